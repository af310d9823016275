"""Min-cost flow on small graphs, for plans that are made on the driver."""

from __future__ import annotations

import heapq
import math


class Flow:
    """Primal-dual min-cost flow; capacities and prices may be fractions, whole capacities give whole flows."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[float] = []
        self.price: list[float] = []

    def arc(self, a: int, b: int, room: float, price: float) -> int:
        for x, y, r, p in ((a, b, room, price), (b, a, 0, -price)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.price.append(p)
        return len(self.to) - 2

    def sent(self, arc: int) -> float:
        return self.room[arc ^ 1]

    def run(self, s: int, t: int, amount: float) -> float:
        """Send up to ``amount`` from s to t at the least cost; the cost. Prices must not be negative."""
        height = [0.0] * len(self.out)
        cost, least = 0.0, amount * 1e-12
        while amount > least:
            far = self._distances(s, height, least)
            if far[t] == math.inf:
                break
            # nodes farther than t get t's distance, which keeps every reduced price at 0 or above
            height = [h + min(f, far[t]) for h, f in zip(height, far, strict=True)]
            sent = self._push_tight(s, t, amount, height, least)
            cost += sent * (height[t] - height[s])
            amount -= sent
        return cost

    def _distances(self, s: int, height: list[float], least: float) -> list[float]:
        far = [math.inf] * len(self.out)
        far[s] = 0.0
        heap = [(0.0, s)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in self.out[x]:
                if self.room[e] > least:
                    y = self.to[e]
                    nd = d + max(0.0, self.price[e] + height[x] - height[y])
                    if nd < far[y] - 1e-15:
                        far[y] = nd
                        heapq.heappush(heap, (nd, y))
        return far

    def _push_tight(self, s: int, t: int, amount: float, height: list[float], least: float) -> float:
        """Fill the paths of arcs without reduced price, depth first, until none is found."""
        next_arc, dead, total = [0] * len(self.out), [False] * len(self.out), 0.0
        while amount - total > least:
            path: list[int] = []
            on, x = {s}, s
            while x != t:
                arcs = self.out[x]
                while next_arc[x] < len(arcs):
                    e = arcs[next_arc[x]]
                    y = self.to[e]
                    if self.room[e] > least and not dead[y] and y not in on and self.price[e] + height[x] - height[y] <= 1e-9:
                        path.append(e)
                        on.add(y)
                        x = y
                        break
                    next_arc[x] += 1
                else:
                    if x == s:
                        return total
                    dead[x] = True
                    on.discard(x)
                    x = self.to[path.pop() ^ 1]
                    next_arc[x] += 1
            step = min(amount - total, min(self.room[e] for e in path))
            for e in path:
                self.room[e] -= step
                self.room[e ^ 1] += step
            total += step
        return total
