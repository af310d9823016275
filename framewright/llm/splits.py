"""Splits that keep related records together, by a min-cost flow over bundles of components."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.flow import Flow
from framewright.operators.components import connected_components, value_edges
from framewright.operators.numbering import hashed_rank
from framewright.session import cut, few_rows

#: Bundles of components of identical size and label counts planned as they are: those of most rows, so every component of a
#: MAX_PROFILES-th of all rows or more is among them. Components of rarer profiles are bundled by class; see ``grouped_split``.
MAX_PROFILES = 8192
#: Classes of the rarer profiles: STEPS sizes per doubling, the commonest label if it is one of CLASS_LABELS, and its share in eighths.
STEPS, CLASS_LABELS = 8, 64
#: Labels that have quotas; more raise ValueError.
MAX_LABELS = 100_000
#: Cost of a row beyond the quota of its label in a split, beyond the quota of the split, and beyond its bundle's.
LABEL_COST, SPLIT_COST, BUNDLE_COST = 1, 8, 0.25
#: Steps in which the price of the one unit that goes over a quota in part is told apart; few steps are few phases of the flow.
PRICE_STEPS = 16
#: Passes of the last exchange, and bundles of one size that take part in it.
MAX_PASSES, MAX_LIKE = 10, 48
#: A group of at least a HOT-th of all rows is joined apart; there are at most HOT of them.
HOT = 200


def linked_groups(records: DataFrame, key: str, links: dict[str, Column]) -> DataFrame:
    """``(key, group_id)``: records that share a value of any link column, directly or through others.

    ``group_id`` is the smallest key of the group. Null link values link nothing; a record without
    links is its own group; repeated rows of a key count once and bring all their links. Every link
    value is named by the smallest key that has it (combined before the shuffle, and hot values
    joined apart, so a value of a third of all rows is no burden); records then are edges between
    such names, and only the distinct edges enter the connected components.
    """
    base = cut(records.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), *(c.alias(n) for n, c in links.items())))
    edges: DataFrame | None = None
    for name in links:
        one = value_edges(base.select("id", name), name)
        edges = one if edges is None else edges.unionByName(one)
    assert edges is not None
    parts = connected_components(edges.filter("src <> dst").distinct())
    ids = base.select("id").distinct()
    return ids.join(parts, F.col("id") == F.col("node"), "left").select(F.col("id").alias(key), F.coalesce("component", "id").alias("group_id"))


def solve_quotas(bundles: list[tuple[str, int, int]], shares: list[float]) -> list[list[int]]:
    """``allot`` for bundles (label, components, rows) of one label each."""
    return allot([(n, {label: rows}) for label, n, rows in bundles], shares)


def allot(bundles: list[tuple[int, dict[str, int]]], shares: list[float]) -> list[list[int]]:
    """How many components of every bundle go to every split.

    A bundle is (components, rows of every label in them). Sizes are settled from the largest down,
    each by one min-cost flow of whole components (``flow_of_size``), against the quotas of all rows
    of that size or more, less what larger components took; so every deviation that large
    components leave is made up by smaller ones, and each split gets its share of large and small.
    At last components are moved, and exchanged with others of equal size, as long as that lowers
    the cost over all quotas. For components of one size and one label each, the flow is least;
    over several sizes or mixed labels the result is not proved least.
    """
    k = len(shares)
    out = [[0] * k for _ in bundles]
    each = [{x: r / n for x, r in counts.items()} for n, counts in bundles]
    size = [sum(e.values()) for e in each]
    left: dict[str, list[float]] = {}
    overall = [0.0] * k
    same: dict[float, list[int]] = {}
    for i in range(len(bundles)):
        same.setdefault(round(size[i], 6), []).append(i)
    for s in sorted(same, reverse=True):
        here = same[s]
        for i in here:
            for x, r in bundles[i][1].items():
                room = left.setdefault(x, [0.0] * k)
                for j in range(k):
                    room[j] += r * shares[j]
                    overall[j] += r * shares[j]
        for i, row in zip(here, flow_of_size([(bundles[i][0], each[i]) for i in here], s, left, overall, shares), strict=True):
            out[i] = row
            for j in range(k):
                overall[j] -= row[j] * size[i]
                for x, r in each[i].items():
                    left[x][j] -= row[j] * r
    order = sorted(range(len(bundles)), key=lambda i: (-size[i], i))
    _exchange(order, each, size, out, left, overall, [j for j in range(k) if shares[j] > 0])
    return out


def _quota_arcs(flow: Flow, a: int, b: int, quota: float, unit: float, most: int, cost: float) -> list[int]:
    """Arcs from a to b for up to ``most`` units of ``unit`` rows each: free below the quota, then at the price of the rows that go over it."""
    whole = min(most, max(0, math.floor(quota / unit + 1e-9)))
    arcs = [flow.arc(a, b, whole, 0.0)] if whole else []
    if whole < most:
        over = min(1.0, max(0.0, 1 - (quota / unit - whole))) if quota > 0 else 1.0
        arcs.append(flow.arc(a, b, 1, math.ceil(over * PRICE_STEPS) / PRICE_STEPS * unit * cost))
        if whole + 1 < most:
            arcs.append(flow.arc(a, b, most - whole - 1, unit * cost))
    return arcs


def flow_of_size(bundles: list[tuple[int, dict[str, float]]], size: float, left: dict[str, list[float]], overall: list[float], shares: list[float]) -> list[list[int]]:
    """Components of every bundle (components, rows of every label in one) to every split, for bundles of one size, at the least cost.

    Components flow from their bundle to (commonest label, split) to split. Each of the three steps
    has arcs that are free up to the bundle's, the label's and the split's quota and cost the rows
    beyond it, so the cost is convex; a bundle's other labels add what they are over already in a
    split. All capacities are whole numbers of components, and so is the flow.
    """
    k = len(shares)
    main = [max(e, key=lambda x: (e[x], x)) for _, e in bundles]
    rows: dict[str, tuple[float, int]] = {}
    for (n, e), x in zip(bundles, main, strict=True):
        r, m = rows.get(x, (0.0, 0))
        rows[x] = (r + n * e[x], m + n)
    labels = sorted(rows)
    total = sum(n for n, _ in bundles)
    at_label = {x: 2 + len(bundles) + i * k for i, x in enumerate(labels)}
    at_split = 2 + len(bundles) + len(labels) * k
    flow = Flow(at_split + k)
    arcs: list[list[list[int]]] = []
    for i, ((n, e), x) in enumerate(zip(bundles, main, strict=True)):
        flow.arc(0, 2 + i, n, 0.0)
        mine: list[list[int]] = []
        for j in range(k):
            if not shares[j]:
                mine.append([])
                continue
            others = sum(LABEL_COST * min(r, max(0.0, r - left[y][j])) for y, r in e.items() if y != x)
            at = at_label[x] + j
            first = len(flow.to)
            _quota_arcs(flow, 2 + i, at, n * size * shares[j], size, n, BUNDLE_COST)
            made = list(range(first, len(flow.to), 2))
            if others:
                for a in made:
                    flow.price[a] += others
                    flow.price[a ^ 1] -= others
            mine.append(made)
        arcs.append(mine)
    for x in labels:
        r, m = rows[x]
        for j in range(k):
            _quota_arcs(flow, at_label[x] + j, at_split + j, left[x][j], r / m, m, LABEL_COST)
    for j in range(k):
        _quota_arcs(flow, at_split + j, 1, overall[j], size, total, SPLIT_COST)
    flow.run(0, 1, total)
    return [[round(sum(flow.sent(a) for a in made)) for made in mine] for mine in arcs]


def _exchange(order: list[int], each: list[dict[str, float]], size: list[float], out: list[list[int]], left: dict[str, list[float]], overall: list[float], open_to: list[int]) -> None:
    """Moves of components, and exchanges between bundles of equal size, while they lower the cost; at most MAX_PASSES times over."""

    def gain(more: dict[str, float], rows: float, a: int, b: int, n: int) -> float:
        before = SPLIT_COST * (max(0.0, -overall[a]) + max(0.0, -overall[b]))
        after = SPLIT_COST * (max(0.0, -overall[a] - n * rows) + max(0.0, -overall[b] + n * rows))
        for x, r in more.items():
            before += LABEL_COST * (max(0.0, -left[x][a]) + max(0.0, -left[x][b]))
            after += LABEL_COST * (max(0.0, -left[x][a] - n * r) + max(0.0, -left[x][b] + n * r))
        return before - after

    def shift(more: dict[str, float], rows: float, a: int, b: int, n: int) -> None:
        overall[a] += n * rows
        overall[b] -= n * rows
        for x, r in more.items():
            left[x][a] += n * r
            left[x][b] -= n * r

    same: dict[float, list[int]] = {}
    for i in order:
        same.setdefault(round(size[i], 6), []).append(i)
    ways = [(a, b) for a in open_to for b in open_to if a != b]
    for _ in range(MAX_PASSES):
        changed = False
        for i in order:
            for a, b in ways:
                n = out[i][a]
                while n and gain(each[i], size[i], a, b, n) <= 1e-6:
                    n //= 2
                if n:
                    shift(each[i], size[i], a, b, n)
                    out[i][a] -= n
                    out[i][b] += n
                    changed = True
        for like in same.values():
            like = like[:MAX_LIKE]
            for i in like:
                for other in like:
                    if i == other:
                        continue
                    more = {x: each[i].get(x, 0.0) - each[other].get(x, 0.0) for x in each[i].keys() | each[other].keys()}
                    for a, b in ways:
                        n = min(out[i][a], out[other][b])
                        while n and gain(more, 0.0, a, b, n) <= 1e-6:
                            n //= 2
                        if n:
                            shift(more, 0.0, a, b, n)
                            out[i][a] -= n
                            out[i][b] += n
                            out[other][b] -= n
                            out[other][a] += n
                            changed = True
        if not changed:
            return


def grouped_split(records: DataFrame, key: str, links: dict[str, Column], label: Column, shares: dict[str, float], seed: int = 11) -> DataFrame:
    """``(key, group_id, group_size, split)``: every key gets a split, linked keys the same one.

    Groups are those of ``linked_groups``. They are bundled by identical size and label counts
    (a null label is one of its own); ``allot`` gives the bundles' components to the splits at the
    least deviation of labels and splits from the asked ``shares`` (which sum to 1), and a bundle's
    members are dealt out in the order of a hash: by counts of hash cells, and by rank only inside
    the one cell where a quota ends. Only the bundles reach the driver, each with the rows of every
    label in it. Where there are more than MAX_PROFILES of them, those of most rows stay as they
    are, and the components of the others are bundled by size class, commonest label and its share;
    such a bundle has the exact label sums of its members, so all rows are planned, and what a split
    gets of it is off by the spread of its members' counts. Every label has its quotas; more than
    MAX_LABELS raise ValueError. A group that is larger than a split's quota makes the shares miss by
    what it is over. Null keys are dropped, repeated rows of a key count once; an empty table gives
    no rows. The same input and seed give the same splits.
    """
    spark = records.sparkSession
    if abs(sum(shares.values()) - 1) > 1e-9 or min(shares.values()) < 0:
        raise ValueError("shares must be non-negative and sum to 1")
    names = list(shares)
    tagged = records.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("bigint").alias(key)).agg(F.max(F.coalesce(label.cast("string"), F.lit(""))).alias("label"))
    groups = cut(linked_groups(records, key, links).join(tagged, key))
    found_labels = sorted(few_rows(groups.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "labels", MAX_LABELS), key=lambda r: (-r["n"], r["label"]))
    total = sum(r["n"] for r in found_labels)
    cells = groups.groupBy("group_id", "label").agg(F.count(F.lit(1)).alias("n"))
    top = cells.groupBy("group_id").agg(F.sum("n").alias("group_size"), F.max(F.struct("n", "label")).alias("top"), F.sort_array(F.collect_list(F.struct("label", "n"))).alias("counts"))
    exact = F.concat_ws(" ", F.col("group_size"), F.hex(F.xxhash64("counts")), F.crc32(F.to_json("counts").cast("binary")))
    common_label = F.when(F.col("top.label").isin([r["label"] for r in found_labels[:CLASS_LABELS]]), F.col("top.label"))
    classed = F.to_json(F.struct(F.floor(STEPS * F.log2("group_size")).alias("size"), common_label.alias("label"), F.floor(F.col("top.n") * 8 / F.col("group_size")).alias("eighths")))
    named = cut(top.select("group_id", "group_size", "counts", exact.alias("exact"), classed.alias("classed")))
    common = named.groupBy("exact").agg(F.sum("group_size").alias("rows")).orderBy(F.col("rows").desc(), "exact").limit(MAX_PROFILES).select("exact", F.lit(True).alias("kept"))
    sized = cut(named.join(F.broadcast(common), "exact", "left").select("group_id", "group_size", "counts", F.when(F.col("kept"), F.col("exact")).otherwise(F.col("classed")).alias("bundle")))
    found = {r["bundle"]: (r["n"], {}) for r in sized.groupBy("bundle").agg(F.count(F.lit(1)).alias("n")).orderBy("bundle").collect()}
    for r in sized.select("bundle", F.inline("counts")).groupBy("bundle", "label").agg(F.sum("n").alias("n")).orderBy("bundle", "label").collect():
        found[r["bundle"]][1][r["label"]] = r["n"]
    quotas = allot(list(found.values()), [shares[s] for s in names])
    rows = [(b, list(itertools.accumulate(q))) for b, q in zip(found, quotas, strict=True)]
    plan = spark.createDataFrame(rows, "bundle string, ends array<bigint>")
    ranked = hashed_rank(sized.drop("counts"), ["bundle"], "group_id", seed, "place").join(F.broadcast(plan), "bundle")
    place = F.col("place")
    pick = F.lit(names[-1])
    for i in reversed(range(len(names) - 1)):
        pick = F.when(place <= F.col("ends")[i], F.lit(names[i])).otherwise(pick)
    chosen = ranked.select("group_id", "group_size", pick.alias("split"))
    big = [r[0] for r in sized.filter(F.col("group_size") * HOT > total).select("group_id").collect()]
    if not big:
        joined = groups.join(chosen, "group_id")
    else:
        is_big = F.col("group_id").isin(big)
        joined = groups.filter(~is_big).join(chosen.filter(~is_big), "group_id").unionByName(groups.filter(is_big).join(F.broadcast(chosen.filter(is_big)), "group_id"))
    return joined.select(key, "group_id", "group_size", "split")


def split_report(assigned: DataFrame) -> DataFrame:
    """``(split, n_keys, n_groups, share)``."""
    total = assigned.agg(F.count(F.lit(1)).alias("total"))
    per = assigned.groupBy("split").agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("group_id") == F.col(assigned.columns[0])).alias("n_groups"))
    return per.crossJoin(F.broadcast(total)).select("split", "n_keys", "n_groups", F.try_divide("n_keys", "total").alias("share"))
