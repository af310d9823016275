"""Mixing sources to target weights."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.tokens import TOKENIZERS, with_token_count
from framewright.operators.numbering import hashed_rank
from framewright.session import few_rows, scratch_path

#: Sources a mix may have; more raise ValueError. They and sums of one row each are all that reaches the driver.
MAX_TARGETS = 20_000
#: Tokens of a block, and of an output shard, about.
BLOCK_TOKENS, SHARD_TOKENS = 20_000, 2_000_000
#: Subtrees of the splitting tree that the driver makes; tasks split them further.
SUBTREES = 256
#: Hash cells of the blocks of a source, for sums along their permuted order.
CELLS = 1024
#: Dealt blocks (about 40 bytes each) that are broadcast to the documents; more are joined by a shuffle.
BROADCAST_BLOCKS = 200_000
#: Blocks of a node up to which the draw is exact; the generator's own limit is 10 ** 9. Larger nodes draw from the normal approximation.
EXACT_DRAW = 900_000_000


def draw_left(have: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """``take`` blocks drawn without replacement from a node that has ``have`` of every source."""
    total = int(have.sum())
    if not total:
        return have
    if total <= EXACT_DRAW:
        return rng.multivariate_hypergeometric(have, take, method="marginals")
    out, rest, left = np.zeros_like(have), total, take
    for i, k in enumerate(int(x) for x in have):
        mean = left * k / rest if rest else 0.0
        spread = math.sqrt(max(0.0, mean * (1 - k / rest) * (rest - left) / max(1, rest - 1))) if rest else 0.0
        out[i] = min(k, left, max(0, left - (rest - k), round(rng.normal(mean, spread))))
        rest, left = rest - k, left - int(out[i])
    return out


def _halves(lo: int, hi: int, have: np.ndarray, start: np.ndarray, seed: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """The two children of a node: its left half draws its blocks, the right half gets the others, which follow in the permuted order."""
    mid = (lo + hi) // 2
    take = (int(have.sum()) * (mid - lo) + (hi - lo) // 2) // (hi - lo)
    left = draw_left(have, take, np.random.default_rng([seed, lo, hi]))
    return [(lo, mid, left, start), (mid, hi, have - left, start + left)]


def _leaves(lo: int, hi: int, have: np.ndarray, start: np.ndarray, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    todo = [(lo, hi, have, start)]
    while todo:
        lo, hi, have, start = todo.pop()
        if hi - lo == 1:
            yield lo, have, start
        else:
            todo += _halves(lo, hi, have, start, seed)


def split_quotas(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Exact block quotas of every shard (shards x sources).

    A tree halves the shards; at each node the blocks of the left half are drawn from the node's
    blocks without replacement, by a multivariate hypergeometric draw, so every way of dealing
    them out is equally likely and the columns add up to ``counts``. Each node has its own
    generator, seeded by its place.
    """
    out = np.zeros((shards, len(counts)), dtype=np.int64)
    have = np.asarray(counts, dtype=np.int64)
    for shard, own, _ in _leaves(0, shards, have, np.zeros_like(have), seed):
        out[shard] = own
    return out


def _expand(names: list[str], seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The runs of the shards below a node: shard, source, first place and number of its blocks in the source's permuted order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node in batch.to_pylist():
                rows: list[tuple[int, str, int, int]] = []
                for shard, have, start in _leaves(node["lo"], node["hi"], np.asarray(node["have"], np.int64), np.asarray(node["start"], np.int64), seed):
                    rows += [(shard, names[i], int(start[i]), int(have[i])) for i in np.flatnonzero(have)]
                    if len(rows) > 20_000:
                        yield _runs(rows)
                        rows = []
                yield _runs(rows)

    return run


def _runs(rows: list[tuple[int, str, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["shard", "source", "start", "n"])


def shard_runs(docs: DataFrame, counts: dict[str, int], shards: int, seed: int) -> DataFrame:
    """``(shard, source, start, n)``: the disjoint runs of permuted blocks that the splitting tree gives the shards.

    The driver splits the tree down to SUBTREES nodes, tasks split these further, so the number of
    shards is not bounded by what one process holds. The same seed gives the quotas of ``split_quotas``.
    """
    names = sorted(counts)
    have = np.asarray([counts[s] for s in names], np.int64)
    nodes = [(0, shards, have, np.zeros_like(have))]
    while len(nodes) < SUBTREES and any(hi - lo > 1 for lo, hi, *_ in nodes):
        nodes = [child for lo, hi, own, start in nodes for child in (_halves(lo, hi, own, start, seed) if hi - lo > 1 else [(lo, hi, own, start)])]
    rows = [(int(lo), int(hi), own.tolist(), start.tolist()) for lo, hi, own, start in nodes]
    spark = docs.sparkSession
    tree = spark.createDataFrame(rows, "lo bigint, hi bigint, have array<bigint>, start array<bigint>")
    if shards > SUBTREES:
        tree = tree.repartition(min(len(rows), 4 * spark.sparkContext.defaultParallelism), "lo")
    return tree.mapInArrow(_expand(names, seed), "shard bigint, source string, start bigint, n bigint")


def last_pass(sums: DataFrame, rest: Column, seed: int) -> DataFrame:
    """``(source, block, most)``: the blocks of a source's last, partial pass, from ``sums`` (``source, block, tokens``).

    Blocks come in the order of a hash; those that end within ``rest`` tokens are whole (``most`` -1),
    the one that crosses it may give ``most``. Sums run over hash cells first, and over blocks only
    inside the one cell that crosses.
    """
    h = F.xxhash64("block", F.lit(seed + 3))
    celled = sums.withColumn("__h", h).withColumn("__c", F.pmod(F.col("__h"), F.lit(CELLS)).cast("int"))
    per = celled.groupBy(F.col("source").alias("__s"), F.col("__c").alias("__cell")).agg(F.sum("tokens").alias("__t"))
    before = F.coalesce(F.sum("__t").over(Window.partitionBy("__s").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = per.withColumn("__before", before)
    joined = celled.join(cells, (F.col("source") == F.col("__s")) & (F.col("__c") == F.col("__cell"))).withColumn("__rest", rest).filter("__before < __rest")
    whole = joined.filter("__before + __t <= __rest").select("source", "block", F.lit(-1).cast("bigint").alias("most"))
    run = F.sum("tokens").over(Window.partitionBy("source", "__c").orderBy("__h", "block").rowsBetween(Window.unboundedPreceding, 0))
    crossing = joined.filter("__before + __t > __rest").withColumn("__end", F.col("__before") + run)
    part = crossing.filter("__end - tokens < __rest").select("source", "block", F.when(F.col("__end") <= F.col("__rest"), F.lit(-1)).otherwise(F.col("__rest") - F.col("__end") + F.col("tokens")).cast("bigint").alias("most"))
    return whole.unionByName(part)


def plan_mix(stats: dict[str, tuple[int, int]], targets: list[tuple[str, float, int]], total_tokens: int | None = None) -> tuple[dict[str, dict], float]:
    """Quota of every source. ``stats``: source -> (documents, tokens). The total is the largest at which no cap is broken.

    Weights of sources without tokens are shared out among the others in proportion. A weight or
    cap that is null, zero or below counts as zero.
    """
    usable = {s: (w, r) for s, w, r in targets if w and w > 0 and r and r > 0 and stats.get(s, (0, 0))[1] > 0}
    weight = sum(w for w, _ in usable.values())
    total = min((stats[s][1] * r * weight / w for s, (w, r) in usable.items()), default=0.0)
    if total_tokens is not None:
        total = min(total, total_tokens)
    plan = {}
    for s, (w, r) in usable.items():
        tokens = stats[s][1]
        quota = min(math.floor(w / weight * total + 1e-6), tokens * r)
        plan[s] = {"share": w / weight, "tokens": tokens, "quota": quota, "passes": quota // tokens, "rest": quota % tokens}
    return plan, total


def mix_sources(
    docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", total_tokens: int | None = None,
    seed: int = 7, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS,
) -> DataFrame:
    """The mixed corpus: ``(shard, position, source, doc_id, copy, n_tokens, text)``.

    Every source of ``targets`` (``source``, ``weight``, ``max_repeats``) gives its weight of the
    total size in tokens; the total is the largest that needs no document more than
    ``max_repeats`` times (or ``total_tokens``, if that is less). Source names are compared in
    lower case without outer blanks; documents of other or null sources, and texts without a
    token, are not used. Sources without documents leave their weight to the others. A source's
    last, partial pass stops before the document that would go over its quota, so a share is off
    by less than one document. Of targets that are named twice the first counts.

    Documents are dealt into blocks of about BLOCK_TOKENS by a hash of their key. Whole passes use all
    blocks, the last pass a prefix of the permuted blocks and of one block's documents. A
    multivariate hypergeometric splitting tree gives every output shard (of about SHARD_TOKENS) its
    exact block quota of each source (``shard_runs``), the shards draw disjoint runs of the permuted
    blocks, and each shard is shuffled by itself. Blocks, permutation, tree and runs are made in
    tasks; one row of sums per source reaches the driver. A shard is some hundred blocks at any
    size, so no task holds more, and a source of any share is never gathered in one task. Repeated
    rows of a document count as documents; null keys are dropped. No documents, or no targets, give
    no rows.
    """
    spark = docs.sparkSession
    wanted: dict[str, tuple[float, int]] = {}
    for name, weight, repeats in few_rows(targets.select(F.lower(F.trim(F.col("source"))), F.col("weight").cast("double"), F.col("max_repeats").cast("int")), "mix targets", MAX_TARGETS):
        if name is not None:
            wanted.setdefault(name, (weight, repeats))
    named = docs.select(F.lower(F.trim(F.col(f"`{source}`"))).alias("source"), F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    known = F.broadcast(spark.createDataFrame([(s,) for s in sorted(wanted)], "source string"))
    used = named.filter(F.col("doc_id").isNotNull() & (F.length("text") > 0)).join(known, "source", "left_semi")
    path = scratch_path(spark, "mix")
    with_token_count(used, "text", "n_tokens", tokenizer, folder).write.parquet(path)
    sized = spark.read.parquet(path).filter("n_tokens > 0")
    stats = {r[0]: (r[1], r[2]) for r in sized.groupBy("source").agg(F.count(F.lit(1)), F.sum("n_tokens")).collect()}
    plan, _ = plan_mix(stats, [(s, w, r) for s, (w, r) in wanted.items()], total_tokens)
    plan = {s: p for s, p in plan.items() if p["quota"] > 0}
    out = "shard bigint, position int, source string, doc_id bigint, copy int, n_tokens int, text string"
    if not plan:
        return spark.createDataFrame([], out)

    facts = F.broadcast(spark.createDataFrame([(s, max(1, math.ceil(p["tokens"] / BLOCK_TOKENS)), p["passes"], p["rest"]) for s, p in sorted(plan.items())], "source string, blocks bigint, passes int, rest bigint"))
    placed = sized.join(facts.select("source", "blocks"), "source").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks"))).drop("blocks")
    sums = _kept(placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")), "blocks").join(facts.drop("blocks"), "source")
    whole = sums.filter("passes > 0").select("source", "block", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("copy"), F.lit(-1).cast("bigint").alias("most"))
    part = last_pass(sums, F.col("rest"), seed).join(facts.select("source", F.col("passes").alias("copy")), "source").select("source", "block", "copy", "most")
    entries = _kept(hashed_rank(whole.unionByName(part).withColumn("entry", F.xxhash64("block", "copy")), ["source"], "entry", seed, "place", CELLS), "entries")
    counts = {r[0]: r[1] for r in entries.groupBy("source").agg(F.count(F.lit(1))).collect()}
    shards = max(1, round(sum(p["quota"] for p in plan.values()) / SHARD_TOKENS))
    slots = shard_runs(docs, counts, shards, seed).select("shard", "source", F.explode(F.sequence(F.col("start") + 1, F.col("start") + F.col("n"))).alias("place"))
    dealt = _kept(entries.join(slots, ["source", "place"]).select("source", "block", "copy", "most", "shard"), "dealt")
    joined = placed.join(F.broadcast(dealt) if sum(counts.values()) <= BROADCAST_BLOCKS else dealt, ["source", "block"])
    run = F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0))
    cut_off = joined.filter("most >= 0").withColumn("run", run).filter("run <= most").drop("run")
    mixed = joined.filter("most < 0").unionByName(cut_off)
    position = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("doc_id", "copy", F.lit(seed + 2)), "doc_id", "copy", "text"))
    return mixed.withColumn("position", position).select("shard", "position", "source", "doc_id", "copy", "n_tokens", "text")


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Reached shares: ``(source, weight, max_repeats, n_rows, n_tokens, share, most_copies)``, one row per target."""
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_tokens").alias("n_tokens"), (F.max("copy") + 1).alias("most_copies"))
    total = got.agg(F.sum("n_tokens").alias("total"))
    asked = targets.select(F.lower(F.trim(F.col("source"))).alias("source"), "weight", "max_repeats")
    zero = F.lit(0)
    return asked.join(F.broadcast(got), "source", "left").crossJoin(F.broadcast(total)).select(
        "source", "weight", "max_repeats", F.coalesce("n_rows", zero).alias("n_rows"), F.coalesce("n_tokens", zero).alias("n_tokens"),
        F.coalesce(F.try_divide("n_tokens", "total"), F.lit(0.0)).alias("share"), F.coalesce("most_copies", zero).alias("most_copies"),
    )


