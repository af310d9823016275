"""References to records that do not exist, from signed reference and existence counts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators.components import join_one
from framewright.operators.latest import first_arrival
from framewright.session import scratch_path

#: Orphan cells (about 40 bytes each) that are broadcast; they are counted first, and more are joined by a shuffle.
BROADCAST_CELLS = 50_000

def reference_counts(deltas: DataFrame, *by: str) -> DataFrame:
    """Current state per key from signed deltas ``(key_id, ref_delta, exist_delta)``.

    Deltas may come in any order and in any number of batches, and a state is a delta again, so it
    can be maintained: ``reference_counts(state_as_deltas.unionByName(new))``. Null keys are
    dropped. ``by``: further grouping columns. Result: ``by..., key_id, refs, existence``.
    """
    return deltas.filter("key_id is not null").groupBy(*by, "key_id").agg(F.sum("ref_delta").alias("refs"), F.sum("exist_delta").alias("existence"))


def orphan_keys(state: DataFrame) -> DataFrame:
    """Keys with positive references and zero existence."""
    return state.filter("refs > 0 and existence <= 0")


def existence_deltas(target: DataFrame, key: str = "id", at: str = "ingested_at", deleted: str = "deleted_at") -> DataFrame:
    """``(key_id, at, exist_delta)``: +1 at an id's first arrival, -1 at the ``deleted`` time of its latest row that has one.

    Rows without an id are left out; a null arrival counts as the earliest time.
    """
    long_ago = F.lit("0001-01-01 00:00:00").cast(target.schema[at].dataType)
    when = F.coalesce(F.col(f"`{at}`"), long_ago)
    one = (
        target.filter(F.col(f"`{key}`").isNotNull())
        .groupBy(F.col(f"`{key}`").cast("bigint").alias("key_id"))
        .agg(F.min(when).alias("born"), F.max_by(F.col(f"`{deleted}`"), F.when(F.col(f"`{deleted}`").isNotNull(), when)).alias("gone"))
    )
    events = F.array(F.struct(F.col("born").alias("at"), F.lit(1).alias("exist_delta")), F.struct(F.col("gone").alias("at"), F.lit(-1).alias("exist_delta")))
    return one.select("key_id", F.inline(events)).filter("at is not null")


def timeline(deltas: DataFrame) -> DataFrame:
    """Existence deltas folded to one row per key: ``key_id, born, gone, existence``.

    ``born`` is when the count first rises, ``gone`` when it last falls (null if it never does),
    ``existence`` the count after all deltas. The deltas arrive grouped by key, so no second
    shuffle is needed.
    """
    rise, fall = (F.when(F.col("exist_delta") > 0, F.col("at")), F.when(F.col("exist_delta") < 0, F.col("at")))
    return deltas.groupBy("key_id").agg(F.min(rise).alias("born"), F.max(fall).alias("gone"), F.sum("exist_delta").alias("existence"))


def _existence_at(at: Column) -> Column:
    """The sum of a key's existence deltas up to a moment."""
    return F.coalesce((F.col("born") <= at).cast("int"), F.lit(0)) - F.coalesce((F.col("gone") <= at).cast("int"), F.lit(0))


def _state_at(at: Column) -> Column:
    """What a reference made at a moment of zero existence is: missing, late or deleted; null where the key existed."""
    return F.when(F.col("born").isNull(), F.lit("missing")).when(F.col("born") > at, F.lit("late")).when(_existence_at(at) <= 0, F.lit("deleted"))


def _first_references(tables: dict[str, DataFrame], fields: list[str], key: str, at: str) -> DataFrame:
    """Every id of the tables once, at its first arrival, as a written table ``(source, row_id, first_at, fields...)``; ``source`` numbers the tables."""
    out: DataFrame | None = None
    for i, df in enumerate(tables.values()):
        one = first_arrival(df, key, at, {f: f for f in fields}).select(F.lit(i).cast("tinyint").alias("source"), F.col("row_id").cast("bigint").alias("row_id"), "first_at", *(F.col(f).cast("bigint").alias(f) for f in fields))
        out = one if out is None else out.unionByName(one)
    assert out is not None
    return _written(out)


def _written(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "orphans")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _period() -> Column:
    return F.trunc("first_at", "month")


def orphan_cells(base: DataFrame, field: str, target: DataFrame, key: str = "id", at: str = "ingested_at") -> DataFrame:
    """The cells of signed counts that hold orphans of a field: ``(source, key_id, period, refs, born, gone, state)``.

    ``refs`` is the sum of the reference deltas of a key in a month (+1 at a row's first arrival,
    combined before the shuffle; a key of a third of all rows has no more cells than there are
    months), existence the sum of the key's existence deltas up to the cell's first and last
    reference. A cell of positive references and zero existence throughout has a ``state``;
    where the existence changes inside the cell, ``state`` is null and the rows decide.
    """
    refs = base.filter(F.col(field).isNotNull()).groupBy("source", F.col(field).alias("key_id"), _period().alias("period")).agg(F.count(F.lit(1)).alias("refs"), F.min("first_at").alias("low"), F.max("first_at").alias("high"))
    joined = refs.join(timeline(existence_deltas(target, key, at)).select("key_id", "born", "gone"), "key_id", "left")
    low, high = F.col("low"), F.col("high")
    changes = F.coalesce((F.col("born") > low) & (F.col("born") <= high), F.lit(False)) | F.coalesce((F.col("gone") > low) & (F.col("gone") <= high), F.lit(False))
    found = joined.filter((F.col("refs") > 0) & ((_existence_at(low) <= 0) | (_existence_at(high) <= 0) | changes))
    return _written(found.select("source", "key_id", "period", "refs", "born", "gone", F.when(~changes, _state_at(low)).alias("state")))


def _expanded(base: DataFrame, cells: DataFrame, field: str) -> DataFrame:
    """``(source, row_id, field_name, key_id, ref_at, state)``: the orphan rows of a field's cells."""
    cell = F.xxhash64("source", "key_id", "period").alias("cell")
    rows = base.filter(F.col(field).isNotNull()).select("source", "row_id", "first_at", F.col(field).alias("key_id"), _period().alias("period")).select("source", "row_id", "first_at", "key_id", cell)
    looked = cells.select(cell, F.col("key_id").alias("__key"), "born", "gone", F.col("refs").alias("__k"))
    size = cells.count()
    joined = rows.join(F.broadcast(looked.drop("__k")), "cell") if size <= BROADCAST_CELLS else join_one(rows, looked, "cell")
    return joined.filter("__key = key_id").select("source", "row_id", F.lit(field).alias("field_name"), "key_id", F.col("first_at").alias("ref_at"), _state_at(F.col("first_at")).alias("state")).filter("state is not null")


def _table_name(tables: dict[str, DataFrame]) -> Column:
    names = F.array(*(F.lit(n) for n in tables))
    return names[F.col("source").cast("int")].alias("table_name")


def orphan_rows(tables: dict[str, DataFrame], targets: dict[str, DataFrame], key: str = "id", at: str = "ingested_at") -> DataFrame:
    """``(table_name, row_id, field_name, key_id, ref_at, state)``: every reference that met no existing record.

    ``targets`` maps a reference column to the table it points into. A redelivered id of a
    referring table counts once, at its first arrival; rows without an id are left out and null
    references are none. States: ``missing`` (no record of that id), ``late`` (it first arrived
    after the referring row did), ``deleted`` (withdrawn at or before that moment); late goes
    before deleted. An empty target makes every reference missing; empty tables give no rows;
    extra columns, also of equal names on both sides, play no part.

    Keys with positive references and zero existence come from the signed counts (``orphan_cells``);
    only those cells are expanded to their rows: by a broadcast of up to BROADCAST_CELLS counted
    cells, beyond that by a shuffle, where cells of very many rows are looked up in a broadcast of
    their few entries, so no task gets a hot key.
    """
    base = _first_references(tables, list(targets), key, at)
    out: DataFrame | None = None
    for field, target in targets.items():
        one = _expanded(base, orphan_cells(base, field, target, key, at), field)
        out = one if out is None else out.unionByName(one)
    assert out is not None
    return out.select(_table_name(tables), "row_id", "field_name", "key_id", "ref_at", "state")


def orphan_report(tables: dict[str, DataFrame], targets: dict[str, DataFrame], key: str = "id", at: str = "ingested_at") -> DataFrame:
    """Orphans counted per table, field, state and month of the reference: ``(table_name, field_name, state, period, n)``.

    The counts are those of the orphan cells; only cells in which the existence changes are expanded to rows.
    """
    base = _first_references(tables, list(targets), key, at)
    out: DataFrame | None = None
    for field, target in targets.items():
        cells = orphan_cells(base, field, target, key, at)
        whole = cells.filter("state is not null").select("source", "state", "period", F.col("refs").alias("n"))
        mixed = _expanded(base, cells.filter("state is null"), field).select("source", "state", F.trunc("ref_at", "month").alias("period"), F.lit(1).cast("bigint").alias("n"))
        one = whole.unionByName(mixed).withColumn("field_name", F.lit(field))
        out = one if out is None else out.unionByName(one)
    assert out is not None
    named = out.select(_table_name(tables), "field_name", "state", F.date_format("period", "yyyy-MM").alias("period"), "n")
    return named.groupBy("table_name", "field_name", "state", "period").agg(F.sum("n").alias("n"))


class OrphanLedger:
    """Signed reference and existence counts per key, kept as tables in a folder and brought up to date by batches of rows.

    Kept are the counts ``(table_name, field_name, key_id, refs, existence)``, of every referring id
    its references, and of every target id whether it is withdrawn. A batch (new, redelivered and
    late rows in any order) is compared with these; what changes makes signed deltas: a new
    reference +1, a reference of an id that names another key now -1 and +1, a new record +1, a
    withdrawal -1. So a batch costs its own size plus one merge, never a recount of all rows.
    """

    def __init__(self, spark: SparkSession, fields: list[str], folder: str | None = None, key: str = "id", at: str = "ingested_at", deleted: str = "deleted_at") -> None:
        self.spark, self.fields, self.key, self.at, self.deleted = spark, fields, key, at, deleted
        self.folder = folder or scratch_path(spark, "ledger")
        refs = ", ".join(f"{f} bigint" for f in fields)
        self.rows = spark.createDataFrame([], f"table_name string, row_id bigint, {refs}, last_at timestamp")
        self.records = spark.createDataFrame([], "field_name string, key_id bigint, gone boolean")
        self.state = spark.createDataFrame([], "table_name string, field_name string, key_id bigint, refs bigint, existence bigint")
        self.tables: set[str] = set()

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def apply(self, tables: dict[str, DataFrame], targets: dict[str, DataFrame]) -> None:
        """Take in a batch of referring rows per table and of target rows per field; either may be empty."""
        names = sorted(self.tables | set(tables))
        deltas: list[DataFrame] = []
        if tables:
            new: DataFrame | None = None
            for name, df in tables.items():
                when = F.col(f"`{self.at}`").cast("timestamp")
                one = df.filter(F.col(f"`{self.key}`").isNotNull()).groupBy(F.col(f"`{self.key}`").cast("bigint").alias("row_id")).agg(
                    *(F.max_by(F.col(f"`{f}`").cast("bigint"), F.when(F.col(f"`{f}`").isNotNull(), F.coalesce(when, F.lit("0001-01-01").cast("timestamp")))).alias(f) for f in self.fields), F.max(when).alias("last_at")
                ).select(F.lit(name).alias("table_name"), "row_id", *self.fields, "last_at")
                new = one if new is None else new.unionByName(one)
            assert new is not None
            old = self.rows.select("table_name", "row_id", *(F.col(f).alias(f"old_{f}") for f in self.fields), F.col("last_at").alias("old_at"))
            both = new.join(old, ["table_name", "row_id"], "full_outer")
            newer = F.col("last_at").isNotNull() & (F.col("old_at").isNull() | (F.col("last_at") >= F.col("old_at")))
            now = [F.when(newer, F.coalesce(f, f"old_{f}")).otherwise(F.coalesce(f"old_{f}", f)).alias(f"now_{f}") for f in self.fields]
            merged = self._keep(both.select("table_name", "row_id", *(f"old_{f}" for f in self.fields), *now, F.greatest("last_at", "old_at").alias("last_at")), "merge")
            changed = F.array(*(F.struct(F.lit(f).alias("field_name"), k.alias("key_id"), F.lit(sign).cast("bigint").alias("ref_delta"), (~F.col(f"old_{f}").eqNullSafe(F.col(f"now_{f}"))).alias("differs")) for f in self.fields for k, sign in ((F.col(f"old_{f}"), -1), (F.col(f"now_{f}"), 1))))
            deltas.append(merged.select("table_name", F.inline(changed)).filter("differs and key_id is not null").select("table_name", "field_name", "key_id", "ref_delta", F.lit(0).cast("bigint").alias("exist_delta")))
            self.rows = merged.select("table_name", "row_id", *(F.col(f"now_{f}").alias(f) for f in self.fields), "last_at")
        if targets:
            came: DataFrame | None = None
            for field, df in targets.items():
                one = df.filter(F.col(f"`{self.key}`").isNotNull()).groupBy(F.col(f"`{self.key}`").cast("bigint").alias("key_id")).agg((F.count(F.col(f"`{self.deleted}`")) > 0).alias("gone")).select(F.lit(field).alias("field_name"), "key_id", "gone")
                came = one if came is None else came.unionByName(one)
            assert came is not None
            both = came.join(self.records.select("field_name", "key_id", F.col("gone").alias("was_gone")), ["field_name", "key_id"], "full_outer")
            known, gone = F.col("was_gone").isNotNull(), F.coalesce("gone", F.lit(False)) | F.coalesce("was_gone", F.lit(False))
            merged = self._keep(both.select("field_name", "key_id", gone.alias("gone"), (F.when(known, 0).otherwise(1) - (gone & ~F.coalesce("was_gone", F.lit(False))).cast("int")).cast("bigint").alias("exist_delta")), "records")
            self.records = merged.select("field_name", "key_id", "gone")
            each = F.explode(F.array(*(F.lit(n) for n in names))) if names else F.explode(F.array().cast("array<string>"))
            deltas.append(merged.filter("exist_delta <> 0").select(each.alias("table_name"), "field_name", "key_id", F.lit(0).cast("bigint").alias("ref_delta"), "exist_delta"))
        fresh = set(tables) - self.tables
        if fresh and self.tables:
            # a table that comes later has to learn what exists
            past = self.records.select(F.explode(F.array(*(F.lit(n) for n in sorted(fresh)))).alias("table_name"), "field_name", "key_id", F.lit(0).cast("bigint").alias("ref_delta"), F.when(F.col("gone"), 0).otherwise(1).cast("bigint").alias("exist_delta"))
            deltas = [d.filter(~F.col("table_name").isin(sorted(fresh)) | (F.col("exist_delta") == 0)) for d in deltas] + [past]
        self.tables |= set(tables)
        state = self.state.select("table_name", "field_name", "key_id", F.col("refs").alias("ref_delta"), F.col("existence").alias("exist_delta"))
        for d in deltas:
            state = state.unionByName(d)
        self.state = self._keep(reference_counts(state, "table_name", "field_name"), "state")

    def orphans(self) -> DataFrame:
        """``(table_name, field_name, key_id, refs)``: keys with positive references and zero existence."""
        return orphan_keys(self.state).select("table_name", "field_name", "key_id", "refs")


def current_orphans(tables: dict[str, DataFrame], targets: dict[str, DataFrame], key: str = "id", at: str = "ingested_at") -> DataFrame:
    """``(table_name, field_name, key_id, refs)``: keys that rows refer to and that no record holds after all deltas, counted at once.

    Every row of a referring table is a +1 reference delta, of a redelivered id only one; the
    counts are combined before the shuffle, and the keys of all tables meet the existence deltas
    in the same aggregation. ``OrphanLedger`` keeps the same counts over batches.
    """
    out: DataFrame | None = None
    for field, target in targets.items():
        gone = existence_deltas(target, key, at).select("key_id", F.lit(0).cast("bigint").alias("ref_delta"), "exist_delta")
        for name, df in tables.items():
            refs = first_arrival(df, key, at, {field: field}).select(F.col(field).cast("bigint").alias("key_id"), F.lit(1).cast("bigint").alias("ref_delta"), F.lit(0).alias("exist_delta"))
            one = orphan_keys(reference_counts(refs.unionByName(gone))).select(F.lit(name).alias("table_name"), F.lit(field).alias("field_name"), "key_id", "refs")
            out = one if out is None else out.unionByName(one)
    assert out is not None
    return out
