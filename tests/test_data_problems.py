import datetime
import json

from pyspark.sql import functions as F

from framewright.operators.balance import balanced_key_stats, heavy_keys
from framewright.operators.components import connected_components
from framewright.operators.latest import latest_rows
from framewright.operators.numbering import hashed_rank, numbered
from framewright.operators.orphans import OrphanLedger, current_orphans, orphan_report, orphan_rows, reference_counts
from framewright.operators.shred import leaf_levels, nested_table, read_payload


def ts(day):
    return datetime.datetime(2024, 1, day)


def test_latest_rows(spark, rows):
    df = spark.createDataFrame([(1, ts(1), "a"), (1, ts(2), None), (1, ts(2), "b"), (2, None, "c"), (None, ts(1), "d")], "id bigint, at timestamp_ntz, v string")
    assert rows(latest_rows(df, "id", "at", ["id", "v"])) == [(1, "b"), (2, "c")]


def test_components(spark, rows):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (50, 50), (60, 61), (None, 3)]
    got = dict(rows(connected_components(spark.createDataFrame(edges, "src bigint, dst bigint"))))
    assert {k: v for k, v in got.items() if k <= 40} == dict.fromkeys(range(41), 0)
    assert got[100] == 0 and got[50] == 50 and got[61] == 60
    assert rows(connected_components(spark.createDataFrame([], "src bigint, dst bigint"))) == []


def test_numbering(spark, rows):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("id"))
    assert [r[1] for r in rows(numbered(df, [F.col("id")])) if r[0] != r[1]] == []
    ranks = hashed_rank(spark.range(500).select("id", (F.col("id") % 2).alias("g")), ["g"], "id", 1, cells=7)
    assert sorted(r["rank"] for r in ranks.filter("g = 0").collect()) == list(range(1, 251))
    assert rows(numbered(df.limit(0), [F.col("id")])) == []


def test_balanced_key_stats(spark, rows):
    data = [(0, 5, i * 10) for i in range(3000)] + [(0, 6, 1), (0, 6, 1), (1, 5, 7), (0, None, 3), (0, 8, None)]
    df = spark.createDataFrame(data, "family int, key_id bigint, at bigint").repartition(5)
    want = [(0, 5, 3000, 0, 29990, 10), (0, 6, 2, 1, 1, 0), (0, 8, 1, 0, 0, 0), (1, 5, 1, 7, 7, 0)]
    assert rows(balanced_key_stats(df, 8)) == want
    assert rows(balanced_key_stats(df.limit(0))) == []


def test_heavy_keys(spark, rows):
    t = spark.createDataFrame([(1, ts(1))] * 4 + [(None, ts(1))] * 90 + [(2, ts(1))] * 3 + [(3, None)] * 3, "k bigint, ingested_at timestamp_ntz").withColumn("n", F.lit(0))
    assert rows(heavy_keys({"t": t}, ["k"]).select("table_name", "field_name", "key_id")) == [("t", "k", 1)]
    assert rows(heavy_keys({"t": t.limit(0)}, ["k"])) == []


def test_a_tied_key_is_cut_too(spark, monkeypatch):
    from framewright.operators import balance

    rows = spark.range(40000).select(F.lit(0).alias("family"), F.lit(7).cast("bigint").alias("key_id"), F.lit(None).cast("bigint").alias("at"))
    states = balance.balanced_key_stats(rows, 8)
    assert [tuple(r) for r in states.collect()] == [(0, 7, 40000, 0, 0, 0)]
    ready = rows.select("family", "key_id", F.coalesce("at", F.lit(0)).alias("at"), F.pmod(F.monotonically_increasing_id(), F.lit(balance.TIES)).alias("tie"))
    sizes = [r["n"] for r in ready.repartitionByRange(8, "family", "key_id", "at", "tie").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 40000 / 8


def _refs(spark):
    images = spark.createDataFrame([(1, ts(2), None), (1, ts(9), None), (2, ts(1), ts(5)), (3, ts(6), None), (4, ts(1), ts(3)), (None, ts(1), None)], "id bigint, ingested_at timestamp_ntz, deleted_at timestamp_ntz")
    refs = spark.createDataFrame([(10, 1, ts(3)), (11, 2, ts(4)), (12, 2, ts(5)), (13, 3, ts(4)), (13, 3, ts(8)), (14, 9, ts(4)), (15, None, ts(4)), (16, 4, ts(8)), (None, 9, ts(4))], "id bigint, image_id bigint, ingested_at timestamp_ntz").withColumn("deleted_at", F.lit("clash"))
    return refs, images


def test_orphans(spark, rows, monkeypatch):
    refs, images = _refs(spark)
    want = [("t", 12, "image_id", "deleted"), ("t", 13, "image_id", "late"), ("t", 14, "image_id", "missing"), ("t", 16, "image_id", "deleted")]
    out = orphan_rows({"t": refs}, {"image_id": images})
    assert rows(out.select("table_name", "row_id", "field_name", "state")) == want
    monkeypatch.setattr("framewright.operators.orphans.BROADCAST_CELLS", 0)
    assert rows(orphan_rows({"t": refs}, {"image_id": images}).select("table_name", "row_id", "field_name", "state")) == want
    monkeypatch.setattr("framewright.operators.components.HOT_ROWS", 0)
    assert rows(orphan_rows({"t": refs}, {"image_id": images}).select("table_name", "row_id", "field_name", "state")) == want
    assert sum(r["n"] for r in orphan_report({"t": refs}, {"image_id": images}).collect()) == 4
    assert rows(current_orphans({"t": refs}, {"image_id": images}).select("key_id", "refs")) == [(2, 2), (4, 1), (9, 1)]
    assert len(rows(orphan_rows({"t": refs}, {"image_id": images.limit(0)}))) == 6
    assert rows(orphan_rows({"t": refs.limit(0)}, {"image_id": images})) == []
    state = reference_counts(spark.createDataFrame([(1, 1, 0), (1, -1, 1), (None, 1, 0)], "key_id bigint, ref_delta bigint, exist_delta bigint"))
    again = reference_counts(state.selectExpr("key_id", "refs as ref_delta", "existence as exist_delta").union(spark.createDataFrame([(1, 2, -1)], "key_id bigint, ref_delta bigint, exist_delta bigint")))
    assert rows(again) == [(1, 2, 0)]


def test_ledger_takes_batches_in_any_order(spark, rows):
    refs, images = _refs(spark)
    want = rows(current_orphans({"t": refs}, {"image_id": images}))
    parts = [refs.filter("id % 3 = 0"), refs.filter("id % 3 <> 0 or id is null")]
    for first, second in (parts, parts[::-1]):
        ledger = OrphanLedger(spark, ["image_id"])
        ledger.apply({"t": first}, {"image_id": images.filter("deleted_at is not null")})
        ledger.apply({"t": second}, {})
        ledger.apply({"t": first}, {"image_id": images})
        assert rows(ledger.orphans()) == want
    ledger.apply({"u": refs}, {})
    assert {r["table_name"] for r in ledger.orphans().collect()} == {"t", "u"} and ledger.orphans().count() == 2 * len(want)
    moved = refs.filter("id = 12").withColumn("image_id", F.lit(77).cast("bigint")).withColumn("ingested_at", F.lit("2030-01-01").cast(refs.schema["ingested_at"].dataType))
    ledger.apply({"t": moved}, {})
    assert {(r["key_id"], r["refs"]) for r in ledger.orphans().filter("table_name = 't'").collect()} >= {(77, 1)}


def by_hand(payload):
    """The items of a payload by plain recursion."""
    out = []

    def items(x, name, a_id):
        for i, v in enumerate(x if isinstance(x, list) else [x]):
            if v is not None:
                out.append((a_id, name, i, str(v)))

    def note(a, above):
        if not isinstance(a, dict):
            return
        a_id = None if a.get("id") is None else int(a["id"])
        box = a.get("bbox")
        box = [box.get(k) for k in ("x_min", "y_min", "width", "height")] if isinstance(box, dict) else box
        if a_id is not None:
            for i, v in enumerate(box or []):
                if v is not None:
                    out.append((a_id, "bbox", i, str(round(float(v) * 100))))
            for k in ("colors", "position"):
                v = (a.get("attributes") or {}).get(k)
                if v is not None:
                    items(v, f"attributes.{k}", a_id)
            if a.get("children_ids") is not None:
                items([None if c is None else int(c) for c in a["children_ids"]], "children_ids", a_id)
            parent = above if above is not None else a.get("parent_id")
            if parent is not None:
                out.append((a_id, "parent_id", 0, str(int(parent))))
        for p in a.get("parts") or []:
            note(p, a_id)

    for a in (payload.get("annotations") or []):
        note(a, None)
    return out


DEEP = {"annotations": [None, {"id": 1, "bbox": [1.5, None, "2.25", 3], "attributes": {"colors": ["red", None, "red"], "position": "side"}, "children_ids": [2, "3", None], "parts": [{"id": "2", "bbox": {"x_min": 1, "height": 2.5}, "parent_id": 9, "parts": [{"bbox": [7]}, None, {"id": 4, "parent_id": 8, "attributes": None}]}, {"parts": [{"id": 5, "parent_id": 6}]}]}, {"id": 0, "children_ids": [], "parts": []}, {"category_id": 3}]}


def test_shredding(spark, rows):
    texts = [json.dumps(DEEP), "﻿ " + json.dumps(json.dumps(DEEP)) + "\n", json.dumps(DEEP)[:-3], "", None, "[1]", '{"image": {"id": "7", "file_name": "x", "tags": {"time": "day"}}}', '{"annotations": null}']
    raw = spark.createDataFrame(list(enumerate(texts)), "record_id bigint, payload string").withColumn("image_id", F.lit("clash")).repartition(1)
    got = rows(nested_table(raw, "items").filter("annotation_id is not null").drop("node"))
    want = sorted(((r, *x) for r in (0, 1) for x in by_hand(DEEP)), key=repr)
    assert got == want
    notes = nested_table(raw, "annotations").filter("record_id = 0")
    assert {r["node"]: r["depth"] for r in notes.collect()} == {"1": 0, "2": 0, "3": 0, "1/0": 1, "1/1": 1, "1/0/0": 2, "1/0/2": 2, "1/1/0": 2}
    assert rows(nested_table(raw, "images").filter("image_id is not null")) == [(6, 7, "x", None, None, None, "day")]
    assert nested_table(raw.limit(0), "items").count() == 0
    levels = leaf_levels(raw).filter("record_id = 0 and path = 'children_ids' and depth = 0").orderBy("seq")
    assert [tuple(r)[4:] for r in levels.collect()] == [(0, 1, None), (1, 4, "2"), (2, 4, "3"), (2, 4, None), (1, 3, None), (1, 2, None)]


def test_payload_of_any_depth():
    text = '{"annotations": [' + '{"id": 1, "parts": [' * 60000 + "]}" * 60000 + "]}"
    assert isinstance(read_payload(text), dict)
    assert read_payload('{"a": [1, {"b": "x]"}]}') == {"a": [1, {"b": "x]"}]}
