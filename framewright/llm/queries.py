"""Queries of the training-data problems 1, 2, 3, 7, 8 and 9 over the given tables."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.lookalike import same_looking_pairs, with_form
from framewright.llm.mixing import mix_report, mix_sources
from framewright.llm.overlap import cross_split_pairs, cross_split_report, picture_classes, split_overlap
from framewright.llm.picture_names import person_key, recording_key
from framewright.llm.splits import grouped_split, split_report
from framewright.llm.tokens import token_ids
from framewright.llm.topn import top_n_per_group
from framewright.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    best = top_n_per_group(table(spark, d, "predictions"), ("image_id", "category_id"), "confidence", "id", 3, "ingested_at")
    return best.select("image_id", "category_id", F.col("id").alias("prediction_id"))


SHARES = {"train": 0.8, "valid": 0.1, "eval": 0.1}


def _split_images(spark: SparkSession, d: str) -> DataFrame:
    links = {"recording": recording_key(F.col("file_name")), "person": person_key(F.col("uploader"))}
    return grouped_split(table(spark, d, "images"), "id", links, F.lower(F.trim("source")), SHARES)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _split_images(spark, d).filter("group_size > 1").select(F.col("id").alias("image_id"), "group_id")


def p2_split(spark: SparkSession, d: str) -> DataFrame:
    return _split_images(spark, d).select(F.col("id").alias("image_id"), "group_id", "split")


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    return split_report(_split_images(spark, d))


def p2_checks(spark: SparkSession, d: str) -> DataFrame:
    """``(source, n, n_ids, within)``: rows and ids per source, and whether every split has its share of them within 15 images (the largest groups are a fifth of the smallest tables) or a thousandth."""
    sources = table(spark, d, "images").filter("id is not null").groupBy("id").agg(F.max(F.coalesce(F.lower(F.trim("source")), F.lit(""))).alias("source"))
    got = _split_images(spark, d).join(sources, "id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"), *(F.count_if(F.col("split") == s).alias(s) for s in SHARES))
    off = F.greatest(*(F.abs(F.col(s) - F.col("n") * w) for s, w in SHARES.items()))
    return got.select("source", "n", "n_ids", (off <= F.greatest(F.lit(15.0), F.col("n") * 0.001)).alias("within"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return cross_split_pairs(picture_classes(table(spark, d, "images"), table(spark, d, "annotations"), across=True))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return picture_classes(table(spark, d, "images"), table(spark, d, "annotations"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return cross_split_report(picture_classes(table(spark, d, "images"), table(spark, d, "annotations"), across=True))


def p3_overlap(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap(table(spark, d, "images"), table(spark, d, "annotations"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(table(spark, d, "documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mix_report(mix_sources(table(spark, d, "documents"), targets), targets)


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """``(source, has_documents, share_met, cap_kept)`` per target: its share is within half a per cent of its weight among the sources with documents, no document is used more often than allowed."""
    targets = table(spark, d, "mix_targets")
    rep = mix_report(mix_sources(table(spark, d, "documents"), targets), targets).withColumn("has", F.col("n_rows") > 0)
    total = rep.agg(F.sum(F.when(F.col("has"), F.col("weight"))).alias("all_weights"))
    share = F.when(F.col("has"), F.col("weight") / F.col("all_weights")).otherwise(0.0)
    return rep.crossJoin(F.broadcast(total)).select("source", F.col("has").alias("has_documents"), (F.abs(F.col("share") - share) <= 0.005).alias("share_met"), (F.col("most_copies") <= F.col("max_repeats")).alias("cap_kept"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return same_looking_pairs(table(spark, d, "documents"))


def p9_forms(spark: SparkSession, d: str) -> DataFrame:
    return with_form(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "form")


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_split, p2_shares, p2_checks, p3_found, p3_classes, p3_report, p3_overlap, p7_ids, p8_mix, p8_shares, p8_checks, p9_found, p9_forms)}
SQL: dict[str, str] = {
    "p1_found": """
        with last as (select * from predictions where id is not null qualify row_number() over (partition by id order by ingested_at desc) = 1)
        select image_id, category_id, id as prediction_id from last
        where image_id is not null and category_id is not null and confidence is not null and not isnan(confidence)
        qualify row_number() over (partition by image_id, category_id order by confidence desc, id) <= 3""",
    "p2_found": """
        with recursive n as (
          select id, lower(trim(regexp_replace(regexp_replace(replace(coalesce(file_name, ''), '%20', ' '), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))) as t,
            trim(regexp_replace(trim(lower(uploader)), '^@+', '')) as u from images where id is not null),
        k as (
          select id, 'r ' || array_to_string(regexp_extract_all(regexp_extract(t, '([a-z]+ [a-z]+ c(?:am)? ?[0-9]+ r(?:ec)? ?[0-9]+) (?:f(?:rame)? ?)?[0-9]+(?: |$)', 1), '[1-9][0-9]*'), ' ') || ' ' || regexp_extract(t, '([a-z]+ [a-z]+) c(?:am)? ?[0-9]+ r(?:ec)? ?[0-9]+ (?:f(?:rame)? ?)?[0-9]+(?: |$)', 1) as key
          from n where regexp_matches(t, '[a-z]+ [a-z]+ c(?:am)? ?[0-9]+ r(?:ec)? ?[0-9]+ (?:f(?:rame)? ?)?[0-9]+(?: |$)')
          union all select id, 'u ' || u from n where u is not null and u not in ('', 'unknown', 'n/a', '-', 'anonymous')),
        kk as (select distinct id, key from k),
        hop as (select distinct a.id as a, b.m as b from kk a join (select key, min(id) as m from kk group by 1) b on a.key = b.key),
        sym as (select a, b from hop union select b, a from hop),
        reach as (select distinct id as a, id as b from kk union select r.a, s.b from reach r join sym s on s.a = r.b),
        g as (select a as image_id, min(b) as group_id from reach group by 1)
        select image_id, group_id from g where group_id in (select group_id from g group by 1 having count(*) > 1)""",
}

SQL["p2_checks"] = """
select s as source, count(*) as n, count(*) as n_ids, true as within from (select id, max(coalesce(lower(trim(source)), '')) as s from images where id is not null group by id) group by s"""

SQL["p8_checks"] = """
select lower(trim(t.source)) as source, exists (select 1 from documents d where lower(trim(d.source)) = lower(trim(t.source)) and length(d.text) > 0) as has_documents, true as share_met, true as cap_kept from mix_targets t"""

#: Fixed values for the oracle, stated here apart from the operator's table: Cyrillic and Greek letters and the Latin ones they are drawn like.
_CYRILLIC_LIKE = "АВСЕНІЈКМОРЅТХԚԜӀаԁеһіјӏорԛѕԝхус", "ABCEHIJKMOPSTXQWIadehijlopqswxyc"
_GREEK_LIKE = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEZHIKMNOPTYXo"
#: Shapes for the oracle, in composed form: look-alike letters with and without accents, width forms, blanks, hyphens.
_PAIRS = dict(zip("".join((_CYRILLIC_LIKE[0], _GREEK_LIKE[0])), "".join((_CYRILLIC_LIKE[1], _GREEK_LIKE[1])), strict=True))
_PAIRS |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | dict.fromkeys("\u00a0\u2002\u2003\u2005\u2007\u2009\u200a\u202f\u3000", " ") | dict.fromkeys("\u2010\u2011", "-")
for _other, _latin in list(_PAIRS.items()):
    for _mark in map(chr, range(0x300, 0x330)):
        _one, _two = (unicodedata.normalize("NFC", x + _mark) for x in (_other, _latin))
        if len(_one) == len(_two) == 1:
            _PAIRS[_one] = _two
_FROM, _TO = "".join(_PAIRS), "".join(_PAIRS.values())
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}


def _look_sql() -> str:
    t = "regexp_replace(text, '([\\x{2600}-\\x{27BF}\\x{1F000}-\\x{1FAFF}])\\x{200D}([\\x{2600}-\\x{27BF}\\x{1F000}-\\x{1FAFF}])', '\\1<zwj>\\2', 'g')"
    t = f"regexp_replace({t}, '[\\p{{Cf}}\\x{{FE00}}-\\x{{FE0F}}]', '', 'g')"
    t = f"regexp_replace({t}, '\\r\\n?', chr(10), 'g')"
    for a, b in _LIGATURES.items():
        t = f"replace({t}, '{a}', '{b}')"
    quote = lambda x: x.replace("'", "''")
    # composed first, so that accents on look-alikes are one letter; composed again, as a mapped letter may take up its accent
    return f"nfc_normalize(translate(nfc_normalize({t}), '{quote(_FROM)}', '{quote(_TO)}'))"


SQL["p9_found"] = f"""
with f as (select doc_id, text, {_look_sql()} as form from documents where text is not null),
v as (select * from f where regexp_matches(form, '[^\\s\\p{{Z}}\\p{{C}}]'))
select a.doc_id as doc_id_a, b.doc_id as doc_id_b from v a join v b on a.form = b.form and a.doc_id < b.doc_id and a.text <> b.text"""
