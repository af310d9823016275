"""Set-valued attributes as boolean columns and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from framewright.model import Dataset

#: More distinct values than this make no sensible set of columns.
MAX_VALUES = 2_000


def set_values(df: DataFrame, column: str) -> list[str]:
    """The sorted values in an array column; the distinct values only reach the driver."""
    values = df.select(F.explode(F.col(f"`{column}`")).alias("v")).filter("v is not null").distinct().limit(MAX_VALUES + 1).collect()
    if len(values) > MAX_VALUES:
        raise ValueError(f"{column} has more than {MAX_VALUES} values")
    return sorted(str(r[0]) for r in values)


def booleanize(df: DataFrame, columns: dict[str, list[str] | None], sep: str = ".") -> tuple[DataFrame, dict[str, tuple[str, ...]]]:
    """One boolean column ``column.value`` per value, in one projection; null arrays are false everywhere. Plain strings raise TypeError."""
    made: dict[str, tuple[str, ...]] = {}
    out = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    for c, values in columns.items():
        kind = df.schema[c].dataType
        if not isinstance(kind, ArrayType):
            raise TypeError(f"{c} holds no sets")
        made[c] = tuple(sorted(values)) if values is not None else tuple(set_values(df, c))
        if len({v.lower() for v in made[c]}) < len(made[c]) and df.sparkSession.conf.get("spark.sql.caseSensitive") != "true":
            raise ValueError(f"values of {c} differ in letter case only; set spark.sql.caseSensitive or unify them")
        cell = F.col(f"`{c}`").cast(ArrayType(StringType()))
        out += [F.coalesce(F.array_contains(F.array_compact(cell), F.lit(v)), F.lit(False)).alias(f"{c}{sep}{v}") for v in made[c]]
    return df.select(*out), made


def debooleanize(df: DataFrame, columns: dict[str, tuple[str, ...]], sep: str = ".") -> DataFrame:
    """The sets back from their boolean columns; what was null is an empty set."""
    gone = {f"{c}{sep}{v}" for c, values in columns.items() for v in values}
    sets = [F.array_compact(F.array(*(F.when(F.col(f"`{c}{sep}{v}`"), F.lit(v)) for v in values)) if values else F.array().cast("array<string>")).alias(c) for c, values in columns.items()]
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in gone), *sets)


def bool_columns(df: DataFrame, prefix: str, sep: str = ".") -> list[str]:
    """Columns below ``prefix``, which must all be boolean."""
    found = [f for f in df.schema.fields if f.name.startswith(prefix + sep)]
    bad = [f.name for f in found if not isinstance(f.dataType, BooleanType)]
    if bad:
        raise TypeError(f"not boolean: {bad}")
    return [f.name for f in found]


def align_bool_columns(a: DataFrame, b: DataFrame, columns: dict[str, tuple[str, ...]], sep: str = ".") -> tuple[DataFrame, DataFrame]:
    """Both frames with every boolean column; one that was absent is false."""
    names = [f"{c}{sep}{v}" for c, values in columns.items() for v in values]
    add = lambda df: df.select("*", *(F.lit(False).alias(n) for n in names if n not in df.columns))
    return add(a), add(b)


def _side(ds: Dataset, column: str) -> str:
    return "images" if column in ds.images.columns else "annotations"


def booleanize_dataset(ds: Dataset, *columns: str, **values: list[str]) -> Dataset:
    asked: dict[str, list[str] | None] = dict.fromkeys(columns) | values
    tracked = dict(ds.booleanized)
    frames = {"images": ds.images, "annotations": ds.annotations}
    for c, v in asked.items():
        side = _side(ds, c)
        frames[side], made = booleanize(frames[side], {c: v})
        tracked |= made
    return ds.with_(**frames, booleanized=tracked)


def debooleanize_dataset(ds: Dataset, *columns: str) -> Dataset:
    frames = {"images": ds.images, "annotations": ds.annotations}
    for c in columns or tuple(ds.booleanized):
        values = ds.booleanized[c]
        for side, df in frames.items():
            if any(f"{c}.{v}" in df.columns for v in values):
                frames[side] = debooleanize(df, {c: values})
    return ds.with_(**frames)
