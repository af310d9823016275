"""Label maps and class remapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.presets import load_preset
from framewright.model import ANNOTATION_TYPES, Dataset, formatted, label_column
from framewright.session import few_rows


class IncompatibleLabelMapsError(ValueError):
    """Two label maps give one id different names."""


def merge_label_maps(left: dict[int, str], right: dict[int, str], method: str = "outer") -> dict[int, str]:
    """``outer``: both maps' entries, which must agree on shared ids; ``inner``: the smaller, which must be part of the larger."""
    if method not in ("inner", "outer"):
        raise ValueError("method is inner or outer")
    small, large = sorted((left, right), key=len)
    if method == "inner" and not set(small) <= set(large):
        raise IncompatibleLabelMapsError("the smaller map is no part of the larger")
    clash = sorted(k for k in set(left) & set(right) if left[k] != right[k])
    if clash:
        raise IncompatibleLabelMapsError(f"ids with two names: {clash[:5]}")
    return dict(small) if method == "inner" else dict(sorted((left | right).items()))


def construct_label_map(annotations: DataFrame, limit: int = 1_000_000) -> dict[int, str]:
    """The label map that annotations imply; an id with two names, or a name with two ids, raises ValueError."""
    rows = annotations.select("category_id", "category_str").distinct().dropna().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("too many categories for a label map")
    for what, i in (("category_id", 0), ("category_str", 1)):
        seen = [r[i] for r in rows]
        if len(set(seen)) < len(seen):
            raise ValueError(f"a {what} has several partners")
    return {int(r[0]): r[1] for r in sorted(rows)}


def label_conflicts(annotations: DataFrame) -> DataFrame:
    """``(category_id, n_names)`` of ids with more than one name."""
    return annotations.groupBy("category_id").agg(F.count_distinct("category_str").alias("n_names")).filter("n_names > 1")


def mapped_category(mapping: dict[int, int], category: Column) -> Column:
    """The mapped id, null where the mapping has none; all ids change at once."""
    if not mapping:
        return F.lit(None).cast("int")
    return F.try_element_at(F.create_map(*(F.lit(int(x)) for kv in mapping.items() for x in kv)), category.cast("int"))


def remap_classes(ds: Dataset, mapping: dict[int, int], new_names: dict[int, str] | None = None, remove_not_mapped: bool = True, remove_emptied_images: bool = False) -> Dataset:
    """Categories replaced by a map of ids.

    Without ``remove_not_mapped`` ids that the map leaves out stay. A merged class is called by
    ``new_names``, else as the last old class that maps to it.
    """
    full = dict(mapping)
    if not remove_not_mapped:
        full |= {k: k for k in ds.label_map if k not in full}
    names = {new: ds.label_map.get(old, str(old)) for old, new in full.items()} | (new_names or {})
    target = mapped_category(full, F.col("category_id"))
    if not remove_not_mapped:
        target = F.coalesce(target, F.col("category_id"))
    kept = ds._with_annotations(ds.annotations.filter(target.isNotNull()), remove_emptied_images)
    cols = {"category_id": target, "category_str": label_column(names, target)}
    annotations = kept.annotations.select(*(cols[c].alias(c) if c in cols else F.col(f"`{c}`") for c in kept.annotations.columns))
    return kept.with_(annotations=formatted(annotations, ANNOTATION_TYPES), label_map=dict(sorted(names.items())))


def remap_from_table(ds: Dataset, table: DataFrame, **how: bool) -> Dataset:
    """Mapping from ``input_category_id, output_category_id, output_category_name`` rows (a few thousand at most)."""
    rows = few_rows(table.select("input_category_id", "output_category_id", "output_category_name"), "rows in the remap table")
    names: dict[int, str] = {}
    for r in rows:
        names.setdefault(int(r[1]), r[2])
    return remap_classes(ds, {int(r[0]): int(r[1]) for r in rows}, {k: v for k, v in names.items() if v is not None}, **how)


def remap_from_csv(ds: Dataset, path: str, **how: bool) -> Dataset:
    return remap_from_table(ds, ds.images.sparkSession.read.csv(path, header=True, inferSchema=True), **how)


def remap_from_preset(ds: Dataset, source: str, target: str, **how: bool) -> Dataset:
    mapping, names = load_preset(source, target)
    return remap_classes(ds, mapping, names, **how)


def lowest_free_id(ids: set[int]) -> int:
    """The first gap between the smallest and the greatest id, else the next after the greatest."""
    if not ids:
        return 0
    i = min(ids)
    while i in ids:
        i += 1
    return i


def mapping_to_names(own: dict[int, str], other: dict[int, str]) -> tuple[dict[int, int], dict[int, str]]:
    """Ids that bring ``own`` in line with ``other`` by name; own classes unknown there keep their id or move to the lowest gap."""
    by_name = {v: k for k, v in other.items()}
    mapping = {k: by_name[v] for k, v in own.items() if v in by_name}
    taken = set(other) | set(mapping.values())
    names = dict(other)
    for k in sorted(set(own) - set(mapping)):
        new = k if k not in taken else lowest_free_id(taken)
        taken.add(new)
        mapping[k] = new
        names[new] = own[k]
    return mapping, names


def remap_from_other(ds: Dataset, other_labels: dict[int, str], remove_not_mapped: bool = False, remove_emptied_images: bool = False) -> Dataset:
    mapping, names = mapping_to_names(ds.label_map, other_labels)
    if remove_not_mapped:
        mapping = {k: v for k, v in mapping.items() if v in other_labels and ds.label_map[k] == other_labels[v]}
    out = remap_classes(ds, mapping, {v: names[v] for v in mapping.values()}, remove_not_mapped, remove_emptied_images)
    return out.with_(label_map=dict(sorted((out.label_map | (other_labels if not remove_not_mapped else {})).items())))


def keep_classes(ds: Dataset, ids: list[int], remove_emptied_images: bool = False) -> Dataset:
    out = ds.filter_annotations(F.col("category_id").isin(ids), remove_emptied_images)
    return out.with_(label_map={k: v for k, v in ds.label_map.items() if k in ids})


def remove_classes(ds: Dataset, ids: list[int], remove_emptied_images: bool = False) -> Dataset:
    out = ds.filter_annotations(~F.col("category_id").isin(ids), remove_emptied_images)
    return out.with_(label_map={k: v for k, v in ds.label_map.items() if k not in ids})
