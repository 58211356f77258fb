"""Per-key aggregates. All but the two collecting ones combine on the map side, so a hot key is harmless."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.functions.columns import as_col, as_list
from stayline.functions.ordering import split_hot
from stayline.functions.scalars import clip_lower, code_root, hours_between, nonblank

MERGE_CHARS = 64_000_000  # characters of a key that are sorted and joined at once
CELL_CHARS = 500_000_000  # at up to four bytes each, what one cell holds
CELL_ROWS = 50_000_000


def code_counts(df: DataFrame, key="hadm_id", code="icd_code", prefix="dx") -> DataFrame:
    """Rows, distinct codes and distinct three-character roots per key."""
    per_code = df.groupBy(key, code).agg(F.count(F.lit(1)).alias("_n"))
    per_root = per_code.groupBy(key, code_root(code).alias("_root")).agg(
        F.sum("_n").alias("_n"), F.count(code).alias("_codes")
    )
    return per_root.groupBy(key).agg(
        F.sum("_n").alias(f"{prefix}_count"),
        F.sum("_codes").alias(f"{prefix}_code_uniq"),
        F.count("_root").alias(f"{prefix}_root3_uniq"),
    )


def count_default_zero(keys: DataFrame, facts: DataFrame, key: str, out: str) -> DataFrame:
    """Count of facts per key row, 0 where there is none."""
    counts = facts.groupBy(key).agg(F.count(F.lit(1)).alias(out))
    return keys.join(counts, key, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def text_parts(
    df: DataFrame, keys, text="text", order: Iterable[str] = ("charttime", "note_id"), first_id: str = "note_id",
    separator: str = "\n\n-----\n\n", split: bool = False, max_chars: float = MERGE_CHARS,
) -> DataFrame:
    """The long form of `merge_texts`: a key above `max_chars` has several consecutive parts (`part` 0, 1, ...).

    Joined in the order of `part` with the separator, they give the whole text. Without `split` every key has
    part 0 alone.
    """
    keys, order = as_list(keys), as_list(order)
    rows = df.filter(nonblank(text))
    if split:
        rows = split_hot(rows, keys, order, weight=F.length(text), threshold=max_chars, name="part")
    else:
        rows = rows.withColumn("part", F.lit(0))
    piece = F.struct(*[F.col(c) for c in order], F.col(text).alias("_text"))
    pieces = F.transform(F.sort_array(F.collect_list(piece)), lambda p: p["_text"])
    return rows.groupBy(*keys, "part").agg(
        F.min(first_id).alias(first_id), F.array_join(pieces, separator).alias(text)
    )


def merge_texts(
    df: DataFrame, keys, text="text", order: Iterable[str] = ("charttime", "note_id"), first_id: str = "note_id",
    separator: str = "\n\n-----\n\n", split: bool = False, max_chars: float = MERGE_CHARS, max_cell: int = CELL_CHARS,
) -> DataFrame:
    """One row per key: its non-blank texts joined in order, with the smallest id.

    With `split`, a key above `max_chars` is sorted and joined in consecutive parts first, and the parts are
    joined then. A key above `max_cell` characters can't be one cell and raises; `text_parts` is the form for it.
    """
    keys = as_list(keys)
    parts = text_parts(df, keys, text, order, first_id, separator, split, max_chars)
    if not split:
        return parts.drop("part")
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("part", text))), lambda p: p[text])
    fits = F.sum(F.length(text)) <= max_cell
    whole = F.when(fits, F.array_join(pieces, separator)).otherwise(F.raise_error(F.lit("a merged text exceeds max_cell")))
    return parts.groupBy(*keys).agg(F.min(first_id).alias(first_id), whole.alias(text))


def struct_counts(df: DataFrame, key: str, fields: Iterable[str], count: str = "n") -> DataFrame:
    """The long form of `collect_structs`: one row per key and distinct struct, with its number of rows."""
    return df.groupBy(key, *as_list(fields)).agg(F.count(F.lit(1)).alias(count))


def collect_structs(df: DataFrame, key: str, fields: Iterable[str], out: str, max_cell: int = CELL_ROWS) -> DataFrame:
    """One row per key: the sorted array of its structs and their number.

    Equal rows travel as one row with a count. A key of more than `max_cell` rows can't be one array and raises;
    `struct_counts` is the form for it.
    """
    fields, n = as_list(fields), F.sum("_n")
    counted = struct_counts(df, key, fields, "_n")
    pairs = F.sort_array(F.collect_list(F.struct(F.struct(*fields).alias("s"), F.col("_n").alias("m"))))
    copies = F.flatten(F.transform(pairs, lambda p: F.array_repeat(p["s"], p["m"].cast("int"))))
    whole = F.when(n <= max_cell, copies).otherwise(F.raise_error(F.lit("a collected array exceeds max_cell")))
    return counted.groupBy(key).agg(whole.alias(out), n.alias(f"n_{out}"))


def argmin_row(df: DataFrame, key: str, order: Iterable[str]) -> DataFrame:
    """The whole earliest row of each key; `order` should end in a unique id."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(key).agg(F.min_by(row, F.struct(*order)).alias("_r")).select("_r.*")


def first_non_null(df: DataFrame, key: str, order: Iterable[str], columns: Iterable[str]) -> DataFrame:
    """First non-null value of each column by itself, so one output row may mix input rows."""
    rank = F.struct(*order)
    aggs = [F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in columns if c != key]
    return df.groupBy(key).agg(*aggs)


def weighted_mean(value, weight) -> Column:
    """Mean over rows with value and weight; NULL unless the weights add up to more than 0."""
    v, w = as_col(value), as_col(weight)
    both = v.isNotNull() & w.isNotNull()
    total = F.sum(F.when(both, w))
    return F.when(total > 0, F.sum(F.when(both, v * w)) / total)


def collapse_intervals(
    df: DataFrame, key="hadm_id", order=("stay_id",), constants: Iterable[str] = (), measures: Iterable[str] = (),
    interval_id="stay_id", start="icu_intime", end="icu_outtime", hours="length_of_icu_stay_hours",
    outer_start="admittime", outer_end="dischtime",
) -> DataFrame:
    """One row per stay from its unit intervals: constants, count, hours, weighted mean/min/max, timing.

    Everything is one aggregate with one shuffle on the key.
    """
    rank = F.struct(*order)
    carried = [c for c in dict.fromkeys([*constants, outer_start, outer_end]) if c != key]
    aggs = [F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in carried]
    aggs += [
        F.count_distinct(interval_id).alias("icu_stay_count"),
        F.coalesce(F.sum(hours), F.lit(0.0)).alias("total_icu_hours"),
        F.min(start).alias("first_icu_intime"),
        F.max(end).alias("last_icu_outtime"),
    ]
    for m in measures:
        aggs += [weighted_mean(m, hours).alias(f"{m}_wmean"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    return df.groupBy(key).agg(*aggs).withColumns(
        {
            "time_to_first_icu_hours": clip_lower(hours_between(outer_start, "first_icu_intime")),
            "last_icu_to_discharge_hours": clip_lower(hours_between("last_icu_outtime", outer_end)),
        }
    )


def group_mean(df: DataFrame, by, metrics: Iterable[str], order: str) -> DataFrame:
    return df.groupBy(by).agg(*[F.avg(m).alias(m) for m in metrics]).orderBy(F.desc(order), by)


def positive_rate(df: DataFrame, label: str, by: Iterable[str] = ()) -> DataFrame:
    y = F.col(label)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).cast("long").alias("positives"),
        F.sum(1 - y).cast("long").alias("negatives"), F.avg(y).alias("pos_rate"),
    )


def pivot_aggregate(groups: Mapping[str, Iterable[str]], label, value, agg, suffix: str = "") -> list[Column]:
    """One aggregate column per label group; labels in a group are synonyms."""
    return [
        agg(F.when(as_col(label).isin(*labels), as_col(value))).alias(f"{name}{suffix}")
        for name, labels in groups.items()
    ]
