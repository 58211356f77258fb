"""Profiles: distinct counts, frequencies, missing values, duplicates, distributions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions.columns import as_list
from stayline.functions.ordering import clean
from stayline.functions.quantiles import two_scan_quantiles
from stayline.operators.filters import varies


def nunique(df: DataFrame, key: str, column: str, out: str = "n_unique", more_than: int | None = None) -> DataFrame:
    """Distinct non-null values per key; `more_than` keeps only the keys above it."""
    counts = df.groupBy(key).agg(F.count_distinct(column).alias(out))
    return counts.filter(F.col(out) > more_than) if more_than is not None else counts


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(column))


def multiplicity_summary(df: DataFrame, key: str, distinct: str | None = None) -> DataFrame:
    """How many keys have 1, 2, or 3 and more rows (or distinct values of a column)."""
    size = F.count_distinct(distinct) if distinct else F.count(F.lit(1))
    per_key = df.groupBy(key).agg(size.alias("_n"))
    group = F.when(F.col("_n") >= 3, "3+").otherwise(F.col("_n").cast("string"))
    return per_key.groupBy(group.alias("multiplicity")).agg(F.count(F.lit(1)).alias("n_keys"))


def missing_table(df: DataFrame) -> DataFrame:
    """Columns with missing cells, their count and share; one pass over the data."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns])
    return (
        one.unpivot(["_n"], df.columns, "variable", "n_missing")
        .filter("n_missing > 0")
        .select("variable", "n_missing", (F.col("n_missing") / F.col("_n")).alias("pct_missing"))
        .orderBy(F.desc("n_missing"), "variable")
    )


def _fingerprint(keys: list[str]):
    """Fixed-size stand-in for long key values, so that texts are not shuffled."""
    return F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)


def duplicate_count(df: DataFrame, keys) -> DataFrame:
    """One row: how many rows repeat an earlier one on the keys."""
    groups = df.groupBy(_fingerprint(as_list(keys)).alias("_f")).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"))


def duplicate_rows(df: DataFrame, keys, row_id: str) -> DataFrame:
    """All members of repeated groups, with `is_extra` for those after the first by row id.

    Group facts come from an aggregate and are joined back, so a group of any size is fine.
    """
    tagged = df.withColumn("_f", _fingerprint(as_list(keys)))
    groups = (
        tagged.groupBy("_f").agg(F.count(F.lit(1)).alias("n_copies"), F.min(row_id).alias("_first")).filter("n_copies > 1")
    )
    return tagged.join(groups, "_f").withColumn("is_extra", F.col(row_id) > F.col("_first")).drop("_f", "_first")


def describe(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """count, mean, sample sd, min, exact quartiles and max per column, from two scans."""
    cols = list(cols)
    measures = {}
    for i, c in enumerate(cols):
        v = clean(c)
        measures |= {f"n{i}": F.count(v), f"mean{i}": F.avg(v), f"std{i}": F.stddev_samp(v), f"min{i}": F.min(v), f"max{i}": F.max(v)}
    quartiles, m = two_scan_quantiles(df, cols, [0.25, 0.5, 0.75], measures)
    rows = [(c, m[f"n{i}"], m[f"mean{i}"], m[f"std{i}"], m[f"min{i}"], *quartiles[c], m[f"max{i}"]) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(
        rows, "variable string, count long, mean double, std double, min double, p25 double, p50 double, p75 double, max double"
    )


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width bins over [min, max], the last closed on the right; empty bins included."""
    lo, hi = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, left double, right double, n long")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    index = F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col(column).isNotNull()).groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("bin"), (F.lit(lo) + F.col("id") * width).alias("left"),
        (F.lit(lo) + (F.col("id") + 1) * width).alias("right"),
    )
    return grid.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with at most one distinct value, NULL counted as a value."""
    row = df.agg(*[varies(c).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if not row[c]]
