"""Binned outcome rates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.functions.ordering import exact_quantiles
from stayline.functions.quantiles import cells, sketched


def quantile_cuts(df: DataFrame, column: str, bins: int = 5) -> list[float]:
    """Distinct ascending bin edges at the exact quantiles 0, 1/bins, ..., 1."""
    values = exact_quantiles(df, [column], [i / bins for i in range(bins + 1)])[column]
    return sorted({v for v in values if v is not None})


def _shown(edge: float, precision: int) -> float:
    """Round to `precision` decimals, or that many significant ones below 1."""
    if edge == 0 or abs(edge) >= 1:
        return round(edge, precision)
    return round(edge, precision - 1 - math.floor(math.log10(abs(edge))))


def cut_labels(edges: list[float], decimals: int = 2, precision: int = 3) -> list[str]:
    """`left-right` texts; the lowest edge is moved down a little because that bin is closed on both sides."""
    shown = [_shown(e, precision) for e in edges]
    while len(set(shown)) < len(edges) and precision < 19:
        precision += 1
        shown = [_shown(e, precision) for e in edges]
    shown[0] -= 10.0 ** -precision
    return [f"{a:.{decimals}f}-{b:.{decimals}f}" for a, b in zip(shown, shown[1:])]


def cut_ladder(column: str, edges: list[float], labels: list[str]) -> tuple[Column, Column]:
    """(bin number, label) of right-closed bins."""
    number, text = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i in reversed(range(len(labels))):
        inside = F.col(column) <= edges[i + 1]
        number = F.when(inside, F.lit(i)).otherwise(number)
        text = F.when(inside, F.lit(labels[i])).otherwise(text)
    return number, text


def _rates(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy("bin_no", "bin").agg(F.avg(target).alias("rate"), F.count(F.lit(1)).alias("n")).withColumn(
        "pct", 100 * F.col("rate")
    )


def _binned_cells(rows: DataFrame, column: str, target: str, bins: int) -> tuple[list[float], DataFrame]:
    """Distinct quantile edges, and (column, n, target) of cells that no edge cuts, or of the rows if the sketch was too poor."""
    probs = [i / bins for i in range(bins + 1)]
    first = sketched(rows, [column], probs)
    if not first.counts[column]:
        return [], rows
    found = cells(rows, {column: first.brackets[column].values()}, target)
    values = [found[column].quantile(q) for q in probs] if found is not None else [None]
    if None in values:
        each = rows.select(column, F.lit(1).cast("long").alias("n"), F.col(target).cast("double").alias("target"))
        return quantile_cuts(rows, column, bins), each
    table = found[column]
    data = list(zip(table.values, table.rows, table.targets))
    return sorted(set(values)), rows.sparkSession.createDataFrame(data, f"`{column}` double, n long, target double")


def _cell_rates(binned: DataFrame) -> DataFrame:
    """The same as `_rates` for rows that stand for `n` rows with a sum of `target`."""
    rates = binned.groupBy("bin_no", "bin").agg((F.sum("target") / F.sum("n")).alias("rate"), F.sum("n").alias("n"))
    return rates.withColumn("pct", 100 * F.col("rate"))


def quantile_bin_rate(df: DataFrame, column: str, target: str, bins: int = 5, decimals: int = 2) -> DataFrame:
    """Share of positives per quantile bin, from two scans; repeated edges merge bins."""
    rows = df.select(F.col(column).cast("double").alias(column), target).dropna()
    edges, table = _binned_cells(rows, column, target, bins)
    if len(edges) < 2:
        raise ValueError(f"column {column} has fewer than two distinct quantiles")
    number, text = cut_ladder(column, edges, cut_labels(edges, decimals))
    return _cell_rates(table.withColumns({"bin_no": number, "bin": text}))


def discrete_overflow_bin(df: DataFrame, column: str, target: str, top: int = 5) -> DataFrame:
    """Integer bins 0..top-1 and one for `top` and more."""
    n = F.coalesce(F.col(column).cast("int"), F.lit(0))
    number = F.least(n, F.lit(top))
    text = F.when(number >= top, f"{top}+").otherwise(number.cast("string"))
    return _rates(df.select(number.alias("bin_no"), text.alias("bin"), target), target)


def zero_own_bin(df: DataFrame, column: str, target: str, bins: int = 5, decimals: int = 2) -> DataFrame:
    """Zero as bin 0, the other values in quantile bins 1, 2, ...; one distinct value is one bin."""
    rows = df.select(F.col(column).cast("double").alias(column), target).dropna()
    is_zero = F.col(column) == 0
    at_zero = rows.filter(is_zero).select(F.lit(0).alias("bin_no"), F.lit("0").alias("bin"), target)
    edges, table = _binned_cells(rows.filter(~is_zero), column, target, bins)
    if not edges:
        return _rates(at_zero, target)
    if len(edges) == 1:
        binned = table.select(F.lit(1).alias("bin_no"), F.lit(f"{edges[0]:.{decimals}f}").alias("bin"), "n", "target")
    else:
        number, text = cut_ladder(column, edges, cut_labels(edges, decimals))
        binned = table.select((number + 1).alias("bin_no"), text.alias("bin"), "n", "target")
    zeros = at_zero.select("bin_no", "bin", F.lit(1).cast("long").alias("n"), F.col(target).cast("double").alias("target"))
    return _cell_rates(zeros.unionByName(binned))
