"""Exact order statistics of many columns in two scans.

The first scan fills one mergeable KLL sketch per column, beside whatever other aggregates the caller needs. A sketch gives
every wanted rank a bracket of values. The second scan counts each column's rows by cell: the brackets, value by value, and
the gaps between them as one cell each. That small table has the exact value at every bracketed rank, the number of rows below any
value in a bracket, and sums of a target by any cut inside the brackets.

Sketches are right with high probability only, and a bracket of a very large column may hold many values; a table that doesn't
settle all ranks is not used, and `exact_quantiles` of the ordering helpers, which narrows brackets step by step, takes its place.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from stayline.functions.ordering import clean, exact_quantiles, number_array

SKETCH_K = 16384
RANK_ERROR = 3 * 2.296 / SKETCH_K**0.9021  # three times the sketch's 99 % error
MOST_VALUES = 200_000  # rows of the small table that come to the driver
PATTERN = 4  # columns whose cells are counted together


@dataclass
class Sketched:
    """What the first scan gives: rows per column, a way to bracket ranks, and the caller's aggregates."""

    counts: dict[str, int]
    brackets: dict[str, dict[float, tuple[float, float]]]
    measures: Row


def sketched(df: DataFrame, cols: Iterable[str], probs: Iterable[float], measures: Mapping[str, Column] | None = None) -> Sketched:
    """The first scan. `brackets` holds (low, high) around the value at each probability."""
    cols, probs = list(dict.fromkeys(cols)), list(probs)
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(clean(c)).alias(f"n{i}"), F.kll_sketch_agg_double(clean(c), SKETCH_K).alias(f"s{i}")]
        aggs += [F.min(clean(c)).alias(f"a{i}"), F.max(clean(c)).alias(f"z{i}")]
    named = list((measures or {}).items())
    one = df.agg(*aggs, *[agg.alias(f"m{i}") for i, (_, agg) in enumerate(named)])
    around = number_array(x for q in probs for x in (max(0.0, q - RANK_ERROR), min(1.0, q + RANK_ERROR)))
    row = one.select(
        *[F.col(f"{x}{i}") for i in range(len(cols)) for x in "naz"], *[f"m{i}" for i in range(len(named))],
        *[F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(f"s{i}", around)).alias(f"q{i}") for i in range(len(cols))],
    ).first()
    brackets = {}
    for i, c in enumerate(cols):
        least, most, ends = row[f"a{i}"], row[f"z{i}"], row[f"q{i}"]
        brackets[c] = {
            q: (least if q <= RANK_ERROR else ends[2 * j], most if q >= 1 - RANK_ERROR else ends[2 * j + 1])
            for j, q in enumerate(probs)
        } if row[f"n{i}"] else {}
    return Sketched({c: row[f"n{i}"] for i, c in enumerate(cols)}, brackets, Row(*[n for n, _ in named])(*[row[f"m{i}"] for i in range(len(named))]))


def disjoint(intervals: Iterable[tuple[float, float]]) -> list[tuple[float, float]]:
    """The intervals in order, overlapping ones joined."""
    out: list[tuple[float, float]] = []
    for low, high in sorted(intervals):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


@dataclass
class Cells:
    """One column's rows in ascending order: (value, rows, target); a gap's value is a number inside the gap."""

    values: list[float]
    rows: list[int]
    targets: list[float]
    exact: list[bool]

    def __post_init__(self):
        self.ends, total = [], 0
        for n in self.rows:
            total += n
            self.ends.append(total)

    def at(self, rank: int) -> float | None:
        """The value of the row at a rank from 0; None if it lies in a gap."""
        i = bisect_left(self.ends, rank + 1)
        return self.values[i] if i < len(self.values) and self.exact[i] else None

    def quantile(self, prob: float) -> float | None:
        """With linear interpolation between ranks; None if a rank lies in a gap."""
        place = (self.ends[-1] - 1) * prob
        low, high = self.at(math.floor(place)), self.at(math.ceil(place))
        return None if low is None or high is None else low + (high - low) * (place - math.floor(place))

    def outside(self, low: float, high: float) -> int | None:
        """Rows below `low` or above `high`."""
        return sum(n for v, n in zip(self.values, self.rows) if v < low or v > high)


def cell_table(df: DataFrame, intervals: Mapping[str, list[tuple[float, float]]], target: str | None = None) -> DataFrame:
    """The second scan: (id, cell, value, n, target).

    In column i, cell 2k + 1 is interval k, cell 2k the gap before it, and the last cell, an odd one too, means no value. Rows with
    id i have the values in the intervals of column i, but for intervals of one value. The cells of PATTERN columns together make one number, the `cell` of the rows with id -1, -2, ...:
    a row of the data gives one of these per PATTERN columns, and one more for each value in an interval.
    """
    names = list(intervals)
    inside, cells_of = [], []
    for i, c in enumerate(names):
        v = clean(c)
        cell, within = F.lit(2 * len(intervals[c])), F.lit(False)
        for k, (low, high) in reversed(list(enumerate(intervals[c]))):
            cell = F.when(v < low, 2 * k).when(v <= high, 2 * k + 1).otherwise(cell)
            if low < high:  # an interval of one value needs no more than its count
                within = ((v >= low) & (v <= high)) | within
        cells_of.append(F.when(v.isNull(), _empty_cell(intervals[c])).otherwise(cell).cast("long"))
        inside.append(F.when(within, F.struct(F.lit(i).alias("id"), F.lit(0).cast("long").alias("cell"), v.alias("value"))))
    patterns = []
    for g, start in enumerate(range(0, len(names), PATTERN)):
        code = F.lit(0).cast("long")
        for c, cell in list(zip(names, cells_of))[start : start + PATTERN]:
            code = code * (_empty_cell(intervals[c]) + 1) + cell
        patterns.append(F.struct(F.lit(-1 - g).alias("id"), code.alias("cell"), F.lit(None).cast("double").alias("value")))
    at = F.col(target).cast("double") if target else F.lit(0.0)
    rows = df.select(F.explode(F.array_compact(F.array(*patterns, *inside))).alias("e"), at.alias("target"))
    return rows.groupBy("e.id", "e.cell", "e.value").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("target"))


def _empty_cell(intervals: list[tuple[float, float]]) -> int:
    return 2 * len(intervals) + 1


def cells(
    df: DataFrame, intervals: Mapping[str, Iterable[tuple[float, float]]], target: str | None = None, most: int = MOST_VALUES
) -> dict[str, Cells] | None:
    """Each column's cells from one scan; None if there are more than `most` values and patterns in all."""
    cuts = {c: disjoint(v) for c, v in intervals.items()}
    names = list(cuts)
    found = cell_table(df, cuts, target).limit(most + 1).toArrow()
    if found.num_rows > most:
        return None
    values: list[list] = [[] for _ in names]
    counted: list[dict[int, list]] = [{} for _ in names]
    for number, code, value, n, total in zip(*(found.column(k).to_pylist() for k in ("id", "cell", "value", "n", "target"))):
        if number >= 0:
            values[number].append((value, n, total, True))
            continue
        start = (-1 - number) * PATTERN
        for i in reversed(range(start, min(start + PATTERN, len(names)))):
            code, cell = divmod(code, _empty_cell(cuts[names[i]]) + 1)
            held = counted[i].setdefault(cell, [0, 0.0])
            held[0] += n
            held[1] += total or 0.0
    out = {}
    for i, c in enumerate(names):
        lows, highs = [a for a, _ in cuts[c]] + [math.inf], [-math.inf] + [b for _, b in cuts[c]]
        gaps = [(_between(highs[k // 2], lows[k // 2]), n, total, False) for k, (n, total) in counted[i].items() if k % 2 == 0]
        single = {2 * k + 1: low for k, (low, high) in enumerate(cuts[c]) if low == high}
        points = [(single[k], n, total, True) for k, (n, total) in counted[i].items() if k in single]
        rows = sorted([*values[i], *gaps, *points])
        out[c] = Cells([r[0] for r in rows], [r[1] for r in rows], [r[2] or 0.0 for r in rows], [r[3] for r in rows])
    return out


def _between(low: float, high: float) -> float:
    if math.isinf(low) or math.isinf(high):
        return low if math.isinf(low) else high
    return low + (high - low) / 2


def two_scan_quantiles(
    df: DataFrame, cols: Iterable[str], probs: Iterable[float], measures: Mapping[str, Column] | None = None,
    most: int = MOST_VALUES,
) -> tuple[dict[str, list[float | None]], Row]:
    """Exact quantiles with linear interpolation, as {column: [one value per prob]}, and the caller's aggregates."""
    cols, probs = list(dict.fromkeys(cols)), list(probs)
    first = sketched(df, cols, probs, measures)
    filled = [c for c in cols if first.counts[c]]
    table = cells(df, {c: first.brackets[c].values() for c in filled}, most=most) if filled else {}
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    open_cols = []
    for c in filled:
        found = [table[c].quantile(q) for q in probs] if table is not None else [None]
        if None in found:
            open_cols.append(c)
        else:
            out[c] = found
    if open_cols:
        out.update(exact_quantiles(df, open_cols, probs))
    return out, first.measures
