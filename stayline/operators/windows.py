"""Next-row lookups."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.functions.columns import as_col
from stayline.functions.ordering import HOT_ROWS, next_value


def lead_next(
    df: DataFrame, key="subject_id", order: Iterable[str] = ("admittime", "hadm_id"),
    take: Mapping[str, str] | None = None, threshold: float = HOT_ROWS,
) -> DataFrame:
    """Columns of the following row of the same key, as {output: column}; all share one sort."""
    order = list(order)
    take = dict(take or {"next_hadm_id": "hadm_id", "next_admittime": "admittime"})
    value = F.struct(*[F.col(c).alias(out) for out, c in take.items()])
    found = next_value(df, key, order, value, "_next", threshold=threshold)
    return found.select(*df.columns, *[F.col(f"_next.{out}").alias(out) for out in take])


def next_event_after(
    probes: DataFrame, events: DataFrame, key: str, at: str, time: str, take: Mapping[str, str], tie: str,
    condition: Column | None = None, threshold: float = HOT_ROWS,
) -> DataFrame:
    """Per probe row, the earliest event of its key strictly after `at` (ties by `tie`), or NULLs.

    Probes and events are sorted together once; no probe-event pairs are built.
    """
    taken = F.struct(*[F.col(c).alias(out) for out, c in take.items()])
    chosen = events.filter(condition) if condition is not None else events
    right = chosen.filter(F.col(time).isNotNull()).select(
        key, F.col(time).alias("_t"), F.lit(0).alias("_probe"), F.col(tie).alias("_tie"),
        taken.alias("_ev"),
    )
    left = probes.select(key, F.col(at).alias("_t"), F.lit(1).alias("_probe"), F.struct("*").alias("_row"))
    both = left.unionByName(right, allowMissingColumns=True)
    found = next_value(
        both, key, ["_t", "_probe", "_tie"], F.col("_ev"), "_next", threshold=threshold
    )
    return found.filter(F.col("_probe") == 1).select(
        "_row.*", *[F.when(F.col("_t").isNotNull(), F.col(f"_next.{out}")).alias(out) for out in take]
    )


def latest_row(df: DataFrame, keys: Iterable[str], order: Iterable[str]) -> DataFrame:
    """The last row of each key group in `order`, as an aggregate that combines on the map side."""
    row = F.struct(*[as_col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_r")).select("_r.*")
