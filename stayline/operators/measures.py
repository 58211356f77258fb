"""Measurements: dimension lookup and per-key pivots."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.operators.aggregates import pivot_aggregate
from stayline.operators.codes import small_table
from stayline.sources.reference import FAHRENHEIT, LAB_LABELS, VITAL_LABELS


def lookup_join(
    facts: DataFrame, dim: DataFrame, labels: Iterable[str], item="itemid", label="label", required=("valuenum",)
) -> DataFrame:
    """Facts with a listed label and the required columns present. The dimension is cut down first."""
    wanted = dim.filter(F.col(label).isin(*labels)).select(item, label)
    for c in required:
        facts = facts.filter(F.col(c).isNotNull())
    return facts.join(small_table(wanted), item)


def all_labels(groups: Mapping[str, Iterable[str]]) -> list[str]:
    return [x for labels in groups.values() for x in labels]


def latest_per_label(
    df: DataFrame, key="hadm_id", label="label", value="valuenum", time="charttime", tie="event_id"
) -> DataFrame:
    """Value of the latest row per (key, label), as an aggregate rather than a ranked window."""
    return df.groupBy(key, label).agg(F.max_by(value, F.struct(time, tie)).alias(value))


def measure_pivot(
    df: DataFrame, groups: Mapping[str, Iterable[str]] = LAB_LABELS, key="hadm_id", label="label",
    value="valuenum", time="charttime", tie="event_id", merge_synonyms_first: bool = False,
) -> DataFrame:
    """last/min/max of every label group per key.

    Two aggregates on nested keys: (key, label), then key. By default the last value of a group is the
    largest of its labels' last values; `merge_synonyms_first` takes the latest over all its labels.
    """
    per_label = df.groupBy(key, label).agg(
        F.min(value).alias("_min"), F.max(value).alias("_max"),
        F.max_by(value, F.struct(time, tie)).alias("_last"), F.max(F.struct(time, tie)).alias("_at"),
    )
    aggs = []
    for name, labels in groups.items():
        mine = F.col(label).isin(*labels)
        if merge_synonyms_first:
            last = F.max_by("_last", F.when(mine, F.col("_at")))
        else:
            last = F.max(F.when(mine, F.col("_last")))
        aggs += [
            last.alias(f"{name}_last"), F.min(F.when(mine, F.col("_min"))).alias(f"{name}_min"),
            F.max(F.when(mine, F.col("_max"))).alias(f"{name}_max"),
        ]
    return per_label.groupBy(key).agg(*aggs)


def mean_pivot(
    df: DataFrame, groups: Mapping[str, Iterable[str]] = VITAL_LABELS, key="stay_id", label="label", value="valuenum"
) -> DataFrame:
    """Mean of every label group per key; Fahrenheit readings count in Celsius."""
    celsius = F.when(F.col(label) == FAHRENHEIT, (F.col(value) - 32.0) * 5.0 / 9.0).otherwise(F.col(value))
    return df.withColumn("_c", celsius).groupBy(key).agg(*pivot_aggregate(groups, label, "_c", F.avg))
