"""The three label definitions. They answer different questions and are kept apart by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions.ordering import HOT_ROWS
from stayline.functions.scalars import days_between, whole_days
from stayline.operators.windows import lead_next, next_event_after


def label_lead(
    stays: DataFrame, person="subject_id", stay="hadm_id", start="admittime", end="dischtime", kind="admission_type",
    planned="ELECTIVE", days: int = 30, label="readmit_30days", threshold: float = HOT_ROWS,
) -> DataFrame:
    """1 if the very next stay is unplanned and starts 0..days whole days after the end.

    Give the full table: the next stay must be known before any filter or sample. A NULL kind counts as 0.
    """
    take = {"next_hadm_id": stay, "next_admittime": start, "next_admission_type": kind}
    nxt = lead_next(stays, person, [start, stay], take, threshold)
    gap = whole_days(end, "next_admittime")
    hit = (F.col("next_admission_type") != planned) & gap.between(0, days)
    return nxt.withColumn("days_to_next_admit", gap).withColumn(label, F.when(hit, 1).otherwise(0))


def label_any_unplanned(
    index: DataFrame, stays: DataFrame, person="subject_id", stay="hadm_id", start="admittime", end="dischtime",
    kind="admission_type", planned="ELECTIVE", days: int = 30, label="readmit_30d_unplanned",
    threshold: float = HOT_ROWS,
) -> DataFrame:
    """1 if any unplanned stay of the person starts after the end and within `days` whole days.

    The earliest unplanned stay after the end decides: if that one is too late, so are all others.
    """
    found = next_event_after(
        index, stays, person, end, start, {"_nid": stay, "_nat": start}, stay, F.col(kind) != planned, threshold
    )
    near = whole_days(end, "_nat") <= days
    return (
        found.withColumn("next_hadm_id", F.when(near, F.col("_nid")))
        .withColumn("next_admittime", F.when(near, F.col("_nat")))
        .withColumn(label, F.when(F.col("next_hadm_id").isNull(), 0).otherwise(1))
        .drop("_nid", "_nat")
    )


def label_fractional(
    rows: DataFrame, person="subject_id", stay="hadm_id", start="admittime", end="dischtime", days: float = 30,
    label="readmit_30days", threshold: float = HOT_ROWS,
) -> DataFrame:
    """1 if the next row of the extract by end time starts 0..days fractional days later, planned or not."""
    nxt = lead_next(rows, person, [end, stay], {"next_admittime": start}, threshold)
    gap = days_between(end, "next_admittime")
    return nxt.withColumn("days_to_next_admit", gap).withColumn(
        label, F.when(gap.between(0, days), 1).otherwise(0)
    )
