"""Join patterns."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions.columns import as_list

TASK_ROWS = 500_000


def left_chain(base: DataFrame, *features: tuple[DataFrame, str | list[str]]) -> DataFrame:
    """Left joins of features that hold one row per key. Equal keys in a row reuse the partitioning."""
    for df, on in features:
        base = base.join(df, on, "left")
    return base


def full_outer(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "full")


def keep_members(df: DataFrame, members: DataFrame, key) -> DataFrame:
    return df.join(members.select(*as_list(key)), as_list(key), "left_semi")


def dealt(df: DataFrame, key, rows: int, per_task: int = TASK_ROWS) -> DataFrame:
    """`df`, of at most `rows` rows, dealt by its key into tasks of about `per_task` rows; few rows are left as they are.

    Narrow rows compress well, so tasks that are sized by their bytes may hold millions of keys, each with a wide aggregate.
    """
    if rows <= 2 * per_task:
        return df
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, math.ceil(rows / per_task)), *as_list(key))


def key_report(df: DataFrame, key) -> DataFrame:
    """Rows, distinct keys and the largest fan-out: a feature is safe to join if max_rows is 1."""
    per_key = df.groupBy(*as_list(key)).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.max("_n").alias("max_rows")
    )


def require_unique(df: DataFrame, key) -> DataFrame:
    """The frame itself, after a job that fails if a key repeats."""
    report = key_report(df, key).first()
    if (report["max_rows"] or 0) > 1:
        raise ValueError(f"key {as_list(key)} repeats up to {report['max_rows']} times; aggregate first")
    return df


def hconcat(blocks: Iterable[DataFrame], key) -> DataFrame:
    """Feature blocks side by side, aligned on the key, never by position."""
    blocks = list(blocks)
    out = blocks[0]
    for b in blocks[1:]:
        out = out.join(b, key)
    return out
