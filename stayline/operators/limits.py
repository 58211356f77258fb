"""Limits, top lists and unions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions.hashing import hash32


def cap_entities(df: DataFrame, key: str, n: int) -> DataFrame:
    """Exactly min(n, available) distinct keys, chosen by hash so reruns agree (a top-n, not a full sort)."""
    keys = df.select(key).distinct().withColumn("_h", hash32(key))
    return keys.orderBy("_h", key).limit(n).drop("_h")


def cap_rows(df: DataFrame, order, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


def top_terms(df: DataFrame, term: str, n: int = 20) -> DataFrame:
    counts = df.groupBy(term).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(term)).limit(n)


def top_contributions(df: DataFrame, value: str, tie: str, n: int = 15) -> DataFrame:
    """The n largest and n smallest rows, marked by side."""
    top = df.orderBy(F.desc(value), F.asc(tie)).limit(n).withColumn("side", F.lit("positive"))
    low = df.orderBy(F.asc(value), F.asc(tie)).limit(n).withColumn("side", F.lit("negative"))
    return top.unionByName(low)


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
