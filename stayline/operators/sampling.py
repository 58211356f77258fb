"""Deterministic sampling, splitting and resampling by key hash."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.functions.hashing import hash32, unit
from stayline.functions.ordering import dense_rank_by_hash
from stayline.operators.codes import small_table
from stayline.session import cut_lineage


def in_bucket(key, mod: int = 1000, bucket: int = 500, seed=None) -> Column:
    """True for the first `bucket` of `mod` hash buckets; raising `bucket` only adds keys."""
    return hash32(key, seed=seed) % mod < bucket


def hash_bucket_sample(df: DataFrame, key: str, mod: int = 1000, bucket: int = 500, seed=None) -> DataFrame:
    return df.filter(in_bucket(key, mod, bucket, seed))


def train_test_split(df: DataFrame, key: str, test: float = 0.3, seed: int = 42, out="split") -> DataFrame:
    """Random split by key hash: no shuffle, and the same whatever the partitioning."""
    return df.withColumn(out, F.when(unit(key, seed=seed) < test, "test").otherwise("train"))


def _class_rank(df: DataFrame, key: str, label: str, seed) -> DataFrame:
    hashed = df.withColumn("_h", hash32(key, seed=seed))
    return dense_rank_by_hash(hashed, "_h", key, "_rank", by=label).drop("_h")


def _class_sizes(df: DataFrame, label: str) -> DataFrame:
    """One row per class, broadcast if they are counted to be few."""
    return small_table(cut_lineage(df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))))


def stratified_split(
    df: DataFrame, key: str, label: str, test: float = 0.2, seed: int = 42, out="split"
) -> DataFrame:
    """Exactly round(test * n) rows of each class go to the test part."""
    ranked = _class_rank(df, key, label, seed).join(_class_sizes(df, label), label)
    part = F.when(F.col("_rank") <= F.round(F.col("_size") * test), "test").otherwise("train")
    return ranked.withColumn(out, part).drop("_rank", "_size")


def stratified_kfold(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42, out="fold") -> DataFrame:
    """Fold number 0..k-1, dealt in hash order inside each class."""
    ranked = _class_rank(df, key, label, seed)
    return ranked.withColumn(out, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def keep_pos_sample_neg(
    df: DataFrame, key: str, label: str, n_neg: int = 1000, max_pos_rate: float = 0.05, seed: int = 42
) -> DataFrame:
    """All positives and at most n_neg negatives if positives are rarer than max_pos_rate, else all rows."""
    if (df.agg(F.avg(label)).first()[0] or 0.0) >= max_pos_rate:
        return df
    negatives = df.filter(F.col(label) == 0).withColumn("_h", hash32(key, seed=seed))
    chosen = negatives.orderBy("_h", key).limit(n_neg).drop("_h")
    return df.filter(F.col(label) == 1).unionByName(chosen)


def cap_rows_stratified(df: DataFrame, key: str, label: str, max_rows: int, seed: int = 42) -> DataFrame:
    """The same fraction of each class so that about max_rows remain."""
    n = df.count()
    if n <= max_rows:
        return df
    ranked = _class_rank(df, key, label, seed).join(_class_sizes(df, label), label)
    keep = F.col("_rank") <= F.round(F.col("_size") * F.lit(max_rows / n))
    return ranked.filter(keep).drop("_rank", "_size")


def draws(spark, n: int, m: int, seed) -> DataFrame:
    """n draws with replacement from 1..m, as (draw, _rank)."""
    return spark.range(n).select(
        F.col("id").alias("draw"), (hash32("id", seed=seed) % m + 1).alias("_rank")
    )


def minority_sizes(df: DataFrame, label: str, minority=1) -> tuple[int, int]:
    """Rows of the minority class, and of the largest other one."""
    is_minority = F.col(label).eqNullSafe(F.lit(minority))
    row = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.sum(F.when(is_minority, F.col("_n"))), F.max(F.when(~is_minority, F.col("_n")))
    ).first()
    return row[0] or 0, row[1] or 0


def random_oversample(
    df: DataFrame, key: str, label: str, ratio: float = 0.5, seed: int = 42, minority: int = 1
) -> DataFrame:
    """Copies of minority rows until they reach ratio * majority; `draw` is NULL on original rows."""
    m, largest = minority_sizes(df, label, minority)
    target = int(ratio * largest)
    base = df.withColumn("draw", F.lit(None).cast("long"))
    if m == 0 or target <= m:
        return base
    hashed = df.filter(F.col(label) == minority).withColumn("_h", hash32(key, seed=seed))
    numbered = dense_rank_by_hash(hashed, "_h", key, "_rank").drop("_h")
    extra = draws(df.sparkSession, target - m, m, seed).join(numbered, "_rank").drop("_rank")
    return base.unionByName(extra)


@dataclass(frozen=True)
class ResamplePolicy:
    """Which resampler may be used, and why."""

    sampler: str | None
    k_neighbors: int
    reason: str


def resample_policy(
    df: DataFrame, label: str, requested: str | None = "smote", n_features: int = 0, sparse: bool = False,
    max_features: int = 200, max_pos_rate: float = 0.05, k: int = 5,
) -> ResamplePolicy:
    """SMOTE only for dense, narrow, rare-positive data; fewer neighbours or plain copies for tiny minorities."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label)).alias("pos")).first()
    n, pos = row["n"], row["pos"] or 0
    if requested is None:
        return ResamplePolicy(None, k, "not requested")
    if requested != "smote":
        return ResamplePolicy(requested, k, "as requested")
    if sparse:
        return ResamplePolicy(None, k, "sparse features")
    if n_features > max_features:
        return ResamplePolicy(None, k, f"more than {max_features} features")
    if n == 0 or pos / n >= max_pos_rate:
        return ResamplePolicy(None, k, f"positives not below {max_pos_rate:.0%}")
    if pos < 2:
        return ResamplePolicy("ros", k, "minority too small for neighbours")
    return ResamplePolicy("smote", int(min(k, pos - 1)), "dense, narrow, rare positives")


def resample_frames(
    train: DataFrame, valid: DataFrame, resample, both: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Apply `resample` to the training part; `both` also to the validation part (diagnostic, inflates scores)."""
    return resample(train), (resample(valid) if both else valid)


def label_union(positives: DataFrame, negatives: DataFrame, columns: Iterable[str]) -> DataFrame:
    return positives.select(*columns).unionByName(negatives.select(*columns))
