"""Reading and writing tables, bundles, splits, run records and models."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayline.session import shared_folder


def scan_table(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = True) -> DataFrame:
    """CSV with a header; give a schema in production, since inference reads the file twice.

    Values may hold line breaks with `multi_line`, and each file is one task; without it large files are split.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def versioned_name(base: str, stamp: str) -> str:
    """`stamp` as YYYY_MM_DD_HHMM, passed in so a rerun can name the same table."""
    return f"{base}_{stamp}"


def create_versioned(df: DataFrame, base: str, stamp: str, path: str | None = None) -> str:
    """CREATE OR REPLACE of a time-stamped table; returns its name."""
    name = versioned_name(base, stamp)
    writer = df.write.mode("overwrite").format("parquet")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return name


def _write_json(spark: SparkSession, path: str, value) -> None:
    """One-row text file through Spark, so any Hadoop file system works."""
    text = json.dumps(value, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_json(spark: SparkSession, path: str):
    return json.loads("".join(r["value"] for r in spark.read.text(path).collect()))


def save_bundle(frames: Mapping[str, DataFrame], path: str) -> None:
    """One Parquet directory per name, then a manifest, written last so a half bundle is not readable."""
    spark = next(iter(frames.values())).sparkSession
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    _write_json(spark, f"{path}/bundle_manifest", {"names": sorted(frames)})


def load_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    names = _read_json(spark, f"{path}/bundle_manifest")["names"]
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def save_splits(datasets: Mapping[str, DataFrame], path: str, split_col: str = "split") -> None:
    """Each dataset as one table partitioned by its split, features and label side by side."""
    for name, df in datasets.items():
        df.write.mode("overwrite").partitionBy(split_col).parquet(f"{path}/{name}")


def load_splits(
    spark: SparkSession, path: str, name: str, label: str, split_col: str = "split"
) -> dict[str, DataFrame]:
    """X_train, X_test, y_train, y_test; the partition filter prunes files."""
    df = spark.read.parquet(f"{path}/{name}")
    out = {}
    for part in ("train", "test"):
        rows = df.filter(F.col(split_col) == part).drop(split_col)
        out[f"X_{part}"], out[f"y_{part}"] = rows.drop(label), rows.select(label)
    return out


def write_bucketed(df: DataFrame, key: str, buckets: int, name: str | None = None) -> DataFrame:
    """`df` as a table of the session's catalog, bucketed and sorted by `key`, its files in the shared folder.

    Tables with the same number of buckets are joined and grouped by `key` without a shuffle.
    """
    spark = df.sparkSession
    name = name or f"stayline_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key)  # one file per bucket
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", shared_folder(spark)).saveAsTable(name)
    return spark.table(name)


def write_run_log(spark: SparkSession, path: str, run: str, params: Mapping[str, object]) -> DataFrame:
    """Append the parameters of a run as (run, parameter, value) rows."""
    rows = [(run, k, json.dumps(v)) for k, v in sorted(params.items())]
    log = spark.createDataFrame(rows, "run string, parameter string, value string")
    log.coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def save_model(model, path: str, *, params: Mapping, threshold: float, metrics: DataFrame, **extra) -> None:
    """Spark ML model, metrics table and the serving settings that `load_model` returns."""
    model.write().overwrite().save(f"{path}/model")
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    serving = {"best_params": dict(params), "threshold": threshold, **extra}
    _write_json(metrics.sparkSession, f"{path}/serving", serving)


def load_model(spark: SparkSession, path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(f"{path}/model"), _read_json(spark, f"{path}/serving")
