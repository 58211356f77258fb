"""Session settings and lineage cutting."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = 8, app: str = "stayline", **conf) -> SparkSession:
    """A session for tests and benches; on a cluster pass your own session instead."""
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "12g",
    }
    settings.update({k: str(v) for k, v in conf.items()})
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the session's reliable checkpoint folder and read it back.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only a local session without
    that setting gets a folder of its own, since a machine-local path is useless to other executors.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="stayline-checkpoint-"))
    return df.checkpoint(eager=True)


def even_parts(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """`df` checkpointed, dealt evenly into parts of about `rows` rows if one of its own holds more.

    For tables that many jobs pass over: parts sized by bytes put narrow rows into a few tasks.
    """
    cut = cut_lineage(df)
    sizes = cut.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
    found = sizes.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    if (found["most"] or 0) <= rows:
        return cut
    return cut_lineage(cut.repartition(math.ceil(found["n"] / rows)))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the session's shared checkpoint folder, for tables handed between jobs."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="stayline-")
    return f"{base.rstrip('/')}/stayline-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet to a new shared folder and read it back: smaller than a checkpoint for large tables."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
