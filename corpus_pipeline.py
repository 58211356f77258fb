"""A cleaning pipeline over `documents`: each stage takes (spark, docs, sf_dir) and returns what it keeps.

Every stage but the last returns the columns of `documents`; a stage's result is written as Parquet and read again as the
next one's input. Stages accept nulls, empty texts, repeated rows and empty tables as their operators do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.llm import bpe, decontaminate, linededup, minhash, quality
from stayline.llm.common import free_name, work_table
from stayline.llm.queries import byte_bpe, table, training

QUALITY_CUT = 0.3


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the cut."""
    model = quality.fit(docs, training(table(spark, sf_dir, "labels")), "quality")
    name = free_name("score", docs.columns)
    return quality.scored(docs, model, "text", out=name).filter(F.col(name) >= QUALITY_CUT).select(*docs.columns)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site lines; those that had nothing else go."""
    removed = free_name("n_removed", docs.columns)
    kept = linededup.dedup_lines(docs).filter((F.col(removed) == 0) | (F.length(F.trim("text")) > 0))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id, once. Texts of one id in different groups are told apart."""
    mark = free_name("text_hash", docs.columns)
    kept = minhash.near_groups(docs, words=5, percent=80).filter("kept").select("doc_id", F.col("text_hash").alias(mark))
    marked = docs.filter("doc_id is not null").withColumn(mark, F.xxhash64("text"))
    named = marked.join(kept, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark])
    return named.select(*docs.columns).union(docs.filter("doc_id is null"))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it."""
    return bpe.encode_checked(docs, byte_bpe())


STAGES = [
    ("quality", good_quality),
    ("line_dedup", without_boilerplate),
    ("near_dedup", one_of_each),
    ("decontamination", without_benchmarks),
    ("bpe", tokens),
]
ORACLE_SQL = None  # the fitted classifier, the sketches and the tokenizer have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
