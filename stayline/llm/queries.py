"""The dealt operators over their whole tables, with oracle SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.llm import (
    bpe, decontaminate, fingerprint, linededup, lmscore, manifest, minhash, piecebpe, quality, runs, tokencounts, toxicity, warc,
)
from stayline.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def training(labels: DataFrame) -> DataFrame:
    return labels.filter(~held_out())


def decided(scores: DataFrame, cut: float) -> DataFrame:
    return scores.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")
    )


@query("op4_bpe")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), byte_bpe())


@query("op6_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return decided(toxicity.score(docs, toxicity.fit(docs, training(table(spark, sf_dir, "labels")), "toxic")), 0.5)


@query("op9_quality")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return decided(quality.score(docs, quality.fit(docs, training(table(spark, sf_dir, "labels")), "quality")), 0.3)


@query("op5_near_duplicates")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"), words=4, percent=80)


@query("op7_decontamination")
def benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_line_dedup", linededup.SQL)
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("text_md5")
    )


@query("op1_fingerprints")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op3_token_counts", tokencounts.SQL)
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.maintained(table(spark, sf_dir, "documents"), tokencounts.Rollup(spark, shared_folder(spark)))


@query("op8_warc")
def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.reassemble(warc.read_records(spark, folder))


@query("op10_lm_scores")
def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lmscore.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


@query("op11_manifest", manifest.SQL)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified(table(spark, sf_dir, "documents"))


@query("op12_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.collapse_runs(runs.planted(table(spark, sf_dir, "documents"))).withColumn("best", runs.strongest(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


@query("op13_sentencepiece")
def sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecebpe.round_trip(table(spark, sf_dir, "documents"), piece_bpe())
