"""Token totals by source, language and tokenizer version, maintained by signed deltas.

A change inserts, deletes or revises the count of one document under one tokenizer version. A batch of changes is
pre-aggregated to one signed row per (source, lang, version) and committed to its own folder below the store; a batch
whose success marker is there is not written again, so a replay changes nothing, and a batch that broke off is
written anew. Totals are the sum over committed batches.

Defined cases: null text has no tokens; null source or lang is a group of its own; repeated changes count each time within
a batch; groups without documents are left out of the totals. Of equal texts the smallest id stays, with all its rows; null ids
come after all others, and where there are no others all rows stay. Two writers of one batch at a time are not kept apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.llm.common import work_table

# Tokenizer versions that are plain patterns; each match is a token.
VERSIONS = {
    "words-1": r"[^ \t\n\x0B\f\r]+",
    "words-2": r"[A-Za-z0-9]+|[^A-Za-z0-9 \t\n\x0B\f\r]",
}
KEYS = ["source", "lang", "version"]


def token_count(text: Column, version: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(VERSIONS[version])).cast("long")


def counted(docs: DataFrame, text: str = "text", versions=tuple(VERSIONS)) -> DataFrame:
    """One row per document and version, with `n_tokens`."""
    each = F.array(*[F.struct(F.lit(v).alias("version"), token_count(F.col(text), v).alias("n_tokens")) for v in versions])
    return docs.select("doc_id", "source", "lang", F.inline(each))


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.col("n_tokens").alias("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("n_tokens")).alias("tokens"))


def revisions(counts: DataFrame, old: str = "old_tokens", new: str = "n_tokens") -> DataFrame:
    return counts.select(*KEYS, F.lit(0).cast("long").alias("docs"), (F.col(new) - F.col(old)).alias("tokens"))


class Rollup:
    """A store of committed batches in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, path: str):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath, jpath.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        root, fs = self._path(self.folder)
        if not fs.exists(root):
            return []
        folders = [str(s.getPath().toString()) for s in fs.listStatus(root) if s.isDirectory()]
        return sorted(f for f in folders if self._done(f))

    def _done(self, folder: str) -> bool:
        path, fs = self._path(f"{folder}/_SUCCESS")
        return fs.exists(path)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Write the batch's signed sums; False if a batch of that name is committed already."""
        folder = f"{self.folder}/{batch}"
        if self._done(folder):
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(folder)
        return True

    def totals(self) -> DataFrame:
        folders = self.committed()
        schema = "source string, lang string, version string, docs long, tokens long"
        rows = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens")).filter("n_docs <> 0")


SALTS = 64


def later_copies(rows: DataFrame) -> DataFrame:
    """Rows of (doc_id, name, ...) that aren't of the smallest id with their name; null ids come last.

    The rows of a name are dealt over SALTS tasks, which meet its smallest id once each.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "source", "lang"), F.lit(SALTS)))
    firsts = rows.groupBy("name").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null")
    named = salted.select("name", "salt").distinct().join(firsts.select("name", "first"), "name")
    return salted.join(named, ["name", "salt"]).filter("doc_id > first or doc_id is null").drop("salt", "first")


SQL = """
WITH kept AS (
  SELECT doc_id, source, lang, translate(coalesce(text, ''), '#$%&*', '') AS text
  FROM documents QUALIFY doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY coalesce(text, ''))),
counts AS (
  SELECT source, lang, 'words-1' AS version, len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS n FROM kept
  UNION ALL
  SELECT source, lang, 'words-2', len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9 \\t\\n\\x0B\\f\\r]')) FROM kept)
SELECT source, lang, version, count(*) AS n_docs, cast(sum(n) AS BIGINT) AS n_tokens FROM counts GROUP BY ALL
"""


def maintained(docs: DataFrame, rollup: Rollup, symbols: str = "#$%&*") -> DataFrame:
    """Insert every document, delete later copies, revise counts for texts without `symbols`, replay, and total."""
    text = F.coalesce("text", F.lit(""))
    touched = text.rlike("[" + symbols + "]")
    new = F.translate(text, symbols, "")
    each = F.array(*[
        F.struct(
            F.lit(v).alias("version"), token_count(text, v).alias("old_tokens"),
            F.when(touched, token_count(new, v)).alias("n_tokens"),  # null where nothing is revised
        )
        for v in VERSIONS
    ])
    # texts are read once; what follows reads names and counts
    rows = work_table(docs.select("doc_id", "source", "lang", F.sha2(text, 256).alias("name"), each.alias("counts")))
    versions = lambda df, n: df.select("source", "lang", F.inline("counts")).select(*KEYS, F.col(n).alias("n_tokens"), "old_tokens")
    counts = versions(rows, "old_tokens")
    rollup.commit("insert", inserts(counts))
    copies = later_copies(rows)
    rollup.commit("delete", deletes(versions(copies, "old_tokens")))
    revised = versions(rows, "n_tokens").filter("n_tokens is not null")
    rollup.commit("revise", revisions(revised))
    taken_back = versions(copies, "n_tokens").filter("n_tokens is not null")
    rollup.commit("revise-copies", revisions(taken_back, "n_tokens", "old_tokens"))  # deleted copies are not revised
    rollup.commit("delete", deletes(counts))  # a replayed name: nothing happens
    return rollup.totals()
