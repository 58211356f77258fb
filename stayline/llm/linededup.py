"""Cross-site boilerplate lines, found by HyperLogLog sketches of the sites of each line.

Lines (split at line feeds, trimmed) are named by two 64-bit hashes of unlike seeds. Site hashes of a line merge into a sketch; an
estimate far enough from `min_sites` decides, and lines near it get an exact count of distinct sites. A line on at
least `min_sites` sites stays in the document with the smallest id that has it and goes from all others.

Work per line is map-side combined: one row per line and task is shuffled for the sketches, and one per line, site and task for
the exact counts, so one line or site in a third of all rows is no hot group. Only DataFrame functions are used.

Defined cases: null text is an empty text and comes out empty; blank lines are never boilerplate; null sites don't count;
repeated rows (same id and text) are treated alike; a null id is larger than all others; columns of any name come through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import free_name, narrow, work_table

MIN_SITES = 8
LG_K = 10  # 1024 registers: relative error about 3 %
MARGIN = 5 * 1.04 / 2 ** (LG_K / 2)  # five deviations


def _lines(rows: DataFrame) -> DataFrame:
    line = F.trim(F.col("line"))
    spread = rows.select("doc", "row1", "row2", "site", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return spread.filter(F.length(line) > 0).select(
        "doc", "row1", "row2", "site", "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")
    )


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2, first): lines on at least `min_sites` sites, and the smallest document with each.

    Sketches are filled line by line and merged on the map side; only lines whose estimate is near the threshold are read
    again for their distinct sites.
    """
    sketched = work_table(
        lines.groupBy("h1", "h2").agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.min("doc").alias("first")
        ).filter(F.col("sites") >= min_sites * (1 - MARGIN) - 1)
    )
    sure = sketched.filter(F.col("sites") > min_sites * (1 + MARGIN) + 1)
    close = sketched.filter(F.col("sites") <= min_sites * (1 + MARGIN) + 1)
    exact = lines.select("h1", "h2", "site").join(close.select("h1", "h2", "first"), ["h1", "h2"]).groupBy("h1", "h2", "first").agg(
        F.count_distinct("site").alias("sites")
    ).filter(F.col("sites") >= min_sites)
    return sure.select("h1", "h2", "first").union(exact.select("h1", "h2", "first"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES,
) -> DataFrame:
    """All rows and columns, the text without its boilerplate lines, and `n_lines` and `n_removed`.

    Where a column has one of these names already, it stays, and the count's name gets underscores (`free_name`).
    """
    def marks(doc, text) -> list:  # two hashes of unlike seeds name a row
        return [F.xxhash64(doc, text), F.xxhash64(F.lit(1), doc, text)]

    rows = narrow(docs, doc=id_col, text=text_col, site=site_col).withColumn("text", F.coalesce("text", F.lit("")))
    one, two = marks(F.col("doc"), F.col("text"))
    rows = rows.select(
        F.coalesce(F.col("doc").cast("long"), F.lit((1 << 63) - 1)).alias("doc"), "text",
        F.when(F.col("site").isNotNull(), F.xxhash64("site")).alias("site"), one.alias("row1"), two.alias("row2"),
    )
    lines = _lines(rows)
    common = boilerplate(lines, min_sites)
    gone = lines.join(common, ["h1", "h2"]).filter("doc <> first").groupBy("row1", "row2").agg(F.collect_set("pos").alias("gone"))
    # the row travels as one struct, so no column of it can clash
    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("own"))
    text = F.coalesce(F.col("own").getField(text_col), F.lit(""))
    one, two = marks(F.col("own").getField(id_col), text)
    joined = own.select("own", one.alias("row1"), two.alias("row2")).join(gone, ["row1", "row2"], "left")
    every = F.split(text, "\n", -1)
    kept = F.filter(every, lambda line, i: ~F.array_contains(F.col("gone"), i))
    left = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(kept, "\n"))
    columns = [(left if c == text_col else F.col("own").getField(c)).alias(c) for c in docs.columns]
    counts = (F.size(every).cast("long"), F.size(F.coalesce("gone", F.array().cast("array<int>"))).cast("long"))
    return joined.select(*columns, *[n.alias(free_name(name, docs.columns)) for name, n in zip(("n_lines", "n_removed"), counts)])


# The exact rule in SQL, for any engine with windowless grouping.
SQL = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
common AS (
  SELECT trim(line, ' ') AS line, min(doc_id) AS first FROM lines WHERE length(trim(line, ' ')) > 0
  GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (
  SELECT l.doc_id, l.pos, l.line, c.first IS NOT NULL AND c.first <> l.doc_id AS gone
  FROM lines l LEFT JOIN common c ON trim(l.line, ' ') = c.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_md5
FROM marked GROUP BY doc_id
"""
