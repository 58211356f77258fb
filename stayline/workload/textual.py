"""Text operators over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayline.operators import limits as T
from stayline.operators import text as TX
from stayline.session import cut_lineage, written
from stayline.sources.reference import EXTRA_STOP_WORDS, STOP_WORDS
from stayline.workload.registry import query
from stayline.workload.relational import r6
from stayline.workload.roles import hash_sql, table


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
STOP_SQL = f"[{quoted([*STOP_WORDS, '_'])}]"
CLEAN = f"list_filter({TOKENS}, lambda t: NOT list_contains({STOP_SQL}, t))"
# a dictionary found in the data: a token ending in s maps to the token without it, if that occurs too
WORDS_SQL = f"""words AS (SELECT doc_id, unnest({TOKENS}) AS token, generate_subscripts({TOKENS}, 1) AS pos FROM documents),
seen AS (SELECT DISTINCT token FROM words),
dict AS (SELECT a.token, b.token AS lemma FROM seen a JOIN seen b ON a.token = b.token || 's'),
lem AS (SELECT doc_id, pos, lower(coalesce(lemma, token)) AS l FROM words LEFT JOIN dict USING (token)),
kept AS (SELECT * FROM lem WHERE regexp_full_match(l, '\\p{{L}}+') AND l NOT IN ({quoted([*STOP_WORDS, *EXTRA_STOP_WORDS])}))"""
GRAMS_SQL = f"""{WORDS_SQL},
two AS (SELECT doc_id, l, lead(l) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM kept WHERE length(l) >= 2),
grams AS (SELECT doc_id, l AS term FROM two UNION ALL SELECT doc_id, l || ' ' || nxt FROM two WHERE nxt IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY 1, 2),
vocab AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 2000),
raw AS (SELECT doc_id, term, tf * (ln((1.0e0 + (SELECT count(*) FROM documents)) / (1.0e0 + df)) + 1.0) AS w FROM tf JOIN vocab USING (term)),
tfidf AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


def documents(spark, sf):
    return table(spark, sf, "documents")


def dictionary(spark, sf):
    seen = written(TX.explode_terms(documents(spark, sf), TX.words("text")).select(F.col("term").alias("token")).distinct())
    stems = seen.select(F.col("token").alias("lemma"), F.concat("token", F.lit("s")).alias("token"))
    return cut_lineage(seen.join(stems, "token").select("token", "lemma"))


def lemmas(spark, sf):
    return TX.lemma_normalize(documents(spark, sf), "doc_id", "text", dictionary(spark, sf))


def lemma_table(spark, sf):
    """Lemma lists written once, for the jobs that read them several times."""
    return written(lemmas(spark, sf))


@query("note_stats", r"SELECT doc_id, length(text) AS note_length, len(regexp_extract_all(text, '\S+')) AS word_count FROM documents")
def note_stats(spark, sf):
    return TX.note_stats(documents(spark, sf)).select(
        "doc_id", F.col("note_length").cast("long").alias("note_length"), F.col("word_count").cast("long").alias("word_count")
    )


@query("tokenize", f"SELECT doc_id, len({CLEAN}) AS n_tokens, md5(array_to_string({CLEAN}, ' ')) AS digest FROM documents")
def tokenize(spark, sf):
    return documents(spark, sf).select("doc_id", TX.tokenize("text").alias("t")).select(
        "doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest")
    )


@query("term_frequency", f"SELECT term, count(*) AS n FROM (SELECT unnest({CLEAN}) AS term FROM documents) GROUP BY 1 ORDER BY n DESC, term LIMIT 20")
def term_frequency(spark, sf):
    return TX.term_frequency(documents(spark, sf))


@query("top_terms", f"SELECT l AS term, n FROM (WITH {WORDS_SQL} SELECT l, count(*) AS n FROM kept GROUP BY 1) ORDER BY n DESC, term LIMIT 20")
def top_terms(spark, sf):
    return T.top_terms(TX.explode_terms(lemmas(spark, sf), F.col("lemmas")), "term")


@query("token_set_diff", f"""SELECT conv_id, turn, len(list_distinct(list_filter(a, lambda t: list_contains(b, t)))) AS n_shared,
  len(list_distinct(list_filter(a, lambda t: NOT list_contains(b, t)))) AS n_only_raw
FROM (SELECT conv_id, turn, {TOKENS} AS a, {CLEAN} AS b FROM conversations)""")
def token_set_diff(spark, sf):
    raw, clean = TX.words("text"), TX.tokenize("text")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.size(F.array_intersect(raw, clean)).cast("long").alias("n_shared"),
        F.size(F.array_except(raw, clean)).cast("long").alias("n_only_raw"),
    )


@query("lemma_normalize", f"""WITH {WORDS_SQL}
SELECT doc_id, coalesce(md5(string_agg(l, ' ' ORDER BY pos)), md5('')) AS digest, count(l) AS n_lemmas
FROM (SELECT doc_id FROM documents) LEFT JOIN kept USING (doc_id) GROUP BY 1""")
def lemma_normalize(spark, sf):
    return lemmas(spark, sf).select(
        "doc_id", F.md5(F.array_join("lemmas", " ")).alias("digest"), F.array_size("lemmas").cast("long").alias("n_lemmas")
    )


@query("lemma_count", f"""WITH {WORDS_SQL}
SELECT n_lemmas, count(*) AS n_documents FROM (SELECT doc_id, count(l) AS n_lemmas FROM (SELECT doc_id FROM documents)
  LEFT JOIN kept USING (doc_id) GROUP BY 1) GROUP BY 1""")
def lemma_count(spark, sf):
    counts = lemmas(spark, sf).select(F.array_size("lemmas").cast("long").alias("n_lemmas"))
    return counts.groupBy("n_lemmas").agg(F.count(F.lit(1)).alias("n_documents"))


@query("ngrams", f"WITH {GRAMS_SQL} SELECT term, CAST(sum(tf) AS BIGINT) AS n, count(*) AS df FROM tf GROUP BY 1")
def ngrams(spark, sf):
    return TX.term_totals(lemmas(spark, sf), "doc_id", "lemmas", unique=True)


@query("tfidf_long", f"WITH {GRAMS_SQL} SELECT doc_id, term, round(weight, 6) AS weight FROM tfidf")
def tfidf_long(spark, sf):
    return TX.tfidf_long(lemma_table(spark, sf), "doc_id", "lemmas", unique=True).withColumn("weight", r6("weight"))


@query("tfidf", f"""WITH {GRAMS_SQL} SELECT doc_id, count(weight) AS n_terms, coalesce(round(sum(weight), 6), 0) AS total,
  coalesce(round(max(weight), 6), 0) AS top FROM (SELECT doc_id FROM documents) LEFT JOIN tfidf USING (doc_id) GROUP BY 1""")
def tfidf(spark, sf):
    vectors, _ = TX.tfidf_vectors(lemma_table(spark, sf), "doc_id", "lemmas", unique=True)
    dense = vectors.select("doc_id", F.unwrap_udt("tfidf")["values"].alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    return dense.select(
        "doc_id", F.size("w").cast("long").alias("n_terms"), r6(total).alias("total"),
        F.coalesce(r6(F.array_max("w")), F.lit(0.0)).alias("top"),
    )


@query("embed_attach", f"""SELECT doc_id, {", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS emb_{i}" for i in range(64))}
FROM documents JOIN embeddings ON vec_id = doc_id""")
def embed_attach(spark, sf):
    emb = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return TX.embed_attach(documents(spark, sf).select("doc_id"), emb, "doc_id", size=64)


@query("batch_embed")
def batch_embed(spark, sf):
    out = TX.batch_embed(documents(spark, sf).select("doc_id", "text"), "text", TX.hashing_predictor(64), 64)
    return out.select("doc_id", "embedding")


@query("hashed_embedding", f"""WITH k AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda t: t <> '')) AS tok FROM documents),
h AS (SELECT doc_id, {hash_sql('tok')} AS c FROM k), n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY 1),
s AS (SELECT doc_id, CAST(c % 16 AS INTEGER) AS slot, sum(CASE WHEN (c // 65536) % 2 = 1 THEN 1 ELSE -1 END) AS v FROM h GROUP BY 1, 2)
SELECT doc_id, slot, round(v / n, 6) AS value FROM s JOIN n USING (doc_id) WHERE v <> 0""")
def hashed_embedding(spark, sf):
    """The slots of the stand-in model that aren't zero."""
    slots = documents(spark, sf).select("doc_id", F.posexplode(TX.hashed_embedding("text", 16)).alias("slot", "value"))
    return slots.filter("value <> 0").withColumn("value", r6("value"))


@query("feature_token_match", f"""WITH {GRAMS_SQL}, t AS (SELECT unnest(['the', 'er', 'ion', 'tion en', 'eaux']) AS token),
l AS (SELECT token, term AS feature, CASE WHEN regexp_matches(term, '(^|[^\\p{{L}}\\p{{N}}_])' || token || '([^\\p{{L}}\\p{{N}}_]|$)') THEN 1
  WHEN term = token THEN 2 WHEN contains(term, token) THEN 3 END AS lvl FROM vocab, t)
SELECT token, feature FROM l WHERE lvl IS NOT NULL QUALIFY lvl = min(lvl) OVER (PARTITION BY token)""")
def feature_token_match(spark, sf):
    vocab = TX.most_frequent(TX.term_totals(lemmas(spark, sf), "doc_id", "lemmas", unique=True))
    return TX.feature_token_match(vocab, "term", ["the", "er", "ion", "tion en", "eaux"])


@query("snippet", """WITH p AS (SELECT doc_id, text, strpos(lower(text), 'the') - 1 AS pos FROM documents)
SELECT doc_id, CASE WHEN pos < 0 THEN '' ELSE regexp_replace(substr(text, CAST(greatest(pos - 60, 0) + 1 AS BIGINT),
  CAST(pos + 63 - greatest(pos - 60, 0) AS BIGINT)), 'the', '[THE]', 'gi') END AS snippet FROM p""")
def snippet(spark, sf):
    return documents(spark, sf).select("doc_id", TX.snippet("text", "the").alias("snippet"))


@query("presence_stats", f"""SELECT count(*) FILTER (WHERE h) AS n_present, count(*) FILTER (WHERE NOT h) AS n_absent,
  round(avg(toxic) FILTER (WHERE h), 6) AS rate_present, round(avg(toxic) FILTER (WHERE NOT h), 6) AS rate_absent, 'positive' AS coef_sign
FROM (SELECT toxic, list_contains({TOKENS}, 'heed') AS h FROM labels JOIN documents USING (doc_id))""")
def presence_stats(spark, sf):
    df = table(spark, sf, "labels").join(documents(spark, sf), "doc_id")
    out = TX.presence_stats(df, F.array_contains(TX.words("text"), "heed"), "toxic", 0.25)
    return out.withColumns({"rate_present": r6("rate_present"), "rate_absent": r6("rate_absent")})
