"""Tokens, terms, TF-IDF, embeddings and snippets. Texts are always read whole."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from stayline.functions.columns import as_col, ordered_unique
from stayline.functions.hashing import hash32
from stayline.functions.scalars import WORD, word_count
from stayline.operators.codes import MAX_BROADCAST_ROWS
from stayline.sources.reference import EXTRA_STOP_WORDS, STOP_WORDS
from stayline.session import written

BATCH_TOKENS = 2_000_000  # about as many tokens are counted at once in a task


def note_stats(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumns({"note_length": F.length(text), "word_count": word_count(text)})


def words(text) -> Column:
    """Lower-case runs of letters, digits and underscores, in any script."""
    return F.regexp_extract_all(F.lower(as_col(text)), F.lit(WORD), F.lit(0))


def tokenize(text, stop: Iterable[str] = STOP_WORDS) -> Column:
    """Words without stop words and lone underscores."""
    dropped = [*stop, "_"]
    return F.filter(words(text), lambda t: ~t.isin(dropped))


def explode_terms(df: DataFrame, tokens: Column, *keep: str) -> DataFrame:
    """One row per term. The outer form is used since the plain one also filters on the size of the list,
    which would compute the tokens twice."""
    return df.select(*keep, F.explode_outer(tokens).alias("term")).filter(F.col("term").isNotNull())


def term_frequency(df: DataFrame, text: str = "text", n: int | None = 20, stop: Iterable[str] = STOP_WORDS) -> DataFrame:
    counts = explode_terms(df, tokenize(text, stop)).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc("term")).limit(n) if n is not None else counts


def lemma_normalize(
    df: DataFrame, key: str, text: str, dictionary: DataFrame,
    stop: Iterable[str] = (*STOP_WORDS, *EXTRA_STOP_WORDS), out: str = "lemmas",
) -> DataFrame:
    """(key, lemmas): tokens mapped by a (token, lemma) table, then alphabetic non-stop lemmas in order; one row per key.

    With a small dictionary each list is mapped where it is, and only the texts of keys with several rows are regrouped.
    A large one, or one with several lemmas of a token, is joined by token, and the lists are regrouped afterwards.
    """
    pairs_table, stop = dictionary.select("token", "lemma"), list(stop)
    known = pairs_table.limit(MAX_BROADCAST_ROWS + 1).toArrow()  # what a broadcast holds, at most
    tokens = known.column("token").drop_null()
    if known.num_rows > MAX_BROADCAST_ROWS or len(tokens.unique()) < len(tokens):
        small = known.num_rows <= MAX_BROADCAST_ROWS
        return _lemmas_regrouped(df, key, text, F.broadcast(pairs_table) if small else pairs_table, stop, out)
    many = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_key")
    if many.isEmpty():
        return _lemmas_in_place(df, key, text, known, stop, out)
    same = F.col(key).eqNullSafe(F.col("_key"))
    single = _lemmas_in_place(df.join(many, same, "left_anti"), key, text, known, stop, out)
    return single.unionByName(
        _lemmas_regrouped(df.join(many, same, "left_semi"), key, text, F.broadcast(pairs_table), stop, out)
    )


def _kept(lemma: Column, stop: list[str]) -> Column:
    return lemma.rlike(r"^\p{L}+$") & ~lemma.isin(stop)


def _lemmas_in_place(df: DataFrame, key: str, text: str, known: pa.Table, stop: list[str], out: str) -> DataFrame:
    """Each row's words are looked up in a shared table of unique tokens; keys are unique."""
    shared = df.sparkSession.sparkContext.broadcast(known.filter(pc.is_valid(known.column("token"))).combine_chunks())

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            names, lemmas = (shared.value.column(c).combine_chunks().cast(flat.type) for c in ("token", "lemma"))
            mapped = pc.coalesce(lemmas.take(pc.index_in(flat, value_set=names)), flat)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(ends, mapped)], names=[key, out])

    schema = StructType([df.schema[key], StructField(out, ArrayType(StringType()))])
    texts = df.select(key, text).repartition(F.col(key)).select(key, F.coalesce(words(text), F.array().cast("array<string>")))
    lemmas = F.filter(F.transform(out, F.lower), lambda l: _kept(l, stop))
    return texts.mapInArrow(run, schema).select(key, lemmas.alias(out))


def _lemmas_regrouped(df: DataFrame, key: str, text: str, pairs_table: DataFrame, stop: list[str], out: str) -> DataFrame:
    tokens = df.select(key, F.posexplode_outer(words(text)).alias("_pos", "token"))
    mapped = tokens.join(pairs_table, "token", "left")
    lemma = F.lower(F.coalesce("lemma", "token"))
    pairs = F.collect_list(F.when(_kept(lemma, stop), F.struct("_pos", lemma.alias("l"))))
    return mapped.groupBy(key).agg(F.transform(F.sort_array(pairs), lambda p: p["l"]).alias(out))


def ngrams(tokens, min_length: int = 2, bigrams: bool = True) -> Column:
    """Unigrams and adjacent pairs; too short tokens go first, so pairs may span them."""
    kept = F.filter(as_col(tokens), lambda t: F.length(t) >= min_length)
    if not bigrams:
        return kept
    n = F.greatest(F.size(kept) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(kept, 1, n), F.slice(kept, 2, n), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(kept, pairs)


def term_counts(df: DataFrame, key: str, tokens: str, bigrams: bool = True) -> DataFrame:
    grams = explode_terms(df, ngrams(tokens, bigrams=bigrams), key)
    return grams.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def term_totals(df: DataFrame, key: str, tokens: str, bigrams: bool = True, unique: bool = False) -> DataFrame:
    """(term, n, df): occurrences of each term and the keys that have it.

    With `unique` each row is a document of its own: Arrow batches of documents are counted where they are, and partial sums per
    term are all that is shuffled. Else the rows of a key are brought together.
    """
    if not unique:
        return _totals(term_counts(df, key, tokens, bigrams))

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            cuts = np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, BATCH_TOKENS), side="right")
            for start, stop in pairwise([*dict.fromkeys([0, *cuts.tolist()]), len(lists)]):
                yield _batch_totals(lists.slice(start, stop - start), bigrams)

    parts = df.select(tokens).mapInArrow(run, "term string, n long, df long")
    return parts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _batch_totals(lists: pa.ListArray, bigrams: bool) -> pa.RecordBatch:
    """(term, n, df) of some documents; terms are those of `ngrams`."""
    flat, row = lists.flatten(), pc.list_parent_indices(lists)
    kept = pc.fill_null(pc.greater_equal(pc.utf8_length(flat), 2), False)
    found, row = flat.filter(kept).dictionary_encode(), row.filter(kept).to_numpy(zero_copy_only=False).astype(np.int64)
    code, words = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary
    if bigrams and len(code):
        beside = row[1:] == row[:-1]
        pairs = pa.array((code[:-1] * len(words) + code[1:])[beside]).dictionary_encode()
        first, second = np.divmod(pairs.dictionary.to_numpy(zero_copy_only=False), len(words))
        joined = pc.binary_join_element_wise(words.take(pa.array(first)), words.take(pa.array(second)), " ")
        code = np.concatenate([code, len(words) + pairs.indices.to_numpy(zero_copy_only=False)])
        row = np.concatenate([row, row[1:][beside]])
        # a word that holds a space may equal a pair
        terms = pa.concat_arrays([words, joined.cast(words.type)]).dictionary_encode()
        code, words = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)[code], terms.dictionary
    n = np.bincount(code, minlength=len(words))
    each = pa.array(row * max(1, len(words)) + code).unique().to_numpy(zero_copy_only=False)
    df = np.bincount(each % max(1, len(words)), minlength=len(words))
    return pa.record_batch([words, pa.array(n, pa.int64()), pa.array(df, pa.int64())], names=["term", "n", "df"])


def _totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("df"))


def most_frequent(totals: DataFrame, max_features: int = 2000) -> DataFrame:
    """The first of (term, n, df) by n; a top-n, at most max_features rows."""
    return totals.orderBy(F.desc("n"), F.asc("term")).limit(max_features)


def vocabulary(counts: DataFrame, max_features: int = 2000) -> DataFrame:
    """(term, n, df) of the most frequent terms of (key, term, tf) rows."""
    return most_frequent(_totals(counts), max_features)


def smooth_idf(df_col, n_docs) -> Column:
    return F.log((F.lit(1.0) + as_col(n_docs)) / (F.lit(1.0) + as_col(df_col))) + 1.0


def tfidf_long(df: DataFrame, key: str, tokens: str, max_features: int = 2000, unique: bool = False) -> DataFrame:
    """(key, term, weight), each document scaled to length 1, over the top terms of the corpus.

    With `unique` each row is a document of its own, and its terms are counted where it is. Else terms are counted once and
    written; the vocabulary and the weights read the counts.
    """
    if unique and max_features <= MAX_BROADCAST_ROWS:
        vectors, terms = tfidf_vectors(df.select(key, tokens), key, tokens, max_features, "_tfidf", unique=True)
        v = F.unwrap_udt("_tfidf")
        rows = vectors.select(key, F.inline(F.arrays_zip(v["indices"].alias("_i"), v["values"].alias("weight"))))
        names = df.sparkSession.createDataFrame(list(enumerate(terms)), "_i int, term string")
        return rows.join(F.broadcast(names), "_i").select(key, "term", "weight")
    # a null term in every document counts the documents
    grams = F.concat(ngrams(tokens), F.array(F.lit(None).cast("string")))
    each = df.select(key, F.explode_outer(F.coalesce(grams, F.array(F.lit(None).cast("string")))).alias("term"))
    found = written(each.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")))
    n_docs = found.filter("term is null").agg(F.sum("tf")).first()[0] or 0
    counts = found.filter("term is not null")
    top = vocabulary(counts, max_features)
    if max_features <= MAX_BROADCAST_ROWS:
        top = F.broadcast(top)
    raw = counts.join(top.drop("n"), "term").withColumn("_w", F.col("tf") * smooth_idf("df", F.lit(n_docs)))
    # at most max_features rows per document
    terms = raw.groupBy(key).agg(
        F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"), F.collect_list(F.struct("term", "_w")).alias("_terms")
    )
    return terms.select(key, "_norm", F.inline("_terms")).select(key, "term", (F.col("_w") / F.col("_norm")).alias("weight"))


def tfidf_vectors(df: DataFrame, key: str, tokens: str, max_features: int = 2000, out: str = "tfidf", unique: bool = False):
    """(frame with a sparse vector column, terms in column order). The vocabulary alone is read by the driver.

    `unique` says that a key has one row, as for `term_totals`.
    """
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    top = most_frequent(term_totals(df, key, tokens, unique=unique), max_features)
    n_docs = df.count()
    rows = top.select("term", smooth_idf("df", F.lit(n_docs)).alias("idf")).orderBy("term").collect()
    terms = [r["term"] for r in rows]
    grams = df.withColumn("_grams", ngrams(tokens))
    counted = CountVectorizerModel.from_vocabulary(terms, inputCol="_grams", outputCol="_counts").transform(grams)
    scaled = ElementwiseProduct(
        scalingVec=Vectors.dense([r["idf"] for r in rows]), inputCol="_counts", outputCol="_raw"
    ).transform(counted)
    done = Normalizer(p=2.0, inputCol="_raw", outputCol=out).transform(scaled)
    return done.drop("_grams", "_counts", "_raw"), terms


def embed_attach(df: DataFrame, embeddings: DataFrame, key: str, vector: str = "embedding", size: int = 768,
                 prefix: str = "emb_", widen: bool = True) -> DataFrame:
    """Join dense vectors by key; `widen` gives one column per dimension."""
    joined = df.join(embeddings.select(key, vector), key)
    if not widen:
        return joined
    return joined.select(*df.columns, *[F.col(vector)[i].cast("double").alias(f"{prefix}{i}") for i in range(size)])


def batch_embed(
    df: DataFrame, text: str, make_predictor: Callable[[], Callable], size: int, batch_size: int = 32,
    out: str = "embedding", by_length: bool = True,
) -> DataFrame:
    """Embed texts in Arrow batches with a caller's model.

    `make_predictor` runs once per Python worker and returns a function from an array of texts to a
    (batch, size) float array. With `by_length` the texts of a partition come in the order of their number of words, so a
    batch holds texts of like length and a model pads little; rows stay in their partition.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    udf = predict_batch_udf(make_predictor, return_type=ArrayType(FloatType()), batch_size=batch_size)
    if by_length:
        df = df.sortWithinPartitions(word_count(text))
    return df.withColumn(out, udf(F.coalesce(F.col(text), F.lit(""))))


def hashed_embedding(text, size: int = 64) -> Column:
    """A stand-in model in built-in functions: for each slot the sum of the signs of the words that fall there, over all words.

    A word falls in the slot that its 32-bit hash names, with the sign of the hash's 17th bit. Texts without words give zeros.
    """
    tokens = F.filter(F.split(F.lower(F.coalesce(as_col(text), F.lit(""))), r"\s+"), lambda t: t != "")

    def mark(token: Column) -> Column:
        code = hash32(token)
        sign = F.when(F.floor(code / 65536) % 2 == 1, 1.0).otherwise(-1.0)
        return F.struct((code % size).cast("int").alias("slot"), sign.alias("sign"))

    def add(total: Column, m: Column) -> Column:
        slots = F.transform(total["sums"], lambda v, i: v + F.when(i == m["slot"], m["sign"]).otherwise(0.0))
        return F.struct(slots.alias("sums"), (total["n"] + 1).alias("n"))

    start = F.struct(F.array_repeat(F.lit(0.0), size).alias("sums"), F.lit(0).alias("n"))
    return F.aggregate(
        F.transform(tokens, mark), start, add, lambda t: F.transform(t["sums"], lambda v: v / F.greatest(t["n"], F.lit(1)))
    )


def hashing_predictor(size: int = 64) -> Callable[[], Callable]:
    """A deterministic stand-in model for `batch_embed`: mean of signed token hashes over all tokens of a text."""

    def make():
        import zlib

        import numpy as np

        def predict(texts):
            tokens = [str(t).lower().split() for t in texts]
            sizes = np.array([len(t) for t in tokens])
            codes = np.fromiter((zlib.crc32(t.encode()) for row in tokens for t in row), np.int64, int(sizes.sum()))
            sign = np.where((codes >> 16) & 1, 1.0, -1.0)
            place = np.repeat(np.arange(len(tokens)), sizes) * size + codes % size
            rows = np.bincount(place, weights=sign, minlength=len(tokens) * size).reshape(-1, size)
            return (rows / np.maximum(sizes, 1)[:, None]).astype(np.float32)

        return predict

    return make


def fuse_datasets(
    df: DataFrame, key: str, label: str, structured: Iterable[str], tfidf: DataFrame, embeddings: DataFrame,
    tfidf_col: str = "tfidf", embedding_col: str = "embedding", keep: Iterable[str] | None = None,
) -> dict[str, DataFrame]:
    """Three modelling tables (key, label, features): structured with TF-IDF, with embeddings, with both.

    Blocks stay vectors and are aligned on the key once, in a written table; `keep` cuts the structured block to a list.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    structured = ordered_unique(structured)
    if keep is not None:
        wanted = set(keep)
        structured = [c for c in structured if c in wanted]
    dense = embeddings.select(key, array_to_vector(F.col(embedding_col).cast("array<double>")).alias("_emb"))
    wide = df.select(key, label, *structured).join(tfidf.select(key, F.col(tfidf_col).alias("_tfidf")), key).join(dense, key)
    wide = written(wide)
    blocks = {"tfidf": ["_tfidf"], "embedding": ["_emb"], "both": ["_tfidf", "_emb"]}
    return {
        name: VectorAssembler(inputCols=[*structured, *cols], outputCol="features", handleInvalid="error")
        .transform(wide).select(key, label, "features")
        for name, cols in blocks.items()
    }


# What may stand before and after a token in a feature's name.
TOKEN_START, TOKEN_END = r"(?:^|__|\b)", r"(?:\b|$)"


def feature_token_match(features: DataFrame, name: str, tokens: Iterable[str]) -> DataFrame:
    """(token, feature): whole-word matches, else equal names, else names that contain the token."""
    specs = F.array(*[
        F.struct(F.lit(t.lower()).alias("token"), F.lit(rf"(?U){TOKEN_START}\Q{t.lower()}\E{TOKEN_END}").alias("pattern"))
        for t in tokens
    ])
    low = F.lower(F.col(name))
    rows = features.select(F.col(name).alias("feature"), low.alias("_low"), F.explode(specs).alias("s"))
    level = (
        F.when(F.expr("_low rlike s.pattern"), 1).when(F.col("_low") == F.col("s.token"), 2)
        .when(F.contains(F.col("_low"), F.col("s.token")), 3)
    )
    found = rows.select(F.col("s.token").alias("token"), "feature", level.alias("_level")).filter("_level is not null")
    best = found.groupBy("token").agg(F.min("_level").alias("_level"))  # one row per requested token
    return found.join(F.broadcast(best), ["token", "_level"]).select("token", "feature")


def snippet(text, token: str, window: int = 60) -> Column:
    """Text around the first hit (any case), every hit in it shown as [TOKEN]; empty if there is none."""
    t = F.coalesce(as_col(text), F.lit(""))
    at = F.locate(token.lower(), F.lower(t)) - 1
    start = F.greatest(at - window, F.lit(0))
    length = at + len(token) + window - start
    cut = F.substring(t, start + 1, length)
    shown = "[" + re.sub(r"([\\$])", r"\\\1", token.upper()) + "]"
    return F.when(at < 0, F.lit("")).otherwise(F.regexp_replace(cut, rf"(?iu)\Q{token}\E", shown))


def presence_stats(df: DataFrame, present: Column, label: str, coef_sum: float | None = None) -> DataFrame:
    """Rows with and without a token, the positive rate of each, and the sign of its coefficients."""
    y, here = F.col(label), F.coalesce(present, F.lit(False))
    sign = None if coef_sum is None else "positive" if coef_sum > 0 else "negative" if coef_sum < 0 else "zero"
    return df.agg(
        F.count(F.when(here, 1)).alias("n_present"), F.count(F.when(~here, 1)).alias("n_absent"),
        F.avg(F.when(here, y)).alias("rate_present"), F.avg(F.when(~here, y)).alias("rate_absent"),
    ).withColumn("coef_sign", F.lit(sign).cast("string"))
