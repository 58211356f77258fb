"""Homomorphic multiset fingerprints of documents.

A paragraph (text between line feeds) is hashed to a wide vector: WIDE numbers from the whole range of the modulus, and LANES
signs, +1 or -1, each a bit of a 64-bit hash with a seed of its own. The fingerprint is the sum of the vectors modulo 2^32: the
order of paragraphs doesn't matter, and adding or taking away a paragraph adds or subtracts its vector. Empty paragraphs say
nothing about likeness; they are counted in one number ahead of the lanes. Equal texts have equal fingerprints. The sums of the
wide numbers are spread evenly over all values, so two unlike multisets agree in them by chance with probability 2^-(32 WIDE), whatever their
sizes; the sums of the signs are small, and tell likeness.

The product of two texts' lanes, summed, estimates the product of their paragraph counts, so the cosine of the lanes
estimates that of the paragraph multisets: the share of common paragraphs where both have as many and none repeats. It is cut
off below 0, and its standard error is at most about 1 / sqrt(LANES), 0.06, at any length. Texts of one paragraph have 1 if
these are equal and otherwise only that error: likeness is by whole paragraphs.

Only DataFrame functions are used. Defined cases: null text counts as empty, which has one empty paragraph; texts without
other paragraphs have likeness 1 among themselves and 0 to others; repeated rows come out once each; null ids come after
all others in descending order; ties of ids are ordered by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.functions.ordering import quantile_edges, range_index
from stayline.llm.common import narrow, shuffle_parts

LANES = 256
WIDE = 16
POWER = 1 << 32
_PAIR = POWER + 1  # the lowest bit of both lanes of a number


def _signed(v: Column) -> Column:
    return F.when(v >= POWER >> 1, v - POWER).otherwise(v)


def vector(text: Column) -> Column:
    """The number of empty paragraphs, the sums of all signs and of the wide numbers, as array<bigint> of 1 + LANES + WIDE numbers."""
    low = F.lit(POWER - 1)
    parts = F.split(text, "\n", -1)
    filled = F.filter(parts, lambda p: p != "")
    words = F.transform(filled, lambda p: F.array(*[F.xxhash64(F.lit(w), p) for w in range(LANES // 64)]))

    def add(total: Column, word: Column) -> Column:
        bits = lambda i: F.call_function("shiftrightunsigned", word[F.floor(i / 32).cast("int")], i % 32).bitwiseAND(F.lit(_PAIR))
        return F.transform(total, lambda t, i: t + bits(i) * 2 - _PAIR)

    # two lanes travel in one number, whose low half is signed: a text has less than 2^30 such paragraphs
    sums = F.aggregate(words, F.array_repeat(F.lit(0).cast("long"), LANES // 2), add)
    lanes = F.transform(sums, lambda t: F.array(t, F.shiftright(t - _signed(t.bitwiseAND(low)), 32)))
    empty = F.size(F.filter(parts, lambda p: p == "")).cast("long")
    number = lambda p, i: F.xxhash64(F.lit(LANES // 64 + i), p).bitwiseAND(low)
    wide = F.aggregate(
        F.transform(filled, lambda p: F.array(*[number(p, i) for i in range(WIDE)])), F.array_repeat(F.lit(0).cast("long"), WIDE),
        lambda total, numbers: F.zip_with(total, numbers, lambda x, y: (x + y).bitwiseAND(low)),
    )
    return F.concat(F.array(empty), F.transform(F.flatten(lanes), lambda v: v.bitwiseAND(low)), wide)


def add_vectors(a: Column, b: Column) -> Column:
    """The fingerprint vector of two paragraph multisets together."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(POWER - 1)))


def take_vectors(a: Column, b: Column) -> Column:
    """The fingerprint vector of multiset a without the paragraphs of b."""
    return F.zip_with(a, b, lambda x, y: (x - y + POWER).bitwiseAND(F.lit(POWER - 1)))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda v: F.lpad(F.hex(v), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the lanes, 0 at least; where a vector has none, 1 if neither has any."""
    x, y = F.slice(a, 2, LANES), F.slice(b, 2, LANES)

    def product(v: Column, w: Column) -> Column:
        terms = F.zip_with(v, w, lambda p, q: _signed(p).cast("double") * _signed(q))
        return F.aggregate(terms, F.lit(0.0), lambda t, p: t + p)

    cosine = F.try_divide(F.greatest(product(x, y), F.lit(0.0)), F.sqrt(product(x, x) * product(y, y)))
    return F.coalesce(F.round(cosine, 12), (x == y).cast("double"))


def with_next(rows: DataFrame) -> DataFrame:
    """(doc, text, next): each row's next text in descending order of doc; after the last comes the first.

    Rows are dealt into ranges of ids. The first row of every range is sent to the range before it as
    well (the very first to the last range), so one shuffle of the texts and a window per range are enough.
    """
    parts = 1 << max(2, (4 * shuffle_parts(rows)).bit_length())
    ranged = rows.withColumn("range", range_index("doc", quantile_edges(rows, "doc", parts), parts))
    heads = ranged.groupBy("range").agg(F.max("doc").alias("head")).orderBy("range").collect()  # one row per range at most
    above = [r["range"] for r in heads[1:]] + [r["range"] for r in heads[:1]]
    table = rows.sparkSession.createDataFrame(
        [(r["head"], a) for r, a in zip(heads, above)] or [(0, -1)], "head long, above int"
    )
    sent = ranged.join(F.broadcast(table), F.col("doc") == F.col("head"), "left").withColumn(
        "to", F.when(F.col("above").isNull(), F.array("range")).otherwise(F.array("range", "above"))
    )
    dealt = sent.select("doc", "text", F.posexplode("to").alias("copy", "range"))
    order = Window.partitionBy("range").orderBy("copy", F.desc("doc"), "text")
    return dealt.withColumn("next", F.lead("text").over(order)).filter("copy = 0").select("doc", "text", "next")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the next document.
    """
    least = -(1 << 63)
    rows = narrow(docs, doc=id_col, text=text_col).select(
        F.coalesce(F.col("doc").cast("long"), F.lit(least)).alias("doc"), F.coalesce("text", F.lit("")).alias("text")
    )
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    pairs = with_next(rows).select(
        "doc", n.cast("long").alias("n_chars"), "text", "next",
        F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half)).alias("edited"),
    )
    vectors = pairs.select(
        "doc", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        vector(F.col("text")).alias("own"), vector(F.col("edited")).alias("changed"), vector(F.col("next")).alias("other"),
    )
    own, changed, other = F.col("own"), F.col("changed"), F.col("other")
    return vectors.select(
        F.when(F.col("doc") != least, F.col("doc")).alias("doc_id"), "n_chars", "edited_sha256",
        as_text(own).alias("fingerprint"), as_text(changed).alias("edited_fingerprint"),
        likeness(own, changed).alias("near_edited"), likeness(own, other).alias("near_next"),
    )
