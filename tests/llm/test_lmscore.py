"""Language-model scores against a direct computation that leaves each document out."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.llm import lmscore
from stayline.llm.queries import table
from tests.llm.test_operators import frame

SF = "/root/testdata/sf0.01"


def direct(texts, targets):
    """(target loss, background loss) of every text; `targets` are the places of target texts."""
    words = [(t or "").lower().split() for t in texts]
    every = [targets, range(len(texts))]
    one = [Counter(w for i in use for w in words[i]) for use in every]
    two = [Counter(p for i in use for p in zip(words[i], words[i][1:])) for use in every]
    known = {w for w, n in one[1].items() if n >= lmscore.MIN_COUNT}
    out = []
    for i, text in enumerate(words):
        losses = []
        for side in (0, 1):
            own = Counter(text) if side or i in targets else Counter()
            own_two = Counter(zip(text, text[1:])) if side or i in targets else Counter()
            n, scale = sum(one[side].values()) - sum(own.values()), sum(one[0].values()) / sum(one[1].values()) if side else 1.0
            unknown = sum(c - own[w] for w, c in one[side].items() if w not in known) * scale
            total = 0.0
            for j, w in enumerate(text):
                p = (((one[side][w] - own[w]) * scale if w in known else unknown) + lmscore.FLOOR) / (n * scale + lmscore.FLOOR * (len(known) + 1))
                if j and w in known and text[j - 1] in known:
                    h = text[j - 1]
                    p = ((two[side][h, w] - own_two[h, w]) * scale + lmscore.PRIOR * p) / ((one[side][h] - own[h]) * scale + lmscore.PRIOR)
                total -= np.log(p)
            losses.append(total / len(text) if text else 0.0)
        out.append((len(text), *losses))
    return out


def sample(n=120, seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.choices(vocabulary, [1 / (k + 1) for k in range(40)], k=r.randrange(0, 60))) for _ in range(n)]
    return texts + ["", None, "a b a b c", "a b a b c", "Once Once", "W1 w1 W2", "x " * 700]


@pytest.mark.parametrize("chunk_bytes", [1, 500, 8_000_000])
def test_scores_leave_each_document_out(spark, chunk_bytes):
    texts = sample()
    targets = set(range(0, len(texts), 3))
    ids = spark.createDataFrame([(i,) for i in targets] * 2 + [(None,), (10_000,)], "doc_id long")
    got = lmscore.cross_entropy_difference(frame(spark, texts), ids, chunk_bytes=chunk_bytes).collect()
    want = direct(texts, targets)
    assert len(got) == len(texts)
    for row in got:
        n, aim, background = want[row["doc_id"]]
        assert row["n_words"] == n
        assert (row["target_loss"], row["background_loss"]) == pytest.approx((aim, background), abs=1e-9)
        assert row["score"] == pytest.approx(aim - background, abs=1e-9)


def test_odd_rows(spark):
    texts = sample(20)
    docs = frame(spark, texts)
    none = lmscore.cross_entropy_difference(docs, docs.limit(0)).collect()
    assert len(none) == len(texts) and {r["score"] for r in none} == {0.0}
    assert lmscore.cross_entropy_difference(docs.limit(0), docs).count() == 0
    nameless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert {r["score"] for r in lmscore.cross_entropy_difference(nameless, docs).collect()} == {0.0}
    twice = lmscore.cross_entropy_difference(docs.union(docs), docs.filter("doc_id = 1")).collect()
    assert Counter(r["doc_id"] for r in twice) == {i: 2 for i in range(len(texts))}


def test_rows_of_one_id_are_dealt_over_chunks(spark):
    docs = frame(spark, [f"a b c {i}" for i in range(200)]).withColumn("doc_id", F.lit(None).cast("long"))
    rows = docs.select(F.col("doc_id").alias("doc"), "text")
    assert lmscore.chunked(rows, 100).count() > 10


def test_packing():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 5000):
        for top in (1 << 20, 1 << 63):
            keys = np.unique(r.integers(0, top, n).astype(np.uint64))
            assert (lmscore.unpacked_keys(lmscore.packed_keys(keys)) == keys).all()
        counts = r.integers(0, 600, n)
        assert (lmscore.unpacked_counts(*lmscore.packed_counts(counts)) == counts).all()


def test_good_documents_score_alike_in_and_outside_the_target(spark):
    labels = table(spark, SF, "labels")
    good = labels.filter("quality = 1").select("doc_id")
    inside = good.filter("doc_id % 2 = 0")
    scores = lmscore.cross_entropy_difference(table(spark, SF, "documents"), inside).join(labels, "doc_id").filter("n_words > 20")
    means = scores.agg(
        F.avg(F.when((F.col("quality") == 1) & (F.col("doc_id") % 2 == 0), F.col("score"))).alias("a"),
        F.avg(F.when((F.col("quality") == 1) & (F.col("doc_id") % 2 == 1), F.col("score"))).alias("b"),
        F.avg(F.when(F.col("quality") == 0, F.col("score"))).alias("poor"),
    ).first()
    assert abs(means["a"] - means["b"]) < 0.5 and means["poor"] > max(means["a"], means["b"]) + 0.5, means
