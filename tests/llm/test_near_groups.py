"""Near duplicates on hot groups against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.llm import minhash
from stayline.llm.common import work_table
from tests.llm.test_operators import brute_groups, frame, near_copies


def hot_texts(seed=9):
    """A large group of copies with more or fewer edits, texts that share a passage, and two smaller groups."""
    r = random.Random(seed)
    base = [f"w{i}" for i in range(100)]
    out = []
    for _ in range(160):
        words = base[:]
        for _ in range(r.randrange(0, 7)):
            at = r.randrange(len(words))
            words[at : at + 1] = [[], [f"e{r.randrange(10**6)}"], [words[at], f"i{r.randrange(50)}"]][r.randrange(3)]
        out.append(" ".join(words))
    passage = " ".join(f"p{i}" for i in range(60))
    out += [passage + " " + " ".join(f"q{r.randrange(10**6)}" for _ in range(r.randrange(5, 40))) for _ in range(120)]
    for g in range(2):
        words = [f"g{g}x{i}" for i in range(60)]
        out += [" ".join(words[: 60 - r.randrange(0, 9)]) for _ in range(20)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("group_rows, group_shingles", [(2048, 1_000_000), (8, 600)])
def test_hot_groups_equal_brute_force(spark, group_rows, group_shingles):
    texts = hot_texts()
    got = minhash.near_groups(frame(spark, texts), words=4, group_rows=group_rows, group_shingles=group_shingles)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_groups(dict(enumerate(texts)), 4, 80)


def test_an_id_with_several_texts_is_linked_by_each(spark):
    a, b = "a b c d e f g h", "k l m n o p q r"
    docs = frame(spark, [a, b, a, b]).withColumn("doc_id", F.expr("element_at(array(1, 2, 2, 3), CAST(doc_id AS INT) + 1)").cast("long"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(minhash.near_groups(docs), ["doc_id", "text_hash"])
    assert sorted((r["doc_id"], r["text"][0], r["component_id"], r["kept"]) for r in rows.collect()) == [
        (1, "a", 1, True), (2, "a", 1, False), (2, "k", 2, True), (3, "k", 2, False)
    ]
    same = frame(spark, [a, b]).withColumn("doc_id", F.lit(7).cast("long"))
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_groups(same).collect()) == [(7, 7, True)] * 2


def test_live_prefixes_lose_no_pair(spark):
    """Two members with enough in common share a prefix shingle and are within each other's reach."""
    texts = hot_texts(4)
    sets = minhash.whole_sets(texts, 4)
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "node long, label long, text string")
    sizes = spark.createDataFrame([(i, len(x)) for i, x in enumerate(sets)], "node long, n long")
    found = minhash.live_prefixes(rows.select("node", "label"), sizes, rows.select("node", "text"), 4, 80).collect()
    keys, reach = {}, {}
    for r in found:
        keys.setdefault(r["node"], set()).add(r["key"])
        reach[r["node"]] = r["reach"]
    pairs = 0
    for i in range(len(texts)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if texts[i] != texts[j] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                assert keys[i] & keys[j] and len(sets[i]) <= reach[j] and len(sets[j]) <= reach[i]
                pairs += 1
    assert pairs > 100


def test_every_pair_of_a_group_meets_once_or_more(spark):
    rows = spark.range(300).selectExpr("id % 3 AS key", "id AS node", "IF(id % 5 < 3, 0, id) AS label")
    dealt = minhash.met(rows, F.lit(1), 16).collect()
    groups = {}
    for r in dealt:
        groups.setdefault((r["key"], r["block"], r["chunk"]), []).append(r)
    met = {(a["node"], b["node"]) for g in groups.values() for a in g if a["visitor"] for b in g if not b["visitor"]}
    label = {r["node"]: r["label"] for r in dealt}
    for i in range(300):
        for j in range(i):
            if i % 3 == j % 3 and label[i] != label[j]:
                assert (i, j) in met or (j, i) in met
    assert max(len(g) for g in groups.values()) < 100


def test_rectangular_counts():
    r = np.random.default_rng(2)
    sets = [[np.unique(r.integers(0, 9000, r.integers(0, 900)).astype(np.uint64)) for _ in range(n)] for n in (7, 11)]
    want = [[len(np.intersect1d(a, b)) for b in sets[1]] for a in sets[0]]
    assert (minhash.common_counts(*sets) == want).all()


def test_rows_meet_their_key_once_and_nodes_are_kept_once(spark, monkeypatch):
    rows = spark.range(6000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % 50).alias("key"), F.col("id").alias("node"))
    per_key = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("pivot")).filter("key < 40")
    expected = sorted(map(tuple, rows.join(per_key, "key").select("key", "node", "size", "pivot").collect()))
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", 10)  # too many keys to be broadcast, few hot ones
    for hot in (1000, 100_000):
        monkeypatch.setattr(minhash, "HOT_KEY", hot)
        got = minhash.with_key_values(rows, "key", per_key, size="size")
        assert sorted(map(tuple, got.select("key", "node", "size", "pivot").collect())) == expected
        assert "xxhash64" not in got._jdf.queryExecution().optimizedPlan().toString()  # no salt: rows are moved once
    single = minhash.one_per_node(spark.createDataFrame([(1, "a"), (2, "b")], "node long, text string"))
    assert "Deduplicate" not in single._jdf.queryExecution().analyzed().toString()
    repeated = minhash.one_per_node(spark.createDataFrame([(1, "a"), (2, "b"), (1, "a"), (3, "c")], "node long, text string"))
    assert sorted(map(tuple, repeated.collect())) == [(1, "a"), (2, "b"), (3, "c")]
