"""Ranks, running totals and curves of many groups, bucketed joins, and vectors instead of long tables."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from stayline.functions import ordering as O
from stayline.functions.hashing import hash32
from stayline.operators import sampling as SA
from stayline.operators import text as TX
from stayline.operators.joins import left_chain
from stayline.plans import explain as EX
from stayline.plans import models as MO
from stayline.sources.tables import write_bucketed


def groups(spark, n=6000, k=900):
    """Rows of many groups, the null one holding a third."""
    return spark.range(n).select(
        "id", F.when(F.col("id") % 3 > 0, F.col("id") * 7919 % k).alias("g"), (F.col("id") * 104729 % 1009 / 1000.0).alias("v")
    )


@pytest.mark.parametrize("bits, rows", [(None, 500_000), (None, 200), (9, 0), (0, 0)])
def test_ranks_are_the_same_with_any_number_of_slices(spark, bits, rows):
    df = groups(spark).withColumn("h", hash32("id"))
    got = O.dense_rank_by_hash(df, "h", "id", "rk", by="g", bits=bits, slice_rows=rows or 1).collect()
    want = {}
    for r in df.collect():
        want.setdefault(r["g"], []).append((r["h"], r["id"]))
    places = {(g, i): n for g, rows_ in want.items() for n, (_, i) in enumerate(sorted(rows_), 1)}
    assert len(got) == 6000 and all(places[r["g"], r["id"]] == r["rk"] for r in got)


def test_folds_of_many_classes(spark):
    df = groups(spark)
    folds = SA.stratified_kfold(df, "id", "g", 3).groupBy("g", "fold").count().groupBy("g").agg(F.max("count").alias("a"), F.min("count").alias("b"), F.count("*").alias("n"))
    assert folds.filter("n = 3 and a - b > 1").isEmpty()


@pytest.mark.parametrize("most", [500_000, 100])
def test_running_totals_of_many_groups(spark, monkeypatch, most):
    monkeypatch.setattr(O, "TOTALS_ROWS", most)
    df = groups(spark).groupBy("g", "v").agg(F.count("*").alias("n"))
    got = O.running_totals(df, "v", {"cum": F.col("n")}, by="g", parts=16).collect()
    want, rows = {}, sorted(df.collect(), key=lambda r: (str(r["g"]), r["v"]))
    for r in rows:
        want[r["g"]] = want.get(r["g"], 0) + r["n"]
        want[r["g"], r["v"]] = want[r["g"]]
    assert len(got) == len(rows) and all(r["cum"] == want[r["g"], r["v"]] for r in got)


def test_metrics_of_many_groups(spark):
    df = groups(spark, 4000, 700).filter("g is not null").select("g", (F.col("id") % 4 == 0).cast("int").alias("y"), F.round("v", 1).alias("prob"))
    got = {r["g"]: r["ap"] for r in MO.fold_metrics(df, "g", "y").collect()}
    rows = {}
    for r in df.collect():
        rows.setdefault(r["g"], []).append((r["prob"], r["y"]))
    for g, points in rows.items():
        pos = sum(y for _, y in points)
        if not pos:
            assert g not in got
            continue
        ap = 0.0
        for t in sorted({p for p, _ in points}, reverse=True):
            tp, flagged = sum(y for p, y in points if p >= t), sum(1 for p, _ in points if p >= t)
            ap += tp / flagged * sum(y for p, y in points if p == t) / pos
        assert got[g] == pytest.approx(ap)


def test_class_sizes_come_as_one_row(spark):
    df = groups(spark)
    null_rows = df.filter("g is null").count()
    assert SA.minority_sizes(df, "g", minority=1) == (df.filter("g = 1").count(), null_rows)
    assert SA.minority_sizes(df, "g", minority=-1)[0] == 0 and SA.minority_sizes(df.limit(0), "g") == (0, 0)


def test_bucketed_features_are_joined_without_a_shuffle(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        base = spark.range(500).withColumnRenamed("id", "hadm_id")
        features = [base.filter(f"hadm_id % {k} = 0").withColumn(f"f{k}", F.col("hadm_id") * k) for k in (2, 3, 5, 7)]
        tables = [write_bucketed(df, "hadm_id", 4) for df in (base, *features)]
        wide = left_chain(tables[0], *[(t, "hadm_id") for t in tables[1:]])
        plan = wide._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        plain = left_chain(base, *[(df, "hadm_id") for df in features])
        assert sorted(wide.collect()) == sorted(plain.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_batches_hold_texts_of_like_length(spark):
    r = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, "w " * int(n)) for i, n in enumerate(r.integers(1, 400, 600))] + [(600, None)], "id long, text string").coalesce(1)

    def predictor():
        def predict(texts):
            longest = max(len(str(t).split()) for t in texts)
            return np.array([[longest, len(str(t).split())] for t in texts], dtype=np.float32)

        return predict

    waste = {}
    for by_length in (False, True):
        rows = TX.batch_embed(docs, "text", predictor, 2, batch_size=32, by_length=by_length).collect()
        assert len(rows) == 601
        waste[by_length] = sum(r["embedding"][0] - r["embedding"][1] for r in rows)
    assert waste[True] < 0.2 * waste[False]


def test_stand_in_models(spark):
    docs = spark.createDataFrame([("a b a",), ("",), (None,), ("A  B\na",)], "text string")
    rows = docs.select(TX.hashed_embedding("text", 8).alias("v")).collect()
    assert rows[0]["v"] == rows[3]["v"] and sum(abs(x) for x in rows[0]["v"]) == pytest.approx(1.0)
    assert rows[1]["v"] == rows[2]["v"] == [0.0] * 8
    predict = TX.hashing_predictor(8)()
    out = predict(np.array(["a b a", "", "A B a"], dtype=object))
    assert out.shape == (3, 8) and (out[0] == out[2]).all() and not out[1].any() and abs(out[0]).sum() == pytest.approx(1.0)


def test_importance_by_vectors_is_that_of_the_long_table(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(300, 12)) * (r.random((300, 12)) < 0.4)
    names, slopes, middle = [f"f{i}" for i in range(12)], r.normal(size=12).tolist(), x.mean(axis=0).tolist()
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, x array<double>").withColumn("v", array_to_vector("x"))
    long = {a["feature"]: a["importance"] for a in EX.global_importance(EX.linear_attribution(df, "id", "v", names, slopes, middle)).collect()}
    wide = {a["feature"]: a["importance"] for a in EX.vector_importance(df, "v", names, slopes, middle).collect()}
    assert wide == pytest.approx(long) and list(wide) == list(long)
    some = EX.chosen_attributions(df, "id", "v", names, slopes, middle, ["f3", "absent", "f1"])
    every = EX.linear_attribution(df, "id", "v", names, slopes, middle).filter("feature in ('f1', 'f3')")
    assert sorted((a["id"], a["feature"], round(a["phi"], 9)) for a in some.collect()) == sorted((a["id"], a["feature"], round(a["phi"], 9)) for a in every.collect())
    assert EX.chosen_attributions(df, "id", "v", names, slopes, middle, ["absent"]).count() == 0
    assert EX.vector_importance(df.limit(0), "v", names, slopes, middle).count() == 0
