"""The paths taken for hot keys and large inputs must give the same results as the plain ones."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.functions import ordering as O
from stayline.functions.hashing import hash32
from stayline.operators import aggregates as A
from stayline.operators import joins as J
from stayline.operators import measures as M
from stayline.operators import windows as W
from stayline.operators import smote as SM
from stayline.operators.smote import nearest_neighbors, smote
from stayline.plans import cohort as CO
from stayline.plans import labels as L


def hot_stays(spark, n=400):
    """A third of the rows belong to one person."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 17 + 1).alias("subject_id"), F.col("id").alias("hadm_id"),
        F.timestamp_seconds((F.col("id") * 7919 % 97) * 86400).alias("admittime"),
        F.timestamp_seconds((F.col("id") * 7919 % 97) * 86400 + (F.col("id") % 5) * 40000).alias("dischtime"),
        F.when(F.col("id") % 4 == 0, "ELECTIVE").otherwise("URGENT").alias("admission_type"))


@pytest.mark.parametrize("label", [L.label_lead, L.label_fractional])
def test_hot_key_labels_agree(spark, label):
    df = hot_stays(spark)
    assert sorted(label(df, threshold=10).collect()) == sorted(label(df).collect())


def test_hot_key_any_unplanned_agrees(spark):
    df = hot_stays(spark)
    plain, split = L.label_any_unplanned(df, df), L.label_any_unplanned(df, df, threshold=10)
    key = lambda r: r["hadm_id"]
    assert sorted(plain.collect(), key=key) == sorted(split.collect(), key=key)
    stays = {r["hadm_id"]: r for r in df.collect()}
    for r in split.collect():
        later = [s for s in stays.values() if s["subject_id"] == r["subject_id"] and s["admittime"] > r["dischtime"]
                 and (s["admittime"] - r["dischtime"]).days <= 30 and s["admission_type"] != "ELECTIVE"]
        first = min(later, key=lambda s: (s["admittime"], s["hadm_id"]), default=None)
        assert r["next_hadm_id"] == (first["hadm_id"] if first else None)


def test_hot_key_split_has_bounded_groups(spark):
    df = hot_stays(spark, 3000)
    parts = O.split_hot(df, "subject_id", F.col("hadm_id"), threshold=100).groupBy("subject_id", "_part").count()
    hot = parts.filter("subject_id = 0")
    assert hot.count() > 5 and hot.agg(F.max("count")).first()[0] < 300


def test_hot_null_key_and_equal_times_are_split(spark):
    df = spark.range(2000).select(
        F.lit(None).cast("long").alias("subject_id"), F.col("id").alias("hadm_id"),
        F.timestamp_seconds(F.lit(0)).alias("admittime"))
    groups = O.split_hot(df, "subject_id", ["admittime", "hadm_id"], threshold=100).groupBy("_part").count()
    assert groups.agg(F.sum("count")).first()[0] == 2000
    assert groups.count() > 10 and groups.agg(F.max("count")).first()[0] < 300
    found = W.lead_next(df, threshold=100).orderBy("hadm_id").collect()
    assert [r["next_hadm_id"] for r in found] == [*range(1, 2000), None]


def test_merged_text_parts_join_to_the_whole(spark):
    df = spark.range(200).select(F.lit(1).alias("k"), F.col("id").alias("note_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    whole = A.merge_texts(df, "k", order=["note_id"], separator="|").first()["text"]
    args = dict(order=["note_id"], separator="|", split=True, max_chars=50)
    pieces = [r["text"] for r in A.text_parts(df, "k", **args).orderBy("part").collect()]
    assert len(pieces) > 5 and "|".join(pieces) == whole
    rows = A.merge_texts(df, "k", **args).collect()
    assert [(r["k"], r["note_id"], r["text"]) for r in rows] == [(1, 0, whole)]
    with pytest.raises(Exception, match="max_cell"):
        A.merge_texts(df, "k", max_cell=100, **args).collect()


def test_collected_structs_parts_are_whole(spark):
    df = spark.range(500).select(F.lit(7).alias("k"), F.col("id").alias("row"), (F.col("id") % 11).cast("string").alias("code"))
    one = A.collect_structs(df, "k", ["code"], "codes").collect()
    assert len(one) == 1 and one[0]["n_codes"] == 500
    assert [x["code"] for x in one[0]["codes"]] == sorted(str(i % 11) for i in range(500))
    with pytest.raises(Exception, match="max_cell"):
        A.collect_structs(df, "k", ["code"], "codes", max_cell=499).collect()


def test_running_totals(spark):
    rng = np.random.default_rng(0)
    values = sorted(set(rng.normal(size=500).tolist()))
    df = spark.createDataFrame([(g, v, i) for g in "ab" for i, v in enumerate(values)], "g string, v double, n long").repartition(5)
    for descending in (False, True):
        got = O.running_totals(df, "v", {"cum": F.col("n")}, by="g", descending=descending, parts=16)
        order = list(reversed(values)) if descending else values
        number = {v: i for i, v in enumerate(values)}
        want = dict(zip(order, np.cumsum([number[v] for v in order]).tolist()))
        assert all(want[r["v"]] == r["cum"] for r in got.collect()) and got.count() == 2 * len(values)


def test_rank_by_hash(spark):
    df = spark.range(1000).withColumn("c", F.col("id") % 2).withColumn("h", hash32("id")).repartition(6)
    got = O.dense_rank_by_hash(df, "h", "id", "rk", by="c", bits=5).collect()
    for c in (0, 1):
        mine = sorted((r["h"], r["id"]) for r in got if r["c"] == c)
        assert [r["rk"] for r in sorted((r for r in got if r["c"] == c), key=lambda r: (r["h"], r["id"]))] == list(range(1, len(mine) + 1))


@pytest.mark.parametrize("small", [10, 50_000])
def test_exact_quantiles(spark, small):
    rng = np.random.default_rng(1)
    data = {"normal": rng.normal(size=3001), "ties": rng.integers(0, 4, size=3001).astype(float), "same": np.zeros(3001),
            "tail": np.exp(rng.normal(size=3001) * 3)}
    rows = list(zip(*[d.tolist() for d in data.values()]))
    df = spark.createDataFrame(rows + [(None, None, None, float("nan"))], "normal double, ties double, same double, tail double").repartition(6)
    probs = [0.0, 0.1, 0.25, 0.5, 0.8, 1.0]
    got = O.exact_quantiles(df, list(data), probs, accuracy=200, small=small)
    for name, values in data.items():
        assert got[name] == pytest.approx(np.quantile(values, probs).tolist(), rel=1e-12, abs=1e-12)
    assert O.exact_quantiles(df.filter("1 = 0"), ["normal"], [0.5]) == {"normal": [None]}


@pytest.mark.parametrize("cell_rows", [16, 1000])
def test_nearest_neighbors_against_brute_force(spark, cell_rows):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(200, 3))
    points[:60] = points[0]  # a third are copies of one row
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>")
    got = {r["key"]: [(p["neighbor"]) for p in r["near"]] for r in nearest_neighbors(df, "id", "v", 4, cell_rows).collect()}
    for i in range(len(points)):
        dist = np.sqrt(((points - points[i]) ** 2).sum(axis=1))
        dist[i] = np.inf
        assert got[i] == np.lexsort((np.arange(len(points)), dist))[:4].tolist()


def test_smote_lies_between_neighbours(spark):
    rows = [(i, 0, [float(i), 0.0]) for i in range(40)] + [(100 + i, 1, [float(i), 10.0]) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, y int, v array<double>")
    out = smote(df, "id", "y", "v", ratio=0.5, k=5)
    new = out.filter("draw is not null").collect()
    assert len(new) == 17 and out.count() == 60
    assert all(r["id"] is None and r["v"][1] == 10.0 and 0.0 <= r["v"][0] <= 2.0 for r in new)
    assert sorted(map(str, smote(df.repartition(5), "id", "y", "v").collect())) == sorted(map(str, smote(df, "id", "y", "v").collect()))
    with pytest.raises(ValueError):
        smote(df.filter("id < 101"), "id", "y", "v")


def test_latest_row(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 5, "c")], "k long, t long, v string")
    assert sorted(r["v"] for r in W.latest_row(df, ["k"], ["t"]).collect()) == ["b", "c"]


def test_quantiles_survive_a_poor_sketch(spark, monkeypatch):
    df = spark.createDataFrame([(float(i),) for i in range(1000)], "v double")
    real = O._confirm
    off = {"shift": 300.0}

    def shifted(data, searches, cuts, small):
        moved = [(lo + off["shift"], hi + off["shift"]) for lo, hi in cuts]
        off["shift"] = 0.0
        return real(data, searches, moved, small)

    monkeypatch.setattr(O, "_confirm", shifted)
    assert O.exact_quantiles(df, ["v"], [0.25, 0.5], accuracy=100, small=10) == {"v": [249.75, 499.5]}


def clustered(spark, n, seed=5, dims=64, rows=50):
    """Clusters of about `rows` rows in 64 dimensions, so more rows are more clusters."""
    r = np.random.default_rng(seed)
    centres = r.normal(0, 10, (n // rows, dims))
    points = centres[np.arange(n) % len(centres)] + r.normal(0, 0.3, (n, dims))
    points[n // 2 : n // 2 + 5] = points[0]  # copies
    return points, spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, v array<double>")


def test_neighbours_in_many_dimensions_are_exact_and_few_rows_are_visited(spark, monkeypatch):
    share = {}
    for n in (1000, 4000):
        points, df = clustered(spark, n)
        seen = []
        plain = SM._visits
        monkeypatch.setattr(SM, "_visits", lambda v, m, k, c: seen.append((v, m)) or plain(v, m, k, c))
        got = {r["key"]: [p["neighbor"] for p in r["near"]] for r in nearest_neighbors(df, "id", "v", 5, 100).collect()}
        monkeypatch.setattr(SM, "_visits", plain)
        for i in range(0, n, 97):
            dist = np.sqrt(((points - points[i]) ** 2).sum(axis=1))
            dist[i] = np.inf
            assert got[i] == np.lexsort((np.arange(n), dist))[:5].tolist()
        visits, members = seen[1]
        sizes = members.groupBy("cell", "slot").count()
        share[n] = visits.join(sizes, ["cell", "slot"]).agg(F.sum("count")).first()[0] / n
    # rows looked at per query: four times the data, hardly more of them
    assert share[4000] < 2 * share[1000] and share[4000] < 4000 / 5, share


def test_neighbours_of_few_or_equal_rows(spark):
    same = spark.range(300).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    got = {r["key"]: [p["neighbor"] for p in r["near"]] for r in nearest_neighbors(same, "id", "v", 3, 40).collect()}
    assert got[0] == [1, 2, 3] and got[1] == [0, 2, 3] and got[299] == [0, 1, 2] and len(got) == 300
    two = nearest_neighbors(same.filter("id < 2"), "id", "v", 5).collect()
    assert {r["key"]: [p["neighbor"] for p in r["near"]] for r in two} == {0: [1], 1: [0]}
    assert nearest_neighbors(same.limit(0), "id", "v").count() == 0


def shuffles(spark, job):
    """How many stages and jobs it took, by the tracker."""
    tracker, group = spark.sparkContext.statusTracker(), f"count-{uuid.uuid4()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        job()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(group)), len(tracker.getJobIdsForGroup(group))


def test_tables_without_hot_keys_are_scanned_once(spark, monkeypatch):
    df = hot_stays(spark, 777)
    assert shuffles(spark, lambda: O.hot_edges(df, "subject_id", "hadm_id"))[0] in (2, 3)  # one scan and its total, which AQE may list twice
    assert shuffles(spark, lambda: O.hot_edges(df, "subject_id", "hadm_id")) == (0, 0)  # remembered
    assert O.hot_edges(hot_stays(spark, 777), ["subject_id"], "admittime") is None
    found = O.hot_edges(df, "subject_id", "hadm_id", threshold=200)
    assert [r["subject_id"] for r in found.collect()] == [0]
    monkeypatch.setattr(O, "SUSPECTS", 1)  # the list of suspects is full: every key is counted
    assert [r["subject_id"] for r in O.hot_edges(df, "subject_id", "hadm_id", threshold=150).collect()] == [0]
    none = df.withColumn("subject_id", F.lit(None).cast("long"))
    assert [r["subject_id"] for r in O.hot_edges(none, "subject_id", "hadm_id", threshold=200).collect()] == [None]
    assert O.hot_edges(df.limit(0), "subject_id", "hadm_id", threshold=1) is None
    heavy = O.hot_edges(df, "subject_id", "hadm_id", weight=F.col("hadm_id"), threshold=100_000)
    assert [r["subject_id"] for r in heavy.collect()] == [0]


def test_terms_counted_in_place(spark, monkeypatch):
    """Totals by row equal those by (key, term), also for words that look like pairs, and no key is shuffled."""
    from stayline.operators import text as TX

    rows = [(1, ["aa", "bb", "a", "aa", "bb"]), (2, ["aa bb", "aa", "bb"]), (3, []), (4, None), (None, ["cc", None, "cc"]), (6, ["x"])]
    df = spark.createDataFrame(rows, "id long, g array<string>").coalesce(1)
    for bigrams in (True, False):
        want = {tuple(r) for r in TX.term_totals(df, "id", "g", bigrams).collect()}
        assert want and {tuple(r) for r in TX.term_totals(df, "id", "g", bigrams, unique=True).collect()} == want
    monkeypatch.setattr(TX, "BATCH_TOKENS", 3)
    few = TX.term_totals(df.repartition(2), "id", "g", unique=True)
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in TX.term_totals(df, "id", "g").collect()}
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" in plan and "hashpartitioning(id" not in plan
    full = df.filter("size(g) > 0")
    want = {(r["id"], r["term"]): round(r["weight"], 9) for r in TX.tfidf_long(full, "id", "g", 4).collect()}
    assert {(r["id"], r["term"]): round(r["weight"], 9) for r in TX.tfidf_long(full, "id", "g", 4, unique=True).collect()} == want


def test_lemmas_in_place(spark):
    """Keys with several rows and null keys are merged by position, other rows stay where they are."""
    from stayline.operators import text as TX

    rows = [(1, "cats see dogs"), (2, "b cats"), (2, "a x9"), (None, "dogs"), (None, "cats"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "id long, t string")
    dictionary = spark.createDataFrame([("cats", "Cat"), ("dogs", None), (None, "no")], "token string, lemma string")
    out = {r["id"]: r["lemmas"] for r in TX.lemma_normalize(df, "id", "t", dictionary, stop=["see"]).collect()}
    assert out == {1: ["cat", "dogs"], 2: ["a", "b", "cat"], None: ["cat", "dogs"], 3: [], 4: []}
    twice = dictionary.unionByName(spark.createDataFrame([("cats", "tom")], "token string, lemma string"))
    again = {r["id"]: r["lemmas"] for r in TX.lemma_normalize(df, "id", "t", twice, stop=["see"]).collect()}
    assert again[1] == ["cat", "tom", "dogs"]
    single = TX.lemma_normalize(df.filter("id in (1, 3, 4)"), "id", "t", dictionary)
    assert "Generate" not in single._jdf.queryExecution().executedPlan().toString()


def test_neighbours_without_clusters_move_few_copies(spark, monkeypatch):
    """Where every cell is visited, a row is moved once per block, not once per cell."""
    points = np.random.default_rng(3).normal(0, 1, (2000, 32))
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, v array<double>")
    seen, plain = [], SM._visits
    monkeypatch.setattr(SM, "_visits", lambda v, m, k, c: seen.append(v) or plain(v, m, k, c))
    got = {r["key"]: [p["neighbor"] for p in r["near"]] for r in nearest_neighbors(df, "id", "v", 5, 50).collect()}
    for i in range(0, 2000, 301):
        dist = np.sqrt(((points - points[i]) ** 2).sum(axis=1))
        dist[i] = np.inf
        assert got[i] == np.lexsort((np.arange(2000), dist))[:5].tolist()
    assert seen[1].count() <= 2000 * 9


def test_stays_of_a_cut_are_found_by_their_ids(spark):
    from stayline.functions.hashing import hash32
    from stayline.plans import cohort as CO

    base = spark.range(60).selectExpr("id % 7 AS subject_id", "id AS hadm_id")
    base = base.unionByName(base.filter("hadm_id < 5"))  # stays may repeat
    notes = spark.range(100).selectExpr("id % 50 % 7 AS subject_id", "id % 50 AS hadm_id", "CASE WHEN id % 9 > 0 THEN 'x' ELSE ' ' END AS text")
    units = spark.range(90).selectExpr("id % 30 AS hadm_id", "id * 10 AS stay_id")
    unit = {}
    for r in units.collect():
        unit.setdefault(r["hadm_id"], []).append(str(r["stay_id"]))
    noted = {(r["subject_id"], r["hadm_id"]) for r in notes.filter("text = 'x'").collect()}
    grains = [(g, r["hadm_id"]) for r in base.collect() if tuple(r) in noted for g in unit.get(r["hadm_id"], [f"HADM_{r['hadm_id']}"])]
    codes = {r["g"]: r["h"] for r in spark.createDataFrame([(g,) for g, _ in grains], "g string").select("g", hash32("g").alias("h")).collect()}
    want = {h for _, _, h in sorted((codes[g], g, h) for g, h in grains)[:10]}
    got = [r["hadm_id"] for r in CO._stays_within(base, notes, units, 10).collect()]
    assert sorted(got) == sorted(want)


def test_many_rows_are_dealt_into_tasks_of_bounded_rows(spark):
    df = spark.range(3000).select((F.col("id") % 700).alias("k"), "id")
    assert J.dealt(df, "k", 3000, per_task=1500) is df
    many = J.dealt(df, "k", 3000, per_task=100)
    assert many.rdd.getNumPartitions() == 30
    tasks = many.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("k").alias("k"), F.count("*").alias("n"))
    assert tasks.agg(F.sum("k"), F.sum("n")).first() == (700, 3000)  # a key is in one task
    wide = M.mean_pivot(many.withColumn("label", F.lit("Heart Rate")), key="k", value="id")
    assert wide.rdd.getNumPartitions() == 30  # the pivot needs no other shuffle


def test_weights_without_a_heavy_key_are_added_up_once(spark):
    df = spark.range(4000).select((F.col("id") % 40).alias("k"), "id", F.lit(10).alias("w"))
    check = lambda: O.hot_edges(df, "k", "id", weight=F.col("w"), threshold=2000)  # noqa: E731  # 40,000 in all, 1000 a key
    assert check() is None
    assert shuffles(spark, check) == (0, 0)  # remembered, though the whole is above the threshold


def cohort_tables(spark):
    at = lambda c: F.to_timestamp_ntz(F.date_add(F.lit("2020-01-01").cast("date"), c.cast("int")))
    n = spark.range(60)
    stays = n.select(
        (F.col("id") % 20).alias("subject_id"), F.col("id").alias("hadm_id"), at(F.col("id")).alias("admittime"), at(F.col("id") + 3).alias("dischtime"),
        F.when(F.col("id") % 15 == 5, at(F.col("id"))).alias("deathtime"), F.lit("URGENT").alias("admission_type"))
    notes = n.filter("id % 4 = 0").select(
        # some notes are blank, some name another person
        (F.col("id") % 20 + F.when(F.col("id") == 8, 1).otherwise(0)).alias("subject_id"), F.col("id").alias("hadm_id"), F.col("id").alias("note_id"),
        F.when(F.col("id") == 12, "  ").otherwise("a note").alias("text"), at(F.col("id")).alias("charttime"), at(F.col("id")).alias("storetime"))
    codes = n.crossJoin(spark.range(2).toDF("j")).select(
        F.col("id").alias("hadm_id"), F.when(F.col("j") == 0, "I50.9").otherwise("Z00").alias("icd_code"), F.lit(10).alias("icd_version"))
    labs = n.select("id", F.col("id").alias("hadm_id"), F.lit(1).alias("itemid"), at(F.col("id")).alias("charttime"), F.col("id").cast("double").alias("valuenum"))
    units = n.filter("id % 3 < 2").select(F.col("id").alias("hadm_id"), (F.col("id") * 10).alias("stay_id"), at(F.col("id")).alias("intime"), at(F.col("id") + 1).alias("outtime"))
    vitals = n.crossJoin(spark.range(3).toDF("j")).select(
        (F.col("id") * 10).alias("stay_id"), F.lit(1).cast("long").alias("itemid"), F.when(F.col("j") < 2, F.col("id") + F.col("j")).cast("double").alias("valuenum"))
    return {
        "admissions": stays, "patients": spark.range(20).select(F.col("id").alias("subject_id"), F.lit(None).cast("date").alias("dod")), "notes": notes,
        "diagnoses": codes, "procedures": codes, "labs": labs.withColumnRenamed("id", "event_id"), "unit_stays": units, "vitals": vitals,
        "lab_items": spark.createDataFrame([(1, "Sodium")], "itemid int, label string"),
        "vital_items": spark.createDataFrame([(1, "Heart Rate", "chartevents")], "itemid long, label string, linksto string"),
    }


def test_whole_cohort_builds_only_stays_with_a_note(spark, monkeypatch):
    tables = cohort_tables(spark)
    seen = []
    counts = A.code_counts
    monkeypatch.setattr(CO.A, "code_counts", lambda df, **k: seen.append(df.select("hadm_id").distinct().count()) or counts(df, **k))
    few = CO.cohort_admission(tables)
    got = sorted(map(str, few.collect()))
    noted = {r["hadm_id"] for r in few.collect()}
    assert noted == {i for i in range(0, 60, 4) if i not in (8, 12) and i % 15 != 5}
    assert seen == [len(noted)] * 2
    assert {r["hadm_id"]: r["hr_mean"] for r in few.collect() if r["icu_stay_id"] is not None} == {i: i + 0.5 for i in noted if i % 3 < 2}
    monkeypatch.setattr(CO, "STAY_IDS", 3)  # too many to be broadcast: every stay is built, with the same rows
    assert sorted(map(str, CO.cohort_admission(tables).collect())) == got
    assert seen[2:] == [60, 60]
