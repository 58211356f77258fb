"""Hand-made frames for the rules and edge cases of the operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stayline.functions import scalars as S
from stayline.operators import aggregates as A
from stayline.operators import binning as B
from stayline.operators import codes as C
from stayline.operators import filters as X
from stayline.operators import joins as J
from stayline.operators import measures as M
from stayline.operators import profile as P
from stayline.operators import sampling as SA
from stayline.operators import scaling as SC
from stayline.operators import text as TX
from stayline.plans import cohort as CO
from stayline.plans import labels as L
from stayline.sources import reference as R
from stayline.sources import tables as IO

D = dt.datetime


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_valid_stays(spark):
    df = spark.createDataFrame(
        [(1, D(2020, 1, 1), D(2020, 1, 2), None), (2, None, D(2020, 1, 2), None), (3, D(2020, 1, 1), None, None),
         (4, D(2020, 1, 1), D(2020, 1, 2), D(2020, 1, 2))],
        "hadm_id long, admittime timestamp, dischtime timestamp, deathtime timestamp")
    assert rows(X.valid_stays(df), "hadm_id") == [(1,)]


def test_death_window_borders(spark):
    end = D(2020, 1, 1, 13)
    stays = spark.createDataFrame([(i, end) for i in range(1, 7)], "subject_id long, dischtime timestamp")
    dods = {1: dt.date(2020, 1, 1), 2: dt.date(2020, 1, 31), 3: dt.date(2020, 2, 1), 4: None, 5: dt.date(2019, 12, 31)}
    people = spark.createDataFrame(list(dods.items()), "subject_id long, dod date")
    # on the day of discharge and on day 30 drop; day 31, no date, earlier date and unknown person stay
    assert rows(X.exclude_event_window(stays, people), "subject_id") == [(3,), (4,), (5,), (6,)]


def stays_frame(spark):
    end = D(2020, 3, 1)
    second = {1: end - dt.timedelta(hours=12), 2: end, 3: end + dt.timedelta(days=30, hours=23),
              4: end + dt.timedelta(days=31), 5: end + dt.timedelta(days=2), 6: end + dt.timedelta(days=2)}
    kind = {5: "ELECTIVE", 6: None}
    data = []
    for p, start in second.items():
        data.append((p, p * 10, D(2020, 2, 1), end, "URGENT"))
        data.append((p, p * 10 + 1, start, start + dt.timedelta(days=1), kind.get(p, "URGENT")))
    return spark.createDataFrame(data, "subject_id long, hadm_id long, admittime timestamp, dischtime timestamp, admission_type string")


def test_label_lead(spark):
    out = L.label_lead(stays_frame(spark)).filter("hadm_id % 10 = 0")
    got = {r["hadm_id"]: (r["days_to_next_admit"], r["readmit_30days"]) for r in out.collect()}
    assert got == {10: (0, 1), 20: (0, 1), 30: (30, 1), 40: (31, 0), 50: (2, 0), 60: (2, 0)}


def test_label_any_unplanned_needs_a_later_start(spark):
    df = stays_frame(spark)
    out = L.label_any_unplanned(df.filter("hadm_id % 10 = 0"), df)
    got = {r["hadm_id"]: (r["next_hadm_id"], r["readmit_30d_unplanned"]) for r in out.collect()}
    assert got == {10: (None, 0), 20: (None, 0), 30: (31, 1), 40: (None, 0), 50: (None, 0), 60: (None, 0)}


def test_label_any_unplanned_looks_past_elective(spark):
    data = [(1, 1, D(2020, 1, 1), D(2020, 1, 2), "URGENT"), (1, 2, D(2020, 1, 5), D(2020, 1, 6), "ELECTIVE"),
            (1, 3, D(2020, 1, 9), D(2020, 1, 10), "URGENT")]
    df = spark.createDataFrame(data, "subject_id long, hadm_id long, admittime timestamp, dischtime timestamp, admission_type string")
    assert {r["hadm_id"]: r["next_hadm_id"] for r in L.label_any_unplanned(df, df).collect()} == {1: 3, 2: 3, 3: None}
    assert {r["hadm_id"]: r["readmit_30days"] for r in L.label_lead(df).collect()} == {1: 0, 2: 1, 3: 0}


def test_label_fractional(spark):
    out = L.label_fractional(stays_frame(spark)).filter("hadm_id in (20, 30, 50)")
    assert {r["hadm_id"]: r["readmit_30days"] for r in out.collect()} == {20: 1, 30: 0, 50: 1}


def test_scores(spark):
    dx = spark.createDataFrame(
        [(1, "410.1", 9), (1, "428", 9), (2, "I50.9", 10), (2, "I501", 10), (3, "C50.9", 10), (4, "C50", 10), (5, "174", 9),
         (5, "410", 9), (6, "410", 10)], "hadm_id long, icd_code string, icd_version int")
    cci = C.flags_and_score(dx, R.charlson_table(spark), R.CHARLSON_FLAGS, CO.CHARLSON_WEIGHTS, "s", True)
    plain = C.flags_and_score(dx, R.charlson_table(spark), R.CHARLSON_FLAGS, CO.CHARLSON_WEIGHTS, "s")
    # two conditions of weight 1 count once; the `$` pattern needs the exact code; versions must agree
    assert rows(cci, "hadm_id", "s") == [(1, 1), (2, 1), (4, 2), (5, 3)]
    assert rows(plain, "hadm_id", "s") == [(1, 2), (2, 1), (4, 2), (5, 3)]


def test_undotted_patterns(spark):
    dx = spark.createDataFrame([(1, "I11.0", 10)], "hadm_id long, icd_code string, icd_version int")
    stripped = C.match_patterns(dx, R.elixhauser_table(spark))
    literal = C.match_patterns(dx, R.elixhauser_table(spark, strip_dots=False))
    assert stripped.count() == 1 and literal.count() == 0


def test_flags_null_without_match_in_system(spark):
    dx = spark.createDataFrame([(1, "410", 9), (2, "F32", 10)], "hadm_id long, icd_code string, icd_version int")
    systems = [C.CodeSystem(R.charlson_table(spark), R.CHARLSON_FLAGS, CO.CHARLSON_WEIGHTS, "cci", True),
               C.CodeSystem(R.elixhauser_table(spark), CO.ELIX_FLAGS, dict(R.ELIXHAUSER_WEIGHTS), "elix")]
    out = C.score_systems(dx, systems)
    assert rows(out, "hadm_id", "cci_mi", "cci", "ex_depression", "elix") == [(1, 1, 1, None, None), (2, None, None, 1, -3)]


def test_last_value_of_synonyms(spark):
    data = [(1, "WBC", 5.0, D(2020, 1, 3), 1), (1, "White Blood Cells", 9.0, D(2020, 1, 1), 2),
            (1, "WBC", 4.0, D(2020, 1, 3), 3), (1, "WBC", 20.0, D(2020, 1, 1), 4)]
    df = spark.createDataFrame(data, "hadm_id long, label string, valuenum double, charttime timestamp, event_id long")
    assert rows(M.measure_pivot(df), "wbc_last", "wbc_min", "wbc_max") == [(9.0, 4.0, 20.0)]
    assert rows(M.measure_pivot(df, merge_synonyms_first=True), "wbc_last") == [(4.0,)]
    assert rows(M.latest_per_label(df), "label", "valuenum") == [("WBC", 4.0), ("White Blood Cells", 9.0)]


def test_collapse_intervals(spark):
    a, z = D(2020, 1, 2), D(2020, 1, 10)
    data = [(1, None, None, None, None, None, a, z), (2, 21, D(2020, 1, 1), D(2020, 1, 1), 0.0, 80.0, a, z),
            (3, 31, D(2020, 1, 3), D(2020, 1, 4), 24.0, 60.0, a, z), (3, 32, D(2020, 1, 5), D(2020, 1, 8), 72.0, 100.0, a, z),
            (3, 33, D(2020, 1, 9), D(2020, 1, 9, 12), None, 50.0, a, z)]
    df = spark.createDataFrame(data, "hadm_id long, stay_id long, icu_intime timestamp, icu_outtime timestamp, "
                               "length_of_icu_stay_hours double, hr double, admittime timestamp, dischtime timestamp")
    out = {r["hadm_id"]: r for r in A.collapse_intervals(df, measures=["hr"]).collect()}
    assert (out[1]["icu_stay_count"], out[1]["total_icu_hours"], out[1]["time_to_first_icu_hours"]) == (0, 0.0, None)
    assert (out[2]["hr_wmean"], out[2]["time_to_first_icu_hours"]) == (None, 0.0)
    assert (out[3]["hr_wmean"], out[3]["hr_min"], out[3]["icu_stay_count"]) == (90.0, 50.0, 3)
    assert out[3]["last_icu_to_discharge_hours"] == 12.0


def test_first_non_null_mixes_rows(spark):
    df = spark.createDataFrame([(1, 1, None, "x"), (1, 2, 5, "y"), (2, 1, None, None)], "k long, o long, a long, b string")
    assert rows(A.first_non_null(df, "k", ["o"], ["a", "b"]), "k", "a", "b") == [(1, 5, "x"), (2, None, None)]
    assert rows(A.argmin_row(df, "k", ["o"]), "k", "a", "b") == [(1, None, "x"), (2, None, None)]


def test_merge_texts(spark):
    data = [(1, 3, "c", None, 2), (1, 1, "a", 1, 9), (1, 2, "  ", 1, 9), (1, 4, None, 1, 9), (2, 5, "z", 1, 1)]
    df = spark.createDataFrame(data, "k long, note_id long, text string, t1 long, t2 long")
    df = df.withColumn("at", F.coalesce("t1", "t2"))
    out = A.merge_texts(df, "k", order=["at", "note_id"])
    assert rows(out, "k", "note_id", "text") == [(1, 1, "a\n\n-----\n\nc"), (2, 5, "z")]


def test_rows_for_entity_drops_constant_columns(spark):
    df = spark.createDataFrame([(1, "a", None, 1), (1, "b", None, None), (2, "c", 3, 4)], "id long, v string, n long, m long")
    assert X.rows_for_entity(df, "id", 1).columns == ["v", "m"]
    assert P.constant_columns(df.filter("id = 1")) == ["id", "n"]


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a long, b long, c long")
    twice = df.toDF("a", "b", "a")
    assert X.dup_column_names(twice) == {"a": 2}
    assert X.first_of_duplicates(twice).columns == ["a", "b"]
    assert X.keep_columns(df, ["c", "zz"], ["a", "c"]).columns == ["c", "a"]
    with pytest.raises(ValueError):
        J.require_unique(spark.createDataFrame([(1,), (1,)], "k long"), "k")


def test_scalars(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (2.0,)], "v double")
    assert [tuple(r) for r in df.select(S.clip_lower("v"), S.negative_to_null("v")).collect()] == [
        (None, None), (0.0, None), (2.0, 2.0)]
    text = spark.createDataFrame([(" a  b c ",), ("",), (None,)], "t string")
    assert [r[0] for r in text.select(S.word_count("t")).collect()] == [3, 0, None]
    pen = spark.createDataFrame([(1.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)], "a double, b double")
    assert [r[0] for r in pen.select(S.penalty_class("a", "b")).collect()] == ["L1", "L2", "ElasticNet", "None"]
    bad = spark.createDataFrame([("2020-01-02 03:04:05",), ("nope",)], "t string")
    assert [r[0] for r in bad.select(S.parse_timestamp("t")).collect()] == [D(2020, 1, 2, 3, 4, 5), None]


def test_quantile_bins(spark):
    df = spark.createDataFrame([(float(v), int(v > 5)) for v in [0, 0, 0, 0, 1, 2, 3, 6, 8, 10]] + [(None, 1)], "v double, y int")
    out = rows(B.quantile_bin_rate(df, "v", "y"), "bin_no", "bin", "n", "rate")
    # repeated edges merge; the lowest bin is closed on the left and labelled a little lower
    assert out == [(0, "-0.00-0.60", 4, 0.0), (1, "0.60-2.40", 2, 0.0), (2, "2.40-6.40", 2, 0.5), (3, "6.40-10.00", 2, 1.0)]
    zero = rows(B.zero_own_bin(df.filter("v in (0, 6)"), "v", "y"), "bin_no", "bin", "n")
    assert zero == [(0, "0", 4), (1, "6.00", 1)]
    over = spark.createDataFrame([(0, 1), (4, 0), (5, 1), (9, 0), (None, 0)], "v int, y int")
    assert rows(B.discrete_overflow_bin(over, "v", "y"), "bin", "n") == [("0", 2), ("4", 1), ("5+", 2)]


def test_scaler_rules(spark):
    cols = "variable string, outliers long, skewness double, kurtosis double, range double, iqr double"
    data = [("a", 0, 0.1, 0.2, 4.0, 1.0), ("b", 0, 0.1, 3.5, 9.0, 1.0), ("c", 0, 1.5, 2.5, 4.0, 1.0),
            ("d", 9, 0.2, 0.1, 4.0, 1.0), ("e", 5, 0.5, 0.0, 4.0, 1.0), ("o1", 11, 0.0, 0.0, 1.0, 1.0), ("o2", 10, 9.0, 9.0, 99.0, 0.0),
            ("f", 0, 0.0, -1.0, 1.0, 0.0)]
    out = SC.assign_scalers(spark.createDataFrame(data, cols), ["o1", "o2"])
    assert dict(rows(out, "variable", "scaler")) == {
        "a": "StandardScaler", "b": "MinMaxScaler", "c": "LogTransform", "d": "RobustScaler", "e": "MinMaxScaler",
        "o1": "RobustScaler", "o2": "MinMaxScaler", "f": "RobustScaler"}


def test_scaling_keeps_constant_columns_at_zero(spark):
    df = spark.createDataFrame([(5.0, 5.0, 5.0, -2.0), (5.0, 5.0, 5.0, 1.0), (None, None, None, None)], "a double, b double, c double, d double")
    methods = {"a": "MinMaxScaler", "b": "StandardScaler", "c": "RobustScaler", "d": "LogTransform"}
    train, _ = SC.scale_features(df, df, methods)
    got = rows(train, "a", "b", "c", "d")
    assert (0.0, 0.0, 0.0, None) in got and (None, None, None, None) in got
    with pytest.raises(ValueError):
        SC.fit_scalers(df, {"a": "Nope"})


def test_sampling(spark):
    df = spark.range(997).withColumn("y", (F.col("id") % 10 == 0).cast("int")).repartition(7)
    small = {r[0] for r in SA.hash_bucket_sample(df, "id", 1000, 200).select("id").collect()}
    large = {r[0] for r in SA.hash_bucket_sample(df, "id", 1000, 500).select("id").collect()}
    assert small < large and 400 < len(large) < 600
    split = SA.stratified_split(df, "id", "y", 0.2).groupBy("y", "split").count()
    assert {(r["y"], r["split"]): r["count"] for r in split.collect()} == {(0, "train"): 718, (0, "test"): 179, (1, "train"): 80, (1, "test"): 20}
    folds = SA.stratified_kfold(df, "id", "y", 3).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in folds if r["y"] == y]
        assert len(sizes) == 3 and max(sizes) - min(sizes) <= 1
    one = SA.stratified_kfold(df.coalesce(1), "id", "y", 3).orderBy("id").collect()
    many = SA.stratified_kfold(df.repartition(13), "id", "y", 3).orderBy("id").collect()
    assert one == many
    over = SA.random_oversample(df, "id", "y", 0.5)
    counts = {r["y"]: r["count"] for r in over.groupBy("y").count().collect()}
    assert counts == {0: 897, 1: 448}
    assert SA.keep_pos_sample_neg(df.withColumn("y", (F.col("id") < 5).cast("int")), "id", "y", 100).count() == 105
    assert SA.keep_pos_sample_neg(df, "id", "y", 100).count() == 997


def test_resample_policy(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") < 4).cast("int"))
    assert SA.resample_policy(df, "y", n_features=10).sampler == "smote"
    assert SA.resample_policy(df, "y", n_features=10).k_neighbors == 3
    assert SA.resample_policy(df, "y", n_features=201).sampler is None
    assert SA.resample_policy(df, "y", sparse=True).sampler is None
    assert SA.resample_policy(df.withColumn("y", (F.col("id") < 1).cast("int")), "y").sampler == "ros"
    assert SA.resample_policy(df.withColumn("y", (F.col("id") < 50).cast("int")), "y").sampler is None


def test_text(spark):
    df = spark.createDataFrame([(1, "École _ a the_x The 2 cats"), (2, ""), (3, None)], "id long, t string")
    assert df.select(TX.tokenize("t")).first()[0] == ["école", "the_x", "2", "cats"]
    lemma = spark.createDataFrame([("cats", "Cat"), ("2", "two")], "token string, lemma string")
    out = {r["id"]: r["lemmas"] for r in TX.lemma_normalize(df, "id", "t", lemma).collect()}
    # the filter acts on the lemma: `2` becomes alphabetic, `the_x` is not
    assert out == {1: ["école", "two", "cat"], 2: [], 3: []}
    grams = spark.createDataFrame([(["aa", "b", "cc", "aa"],), (["x"],), ([],)], "g array<string>")
    assert [r[0] for r in grams.select(TX.ngrams("g")).collect()] == [["aa", "cc", "aa", "aa cc", "cc aa"], [], []]


def test_tfidf_weights(spark):
    import math

    df = spark.createDataFrame([(1, ["aa", "aa", "bb"]), (2, ["aa"])], "id long, g array<string>")
    out = {(r["id"], r["term"]): r["weight"] for r in TX.tfidf_long(df, "id", "g").collect()}
    rare = math.log(3 / 2) + 1
    raw = {"aa": 2.0, "bb": rare, "aa aa": rare, "aa bb": rare}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    assert out[(2, "aa")] == pytest.approx(1.0)
    for term, v in raw.items():
        assert out[(1, term)] == pytest.approx(v / norm)
    vectors, terms = TX.tfidf_vectors(df, "id", "g")
    first = vectors.filter("id = 1").first()["tfidf"]
    assert terms == sorted(terms)
    for i, term in enumerate(terms):
        assert first[i] == pytest.approx(out.get((1, term), 0.0))


def test_snippet(spark):
    long = "x" * 100 + "Take it, take IT" + "y" * 100
    df = spark.createDataFrame([(long,), ("nothing",), (None,)], "t string")
    got = [r[0] for r in df.select(TX.snippet("t", "take", 10)).collect()]
    assert got == ["x" * 10 + "[TAKE] it, [TAKE] ", "", ""]


def test_feature_match_levels(spark):
    names = spark.createDataFrame([("tfidf__take",), ("take care",), ("mistake",), ("n",)], "name string")
    assert rows(TX.feature_token_match(names, "name", ["take"]), "feature") == [("take care",), ("tfidf__take",)]
    assert rows(TX.feature_token_match(names, "name", ["istak"]), "feature") == [("mistake",)]


def test_bundle_and_splits(spark, tmp_path):
    a, b = spark.range(3), spark.range(4).withColumn("y", F.lit(1))
    IO.save_bundle({"a": a, "b": b}, str(tmp_path / "bundle"))
    assert {n: d.count() for n, d in IO.load_bundle(spark, str(tmp_path / "bundle")).items()} == {"a": 3, "b": 4}
    IO.save_splits({"b": SA.train_test_split(b, "id")}, str(tmp_path / "splits"))
    parts = IO.load_splits(spark, str(tmp_path / "splits"), "b", "y")
    assert parts["X_train"].columns == ["id"] and parts["y_test"].columns == ["y"]
    assert parts["X_train"].count() + parts["X_test"].count() == 4


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "a", "x"), (4, "b", None), (5, "a", None)], "id long, t string, u string")
    assert P.duplicate_count(df, ["t", "u"]).first()[0] == 2
    assert rows(P.duplicate_rows(df, ["t", "u"], "id"), "id", "is_extra") == [(1, False), (2, True), (5, True)]


def test_first_visit(spark):
    data = [(1, 10, 1, 1, 5.0, None), (1, 10, 1, 2, 5.0, "b"), (2, 20, 1, 3, None, "c"), (2, 21, 2, 4, 7.0, "d"), (3, 30, 1, 5, 0.0, "e")]
    df = spark.createDataFrame(data, "subject_id long, hadm_id long, admittime long, row_id long, admit_to_disch_hours double, v string")
    mixed = rows(CO.first_visit_table(df), "subject_id", "hadm_id", "admit_to_disch_hours", "v")
    assert mixed == [(1, 10, 5.0, "b"), (1, 10, 5.0, None), (2, 20, 7.0, "c")]
    whole = rows(CO.first_visit_table(df, row_first=True), "subject_id", "hadm_id")
    assert whole == [(1, 10), (1, 10)]


def test_cohort_patient_is_capped_before_features(spark):
    stays = spark.range(300).select(
        (F.col("id") % 100).alias("subject_id"), F.col("id").alias("hadm_id"),
        F.timestamp_seconds(F.col("id") * 86400).alias("admittime"), F.timestamp_seconds(F.col("id") * 86400 + 3600).alias("dischtime"),
        F.lit(None).cast("timestamp").alias("deathtime"), F.lit("URGENT").alias("admission_type"))
    codes = stays.select("hadm_id", F.lit("I50").alias("icd_code"), F.lit(10).alias("icd_version"))
    codes = codes.unionByName(codes)
    rate = stays.select("hadm_id", F.lit(70.0).alias("heart_rate"))
    out = CO.cohort_patient(stays, codes, codes, rate, sample_bucket=1000, target_n=20)
    got = out.collect()
    assert len(got) == 20 == len({r["subject_id"] for r in got})
    assert all(r["hadm_id"] == r["subject_id"] and r["n_dx_codes"] == 2 and r["los_hours"] == 1 for r in got)


def test_whole_cohort_patient_adds_facts_up_before_they_meet_stays(spark):
    stays = spark.range(12).select(
        (F.col("id") % 4).alias("subject_id"), F.col("id").alias("hadm_id"),
        F.timestamp_seconds(F.col("id") * 86400).alias("admittime"), F.timestamp_seconds(F.col("id") * 86400 + 3600).alias("dischtime"),
        F.lit(None).cast("timestamp").alias("deathtime"), F.lit("URGENT").alias("admission_type"))
    codes = spark.createDataFrame([(0, "a"), (0, "a"), (1, "b"), (7, "c"), (None, "d")], "hadm_id long, icd_code string")
    rate = spark.createDataFrame([(0, 60.0), (0, 70.0), (2, None), (None, 1.0)], "hadm_id long, heart_rate double")
    out = CO.cohort_patient(stays, codes, codes.filter("hadm_id = 1"), rate)
    assert rows(out, "hadm_id", "n_dx_codes", "n_px_codes", "icu_mean_hr") == [
        (0, 2, None, 65.0), (1, 1, 1, None), (2, None, None, None), (3, None, None, None)
    ]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [hadm_id") == 1
