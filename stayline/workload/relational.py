"""Scans, filters, joins, aggregates, windows, limits and unions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayline.functions import scalars as S
from stayline.operators import aggregates as A
from stayline.operators import codes as C
from stayline.operators import filters as X
from stayline.operators import joins as J
from stayline.operators import limits as T
from stayline.operators import measures as M
from stayline.operators import windows as W
from stayline.plans.cohort import CHARLSON_WEIGHTS, ELIX_FLAGS
from stayline.session import shared_folder
from stayline.sources import reference as R
from stayline.sources import tables as IO
from stayline.workload import roles as role
from stayline.workload.registry import query
from stayline.workload.roles import table, with_roles


def r6(c):
    return F.round(c, 6)


def values_sql(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


CHARLSON_SQL = f"charlson(group_name, weight, icd_version, pattern) AS (VALUES {values_sql(R.CHARLSON)})"
ELIX_ROWS = [(g, v, R.undotted(p)) for g, v, p in R.ELIXHAUSER]
ELIX_SQL = f"elix(group_name, icd_version, pattern) AS (VALUES {values_sql(ELIX_ROWS)})"
WEIGHTS_SQL = f"weights(group_name, weight) AS (VALUES {values_sql(R.ELIXHAUSER_WEIGHTS)})"
NORM_SQL = "upper(replace(icd_code, '.', ''))"
CCI_RAW = f"""cci_raw AS (
  SELECT hadm_id, group_name, weight FROM diagnoses d JOIN charlson c
    ON d.icd_version = c.icd_version AND regexp_matches({NORM_SQL}, c.pattern)
  GROUP BY ALL)"""
ELIX_RAW = f"""elix_raw AS (
  SELECT hadm_id, group_name FROM diagnoses d JOIN elix e
    ON d.icd_version = e.icd_version AND regexp_matches({NORM_SQL}, e.pattern)
  GROUP BY ALL)"""
CCI_FLAGS_SQL = ",\n".join(
    f"max(CASE WHEN group_name = '{g}' THEN 1 ELSE 0 END) AS {n}" for g, n in R.CHARLSON_FLAGS.items()
)
EX_FLAGS_SQL = ",\n".join(f"max(CASE WHEN group_name = '{g}' THEN 1 ELSE 0 END) AS {n}" for g, n in ELIX_FLAGS.items())


def in_labels(labels) -> str:
    return "label IN (" + ", ".join(f"'{x}'" for x in labels) + ")"


LAB_ROWS_SQL = f"""lab_rows AS (
  SELECT l.hadm_id, l.event_id, l.charttime, l.valuenum, d.label FROM labs l JOIN lab_items d USING (itemid)
  WHERE l.hadm_id IS NOT NULL AND l.valuenum IS NOT NULL AND {in_labels(M.all_labels(R.LAB_LABELS))})"""
LAB_MINMAX_SQL = ", ".join(
    f"min(CASE WHEN {in_labels(ls)} THEN valuenum END) AS {n}_min, max(CASE WHEN {in_labels(ls)} THEN valuenum END) AS {n}_max"
    for n, ls in R.LAB_LABELS.items()
)
LAB_LAST_ROWS_SQL = """lab_last_rows AS (
  SELECT hadm_id, label, valuenum FROM (
    SELECT *, row_number() OVER (PARTITION BY hadm_id, label ORDER BY charttime DESC, event_id DESC) AS rn FROM lab_rows)
  WHERE rn = 1)"""
LAB_LAST_SQL = ", ".join(
    f"max(CASE WHEN {in_labels(ls)} THEN valuenum END) AS {n}_last" for n, ls in R.LAB_LABELS.items()
)


def vital_mean_sql(name: str, labels) -> str:
    v = "valuenum"
    if R.FAHRENHEIT in labels:
        v = f"CASE WHEN label = '{R.FAHRENHEIT}' THEN (valuenum - 32.0) * 5.0 / 9.0 ELSE valuenum END"
    return f"avg(CASE WHEN {in_labels(labels)} THEN {v} END) AS {name}"


VITAL_MEANS_SQL = ", ".join(vital_mean_sql(n, ls) for n, ls in R.VITAL_LABELS.items())
CHART_SQL = f"""chart AS (
  SELECT v.stay_id, v.valuenum, i.label FROM vitals v JOIN vital_items i USING (itemid)
  WHERE v.valuenum IS NOT NULL AND i.linksto = 'chartevents' AND {in_labels(M.all_labels(R.VITAL_LABELS))}
    AND v.stay_id IN (SELECT stay_id FROM unit_stays))"""


def lab_rows(spark, sf):
    return M.lookup_join(
        role.labs(spark, sf).filter("hadm_id is not null"), role.lab_items(spark, sf), M.all_labels(R.LAB_LABELS)
    )


def chart_rows(spark, sf):
    items = role.vital_items(spark, sf).filter("linksto = 'chartevents'")
    vitals = role.vitals(spark, sf)
    rows = J.keep_members(M.lookup_join(vitals, items, M.all_labels(R.VITAL_LABELS)), role.unit_stays(spark, sf), "stay_id")
    return J.dealt(rows, "stay_id", vitals.count())


# ---- scans, sources, sinks -------------------------------------------------------------------------------------------

@query("scan_table", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def scan_table(spark, sf):
    return IO.scan_table(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice"])


@query("scan_csv", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def scan_csv(spark, sf):
    path = shared_folder(spark)
    df = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    IO.write_csv(df, path)
    return IO.scan_csv(spark, path, df.schema)


@query("write_csv", "SELECT doc_id, text, lang FROM documents")
def write_csv(spark, sf):
    path = shared_folder(spark)
    df = table(spark, sf, "documents").select("doc_id", "text", "lang")
    IO.write_csv(df, path)
    return IO.scan_csv(spark, path, df.schema)


@query("ref_relation", f"""WITH {CHARLSON_SQL}, {role.SQL['diagnoses']}
SELECT group_name, weight, icd_version, count(hadm_id) AS n_events FROM charlson c LEFT JOIN diagnoses d
  USING (icd_version) GROUP BY ALL""")
def ref_relation(spark, sf):
    per_version = role.diagnoses(spark, sf).groupBy("icd_version").agg(F.count("hadm_id").alias("n_events"))
    ref = R.charlson_table(spark).select("group_name", "weight", "icd_version")
    return ref.join(per_version, "icd_version", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))


@query("versioned_ctas", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def versioned_ctas(spark, sf):
    df = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    path = shared_folder(spark)
    return spark.table(IO.create_versioned(df, "orders_by_status", path[-8:] + "_2026_01_01_0000", path))


@query("save_bundle", """SELECT 'customer' AS name, count(*) AS n FROM customer
UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part""")
def save_bundle(spark, sf):
    path = shared_folder(spark)
    IO.save_bundle({n: table(spark, sf, n) for n in ("customer", "supplier", "part")}, path)
    frames = IO.load_bundle(spark, path)
    return T.union_all(*[
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n, df in frames.items()
    ])


@query("bundle_contents", """SELECT 'customer' AS name, c_custkey AS id, md5(c_name) AS digest FROM customer
UNION ALL SELECT 'supplier', s_suppkey, md5(s_name) FROM supplier UNION ALL SELECT 'part', p_partkey, md5(p_name) FROM part""")
def bundle_contents(spark, sf):
    """Every row of a bundle that was saved and loaded."""
    path, columns = shared_folder(spark), {"customer": "c_custkey c_name", "supplier": "s_suppkey s_name", "part": "p_partkey p_name"}
    IO.save_bundle({n: table(spark, sf, n) for n in columns}, path)
    frames = IO.load_bundle(spark, path)
    return T.union_all(*[
        frames[n].select(F.lit(n).alias("name"), F.col(key).alias("id"), F.md5(F.col(value).cast("binary")).alias("digest"))
        for n, (key, value) in ((n, c.split()) for n, c in columns.items())
    ])


@query("run_log", """SELECT parameter, value FROM (VALUES ('n_rows', (SELECT CAST(count(*) AS VARCHAR) FROM orders)),
  ('sample_bucket', '500'), ('sample_mod', '1000'), ('seed', '42')) t(parameter, value)""")
def run_log(spark, sf):
    params = {"sample_mod": 1000, "sample_bucket": 500, "seed": 42, "n_rows": table(spark, sf, "orders").count()}
    return IO.write_run_log(spark, shared_folder(spark), "run1", params).select("parameter", "value")


# ---- filters and projections -----------------------------------------------------------------------------------------

@query("valid_stays", with_roles("admissions", body="""
SELECT subject_id, hadm_id FROM admissions
WHERE admittime IS NOT NULL AND dischtime IS NOT NULL AND deathtime IS NULL"""))
def valid_stays(spark, sf):
    return X.valid_stays(role.admissions(spark, sf)).select("subject_id", "hadm_id")


@query("exclude_event_window", with_roles("admissions", "patients", body="""
SELECT a.subject_id, a.hadm_id FROM admissions a LEFT JOIN patients p USING (subject_id)
WHERE NOT (p.dod IS NOT NULL AND p.dod BETWEEN CAST(a.dischtime AS DATE) AND CAST(a.dischtime AS DATE) + 30)"""))
def exclude_event_window(spark, sf):
    out = X.exclude_event_window(role.admissions(spark, sf), role.patients(spark, sf))
    return out.select("subject_id", "hadm_id")


@query("label_in_list", with_roles("labs", "lab_items", body="""
SELECT event_id, label, valuenum FROM labs JOIN lab_items USING (itemid) WHERE label IN ('Sodium', 'Glucose', 'Lactate')"""))
def label_in_list(spark, sf):
    out = X.label_in_list(
        role.labs(spark, sf), role.lab_items(spark, sf), "itemid", "label", ["Sodium", "Glucose", "Lactate"]
    )
    return out.select("event_id", "label", "valuenum")


@query("nonblank_text", r"SELECT doc_id FROM documents WHERE text IS NOT NULL AND regexp_matches(trim(text), '\S')")
def nonblank_text(spark, sf):
    return X.nonblank_text(table(spark, sf, "documents")).select("doc_id")


@query("drop_columns", "SELECT p_partkey, p_name, p_brand, p_size FROM part")
def drop_columns(spark, sf):
    return X.drop_columns(table(spark, sf, "part"), ["p_type", "p_retailprice", "not_there"])


@query("keep_columns", "SELECT s_suppkey, s_acctbal, s_name FROM supplier")
def keep_columns(spark, sf):
    return X.keep_columns(table(spark, sf, "supplier"), ["s_suppkey", "s_acctbal", "missing"], ["s_name", "s_suppkey"])


@query("dup_column_names", """SELECT o_orderkey, o_custkey AS key, c_name FROM orders JOIN customer ON o_custkey = c_custkey""")
def dup_column_names(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), "c_name")
    both = orders.join(people, orders["key"] == people["key"])
    if X.dup_column_names(both) != {"key": 2}:
        raise ValueError("duplicate name not reported")
    return X.first_of_duplicates(both)


@query("prefix_columns", "SELECT n_nationkey AS dim__n_nationkey, n_name AS dim__n_name, n_regionkey FROM nation")
def prefix_columns(spark, sf):
    return X.prefix_columns(table(spark, sf, "nation"), "dim__", ["n_nationkey", "n_name"])


@query("row_grain", with_roles("admissions", "unit_stays", body="""
SELECT a.hadm_id, CASE WHEN stay_id IS NULL THEN 'ADMISSION_ONLY' ELSE 'ICU_STAY' END AS row_grain,
  coalesce(CAST(stay_id AS VARCHAR), 'HADM_' || CAST(a.hadm_id AS VARCHAR)) AS grain_id
FROM admissions a LEFT JOIN unit_stays u ON u.hadm_id = a.hadm_id"""))
def row_grain(spark, sf):
    stays = role.unit_stays(spark, sf).select("hadm_id", "stay_id")
    df = role.admissions(spark, sf).select("hadm_id").join(stays, "hadm_id", "left")
    return X.row_grain(df).select("hadm_id", "row_grain", "grain_id")


@query("prefer_coalesce", """SELECT l_orderkey, l_linenumber, l_partkey,
  coalesce(CASE WHEN l_discount > 0.02 THEN l_discount END, CASE WHEN l_tax > 0 THEN l_tax END) AS preferred FROM lineitem""")
def prefer_coalesce(spark, sf):
    first, second = F.when(F.col("l_discount") > 0.02, F.col("l_discount")), F.when(F.col("l_tax") > 0, F.col("l_tax"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.coalesce(first, second).alias("preferred")
    )


@query("negatives_to_null", with_roles("durations", body="""
SELECT hadm_id, CASE WHEN hours >= 0 THEN hours END AS hours FROM durations"""))
def negatives_to_null(spark, sf):
    return role.durations(spark, sf).select("hadm_id", S.negative_to_null("hours").alias("hours"))


@query("clip_lower", with_roles("durations", body="""
SELECT hadm_id, CASE WHEN hours < 0 THEN 0 ELSE hours END AS hours FROM durations"""))
def clip_lower(spark, sf):
    return role.durations(spark, sf).select("hadm_id", S.clip_lower("hours").alias("hours"))


@query("fill_from_column", with_roles("durations", body="""
SELECT hadm_id, coalesce(hours, o_totalprice) AS hours FROM durations"""))
def fill_from_column(spark, sf):
    return X.fill_from_column(role.durations(spark, sf), ["hours"], "o_totalprice").select("hadm_id", "hours")


@query("impute_policy", with_roles("admissions", "unit_stays", body="""
WITH t AS (SELECT a.hadm_id, (epoch_us(any_value(dischtime)) - epoch_us(any_value(admittime))) / 3.6e9 AS los,
  (epoch_us(min(intime)) - epoch_us(any_value(admittime))) / 3.6e9 AS wait FROM admissions a LEFT JOIN unit_stays u ON u.hadm_id = a.hadm_id GROUP BY 1)
SELECT hadm_id, coalesce(CASE WHEN wait < 0 THEN 0 ELSE wait END, los) AS time_to_first_icu_hours FROM t"""))
def impute_policy(spark, sf):
    first = role.unit_stays(spark, sf).groupBy("hadm_id").agg(F.min("intime").alias("first"))
    df = role.admissions(spark, sf).join(first, "hadm_id", "left").select(
        "hadm_id", S.hours_between("admittime", "dischtime").alias("los"),
        S.clip_lower(S.hours_between("admittime", "first")).alias("time_to_first_icu_hours"),
    )
    return X.fill_from_column(df, ["time_to_first_icu_hours"], "los").drop("los")


@query("drop_nonpositive", with_roles("durations", body="SELECT hadm_id, hours FROM durations WHERE hours > 0"))
def drop_nonpositive(spark, sf):
    return X.drop_nonpositive(role.durations(spark, sf), "hours").select("hadm_id", "hours")


@query("rows_for_entity", """SELECT event_id, ts, event_type, value, props FROM events
WHERE user_id = (SELECT min(user_id) FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1
  QUALIFY n = max(n) OVER ()))""")
def rows_for_entity(spark, sf):
    events = table(spark, sf, "events")
    top = events.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").first()["user_id"]
    return X.rows_for_entity(events, "user_id", top)


@query("derived_features", with_roles("admissions", "patients", "notes", body=r"""
WITH n AS (SELECT hadm_id, min(text) AS note_text FROM notes GROUP BY 1)
SELECT a.hadm_id, date_sub('hour', admittime, dischtime) AS los_hours, date_sub('day', admittime, dischtime) AS los_days,
  CASE WHEN note_text IS NOT NULL AND regexp_matches(trim(note_text), '\S') THEN 1 ELSE 0 END AS has_text,
  date_sub('year', birth_date, CAST(admittime AS DATE)) AS age_at_admission, sex AS sex_at_admission
FROM admissions a LEFT JOIN patients p USING (subject_id) LEFT JOIN n USING (hadm_id)"""))
def derived_features(spark, sf):
    texts = role.notes(spark, sf).groupBy("hadm_id").agg(F.min("text").alias("note_text"))
    df = J.left_chain(role.admissions(spark, sf), (role.patients(spark, sf), "subject_id"), (texts, "hadm_id"))
    return X.derived_features(df).select(
        "hadm_id", "los_hours", "los_days", "has_text", "age_at_admission", "sex_at_admission"
    )


# ---- joins -----------------------------------------------------------------------------------------------------------

@query("inner_two_key", with_roles("admissions", "notes", body="""
SELECT a.hadm_id, note_id, admission_type FROM admissions a JOIN notes n
  ON n.subject_id = a.subject_id AND n.hadm_id = a.hadm_id"""))
def inner_two_key(spark, sf):
    return role.admissions(spark, sf).join(role.notes(spark, sf), ["subject_id", "hadm_id"]).select(
        "hadm_id", "note_id", "admission_type"
    )


@query("left_chain", with_roles("admissions", "diagnoses", "procedures", "unit_stays", body="""
WITH dx AS (SELECT hadm_id, count(*) AS n_dx FROM diagnoses GROUP BY 1),
px AS (SELECT hadm_id, count(*) AS n_px FROM procedures GROUP BY 1),
st AS (SELECT hadm_id, count(*) AS n_stays FROM unit_stays GROUP BY 1)
SELECT a.hadm_id, n_dx, n_px, n_stays FROM admissions a LEFT JOIN dx USING (hadm_id) LEFT JOIN px USING (hadm_id)
  LEFT JOIN st USING (hadm_id)"""))
def left_chain(spark, sf):
    def counts(df, out):
        return df.groupBy("hadm_id").agg(F.count(F.lit(1)).alias(out))

    return J.left_chain(
        role.admissions(spark, sf).select("hadm_id"),
        (counts(role.diagnoses(spark, sf), "n_dx"), "hadm_id"),
        (counts(role.procedures(spark, sf), "n_px"), "hadm_id"),
        (counts(role.unit_stays(spark, sf), "n_stays"), "hadm_id"),
    )


@query("full_outer_using", with_roles("procedures", "labs", body="""
WITH p AS (SELECT hadm_id, count(*) AS n_px FROM procedures GROUP BY 1),
l AS (SELECT hadm_id, max(valuenum) AS max_lab FROM labs GROUP BY 1)
SELECT hadm_id, n_px, max_lab FROM p FULL OUTER JOIN l USING (hadm_id)"""))
def full_outer_using(spark, sf):
    p = role.procedures(spark, sf).groupBy("hadm_id").agg(F.count(F.lit(1)).alias("n_px"))
    labs = role.labs(spark, sf).groupBy("hadm_id").agg(F.max("valuenum").alias("max_lab"))
    return J.full_outer(p, labs, "hadm_id")


@query("pattern_join", with_roles("diagnoses", body=f"WITH {CHARLSON_SQL}, {CCI_RAW} SELECT hadm_id, group_name, weight FROM cci_raw"))
def pattern_join(spark, sf):
    return C.match_patterns(role.diagnoses(spark, sf), R.charlson_table(spark))


@query("lookup_join", with_roles("vitals", "vital_items", "unit_stays", body=f"""
WITH {CHART_SQL} SELECT label, count(*) AS n, round(sum(valuenum), 6) AS total FROM chart GROUP BY 1"""))
def lookup_join(spark, sf):
    return chart_rows(spark, sf).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("valuenum")).alias("total")
    )


@query("range_next_event", with_roles("admissions", body="""
SELECT i.subject_id, i.hadm_id, min_by(a.hadm_id, (a.admittime, a.hadm_id)) AS next_hadm_id, min(a.admittime) AS next_admittime
FROM admissions i JOIN admissions a ON a.subject_id = i.subject_id AND a.admittime > i.dischtime
  AND date_sub('day', i.dischtime, a.admittime) <= 30 AND a.admission_type <> 'ELECTIVE'
GROUP BY 1, 2"""))
def range_next_event(spark, sf):
    stays = role.admissions(spark, sf)
    take = {"next_hadm_id": "hadm_id", "next_admittime": "admittime"}
    found = W.next_event_after(
        stays, stays, "subject_id", "dischtime", "admittime", take, "hadm_id", F.col("admission_type") != "ELECTIVE"
    )
    return found.filter(S.whole_days("dischtime", "next_admittime") <= 30).select("subject_id", "hadm_id", *take)


@query("semi_join", with_roles("admissions", "labs", body="""
SELECT subject_id, hadm_id FROM admissions WHERE hadm_id IN (SELECT hadm_id FROM labs WHERE valuenum > 20)"""))
def semi_join(spark, sf):
    members = role.labs(spark, sf).filter("valuenum > 20")
    return J.keep_members(role.admissions(spark, sf), members, "hadm_id").select("subject_id", "hadm_id")


@query("fan_out_guard", with_roles("unit_stays", "diagnoses", body="""
SELECT 'unit_stays' AS feature, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, max(n) AS max_rows
FROM (SELECT stay_id, count(*) AS n FROM unit_stays GROUP BY 1)
UNION ALL SELECT 'diagnoses', CAST(sum(n) AS BIGINT), count(*), max(n) FROM (SELECT hadm_id, count(*) AS n FROM diagnoses GROUP BY 1)"""))
def fan_out_guard(spark, sf):
    stays = J.require_unique(role.unit_stays(spark, sf), "stay_id")
    a = J.key_report(stays, "stay_id").select(F.lit("unit_stays").alias("feature"), "*")
    b = J.key_report(role.diagnoses(spark, sf), "hadm_id").select(F.lit("diagnoses").alias("feature"), "*")
    return a.unionByName(b)


@query("hconcat", """SELECT doc_id, n_chars, toxic, label FROM documents JOIN labels USING (doc_id)
  JOIN embeddings ON vec_id = doc_id""")
def hconcat(spark, sf):
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return J.hconcat(
        [table(spark, sf, "documents").select("doc_id", "n_chars"), table(spark, sf, "labels").select("doc_id", "toxic"), emb],
        "doc_id",
    )


@query("index_left_join", """SELECT c_custkey, c_mktsegment, n_orders, spend FROM customer LEFT JOIN
  (SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS spend FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def index_left_join(spark, sf):
    agg = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spend")
    )
    return table(spark, sf, "customer").select("c_custkey", "c_mktsegment").join(agg, "c_custkey", "left")


# ---- aggregates ------------------------------------------------------------------------------------------------------

@query("code_counts", with_roles("diagnoses", body="""
SELECT hadm_id, count(*) AS dx_count, count(DISTINCT icd_code) AS dx_code_uniq,
  count(DISTINCT substr(icd_code, 1, 3)) AS dx_root3_uniq FROM diagnoses GROUP BY 1"""))
def code_counts(spark, sf):
    return A.code_counts(role.diagnoses(spark, sf))


@query("distinct_groups", with_roles("diagnoses", body="SELECT DISTINCT hadm_id, icd_code, icd_version FROM diagnoses"))
def distinct_groups(spark, sf):
    return role.diagnoses(spark, sf).distinct()


@query("flag_pivot", with_roles("diagnoses", body=f"""
WITH {CHARLSON_SQL}, {CCI_RAW}, {ELIX_SQL}, {ELIX_RAW},
cf AS (SELECT hadm_id, {CCI_FLAGS_SQL} FROM cci_raw GROUP BY 1),
ef AS (SELECT hadm_id, {EX_FLAGS_SQL} FROM elix_raw GROUP BY 1)
SELECT * FROM cf FULL OUTER JOIN ef USING (hadm_id)"""))
def flag_pivot(spark, sf):
    systems = [
        C.CodeSystem(R.charlson_table(spark), R.CHARLSON_FLAGS, CHARLSON_WEIGHTS, "cci_score", True),
        C.CodeSystem(R.elixhauser_table(spark), ELIX_FLAGS, dict(R.ELIXHAUSER_WEIGHTS), "elix_vw_score"),
    ]
    return C.score_systems(role.diagnoses(spark, sf), systems).drop("cci_score", "elix_vw_score")


@query("distinct_weight_score", with_roles("diagnoses", body=f"""
WITH {CHARLSON_SQL}, {CCI_RAW} SELECT hadm_id, CAST(sum(DISTINCT weight) AS BIGINT) AS cci_score FROM cci_raw GROUP BY 1"""))
def distinct_weight_score(spark, sf):
    return C.flags_and_score(
        role.diagnoses(spark, sf), R.charlson_table(spark), R.CHARLSON_FLAGS, CHARLSON_WEIGHTS, "cci_score", True
    ).select("hadm_id", "cci_score")


@query("plain_weight_score", with_roles("diagnoses", body=f"""
WITH {CHARLSON_SQL}, {CCI_RAW} SELECT hadm_id, CAST(sum(weight) AS BIGINT) AS cci_score FROM cci_raw GROUP BY 1"""))
def plain_weight_score(spark, sf):
    return C.flags_and_score(
        role.diagnoses(spark, sf), R.charlson_table(spark), R.CHARLSON_FLAGS, CHARLSON_WEIGHTS, "cci_score"
    ).select("hadm_id", "cci_score")


@query("weighted_score", with_roles("diagnoses", body=f"""
WITH {ELIX_SQL}, {WEIGHTS_SQL}, {ELIX_RAW}
SELECT hadm_id, CAST(sum(coalesce(weight, 0)) AS BIGINT) AS elix_vw_score FROM elix_raw LEFT JOIN weights USING (group_name)
GROUP BY 1"""))
def weighted_score(spark, sf):
    return C.flags_and_score(
        role.diagnoses(spark, sf), R.elixhauser_table(spark), ELIX_FLAGS, dict(R.ELIXHAUSER_WEIGHTS), "elix_vw_score"
    ).select("hadm_id", "elix_vw_score")


@query("minmax_pivot", with_roles("labs", "lab_items", body=f"""
WITH {LAB_ROWS_SQL} SELECT hadm_id, {LAB_MINMAX_SQL} FROM lab_rows GROUP BY 1"""))
def minmax_pivot(spark, sf):
    wide = M.measure_pivot(lab_rows(spark, sf))
    return wide.drop(*[f"{n}_last" for n in R.LAB_LABELS])


@query("last_pivot", with_roles("labs", "lab_items", body=f"""
WITH {LAB_ROWS_SQL}, {LAB_LAST_ROWS_SQL} SELECT hadm_id, {LAB_LAST_SQL} FROM lab_last_rows GROUP BY 1"""))
def last_pivot(spark, sf):
    wide = M.measure_pivot(lab_rows(spark, sf))
    return wide.select("hadm_id", *[f"{n}_last" for n in R.LAB_LABELS])


@query("last_pivot_merged", with_roles("labs", "lab_items", body=f"""
WITH {LAB_ROWS_SQL} SELECT hadm_id, {", ".join(
    f"max_by(valuenum, (charttime, event_id)) FILTER (WHERE {in_labels(ls)}) AS {n}_last" for n, ls in R.LAB_LABELS.items())}
FROM lab_rows GROUP BY 1"""))
def last_pivot_merged(spark, sf):
    wide = M.measure_pivot(lab_rows(spark, sf), merge_synonyms_first=True)
    return wide.select("hadm_id", *[f"{n}_last" for n in R.LAB_LABELS])


@query("mean_pivot_units", with_roles("vitals", "vital_items", "unit_stays", body=f"""
WITH {CHART_SQL}, m AS (SELECT stay_id, {VITAL_MEANS_SQL} FROM chart GROUP BY 1)
SELECT stay_id, {", ".join(f"round({n}, 6) AS {n}" for n in R.VITAL_LABELS)} FROM m"""))
def mean_pivot_units(spark, sf):
    return M.mean_pivot(chart_rows(spark, sf)).select("stay_id", *[r6(n).alias(n) for n in R.VITAL_LABELS])


@query("count_default_zero", with_roles("admissions", "unit_stays", body="""
SELECT a.hadm_id, coalesce(n, 0) AS icu_stay_count FROM admissions a
LEFT JOIN (SELECT hadm_id, count(*) AS n FROM unit_stays GROUP BY 1) USING (hadm_id)"""))
def count_default_zero(spark, sf):
    keys = role.admissions(spark, sf).select("hadm_id")
    return A.count_default_zero(keys, role.unit_stays(spark, sf), "hadm_id", "icu_stay_count")


@query("ordered_string_agg", r"""SELECT conv_id, min(turn) AS note_id,
  string_agg(text, chr(10) || chr(10) || '-----' || chr(10) || chr(10) ORDER BY turn, role) AS text
FROM conversations WHERE text IS NOT NULL AND regexp_matches(trim(text), '\S') GROUP BY 1""")
def ordered_string_agg(spark, sf):
    df = table(spark, sf, "conversations").withColumn("note_id", F.col("turn"))
    return A.merge_texts(df, "conv_id", order=["turn", "role"], split=True)


@query("argmin_row", with_roles("admissions", body="""
SELECT subject_id, hadm_id, admittime, admission_type FROM (
  SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY admittime, hadm_id) AS rn FROM admissions) WHERE rn = 1"""))
def argmin_row(spark, sf):
    return A.argmin_row(role.admissions(spark, sf), "subject_id", ["admittime", "hadm_id"]).select(
        "subject_id", "hadm_id", "admittime", "admission_type"
    )


@query("min_by", """SELECT user_id, min_by(event_id, (ts, event_id)) AS first_error, min(ts) AS first_at
FROM events WHERE event_type = 'error' GROUP BY 1""")
def min_by(spark, sf):
    errors = table(spark, sf, "events").filter("event_type = 'error'")
    return errors.groupBy("user_id").agg(
        F.min_by("event_id", F.struct("ts", "event_id")).alias("first_error"), F.min("ts").alias("first_at")
    )


@query("collect_structs", with_roles("diagnoses", body="""
SELECT hadm_id, string_agg(icd_code || '/' || icd_version, ',' ORDER BY icd_code, icd_version) AS codes, count(*) AS n_codes
FROM diagnoses GROUP BY 1"""))
def collect_structs(spark, sf):
    out = A.collect_structs(role.diagnoses(spark, sf), "hadm_id", ["icd_code", "icd_version"], "codes")
    text = F.transform("codes", lambda s: F.concat(s["icd_code"], F.lit("/"), s["icd_version"].cast("string")))
    return out.select("hadm_id", F.array_join(text, ",").alias("codes"), F.col("n_codes").cast("long").alias("n_codes"))


@query("mean_by_key", """SELECT o_custkey, l_orderkey, round(avg(l_quantity), 6) AS mean_qty
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def mean_by_key(spark, sf):
    # aggregate to the order first, then attach the customer
    means = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(r6(F.avg("l_quantity")).alias("mean_qty"))
    orders = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey"))
    return orders.join(means, "l_orderkey")


FIRST_COLS = {"a": "CASE WHEN l_discount > 0.05 THEN l_discount END", "b": "CASE WHEN l_tax > 0.04 THEN l_tax END",
              "c": "CASE WHEN l_returnflag = 'A' THEN l_linestatus END"}


@query("first_non_null", f"""
WITH t AS (SELECT l_orderkey, l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  {", ".join(f"{e} AS {n}" for n, e in FIRST_COLS.items())} FROM lineitem)
SELECT l_orderkey, {", ".join(
    f"min_by({n}, (l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) FILTER (WHERE {n} IS NOT NULL) AS {n}"
    for n in FIRST_COLS)} FROM t GROUP BY 1""")
def first_non_null(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr("*", *[f"{e} AS {n}" for n, e in FIRST_COLS.items()])
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return A.first_non_null(df, "l_orderkey", order, list(FIRST_COLS))


@query("sum_min_count", with_roles("durations", body="""
SELECT subject_id, sum(hours) AS total_or_null, coalesce(sum(hours), 0) AS total
FROM (SELECT subject_id, round(hours / 24) AS hours FROM durations) GROUP BY 1"""))
def sum_min_count(spark, sf):
    days = role.durations(spark, sf).select("subject_id", F.round(F.col("hours") / 24).alias("hours"))
    return days.groupBy("subject_id").agg(F.sum("hours").alias("total_or_null")).withColumn(
        "total", F.coalesce("total_or_null", F.lit(0.0))
    )


@query("weighted_mean", """SELECT l_orderkey, round(CASE WHEN sum(w) > 0 THEN sum(l_extendedprice * w) / sum(w) END, 6) AS price_wmean
FROM (SELECT *, CASE WHEN l_quantity > 10 THEN l_quantity + 10 * l_tax + 0.37 END AS w FROM lineitem) GROUP BY 1""")
def weighted_mean(spark, sf):
    weight = F.when(F.col("l_quantity") > 10, F.col("l_quantity") + 10 * F.col("l_tax") + 0.37)
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        r6(A.weighted_mean("l_extendedprice", weight)).alias("price_wmean")
    )


COLLAPSE_SQL = """
SELECT hadm_id, count(DISTINCT stay_id) AS icu_stay_count, round(coalesce(sum(h), 0), 6) AS total_icu_hours,
  min(intime) AS first_icu_intime, max(outtime) AS last_icu_outtime,
  round(CASE WHEN sum(h) FILTER (WHERE hr IS NOT NULL) > 0
    THEN sum(hr * h) / sum(h) FILTER (WHERE hr IS NOT NULL) END, 6) AS hr_wmean,
  min(hr) AS hr_min, max(hr) AS hr_max,
  round(greatest((epoch_us(min(intime)) - epoch_us(any_value(admittime))) / 3.6e9, 0), 6) AS time_to_first_icu_hours,
  round(greatest((epoch_us(any_value(dischtime)) - epoch_us(max(outtime))) / 3.6e9, 0), 6) AS last_icu_to_discharge_hours
FROM (SELECT a.hadm_id, admittime, dischtime, stay_id, intime, outtime, (epoch_us(outtime) - epoch_us(intime)) / 3.6e9 AS h,
    CASE WHEN stay_id % 5 > 0 THEN CAST(stay_id % 40 + 60 AS DOUBLE) END AS hr
  FROM admissions a LEFT JOIN unit_stays u ON u.hadm_id = a.hadm_id)
GROUP BY 1"""


@query("collapse_intervals", with_roles("admissions", "unit_stays", body=f"""
WITH c AS ({COLLAPSE_SQL})
SELECT * REPLACE (CASE WHEN first_icu_intime IS NOT NULL THEN time_to_first_icu_hours END AS time_to_first_icu_hours,
  CASE WHEN last_icu_outtime IS NOT NULL THEN last_icu_to_discharge_hours END AS last_icu_to_discharge_hours) FROM c"""))
def collapse_intervals(spark, sf):
    stays = role.unit_stays(spark, sf).withColumns({
        "length_of_icu_stay_hours": S.hours_between("intime", "outtime"),
        "hr": F.expr("CASE WHEN stay_id % 5 > 0 THEN cast(stay_id % 40 + 60 AS double) END"),
    })
    df = role.admissions(spark, sf).select("hadm_id", "admittime", "dischtime").join(stays, "hadm_id", "left")
    out = A.collapse_intervals(df, measures=["hr"], start="intime", end="outtime")
    rounded = ["total_icu_hours", "hr_wmean", "time_to_first_icu_hours", "last_icu_to_discharge_hours"]
    return out.drop("admittime", "dischtime").withColumns({c: r6(c) for c in rounded})


@query("group_mean", """SELECT o_orderpriority, round(avg(o_totalprice), 6) AS price, round(avg(o_custkey), 6) AS key
FROM orders GROUP BY 1""")
def group_mean(spark, sf):
    df = table(spark, sf, "orders").select("o_orderpriority", F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("key"))
    return A.group_mean(df, "o_orderpriority", ["price", "key"], "price").select(
        "o_orderpriority", r6("price").alias("price"), r6("key").alias("key")
    )


@query("positive_rate", """SELECT lang, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS positives,
  CAST(sum(1 - toxic) AS BIGINT) AS negatives, round(avg(toxic), 6) AS pos_rate
FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def positive_rate(spark, sf):
    df = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return A.positive_rate(df, "toxic", ["lang"]).withColumn("pos_rate", r6("pos_rate"))


# ---- windows ---------------------------------------------------------------------------------------------------------

@query("lead_next", with_roles("admissions", body="""
SELECT hadm_id, lead(hadm_id) OVER w AS next_hadm_id, lead(admittime) OVER w AS next_admittime,
  lead(admission_type) OVER w AS next_admission_type
FROM admissions WINDOW w AS (PARTITION BY subject_id ORDER BY admittime, hadm_id)"""))
def lead_next(spark, sf):
    take = {"next_hadm_id": "hadm_id", "next_admittime": "admittime", "next_admission_type": "admission_type"}
    return W.lead_next(role.admissions(spark, sf), take=take).select("hadm_id", *take)


@query("latest_row", """SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_row(spark, sf):
    return W.latest_row(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select(
        "user_id", "event_type", "event_id", "value"
    )


@query("shift_next", with_roles("admissions", body="""
SELECT hadm_id, lead(admittime) OVER (PARTITION BY subject_id ORDER BY dischtime, hadm_id) AS next_admittime FROM admissions"""))
def shift_next(spark, sf):
    out = W.lead_next(role.admissions(spark, sf), order=["dischtime", "hadm_id"], take={"next_admittime": "admittime"})
    return out.select("hadm_id", "next_admittime")


# ---- limits, sorts, unions -------------------------------------------------------------------------------------------

@query("cap_entities", f"""SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders)
ORDER BY {role.hash_sql('o_custkey')}, o_custkey LIMIT 500""")
def cap_entities(spark, sf):
    return T.cap_entities(table(spark, sf, "orders"), "o_custkey", 500)


@query("cap_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10000")
def cap_rows(spark, sf):
    return T.cap_rows(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 10_000)


@query("top_contributions", """(SELECT o_orderkey, o_totalprice, 'positive' AS side FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15)
UNION ALL (SELECT o_orderkey, o_totalprice, 'negative' FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 15)""")
def top_contributions(spark, sf):
    return T.top_contributions(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("sort_rows", "SELECT c_mktsegment, c_acctbal, c_custkey FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey")
def sort_rows(spark, sf):
    return table(spark, sf, "customer").select("c_mktsegment", "c_acctbal", "c_custkey").orderBy(
        "c_mktsegment", F.desc("c_acctbal"), "c_custkey"
    )


@query("union_all", """SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier""")
def union_all(spark, sf):
    a = table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_acctbal AS balance")
    b = table(spark, sf, "supplier").selectExpr("s_acctbal AS balance", "s_suppkey AS id", "s_name AS name")
    return T.union_all(a, b)


@query("first_visit_union", with_roles("admissions", body="""
WITH n AS (SELECT subject_id, count(DISTINCT hadm_id) AS k FROM admissions GROUP BY 1),
o AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY admittime, hadm_id) AS rn FROM admissions)
SELECT subject_id, hadm_id, admission_type FROM o JOIN n USING (subject_id) WHERE k = 1
UNION ALL SELECT subject_id, hadm_id, admission_type FROM o JOIN n USING (subject_id) WHERE k > 1 AND rn = 1"""))
def first_visit_union(spark, sf):
    from stayline.plans.cohort import first_visit_table

    df = role.admissions(spark, sf).withColumn("one", F.lit(1))
    out = first_visit_table(df, order=["admittime", "hadm_id"], positive="one", row_first=True)
    return out.select("subject_id", "hadm_id", "admission_type")


# ---- scalar expressions ----------------------------------------------------------------------------------------------

@query("code_normalize", with_roles("diagnoses", body=f"""
SELECT {NORM_SQL} AS code, substr({NORM_SQL}, 1, 3) AS root, regexp_matches({NORM_SQL}, '^(I|4)') AS heart, count(*) AS n
FROM diagnoses GROUP BY ALL"""))
def code_normalize(spark, sf):
    code = S.normalize_code("icd_code")
    return role.diagnoses(spark, sf).groupBy(
        code.alias("code"), S.code_root(code).alias("root"), code.rlike("^(I|4)").alias("heart")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("time_diffs", with_roles("admissions", body="""
WITH t AS (SELECT *, lead(admittime) OVER (PARTITION BY subject_id ORDER BY admittime, hadm_id) - INTERVAL 7 HOUR AS nxt FROM admissions)
SELECT hadm_id, CAST(CAST(dischtime AS DATE) + 30 AS VARCHAR) AS limit_day, date_sub('day', dischtime, nxt) AS gap_days,
  date_sub('hour', dischtime, nxt) AS gap_hours, round((epoch_us(nxt) - epoch_us(dischtime)) / 86.4e9, 6) AS gap_frac,
  try_cast(CASE WHEN hadm_id % 7 = 0 THEN 'unknown' ELSE strftime(admittime, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS parsed
FROM t"""))
def time_diffs(spark, sf):
    adm = role.admissions(spark, sf)
    df = W.lead_next(adm, take={"nxt": "admittime"}).withColumn("nxt", F.expr("nxt - INTERVAL '7' HOUR"))
    text = F.when(F.col("hadm_id") % 7 == 0, "unknown").otherwise(F.date_format("admittime", "yyyy-MM-dd HH:mm:ss"))
    return df.select(
        "hadm_id", F.date_add(F.to_date("dischtime"), 30).cast("string").alias("limit_day"), S.whole_days("dischtime", "nxt").alias("gap_days"),
        S.whole_hours("dischtime", "nxt").alias("gap_hours"), r6(S.days_between("dischtime", "nxt")).alias("gap_frac"),
        S.parse_timestamp(text).cast("timestamp_ntz").alias("parsed"),
    )


@query("text_lengths", r"""SELECT doc_id, length(text) AS note_length, len(regexp_extract_all(text, '\S+')) AS word_count FROM documents""")
def text_lengths(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.length("text").cast("long").alias("note_length"), S.word_count("text").cast("long").alias("word_count")
    )


@query("penalty_class", """WITH t AS (SELECT CASE WHEN l_discount > 0.05 THEN l_discount ELSE 0 END AS l1, l_tax AS l2 FROM lineitem)
SELECT CASE WHEN l1 > 1e-12 AND l2 < 1e-12 THEN 'L1' WHEN l2 > 1e-12 AND l1 < 1e-12 THEN 'L2'
  WHEN l1 > 1e-12 AND l2 > 1e-12 THEN 'ElasticNet' ELSE 'None' END AS penalty, count(*) AS n FROM t GROUP BY 1""")
def penalty_class(spark, sf):
    l1 = F.when(F.col("l_discount") > 0.05, F.col("l_discount")).otherwise(0.0)
    return table(spark, sf, "lineitem").groupBy(S.penalty_class(l1, "l_tax").alias("penalty")).agg(
        F.count(F.lit(1)).alias("n")
    )
