"""Labels and cohort tables over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayline.functions import scalars as S
from stayline.operators.filters import valid_stays
from stayline.operators.aggregates import positive_rate
from stayline.plans import cohort as CO
from stayline.plans import labels as L
from stayline.sources import reference as R
from stayline.workload import roles as role
from stayline.workload.registry import query
from stayline.workload.relational import (
    CCI_FLAGS_SQL, CCI_RAW, CHARLSON_SQL, CHART_SQL, ELIX_RAW, ELIX_SQL, EX_FLAGS_SQL, LAB_LAST_ROWS_SQL, LAB_LAST_SQL,
    LAB_MINMAX_SQL, LAB_ROWS_SQL, VITAL_MEANS_SQL, WEIGHTS_SQL, r6,
)
from stayline.workload.roles import hash_sql, table, with_roles

NEXT_SQL = """nxt AS (SELECT subject_id, hadm_id, lead(hadm_id) OVER w AS next_hadm_id, lead(admittime) OVER w AS next_admittime,
  lead(admission_type) OVER w AS next_admission_type FROM admissions
  WINDOW w AS (PARTITION BY subject_id ORDER BY admittime, hadm_id))"""
LABEL_SQL = """date_sub('day', a.dischtime, n.next_admittime) AS days_to_next_admit,
  CASE WHEN n.next_admission_type <> 'ELECTIVE' AND date_sub('day', a.dischtime, n.next_admittime) BETWEEN 0 AND 30
    THEN 1 ELSE 0 END AS readmit_30days"""


@query("label_lead", with_roles("admissions", body=f"""WITH {NEXT_SQL}
SELECT a.hadm_id, n.next_hadm_id, {LABEL_SQL} FROM admissions a JOIN nxt n USING (subject_id, hadm_id)"""))
def label_lead(spark, sf):
    return L.label_lead(role.admissions(spark, sf)).select("hadm_id", "next_hadm_id", "days_to_next_admit", "readmit_30days")


@query("label_any_unplanned", with_roles("admissions", body="""
WITH f AS (SELECT i.hadm_id, min_by(a.hadm_id, (a.admittime, a.hadm_id)) AS next_hadm_id FROM admissions i JOIN admissions a
  ON a.subject_id = i.subject_id AND a.admittime > i.dischtime AND date_sub('day', i.dischtime, a.admittime) <= 30
  AND a.admission_type <> 'ELECTIVE' GROUP BY 1)
SELECT hadm_id, next_hadm_id, CASE WHEN next_hadm_id IS NULL THEN 0 ELSE 1 END AS readmit_30d_unplanned
FROM admissions LEFT JOIN f USING (hadm_id)"""))
def label_any_unplanned(spark, sf):
    stays = role.admissions(spark, sf)
    return L.label_any_unplanned(stays, stays).select("hadm_id", "next_hadm_id", "readmit_30d_unplanned")


@query("label_fractional", with_roles("admissions", body="""
WITH n AS (SELECT *, lead(admittime) OVER (PARTITION BY subject_id ORDER BY dischtime, hadm_id) AS nx FROM admissions),
d AS (SELECT hadm_id, (epoch_us(nx) - epoch_us(dischtime)) / 86.4e9 AS g FROM n)
SELECT hadm_id, round(g, 6) AS days_to_next_admit, CASE WHEN g BETWEEN 0 AND 30 THEN 1 ELSE 0 END AS readmit_30days FROM d"""))
def label_fractional(spark, sf):
    out = L.label_fractional(role.admissions(spark, sf))
    return out.select("hadm_id", r6("days_to_next_admit").alias("days_to_next_admit"), "readmit_30days")


@query("return_rate_by_segment", with_roles("admissions", body=f"""WITH {NEXT_SQL},
l AS (SELECT a.subject_id, {LABEL_SQL} FROM admissions a JOIN nxt n USING (subject_id, hadm_id)
  WHERE a.admittime IS NOT NULL AND a.dischtime IS NOT NULL AND a.deathtime IS NULL)
SELECT c_mktsegment AS segment, count(*) AS n, CAST(sum(readmit_30days) AS BIGINT) AS positives,
  CAST(sum(1 - readmit_30days) AS BIGINT) AS negatives, round(avg(readmit_30days), 6) AS pos_rate
FROM l JOIN customer ON c_custkey = subject_id GROUP BY 1"""))
def return_rate_by_segment(spark, sf):
    labelled = valid_stays(L.label_lead(role.admissions(spark, sf))).select("subject_id", "readmit_30days")
    people = table(spark, sf, "customer").selectExpr("c_custkey AS subject_id", "c_mktsegment AS segment")
    out = positive_rate(labelled.join(people, "subject_id"), "readmit_30days", ["segment"])
    return out.withColumn("pos_rate", r6("pos_rate"))


ROLES = ["admissions", "patients", "notes", "diagnoses", "procedures", "labs", "lab_items", "unit_stays", "vitals", "vital_items"]
CCI = list(R.CHARLSON_FLAGS.values())
EX = list(CO.ELIX_FLAGS.values())
LAB_COLS = [f"{n}_{s}" for n in R.LAB_LABELS for s in ("last", "min", "max")]
VITAL_COLS = list(R.VITAL_LABELS)
SEP = "chr(10) || chr(10) || '-----' || chr(10) || chr(10)"
COHORT_SQL = rf"""{NEXT_SQL},
base AS (SELECT a.* FROM admissions a LEFT JOIN patients p USING (subject_id)
  WHERE a.admittime IS NOT NULL AND a.dischtime IS NOT NULL AND a.deathtime IS NULL
    AND NOT (p.dod IS NOT NULL AND p.dod BETWEEN CAST(a.dischtime AS DATE) AND CAST(a.dischtime AS DATE) + 30)),
nt AS (SELECT subject_id, hadm_id, min(note_id) AS note_id,
    string_agg(text, {SEP} ORDER BY coalesce(charttime, storetime), note_id) AS note_text
  FROM notes WHERE text IS NOT NULL AND regexp_matches(trim(text), '\S') GROUP BY 1, 2),
dx AS (SELECT hadm_id, count(*) AS dx_count, count(DISTINCT icd_code) AS dx_code_uniq,
    count(DISTINCT substr(icd_code, 1, 3)) AS dx_root3_uniq FROM diagnoses GROUP BY 1),
px AS (SELECT hadm_id, count(*) AS proc_count, count(DISTINCT icd_code) AS proc_code_uniq,
    count(DISTINCT substr(icd_code, 1, 3)) AS proc_root3_uniq FROM procedures GROUP BY 1),
{CHARLSON_SQL}, {ELIX_SQL}, {WEIGHTS_SQL}, {CCI_RAW}, {ELIX_RAW},
cf AS (SELECT hadm_id, {CCI_FLAGS_SQL} FROM cci_raw GROUP BY 1),
ci AS (SELECT hadm_id, CAST(sum(DISTINCT weight) AS BIGINT) AS cci_score FROM cci_raw GROUP BY 1),
ef AS (SELECT hadm_id, {EX_FLAGS_SQL} FROM elix_raw GROUP BY 1),
es AS (SELECT hadm_id, CAST(sum(coalesce(weight, 0)) AS BIGINT) AS elix_vw_score FROM elix_raw LEFT JOIN weights USING (group_name) GROUP BY 1),
{LAB_ROWS_SQL}, {LAB_LAST_ROWS_SQL},
lm AS (SELECT hadm_id, {LAB_MINMAX_SQL} FROM lab_rows GROUP BY 1),
ll AS (SELECT hadm_id, {LAB_LAST_SQL} FROM lab_last_rows GROUP BY 1),
lw AS (SELECT * FROM lm FULL OUTER JOIN ll USING (hadm_id)),
ic AS (SELECT hadm_id, count(*) AS icu_stay_count FROM unit_stays GROUP BY 1),
{CHART_SQL},
vm AS (SELECT stay_id, {VITAL_MEANS_SQL} FROM chart GROUP BY 1),
cohort AS (SELECT CASE WHEN i.stay_id IS NULL THEN 'ADMISSION_ONLY' ELSE 'ICU_STAY' END AS row_grain,
    coalesce(CAST(i.stay_id AS VARCHAR), 'HADM_' || CAST(a.hadm_id AS VARCHAR)) AS grain_id,
    a.subject_id, a.hadm_id, a.admittime, a.dischtime, a.admission_type, n.next_hadm_id, n.next_admittime, n.next_admission_type,
    {LABEL_SQL}, coalesce(icu_stay_count, 0) AS icu_stay_count, nt.note_id, nt.note_text,
    dx_count, dx_code_uniq, dx_root3_uniq, proc_count, proc_code_uniq, proc_root3_uniq, {", ".join(CCI)},
    coalesce(cci_score, 0) AS cci_score, {", ".join(EX)}, coalesce(elix_vw_score, 0) AS elix_vw_score, {", ".join(LAB_COLS)},
    i.stay_id AS icu_stay_id, i.intime AS icu_intime, i.outtime AS icu_outtime, {", ".join(VITAL_COLS)},
    coalesce(map_art_mean, map_ni_mean) AS map_mean_pref
  FROM base a JOIN nt ON nt.subject_id = a.subject_id AND nt.hadm_id = a.hadm_id
  LEFT JOIN nxt n ON n.subject_id = a.subject_id AND n.hadm_id = a.hadm_id
  LEFT JOIN dx ON dx.hadm_id = a.hadm_id LEFT JOIN px ON px.hadm_id = a.hadm_id LEFT JOIN cf ON cf.hadm_id = a.hadm_id
  LEFT JOIN ci ON ci.hadm_id = a.hadm_id LEFT JOIN ef ON ef.hadm_id = a.hadm_id LEFT JOIN es ON es.hadm_id = a.hadm_id
  LEFT JOIN lw ON lw.hadm_id = a.hadm_id LEFT JOIN unit_stays i ON i.hadm_id = a.hadm_id
  LEFT JOIN ic ON ic.hadm_id = a.hadm_id LEFT JOIN vm ON vm.stay_id = i.stay_id
)"""
SAMPLED_SQL = COHORT_SQL.removesuffix(")") + f"WHERE {hash_sql('a.hadm_id')} % 1000 < 500 ORDER BY {hash_sql('grain_id')}, grain_id LIMIT 10000)"
ROUND_VITALS = ", ".join(f"round({c}, 6) AS {c}" for c in [*VITAL_COLS, "map_mean_pref"])


def cohort(spark, sf, **rules):
    return CO.cohort_admission({n: getattr(role, n)(spark, sf) for n in ROLES}, **rules)


def rounded_vitals(df):
    return df.withColumns({c: r6(c) for c in [*VITAL_COLS, "map_mean_pref"]})


@query("cohort_admission", with_roles(*ROLES, body=f"WITH {SAMPLED_SQL} SELECT * REPLACE ({ROUND_VITALS}) FROM cohort"))
def cohort_admission(spark, sf):
    return rounded_vitals(cohort(spark, sf, sample_bucket=500, limit=10_000))


@query("cohort_admission_whole", with_roles(*ROLES, body=f"WITH {COHORT_SQL} SELECT * REPLACE ({ROUND_VITALS}) FROM cohort"))
def cohort_admission_whole(spark, sf):
    """Every stay: no sample, no limit, and joins of bucketed feature tables."""
    return rounded_vitals(cohort(spark, sf, buckets=int(spark.conf.get("spark.sql.shuffle.partitions"))))


COLLAPSED = CO.VITALS
COLLAPSED_AGGS = ", ".join(
    f"""round(CASE WHEN sum(h) FILTER (WHERE {c} IS NOT NULL) > 0 THEN sum({c} * h) / sum(h) FILTER (WHERE {c} IS NOT NULL) END, 6) AS {c}_wmean,
  round(min({c}), 6) AS {c}_min, round(max({c}), 6) AS {c}_max"""
    for c in COLLAPSED
)


@query("collapsed_features", with_roles(*ROLES, body=rf"""WITH {COHORT_SQL},
t AS (SELECT *, CASE WHEN icu_outtime >= icu_intime THEN (epoch_us(icu_outtime) - epoch_us(icu_intime)) / 3.6e9 END AS h,
  CASE WHEN dischtime >= admittime THEN (epoch_us(dischtime) - epoch_us(admittime)) / 3.6e9 END AS los FROM cohort)
SELECT hadm_id, any_value(subject_id) AS subject_id, any_value(readmit_30days) AS readmit_30days, any_value(dx_count) AS dx_count,
  any_value(cci_score) AS cci_score, any_value(los) AS admit_to_disch_hours, count(DISTINCT icu_stay_id) AS icu_stay_count,
  round(coalesce(sum(h), 0), 6) AS total_icu_hours, min(icu_intime) AS first_icu_intime, max(icu_outtime) AS last_icu_outtime,
  {COLLAPSED_AGGS},
  CASE WHEN min(icu_intime) IS NOT NULL THEN round(greatest((epoch_us(min(icu_intime)) - epoch_us(any_value(admittime))) / 3.6e9, 0), 6) END AS time_to_first_icu_hours,
  CASE WHEN max(icu_outtime) IS NOT NULL THEN round(greatest((epoch_us(any_value(dischtime)) - epoch_us(max(icu_outtime))) / 3.6e9, 0), 6) END AS last_icu_to_discharge_hours,
  any_value(length(note_text)) AS note_length, any_value(len(regexp_extract_all(note_text, '\S+'))) AS word_count
FROM t GROUP BY 1"""))
def collapsed_features(spark, sf):
    out = CO.collapsed_features(cohort(spark, sf))
    rounded = ["total_icu_hours", "time_to_first_icu_hours", "last_icu_to_discharge_hours"]
    rounded += [f"{c}_{s}" for c in COLLAPSED for s in ("wmean", "min", "max")]
    return out.select(
        "hadm_id", "subject_id", "readmit_30days", "dx_count", "cci_score", "admit_to_disch_hours", "icu_stay_count",
        "first_icu_intime", "last_icu_outtime", *[r6(c).alias(c) for c in rounded],
        F.col("note_length").cast("long").alias("note_length"), F.col("word_count").cast("long").alias("word_count"),
    )


def patient_sql(extra: str, people: str = f"WHERE {hash_sql('subject_id')} % 1000 < 500 ORDER BY {hash_sql('subject_id')}, subject_id LIMIT 10000") -> str:
    return rf"""
WITH el AS (SELECT a.* FROM admissions a LEFT JOIN patients p USING (subject_id)
  WHERE a.admittime IS NOT NULL AND a.dischtime IS NOT NULL AND a.deathtime IS NULL {extra}),
ea AS (SELECT * FROM el QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY admittime, hadm_id) = 1),
fp AS (SELECT subject_id FROM ea {people}),
na AS (SELECT ea.subject_id, ea.hadm_id, min(a.admittime) AS t FROM ea JOIN admissions a ON a.subject_id = ea.subject_id
  AND a.admittime > ea.dischtime AND date_sub('day', ea.dischtime, a.admittime) <= 30 AND a.admission_type <> 'ELECTIVE' GROUP BY 1, 2),
dx AS (SELECT hadm_id, count(*) AS n_dx_codes FROM diagnoses GROUP BY 1),
px AS (SELECT hadm_id, count(*) AS n_px_codes FROM procedures GROUP BY 1),
hr AS (SELECT hadm_id, avg(valuenum) AS icu_mean_hr FROM vitals GROUP BY 1)
SELECT ea.subject_id, ea.hadm_id, date_sub('hour', ea.admittime, ea.dischtime) AS los_hours, n_dx_codes, n_px_codes,
  round(icu_mean_hr, 6) AS icu_mean_hr, CASE WHEN na.t IS NULL THEN 0 ELSE 1 END AS readmit_30d_unplanned
FROM ea LEFT JOIN na ON na.subject_id = ea.subject_id LEFT JOIN dx ON dx.hadm_id = ea.hadm_id
  LEFT JOIN px ON px.hadm_id = ea.hadm_id LEFT JOIN hr ON hr.hadm_id = ea.hadm_id
WHERE ea.subject_id IN (SELECT subject_id FROM fp)"""


SAMPLE = {"sample_bucket": 500, "target_n": 10_000}


def patient_cohort(spark, sf, **rules):
    heart = role.vitals(spark, sf).withColumnRenamed("valuenum", "heart_rate")
    out = CO.cohort_patient(
        role.admissions(spark, sf), role.diagnoses(spark, sf), role.procedures(spark, sf), heart, **rules
    )
    return out.withColumn("icu_mean_hr", r6("icu_mean_hr"))


@query("cohort_patient", with_roles("admissions", "patients", "diagnoses", "procedures", "vitals", body=patient_sql("")))
def cohort_patient(spark, sf):
    return patient_cohort(spark, sf, **SAMPLE)


@query("cohort_patient_whole", with_roles("admissions", "patients", "diagnoses", "procedures", "vitals", body=patient_sql("", "")))
def cohort_patient_whole(spark, sf):
    """Every person: no sample, no limit."""
    return patient_cohort(spark, sf)


@query("cohort_patient_rules", with_roles("admissions", "patients", "notes", "diagnoses", "procedures", "vitals", body=patient_sql(r"""
  AND NOT (p.dod IS NOT NULL AND p.dod BETWEEN CAST(a.dischtime AS DATE) AND CAST(a.dischtime AS DATE) + 30)
  AND a.hadm_id IN (SELECT hadm_id FROM notes WHERE text IS NOT NULL AND regexp_matches(trim(text), '\S'))""")))
def cohort_patient_rules(spark, sf):
    return patient_cohort(spark, sf, patients=role.patients(spark, sf), notes=role.notes(spark, sf), **SAMPLE)


EXTRACT = ["subject_id", "hadm_id", "admittime", "row_id", "stay_id", "intime", "admit_to_disch_hours"]


@query("first_visit_table", with_roles("admissions", "unit_stays", body=f"""
WITH t AS (SELECT a.subject_id, a.hadm_id, a.admittime, coalesce(stay_id, a.hadm_id * 10) AS row_id, stay_id, intime,
    (epoch_us(dischtime) - epoch_us(admittime)) / 3.6e9 AS admit_to_disch_hours FROM admissions a LEFT JOIN unit_stays u ON u.hadm_id = a.hadm_id),
k AS (SELECT subject_id, count(DISTINCT hadm_id) AS n FROM t GROUP BY 1),
m AS (SELECT subject_id, {", ".join(f"min_by({c}, (admittime, row_id)) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in EXTRACT[1:])}
  FROM t JOIN k USING (subject_id) WHERE n > 1 GROUP BY 1)
SELECT {", ".join(EXTRACT)} FROM (SELECT {", ".join(EXTRACT)} FROM t JOIN k USING (subject_id) WHERE n = 1
  UNION ALL SELECT {", ".join(EXTRACT)} FROM m) WHERE admit_to_disch_hours > 0"""))
def first_visit_table(spark, sf):
    stays = role.unit_stays(spark, sf)
    df = role.admissions(spark, sf).join(stays, "hadm_id", "left").select(
        "subject_id", "hadm_id", "admittime", F.coalesce("stay_id", F.col("hadm_id") * 10).alias("row_id"), "stay_id", "intime",
        S.negative_to_null(S.hours_between("admittime", "dischtime")).alias("admit_to_disch_hours"),
    )
    return CO.first_visit_table(df).select(*EXTRACT)
