"""The driver's tables in the roles the operators expect, in Spark and as SQL for the oracle.

Orders stand for stays, customers for persons, line items for codes and unit stays, events for lab values,
documents for notes. Both sides state the same mapping; whole tables are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.sources.tables import scan_table

# Test codes for the diagnosis role, chosen by part key.
CODES9 = ["410.1", "428.0", "443.9", "434", "290.0", "496", "725", "531.4", "571.2", "250.0", "250.4", "342", "583.7",
          "174.9", "197", "042", "V30", "425.4"]
CODES10 = ["I21.3", "I50.9", "I11.0", "G45", "F03", "J44.1", "M05.2", "K25", "K70.4", "E11.9", "E11.6", "G81", "N18.3",
           "C50", "C50.9", "C78", "B20", "F32.1", "I85.0", "Z00"]
LABS = ["WBC", "White Blood Cells", "Platelet Count", "Hemoglobin", "Sodium", "Potassium", "Chloride", "Bicarbonate",
        "Glucose", "Creatinine", "Urea Nitrogen", "Blood Urea Nitrogen", "Lactate", "Albumin", "Calcium"]
VITALS = ["Heart Rate", "Respiratory Rate", "SpO2", "O2 saturation pulseoxymetry", "Temperature Celsius",
          "Temperature Fahrenheit", "Arterial Blood Pressure mean", "Arterial Blood Pressure systolic",
          "Arterial Blood Pressure diastolic", "Non Invasive Blood Pressure mean",
          "Non Invasive Blood Pressure systolic", "Non Invasive Blood Pressure diastolic", "Weight"]


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def spark_list(values) -> str:
    return "array(" + ", ".join("'" + v + "'" for v in values) + ")"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return scan_table(spark, f"{sf}/{name}.parquet")


def admissions(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "o_custkey AS subject_id", "o_orderkey AS hadm_id", "o_orderdate AS admittime",
        "o_orderdate + make_dt_interval(int(o_orderkey % 10)) AS dischtime",
        "CASE WHEN o_orderstatus = 'P' THEN o_orderdate + make_dt_interval(int(o_orderkey % 10)) END AS deathtime",
        "CASE WHEN o_orderpriority = '5-LOW' THEN 'ELECTIVE' ELSE o_orderpriority END AS admission_type",
    )


def patients(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "c_custkey AS subject_id", "c_mktsegment AS sex",
        "CASE WHEN c_custkey % 17 = 0 THEN date_add(DATE '1995-01-01', int(c_custkey % 2000)) END AS dod",
        "date_add(DATE '1930-01-01', int(c_custkey * 7 % 20000)) AS birth_date",
    )


def notes(spark, sf) -> DataFrame:
    """Two documents per stay; every third has no chart time."""
    docs = table(spark, sf, "documents").selectExpr(
        "doc_id DIV 2 AS hadm_id", "doc_id AS note_id", "text",
        "CASE WHEN doc_id % 3 > 0 THEN TIMESTAMP_NTZ '2020-01-01' + make_dt_interval(int(doc_id * 37 % 100)) END AS charttime",
        "TIMESTAMP_NTZ '2020-02-01' + make_dt_interval(int(doc_id % 10)) AS storetime",
    )
    people = table(spark, sf, "orders").selectExpr("o_orderkey AS hadm_id", "o_custkey AS subject_id")
    return docs.join(people, "hadm_id")


def diagnoses(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS hadm_id",
        f"CASE WHEN l_linenumber % 2 = 0 THEN element_at({spark_list(CODES9)}, int(l_partkey % {len(CODES9)}) + 1) "
        f"ELSE element_at({spark_list(CODES10)}, int(l_partkey % {len(CODES10)}) + 1) END AS icd_code",
        "int(9 + l_linenumber % 2) AS icd_version",
    )


def procedures(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS hadm_id", "cast(10000 + l_suppkey * 7 AS string) AS icd_code", "int(9 + l_linenumber % 2) AS icd_version"
    )


def labs(spark, sf) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "event_id", "user_id AS hadm_id", "int(regexp_extract(props, '([0-9]+)', 1)) AS itemid", "ts AS charttime",
        "value AS valuenum", "event_type",
    )


def lab_items(spark, sf) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "int(p_partkey) AS itemid", f"element_at({spark_list(LABS)}, int(p_partkey % {len(LABS)}) + 1) AS label"
    )


def unit_stays(spark, sf) -> DataFrame:
    """Lines as unit stays; (order, line) repeats in the data, so it is merged first."""
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.min("l_shipdate").alias("intime"), F.max("l_quantity").alias("q"))
        .selectExpr(
            "l_orderkey AS hadm_id", "l_orderkey * 10 + l_linenumber AS stay_id", "intime",
            "intime + make_dt_interval(0, int(q)) AS outtime",
        )
    )


def vitals(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS stay_id", "l_orderkey AS hadm_id", "l_partkey AS itemid",
        "l_quantity + 60 AS valuenum",
    )


def vital_items(spark, sf) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS itemid", f"element_at({spark_list(VITALS)}, int(p_partkey % {len(VITALS)}) + 1) AS label",
        "CASE WHEN p_size > 5 THEN 'chartevents' ELSE 'procedureevents' END AS linksto",
    )


def durations(spark, sf) -> DataFrame:
    """Hours from order to last shipment, with real negatives and gaps (orders without lines)."""
    last = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_ship"))
    return table(spark, sf, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left").selectExpr(
        "o_orderkey AS hadm_id", "o_custkey AS subject_id", "o_totalprice",
        "(unix_micros(cast(last_ship as timestamp)) - unix_micros(cast(o_orderdate as timestamp))) / 3.6e9D AS hours",
    )


def scored(spark, sf) -> DataFrame:
    """Labelled documents with a score in (0, 1] that ties often: short texts score high."""
    return (
        table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
        .selectExpr("doc_id", "toxic", "quality", "lang", "n_chars", "round(100D / (100 + n_chars % 977), 2) AS prob")
    )


SQL = {
    "admissions": """admissions AS (
  SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, o_orderdate AS admittime,
    o_orderdate + (o_orderkey % 10) * INTERVAL 1 DAY AS dischtime,
    CASE WHEN o_orderstatus = 'P' THEN o_orderdate + (o_orderkey % 10) * INTERVAL 1 DAY END AS deathtime,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'ELECTIVE' ELSE o_orderpriority END AS admission_type
  FROM orders)""",
    "patients": """patients AS (
  SELECT c_custkey AS subject_id, c_mktsegment AS sex,
    CASE WHEN c_custkey % 17 = 0 THEN DATE '1995-01-01' + CAST(c_custkey % 2000 AS INTEGER) END AS dod,
    DATE '1930-01-01' + CAST(c_custkey * 7 % 20000 AS INTEGER) AS birth_date
  FROM customer)""",
    "notes": """notes AS (
  SELECT doc_id // 2 AS hadm_id, o_custkey AS subject_id, doc_id AS note_id, text,
    CASE WHEN doc_id % 3 > 0 THEN TIMESTAMP '2020-01-01' + (doc_id * 37 % 100) * INTERVAL 1 DAY END AS charttime,
    TIMESTAMP '2020-02-01' + (doc_id % 10) * INTERVAL 1 DAY AS storetime
  FROM documents JOIN orders ON o_orderkey = doc_id // 2)""",
    "diagnoses": f"""diagnoses AS (
  SELECT l_orderkey AS hadm_id,
    CASE WHEN l_linenumber % 2 = 0 THEN {sql_list(CODES9)}[l_partkey % {len(CODES9)} + 1]
      ELSE {sql_list(CODES10)}[l_partkey % {len(CODES10)} + 1] END AS icd_code,
    9 + l_linenumber % 2 AS icd_version
  FROM lineitem)""",
    "procedures": """procedures AS (
  SELECT l_orderkey AS hadm_id, CAST(10000 + l_suppkey * 7 AS VARCHAR) AS icd_code, 9 + l_linenumber % 2 AS icd_version
  FROM lineitem)""",
    "labs": """labs AS (
  SELECT event_id, user_id AS hadm_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS itemid,
    ts AS charttime, value AS valuenum, event_type
  FROM events)""",
    "lab_items": f"""lab_items AS (
  SELECT p_partkey AS itemid, {sql_list(LABS)}[p_partkey % {len(LABS)} + 1] AS label FROM part)""",
    "unit_stays": """unit_stays AS (
  SELECT l_orderkey AS hadm_id, l_orderkey * 10 + l_linenumber AS stay_id, min(l_shipdate) AS intime,
    min(l_shipdate) + CAST(max(l_quantity) AS INTEGER) * INTERVAL 1 HOUR AS outtime
  FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
    "vitals": """vitals AS (
  SELECT l_orderkey * 10 + l_linenumber AS stay_id, l_orderkey AS hadm_id, l_partkey AS itemid,
    l_quantity + 60 AS valuenum
  FROM lineitem)""",
    "vital_items": f"""vital_items AS (
  SELECT p_partkey AS itemid, {sql_list(VITALS)}[p_partkey % {len(VITALS)} + 1] AS label,
    CASE WHEN p_size > 5 THEN 'chartevents' ELSE 'procedureevents' END AS linksto
  FROM part)""",
    "durations": """durations AS (
  SELECT o_orderkey AS hadm_id, o_custkey AS subject_id, o_totalprice,
    (epoch_us(last_ship) - epoch_us(o_orderdate)) / 3.6e9 AS hours
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)""",
    "scored": """scored AS (
  SELECT doc_id, toxic, quality, lang, n_chars, round(100e0 / (100 + n_chars % 977), 2) AS prob
  FROM labels JOIN documents USING (doc_id))""",
}


def with_roles(*names: str, body: str) -> str:
    """Oracle text: the named roles as common table expressions before the body."""
    ctes = ",\n".join(SQL[n] for n in names)
    rest = body.strip()
    if rest.upper().startswith("WITH "):
        return f"WITH {ctes},\n{rest[5:]}"
    return f"WITH {ctes}\n{rest}"


def hash_sql(expr: str, seed=None) -> str:
    text = f"CAST({expr} AS VARCHAR)"
    if seed is not None:
        text = f"'{seed}:' || {text}"
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"
