"""Profiles, samples, splits, bins, scalers and metrics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayline.operators import binning as B
from stayline.operators import metrics as ME
from stayline.operators import profile as P
from stayline.operators import sampling as SA
from stayline.operators import scaling as SC
from stayline.operators.limits import cap_entities, union_all
from stayline.sources.tables import load_splits, save_splits
from stayline.session import shared_folder
from stayline.workload import roles as role
from stayline.workload.registry import query
from stayline.workload.relational import r6
from stayline.workload.roles import hash_sql, table, with_roles

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


# ---- profiles --------------------------------------------------------------------------------------------------------

@query("nunique", """SELECT user_id, count(DISTINCT event_type) AS n_unique FROM events GROUP BY 1
HAVING count(DISTINCT event_type) > 4""")
def nunique(spark, sf):
    return P.nunique(table(spark, sf, "events"), "user_id", "event_type", more_than=4)


@query("value_counts", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1")
def value_counts(spark, sf):
    return P.value_counts(table(spark, sf, "orders"), "o_orderpriority")


@query("multiplicity_summary", """
SELECT 'lines per order' AS what, CASE WHEN n >= 3 THEN '3+' ELSE CAST(n AS VARCHAR) END AS multiplicity, count(*) AS n_keys
FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1, 2
UNION ALL
SELECT 'suppliers per order', CASE WHEN n >= 3 THEN '3+' ELSE CAST(n AS VARCHAR) END, count(*)
FROM (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) GROUP BY 1, 2""")
def multiplicity_summary(spark, sf):
    lines = table(spark, sf, "lineitem")
    rows = P.multiplicity_summary(lines, "l_orderkey").select(F.lit("lines per order").alias("what"), "*")
    supp = P.multiplicity_summary(lines, "l_orderkey", "l_suppkey").select(F.lit("suppliers per order").alias("what"), "*")
    return rows.unionByName(supp)


@query("missing_table", with_roles("admissions", "durations", body="""
WITH t AS (SELECT a.hadm_id, deathtime, hours FROM admissions a LEFT JOIN durations d ON d.hadm_id = a.hadm_id)
SELECT variable, n_missing, round(n_missing / n, 6) AS pct_missing FROM (
  SELECT 'deathtime' AS variable, count(*) FILTER (WHERE deathtime IS NULL) AS n_missing, count(*) AS n FROM t
  UNION ALL SELECT 'hours', count(*) FILTER (WHERE hours IS NULL), count(*) FROM t
  UNION ALL SELECT 'hadm_id', count(*) FILTER (WHERE hadm_id IS NULL), count(*) FROM t) WHERE n_missing > 0"""))
def missing_table(spark, sf):
    d = role.durations(spark, sf).select("hadm_id", "hours")
    df = role.admissions(spark, sf).select("hadm_id", "deathtime").join(d, "hadm_id", "left")
    return P.missing_table(df).withColumn("pct_missing", r6("pct_missing"))


@query("duplicate_rows", """WITH d AS (SELECT *, count(*) OVER (PARTITION BY text) AS n_copies,
  min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents)
SELECT doc_id, n_copies, doc_id > first_id AS is_extra FROM d WHERE n_copies > 1""")
def duplicate_rows(spark, sf):
    return P.duplicate_rows(table(spark, sf, "documents"), ["text"], "doc_id").select("doc_id", "n_copies", "is_extra")


@query("duplicate_count", """SELECT CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM
  (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)""")
def duplicate_count(spark, sf):
    return P.duplicate_count(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def describe_sql(cols, tab):
    return "\nUNION ALL ".join(
        f"""SELECT '{c}' AS variable, count({c}) AS "count", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
  min({c}) AS "min", round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
  round(quantile_cont({c}, 0.75), 6) AS p75, max({c}) AS "max" FROM {tab}"""
        for c in cols
    )


@query("describe", describe_sql(NUMERIC, "lineitem"))
def describe(spark, sf):
    out = P.describe(table(spark, sf, "lineitem"), NUMERIC)
    return out.withColumns({c: r6(c) for c in ("mean", "std", "p25", "p50", "p75")})


@query("histogram", """WITH r AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 50 AS w FROM orders),
c AS (SELECT least(CAST(floor((o_totalprice - lo) / w) AS INTEGER), 49) AS bin, count(*) AS n FROM orders, r GROUP BY 1)
SELECT CAST(g.bin AS INTEGER) AS bin, round(lo + g.bin * w, 4) AS "left", round(lo + (g.bin + 1) * w, 4) AS "right", coalesce(n, 0) AS n
FROM range(50) g(bin) CROSS JOIN r LEFT JOIN c ON c.bin = g.bin""")
def histogram(spark, sf):
    out = P.histogram(table(spark, sf, "orders"), "o_totalprice", 50)
    return out.withColumns({"left": F.round("left", 4), "right": F.round("right", 4)})


@query("constant_columns", """SELECT * FROM (
  SELECT 'role' AS variable, count(DISTINCT role) AS k FROM conversations
  UNION ALL SELECT 'turn', count(DISTINCT turn) FROM conversations
  UNION ALL SELECT 'zero', count(DISTINCT turn * 0) FROM conversations
  UNION ALL SELECT 'gap', count(DISTINCT CASE WHEN turn < 0 THEN 1 END) + 1 FROM conversations) WHERE k <= 1""")
def constant_columns(spark, sf):
    df = table(spark, sf, "conversations").selectExpr("role", "turn", "turn * 0 AS zero", "CASE WHEN turn < 0 THEN 1 END AS gap")
    names = P.constant_columns(df)
    seen = df.agg(*[F.greatest(F.count_distinct(c), F.lit(1)).alias(c) for c in names])
    return seen.unpivot([], names, "variable", "k")


# ---- sampling --------------------------------------------------------------------------------------------------------

@query("hash_bucket_sample", f"SELECT o_orderkey FROM orders WHERE {hash_sql('o_orderkey')} % 1000 < 500")
def hash_bucket_sample(spark, sf):
    return SA.hash_bucket_sample(table(spark, sf, "orders"), "o_orderkey").select("o_orderkey")


@query("patient_capped_cohort", f"""WITH p AS (SELECT DISTINCT o_custkey FROM orders WHERE {hash_sql('o_custkey')} % 1000 < 500
  ORDER BY {hash_sql('o_custkey')}, o_custkey LIMIT 400)
SELECT o_custkey, count(*) AS n_orders FROM orders WHERE o_custkey IN (SELECT o_custkey FROM p) GROUP BY 1""")
def patient_capped_cohort(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    people = cap_entities(SA.hash_bucket_sample(orders, "o_custkey"), "o_custkey", 400)
    kept = orders.join(F.broadcast(people), "o_custkey", "left_semi")  # at most 400 keys
    return kept.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))


@query("train_test_split", f"""SELECT o_orderkey, CASE WHEN {hash_sql('o_orderkey', 42)} / 4294967296.0 < 0.3 THEN 'test' ELSE 'train' END AS split
FROM orders""")
def train_test_split(spark, sf):
    return SA.train_test_split(table(spark, sf, "orders"), "o_orderkey").select("o_orderkey", "split")


RANKED = f"""r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {hash_sql('doc_id', 42)}, doc_id) AS rk,
  count(*) OVER (PARTITION BY toxic) AS size FROM labels)"""


@query("stratified_split", f"""WITH {RANKED}
SELECT doc_id, toxic, CASE WHEN rk <= round(size * 0.2) THEN 'test' ELSE 'train' END AS split FROM r""")
def stratified_split(spark, sf):
    return SA.stratified_split(table(spark, sf, "labels"), "doc_id", "toxic").select("doc_id", "toxic", "split")


@query("stratified_kfold", f"WITH {RANKED} SELECT doc_id, toxic, CAST((rk - 1) % 5 AS INTEGER) AS fold FROM r")
def stratified_kfold(spark, sf):
    return SA.stratified_kfold(table(spark, sf, "labels"), "doc_id", "toxic").select("doc_id", "toxic", "fold")


RARE = "CASE WHEN o_totalprice > 480000 THEN 1 ELSE 0 END"


@query("keep_pos_sample_neg", f"""WITH t AS (SELECT o_orderkey, {RARE} AS y FROM orders)
SELECT o_orderkey, y FROM t WHERE y = 1
UNION ALL (SELECT o_orderkey, y FROM t WHERE y = 0 ORDER BY {hash_sql('o_orderkey', 42)}, o_orderkey LIMIT 1000)""")
def keep_pos_sample_neg(spark, sf):
    df = table(spark, sf, "orders").selectExpr("o_orderkey", f"{RARE} AS y")
    return SA.keep_pos_sample_neg(df, "o_orderkey", "y")


@query("cap_rows_stratified", f"""WITH n AS (SELECT count(*) AS n FROM labels), {RANKED}
SELECT doc_id, toxic FROM r, n WHERE rk <= round(size * (200e0 / n))""")
def cap_rows_stratified(spark, sf):
    return SA.cap_rows_stratified(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "toxic", 200)


@query("random_oversample", f"""WITH {RANKED},
m AS (SELECT rk, doc_id, toxic, size FROM r WHERE toxic = 1),
s AS (SELECT max(size) AS m, (SELECT CAST(floor(0.5 * max(size)) AS BIGINT) FROM r WHERE toxic = 0) AS target FROM m),
d AS (SELECT i AS draw, CAST('0x' || substr(md5('42:' || CAST(i AS VARCHAR)), 1, 8) AS BIGINT) % m + 1 AS rk
  FROM s, range(0, 1000000) g(i) WHERE i < target - m)
SELECT doc_id, toxic, CAST(NULL AS BIGINT) AS draw FROM labels
UNION ALL SELECT doc_id, toxic, draw FROM d JOIN m USING (rk)""")
def random_oversample(spark, sf):
    return SA.random_oversample(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "toxic")


@query("index_union", f"""WITH t AS (SELECT doc_id, toxic FROM labels)
SELECT doc_id FROM t WHERE toxic = 1 UNION ALL SELECT doc_id FROM t WHERE toxic = 0 AND {hash_sql('doc_id', 7)} % 10 < 3""")
def index_union(spark, sf):
    df = table(spark, sf, "labels")
    negatives = SA.hash_bucket_sample(df.filter("toxic = 0"), "doc_id", 10, 3, seed=7)
    return SA.label_union(df.filter("toxic = 1"), negatives, ["doc_id"])


@query("save_splits", f"""SELECT CASE WHEN {hash_sql('doc_id', 42)} / 4294967296.0 < 0.3 THEN 'test' ELSE 'train' END AS part,
  count(*) AS n, CAST(sum(toxic) AS BIGINT) AS positives FROM labels GROUP BY 1""")
def splits(spark, sf):
    path = shared_folder(spark)
    df = SA.train_test_split(table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id")
    save_splits({"base": df}, path)
    parts = load_splits(spark, path, "base", "toxic")
    return parts["y_train"].withColumn("part", F.lit("train")).unionByName(
        parts["y_test"].withColumn("part", F.lit("test"))
    ).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").cast("long").alias("positives"))


@query("split_contents", f"""WITH l AS (SELECT *, CASE WHEN {hash_sql('doc_id', 42)} / 4294967296.0 < 0.3 THEN 'test' ELSE 'train' END AS part FROM labels),
o AS (SELECT *, CASE WHEN {hash_sql('o_orderkey', 42)} / 4294967296.0 < 0.3 THEN 'test' ELSE 'train' END AS part FROM orders)
SELECT 'labels' AS dataset, 'X_' || part AS frame, doc_id AS id, quality AS value FROM l
UNION ALL SELECT 'labels', 'y_' || part, NULL, toxic FROM l
UNION ALL SELECT 'orders', 'X_' || part, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) FROM o UNION ALL SELECT 'orders', 'y_' || part, NULL, o_custkey FROM o""")
def split_contents(spark, sf):
    """Every row of two saved datasets, frame by frame."""
    path = shared_folder(spark)
    labels = SA.train_test_split(table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id")
    orders = SA.train_test_split(table(spark, sf, "orders").select("o_orderkey", F.floor("o_totalprice").alias("price"), "o_custkey"), "o_orderkey")
    save_splits({"labels": labels, "orders": orders}, path)
    parts = []
    for name, id_col, value, label in (("labels", "doc_id", "quality", "toxic"), ("orders", "o_orderkey", "price", "o_custkey")):
        for frame, df in load_splits(spark, path, name, label).items():
            shown = [F.col(id_col), F.col(value)] if frame.startswith("X") else [F.lit(None), F.col(label)]
            parts.append(df.select(
                F.lit(name).alias("dataset"), F.lit(frame).alias("frame"), shown[0].cast("long").alias("id"), shown[1].cast("long").alias("value")
            ))
    return union_all(*parts)


# ---- bins and scaling ------------------------------------------------------------------------------------------------

def bins_sql(source: str, value: str, target: str, first: int = 0, zero: str = "") -> str:
    """Five quantile bins as an oracle; labels with edges rounded to three decimals, the lowest lowered by .001."""
    return f"""
q AS (SELECT unnest(quantile_cont({value}, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS e FROM {source}),
e AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS k FROM (SELECT DISTINCT e FROM q)),
b AS (SELECT a.k AS bin_no, a.e AS lo, z.e AS hi,
  printf('%.2f', round(a.e, 3) - CASE WHEN a.k = 0 THEN 0.001e0 ELSE 0e0 END) || '-' || printf('%.2f', round(z.e, 3)) AS bin
  FROM e a JOIN e z ON z.k = a.k + 1)
SELECT CAST(bin_no + {first} AS INTEGER) AS bin_no, bin, round(avg({target}), 6) AS rate, count(*) AS n, round(100 * avg({target}), 6) AS pct
FROM {source} JOIN b ON {value} <= hi AND ({value} > lo OR bin_no = 0 AND {value} >= lo) GROUP BY bin_no, bin {zero}"""


def rounded(df):
    return df.withColumns({"rate": r6("rate"), "pct": r6("pct")})


@query("quantile_bin_rate", with_roles("durations", body=f"""
WITH t AS (SELECT hours, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS y FROM durations WHERE hours IS NOT NULL),
{bins_sql('t', 'hours', 'y')}"""))
def quantile_bin_rate(spark, sf):
    df = role.durations(spark, sf).selectExpr("hours", "CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS y")
    return rounded(B.quantile_bin_rate(df, "hours", "y"))


@query("discrete_overflow_bin", """WITH t AS (SELECT coalesce(n, 0) AS n, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS y
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
SELECT CAST(least(n, 5) AS INTEGER) AS bin_no, CASE WHEN n >= 5 THEN '5+' ELSE CAST(n AS VARCHAR) END AS bin,
  round(avg(y), 6) AS rate, count(*) AS n, round(100 * avg(y), 6) AS pct FROM t GROUP BY 1, 2""")
def discrete_overflow_bin(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
    df = table(spark, sf, "orders").join(lines, "o_orderkey", "left")
    return rounded(B.discrete_overflow_bin(df.selectExpr("lines", "CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS y"), "lines", "y"))


@query("zero_own_bin", with_roles("durations", body=f"""
WITH t AS (SELECT greatest(hours, 0) AS hours, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS y FROM durations
  WHERE hours IS NOT NULL), nz AS (SELECT * FROM t WHERE hours <> 0),
{bins_sql('nz', 'hours', 'y', 1, "UNION ALL SELECT 0, '0', round(avg(y), 6), count(*), round(100 * avg(y), 6) FROM t WHERE hours = 0")}"""))
def zero_own_bin(spark, sf):
    df = role.durations(spark, sf).selectExpr(
        "CASE WHEN hours < 0 THEN 0D ELSE hours END AS hours", "CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS y"
    )
    return rounded(B.zero_own_bin(df, "hours", "y"))


PROFILE = {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "l_discount": "l_discount",
           "l_tax": "CASE WHEN l_tax > 0.07 THEN l_tax * 50 ELSE l_tax END", "lines": "CAST(l_linenumber AS DOUBLE)",
           "flat": "l_tax * 0"}
PROFILE_SQL = ", ".join(f"{e} AS {c}" for c, e in PROFILE.items())
ORDINAL = ["lines"]


def stats_sql() -> str:
    return f"WITH t AS (SELECT {PROFILE_SQL} FROM lineitem), s AS (" + "\nUNION ALL ".join(
        f"""SELECT '{c}' AS variable, count({c}) AS n, any_value(q1) AS q1, any_value(q3) AS q3, any_value(q3 - q1) AS iqr,
  count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers,
  max({c}) - min({c}) AS "range", {'NULL' if c == 'flat' else f'skewness({c})'} AS skewness,
  {'NULL' if c == 'flat' else f'kurtosis({c})'} AS kurtosis,
  CASE WHEN any_value(q3 - q1) <> 0 THEN (max({c}) - min({c})) / any_value(q3 - q1) END AS range_per_iqr
FROM t, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM t)"""
        for c in PROFILE
    ) + ")"


STAT_COLS = ["q1", "q3", "iqr", "range", "skewness", "kurtosis", "range_per_iqr"]


@query("scaler_stats", stats_sql() + ' SELECT variable, n, outliers, ' + ", ".join(f'round("{c}", 6) AS "{c}"' for c in STAT_COLS) + " FROM s")
def scaler_stats(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in PROFILE.items()])
    return SC.scaler_stats(df, list(PROFILE)).withColumns({c: r6(c) for c in STAT_COLS})


@query("assign_scalers", stats_sql() + """
SELECT variable, CASE WHEN variable = 'lines' AND outliers > 10 THEN 'RobustScaler' WHEN variable = 'lines' THEN 'MinMaxScaler'
  WHEN outliers < 5 AND abs(skewness) < 0.5 AND abs(kurtosis) < 3 AND "range" < 5 * iqr THEN 'StandardScaler'
  WHEN outliers < 5 AND abs(skewness) < 0.5 AND "range" < 10 * iqr THEN 'MinMaxScaler'
  WHEN abs(skewness) > 1 AND kurtosis > 2 THEN 'LogTransform'
  WHEN outliers > 5 OR "range" > 10 * iqr OR abs(skewness) > 0.5 THEN 'RobustScaler' ELSE 'MinMaxScaler' END AS scaler FROM s""")
def assign_scalers(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in PROFILE.items()])
    return SC.assign_scalers(SC.scaler_stats(df, list(PROFILE)), ORDINAL).select("variable", "scaler")


@query("scaler_reasons", stats_sql() + """
SELECT variable, CASE WHEN variable = 'lines' AND outliers > 10 THEN '1: ordinal, more than 10 outliers' WHEN variable = 'lines' THEN '2: ordinal'
  WHEN outliers < 5 AND abs(skewness) < 0.5 AND abs(kurtosis) < 3 AND "range" < 5 * iqr THEN '3: few outliers, near normal, narrow'
  WHEN outliers < 5 AND abs(skewness) < 0.5 AND "range" < 10 * iqr THEN '4: few outliers, little skew'
  WHEN abs(skewness) > 1 AND kurtosis > 2 THEN '5: strong skew and heavy tail'
  WHEN outliers > 5 OR "range" > 10 * iqr OR abs(skewness) > 0.5 THEN '6: outliers, skew or a wide range' ELSE '7: none of the above' END AS why FROM s""")
def scaler_reasons(spark, sf):
    """The rule that chose each column's scaler."""
    df = table(spark, sf, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in PROFILE.items()])
    return SC.assign_scalers(SC.scaler_stats(df, list(PROFILE)), ORDINAL).select("variable", "why")


METHODS = {"l_quantity": "MinMaxScaler", "l_extendedprice": "RobustScaler", "l_discount": "StandardScaler", "l_tax": "LogTransform"}


@query("scale_features", f"""WITH t AS (SELECT *, {hash_sql('l_orderkey', 42)} / 4294967296.0 < 0.3 AS test FROM lineitem),
f AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, avg(l_discount) AS m, stddev_pop(l_discount) AS s,
  quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS q2, quantile_cont(l_extendedprice, 0.75) AS q3
  FROM t WHERE NOT test)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN test THEN 'test' ELSE 'train' END AS split,
  round((l_quantity - a) / (b - a), 6) AS l_quantity, round((l_extendedprice - q2) / (q3 - q1), 6) AS l_extendedprice,
  round((l_discount - m) / s, 6) AS l_discount, round(ln(1 + l_tax), 6) AS l_tax FROM t, f""")
def scale_features(spark, sf):
    df = SA.train_test_split(table(spark, sf, "lineitem"), "l_orderkey")
    train, test = SC.scale_features(df.filter("split = 'train'"), df.filter("split = 'test'"), METHODS)
    return train.unionByName(test).select(
        "l_orderkey", "l_linenumber", "l_partkey", "split", *[r6(c).alias(c) for c in METHODS]
    )


@query("cyclic_month", """SELECT o_orderkey, round(sin(2 * pi() * month(o_orderdate) / 12), 6) AS month_sin,
  round(cos(2 * pi() * month(o_orderdate) / 12), 6) AS month_cos FROM orders""")
def cyclic_month(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.month("o_orderdate").alias("month"))
    return SC.cyclic_month(df, "month").withColumns({"month_sin": r6("month_sin"), "month_cos": r6("month_cos")})


@query("year_offset", f"""WITH t AS (SELECT o_orderkey, year(o_orderdate) AS y, {hash_sql('o_orderkey', 42)} / 4294967296.0 < 0.3 AS test FROM orders)
SELECT o_orderkey, y - (SELECT min(y) FROM t WHERE NOT test) AS order_year FROM t""")
def year_offset(spark, sf):
    df = SA.train_test_split(table(spark, sf, "orders"), "o_orderkey").select(
        "o_orderkey", F.year("o_orderdate").cast("long").alias("order_year"), "split"
    )
    train, test = SC.year_offset(df.filter("split = 'train'"), df.filter("split = 'test'"), "order_year")
    return train.unionByName(test).drop("split")


# ---- metrics ---------------------------------------------------------------------------------------------------------

CURVE = """s AS (SELECT prob, count(*) FILTER (WHERE toxic = 1) AS p, count(*) FILTER (WHERE toxic = 0) AS n FROM scored GROUP BY 1),
c AS (SELECT prob AS threshold, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg
  FROM s WINDOW w AS (ORDER BY prob DESC)),
m AS (SELECT *, tp / (tp + fp) AS precision, tp / pos AS recall,
  CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / (tp + fp)) * (tp / pos) / (tp / (tp + fp) + tp / pos) END AS f1,
  CASE WHEN tp = 0 THEN 0 ELSE 5 * (tp / (tp + fp)) * (tp / pos) / (4 * tp / (tp + fp) + tp / pos) END AS f2 FROM c)"""


def scored(spark, sf):
    return role.scored(spark, sf)


@query("pr_curve", with_roles("scored", body=f"""
WITH {CURVE} SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(precision, 6) AS precision, round(recall, 6) AS recall FROM m"""))
def pr_curve(spark, sf):
    return ME.pr_curve(scored(spark, sf), "toxic").select(
        "threshold", "tp", "fp", r6("precision").alias("precision"), r6("recall").alias("recall")
    )


@query("average_precision", with_roles("scored", body=f"WITH {CURVE} SELECT round(sum(precision * p / pos), 6) AS average_precision FROM m"))
def average_precision(spark, sf):
    return ME.average_precision(scored(spark, sf), "toxic").select(r6("average_precision").alias("average_precision"))


@query("roc_auc", with_roles("scored", body="""
WITH r AS (SELECT toxic, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2 AS mid FROM scored),
k AS (SELECT sum(toxic) AS p, sum(1 - toxic) AS n FROM scored)
SELECT round((sum(mid) FILTER (WHERE toxic = 1) - any_value(p * (p + 1) / 2)) / any_value(p * n), 6) AS roc_auc FROM r, k"""))
def roc_auc(spark, sf):
    return ME.roc_auc(scored(spark, sf), "toxic").select(r6("roc_auc").alias("roc_auc"))


@query("threshold_metrics", with_roles("scored", body="""
WITH k AS (SELECT count(*) FILTER (WHERE prob >= 0.2 AND toxic = 1) AS tp, count(*) FILTER (WHERE prob >= 0.2 AND toxic = 0) AS fp,
  count(*) FILTER (WHERE prob < 0.2 AND toxic = 1) AS fn, count(*) FILTER (WHERE prob < 0.2 AND toxic = 0) AS tn FROM scored)
SELECT 0.2e0 AS threshold, tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM k"""))
def threshold_metrics(spark, sf):
    out = ME.threshold_metrics(scored(spark, sf), 0.2, "toxic")
    return out.withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


def pick(order: str, name: str, threshold: str = "threshold") -> str:
    return f"""(SELECT '{name}' AS strategy, {threshold} AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall
  FROM m ORDER BY {order}, threshold LIMIT 1)"""


@query("select_threshold", with_roles("scored", body=f"""WITH {CURVE}
{pick('round(f1, 12) DESC', 'f1')} UNION ALL {pick('round(f2, 12) DESC', 'fbeta')}
UNION ALL {pick('recall >= 0.6 DESC, CASE WHEN recall >= 0.6 THEN precision ELSE recall END DESC', 'precision_at_recall')}
UNION ALL {pick('precision >= 0.15 DESC, CASE WHEN precision >= 0.15 THEN recall ELSE precision END DESC', 'recall_at_precision')}
UNION ALL {pick('round(f1, 12) DESC', 'f1_shifted', 'coalesce((SELECT max(prob) FROM scored WHERE prob < m.threshold), 0)')}"""))
def select_threshold(spark, sf):
    df = scored(spark, sf)
    picks = [
        ME.select_threshold(df, "f1", label="toxic"),
        ME.select_threshold(df, "fbeta", beta=2.0, label="toxic"),
        ME.select_threshold(df, "precision_at_recall", min_recall=0.6, label="toxic"),
        ME.select_threshold(df, "recall_at_precision", min_precision=0.15, label="toxic"),
        ME.select_threshold(df, "f1", label="toxic", compat_shift=True).withColumn("strategy", F.lit("f1_shifted")),
    ]
    out = picks[0]
    for p in picks[1:]:
        out = out.unionByName(p)
    return out.select("strategy", "threshold", r6("precision").alias("precision"), r6("recall").alias("recall"))


GRID = ", ".join(repr(g) + "e0" for g in ME.threshold_grid())


@query("threshold_sweep", with_roles("scored", body=f"""
WITH g AS (SELECT unnest([{GRID}]) AS threshold),
k AS (SELECT threshold, count(*) FILTER (WHERE prob >= threshold AND toxic = 1) AS tp,
  count(*) FILTER (WHERE prob >= threshold AND toxic = 0) AS fp, count(*) FILTER (WHERE toxic = 1) AS pos
  FROM g, scored GROUP BY 1),
r AS (SELECT threshold, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, tp / pos AS r FROM k)
SELECT round(threshold, 9) AS threshold, round(p, 6) AS precision, round(r, 6) AS recall,
  {", ".join(f"round(CASE WHEN p + r = 0 THEN 0 ELSE (1 + {b}e0) * p * r / ({b}e0 * p + r) END, 6) AS {n}" for b, n in ((0.25, 'f05'), (1.0, 'f1'), (4.0, 'f2')))}
FROM r"""))
def threshold_sweep(spark, sf):
    out = ME.threshold_sweep(scored(spark, sf), label="toxic")
    return out.withColumns({"threshold": F.round("threshold", 9), **{c: r6(c) for c in ("precision", "recall", "f05", "f1", "f2")}})


CELLS = """k AS (SELECT count(*) FILTER (WHERE prob >= 0.2 AND toxic = 1) AS tp, count(*) FILTER (WHERE prob >= 0.2 AND toxic = 0) AS fp,
  count(*) FILTER (WHERE prob < 0.2 AND toxic = 1) AS fn, count(*) FILTER (WHERE prob < 0.2 AND toxic = 0) AS tn, count(*) AS n FROM scored)"""


@query("classification_report", with_roles("scored", body=f"""WITH {CELLS},
v AS (SELECT tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, 2 * tn / (2 * tn + fn + fp) AS f0, (tn + fp) / n AS w0,
  tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, 2 * tp / (2 * tp + fn + fp) AS f1, (tp + fn) / n AS w1, (tp + tn) / n AS acc, n FROM k),
u AS (SELECT '0' AS class, p0 AS p, r0 AS r, f0 AS f, w0 AS s FROM v UNION ALL SELECT '1', p1, r1, f1, w1 FROM v
  UNION ALL SELECT 'accuracy', acc, acc, acc, acc / n FROM v UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, 1 FROM v
  UNION ALL SELECT 'weighted avg', w0 * p0 + w1 * p1, w0 * r0 + w1 * r1, w0 * f0 + w1 * f1, 1 FROM v)
SELECT class, round(100 * p, 2) AS precision, round(100 * r, 2) AS recall, round(100 * f, 2) AS f1, round(100 * s, 2) AS support_pct FROM u"""))
def classification_report(spark, sf):
    return ME.classification_report(scored(spark, sf), 0.2, "toxic")


@query("confusion_pct", with_roles("scored", body=f"""WITH {CELLS}
SELECT 0 AS "true", 0 AS pred, round(100 * tn / n, 2) AS pct FROM k UNION ALL SELECT 0, 1, round(100 * fp / n, 2) FROM k
UNION ALL SELECT 1, 0, round(100 * fn / n, 2) FROM k UNION ALL SELECT 1, 1, round(100 * tp / n, 2) FROM k"""))
def confusion_pct(spark, sf):
    return ME.confusion_pct(scored(spark, sf), 0.2, "toxic")


@query("imbalance_policy", """WITH k AS (SELECT avg(toxic) AS r, sum(1 - toxic) / sum(toxic) AS o FROM labels)
SELECT round(r, 6) AS pos_rate, CASE WHEN r >= 0.05 THEN 'roc_auc' ELSE 'average_precision' END AS primary_metric,
  round(CASE WHEN r < 0.05 THEN o WHEN r < 0.2 THEN least(o, 3) ELSE 1 END, 6) AS weight_capped,
  CASE WHEN r < 0.05 THEN round(o, 6) END AS weight_rare_only, round(o, 6) AS weight_always FROM k""")
def imbalance_policy(spark, sf):
    out = ME.imbalance_policy(table(spark, sf, "labels"), "toxic")
    return out.withColumns({c: r6(c) for c in ("pos_rate", "weight_capped", "weight_rare_only", "weight_always")})
