"""Resampling, classifiers, search, stacking and explanation over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from stayline.functions import scalars as S
from stayline.operators import metrics as ME
from stayline.operators import sampling as SA
from stayline.operators import scaling as SC
from stayline.operators import text as TX
from stayline.operators.smote import nearest_neighbors, smote
from stayline.plans import explain as EX
from stayline.plans import models as MO
from stayline.plans import tuning as TU
from stayline.session import cut_lineage, even_parts, shared_folder
from stayline.sources.tables import load_model, save_model
from stayline.workload.profiling import RANKED
from stayline.workload.registry import query
from stayline.workload.relational import r6
from stayline.workload.roles import hash_sql, table
from stayline.workload.textual import GRAMS_SQL, TOKENS, lemma_table

NAMES = ["n_chars", "n_words", "tfidf__the", "tfidf__heed", "tfidf__thing heed"]


def share(tokens, word):
    hits = F.size(F.filter(tokens, lambda t: t == word))
    return hits / F.greatest(F.size(tokens), F.lit(1))


def features(spark, sf):
    """Labelled documents with a small numeric feature array."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars")
    cols = [F.log1p("n_chars"), S.word_count("text") / 1000.0, *[share("_tokens", t) for t in ("the", "heed", "thing")]]
    rows = table(spark, sf, "labels").select("doc_id", "toxic", "quality").join(docs, "doc_id")
    return rows.withColumn("_tokens", TX.words("text")).withColumn("x", F.array(*[c.cast("double") for c in cols])).drop("_tokens")


def training(spark, sf, folds: int = 3):
    """(doc_id, label, features, fold), checkpointed once for the many fits that follow."""
    df = features(spark, sf).select("doc_id", F.col("toxic").alias("label"), array_to_vector("x").alias("features"))
    return even_parts(SA.stratified_kfold(df, "doc_id", "label", folds))


# The features of `features` in SQL: w and x; with centred class means and attributions also c and phi.
X_SQL = f"""w AS (SELECT doc_id, toxic, text, n_chars, {TOKENS} AS tok, len(regexp_extract_all(text, '\\S+')) AS words FROM labels JOIN documents USING (doc_id)),
x AS (SELECT doc_id, toxic, text, ln(1 + n_chars) AS x1, words / 1000e0 AS x2,
  {", ".join(f"len(list_filter(tok, lambda t: t = '{t}')) / greatest(len(tok), 1) AS x{i}" for i, t in ((3, 'the'), (4, 'heed'), (5, 'thing')))} FROM w),
c AS (SELECT {", ".join(f"avg(x{i}) FILTER (WHERE toxic = 1) - avg(x{i}) FILTER (WHERE toxic = 0) AS b{i}, avg(x{i}) AS m{i}" for i in range(1, 6))} FROM x),
phi AS ({" UNION ALL ".join(f"SELECT doc_id, '{n}' AS feature, x{i} AS value, b{i} * (x{i} - m{i}) AS phi FROM x, c" for i, n in enumerate(NAMES, 1))})"""


# ---- resampling ------------------------------------------------------------------------------------------------------

@query("smote")
def smote_query(spark, sf):
    df = features(spark, sf).select("doc_id", F.col("toxic").alias("label"), "x")
    return smote(df, "doc_id", "label", "x")



@query("nearest_neighbors", """WITH p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
d AS (SELECT a.vec_id AS key, b.vec_id AS neighbor, list_distance(a.e, b.e) AS dist FROM p a JOIN p b ON a.vec_id <> b.vec_id)
SELECT key, string_agg(CAST(neighbor AS VARCHAR), ',' ORDER BY rk) AS near, round(max(dist), 6) AS reach FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY dist, neighbor) AS rk FROM d) WHERE rk <= 5 GROUP BY 1""")
def nearest(spark, sf):
    found = nearest_neighbors(table(spark, sf, "embeddings"), "vec_id", "embedding", 5, cell_rows=256)
    return found.select(
        "key", F.array_join(F.transform("near", lambda p: p["neighbor"].cast("string")), ",").alias("near"),
        r6(F.element_at("near", -1)["dist"]).alias("reach"),
    )


@query("resample_policy", """WITH r AS (SELECT CASE WHEN doc_id % 4 = 0 THEN toxic ELSE 0 END AS y, toxic FROM labels),
d AS (SELECT 'numeric' AS dataset, 5 AS width, toxic AS y FROM r UNION ALL SELECT 'rare', 5, y FROM r UNION ALL SELECT 'wide', 2768, y FROM r),
k AS (SELECT dataset, width, count(*) AS n, sum(y) AS pos FROM d GROUP BY 1, 2)
SELECT dataset, n, CASE WHEN width > 200 OR pos / n >= 0.05 THEN NULL WHEN pos < 2 THEN 'ros' ELSE 'smote' END AS sampler,
  CASE WHEN width > 200 THEN 'more than 200 features' WHEN pos / n >= 0.05 THEN 'positives not below 5%'
    WHEN pos < 2 THEN 'minority too small for neighbours' ELSE 'dense, narrow, rare positives' END AS reason FROM k""")
def resample_policy(spark, sf):
    df = table(spark, sf, "labels")
    rare = df.withColumn("toxic", F.when(F.col("doc_id") % 4 == 0, F.col("toxic")).otherwise(0))
    asked = {"numeric": (df, 5), "rare": (rare, 5), "wide": (rare, 2768)}
    parts = []
    for name, (d, n_features) in asked.items():
        policy = SA.resample_policy(d, "toxic", n_features=n_features)
        parts.append(d.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("dataset"), F.lit(policy.sampler).cast("string").alias("sampler"),
            F.lit(policy.reason).alias("reason"), "n",
        ))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("smote_rows", f"""WITH {X_SQL},
m AS (SELECT doc_id, [x1, x2, x3, x4, x5] AS v, row_number() OVER (ORDER BY {hash_sql('doc_id', 42)}, doc_id) AS rk, count(*) OVER () AS m FROM x WHERE toxic = 1),
t AS (SELECT (SELECT count(*) FROM x WHERE toxic = 1) AS m, CAST(floor(0.5 * (SELECT count(*) FROM x WHERE toxic = 0)) AS BIGINT) AS target),
d AS (SELECT draw, {hash_sql('draw', 42)} % t.m + 1 AS rk, {hash_sql('draw', '42n')} % least(5, t.m - 1) + 1 AS j, {hash_sql('draw', '42u')} / 4294967296e0 AS u
  FROM t, (SELECT unnest(range(0, 1000000)) AS draw) WHERE draw < t.target - t.m),
near AS (SELECT a.doc_id, b.v AS w, row_number() OVER (PARTITION BY a.doc_id ORDER BY list_distance(a.v, b.v), b.doc_id) AS j
  FROM m a JOIN m b ON a.doc_id <> b.doc_id)
SELECT doc_id, toxic AS label, CAST(NULL AS BIGINT) AS draw, {", ".join(f"round(x{i}, 6) AS x{i}" for i in range(1, 6))} FROM x
UNION ALL SELECT NULL, 1, draw, {", ".join(f"round(m.v[{i}] + u * (w[{i}] - m.v[{i}]), 6)" for i in range(1, 6))}
FROM d JOIN m USING (rk) JOIN near ON near.doc_id = m.doc_id AND near.j = d.j""")
def smote_rows(spark, sf):
    """All rows and the synthetic ones, number by number."""
    df = features(spark, sf).select("doc_id", F.col("toxic").alias("label"), "x")
    out = smote(df, "doc_id", "label", "x")
    return out.select("doc_id", "label", "draw", *[r6(F.col("x")[i]).alias(f"x{i + 1}") for i in range(5)])


def smote_frame(seed: int):
    """Resampler for (doc_id, label, features vector, fold) frames; real rows keep their folds."""

    def resample(df):
        arrays = df.select("doc_id", "label", vector_to_array("features").alias("x"))
        out = smote(arrays, "doc_id", "label", "x", seed=seed)
        rows = out.select("doc_id", "label", array_to_vector("x").alias("features"))
        return rows.join(df.select("doc_id", "fold"), "doc_id", "left")  # synthetic rows belong to no fold

    return resample


@query("oversample_both_folds")
def oversample_both_folds(spark, sf):
    df = training(spark, sf, 2)
    oof = MO.cross_val_oof(df, MO.logreg_fit(), resample=smote_frame(42), resample_valid=True)
    return MO.fold_metrics(oof)


@query("block_standardise", """WITH t AS (SELECT doc_id, n_chars, len(regexp_extract_all(text, '\\S+')) AS words, toxic FROM labels JOIN documents USING (doc_id))
SELECT doc_id, round((n_chars - avg(n_chars) OVER ()) / stddev_samp(n_chars) OVER (), 6) AS n_chars,
  round((words - avg(words) OVER ()) / stddev_samp(words) OVER (), 6) AS words, CAST(toxic AS DOUBLE) AS toxic FROM t""".replace("\\\\", "\\"))
def block_standardise(spark, sf):
    df = features(spark, sf).select("doc_id", "n_chars", S.word_count("text").alias("words"), "toxic")
    model = SC.block_standardise(df, ["n_chars", "words"], ["toxic"])
    out = model.transform(df).select("doc_id", vector_to_array("features").alias("f"))
    return out.select("doc_id", r6(F.col("f")[0]).alias("n_chars"), r6(F.col("f")[1]).alias("words"), F.col("f")[2].alias("toxic"))


def fused_tables(spark, sf, keep=None, **terms):
    df = features(spark, sf).select("doc_id", "toxic", "n_chars", S.word_count("text").alias("words"), "lang")
    vectors, _ = TX.tfidf_vectors(lemma_table(spark, sf), "doc_id", "lemmas", unique=True, **terms)
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return TX.fuse_datasets(df, "doc_id", "toxic", ["n_chars", "words"], vectors, emb, keep=keep)


@query("fuse_datasets", f"""WITH b AS (SELECT count(*) AS n FROM labels JOIN documents USING (doc_id) JOIN embeddings ON vec_id = doc_id)
SELECT 'tfidf' AS dataset, n AS n_rows, 502 AS width FROM b UNION ALL SELECT 'embedding', n, 66 FROM b UNION ALL SELECT 'both', n, 566 FROM b""")
def fuse_datasets(spark, sf):
    fused = fused_tables(spark, sf, max_features=500)
    width = F.max(F.size(vector_to_array("features")))
    return reduce(lambda a, b: a.unionByName(b), [
        d.agg(F.count(F.lit(1)).alias("n_rows"), width.alias("width")).select(F.lit(n).alias("dataset"), "n_rows", "width")
        for n, d in fused.items()
    ])


FUSED_SQL = f"""{GRAMS_SQL},
base AS (SELECT doc_id, toxic, n_chars, len(regexp_extract_all(text, '\\S+')) AS words, CAST(embedding AS DOUBLE[]) AS e
  FROM labels JOIN documents USING (doc_id) JOIN embeddings ON vec_id = doc_id),
place AS (SELECT term, row_number() OVER (ORDER BY term) AS i FROM vocab),
k AS (SELECT (SELECT count(*) FROM vocab) AS terms)"""


def contents_sql(*structured: str) -> str:
    """Width, sum and sum weighted by place of every row of the three tables."""
    m = len(structured)
    total, placed = " + ".join(structured), " + ".join(f"{i} * {c}" for i, c in enumerate(structured, 1))
    return f"""WITH {FUSED_SQL},
t AS (SELECT doc_id, sum(weight) AS s, sum(i * weight) AS p FROM tfidf JOIN place USING (term) GROUP BY 1),
v AS (SELECT doc_id, sum(x) AS s, sum(i * x) AS p FROM (
  SELECT doc_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM base) GROUP BY 1),
b AS (SELECT doc_id, toxic, {total} AS s, {placed} AS p, terms, len(e) AS dims,
  coalesce(t.s, 0) AS ts, coalesce(t.p, 0) AS tp, v.s AS vs, v.p AS vp
  FROM base CROSS JOIN k LEFT JOIN t USING (doc_id) JOIN v USING (doc_id)),
f AS (SELECT 'tfidf' AS dataset, doc_id, toxic, {m} + terms AS width, s + ts AS total, p + tp + {m} * ts AS placed FROM b
  UNION ALL SELECT 'embedding', doc_id, toxic, {m} + dims, s + vs, p + vp + {m} * vs FROM b
  UNION ALL SELECT 'both', doc_id, toxic, {m} + terms + dims, s + ts + vs, p + tp + {m} * ts + vp + ({m} + terms) * vs FROM b)
SELECT dataset, doc_id, toxic, width, round(total, 4) AS total, round(placed, 4) AS placed FROM f"""


def contents(tables):
    x = F.col("x")
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda t, y: t + y)
    return reduce(lambda a, b: a.unionByName(b), [
        d.withColumn("x", vector_to_array("features")).select(
            F.lit(n).alias("dataset"), "doc_id", "toxic", F.size(x).cast("long").alias("width"),
            F.round(add(x), 4).alias("total"), F.round(add(F.transform(x, lambda y, i: y * (i + 1))), 4).alias("placed"),
        )
        for n, d in tables.items()
    ])


@query("fuse_datasets_whole", contents_sql("n_chars", "words"))
def fuse_datasets_whole(spark, sf):
    """Every row of the three tables with all 2000 terms."""
    return contents(fused_tables(spark, sf))


@query("fuse_datasets_kept", contents_sql("words"))
def fuse_datasets_kept(spark, sf):
    """The same with the structured block cut to the kept columns."""
    return contents(fused_tables(spark, sf, keep=["words", "absent"]))


@query("global_importance_wide", f"""WITH {FUSED_SQL}, n AS (SELECT count(*) AS n FROM base),
long AS (SELECT 0 AS i, n_chars AS x FROM base UNION ALL SELECT 1, words FROM base
  UNION ALL SELECT 1 + place.i, weight FROM tfidf JOIN place USING (term) JOIN base USING (doc_id)
  UNION ALL SELECT 1 + terms + i, x FROM (SELECT unnest(e) AS x, generate_subscripts(e, 1) AS i FROM base), k),
m AS (SELECT i, sum(x) / any_value(n) AS m, any_value(n) - count(*) AS zeros, any_value(n) AS n FROM long, n GROUP BY 1),
w AS (SELECT unnest(range(0, 2 + terms + (SELECT max(len(e)) FROM base))) AS i FROM k),
a AS (SELECT i, (sum(abs(x - m)) + any_value(zeros * abs(m))) / any_value(n) AS away FROM long JOIN m USING (i) GROUP BY 1)
SELECT 'f' || i AS feature, round(abs(i % 7 - 3) * coalesce(away, 0), 6) AS importance FROM w LEFT JOIN a USING (i)""")
def global_importance_wide(spark, sf):
    """Mean absolute attributions of all fused features, added up as vectors."""
    df = fused_tables(spark, sf)["both"]
    mean = df.select(Summarizer.mean(F.col("features")).alias("m")).first()["m"]
    names = [f"f{i}" for i in range(len(mean))]
    slopes = [float(i % 7 - 3) for i in range(len(mean))]
    return EX.vector_importance(df, "features", names, slopes, list(map(float, mean))).withColumn("importance", r6("importance"))


# ---- models ----------------------------------------------------------------------------------------------------------

def coefficients(model, spark):
    m = model.stages[-1]
    rows = [(n, float(c)) for n, c in zip(NAMES, m.coefficients)] + [("(intercept)", float(m.intercept))]
    return spark.createDataFrame(rows, "feature string, coefficient double")


@query("fit_logreg")
def fit_logreg(spark, sf):
    df = training(spark, sf)
    fits = {
        "l1": MO.logreg_fit(penalty="l1", C=0.5, class_weight="balanced"), "l2": MO.logreg_fit(C=1.0),
        "elasticnet": MO.logreg_fit(penalty="elasticnet", C=1.0, l1_ratio=0.3),
    }
    return reduce(lambda a, b: a.unionByName(b), [
        coefficients(fit(df), spark).withColumn("penalty", F.lit(name)) for name, fit in fits.items()
    ])


@query("fit_gbt")
def fit_gbt(spark, sf):
    df = training(spark, sf)
    fit = MO.gbt_fit(rounds=10, max_depth=3, subsample=0.8, stop=df.filter("fold = 0"))
    return MO.score(fit(df.filter("fold > 0")), df).select("doc_id", "label", "prob")


@query("fit_rf")
def fit_rf(spark, sf):
    df = training(spark, sf)
    return MO.score(MO.rf_fit(trees=20, max_depth=5)(df), df).select("doc_id", "label", "prob")


@query("cross_val_oof")
def cross_val_oof(spark, sf):
    return MO.cross_val_oof(training(spark, sf), MO.logreg_fit(), parallel=3).select("doc_id", "label", "fold", "prob")


@query("cv_metrics")
def cv_metrics(spark, sf):
    return MO.fold_metrics(MO.cross_val_oof(training(spark, sf), MO.logreg_fit(class_weight="balanced"), parallel=3))


@query("param_search")
def param_search(spark, sf):
    found = MO.param_search(training(spark, sf, 2), MO.logreg_fit, MO.LOGREG_SPACE, 3, max_iter=20)
    return found.trials


@query("penalty_summary")
def penalty_summary(spark, sf):
    return MO.penalty_summary(training(spark, sf))


@query("stacking")
def stacking(spark, sf):
    df = training(spark, sf, 2)
    bases = {"lr": MO.logreg_fit(), "gbt_a": MO.gbt_fit(rounds=5, max_depth=3), "gbt_b": MO.gbt_fit(rounds=5, max_depth=2, step=0.3)}
    return MO.fit_stack(df, bases, "doc_id").transform(df).select("doc_id", "label", "prob")


def saved_model(spark, sf):
    """Fit, save with threshold and metrics, load again."""
    df, path = training(spark, sf), shared_folder(spark)
    model = MO.logreg_fit(class_weight="balanced")(df)
    metrics = ME.threshold_metrics(MO.score(model, df), 0.5)
    save_model(model, path, params={"C": 1.0}, threshold=0.5, metrics=metrics, features=NAMES)
    return df, path, *load_model(spark, path)


@query("save_model")
def save_model_query(spark, sf):
    """The metrics that were stored beside the model."""
    _, path, _, serving = saved_model(spark, sf)
    return spark.read.parquet(f"{path}/metrics").withColumn("features", F.lit(",".join(serving["features"])))


@query("score")
def score(spark, sf):
    """All rows through the loaded model and its stored threshold."""
    df, _, model, serving = saved_model(spark, sf)
    return MO.score(model, df, threshold=serving["threshold"]).select("doc_id", "prob", "pred")


@query("safe_early_stop")
def safe_early_stop(spark, sf):
    """Stopping rows of one class: the training part takes their place."""
    df = training(spark, sf)
    negatives = df.filter("fold = 0 AND label = 0")
    fit = MO.gbt_fit(rounds=5, max_depth=2, stop=negatives)
    return MO.score(fit(df.filter("fold > 0")), df).select("doc_id", "label", "prob")


# ---- tuning, and what must hold for fitted models --------------------------------------------------------------------

FOLDED = f"""{RANKED}, k AS (SELECT doc_id, toxic AS label, CAST((rk - 1) % 3 AS INTEGER) AS fold FROM r)"""


@query("held_stopping", f"""WITH {FOLDED} SELECT fold, count(*) AS n, 12 AS n_losses, true AS losses_agree, true AS least_loss_kept FROM k GROUP BY 1""")
def held_stopping(spark, sf):
    """Per fold: the loss after each round, taken again from the scores of tree prefixes, has its least where the fold stopped."""
    fits = MO.cross_val_fits(training(spark, sf), MO.staged_gbt_fit(rounds=12, max_depth=3, patience=12), parallel=3)
    parts = []
    for f in fits:
        staged, scored = f.model, f.scored
        for n in range(1, len(staged.losses) + 1):
            prefix = MO.StagedModel(staged.model, n, staged.losses)
            scored = MO.score(prefix, scored, f"p{n}")
        true = lambda n: F.when(F.col("label") == 1, F.col(f"p{n}")).otherwise(1 - F.col(f"p{n}"))
        again = scored.groupBy("fold").agg(
            F.count(F.lit(1)).alias("n"), F.array(*[F.avg(-2 * F.ln(true(n + 1))) for n in range(len(staged.losses))]).alias("again")
        )
        told = F.array(*[F.lit(float(x)) for x in staged.losses])
        gaps = F.zip_with("again", told, lambda a, b: F.abs(a - b))
        parts.append(again.select(
            "fold", "n", F.size("again").alias("n_losses"), (F.array_max(gaps) < 1e-9).alias("losses_agree"),
            (F.element_at("again", staged.rounds) <= F.array_min("again") + 1e-9).alias("least_loss_kept"),
        ))
    return reduce(lambda a, b: a.unionByName(b), parts)


def ros_frame(df):
    return SA.random_oversample(df, "doc_id", "label").drop("draw")


def tuned(spark, sf):
    """The whole job over boosted trees, saved and loaded again."""
    df, path = training(spark, sf), shared_folder(spark)
    bundle = TU.tune(
        df, MO.staged_gbt_fit, MO.space_for("general"), dataset="general", key="doc_id", n_trials=4, resample=ros_frame,
        features=NAMES, rounds=20, patience=5,
    )
    TU.save_bundle(bundle, path)
    return df, bundle, TU.load_bundle(spark, path)


@query("tune_and_save", "SELECT doc_id, toxic AS label, true AS same, true AS decided, true AS oof_scored FROM labels JOIN documents USING (doc_id)")
def tune_and_save(spark, sf):
    """Every row through the saved bundle: its scores are those of the tuned model, its decisions those of the threshold."""
    df, made, loaded = tuned(spark, sf)
    before = made.score(df, "before").select("doc_id", F.col("before"))
    oof = loaded.oof.select("doc_id", F.col("prob").alias("oof"))
    rows = loaded.score(df).join(before, "doc_id").join(oof, "doc_id", "left")
    cut = F.lit(loaded.serving["threshold"])
    return rows.select(
        "doc_id", "label", (F.col("prob") == F.col("before")).alias("same"), ((F.col("pred") == 1) == (F.col("prob") >= cut)).alias("decided"),
        F.coalesce(F.col("oof").between(0, 1), F.lit(False)).alias("oof_scored"),
    )


@query("tune_metrics")
def tune_metrics(spark, sf):
    """The stored metrics at the tuned threshold, with the settings a server would read."""
    loaded = tuned(spark, sf)[2]
    keys = ("dataset", "threshold_strategy", "rows", "pos_rate", "best_value")
    return loaded.metrics.withColumns({k: F.lit(loaded.serving[k]) for k in keys})


@query("param_search_boosted")
def param_search_boosted(spark, sf):
    """Boosted trials that stop on their held-out folds, resampled, and given up once they can't win."""
    found = MO.param_search(
        training(spark, sf), MO.staged_gbt_fit, MO.space_for("tfidf"), 4, resample=ros_frame, prune=True, rounds=20, patience=5
    )
    return found.trials


@query("stacking_passthrough", "SELECT doc_id, toxic AS label, true AS scored FROM labels JOIN documents USING (doc_id)")
def stacking_passthrough(spark, sf):
    """A stack whose meta model sees the features beside the base probabilities."""
    df = training(spark, sf)
    bases = {"lr": MO.logreg_fit(), "gbt": MO.gbt_fit(rounds=10, max_depth=3), "rf": MO.rf_fit(trees=20, max_depth=5)}
    stack = MO.fit_stack(df, bases, "doc_id", passthrough=True)
    return stack.transform(df).select("doc_id", "label", F.col("prob").between(0, 1).alias("scored"))


@query("oof_invariants", f"""WITH {FOLDED} SELECT doc_id, label, fold, true AS scored FROM k JOIN documents USING (doc_id)""")
def oof_invariants(spark, sf):
    """One out-of-fold score per row, in its fold, for a linear, a boosted and a forest fit alike."""
    df, fits = training(spark, sf), {"a": MO.logreg_fit(), "b": MO.staged_gbt_fit(rounds=10, max_depth=3), "c": MO.rf_fit(trees=10)}
    parts = [MO.cross_val_oof(df, fit, parallel=3).select("doc_id", "label", "fold", "prob") for fit in fits.values()]
    each = reduce(lambda a, b: a.unionByName(b), parts).groupBy("doc_id", "label", "fold")
    return each.agg(((F.count("prob") == len(fits)) & (F.min("prob") >= 0) & (F.max("prob") <= 1)).alias("scored"))


@query("logreg_gradient", f"""SELECT unnest({NAMES + ['(intercept)']}) AS feature, (SELECT count(*) FROM labels JOIN documents USING (doc_id)) AS n, true AS flat""")
def logreg_gradient(spark, sf):
    """The gradient of the L2 objective is zero at the fitted coefficients, feature by feature."""
    c = 0.5
    df = training(spark, sf)
    fit = MO.logreg_fit(C=c, max_iter=500, tol=1e-10)(df)
    model = fit.stages[-1]
    residual = MO.score(fit, df).withColumn("x", F.concat(vector_to_array("features"), F.array(F.lit(1.0)))).select(
        F.posexplode("x").alias("i", "x"), (F.col("prob") - F.col("label")).alias("r")
    )
    names, slopes = F.array(*map(F.lit, [*NAMES, "(intercept)"])), [*map(float, model.coefficients), 0.0]  # no penalty on the intercept
    gradient = F.sum(F.col("x") * F.col("r")) + F.element_at(F.array(*map(F.lit, slopes)), F.first("i") + 1) / c
    return residual.groupBy("i").agg(F.count(F.lit(1)).alias("n"), gradient.alias("g")).select(
        F.element_at(names, F.col("i") + 1).alias("feature"), "n", (F.abs("g") < 1e-4 * F.col("n")).alias("flat")
    )


@query("saved_scores", "SELECT doc_id, true AS same, true AS decided FROM labels JOIN documents USING (doc_id)")
def saved_scores(spark, sf):
    """A saved and loaded model scores as before, and its decisions follow the stored threshold."""
    df, _, model, serving = saved_model(spark, sf)
    before = MO.score(MO.logreg_fit(class_weight="balanced")(df), df, "before").select("doc_id", "before")
    after = MO.score(model, df, threshold=serving["threshold"])
    return after.join(before, "doc_id").select(
        "doc_id", (F.abs(F.col("prob") - F.col("before")) < 1e-9).alias("same"),
        ((F.col("pred") == 1) == (F.col("prob") >= serving["threshold"])).alias("decided"),
    )


@query("attribution_sums", "SELECT doc_id, 5 AS n, true AS adds_up FROM labels JOIN documents USING (doc_id)")
def attribution_sums(spark, sf):
    """Attributions of a fitted model and its base value add up to the log odds of its score."""
    df = training(spark, sf)
    fit = MO.logreg_fit(class_weight="balanced")(df)
    model, background = fit.stages[-1], EX.background_mean(df, k=50)
    slopes = list(map(float, model.coefficients))
    base = EX.base_value(float(model.intercept), slopes, background)
    sums = EX.linear_attribution(df, "doc_id", "features", NAMES, slopes, background).groupBy("doc_id").agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.sum("phi").alias("phi")
    )
    odds = MO.score(fit, df).select("doc_id", F.ln(F.col("prob") / (1 - F.col("prob"))).alias("odds"))
    gap = F.abs(F.col("phi") + F.lit(base) - F.col("odds"))
    return sums.join(odds, "doc_id").select("doc_id", "n", (gap < 1e-6 * (1 + F.abs("odds"))).alias("adds_up"))


# ---- explanation -----------------------------------------------------------------------------------------------------




def class_mean_model(df):
    """Coefficients = difference of class means, background = mean: a linear model SQL can state too."""
    aggs = []
    for i in range(len(NAMES)):
        v = F.col("x")[i]
        aggs += [F.avg(F.when(F.col("toxic") == 1, v)).alias(f"p{i}"), F.avg(F.when(F.col("toxic") == 0, v)).alias(f"n{i}"), F.avg(v).alias(f"m{i}")]
    row = df.agg(*aggs).first()
    return [row[f"p{i}"] - row[f"n{i}"] for i in range(len(NAMES))], [row[f"m{i}"] for i in range(len(NAMES))]


def attributions(spark, sf):
    df = features(spark, sf)
    coef, background = class_mean_model(df)
    return EX.linear_attribution(df, "doc_id", F.col("x"), NAMES, coef, background), coef, background


@query("linear_attribution")
def linear_attribution(spark, sf):
    """Attributions of a fitted model against the mean of k-means centres."""
    df = training(spark, sf)
    model = MO.logreg_fit(class_weight="balanced")(df).stages[-1]
    background = EX.background_mean(df, k=50)
    return EX.linear_attribution(df, "doc_id", "features", NAMES, list(model.coefficients), background)


@query("linear_attribution_given", f"WITH {X_SQL} SELECT doc_id, feature, round(value, 6) AS value, round(phi, 6) AS phi FROM phi")
def linear_attribution_given(spark, sf):
    phi = attributions(spark, sf)[0]
    return phi.select("doc_id", "feature", r6("value").alias("value"), r6("phi").alias("phi"))


@query("global_importance", f"WITH {X_SQL} SELECT feature, round(avg(abs(phi)), 6) AS importance FROM phi GROUP BY 1")
def global_importance(spark, sf):
    return EX.global_importance(attributions(spark, sf)[0]).withColumn("importance", r6("importance"))


@query("row_attribution", f"""WITH {X_SQL} SELECT doc_id, feature, round(value, 6) AS value, round(phi, 6) AS phi,
  round((SELECT {" + ".join(f"b{i} * m{i}" for i in range(1, 6))} FROM c), 6) AS base
FROM phi WHERE doc_id = (SELECT max(doc_id) FROM labels)""")
def row_attribution(spark, sf):
    phi, coef, background = attributions(spark, sf)
    last = table(spark, sf, "labels").agg(F.max("doc_id")).first()[0]
    out = EX.row_attribution(phi, "doc_id", last, EX.base_value(0.0, coef, background))
    return out.withColumns({c: r6(c) for c in ("value", "phi", "base")})


@query("dependence_table", f"""WITH {X_SQL} SELECT p.doc_id, p.feature, round(p.value, 6) AS value, round(p.phi, 6) AS phi, round(x1, 6) AS interaction
FROM phi p JOIN x USING (doc_id) WHERE p.feature IN ('tfidf__the', 'tfidf__heed')""")
def dependence_table(spark, sf):
    out = EX.dependence_table(attributions(spark, sf)[0], "doc_id", ["tfidf__the", "tfidf__heed", "absent"], "n_chars")
    return out.withColumns({c: r6(c) for c in ("value", "phi", "interaction")})


@query("token_story", f"""WITH {X_SQL},
s AS (SELECT doc_id, toxic, round(sum(phi), 9) AS v, text FROM phi JOIN x USING (doc_id)
  WHERE feature IN ('tfidf__heed', 'tfidf__thing heed') GROUP BY doc_id, toxic, text HAVING sum(value) > 0),
top AS ((SELECT *, 'positive' AS side FROM s ORDER BY v DESC, doc_id LIMIT 15) UNION ALL (SELECT *, 'negative' FROM s ORDER BY v, doc_id LIMIT 15)),
p AS (SELECT *, strpos(lower(text), 'heed') - 1 AS pos FROM top)
SELECT doc_id, side, round(v, 6) AS phi_token, toxic, CASE WHEN pos < 0 THEN '' ELSE regexp_replace(substr(text,
  CAST(greatest(pos - 60, 0) + 1 AS BIGINT), CAST(pos + 64 - greatest(pos - 60, 0) AS BIGINT)), 'heed', '[HEED]', 'gi') END AS snippet FROM p""")
def token_story(spark, sf):
    phi = attributions(spark, sf)[0]
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    matched = F.broadcast(TX.feature_token_match(names, "name", ["heed"]))  # a subset of the feature names
    contributions = EX.token_contributions(phi, "doc_id", matched).withColumn("phi_token", F.round("phi_token", 9))
    out = EX.token_story(contributions, features(spark, sf), "doc_id", "heed", "text", extra=["toxic"])
    return out.withColumn("phi_token", r6("phi_token"))


class GivenModel:
    """A linear model with given slopes on the array column x."""

    def __init__(self, slopes):
        self.slopes = slopes

    def transform(self, df):
        odds = reduce(lambda a, b: a + b, [F.lit(float(b)) * F.col("x")[i] for i, b in enumerate(self.slopes)])
        one = 1 / (1 + F.exp(-odds))
        return df.withColumn("probability", array_to_vector(F.array(1 - one, one)))


@query("token_story_scored", f"""WITH {X_SQL},
s AS (SELECT doc_id, toxic, round(sum(phi), 9) AS v, text FROM phi JOIN x USING (doc_id)
  WHERE feature = 'tfidf__heed' GROUP BY doc_id, toxic, text HAVING sum(value) > 0),
top AS ((SELECT *, 'positive' AS side FROM s ORDER BY v DESC, doc_id LIMIT 15) UNION ALL (SELECT *, 'negative' FROM s ORDER BY v, doc_id LIMIT 15))
SELECT doc_id, side, round(v, 6) AS phi_token, toxic, round(1 / (1 + exp(-({" + ".join(f"b{i} * x{i}" for i in range(1, 6))}))), 6) AS prob
FROM top JOIN x USING (doc_id, toxic), c""")
def token_story_scored(spark, sf):
    """The token's strongest rows with the model's probability; only the matched features are attributed."""
    df = features(spark, sf)
    slopes, background = class_mean_model(df)
    phi = EX.chosen_attributions(df, "doc_id", F.col("x"), NAMES, slopes, background, ["tfidf__heed"])
    matched = F.broadcast(spark.createDataFrame([("heed", "tfidf__heed")], "token string, feature string"))
    contributions = EX.token_contributions(phi, "doc_id", matched).withColumn("phi_token", F.round("phi_token", 9))
    out = EX.token_story(contributions, df, "doc_id", "heed", "text", extra=["toxic"], model=GivenModel(slopes))
    return out.drop("snippet").withColumns({"phi_token": r6("phi_token"), "prob": r6("prob")})


@query("metrics_of_many_groups", """WITH o AS (SELECT o_custkey AS customer, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS y,
  round(o_totalprice / 600000, 3) AS prob FROM orders),
c AS (SELECT customer, prob, sum(y) AS p, count(*) - sum(y) AS n FROM o GROUP BY 1, 2),
t AS (SELECT customer, sum(y) AS pos, count(*) - sum(y) AS neg, sum(y) FILTER (WHERE prob >= 0.5) AS tp, count(*) FILTER (WHERE prob >= 0.5) AS flagged FROM o GROUP BY 1),
k AS (SELECT *, sum(p) OVER w AS tp_k, sum(n) OVER w AS fp_k FROM c WINDOW w AS (PARTITION BY customer ORDER BY prob DESC))
SELECT customer, round(sum(tp_k / (tp_k + fp_k) * p / pos), 6) AS ap,
  round(CASE WHEN any_value(neg) > 0 THEN sum(p * (neg - fp_k + n / 2)) / any_value(pos * neg) END, 6) AS roc_auc,
  round(coalesce(any_value(tp) / nullif(any_value(flagged), 0), 0), 6) AS precision, round(coalesce(any_value(tp), 0) / any_value(pos), 6) AS recall
FROM k JOIN t USING (customer) WHERE pos > 0 GROUP BY 1""")
def metrics_of_many_groups(spark, sf):
    """Ranking metrics of every customer's orders, each group with cut points of its own."""
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int")
    df = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("customer"), urgent.alias("y"), F.round(F.col("o_totalprice") / 600000, 3).alias("prob")
    )
    out = MO.fold_metrics(df, fold="customer", label="y")
    return out.withColumns({c: r6(c) for c in ("ap", "roc_auc", "precision", "recall")})
