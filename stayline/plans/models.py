"""Classifier jobs on Spark ML: fitting, out-of-fold scores, search, stacking, serving.

Tables carry (key, label, features vector, fold). Folds and trials are separate Spark jobs over one
checkpointed table; nothing but parameters, metrics and model coefficients reaches the driver.
"""

from __future__ import annotations

import math
import random
import threading
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass, field
from functools import partial

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions.ordering import running_totals
from stayline.functions.scalars import ratio
from stayline.operators.limits import union_all
from stayline.operators.metrics import rank_metrics, select_threshold, threshold_metrics
from stayline.session import cut_lineage, even_parts

WEIGHT = "_weight"
STOPPING = "_stopping"
Fit = Callable[[DataFrame], "object"]


def class_weights(df: DataFrame, label: str, weight: float | str | None) -> tuple[DataFrame, float]:
    """Weight column and its sum: None = 1, 'balanced' = n / (2 n_class), a number = that for positives."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label)).alias("pos")).first()
    n, pos = row["n"], row["pos"] or 0
    neg = n - pos
    if weight is None:
        one, zero = 1.0, 1.0
    elif weight == "balanced":
        one, zero = n / (2 * max(pos, 1)), n / (2 * max(neg, 1))
    else:
        one, zero = float(weight), 1.0
    return df.withColumn(WEIGHT, F.when(F.col(label) == 1, one).otherwise(zero)), one * pos + zero * neg


def scale_pos_weight(pos: int, neg: int, rule: str = "capped") -> float | None:
    """Class weight rules: capped, rare-only, always."""
    odds, rate = neg / max(pos, 1), pos / max(pos + neg, 1)
    if rule == "always":
        return odds
    if rule == "rare-only":
        return odds if rate < 0.05 else None
    if rule == "capped":
        return odds if rate < 0.05 else min(odds, 3.0) if rate < 0.20 else 1.0
    raise ValueError(f"unknown weight rule: {rule}")


def logreg_fit(
    label="label", features="features", penalty: str = "l2", C: float = 1.0, l1_ratio: float = 0.5,
    class_weight=None, max_iter: int = 100, tol: float = 1e-4,
) -> Fit:
    """Logistic regression with the usual C: the penalty is 1 / (C * sum of weights) on unscaled features."""
    mix = {"l1": 1.0, "l2": 0.0, "elasticnet": l1_ratio}[penalty]

    def fit(train: DataFrame):
        weighted, total = class_weights(train, label, class_weight)
        model = LogisticRegression(
            labelCol=label, featuresCol=features, weightCol=WEIGHT, elasticNetParam=mix, regParam=1.0 / (C * total),
            standardization=False, maxIter=max_iter, tol=tol,
        )
        return Pipeline(stages=[model]).fit(weighted)

    return fit


def watched_rows(train: DataFrame, valid: DataFrame, label: str) -> DataFrame:
    """The rows whose loss decides when to stop: the validation part, or the training part if that has one class."""
    classes = valid.agg(F.min(label).alias("a"), F.max(label).alias("b")).first()
    return valid if classes["a"] != classes["b"] else train


def early_stop_frame(train: DataFrame, valid: DataFrame | None, label: str) -> tuple[DataFrame, bool]:
    """Training rows with marked stopping rows: the validation part, or the training part if that has one class."""
    if valid is None:
        return train, False
    watched = watched_rows(train, valid, label)
    both = train.withColumn(STOPPING, F.lit(False)).unionByName(watched.withColumn(STOPPING, F.lit(True)))
    return both, True


def gbt_fit(
    label="label", features="features", step: float = 0.1, max_depth: int = 5, rounds: int = 20,
    min_instances: int = 1, min_gain: float = 0.0, subsample: float = 1.0, feature_share: float | str = "all",
    max_bins: int = 256, class_weight=None, stop: DataFrame | None = None, stop_tol: float = 0.01, seed: int = 42,
) -> Fit:
    """Boosted trees; with `stop` rows the rounds end when the loss on them stops falling."""

    def fit(train: DataFrame):
        # the classes are weighed by the training rows alone; stopping rows count alike
        weighted, _ = class_weights(train, label, class_weight)
        held = None if stop is None else stop.withColumn(WEIGHT, F.lit(1.0))
        weighted, stopping = early_stop_frame(weighted, held, label)
        watch = {"validationIndicatorCol": STOPPING, "validationTol": stop_tol} if stopping else {}
        model = GBTClassifier(
            labelCol=label, featuresCol=features, weightCol=WEIGHT, stepSize=step, maxDepth=max_depth, maxIter=rounds,
            minInstancesPerNode=min_instances, minInfoGain=min_gain, subsamplingRate=subsample,
            featureSubsetStrategy=str(feature_share), maxBins=max_bins, seed=seed, **watch,
        )
        return Pipeline(stages=[model]).fit(weighted)

    return fit


def best_round(losses: Sequence[float], patience: int) -> int:
    """The number of rounds with the least loss, reading on until `patience` rounds bring nothing better."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


@dataclass(frozen=True)
class StagedModel:
    """The first `rounds` trees of a boosted model, and the held-out loss after each of its rounds."""

    model: object
    rounds: int
    losses: tuple[float, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds `probability` from the weighted sum of the first trees."""
        boosted = self.model.stages[-1]
        features, columns = boosted.getFeaturesCol(), df.columns
        names = [f"_tree_{i}" for i in range(self.rounds)]
        for name, tree in zip(names, boosted.trees):
            df = tree.setFeaturesCol(features).setPredictionCol(name).transform(df)
        margin = F.lit(0.0)
        for name, weight in zip(names, boosted.treeWeights):
            margin = margin + F.col(name) * float(weight)
        one = 1.0 / (1.0 + F.exp(-2.0 * margin))
        return df.withColumn("probability", array_to_vector(F.array(1.0 - one, one))).select(*columns, "probability")


@dataclass(frozen=True)
class StagedFit:
    """Boosted trees that are given the held-out rows: all rounds are fitted, and the round of least held-out loss is kept.

    The loss is read for all rounds in one job. It is the logistic loss, the only one that boosting reports by round.
    """

    params: Mapping
    patience: int = 10
    label: str = "label"

    def __call__(self, train: DataFrame, held: DataFrame | None = None):
        model = gbt_fit(label=self.label, **self.params)(train)
        if held is None:
            return model
        watched = watched_rows(train, held, self.label).withColumn(WEIGHT, F.lit(1.0))
        losses = tuple(model.stages[-1].evaluateEachIteration(watched))
        return StagedModel(model, best_round(losses, self.patience), losses)


def staged_gbt_fit(label="label", patience: int = 10, **params) -> StagedFit:
    """`gbt_fit` whose rounds end at the best one on the rows held out, where `cross_val_oof` or a search hands them over."""
    return StagedFit(params, patience, label)


def rf_fit(
    label="label", features="features", trees: int = 100, max_depth: int = 8, class_weight="balanced", seed: int = 42
) -> Fit:
    def fit(train: DataFrame):
        weighted, _ = class_weights(train, label, class_weight)
        model = RandomForestClassifier(
            labelCol=label, featuresCol=features, weightCol=WEIGHT, numTrees=trees, maxDepth=max_depth, seed=seed
        )
        return Pipeline(stages=[model]).fit(weighted)

    return fit


def score(model, df: DataFrame, out: str = "prob", threshold: float | None = None) -> DataFrame:
    """Probability of the positive class, and the decision if a threshold is given."""
    scored = model.transform(df).withColumn(out, vector_to_array("probability")[1])
    scored = scored.select(*df.columns, out)
    if threshold is None:
        return scored
    return scored.withColumn("pred", F.when(F.col(out) >= threshold, 1).otherwise(0))


@dataclass(frozen=True)
class FoldFit:
    """One fold's model, its scored held-out rows, and the rounds kept if the model is staged."""

    fold: object
    model: object
    scored: DataFrame
    rounds: int | None


def fold_fit(
    df: DataFrame, fit: Fit, f, fold: str = "fold", out: str = "prob", resample: Callable | None = None, resample_valid: bool = False
) -> FoldFit:
    """Fit on the other folds and score this one. A staged fit gets the held-out rows to stop on."""
    train, held = df.filter(F.col(fold) != f), df.filter(F.col(fold) == f)
    if resample is not None:
        train = resample(train)
        held = resample(held).withColumn(fold, F.lit(f)) if resample_valid else held
    model = fit(train, held) if isinstance(fit, StagedFit) else fit(train)
    return FoldFit(f, model, score(model, held, out), getattr(model, "rounds", None))


def fold_values(df: DataFrame, fold: str, most: int = 1000) -> list:
    """The folds in order; more than `most` are not folds and raise."""
    found = [r[fold] for r in df.select(fold).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{fold} has more than {most} values")
    return sorted(found)


def cross_val_fits(
    df: DataFrame, fit: Fit, fold: str = "fold", out: str = "prob", resample: Callable | None = None,
    resample_valid: bool = False, parallel: int = 1,
) -> list[FoldFit]:
    folds = fold_values(df, fold)
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        return list(pool.map(lambda f: fold_fit(df, fit, f, fold, out, resample, resample_valid), folds))


def cross_val_oof(
    df: DataFrame, fit: Fit, fold: str = "fold", out: str = "prob", resample: Callable | None = None,
    resample_valid: bool = False, parallel: int = 1,
) -> DataFrame:
    """Every row scored by the model that did not see its fold; a staged model at its best round on that fold.

    `resample` is applied to training rows; with `resample_valid` to the held-out rows too (diagnostic).
    """
    return union_all(*[f.scored for f in cross_val_fits(df, fit, fold, out, resample, resample_valid, parallel)])


def fold_metrics(oof: DataFrame, fold="fold", label="label", prob="prob", threshold: float = 0.5) -> DataFrame:
    """AP, ROC-AUC, precision and recall of each fold in one pass; folds without positives are left out."""
    y, predicted = F.col(label), F.col(prob) >= threshold
    counts = oof.groupBy(fold, F.col(prob).alias("threshold")).agg(
        F.count(F.when(y == 1, 1)).alias("_p"), F.count(F.when(y == 0, 1)).alias("_n")
    )
    totals = oof.groupBy(fold).agg(
        F.count(F.when(y == 1, 1)).alias("pos"), F.count(F.when(y == 0, 1)).alias("neg"),
        F.count(F.when(predicted & (y == 1), 1)).alias("tp_at"), F.count(F.when(predicted, 1)).alias("flagged"),
    )
    curve = running_totals(
        counts, "threshold", {"tp": F.col("_p"), "fp": F.col("_n")}, by=fold, descending=True, parts=256
    ).join(F.broadcast(totals), fold)  # one row per fold
    tp, fp = F.col("tp"), F.col("fp")
    return curve.filter("pos > 0").groupBy(fold).agg(
        F.sum(tp / (tp + fp) * F.col("_p") / F.col("pos")).alias("ap"),
        F.when(F.first("neg") > 0, F.sum(F.col("_p").cast("double") * (F.col("neg") - fp + F.col("_n") / 2))
               / F.first(F.col("pos").cast("double") * F.col("neg"))).alias("roc_auc"),
        ratio(F.first("tp_at"), F.first("flagged")).alias("precision"),
        (F.first("tp_at") / F.first("pos")).alias("recall"),
    )


def cv_metrics(oof: DataFrame, **names) -> dict[str, float | None]:
    """Means over the folds that have positives, and how many those are."""
    per = fold_metrics(oof, **names)
    cols = ("ap", "precision", "recall", "roc_auc")
    return per.agg(*[F.avg(c).alias(c) for c in cols], F.count(F.lit(1)).alias("folds")).first().asDict()


# ---- search ----------------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Range:
    """A parameter range: floats, ints, log scale, or choices."""

    low: float = 0.0
    high: float = 0.0
    log: bool = False
    integer: bool = False
    choices: Sequence = ()

    def draw(self, rng: random.Random):
        if self.choices:
            return rng.choice(list(self.choices))
        if self.log:
            value = math.exp(rng.uniform(math.log(self.low), math.log(self.high)))
        else:
            value = rng.uniform(self.low, self.high)
        return int(min(self.high, math.floor(rng.uniform(self.low, self.high + 1)))) if self.integer else value


# Search ranges by feature set, for logistic regression and boosted trees.
LOGREG_SPACE = {"C": Range(1e-5, 1e2, log=True), "class_weight": Range(choices=(None, "balanced"))}
LOGREG_SPACE_FUSED = {"C": Range(1e-4, 10.0, log=True), "class_weight": Range(choices=(None, "balanced"))}
ELASTIC_RANGE = Range(0.05, 0.95)
GBT_SPACES = {
    "tfidf": {"step": Range(0.03, 0.2, log=True), "max_depth": Range(3, 8, integer=True),
              "min_instances": Range(1, 8, integer=True), "min_gain": Range(0.0, 0.4), "subsample": Range(0.6, 1.0),
              "feature_share": Range(0.2, 0.7)},
    "embedding": {"step": Range(0.01, 0.3, log=True), "max_depth": Range(4, 12, integer=True),
                  "min_instances": Range(1, 12, integer=True), "min_gain": Range(0.0, 0.5),
                  "subsample": Range(0.7, 1.0), "feature_share": Range(0.5, 1.0)},
    "both": {"step": Range(0.02, 0.25, log=True), "max_depth": Range(4, 10, integer=True),
             "min_instances": Range(1, 10, integer=True), "min_gain": Range(0.0, 0.5), "subsample": Range(0.6, 1.0),
             "feature_share": Range(0.3, 0.9)},
}

# Ranges of the leaf-wise booster, in the terms Spark has (leaf counts and leaf penalties do not exist).
GBT_SPACES_LEAFWISE = {
    "tfidf": {"step": Range(0.03, 0.2, log=True), "max_depth": Range(3, 10, integer=True),
              "min_instances": Range(20, 200, integer=True), "min_gain": Range(0.0, 0.2), "subsample": Range(0.6, 1.0),
              "feature_share": Range(0.2, 0.7), "rounds": Range(200, 1500, integer=True)},
    "embedding": {"step": Range(0.02, 0.2, log=True), "max_depth": Range(3, 16, integer=True),
                  "min_instances": Range(10, 100, integer=True), "min_gain": Range(0.0, 0.2),
                  "subsample": Range(0.6, 1.0), "feature_share": Range(0.6, 1.0), "rounds": Range(200, 2000, integer=True)},
    "both": {"step": Range(0.02, 0.2, log=True), "max_depth": Range(3, 14, integer=True),
             "min_instances": Range(20, 150, integer=True), "min_gain": Range(0.0, 0.2), "subsample": Range(0.6, 1.0),
             "feature_share": Range(0.35, 0.9), "rounds": Range(200, 1800, integer=True)},
}


# Ranges for feature sets without their own.
GBT_SPACE_GENERAL = {
    "step": Range(0.02, 0.2, log=True), "max_depth": Range(3, 10, integer=True), "min_instances": Range(1, 10, integer=True),
    "min_gain": Range(0.0, 0.5), "subsample": Range(0.6, 1.0), "feature_share": Range(0.3, 0.9),
}
GBT_SPACE_GENERAL_LEAFWISE = {
    "step": Range(0.03, 0.2, log=True), "max_depth": Range(3, 12, integer=True), "min_instances": Range(20, 150, integer=True),
    "min_gain": Range(0.0, 0.2), "subsample": Range(0.6, 1.0), "feature_share": Range(0.4, 0.9),
    "rounds": Range(200, 1500, integer=True),
}


def space_for(dataset: str, leafwise: bool = False) -> dict[str, Range]:
    """The search ranges of a feature set; other names get the general ranges."""
    if leafwise:
        return dict(GBT_SPACES_LEAFWISE.get(dataset, GBT_SPACE_GENERAL_LEAFWISE))
    return dict(GBT_SPACES.get(dataset, GBT_SPACE_GENERAL))


@dataclass
class SearchResult:
    """Completed trials, the best of them, and why the others have no score.

    `pruned` gives the reason of each trial that was given up, `fits` the number of folds fitted by every trial, and
    `rounds` the mean best round of each staged trial.
    """

    trials: DataFrame
    best_params: dict
    best_value: float
    failed: list[int] = field(default_factory=list)
    pruned: dict[int, str] = field(default_factory=dict)
    fits: dict[int, int] = field(default_factory=dict)
    rounds: dict[int, float] = field(default_factory=dict)


NO_POSITIVES, CANNOT_WIN = "a fold without positives", "cannot reach the best trial"
METRICS = ("ap", "precision", "recall", "roc_auc")


class _Trial:
    """One trial's folds. Giving it up cancels the Spark jobs of its folds by their tag."""

    def __init__(self, number: int, params: dict, context):
        self.number, self.params, self.context = number, params, context
        self.tag = f"stayline-trial-{uuid.uuid4().hex}"
        self.values: list[dict[str, float]] = []
        self.rounds: list[int] = []
        self.fits = 0
        self.reason: str | None = None

    def give_up(self, reason: str) -> None:
        if self.reason is None:
            self.reason = reason
            self.context.cancelJobsWithTag(self.tag)

    def mean(self, name: str) -> float | None:
        found = [v[name] for v in self.values if v[name] is not None]
        return sum(found) / len(found) if found else None


class _Search:
    """Trials over one table, which share the best value found so far."""

    def __init__(self, df: DataFrame, folds: list, metric: str, fold: str, label: str, resample, prune: bool, need_all: bool):
        self.df, self.folds, self.metric, self.fold, self.label = df, folds, metric, fold, label
        self.resample, self.prune, self.need_all = resample, prune, need_all
        self.lock = threading.Lock()
        self.best: float | None = None
        self.drawn: dict = {}
        self.drawing = {f: threading.Lock() for f in folds}

    def resampled(self, f, train: DataFrame) -> DataFrame:
        """Rows of the sampler for a fold; those given if it refuses them (a minority that is too small).

        They are the same for every trial, so the first to ask has them drawn and stored. If it is given up meanwhile, the next one does.
        """
        with self.drawing[f]:
            if f not in self.drawn:
                try:
                    rows = self.resample(train)
                except ValueError:
                    self.drawn[f] = train
                else:
                    self.drawn[f] = even_parts(rows)
            return self.drawn[f]

    def one_fold(self, trial: _Trial, fit: Fit, f) -> None:
        context = self.df.sparkSession.sparkContext
        context.addJobTag(trial.tag)  # tags belong to this thread
        try:
            if trial.reason is not None:
                return
            with self.lock:
                trial.fits += 1
            made = fold_fit(self.df, fit, f, self.fold, resample=None if self.resample is None else partial(self.resampled, f))
            row = fold_metrics(cut_lineage(made.scored), self.fold, self.label).first()
            with self.lock:
                if made.rounds is not None:
                    trial.rounds.append(made.rounds)
                if row is not None:
                    trial.values.append({m: row[m] for m in METRICS})
            if row is None and self.need_all:
                trial.give_up(NO_POSITIVES)
            elif self.prune:
                self.look(trial)
        except Exception:
            if trial.reason is None:
                raise
        finally:
            context.removeJobTag(trial.tag)

    def look(self, trial: _Trial) -> None:
        """Give up a trial that stays below the best even if its other folds are perfect (no metric is above 1)."""
        with self.lock:
            found = [v[self.metric] for v in trial.values if v[self.metric] is not None]
            open_folds = len(self.folds) - len(trial.values)
            # folds without positives may drop out of the mean: the most it can reach is with all open folds in it
            hopeless = self.best is not None and bool(found) and (sum(found) + open_folds) / (len(found) + open_folds) < self.best
        if hopeless:
            trial.give_up(CANNOT_WIN)

    def run(self, trial: _Trial, fit: Fit, parallel: int) -> _Trial:
        if parallel == 1:
            for f in self.folds:
                self.one_fold(trial, fit, f)
        else:
            with ThreadPoolExecutor(max_workers=parallel) as pool:
                for done in as_completed([pool.submit(self.one_fold, trial, fit, f) for f in self.folds]):
                    done.result()
        value = trial.mean(self.metric)
        with self.lock:
            if trial.reason is None and value is not None and (self.best is None or value > self.best):
                self.best = value
        return trial


def param_search(
    df: DataFrame, make_fit: Callable[..., Fit], space: Mapping[str, Range], n_trials: int = 10, metric: str = "ap",
    seed: int = 42, fold: str = "fold", label: str = "label", parallel: int = 2, need_all_folds: bool = False,
    resample: Callable | None = None, prune: bool = False, parallel_folds: int = 1, **fixed,
) -> SearchResult:
    """Seeded random search; trials, and with `parallel_folds` their folds, are concurrent Spark jobs.

    `resample` is applied to the training rows of every fold, once for all trials. With `need_all_folds` a trial is given up at its first fold
    without positives, else such folds are left out of its means. With `prune` a trial is given up once it can't reach the best one.
    The running jobs of a trial that is given up are cancelled. The best trial is the same with and without pruning.
    """
    folds = fold_values(df, fold)
    context = df.sparkSession.sparkContext
    rng = random.Random(seed)
    trials = [_Trial(n, {name: r.draw(rng) for name, r in space.items()}, context) for n in range(n_trials)]
    search = _Search(df, folds, metric, fold, label, resample, prune, need_all_folds)
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        list(pool.map(lambda t: search.run(t, make_fit(label=label, **t.params, **fixed), parallel_folds), trials))
    complete = [t for t in trials if t.reason is None and t.mean(metric) is not None]
    if not complete:
        raise ValueError(f"none of the {len(trials)} trials has a {metric} for its folds")
    best = max(complete, key=lambda t: (t.mean(metric), -t.number))
    rows = [(t.number, *[t.mean(m) for m in METRICS], {k: str(v) for k, v in t.params.items()}) for t in complete]
    schema = "trial int, ap double, precision double, recall double, roc_auc double, params map<string,string>"
    return SearchResult(
        df.sparkSession.createDataFrame(rows, schema), best.params, best.mean(metric),
        [t.number for t in trials if t not in complete], {t.number: t.reason for t in trials if t.reason},
        {t.number: t.fits for t in trials}, {t.number: sum(t.rounds) / len(t.rounds) for t in trials if t.rounds},
    )


def penalty_summary(
    df: DataFrame, penalties: Iterable[str] = ("l1", "l2", "elasticnet"), n_trials: int = 3, metric: str = "roc_auc",
    seed: int = 42, fold="fold", label="label", space: Mapping[str, Range] = LOGREG_SPACE, parallel: int = 3, **fixed,
) -> DataFrame:
    """Best trial of each penalty with its out-of-fold metrics and F1 threshold; penalties are concurrent jobs."""

    def summary(penalty: str) -> tuple:
        ranges = {**space, "l1_ratio": ELASTIC_RANGE} if penalty == "elasticnet" else dict(space)
        found = param_search(df, logreg_fit, ranges, n_trials, metric, seed, fold, label, penalty=penalty, **fixed)
        oof = cut_lineage(cross_val_oof(df, logreg_fit(label=label, penalty=penalty, **found.best_params, **fixed), fold))
        ranks = rank_metrics(oof, label)
        point = select_threshold(oof, "f1", label=label).first()
        at = threshold_metrics(oof, point["threshold"], label).first()
        return (penalty, ranks["roc_auc"], ranks["average_precision"], at["f1"], at["precision"], at["recall"],
                point["threshold"], {k: str(v) for k, v in found.best_params.items()})

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        rows = list(pool.map(summary, penalties))
    schema = ("penalty string, roc_auc double, avg_precision double, f1 double, precision double, recall double, "
              "threshold double, best_params map<string,string>")
    return df.sparkSession.createDataFrame(rows, schema)


# ---- stacking --------------------------------------------------------------------------------------------------------

@dataclass
class Stack:
    """Base models refitted on all rows and a logistic model on their probabilities."""

    bases: dict[str, object]
    meta: object
    features: str
    passthrough: bool

    def transform(self, df: DataFrame, out: str = "prob") -> DataFrame:
        columns = df.columns
        for name, model in self.bases.items():
            df = score(model, df, f"_p_{name}")
        joined = assemble_bases(df, list(self.bases), self.features if self.passthrough else None)
        return score(self.meta, joined, out).select(*columns, out)


def assemble_bases(df: DataFrame, names: Sequence[str], features: str | None) -> DataFrame:
    inputs = [f"_p_{n}" for n in names] + ([features] if features else [])
    return VectorAssembler(inputCols=inputs, outputCol="_stacked").transform(df)


def fit_stack(
    df: DataFrame, bases: Mapping[str, Fit], key: str, label="label", features="features", fold="fold",
    passthrough: bool = False, meta_c: float = 1.0,
) -> Stack:
    """Meta model from out-of-fold base probabilities, then base models on all rows."""
    oof = df
    for name, fit in bases.items():
        probs = cross_val_oof(df, fit, fold, f"_p_{name}").select(key, f"_p_{name}")
        oof = oof.join(probs, key)
    stacked = cut_lineage(assemble_bases(oof, list(bases), features if passthrough else None))
    meta = logreg_fit(label, "_stacked", C=meta_c)(stacked)
    return Stack({n: fit(df) for n, fit in bases.items()}, meta, features, passthrough)
