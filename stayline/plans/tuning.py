"""The tuning job: search, out-of-fold scores, threshold, final fit, and a bundle that is read whole or not at all."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.operators.limits import union_all
from stayline.operators.metrics import rank_metrics, select_threshold, threshold_metrics
from stayline.plans.models import Fit, Range, cross_val_fits, param_search, scale_pos_weight, score
from stayline.session import cut_lineage, even_parts

COMMITS = "version string, committed timestamp"
TABLES = ("trials", "oof", "metrics")


@dataclass
class Bundle:
    """A tuned model with its serving settings, trials, out-of-fold scores and metrics."""

    model: object
    serving: dict
    trials: DataFrame
    oof: DataFrame
    metrics: DataFrame

    def score(self, df: DataFrame, out: str = "prob") -> DataFrame:
        """Probability and decision by the tuned threshold."""
        return score(self.model, df, out, threshold=self.serving["threshold"])


def save_bundle(bundle: Bundle, path: str) -> str:
    """Write a new version below `path`; the row appended to its commits at the end makes it visible.

    Every version has a folder of its own, so a job that dies, or two at a time, leave earlier versions as they are.
    """
    spark, version = bundle.trials.sparkSession, uuid.uuid4().hex
    at = f"{path.rstrip('/')}/{version}"
    bundle.model.write().save(f"{at}/model")
    for name in TABLES:
        getattr(bundle, name).write.parquet(f"{at}/{name}")
    settings = spark.createDataFrame([(json.dumps(bundle.serving),)], "serving string")
    settings.coalesce(1).write.parquet(f"{at}/serving")
    commit = spark.createDataFrame([(version,)], "version string").withColumn("committed", F.current_timestamp())
    commit.coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/commits")
    return version


def load_bundle(spark: SparkSession, path: str, version: str | None = None) -> Bundle:
    """A committed version, the latest if none is named; without a commit there is nothing to load."""
    base = path.rstrip("/")
    commits = spark.read.schema(COMMITS).parquet(f"{base}/commits")
    chosen = commits if version is None else commits.filter(F.col("version") == version)
    row = chosen.orderBy(F.desc("committed"), "version").first()
    if row is None:
        raise ValueError(f"no committed version{'' if version is None else ' ' + version} below {path}")
    at = f"{base}/{row['version']}"
    serving = json.loads(spark.read.parquet(f"{at}/serving").first()["serving"])
    return Bundle(PipelineModel.load(f"{at}/model"), serving, *[spark.read.parquet(f"{at}/{name}") for name in TABLES])


def tune(
    df: DataFrame, make_fit: Callable[..., Fit], space: Mapping[str, Range], *, dataset: str, key: str, n_trials: int = 10,
    metric: str = "ap", strategy: str | None = "f1", threshold_args: Mapping | None = None, resample: Callable | None = None,
    final_resample: Callable | None = None, weight_rule: str | None = "capped", features: Sequence[str] | None = None,
    fold: str = "fold", label: str = "label", seed: int = 42, parallel: int = 2, prune: bool = True, **fixed,
) -> Bundle:
    """Search, out-of-fold scores of the best trial, a threshold from them, and a final fit on all rows.

    Positives weigh by `weight_rule`. Folds of a staged fit stop at their best held-out round, and the final fit runs for the
    mean of those rounds. Without a `strategy` the threshold is 0.5. `resample` is for the folds of the search, `final_resample`
    for the final fit; out-of-fold scores come from rows as they are.
    """
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos")).first()
    n, pos = counts["n"], int(counts["pos"] or 0)
    if weight_rule is not None:
        fixed = {**fixed, "class_weight": scale_pos_weight(pos, n - pos, weight_rule)}
    found = param_search(
        df, make_fit, space, n_trials, metric, seed, fold, label, parallel, need_all_folds=True, resample=resample, prune=prune, **fixed
    )
    fit = make_fit(label=label, **{**fixed, **found.best_params})
    fits = cross_val_fits(df, fit, fold, parallel=parallel)
    oof = cut_lineage(union_all(*[f.scored.select(key, label, fold, "prob") for f in fits]))
    rounds = [f.rounds for f in fits if f.rounds is not None]
    threshold = 0.5
    if strategy is not None:
        threshold = float(select_threshold(oof, strategy, label=label, **(threshold_args or {})).first()["threshold"])
    ranks = rank_metrics(oof, label)
    metrics = threshold_metrics(oof, threshold, label).withColumns(
        {"ap": F.lit(ranks["average_precision"]).cast("double"), "roc_auc": F.lit(ranks["roc_auc"]).cast("double")}
    )
    final = {**fixed, **found.best_params}
    if rounds:
        final["rounds"] = max(1, round(sum(rounds) / len(rounds)))
    rows = df if final_resample is None else even_parts(final_resample(df))
    model = make_fit(label=label, **final)(rows)
    serving = {
        "dataset": dataset, "tuned_at": dt.datetime.now(dt.timezone.utc).isoformat(), "rows": n, "pos_rate": pos / n if n else None,
        "best_params": found.best_params, "best_value": found.best_value, "final_params": {k: v for k, v in final.items() if _plain(v)},
        "threshold": threshold, "threshold_strategy": strategy or "fixed", "fold_rounds": rounds,
        "pruned": {str(k): v for k, v in found.pruned.items()}, "features": list(features) if features is not None else None,
    }
    return Bundle(model, serving, found.trials, oof, metrics)


def _plain(value) -> bool:
    return value is None or isinstance(value, (bool, int, float, str))

