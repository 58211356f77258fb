"""Ranking and threshold metrics on tables of (label, score).

Scores are first merged to one row per distinct value; running sums over them use value ranges, so no task
sees all scores.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.functions.ordering import PARTS, number_array, range_cuts, range_index, running_totals
from stayline.functions.scalars import ratio


def score_counts(df: DataFrame, label: str = "label", score: str = "prob") -> DataFrame:
    y = F.col(label)
    return df.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.count(F.when(y == 1, 1)).alias("_p"), F.count(F.when(y == 0, 1)).alias("_n")
    ).filter(F.col("threshold").isNotNull())


def pr_curve(df: DataFrame, label: str = "label", score: str = "prob", parts: int = PARTS) -> DataFrame:
    """tp, fp, precision and recall of `score >= threshold` for every distinct score."""
    counts = score_counts(df, label, score)
    plan = counts.agg(
        F.sum("_p").alias("pos"), F.sum("_n").alias("neg"), range_cuts("threshold", parts).alias("edges")
    ).first()
    pos, neg, edges = plan["pos"] or 0, plan["neg"] or 0, list(plan["edges"] or [])
    sums = {"tp": F.col("_p"), "fp": F.col("_n")}
    ranked = running_totals(counts, "threshold", sums, descending=True, parts=parts, edges=edges)
    tp, fp = F.col("tp"), F.col("fp")
    return ranked.select(
        "threshold", "tp", "fp", F.lit(pos).cast("long").alias("pos"), F.lit(neg).cast("long").alias("neg"),
        F.col("_p").alias("tp_at"), F.col("_n").alias("fp_at"),
        ratio(tp, tp + fp).alias("precision"), (F.lit(1.0) if pos == 0 else tp / F.lit(pos)).alias("recall"),
    )


def average_precision(df: DataFrame, label: str = "label", score: str = "prob") -> DataFrame:
    """Sum of precision times recall step (no interpolation); 0 without positives."""
    return _average_precision(pr_curve(df, label, score))


def _average_precision(curve: DataFrame) -> DataFrame:
    step = F.when(F.col("pos") > 0, F.col("precision") * F.col("tp_at") / F.col("pos")).otherwise(0.0)
    return curve.agg(F.sum(step).alias("average_precision"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "prob") -> DataFrame:
    """Share of positive-negative pairs ranked right, ties counted half; NULL if one class is missing."""
    return _roc_auc(pr_curve(df, label, score))


def _roc_auc(curve: DataFrame) -> DataFrame:
    # each positive outranks the negatives below its score and half of those at it
    wins = F.col("tp_at").cast("double") * (F.col("neg") - F.col("fp") + F.col("fp_at") / 2)
    pairs = F.max("pos").cast("double") * F.max("neg")
    return curve.agg(F.when(pairs > 0, F.sum(wins) / pairs).alias("roc_auc"))


def rank_metrics(df: DataFrame, label: str = "label", score: str = "prob") -> dict[str, float | None]:
    """Average precision and ROC-AUC from one pass over the curve."""
    curve = pr_curve(df, label, score)
    wins = F.col("tp_at").cast("double") * (F.col("neg") - F.col("fp") + F.col("fp_at") / 2)
    step = F.when(F.col("pos") > 0, F.col("precision") * F.col("tp_at") / F.col("pos")).otherwise(0.0)
    pairs = F.max("pos").cast("double") * F.max("neg")
    row = curve.agg(
        F.sum(step).alias("average_precision"), F.when(pairs > 0, F.sum(wins) / pairs).alias("roc_auc"),
        F.max("pos").alias("pos"),
    ).first()
    return row.asDict()


def _counts_at(label: str, predicted: Column) -> list[Column]:
    y = F.col(label)
    return [
        F.count(F.when(predicted & (y == 1), 1)).alias("tp"), F.count(F.when(predicted & (y == 0), 1)).alias("fp"),
        F.count(F.when(~predicted & (y == 1), 1)).alias("fn"), F.count(F.when(~predicted & (y == 0), 1)).alias("tn"),
    ]


def fbeta(precision, recall, beta: float = 1.0) -> Column:
    p = F.col(precision) if isinstance(precision, str) else precision
    r = F.col(recall) if isinstance(recall, str) else recall
    b = beta * beta
    return ratio((1 + b) * p * r, b * p + r)


def threshold_metrics(df: DataFrame, threshold: float = 0.5, label="label", score="prob") -> DataFrame:
    """Confusion counts, precision, recall and F1 at a threshold; 0 where a denominator is 0."""
    counts = df.agg(*_counts_at(label, F.col(score) >= threshold))
    rates = counts.select(
        F.lit(float(threshold)).alias("threshold"), "tp", "fp", "fn", "tn",
        ratio("tp", F.col("tp") + F.col("fp")).alias("precision"), ratio("tp", F.col("tp") + F.col("fn")).alias("recall"),
    )
    return rates.withColumn("f1", fbeta("precision", "recall"))


STRATEGIES = ("f1", "fbeta", "precision_at_recall", "recall_at_precision")


def select_threshold(
    df: DataFrame, strategy: str = "f1", *, beta: float = 1.0, min_precision: float | None = None,
    min_recall: float | None = None, label="label", score="prob", compat_shift: bool = False,
) -> DataFrame:
    """One row: the best threshold of a strategy; ties take the lowest threshold.

    If no point meets the bound, the point with the best bounded value is taken. With `compat_shift` each
    point reports the next lower score (0 for the lowest), as the misaligned arrays of the source do.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"{strategy!r} is none of {sorted(STRATEGIES)}")
    if strategy == "precision_at_recall" and min_recall is None:
        raise ValueError("precision_at_recall needs a recall bound")
    if strategy == "recall_at_precision" and min_precision is None:
        raise ValueError("recall_at_precision needs a precision bound")
    curve = pr_curve(df, label, score).withColumns({
        "f1": fbeta("precision", "recall"), "fbeta": fbeta("precision", "recall", beta)
    })
    p, r, low = F.col("precision"), F.col("recall"), -F.col("threshold")
    if strategy in ("f1", "fbeta"):
        rank = F.struct(F.col(strategy).alias("a"), low.alias("b"), low.alias("c"))
    elif strategy == "precision_at_recall":
        ok = r >= min_recall
        rank = F.struct(ok.alias("a"), F.when(ok, p).otherwise(r).alias("b"), low.alias("c"))
    else:
        ok = p >= min_precision
        rank = F.struct(ok.alias("a"), F.when(ok, r).otherwise(p).alias("b"), low.alias("c"))
    point = F.struct("threshold", "precision", "recall", "f1", "fbeta")
    best = curve.agg(F.max_by(point, rank).alias("_b")).select("_b.*")
    if compat_shift:
        chosen = F.lit(best.first()["threshold"])
        lower = df.agg(F.max(F.when(F.col(score) < chosen, F.col(score)))).first()[0]
        best = best.withColumn("threshold", F.lit(float(lower or 0.0)))
    return best.withColumn("strategy", F.lit(strategy))


def threshold_grid(n: int = 100, lo: float = 0.01, hi: float = 0.99) -> list[float]:
    return [float(x) for x in np.linspace(lo, hi, n)]


def threshold_sweep(df: DataFrame, grid: list[float] | None = None, label="label", score="prob") -> DataFrame:
    """Precision, recall, F0.5, F1 and F2 at every grid threshold.

    Each row is counted once, under the highest grid threshold it reaches; sums over the grid give the rest.
    """
    df = df.filter(F.col(score).isNotNull())  # as everywhere here, rows without a score don't count
    grid = sorted(grid or threshold_grid())
    parts = 1 << len(grid).bit_length()
    padded = grid + [float("inf")] * (parts - 1 - len(grid))
    reached = range_index(score, padded, parts, inclusive=True)
    levels = number_array(grid)
    counts = df.groupBy(reached.alias("_k")).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("_p"), F.count(F.when(F.col(label) == 0, 1)).alias("_n")
    )
    # at most len(grid)+1 rows per step from here on
    reach = counts.select(F.explode(F.sequence(F.lit(0), "_k")).alias("_i"), "_p", "_n")
    every = df.sparkSession.range(len(grid) + 1).select(
        F.col("id").cast("int").alias("_i"), F.lit(0).cast("long").alias("_p"), F.lit(0).cast("long").alias("_n")
    )
    sums = reach.unionByName(every).groupBy("_i").agg(F.sum("_p").alias("tp"), F.sum("_n").alias("fp"))
    # every positive reaches level 0, so the largest count is the number of positives
    whole = sums.withColumn("_pos", F.max("tp").over(Window.partitionBy(F.lit(0))))
    out = whole.filter("_i > 0")
    out = out.select(
        F.element_at(levels, F.col("_i")).alias("threshold"),
        ratio("tp", F.col("tp") + F.col("fp")).alias("precision"), ratio("tp", "_pos").alias("recall"),
    )
    return out.select(
        "*", fbeta("precision", "recall", 0.5).alias("f05"), fbeta("precision", "recall").alias("f1"),
        fbeta("precision", "recall", 2.0).alias("f2"),
    )


def classification_report(df: DataFrame, threshold: float = 0.5, label="label", score="prob") -> DataFrame:
    """Per class, accuracy, macro and weighted rows; all values in percent with two decimals."""
    c = df.agg(*_counts_at(label, F.col(score) >= threshold)).withColumn(
        "n", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    )
    tp, fp, fn, tn, n = (F.col(x) for x in ("tp", "fp", "fn", "tn", "n"))
    p1, r1, p0, r0 = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fn), ratio(tn, tn + fp)
    f1, f0 = fbeta(p1, r1), fbeta(p0, r0)
    w1, w0, acc = ratio(tp + fn, n), ratio(tn + fp, n), ratio(tp + tn, n)

    def line(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"), s.alias("support"))

    lines = F.array(
        line("0", p0, r0, f0, w0), line("1", p1, r1, f1, w1),
        # the accuracy row carries the accuracy in every column, as in the usual report
        line("accuracy", acc, acc, acc, acc / n),
        line("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, F.lit(1.0)),
        line("weighted avg", w0 * p0 + w1 * p1, w0 * r0 + w1 * r1, w0 * f0 + w1 * f1, F.lit(1.0)),
    )
    return c.select(F.explode(lines).alias("l")).select(
        "l.class", *[F.round(100 * F.col(f"l.{x}"), 2).alias(x) for x in ("precision", "recall", "f1")],
        F.round(100 * F.col("l.support"), 2).alias("support_pct"),
    )


def confusion_pct(df: DataFrame, threshold: float = 0.5, label="label", score="prob") -> DataFrame:
    """All four cells as percent of all rows, empty cells as 0."""
    c = df.agg(*_counts_at(label, F.col(score) >= threshold))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    cells = F.array(*[
        F.struct(F.lit(t).alias("true"), F.lit(p).alias("pred"), F.round(100 * ratio(name, n), 2).alias("pct"))
        for t, p, name in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
    ])
    return c.select(F.explode(cells).alias("c")).select("c.*")


def imbalance_policy(df: DataFrame, label: str = "label") -> DataFrame:
    """Primary metric and the three class weights from the share of positives."""
    row = df.agg(F.sum(F.col(label)).cast("double").alias("_p"), F.count(label).cast("double").alias("_n"))
    rate, odds = F.col("_p") / F.col("_n"), (F.col("_n") - F.col("_p")) / F.greatest(F.col("_p"), F.lit(1e-12))
    return row.select(
        rate.alias("pos_rate"), F.when(rate >= 0.05, "roc_auc").otherwise("average_precision").alias("primary_metric"),
        F.when(rate < 0.05, odds).when(rate < 0.20, F.least(odds, F.lit(3.0))).otherwise(1.0).alias("weight_capped"),
        F.when(rate < 0.05, odds).alias("weight_rare_only"), odds.alias("weight_always"),
    )
