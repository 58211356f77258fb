"""Metrics against direct computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.operators import metrics as ME
from stayline.plans import models as MO


def frame(spark, pairs):
    return spark.createDataFrame([(int(y), float(p)) for y, p in pairs], "label int, prob double")


def direct(pairs):
    y, p = np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])
    pos, neg = p[y == 1], p[y == 0]
    auc = float(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])) if len(pos) and len(neg) else None
    ap, prev = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        tp, n = ((p >= t) & (y == 1)).sum(), (p >= t).sum()
        recall = tp / max(1, (y == 1).sum())
        ap += (recall - prev) * tp / n
        prev = recall
    return auc, ap


RNG = np.random.default_rng(3)
TIED = [(int(RNG.random() < 0.3), round(float(RNG.random()), 1)) for _ in range(300)]
LOOSE = [(int(RNG.random() < 0.1), float(RNG.random()) ** 5) for _ in range(500)]


@pytest.mark.parametrize("pairs", [TIED, LOOSE, [(1, 0.5), (0, 0.5), (1, 0.5)], [(1, 0.2), (1, 0.9)], [(0, 0.2), (0, 0.9)]])
def test_rank_metrics(spark, pairs):
    df = frame(spark, pairs).repartition(3)
    auc, ap = direct(pairs)
    assert ME.roc_auc(df).first()[0] == (pytest.approx(auc) if auc is not None else None)
    assert ME.average_precision(df).first()[0] == pytest.approx(ap)
    both = ME.rank_metrics(df)
    assert both["average_precision"] == pytest.approx(ap)


def test_fold_metrics_match_single_curves(spark):
    df = frame(spark, TIED).withColumn("fold", (F.col("prob") * 10).cast("int") % 2)
    for r in MO.fold_metrics(df).collect():
        part = ME.rank_metrics(df.filter(F.col("fold") == r["fold"]))
        assert r["ap"] == pytest.approx(part["average_precision"]) and r["roc_auc"] == pytest.approx(part["roc_auc"])
    none = frame(spark, [(0, 0.1), (1, 0.2), (0, 0.3)]).withColumn("fold", (F.col("prob") > 0.25).cast("int"))
    assert [r["fold"] for r in MO.fold_metrics(none).collect()] == [0]


def test_select_threshold(spark):
    df = frame(spark, LOOSE)
    y, p = np.array([a for a, _ in LOOSE]), np.array([b for _, b in LOOSE])

    def at(t):
        tp, n = ((p >= t) & (y == 1)).sum(), (p >= t).sum()
        return tp / n, tp / y.sum()

    def f1(t):
        a, b = at(t)
        return 0.0 if a + b == 0 else 2 * a * b / (a + b)

    best = ME.select_threshold(df).first()
    assert best["f1"] == pytest.approx(max(f1(t) for t in set(p)))
    shifted = ME.select_threshold(df, compat_shift=True).first()
    assert shifted["threshold"] == pytest.approx(max([t for t in p if t < best["threshold"]], default=0.0))
    bound = ME.select_threshold(df, "precision_at_recall", min_recall=0.5).first()
    assert bound["precision"] == pytest.approx(max(at(t)[0] for t in set(p) if at(t)[1] >= 0.5))
    for kind in ("precision_at_recall", "recall_at_precision", "other"):
        with pytest.raises(ValueError):
            ME.select_threshold(df, kind)


def test_threshold_metrics_without_predictions(spark):
    row = ME.threshold_metrics(frame(spark, [(1, 0.1), (0, 0.2)]), 0.9).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)


def test_sweep_matches_single_thresholds(spark):
    df = frame(spark, TIED)
    sweep = {round(r["threshold"], 6): r for r in ME.threshold_sweep(df).collect()}
    assert len(sweep) == 100
    for t in list(sweep)[::17]:
        one = ME.threshold_metrics(df, sweep[t]["threshold"]).first()
        for c in ("precision", "recall", "f1"):
            assert sweep[t][c] == pytest.approx(one[c])


def test_confusion_grid_is_complete(spark):
    assert sorted(tuple(r) for r in ME.confusion_pct(frame(spark, [(1, 0.9), (1, 0.8)])).collect()) == [
        (0, 0, 0.0), (0, 1, 0.0), (1, 0, 0.0), (1, 1, 100.0)]


def test_weights():
    assert MO.scale_pos_weight(1, 99) == 99 and MO.scale_pos_weight(14, 86) == 3.0 and MO.scale_pos_weight(40, 60) == 1.0
    assert MO.scale_pos_weight(14, 86, "rare-only") is None and MO.scale_pos_weight(1, 4, "always") == 4
    space = {"x": MO.Range(1, 3, integer=True), "y": MO.Range(1e-3, 1.0, log=True), "z": MO.Range(choices=(None, "b"))}
    import random

    draws = [{k: r.draw(random.Random(s)) for k, r in space.items()} for s in range(50)]
    assert {d["x"] for d in draws} == {1, 2, 3} and all(1e-3 <= d["y"] <= 1 for d in draws) and {d["z"] for d in draws} == {None, "b"}


def test_imbalance_policy(spark):
    rare = ME.imbalance_policy(frame(spark, [(1, 0)] + [(0, 0)] * 99)).first()
    assert (rare["primary_metric"], rare["weight_capped"], rare["weight_rare_only"]) == ("average_precision", 99.0, 99.0)
    mild = ME.imbalance_policy(frame(spark, [(1, 0)] * 14 + [(0, 0)] * 86)).first()
    assert (mild["primary_metric"], mild["weight_capped"], mild["weight_rare_only"]) == ("roc_auc", 3.0, None)
