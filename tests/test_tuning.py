"""Held-out stopping, trials that are given up, and bundles that are read whole or not at all."""

import math
import random
import threading
import time

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from stayline.operators import sampling as SA
from stayline.plans import models as MO
from stayline.plans import tuning as TU
from stayline.session import even_parts


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(3)
    data = []
    for i in range(240):
        x = [r.gauss(0, 1) for _ in range(3)]
        y = int(x[0] + 0.5 * x[1] + r.gauss(0, 1) > 0.8)
        data.append((i, y, Vectors.dense(x), i % 3))
    return spark.createDataFrame(data, ["doc_id", "label", "features", "fold"]).cache()


def test_best_round_looks_on_for_patience():
    assert MO.best_round([3, 2, 2.5, 1, 4, 5, 6], 2) == 4
    assert MO.best_round([3, 2, 2.5, 2.6, 1], 2) == 2
    assert MO.best_round([3, 2, 2.5, 2.6, 1], 10) == 5
    assert MO.best_round([1.0], 1) == 1
    assert MO.best_round([1, 1, 1], 5) == 1


def test_prefix_scores_are_those_of_the_shorter_fit(rows):
    """Boosting adds trees one by one, so the first trees are the model of as many rounds."""
    staged = MO.staged_gbt_fit(rounds=8, max_depth=2)(rows.filter("fold > 0"), rows.filter("fold = 0"))
    short = MO.gbt_fit(rounds=3, max_depth=2)(rows.filter("fold > 0"))
    a = MO.score(MO.StagedModel(staged.model, 3, staged.losses), rows).orderBy("doc_id").collect()
    b = MO.score(short, rows).orderBy("doc_id").collect()
    assert all(math.isclose(x["prob"], y["prob"], abs_tol=1e-12) for x, y in zip(a, b))
    assert a[0].asDict().keys() == b[0].asDict().keys()


def test_folds_stop_at_their_least_loss(rows):
    fits = MO.cross_val_fits(rows, MO.staged_gbt_fit(rounds=15, max_depth=4, patience=15))
    assert [f.fold for f in fits] == [0, 1, 2]
    for f in fits:
        assert f.model.losses[f.rounds - 1] == min(f.model.losses) and len(f.model.losses) == 15
    oof = MO.cross_val_oof(rows, MO.staged_gbt_fit(rounds=15, max_depth=4, patience=15))
    assert oof.count() == 240 and oof.filter("prob between 0 and 1").count() == 240


def test_held_rows_of_one_class_leave_stopping_to_the_training_rows(rows):
    staged = MO.staged_gbt_fit(rounds=5, max_depth=2)(rows.filter("fold > 0"), rows.filter("fold = 0 and label = 0"))
    train = rows.filter("fold > 0").withColumn(MO.WEIGHT, F.lit(1.0))
    assert list(staged.losses) == pytest.approx(staged.model.stages[-1].evaluateEachIteration(train))


class Model:
    def __init__(self, value):
        self.value = value

    def transform(self, df):
        from pyspark.ml.functions import array_to_vector

        p = F.when(F.col("label") == 1, self.value).otherwise(1.0 - self.value)
        return df.withColumn("probability", array_to_vector(F.array(1 - p, p)))


def fixed_fits(calls):
    """Fits whose average precision is 1 or about the share of positives, and that note their calls."""

    def make(label, value):
        def fit(train):
            calls.append((value, threading.get_ident()))
            return Model(value)

        return fit

    return make


def test_hopeless_trials_are_given_up(rows):
    space = {"value": MO.Range(choices=(0.9, 0.1))}
    plain_calls, pruned_calls = [], []
    plain = MO.param_search(rows, fixed_fits(plain_calls), space, 6, seed=4, parallel=1)
    pruned = MO.param_search(rows, fixed_fits(pruned_calls), space, 6, seed=4, parallel=1, prune=True)
    assert plain.best_params == pruned.best_params == {"value": 0.9} and pruned.best_value == plain.best_value == 1.0
    assert not plain.pruned and set(pruned.pruned.values()) == {MO.CANNOT_WIN}
    assert all(pruned.fits[n] == 1 for n in pruned.pruned) and len(plain_calls) == 18
    assert len(pruned_calls) == sum(pruned.fits.values()) < 18
    assert pruned.trials.count() == 6 - len(pruned.pruned)


def test_folds_without_positives_end_a_trial_at_once(spark, rows):
    calls = []
    bare = rows.withColumn("label", F.when(F.col("fold") == 0, 0).otherwise(F.col("label")))
    with pytest.raises(ValueError, match="none of the 2 trials"):
        MO.param_search(bare, fixed_fits(calls), {"value": MO.Range(choices=(0.9,))}, 2, parallel=1, need_all_folds=True)
    assert len(calls) == 2  # one fold of each trial
    kept = MO.param_search(bare, fixed_fits([]), {"value": MO.Range(choices=(0.9,))}, 2, parallel=1)
    assert kept.best_value == 1.0


def test_running_jobs_of_a_trial_given_up_are_cancelled(spark, rows):
    bare = rows.withColumn("label", F.when(F.col("fold") == 0, 0).otherwise(F.col("label")))

    def make(label, **_):
        def fit(train):
            if train.filter("fold = 0").isEmpty():
                return Model(0.9)  # the fold without positives answers at once

            def slow(batches):
                for b in batches:
                    time.sleep(60)
                    yield b

            train.select("doc_id").repartition(1).mapInArrow(slow, "doc_id long").count()
            return Model(0.9)

        return fit

    def run():
        with pytest.raises(ValueError, match="none of the 1 trials"):
            MO.param_search(bare.drop("features"), make, {}, 1, parallel=1, need_all_folds=True, parallel_folds=3)

    start = time.time()
    run()
    assert time.time() - start < 45


def test_errors_of_a_trial_are_not_hidden(rows):
    def make(label, **_):
        def fit(train):
            raise RuntimeError("broken")

        return fit

    with pytest.raises(RuntimeError, match="broken"):
        MO.param_search(rows, make, {}, 1, parallel=1, prune=True)


def test_trials_are_resampled_and_a_refusal_leaves_rows_as_they_are(rows):
    seen = []

    def make(label, **_):
        def fit(train):
            seen.append(train.count())
            return Model(0.9)

        return fit

    ros = lambda df: SA.random_oversample(df, "doc_id", "label", ratio=1.0).drop("draw")
    MO.param_search(rows, make, {}, 1, parallel=1, resample=ros)

    def refuse(df):
        raise ValueError("too small")

    MO.param_search(rows, make, {}, 1, parallel=1, resample=refuse)
    assert seen[3:] == [160, 160, 160] and all(n > 160 for n in seen[:3])


def test_rows_of_a_fold_are_resampled_once_for_all_trials(rows):
    seen, fitted, lock = [], [], threading.Lock()

    def ros(df):
        with lock:
            seen.append(sorted(r["fold"] for r in df.select("fold").distinct().collect()))
        return SA.random_oversample(df, "doc_id", "label", ratio=1.0).drop("draw")

    def make(label, **_):
        def fit(train):
            found = sorted((r["doc_id"], r["label"]) for r in train.collect())
            with lock:
                fitted.append(found)
            return Model(0.9)

        return fit

    found = MO.param_search(rows, make, {}, 4, resample=ros)
    assert sorted(seen) == [[0, 1], [0, 2], [1, 2]] and found.fits == {n: 3 for n in range(4)}
    expected = [sorted((r["doc_id"], r["label"]) for r in ros(rows.filter(f"fold != {f}")).collect()) for f in range(3)]
    assert sorted(fitted) == sorted(expected * 4)


def test_a_resampling_that_is_cancelled_is_done_by_the_next_trial(rows):
    search = MO._Search(rows, [0, 1, 2], "ap", "fold", "label", None, True, True)
    calls = []

    def broken_once(df):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("cancelled")
        return df.limit(7)

    search.resample = broken_once
    with pytest.raises(RuntimeError, match="cancelled"):
        search.resampled(0, rows)
    assert search.resampled(0, rows).count() == 7 and search.resampled(0, rows).count() == 7 and len(calls) == 2


def test_parts_that_hold_too_many_rows_are_dealt_evenly(spark):
    # as a window over few classes leaves them: most rows in one part
    uneven = spark.range(1100).repartition(3, (F.col("id") < 1000)).withColumn("x", F.col("id") * 2)
    dealt = even_parts(uneven, 100)
    sizes = [r["n"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 11 and max(sizes) <= 110
    assert sorted(map(tuple, dealt.collect())) == [(i, 2 * i) for i in range(1100)]
    few = spark.range(0, 90, 1, 2)
    assert even_parts(few, 100).rdd.getNumPartitions() == 2 and even_parts(few.filter("id < 0"), 100).count() == 0


def test_spaces():
    assert MO.space_for("anything") == MO.GBT_SPACE_GENERAL and MO.space_for("both") == MO.GBT_SPACES["both"]
    assert MO.space_for("anything", leafwise=True)["rounds"].high == 1500
    rng = random.Random(1)
    for space in [*MO.GBT_SPACES.values(), *MO.GBT_SPACES_LEAFWISE.values(), MO.GBT_SPACE_GENERAL]:
        for _ in range(50):
            drawn = {k: r.draw(rng) for k, r in space.items()}
            assert all(space[k].low <= v <= space[k].high for k, v in drawn.items())


def tuned(rows, **options):
    return TU.tune(
        rows, MO.staged_gbt_fit, {"max_depth": MO.Range(2, 3, integer=True)}, dataset="d", key="doc_id", n_trials=2,
        features=["a", "b", "c"], rounds=8, patience=3, **options,
    )


def test_bundle_is_whole_or_absent(spark, rows, tmp_path):
    path = str(tmp_path / "bundle")
    made = tuned(rows)
    with pytest.raises(Exception):
        TU.load_bundle(spark, path)
    first = TU.save_bundle(made, path)
    made.serving["threshold"] = 0.25
    second = TU.save_bundle(made, path)
    # a version whose job died before its commit
    made.model.write().save(f"{path}/dead/model")
    latest = TU.load_bundle(spark, path)
    assert latest.serving["threshold"] == 0.25 and second != first
    assert TU.load_bundle(spark, path, first).serving["threshold"] != 0.25
    with pytest.raises(ValueError, match="no committed version"):
        TU.load_bundle(spark, path, "dead")
    a = made.score(rows).orderBy("doc_id").collect()
    b = latest.score(rows).orderBy("doc_id").collect()
    assert a == b and latest.oof.count() == 240
    assert latest.serving["features"] == ["a", "b", "c"] and len(latest.serving["fold_rounds"]) == 3


def test_tuning_settings(rows):
    made = tuned(rows, strategy="precision_at_recall", threshold_args={"min_recall": 0.9}, weight_rule=None)
    serving = made.serving
    assert made.metrics.first()["recall"] >= 0.9 and serving["threshold_strategy"] == "precision_at_recall"
    assert serving["final_params"]["rounds"] == max(1, round(sum(serving["fold_rounds"]) / 3))
    assert made.model.stages[-1].getNumTrees == serving["final_params"]["rounds"]
    assert tuned(rows, strategy=None).serving["threshold"] == 0.5
