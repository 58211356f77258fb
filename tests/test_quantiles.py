"""Order statistics from two scans against numpy, and what happens when a sketch is poor."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.functions import quantiles as Q
from stayline.operators import binning as B
from stayline.operators import profile as P
from stayline.operators import scaling as SC

PROBS = [0.0, 0.1, 0.25, 0.5, 0.8, 1.0]


def columns(n=20_000):
    r = np.random.default_rng(4)
    return {
        "normal": r.normal(size=n), "ties": r.integers(0, 4, n).astype(float), "same": np.zeros(n), "tail": np.exp(r.normal(size=n) * 3),
        "two": np.where(np.arange(n) % 2 == 0, -1e9, 1e9),
    }


@pytest.fixture(scope="module")
def wide(spark):
    data = columns()
    rows = list(zip(*[d.tolist() for d in data.values()], (np.arange(20_000) % 3 == 0).astype(int).tolist()))
    schema = ", ".join(f"{c} double" for c in data) + ", y int"
    return spark.createDataFrame(rows + [(None, None, None, float("nan"), None, 1)], schema).repartition(6).cache()


def counted(spark, df):
    """The frame, and how many of its rows were read so far."""
    read = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), read


def test_quantiles(wide):
    got, _ = Q.two_scan_quantiles(wide, list(columns()), PROBS)
    for name, values in columns().items():
        assert got[name] == pytest.approx(np.quantile(values, PROBS).tolist(), rel=1e-12, abs=1e-12), name
    assert Q.two_scan_quantiles(wide.filter("1 = 0"), ["normal"], [0.5])[0] == {"normal": [None]}


@pytest.mark.parametrize("job", [
    lambda df: P.describe(df, ["normal", "ties", "tail"]).collect(), lambda df: SC.scaler_stats(df, ["normal", "ties", "tail"]).collect(),
    lambda df: B.quantile_bin_rate(df, "tail", "y").collect(),
    lambda df: SC.fit_scalers(df, {"normal": "StandardScaler", "ties": "MinMaxScaler", "tail": "RobustScaler"}),
])
def test_two_scans(spark, wide, job):
    df, read = counted(spark, wide)
    job(df)
    assert read.value == 2 * wide.count()


@pytest.mark.parametrize("poor", ["missed", "wide"])
def test_poor_sketches_cost_time_only(wide, monkeypatch, poor):
    cols = ["normal", "tail", "ties"]
    fine = [P.describe(wide, cols).collect(), SC.scaler_stats(wide, cols).collect(), sorted(B.quantile_bin_rate(wide, "tail", "y").collect()),
            sorted(B.zero_own_bin(wide, "ties", "y").collect())]
    if poor == "missed":
        real = Q.sketched

        def shifted(*a, **k):
            found = real(*a, **k)
            found.brackets = {c: {q: (lo + 1e-3, lo + 2e-3) for q, (lo, hi) in b.items()} for c, b in found.brackets.items()}
            return found

        for module in (Q, SC, B):
            monkeypatch.setattr(module, "sketched", shifted)
    else:
        for module in (Q, SC, B):
            monkeypatch.setattr(module, "cells", lambda *a, **k: None)
    again = [P.describe(wide, cols).collect(), SC.scaler_stats(wide, cols).collect(), sorted(B.quantile_bin_rate(wide, "tail", "y").collect()),
             sorted(B.zero_own_bin(wide, "ties", "y").collect())]
    for a, b in zip(fine, again):
        for x, y in zip(a, b):
            assert [pytest.approx(v, rel=1e-9) if isinstance(v, float) else v for v in x] == list(y)


def test_cells_of_few_values_only(wide):
    assert Q.cells(wide, {"normal": [(-1.0, 1.0)]}, most=100) is None
    found = Q.cells(wide, {"ties": [(0.5, 1.5), (1.0, 2.0)]}, "y")["ties"]
    values = columns()["ties"]
    assert found.values == [-np.inf, 1.0, 2.0, np.inf] and found.exact == [False, True, True, False]
    assert found.rows == [int((values == k).sum()) for k in range(4)] and sum(found.targets) == sum(np.arange(20_000) % 3 == 0)
    assert found.outside(1.0, 1.0) == int((values != 1).sum())


def test_outliers(spark):
    r = np.random.default_rng(6)
    values = np.concatenate([r.normal(size=5000), r.normal(size=100) * 50])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    q1, q3 = np.quantile(values, [0.25, 0.75])
    row = SC.scaler_stats(df, ["v"]).first()
    assert row["outliers"] == int(((values < q1 - 1.5 * (q3 - q1)) | (values > q3 + 1.5 * (q3 - q1))).sum())
    assert df.agg(F.count("v")).first()[0] == row["n"]
