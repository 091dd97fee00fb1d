import random
import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from wayside.operators import quantiles
from wayside.operators.quantiles import exact_medians, exact_quantiles, ordered_bits, weighted_medians, weighted_medians_of_few

PROBS = {"q0": 0.0, "q1": 0.1, "q2": 0.5, "q3": 0.95, "q4": 1.0}


@pytest.mark.parametrize("values", [
    np.random.default_rng(1).normal(0, 1e3, 2001), np.random.default_rng(2).integers(-3, 4, 500).astype(float),
    np.full(77, -2.5), np.array([1e-300, -1e300, 0.0, 5.0]), np.array([4.0]), 20 + np.random.default_rng(3).random(5000) * 1e-6,
])
def test_quantiles_equal_linear_interpolation(spark, values):
    df = spark.createDataFrame(pd.DataFrame(dict(k=1, x=values))).repartition(5)
    for limit in (quantiles.LIMIT, 40, 1):
        got = exact_quantiles(df, ["k"], "x", PROBS, limit).first()
        assert [got[c] for c in PROBS] == pytest.approx([np.quantile(values, p) for p in PROBS.values()], rel=1e-12, abs=1e-12)


def test_groups_nulls_and_whole_table(frame):
    rows = [("a", 1.0), ("a", 3.0), ("a", None), ("b", -7.0), ("c", None)]
    df = frame("k string, x double", rows)
    assert {r.k: r.m for r in exact_medians(df, ["k"], "x", "m").collect()} == {"a": 2.0, "b": -7.0}
    assert exact_medians(df, [], "x", "m").first().m == 1.0


def test_weighted_median(spark):
    rng = np.random.default_rng(5)
    for _ in range(5):
        r, w = rng.random(301) * 50, rng.random(301)
        order = np.argsort(r)
        want = r[order][np.searchsorted(np.cumsum(w[order]), w.sum() / 2)]
        df = spark.createDataFrame(pd.DataFrame(dict(k=1, r=r, w=w))).repartition(4)
        assert weighted_medians(df, ["k"], "r", "w", "m").first().m == want


def test_bits_order_as_numbers_do(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([
        rng.normal(0, 1, 400), 10.0 ** rng.uniform(-320, 308, 400) * rng.choice([-1, 1], 400), 2.0 ** np.arange(-1074, 1024),
        np.nextafter(2.0 ** np.arange(-1021, 1024), 0), -(2.0 ** np.arange(-1074, 1024)), [0.0, -0.0, np.inf, -np.inf, 5e-324, 1.7976931348623157e308]])
    df = spark.createDataFrame(pd.DataFrame(dict(x=x)))
    got = {r.x: r.b for r in df.select("x", ordered_bits(F.col("x")).alias("b")).collect()}
    want = x.view(np.int64)
    want = np.where(want < 0, -(want & np.int64(2**63 - 1)), want)
    assert all(got[v] == w for v, w in zip(x.tolist(), want.tolist()))
    nan = spark.createDataFrame([(float("nan"),)], "x double").select(ordered_bits(F.col("x"))).first()[0]
    assert nan > got[np.inf]


def test_large_groups_are_opened_cell_by_cell(spark):
    """Mixed sizes, many equal values, NULL keys: the same answers whatever the limit."""
    rng = np.random.default_rng(3)
    frame = pd.DataFrame(dict(
        k=np.repeat(["a", "b", None], [3000, 30, 1500]), x=np.concatenate([rng.normal(5, 1e-9, 2000), np.full(1000, 5.0), rng.random(30), rng.integers(0, 3, 1500)])))
    df = spark.createDataFrame(frame).repartition(5)
    for limit in (50, 700, 10**6):
        got = {r.k: r for r in exact_quantiles(df, ["k"], "x", PROBS, limit).collect()}
        for k, part in frame.groupby("k", dropna=False).x:
            key = None if pd.isna(k) else k
            assert [got[key][c] for c in PROBS] == pytest.approx([np.quantile(part, p) for p in PROBS.values()], rel=1e-14)


def test_millions_of_values(spark):
    """Only histograms are exchanged until a cell fits; the answer is that of a full sort."""
    df = spark.range(2_000_000).select(F.lit(1).alias("k"), (F.hash("id") / 7.0).alias("x"))
    got = exact_quantiles(df, ["k"], "x", {"a": 0.25, "b": 0.999}, 20_000).first()
    want = df.agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.999)))).first()[0]
    assert [got.a, got.b] == want


def test_weighted_medians_of_few_groups(frame):
    """As the plain form: many values to a wide cell, equal values, one value, weights that are the values."""
    rng = random.Random(8)
    rows = [(k, v, w) for k in range(6) for _ in range(1 + 40 * k) for v in [rng.choice([2.0, rng.lognormvariate(3, 0.02 * k), rng.uniform(-1, 1)])]
            for w in [rng.random() + 0.1]]
    df = frame("k int, v double, w double", rows)
    found = {r.k: r.m for r in weighted_medians_of_few(df, ["k"], "v", "w", "m").collect()}
    assert len(found) == 6 and found == {r.k: r.m for r in weighted_medians(df, ["k"], "v", "w", "m").collect()}
