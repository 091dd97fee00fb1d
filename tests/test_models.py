import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayside.operators import decide as choose, models


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 3, (400, 4)) + 5
    y = x @ [1.0, -2.0, 0.5, 0.0] + 3 + rng.normal(0, 0.1, 400)
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(y=y)).repartition(5)
    model = models.fit_ridge(df, names, "y", 2.0)
    z = x - x.mean(0)
    want = np.linalg.solve(z.T @ z + 2 * np.eye(4), z.T @ (y - y.mean()))
    assert np.allclose(model.coefficients, want) and model.intercept == pytest.approx(y.mean() - want @ x.mean(0))
    with pytest.raises(ValueError):
        models.fit_ridge(df.where("a > 1e9"), names, "y")


def side_rows(spark, labels):
    rng = np.random.default_rng(1)
    rows = []
    for u, label in enumerate(labels):
        for side in (1, 2):
            hit = label == ("Side I" if side == 1 else "Side II")
            rows.append((u, side, label, float(rng.normal(4 if hit else 0, 0.3)), float(rng.normal())))
    return spark.createDataFrame(rows, "unit int, side int, label string, v double, w double")


def test_detect_then_localise(spark):
    labels = ["Normal"] * 20 + ["Side I"] * 8 + ["Side II"] * 8
    rows = side_rows(spark, labels)
    score = models.fit_hierarchical(rows, "unit", ["v", "w"], 10)
    p = choose.paired_probability(score(rows.drop("label")), "unit", "hierarchical").toPandas().sort_values("unit")
    best = np.where(p[["p1", "p2"]].max(axis=1) < 0.5, "Normal", np.where(p.p1 >= p.p2, "Side I", "Side II"))
    assert (best == np.array(labels)).mean() > 0.95


def test_one_class_only(spark):
    rows = side_rows(spark, ["Normal"] * 6)
    score = models.fit_hierarchical(rows, "unit", ["v", "w"], 3)
    got = choose.paired_probability(score(rows.drop("label")), "unit", "hierarchical")
    assert got.agg(F.max("p1"), F.max("p2")).first() == (0.0, 0.0)


def test_out_of_fold_rows_never_see_their_own_fold(spark):
    df = spark.range(40).select("id", (F.col("id") % 4).alias("fold"))
    seen = {}

    def fit(train, k):
        seen[k] = {r.fold for r in train.select("fold").distinct().collect()}
        return lambda test: test.withColumn("p", F.lit(0.5))

    got = models.out_of_fold(df, "fold", range(4), ["id"], fit)
    assert got.count() == 40 and all(k not in folds and len(folds) == 3 for k, folds in seen.items())


def class_rows(spark, n=300):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(n, 3))
    y = (v[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(float)
    data = pd.DataFrame(v, columns=["a", "b", "c"]).assign(unit=range(n), y=y)
    return spark.createDataFrame(data).coalesce(1), y


def test_trees_of_a_forest_are_grown_by_several_fits(spark, monkeypatch):
    """All trees asked for, each with one vote, grown side by side from different seeds; a second fit gives the same."""
    monkeypatch.setattr(models, "TREES_A_FIT", 5)
    rows, y = class_rows(spark)
    forest = models.fit_forest(rows, ["a", "b", "c"], "y", 12, leaf=2, seed=3)
    assert [p.getNumTrees for p in forest.parts] == [4, 4, 4]
    assert len({t.toDebugString.split("\n", 1)[1] for p in forest.parts for t in p.trees}) == 12
    p = models.probability(forest, rows, ["unit"]).toPandas().sort_values("unit").p.to_numpy()
    alone = [part.setProbabilityCol("p").transform(forest.assembler.transform(rows)).orderBy("unit").toPandas().p for part in forest.parts]
    assert np.allclose(p, np.mean([[v[1] for v in one] for one in alone], axis=0))
    assert ((p > 0.5) == (y == 1)).mean() > 0.95
    again = models.fit_forest(rows, ["a", "b", "c"], "y", 12, leaf=2, seed=3)
    assert np.allclose(models.probability(again, rows, ["unit"]).toPandas().sort_values("unit").p, p)
    told = forest.transform(rows).select("probability", "prediction").toPandas()
    assert (told.prediction == [v.toArray().argmax() for v in told.probability]).all()
    weights = models.importances(forest, ["a", "b", "c"])
    assert sum(weights.values()) == pytest.approx(1) and max(weights, key=weights.get) == "a"
