import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayside.operators import forests, models
from wayside.operators.forests import Nodes, Plan

NAMES = ["a", "b", "c", "d"]


def mixed_rows(spark, n=400):
    rng = np.random.default_rng(11)
    v = rng.normal(size=(n, 4)).round(2)
    y = (v[:, 0] + v[:, 1] * (v[:, 2] > 0) + 0.5 * rng.normal(size=n) > 0.4).astype(float)
    data = pd.DataFrame(v, columns=NAMES).assign(unit=range(n), y=y)
    return spark.createDataFrame(data).repartition(3), data


def trees_of(forest):
    return [(r["tree"], r["root"], Nodes.read(r.asDict(), forest.plan.classes)) for r in forest.grown.where("root >= 0").orderBy("tree", "root").collect()]


def gini_gain(cells, y, times, weights, feature, cell):
    def weight_and_impurity(at):
        w = np.bincount(y[at], times[at], len(weights)) * weights
        return w.sum(), w.sum() - (w * w).sum() / w.sum()

    left = cells[:, feature] <= cell
    return weight_and_impurity(np.full(len(y), True))[1] - weight_and_impurity(left)[1] - weight_and_impurity(~left)[1]


@pytest.mark.parametrize("classes", [2, 3])
def test_every_split_is_the_best_one(classes):
    """Both ways to count, cells of few nodes and sorted rows of many, against all splits of all rows."""
    rng = np.random.default_rng(classes)
    cells = rng.integers(0, 32, (3000, 3)).astype(np.uint8)
    y = ((cells[:, 0] + rng.integers(0, 20, 3000)) // 18 % classes).astype(np.uint8)
    plan = Plan(3, (0.5, 1.5, 2.0)[:classes], 3, 3, 30, 7)
    times = forests.drawn(np.arange(3000), plan.seed, 4)
    tree, gains = forests.grow(cells, y, np.arange(3000), plan, 4)
    assert (tree.counts[0] == np.bincount(y, times, classes)).all() and gains.argmax() == 0
    where = {0: np.flatnonzero(times)}
    for i in range(len(tree.left)):
        rows = where[i]
        assert (tree.counts[i] == np.bincount(y[rows], times[rows], classes)).all() and times[rows].sum() >= plan.leaf
        if tree.left[i] < 0:
            continue
        left = cells[rows, tree.feature[i]] <= tree.cell[i]
        where[tree.left[i]], where[tree.left[i] + 1] = rows[left], rows[~left]
        got = gini_gain(cells[rows], y[rows], times[rows], np.array(plan.weights), tree.feature[i], tree.cell[i])
        for f in range(3):
            for c in np.unique(cells[rows, f])[:-1]:
                below = times[rows][cells[rows, f] <= c].sum()
                if plan.leaf <= below <= times[rows].sum() - plan.leaf:
                    assert gini_gain(cells[rows], y[rows], times[rows], np.array(plan.weights), f, c) <= got + 1e-9
    likeliest = (tree.counts * np.array(plan.weights)).argmax(axis=1)
    inner = np.flatnonzero(tree.left >= 0)
    leaves = (tree.left[tree.left[inner]] < 0) & (tree.left[tree.left[inner] + 1] < 0)
    assert len(inner) > 100 and (likeliest[tree.left[inner]] != likeliest[tree.left[inner] + 1])[leaves].all()


def test_trees_stay_in_a_table(spark):
    """Every tree asked for is a row of a written table; its leaves hold the rows it drew, each once."""
    rows, data = mixed_rows(spark)
    forest = models.fit_forest(rows, NAMES, "y", 23, seed=2)
    grown = trees_of(forest)
    assert [t for t, _, _ in grown] == list(range(23)) and forest.sizes == (8, 8, 7)
    assert forest.grown.inputFiles()  # read from files, not from the driver
    for _, _, tree in grown:
        leaves = tree.counts[tree.left < 0].sum(axis=0)
        assert (leaves == tree.counts[0]).all() and 300 < leaves.sum() < 500
    p = models.probability(forest, rows, ["unit"]).toPandas().sort_values("unit").p.to_numpy()
    assert ((p > 0.5) == (data.y.to_numpy() == 1)).mean() > 0.95


def test_trees_of_more_rows_than_a_task_holds(spark, monkeypatch):
    """Upper nodes come from sums of all tasks, lower ones from tasks; all rows are in the trees and each is scored by all trees."""
    rows, data = mixed_rows(spark)
    whole = models.fit_forest(rows, NAMES, "y", 20, leaf=2, seed=4)
    monkeypatch.setattr(forests, "HELD", 60 * len(NAMES))
    forest = models.fit_forest(rows, NAMES, "y", 20, leaf=2, seed=4)
    grown = trees_of(forest)
    assert all(t.nodes.left[0] > 0 for t in forest.upper) and len(grown) > 60
    totals = np.zeros((20, 2), int)
    for t, root, tree in grown:
        totals[t] += tree.counts[tree.left < 0].sum(axis=0)
        assert (tree.counts[0] == forest.upper[t].nodes.counts[root]).all()
        assert tree.counts[0].sum() <= 60 or len(tree.left) == 1
    assert (totals == [t.nodes.counts[0] for t in forest.upper]).all() and 300 < totals.sum(axis=1).mean() < 500
    got, want = ([models.probability(f, rows, ["unit"]).toPandas().sort_values("unit").p.to_numpy() for f in (forest, whole)])
    assert ((got > 0.5) == (data.y.to_numpy() == 1)).mean() > 0.95 and np.abs(got - want).mean() < 0.08
    weights = models.importances(forest, NAMES)
    assert sum(weights.values()) == pytest.approx(1) and max(weights, key=weights.get) == "a"


def test_upper_node_that_nothing_splits_is_a_leaf(spark, monkeypatch):
    monkeypatch.setattr(forests, "HELD", 10)
    rows = spark.range(60).select("id", (F.col("id") % 2).cast("double").alias("y"), F.lit(1.0).alias("v"))
    forest = models.fit_forest(rows, ["v"], "y", 3)
    assert [tree.left.tolist() for _, _, tree in trees_of(forest)] == [[-1]] * 3
    p = models.probability(forest, rows, ["id"]).toPandas().p
    assert len(p) == 60 and p.nunique() == 1 and 0.2 < p[0] < 0.8


def test_rows_that_come_twice_or_lack_values_are_all_scored(spark):
    rows, _ = mixed_rows(spark, 120)
    forest = models.fit_forest(rows, NAMES, "y", 5)
    odd = rows.union(rows).withColumn("b", F.when(F.col("unit") % 7 > 0, F.col("b")))
    got = models.probability(forest, odd, ["unit"]).toPandas()
    assert len(got) == 240 and got.p.between(0, 1).all() and (got.groupby("unit").p.nunique() == 1).all()
    assert models.probability(forest, odd.where("unit < 0"), ["unit"]).count() == 0
    with pytest.raises(ValueError):
        models.fit_forest(odd, NAMES, "y", 2)
    with pytest.raises(ValueError):
        models.fit_forest(rows.where("unit < 0"), NAMES, "y", 2)


def test_candidate_thresholds(spark):
    even = np.arange(64.0)
    assert forests.split_points(even, np.ones(64), 31).tolist() == (np.arange(1, 32) * 2 - 0.5).tolist()
    assert forests.split_points(np.array([1.0, 2.0, 4.0]), np.ones(3), 31).tolist() == [1.5, 3.0]
    heavy = forests.split_points(np.array([0.0, 1.0, 2.0, 3.0]), np.array([1.0, 1.0, 1.0, 9.0]), 1)
    assert heavy.tolist() == [2.5]
    df = spark.range(20_000).select(F.array((F.col("id") % 10_000).cast("double"), (F.col("id") % 3).cast("double")).alias("x"), F.lit(1.0).alias("weight"))
    first, second = forests.thresholds(df.repartition(4), 2, 20_000)
    assert len(first) == 31 and np.abs(first - np.arange(1, 32) * 10_000 / 32).max() < 30 and second.tolist() == [0.5, 1.5]


def test_draws_are_poisson_and_differ_by_tree_and_seed():
    ids = np.arange(200_000)
    one, other, later = forests.drawn(ids, 0, 0), forests.drawn(ids, 0, 1), forests.drawn(ids, 1, 0)
    for times in (one, other, later):
        assert abs(times.mean() - 1) < 0.01 and abs(times.var() - 1) < 0.02 and times.max() <= 15
    assert max(abs(np.corrcoef(a, b)[0, 1]) for a, b in ((one, other), (one, later), (other, later))) < 0.01
    assert (forests.drawn(ids[::-1], 0, 0)[::-1] == one).all()
    tried = forests.chosen(np.random.default_rng(0), 20_000, 10, 4)
    assert all(len(set(r)) == 4 for r in tried[:500].tolist()) and np.abs(np.bincount(tried.ravel()) / 8000 - 1).max() < 0.05
    assert [forests.features_tried(s, 64, 500) for s in ("sqrt", "all", "onethird", "log2", "auto", "5", "0.5")] == [8, 64, 22, 6, 8, 5, 32]


def test_detect_then_localise_with_trees_in_tables(spark, monkeypatch):
    """Detector and localiser leave no tree with the driver: rows of trees are read when rows are scored, and both kinds vote."""
    rng = np.random.default_rng(8)
    labels = ["Normal"] * 30 + ["Side I"] * 12 + ["Side II"] * 12
    rows = spark.createDataFrame([
        (u, s, label, float(rng.normal(3 if label == ("Side I" if s == 1 else "Side II") else 0, 0.3)), float(rng.normal()))
        for u, label in enumerate(labels) for s in (1, 2)], "unit int, side int, label string, v double, w double")
    fitted = []
    fit = models.fit_forest
    monkeypatch.setattr(models, "fit_forest", lambda *a, **k: fitted.append(fit(*a, **k)) or fitted[-1])
    score = models.fit_hierarchical(rows, "unit", ["v", "w"], 12)
    assert [f.grown.where("root = 0").count() for f in fitted] == [12, 12] and [f.plan.features for f in fitted] == [4, 2]
    assert all(len(top.level) == 1 for f in fitted for top in f.upper)  # what the driver has of a tree does not grow with it
    told = score(rows.drop("label")).toPandas().set_index(["unit", "side"]).sort_index()
    assert len(told) == 108 and ((told.detector > 0.5) == (np.repeat(labels, 2) != "Normal")).mean() > 0.95
    own = told.loc[list(range(30, 54))].own.to_numpy().reshape(-1, 2)
    assert ((own[:, 0] > own[:, 1]) == (np.array(labels[30:]) == "Side I")).all()


def test_out_of_fold_forests_hold_no_tree_of_their_own_fold(spark, monkeypatch):
    """Every row is scored once, by trees that have drawn rows of the other folds only."""
    rows, data = mixed_rows(spark, 200)
    placed = rows.withColumn("fold", F.col("unit") % 4)
    fitted = {}

    def fit(train, k):
        fitted[k] = models.fit_forest(train, NAMES, "y", 15, seed=k)
        return lambda test: models.probability(fitted[k], test, ["unit", "y"])

    got = models.out_of_fold(placed, "fold", range(4), ["unit", "y"], fit).toPandas()
    assert sorted(got.unit) == list(range(200)) and (got.unit % 4 == got.fold).all() and ((got.p > 0.5) == (got.y == 1)).mean() > 0.75
    for forest in fitted.values():
        assert len(trees_of(forest)) == 15 and np.mean([t.counts[0].sum() for _, _, t in trees_of(forest)]) == pytest.approx(150, abs=15)
    assert len({tuple(t.feature.tolist()) for f in fitted.values() for _, _, t in trees_of(f)}) == 60


def test_registered_forest_has_all_its_trees(spark, monkeypatch, tmp_path):
    from wayside.plans import catalog_models

    rng = np.random.default_rng(3)
    values = rng.normal(size=(80, 64)).round(3)
    data = [(i, [float(x) for x in v], int(5 + 5 * (v[0] > 0.4))) for i, v in enumerate(values)]
    spark.createDataFrame([*data, data[0]], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    fitted = []
    fit = models.fit_forest
    monkeypatch.setattr(models, "fit_forest", lambda *a, **k: fitted.append(fit(*a, **k)) or fitted[-1])
    got = catalog_models.rf_scores(spark, str(tmp_path)).toPandas()
    [forest] = fitted
    assert sorted(got.vec_id) == sorted([*range(80), 0]) and got.p.between(0, 1).all()
    assert (forest.plan.leaf, forest.plan.depth, forest.plan.tries, forest.plan.features) == (2, 30, 8, 64)
    assert forest.grown.where("root = 0").select("tree").distinct().count() == 500 == sum(forest.sizes)
    assert all(tree.counts[tree.left < 0].sum(axis=1).min() >= 2 for _, _, tree in trees_of(forest))
