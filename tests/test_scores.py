import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayside.functions.columns import decide, format_native_ts, parse_native_ts
from wayside.operators import decide as choose, folds, history, intervals, peers, scores


def score_intervals(frame, true, pred, blind=False):
    t = frame("label string, i long, start long, end long", [(x[2], i, x[0], x[1]) for i, x in enumerate(true)])
    p = frame("label string, j long, start long, end long", [(x[2], j, x[0], x[1]) for j, x in enumerate(pred)])
    keys = [] if blind else ["label"]
    both = [d.withColumn("one", F.lit(1)) for d in (t, p)]
    pairs = intervals.overlaps(*both, ["one", *keys]).select("one", "i", "j", "iou", "lo", "hi")
    return scores.interval_f1(*both, intervals.greedy_matching(pairs, ["one"]), ["one"]).first()


def test_interval_f1_worked_examples(frame):
    true = [(0, 4500, "Normal"), (30000, 33800, "Abnormal resistance")]
    assert score_intervals(frame, true, true).score == pytest.approx(1)
    wrong = [true[0], (30000, 33800, "Normal")]
    assert score_intervals(frame, true, wrong).score == pytest.approx(0.5)
    assert score_intervals(frame, true, wrong, blind=True).score == pytest.approx(1)
    recall, precision = 1 / 3, 1 / 6
    got = score_intervals(frame, [(0, 10, "N")], [(5, 15, "N"), (60, 65, "N")])
    assert got.score == pytest.approx(2 * recall * precision / (recall + precision)) and got.n_match == 1


def test_matching_equals_the_greedy_pass(frame):
    rng = random.Random(4)
    pairs = sorted({(k, rng.randrange(6), rng.randrange(6)): rng.randrange(1, 5) / 4 for k in range(40) for _ in range(14)}.items())
    want = set()
    for k in range(40):
        used_i, used_j = set(), set()
        for (_, i, j), iou in sorted((p for p in pairs if p[0][0] == k), key=lambda p: (-p[1], p[0])):
            if i not in used_i and j not in used_j:
                used_i.add(i)
                used_j.add(j)
                want.add((k, i, j))
    df = frame("k int, i int, j int, iou double, lo long, hi long", [(*key, iou, 0, 1) for key, iou in pairs])
    assert {(r.k, r.i, r.j) for r in intervals.greedy_matching(df, ["k"]).collect()} == want


def test_rank_decay_worked_example(frame):
    df = frame("r string, t string", [("03|01|05|02|04|06|07|08", c) for c in ("03", "01", "05", "08", "09")])
    got = {r.t: r.s for r in df.select("t", scores.rank_decay("r", "t").alias("s")).collect()}
    assert got == {"03": 1.0, "01": 0.875, "05": 0.75, "08": 0.125, "09": 0.0}


def test_macro_f1_all_normal(frame):
    df = frame("label string, pred string", [("Normal", "Normal")] * 9 + [("Side I", "Normal"), ("Side II", "Normal")])
    got = scores.macro_f1(df, []).first()
    assert got.f1_1 == got.f1_2 == 0 and got.macro_f1 == pytest.approx((2 * 9 / 11 / (1 + 9 / 11)) / 3)


def test_percentage_error_worked_example(frame):
    y, p = [0.10, 0.30, 0.50, 0.70, 0.90], [0.15, 0.28, 0.55, 0.68, 0.85]
    df = frame("y double, p double, c double", [(a, b, 0.5) for a, b in zip(y, p)])
    assert scores.mape_score(df, [], "y", "p").first().score == pytest.approx(0.850, abs=1e-3)
    flat = scores.mape_score(df, [], "y", "c").first()
    assert flat.score == 0 and flat.mape > 1


def test_decision_rules(frame):
    rows = [(0, 0.02, 0.04, "Normal"), (1, 0.81, 0.33, "Side I"), (2, 0.05, 0.66, "Side II"), (3, 0.41, 0.37, "Normal")]
    df = frame("n int, p1 double, p2 double, label string", rows)
    label = lambda *a, **k: [r.d for r in df.select("n", decide("p1", "p2", *a, **k).alias("d")).orderBy("n").collect()]
    assert label("global", 0.35) == ["Normal", "Side I", "Side II", "Side I"]
    assert label("global", 0.7) == ["Normal", "Side I", "Normal", "Normal"]
    assert label("per_side", 0.85, 0.3) == ["Normal", "Side II", "Side II", "Side II"]
    assert label("margin", 0.35, delta=0.2) == [r[3] for r in rows]
    with pytest.raises(ValueError):
        decide("p1", "p2", "unknown", 0.1)
    for rule in ("global", "per_side", "margin"):
        best = choose.sweep(df.drop("n"), rule).where("selected").collect()
        assert len(best) == 1 and best[0].macro_f1 == pytest.approx(1)


def test_paired_probability_swaps_with_the_views(frame):
    rows = [(1, 1, 0.7, 0.2, 0.9), (1, 2, 0.1, 0.4, 0.9)]
    schema = "u int, side int, own double, other double, detector double"
    for kind in ("multiclass", "hierarchical"):
        a = choose.paired_probability(frame(schema, rows), "u", kind).first()
        b = choose.paired_probability(frame(schema, [(1, 3 - s, *x) for _, s, *x in rows]), "u", kind).first()
        assert (a.p1, a.p2) == (b.p2, b.p1)


def test_native_times(frame):
    texts = ["2023-7-5-0-11-17-664", "2023-7-5-0-11-15-5", "2023-12-31-23-59-59-999"]
    df = frame("s string", [(t,) for t in texts])
    got = {r.s: (r.back, r.ts) for r in df.select("s", parse_native_ts("s").alias("ts")).withColumn("back", format_native_ts("ts")).collect()}
    assert all(got[t][0] == t for t in texts) and got[texts[1]][1].microsecond == 5000


def test_bands_need_three_values_and_ignore_missing(frame):
    readings = [("up", 3.0 + 0.01 * i) for i in range(14)] + [("up", 55.0), ("down", 7.5), ("lone", None), ("lone", 4.0)]
    got = peers.bands(frame("g string, v double", readings), ["g"], "v").collect()
    assert [r.v for r in got if r.unusual] == [55.0]
    assert all(r.low is None for r in got if r.g != "up") and {r.n for r in got if r.g == "lone"} == {1}


def test_downsampling_keeps_the_outlier(spark):
    from wayside.operators.ordered import Order

    wave = F.sin(F.col("id") / 40.0)
    df = spark.range(6_400).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.when(F.col("id") == 911, -30.0).otherwise(wave).alias("v"))
    got = history.downsample(df, Order(("k",), "i"), "v").collect()
    assert [(r["index"], r.value) for r in got if r.unusual] == [(912, -30.0)] and 180 <= len(got) < 210


def test_every_threshold_is_scored(frame):
    """Also where no pair agrees, and where none does at any threshold."""
    schema = "k int, i int, j int, iou double, lo long, hi long, label string, p double"
    count = frame("n int", [(1,), (2,)])
    sweep = lambda rows: choose.interval_threshold_sweep(frame(schema, rows), ["k"], count, count, "bad", "good").orderBy("cand").collect()
    got = sweep([(1, 0, 0, 0.5, 0, 4, "bad", 0.41), (1, 1, 1, 0.5, 9, 12, "bad", 0.3)])
    assert len(got) == 25 and [r.score for r in got[:5]] == [0.5] * 5 and got[-1].score == 0.0
    none = sweep([(1, 0, 0, 0.5, 0, 4, "good", 0.99)])
    assert len(none) == 25 and {r.score for r in none} == {0.0}


def random_intervals(rng, n, longest):
    start = rng.integers(0, 4000, n)
    return [(int(s), int(s + length)) for s, length in zip(start, rng.choice([0, 1, 3, 50, longest], n))]


def test_overlaps_of_any_length(frame):
    """Points, short and very long intervals; every pair once, on two keys."""
    rng = np.random.default_rng(12)
    true, pred = ([(int(k), i, s, e) for i, ((s, e), k) in enumerate(zip(random_intervals(rng, 150, far), rng.integers(0, 2, 150)))] for far in (900, 10**12))
    got = intervals.overlaps(frame("k int, i long, start long, end long", true), frame("k int, j long, start long, end long", pred), ["k"]).collect()
    want = {}
    for k, i, s, e in true:
        for q, j, a, b in pred:
            inter = min(e, b) - max(s, a)
            if k == q and inter > 0:
                want[k, i, j] = (pytest.approx(inter / (e - s + b - a - inter)), min(s, a), max(e, b))
    assert len(got) == len(want) and all(want[r.k, r.i, r.j] == (r.iou, r.lo, r.hi) for r in got)


def test_a_long_interval_makes_few_rows(spark):
    long = spark.range(1).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.lit(0).cast("long").alias("start"), F.lit(10**15).cast("long").alias("end"))
    short = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("j"), (F.col("id") * 10**12).alias("start"), (F.col("id") * 10**12 + 5).alias("end"))
    assert intervals.overlaps(long, short, ["k"]).count() == 1000
    levels = {f.name for f in intervals.overlaps(long, short, ["k"]).schema}
    assert levels == {"k", "i", "j", "iou", "lo", "hi"}


def test_points_inside_and_outside(frame):
    rng = np.random.default_rng(13)
    spans = [(int(k), s, e) for (s, e), k in zip(random_intervals(rng, 60, 300), rng.integers(0, 3, 60))]
    points = [(int(k), int(t), n) for n, (k, t) in enumerate(zip(rng.integers(0, 4, 900), rng.integers(0, 4400, 900)))] + [(0, spans[0][1], 900), (spans[0][0], spans[0][2], 901)]
    inside = {n for k, t, n in points if any(q == k and s <= t <= e for q, s, e in spans)}
    p, s = frame("k int, t long, n int", points), frame("k int, a long, b long", spans)
    assert {r.n for r in intervals.inside_intervals(p, s, ["k"], "t", "a", "b").collect()} == inside
    assert {r.n for r in intervals.outside_intervals(p, s, ["k"], "t", "a", "b").collect()} == {n for _, _, n in points} - inside


def test_a_chain_of_overlaps_needs_no_rounds(spark):
    """Each pair beats the one before: rounds of mutual best pairs would take one pair each."""
    n = 20_000
    df = spark.range(n).select(
        F.lit(1).alias("k"), F.floor(F.col("id") / 2).alias("i"), F.floor((F.col("id") + 1) / 2).alias("j"), ((F.col("id") + 1) / (n + 1)).alias("iou"),
        F.col("id").alias("lo"), (F.col("id") + 2).alias("hi"))
    got = intervals.greedy_matching(df, ["k"])
    assert got.count() == n // 2 and got.agg(F.min("iou")).first()[0] == pytest.approx(2 / (n + 1))


def f1_of(label, pred):
    scores_ = []
    for c in ("Normal", "Side I", "Side II"):
        tp = np.sum((label == c) & (pred == c))
        p, r = tp / max(np.sum(pred == c), 1), tp / max(np.sum(label == c), 1)
        scores_.append(2 * p * r / (p + r) if p + r else 0.0)
    return np.mean(scores_)


def predicted(rule, p1, p2, a, b):
    if rule == "per_side":
        own, other, flagged = p1 - a, p2 - b, np.maximum(p1 - a, p2 - b) >= 0
    else:
        own, other, flagged = p1, p2, (np.maximum(p1, p2) >= a) & ((rule == "global") | (np.abs(p1 - p2) >= b))
    return np.where(~flagged, "Normal", np.where(own >= other, "Side I", "Side II"))


@pytest.mark.parametrize("kind", ["continuous", "votes", "thresholds"])
def test_sweeps_equal_trying_every_setting(spark, kind):
    """Also where probabilities lie on the thresholds or their differences, so that every rounding counts."""
    rng = np.random.default_rng(21)
    n = 400
    draw = {"continuous": lambda: rng.random(n), "votes": lambda: rng.integers(0, 41, n) / 40, "thresholds": lambda: rng.choice(choose.TAUS, n)}[kind]
    p0, p1, p2 = draw(), draw(), draw()
    label = rng.choice(["Normal", "Side I", "Side II"], n, p=[0.5, 0.3, 0.2])
    df = spark.createDataFrame([(*map(float, r[:3]), str(r[3])) for r in zip(p0, p1, p2, label)], "p0 double, p1 double, p2 double, label string").repartition(4)
    for rule, size in (("global", 35), ("per_side", 1225), ("margin", 245)):
        got = choose.sweep(df, rule).collect()
        assert len(got) == size and sum(r.selected for r in got) == 1
        for r in got:
            assert r.macro_f1 == pytest.approx(f1_of(label, predicted(rule, p1, p2, r.a, r.b)), abs=1e-12), (rule, r.a, r.b)
    got = choose.class_scaling(df).collect()
    assert len(got) == 226
    for r in got:
        normal = (p0 >= p1 * r.a) & (p0 >= p2 * r.b)
        assert r.macro_f1 == pytest.approx(f1_of(label, np.where(normal, "Normal", np.where(p1 * r.a >= p2 * r.b, "Side I", "Side II"))), abs=1e-12), (r.a, r.b)


def test_missing_probabilities_count_as_zero(frame):
    rows = [(None, 0.9, "Side II"), (float("nan"), 0.2, "Side II"), (0.7, None, "Side I"), (0.01, 0.02, "Normal")]
    got = choose.sweep(frame("p1 double, p2 double, label string", rows), "global").where("a = 0.05").first()
    assert got.macro_f1 == pytest.approx(1)


def test_rows_are_not_repeated_per_setting(spark):
    """Only rows that are ties to a billionth are exploded, after they were counted by value."""
    df = spark.range(10).select(F.lit(0.5).alias("p1"), F.lit(0.2).alias("p2"), F.lit(0.3).alias("p0"), F.lit("Normal").alias("label"))
    for rule in ("global", "margin"):
        assert "Generate" not in choose.tried(df, choose.RULES[rule]())._jdf.queryExecution().optimizedPlan().toString()
    plan = choose.tried(df, choose.RULES["per_side"]())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and plan.index("Generate") < plan.rindex("Aggregate")
