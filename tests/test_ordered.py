from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayside.operators import cycles, intervals, ordered
from wayside.operators.ordered import (
    RANGE, Order, ahead_by, first_transition, following, gap_segments, longest_run, positions, previous, running, turning_points,
)
from wayside.session import cut

SECOND = 1_000_000


def rows_of(n=3000, seed=0):
    """One stream: a third of all rows at one time, the rest spread out."""
    rng = np.random.default_rng(seed)
    t = rng.integers(0, 100_000, n)
    t[n // 3: 2 * n // 3] = 50_000
    t = np.sort(t)
    return pd.DataFrame(dict(k=1, t=t, seq=np.arange(n), v=rng.integers(0, 9, n).astype(float)))


@pytest.fixture(scope="module", params=[10**9, 700, 100, 7])
def case(request, spark):
    data = rows_of()
    df = spark.createDataFrame(data.sample(frac=1, random_state=3)).repartition(6).cache()
    return data, df, Order(("k",), "t", ("seq",), request.param).sampled(df)


def sorted_pandas(df):
    return df.orderBy("t", "seq").toPandas()


def test_neighbours(case):
    data, df, order = case
    got = sorted_pandas(following(previous(df, order, "v"), order, "v"))
    assert np.array_equal(got.prev_v.to_numpy()[1:], data.v.to_numpy()[:-1]) and np.isnan(got.prev_v[0])
    assert np.array_equal(got.next_v.to_numpy()[:-1], data.v.to_numpy()[1:]) and np.isnan(got.next_v.iloc[-1])


def test_running_and_positions(case):
    data, df, order = case
    got = sorted_pandas(positions(running(df, order, F.col("v"), "total"), order))
    assert np.array_equal(got.pos, np.arange(len(data))) and (got.n == len(data)).all()
    assert np.allclose(got.total, data.v.cumsum())
    more = sorted_pandas(running(running(df, order, F.col("v"), "top", "max"), order, F.col("seq"), "mixed", "xor"))
    assert np.array_equal(more.top, data.v.cummax()) and np.array_equal(more.mixed, np.bitwise_xor.accumulate(data.seq.to_numpy()))


def test_ahead(case):
    data, df, order = case
    got = sorted_pandas(ahead_by(df, order, "v", 10, "later"))
    assert np.array_equal(got.later.to_numpy()[:-10], data.v.to_numpy()[10:]) and got.later[-10:].isna().all()


def test_longest_run(case):
    data, df, order = case
    best = run = 0
    for v in data.v:
        run = run + 1 if v > 2 else 0
        best = max(best, run)
    assert longest_run(df, order, F.col("v") > 2).first().longest == best


def test_turning_points(case):
    data, df, order = case
    v = data.v.to_numpy()
    v = v[np.r_[True, np.diff(v) != 0]]
    inner = (np.diff(v)[:-1] > 0) != (np.diff(v)[1:] > 0)
    assert np.array_equal(sorted_pandas(turning_points(df, order, "v")).v, v[np.r_[True, inner, True]])


@pytest.mark.parametrize("spread", ["dense", "tied", "skewed"])
def test_ranges_are_about_as_long_as_the_limit(spark, spread):
    """Between half the limit and twice the limit, however the order columns are spread; short streams have one range."""
    n, limit = 40_000, 500
    at = {"dense": F.col("id"), "tied": F.lit(5).cast("long"), "skewed": F.expr("CAST(exp(id / 2000) AS LONG)")}[spread]
    df = spark.range(n).select(F.expr("IF(id % 10 < 9, 0, 1 + id % 7)").alias("k"), at.alias("t"), F.col("id").alias("seq"))
    order, dealt = Order(("k",), "t", ("seq",), limit).dealt(df)
    sizes = dealt.groupBy("k", RANGE).count().where("k = 0").toPandas()
    assert sizes["count"].sum() == n * 9 // 10 and sizes["count"].between(limit / 2, 2 * limit).all()
    long = dealt.select("k", "_many").distinct().collect()
    assert {r.k for r in long if r._many} >= {0} and len({r.k for r in long}) == 8


def test_rows_are_read_and_exchanged_once(spark, tmp_path, monkeypatch):
    """Segments, shifted values, sums and positions come from one scan and one exchange of the rows, long streams or not."""
    spark.createDataFrame(rows_of()).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    written = []
    monkeypatch.setattr(ordered, "written", lambda rows: written.append(rows) or cut(rows))
    for limit in (100, 10**9):
        order = Order(("k",), "t", ("seq",), limit)
        order = order.sampled(df) if limit == 100 else replace(order, bounds=df.limit(0))
        for run in (lambda: gap_segments(df, order, 5), lambda: ahead_by(df, order, "v", 10, "later"),
                    lambda: running(df, order, F.col("v"), "total"), lambda: positions(df, order)):
            written.clear()
            result = run()
            text = (written[0] if order.many else result)._jdf.queryExecution().executedPlan().toString()
            scans = [line for line in text.splitlines() if "Scan parquet" in line and "_bounds" not in line]
            assert len(scans) == 1 and text.count("Exchange hashpartitioning") == 1
            if order.many:  # what is read afterwards is the written table, and rows are not exchanged again
                after = result._jdf.queryExecution().executedPlan().toString()
                assert str(tmp_path) not in after


def test_nothing_is_drawn_where_every_stream_fits_a_range(spark, monkeypatch):
    written = []
    monkeypatch.setattr(ordered, "written", lambda rows: written.append(rows) or cut(rows))
    df = spark.createDataFrame([(k, i) for k in range(5) for i in range(200)], "k int, t long")
    order = Order(("k",), "t").sampled(df)
    assert not written and not order.many and order.bounds is not None
    assert positions(df, order).agg(F.max("pos"), F.max("n")).first() == (199, 200)
    assert Order(("k",), "t", (), 100).sampled(df).many and written  # longer than a range: drawn as ever


def test_gap_is_strict(frame):
    times = [0, SECOND, 2 * SECOND + 1, 2 * SECOND + 2, 9 * SECOND]
    df = frame("k int, t long, seq long", [(1, t, i) for i, t in enumerate(times)])
    for limit in (1, 2, 3, 10**9):
        got = gap_segments(df, Order(("k",), "t", ("seq",), limit), SECOND).orderBy("t").toPandas()
        assert got.segment_id.tolist() == [0, 0, 1, 1, 2]


def test_first_transition_and_null_breaks_a_run(frame):
    order = Order(("k",), "t", (), 2)
    df = frame("k int, t long, f int, pos double", [(1, i, f, float(i * 10)) for i, f in enumerate([0, 0, 1, 1, 0])])
    assert first_transition(df, order, "f", 1).first().pos == 2
    flags = frame("k int, t long, f boolean", [(1, i, f) for i, f in enumerate([True, True, None, True])])
    assert longest_run(flags, order, F.col("f")).first().longest == 2


def plan(df):
    return df._jdf.queryExecution().toString()


def test_no_single_task_and_no_nested_loop(spark):
    df = spark.createDataFrame(rows_of(300))
    order = Order(("k",), "t", ("seq",))
    spans = df.select("k", F.col("t").alias("start"), (F.col("t") + 5).alias("end"))
    for result in (gap_segments(df, order, 5), positions(df, order), turning_points(df, order, "v"),
                   intervals.outside_intervals(df, spans, ["k"], "t", "start", "end"),
                   intervals.overlaps(spans.withColumn("i", F.col("start")), spans.withColumn("j", F.col("start")), ["k"])):
        text = plan(result)
        assert "SinglePartition" not in text and "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text


def test_profile_bins_and_interpolation(frame):
    values = [float(x) for x in (3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8)]  # 12 rows: some of 20 bins stay empty
    df = frame("k int, i long, n long, x double", [(1, i, len(values), v) for i, v in enumerate(values)] + [(2, 0, 1, 7.0)])
    got = {r.k: r.profile for r in cycles.profiles(df, ["k"], "x").collect()}
    where = np.minimum((np.linspace(0, 1, 12, endpoint=False) * 20).astype(int), 19)
    want = pd.Series([np.mean([v for v, b in zip(values, where) if b == bin_]) if bin_ in where else np.nan for bin_ in range(20)])
    assert np.allclose(got[1], want.interpolate(limit_direction="both")) and got[2] == [7.0] * 20


def test_late_answer_wins_and_missing_label_is_null(frame):
    starts = frame("stream_id int, segment_id long, start_us long", [(1, 0, 10), (1, 1, 20)])
    answers = frame("stream_id int, start_us long, answer_seq int, status string", [(1, 10, 1, "Normal"), (1, 10, 2, "Abnormal resistance")])
    got = {r.segment_id: r.status for r in cycles.attach_labels(starts, answers, ["stream_id"]).collect()}
    assert got == {0: "Abnormal resistance", 1: None}
