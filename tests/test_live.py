import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayside.functions.columns import micros
from wayside.operators import cycles, fatigue
from wayside.operators.ordered import Order, gap_segments
from wayside.streaming import live

SECOND = 1_000_000


def rows_of(n=400):
    """Two streams at 0.2 s with 30 s pauses."""
    out = []
    for stream in (1, 2):
        t = 0
        for i in range(n):
            t += 30 * SECOND if i % 37 == 36 else 200_000
            out.append((stream, stream * n + i, t + stream, float((i * 7919 + stream * 31) % 97), float(i % 13), float(i % 5)))
    return pd.DataFrame(out, columns=["stream_id", "seq", "t", "current", "bemf", "pos"])


SENTINEL = pd.DataFrame([(9, 0, 10**10, 1.0, 1.0, 1.0)], columns=["stream_id", "seq", "t", "current", "bemf", "pos"])


@pytest.fixture
def folder(spark, tmp_path):
    """The rows in two files, the far-future row that closes everything in a third."""
    data = rows_of()
    parts = [data[data.t < 100 * SECOND], data[data.t >= 100 * SECOND], SENTINEL]
    for n, part in enumerate(parts):
        df = spark.createDataFrame(part).withColumn("ts", F.timestamp_micros("t"))
        df.coalesce(1).write.parquet(str(tmp_path / "in" / f"part{n}"))
    return str(tmp_path / "in")


def stream_of(spark, folder):
    schema = spark.read.parquet(f"{folder}/part0").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/part*")


def batch_of(spark, folder):
    return spark.read.parquet(f"{folder}/part0", f"{folder}/part1")


ORDER = Order(("stream_id",), "t", ("seq",))


def test_segments_equal_batch(spark, folder):
    done, query = live.run_available(live.live_segments(stream_of(spark, folder), ["stream_id"], "ts", "1 second", "0 seconds"))
    got = {(r.stream_id, r.s, r.n_rows) for r in done.select("stream_id", micros("start").alias("s"), "n_rows").collect()}
    segments = gap_segments(batch_of(spark, folder), ORDER, SECOND)
    want = cycles.bounds(segments, ORDER.within("stream_id", "segment_id")).collect()
    assert got == {(r.stream_id, r.start_us, r.n_rows) for r in want} and live.late_rows(query) == 0


def test_cycle_features_equal_batch(spark, folder):
    done, _ = live.run_available(live.live_cycle_features(stream_of(spark, folder), SECOND, "0 seconds"), state=live.ROCKS)
    order = ORDER.within("stream_id", "segment_id")
    keys = list(order.keys)
    placed = cycles.placed_in(gap_segments(batch_of(spark, folder), ORDER, SECOND), order)
    want = (
        cycles.phases(placed, keys).join(cycles.velocities(placed, order, "pos"), keys)
        .join(cycles.travel_slope(placed, keys, "current", "bemf"), keys).join(cycles.bounds(placed, order).drop("n_rows"), keys))
    columns = ["trav_mean", "mid_mean", "vel_mean", "stall_rows", "slope"]
    table = lambda df: df.select("stream_id", "start_us", *columns).orderBy("stream_id", "start_us").toPandas()
    pd.testing.assert_frame_equal(table(done), table(want))


def test_rainflow_equals_batch(spark, folder):
    done, _ = live.run_available(live.live_rainflow(stream_of(spark, folder), "0 seconds"), state=live.ROCKS)
    got = live.newest_residue(done).where("stream_id < 9").select("stream_id", "range", "mean", "cnt")
    want = fatigue.rainflow(batch_of(spark, folder), ORDER, "current")
    table = lambda df: sorted(map(tuple, df.collect()))
    assert table(got) == table(want)


@pytest.mark.parametrize("bucket", ["1 second", "1 minute"])
def test_rainflow_over_many_buckets_equals_batch(spark, folder, bucket):
    done, _ = live.run_available(live.live_rainflow(stream_of(spark, folder), "0 seconds", bucket=bucket), state=live.ROCKS)
    got = live.newest_residue(done).where("stream_id < 9").select("stream_id", "range", "mean", "cnt")
    table = lambda df: sorted(map(tuple, df.collect()))
    assert table(got) == table(fatigue.rainflow(batch_of(spark, folder), ORDER, "current"))


def test_peer_deviation_equals_batch(spark, folder):
    """Windows of 30 seconds; the median comes from counted values, readings are met one by one."""
    rows = stream_of(spark, folder).withColumn("train", F.lit(1))
    done, _ = live.run_available(live.live_peer_deviation(rows, ["train"], "stream_id", "ts", "30 seconds", "0 seconds", "current"))
    batch = batch_of(spark, folder).withColumn("w", F.floor(F.col("t") / (30 * SECOND))).toPandas()
    batch["dev"] = batch.current - batch.groupby("w").current.transform("median")
    batch = batch[batch.groupby("w").current.transform("size") >= 3]
    got = sorted((r.stream_id, r.t, r.peer_dev) for r in done.select("stream_id", micros("ts").alias("t"), "peer_dev").where("t < 9e9").collect())
    assert got == sorted(zip(batch.stream_id, batch.t, batch.dev))


def test_late_rows_are_a_table(spark, tmp_path):
    """What is late is all that arrived but what was taken in; it is as many rows as the run says it dropped."""
    first, second = rows_of(60), rows_of(60).assign(seq=lambda d: d.seq + 1000)
    schema = None
    for part in (pd.concat([first, SENTINEL]), second):
        df = spark.createDataFrame(part).withColumn("ts", F.timestamp_micros("t"))
        schema = df.schema
        df.write.mode("append").parquet(str(tmp_path / "in"))
        rows = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        accepted, query = live.run_available(live.accepted_rows(rows, ["stream_id", "seq"], "ts", "0 seconds"), str(tmp_path / "out"))
    late = live.late_table(spark.read.parquet(str(tmp_path / "in")), accepted, ["stream_id", "seq"])
    assert {(r.stream_id, r.seq) for r in late.collect()} == set(zip(second.stream_id, second.seq)) and live.late_rows(query) == len(second)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    early, late = rows_of(60), rows_of(60).assign(seq=lambda d: d.seq + 1000)
    # a batch is held against the watermark its predecessor started with, hence two far-future rows
    for n, part in enumerate([early, SENTINEL, SENTINEL.assign(seq=1, t=SENTINEL.t + SECOND), late]):
        spark.createDataFrame(part).withColumn("ts", F.timestamp_micros("t")).coalesce(1).write.parquet(str(tmp_path / f"part{n}"))
    schema = spark.read.parquet(str(tmp_path / "part0")).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "part*"))
    done, query = live.run_available(live.live_segments(rows, ["stream_id"], "ts", "1 second", "0 seconds"))
    assert live.late_rows(query) > 0 and done.where("stream_id < 9").agg(F.sum("n_rows")).first()[0] == len(early)


def test_scoring_labels_closed_segments(spark, folder):
    segments = live.live_segments(stream_of(spark, folder), ["stream_id"], "ts", "1 second", "0 seconds", F.avg("current").alias("m"))
    done = live.live_scoring(segments, lambda b: b.select("stream_id", "start", (F.col("m") / 100).alias("p1"), F.lit(0.1).alias("p2")), 0.48)
    assert {r.prediction for r in done.collect()} == {"Normal", "Side I"}


def test_rainflow_query_takes_all_series_that_the_watermark_has_passed(spark, tmp_path):
    """Also a series whose last row is in the hour in which the watermark stands; not one with a row at or after it."""
    import duckdb

    import __spark_entry__ as entry

    hour, day = 3_600_000_000, 1_704_067_200_000_000
    newest = day + 9 * hour + 1_800_123_456  # the watermark is at 8:30 and 0.123 s
    mark = newest // 1000 * 1000 - hour
    ends = {1: day + 8 * hour - 1, 2: mark - 1, 3: mark - 1000, 4: mark, 5: newest, 6: day + 8 * hour + 5}
    rows = [(user, end - back * 1_700_000_000) for user, end in ends.items() for back in range(6)]
    data = [(i, u, t, "a", float(i * 7919 % 31), '{"k": 3}') for i, (u, t) in enumerate(rows)]
    frame = pd.DataFrame(data, columns=["event_id", "user_id", "t", "event_type", "value", "props"])  # noqa: F841
    duck = duckdb.connect()
    duck.sql("CREATE TABLE events AS SELECT event_id, user_id, make_timestamp(t) AS ts, event_type, value, props FROM frame")
    duck.sql(f"COPY events TO '{tmp_path}/events.parquet'")
    got = sorted(map(tuple, entry.queries()["stream_rainflow_residue"](spark, str(tmp_path)).collect()))
    assert {r[0] for r in got} == {1, 2, 3, 6}
    assert got == sorted(duck.sql(entry.oracle_sql()["stream_rainflow_residue"]).limit(10_000).fetchall())
