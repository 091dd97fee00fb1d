"""Live queries run over the whole event table as a stream that is then at its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wayside.functions.columns import DAY_US, HOUR_US, micros, rounded
from wayside.plans.catalog_fatigue import CYC
from wayside.plans.inputs import EV, GAP, SEG, event_stream
from wayside.plans.registry import query, rd
from wayside.session import shared_folder, table
from wayside.streaming import live

DELAY, DELAY_US = "1 hour", 3_600_000_000


def derived(rows):
    """Events with the same derived columns as the batch form."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return rows.select(
        F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), micros("ts").alias("t"),
        F.col("event_type").alias("mode"), (F.col("value") / 0.97).alias("current"), (k + F.col("value") / 9.7).alias("bemf"), k.cast("double").alias("pos"))


def stream(spark, sf):
    """The event table read as a stream."""
    return derived(live.read_rows(spark, sf, "events.parquet", table(spark, sf, "events").schema))


MARK = f"wm AS (SELECT (max(t) // 1000) * 1000 - {DELAY_US} AS mark FROM ev)"


@query(
    "stream_gap_segments",
    f"""WITH {SEG}, {MARK} SELECT stream_id, min(t) AS start_us, max(t) AS end_us, count(*) AS n_rows, {rd("avg(current)")} AS cur_mean FROM seg, wm
    GROUP BY stream_id, segment_id, mark HAVING max(t) + {GAP} <= mark""",
)
def stream_gap_segments(spark, sf):
    s = live.live_segments(stream(spark, sf), ["stream_id"], "ts", "24 hours", DELAY, F.avg("current").alias("cur_mean"))
    done, _ = live.run_available(s)
    return done.select("stream_id", micros("start").alias("start_us"), micros("end").alias("end_us"), "n_rows", rounded("cur_mean").alias("cur_mean"))


@query(
    "stream_peer_deviation",
    f"""WITH {EV}, {MARK}, r AS (SELECT stream_id // 8 AS case_id, stream_id, t, t // {DAY_US} AS d, current FROM ev),
    m AS (SELECT case_id, d, median(current) AS med, count(*) AS n FROM r GROUP BY ALL)
    SELECT case_id, stream_id, t, {rd("current - med")} AS peer_dev FROM r JOIN m USING (case_id, d), wm WHERE n >= 3 AND (d + 1) * {DAY_US} <= mark""",
)
def stream_peer_deviation(spark, sf):
    rows = stream(spark, sf).withColumn("case_id", F.floor(F.col("stream_id") / 8))
    done, _ = live.run_available(live.live_peer_deviation(rows, ["case_id"], "stream_id", "ts", "1 day", DELAY, "current"))
    return done.select("case_id", "stream_id", micros("ts").alias("t"), rounded("peer_dev").alias("peer_dev"))


@query(
    "stream_segment_features",
    f"""WITH {SEG}, {MARK}, v AS (SELECT *, abs(pos - coalesce(lag(pos) OVER (PARTITION BY stream_id, segment_id ORDER BY i), pos)) AS v, greatest(1, floor(9e-1 * n)) AS k FROM segp)
    SELECT stream_id, min(t) AS start_us, count(*) AS n_rows, {rd("avg(current) FILTER (i < k)")} AS trav_mean, {rd("avg(current) FILTER (i >= floor(3e-1 * n) AND i < floor(8e-1 * n))")} AS mid_mean,
      {rd("avg(v)")} AS vel_mean, count(*) FILTER (v = 0 AND current > 200) AS stall_rows, {rd("CASE WHEN any_value(k) > 2 THEN regr_slope(current, bemf) FILTER (i < k) ELSE 0 END")} AS slope
    FROM v, wm GROUP BY stream_id, segment_id, mark HAVING max(t) + {GAP} + 1 <= mark""",
)
def stream_segment_features(spark, sf):
    done, _ = live.run_available(live.live_cycle_features(stream(spark, sf), GAP, DELAY))
    return done.select("stream_id", "start_us", "n_rows", "stall_rows", *[rounded(c).alias(c) for c in ("trav_mean", "mid_mean", "vel_mean", "slope")])


_DONE = CYC.replace("ev AS (", "ev_all AS (", 1).replace(
    ", mv AS", f""", wm AS (SELECT (max(t) // 1000) * 1000 - {DELAY_US} AS mark FROM ev_all),
ev AS (SELECT * FROM ev_all WHERE stream_id IN (SELECT stream_id FROM ev_all, wm GROUP BY stream_id, mark HAVING max(t) // 1000 + 1 <= mark // 1000)), mv AS""", 1)


@query("stream_rainflow_residue", f"WITH RECURSIVE {_DONE} SELECT stream_id, {rd('range')} AS range, {rd('mean')} AS mean, cnt FROM cyc")
def stream_rainflow_residue(spark, sf):
    """Cycles of the series whose rows the watermark has passed: closed ones as emitted, and the last residue.

    The hours are laid so that one ends where the watermark stands after the last row: all rows it has passed are counted.
    """
    rows = stream(spark, sf)
    newest = table(spark, sf, "events").agg(F.max(micros("ts"))).first()[0]
    mark = (newest or 0) // 1000 * 1000 - DELAY_US
    done, _ = live.run_available(live.live_rainflow(rows, DELAY, start=f"{mark % HOUR_US} microseconds"), state=live.ROCKS)
    ended = event_stream(spark, sf).groupBy("stream_id").agg(F.max("t").alias("last")).where((F.floor(F.col("last") / 1000) + 1) * 1000 <= mark)
    return live.newest_residue(done).join(ended, "stream_id", "left_semi").select("stream_id", rounded("range").alias("range"), rounded("mean").alias("mean"), "cnt")


@query(
    "stream_scoring",
    f"""WITH {SEG}, {MARK}, p AS (SELECT stream_id, min(t) AS start_us, least(1, avg(current) / 120) AS p1, least(1, max(current) / 300) AS p2 FROM seg, wm GROUP BY stream_id, segment_id, mark HAVING max(t) + {GAP} <= mark)
    SELECT stream_id, start_us, {rd("p1")} AS p1, {rd("p2")} AS p2, CASE WHEN greatest(p1, p2) < 6e-1 THEN 'Normal' WHEN p1 >= p2 THEN 'Side I' ELSE 'Side II' END AS prediction FROM p""",
)
def stream_scoring(spark, sf):
    """Closed segments labelled from two scores (stand-ins for fitted models) as they arrive."""
    s = live.live_segments(stream(spark, sf), ["stream_id"], "ts", "24 hours", DELAY, F.avg("current").alias("a"), F.max("current").alias("m"))
    score = lambda b: b.select(
        "stream_id", "start", F.least(F.lit(1.0), F.col("a") / 120).alias("p1"), F.least(F.lit(1.0), F.col("m") / 300).alias("p2"))
    done = live.live_scoring(s, score, 0.6)
    return done.select("stream_id", micros("start").alias("start_us"), rounded("p1").alias("p1"), rounded("p2").alias("p2"), "prediction")


LATE = 10  # every so many-th event arrives after all others


@query(
    "stream_late_rows",
    f"""WITH {EV}, wm AS (SELECT (max(t) // 1000) * 1000 - {DELAY_US} AS mark FROM ev WHERE seq % {LATE} <> 0)
    SELECT stream_id, seq, t FROM ev, wm WHERE seq % {LATE} = 0 AND t <= mark""",
)
def stream_late_rows(spark, sf):
    """The rows that a live run does not take in when every tenth event arrives after all others."""
    base = f"{shared_folder(spark)}/arrivals-{uuid.uuid4().hex}"
    events = table(spark, sf, "events")
    late = F.col("event_id") % LATE == 0
    for part in (events.where(~late), events.where(late)):
        part.write.mode("append").parquet(f"{base}/in")
        rows = derived(spark.readStream.schema(events.schema).parquet(f"{base}/in"))
        accepted, _ = live.run_available(live.accepted_rows(rows.select("stream_id", "seq", "t", "ts"), ["stream_id", "seq"], "ts", DELAY), f"{base}/out")
    return live.late_table(derived(events).select("stream_id", "seq", "t"), accepted, ["stream_id", "seq"])
