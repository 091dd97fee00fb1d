"""Queries over continuous streams: segmentation, ordered operators and cycle features."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayside.functions.columns import (
    DAY_US, format_native_ts, micros, natural_key, parse_native_ts, rounded,
)
from wayside.operators import cycles, ordered
from wayside.operators.intervals import outside_intervals, top_rows
from wayside.operators.quantiles import exact_quantiles
from wayside.operators.rail import pulse_speeds, run_length_medians
from wayside.plans.inputs import EV, GAP, LI, RECORDING, SEG, STREAM, event_stream, recordings
from wayside.plans.registry import query, rd
from wayside.session import cut, table

KEYS = ["stream_id", "segment_id"]


def streamed(spark, sf):
    """The event stream and its order, with the ranges of long streams known."""
    rows = event_stream(spark, sf)
    return rows, STREAM.sampled(rows)


def segments(spark, sf):
    """Segmented rows and the order inside a segment."""
    rows, order = streamed(spark, sf)
    return ordered.gap_segments(rows, order, GAP), order.within(*KEYS)


def segmented(spark, sf):
    """As ``segments``, written once: for queries that look at the segments several times."""
    rows, order = segments(spark, sf)
    return cut(rows), order


def recorded(spark, sf):
    rows = recordings(spark, sf)
    return rows, RECORDING.sampled(rows)


@query(
    "native_ts_roundtrip",
    """WITH e AS (SELECT event_id, ts, epoch_us(ts) AS t FROM events)
    SELECT event_id, concat_ws('-', year(ts), month(ts), day(ts), hour(ts), minute(ts), second(ts), (t % 1000000) // 1000)
      AS native, t - t % 1000 AS parsed_us FROM e""",
)
def native_ts_roundtrip(spark, sf):
    e = table(spark, sf, "events").select("event_id", format_native_ts("ts").alias("native"))
    return e.withColumn("parsed_us", micros(parse_native_ts("native")))


@query(
    "natural_order",
    """SELECT c_custkey, c_name, CAST(row_number() OVER (PARTITION BY c_nationkey
      ORDER BY CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT)) AS BIGINT) AS place FROM customer""",
)
def natural_order(spark, sf):
    """Place of every customer name inside its nation when digit runs compare as numbers."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    return ordered.places(c, ["c_nationkey"], [natural_key("c_name")]).select("c_custkey", "c_name", "place")


@query("gap_segments", f"WITH {SEG} SELECT stream_id, seq, t, segment_id FROM seg")
def gap_segments(spark, sf):
    return segments(spark, sf)[0].select("stream_id", "seq", "t", "segment_id")


@query(
    "segment_bounds",
    f"""WITH {SEG}, b AS (SELECT stream_id, segment_id, min(t) AS start_us, max(t) AS end_us, count(*) AS n_rows
      FROM seg GROUP BY ALL)
    SELECT *, strftime(make_timestamp(start_us), '%Y-%-m-%-d-%-H-%-M-%-S-') || (start_us % 1000000) // 1000 AS start_time,
      strftime(make_timestamp(end_us), '%Y-%-m-%-d-%-H-%-M-%-S-') || (end_us % 1000000) // 1000 AS end_time FROM b""",
)
def segment_bounds(spark, sf):
    b = cycles.bounds(*segments(spark, sf))
    native = lambda c: format_native_ts(F.timestamp_micros(F.col(c)))
    return b.withColumn("start_time", native("start_us")).withColumn("end_time", native("end_us"))


DIRECTION = """dir AS (SELECT stream_id, segment_id, arg_min(pos, (t, seq)) AS pos_start, arg_max(pos, (t, seq)) AS pos_end,
  CASE WHEN arg_max(pos, (t, seq)) > arg_min(pos, (t, seq)) THEN 'Open' ELSE 'Close' END AS operation
  FROM seg GROUP BY ALL)"""


@query("segment_direction", f"WITH {SEG}, {DIRECTION} SELECT * FROM dir")
def segment_direction(spark, sf):
    return cycles.directions(*segments(spark, sf))


@query(
    "segment_labels",
    f"""WITH {SEG}, b AS (SELECT stream_id, segment_id, min(t) AS start_us FROM seg GROUP BY ALL),
    ans AS (SELECT stream_id, t AS start_us, CASE WHEN current > 30 THEN 'Abnormal resistance' ELSE 'Normal' END AS status
      FROM ev WHERE mode IN ('error', 'signup'))
    SELECT b.*, status FROM b LEFT JOIN ans USING (stream_id, start_us)""",
)
def segment_labels(spark, sf):
    starts = cycles.bounds(*segments(spark, sf)).select(*KEYS, "start_us")
    answers = event_stream(spark, sf).where(F.col("mode").isin("error", "signup")).select(
        "stream_id", F.col("t").alias("start_us"), F.col("seq").alias("answer_seq"),
        F.when(F.col("current") > 30, "Abnormal resistance").otherwise("Normal").alias("status"),
    )
    return cycles.attach_labels(starts, answers, ["stream_id"]).select(*KEYS, "start_us", "status")


@query(
    "gap_profile",
    f"""WITH {SEG}, d AS (SELECT dt / 1e6 AS dt FROM step WHERE dt IS NOT NULL), b AS (
      SELECT stream_id, segment_id, min(t) AS s, max(t) AS e FROM seg GROUP BY ALL HAVING count(*) >= 3)
    SELECT 'p50' AS metric, {rd("quantile_cont(dt, 5e-1)")} AS value FROM d
    UNION ALL SELECT 'p90', {rd("quantile_cont(dt, 9e-1)")} FROM d
    UNION ALL SELECT 'p99', {rd("quantile_cont(dt, 99e-2)")} FROM d
    UNION ALL SELECT 'p999', {rd("quantile_cont(dt, 999e-3)")} FROM d
    UNION ALL SELECT 'over_1h', count(*) FILTER (dt > 3600) FROM d
    UNION ALL SELECT 'over_6h', count(*) FILTER (dt > 21600) FROM d
    UNION ALL SELECT 'over_24h', count(*) FILTER (dt > 86400) FROM d
    UNION ALL SELECT 'top_' || lpad(CAST(r AS VARCHAR), 2, '0'), {rd("dt")} FROM
      (SELECT dt, row_number() OVER (ORDER BY dt DESC) AS r FROM d) WHERE r <= 15
    UNION ALL SELECT 'outside', (SELECT count(*) FROM ev WHERE NOT EXISTS (SELECT 1 FROM b
      WHERE b.stream_id = ev.stream_id AND ev.t BETWEEN s AND e))""",
)
def gap_profile(spark, sf):
    """Quantiles of the time steps, how many exceed a threshold, the 15 largest, rows outside cycles of 3+ rows."""
    events, order = streamed(spark, sf)
    steps = ordered.previous(events, order, "t").select(((F.col("t") - F.col("prev_t")) / 1e6).alias("dt"))
    q = exact_quantiles(steps, [], "dt", {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999})
    over = steps.agg(*[
        F.count(F.when(F.col("dt") > hours * 3600, 1)).cast("double").alias(f"over_{hours}h") for hours in (1, 6, 24)
    ])
    top = top_rows(steps.where("dt IS NOT NULL"), [F.desc("dt")], 15, "r")
    spans = cycles.bounds(*segments(spark, sf)).where("n_rows >= 3")
    outside = outside_intervals(events, spans, ["stream_id"], "t", "start_us", "end_us")
    parts = [
        q.unpivot([], list(q.columns), "metric", "value"),
        over.unpivot([], list(over.columns), "metric", "value"),
        top.select(F.concat(F.lit("top_"), F.lpad(F.col("r").cast("string"), 2, "0")).alias("metric"), F.col("dt").alias("value")),
        outside.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("outside").alias("metric"), "value"),
    ]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return whole.select("metric", rounded("value").alias("value"))


@query(
    "profile_20bin",
    f"""WITH {LI}, b AS (SELECT rec, least(CAST(floor(i * (1e0 / n) * 20) AS INTEGER), 19) AS bin, avg(x) AS m FROM li GROUP BY ALL)
    SELECT rec, bin, {rd("m", 4)} AS value FROM b""",
)
def profile_20bin(spark, sf):
    rows, order = recorded(spark, sf)
    placed = cycles.placed_in(rows, order)
    p = cycles.profiles(placed, ["rec"], "x")
    return p.select("rec", F.posexplode("profile").alias("bin", "v")).select("rec", "bin", rounded("v", 4).alias("value"))


@query(
    "longest_run",
    f"""WITH {EV}, a AS (SELECT *, current > 40 AS hit, row_number() OVER (PARTITION BY stream_id ORDER BY t, seq)
      - row_number() OVER (PARTITION BY stream_id, current > 40 ORDER BY t, seq) AS g FROM ev),
    r AS (SELECT stream_id, hit, g, count(*) AS c FROM a GROUP BY ALL)
    SELECT stream_id, coalesce(max(c) FILTER (hit), 0) AS longest FROM r GROUP BY ALL""",
)
def longest_run(spark, sf):
    return ordered.longest_run(*streamed(spark, sf), F.col("current") > 40)


@query(
    "first_transition",
    f"""WITH {EV}, a AS (SELECT *, CASE WHEN current > 40 THEN 1 ELSE 0 END AS f,
      row_number() OVER (PARTITION BY stream_id ORDER BY t, seq) - 1 AS p FROM ev),
    b AS (SELECT *, f - lag(f) OVER (PARTITION BY stream_id ORDER BY t, seq) AS d FROM a),
    c AS (SELECT stream_id, CASE WHEN d = 1 THEN 'act' ELSE 'rel' END AS kind, min(p) AS at_row, arg_min(pos, p) AS pos_there
      FROM b WHERE d <> 0 GROUP BY ALL)
    SELECT * FROM c""",
)
def first_transition(spark, sf):
    """First 0→1 (act) and 1→0 (rel) of a switch per stream, with the leaf position there."""
    rows, order = streamed(spark, sf)
    e = rows.withColumn("f", F.when(F.col("current") > 40, 1).otherwise(0))
    return _transition(e, order, 1, "act").unionByName(_transition(e, order, 0, "rel"))


def _transition(e, order, to, kind):
    found = ordered.first_transition(e.withColumnRenamed("pos", "place"), order, "f", to, "place")
    return found.select("stream_id", F.lit(kind).alias("kind"), F.col("pos").alias("at_row"), F.col("place").alias("pos_there"))


@query(
    "transition_summary",
    f"""WITH {SEG}, {DIRECTION},
    a AS (SELECT *, CASE WHEN current > 40 THEN 1 ELSE 0 END AS f FROM segp),
    b AS (SELECT *, f - lag(f) OVER (PARTITION BY stream_id, segment_id ORDER BY t, seq) AS d FROM a),
    c AS (SELECT stream_id, segment_id, min(i) * 2e-2 AS timing FROM b WHERE d = 1 GROUP BY ALL),
    l AS (SELECT stream_id, segment_id, CASE WHEN avg(current) > 50 THEN 'Abnormal resistance' ELSE 'Normal' END AS label
      FROM seg GROUP BY ALL)
    SELECT operation, label, count(*) AS n, {rd("min(timing)")} AS t_min, {rd("median(timing)")} AS t_median,
      {rd("max(timing)")} AS t_max FROM c JOIN dir USING (stream_id, segment_id) JOIN l USING (stream_id, segment_id) GROUP BY ALL""",
)
def transition_summary(spark, sf):
    """Switch timing (s from cycle start) by operation and label."""
    s, order = segmented(spark, sf)
    e = s.withColumn("f", F.when(F.col("current") > 40, 1).otherwise(0))
    timing = ordered.first_transition(e, order, "f", 1).withColumn("timing", F.col("pos") * cycles.SAMPLE_S)
    label = s.groupBy(*KEYS).agg(
        F.when(F.avg("current") > 50, "Abnormal resistance").otherwise("Normal").alias("label"))
    both = cut(timing.join(cycles.directions(s, order), KEYS).join(label, KEYS))
    by = ["operation", "label"]
    ends = both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), rounded(F.min("timing")).alias("t_min"), rounded(F.max("timing")).alias("t_max"))
    mid = exact_quantiles(both, by, "timing", {"t_median": 0.5})
    return ends.join(mid, by).withColumn("t_median", rounded("t_median"))


@query(
    "pulse_speed",
    f"""WITH {LI}, d AS (SELECT rec, n, pulse - lag(pulse) OVER (PARTITION BY rec ORDER BY i) AS d FROM li)
    SELECT rec, n, {rd("count(*) FILTER (d <> 0) / 180e0 * pi() * 85e-2 * (1e4 / n)")} AS speed,
      {rd("count(*) FILTER (d > 0) / 90e0 * pi() * 85e-2")} AS rising_speed FROM d GROUP BY rec, n""",
)
def pulse_speed(spark, sf):
    s = pulse_speeds(*recorded(spark, sf), "pulse", 10_000.0)
    return s.select("rec", "n", rounded("speed").alias("speed"), rounded("rising_speed").alias("rising_speed"))


@query(
    "run_length_median",
    f"""WITH {LI}, c AS (SELECT rec, i, pulse <> lag(pulse) OVER (PARTITION BY rec ORDER BY i) AS ch FROM li),
    g AS (SELECT rec, i - lag(i) OVER (PARTITION BY rec ORDER BY i) AS len FROM c WHERE ch)
    SELECT rec, {rd("median(len)")} AS run_median, count(len) AS n_runs FROM g WHERE len IS NOT NULL GROUP BY rec""",
)
def run_length_median(spark, sf):
    """Median distance between consecutive level changes of the pulse."""
    m = run_length_medians(*recorded(spark, sf), "pulse")
    return m.select("rec", rounded("run_median").alias("run_median"), "n_runs")


@query(
    "lead10_delta",
    f"""WITH {EV} SELECT stream_id, seq,
      {rd("lead(current, 10) OVER (PARTITION BY stream_id ORDER BY t, seq) - current")} AS delta_10 FROM ev""",
)
def lead10_delta(spark, sf):
    later = ordered.ahead_by(*streamed(spark, sf), "current", 10, "later")
    return later.select("stream_id", "seq", rounded(F.col("later") - F.col("current")).alias("delta_10"))


TURNS = """mv AS (SELECT * FROM (SELECT *, lag(current) OVER (PARTITION BY stream_id ORDER BY t, seq) AS p FROM ev)
  WHERE p IS NULL OR p <> current),
tp AS (SELECT stream_id, seq, t, current, row_number() OVER (PARTITION BY stream_id ORDER BY t, seq) AS r FROM (
  SELECT *, lead(current) OVER (PARTITION BY stream_id ORDER BY t, seq) AS nx FROM mv)
  WHERE p IS NULL OR nx IS NULL OR (current > p) <> (nx > current))"""


@query("turning_points", f"WITH {EV}, {TURNS} SELECT stream_id, seq, t, current FROM tp")
def turning_points(spark, sf):
    rows, order = streamed(spark, sf)
    return ordered.turning_points(rows.select("stream_id", "seq", "t", "current"), order, "current")


def _rounded(df, keys, skip=()):
    return df.select(*keys, *[c if c in skip else rounded(c).alias(c) for c in df.columns if c not in keys])


ELECTRICAL = """el AS (SELECT stream_id, segment_id, count(*) AS n_rows, (max(t) - min(t)) / 1e6 AS duration,
  max(current) AS cur_peak, avg(current) AS cur_mean, sqrt(avg(current * current)) AS cur_rms, stddev_pop(current) AS cur_std,
  sum(current) * 2e-2 AS cur_integral, quantile_cont(current, 9e-1) AS cur_p90, median(current) AS cur_median,
  avg(voltage) AS volt_mean, max(voltage) AS volt_max, avg(bemf) AS bemf_mean, max(bemf) AS bemf_max,
  sum(voltage * 1e-2 * current * 1e-3 * 2e-2) AS energy,
  CASE WHEN avg(voltage) = 0 THEN 0 ELSE avg(bemf) / avg(voltage) END AS bemf_per_volt,
  arg_min(pos, (t, seq)) AS pos_start, arg_max(pos, (t, seq)) AS pos_end,
  abs(arg_max(pos, (t, seq)) - arg_min(pos, (t, seq))) AS pos_range,
  CASE WHEN arg_max(pos, (t, seq)) > arg_min(pos, (t, seq)) THEN 1e0 ELSE 0e0 END AS op_is_open FROM seg GROUP BY ALL)"""
NUMERIC = ("duration cur_peak cur_mean cur_rms cur_std cur_integral cur_p90 cur_median volt_mean volt_max bemf_mean "
           "bemf_max energy bemf_per_volt pos_start pos_end pos_range op_is_open").split()


@query(
    "segment_features",
    f"WITH {SEG}, {ELECTRICAL} SELECT stream_id, segment_id, n_rows, " + ", ".join(f"{rd(c)} AS {c}" for c in NUMERIC) + " FROM el",
)
def segment_features(spark, sf):
    return _rounded(cycles.electrical(*segmented(spark, sf)), KEYS, ("n_rows",))


PHASE = """ph AS (SELECT {keys}, avg(x) FILTER (i < k) AS trav_mean, max(x) FILTER (i < k) AS trav_max,
  stddev_pop(x) FILTER (i < k) AS trav_std, quantile_cont(x, 9e-1) FILTER (i < k) AS trav_p90, avg(CASE WHEN x > 300 THEN 1e0 ELSE 0e0 END) FILTER (i < k) AS trav_above_300,
  avg(CASE WHEN x > 500 THEN 1e0 ELSE 0e0 END) FILTER (i < k) AS trav_above_500,
  avg(x) FILTER (i >= floor(3e-1 * n) AND i < floor(8e-1 * n)) AS mid_mean,
  max(x) FILTER (i >= floor(3e-1 * n) AND i < floor(8e-1 * n)) AS mid_max
  FROM (SELECT *, greatest(1, floor(9e-1 * n)) AS k FROM {source}) GROUP BY ALL)"""
PHASES = "trav_mean trav_max trav_std trav_p90 trav_above_300 trav_above_500 mid_mean mid_max".split()


@query(
    "phase_features",
    f"WITH {LI}, {PHASE.format(keys='rec', source='li')} SELECT rec, " + ", ".join(f"{rd(c)} AS {c}" for c in PHASES) + " FROM ph",
)
def phase_features(spark, sf):
    rows, order = recorded(spark, sf)
    placed = cycles.placed_in(rows, order)
    return _rounded(cycles.phases(placed, ["rec"], "x"), ["rec"])


@query(
    "velocity_stall",
    f"""WITH {LI}, v AS (SELECT *, abs(q - coalesce(lag(q) OVER (PARTITION BY rec ORDER BY i), q)) AS v FROM li)
    SELECT rec, {rd("avg(v)")} AS vel_mean, {rd("max(v)")} AS vel_max,
      {rd("min(v) FILTER (i >= floor(2e-1 * n) AND i < floor(8e-1 * n))")} AS vel_min_mid,
      count(*) FILTER (v = 0 AND x > 200) AS stall_rows FROM v GROUP BY rec""",
)
def velocity_stall(spark, sf):
    rows, order = recorded(spark, sf)
    placed = cycles.placed_in(rows, order)
    return _rounded(cycles.velocities(placed, order, "q", "x"), ["rec"], ("stall_rows",))


@query(
    "group_slope",
    f"""WITH {LI}, k AS (SELECT * FROM li WHERE i < greatest(1, floor(9e-1 * n)))
    SELECT rec, {rd("CASE WHEN count(*) > 2 THEN regr_slope(x, q) ELSE 0 END")} AS slope FROM k GROUP BY rec""",
)
def group_slope(spark, sf):
    rows, order = recorded(spark, sf)
    placed = cycles.placed_in(rows, order)
    return _rounded(cycles.travel_slope(placed, ["rec"], "x", "q"), ["rec"])


PROFILE = """pb AS (SELECT stream_id, segment_id, least(CAST(floor(i * (1e0 / n) * 20) AS INTEGER), 19) AS bin, avg(current) AS m
  FROM segp GROUP BY ALL),
spine AS (SELECT stream_id, segment_id, unnest(range(20)) AS bin FROM (SELECT DISTINCT stream_id, segment_id FROM pb)),
nb AS (SELECT spine.stream_id, spine.segment_id, spine.bin, m,
  last_value(CASE WHEN m IS NULL THEN NULL ELSE pb.bin END IGNORE NULLS) OVER w AS lb, last_value(m IGNORE NULLS) OVER w AS lm,
  first_value(CASE WHEN m IS NULL THEN NULL ELSE pb.bin END IGNORE NULLS) OVER w2 AS rb, first_value(m IGNORE NULLS) OVER w2 AS rm
  FROM spine LEFT JOIN pb ON pb.stream_id = spine.stream_id AND pb.segment_id = spine.segment_id AND pb.bin = spine.bin
  WINDOW w AS (PARTITION BY spine.stream_id, spine.segment_id ORDER BY spine.bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    w2 AS (PARTITION BY spine.stream_id, spine.segment_id ORDER BY spine.bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
prof AS (SELECT stream_id, segment_id, operation, bin, CASE WHEN m IS NOT NULL THEN m WHEN lb IS NULL THEN rm WHEN rb IS NULL THEN lm
  ELSE lm + (rm - lm) * (bin - lb) / CAST(rb - lb AS DOUBLE) END AS v FROM nb JOIN dir USING (stream_id, segment_id)),
norm AS (SELECT stream_id, segment_id, avg(current) <= 50 AS normal FROM seg GROUP BY ALL),
ref AS (SELECT operation, bin, median(v) AS med, quantile_cont(v, 75e-2) - quantile_cont(v, 25e-2) + 1e-6 AS iqr
  FROM prof JOIN norm USING (stream_id, segment_id) WHERE normal GROUP BY ALL),
zz AS (SELECT stream_id, segment_id, operation, bin, v, (v - med) / iqr AS z FROM prof JOIN ref USING (operation, bin))"""


def profiled(spark, sf):
    """Cycles with operation, profile and a stand-in verdict: normal where the mean current is at most 50."""
    s, order = segmented(spark, sf)
    profile = cycles.profiles(cycles.placed_in(s, order), KEYS)
    verdict = s.groupBy(*KEYS).agg((F.avg("current") <= 50).alias("normal"))
    whole = profile.join(cycles.directions(s, order).select(*KEYS, "operation"), KEYS).join(verdict, KEYS)
    return cut(whole)  # one row per cycle, used for the reference and for the deviations


@query(
    "reference_profile",
    f"WITH {SEG}, {DIRECTION}, {PROFILE} SELECT operation, bin, {rd('med')} AS med, {rd('iqr')} AS iqr FROM ref",
)
def reference_profile(spark, sf):
    return _rounded(cycles.reference_profile(profiled(spark, sf), F.col("normal")), ["operation", "bin"])


def with_excess(spark, sf):
    p = profiled(spark, sf)
    return cycles.with_excess(p, cycles.reference_profile(p, F.col("normal")))


@query(
    "excess_features",
    f"""WITH {SEG}, {DIRECTION}, {PROFILE},
    runs AS (SELECT *, bin - row_number() OVER (PARTITION BY stream_id, segment_id, z > 2 ORDER BY bin) AS g FROM zz),
    best AS (SELECT stream_id, segment_id, max(c) AS exc_run FROM (SELECT stream_id, segment_id, g, count(*) AS c FROM runs WHERE z > 2 GROUP BY ALL) GROUP BY ALL)
    SELECT stream_id, segment_id, {rd("max(z)", 4)} AS exc_max, {rd("avg(z)", 4)} AS exc_mean,
      {rd("sum(greatest(z, 0))", 4)} AS exc_pos_integral, CAST(arg_max(bin, (z, -bin)) AS BIGINT) AS exc_argmax,
      coalesce(any_value(exc_run), 0) AS exc_run, count(*) FILTER (z > 2) AS exc_n_above2, {rd("sqrt(avg(z * z))", 4)} AS exc_l2,
      {rd("avg(z) FILTER (bin >= 6 AND bin < 16)", 4)} AS exc_mid_mean
    FROM zz LEFT JOIN best USING (stream_id, segment_id) GROUP BY ALL""",
)
def excess_features(spark, sf):
    e = cycles.excess(with_excess(spark, sf), KEYS)
    whole = ("exc_argmax", "exc_run", "exc_n_above2")
    return e.select(*KEYS, *[c if c in whole else rounded(c, 4).alias(c) for c in e.columns if c not in KEYS])


@query(
    "profile_wide",
    f"WITH {SEG}, {DIRECTION}, {PROFILE} SELECT stream_id, segment_id, "
    + ", ".join(f"{rd(f'max({a}) FILTER (bin = {i})', 4)} AS {p}_{i}" for a, p in (("v", "prof"), ("z", "z")) for i in range(20))
    + " FROM zz GROUP BY ALL",
)
def profile_wide(spark, sf):
    w = cycles.profile_wide(with_excess(spark, sf), KEYS)
    return w.select(*KEYS, *[rounded(c, 4).alias(c) for c in w.columns if c not in KEYS])


@query(
    "outside_rows",
    f"""WITH {SEG}, b AS (SELECT stream_id, segment_id, min(t) AS s, max(t) AS e FROM seg GROUP BY ALL HAVING avg(current) > 50)
    SELECT stream_id, seq, t FROM ev WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.stream_id = ev.stream_id AND ev.t BETWEEN s AND e)""",
)
def outside_rows(spark, sf):
    """Rows that lie in no labelled (here: high-current) cycle."""
    s, _ = segments(spark, sf)
    spans = s.groupBy(*KEYS).agg(F.min("t").alias("start_us"), F.max("t").alias("end_us"), F.avg("current").alias("m")).where("m > 50")
    rows = event_stream(spark, sf).select("stream_id", "seq", "t")
    return outside_intervals(rows, spans, ["stream_id"], "t", "start_us", "end_us")
