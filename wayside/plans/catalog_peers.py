"""Queries that compare cars of one train with each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayside.functions.columns import DAY_US, is_cooling, is_full_cooling, rounded
from wayside.operators import decide as choose, peers, scores
from wayside.operators.ordered import Order
from wayside.plans.inputs import EV, event_stream
from wayside.plans.registry import query, rd
from wayside.session import cut, table
from wayside.sources import telemetry

CAR = Order(("case_id", "car"), "t", ("seq",))
MODES = {"click": "Cooling", "view": "Full cooling", "purchase": "Cool stop", "signup": "Heating", "error": "cooling half"}

ACV = EV + f""", acv0 AS (SELECT stream_id // 8 AS case_id, lpad(CAST(stream_id % 8 + 1 AS VARCHAR), 2, '0') AS car, t // {DAY_US} AS ts, t, seq,
  CASE WHEN CAST(pos AS INTEGER) % 10 = 3 THEN ' Invalid' ELSE 'valid' END AS info_valid,
  CASE mode {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in MODES.items())} END AS mode_run, current - 5 AS raw, pos AS out_raw,
  20 + pos / 9 AS set_raw, bemf - 30 AS ph1, voltage / 3 - 40 AS ph2 FROM ev),
acv AS (SELECT *, CASE WHEN raw > 0 AND info_valid = 'valid' THEN raw END AS t_in, CASE WHEN out_raw > 0 AND info_valid = 'valid' THEN out_raw END AS t_out,
  CASE WHEN info_valid = 'valid' THEN set_raw END AS t_set_cool, CASE WHEN ph1 > 0 THEN ph1 END AS p_high_1, CASE WHEN ph2 > 0 THEN ph2 END AS p_high_2,
  lower(mode_run) LIKE '%cool%' AND NOT lower(mode_run) LIKE '%stop%' AS cooling,
  CASE WHEN lower(mode_run) LIKE '%full cool%' THEN 1e0 ELSE 0e0 END AS full_cool FROM acv0),
prep AS (SELECT *, t_in - t_set_cool AS set_err, lead(t_in, 10) OVER (PARTITION BY case_id, car ORDER BY t, seq) - t_in AS dt10 FROM acv),
pm AS (SELECT case_id, ts, median(t_in) AS med, count(*) AS cnt, max(t_in) AS mx FROM prep WHERE cooling AND t_in IS NOT NULL GROUP BY ALL),
q1 AS (SELECT case_id, ts, median(p_high_1) AS m1, median(p_high_2) AS m2 FROM prep GROUP BY ALL),
dev AS (SELECT prep.*, CASE WHEN cooling AND cnt >= 3 THEN t_in - med END AS peer_dev, CASE WHEN cooling THEN t_in - med END AS any_dev, cnt, mx,
  m1 - p_high_1 AS def1, m2 - p_high_2 AS def2 FROM prep LEFT JOIN pm USING (case_id, ts) LEFT JOIN q1 USING (case_id, ts))"""


def readings(spark, sf):
    """Streams as cars (eight to a case), days as moments."""
    e = event_stream(spark, sf)
    mode = F.create_map(*[F.lit(x) for pair in MODES.items() for x in pair])
    raw = e.select(
        F.floor(F.col("stream_id") / 8).alias("case_id"),
        F.lpad((F.col("stream_id") % 8 + 1).cast("string"), 2, "0").alias("car"),
        F.floor(F.col("t") / F.lit(DAY_US)).alias("ts"), "t", "seq",
        F.when(F.col("pos").cast("int") % 10 == 3, " Invalid").otherwise("valid").alias("info_valid"),
        mode[F.col("mode")].alias("mode_run"),
        (F.col("current") - 5).alias("t_in"), F.col("pos").alias("t_out"), (20 + F.col("pos") / 9).alias("t_set_cool"),
        (F.col("bemf") - 30).alias("p_high_1"), (F.col("voltage") / 3 - 40).alias("p_high_2"),
    )
    return telemetry.clean(raw)


def prepared(spark, sf):
    rows = readings(spark, sf)
    return peers.prepare(rows, CAR.sampled(rows))


def deviated(spark, sf):
    return cut(peers.with_deviations(cut(prepared(spark, sf)), ["case_id", "ts"]))


@query("mask_invalid", f"WITH {ACV} SELECT seq, case_id, car, info_valid, {rd('t_in')} AS t_in, {rd('t_out')} AS t_out, {rd('t_set_cool')} AS t_set_cool, {rd('p_high_1')} AS p_high_1 FROM (SELECT * EXCLUDE (info_valid), trim(info_valid) AS info_valid FROM acv)")
def mask_invalid(spark, sf):
    r = readings(spark, sf)
    return r.select("seq", "case_id", "car", "info_valid", *[rounded(c).alias(c) for c in ("t_in", "t_out", "t_set_cool", "p_high_1")])


@query("mode_flags", f"WITH {ACV} SELECT seq, mode_run, cooling, full_cool, {rd('set_err')} AS set_err FROM prep")
def mode_flags(spark, sf):
    r = readings(spark, sf)
    return r.select(
        "seq", "mode_run", is_cooling("mode_run").alias("cooling"), is_full_cooling("mode_run").cast("double").alias("full_cool"),
        rounded(F.col("t_in") - F.col("t_set_cool")).alias("set_err"))


@query(
    "acv_melt",
    f"""WITH {EV}, w AS (SELECT stream_id // 8 AS case_id, t // {DAY_US} AS ts, lpad(CAST(stream_id % 8 + 1 AS VARCHAR), 2, '0') AS car,
      round(avg(current), 3) AS a, round(max(voltage) - 150, 3) AS b, min(mode) AS m FROM ev GROUP BY ALL),
    ids AS (SELECT DISTINCT case_id, ts FROM w), grid AS (SELECT case_id, ts, lpad(CAST(c AS VARCHAR), 2, '0') AS car FROM ids, range(1, 9) t(c))
    SELECT case_id, ts, car, CASE WHEN a > 0 THEN a END AS t_in, CASE WHEN b > 0 THEN b END AS t_set_cool, m AS mode_run FROM grid LEFT JOIN w USING (case_id, ts, car)""",
)
def acv_melt(spark, sf):
    """A wide table (one column per car and parameter) back to one row per car."""
    e = event_stream(spark, sf)
    cars = [f"{c:02d}" for c in range(1, 9)]
    car = F.lpad((F.col("stream_id") % 8 + 1).cast("string"), 2, "0")
    at = lambda c, v: F.when(car == c, F.col(v))
    wide = e.groupBy(F.floor(F.col("stream_id") / 8).alias("case_id"), F.floor(F.col("t") / F.lit(DAY_US)).alias("ts")).agg(
        *[x for c in cars for x in (
            F.round(F.avg(at(c, "current")), 3).alias(f"Car {c} - Indoor Temperature"),
            F.round(F.max(at(c, "voltage")) - 150, 3).alias(f"Car {c} - Control Temperature Cooling"),
            F.min(at(c, "mode")).alias(f"Car {c} - Running Mode"),
        )])
    return telemetry.melt(wide, ["case_id", "ts"])


PART_RULES = {
    "t_in": (("red", "widget"), ("small", "ring")), "t_out": (("blue",),), "mode": (("bolt",),), "pressure": (("large", "gear"), ("green", "nut")),
}


@query(
    "role_resolution",
    "WITH h AS (" + " UNION ALL ".join(
        f"SELECT '{role}' AS role, p_name, p_partkey FROM part WHERE " + " OR ".join("(" + " AND ".join(f"lower(p_name) LIKE '%{w}%'" for w in ws) + ")" for ws in sets)
        for role, sets in PART_RULES.items()
    ) + ") SELECT role, arg_min(p_name, p_partkey) AS p_name, min(p_partkey) AS p_partkey FROM h GROUP BY role",
)
def role_resolution(spark, sf):
    return telemetry.resolve_roles(table(spark, sf, "part"), "p_name", "p_partkey", PART_RULES)


@query("peer_deviation", f"WITH {ACV} SELECT seq, case_id, car, {rd('peer_dev')} AS peer_dev FROM dev")
def peer_deviation(spark, sf):
    d = peers.peer_deviation(prepared(spark, sf), ["case_id", "ts"], "t_in", F.col("cooling"), "peer_dev")
    return d.select("seq", "case_id", "car", rounded("peer_dev").alias("peer_dev"))


@query("peer_deficit", f"WITH {ACV} SELECT seq, case_id, car, {rd('def1')} AS p_high_1_def FROM dev")
def peer_deficit(spark, sf):
    d = peers.peer_deficit(readings(spark, sf), ["case_id", "ts"], "p_high_1", "p_high_1_def")
    return d.select("seq", "case_id", "car", rounded("p_high_1_def").alias("p_high_1_def"))


CAR_SQL = """cr AS (SELECT case_id, car, peer_dev > 1 AS hit, row_number() OVER (PARTITION BY case_id, car ORDER BY t, seq)
  - row_number() OVER (PARTITION BY case_id, car, coalesce(peer_dev > 1, false) ORDER BY t, seq) AS g FROM dev WHERE cooling),
pers AS (SELECT case_id, car, max(c) AS persist FROM (SELECT case_id, car, g, count(*) AS c FROM cr WHERE hit GROUP BY ALL) GROUP BY ALL),
feat AS (SELECT case_id, car, count(*) AS n, count(t_in) AS n_valid, avg(CASE WHEN cooling THEN 1e0 ELSE 0e0 END) AS cool_frac, avg(full_cool) AS full_cool_frac,
  avg(t_in) FILTER (cooling) AS t_in_mean, stddev_samp(t_in) FILTER (cooling) AS t_in_std, avg(peer_dev) AS peer_dev_mean,
  avg(CASE WHEN peer_dev > 1 THEN 1e0 ELSE 0e0 END) FILTER (cooling) AS peer_dev_pos_frac, avg(set_err) FILTER (cooling) AS set_err_mean,
  avg(CASE WHEN set_err > 1 THEN 1e0 ELSE 0e0 END) FILTER (cooling) AS set_err_pos_frac, avg(dt10) FILTER (cooling) AS dT_mean_cool,
  avg(CASE WHEN t_in IS NULL THEN 1e0 ELSE 0e0 END) AS invalid_frac, greatest(avg(def1) FILTER (cooling), avg(def2) FILTER (cooling)) AS p_high_def,
  quantile_cont(t_in, 95e-2) FILTER (cooling) AS t_in_p95, quantile_cont(peer_dev, 9e-1) AS peer_dev_p90, quantile_cont(set_err, 95e-2) FILTER (cooling) AS set_err_p95,
  quantile_cont(dt10, 9e-1) FILTER (cooling) AS dT_p90_cool FROM dev GROUP BY ALL),
car_f AS (SELECT feat.*, coalesce(persist, 0) AS peer_dev_persist FROM feat LEFT JOIN pers USING (case_id, car))"""
WHOLE = ("n", "n_valid", "peer_dev_persist")
FEATURES = ("cool_frac full_cool_frac t_in_mean t_in_std peer_dev_mean peer_dev_pos_frac set_err_mean set_err_pos_frac dT_mean_cool invalid_frac "
            "p_high_def t_in_p95 peer_dev_p90 set_err_p95 dT_p90_cool").split()


def features(spark, sf):
    rows = deviated(spark, sf)
    return peers.car_features(rows, ["case_id", "car"], CAR.sampled(rows))


@query("car_features", f"WITH {ACV}, {CAR_SQL} SELECT case_id, car, {', '.join(WHOLE)}, " + ", ".join(f"{rd(c)} AS {c}" for c in FEATURES) + " FROM car_f")
def car_features(spark, sf):
    return features(spark, sf).select("case_id", "car", *WHOLE, *[rounded(c).alias(c) for c in FEATURES])


@query(
    "robust_z",
    f"""WITH m AS (SELECT s_nationkey, median(s_acctbal) AS med FROM supplier GROUP BY ALL),
    d AS (SELECT s.*, med, abs(s_acctbal - med) AS dv FROM supplier s JOIN m USING (s_nationkey)),
    a AS (SELECT s_nationkey, median(dv) AS mad FROM d GROUP BY ALL)
    SELECT s_suppkey, s_nationkey, {rd("(s_acctbal - med) / (mad * 14826e-4 + 1e-6)", 4)} AS z FROM d JOIN a USING (s_nationkey)""",
)
def robust_z(spark, sf):
    z = peers.robust_z(table(spark, sf, "supplier"), ["s_nationkey"], "s_acctbal")
    return z.select("s_suppkey", "s_nationkey", rounded("z", 4).alias("z"))


WEIGHTS = {"peer_dev_mean": 1.0, "p_high_def": 1.0, "peer_dev_persist": 0.5}


def _z_sql(components):
    return ", ".join(f"""z_{c} AS (SELECT case_id, car, CASE WHEN k < 2 OR x IS NULL THEN 0e0 ELSE greatest(-5e0, least(5e0, (x - med) / (mad * 14826e-4 + 1e-6))) END AS {c}
      FROM (SELECT case_id, car, x, med, k, median(abs(x - med)) OVER (PARTITION BY case_id) AS mad FROM (SELECT case_id, car, CAST({c} AS DOUBLE) AS x,
        median({c}) OVER (PARTITION BY case_id) AS med, count({c}) OVER (PARTITION BY case_id) AS k FROM car_f)))""" for c in components)


@query(
    "rank_cars",
    f"""WITH {ACV}, {CAR_SQL}, {_z_sql(WEIGHTS)}, tot AS (SELECT case_id, car, CASE WHEN n_valid = 0 THEN -1e300 ELSE round(peer_dev_mean + p_high_def + peer_dev_persist * 5e-1, 9) END AS s
      FROM z_peer_dev_mean JOIN z_p_high_def USING (case_id, car) JOIN z_peer_dev_persist USING (case_id, car) JOIN (SELECT case_id, car, n_valid FROM car_f) USING (case_id, car))
    SELECT case_id, string_agg(car, '|' ORDER BY s DESC, car) AS ranked_cars FROM tot GROUP BY case_id""",
)
def rank_cars(spark, sf):
    f = cut(features(spark, sf))
    z = peers.component_z(f, "case_id", "car", list(WEIGHTS)).join(f.select("case_id", "car", "n_valid"), ["case_id", "car"])
    scored = z.withColumn("score", F.round(peers.weighted_score(z, WEIGHTS, "n_valid"), 9))
    return peers.rank_units(scored, "case_id", "car", "score")


def _scorer(name, fn, sql):
    @query(name, f"WITH {ACV}, s AS ({sql}) SELECT case_id, car, {rd('score')} AS score FROM s")
    def run(spark, sf):
        return fn(cut(prepared(spark, sf)), "case_id").select("case_id", "car", rounded("score").alias("score"))

    run.__name__ = name
    run.__doc__ = fn.__doc__
    return run


_scorer("scorer_setpoint", peers.setpoint_adjusted, """SELECT case_id, car, avg(set_err - m) AS score FROM prep JOIN (SELECT case_id, ts, median(set_err) AS m, count(*) AS c FROM prep
  WHERE cooling AND set_err IS NOT NULL GROUP BY ALL) USING (case_id, ts) WHERE cooling AND set_err IS NOT NULL AND c >= 3 GROUP BY case_id, car""")
_scorer("scorer_hot_only", peers.hot_weather, """SELECT case_id, car, avg(t_in - m) AS score FROM (SELECT *, median(t_in) OVER (PARTITION BY case_id, ts) AS m, count(*) OVER (PARTITION BY case_id, ts) AS c
  FROM (SELECT *, median(t_out) OVER (PARTITION BY case_id) AS mid FROM prep) WHERE cooling AND t_in IS NOT NULL AND t_out >= mid) WHERE c >= 3 GROUP BY case_id, car""")
_scorer("scorer_trimmed", peers.trimmed, """SELECT case_id, car, avg(any_dev) FILTER (any_dev > lo AND any_dev < hi) AS score FROM dev JOIN (SELECT case_id, car, quantile_cont(any_dev, 1e-1) AS lo,
  quantile_cont(any_dev, 9e-1) AS hi FROM dev WHERE any_dev IS NOT NULL GROUP BY ALL) USING (case_id, car) WHERE any_dev IS NOT NULL GROUP BY case_id, car""")
_scorer("scorer_daily_max", peers.daily_maximum, f"""SELECT case_id, car, avg(m - mid) AS score FROM (SELECT *, median(m) OVER (PARTITION BY case_id, day) AS mid FROM
  (SELECT case_id, t // {DAY_US} AS day, car, max(t_in) AS m FROM prep WHERE cooling AND t_in IS NOT NULL GROUP BY ALL)) GROUP BY case_id, car""")
_scorer("scorer_hottest", peers.hottest_share, """SELECT case_id, car, avg(CASE WHEN t_in >= mx AND cnt >= 3 THEN 1e0 ELSE 0e0 END) AS score FROM dev
  WHERE cooling AND t_in IS NOT NULL GROUP BY case_id, car""")
_scorer("scorer_loo_median", peers.others_median, """SELECT a.case_id, a.car, avg(a.m - o.m) AS score FROM (SELECT case_id, ts, car, avg(t_in) AS m FROM prep WHERE cooling AND t_in IS NOT NULL GROUP BY ALL) a LEFT JOIN
  (SELECT x.case_id, x.ts, x.car, median(y.m) AS m FROM (SELECT DISTINCT case_id, ts, car FROM prep WHERE cooling AND t_in IS NOT NULL) x JOIN
    (SELECT case_id, ts, car, avg(t_in) AS m FROM prep WHERE cooling AND t_in IS NOT NULL GROUP BY ALL) y ON x.case_id = y.case_id AND x.ts = y.ts AND x.car <> y.car GROUP BY ALL) o
  ON a.case_id = o.case_id AND a.ts = o.ts AND a.car = o.car GROUP BY a.case_id, a.car""")
_scorer("scorer_borda", peers.borda, """SELECT case_id, car, avg(v) AS score FROM (UNPIVOT (SELECT case_id, car,
    """ + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY case_id, {c} IS NOT NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY case_id, {c} IS NOT NULL, {c}) - 1) / 2e0 END AS r_{c}" for c in ("dv", "p90", "se", "dt")) + """
  FROM (SELECT case_id, car, avg(peer_dev) AS dv, quantile_cont(any_dev, 9e-1) AS p90, avg(set_err) AS se, -avg(dt10) AS dt FROM dev WHERE cooling GROUP BY ALL)) ON r_dv, r_p90, r_se, r_dt INTO NAME k VALUE v) GROUP BY case_id, car""")
_scorer("scorer_mode_combo", peers.mode_combination, """SELECT case_id, car, (dv - md) / (median(abs(dv - md)) OVER w * 14826e-4 + 1e-6) + 5e-1 * (fc - mf) / (median(abs(fc - mf)) OVER w * 14826e-4 + 1e-6) AS score FROM
  (SELECT *, median(dv) OVER w AS md, median(fc) OVER w AS mf FROM (SELECT case_id, car, avg(peer_dev) AS dv, avg(full_cool) AS fc FROM dev GROUP BY ALL) WINDOW w AS (PARTITION BY case_id)) WINDOW w AS (PARTITION BY case_id)""")

POWER = ("cool_frac", "t_in_mean", "t_in_p95", "peer_dev_mean", "set_err_mean", "dT_mean_cool", "p_high_def")
TRUTH = "lpad(CAST(case_id % 8 + 1 AS VARCHAR), 2, '0')"


def _truth(f):
    return f.select("case_id", F.lpad((F.col("case_id") % 8 + 1).cast("string"), 2, "0").alias("car")).distinct()


@query(
    "feature_rank_power",
    f"WITH {ACV}, {CAR_SQL}, p AS (" + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, case_id, car, row_number() OVER (PARTITION BY case_id ORDER BY coalesce(round({c}, 9), lo - 1) DESC NULLS LAST, car) AS r, count(*) OVER (PARTITION BY case_id) AS n
        FROM (SELECT case_id, car, {c}, min(round({c}, 9)) OVER (PARTITION BY case_id) AS lo FROM car_f)""" for c in POWER) + f""")
    SELECT feature, {rd("avg((n - (r - 1)) / CAST(n AS DOUBLE))")} AS mean_score, count(*) AS cases FROM p WHERE car = {TRUTH} GROUP BY feature""",
)
def feature_rank_power(spark, sf):
    f = cut(features(spark, sf)).select("case_id", "car", *[F.round(c, 9).alias(c) for c in POWER])
    p = peers.ranking_power(f, _truth(f), "case_id", POWER)
    return p.select("feature", rounded("mean_score").alias("mean_score"), "cases")


@query(
    "rank_decay",
    f"""WITH {ACV}, r AS (SELECT case_id, string_agg(car, '|' ORDER BY s DESC, car) AS ranked, count(*) AS n FROM
      (SELECT case_id, car, round(coalesce(avg(t_in), -1), 9) AS s FROM acv GROUP BY ALL) GROUP BY case_id)
    SELECT case_id, {TRUTH} AS true_car, {rd(f"CASE WHEN list_contains(string_split(ranked, '|'), {TRUTH}) THEN (n - (list_position(string_split(ranked, '|'), {TRUTH}) - 1)) / CAST(n AS DOUBLE) ELSE 0 END")} AS score FROM r""",
)
def rank_decay(spark, sf):
    per = readings(spark, sf).groupBy("case_id", "car").agg(F.round(F.coalesce(F.avg("t_in"), F.lit(-1.0)), 9).alias("s"))
    ranked = peers.rank_units(per, "case_id", "car", "s")
    true = F.lpad((F.col("case_id") % 8 + 1).cast("string"), 2, "0")
    return ranked.select("case_id", true.alias("true_car"), rounded(scores.rank_decay("ranked_cars", true)).alias("score"))


COMPONENTS = ("peer_dev_mean", "p_high_def", "set_err_p95")
LEVELS = "CASE {x} WHEN 0 THEN 0e0 WHEN 1 THEN 5e-1 ELSE 1e0 END"


@query(
    "nested_loo_weights",
    f"""WITH {ACV}, {CAR_SQL}, {_z_sql(COMPONENTS)}, g AS (SELECT c AS combo, {LEVELS.format(x='c // 9')} AS w1, {LEVELS.format(x='(c // 3) % 3')} AS w2, {LEVELS.format(x='c % 3')} AS w3 FROM range(1, 27) t(c)),
    z AS (SELECT case_id, car, n_valid, peer_dev_mean AS a, p_high_def AS b, set_err_p95 AS c FROM z_peer_dev_mean JOIN z_p_high_def USING (case_id, car) JOIN z_set_err_p95 USING (case_id, car)
      JOIN (SELECT case_id, car, n_valid FROM car_f) USING (case_id, car)),
    s AS (SELECT case_id, car, combo, CAST(w1 > 0 AS INTEGER) + CAST(w2 > 0 AS INTEGER) + CAST(w3 > 0 AS INTEGER) AS nz, CASE WHEN n_valid = 0 THEN -1e300 ELSE round(a * w1 + b * w2 + c * w3, 9) END AS t FROM z, g),
    r AS (SELECT *, row_number() OVER (PARTITION BY case_id, combo ORDER BY t DESC, car) AS r, count(*) OVER (PARTITION BY case_id, combo) AS n FROM s),
    u AS (SELECT case_id, combo, nz, coalesce(max((n - (r - 1)) / CAST(n AS DOUBLE)) FILTER (car = {TRUTH}), 0) AS score FROM r GROUP BY ALL),
    o AS (SELECT *, round((sum(score) OVER (PARTITION BY combo) - score) / (count(*) OVER (PARTITION BY combo) - 1), 9) AS others FROM u),
    b AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY others DESC, nz, combo) AS k FROM o)
    SELECT case_id AS held, CAST(combo AS INTEGER) AS combo, {rd("score")} AS score, {rd("others")} AS others_mean FROM b WHERE k = 1""",
)
def nested_loo_weights(spark, sf):
    """Weights of three components on the grid {0, ½, 1}, chosen on all other cases and scored on the held-out one."""
    f = cut(features(spark, sf))
    z = peers.component_z(f, "case_id", "car", COMPONENTS).join(f.select("case_id", "car", "n_valid"), ["case_id", "car"])
    tried = z.select("*", F.explode(F.sequence(F.lit(1), F.lit(26))).alias("combo"))
    w = [(F.floor(F.col("combo") / d) % 3) / 2 for d in (9, 3, 1)]
    total = sum((F.col(c) * x for c, x in zip(COMPONENTS, w)), F.lit(0.0))
    nonzero = sum((F.when(x > 0, 1).otherwise(0) for x in w), F.lit(0))
    scored = tried.select("case_id", "car", "combo", nonzero.alias("nonzero"),
                          F.when(F.col("n_valid") == 0, F.lit(float("-inf"))).otherwise(F.round(total, 9)).alias("s"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), F.col("car").alias("c"))))
    ranked = scored.groupBy("case_id", "combo", "nonzero").agg(F.array_join(F.transform(order, lambda x: x.c), "|").alias("ranked_cars"))
    true = F.lpad((F.col("case_id") % 8 + 1).cast("string"), 2, "0")
    per_case = ranked.select(F.col("case_id").alias("case"), "combo", "nonzero", scores.rank_decay("ranked_cars", true).alias("score"))
    best = choose.nested_leave_one_out(cut(per_case))
    return best.select("held", "combo", rounded("score").alias("score"), rounded("others_mean").alias("others_mean"))


@query(
    "peer_bands",
    f"""WITH {EV}, i AS (SELECT stream_id, mode, avg(current) AS value FROM ev GROUP BY ALL),
    s AS (SELECT mode, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd FROM i GROUP BY ALL)
    SELECT stream_id, mode, {rd("value")} AS value, n, {rd("mean")} AS mean, {rd("CASE WHEN n >= 3 THEN mean - 2 * sd END")} AS low, {rd("CASE WHEN n >= 3 THEN mean + 2 * sd END")} AS high,
      n >= 3 AND abs(value - mean) > 2 * sd + 1e-12 AS unusual, {rd("CASE WHEN n >= 3 THEN 100 * (value - mean) / sd END", 4)} AS deviation_pct FROM i JOIN s USING (mode)""",
)
def peer_bands(spark, sf):
    i = event_stream(spark, sf).groupBy("stream_id", "mode").agg(F.avg("current").alias("value"))
    b = peers.bands(i, ["mode"], "value")
    return b.select("stream_id", "mode", "n", "unusual", *[rounded(c).alias(c) for c in ("value", "mean", "low", "high")], rounded("deviation_pct", 4).alias("deviation_pct"))
