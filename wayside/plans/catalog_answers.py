"""End-to-end answers of the four systems, and the evidence shown beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayside.functions.columns import rounded
from wayside.operators import cycles, fatigue, history, models, rail, spectral
from wayside.operators.ordered import positions
from wayside.plans import subsystems
from wayside.plans.catalog_fatigue import CYC
from wayside.plans.catalog_models import _RF, _ridge_sql
from wayside.plans.catalog_peers import ACV, CAR_SQL, TRUTH, _z_sql, deviated, features, readings
from wayside.plans.catalog_rail import (
    AGG, CH, DOM, EX, LAM, PAIR, PSD, REF, UNIT, _NAMES, _SQL, excessive, geometry, psd, speeds,
)
from wayside.plans.catalog_stream import DIRECTION, ELECTRICAL, KEYS, NUMERIC, PHASE, PHASES, PROFILE, segmented, streamed
from wayside.plans.inputs import SEG, VEC, event_stream, samples
from wayside.plans.registry import query, rd
from wayside.session import cut

# --- doors ----------------------------------------------------------------------------------------

MOVING = "vel_mean vel_max vel_min_mid cur_above_bemf_slope".split()
EXCESS = {
    "exc_max": "max(z)", "exc_mean": "avg(z)", "exc_pos_integral": "sum(greatest(z, 0))", "exc_l2": "sqrt(avg(z * z))",
    "exc_mid_mean": "avg(z) FILTER (bin >= 6 AND bin < 16)",
}
COUNTED = ["n_rows", "start_us", "end_us", "stall_rows", "exc_argmax", "exc_run", "exc_n_above2"]
DOOR = [*NUMERIC, *PHASES, *MOVING]


@query(
    "door_table",
    f"""WITH {SEG}, {DIRECTION}, {PROFILE}, {ELECTRICAL}, {PHASE.format(keys='stream_id, segment_id', source='(SELECT *, current AS x FROM segp)')},
    bd AS (SELECT stream_id, segment_id, min(t) AS start_us, max(t) AS end_us FROM seg GROUP BY ALL),
    vv AS (SELECT stream_id, segment_id, avg(v) AS vel_mean, max(v) AS vel_max, min(v) FILTER (i >= floor(2e-1 * n) AND i < floor(8e-1 * n)) AS vel_min_mid,
      count(*) FILTER (v = 0 AND current > 200) AS stall_rows FROM (SELECT *, abs(pos - coalesce(lag(pos) OVER (PARTITION BY stream_id, segment_id ORDER BY t, seq), pos)) AS v FROM segp) GROUP BY ALL),
    sl AS (SELECT stream_id, segment_id, CASE WHEN count(*) > 2 THEN regr_slope(current, bemf) ELSE 0 END AS cur_above_bemf_slope FROM segp WHERE i < greatest(1, floor(9e-1 * n)) GROUP BY ALL),
    runs AS (SELECT *, bin - row_number() OVER (PARTITION BY stream_id, segment_id, z > 2 ORDER BY bin) AS g FROM zz),
    best AS (SELECT stream_id, segment_id, max(c) AS exc_run FROM (SELECT stream_id, segment_id, g, count(*) AS c FROM runs WHERE z > 2 GROUP BY ALL) GROUP BY ALL),
    ex AS (SELECT stream_id, segment_id, {', '.join(f'{e} AS {n}' for n, e in EXCESS.items())}, CAST(arg_max(bin, (z, -bin)) AS BIGINT) AS exc_argmax,
      coalesce(any_value(exc_run), 0) AS exc_run, count(*) FILTER (z > 2) AS exc_n_above2,
      {', '.join(f'max({a}) FILTER (bin = {i}) AS {p}_{i}' for a, p in (('v', 'prof'), ('z', 'z')) for i in range(20))} FROM zz LEFT JOIN best USING (stream_id, segment_id) GROUP BY ALL)
    SELECT stream_id, segment_id, operation, {', '.join(COUNTED)}, {', '.join(f'{rd(c)} AS {c}' for c in DOOR)}, {', '.join(f'{rd(c, 4)} AS {c}' for c in EXCESS)},
      {', '.join(f'{rd(f"{p}_{i}", 4)} AS {p}_{i}' for p in ('prof', 'z') for i in range(20))}
    FROM el JOIN ph USING (stream_id, segment_id) JOIN vv USING (stream_id, segment_id) JOIN sl USING (stream_id, segment_id) JOIN ex USING (stream_id, segment_id)
      JOIN bd USING (stream_id, segment_id) JOIN (SELECT stream_id, segment_id, operation FROM dir) USING (stream_id, segment_id)""",
)
def door_table(spark, sf):
    """Every feature of every door cycle: what the door model is given."""
    s, order = segmented(spark, sf)
    table = cut(subsystems.door_table(s, order))
    reference = cycles.reference_profile(table, F.col("cur_mean") <= 50)
    full = subsystems.door_features(table, cut(reference))
    profile = [f"{p}_{i}" for p in ("prof", "z") for i in range(20)]
    return full.select(
        *KEYS, "operation", *COUNTED, *[rounded(c).alias(c) for c in DOOR], *[rounded(c, 4).alias(c) for c in (*EXCESS, *profile)])


# --- air conditioning -----------------------------------------------------------------------------


@query(
    "car_ranking",
    f"""WITH {ACV}, {CAR_SQL}, {_z_sql(list(subsystems.CAR_WEIGHTS))}, tot AS (SELECT case_id, car, CASE WHEN n_valid = 0 THEN -1e300 ELSE peer_dev_mean + p_high_def END AS s
      FROM z_peer_dev_mean JOIN z_p_high_def USING (case_id, car) JOIN (SELECT case_id, car, n_valid FROM car_f) USING (case_id, car))
    SELECT case_id AS file_id, string_agg(car, '|' ORDER BY round(s, 9) DESC, car) AS ranked_cars FROM tot GROUP BY case_id""",
)
def car_ranking(spark, sf):
    """Cars of every case by how likely they leak, from raw readings to the ranked list."""
    return subsystems.rank_cars(readings(spark, sf), ties=("seq",))


CAR_FIT = f"""tr AS (SELECT * FROM prep WHERE cooling AND car <> {TRUTH} AND dt10 IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in _RF)}), {_ridge_sql('tr', _RF, 'dt10')},
    rm AS (SELECT case_id, car, avg(CASE WHEN cooling THEN dt10 - (m{len(_RF)} + {' + '.join(f'w{i} * (coalesce({c}, m{i}) - m{i})' for i, c in enumerate(_RF))}) END) AS resid_mean FROM prep, fit GROUP BY ALL)"""


def _shown_sql(metrics, ident: str, group: str, digits: int = 5) -> str:
    """Rows of evidence from relation ``f``, with the bands of each metric within ``group``."""
    parts = " UNION ALL ".join(
        f"SELECT {ident}, '{k}' AS key, '{label}' AS label, CAST({k} AS DOUBLE) AS value, '{unit}' AS unit FROM f" for k, label, unit in metrics)
    by = f"PARTITION BY {group + ', ' if group else ''}key"
    return f"""it AS ({parts}), bn AS (SELECT *, count(value) OVER ({by}) AS n, avg(value) OVER ({by}) AS mean, stddev_pop(value) OVER ({by}) AS sd FROM it)
    SELECT {ident}, key, label, unit, n, {rd('value', digits)} AS value, {rd('mean', digits)} AS mean, {rd('CASE WHEN n >= 3 THEN mean - 2 * sd END', digits)} AS low,
      {rd('CASE WHEN n >= 3 THEN mean + 2 * sd END', digits)} AS high, coalesce(n >= 3 AND abs(value - mean) > 2 * sd + 1e-12, false) AS unusual FROM bn"""


def _shown(table, ident, metrics, group, digits: int = 5):
    rows = history.compared(history.evidence(table, ident, metrics), ident, group)
    return rows.select(*ident, "key", "label", "unit", "n", "unusual", *[rounded(c, digits).alias(c) for c in ("value", "mean", "low", "high")])


@query(
    "evidence_cars",
    f"""WITH {ACV}, {CAR_SQL}, {CAR_FIT}, pr AS (SELECT case_id, car, avg(p_high_1) AS p_high_1, avg(p_high_2) AS p_high_2 FROM prep GROUP BY ALL),
    f AS (SELECT * FROM car_f JOIN rm USING (case_id, car) JOIN pr USING (case_id, car)), {_shown_sql(history.CAR_EVIDENCE, 'case_id, car', 'case_id')}""",
)
def evidence_cars(spark, sf):
    """What is shown for every car, compared with the cars of its case."""
    keys = ["case_id", "car"]
    rows = deviated(spark, sf)
    faulty = F.lpad((F.col("case_id") % 8 + 1).cast("string"), 2, "0")
    model = models.fit_ridge(rows.where(F.col("cooling") & (F.col("car") != faulty)), models.RESPONSE_FEATURES, "dT_10")
    more = models.response_residual(rows, model).groupBy(*keys).agg(
        F.avg("resid").alias("resid_mean"), F.avg("p_high_1").alias("p_high_1"), F.avg("p_high_2").alias("p_high_2"))
    return _shown(features(spark, sf).join(more, keys), keys, history.CAR_EVIDENCE, ["case_id"])


# --- rail -----------------------------------------------------------------------------------------

LED = ("car_diff_mean car_diff_std car_diff_max car_diff_min car_diff_pos_frac car_dom_count car_ratio_mean car_ratio_max "
       "car_shock_diff_mean car_shock_diff_max speednorm_rms").split()
KINDS = {"mean": "avg(g)", "median": "median(g)", "p90": "quantile_cont(g, 9e-1)", "max": "max(g)", "std": "stddev_pop(g)",
         "positive_frac": "count(*) FILTER (g > 0) / CAST(count(g) AS DOUBLE)"}
PAIRED = [f"pair_{f}_{kind}" for f in PAIR for kind in KINDS]
SIDED = [*_NAMES, "agree", "carmax_top1", "carmax_top2", *PAIRED, *[f"pair_{c}" for c in LED]]
RATIOS = [f"{f}_{s}" for f in ("rms", "kurt") for s in ("mean", "max")]


@query(
    "rail_side_table",
    f"""WITH {VEC}, {PSD}, {LAM}, {DOM}, {'c1 AS' + CH.split('c1 AS', 1)[1]}, {REF}, {EX}, w AS ({_SQL}),
    v1 AS ({' UNION ALL '.join(f"SELECT rec, {s} AS side, " + ', '.join(f's{s}_{n} AS {n}' for n in _NAMES) + ' FROM w' for s in (1, 2))}),
    am AS (SELECT *, median(dom_lambda) OVER (PARTITION BY rec, side) AS md FROM dom),
    ag AS (SELECT rec, side, CASE WHEN count(*) > 2 THEN avg(CASE WHEN dom_lambda > 9e-1 * md AND dom_lambda < 11e-1 * md THEN 1e0 ELSE 0e0 END) END AS agree FROM am GROUP BY rec, side),
    ct AS (SELECT rec, side, max(m) AS carmax_top1, avg(m) AS carmax_top2 FROM (SELECT *, row_number() OVER (PARTITION BY rec, side ORDER BY m DESC) AS r FROM
      (SELECT rec, side, car, max(ex_log_rms) AS m FROM ex GROUP BY ALL)) WHERE r <= 2 GROUP BY rec, side),
    pr AS (SELECT a.rec, {', '.join(f'a.{f} - b.{f} AS {f}' for f in PAIR)} FROM ch a JOIN ch b ON a.rec = b.rec AND a.k + 1 = b.k AND a.side = 1),
    pg AS ({' UNION ALL '.join(f"SELECT rec, {s} AS side, '{f}' AS feature, {f} * {sign} AS g FROM pr" for f in PAIR for s, sign in ((1, 1), (2, -1)))}),
    ps AS (SELECT rec, side, {', '.join(f'max({kind}) FILTER (feature = {chr(39)}{f}{chr(39)}) AS pair_{f}_{kind}' for f in PAIR for kind in KINDS)}
      FROM (SELECT rec, side, feature, {', '.join(f'{e} AS {kind}' for kind, e in KINDS.items())} FROM pg GROUP BY ALL) GROUP BY rec, side),
    cc AS (SELECT rec, car, any_value(speed) AS speed, avg(rms) FILTER (side = 1) AS r1, avg(rms) FILTER (side = 2) AS r2, avg(shock_rms) FILTER (side = 1) AS h1, avg(shock_rms) FILTER (side = 2) AS h2 FROM ch GROUP BY rec, car),
    cv AS (SELECT rec, 1 AS side, speed, r1 - r2 AS d, r1 / (r2 + 1e-9) AS q, h1 - h2 AS sd, r1 AS own FROM cc UNION ALL SELECT rec, 2, speed, r2 - r1, r2 / (r1 + 1e-9), h2 - h1, r2 FROM cc),
    cd AS (SELECT rec, side, avg(d) AS pair_car_diff_mean, stddev_pop(d) AS pair_car_diff_std, max(d) AS pair_car_diff_max, min(d) AS pair_car_diff_min, avg(CASE WHEN d > 0 THEN 1e0 ELSE 0e0 END) AS pair_car_diff_pos_frac,
      count(*) FILTER (d > 4e-2) AS pair_car_dom_count, avg(q) AS pair_car_ratio_mean, max(q) AS pair_car_ratio_max, avg(sd) AS pair_car_shock_diff_mean, max(sd) AS pair_car_shock_diff_max,
      avg(own) / (any_value(speed) + 1) AS pair_speednorm_rms FROM cv GROUP BY rec, side),
    al AS (SELECT * FROM v1 LEFT JOIN ag USING (rec, side) LEFT JOIN ct USING (rec, side) LEFT JOIN ps USING (rec, side) LEFT JOIN cd USING (rec, side))
    SELECT a.rec, CAST(a.side AS INTEGER) AS side, {', '.join(f"{rd(f'CAST(a.{n} AS DOUBLE)')} AS own_{n}, {rd(f'CAST(a.{n} - b.{n} AS DOUBLE)')} AS rel_{n}" for n in SIDED)},
      {', '.join(f"{rd(f'(a.{n} - b.{n}) / (abs(a.{n}) + abs(b.{n}) + 1e-9)')} AS ratio_{n}" for n in RATIOS)} FROM al a JOIN al b ON a.rec = b.rec AND a.side <> b.side""",
)
def rail_side_table(spark, sf):
    """Everything known of both sides of every recording: what the rail model is given."""
    waves = spectral.dominant_wavelength(psd(spark, sf), ["rec", "k"], "speed").select("rec", "k", "dom_lambda")
    c = cut(excessive(spark, sf).join(waves, ["rec", "k"], "left"))
    rows = rail.side_table(c, UNIT, AGG, ["ex_log_rms"], PAIR, "ex_log_rms")
    return rows.select("rec", "side", *[rounded(F.col(x).cast("double")).alias(x) for x in rows.columns if x not in ("rec", "side")])


@query(
    "evidence_rail",
    f"""WITH {VEC}, {PSD}, {LAM}, {DOM}, {'c1 AS' + CH.split('c1 AS', 1)[1]},
    f AS (SELECT rec, any_value(speed) AS speed, {', '.join(f'avg({k}) FILTER (side = {s}) AS s{s}_{k}' for s in (1, 2) for k in ('rms', 'shock_rms', 'dom_lambda'))}
      FROM ch LEFT JOIN (SELECT rec, k, dom_lambda FROM dom) USING (rec, k) GROUP BY rec), {_shown_sql(history.RAIL_EVIDENCE, 'rec', '')}""",
)
def evidence_rail(spark, sf):
    """What is shown for every rail recording, compared with all recordings."""
    lines = psd(spark, sf)
    waves = spectral.dominant_wavelength(lines, ["rec", "k"], "speed").select("rec", "k", "dom_lambda")
    c = geometry(rail.channel_statistics(samples(spark, sf), ["rec", "k"])).join(waves, ["rec", "k"], "left").join(speeds(spark, sf), "rec")
    side = lambda k, s: F.avg(F.when(F.col("side") == s, F.col(k))).alias(f"s{s}_{k}")
    table = c.groupBy("rec").agg(F.max("speed").alias("speed"), *[side(k, s) for s in (1, 2) for k in ("rms", "shock_rms", "dom_lambda")])
    return _shown(table, ["rec"], history.RAIL_EVIDENCE, [])


# --- structural health ----------------------------------------------------------------------------

SCALE = 1e7


@query("damage_estimates", f"WITH RECURSIVE {CYC} SELECT stream_id AS file_id, {rd(f'sum(cnt * pow(range / 2, 5)) / {SCALE}')} AS prediction FROM cyc GROUP BY stream_id")
def damage_estimates(spark, sf):
    """Fatigue damage of every series, from raw samples to the estimate."""
    rows, order = streamed(spark, sf)
    placed = positions(rows, order, "i", "n").select(F.col("stream_id").alias("recording_id"), "i", F.col("current").alias("stress"))
    return subsystems.damage_estimates(cut(placed), SCALE).withColumn("prediction", rounded("prediction"))


@query(
    "evidence_stress",
    f"""WITH RECURSIVE {CYC}, cs AS (SELECT stream_id, sum(cnt * pow(range / 2, 5)) / {SCALE} AS damage, max(range) AS cycle_range, sum(cnt) AS cycles FROM cyc GROUP BY stream_id),
    f AS (SELECT stream_id, coalesce(any_value(damage), 0) AS damage, avg(current) AS mean, sqrt(avg(current * current)) AS rms, max(current) - min(current) AS range,
      coalesce(any_value(cycle_range), 0) AS cycle_range, coalesce(any_value(cycles), 0) AS cycles FROM ev LEFT JOIN cs USING (stream_id) GROUP BY stream_id),
    {_shown_sql(history.STRESS_EVIDENCE, 'stream_id', '')}""",
)
def evidence_stress(spark, sf):
    """What is shown for every stress series, compared with all series."""
    rows, order = streamed(spark, sf)
    counted = cut(fatigue.rainflow(rows, order, "current"))
    from_cycles = fatigue.damages(counted, ["stream_id"], {"damage": fatigue.Convention(5.0)}).join(
        counted.groupBy("stream_id").agg(F.max("range").alias("cycle_range"), F.sum("cnt").alias("cycles")), "stream_id")
    v = F.col("current")
    stats = event_stream(spark, sf).groupBy("stream_id").agg(
        F.avg(v).alias("mean"), F.sqrt(F.avg(v * v)).alias("rms"), (F.max(v) - F.min(v)).alias("range"))
    table = stats.join(from_cycles, "stream_id", "left").fillna(0.0, ["damage", "cycle_range", "cycles"])
    return _shown(table.withColumn("damage", F.col("damage") / SCALE), ["stream_id"], history.STRESS_EVIDENCE, [])
