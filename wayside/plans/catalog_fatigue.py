"""Queries on stress series: rainflow cycles, damage conventions, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayside.functions.columns import rounded
from wayside.operators import fatigue
from wayside.plans.catalog_stream import streamed
from wayside.plans.inputs import EV, LI, event_stream, recordings
from wayside.plans.registry import query, rd
from wayside.session import cut

BY = ["stream_id"]

def cycles_sql(source: str, key: str, order: str, value: str) -> str:
    """Turning points and rainflow cycles (relation cyc) of the series in ``source``, as recursive SQL."""
    pop = "abs(st[len(st) - 1] - st[len(st) - 2])"
    return f"""mv AS (SELECT * FROM (SELECT *, lag({value}) OVER (PARTITION BY {key} ORDER BY {order}) AS p FROM {source}) WHERE p IS NULL OR p <> {value}),
tp AS (SELECT {key}, {value} AS v, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS r FROM (
  SELECT *, lead({value}) OVER (PARTITION BY {key} ORDER BY {order}) AS nx FROM mv) WHERE p IS NULL OR nx IS NULL OR ({value} > p) <> (nx > {value})),
rfw AS (
  SELECT DISTINCT {key}, CAST(0 AS BIGINT) AS step, CAST(0 AS BIGINT) AS r, CAST([] AS DOUBLE[]) AS st, false AS closed, CAST(NULL AS DOUBLE) AS range, CAST(NULL AS DOUBLE) AS mean FROM tp
  UNION ALL
  SELECT g.{key}, g.step + 1, CASE WHEN can THEN g.r ELSE g.r + 1 END, CASE WHEN can THEN list_append(st[1:len(st) - 3], st[len(st)]) ELSE list_append(st, tp.v) END, can,
    CASE WHEN can THEN {pop} END, CASE WHEN can THEN (st[len(st) - 1] + st[len(st) - 2]) / 2 END
  FROM (SELECT *, len(st) >= 4 AND {pop} < abs(st[len(st) - 2] - st[len(st) - 3]) AND {pop} <= abs(st[len(st)] - st[len(st) - 1]) AS can FROM rfw) g
  LEFT JOIN tp ON tp.{key} = g.{key} AND tp.r = g.r + 1 WHERE can OR tp.v IS NOT NULL),
fin AS (SELECT {key}, arg_max(st, step) AS st FROM rfw GROUP BY {key}),
cyc AS (SELECT {key}, range, mean, 1e0 AS cnt FROM rfw WHERE closed
  UNION ALL SELECT {key}, abs(st[j + 1] - st[j]), (st[j + 1] + st[j]) / 2, 5e-1 FROM (SELECT {key}, st, unnest(range(1, len(st))) AS j FROM fin))"""


CYC = EV + ", " + cycles_sql("ev", "stream_id", "t, seq", "current")


def cycles(spark, sf):
    return fatigue.rainflow(*streamed(spark, sf), "current")


@query("rainflow_cycles", f"WITH RECURSIVE {CYC} SELECT stream_id, {rd('range')} AS range, {rd('mean')} AS mean, cnt FROM cyc")
def rainflow_cycles(spark, sf):
    return cycles(spark, sf).select("stream_id", rounded("range").alias("range"), rounded("mean").alias("mean"), "cnt")


def log_damage(df, digits=6):
    return df.select("stream_id", rounded(F.log1p("damage"), digits).alias("log_damage"))


AMP = "range / 2 / greatest(1 - mean / {su}e0, 1e-3)"


@query(
    "damage_sum",
    f"""WITH RECURSIVE {CYC}, w AS (SELECT *, max(range) OVER (PARTITION BY stream_id) / 16 AS w FROM cyc),
    b AS (SELECT *, CASE WHEN w > 0 THEN ceil(range / w - 1e-12) * w ELSE range END AS rb, {AMP.format(su=400)} AS ag FROM w)
    SELECT stream_id, {rd("ln(1 + sum(cnt * pow(range / 2, 5)))")} AS plain, {rd("ln(1 + sum(CASE WHEN cnt = 5e-1 THEN 1 ELSE cnt END * pow(range / 2, 5)))")} AS full_residue,
      {rd("ln(1 + sum(CASE WHEN cnt = 5e-1 THEN 0 ELSE cnt END * pow(range, 3)))")} AS dropped_range, {rd("ln(1 + sum(CASE WHEN ag < 20 THEN 0 ELSE cnt END * pow(ag, 4)))")} AS goodman_cutoff,
      {rd("ln(1 + sum(cnt * pow(rb / 2, 5)))")} AS binned FROM b GROUP BY stream_id""",
)
def damage_sum(spark, sf):
    """Five conventions of the damage sum side by side (natural log of 1 + S)."""
    c = cycles(spark, sf)
    of = fatigue.Convention
    forms = {
        "plain": of(5.0), "full_residue": of(5.0, half_weight=1.0), "dropped_range": of(3.0, half_weight=0.0, whole_range=True),
        "goodman_cutoff": of(4.0, strength=400.0, least=20.0), "binned": of(5.0, bins=16)}
    sums = fatigue.damages(c, BY, forms)
    return sums.select(*BY, *[rounded(F.log1p(name)).alias(name) for name in forms])


@query(
    "damage_bilinear",
    f"""WITH RECURSIVE {CYC} SELECT stream_id, {rd("ln(1 + sum(cnt * CASE WHEN range / 2 >= 8 THEN pow(range / 2, 5) ELSE pow(range / 2, 7) * pow(8e0, -2) END))")} AS log_damage FROM cyc GROUP BY stream_id""",
)
def damage_bilinear(spark, sf):
    return log_damage(fatigue.bilinear_damage(cycles(spark, sf), BY, 5.0, 7.0, 8.0))


@query(
    "damage_meanstress",
    f"""WITH RECURSIVE {CYC}, a AS (SELECT stream_id, cnt, range / 2 / greatest(1 - sign(mean) * pow(abs(mean) / 400, 2), 5e-2) AS a FROM cyc)
    SELECT stream_id, {rd("ln(1 + sum(cnt * pow(a, 5)))")} AS log_damage FROM a GROUP BY stream_id""",
)
def damage_meanstress(spark, sf):
    return log_damage(fatigue.mean_stress_damage(cycles(spark, sf), BY, 400.0, 2.0))


@query(
    "damage_bigresidue",
    f"""WITH RECURSIVE {CYC}, r AS (SELECT *, row_number() OVER (PARTITION BY stream_id, cnt ORDER BY range DESC) AS k FROM cyc)
    SELECT stream_id, {rd("ln(1 + sum(CASE WHEN cnt = 5e-1 AND k = 1 THEN 1 ELSE cnt END * pow(range / 2, 5)))")} AS log_damage FROM r GROUP BY stream_id""",
)
def damage_bigresidue(spark, sf):
    return log_damage(fatigue.closed_residue_damage(cycles(spark, sf), BY))


MATRIX = f"""cfg AS (SELECT m, residue, cutoff, goodman FROM (SELECT round(3e0 + r * 1e-1, 2) AS m FROM range(41) t(r)), (SELECT unnest(['half', 'full', 'drop']) AS residue),
  (SELECT unnest([0e0, 5e-1, 1e0, 2e0]) AS cutoff), (SELECT unnest([CAST(NULL AS DOUBLE), 100e0, 200e0, 400e0]) AS goodman)),
ca AS (SELECT stream_id, cnt, g AS goodman, range / 2 / CASE WHEN g IS NULL THEN 1 ELSE greatest(1 - mean / g, 1e-3) END AS a FROM cyc, (SELECT unnest([CAST(NULL AS DOUBLE), 100e0, 200e0, 400e0]) AS g)),
mat AS (SELECT stream_id, m, residue, cutoff, cfg.goodman, sum(CASE WHEN a < cutoff THEN 0 WHEN cnt = 5e-1 THEN CASE residue WHEN 'half' THEN 5e-1 WHEN 'full' THEN 1 ELSE 0 END ELSE cnt END * pow(a, m)) AS s
  FROM ca JOIN cfg ON cfg.goodman IS NOT DISTINCT FROM ca.goodman GROUP BY ALL)"""


@query("s_matrix", f"WITH RECURSIVE {CYC}, {MATRIX} SELECT stream_id, m, residue, cutoff, goodman, {rd('ln(1 + s)')} AS log_s FROM mat")
def s_matrix(spark, sf):
    m = fatigue.s_matrix(cycles(spark, sf), BY)
    return m.select("stream_id", "m", "residue", "cutoff", "goodman", rounded(F.log1p("s")).alias("log_s"))


LOAD = "ld AS (SELECT stream_id, 1 + sum(pow(current, 2)) / 1000 AS d, avg(pos) > 50 AS heavy FROM ev GROUP BY stream_id)"


def loads(spark, sf):
    """A stand-in for the measured damage of each series, and its load condition."""
    return event_stream(spark, sf).groupBy("stream_id").agg(
        (1 + F.sum(F.col("current") * F.col("current")) / 1000).alias("d"), (F.avg("pos") > 50).alias("heavy"))


@query(
    "select_config",
    f"""WITH RECURSIVE {CYC}, {MATRIX}, {LOAD}, pos AS (SELECT mat.* FROM mat WHERE s > 0), r AS (SELECT pos.*, d, s / d AS r FROM pos JOIN ld USING (stream_id)),
    cw AS (SELECT *, sum(r) OVER (PARTITION BY m, residue, cutoff, goodman ORDER BY r, stream_id) AS c, sum(r) OVER (PARTITION BY m, residue, cutoff, goodman) / 2 AS h FROM r),
    sc AS (SELECT m, residue, cutoff, goodman, min(r) AS scale FROM cw WHERE c >= h * (1 - 1e-12) GROUP BY ALL),
    er AS (SELECT r.m, r.residue, r.cutoff, r.goodman, any_value(scale) AS scale, avg(abs(1 - s / (d * scale))) AS error, exp(avg(ln(s) - ln(d))) AS log_scale
      FROM r JOIN sc ON sc.m = r.m AND sc.residue = r.residue AND sc.cutoff = r.cutoff AND sc.goodman IS NOT DISTINCT FROM r.goodman GROUP BY ALL),
    el AS (SELECT *, CAST(residue <> 'half' AS INTEGER) + CAST(cutoff > 0 AS INTEGER) + CAST(goodman IS NOT NULL AS INTEGER) AS complexity, error <= min(error) OVER () + 2e-4 AS ok FROM er)
    SELECT m, residue, cutoff, goodman, complexity, {rd("ln(scale)")} AS scale, {rd("ln(log_scale)")} AS log_scale, {rd("error")} AS error,
      ok AND row_number() OVER (PARTITION BY ok ORDER BY complexity, abs(m - 5), round(error, 12), m, residue, cutoff, goodman NULLS FIRST) = 1 AS chosen FROM el""",
)
def select_config(spark, sf):
    """Scale and error of all 1,968 settings against the stand-in damage, and the one chosen."""
    known = cycles(spark, sf).join(loads(spark, sf).select("stream_id", "d"), "stream_id")
    m = fatigue.settings(cut(fatigue.damage_sums(known, [*BY, "d"])), [*BY, "d"]).where("s > 0")
    e = fatigue.select_setting(m, ["m", "residue", "cutoff", "goodman"], "s", "d")
    return e.select("m", "residue", "cutoff", "goodman", "complexity", "chosen", rounded(F.ln("scale")).alias("scale"),
                    rounded(F.ln("log_scale")).alias("log_scale"), rounded("error").alias("error"))


SERIES = "sd AS (SELECT rec, rec % 5 AS grp, sum(pow(x, 2)) AS s, 1 + sum(q) AS d FROM li GROUP BY rec)"


def series(spark, sf):
    r = recordings(spark, sf)
    return r.groupBy("rec").agg(F.sum(F.col("x") * F.col("x")).alias("s"), (1 + F.sum("q")).alias("d")).withColumn("grp", F.col("rec") % 5)


def _median_sql(weight: str) -> str:
    return f"""cw AS (SELECT grp, s / d AS r, sum({weight}) OVER (PARTITION BY grp ORDER BY s / d, rec) AS c, sum({weight}) OVER (PARTITION BY grp) / 2 AS h FROM sd)
    SELECT grp, {rd("min(r)", 4)} AS scale FROM cw WHERE c >= h * (1 - 1e-12) GROUP BY grp"""


@query("weighted_median", f"WITH {LI}, {SERIES}, {_median_sql('s / d')}")
def weighted_median(spark, sf):
    return fatigue.scale(series(spark, sf), ["grp"], "s", "d").withColumn("scale", rounded("scale", 4))


@query("weighted_median_inv", f"WITH {LI}, {SERIES}, {_median_sql('1 / d')}")
def weighted_median_inv(spark, sf):
    return fatigue.scale(series(spark, sf), ["grp"], "s", "d", weights="inverse").withColumn("scale", rounded("scale", 4))


@query(
    "grouped_scale",
    f"""WITH {LI}, {SERIES.replace('rec % 5 AS grp', 'CASE WHEN rec < 2 THEN 9 ELSE rec % 5 END AS grp')}, a AS (SELECT grp, rec, s / d AS r FROM sd),
    o AS (SELECT grp, r, sum(r) OVER (PARTITION BY grp ORDER BY r, rec) AS c, sum(r) OVER (PARTITION BY grp) / 2 AS h FROM a),
    p AS (SELECT r, sum(r) OVER (ORDER BY r, rec) AS c, sum(r) OVER () / 2 AS h FROM a)
    SELECT grp, n, {rd("CASE WHEN n >= 3 THEN own ELSE (SELECT min(r) FROM p WHERE c >= h * (1 - 1e-12)) END", 4)} AS scale
    FROM (SELECT grp, count(*) AS n FROM a GROUP BY ALL) JOIN (SELECT grp, min(r) AS own FROM o WHERE c >= h * (1 - 1e-12) GROUP BY ALL) USING (grp)""",
)
def grouped_scale(spark, sf):
    s = series(spark, sf).withColumn("grp", F.when(F.col("rec") < 2, 9).otherwise(F.col("grp")).cast("long"))
    return fatigue.grouped_scale(s, "grp", "s", "d").withColumn("scale", rounded("scale", 4))


STAT_SQL = {
    "mean": "avg(x)", "std": "stddev_pop(x)", "ptp": "max(x) - min(x)", "skewness": "avg(pow(x - mu, 3)) / pow(avg(pow(x - mu, 2)), 15e-1)",
    "kurtosis": "kurtosis_pop(x)", "crest_factor": "max(abs(x)) / (sqrt(avg(x * x)) + 1e-8)", "p01": "quantile_cont(x, 1e-2)",
    "p95_p05": "quantile_cont(x, 95e-2) - quantile_cont(x, 5e-2)", "p99_p01": "quantile_cont(x, 99e-2) - quantile_cont(x, 1e-2)",
}


@query(
    "series_stats",
    f"WITH {LI}, c AS (SELECT rec, x, avg(x) OVER (PARTITION BY rec) AS mu FROM li) SELECT rec, " + ", ".join(f"{rd(e)} AS {n}" for n, e in STAT_SQL.items()) + " FROM c GROUP BY rec",
)
def series_stats(spark, sf):
    s = fatigue.series_statistics(recordings(spark, sf), ["rec"], "x")
    return s.select("rec", *[rounded(c).alias(c) for c in STAT_SQL])


@query(
    "feature_corr",
    f"""WITH {LI}, f AS (SELECT rec, avg(x) AS mean, stddev_pop(x) AS std, max(x) AS mx, min(x) AS mn, avg(q) AS d FROM li GROUP BY rec)
    SELECT {rd("corr(mean, d)")} AS mean, {rd("corr(std, d)")} AS std, {rd("corr(mx, d)")} AS mx, {rd("corr(mn, d)")} AS mn FROM f""",
)
def feature_corr(spark, sf):
    """Correlation of series features with the target (mean quantity plays the damage)."""
    f = recordings(spark, sf).groupBy("rec").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.max("x").alias("mx"), F.min("x").alias("mn"), F.avg("q").alias("d"))
    return f.agg(*[rounded(F.corr(c, "d")).alias(c) for c in ("mean", "std", "mx", "mn")])
