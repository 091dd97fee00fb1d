"""Units compared with their peers at the same moment: deviations, per-car features, scores and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayside.functions.columns import is_cooling, is_full_cooling
from wayside.operators.ordered import Order, ahead_by, longest_run
from wayside.operators.quantiles import exact_medians, exact_quantiles, stacked
from wayside.session import cut

# How far above the peers counts as hot, smallest peer group, robust-z scale, clip and guard.
HOT_MARGIN, MIN_PEERS, HORIZON = 1.0, 3, 10
MAD_SCALE, Z_CLIP, MAD_GUARD = 1.4826, 5.0, 1e-6


def medians(df: DataFrame, keys: Sequence[str], value: str, name: str, bounded: bool) -> DataFrame:
    """Group medians. ``bounded`` groups (the cars of one train) take the built-in aggregate, others the distributed one."""
    if not bounded:
        return exact_medians(df, list(keys), value, name)
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.median(value).alias(name))


def prepare(rows: DataFrame, order: Order) -> DataFrame:
    """Operating state, set-point error and the change of the indoor temperature over the next ten rows."""
    has_mode = "mode_run" in rows.columns
    flagged = rows.withColumn("cooling", is_cooling("mode_run") if has_mode else F.lit(True)).withColumn(
        "full_cool", is_full_cooling("mode_run").cast("double") if has_mode else F.lit(0.0))
    err = F.col("t_in") - F.col("t_set_cool") if "t_set_cool" in rows.columns else F.lit(None).cast("double")
    later = ahead_by(flagged.withColumn("set_err", err), order, "t_in", HORIZON, "_later")
    return later.withColumn("dT_10", F.col("_later") - F.col("t_in")).drop("_later")


def peer_deviation(
    rows: DataFrame, moment: Sequence[str], value: str, among: Column, name: str, min_peers: int = MIN_PEERS
) -> DataFrame:
    """Value minus the median of the peers at the same moment (the unit itself included), NULL for rows outside
    ``among``, without a value, or with fewer than ``min_peers`` peers.

    A moment holds the cars of one train: a bounded group, so one aggregation and one join on the same keys.
    """
    keys = list(moment)
    part = rows.where(among & F.col(value).isNotNull())
    peers = part.groupBy(*keys).agg(F.median(value).alias("_med"), F.count(value).alias("_n"))
    joined = rows.join(peers, keys, "left")
    member = F.coalesce(among, F.lit(False)) & (F.col("_n") >= min_peers)
    return joined.withColumn(name, F.when(member, F.col(value) - F.col("_med"))).drop("_med", "_n")


def peer_deficit(rows: DataFrame, moment: Sequence[str], value: str, name: str) -> DataFrame:
    """Median of all units with a reading minus the value: positive where a unit lies below its peers."""
    return peer_deviation(rows, moment, value, F.lit(True), "_dev", 1).withColumn(name, -F.col("_dev")).drop("_dev")


def with_deviations(prepared: DataFrame, moment: Sequence[str]) -> DataFrame:
    d = peer_deviation(prepared, moment, "t_in", F.col("cooling"), "peer_dev")
    for p in ("p_high_1", "p_high_2"):
        if p in prepared.columns:
            d = peer_deficit(d, moment, p, f"{p}_def")
    return d


def car_features(d: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """Per-car aggregates of prepared rows with deviations. Quantiles are over a car's whole history: distributed.

    With a column ``resid`` (what the response model does not explain) its mean and 90 % quantile are added.
    """
    keys = list(keys)
    cool = F.col("cooling")
    on = lambda c: F.when(cool, F.col(c))
    hot_share = lambda c: F.avg(F.when(cool, F.coalesce((F.col(c) > HOT_MARGIN).cast("double"), F.lit(0.0))))
    stats = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("t_in").alias("n_valid"),
        F.avg(cool.cast("double")).alias("cool_frac"),
        F.avg("full_cool").alias("full_cool_frac"),
        F.avg(on("t_in")).alias("t_in_mean"),
        F.stddev_samp(on("t_in")).alias("t_in_std"),
        F.avg(on("peer_dev")).alias("peer_dev_mean"),
        hot_share("peer_dev").alias("peer_dev_pos_frac"),
        F.avg(on("set_err")).alias("set_err_mean"),
        hot_share("set_err").alias("set_err_pos_frac"),
        F.avg(on("dT_10")).alias("dT_mean_cool"),
        F.avg(F.col("t_in").isNull().cast("double")).alias("invalid_frac"),
        F.greatest(F.avg(on("p_high_1_def")), F.avg(on("p_high_2_def"))).alias("p_high_def"),
        *([F.avg("resid").alias("resid_mean")] if "resid" in d.columns else []),
    )
    cooling = d.where(cool)
    measured = ["t_in", "peer_dev", "set_err", "dT_10", *(["resid"] if "resid" in d.columns else [])]
    tails = exact_quantiles(stacked(cooling, keys, measured), [*keys, "metric"], "value", {"p90": 0.9, "p95": 0.95})
    tail = lambda m, q, name: F.max(F.when(F.col("metric") == m, F.col(q))).alias(name)
    wide = tails.groupBy(*keys).agg(
        tail("t_in", "p95", "t_in_p95"), tail("peer_dev", "p90", "peer_dev_p90"),
        tail("set_err", "p95", "set_err_p95"), tail("dT_10", "p90", "dT_p90_cool"),
        *([tail("resid", "p90", "resid_p90")] if "resid" in d.columns else []))
    persist = longest_run(cooling, order, F.col("peer_dev") > HOT_MARGIN, "peer_dev_persist")
    out = stats.join(wide, keys, "left").join(persist, keys, "left")
    return out.withColumn("peer_dev_persist", F.coalesce("peer_dev_persist", F.lit(0)).cast("long"))


def robust_z(df: DataFrame, group: Sequence[str], value: str, name: str = "z", bounded: bool = False) -> DataFrame:
    """(x − median) / (1.4826 · MAD + 1e-6) within a group."""
    keys = list(group)
    centred = df.join(medians(df, keys, value, "_med", bounded), keys, "left").withColumn(
        "_dev", F.abs(F.col(value) - F.col("_med")))
    spread = medians(centred, keys, "_dev", "_mad", bounded)
    z = (F.col(value) - F.col("_med")) / (F.col("_mad") * MAD_SCALE + MAD_GUARD)
    return centred.join(spread, keys, "left").withColumn(name, z).drop("_med", "_dev", "_mad")


def component_z(features: DataFrame, case: str, car: str, components: Sequence[str]) -> DataFrame:
    """Clipped robust z of every score component (columns named like the components), 0 where undefined.

    A component with fewer than two values in a case counts for nothing there. Cases hold a few cars each.
    """
    long = stacked(features, [case, car], list(components))
    z = robust_z(long, [case, "metric"], "value", bounded=True)
    known = long.groupBy(case, "metric").agg(F.count("value").alias("_k"))
    clipped = F.greatest(F.lit(-Z_CLIP), F.least(F.lit(Z_CLIP), F.col("z")))
    used = z.join(known, [case, "metric"]).withColumn("z", F.when(F.col("_k") >= 2, F.coalesce(clipped, F.lit(0.0))).otherwise(0.0))
    return used.groupBy(case, car).pivot("metric", list(components)).agg(F.max("z"))


def weighted_score(z: DataFrame, weights: dict[str, float], n_valid: str) -> Column:
    total = sum((F.col(c) * float(w) for c, w in weights.items() if w), F.lit(0.0))
    return F.when(F.col(n_valid) == 0, F.lit(float("-inf"))).otherwise(total)


def rank_units(scored: DataFrame, case: str, car: str, score: str) -> DataFrame:
    """Cars of a case joined by '|', highest score first, ties by car. A case is one train."""
    order = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(car).alias("c"))))
    return scored.groupBy(case).agg(F.array_join(F.transform(order, lambda x: x.c), "|").alias("ranked_cars"))


def average_rank(df: DataFrame, by: Sequence[str], value: str) -> Column:
    """Ascending rank with ties averaged; NULL stays NULL."""
    known = F.col(value).isNotNull()
    rank = F.rank().over(Window.partitionBy(*by, known).orderBy(value))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, known, value))
    return F.when(known, rank + (ties - 1) / 2)


# --- alternative scorers: (prepared rows) -> (case, car, score) -----------------------------------


def _deviations(d: DataFrame, case: str, among: Column = None, value: str = "t_in", min_peers: int = 1) -> DataFrame:
    among = F.col("cooling") if among is None else among
    return peer_deviation(d, [case, "ts"], value, among, "dev", min_peers).where(F.col("dev").isNotNull())


def mean_deviation(d, case, among=None, value="t_in"):
    """Mean deviation of a car from its peers, optionally on a part of the rows or of another value."""
    return _deviations(d, case, among, value, MIN_PEERS).groupBy(case, "car").agg(F.avg("dev").alias("score"))


def setpoint_adjusted(d, case):
    return mean_deviation(d, case, value="set_err")


def hot_weather(d, case):
    """Only rows at or above the median outdoor temperature of the case (a whole history: distributed median)."""
    mid = exact_medians(d, [case], "t_out", "_mid")
    rows = d.join(mid, case, "left")
    return mean_deviation(rows, case, F.col("cooling") & F.coalesce(F.col("t_out") >= F.col("_mid"), F.lit(False)))


def borda(d, case):
    """Mean of the ranks by mean deviation, its 90th percentile, set-point error and cooling rate."""
    keys = [case, "car"]
    dev = mean_deviation(d, case).withColumnRenamed("score", "dev")
    p90 = exact_quantiles(_deviations(d, case), keys, "dev", {"p90": 0.9})
    means = d.where("cooling").groupBy(*keys).agg(F.avg("set_err").alias("se"), (-F.avg("dT_10")).alias("dt"))
    joined = means.join(dev, keys, "full").join(p90, keys, "full")
    ranks = [average_rank(joined, [case], c).alias(c) for c in ("dev", "p90", "se", "dt")]
    long = stacked(joined.select(*keys, *ranks), keys, ["dev", "p90", "se", "dt"])
    return long.groupBy(*keys).agg(F.avg("value").alias("score"))


def trimmed(d, case):
    """Mean of the deviations strictly between the car's own 10 % and 90 % quantiles."""
    keys = [case, "car"]
    dev = _deviations(d, case).select(*keys, "dev")
    q = exact_quantiles(dev, keys, "dev", {"lo": 0.1, "hi": 0.9})
    inside = (F.col("dev") > F.col("lo")) & (F.col("dev") < F.col("hi"))
    return dev.join(q, keys).groupBy(*keys).agg(F.avg(F.when(inside, F.col("dev"))).alias("score"))


def daily_maximum(d, case):
    day = F.floor(F.col("t") / F.lit(86_400_000_000)).alias("day")
    top = d.where(F.col("cooling") & F.col("t_in").isNotNull()).groupBy(case, day, "car").agg(F.max("t_in").alias("m"))
    mid = top.groupBy(case, "day").agg(F.median("m").alias("_mid"))
    return top.join(mid, [case, "day"]).groupBy(case, "car").agg(F.avg(F.col("m") - F.col("_mid")).alias("score"))


def hottest_share(d, case):
    """Share of moments with at least three peers at which the car is the hottest."""
    rows = d.where(F.col("cooling") & F.col("t_in").isNotNull())
    top = rows.groupBy(case, "ts").agg(F.max("t_in").alias("_max"), F.count("t_in").alias("_n"))
    hit = (F.col("t_in") >= F.col("_max")) & (F.col("_n") >= MIN_PEERS)
    return rows.join(top, [case, "ts"]).groupBy(case, "car").agg(F.avg(hit.cast("double")).alias("score"))


def median_of(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    lo, hi = F.floor((n - 1) / 2).cast("int") + 1, F.floor(n / 2).cast("int") + 1
    return F.when(n > 0, (F.element_at(s, F.greatest(lo, F.lit(1))) + F.element_at(s, F.greatest(hi, F.lit(1)))) / 2)


def others_median(d, case):
    """Deviation from the median of the other cars' means at the same moment (an array of one train's cars)."""
    per = d.where(F.col("cooling") & F.col("t_in").isNotNull()).groupBy(case, "ts", "car").agg(F.avg("t_in").alias("m"))
    cars = per.groupBy(case, "ts").agg(F.collect_list(F.struct("car", "m")).alias("_cars"))
    each = cars.select(case, "ts", "_cars", F.inline("_cars"))
    others = F.transform(F.filter("_cars", lambda x: x.car != F.col("car")), lambda x: x.m)
    gap = F.when(F.size(others) > 0, F.col("m") - median_of(others))
    return each.withColumn("gap", gap).groupBy(case, "car").agg(F.avg("gap").alias("score"))


def mode_combination(d, case):
    """Robust z of the mean deviation plus half the robust z of the full-cooling share."""
    full = d.groupBy(case, "car").agg(F.avg("full_cool").alias("full"))
    both = cut(full.join(mean_deviation(d, case), [case, "car"], "left"))  # one row per car
    z = robust_z(robust_z(both, [case], "score", "z1", bounded=True), [case], "full", "z2", bounded=True)
    return z.select(case, "car", (F.col("z1") + 0.5 * F.col("z2")).alias("score"))


def ranking_power(features: DataFrame, truth: DataFrame, case: str, columns: Sequence[str]) -> DataFrame:
    """Mean rank-decay score of every feature used alone: missing values rank last, ties by car."""
    long = stacked(features, [case, "car"], list(columns), "feature")
    low = long.groupBy(case, "feature").agg(F.min("value").alias("_low"), F.count(F.lit(1)).alias("n"))
    filled = long.join(low, [case, "feature"]).withColumn("v", F.coalesce(F.col("value"), F.col("_low") - 1))
    place = F.row_number().over(Window.partitionBy(case, "feature").orderBy(F.desc_nulls_last("v"), "car"))
    hit = filled.withColumn("r", place).join(truth, [case, "car"])
    per_case = F.avg((F.col("n") - (F.col("r") - 1)) / F.col("n"))
    return hit.groupBy("feature").agg(per_case.alias("mean_score"), F.count(F.lit(1)).alias("cases"))


def bands(items: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Mean ± 2 population SD of the peers (n ≥ 3), whether a value is unusual, and its deviation in % of one SD."""
    keys = list(group)
    stats = items.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("_sd"))
    v, enough = F.col(value), F.col("n") >= 3
    off = F.abs(v - F.col("mean"))
    deviation = F.when(F.col("_sd") == 0, F.when(v == F.col("mean"), 0.0)).otherwise(
        F.try_divide(100 * (v - F.col("mean")), F.col("_sd")))
    return items.join(stats, keys, "left").select(
        *items.columns, "n", "mean",
        F.when(enough, F.col("mean") - 2 * F.col("_sd")).alias("low"),
        F.when(enough, F.col("mean") + 2 * F.col("_sd")).alias("high"),
        F.coalesce(enough & (off > 2 * F.col("_sd") + 1e-12), F.lit(False)).alias("unusual"),
        F.when(enough, deviation).alias("deviation_pct"),
    )
