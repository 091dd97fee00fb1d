"""Per-cycle features of a segmented stream: bounds, electrical statistics, phases, profiles and excess."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayside.functions.columns import ratio, seconds
from wayside.operators.ordered import Order, positions, previous
from wayside.operators.quantiles import exact_quantiles

BINS = 20
# Seconds per sample, voltage and current units, stall and resistance thresholds.
SAMPLE_S, VOLT, AMP = 0.02, 0.01, 0.001
STALL_CURRENT, HIGH_CURRENT, VERY_HIGH_CURRENT = 200, 300, 500


def bounds(rows: DataFrame, order: Order) -> DataFrame:
    return rows.groupBy(*order.keys).agg(
        F.min(order.at).alias("start_us"), F.max(order.at).alias("end_us"), F.count(F.lit(1)).alias("n_rows")
    )


def directions(rows: DataFrame, order: Order, position: str = "pos") -> DataFrame:
    """Open where the position ends above where it started, else Close."""
    place = F.struct(*order.sort)
    return (
        rows.groupBy(*order.keys)
        .agg(F.min_by(position, place).alias("pos_start"), F.max_by(position, place).alias("pos_end"))
        .withColumn("operation", F.when(F.col("pos_end") > F.col("pos_start"), "Open").otherwise("Close"))
    )


def attach_labels(starts: DataFrame, answers: DataFrame, keys: Sequence[str], start: str = "start_us") -> DataFrame:
    """Status of the answer with exactly the same start time, NULL where there is none; the last answer wins."""
    latest = answers.groupBy(*keys, start).agg(F.max_by("status", "answer_seq").alias("status"))
    return starts.join(latest, [*keys, start], "left")


def electrical(rows: DataFrame, order: Order) -> DataFrame:
    """Count, duration and current / voltage / back-EMF statistics of every cycle, and its first set opening and
    closing times where the rows carry them."""
    place = F.struct(*order.sort)
    first = [F.min_by(c, place).alias(f"{c}_col") for c in ("t_open", "t_close") if c in rows.columns]
    cur, volt, emf = F.col("current"), F.col("voltage"), F.col("bemf")
    stats = rows.groupBy(*order.keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        seconds(F.max(order.at) - F.min(order.at)).alias("duration"),
        F.max(cur).alias("cur_peak"),
        F.avg(cur).alias("cur_mean"),
        F.sqrt(F.avg(cur * cur)).alias("cur_rms"),
        F.stddev_pop(cur).alias("cur_std"),
        (F.sum(cur) * SAMPLE_S).alias("cur_integral"),
        F.avg(volt).alias("volt_mean"),
        F.max(volt).alias("volt_max"),
        F.avg(emf).alias("bemf_mean"),
        F.max(emf).alias("bemf_max"),
        F.sum(volt * VOLT * cur * AMP * SAMPLE_S).alias("energy"),
        ratio(F.avg(emf), F.avg(volt)).alias("bemf_per_volt"),
        F.min_by("pos", place).alias("pos_start"),
        F.max_by("pos", place).alias("pos_end"),
        F.percentile(cur, F.lit(0.9)).alias("cur_p90"),  # a cycle is bounded, so plain percentiles will do
        F.percentile(cur, F.lit(0.5)).alias("cur_median"),
        *first,
    )
    return (
        stats.withColumn("pos_range", F.abs(F.col("pos_end") - F.col("pos_start")))
        .withColumn("op_is_open", F.when(F.col("pos_end") > F.col("pos_start"), 1.0).otherwise(0.0))
    )


def _share(fraction: float) -> Column:
    return F.floor(F.lit(fraction) * F.col("n")).cast("long")


def travelling() -> Column:
    """Rows of the travel phase: all but the last tenth, where the lock engages."""
    return F.col("i") < F.greatest(F.lit(1), _share(0.9))


def middle(low: float = 0.3, high: float = 0.8) -> Column:
    return (F.col("i") >= _share(low)) & (F.col("i") < _share(high))


def phases(placed: DataFrame, keys: Sequence[str], value: str = "current") -> DataFrame:
    """Travel and mid-travel statistics; ``placed`` carries the row position i and the cycle length n."""
    travel, mid, v = F.when(travelling(), F.col(value)), F.when(middle(), F.col(value)), F.col(value)
    share = lambda limit: F.avg(F.when(travelling(), F.when(v > limit, 1.0).otherwise(0.0)))
    return placed.groupBy(*keys).agg(
        F.avg(travel).alias("trav_mean"),
        F.max(travel).alias("trav_max"),
        F.stddev_pop(travel).alias("trav_std"),
        F.percentile(travel, F.lit(0.9)).alias("trav_p90"),  # a cycle is bounded
        share(HIGH_CURRENT).alias("trav_above_300"),
        share(VERY_HIGH_CURRENT).alias("trav_above_500"),
        F.avg(mid).alias("mid_mean"),
        F.max(mid).alias("mid_max"),
    )


def velocities(placed: DataFrame, order: Order, position: str, value: str = "current") -> DataFrame:
    """Speed of the leaf from row to row (first row 0), samples standing still under load, slowest mid-travel step."""
    moved = previous(placed, order, position)
    speed = F.abs(F.col(position) - F.coalesce(F.col(f"prev_{position}"), F.col(position)))
    return (
        moved.withColumn("_speed", speed)
        .groupBy(*order.keys)
        .agg(
            F.avg("_speed").alias("vel_mean"),
            F.max("_speed").alias("vel_max"),
            F.min(F.when(middle(0.2, 0.8), F.col("_speed"))).alias("vel_min_mid"),
            F.count(F.when((F.col("_speed") == 0) & (F.col(value) > STALL_CURRENT), 1)).alias("stall_rows"),
        )
    )


def travel_slope(placed: DataFrame, keys: Sequence[str], y: str, x: str, name: str = "slope") -> DataFrame:
    """Least-squares slope of y on x over the travel phase; 0 for cycles with at most two travel rows."""
    slope = F.regr_slope(F.when(travelling(), F.col(y)), F.when(travelling(), F.col(x)))
    rows = F.count(F.when(travelling(), 1))
    return placed.groupBy(*keys).agg(F.when(rows > 2, slope).otherwise(0.0).alias(name))


def profiles(placed: DataFrame, keys: Sequence[str], value: str = "current", bins: int = BINS) -> DataFrame:
    """Mean of ``value`` in equal bins of normalised time, as an array; empty bins are interpolated linearly and
    the outer ones take the nearest known bin. At most ``bins`` partial means per cycle leave the aggregation."""
    slot = F.least(F.floor(F.col("i") * (F.lit(1.0) / F.col("n")) * bins), F.lit(bins - 1)).cast("int")
    means = placed.groupBy(*keys, slot.alias("_bin")).agg(F.avg(value).alias("_mean"))
    known = means.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_bin", "_mean"))).alias("_known"))
    have = F.map_keys("_known")

    def fill(b: Column) -> Column:
        left = F.array_max(F.filter(have, lambda x: x <= b))
        right = F.array_min(F.filter(have, lambda x: x >= b))
        at = lambda x: F.element_at("_known", x)
        between = at(left) + (at(right) - at(left)) * (b - left) / (right - left)
        return F.when(left.isNull(), at(right)).when(right.isNull() | (left == right), at(left)).otherwise(between)

    return known.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), fill).alias("profile"))


def reference_profile(cycles: DataFrame, normal: Column) -> DataFrame:
    """Median and interquartile range of the profile bins over the normal cycles, per operation.

    An operation covers a large share of all cycles, so the quantiles are the distributed ones.
    """
    bins = cycles.where(normal).select("operation", F.posexplode("profile").alias("bin", "value"))
    q = exact_quantiles(bins, ["operation", "bin"], "value", {"q1": 0.25, "med": 0.5, "q3": 0.75})
    return q.select("operation", "bin", "med", (F.col("q3") - F.col("q1") + 1e-6).alias("iqr"))


def with_excess(cycles: DataFrame, reference: DataFrame) -> DataFrame:
    """Deviation of every bin from the reference of the cycle's operation, as array ``z``.

    The reference has two operations times the number of bins: a fixed size, hence the broadcast.
    """
    packed = reference.groupBy("operation").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("bin", "med", "iqr"))), lambda s: F.struct(s.med, s.iqr)
        ).alias("_ref")
    )
    joined = cycles.join(F.broadcast(packed), "operation")
    z = F.zip_with("profile", "_ref", lambda p, r: (p - r.med) / r.iqr)
    return joined.withColumn("z", z).drop("_ref")


def excess(cycles: DataFrame, keys: Sequence[str], bins: int = BINS) -> DataFrame:
    z = F.col("z")
    add = lambda a, b: a + b
    total = lambda a: F.aggregate(a, F.lit(0.0), add)
    above = F.size(F.filter(z, lambda x: x > 2))
    streak = F.aggregate(
        z,
        F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")),
        lambda s, x: F.struct(
            F.when(x > 2, s.run + 1).otherwise(0).alias("run"),
            F.greatest(s.best, F.when(x > 2, s.run + 1).otherwise(0)).alias("best"),
        ),
        lambda s: s.best,
    )
    lo, hi = int(0.3 * bins), int(0.8 * bins)
    return cycles.select(
        *keys,
        F.array_max(z).alias("exc_max"),
        (total(z) / bins).alias("exc_mean"),
        total(F.transform(z, lambda x: F.greatest(x, F.lit(0.0)))).alias("exc_pos_integral"),
        (F.array_position(z, F.array_max(z)) - 1).cast("long").alias("exc_argmax"),
        streak.cast("long").alias("exc_run"),
        above.cast("long").alias("exc_n_above2"),
        F.sqrt(total(F.transform(z, lambda x: x * x)) / bins).alias("exc_l2"),
        (total(F.slice(z, lo + 1, hi - lo)) / (hi - lo)).alias("exc_mid_mean"),
    )


def profile_wide(cycles: DataFrame, keys: Sequence[str], bins: int = BINS) -> DataFrame:
    """One column per bin for the profile (prof_i) and its deviation (z_i)."""
    spread = [F.col(a)[i].alias(f"{p}_{i}") for a, p in (("profile", "prof"), ("z", "z")) for i in range(bins)]
    return cycles.select(*keys, *spread)


def placed_in(rows: DataFrame, order: Order) -> DataFrame:
    """Row position i and cycle length n, as the phase features expect them."""
    return positions(rows, order, "i", "n")
