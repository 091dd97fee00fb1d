"""Result history: newest result per file, filters, merging and export checks, and views for operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayside.functions.columns import natural_key
from wayside.operators.folds import ranked, split_even
from wayside.operators.ordered import Order, places, positions, previous
from wayside.operators.peers import bands
from wayside.session import cut

# Columns of the exported tables and their headings for operators.
OUTPUT = {
    "door": ("start_time", "end_time", "prediction"),
    "acv": ("file_id", "ranked_cars"),
    "rail": ("file_id", "prediction"),
    "shm": ("file_id", "prediction"),
}
HEADINGS = {
    "door": {
        "start_time": "Movement start (recording time)",
        "end_time": "Movement end (recording time)",
        "prediction": "Door condition",
    },
    "acv": {"file_id": "Source file", "ranked_cars": "Cars in refrigerant leak inspection order"},
    "rail": {"file_id": "Source file", "prediction": "Rail corrugation result"},
    "shm": {"file_id": "Source file", "prediction": "Estimated fatigue damage"},
}


def latest(rows: DataFrame) -> DataFrame:
    """Newest result per (system, file) by (created, seq); of the door, all rows of the newest run.

    ``max_by`` combines map-side, so a file checked over and over does not gather in one task.
    """
    live = rows.where(~F.col("preview"))
    age = F.struct("created", "seq")
    others = [c for c in rows.columns if c not in ("system", "file_id")]
    newest = (
        live.where("system <> 'door'").groupBy("system", "file_id")
        .agg(F.max_by(F.struct(*others), age).alias("_r")).select("system", "file_id", "_r.*"))
    doors = live.where("system = 'door'")
    run = doors.agg(F.max_by("run_id", age)).scalar()
    return newest.unionByName(doors.where(F.col("run_id") == run).select(*newest.columns))


def visible(runs: DataFrame, system: str | None, since: Column | None) -> DataFrame:
    """Runs of a system since a moment, without previews and without runs that were merged into another."""
    merged = runs.where(F.col("combined_from").isNotNull()).select(F.explode("combined_from").alias("run_id")).distinct()
    shown = runs.where(~F.col("preview")).join(merged, "run_id", "left_anti")
    if system is not None:
        shown = shown.where(F.col("system") == system)
    return shown if since is None else shown.where(F.col("created") >= since)


def merge_problems(rows: DataFrame, group: str) -> DataFrame:
    """Why the runs of a group cannot be merged: door, mixed systems, several models, previews, repeated files."""
    differs = lambda c: F.min(c) != F.max(c)
    whole = rows.groupBy(group).agg(
        F.bool_or(F.col("system") == "door").alias("door"), differs("system").alias("mixed_systems"),
        differs("model").alias("several_models"), F.bool_or("preview").alias("preview"))
    repeated = rows.groupBy(group, "file_id").agg(F.count(F.lit(1)).alias("_n")).groupBy(group).agg(
        (F.max("_n") > 1).alias("repeated_files"))
    names = ("door", "mixed_systems", "several_models", "preview", "repeated_files")
    broken = F.filter(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]), lambda r: r.isNotNull())
    return whole.join(repeated, group).select(group, F.explode(broken).alias("rule"))


def export_choices(choices: DataFrame, results: DataFrame) -> DataFrame:
    """Each distinct choice with its result and what speaks against exporting it: unavailable, chosen twice, or a
    system whose chosen results come from several models."""
    wanted = choices.groupBy("run_id", "file_id").agg(F.count(F.lit(1)).alias("_times"))
    found = wanted.join(results.where(~F.col("preview")), ["run_id", "file_id"], "left")
    models = found.where("system IS NOT NULL").groupBy("system").agg((F.min("model") != F.max("model")).alias("_mixed"))
    problem = (
        F.when(F.col("system").isNull(), "unavailable").when(F.col("_times") > 1, "chosen_twice")
        .when(F.col("_mixed"), "several_models").otherwise("ok"))
    # one row per system: four at most
    return found.join(F.broadcast(models), "system", "left").select("run_id", "file_id", "system", problem.alias("status"))


def operator_view(rows: DataFrame, system: str) -> DataFrame:
    """The exported columns under their headings, times to whole seconds."""

    def shown(c: str) -> Column:
        return F.date_format(c, "dd MMM yyyy, HH:mm:ss") if c in ("start_time", "end_time") else F.col(c)

    return rows.select(*[shown(c).alias(heading) for c, heading in HEADINGS[system].items()])


def listing(rows: DataFrame, search: str, label: str | None, by: str = "damage", turned: bool = False) -> DataFrame:
    """Results whose file name contains a text, optionally of one label, with their place.

    ``by``: "file" (natural order of the names), "damage" (highest first) or a label (results with that label first); file
    names in natural order decide among equals. Missing damages come last. ``turned``: the other direction, lowest damage or
    last name first; missing damages still come last.
    """
    hits = rows.where(F.contains(F.lower("file_id"), F.lit(search.lower())))
    if label is not None:
        hits = hits.where(F.col("prediction") == label)
    first = {
        "file": [], "damage": [F.col("damage").isNull(), F.col("damage") * (1 if turned else -1)],
    }.get(by, [~F.coalesce(F.col("prediction") == by, F.lit(False))])
    everything = hits.withColumn("_all", F.lit(0))
    placed = places(everything, ["_all"], [*first, natural_key("file_id")]).drop("_all")
    if turned and by == "file":
        return placed.withColumn("place", hits.agg(F.count(F.lit(1))).scalar() + 1 - F.col("place"))
    return placed


def label_adjacency(units: DataFrame, label: str, at: str, value: str, blocks: int) -> DataFrame:
    """Per label: units, mean step of ``value`` between neighbours of the label in unit order, units per block."""
    placed = ranked(units, at).withColumn("_block", split_even(F.col("pos"), F.col("n"), blocks))
    stepped = previous(placed, Order((label,), at), value)
    return stepped.groupBy(label).agg(
        F.count(F.lit(1)).alias("units"), F.avg(F.abs(F.col(value) - F.col(f"prev_{value}"))).alias("mean_step"),
        *[F.count(F.when(F.col("_block") == b, 1)).alias(f"block_{b}") for b in range(blocks)])


def downsample(rows: DataFrame, order: Order, value: str, points: int = 180, extremes: int = 24) -> DataFrame:
    """Evenly spaced samples, the largest 3-sigma outliers and the first minimum and maximum of each trace."""
    return _picked(rows, order, value, points, extremes).select(*order.keys, "index", "value", "unusual")


def traces(rows: DataFrame, order: Order, value: str, points: int = 180, extremes: int = 24) -> DataFrame:
    """What a trace is drawn from: the points of ``downsample`` with their ``time`` and their rank among the outliers shown
    (``extreme``, else NULL), and beside each the trace's n, mean, low, high and number of outliers (``flagged``)."""
    keys = list(order.keys)
    stats = trace_summary(rows, keys, value)
    return _picked(rows, order, value, points, extremes).join(stats, keys)


def _picked(rows: DataFrame, order: Order, value: str, points: int, extremes: int) -> DataFrame:
    """Points of a trace: index from 1, time, value, unusual, extreme.

    The per-trace top list filters on its row number, which Spark turns into a limit before the shuffle.
    """
    keys = list(order.keys)
    placed = cut(positions(rows.select(*keys, *[c for c in order.sort if c != value], value), order, "_i", "_n"))
    known = F.col(value).isNotNull()
    stats = placed.where(known).groupBy(*keys).agg(
        F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"),
        F.min_by("_i", F.struct(value, "_i")).alias("_at_min"), F.max_by("_i", F.struct(F.col(value), -F.col("_i"))).alias("_at_max"))
    d = placed.join(stats, keys).withColumn("_off", F.abs(F.col(value) - F.col("_mean")))
    flagged = F.coalesce(F.col("_off") > 3 * F.col("_sd") + 1e-12, F.lit(False))
    d = d.withColumn("unusual", flagged)
    m = F.least(F.col("_n"), F.lit(points))
    step = (F.col("_n") - 1) / F.greatest(m - 1, F.lit(1))
    near = F.floor(F.col("_i") / F.greatest(step, F.lit(1.0)))
    spaced = (F.col("_i") == F.col("_n") - 1) | (F.col("_i") == 0)
    for k in (0, 1):
        j = near + k
        spaced = spaced | ((F.floor(j * step) == F.col("_i")) & (j < m))
    even = d.where(spaced | (F.col("_i") == F.col("_at_min")) | (F.col("_i") == F.col("_at_max")))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_off"), "_i"))
    top = d.where("unusual").withColumn("extreme", place.cast("long")).where(F.col("extreme") <= extremes)
    both = even.withColumn("extreme", F.lit(None).cast("long")).unionByName(top)
    return both.groupBy(*keys, (F.col("_i") + 1).alias("index")).agg(
        F.first(order.at).alias("time"), F.first(value).alias("value"), F.first("unusual").alias("unusual"), F.max("extreme").alias("extreme"))


def trace_summary(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per trace: known readings, mean, three standard deviations to either side, and how many readings lie beyond."""
    stats = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), (3 * F.stddev_pop(value)).alias("_reach"))
    beyond = F.abs(F.col(value) - F.col("mean")) > F.col("_reach") + 1e-12
    joined = rows.select(*keys, value).join(stats, list(keys))
    return joined.groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("mean").alias("mean"), (F.first("mean") - F.first("_reach")).alias("low"),
        (F.first("mean") + F.first("_reach")).alias("high"), F.count(F.when(beyond, 1)).alias("flagged"))


# Evidence shown for a door movement (key, label, unit).
DOOR_EVIDENCE: Sequence[tuple[str, str, str]] = (
    ("mid_mean", "Mid-travel current", "source units"),
    ("trav_mean", "Travel current", "source units"),
    ("exc_mid_mean", "Mid-travel deviation from trained normal profile", "IQR units"),
    ("cur_peak", "Peak current", "source units"),
    ("duration", "Movement duration", "s"),
    ("volt_mean", "Mean motor voltage", "source units"),
    ("bemf_mean", "Mean back-EMF", "source units"),
    ("stall_rows", "Stationary samples under load", "samples"),
)


# Evidence shown for a car, a rail recording, a stress series.
CAR_EVIDENCE: Sequence[tuple[str, str, str]] = (
    ("t_in_mean", "Cabin temperature while cooling", "°C"),
    ("peer_dev_mean", "Temperature above peer median", "°C"),
    ("peer_dev_p90", "90th percentile above peer temperature", "°C"),
    ("resid_mean", "Temperature change above learned response", "°C"),
    ("set_err_mean", "Temperature above cooling setpoint", "°C"),
    ("dT_mean_cool", "Temperature change over 10 samples", "°C"),
    ("p_high_def", "High-pressure deficit vs peers", "source units"),
    ("invalid_frac", "Invalid temperature fraction", "fraction"),
    ("p_high_1", "System 1 high pressure", "source units"),
    ("p_high_2", "System 2 high pressure", "source units"),
)
RAIL_EVIDENCE: Sequence[tuple[str, str, str]] = (
    ("speed", "Estimated speed", "m/s"),
    ("s1_rms", "Side I · Vibration RMS", "source units"),
    ("s1_shock_rms", "Side I · Shock RMS", "source units"),
    ("s1_dom_lambda", "Side I · Dominant wavelength", "m"),
    ("s2_rms", "Side II · Vibration RMS", "source units"),
    ("s2_shock_rms", "Side II · Shock RMS", "source units"),
    ("s2_dom_lambda", "Side II · Dominant wavelength", "m"),
)
STRESS_EVIDENCE: Sequence[tuple[str, str, str]] = (
    ("damage", "Estimated fatigue damage", "unitless"),
    ("mean", "Mean stress", "source units"),
    ("rms", "Stress RMS", "source units"),
    ("range", "Peak-to-peak stress", "source units"),
    ("cycle_range", "Largest stress-cycle range", "source units"),
    ("cycles", "Counted stress cycles", "cycles"),
)


def compared(items: DataFrame, ident: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Evidence exploded, each value with the band of its metric among the items of its group (none: all items)."""
    return bands(evidence_rows(items, ident), [*group, "key"], "value")


def evidence(features: DataFrame, ident: Sequence[str], metrics: Sequence[tuple[str, str, str]] = DOOR_EVIDENCE) -> DataFrame:
    """Each item with its metrics as an array of (key, label, value, unit)."""
    items = [
        F.struct(F.lit(k).alias("key"), F.lit(label).alias("label"), F.col(k).cast("double").alias("value"), F.lit(unit).alias("unit"))
        for k, label, unit in metrics]
    return features.select(*ident, F.array(*items).alias("metrics"))


def evidence_rows(items: DataFrame, ident: Sequence[str]) -> DataFrame:
    return items.select(*ident, F.inline("metrics"))
