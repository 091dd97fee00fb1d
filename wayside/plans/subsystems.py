"""The four maintenance questions from raw rows to predictions, each one lazy plan over the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayside.functions.columns import channel_car, channel_side, decide, format_native_ts, speed_bin
from wayside.operators import cycles, fatigue, models, peers, rail, spectral
from wayside.operators.ordered import Order, gap_segments
from wayside.session import cut

# Gap between door cycles (µs), score weights of the cars, sampling rate and segment of rail recordings.
DOOR_GAP = 1_000_000
CAR_WEIGHTS = {"peer_dev_mean": 1.0, "p_high_def": 1.0}
RAIL_RATE, RAIL_SEGMENT = 10_000.0, 1024
REFERENCE_FEATURES = tuple(f"fb_{lo}_{hi}" for lo, hi in spectral.FREQ_BANDS) + ("log_rms", "shock_log_rms")
ABNORMAL = "Abnormal resistance"


# --- doors ----------------------------------------------------------------------------------------


def door_cycles(rows: DataFrame, gap: int = DOOR_GAP) -> tuple[DataFrame, Order]:
    """Rows with their cycle, written once for the many features that follow, and the order inside a cycle."""
    stream = Order(("stream_id",), "t", ("seq",)).sampled(rows)
    return cut(gap_segments(rows, stream, gap)), stream.within("stream_id", "segment_id")


def door_table(segmented: DataFrame, order: Order) -> DataFrame:
    """One row per cycle: electrical, phase and velocity features, slope, operation and profile."""
    keys = list(order.keys)
    placed = cut(cycles.placed_in(segmented, order))
    parts = [
        cycles.phases(placed, keys),
        cycles.velocities(placed, order, "pos"),
        cycles.travel_slope(placed, keys, "current", "bemf", "cur_above_bemf_slope"),
        cycles.profiles(placed, keys),
        cycles.directions(segmented, order).select(*keys, "operation"),
        cycles.bounds(segmented, order).drop("n_rows"),
    ]
    table = cycles.electrical(segmented, order)
    for part in parts:
        table = table.join(part, keys)
    return table


def door_features(table: DataFrame, reference: DataFrame) -> DataFrame:
    """Cycle table with the deviations from the reference profile."""
    keys = ["stream_id", "segment_id"]
    deviated = cycles.with_excess(table, reference)
    return deviated.join(cycles.excess(deviated, keys), keys).join(cycles.profile_wide(deviated, keys), keys)


DOOR_IDENTITY = ("stream_id", "segment_id", "start_us", "end_us", "status", "y")


def door_inputs(rows: DataFrame) -> list[str]:
    """The model's inputs: every number the operators made, identity and answer left out, in order of their names."""
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint")
    return sorted(c for c, kind in rows.dtypes if kind in numeric and c not in DOOR_IDENTITY)


@dataclass(frozen=True)
class DoorModel:
    reference: DataFrame
    inputs: list[str]
    forest: models.Forest
    logistic: PipelineModel
    threshold: float


def train_door(table: DataFrame, threshold: float = 0.5, trees: int = models.DOOR_TREES) -> DoorModel:
    """``table`` is a door table with ``status``. Reference, scaler and models see these rows only."""
    reference = cut(cycles.reference_profile(table, F.col("status") == "Normal"))  # two operations × bins
    rows = door_features(table, reference).withColumn("y", (F.col("status") == ABNORMAL).cast("double"))
    inputs = door_inputs(rows)
    rows = cut(rows.fillna(0.0, inputs))
    forest = models.fit_forest(rows, inputs, "y", trees, models.DOOR_LEAF)
    logistic = models.fit_logistic(rows, models.LOGISTIC_FEATURES, "y")
    return DoorModel(reference, inputs, forest, logistic, threshold)


def predict_door(table: DataFrame, model: DoorModel) -> DataFrame:
    keys = ["stream_id", "segment_id", "start_us", "end_us"]
    rows = door_features(table, model.reference).fillna(0.0, model.inputs)
    p = models.ensemble([models.probability(m, rows, keys) for m in (model.forest, model.logistic)], keys)
    native = lambda c: format_native_ts(F.timestamp_micros(F.col(c)))
    return p.select(
        "stream_id", native("start_us").alias("start_time"), native("end_us").alias("end_time"),
        F.when(F.col("p") >= model.threshold, ABNORMAL).otherwise("Normal").alias("prediction"))


def peer_verdicts(segmented: DataFrame, order: Order, limit: float = 2.0) -> DataFrame:
    """Door verdicts without a model: a cycle is abnormal where its mean current lies far above the cycles of the
    same operation (robust z)."""
    table = cycles.electrical(segmented, order).join(cycles.bounds(segmented, order).drop("n_rows"), list(order.keys))
    named = table.withColumn("operation", F.when(F.col("op_is_open") == 1, "Open").otherwise("Close"))
    z = peers.robust_z(named, ["operation"], "cur_mean")
    native = lambda c: format_native_ts(F.timestamp_micros(F.col(c)))
    return z.select(
        "stream_id", native("start_us").alias("start_time"), native("end_us").alias("end_time"),
        F.when(F.col("z") > limit, ABNORMAL).otherwise("Normal").alias("prediction"))


# --- air conditioning -----------------------------------------------------------------------------


def rank_cars(
    readings: DataFrame, response: models.Linear | None = None, weights: dict[str, float] | None = None, ties: tuple[str, ...] | None = None
) -> DataFrame:
    """Cars of each case by how likely they leak. ``readings``: case_id, car, ts, t and one column per role.

    ``ties``: columns that order readings of one car at one time; by default all others, so that chance has no say.
    """
    weights = weights or CAR_WEIGHTS
    tied = ties or tuple(sorted(set(readings.columns) - {"case_id", "car", "t"}))
    order = Order(("case_id", "car"), "t", tied).sampled(readings)
    prepared = cut(peers.prepare(readings, order))
    if response is not None:
        prepared = models.response_residual(prepared, response)
    keys = ["case_id", "car"]
    deviated = peers.with_deviations(prepared, ["case_id", "ts"])
    for p in ("p_high_1", "p_high_2"):
        if f"{p}_def" not in deviated.columns:
            deviated = deviated.withColumn(f"{p}_def", F.lit(None).cast("double"))
    features = cut(peers.car_features(cut(deviated), keys, order))
    z = peers.component_z(features, "case_id", "car", list(weights)).join(features.select(*keys, "n_valid"), keys)
    scored = z.withColumn("score", peers.weighted_score(z, weights, "n_valid"))
    return peers.rank_units(scored, "case_id", "car", "score").withColumnRenamed("case_id", "file_id")


# --- rail -----------------------------------------------------------------------------------------


def rail_channels(samples: DataFrame, speeds: DataFrame, unit: str = "recording_id", rate: float = RAIL_RATE, nperseg: int = RAIL_SEGMENT) -> DataFrame:
    """Channel table: time, frequency and wavelength features, one row per (recording, channel)."""
    keys = [unit, "k"]
    lines = cut(spectral.welch(samples, keys, "i", "x", rate, nperseg).join(speeds, unit))
    time = rail.channel_statistics(samples, keys)

    def banded(axis, bands, prefix: str, factor: int, compact) -> DataFrame:
        power = spectral.band_log_power(lines, keys, axis, bands)
        of_band = lambda lo, hi: F.max(F.when(F.col("band") == f"{lo:g}_{hi:g}", F.col("log_power")))
        named = lambda lo, hi: f"{prefix}_{int(round(lo * factor))}_{int(round(hi * factor))}"
        return power.groupBy(*keys).agg(*[
            rail.tagged(of_band(lo, hi), named(lo, hi), "band", *(["compact"] if compact(lo, hi) else [])) for lo, hi in bands])

    def marked(found: DataFrame, **tags: str) -> DataFrame:
        return found.select(*[rail.tagged(F.col(c), c, *tags[c].split()) if c in tags else F.col(c) for c in found.columns])

    parts = [
        banded(F.col("f"), spectral.FREQ_BANDS, "fb", 1, lambda lo, hi: 200 <= lo and hi <= 1600),
        banded(spectral.wavelength("speed"), spectral.LAMBDA_BANDS, "lb", 1000, lambda lo, hi: True),
        marked(spectral.dominant_wavelength(lines, keys, "speed"), dom_prom="shape compact"),
        marked(spectral.entropy_centroid(lines, keys), spec_entropy="shape compact", spec_centroid="shape"),
    ]
    table = time
    for part in parts:
        table = table.join(part, keys, "left")
    return (
        table.join(speeds, unit).withColumn("speed_bin", speed_bin("speed"))
        .withColumn("car", channel_car("k")).withColumn("side", channel_side("k")))


def rail_side_rows(channels: DataFrame, reference: DataFrame, unit: str = "recording_id") -> DataFrame:
    """Two rows per recording, own side against the other, from a channel table and a normal reference."""
    deviated = rail.with_reference_excess(channels, reference, REFERENCE_FEATURES)
    skip = {unit, "k", "car", "side", "speed", "speed_bin"}
    features = [c for c in deviated.columns if c not in skip]
    excess = [c for c in features if "excess" in rail.tags(deviated, c)]
    pairs = [c for c in features if {"band", "level", "shape"} & set(rail.tags(deviated, c))] + ["kurt", "crest", "shock_kurt"]
    rows = rail.side_table(deviated, [unit], features, excess, pairs, "ex_log_rms")
    speed = channels.groupBy(unit).agg(*[rail.tagged(F.max(c), c, "speed") for c in ("speed", "speed_bin")])
    return rows.join(speed, unit)


def predict_rail(side_scores: DataFrame, unit: str, tau: float = 0.20) -> DataFrame:
    """Label per recording from the probabilities (column p) of its two side rows."""
    at = lambda s: F.max(F.when(F.col("side") == s, F.col("p")))
    wide = side_scores.groupBy(unit).agg(at(1).alias("p1"), at(2).alias("p2"))
    return wide.select(F.col(unit).alias("file_id"), decide("p1", "p2", "global", tau).alias("prediction"))


# --- structural health ----------------------------------------------------------------------------


def damage_estimates(rows: DataFrame, scale: float, m: float = 5.0) -> DataFrame:
    """Fatigue damage of every series: S(m) / C."""
    order = Order(("recording_id",), "i")
    counted = fatigue.rainflow(rows, order, "stress")
    s = fatigue.damages(counted, ["recording_id"], {"damage": fatigue.Convention(m)})
    return s.select(F.col("recording_id").alias("file_id"), (F.col("damage") / float(scale)).alias("prediction"))
