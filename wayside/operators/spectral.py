"""Spectra of segmented recordings.

A recording is cut into chunks of overlapping segments; chunks are the unit of work, so a long recording spreads over the
cluster. Samples travel packed into arrays, and a chunk hands on one array of summed densities.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayside.session import cut

# Analysis bands in Hz and m.
FREQ_BANDS = ((20, 50), (50, 100), (100, 200), (200, 400), (400, 800), (800, 1600), (1600, 3200), (3200, 5000))
LAMBDA_BANDS = ((0.025, 0.05), (0.05, 0.08), (0.08, 0.125), (0.125, 0.2), (0.2, 0.315), (0.315, 0.5), (0.5, 1.0))
SIDE_BANDS = (("low", 10, 100), ("mid1", 100, 300), ("corrug_classic", 300, 600), ("corrug_high", 600, 1200), ("impact", 1200, 3000))
TEMPORAL_BANDS = ((20, 100), (100, 300), (300, 600), (600, 1200))
TINY, MOVING = 1e-15, 1.0


def _densities(block: np.ndarray, rate: float) -> np.ndarray:
    """One-sided power density of the rows of ``block``: mean removed, periodic Hann window."""
    n = block.shape[1]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n) if n > 1 else np.ones(1)
    power = np.abs(np.fft.rfft((block - block.mean(axis=1, keepdims=True)) * window, axis=1)) ** 2
    power /= rate * (window**2).sum()
    power[:, 1 : (n + 1) // 2] *= 2
    return power


HALVES = 64  # half segments of a chunk


def _chunk_powers(keys: Sequence[str], rate: float, nperseg: int):
    """Arrow pass over chunks (keys, chunk, samples): summed densities of the whole segments that begin in a chunk.

    A segment with a missing sample is left out. A first chunk that holds fewer samples than a segment, without a hole, may be
    a whole short recording: its density is given too, marked as short.
    """
    half = nperseg // 2
    width = HALVES * half
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, segments, shorts, powers = [], [], [], []
            for chunk, packed in zip(batch.column(n_keys).to_pylist(), batch.column(n_keys + 1), strict=True):
                at = packed.values.field("_i").to_numpy(zero_copy_only=False) - chunk * width
                x = packed.values.field("_x").to_numpy(zero_copy_only=False).astype(np.float64)
                dense = np.full(width + half, np.nan)
                dense[at] = x
                cut_up = np.lib.stride_tricks.sliding_window_view(dense, nperseg)[::half][:HALVES]
                whole = cut_up[~np.isnan(cut_up).any(axis=1)]
                short = chunk == 0 and 0 < len(at) < nperseg and at.max() == len(at) - 1 and not np.isnan(x).any()
                block = dense[None, :len(at)] if short else whole
                lengths.append(block.shape[1])
                segments.append(len(block))
                shorts.append(short)
                powers.append(_densities(block, rate).sum(axis=0) if len(block) else np.empty(0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n_keys], pa.array(lengths, pa.int32()), pa.array(segments, pa.int32()), pa.array(shorts, pa.bool_()),
                 pa.array(powers, pa.list_(pa.float64()))],
                names=[*keys, "_n", "_segments", "_short", "_p"])

    return run


def welch(samples: DataFrame, keys: Sequence[str], index: str, value: str, rate: float, nperseg: int) -> DataFrame:
    """Averaged power density (columns f, p) of long-form samples, per ``keys``.

    Samples gather into chunks of HALVES half segments, packed into arrays by each task before they are exchanged; the half
    segment that two chunks share goes to both. Half-overlapping segments are transformed and summed inside a chunk, so what
    is left is one array of lines per chunk. Segments with a missing sample are left out; a recording shorter than one
    segment becomes a single shorter segment, unless samples are missing in it.
    """
    if nperseg % 2:
        raise ValueError("segments overlap by half, so their length must be even")
    half = nperseg // 2
    width = HALVES * half
    i = F.col("_i")
    own = F.floor(i / width).cast("long")
    shared = (i % width < half) & (own > 0)
    given = list(keys)
    slim = samples.select(*given, F.col(index).cast("long").alias("_i"), F.col(value).cast("double").alias("_x"))
    spread = slim.select("*", F.explode(F.when(shared, F.array(own, own - 1)).otherwise(F.array(own))).alias("_chunk"))
    packed = spread.groupBy(*given, "_chunk").agg(F.collect_list(F.struct("_i", "_x")).alias("_s"))
    fields = ", ".join(f"`{c}` {packed.schema[c].dataType.simpleString()}" for c in given)
    schema = f"{fields}, _n int, _segments int, _short boolean, _p array<double>"
    powers = cut(packed.select(*given, "_chunk", "_s").mapInArrow(_chunk_powers(given, rate, nperseg), schema))
    alone = powers.groupBy(*given).agg(F.count(F.lit(1)).alias("_chunks")).where("_chunks = 1").drop("_chunks")
    used = powers.where("NOT _short").unionByName(powers.where("_short").join(alone, given, "left_semi"))
    lines = used.where("_segments > 0").select(*given, "_n", "_segments", F.posexplode("_p").alias("_k", "_v"))
    frequency = (F.col("_k") * F.lit(float(rate)) / F.col("_n")).alias("f")
    return lines.groupBy(*given, frequency).agg((F.sum("_v") / F.sum("_segments")).alias("p"))


def welch_arrays(rows: DataFrame, value: str, rate: float, nperseg: int, name: str = "psd") -> DataFrame:
    """Welch density of a recording kept as one bounded array per row: no shuffle at all."""
    half = nperseg // 2

    @F.pandas_udf("array<double>")
    def density(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            out = []
            for x in series:
                x = np.asarray(x, dtype=float)
                size = min(nperseg, len(x))
                step = half if len(x) >= nperseg else size
                segments = np.lib.stride_tricks.sliding_window_view(x, size)[::step]
                out.append(_densities(segments, rate).mean(axis=0))
            yield pd.Series(out)

    return rows.withColumn(name, density(F.col(value)))


def band_of(f: Column, bands: Sequence[tuple[float, float]]) -> Column:
    """Label 'lo_hi' of the half-open band that holds a value; NULL outside all bands."""
    out = F.lit(None).cast("string")
    for lo, hi in reversed(bands):
        out = F.when((f >= lo) & (f < hi), F.lit(f"{lo:g}_{hi:g}")).otherwise(out)
    return out


def band_log_power(psd: DataFrame, keys: Sequence[str], axis: Column, bands) -> DataFrame:
    """Mean of the log power over each band."""
    return (
        psd.withColumn("band", band_of(axis, bands)).where(F.col("band").isNotNull())
        .groupBy(*keys, "band").agg(F.avg(F.log10(F.col("p") + TINY)).alias("log_power")))


def band_power(psd: DataFrame, keys: Sequence[str], bands) -> DataFrame:
    """Sum of the power over each band."""
    return (
        psd.withColumn("band", band_of(F.col("f"), bands)).where(F.col("band").isNotNull())
        .groupBy(*keys, "band").agg(F.sum("p").alias("power")))


def wavelength(speed: str) -> Column:
    """Wavelength of a spectral line; only defined for a moving train and a positive frequency."""
    return F.when((F.col(speed) > MOVING) & (F.col("f") > 0), F.col(speed) / F.col("f"))


def dominant_wavelength(psd: DataFrame, keys: Sequence[str], speed: str, low: float = 0.025, high: float = 1.0) -> DataFrame:
    """Strongest wavelength in the corrugation range and how far it stands out of the median line, per channel."""
    lines = psd.withColumn("_lam", wavelength(speed)).where((F.col("_lam") >= low) & (F.col("_lam") < high))
    return lines.groupBy(*keys).agg(
        F.max_by("_lam", F.struct("p", "_lam")).alias("dom_lambda"),
        (F.log10(F.max("p") + TINY) - F.log10(F.percentile("p", F.lit(0.5)) + TINY)).alias("dom_prom"))


def entropy_centroid(psd: DataFrame, keys: Sequence[str], low: float = 20, high: float = 2000) -> DataFrame:
    """Spectral entropy and centroid of the normalised power. A spectrum has a fixed number of lines."""
    lines = psd.where((F.col("f") >= low) & (F.col("f") < high))
    share = F.col("p") / (F.sum("p").over(Window.partitionBy(*keys)) + TINY)
    return lines.withColumn("_q", share).groupBy(*keys).agg(
        (-F.sum(F.col("_q") * F.ln(F.col("_q") + TINY))).alias("spec_entropy"), F.sum(F.col("f") * F.col("_q")).alias("spec_centroid"))


def side_spectrum_features(psd: DataFrame, unit: Sequence[str], bands=SIDE_BANDS) -> DataFrame:
    """Band sums of both sides with ratio, difference and sum, peak frequency and centroid, one row per recording."""
    s, f, p = F.col("side"), F.col("f"), F.col("p")
    aggs = []
    for name, lo, hi in bands:
        aggs += [F.coalesce(F.sum(F.when((s == k) & (f >= lo) & (f < hi), p)), F.lit(0.0)).alias(f"psd_s{k}_{name}") for k in (1, 2)]
    for k in (1, 2):
        on = F.when(s == k, p)
        aggs += [
            F.max_by("f", F.struct(on, -f)).alias(f"peak_freq_s{k}"),
            (F.sum(f * on) / (F.sum(on) + 1e-9)).alias(f"spec_centroid_s{k}")]
    wide = psd.groupBy(*unit).agg(*aggs)
    more = []
    for name, _, _ in bands:
        a, b = F.col(f"psd_s1_{name}"), F.col(f"psd_s2_{name}")
        more += [(a / (b + 1e-9)).alias(f"psd_ratio_{name}"), (a - b).alias(f"psd_diff_{name}"), (a + b).alias(f"psd_sum_{name}")]
    more.append((F.col("spec_centroid_s1") - F.col("spec_centroid_s2")).alias("spec_centroid_diff"))
    return wide.select("*", *more)


def averaged_waveforms(samples: DataFrame, unit: Sequence[str]) -> DataFrame:
    """Mean of a side's channels per sample (phases may cancel)."""
    return samples.groupBy(*unit, "side", "i").agg(F.avg("x").alias("x"))


def pooled(psd: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean power over channels per line (phases cannot cancel)."""
    return psd.groupBy(*keys, "f").agg(F.avg("p").alias("p"))


def _five(prefix: str, c: str) -> list[Column]:
    return [
        F.avg(c).alias(f"{prefix}_mean"), F.stddev_pop(c).alias(f"{prefix}_std"), F.min(c).alias(f"{prefix}_min"),
        F.max(c).alias(f"{prefix}_max"), F.percentile(c, F.lit(0.5)).alias(f"{prefix}_median")]


def cross_car(car_psd: DataFrame, unit: Sequence[str], bands=FREQ_BANDS) -> DataFrame:
    """Consistency of band power along the train, one row per (recording, side, band). A train has eight cars."""
    power = band_power(car_psd, [*unit, "car", "side"], bands).withColumn("_l", F.log10(F.col("power") + TINY))
    at = lambda s: F.max(F.when(F.col("side") == s, F.col("_l")))
    wide = power.groupBy(*unit, "band", "car").agg(at(1).alias("_1"), at(2).alias("_2"))
    view = lambda s, a, b: F.struct(F.lit(s).alias("side"), F.col(a).alias("own"), (F.col(a) - F.col(b)).alias("delta"))
    rows = wide.select(*unit, "band", "car", F.inline(F.array(view(1, "_1", "_2"), view(2, "_2", "_1"))))
    step = F.abs(F.col("own") - F.lag("own").over(Window.partitionBy(*unit, "band", "side").orderBy("car")))
    return rows.withColumn("_step", step).groupBy(*unit, "side", "band").agg(
        *_five("power", "own"), *_five("bilateral", "delta"),
        F.avg((F.col("delta") > 0).cast("double")).alias("positive_fraction"), F.avg("_step").alias("adjacent_difference"))


def spectral_cosine(car_psd: DataFrame, unit: Sequence[str], speed: str, low: float = 20, high: float = 2000) -> DataFrame:
    """Mean pairwise cosine similarity of the cars' spectra, spread of peak frequency and wavelength.

    The sum over all pairs is (|Σu|² − Σ|u|²) / 2 for the normalised spectra u, so no pair is ever formed.
    """
    keys = [*unit, "side"]
    lines = car_psd.where((F.col("f") >= low) & (F.col("f") < high))
    norm = F.sqrt(F.sum(F.col("p") * F.col("p")).over(Window.partitionBy(*keys, "car"))) + TINY
    u = lines.withColumn("_u", F.col("p") / norm)
    per_line = u.groupBy(*keys, "f").agg(
        F.sum("_u").alias("_sum"), F.sum(F.col("_u") * F.col("_u")).alias("_sq"), F.count(F.lit(1)).alias("_cars"))
    n = F.max("_cars")
    cosine = per_line.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("_sum") * F.col("_sum")) - F.sum("_sq"), n * (n - 1)).alias("spectral_cosine_mean"))
    peaks = lines.groupBy(*keys, "car").agg(
        F.max_by("f", F.struct("p", -F.col("f"))).alias("_peak"), F.max(speed).alias("_v")
    ).withColumn("_lam", F.col("_v") / F.greatest(F.col("_peak"), F.lit(1.0)))
    spread = peaks.groupBy(*keys).agg(
        F.stddev_pop("_peak").alias("peak_frequency_std"), F.percentile("_peak", F.lit(0.5)).alias("peak_frequency_median"),
        F.stddev_pop("_lam").alias("wavelength_std"), F.percentile("_lam", F.lit(0.5)).alias("wavelength_median"))
    return cosine.join(spread, keys)


def _matrix_statistics(rows: DataFrame, keys: Sequence[str], value: str, tag: str) -> DataFrame:
    """Statistics of a cars × windows matrix in long form (eight cars, a few windows)."""
    car = rows.groupBy(*keys, "car").agg(F.stddev_pop(value).alias("_s"), (F.max(value) - F.avg(value)).alias("_e"))
    per_car = car.groupBy(*keys).agg(F.avg("_s").alias("car_temporal_std_mean"), F.avg("_e").alias("car_peak_excess_mean"))
    window = rows.groupBy(*keys, "w").agg(F.avg(value).alias("_m")).groupBy(*keys).agg(F.stddev_pop("_m").alias("window_car_mean_std"))
    whole = rows.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.percentile(value, F.lit(0.9)).alias("p90"),
        F.max(value).alias("max"), F.min(value).alias("min"))
    return whole.join(per_car, list(keys)).join(window, list(keys)).withColumn("source", F.lit(tag))


def temporal_variation(window_psd: DataFrame, unit: Sequence[str], bands=TEMPORAL_BANDS) -> tuple[DataFrame, DataFrame]:
    """How band power varies over consecutive windows: matrix statistics of the own side and of own − other, and the
    shares of positive differences. Input: one spectrum per (recording, channel, window) with car and side."""
    cars = pooled(window_psd, [*unit, "car", "side", "w"])
    power = band_power(cars, [*unit, "car", "side", "w"], bands)
    level = power.withColumn("_l", F.log10(F.greatest(F.col("power"), F.lit(TINY))))
    at = lambda s: F.max(F.when(F.col("side") == s, F.col("_l")))
    wide = level.groupBy(*unit, "band", "car", "w").agg(at(1).alias("_1"), at(2).alias("_2"))
    view = lambda s, a, b: F.struct(F.lit(s).alias("side"), F.col(a).alias("own"), (F.col(a) - F.col(b)).alias("rel"))
    rows = wide.select(*unit, "band", "car", "w", F.inline(F.array(view(1, "_1", "_2"), view(2, "_2", "_1"))))
    keys = [*unit, "side", "band"]
    stats = _matrix_statistics(rows, keys, "own", "own").unionByName(_matrix_statistics(rows, keys, "rel", "relative"))
    positive = (F.col("rel") > 0).cast("double")
    share = rows.groupBy(*keys, "w").agg(F.avg(positive).alias("_p"))
    shares = share.groupBy(*keys).agg(
        F.avg("_p").alias("positive_fraction_mean"), F.stddev_pop("_p").alias("positive_fraction_std"), F.max("_p").alias("positive_fraction_max"))
    return stats, shares


def spectral_moments(psd: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Irregularity, zero-crossing and peak rates from the spectral moments."""
    f, p = F.col("f"), F.col("p")
    m = psd.groupBy(*keys).agg(
        F.sum(p).alias("m0"), F.sum(f * f * p).alias("m2"), F.sum(f * f * f * f * p).alias("m4"))
    return m.select(
        *keys, (F.col("m2") / (F.sqrt(F.col("m0") * F.col("m4")) + 1e-8)).alias("spec_alpha2"),
        F.sqrt(F.col("m2") / (F.col("m0") + 1e-8)).alias("spec_zero_crossing"),
        F.sqrt(F.col("m4") / (F.col("m2") + 1e-8)).alias("spec_peak_rate"))


def low_pass_taps(factor: int = 4, beta: float = 5.0) -> list[float]:
    """Kaiser-windowed sinc, ten lobes a side, cut-off at the new Nyquist rate, unit gain at zero."""
    half = 10 * factor
    n = np.arange(-half, half + 1)
    taps = np.sinc(n / factor) / factor * np.kaiser(2 * half + 1, beta)
    return [float(t) for t in taps / taps.sum()]


def decimate(samples: DataFrame, keys: Sequence[str], index: str, value: str, factor: int = 4) -> DataFrame:
    """Low-pass filter and keep every ``factor``-th sample. Each sample adds its weighted share to the outputs within
    reach of the filter, so the sum spreads by (recording, output) and combines map-side."""
    taps = low_pass_taps(factor)
    half = len(taps) // 2
    last = F.ceil(F.col("_n") / factor) - 1
    reach = F.sequence(
        F.greatest(F.ceil((F.col(index) - half) / factor), F.lit(0)).cast("long"),
        F.least(F.floor((F.col(index) + half) / factor), last).cast("long"))
    spread = samples.withColumnRenamed("n", "_n").select(*keys, index, value, F.explode(reach).alias("j"))
    tap = F.element_at(F.array(*[F.lit(t) for t in taps]), (F.col("j") * factor - F.col(index) + half + 1).cast("int"))
    return spread.groupBy(*keys, "j").agg(F.sum(F.col(value) * tap).alias("y"))


def normalise(samples: DataFrame, keys: Sequence[str], value: str, name: str = "z") -> DataFrame:
    """Subtract the mean and divide by the deviation (at least 1e-6) of each recording."""
    stats = samples.groupBy(*keys).agg(F.avg(value).alias("_m"), F.greatest(F.stddev_pop(value), F.lit(1e-6)).alias("_s"))
    joined = samples.join(stats, list(keys))
    return joined.withColumn(name, (F.col(value) - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def class_spectra(psd: DataFrame, unit: Sequence[str], label: str, bands=FREQ_BANDS) -> DataFrame:
    """Mean log spectrum of each class, side and band, over the recordings of the class."""
    side = pooled(psd, [*unit, label, "side"])
    level = side.withColumn("band", band_of(F.col("f"), bands)).where(F.col("band").isNotNull())
    return level.groupBy(label, "side", "band").agg(F.avg(F.log10(F.col("p") + 1e-12)).alias("log_power"), F.count(F.lit(1)).alias("n"))


def agreement(channels: DataFrame, unit: Sequence[str], value: str = "dom_lambda") -> DataFrame:
    """Share of a side's channels within 10 % of their median; NULL with two values or fewer."""
    keys = [*unit, "side"]
    known = channels.where(F.col(value).isNotNull())
    mid = known.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("_m"), F.count(F.lit(1)).alias("_n"))
    near = (F.col(value) > 0.9 * F.col("_m")) & (F.col(value) < 1.1 * F.col("_m"))
    return known.join(mid, keys).groupBy(*keys).agg(
        F.when(F.max("_n") > 2, F.avg(near.cast("double"))).alias("agree"), F.max("_n").alias("n"))
