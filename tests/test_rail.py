import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayside.functions.columns import channel_side, speed_bin, swap_sides
from wayside.operators import rail, spectral
from wayside.operators.ordered import Order


def welch(x, rate, n):
    """Independent density of one series: half-overlapping windows, mean removed."""
    n = min(n, len(x))
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    step = n // 2 if len(x) > n else n
    total, count = 0, 0
    for at in range(0, len(x) - n + 1, step):
        s = x[at:at + n]
        total = total + np.abs(np.fft.rfft((s - s.mean()) * w)) ** 2
        count += 1
    p = total / count / (rate * (w * w).sum())
    p[1:(n + 1) // 2] *= 2
    return np.arange(len(p)) * rate / n, p


@pytest.mark.parametrize("length, nperseg", [(1000, 128), (96, 32), (20, 64), (33, 64)])
def test_density_equals_numpy(spark, length, nperseg):
    rng = np.random.default_rng(length)
    series = {k: rng.normal(0, 1, length) + np.sin(np.arange(length) / (2 + k)) for k in range(3)}
    rows = pd.DataFrame([(k, i, v) for k, x in series.items() for i, v in enumerate(x)], columns=["k", "i", "x"])
    got = spectral.welch(spark.createDataFrame(rows).repartition(4), ["k"], "i", "x", 100.0, nperseg).orderBy("k", "f").toPandas()
    arrays = spark.createDataFrame([(k, x.tolist()) for k, x in series.items()], "k int, x array<double>")
    per_row = {r.k: r.psd for r in spectral.welch_arrays(arrays, "x", 100.0, nperseg).collect()}
    for k, x in series.items():
        f, p = welch(x, 100.0, nperseg)
        mine = got[got.k == k]
        assert np.allclose(mine.f, f) and np.allclose(mine.p, p) and np.allclose(per_row[k], p)


def test_odd_segments_are_rejected(frame):
    with pytest.raises(ValueError):
        spectral.welch(frame("k int, i long, x double", [(1, 0, 1.0)]), ["k"], "i", "x", 1.0, 33)


def test_power_pooling_keeps_antiphase_energy(spark):
    t = np.arange(512)
    tone = np.sin(2 * np.pi * t * 0.1)
    rows = [("r", 1, k, int(i), float(tone[i] * (1 if k else -1))) for k in (0, 1) for i in t]
    df = spark.createDataFrame(rows, "rec string, side int, k int, i int, x double")
    averaged = spectral.welch(spectral.averaged_waveforms(df, ["rec"]), ["rec", "side"], "i", "x", 100.0, 128)
    power = spectral.pooled(spectral.welch(df, ["rec", "side", "k"], "i", "x", 100.0, 128), ["rec", "side"])
    assert averaged.agg(F.sum("p")).first()[0] < 1e-20 < 1e-3 < power.agg(F.sum("p")).first()[0]


def test_cosine_without_pairs(spark):
    rng = np.random.default_rng(2)
    spectra = rng.random((8, 12))
    rows = [("r", 1, car, 100.0 + 50 * i, float(spectra[car, i]), 10.0) for car in range(8) for i in range(12)]
    df = spark.createDataFrame(rows, "rec string, side int, car int, f double, p double, speed double")
    u = spectra / np.linalg.norm(spectra, axis=1, keepdims=True)
    want = (u @ u.T)[np.triu_indices(8, 1)].mean()
    assert spectral.spectral_cosine(df, ["rec"], "speed").first().spectral_cosine_mean == pytest.approx(want)


def test_decimation_keeps_a_slow_tone_and_removes_a_fast_one(spark):
    n = np.arange(800)
    for period, kept in ((80, 0.99), (4.4, 0.01)):
        x = np.sin(2 * np.pi * n / period)
        df = spark.createDataFrame(pd.DataFrame(dict(k=1, i=n, n=len(n), x=x)))
        y = spectral.decimate(df, ["k"], "i", "x").orderBy("j").toPandas()
        middle = np.abs(y.y.to_numpy()[20:-20]).max()
        assert len(y) == 200 and (middle > kept if period > 10 else middle < kept)


def channel_frame(spark, swap=False):
    k = np.arange(64)
    side = k % 2 + 1 if not swap else 2 - k % 2
    rms = np.where(side == 1, 2.0, 1.0)
    data = pd.DataFrame(dict(
        rec=1, k=k, car=k // 8, side=k % 2 + 1, rms=rms, log_rms=np.log10(rms), shock_rms=rms / 2, ptp=rms * 3, speed=12.0, dom_lambda=0.1))
    return spark.createDataFrame(data)


def test_side_features_worked_numbers_and_swap(spark):
    for swap, first, second in ((False, 1, 2), (True, 2, 1)):
        c = channel_frame(spark, swap)
        dom = {r.side: r for r in rail.car_dominance(c, ["rec"], "speed").collect()}
        assert dom[first].car_diff_mean == pytest.approx(1) and dom[first].car_dom_count == 8
        assert dom[first].car_ratio_mean == pytest.approx(2) and dom[first].speednorm_rms == pytest.approx(2 / 13)
        assert dom[second].car_diff_mean == pytest.approx(-1) and dom[second].car_dom_count == 0 and dom[second].car_diff_pos_frac == 0
        assert dom[first].car_shock_diff_mean == pytest.approx(0.5)
        pair = {(r.side, r.feature): r["mean"] for r in rail.paired_positions(c, ["rec"], ["log_rms"]).collect()}
        assert pair[(first, "log_rms")] == pytest.approx(np.log10(2))
        wide = rail.side_aggregates(c, ["rec"], ["rms"])
        rows = {r.side: r for r in rail.own_other(wide, ["rec"], ["rms_mean"], ["rms_mean"]).collect()}
        assert rows[first].ratio_rms_mean == pytest.approx(1 / 3) and rows[second].ratio_rms_mean == pytest.approx(-1 / 3)
        design = rail.symmetric_design(rail.own_other(wide, ["rec"], ["rms_mean"]), ["rec"], ["own_rms_mean"]).first()
        assert (design.mean_own_rms_mean, design.absdiff_own_rms_mean) == (1.5, 1.0)
        agree = spectral.agreement(c, ["rec"]).collect()
        assert [r.agree for r in agree] == [1.0, 1.0]


def test_swapping_twice_is_the_identity(spark):
    df = spark.createDataFrame([([float(i) for i in range(64)],)], "v array<double>")
    got = df.select(swap_sides("v").alias("a"), swap_sides(swap_sides("v")).alias("b"), "v").first()
    assert got.a[:4] == [1.0, 0.0, 3.0, 2.0] and got.b == got.v


def test_geometry_and_speed_bins(frame):
    sides = {r.k: r.s for r in frame("k int", [(k,) for k in range(64)]).select("k", channel_side("k").alias("s")).collect()}
    assert sides == {k: 1 if (k % 8 + 1) in (1, 3, 5, 7) else 2 for k in range(64)}
    values = [-1.0, 0.0, 2.9, 3.0, 8.9, 9.0, 14.9, 15.0, 31.0]
    got = {r.v: r.b for r in frame("v double", [(v,) for v in values]).select("v", speed_bin("v").alias("b")).collect()}
    assert got == {v: int(np.clip(np.digitize(v, [0, 3, 6, 9, 12, 15, 30]) - 1, 0, 5)) for v in values}


def test_reference_falls_back_to_the_side(spark):
    rows = [(r, k, k % 2 + 1, 2 if r < 3 else 4, float(r + k)) for r in range(4) for k in range(8)]
    c = spark.createDataFrame(rows, "rec int, k int, side int, speed_bin int, log_rms double")
    reference = rail.speed_reference(c, F.col("rec") < 3, ["log_rms"])
    got = rail.with_reference_excess(c, reference, ["log_rms"]).toPandas()
    pool = np.array([v for r, _, s, _, v in rows if r < 3 and s == 1])
    med, iqr = np.median(pool), np.subtract(*np.percentile(pool, [75, 25])) + 1e-3
    far = got[(got.rec == 3) & (got.side == 1)]
    assert np.allclose(far.ex_log_rms, (far.log_rms - med) / iqr)


def test_column_sets_and_rejections(frame):
    made = {"rms_mean": ["single", "magnitude"], "log_rms_mean": ["single", "loudness", "compact"], "ex_log_rms_mean": ["single", "excess"],
            "pair_car_diff_mean": ["pair", "car"], "pair_rms_p90": ["pair"]}
    wide = frame("rec int, " + ", ".join(f"s{s}_{b} double" for b in made for s in (1, 2)), [(1, *map(float, range(10)))])
    wide = wide.select("rec", *[rail.tagged(F.col(f"s{s}_{b}"), f"s{s}_{b}", *t) for b, t in made.items() for s in (1, 2)])
    rows = rail.own_other(wide, ["rec"])
    rows = rows.select("*", rail.tagged(F.lit(9.0), "speed", "speed"))
    sets = {name: set(rail.column_set(rows, name)) for name in rail.COLUMN_SETS}
    assert sets["own"] == {f"own_{b}" for b in made} | {"speed"}
    assert sets["relative"] == {f"rel_{b}" for b in made} | {"speed"} and sets["all"] == set(rows.columns)
    assert sets["excess"] == {"own_ex_log_rms_mean", "rel_ex_log_rms_mean", "speed"}
    assert sets["with_ratios"] - sets["unpaired"] == {"ratio_rms_mean", "side"}
    assert sets["with_cars"] - sets["unpaired"] == {"own_pair_car_diff_mean", "rel_pair_car_diff_mean"}
    assert {"own_log_rms_mean", "own_pair_rms_p90", "ratio_rms_mean"} <= sets["paired"] and "own_rms_mean" not in sets["paired"]
    assert "rel_log_rms_mean" in sets["compact"] and "own_rms_mean" not in sets["compact"]
    df = frame("speed double, x double", [(1.0, 2.0), (None, float("nan")), (3.0, float("inf"))])
    assert rail.without(df, ["speed"]).columns == ["x"]
    with pytest.raises(ValueError):
        rail.without(df, ["speed", "nothing"])
    filled = sorted((r.speed, r.x) for r in rail.design(df, ["speed", "x"]).collect())
    assert filled == [(-9.0, -9.0), (1.0, 2.0), (3.0, 1e6)]


def test_stationary_pulse_and_speed_formulas(frame):
    order = Order(("rec",), "i", (), 3)
    square = [(1, i, i % 2) for i in range(100)] + [(2, i, 1) for i in range(100)]
    got = {r.rec: r for r in rail.pulse_speeds(frame("rec int, i long, pulse int", square), order, "pulse", 100.0).collect()}
    assert got[1].speed == pytest.approx(99 / 180 * np.pi * 0.85) and got[1].rising_speed == pytest.approx(50 / 90 * np.pi * 0.85)
    assert got[2].speed == 0
    lines = frame("rec int, f double, p double, speed double", [(1, 100.0, 1.0, 0.5), (1, 200.0, 2.0, 0.5)])
    assert spectral.dominant_wavelength(lines, ["rec"], "speed").count() == 0


def test_density_of_recordings_with_holes(spark):
    """Only whole segments count; a short recording with a hole has no spectrum, a long one with a hole at its start has."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=900)
    keep = {"hole": [i for i in range(900) if i != 40], "short": range(50), "short hole": [i for i in range(50) if i != 7], "far": range(700, 900),
            "late": [*range(20), *range(600, 900)]}
    rows = pd.DataFrame([(k, i, x[i]) for k, at in keep.items() for i in at], columns=["k", "i", "x"])
    got = spectral.welch(spark.createDataFrame(rows).repartition(5), ["k"], "i", "x", 100.0, 64).orderBy("k", "f").toPandas()
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(64) / 64)
    for k in ("hole", "far", "late"):
        parts = [x[s:s + 64] for s in range(0, 900 - 63, 32) if set(range(s, s + 64)) <= set(keep[k])]
        power = np.mean([np.abs(np.fft.rfft((p - p.mean()) * window)) ** 2 for p in parts], axis=0) / (100.0 * (window**2).sum())
        power[1:32] *= 2
        assert np.allclose(got[got.k == k].p, power)
    assert len(got[got.k == "short"]) == 26 and "short hole" not in set(got.k)


def test_side_table_knows_pairs_cars_and_agreement(spark):
    c = channel_frame(spark)
    tagged = c.select("rec", "k", "car", "side", "speed", "dom_lambda", rail.tagged(F.col("rms"), "rms", "magnitude"),
                      rail.tagged(F.col("log_rms"), "log_rms", "level", "compact", "loudness"), "shock_rms", "ptp",
                      rail.tagged(F.col("log_rms") * 10, "ex_log_rms", "excess", "compact"))
    rows = rail.side_table(tagged, ["rec"], ["rms", "log_rms", "ex_log_rms"], ["ex_log_rms"], ["log_rms"], "ex_log_rms")
    got = {r.side: r for r in rows.collect()}
    assert got[1].own_agree == 1.0 and got[1].own_pair_log_rms_mean == pytest.approx(np.log10(2)) and got[2].rel_pair_car_diff_mean == pytest.approx(-2)
    assert got[1].ratio_rms_max == pytest.approx(1 / 3) and "ratio_rms_std" not in rows.columns and "ratio_log_rms_mean" not in rows.columns
    sets = {name: set(rail.column_set(rows, name)) for name in rail.COLUMN_SETS}
    assert {"own_pair_log_rms_median", "rel_log_rms_mean", "ratio_rms_mean"} <= sets["paired"]
    assert {"own_pair_car_ratio_max", "rel_pair_speednorm_rms"} <= sets["with_cars"] and not any("pair" in x for x in sets["unpaired"])
    assert {"own_log_rms_mean", "rel_ex_log_rms_mean", "own_pair_log_rms_p90"} <= sets["compact"] and "own_log_rms_std" not in sets["compact"]
    assert sets["excess"] == {f"{p}_ex_log_rms_{s}" for p in ("own", "rel") for s in ("mean", "max", "p75", "std", "nover2")}
