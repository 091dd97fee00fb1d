from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayside.functions.columns import natural_key
from wayside.operators import contracts, history, models, ordered, peers, rail
from wayside.operators.ordered import Order
from wayside.plans import subsystems
from wayside.sources import recordings, sinks, telemetry


def native(us):
    t = pd.Timestamp("2023-07-05") + pd.Timedelta(us, "us")
    return f"{t.year}-{t.month}-{t.day}-{t.hour}-{t.minute}-{t.second}-{t.microsecond // 1000}"


def door_file(path, cycles=24, rows=40, seed=0):
    """Opening and closing cycles every 20 s; every fourth draws far more current."""
    rng = np.random.default_rng(seed)
    lines, answers = [], []
    for c in range(cycles):
        start = c * 20_000_000
        bad = c % 4 == 3
        for i in range(rows):
            lines.append([native(start + i * 20_000), (600 if bad else 200) + rng.integers(0, 20), 240, 100 + i, 8, 8, 0, 1, 0, 0, 0, 0, 0, 0, 1, 0,
                          i * 10 if c % 2 else (rows - i) * 10])
        answers.append((f"{path.name}", start, "Abnormal resistance" if bad else "Normal"))
    pd.DataFrame(lines, columns=[f"column {i}" for i in range(17)]).to_csv(path, index=False)
    return answers


@pytest.fixture
def folder(tmp_path):
    return tmp_path


def test_door_from_file_to_predictions(spark, folder):
    answers = door_file(folder / "door.csv")
    rows = recordings.read_door(spark, str(folder / "door.csv"))
    first = rows.orderBy("seq").first()
    assert rows.count() == 960 and first.stream_id == "door.csv" and first.dcsr == 0 and first.ts.year == 2023
    segmented, order = subsystems.door_cycles(rows)
    table = subsystems.door_table(segmented, order)
    base = pd.Timestamp("2023-07-05").value // 1000
    known = spark.createDataFrame([(f, base + s, y) for f, s, y in answers], "stream_id string, start_us long, status string")
    labelled = table.join(known, ["stream_id", "start_us"])
    assert labelled.count() == 24
    model = subsystems.train_door(labelled, trees=10)
    got = subsystems.predict_door(table, model)
    want = {native(s): y for _, s, y in answers}
    assert {r.start_time: r.prediction for r in got.collect()} == want
    assert models.importances(model.forest, model.inputs).keys() == set(model.inputs)
    assert {"cur_mean", "prof_0", "z_19", "pos_start"} <= set(model.inputs) and not {"segment_id", "start_us"} & set(model.inputs)
    sinks.write_predictions(got, "door", str(folder / "out"))
    back = sinks.read_predictions(spark, str(folder / "out"), "door")
    assert back.count() == 24 and back.columns == ["start_time", "end_time", "prediction"]
    assert contracts.violations(back, ["start_time"], contracts.door_rules("start_time", "end_time")).where("rule <> 'order'").count() == 0


def test_wrong_width_is_rejected(spark, folder):
    """Also beside a good file, whichever is listed first."""
    door_file(folder / "m.csv")
    for bad in ("a.csv", "z.csv"):
        pd.DataFrame([[1, 2]]).to_csv(folder / bad, index=False)
        for reader in (recordings.read_door, recordings.read_rail):
            with pytest.raises(ValueError, match=bad):
                reader(spark, [str(folder / "m.csv"), str(folder / bad)])


def test_telemetry_headers_differ_by_file(spark, folder):
    """Columns in another order, other parameters, other cars: every reading keeps its role."""
    at = "2024-05-01 00:00:00"
    pd.DataFrame([[at, 21.0, 35.0]], columns=["Time", "Car 01 - Indoor Temperature", "Car 01 - Outdoor Temperature"]).to_csv(folder / "a.csv", index=False)
    pd.DataFrame([[36.0, at, 22.0]], columns=["Car 01 - Outdoor Temperature", "Time", "Car 01 - Indoor Temperature"]).to_csv(folder / "b c.csv", index=False)
    pd.DataFrame([[at, "x", 23.0]], columns=["Time", "Car 03 - Running Mode", "Car 03 - Cabin detected temperature"]).to_csv(folder / "c.csv", index=False)
    rows = recordings.read_telemetry(spark, str(folder)).collect()
    got = {r.case_id.replace("%20", " "): (r.car, r.t_in, r.t_out, r.mode_run) for r in rows}
    assert got == {"a.csv": ("01", 21.0, 35.0, None), "b c.csv": ("01", 22.0, 36.0, None), "c.csv": ("03", 23.0, None, "x")}


def test_natural_order_of_any_names(frame):
    names = ["a2", "b1", "a10", "a1", "plain", "", "a" + "9" * 30, "a1" + "0" * 30, "a002", "x1y10", "x1y9"]
    df = frame("s string", [(n,) for n in names])
    want = ["", "a1", "a002", "a2", "a10", "a" + "9" * 30, "a1" + "0" * 30, "b1", "plain", "x1y9", "x1y10"]
    assert [r.s for r in df.orderBy(natural_key("s")).collect()] == want
    assert df.select(natural_key("s")).distinct().count() == len(names)
    placed = ordered.places(df.withColumn("g", F.lit(1)), ["g"], [natural_key("s")])
    assert [r.s for r in placed.orderBy("place").collect()] == want


def test_listing_orders(frame):
    rows = [("b1", 0.001, "Normal"), ("a2", 0.004, "Side I"), ("a10", 0.004, "Normal"), ("none", None, "Side I"), ("a1", 12.5, "Side II")]
    df = frame("file_id string, damage double, prediction string", rows)
    order = lambda by: [r.file_id for r in history.listing(df, "", None, by).orderBy("place").collect()]
    assert order("damage") == ["a1", "a2", "a10", "b1", "none"]
    assert order("file") == ["a1", "a2", "a10", "b1", "none"]
    assert order("Side I") == ["a2", "none", "a1", "a10", "b1"]
    turned = lambda by: [r.file_id for r in history.listing(df, "", None, by, True).orderBy("place").collect()]
    assert turned("damage") == ["b1", "a2", "a10", "a1", "none"] and turned("file") == order("file")[::-1]
    assert [r.place for r in history.listing(df, "A1", "Normal").collect()] == [1]


def rail_file(path, side, seed, rows=512):
    rng = np.random.default_rng(seed)
    t = np.arange(rows)
    names, data = ["Rotating speed"], [(t // 2) % 2]
    for car in range(1, 9):
        for position in range(1, 9):
            x = rng.normal(0, 0.1, rows)
            if side == (1 if position % 2 else 2):
                x += np.sin(2 * np.pi * 400 * t / 10_000)
            names += [f"Vibration of bearing in position {position} of car {car}", f"Shock of bearing in position {position} of car {car}"]
            data += [x, np.abs(x)]
    pd.DataFrame(np.column_stack(data), columns=names).to_csv(path, index=False)


def test_rail_from_files_to_side_rows(spark, folder):
    for n, side in enumerate([0, 1, 2, 0, 0]):
        rail_file(folder / f"Train{n}.csv", side, n)
    read = recordings.read_rail(spark, str(folder / "Train*.csv"))
    one = read.where("recording_id = 'Train1.csv'").orderBy("i").toPandas()
    raw = pd.read_csv(folder / "Train1.csv").to_numpy()
    assert np.array_equal(one.i, np.arange(512)) and np.allclose(np.stack(one.vib), raw[:, 1::2]) and np.allclose(np.stack(one.shock), raw[:, 2::2])
    order = Order(("recording_id",), "i")
    speeds = rail.pulse_speeds(read.select("recording_id", "i", "pulse"), order, "pulse", 10_000.0).select("recording_id", "speed")
    channels = subsystems.rail_channels(recordings.rail_samples(read), speeds, nperseg=256).cache()
    assert channels.count() == 5 * 64
    normal = ~F.col("recording_id").isin("Train1.csv", "Train2.csv")
    reference = rail.speed_reference(channels, normal, subsystems.REFERENCE_FEATURES)
    rows = subsystems.rail_side_rows(channels, reference)
    power = {(r.recording_id, r.side): r.rel_ex_fb_400_800_mean for r in rows.collect()}
    assert power[("Train1.csv", 1)] > 2 > -2 > power[("Train1.csv", 2)] and power[("Train2.csv", 2)] > 2
    scored = rows.select("recording_id", "side", F.when(F.col("rel_ex_fb_400_800_mean") > 2, 0.9).otherwise(0.1).alias("p"))
    got = {r.file_id: r.prediction for r in subsystems.predict_rail(scored, "recording_id", 0.5).collect()}
    assert got == {"Train0.csv": "Normal", "Train1.csv": "Side I", "Train2.csv": "Side II", "Train3.csv": "Normal", "Train4.csv": "Normal"}


def test_stress_series_in_file_order(spark, folder):
    series = {f"train{n}.csv": np.array([0.0, 1, 0, -1, 0] * 200) * (1 + n) for n in range(3)}
    for name, x in series.items():
        pd.Series(x).to_csv(folder / name, header=False, index=False)
    read = recordings.read_series(spark, str(folder / "train*.csv"))
    for name, x in series.items():
        assert np.array_equal(read.where(F.col("recording_id") == name).orderBy("i").toPandas().stress, x)
    got = {r.file_id: r.prediction for r in subsystems.damage_estimates(read, scale=1e3).collect()}
    assert got["train1.csv"] == pytest.approx(got["train0.csv"] * 2**5) and got["train0.csv"] == pytest.approx(0.2, rel=0.02)


def test_telemetry_roles_masks_and_ranking(spark, folder):
    rng = np.random.default_rng(3)
    times = pd.date_range("2024-05-01", periods=120, freq="30s").astype(str)
    data = {"car model": "M", "train number": 7, "Time": times}
    for car in range(1, 9):
        data[f"Car {car:02d} - Indoor Temperature"] = np.round(24 + rng.normal(0, 0.1, 120) + (3 if car == 5 else 0), 2)
        data[f"Car {car:02d} - Control Temperature Cooling"] = 24.0
        data[f"Car {car:02d} - Outdoor Temperature"] = 33.0
        data[f"Car {car:02d} - Running Mode"] = " Full cooling"
        data[f"Car {car:02d} - Information Valid"] = np.where(np.arange(120) == 5, "Invalid", "Valid")
    frame = pd.DataFrame(data)
    frame.loc[3, "Car 02 - Indoor Temperature"] = 0.0
    frame["Car 02 - Indoor Temperature"] = frame["Car 02 - Indoor Temperature"].astype(object)
    frame.loc[4, "Car 02 - Indoor Temperature"] = "n/a"
    frame.to_csv(folder / "case.csv", index=False)
    long = recordings.read_telemetry(spark, str(folder / "case.csv"))
    assert long.count() == 960 and long.where("t_in IS NULL").count() == 8 + 2
    assert long.where("car = '02' AND t_set_cool IS NULL").count() == 1
    got = subsystems.rank_cars(long).first()
    assert got.file_id == "case.csv" and got.ranked_cars.startswith("05|") and len(got.ranked_cars.split("|")) == 8
    ok = contracts.violations(subsystems.rank_cars(long), ["file_id"], contracts.ranking_rules())
    assert ok.count() == 0


def test_header_rules():
    cars, roles = telemetry.header_roles([
        "Time", "Car 02 - Cabin detected temperature", "Car 01 - Target temperature value", "Car 01 - System 1 High Pressure", "Car 01 - Indoor temp 2"])
    assert cars == ["01", "02"]
    assert roles == {"t_in": "Cabin detected temperature", "t_set_cool": "Target temperature value", "p_high_1": "System 1 High Pressure"}
    assert telemetry.time_column(["a", "b"]) == "b" and telemetry.time_column(["a", "b", " TIME"]) == " TIME"
    with pytest.raises(ValueError):
        telemetry.melt(type("D", (), {"columns": ["a", "b"]})(), ["a"])


def test_missing_mode_counts_as_cooling_and_few_peers_give_nothing(frame):
    rows = [("c", car, 0, 1, v) for car, v in (("01", 20.0), ("02", 22.0))] + [("c", car, 1, 2, v) for car, v in (("01", 20.0), ("02", 22.0), ("03", 25.0))]
    df = frame("case_id string, car string, ts long, t long, t_in double", rows)
    d = peers.prepare(df, Order(("case_id", "car"), "t", ()))
    got = peers.peer_deviation(d, ["case_id", "ts"], "t_in", F.col("cooling"), "dev").collect()
    assert all(r.cooling and r.full_cool == 0 for r in got)
    assert {(r.ts, r.car): r.dev for r in got} == {(0, "01"): None, (0, "02"): None, (1, "01"): -2.0, (1, "02"): 0.0, (1, "03"): 3.0}


def test_fingerprint_ignores_row_order_and_sees_changes(frame):
    rows = [(r, i, float(i * (r % 2))) for r in range(4) for i in range(50)]
    rows[3] = (0, 3, 0.5)
    got = contracts.series_fingerprint(frame("r int, i long, x double", rows), ["r"], "i", ["x"]).collect()
    digest = {x.r: x.digest for x in got}
    assert digest[1] == digest[3] and digest[0] != digest[2]


def test_number_contract(frame):
    rows = [("a", "1.5"), ("b", "-1"), ("c", "x"), ("d", None), ("e", "NaN"), ("f", "Infinity")]
    bad = contracts.violations(frame("file_id string, prediction string", rows), ["file_id"], contracts.damage_rules()).collect()
    assert sorted((r.file_id, r.rule) for r in bad) == [("b", "number"), ("c", "number"), ("d", "missing"), ("e", "number"), ("f", "number")]


def test_hash_tree_of_long_recordings(frame):
    import hashlib

    from wayside.operators import contracts

    sizes = {"one": 1, "leaf": 8, "two": 9, "many": 8 * 4 * 4 + 3, "same": 9}
    rows = [(k, i, f"v{i * i}") for k, n in sizes.items() for i in range(n)]
    got = {r.k: (r.n, r.digest) for r in contracts.series_tree(frame("k string, i long, t string", rows), ["k"], "i", F.col("t"), 8, 4).collect()}
    sha = lambda parts: hashlib.sha256("\n".join(parts).encode()).hexdigest()
    for k, n in sizes.items():
        level = [sha([f"v{i * i}" for i in range(s, min(s + 8, n))]) for s in range(0, n, 8)]
        while len(level) > 1:
            level = [sha(level[i:i + 4]) for i in range(0, len(level), 4)]
        assert got[k] == (n, level[0])
    assert got["two"] == got["same"] and contracts.series_tree(frame("k string, i long, t string", []), ["k"], "i", F.col("t")).count() == 0


def test_first_lines_read_only_the_beginning(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"a b%{n}.csv").write_bytes(b"\xef\xbb\xbfx,y\r\n" + b"1,2\r\n" * 50_000 if n else b"only")
    found = {r.header for r in recordings.first_lines(spark, str(tmp_path / "*.csv")).collect()}
    assert found == {"x,y", "only"}
    assert [(names, len(files)) for names, files in recordings.headers(spark, str(tmp_path / "*.csv"))] == [(["only"], 1), (["x", "y"], 2)]


def test_written_tables_are_cleaned(spark, monkeypatch):
    from wayside import session

    monkeypatch.setattr(session, "MADE", [])
    first, second = session.cut(spark.range(3)), session.cut(spark.range(5))
    files = [f for t in (first, second) for f in t.inputFiles()]
    session.erase(first)
    assert second.count() == 5 and session.clean(spark) == 2 and session.MADE == []
    folder = files[-1].removeprefix("file://").removeprefix("file:").rsplit("/", 1)[0]
    assert not Path(folder).exists()
