"""Live forms of the stream operators. Each emits, once a piece is closed by the watermark, what its batch form gives.

State is kept per open piece: a cycle of a stream (cycle features), a time bucket of a stream and then one residue per
stream (rainflow), counted values and single readings of a train's moment (peer deviation). None grows with the rows of a
stream that wait for the watermark.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from wayside.functions.columns import decide
from wayside.operators.cycles import STALL_CURRENT
from wayside.operators.fatigue import close_cycles
from wayside.operators.peers import MIN_PEERS
from wayside.session import shared_folder

PROGRESS, MOST_PROGRESS = "spark.sql.streaming.numRecentProgressUpdates", 1_000_000
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_rows(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """A growing folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def run_available(
    stream: DataFrame, target: str | None = None, mode: str = "append", state: str | None = None
) -> tuple[DataFrame, StreamingQuery]:
    """Process everything that is there, write files to the shared folder and return them with the finished query.

    ``state`` names the state store of this query; the rainflow residue needs ROCKS.
    """
    spark = stream.sparkSession
    base = target or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    before = {key: spark.conf.get(key) for key in (STORE, PROGRESS)}
    spark.conf.set(STORE, state or before[STORE])
    spark.conf.set(PROGRESS, str(MOST_PROGRESS))  # counts over a run need the progress of all its batches
    try:
        query = (
            stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/checkpoint")
            .option("path", f"{base}/rows").trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(stream.schema).parquet(f"{base}/rows"), query


def accepted_rows(rows: DataFrame, key: list[str], ts: str, delay: str) -> DataFrame:
    """Rows that a live run takes in: those not behind the watermark when they arrive, each once by ``key``."""
    return rows.withWatermark(ts, delay).dropDuplicates([*key, ts])


def late_table(everything: DataFrame, accepted: DataFrame, key: list[str]) -> DataFrame:
    """The rows that came later than the watermark allowed: all that arrived but those that were taken in."""
    return everything.join(accepted.select(*key), key, "left_anti")


def late_rows(query: StreamingQuery) -> int:
    """How many rows were dropped as late over all batches of the run, by the run's own account."""
    return sum(s.numRowsDroppedByWatermark for p in all_progress(query) for s in p.stateOperators)


def all_progress(query: StreamingQuery) -> list:
    """The progress of every batch of a run; an error if some of it is gone."""
    found = query.recentProgress
    if len(found) >= MOST_PROGRESS:
        raise RuntimeError("the run had more batches than progress updates are kept")
    return found


def live_segments(rows: DataFrame, keys: list[str], ts: str, gap: str, delay: str, *aggregates) -> DataFrame:
    """Segments of a stream, emitted when the watermark passes their end plus the gap."""
    windowed = rows.withWatermark(ts, delay).groupBy(*keys, F.session_window(ts, gap).alias("_w"))
    closed = windowed.agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n_rows"), *aggregates)
    return closed.drop("_w")


def live_peer_deviation(rows: DataFrame, moment: list[str], unit: str, ts: str, width: str, delay: str, value: str) -> DataFrame:
    """Value minus the median of the units of a train in the same time window, at least three readings.

    The median is an aggregate whose state counts equal values; readings wait in the state of a stream-stream join on
    (train, window), one by one, until the median of their window is known.
    """
    # the window is the event time from here on; the reading's own time goes along inside a struct
    marked = rows.withWatermark(ts, delay).select(
        *moment, unit, F.struct(ts).alias("_at"), F.col(value).alias("_value"), F.window(ts, width).alias("_w"))
    middle = marked.groupBy(*moment, "_w").agg(F.percentile("_value", F.lit(0.5)).alias("_m"), F.count(F.lit(1)).alias("_n"))
    known = middle.where(F.col("_n") >= MIN_PEERS).select(*[F.col(c).alias(f"_{c}") for c in moment], F.col("_w").alias("_mw"), "_m")
    same = F.col("_w") == F.col("_mw")
    for c in moment:
        same = same & (F.col(c) == F.col(f"_{c}"))
    met = marked.join(known, same)
    return met.select(*moment, F.col("_w.start").alias("window_start"), unit, F.col(f"_at.{ts}").alias(ts), (F.col("_value") - F.col("_m")).alias("peer_dev"))


CYCLES = "stream_id bigint, kind string, upto bigint, range double, mean double, cnt double"
CYCLE = (
    "stream_id bigint, start_us bigint, n_rows bigint, trav_mean double, mid_mean double, vel_mean double, stall_rows bigint, slope double")
PART = "stream_id bigint, upto bigint, residue array<double>, ranges array<double>, means array<double>"


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _cycle_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for stream, rows in zip(batch["stream_id"], batch["rows"], strict=True):
            placed = sorted((r["t"], r["seq"], r["current"], r["bemf"], r["pos"]) for r in rows)
            n = len(placed)
            _, _, cur, emf, pos = (np.asarray(c) for c in zip(*placed, strict=True))
            k = max(1, int(0.9 * n))
            mid = cur[int(0.3 * n):int(0.8 * n)]
            speed = np.abs(np.diff(pos, prepend=pos[0]))
            spread = emf[:k] - emf[:k].mean()
            slope = 0.0 if k <= 2 else (float(spread @ cur[:k] / (spread @ spread)) if spread @ spread else None)
            out.append((
                stream, placed[0][0], n, float(cur[:k].mean()), float(mid.mean()) if len(mid) else None, float(speed.mean()),
                int(((speed == 0) & (cur > STALL_CURRENT)).sum()), slope))
        yield pd.DataFrame(out, columns=_names(CYCLE))


def live_cycle_features(rows: DataFrame, gap_us: int, delay: str, ts: str = "ts") -> DataFrame:
    """Phase, velocity and slope features of every cycle when it closes.

    State is one session per open cycle of a stream, and a cycle is bounded; its rows are put in order once it is closed.
    """
    session = F.session_window(ts, f"{gap_us + 1} microseconds").alias("_w")  # a cycle ends at a step strictly above the gap
    closed = rows.withWatermark(ts, delay).groupBy("stream_id", session).agg(
        F.collect_list(F.struct("t", "seq", "current", "bemf", "pos")).alias("rows"))
    return closed.select("stream_id", "rows").mapInPandas(_cycle_features, CYCLE)


def take_in(values: Iterable[float], points: list[float]) -> list[tuple[float, float]]:
    """Add values to a residue: plateaus and monotone interior points go, cycles that close are returned."""
    found = []
    for v in values:
        if points and v == points[-1]:
            continue
        if len(points) >= 2 and (points[-1] > points[-2]) == (v > points[-1]):
            points.pop()  # the running end moves on in the same direction
        found += close_cycles([v], points)
    return found


def _bucket_cycles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        residues, ranges, means = [], [], []
        for values in batch["values"]:
            points: list[float] = []
            found = take_in(values.tolist(), points)
            residues.append(points)
            ranges.append([r for r, _ in found])
            means.append([m for _, m in found])
        yield batch[["stream_id", "upto"]].assign(residue=residues, ranges=ranges, means=means)


class _Residue(StatefulProcessor):
    """Joins the residues of a stream's time buckets, which close in order; the stream's own residue is the only state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stack = handle.getValueState("stack", T.StructType([T.StructField("points", T.ArrayType(T.DoubleType()))]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns = ("upto", "residue", "ranges", "means")
        parts = sorted((r for batch in rows for r in zip(*(batch[n] for n in columns), strict=True)), key=lambda r: r[0])
        held = self.stack.get()
        points = list(held[0]) if held is not None else []
        out = []
        for upto, residue, ranges, means in parts:
            found = [*zip(ranges, means, strict=True), *take_in(map(float, residue), points)]
            out += [(key[0], "cycle", upto, float(r), float(m), 1.0) for r, m in found]
        self.stack.update((points,))
        out += [(key[0], "residue", parts[-1][0], abs(b - a), (a + b) / 2, 0.5) for a, b in zip(points, points[1:])]
        if out:
            yield pd.DataFrame(out, columns=_names(CYCLES))

    def close(self) -> None: ...


def live_rainflow(rows: DataFrame, delay: str, ts: str = "ts", bucket: str = "1 hour", start: str = "0 seconds") -> DataFrame:
    """Closed cycles of each series as they close, and at every step the half cycles of its residue.

    Rows gather by (stream, time bucket). A bucket that the watermark has passed is counted by itself, and only its residue
    goes on to the second stateful step, where a stream's residues are joined. A step takes in the rows up to ``upto``; only the
    residue with the largest ``upto`` of a series counts. Buckets begin at ``start`` and whole buckets from there.
    """
    closed = rows.withWatermark(ts, delay).groupBy("stream_id", F.window(ts, bucket, startTime=start).alias("_w")).agg(
        F.sort_array(F.collect_list(F.struct("t", "seq", "current"))).alias("rows"))
    placed = closed.select("stream_id", F.element_at("rows.t", -1).alias("upto"), F.col("rows.current").alias("values"))
    parts = placed.mapInPandas(_bucket_cycles, PART)
    return parts.groupBy("stream_id").transformWithStateInPandas(
        statefulProcessor=_Residue(), outputStructType=CYCLES, outputMode="Append", timeMode="None")


def newest_residue(rows: DataFrame) -> DataFrame:
    """All closed cycles and the residue of the last step of each series."""
    last = rows.groupBy("stream_id").agg(F.max("upto").alias("_last"))
    return rows.join(last, "stream_id").where("kind = 'cycle' OR upto = _last").drop("_last")


def live_scoring(segments: DataFrame, score: Callable[[DataFrame], DataFrame], tau: float, target: str | None = None) -> DataFrame:
    """Label closed segments with a fitted scorer giving p1 and p2. A batch that runs again replaces its own files."""
    spark = segments.sparkSession
    base = target or f"{shared_folder(spark)}/scores-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        scored = score(batch).withColumn("prediction", decide("p1", "p2", "global", tau))
        scored.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    query = (
        segments.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(f"{base}/rows").drop("batch")
