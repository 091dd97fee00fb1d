"""Readers of the raw recordings, many files at a time.

The place of a row in its file comes from the file block it was read from and its order inside that block, so large
files are still read in parallel and no file has to fit a task.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayside.functions.columns import finite, micros, parse_native_ts
from wayside.operators.ordered import Order, positions
from wayside.sources.telemetry import melt, time_column

# Column order of a door stream, which of them are flags; columns of a rail recording.
DOOR_COLUMNS = (
    "dt", "current", "voltage", "bemf", "t_open", "t_close", "cmd_close", "cmd_open",
    "dcsr", "dcsl", "dlsr", "dlsl", "opened", "locked", "opening", "closing", "pos",
)
DOOR_FLAGS = ("cmd_close", "cmd_open", "dcsr", "dcsl", "dlsr", "dlsl", "opened", "locked", "opening", "closing")
RAIL_COLUMNS = 129


#: What is read of a file to know its first line.
HEAD_BYTES = 1 << 16
OPENED = ("file", "s3", "s3a", "gs", "hdfs", "viewfs", "abfs", "abfss")


def first_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, header): the first line of every file, from its first HEAD_BYTES. Files are listed and opened by tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array([head(f) for f in files], pa.string())], names=["file", "header"])

    def head(uri: str) -> str:
        scheme, _, rest = uri.partition(":")
        if scheme == "file":
            system, place = fs.LocalFileSystem(), "/" + rest.lstrip("/")
        else:
            system, place = fs.FileSystem.from_uri(uri.replace("s3a:", "s3:", 1))
        with system.open_input_stream(unquote(place)) as stream:
            found = b""
            while b"\n" not in found and (more := stream.read(HEAD_BYTES)):
                found += more
        return found.split(b"\n", 1)[0].rstrip(b"\r").decode("utf-8-sig")

    listed = spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path)).select("path")  # no content is read
    scheme = F.split("path", ":")[0]
    if listed.where(~scheme.isin(*OPENED)).isEmpty():
        return listed.mapInArrow(run, "file string, header string")
    lines = spark.read.text(path).select(  # a file system that only Spark can open: its rows tell their place
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("line"))
    return lines.where("at = 0").groupBy("file").agg(F.min_by("value", "line").alias("header"))


def headers(spark: SparkSession, path: str | Sequence[str]) -> list[tuple[list[str], list[str]]]:
    """(column names, files) for every distinct first line of the files."""
    found = first_lines(spark, path).groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header").collect()
    return [(next(csv.reader([r.header.lstrip("\ufeff")])), [unquote(f) for f in r.files]) for r in found]


def _csv(spark: SparkSession, path: str | Sequence[str], names: Sequence[str], header: bool = True) -> DataFrame:
    """All columns as text, by position, under the given names."""
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.option("header", header).option("enforceSchema", True).schema(schema).csv(path)


def _of_width(spark: SparkSession, path: str | Sequence[str], names: Sequence[str]) -> DataFrame:
    """Files that all have as many columns as there are names; any other file is named in the error."""
    width = F.udf(lambda h: len(next(csv.reader([h]), [])), "int")(F.col("header"))  # one header per file
    wrong = first_lines(spark, path).withColumn("n", width).where(F.col("n") != len(names))
    some = wrong.orderBy("file").limit(20).collect()  # named in the message
    if some:
        listed = ", ".join(f"{unquote(r.file).rsplit('/', 1)[-1]} ({r.n})" for r in some)
        raise ValueError(f"expected {len(names)} columns, got others in {wrong.count()} files: {listed}")
    return _csv(spark, path, names)


def _placed(df: DataFrame, columns: list[str]) -> DataFrame:
    """File name, block start and order inside the block beside the columns of a file scan."""
    return df.select(
        *columns, F.col("_metadata.file_name").alias("file_id"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"))


def _indexed(df: DataFrame, name: str = "i") -> DataFrame:
    """Row number inside each file."""
    order = Order(("file_id",), "_block", ("_line",))
    return positions(df, order, name, "_n").drop("_block", "_line", "_n")


def read_door(spark: SparkSession, path) -> DataFrame:
    """Continuous door stream: 17 columns by position. ``stream_id`` is the file, ``seq`` the row in it."""
    raw = _of_width(spark, path, DOOR_COLUMNS)
    named = _indexed(_placed(raw, [F.col(c) for c in DOOR_COLUMNS]), "seq")
    typed = [
        F.col(c).try_cast("int").alias(c) if c in DOOR_FLAGS else finite(F.col(c).try_cast("double")).alias(c)
        for c in DOOR_COLUMNS[1:]]
    ts = parse_native_ts("dt")
    return named.select(F.col("file_id").alias("stream_id"), "seq", ts.alias("ts"), micros(ts).alias("t"), *typed)


def read_rail(spark: SparkSession, path) -> DataFrame:
    """Rail recordings: pulse, then vibration and shock of 64 channels alternating, as two arrays per sample."""
    raw = _of_width(spark, path, [f"c{i}" for i in range(RAIL_COLUMNS)])
    value = lambda c: finite(F.col(c).try_cast("double"))
    columns = [
        value(raw.columns[0]).alias("pulse"),
        F.array(*[value(c) for c in raw.columns[1::2]]).alias("vib"),
        F.array(*[value(c) for c in raw.columns[2::2]]).alias("shock")]
    return _indexed(_placed(raw, columns)).withColumnRenamed("file_id", "recording_id")


def rail_samples(recordings: DataFrame, unit: str = "recording_id") -> DataFrame:
    """Long form of rail recordings: one row per sample and channel with vibration x and shock y."""
    both = F.arrays_zip("vib", "shock")
    return recordings.select(unit, "i", F.posexplode(both).alias("k", "_v")).select(
        unit, "i", "k", F.col("_v.vib").alias("x"), F.col("_v.shock").alias("y"))


def read_series(spark: SparkSession, path) -> DataFrame:
    """Headerless stress series: the first column, in file order."""
    raw = spark.read.option("header", False).option("inferSchema", False).csv(path)
    value = finite(F.col(raw.columns[0]).try_cast("double")).alias("stress")
    return _indexed(_placed(raw, [value])).withColumnRenamed("file_id", "recording_id")


def read_telemetry(spark: SparkSession, path) -> DataFrame:
    """Wide car telemetry: one row per time and car, a column per role. Headers may differ from file to file: files are
    read by the header they have, and a role that a header lacks is null."""

    def group(names: list[str], files: list[str]) -> DataFrame:
        unique = [n if names.index(n) == i and n else f"_unnamed_{i}" for i, n in enumerate(names)]
        raw = _csv(spark, files, [n.replace("`", "``") for n in unique])
        at = time_column(unique)
        named = raw.withColumn("case_id", F.col("_metadata.file_name"))
        return melt(named.withColumn("_time", parse_native_ts(F.col(f"`{at}`"))), ["case_id", "_time"])

    long = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [group(*g) for g in headers(spark, path)])
    stamp = F.col("_time")
    return long.select("case_id", stamp.alias("time"), micros(stamp).alias("t"), micros(stamp).alias("ts"), *[
        c for c in long.columns if c not in ("case_id", "_time")])
