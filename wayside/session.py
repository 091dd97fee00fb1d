"""Session helpers: settings the operators rely on, table loading and lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WRITTEN = "written-"
MADE: list[str] = []  # folders that this process has written and not erased
CONFIGURED = "wayside.configured"
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings every operator assumes (UTC, adaptive execution, Arrow), once per session."""
    if spark.conf.get(CONFIGURED, None) is None:
        for key, value in SETTINGS.items():
            spark.conf.set(key, value)
        spark.conf.set(CONFIGURED, "true")
    return spark


def local_session(cpus: str = "*", name: str = "wayside") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: there driver and executors are one machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="wayside-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from its files.

    The files outlive any executor, and being columnar they are read column by column by whatever follows.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{WRITTEN}{uuid.uuid4().hex}"
    df.write.parquet(path)
    MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def join_counted(rows: DataFrame, counted: DataFrame, key: str, n: str, held: int = 200_000) -> DataFrame:
    """Inner join of ``rows`` with a written table that has one row per key and, in ``n``, how many rows have that key.

    Keys with more than a ``held``-th of all rows, fewer than ``held`` of them, are broadcast, so that no hot key is shuffled;
    the others are joined by a shuffle in which every key has few rows.
    """
    total = counted.agg(F.sum(n)).first()[0] or 0  # one row
    frequent = F.col(n) > total // held
    often = F.broadcast(counted.where(frequent))
    seldom = rows.join(F.broadcast(counted.where(frequent).select(key)), key, "left_anti")
    return rows.join(often, key).unionByName(seldom.join(counted.where(~frequent), key))


def erase(written: DataFrame) -> None:
    """Remove the files of a table made by ``cut`` that nothing will read again, such as the last round of an iteration."""
    for folder in {f.rsplit("/", 1)[0] for f in written.inputFiles()}:
        if not folder.rsplit("/", 1)[-1].startswith(WRITTEN):
            raise ValueError(f"not a table written by cut: {folder}")
        _remove(written.sparkSession, folder)


def clean(spark: SparkSession) -> int:
    """Remove all tables that ``cut`` has written in this process; for when every result made from them has been used."""
    folders = [MADE.pop() for _ in range(len(MADE))]
    for folder in folders:
        _remove(spark, folder)
    return len(folders)


def _remove(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
