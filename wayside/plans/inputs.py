"""How the given tables play sensor recordings, as DataFrames and as SQL for the checks.

events      one continuous stream per user: time, operating mode, motor current, voltage, back-EMF, leaf position
lineitem    one long recording per supplier, ordered by ship date and keys
embeddings  64 channels: 50 consecutive vectors form one recording of 50 samples
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayside.functions.columns import DAY_US, micros
from wayside.operators.ordered import Order
from wayside.session import table

STREAM = Order(("stream_id",), "t", ("seq",))
RECORDING = Order(("rec",), "t", ("ok", "ln", "pk", "x"))
GAP = DAY_US
SAMPLES = 50  # samples per embedded recording
RATE = 1000.0  # its sampling rate in Hz


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("stream_id"),
        F.col("event_id").alias("seq"),
        micros("ts").alias("t"),
        F.col("event_type").alias("mode"),
        (F.col("value") / 0.97).alias("current"),
        (F.lit(100) + k).cast("double").alias("voltage"),
        (k + F.col("value") / 9.7).alias("bemf"),
        k.cast("double").alias("pos"),
    )


EV = """ev AS (SELECT user_id AS stream_id, event_id AS seq, epoch_us(ts) AS t, event_type AS mode, value / 97e-2 AS current,
  CAST(100 + k AS DOUBLE) AS voltage, k + value / 97e-1 AS bemf, CAST(k AS DOUBLE) AS pos
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events))"""

SEG = (
    EV
    + f""", step AS (SELECT *, t - lag(t) OVER (PARTITION BY stream_id ORDER BY t, seq) AS dt FROM ev),
seg AS (SELECT *, CAST(sum(CASE WHEN dt > {GAP} THEN 1 ELSE 0 END)
  OVER (PARTITION BY stream_id ORDER BY t, seq) AS BIGINT) AS segment_id FROM step),
segp AS (SELECT *, row_number() OVER (PARTITION BY stream_id, segment_id ORDER BY t, seq) - 1 AS i,
  count(*) OVER (PARTITION BY stream_id, segment_id) AS n FROM seg)"""
)


def recordings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("rec"),
        micros("l_shipdate").alias("t"),
        F.col("l_orderkey").alias("ok"),
        F.col("l_linenumber").alias("ln"),
        F.col("l_partkey").alias("pk"),
        (F.sqrt("l_extendedprice") * 3).alias("x"),
        F.col("l_quantity").alias("q"),
        (F.col("l_linenumber") % 2).cast("int").alias("pulse"),
    )


LI = """li AS (SELECT l_suppkey AS rec, sqrt(l_extendedprice) * 3 AS x, l_quantity AS q, l_linenumber % 2 AS pulse,
  row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n
  FROM lineitem
  WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice))"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """One row per vector: recording, sample index, class label and the 64 channel values."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id"),
        F.floor(F.col("vec_id") / SAMPLES).alias("rec"),
        (F.col("vec_id") % SAMPLES).alias("i"),
        "label",
        F.transform("embedding", lambda x: x.cast("double")).alias("vib"),
    )


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Long form: (rec, i, k, x) with the shock reading y beside the vibration x."""
    long = vectors(spark, sf).select("rec", "i", "label", F.posexplode("vib").alias("k", "x"))
    return long.withColumn("y", F.col("x") * F.col("x") * 10 + F.col("x") / 2)


VEC = f"""vec AS (SELECT vec_id, vec_id // {SAMPLES} AS rec, vec_id % {SAMPLES} AS i, label, embedding FROM embeddings),
smp AS (SELECT rec, i, label, k, x, x * x * 10 + x / 2 AS y FROM
  (SELECT rec, i, label, unnest(range(64)) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM vec))"""
