"""Writers of prediction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayside.functions.columns import natural_key
from wayside.operators.history import OUTPUT


def prediction_columns(df: DataFrame, system: str) -> DataFrame:
    """Exactly the exported columns of a subsystem."""
    missing = [c for c in OUTPUT[system] if c not in df.columns]
    if missing:
        raise ValueError(f"{system} predictions lack {missing}")
    return df.select(*OUTPUT[system])


def write_predictions(df: DataFrame, system: str, path: str, form: str = "csv") -> None:
    """Write the predictions of a subsystem under ``path``/system=<name>, files in natural order of their names.

    Predictions of several streams go to one folder per ``stream_id``, so they can be told apart.
    """
    by = ["stream_id"] if "stream_id" in df.columns and "stream_id" not in OUTPUT[system] else []
    rows = prediction_columns(df, system) if not by else df.select(*by, *prediction_columns(df, system).columns)
    if "file_id" in rows.columns:
        rows = rows.orderBy(natural_key("file_id"))
    writer = rows.write.mode("overwrite").partitionBy(*by)
    if form == "csv":
        writer = writer.option("header", True)
    writer.format(form).save(f"{path}/system={system}")


def read_predictions(spark, path: str, system: str) -> DataFrame:
    return spark.read.option("header", True).csv(f"{path}/system={system}").select(*[F.col(c) for c in OUTPUT[system]])
