"""Checks of inputs and outputs as tables of violations: no row means the contract holds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayside.session import cut

# Allowed labels, file limits and extensions.
DOOR_LABELS = ("Normal", "Abnormal resistance")
RAIL_LABELS = ("Normal", "Side I", "Side II")
MAX_FILES, MAX_BYTES = 100, 120 * 1024 * 1024
EXTENSIONS = {"door": ".csv", "acv": ".xlsx", "rail": ".csv", "shm": ".csv"}


def violations(rows: DataFrame, ident: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """One row per broken rule of a row; NULL counts as not broken."""
    broken = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]), lambda r: r.isNotNull())
    return rows.select(*ident, F.explode(broken).alias("rule"))


def _missing(*columns: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out


def door_rules(start: str = "start_us", end: str = "end_us") -> dict[str, Column]:
    return {
        "missing": _missing(start, end, "prediction"),
        "label": ~F.col("prediction").isin(*DOOR_LABELS),
        "order": F.col(end) <= F.col(start),
    }


def rail_rules() -> dict[str, Column]:
    return {"missing": _missing("file_id", "prediction"), "label": ~F.col("prediction").isin(*RAIL_LABELS)}


def damage_rules() -> dict[str, Column]:
    p = F.col("prediction").try_cast("double")
    return {
        "missing": _missing("file_id", "prediction"),
        "number": F.col("prediction").isNotNull() & (p.isNull() | F.isnan(p) | (F.abs(p) == float("inf")) | (p < 0)),
    }


def ranking_rules() -> dict[str, Column]:
    cars = F.split("ranked_cars", r"\|")
    return {
        "missing": _missing("file_id", "ranked_cars"),
        "car": F.exists(cars, lambda c: ~c.rlike(r"^\d{2}$")),
        "repeated": F.size(F.array_distinct(cars)) < F.size(cars),
    }


def reconcile(expected: DataFrame, got: DataFrame, ident: str) -> DataFrame:
    """Ids that are missing, unexpected or repeated among the results."""
    e = expected.select(ident).distinct().withColumn("_e", F.lit(True))
    g = got.groupBy(ident).agg(F.count(F.lit(1)).alias("_n"))
    both = e.join(g, ident, "full")
    problem = (
        F.when(F.col("_n").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("_n") > 1, "repeated"))
    return both.select(ident, problem.alias("problem")).where("problem IS NOT NULL")


def manifest_violations(files: DataFrame, batch: str, extension: str, single: bool = False) -> DataFrame:
    """Problems of the file lists of upload batches: (batch, rule, name); name is NULL for whole-batch rules."""
    name, low = F.col("name"), F.lower("name")
    per_file = violations(files, [batch, "name"], {
        "unsafe": name.isNull() | name.isin("", ".", "..") | name.rlike(r"[/\\\x00-\x1f]"),
        "formula": name.rlike(r"^[=+\-@]"),
        "extension": ~name.endswith(extension),
        "empty": F.col("bytes") <= 0,
    })
    repeated = files.groupBy(batch, low.alias("name")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    whole = files.groupBy(batch).agg(F.count(F.lit(1)).alias("_n"), F.sum("bytes").alias("_bytes"))
    limits = violations(whole, [batch], {
        "count": (F.col("_n") > (1 if single else MAX_FILES)), "size": F.col("_bytes") > MAX_BYTES})
    return (
        per_file.select(batch, "rule", "name")
        .unionByName(repeated.select(batch, F.lit("same_name").alias("rule"), "name"))
        .unionByName(limits.select(batch, "rule", F.lit(None).cast("string").alias("name"))))


def duplicate_families(units: DataFrame, unit: str, content: Column) -> DataFrame:
    """Units with equal content: digest, smallest member and size of the family. Sizes combine map-side, so a family
    that holds much of the table is no problem."""
    hashed = units.select(unit, F.sha2(content, 256).alias("digest"))
    families = hashed.groupBy("digest").agg(F.min(unit).alias("family"), F.count(F.lit(1)).alias("members"))
    return hashed.join(families, "digest")


def series_tree(rows: DataFrame, keys: Sequence[str], index: str, text: Column, leaf: int = 4096, fan: int = 64) -> DataFrame:
    """SHA-256 of a long recording, as a hash tree: keys, n (samples) and digest.

    ``text`` is what counts of a sample. Every ``leaf`` samples, by ``index`` from 0 on, are hashed in order; every ``fan``
    digests are hashed again, until one is left. Only a leaf or the digests of one node ever meet, levels grow with the
    logarithm of the longest recording, and a digest depends on its own recording alone. A recording of one leaf has the plain
    SHA-256 of its samples joined by line feeds.
    """
    given = list(keys)
    joined = lambda column: F.array_join(F.transform(F.array_sort(F.collect_list(column)), lambda x: x["_t"]), "\n")
    placed = rows.select(*given, F.col(index).cast("long").alias("_i"), text.cast("string").alias("_t"))
    level = placed.groupBy(*given, F.floor(F.col("_i") / leaf).cast("long").alias("_node")).agg(
        F.sha2(joined(F.struct("_i", "_t")), 256).alias("_t"), F.count(F.lit(1)).alias("_rows"))
    level = cut(level)
    sizes = cut(level.groupBy(*given).agg(F.sum("_rows").alias("n"), F.count(F.lit(1)).alias("_nodes")))
    level, most = level.drop("_rows"), sizes.agg(F.max("_nodes")).first()[0] or 0  # one row
    nodes = F.col("_nodes")
    while most > 1:
        above = level.join(sizes.select(*given, "_nodes"), given).groupBy(*given, F.floor(F.col("_node") / fan).cast("long").alias("_up")).agg(
            F.when(F.max(nodes) == 1, F.max("_t")).otherwise(F.sha2(joined(F.struct("_node", "_t")), 256)).alias("_t"))
        level = cut(above.withColumnRenamed("_up", "_node"))
        sizes = cut(sizes.withColumn("_nodes", F.ceil(nodes / fan)))
        most = -(-most // fan)
    return level.join(sizes, given).select(*given, "n", F.col("_t").alias("digest"))


def series_fingerprint(rows: DataFrame, keys: Sequence[str], index: str, columns: Sequence[str]) -> DataFrame:
    """Content digest of a long recording from its (index, values) rows. Row hashes are summed in two independent
    ways, so the digest needs no ordering and no row of a recording has to meet another."""
    digest = lambda salt: F.xxhash64(F.lit(salt), F.col(index), *[F.col(c) for c in columns])
    summed = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.bit_xor(digest(1)).alias("_x"), F.sum(digest(2).cast("decimal(38,0)")).alias("_s"))
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in ("_n", "_x", "_s")])
    return summed.select(*keys, F.sha2(text, 256).alias("digest"))
