"""Leakage-safe folds as tables of (unit, fold). Ranks come from ordered ranges, so no task sees all units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayside.functions.columns import speed_bin
from wayside.operators.ordered import Order, positions
from wayside.operators.quantiles import exact_medians


def ranked(units: DataFrame, at: str, ties: Sequence[str] = ()) -> DataFrame:
    """Units with their rank ``pos`` in the order of ``at`` and their number ``n``."""
    order = Order(("_all",), at, tuple(ties))
    return positions(units.withColumn("_all", F.lit(0)), order).drop("_all")


def split_even(pos: Column, n: Column, blocks: int) -> Column:
    """Block of a position when n units are split evenly, the first n mod blocks blocks one longer."""
    size, longer = F.floor(n / blocks), n % blocks
    return F.when(pos < longer * (size + 1), F.floor(pos / (size + 1))).otherwise(
        longer + F.floor((pos - longer * (size + 1)) / F.greatest(size, F.lit(1)))
    ).cast("long")


def proportional(pos: Column, n: Column, blocks: int) -> Column:
    return F.floor(pos * blocks / n).cast("long")


def rotated(pos: Column, n: Column, offset: Column | int) -> Column:
    return F.pmod(pos - offset, n)


def nested_blocks(units: DataFrame, blocks: int, inner: int, offsets: Sequence[int]) -> DataFrame:
    """Outer rotated blocks; inside each outer training set contiguous inner blocks in the original order.

    The validation block is a (possibly wrapped) interval of positions, so the position of a unit inside the training
    set is arithmetic on its rank: nothing is sorted again per fold.
    """
    spread = units.select("*", F.posexplode(F.array(*[F.lit(int(o)) for o in offsets])).alias("repeat", "offset"))
    spread = spread.select("*", F.explode(F.array(*[F.lit(k) for k in range(blocks)])).alias("fold"))
    n, pos, k = F.col("n"), F.col("pos"), F.col("fold")
    size, longer = F.floor(n / blocks), n % blocks
    length = size + F.when(k < longer, 1).otherwise(0)
    start = F.pmod(k * size + F.least(k, longer) + F.col("offset"), n)
    held = split_even(rotated(pos, n, F.col("offset")), n, blocks) == k
    wrapped = F.greatest(start + length - n, F.lit(0))
    before = F.least(pos, wrapped) + F.greatest(F.least(pos - start, length - wrapped), F.lit(0))
    out = spread.withColumn("held", held).withColumn("_before", before).withColumn("_train", n - length)
    inner_block = F.when(~F.col("held"), split_even(pos - F.col("_before"), F.col("_train"), inner))
    return out.withColumn("inner_block", inner_block).drop("_before", "_train", "offset", "pos", "n")


def stratified(units: DataFrame, unit: str, label: str, k: int, seed: int) -> DataFrame:
    """Class-balanced folds: units of a class in the order of a seeded digest, dealt out in turn."""
    digest = F.md5(F.concat_ws("-", F.col(unit).cast("string"), F.lit(str(seed))))
    keyed = units.withColumn("_digest", digest)
    order = Order((label,), "_digest", (unit,))
    placed = positions(keyed, order)
    return placed.withColumn("fold", F.col("pos") % k).drop("_digest", "pos", "n")


def family_folds(units: DataFrame, family: str, at: str, fold: str) -> DataFrame:
    """Every member takes the fold of the smallest member of its family."""
    lead = units.groupBy(family).agg(F.min_by(fold, at).alias("family_fold"))
    return units.join(lead, family)


def condition_folds(units: DataFrame, family: str, speed: str, lowest: int = 2) -> DataFrame:
    """Hold out one speed bin at a time; the median speed of a family decides for all its members."""
    typical = exact_medians(units, [family], speed, "_speed")
    return units.join(typical, family).withColumn("fold", F.greatest(F.lit(lowest), speed_bin("_speed"))).drop("_speed")


def others_mean(df: DataFrame, case: str, value: str) -> DataFrame:
    """Leave-one-case-out training mean: the total minus the held-out case, instead of listing all other cases."""
    per = df.groupBy(case).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    total = lambda c: per.agg(c).scalar()
    rest = per.select(
        F.col(case).alias("held"), (total(F.count(F.lit(1))) - 1).alias("train_cases"),
        (total(F.sum("_c")) - F.col("_c")).alias("train_rows"), (total(F.sum("_s")) - F.col("_s")).alias("_sum"))
    return rest.withColumn("train_mean", F.try_divide("_sum", "train_rows")).drop("_sum")


def audit(folds: DataFrame, unit: str, family: str, held: Column) -> DataFrame:
    """Violations of a protocol with rows (repeat, fold, unit, family): units not held out exactly once per repeat and
    families that are both held out and trained on in one fold."""
    once = folds.groupBy("repeat", unit).agg(F.count(F.when(held, 1)).alias("n")).where("n <> 1")
    crossing = folds.groupBy("repeat", "fold", family).agg(
        F.count(F.when(held, 1)).alias("n"), F.count(F.when(~held, 1)).alias("_out")).where("n > 0 AND _out > 0")
    return once.select(
        F.lit("held_out_once").alias("rule"), "repeat", F.lit(None).cast("int").alias("fold"), F.col(unit).cast("string").alias("key"), "n"
    ).unionByName(
        crossing.select(F.lit("family_crosses").alias("rule"), "repeat", "fold", F.col(family).cast("string").alias("key"), "n"))


def truth_folds(truth: DataFrame, cycles: DataFrame, keys: Sequence[str], start: str, blocks: int) -> DataFrame:
    """Fold of a true interval: the number of block boundaries at or before its start.

    A boundary is the start of the first cycle of a block, so a stream has ``blocks`` − 1 of them.
    """
    edges = cycles.where(F.col("block") > 0).groupBy(*keys, "block").agg(F.min(start).alias("_edge"))
    packed = edges.groupBy(*keys).agg(F.collect_list("_edge").alias("_edges"))
    passed = F.size(F.filter(F.coalesce("_edges", F.array()), lambda e: e <= F.col(start)))
    return truth.join(packed, list(keys), "left").withColumn("fold", passed.cast("long")).drop("_edges")


def balanced_weights(units: DataFrame, label: str) -> DataFrame:
    """Weight n / (classes × class size) of each class."""
    sizes = units.groupBy(label).agg(F.count(F.lit(1)).alias("class_n"))
    n, k = (sizes.agg(c).scalar() for c in (F.sum("class_n"), F.count(F.lit(1))))
    return sizes.withColumn("weight", n / (k * F.col("class_n")))
