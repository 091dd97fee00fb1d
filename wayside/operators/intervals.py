"""Interval joins and overlap matching of two segmentations, without a bucket per unit of time.

Whether a moment lies in any interval is a running value: intervals and moments are put in one order by time, and the moment
is inside if an interval that began before reaches it. Overlapping pairs are found on dyadic nodes: an interval lives at the
level whose nodes are as wide as it is long, on two or three nodes, and looks for longer ones at the levels above.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayside.operators.ordered import Order, running, runnings, shifted

OCTAVES = 2  # nodes are four times as wide from level to level


def top_rows(df: DataFrame, order: Sequence[Column], k: int, name: str) -> DataFrame:
    """The k first rows with their place; only the k survivors of the distributed limit are numbered."""
    best = df.orderBy(*order).limit(k)
    return best.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def _covered(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str) -> DataFrame:
    """``points`` with ``_inside``: whether an interval of the same key holds the moment, both ends included.

    Intervals come before moments at the same time; the largest end so far tells whether one of them is still open.
    """
    given = F.struct(*[F.col(c) for c in points.columns])
    moments = points.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_end"), given.alias("_row"))
    begun = spans.select(
        *keys, F.col(start).alias("_t"), F.lit(0).alias("_kind"), F.col(end).cast("long").alias("_end"), F.lit(None).cast(moments.schema["_row"].dataType).alias("_row"))
    both = moments.unionByName(begun)
    reach = running(both, Order(tuple(keys), "_t", ("_kind", "_end")), F.col("_end"), "_reach", "max")
    return reach.where("_kind = 1").select("_row.*", F.coalesce(F.col("_reach") >= F.col("_t"), F.lit(False)).alias("_inside"))


def outside_intervals(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str) -> DataFrame:
    """Rows of ``points`` inside no interval of ``spans``."""
    return _covered(points, spans, keys, at, start, end).where("NOT _inside").drop("_inside")


def inside_intervals(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str) -> DataFrame:
    return _covered(points, spans, keys, at, start, end).where("_inside").drop("_inside")


def _level(start: str, end: str) -> Column:
    """Level whose nodes are at least about as wide as the interval is long."""
    return F.ceil(F.log2(F.greatest(F.col(end) - F.col(start), F.lit(1)).cast("double")) / OCTAVES).cast("int")


def overlaps(true: DataFrame, pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs (i, j) of overlapping intervals, their intersection over union, and the span from ``lo`` to ``hi`` of both.

    ``true`` has i, start, end; ``pred`` has j, start, end (integers on one axis). A pair meets at the level of the longer
    one, on the node where the intersection begins, and so comes once. An interval of any length makes at most three rows for
    each level in use.
    """
    in_use = true.select(_level("start", "end").alias("l")).union(pred.select(_level("start", "end").alias("l"))).distinct()
    levels = sorted(r["l"] for r in in_use.collect())  # 32 numbers at most
    width = lambda level: F.pow(F.lit(2.0), F.lit(OCTAVES) * level).cast("long")
    node = lambda c, level: F.floor(c / width(level)).cast("long")
    every = F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")

    def side(df: DataFrame, tag: str, ident: str) -> DataFrame:
        mine = _level("start", "end")
        at = df.where("end > start").select(
            *keys, ident, F.col("start").alias(f"{tag}s"), F.col("end").alias(f"{tag}e"), mine.alias(f"{tag}l"), F.explode(F.filter(every, lambda x: x >= mine)).alias("_l"))
        return at.select("*", F.explode(F.sequence(node(F.col(f"{tag}s"), F.col("_l")), node(F.col(f"{tag}e"), F.col("_l")))).alias("_b"))

    both = side(true, "t", "i").join(side(pred, "p", "j"), [*keys, "_l", "_b"])
    begin = F.greatest("ts", "ps")
    inter = (F.least("te", "pe") - begin).cast("double")
    union = (F.col("te") - F.col("ts") + F.col("pe") - F.col("ps")).cast("double") - inter
    met = both.where((F.greatest("tl", "pl") == F.col("_l")) & (inter > 0) & (node(begin, F.col("_l")) == F.col("_b")))
    return met.select(*keys, "i", "j", (inter / union).alias("iou"), F.least("ts", "ps").alias("lo"), F.greatest("te", "pe").alias("hi"))


def _components(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs with ``_component``: a new one begins where no pair so far reaches. Pairs that share an interval are in one."""
    order = Order(tuple(keys), "lo", ("hi", "i", "j")).sampled(pairs)
    reach = runnings(pairs, order, {"_reach": F.col("hi")}, "max")
    before = shifted(reach, order, {"_before": "_reach"}, -1)
    begins = F.when(F.col("_before").isNull() | (F.col("lo") >= F.col("_before")), 1).otherwise(0).cast("long")
    return running(before, order, begins, "_component").drop("_reach", "_before")


def greedy_matchings(pairs: DataFrame, keys: Sequence[str], settings: Column) -> DataFrame:
    """Several one-to-one matchings at once, each highest IoU first, ties by (i, j): pairs with ``taken``, if not 0.

    ``pairs``: keys, i, j, iou, lo, hi (the span of both intervals; any span that holds all pairs of an interval will do).
    ``settings``: bits of the matchings that a pair may be part of, 63 at most. Pairs are grouped into components of
    overlapping spans, which are independent of each other. A component is passed through once, best pair first: sorted by
    Spark, with the bits in which each of its intervals is taken as the only state. There are no rounds.
    """
    names = list(keys)
    marked = _components(pairs.withColumn("_bits", settings.cast("long")), names)
    by = [*names, "_component"]
    dealt = marked.repartition(*by).sortWithinPartitions(*by, F.desc("iou"), "i", "j")
    slim = dealt.select(*by, "i", "j", "iou", "_bits")
    n = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, left, right = None, {}, {}
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            taken = []
            for *group, i, j, _, bits in zip(*columns, strict=True):
                if group != here:
                    here, left, right = group, {}, {}
                free = bits & ~left.get(i, 0) & ~right.get(j, 0)
                if free:
                    left[i], right[j] = left.get(i, 0) | free, right.get(j, 0) | free
                taken.append(free)
            out = pa.RecordBatch.from_arrays(
                [*batch.columns[:n - 1], *batch.columns[n:n + 3], pa.array(taken, pa.int64())], names=[*names, "i", "j", "iou", "taken"])
            yield out.filter(pa.array([x != 0 for x in taken], pa.bool_()))

    fields = ", ".join(f"{c} {slim.schema[c].dataType.simpleString()}" for c in [*names, "i", "j", "iou"])
    return slim.mapInArrow(run, f"{fields}, taken long")


def greedy_matching(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One-to-one matching, highest IoU first, ties by (i, j)."""
    return greedy_matchings(pairs, keys, F.lit(1)).drop("taken")
