"""Exact quantiles of groups of any size.

Spark's ``percentile`` keeps every distinct value of a group in one task, which is right for a group of up to ``LIMIT`` rows (a
cycle, the 64 channels of a recording, most cars) and wrong for "all normal rows of side 1". Larger groups are selected by
radix: a double has an order-preserving integer, histograms over its leading bits are counted with map-side combine, and the
cells that hold a wanted rank are refined by further bits until they hold no more than ``LIMIT`` rows. Only what such a cell
holds is ever brought together; a cell with all bits fixed holds one value and needs no rows at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayside.session import cut

RESOLUTION = 4096  # cells per factor of e
OFFSET = 746 * RESOLUTION  # ln of the smallest positive double is above -746


def _cell(v: Column) -> Column:
    """A weakly increasing integer function of a double."""
    size = F.floor(F.ln(F.abs(v)) * RESOLUTION) + OFFSET
    return F.when(v == 0, 0).when(v > 0, size).otherwise(-size).cast("long")


LIMIT = 100_000  # rows of a group, or of an opened cell, that meet in one task
DEPTHS = (20, 34, 49, 64)  # leading bits that the cells of each round have in common
MANTISSA = 1 << 52


def ordered_bits(v: Column) -> Column:
    """A long that orders as the double does, one for each value: the magnitude's exponent and mantissa, with its sign.

    Both zeros are one value, NaN is the largest. The power of two below a number is found by a logarithm and put right where
    rounding misses it; everything after is exact.
    """
    a = F.abs(v)
    guess = F.floor(F.log2(a)).cast("int")
    low = F.when(F.pow(F.lit(2.0), guess) > a, guess - 1).when(F.pow(F.lit(2.0), guess + 1) <= a, guess + 1).otherwise(guess)
    mantissa = ((a / F.pow(F.lit(2.0), low) - 1) * float(MANTISSA)).cast("long")
    size = F.when(F.isnan(v), 2047 * MANTISSA + 1).when(a == float("inf"), 2047 * MANTISSA).when(
        a < 2.0 ** -1022, (a * 2.0 ** 537 * 2.0 ** 537).cast("long")).otherwise((low + 1023).cast("long") * MANTISSA + mantissa)
    return F.when(v < 0, -size).otherwise(size)


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], limit: int = LIMIT, sizes: DataFrame | None = None
) -> DataFrame:
    """Linearly interpolated quantiles of ``value`` per ``keys`` (none: of the whole table).

    Values are written once, beside their keys alone; then groups are counted, and those above ``limit`` rows, of which
    there are few, are taken out for ``radix_quantiles``. A caller whose rows are a table already and who knows their
    ``sizes`` (``keys`` and, in _n, values that are not NULL; written) spares both.
    """
    by = list(keys) or ["_all"]
    base = df if keys else df.withColumn("_all", F.lit(0))
    known = base.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if sizes is None:
        known = cut(known)
        large = cut(known.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit))
    else:
        large = sizes.select(*by, "_n").where(F.col("_n") > limit)
    many = not large.isEmpty()
    same = known[by[0]].eqNullSafe(large[by[0]])
    for k in by[1:]:
        same = same & known[k].eqNullSafe(large[k])
    rest = known.join(F.broadcast(large), same, "left_anti") if many else known
    wanted = F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs.values()])).alias("_q")
    found = rest.groupBy(*by).agg(wanted).select(*keys, *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)])
    if not many:
        return found
    return found.unionByName(radix_quantiles(known.join(F.broadcast(large), same, "left_semi"), large, by, probs, limit).select(*keys, *probs))


def radix_quantiles(rows: DataFrame, sizes: DataFrame, by: list[str], probs: dict[str, float], limit: int) -> DataFrame:
    """Quantiles of ``rows`` (``by``, _v) for the groups of ``sizes`` (``by``, _n), a bounded number of large ones.

    ``cells`` are the cells still too large, with the rows below them and the ranks wanted in them: at most two a quantile and
    group, so they are broadcast. Every round counts the next bits inside them.
    """
    position = {name: F.lit(float(p)) * (F.col("_n") - 1) for name, p in probs.items()}
    ends = F.array_distinct(F.array(*[f(r).cast("long") for r in position.values() for f in (F.floor, F.ceil)]))
    bits = rows.withColumn("_bits", ordered_bits(F.col("_v")))
    cells = cut(sizes.select(*by, F.lit(0).cast("long").alias("_cell"), F.lit(0).cast("long").alias("_below"), ends.alias("_ranks")))
    prefix = lambda depth: F.shiftright("_bits", 64 - depth) if depth else F.lit(0).cast("long")
    picked, before = [], 0
    for depth in DEPTHS:
        inside = _met(bits.withColumn("_cell", prefix(before)), cells, by)
        counted = inside.groupBy(*by, "_cell", prefix(depth).alias("_next")).agg(
            F.count(F.lit(1)).alias("_in"), F.min("_v").alias("_least"), F.first("_below").alias("_below"), F.first("_ranks").alias("_ranks"))
        ahead = Window.partitionBy(*by, "_cell").orderBy("_next").rowsBetween(Window.unboundedPreceding, -1)
        placed = counted.withColumn("_from", F.col("_below") + F.coalesce(F.sum("_in").over(ahead), F.lit(0)))
        mine = F.filter("_ranks", lambda r: (r >= F.col("_from")) & (r < F.col("_from") + F.col("_in")))
        hit = cut(placed.withColumn("_mine", mine).where(F.size("_mine") > 0).select(
            *by, F.col("_next").alias("_cell"), F.col("_from").alias("_below"), F.col("_mine").alias("_ranks"), "_in", "_least"))
        if depth == 64:  # one value each
            picked.append(hit.select(*by, F.explode("_ranks").alias("_rank"), F.col("_least").alias("_at")))
            break
        small = hit.where(F.col("_in") <= limit).drop("_in", "_least")
        opened = _met(bits.withColumn("_cell", prefix(depth)), small, by).groupBy(*by, "_cell").agg(
            F.sort_array(F.collect_list("_v")).alias("_sorted"), F.first("_below").alias("_below"), F.first("_ranks").alias("_ranks"))
        picked.append(opened.select(*by, "_sorted", "_below", F.explode("_ranks").alias("_rank")).select(
            *by, "_rank", F.element_at("_sorted", (F.col("_rank") - F.col("_below") + 1).cast("int")).alias("_at")))
        cells, before = hit.where(F.col("_in") > limit).drop("_in", "_least"), depth
        if cells.isEmpty():
            break
    values = picked[0]
    for part in picked[1:]:
        values = values.unionByName(part)
    at = values.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_at"))).alias("_at"))
    joined = _met(at, sizes, by)
    out = []
    for name, r in position.items():
        low, high = (F.element_at("_at", f(r).cast("long")) for f in (F.floor, F.ceil))
        out.append(F.when(F.floor(r) == F.ceil(r), low).otherwise((F.ceil(r) - r) * low + (r - F.floor(r)) * high).alias(name))
    return joined.select(*by, *out)


def _met(rows: DataFrame, few: DataFrame, by: list[str]) -> DataFrame:
    """Rows joined with a bounded table on the group, NULL groups included, and the cell if both have one."""
    on = [*by, *(["_cell"] if "_cell" in few.columns else [])]
    renamed = few.withColumnsRenamed({c: f"_few_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_few_{c}"))
    return rows.join(F.broadcast(renamed), same).drop(*[f"_few_{c}" for c in on])


def exact_medians(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5})


def stacked(df: DataFrame, keys: list[str], columns: list[str], metric: str = "metric", value: str = "value") -> DataFrame:
    """Long form of several value columns, for quantiles of many columns in one pass."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keys, columns, metric, value)


def weighted_medians(df: DataFrame, keys: list[str], value: str, weight: str, name: str) -> DataFrame:
    """First value, in ascending order, at which the cumulative weight reaches half of the group's total."""
    by = list(keys) or ["_all"]
    base = df if keys else df.withColumn("_all", F.lit(0))
    counted = (
        base.select(*by, F.col(value).cast("double").alias("_v"), F.col(weight).cast("double").alias("_w"))
        .where(F.col("_v").isNotNull())
        .groupBy(*by, _cell(F.col("_v")).alias("_cell"), "_v").agg(F.sum("_w").alias("_w"))
    )
    near = _crossed(counted, by, "_cell")
    here = Window.partitionBy(*by, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    opened = counted.join(near, [*by, "_cell"]).withColumn("_upto", F.col("_below") + F.sum("_w").over(here))
    return _reached(opened, by, name).select(*keys, name)


def _crossed(counted: DataFrame, by: list[str], cell: str) -> DataFrame:
    """Cells in which the cumulative weight reaches half of the total, with the weight below them and that half."""
    cells = counted.groupBy(*by, cell).agg(F.sum("_w").alias("_in"))
    before = Window.partitionBy(*by).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.select(
        *by, cell, "_in", F.coalesce(F.sum("_in").over(before), F.lit(0.0)).alias("_below"),
        (F.sum("_in").over(Window.partitionBy(*by)) / 2).alias("_half"))
    # a cell at either side of the crossing is kept, so rounding in the sums cannot lose it
    slack = F.col("_half") * 1e-9
    return placed.where((F.col("_below") <= F.col("_half") + slack) & (F.col("_below") + F.col("_in") >= F.col("_half") - slack))


def _reached(opened: DataFrame, by: list[str], name: str) -> DataFrame:
    reached = opened.where(F.col("_upto") >= F.col("_half") - F.col("_half") * 1e-12)
    return reached.groupBy(*by).agg(F.min("_v").alias(name))


COARSE = 256  # cells that the first round of few groups takes together


def weighted_medians_of_few(df: DataFrame, keys: list[str], value: str, weight: str, name: str) -> DataFrame:
    """``weighted_medians`` of few groups of any size, whose keys are not NULL. ``df`` is read twice.

    Weights are summed by wide cells first, combined before they are exchanged; only rows of the cells that a median may be
    in, a few for each group, are exchanged and put in order.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"), F.col(weight).cast("double").alias("_w")).where(F.col("_v").isNotNull())
    wide = rows.withColumn("_wide", F.floor(_cell(F.col("_v")) / COARSE))
    near = cut(_crossed(wide, keys, "_wide").drop("_in"))
    inside = wide.join(F.broadcast(near), [*keys, "_wide"]).groupBy(*keys, "_wide", "_v").agg(
        F.sum("_w").alias("_w"), F.first("_below").alias("_below"), F.first("_half").alias("_half"))
    here = Window.partitionBy(*keys, "_wide").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return _reached(inside.withColumn("_upto", F.col("_below") + F.sum("_w").over(here)), keys, name)
