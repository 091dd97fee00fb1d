"""Ordered-stream operators that never put one stream into one task.

A stream (one door, one recording) may hold a large share of all rows, so nothing here windows over a whole stream. A
sample of the order columns cuts every long stream into ranges of about equal rows; rows are exchanged once, by
(stream, range), and windowed inside their range. What crosses a border is carried by a table with one row per range of
a long stream: the sums, counts and ends of the ranges before. Where no stream is longer than a range, there is no border.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayside.session import cut as written

RANGE = "_range"
TASK_ROWS = 2_000_000  # rows of one range
LEAST_ROWS = 256  # a range is not made smaller than this to employ more tasks
SAMPLED = 64  # rows sampled for one range: its size is off by an eighth (one standard deviation)


@dataclass(frozen=True)
class Order:
    """How rows of a stream are ordered.

    keys:  identity of the stream (no NULLs).
    at:    first order column, mostly microseconds or a sample index; NULLs come first.
    ties:  further columns that make the order total. Rows equal in all of them cannot be parted.
    limit: rows of one range; ranges are smaller where a table of n rows spread over all tasks gives smaller shares.
    bounds, bound_keys, steps: where the ranges of the long streams begin, set by ``sampled``.
    """

    keys: tuple[str, ...]
    at: str
    ties: tuple[str, ...] = ()
    limit: int = TASK_ROWS
    bounds: DataFrame | None = field(default=None, repr=False)
    bound_keys: tuple[str, ...] = ()
    steps: tuple[int, ...] = ()

    def within(self, *keys: str) -> "Order":
        """The order inside parts of the streams; ranges stay those of the streams."""
        return replace(self, keys=tuple(keys))

    @property
    def sort(self) -> list[str]:
        return [self.at, *self.ties]

    @property
    def parts(self) -> list[str]:
        return [*self.keys, RANGE]

    @property
    def many(self) -> bool:
        """Whether any stream has more than one range."""
        return bool(self.steps)

    def rows(self):
        return Window.partitionBy(*self.parts).orderBy(*self.sort)

    def ranges(self):
        return Window.partitionBy(*self.keys).orderBy(RANGE)

    def sampled(self, df: DataFrame) -> "Order":
        """The same order, with the bounds of the ranges that the streams of ``df`` are cut into.

        Rows are drawn by a hash of their place, and every SAMPLED-th drawn row of a long stream begins a range. Bounds only
        balance the work: they serve any rows with these keys and order columns, so one sample does for many operators.
        Where every stream fits a range, which the counts of its rows tell, nothing is drawn.
        """
        keys = list(self.keys)
        slim = df.select(*keys, *self.sort)
        n, longest = slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(
            F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()  # one row
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        share = min(self.limit, max(LEAST_ROWS, n // tasks))
        if longest <= share:
            none = slim.select(*keys, F.array(F.struct(*self.sort)).alias("_bounds")).limit(0)
            return replace(self, bounds=none, bound_keys=self.keys, steps=())
        all_hashes = 1 << 40
        drawn = F.pmod(F.xxhash64(*keys, *self.sort), F.lit(all_hashes)) < all_hashes * SAMPLED // max(share, SAMPLED)
        some = slim.where(drawn).select(*keys, F.struct(*self.sort).alias("_place"))
        stream = Window.partitionBy(*keys)
        numbered = some.select(
            *keys, "_place", F.row_number().over(stream.orderBy("_place")).alias("_r"), F.count(F.lit(1)).over(stream).alias("_n"))
        ranges = F.greatest(F.round(F.col("_n") / min(share, SAMPLED)), F.lit(1))
        number = lambda r: F.floor(r * ranges / F.col("_n"))
        begins = numbered.where(number(F.col("_r") - 1) > number(F.col("_r") - 2)).where("_r > 1")
        bounds = written(begins.groupBy(*keys).agg(F.sort_array(F.collect_list("_place")).alias("_bounds")))
        most = bounds.agg(F.max(F.size("_bounds"))).first()[0] or 0  # one row
        steps = tuple(1 << i for i in reversed(range(most.bit_length())))
        return replace(self, bounds=bounds, bound_keys=self.keys, steps=steps)

    def dealt(self, df: DataFrame) -> tuple["Order", DataFrame]:
        """The sampled order, and ``df`` with the number of each row's range and whether its stream has several (``_many``).

        The bounds are broadcast: at most one for every half limit of rows.
        """
        order = self if self.bounds is not None else self.sampled(df)
        if not order.many:
            return order, df.withColumns({RANGE: F.lit(0), "_many": F.lit(False)})
        place = F.struct(*self.sort)
        below = lambda at, step: at + F.when(F.get("_bounds", at + step - 1) <= place, step).otherwise(0)
        number = F.aggregate(F.array(*map(F.lit, order.steps)), F.lit(0), below)
        known = df.join(F.broadcast(order.bounds), list(order.bound_keys), "left")
        return order, known.select(
            *[F.col(c) for c in df.columns], F.when(F.col("_bounds").isNull(), 0).otherwise(number).alias(RANGE),
            F.col("_bounds").isNotNull().alias("_many"))


def _inside(df: DataFrame, order: Order, *columns: Column | Callable) -> tuple[Order, DataFrame]:
    """Rows with values computed inside their ranges; written once if borders have to be looked at."""
    order, dealt = order.dealt(df)
    rows = dealt.select("*", *[c(order.rows()) if callable(c) else c for c in columns])
    return order, written(rows) if order.many else rows


def _row(w) -> Column:
    return F.row_number().over(w).cast("long").alias("_row")


def _size(w) -> Column:
    return F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_size")


def _carried(rows: DataFrame, order: Order, carry: DataFrame) -> DataFrame:
    """Rows with the columns of ``carry`` (a row per range) for keys that reach over a border.

    A border is crossed by one key, so at most two rows for every border are left to be broadcast.
    """
    crossing = carry.withColumn("_reach", F.count(F.lit(1)).over(Window.partitionBy(*order.keys))).where("_reach > 1")
    return rows.join(F.broadcast(crossing.drop("_reach")), order.parts, "left")


def shifted(df: DataFrame, order: Order, columns: dict[str, str], steps: int) -> DataFrame:
    """Columns (new name: old name) of the row ``steps`` later, or earlier if negative; NULL where there is none.

    Only the rows within ``steps`` of a border look for theirs in the rows at the borders of the ranges beyond.
    """
    k, ahead = abs(steps), steps > 0
    names = list(dict.fromkeys(columns.values()))
    here = F.struct(*names)
    step = F.lead if ahead else F.lag
    order, rows = _inside(df, order, lambda w: step(here, k).over(w).alias("_got"), _row, _size)
    given = [F.col(c) for c in df.columns]
    new = [F.col(f"_got.{old}").alias(name) for name, old in columns.items()]
    if not order.many:
        return rows.select(*given, *new)
    far = F.col("_size") - F.col("_row") + 1
    mine, theirs = (far, F.col("_row")) if ahead else (F.col("_row"), far)
    at_border = F.col("_many") & (mine <= k)
    listed = rows.where(F.col("_many") & (theirs <= k)).groupBy(*order.parts).agg(
        F.sort_array(F.collect_list(F.struct("_row", here.alias("_here")))).alias("_list"))
    beyond = order.ranges().rowsBetween(*((1, k) if ahead else (-k, -1)))
    found = F.flatten(F.collect_list(F.transform("_list", lambda x: x["_here"])).over(beyond))
    others = listed.select(*order.parts, found.alias("_others"))
    place = (k - mine + 1).cast("int")
    taken = F.try_element_at("_others", place if ahead else -place)
    border = rows.where(at_border).drop("_got").join(others, order.parts, "left").withColumn("_got", taken)
    return rows.where(~at_border).select(*given, *new).unionByName(border.select(*given, *new))


def previous(df: DataFrame, order: Order, *columns: str, prefix: str = "prev_") -> DataFrame:
    """Value of ``columns`` in the row before, NULL in the first row of a stream."""
    return shifted(df, order, {f"{prefix}{c}": c for c in columns}, -1)


def following(df: DataFrame, order: Order, *columns: str, prefix: str = "next_") -> DataFrame:
    return shifted(df, order, {f"{prefix}{c}": c for c in columns}, 1)


def ahead_by(df: DataFrame, order: Order, column: str, steps: int, name: str) -> DataFrame:
    """Value ``steps`` rows later."""
    return shifted(df, order, {name: column}, steps)


#: What running values need: the aggregate and how two of them add up.
RUNNING = {
    "sum": (F.sum, lambda a, b: a + b),
    "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b)),
    "max": (F.max, F.greatest),
}


def running(df: DataFrame, order: Order, value: Column, name: str, how: str = "sum") -> DataFrame:
    """Running sum (or exclusive or, or maximum) of ``value`` up to and including each row."""
    return runnings(df, order, {name: value}, how)


def runnings(df: DataFrame, order: Order, values: dict[str, Column], how: str = "sum") -> DataFrame:
    """Several running values at once: new name, value."""
    whole, add = RUNNING[how]
    named = {f"_v_{name}": value for name, value in values.items()}
    upto = lambda c: lambda w: whole(c).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_in{c}")
    order, rows = _inside(df.withColumns(named), order, *[upto(c) for c in named])
    given = [F.col(c) for c in df.columns]
    if not order.many:
        return rows.select(*given, *[F.col(f"_in_v_{name}").alias(name) for name in values])
    before = order.ranges().rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.where("_many").groupBy(*order.parts).agg(*[whole(c).alias(c) for c in named])
    carry = ends.select(*order.parts, *[whole(c).over(before).alias(f"_to{c}") for c in named])
    joined = _carried(rows, order, carry)
    return joined.select(*given, *[
        F.when(F.col(f"_to_v_{name}").isNull(), F.col(f"_in_v_{name}")).otherwise(
            F.coalesce(add(F.col(f"_to_v_{name}"), F.col(f"_in_v_{name}")), F.col(f"_to_v_{name}"))).alias(name)
        for name in values])


def positions(df: DataFrame, order: Order, name: str = "pos", length: str = "n") -> DataFrame:
    """Zero-based position of each row in its stream and the length of the stream."""
    order, rows = _inside(df, order, _row, _size)
    given = [F.col(c) for c in df.columns]
    if not order.many:
        return rows.select(*given, (F.col("_row") - 1).alias(name), F.col("_size").alias(length))
    before = order.ranges().rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.where("_many").groupBy(*order.parts).agg(F.count(F.lit(1)).alias("_rows"))
    carry = ends.select(
        *order.parts, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_ahead"),
        F.sum("_rows").over(Window.partitionBy(*order.keys)).alias("_stream_size"))
    joined = _carried(rows, order, carry)
    return joined.select(
        *given, (F.coalesce("_ahead", F.lit(0)) + F.col("_row") - 1).alias(name), F.coalesce("_stream_size", "_size").alias(length))


def run_numbers(df: DataFrame, order: Order, columns: Sequence[str], starts: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """Number the runs of a stream from 0. ``starts(before, here)`` says from two neighbouring rows (structs of
    ``columns``) whether a new run begins.

    The table of ranges holds the first and last row of a range and the runs begun inside, so borders are decided there.
    """
    here = F.struct(*columns)
    new = lambda before, now: F.when(before.isNotNull() & starts(before, now), 1).otherwise(0).cast("long")
    order, dealt = order.dealt(df)
    begun = dealt.withColumn("_new", new(F.lag(here).over(order.rows()), here))
    upto = order.rows().rowsBetween(Window.unboundedPreceding, 0)
    rows = begun.withColumn("_in", F.sum("_new").over(upto))
    given = [F.col(c) for c in df.columns]
    if not order.many:
        return rows.select(*given, F.col("_in").alias(name))
    rows = written(rows)
    place = F.struct(*order.sort)
    ends = rows.where("_many").groupBy(*order.parts).agg(
        F.min_by(here, place).alias("_first"), F.max_by(here, place).alias("_last"), F.sum("_new").alias("_n"))
    border = ends.withColumn("_border", new(F.lag("_last").over(order.ranges()), F.col("_first")))
    ahead = order.ranges().rowsBetween(Window.unboundedPreceding, -1)
    carry = border.select(
        *order.parts, (F.coalesce(F.sum(F.col("_n") + F.col("_border")).over(ahead), F.lit(0)) + F.col("_border")).alias("_carry"))
    joined = _carried(rows, order, carry)
    return joined.select(*given, (F.coalesce("_carry", F.lit(0)) + F.col("_in")).alias(name))


def gap_segments(df: DataFrame, order: Order, gap: int, name: str = "segment_id") -> DataFrame:
    """Number the segments of each stream; a new one starts where the step in ``at`` is strictly above ``gap``."""
    return run_numbers(df, order, [order.at], lambda a, b: b[order.at] - a[order.at] > gap, name)


def runs(df: DataFrame, order: Order, value: str, name: str = "run_id") -> DataFrame:
    """Number the maximal runs of equal consecutive values, starting at 0."""
    return run_numbers(df, order, [value], lambda a, b: b[value] != a[value], name)


def longest_run(df: DataFrame, order: Order, flag: Column, name: str = "longest") -> DataFrame:
    """Longest run of consecutive rows with ``flag`` true, per stream. False and NULL end a run."""
    hit = F.coalesce(flag, F.lit(False))
    slim = df.select(*order.keys, *order.sort, hit.alias("_hit"))
    grouped = running(slim, order, F.when(F.col("_hit"), 0).otherwise(1).cast("long"), "_break")
    lengths = grouped.groupBy(*order.keys, "_break").agg(F.sum(F.col("_hit").cast("long")).alias("_len"))
    return lengths.groupBy(*order.keys).agg(F.max("_len").alias(name))


def first_transition(df: DataFrame, order: Order, flag: str, to: int, *extra: str) -> DataFrame:
    """First row where ``flag`` turns to ``to``: its position and the ``extra`` columns there, per stream.

    Everything comes from the table of ranges: rows of a range, the first turn inside, and the flag at both ends.
    """
    columns = list(dict.fromkeys([*order.keys, *order.sort, flag, *extra]))
    order, dealt = order.dealt(df.select(*columns))
    before = F.lag(flag).over(order.rows())
    turned = dealt.select("*", _row(order.rows()), ((F.col(flag) == to) & (before == 1 - to)).alias("_turn"))
    found = F.struct((F.col("_row") - 1).alias("pos"), *extra)
    ends = turned.groupBy(*order.parts).agg(
        F.count(F.lit(1)).alias("_rows"), F.min_by(flag, "_row").alias("_first"), F.max_by(flag, "_row").alias("_last"),
        F.min_by(found, F.col("_row")).alias("_head"), F.min_by(F.when(F.col("_turn"), found), F.when(F.col("_turn"), F.col("_row"))).alias("_in"))
    ahead = order.ranges().rowsBetween(Window.unboundedPreceding, -1)
    border = (F.col("_first") == to) & (F.lag("_last").over(order.ranges()) == 1 - to)
    listed = ends.select(
        *order.keys, F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_ahead"), F.when(border, F.col("_head")).otherwise(F.col("_in")).alias("_hit"))
    hits = listed.where("_hit IS NOT NULL").select(*order.keys, (F.col("_ahead") + F.col("_hit.pos")).alias("_pos"), "_hit")
    first = hits.groupBy(*order.keys).agg(F.min("_pos").alias("pos"), F.min_by("_hit", "_pos").alias("_hit"))
    return first.select(*order.keys, "pos", *[F.col(f"_hit.{c}").alias(c) for c in extra])


def turning_points(df: DataFrame, order: Order, value: str) -> DataFrame:
    """Reversals of a series: plateaus collapse to their first row, monotone interior rows go, both ends stay."""
    known = df.where(F.col(value).isNotNull())
    stepped = previous(known, order, value)
    moved = stepped.where(F.col(f"prev_{value}").isNull() | (F.col(value) != F.col(f"prev_{value}")))
    both = following(moved, order, value)
    rising_in, rising_out = F.col(value) > F.col(f"prev_{value}"), F.col(f"next_{value}") > F.col(value)
    keep = F.col(f"prev_{value}").isNull() | F.col(f"next_{value}").isNull() | (rising_in != rising_out)
    return both.where(keep).select(*df.columns)


def places(df: DataFrame, keys: Sequence[str], by: Sequence[Column], name: str = "place") -> DataFrame:
    """Place (from 1) of every row inside its keys by any sort columns, texts included; equal rows cannot be parted."""
    marked = [f"_by{i}" for i in range(len(by))]
    sortable = df.withColumns(dict(zip(marked, by, strict=True)))
    placed = positions(sortable, Order(tuple(keys), marked[0], tuple(marked[1:])), "_pos", "_len")
    return placed.select(*df.columns, (F.col("_pos") + 1).alias(name))
