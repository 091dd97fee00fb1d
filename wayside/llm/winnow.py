"""Document fingerprints by winnowing, in column expressions alone.

A text is a row of tokens: runs of Latin letters and digits (at most RUN characters at a time, so that an unbroken text is
many tokens too), and every other character but blanks by itself. Every ``k`` neighbouring tokens have a rolling hash: a
polynomial in the hashes of the tokens modulo a prime, made by doubling, since the hash of 2s tokens follows from two hashes
of s. Of every ``w`` consecutive hashes the smallest is chosen, the rightmost of equal ones, and kept with its position. So a
passage of ``k + w - 1`` tokens that two texts share is marked in both by a common hash, wherever it stands, and shared
passages shorter than ``k`` tokens never match.

A text of fewer than ``k`` tokens is one run; one with fewer than ``w`` runs is one window. A row needs memory in proportion
to its text: whole texts are marked, in one piece.

Nulls: a null text is empty and has an empty fingerprint, as has one of blanks. Equal texts have equal fingerprints. Repeated
rows are marked each; a column named like the result is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayside.llm.text import let, whole
from wayside.operators.ordered import RANGE, Order
from wayside.session import cut

RUN = 12
TOKEN = rf"[0-9A-Za-z\x{{80}}-\x{{24F}}]{{1,{RUN}}}|[^\x20\x09-\x0D]"
# A prime below 2^31, so that products of two residues fit a long, and the base of the polynomial.
PRIME, BASE = 2_147_483_647, 911_382_323
DIGITS = 7  # hexadecimal digits of a token's MD5 that make its number
PLACES = 1 << 32  # a mark is hash * PLACES + (PLACES - 1 - position): the smallest is the rightmost of the smallest hashes


def doubled(values: Column, size: int, join: Callable[[Column, Column, int], Column]) -> Column:
    """Array of the values of ``size`` consecutive elements each (a power of two), by joining neighbours again and again."""
    def once(step: int):
        return lambda a: F.transform(a, lambda x, i: join(x, F.get(a, i + step), step))

    step = 1
    while step < size:
        values = let(values, once(step))
        step *= 2
    return values


@dataclass(frozen=True)
class Winnow:
    """``k``: tokens of a run; ``w``: runs of a window; both powers of two."""

    k: int = 4
    w: int = 8

    def __post_init__(self) -> None:
        if any(x < 2 or x & (x - 1) for x in (self.k, self.w)):
            raise ValueError("k and w: powers of two from 2 on")

    @property
    def reach(self) -> int:
        """Tokens of a window: the shortest shared passage that is surely found."""
        return self.k + self.w - 1

    def _runs(self, text: Column) -> Column:
        """Hashes of all runs of a text."""
        number = lambda t: F.conv(F.substring(F.md5(t), 1, DIGITS), 16, 10).cast("long")
        tokens = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), number)
        polynomial = lambda a, b, s: (a * pow(BASE, s, PRIME) + b) % PRIME
        alone = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda h, t: (h * BASE + t) % PRIME)
        return let(tokens, lambda a: F.when(F.size(a) >= self.k, _but_last(doubled(a, self.k, polynomial), self.k - 1)).when(
            F.size(a) > 0, F.array(alone(a))).otherwise(F.array().cast("array<bigint>")))

    def marks(self, text: Column) -> Column:
        """Packed marks of a text, in the order of their windows."""
        placed = F.transform(self._runs(text), lambda h, i: h * PLACES + (PLACES - 1 - i))
        smallest = let(placed, lambda m: F.when(
            F.size(m) >= self.w, _but_last(doubled(m, self.w, lambda a, b, _: F.least(a, b)), self.w - 1)
        ).otherwise(F.filter(F.array(F.array_min(m)), lambda x: x.isNotNull())))
        return F.array_distinct(smallest)


def _but_last(values: Column, n: int) -> Column:
    return let(values, lambda a: F.slice(a, 1, F.size(a) - n))


def spelled(marks: Column) -> Column:
    """Marks as an array of (pos, hash), by position."""
    return F.array_sort(F.transform(marks, lambda m: F.struct(
        (F.lit(PLACES - 1) - m % PLACES).alias("pos"), F.shiftright(m, 32).alias("hash"))))


def hash_set(marks: Column) -> Column:
    return F.array_distinct(F.transform(marks, lambda m: F.shiftright(m, 32)))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes of two sets, of all their hashes; two empty sets are alike."""
    met, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(every == 0, 1.0).otherwise(met / every)


def as_text(marks: Column) -> Column:
    """A fingerprint as a string: position:hash by position, separated by commas."""
    return F.array_join(F.transform(spelled(marks), lambda m: F.concat_ws(":", m["pos"].cast("string"), F.lower(F.hex(m["hash"])))), ",")


def fingerprints(docs: DataFrame, text: str = "text", how: Winnow = Winnow(), name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of every text: an array of (pos, hash) by position."""
    return docs.withColumn(name, spelled(how.marks(whole(text))))


def beside_next(docs: DataFrame, key: str = "doc_id", text: str = "text", how: Winnow = Winnow(), limit: int = 50_000) -> DataFrame:
    """Every document with its marks and those of the next by ascending ``key``: doc_id, text, marks, next_text, next_marks.

    After the last comes the first. Null keys come first; rows with equal keys are ordered by a hash of their text. Texts are
    dealt out once, by ranges of the key of about ``limit`` rows at most; the first row of a range goes to the range before
    as well, where it stands behind the last. Marks are made after that, so that only texts travel.
    """
    slim = docs.select(F.lit(0).alias("_all"), F.col(key).alias("doc_id"), whole(text).alias("text")).withColumn("_tie", F.xxhash64("text"))
    _, dealt = Order(("_all",), "doc_id", ("_tie",), limit).dealt(slim)
    place = F.struct("doc_id", "_tie")
    every = Window.partitionBy(F.lit(0))  # one row for each range
    before = F.coalesce(F.lag(RANGE).over(every.orderBy(RANGE)), F.max(RANGE).over(every))
    heads = cut(dealt.groupBy(RANGE).agg(F.min(place).alias("_head"))).select(F.col(RANGE).alias("_of"), "_head", before.alias("_to"))
    found = dealt.join(F.broadcast(heads), (F.col(RANGE) == F.col("_of")) & (place == F.col("_head")), "left")
    at = lambda r, ahead: F.struct(F.col(r).alias("r"), F.lit(ahead).alias("ahead"))
    spread = found.select("doc_id", "_tie", "text", F.explode(
        F.filter(F.array(at(RANGE, False), at("_to", True)), lambda p: p["r"].isNotNull())).alias("_at"))
    marked = spread.select("doc_id", "_tie", "text", "_at.*").repartition("r").select("*", how.marks(F.col("text")).alias("marks"))
    inside = Window.partitionBy("r").orderBy("ahead", "doc_id", "_tie")
    told = marked.select("*", *[F.lead(c).over(inside).alias(f"next_{c}") for c in ("text", "marks")])
    return told.where("NOT ahead").select("doc_id", "text", "marks", "next_text", "next_marks")
