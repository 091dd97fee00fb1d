"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a budget of words. Whole epochs of the source come first; for the rest of the budget, documents are drawn
without replacement with probability by quality weight: each gets the exponential key -ln(u) / weight, and the smallest
keys are taken until the prefix sum of sizes meets the budget (the last one only if that comes nearer to it).

A source is never sorted as a whole. Keys fall into ranges, sizes are summed by source and range, and only the one range in
which the budget ends is ordered, so a source with a third of all rows is as well spread as any other. What results is one
cutoff per source, and taking a document is a comparison with it.

Rows that tie on key, id and size are counted as one group, never ordered. If the budget ends inside a group, as many of its
rows are drawn as still fit, by hashed row numbers that fall into ranges as keys do.

Nulls: a null text has size 0 and is taken zero words; a null source is a source of its own, last in the order; a null
document id is an id like any other, but its key depends on the text as well, so that such rows are drawn by chance too.
Repeated rows share their key and are separate rows; ties of keys go by id, then size. Empty
sources have target 0. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayside.llm.text import unit, whole, words
from wayside.session import cut

RANGES = 65536  # key ranges of a source; only one of them is ordered


def repeating_weights(weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> Column:
    """Weight of a source by its place in code point order (null last), ``weights`` repeating."""
    return F.get(F.array(*map(F.lit, weights)), F.pmod(F.col("place") - 1, F.lit(len(weights))))


def targets(sources: DataFrame, weight: Column, share: float = 1.0, most_epochs: float = 3.0) -> DataFrame:
    """Words to take from each source: ``share`` of all words, split by weight, none above ``most_epochs`` of its size.

    ``sources`` has one row per source (source, source_size), summed before, and is small beside the documents. The excess
    of sources at their limit goes to the others by weight until none is above: there is one level such that the sum of
    min(limit, weight * level) is the whole. With sources in order of limit / weight it is found at the first that stays
    under its limit.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    order = Window.orderBy("rate", "place")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    placed = sources.withColumn("place", F.row_number().over(named)).withColumn("weight", weight)
    rated = placed.withColumn("limit", F.col("source_size") * F.lit(float(most_epochs))).withColumn(
        "rate", F.col("limit") / F.col("weight")
    )
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    tried = rated.withColumn("level", left / F.sum("weight").over(onward))
    under = F.col("level") <= F.col("rate")  # from the first such source on, levels only fall
    found = tried.withColumn("water", F.max(F.when(under, F.col("level"))).over(every)).withColumn(
        "free", F.min(F.when(under, F.col("rate"))).over(every)
    )
    full = F.col("water").isNull() | (F.col("rate") < F.col("free"))
    target = F.when(full, F.col("limit")).otherwise(F.least(F.col("limit"), F.col("weight") * F.col("water")))
    return found.select("source", "source_size", "weight", target.alias("target"))


def text_weight(text: str) -> Column:
    """Quality weight between 0.1 and 1: falls with the share of characters that are no letter, digit, space or stop."""
    odd = F.regexp_count(whole(text), F.lit(r"[^\p{L}\p{N}\s.,]"))
    return F.greatest(F.lit(0.1), 1 - 4 * odd / F.greatest(F.length(whole(text)), F.lit(1)))


def drawing_key(key: str, quality: Column, seed: str, text: str) -> Column:
    nameless = unit(F.lit(seed), F.lit("null"), whole(text))
    return -F.ln(F.when(F.col(key).isNull(), nameless).otherwise(unit(F.lit(seed), F.col(key)))) / quality


def key_range() -> Column:
    """Range of a key: grows with it, and no range holds much more than its share of keys."""
    return F.least(F.floor((1 - F.exp(-F.col("key") / 4)) * RANGES), F.lit(RANGES - 1)).cast("int")


def cutoffs(slim: DataFrame, weight: Column, share: float, most_epochs: float) -> DataFrame:
    """One row per source: source_size, target, epochs, and up to which (range, key, id, size) a document is drawn once more.

    ``left`` is how many rows of that last group are drawn if the budget ends inside it; else it is null and all of them are.
    """
    sums = slim.groupBy("source", "part").agg(F.sum("size").alias("size"))
    sources = sums.groupBy("source").agg(F.sum("size").alias("source_size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budget = cut(
        targets(sources, weight, share, most_epochs).withColumn("epochs", epochs.cast("int"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    )
    upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    running = sums.withColumn("before", F.coalesce(F.sum("size").over(upto), F.lit(0)))
    ends = cut(
        running.alias("s").join(budget.alias("b"), F.expr("s.source <=> b.source AND s.before <= b.rest"))
        .groupBy("b.source").agg(F.max(F.struct("part", "before", "rest")).alias("end"))
        .select("source", "end.*")
    )
    inside = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    # of n equal sizes after a sum, the j-th is taken if its middle is within the budget: sum + (j - 1/2) * size <= rest
    room = F.floor((F.col("rest") - F.col("upto")) / F.col("size") + 0.5)
    edge = (
        slim.alias("d").join(ends.alias("e"), F.expr("d.source <=> e.source AND d.part = e.part"))
        .groupBy("d.source", "key", "doc_id", "size")
        .agg(F.count("*").alias("n"), F.first("before").alias("before"), F.first("rest").alias("rest"))
        .withColumn("upto", F.col("before") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(inside), F.lit(0)))
        .withColumn("fit", F.when(F.col("size") > 0, F.least("n", room)).when(F.col("upto") <= F.col("rest"), F.col("n")))
        .where("fit > 0")
        .groupBy("source").agg(F.max(F.struct(F.struct("key", "doc_id", "size").alias("edge"), "n", "fit")).alias("last"))
        .select("source", "last.edge", F.expr("CASE WHEN last.fit < last.n THEN last.fit END").alias("left"))
    )
    return cut(
        budget.alias("b").join(ends.alias("e"), F.expr("b.source <=> e.source"), "left")
        .join(edge.alias("l"), F.expr("b.source <=> l.source"), "left")
        .select("b.source", "source_size", "target", "epochs", F.col("part").alias("end_part"), "edge", "left")
    )


def place(size: Column) -> Column:
    return F.struct(F.col("key").alias("key"), F.col("doc_id").alias("doc_id"), size.alias("size"))


def copies(size: Column | None = None) -> Column:
    """How often the mix takes a document that stands beside its source's cutoff; ``tied`` ones may be drawn once more."""
    here = place(F.col("size") if size is None else size)
    drawn = (F.col("part") < F.col("end_part")) | (
        (F.col("part") == F.col("end_part")) & ((here < F.col("edge")) | ((here == F.col("edge")) & F.col("left").isNull()))
    )
    return F.col("epochs") + F.coalesce(drawn, F.lit(False)).cast("int")


def tied(size: Column | None = None) -> Column:
    """Whether a document beside its source's cutoff is in a group of which only ``left`` rows are drawn."""
    here = place(F.col("size") if size is None else size)
    return F.coalesce(F.col("left").isNotNull() & (F.col("part") == F.col("end_part")) & (here == F.col("edge")), F.lit(False))


def draw_tied(rows: DataFrame) -> DataFrame:
    """``rows`` (tied ones with source, left and a unique ``row``; a written table) with how many more of each are drawn.

    Exactly ``left`` of a source are, those of the smallest hashes: counted by range, and one range ordered.
    """
    dealt = rows.withColumn("deal", F.xxhash64("row")).withColumn("at", F.pmod("deal", F.lit(RANGES)).cast("int"))
    upto = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("source", "at").agg(F.count("*").alias("n"), F.first("left").alias("left"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    ends = before.where("before < left").groupBy("source").agg(
        F.max(F.struct("at", (F.col("left") - F.col("before")).alias("more"))).alias("end")).select("source", "end.*")
    order = Window.partitionBy("source").orderBy("deal", "row")
    last = cut(
        dealt.alias("d").join(ends.alias("e"), F.expr("d.source <=> e.source AND d.at = e.at"))
        .select("d.source", "d.at", "deal", "row", "more").withColumn("rank", F.row_number().over(order))
        .where("rank = more").select("source", F.struct("at", "deal", "row").alias("last"))
    )  # one row per source
    drawn = F.coalesce(F.struct("at", "deal", "row") <= F.col("last"), F.lit(False)).cast("int")
    return dealt.alias("d").join(last.alias("l"), F.expr("d.source <=> l.source"), "left").select(
        *[F.col(f"d.`{c}`") for c in rows.columns], drawn.alias("more"))


def sized(docs: DataFrame, quality: Column | None, key: str, source: str, text: str, seed: str) -> DataFrame:
    """``docs`` with size, key and key range of every document."""
    return docs.withColumn("size", F.size(words(text)).cast("long")).withColumn(
        "key", drawing_key(key, quality if quality is not None else text_weight(text), seed, text)
    ).withColumn("part", key_range())


def partly_drawn(rules: DataFrame) -> bool:
    """Whether the budget of any source ends inside a group of ties."""
    return not rules.where("left IS NOT NULL").isEmpty()


def plan(docs: DataFrame, weight: Column | None = None, quality: Column | None = None, key: str = "doc_id",
         source: str = "source", text: str = "text", share: float = 1.0, most_epochs: float = 3.0,
         seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, epochs, copies and taken (copies * size).

    ``weight`` is a column over ``place``, the source's place in code point order; ``quality`` one over ``docs``. The
    sizes and keys are written once, without texts, and the cutoffs come from them.
    """
    slim = cut(
        sized(docs.select(key, source, text), quality, key, source, text, seed)
        .select(F.col(key).alias("doc_id"), F.col(source).alias("source"), "size", "key", "part")
    )
    rules = cutoffs(slim, repeating_weights() if weight is None else weight, share, most_epochs)
    beside = slim.alias("d").join(rules.alias("r"), F.expr("d.source <=> r.source"), "left")
    found = ["doc_id", "size", F.col("d.source").alias("source"), "source_size", "target", "epochs", copies().alias("copies")]
    if partly_drawn(rules):
        ties = cut(beside.where(tied()).select(*found, "left", F.monotonically_increasing_id().alias("row")))
        more = draw_tied(ties).withColumn("copies", F.col("copies") + F.col("more")).drop("left", "row", "more")
        rows = beside.where(~tied()).select(*found).unionByName(more)
    else:
        rows = beside.select(*found)
    return rows.withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, weight: Column | None = None, quality: Column | None = None, key: str = "doc_id",
        source: str = "source", text: str = "text", share: float = 1.0, most_epochs: float = 3.0,
        seed: str = "mix") -> DataFrame:
    """The mixed rows themselves: ``docs``, each row as often as the plan takes it (not at all for 0).

    Taking a row is a comparison with its source's cutoff, so texts are not shuffled. Rows that tie where a budget ends are
    written with their numbers, and the numbers alone are drawn.
    """
    slim = cut(
        sized(docs.select(key, source, text), quality, key, source, text, seed)
        .select(F.col(key).alias("doc_id"), F.col(source).alias("source"), "size", "key", "part")
    )
    rules = cutoffs(slim, repeating_weights() if weight is None else weight, share, most_epochs)
    rows = docs.select(
        F.struct(*docs.columns).alias("__row"), F.col(key).alias("doc_id"), F.col(source).alias("__source"),
        F.col(text).alias("__text"),
        drawing_key(key, quality if quality is not None else text_weight(text), seed, text).alias("key"),
    ).withColumn("part", key_range())
    # the size decides between ties only; rows of other places are not split into words
    close = (F.col("part") == F.col("end_part")) & (F.col("key") == F.col("edge.key"))
    size = F.when(close, F.size(words("__text")).cast("long"))
    beside = rows.alias("d").join(rules.alias("r"), F.expr("d.__source <=> r.source"))
    if partly_drawn(rules):
        ties = cut(beside.where(tied(size)).select(
            "__row", F.col("r.source").alias("source"), "left", copies(size).alias("__n"), F.monotonically_increasing_id().alias("row")))
        taken = beside.where(~tied(size)).select("__row", copies(size).alias("__n")).unionByName(
            draw_tied(ties).select("__row", (F.col("__n") + F.col("more")).alias("__n")))
    else:
        taken = beside.select("__row", copies(size).alias("__n"))
    return taken.where("__n > 0").select("__row", F.explode(F.array_repeat(F.lit(0), F.col("__n").cast("int")))).select("__row.*")
