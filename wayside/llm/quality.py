"""Quality rules whose cutoffs are certified on labelled rows.

Fixed rules reject what is too short or repeats itself. Beyond them, every signal has a fixed list of candidate cutoffs.
A candidate is certified for a stratum if the exact binomial tail says that it rejects less than ``risk / signals`` of the
good documents there, at a level shared among all candidates of all strata (Bonferroni). Rejection by any signal is then
wrong for at most ``risk`` of the good documents of a stratum, with probability 1 - ``error`` over all strata at once.

A stratum is a language itself, however many there are. Cutoffs are joined to documents by it: one row per stratum, which
Spark broadcasts if the table of them turns out small, and else shuffles, hot languages split.

Nulls: a null text is an empty one (rejected, no words); a null language is a stratum of its own; labels without doc_id or
value, and documents labelled both ways, certify nothing. With no labels nothing beyond the fixed rules is rejected.
Repeated rows are judged one by one and equally; labels count once per document row. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayside.llm.text import NOT_SPACE, whole, words
from wayside.session import cut

SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Signal:
    """A number that is larger the worse a text is, and the cutoffs that may be chosen for it."""

    name: str
    value: Column
    cutoffs: tuple[float, ...]

    def above(self) -> Column:
        """How many of the cutoffs, from the first, the value is above."""
        return F.size(F.filter(F.array(*map(F.lit, self.cutoffs)), lambda c: self.value > c))


def signals() -> list[Signal]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = tuple(round(0.02 * i, 2) for i in range(1, 25))
    return [
        Signal("symbols", F.col("n_symbols") / n, tuple(round(0.05 * i, 2) for i in range(1, 25))),
        Signal("dup_lines", F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), share),
        Signal("repeats", F.col("n_repeat_words") / n, share),
        Signal("long_words", F.col("word_chars") / n, tuple(6.0 + 0.5 * i for i in range(24))),
    ]


def repeated_words(w: Column, span: int = 3) -> Column:
    """How many word positions lie in a ``span``-word window that the text holds at least twice.

    Windows are sorted by hash, neighbours compared, and the covered positions counted: n log n for any text.
    """
    count = F.greatest(F.size(w) - (span - 1), F.lit(0))
    windows = F.transform(
        F.slice(w, 1, count),
        lambda x, i: F.struct(F.xxhash64(x, *[F.get(w, i + j) for j in range(1, span)]).alias("h"), i.alias("i")),
    )
    return windows, span


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts the rules work on (columns of these names in ``docs`` are replaced)."""
    windows, span = repeated_words(F.col("__words"))
    split = docs.withColumn("__words", words(text)).withColumn(
        "__lines", F.filter(F.split(whole(text), "\n"), lambda x: x.rlike(NOT_SPACE))
    )
    counted = split.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": F.regexp_count(whole(text), F.lit(SYMBOLS)).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__sorted": F.sort_array(windows),
    }).drop("__words", "__lines")
    hash_at = lambda j: F.get(F.col("__sorted"), j)["h"]
    twins = F.filter("__sorted", lambda e, j: (hash_at(j - 1) == e["h"]) | (hash_at(j + 1) == e["h"]))
    placed = counted.withColumn("__places", F.sort_array(F.transform(twins, lambda e: e["i"]))).drop("__sorted")
    steps = F.transform("__places", lambda x, j: F.least(F.lit(span), F.get(F.col("__places"), j + 1) - x))
    return placed.withColumn(
        "n_repeat_words", F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    ).drop("__places")


def base_failed() -> Column:
    """The fixed rules: under 50 words, or over half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def log_gamma(x: Column) -> Column:
    """ln Γ(x) for x >= 1, to about 13 digits: Stirling's series at x + 8, stepped back."""
    y = x + 8.0
    back = F.ln(x)
    for i in range(1, 8):
        back = back + F.ln(x + float(i))
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3.0)) + 1 / (1260 * F.pow(y, 5.0)) - 1 / (1680 * F.pow(y, 7.0))
    return (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + series - back


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(Bin(n, rate) <= k), exact up to double precision where it is below about a half; 1 elsewhere.

    Below the mean the terms fall from k downwards, so the sum ends after some multiples of the standard deviation.
    """
    kd, nd = k.cast("double"), n.cast("double")
    top = (log_gamma(nd + 1) - log_gamma(kd + 1) - log_gamma(nd - kd + 1)
           + kd * F.ln(F.lit(rate)) + (nd - kd) * F.ln(F.lit(1 - rate)))
    down = F.sequence(F.lit(0), F.least(k, (F.sqrt(nd) * 12 + 40).cast("long")).cast("int"))
    start = F.struct(F.lit(0.0).alias("total"), F.lit(1.0).alias("term"))
    total = F.aggregate(
        down, start,
        lambda a, j: F.struct(
            (a["total"] + a["term"]).alias("total"),
            (a["term"] * (kd - j) / (nd - kd + j + 1) * ((1 - rate) / rate)).alias("term"),
        ),
        lambda a: a["total"],
    )
    return F.when((nd > 0) & (kd < nd * rate), F.least(F.lit(1.0), F.exp(top) * total)).otherwise(F.lit(1.0))


def stratum(by: str) -> Column:
    """The value itself, marked so that null is a key of its own and equal to no value."""
    return F.when(F.col(by).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(by).cast("string")))


def certify(rows: DataFrame, risk: float = 0.02, error: float = 0.05, lift: float = 5.0) -> DataFrame:
    """Certified cutoffs: one row per stratum and signal, from rows with ``stratum``, ``good`` and the counts.

    Among a signal's certified cutoffs the one that rejects most bad rows is taken, of equals the highest. It must reject
    ``lift`` times as large a share of them as of good ones, else the signal is not used there. Counting is by cell of the grid, before anything is shuffled.
    """
    found = signals()
    cells = F.array(*[F.struct(F.lit(k).alias("signal"), s.above().alias("above")) for k, s in enumerate(found)])
    counts = (
        rows.select("stratum", "good", F.explode(cells).alias("cell"))
        .groupBy("stratum", F.col("cell.signal").alias("signal"), F.col("cell.above").alias("above"))
        .agg(F.sum(F.col("good").cast("long")).alias("g"), F.sum((~F.col("good")).cast("long")).alias("b"))
    )
    kinds = F.create_map(*[x for k, s in enumerate(found) for x in (F.lit(k), F.array(*map(F.lit, s.cutoffs)))])
    # a cell "above = a" is rejected by the first a cutoffs; a group has 25 cells at most
    per = counts.groupBy("stratum", "signal").agg(
        F.sum("g").alias("n_good"), F.sum("b").alias("n_bad"),
        F.collect_list(F.struct("above", "g", "b")).alias("cells"),
    )
    tried = per.select("stratum", "signal", "n_good", "n_bad", "cells", F.posexplode(kinds[F.col("signal")]).alias("i", "cutoff"))
    over = lambda name: F.aggregate(
        F.filter("cells", lambda c: c["above"] > F.col("i")), F.lit(0).cast("long"), lambda a, c: a + c[name])
    tried = tried.select("stratum", "signal", "n_good", "n_bad", "cutoff", over("g").alias("g"), over("b").alias("b"))
    tests = F.broadcast(tried.agg(F.count("*").alias("tests")))  # one row
    share = risk / len(found)
    certain = tried.crossJoin(tests).where(binomial_tail(F.col("g"), F.col("n_good"), share) <= error / F.col("tests"))
    useful = certain.where((F.col("b") > 0) & (F.col("b") * F.col("n_good") >= lift * F.col("g") * F.col("n_bad")))
    return useful.groupBy("stratum", "signal").agg(
        F.max(F.struct("b", "cutoff"))["cutoff"].alias("cutoff")
    )


def verdicts(counted: DataFrame, chosen: DataFrame) -> DataFrame:
    """``counted`` (stratum and counts) with base_failed, rejected_by and kept, by the certified cutoffs."""
    found = signals()
    limits = cut(chosen.groupBy("stratum").agg(*[
        F.max(F.when(F.col("signal") == k, F.col("cutoff"))).alias(f"max_{s.name}") for k, s in enumerate(found)
    ]))  # written, so that its size is known when the join is planned
    hits = F.filter(
        F.array(*[F.when(s.value > F.col(f"max_{s.name}"), F.lit(s.name)) for s in found]), lambda x: x.isNotNull())
    joined = counted.join(limits, "stratum", "left")
    failed = joined.withColumn("base_failed", base_failed()).withColumn("rejected_by", hits)
    return failed.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def calibrated(docs: DataFrame, labels: DataFrame, by: str, key: str, text: str, risk: float, error: float):
    """(counts of every document, certified cutoffs). The counts, without texts, are written once and read by both uses."""
    counted = features(docs.select(key, by, text), text).withColumn("stratum", stratum(by))
    counted = cut(counted.select(key, by, "stratum", *COUNTS))
    sure = (
        labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull())
        .groupBy(key).agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
        .where("low = high").select(key, (F.col("low") == 1).alias("good"))
    )
    return counted, cut(certify(counted.where(~base_failed()).join(sure, key), risk, error))


def judge(docs: DataFrame, labels: DataFrame, by: str = "lang", key: str = "doc_id", text: str = "text",
          risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """One row per document: key, ``by``, the counts, base_failed, the signals that rejected it, and kept."""
    counted, chosen = calibrated(docs, labels, by, key, text, risk, error)
    return verdicts(counted, chosen).select(key, by, *COUNTS, "base_failed", "rejected_by", "kept")


def accepted(docs: DataFrame, labels: DataFrame, by: str = "lang", key: str = "doc_id", text: str = "text",
             risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns. Verdicts are made in the row: texts stay in place."""
    _, chosen = calibrated(docs, labels, by, key, text, risk, error)
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col(by).alias("__by"), F.col(text).alias("__text"))
    counted = features(rows, "__text").withColumn("stratum", stratum("__by"))
    # a filter on the verdict itself would be moved below the counts, and these made anew for every place that names them
    judged = verdicts(counted, chosen).select("__row", F.explode_outer(F.array("kept")).alias("__keep"))
    return judged.where("__keep").select("__row.*")
