"""Scores of predictions: interval, rank, class and percentage-error metrics, and comparisons of models.

All of them are one conditional aggregation; groups with few keys still combine map-side first.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayside.functions.columns import col, ratio
from wayside.operators.quantiles import exact_quantiles

# Class names.
CLASSES = ("Normal", "Side I", "Side II")
SYSTEMS = 4


def _sum_where(condition: Column, weight: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, weight)), F.lit(0))


def macro_f1(
    df: DataFrame, by: Sequence[str], truth: str = "label", pred: str = "pred",
    classes: Sequence[str] = CLASSES, weight: str | None = None,
) -> DataFrame:
    """Per-class F1 (columns f1_0, f1_1, …) and their mean over the fixed class list, per ``by``."""
    w = F.col(weight) if weight else F.lit(1)
    t, p = F.col(truth), F.col(pred)
    counts = []
    for i, c in enumerate(classes):
        counts += [
            _sum_where((t == c) & (p == c), w).alias(f"_tp{i}"),
            _sum_where((t != c) & (p == c), w).alias(f"_fp{i}"),
            _sum_where((t == c) & (p != c), w).alias(f"_fn{i}"),
        ]
    summed = df.groupBy(*by).agg(*counts)
    f1 = []
    for i in range(len(classes)):
        tp, fp, fn = (F.col(f"_{x}{i}") for x in ("tp", "fp", "fn"))
        precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
        f1.append(ratio(2 * precision * recall, precision + recall).alias(f"f1_{i}"))
    scored = summed.select(*by, *f1)
    mean = sum((F.col(f"f1_{i}") for i in range(1, len(classes))), F.col("f1_0")) / len(classes)
    return scored.withColumn("macro_f1", mean)


def confusion(df: DataFrame, truth: str = "label", pred: str = "pred", classes: Sequence[str] = CLASSES) -> DataFrame:
    return df.groupBy(truth).pivot(pred, list(classes)).agg(F.count(F.lit(1))).fillna(0)


def interval_f1(true: DataFrame, pred: DataFrame, matched: DataFrame, by: Sequence[str]) -> DataFrame:
    """IoU-weighted F1 from the matched pairs and the number of true and predicted intervals, per ``by``."""
    keys = list(by)
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    hit = matched.groupBy(*keys).agg(F.sum("iou").alias("_total"), F.count(F.lit(1)).alias("n_match"))
    joined = (
        count(true, "n_true").join(count(pred, "n_pred"), keys, "full").join(hit, keys, "left")
        .fillna(0, ["n_true", "n_pred", "n_match", "_total"])
    )
    recall, precision = ratio("_total", "n_true"), ratio("_total", "n_pred")
    return joined.select(
        *keys, "n_true", "n_pred", "n_match",
        recall.alias("soft_recall"), precision.alias("soft_precision"), ratio("_total", "n_match").alias("mean_iou"),
        ratio(2 * recall * precision, recall + precision).alias("score"),
    )


def rank_decay(ranked: str | Column, truth: str | Column) -> Column:
    """(n − (r − 1)) / n for the true unit at rank r of a '|'-joined list; 0 where it is absent."""
    order = F.transform(F.split(col(ranked), r"\|"), lambda x: F.trim(x))
    n, r = F.size(order), F.array_position(order, F.trim(col(truth)))
    return F.when(r > 0, (n - (r - 1)) / n).otherwise(0.0)


def percentage_error(truth: str | Column, pred: str | Column) -> Column:
    """Undefined, hence NULL, where the truth is 0."""
    return F.try_divide(F.abs(col(truth) - col(pred)), F.abs(col(truth)))


def mape_score(df: DataFrame, by: Sequence[str], truth: str, pred: str) -> DataFrame:
    """Mean absolute percentage error and 1 − MAPE floored at 0."""
    out = df.groupBy(*by).agg(F.avg(percentage_error(truth, pred)).alias("mape"))
    return out.withColumn("score", F.greatest(F.lit(0.0), 1 - F.col("mape")))


def ape_summary(df: DataFrame, by: Sequence[str], truth: str, pred: str) -> DataFrame:
    slim = df.select(*by, percentage_error(truth, pred).alias("ape"))
    q = exact_quantiles(slim, list(by), "ape", {"p50": 0.5, "p90": 0.9, "worst": 1.0})
    return q


def margins(df: DataFrame, by: Sequence[str], positive: Column, p: str, threshold: float) -> DataFrame:
    """True / false positives and misses at a threshold, and how far apart the two classes lie."""
    flagged = F.col(p) >= threshold
    n = lambda c: F.count(F.when(c, 1))
    return df.groupBy(*by).agg(
        n(flagged & positive).alias("tp"), n(flagged & ~positive).alias("fp"), n(~flagged & positive).alias("fn"),
        F.max(F.when(~positive, F.col(p))).alias("normal_max"), F.min(F.when(positive, F.col(p))).alias("abnormal_min"),
    )


def overall(df: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """Sum over all four systems divided by four, and the mean over the attempted ones."""
    return df.groupBy(*by).agg(
        (F.sum(score) / SYSTEMS).alias("overall"), F.avg(score).alias("average"), F.count(score).alias("attempted")
    )


def complementarity(df: DataFrame, truth: str, a: str, b: str) -> DataFrame:
    ok_a, ok_b = F.col(a) == F.col(truth), F.col(b) == F.col(truth)
    n = lambda c: F.count(F.when(c, 1))
    return df.groupBy(truth).agg(
        n(ok_a & ok_b).alias("both_right"), n(~ok_a & ok_b).alias("only_b"),
        n(ok_a & ~ok_b).alias("only_a"), n(~ok_a & ~ok_b).alias("both_wrong"),
    )


def vector_differences(df: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """Units on which each pair of candidate prediction columns differs; 0 means identical vectors.

    One aggregation row for all pairs, so no prediction vector is ever collected.
    """
    pairs = list(combinations(candidates, 2))
    counted = df.agg(*[
        F.count(F.when(~F.col(a).eqNullSafe(F.col(b)), 1)).alias(f"d{i}") for i, (a, b) in enumerate(pairs)
    ])
    rows = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"d{i}").alias("n_diff")) for i, (a, b) in enumerate(pairs)
    ])
    return counted.select(F.inline(rows)).withColumn("identical", F.col("n_diff") == 0)


def gates(scores: DataFrame, baseline: str, parts: Sequence[str], blend: str, minimum: float, class_loss: float, edge: float) -> DataFrame:
    """One boolean per acceptance rule for every candidate.

    ``scores`` has candidate, repeat, macro_f1 and the per-class f1 columns. The candidate list is short by nature.
    """
    classes = [c for c in scores.columns if c.startswith("f1_")]
    base = scores.where(F.col("candidate") == baseline).select(
        "repeat", F.col("macro_f1").alias("_b"), *[F.col(c).alias(f"_{c}") for c in classes])
    paired = scores.join(base, "repeat")
    per = paired.groupBy("candidate").agg(
        F.avg("macro_f1").alias("mean"), F.avg("_b").alias("_base_mean"), F.stddev_pop("_b").alias("_base_sd"),
        F.bool_and(F.col("macro_f1") >= F.col("_b") - 1e-12).alias("consistent"),
        *[(F.avg(c) >= F.avg(f"_{c}") - class_loss).alias(f"_ok_{c}") for c in classes[1:]],
    )
    best_part = scores.where(F.col("candidate").isin(*parts)).groupBy("candidate").agg(F.avg("macro_f1").alias("m")).agg(
        F.max("m").alias("_best_part"))
    fault_ok = F.lit(True)
    for c in classes[1:]:
        fault_ok = fault_ok & F.col(f"_ok_{c}")
    return per.withColumn("_best_part", best_part.scalar()).select(
        "candidate", "mean",
        (F.col("mean") - F.col("_base_mean") > F.greatest(F.lit(minimum), F.col("_base_sd"))).alias("gain"),
        "consistent", fault_ok.alias("fault_classes"),
        F.when(F.col("candidate") == blend, F.col("mean") > F.col("_best_part") + edge).alias("beats_parts"),
    ).withColumn("qualified", F.col("gain") & F.col("consistent") & F.col("fault_classes") & F.coalesce("beats_parts", F.lit(True)))
