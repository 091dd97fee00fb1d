"""Choosing decision parameters from out-of-fold probabilities.

A setting only asks on which side of a few thresholds a row lies. So rows are counted by grid cell (how many thresholds
each of their values reaches), which needs one aggregation with map-side combine and leaves a bounded table, whatever the
number of rows. A summed-area table over the cells then answers every setting by a few prefix sums; no row is repeated per
setting. Where a comparison of two differences or products is a tie up to rounding, its cell cannot tell how each setting
rounds: such rows are counted by value and compared again, only at the settings on that tie.

A missing probability (NULL or NaN) counts as 0.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayside.functions.columns import ratio
from wayside.operators.intervals import greedy_matchings
from wayside.operators.scores import CLASSES, macro_f1
from wayside.session import cut

# Thresholds 0.05 … 0.90 in 35 steps, margins 0 … 0.3 in 7 steps, class factors 0.5 … 4 in 15 steps,
# blending weights.
TAUS = [round(0.05 + i * 0.025, 4) for i in range(35)]
MARGINS = [round(i * 0.05, 4) for i in range(7)]
FACTORS = [0.5 + 0.25 * i for i in range(15)]
WEIGHTS = (0.25, 0.5, 0.75)
TIE = 1e-9  # nearer than this (relative to the threshold, 1 at least for differences) two values may round either way


def constant(values: Sequence) -> Column:
    """An array of numbers, or of arrays of them, as one literal."""
    shown = lambda x: f"array({', '.join(map(shown, x))})" if isinstance(x, list) else f"double('{x!r}')" if isinstance(x, float) else str(x)
    return F.expr(shown(list(values)))


def reached(v: Column, grid: Sequence[float]) -> Column:
    """How many values of the ascending ``grid`` are at most ``v``, by binary search."""
    listed = constant(grid)
    steps = constant([1 << i for i in reversed(range(len(grid).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: at + F.when(F.get(listed, at + s - 1) <= v, s).otherwise(0))


@dataclass(frozen=True)
class Grid:
    """A family of settings.

    names:    probability columns.
    cells:    three columns that place a row in the grid.
    shape:    their numbers of values.
    settings: (cand, a, b, place) of every setting; ``place`` is what ``counts`` takes.
    counts:   from the summed-area table and a place the rows that are Side I and Side II.
    tie:      which settings (indexes) a row is a tie at, as an array; empty for nearly all rows. None: ties are exact.
    at_tie:   from the columns a and b of a setting, whether a tied row is taken for Side I by its cell, and by the rule; NULL
              where the setting does not compare at all.
    """

    names: tuple[str, ...]
    cells: tuple[Column, Column, Column]
    shape: tuple[int, int, int]
    settings: list[tuple[int, float, float, tuple[int, ...]]]
    counts: Callable
    tie: Column | None = None
    at_tie: Callable | None = None


def _by_difference() -> Grid:
    p1, p2 = F.col("p1"), F.col("p2")
    n = len(TAUS)
    steps = [round(0.025 * d, 4) for d in range(1 - n, n)]
    lead = reached(p1 - p2, steps)

    def counts(s, i, j):
        both, first = s[i + 1, j + 1, 0], s[i + 1, j + 1, i - j + n]
        return s[i + 1, 0, 0] - both + first, s[0, j + 1, 0] - first

    settings = [(i * n + j, TAUS[i], TAUS[j], (i, j)) for i in range(n) for j in range(n)]
    on_diagonal = [[k for k, (_, _, _, (i, j)) in enumerate(settings) if i - j == d] for d in range(1 - n, n)]
    near = lambda k: F.abs(p1 - p2 - F.get(constant(steps), k)) <= TIE
    tie = _settings_at(F.when(near(lead - 1), lead - 1).when(near(lead), lead), on_diagonal)
    compared = lambda a, b: (p1 >= a) & (p2 >= b)
    # by its cell a row is Side I where its difference reaches that of the thresholds
    taken = lambda a, b: p1 - p2 >= F.get(constant(steps), F.round((a - b) / 0.025).cast("int") + n - 1)
    return Grid(("p1", "p2"), (reached(p1, TAUS), reached(p2, TAUS), lead), (n + 1, n + 1, 2 * n), settings, counts, tie,
                lambda a, b: (F.when(compared(a, b), taken(a, b)), F.when(compared(a, b), p1 - a >= p2 - b)))


def _by_margin(margins: Sequence[float]) -> Grid:
    p1, p2 = F.col("p1"), F.col("p2")
    first = F.when(p1 >= p2, 1).otherwise(0)

    def counts(s, i, j):
        return s[i + 1, j + 1, 1], s[i + 1, j + 1, 0] - s[i + 1, j + 1, 1]

    settings = [(i * len(margins) + j, t, m, (i, j)) for i, t in enumerate(TAUS) for j, m in enumerate(margins)]
    return Grid(("p1", "p2"), (reached(F.greatest(p1, p2), TAUS), reached(F.abs(p1 - p2), margins), first), (len(TAUS) + 1, len(margins) + 1, 2),
                settings, counts)


def _by_factor() -> Grid:
    p0, p1, p2 = F.col("p0"), F.col("p1"), F.col("p2")
    fits = lambda p: sum((F.when(p0 >= p * f, 1).otherwise(0) for f in FACTORS[1:]), F.when(p0 >= p * FACTORS[0], 1).otherwise(0))
    exact = sorted({Fraction(b) / Fraction(a) for a in FACTORS for b in FACTORS})
    ratios = [float(r) for r in exact]
    share = F.when(p2 > 0, p1 / p2).otherwise(float("inf"))
    lead = reached(share, ratios)

    def counts(s, i, j):
        r = exact.index(Fraction(FACTORS[j]) / Fraction(FACTORS[i])) + 1
        rest = s[0, 0, 0] - s[i + 1, j + 1, 0]
        first = s[0, 0, r] - s[i + 1, j + 1, r]
        return first, rest - first

    n = len(FACTORS)
    settings = [(0, 1.0, 1.0, (FACTORS.index(1.0), FACTORS.index(1.0)))]
    settings += [(1 + i * n + j, FACTORS[i], FACTORS[j], (i, j)) for i in range(n) for j in range(n)]
    on_ratio = [[k for k, (_, a, b, _) in enumerate(settings) if Fraction(b) / Fraction(a) == r] for r in exact]
    near = lambda k: F.abs(share / F.get(constant(ratios), k) - 1) <= TIE
    tie = _settings_at(F.when(near(lead - 1), lead - 1).when(near(lead), lead), on_ratio)
    compared = lambda a, b: ~((p0 >= p1 * a) & (p0 >= p2 * b))
    taken = lambda a, b: lead > F.array_position(constant(ratios), b / a) - 1
    return Grid(("p0", "p1", "p2"), (fits(p1), fits(p2), lead), (n + 1, n + 1, len(ratios) + 1), settings, counts, tie,
                lambda a, b: (F.when(compared(a, b), taken(a, b)), F.when(compared(a, b), p1 * a >= p2 * b)))


def _settings_at(place: Column, settings: list[list[int]]) -> Column:
    return F.coalesce(F.get(constant(settings), place), F.array().cast("array<int>"))


def tried(oof: DataFrame, grid: Grid, by: Sequence[str] = ()) -> DataFrame:
    """How often every setting gives every label a class: ``by``, cand, a, b, label, pred, n."""
    group = list(by) or ["_all"]
    known = (oof if by else oof.withColumn("_all", F.lit(0))).select(
        *group, "label", *[F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in grid.names])
    one = F.lit(0)
    placed = known.select(*group, "label", *[c.alias(f"c{i}") for i, c in enumerate(grid.cells)])
    cells = placed.groupBy(*group, "label", "c0", "c1", "c2").agg(F.count(F.lit(1)).alias("n")).withColumn("side", one)
    if grid.tie is not None:
        first, second = (constant([s[i] for s in grid.settings]) for i in (1, 2))
        setting = lambda k: F.struct(k.alias("k"), F.get(first, k).alias("a"), F.get(second, k).alias("b"))
        tied = known.withColumn("_at", grid.tie).where(F.size("_at") > 0).groupBy(*group, "label", *grid.names, "_at").agg(
            F.count(F.lit(1)).alias("n"))
        each = tied.withColumn("_s", F.explode(F.transform("_at", setting)))
        by_cell, by_rule = grid.at_tie(F.col("_s.a"), F.col("_s.b"))
        wrong = each.withColumns({"_cell": by_cell, "_rule": by_rule}).where(F.col("_cell") != F.col("_rule"))
        cells = cells.unionByName(wrong.select(
            *group, "label", F.col("_s.k").alias("c0"), F.lit(0).alias("c1"), F.lit(0).alias("c2"), "n",
            F.when(F.col("_rule"), 1).otherwise(-1).alias("side")))
    parts = cells.groupBy(*group, "label", "c0", "c1", "c2", "side").agg(F.sum("n").alias("n"))

    shape, settings, counts = grid.shape, grid.settings, grid.counts  # what tasks need of the grid

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        cube = np.zeros(shape, np.int64)
        plain, moved = frame[frame["side"] == 0], frame[frame["side"] != 0]
        cube[plain["c0"], plain["c1"], plain["c2"]] = plain["n"]
        area = np.pad(cube, [(0, 1)] * 3)
        for axis in range(3):  # how many rows lie at or above a cell
            area = np.flip(np.flip(area, axis).cumsum(axis), axis)
        found = np.array([counts(area, *place) for _, _, _, place in settings], np.int64)
        np.add.at(found, (moved["c0"].to_numpy(), 0), (moved["side"] * moved["n"]).to_numpy())
        np.add.at(found, (moved["c0"].to_numpy(), 1), (-moved["side"] * moved["n"]).to_numpy())
        out = pd.DataFrame([s[:3] for s in settings], columns=["cand", "a", "b"]).assign(**{c: frame[c].iloc[0] for c in [*group, "label"]})
        named = [(CLASSES[0], cube.sum() - found.sum(1)), (CLASSES[1], found[:, 0]), (CLASSES[2], found[:, 1])]
        return pd.concat([out.assign(pred=name, n=n) for name, n in named])[[*group, "label", "cand", "a", "b", "pred", "n"]]

    kinds = ", ".join(f"{c} {parts.schema[c].dataType.simpleString()}" for c in [*group, "label"])
    done = parts.groupBy(*group, "label").applyInPandas(answer, f"{kinds}, cand int, a double, b double, pred string, n long")
    return done if by else done.drop("_all")


RULES = {"global": lambda: _by_margin([float("-inf")]), "per_side": _by_difference, "margin": lambda: _by_margin(MARGINS)}


def middle_of_tied(scored: DataFrame, by: Sequence[str], score: str = "macro_f1", order: str = "cand") -> DataFrame:
    """Mark, per ``by``, the lower-middle setting of those within 1e-12 of the best score (settings, not rows)."""
    everything = Window.partitionBy(*by)
    tied = F.col(score) >= F.max(score).over(everything) - 1e-12
    flagged = scored.withColumn("_tied", tied)
    rank = F.row_number().over(Window.partitionBy(*by, "_tied").orderBy(order))
    size = F.count(F.lit(1)).over(Window.partitionBy(*by, "_tied"))
    return flagged.withColumn("selected", F.col("_tied") & (rank == F.floor((size - 1) / 2) + 1)).drop("_tied")


def sweep(oof: DataFrame, rule: str, by: Sequence[str] = ()) -> DataFrame:
    """Macro-F1 of every candidate setting of a rule on (p1, p2, label), and the selected one."""
    counted = tried(oof, RULES[rule](), by)
    b = F.lit(0.0) if rule == "global" else F.col("b")
    scored = macro_f1(counted.withColumn("b", b), [*by, "cand", "a", "b"], weight="n")
    return middle_of_tied(scored.withColumn("rule", F.lit(rule)), [*by, "rule"])


def class_scaling(oof: DataFrame) -> DataFrame:
    """Scale the two fault probabilities over the factor grid; the first setting that beats the unscaled argmax most wins."""
    scored = macro_f1(tried(oof, _by_factor()), ["cand", "a", "b"], weight="n")
    best = Window.partitionBy(F.lit(0)).orderBy(F.round("macro_f1", 12).desc(), "cand")  # 226 settings
    return scored.withColumn("selected", F.row_number().over(best) == 1)


def blend_sweep(oof: DataFrame) -> DataFrame:
    """For each blending weight the best threshold and its score, and the weight chosen (first of the best)."""
    weights = F.explode(F.array(*[F.lit(w) for w in WEIGHTS]))
    mixed = oof.select("label", weights.alias("w"), "p1", "p2", "q1", "q2").select(
        "label", "w",
        (F.col("w") * F.col("p1") + (1 - F.col("w")) * F.col("q1")).alias("p1"),
        (F.col("w") * F.col("p2") + (1 - F.col("w")) * F.col("q2")).alias("p2"),
    )
    best = sweep(mixed, "global", ["w"]).where("selected").select("w", F.col("a").alias("tau"), "macro_f1")
    first = Window.partitionBy(F.lit(0)).orderBy(F.round("macro_f1", 12).desc(), "w")  # three weights
    return best.withColumn("chosen", F.row_number().over(first) == 1)


def paired_probability(rows: DataFrame, unit: str, kind: str) -> DataFrame:
    """Side probabilities from the two views of a unit, equal under exchange of the views.

    multiclass: half of own view's 'own' plus the other view's 'other'.
    hierarchical: detector times half of own plus the complement of the other view's own.
    """
    at = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
    wide = rows.groupBy(unit).agg(
        *[at(c, s).alias(f"{c}{s}") for c in ("own", "other") for s in (1, 2)], F.max("detector").alias("detector"))
    if kind == "multiclass":
        p1 = (F.col("own1") + F.col("other2")) / 2
        p2 = (F.col("own2") + F.col("other1")) / 2
    else:
        p1 = F.col("detector") * (F.col("own1") + (1 - F.col("own2"))) / 2
        p2 = F.col("detector") * (F.col("own2") + (1 - F.col("own1"))) / 2
    return wide.select(unit, p1.alias("p1"), p2.alias("p2"))


def nested_leave_one_out(scores: DataFrame) -> DataFrame:
    """For each held-out case the setting with the best mean over the other cases (fewest non-zero weights, then first,
    on ties) and its score on the held-out case. The mean of the others is the total minus the case itself."""
    per = scores.groupBy("combo").agg(F.sum("score").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    joined = scores.join(per, "combo")
    others = F.round(F.try_divide(F.col("_sum") - F.col("score"), F.col("_n") - 1), 9)
    choice = F.struct(others.alias("others"), (-F.col("nonzero")).alias("few"), (-F.col("combo")).alias("first"))
    best = joined.groupBy(F.col("case").alias("held")).agg(
        F.max_by(F.struct("combo", "score", others.alias("others")), choice).alias("best"))
    return best.select("held", "best.combo", "best.score", F.col("best.others").alias("others_mean"))


def leave_fold_out_thresholds(oof: DataFrame, fold: str) -> DataFrame:
    """Threshold of the global rule chosen for every fold on the units outside it, and the median of the choices.

    Confusion counts add up, so the counts outside a fold are the total minus its own: no unit is counted per fold.
    """
    own = cut(tried(oof, RULES["global"](), [fold]).where("n > 0").select(fold, "cand", "a", "label", "pred", "n"))
    whole = own.groupBy("cand", "a", "label", "pred").agg(F.sum("n").alias("_all"))
    folds = own.select(fold).distinct()  # a handful of folds
    spread = whole.withColumn("_folds", folds.agg(F.collect_set(fold)).scalar()).select("*", F.explode("_folds").alias(fold)).drop("_folds")
    rest = spread.join(own, [fold, "cand", "a", "label", "pred"], "left").withColumn("n", F.col("_all") - F.coalesce("n", F.lit(0)))
    best = middle_of_tied(macro_f1(rest, [fold, "cand", "a"], weight="n"), [fold]).where("selected")
    chosen = best.select(fold, F.col("a").alias("tau"), "macro_f1")
    return chosen.withColumn("final_tau", F.median("tau").over(Window.partitionBy(F.lit(0))))


def interval_threshold_sweep(
    pairs: DataFrame, keys: Sequence[str], n_true: DataFrame, n_pred: DataFrame, positive: str, negative: str,
    start: float = 0.2, step: float = 0.025, steps: int = 25,
) -> DataFrame:
    """IoU-weighted F1 of labelled segments at every threshold on their probability.

    ``pairs``: overlapping pairs whatever their labels (keys, i, j, iou, lo, hi, label of i, p of j). Overlaps are found once; a
    threshold only decides which pairs agree, which is a run of bits, and all thresholds are matched in one pass. Among
    equally good thresholds (1e-9) the median is ``best``. A threshold at which nothing matches scores 0.
    """
    taus = [round(start + k * step, 4) for k in range(steps)]
    every = (1 << steps) - 1
    low = F.get(constant([(1 << c) - 1 for c in range(steps + 1)]), reached(F.col("p"), taus)).cast("long")
    agree = F.when(F.col("label") == positive, low).when(F.col("label") == negative, F.lit(every).cast("long").bitwiseXOR(low)).otherwise(0)
    matched = greedy_matchings(pairs.withColumn("_agree", agree).where("_agree <> 0"), keys, F.col("_agree"))
    hit = lambda k: F.col("taken").bitwiseAND(F.lit(1 << k).cast("long")) != 0
    totals = matched.agg(F.array(*[F.coalesce(F.sum(F.when(hit(k), F.col("iou"))), F.lit(0.0)) for k in range(steps)]).alias("_totals"))
    per = totals.select(F.posexplode("_totals").alias("cand", "_total"))  # one row per threshold
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    recall, precision = ratio("_total", count(n_true)), ratio("_total", count(n_pred))
    scored = per.select("cand", F.get(constant(taus), F.col("cand")).alias("tau"), ratio(2 * recall * precision, recall + precision).alias("score"))
    everything = Window.partitionBy(F.lit(0))  # one row per threshold
    tied = F.when(F.col("score") >= F.max("score").over(everything) - 1e-9, F.col("tau"))
    marked = scored.withColumn("_tied", tied)
    return marked.withColumn("best", F.median("_tied").over(everything)).drop("_tied")
