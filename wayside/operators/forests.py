"""Random forests whose trees are grown and kept by tasks: rows as bins of a byte, trees as rows of a written table.

The trees are those of Spark ML: candidate thresholds at 32 weighted quantiles, Poisson bootstrap, features drawn for every node,
weighted Gini gain, sibling leaves of one class merged. Only thresholds, class weights and the top of trees reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayside.session import cut

# Bins of a feature, points of a batch's quantile summary, values (rows x features) that one task holds, tasks of a step at most.
BINS, POINTS, HELD, MOST_TASKS = 32, 2048, 12_800_000, 2000
AT_ONCE = 1_000_000  # values that are looked at in one go
COUNT_BITS = 4  # a row is drawn 15 times at most: one in 10^13 would be drawn more often
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(15)])
GROWN = "tree int, root int, feature binary, cell binary, left binary, counts binary, importance array<double>"
BLOCK = "block long, ids binary, cells binary, y binary"


@dataclass(frozen=True)
class Plan:
    """What a tree needs to know to grow."""

    features: int
    weights: tuple[float, ...]  # of the classes
    leaf: int
    tries: int  # features drawn for a node
    depth: int
    seed: int

    @property
    def classes(self) -> int:
        return len(self.weights)


@dataclass
class Nodes:
    """A tree in level order: a row goes to ``left`` if its cell of ``feature`` is at most ``cell``, else to ``left`` + 1."""

    feature: np.ndarray
    cell: np.ndarray
    left: np.ndarray  # -1: a leaf
    counts: np.ndarray  # drawn rows of each class

    def reached(self, cells: np.ndarray) -> np.ndarray:
        """Leaf of every row."""
        at = np.zeros(len(cells), np.int64)
        rows = np.flatnonzero(self.left[at] >= 0)
        flat, width = cells.ravel(), cells.shape[1]
        while len(rows):
            here = at[rows]
            here = self.left[here] + (flat[rows * width + self.feature[here]] > self.cell[here])
            at[rows] = here
            rows = rows[self.left[here] >= 0]
        return at

    def leaf(self, node: int) -> Nodes:
        """A node as a tree of its own."""
        return Nodes(self.feature[[node]], self.cell[[node]], self.left[[node]], self.counts[[node]])

    def packed(self) -> list[bytes]:
        return [self.feature.astype(np.int32).tobytes(), self.cell.astype(np.uint8).tobytes(),
                self.left.astype(np.int32).tobytes(), self.counts.astype(np.int32).tobytes()]

    @classmethod
    def read(cls, row: dict, classes: int) -> Nodes:
        of = lambda name, kind: np.frombuffer(row[name], kind)
        return cls(of("feature", np.int32), of("cell", np.uint8), of("left", np.int32), of("counts", np.int32).reshape(-1, classes))


def features_tried(subset: str, features: int, trees: int) -> int:
    """Features drawn for a node, by the names Spark ML has for it."""
    named = {"all": features, "sqrt": math.ceil(math.sqrt(features)), "onethird": math.ceil(features / 3), "log2": max(1, math.ceil(math.log2(features)))}
    named["auto"] = named["all" if trees == 1 else "sqrt"]
    if subset in named:
        return named[subset]
    return min(int(subset), features) if subset.isdigit() else math.ceil(float(subset) * features)


# --- rows as cells --------------------------------------------------------------------------------


def _matrix(column) -> np.ndarray:
    """Rows by features."""
    found = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return found.flatten().to_numpy(zero_copy_only=False).reshape(len(found), -1)


def _summed(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(values, return_inverse=True)
    return found, np.bincount(at, weights)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values of each feature in a batch with their weights; of more than POINTS values, those at even steps of weight."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, w = _matrix(batch["x"]), batch["weight"].to_numpy()
        out = []
        for k in range(x.shape[1]):
            values, weights = _summed(x[:, k], w)
            if len(values) > POINTS:
                total = np.cumsum(weights)
                at = np.unique(np.minimum(np.searchsorted(total, np.linspace(0, total[-1], POINTS)), len(values) - 1))
                at[-1] = len(values) - 1
                values, weights = values[at], np.diff(total[at], prepend=0.0)
            out.append((k, values, weights))
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int32()), *(pa.array([o[i] for o in out], pa.list_(pa.float64())) for i in (1, 2))], ["k", "v", "w"])


def split_points(values: np.ndarray, weights: np.ndarray, splits: int) -> np.ndarray:
    """Midpoints between neighbouring values: all of them, or those nearest to even shares of the weight."""
    middle = values[:-1] / 2 + values[1:] / 2
    if len(middle) <= splits:
        return middle
    stride = weights.sum() / (splits + 1)
    found, total, target = [], weights[0], stride
    for m, w in zip(middle, weights[1:]):
        if abs(total - target) < abs(total + w - target):
            found.append(m)
            target += stride
        total += w
    return np.unique(found)


def thresholds(rows: DataFrame, features: int, n: int) -> list[np.ndarray]:
    """Ascending candidate thresholds of every feature of ``rows`` (x, weight). A missing value, which only rows to be scored have, is above all of them."""
    splits = min(BINS, n) - 1

    def points(found: pa.Table) -> pa.Table:
        values, weights = (found[c].combine_chunks().flatten().to_numpy() for c in ("v", "w"))
        at = split_points(*_summed(values, weights), splits)
        return pa.table({"k": found["k"][:1], "at": pa.array([at], pa.list_(pa.float64()))})

    told = rows.select("x", "weight").mapInArrow(_summaries, "k int, v array<double>, w array<double>")
    found = {r["k"]: np.array(r["at"], float) for r in told.groupBy("k").applyInArrow(points, "k int, at array<double>").collect()}  # one row per feature
    return [found[k] for k in range(features)]


def blocks(rows: DataFrame, limits: Sequence[np.ndarray]) -> DataFrame:
    """Rows (id, x and, if there, y) as blocks of cells; a block has the id of its first row."""
    answered = "y" in rows.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch["id"].to_numpy(), _matrix(batch["x"])
            cells = np.stack([np.searchsorted(at, x[:, k]) for k, at in enumerate(limits)], axis=1).astype(np.uint8)
            y = batch["y"].to_numpy().astype(np.uint8).tobytes() if answered else b""
            yield _table(BLOCK, [[int(ids[0]), ids.tobytes(), cells.tobytes(), y]]).to_batches()[0]

    return rows.select("id", "x", *(["y"] if answered else [])).mapInArrow(pack, BLOCK)


KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}


def _table(schema: str, rows: Sequence[Sequence]) -> pa.Table:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], KINDS[kind]) for i, (name, kind) in enumerate(fields)})


def _unpacked(found: pa.Table | pa.RecordBatch, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, cells and classes of all blocks."""
    of = lambda name, kind: np.concatenate([np.frombuffer(b.as_py(), kind) for b in found[name]])
    return of("ids", np.int64), of("cells", np.uint8).reshape(-1, features), of("y", np.uint8)


# --- one tree -------------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's last steps."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(ids: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often a tree draws each row: Poisson of mean 1, by a digest of seed, tree and row."""
    start = _mixed(np.array([seed % 2**63], np.uint64)) + np.array([tree + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    u = _mixed(_mixed(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ _mixed(start)))
    return np.searchsorted(POISSON, (u >> np.uint64(11)) * 2.0**-53, side="right")


def chosen(rng: np.random.Generator, nodes: int, features: int, tries: int) -> np.ndarray:
    """Different features for every node, all choices equally likely (Floyd's method)."""
    out = np.empty((nodes, tries), np.int64)
    for i, j in enumerate(range(features - tries, features)):
        t = rng.integers(0, j + 1, nodes)
        out[:, i] = np.where((out[:, :i] == t[:, None]).any(axis=1), j, t)
    return out


def _rng(plan: Plan, tree: int, root: int) -> np.random.Generator:
    return np.random.default_rng([plan.seed % 2**63, tree, root])


def _rows(counts: np.ndarray) -> np.ndarray:
    """Sum of the classes; there are few, so column by column."""
    return sum(counts[..., k] for k in range(counts.shape[-1]))


def _purity(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of squared class weights over their sum: a node's weight times (1 - Gini)."""
    total, squares = np.zeros(counts.shape[:-1]), np.zeros(counts.shape[:-1])
    for k, weight in enumerate(weights):
        w = counts[..., k] * weight
        total += w
        squares += w * w
    return np.divide(squares, total, out=np.zeros(total.shape), where=total > 0)


def _shares(counts: np.ndarray) -> np.ndarray:
    """Each row's numbers over their sum; zeros stay."""
    total = counts.sum(axis=1, keepdims=True)
    return np.divide(counts, total, out=np.zeros(counts.shape), where=total > 0)


class Best:
    """The best split seen so far of every node."""

    def __init__(self, totals: np.ndarray, plan: Plan):
        self.totals, self.plan, self.weights = totals, plan, np.array(plan.weights)
        self.score = _purity(totals, self.weights) * (1 + 1e-12)  # a split must gain
        self.slot, self.cell, self.left = np.full(len(totals), -1), np.zeros(len(totals), np.int64), np.zeros_like(totals)

    def offer(self, node: np.ndarray, slot: np.ndarray, cell: np.ndarray, left: np.ndarray) -> None:
        """Splits after ``cell`` with ``left`` rows of each class below; ``node`` ascends."""
        below = _rows(left)
        able = np.flatnonzero((below >= self.plan.leaf) & (_rows(self.totals)[node] - below >= self.plan.leaf))
        if not len(able):
            return
        node, left = node[able], left[able]
        score = _purity(left, self.weights) + _purity(self.totals[node] - left, self.weights)
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        most = np.maximum.reduceat(score, first)
        top = np.flatnonzero(score == np.repeat(most, np.diff(first, append=len(node))))
        top = top[np.concatenate([[True], node[top][1:] != node[top][:-1]])]
        top = top[score[top] > self.score[node[top]]]
        at = node[top]
        self.score[at], self.slot[at], self.cell[at], self.left[at] = score[top], slot[able[top]], cell[able[top]], left[top]

    def offer_histogram(self, slots: Sequence[int], histogram: np.ndarray) -> None:
        """Drawn rows by node, slot, cell and class."""
        node, slot, cell = (x.ravel() for x in np.indices((len(histogram), len(slots), BINS - 1)))
        self.offer(node, np.asarray(slots)[slot], cell, histogram.cumsum(axis=2)[:, :, :-1].reshape(len(node), -1))


def _histogram(place: np.ndarray, y: np.ndarray, times: np.ndarray, places: int, classes: int) -> np.ndarray:
    """Drawn rows by place (of any number of cells) and class."""
    return np.bincount(place.ravel() * classes + y, times, places * classes).astype(np.int64)


def _best(cells: np.ndarray, rows, node, y, times, tried: np.ndarray, totals: np.ndarray, plan: Plan) -> Best:
    """Best splits of all nodes of a level; ``node`` ascends. Few nodes are counted cell by cell, many by sorting their rows."""
    best, flat, base = Best(totals, plan), cells.ravel(), rows * plan.features
    nodes, classes, bits = len(totals), plan.classes, (plan.classes - 1).bit_length()
    step = max(1, AT_ONCE // len(rows))
    for slots in (np.arange(a, min(a + step, plan.tries)) for a in range(0, plan.tries, step)):
        S = len(slots)
        place = ((node * S)[:, None] + np.arange(S)) * BINS + flat[base[:, None] + tried[:, slots][node]]
        if nodes * BINS * classes <= 4 * len(rows):
            h = _histogram(place, np.repeat(y, S), np.repeat(times, S), nodes * S * BINS, classes)
            best.offer_histogram(slots, h.reshape(nodes, S, BINS, classes))
            continue
        kind = np.int32 if nodes * S * BINS << bits + COUNT_BITS < 2**31 else np.int64
        key = np.sort((place.astype(kind) << bits + COUNT_BITS | (y.astype(kind) << COUNT_BITS | times.astype(kind))[:, None]).ravel())
        place, of, c = key >> bits + COUNT_BITS, (key >> COUNT_BITS) & ((1 << bits) - 1), key & ((1 << COUNT_BITS) - 1)
        end = np.flatnonzero(place[1:] != place[:-1])
        group = place // BINS
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))  # every node has rows
        at = group[end]
        below = []
        for k in range(classes):
            total = np.cumsum(np.where(of == k, c, 0), dtype=np.int64)
            below.append(total[end] - np.where(start > 0, total[start - 1], 0)[at])
        best.offer(at // S, slots[at % S], place[end] % BINS, np.stack(below).T)
    return best


def _open(counts: np.ndarray, plan: Plan, level: int) -> np.ndarray:
    """Nodes that may be split: of several classes, large enough, not too deep."""
    return (_rows(counts > 0) > 1) & (_rows(counts) >= 2 * plan.leaf) & (level < plan.depth)


def grow(cells: np.ndarray, y: np.ndarray, ids: np.ndarray, plan: Plan, tree: int, root: int = 0, level: int = 0) -> tuple[Nodes, np.ndarray]:
    """The tree below a node whose rows are given, and what each feature gains in it."""
    times = drawn(ids, plan.seed, tree)
    rows = np.flatnonzero(times)
    times, y, node = times[rows], y[rows].astype(np.int64), np.zeros(len(rows), np.int64)
    rng, K = _rng(plan, tree, root), plan.classes
    counts = np.bincount(y, times, K).astype(np.int64)[None, :]
    levels, made = [], 1
    while True:
        found = Nodes(np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64), np.full(len(counts), -1), counts)
        levels.append(found)
        opened = np.flatnonzero(_open(counts, plan, level))
        if not len(opened):
            break
        tried = chosen(rng, len(opened), plan.features, plan.tries)
        best = _best(cells, rows, node, y, times, tried, counts[opened], plan)
        split = best.slot >= 0
        at = opened[split]
        found.feature[at], found.cell[at] = tried[split, best.slot[split]], best.cell[split]
        found.left[at] = made + 2 * np.arange(len(at))
        made += 2 * len(at)
        if not len(at):
            break
        counts = np.stack([best.left[split], best.totals[split] - best.left[split]], axis=1).reshape(-1, K)
        level += 1
        again = np.cumsum(split) - 1
        stay = split[node]
        rows, times, y, node = rows[stay], times[stay], y[stay], node[stay]
        here = opened[node]
        child = 2 * again[node] + (cells.ravel()[rows * plan.features + found.feature[here]] > found.cell[here])
        more = _open(counts, plan, level)
        stay = np.flatnonzero(more[child])
        node = (np.cumsum(more) - 1)[child[stay]]
        order = np.argsort(node, kind="stable")
        node, stay = node[order], stay[order]
        rows, times, y = rows[stay], times[stay], y[stay]
    return _pruned(levels, plan)


def _pruned(levels: Sequence[Nodes], plan: Plan) -> tuple[Nodes, np.ndarray]:
    """The levels as one tree, sibling leaves of one class merged, and what each feature gains."""
    whole = Nodes(*(np.concatenate([getattr(n, c) for n in levels]) for c in ("feature", "cell", "left", "counts")))
    weights, ends = np.array(plan.weights), np.cumsum([len(n.left) for n in levels])
    likeliest = (whole.counts * weights).argmax(axis=1)
    spans = [np.arange(e - len(n.left), e) for n, e in zip(levels, ends)]
    for span in reversed(spans):
        inner = span[whole.left[span] >= 0]
        a = whole.left[inner]
        same = (whole.left[a] < 0) & (whole.left[a + 1] < 0) & (likeliest[a] == likeliest[a + 1])
        whole.left[inner[same]] = -1
    keep = np.zeros(len(whole.left), bool)
    keep[0] = True
    for span in spans:
        a = whole.left[span[keep[span] & (whole.left[span] >= 0)]]
        keep[a] = keep[a + 1] = True
    left = np.where(whole.left >= 0, (np.cumsum(keep) - 1)[whole.left], -1)[keep]
    tree = Nodes(whole.feature[keep], whole.cell[keep], left, whole.counts[keep])
    return tree, _gains(tree, plan)


def _gains(tree: Nodes, plan: Plan) -> np.ndarray:
    """Weight times Gini gain of the splits, by feature."""
    inner = np.flatnonzero(tree.left >= 0)
    pure, a = _purity(tree.counts, np.array(plan.weights)), tree.left[inner]
    return np.bincount(tree.feature[inner], pure[a] + pure[a + 1] - pure[inner], plan.features).astype(float)


# --- the forest -----------------------------------------------------------------------------------


@dataclass
class Top:
    """The upper nodes of a tree, while they have more rows than a task holds; its leaves are the roots of what tasks grow."""

    nodes: Nodes
    level: list[int]
    opened: list[int] = field(default_factory=list)
    tried: set[int] = field(default_factory=set)

    @staticmethod
    def empty(classes: int, opened: bool) -> Top:
        none = np.zeros(1, np.int64)
        return Top(Nodes(none, none, none - 1, np.zeros((1, classes), np.int64)), [0], [0] if opened else [])

    def split(self, node: int, feature: int, cell: int, left: np.ndarray, total: np.ndarray) -> tuple[int, int]:
        n, made = self.nodes, len(self.level)
        more = lambda a, v: np.append(a, v)
        self.nodes = Nodes(more(n.feature, [0, 0]), more(n.cell, [0, 0]), more(n.left, [-1, -1]), np.vstack([n.counts, left, total - left]))
        self.nodes.feature[node], self.nodes.cell[node], self.nodes.left[node] = feature, cell, made
        self.level += [self.level[node] + 1] * 2
        return made, made + 1


def tops(ready: DataFrame, plan: Plan, trees: int, n: int) -> list[Top]:
    """Upper parts of all trees, grown level by level on histograms of all rows; just roots if a task holds all rows."""
    held = max(1, HELD // plan.features)
    found = [Top.empty(plan.classes, n > held) for _ in range(trees)]
    while any(t.opened for t in found):
        tried = {(t, k): chosen(_rng(plan, t, k), 1, plan.features, plan.tries)[0] for t, top in enumerate(found) for k in top.opened}
        told = _histograms(ready, plan, {t: top.nodes for t, top in enumerate(found) if top.opened}, tried).collect()  # one row per open node
        for top in found:
            top.tried |= set(top.opened)
            top.opened = []
        for r in told:
            top, k = found[r["tree"]], r["node"]
            total, left = (np.frombuffer(r[c], np.int64) for c in ("total", "below"))
            top.nodes.counts[k] = total
            if r["feature"] >= 0:
                for child in top.split(k, r["feature"], r["cell"], left, total):
                    counts = top.nodes.counts[child]
                    if counts.sum() > held and _open(counts[None, :], plan, top.level[child])[0]:
                        top.opened.append(child)
    return found


def _histograms(ready: DataFrame, plan: Plan, upper: dict[int, Nodes], tried: dict[tuple[int, int], np.ndarray]) -> DataFrame:
    """The best split of each open node, from counts that tasks have made of their rows."""
    schema, K = "tree int, node int, counts binary", plan.classes

    def flushed(sums: dict) -> pa.RecordBatch:
        return _table(schema, [[t, k, h.tobytes()] for (t, k), h in sums.items()]).to_batches()[0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            ids, cells, y = _unpacked(batch, plan.features)
            for t, nodes in upper.items():
                times = drawn(ids, plan.seed, t)
                at = np.where(times > 0, nodes.reached(cells), -1)
                for k in (k for s, k in tried if s == t):
                    rows = np.flatnonzero(at == k)
                    h = np.stack([_histogram(cells[rows, f], y[rows], times[rows], BINS, K) for f in tried[t, k]])
                    sums[t, k] = sums[t, k] + h if (t, k) in sums else h
            if sum(h.nbytes for h in sums.values()) > HELD:
                yield flushed(sums)
                sums = {}
        if sums:
            yield flushed(sums)

    def decide(found: pa.Table) -> pa.Table:
        t, k = found["tree"][0].as_py(), found["node"][0].as_py()
        h = sum(np.frombuffer(b.as_py(), np.int64) for b in found["counts"]).reshape(-1, BINS, K)
        best = Best(h[0].sum(axis=0)[None, :], plan)
        best.offer_histogram(range(len(h)), h[None])
        feature = int(tried[t, k][best.slot[0]]) if best.slot[0] >= 0 else -1
        return _table(out, [[t, k, feature, int(best.cell[0]), best.totals[0].tobytes(), best.left[0].tobytes()]])

    out = "tree int, node int, feature int, cell int, total binary, below binary"
    return ready.mapInArrow(count, schema).groupBy("tree", "node").applyInArrow(decide, out)


def keys(spark: SparkSession, n: int) -> tuple[list[int], int]:
    """Numbers for ``n`` jobs and the partitions to deal them to: Spark's hashes of the numbers fill all partitions evenly."""
    tasks, rounds = min(n, MOST_TASKS), -(-n // MOST_TASKS)
    numbers = spark.range(tasks * rounds * (20 + 2 * tasks.bit_length())).select(F.col("id").cast("int").alias("id"))
    of = F.pmod(F.hash("id"), F.lit(tasks))
    told = numbers.groupBy(of.alias("at")).agg(F.slice(F.sort_array(F.collect_list("id")), 1, rounds).alias("ids")).collect()  # one row per task
    free = {r["at"]: r["ids"] for r in told}
    pick = lambda i: (free.get(i % tasks, []) + [-1 - i] * rounds)[i // tasks]
    return [pick(i) for i in range(n)], tasks


def grown(ready: DataFrame, plan: Plan, sizes: Sequence[int], upper: Sequence[Top]) -> DataFrame:
    """All trees, one row for each root that a task has grown. If no tree has an upper part, a task gets all rows and grows
    the trees of a part; else it gets the rows of one root."""
    spark, whole = ready.sparkSession, not any(t.tried for t in upper)
    part_of = np.repeat(np.arange(len(sizes)), sizes)
    roots = [(t, int(k)) for t, top in enumerate(upper) for k in np.flatnonzero(top.nodes.left < 0)]
    final = [] if whole else [(t, k) for t, k in roots if k in upper[t].tried or not _open(upper[t].nodes.counts[[k]], plan, upper[t].level[k])[0]]
    todo = sorted(set(roots) - set(final))
    listed = [[(int(t), 0) for t in np.flatnonzero(part_of == i)] for i in range(len(sizes))] if whole else [[r] for r in todo]
    levels, schema = {(t, k): upper[t].level[k] for t, k in todo}, f"job int, {BLOCK}"
    nodes = [t.nodes for t in upper]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if whole:
                for job in jobs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, job), pa.int32()), *batch.columns], ["job", *batch.schema.names])
                continue
            ids, cells, y = _unpacked(batch, plan.features)
            last = None
            for job, [(t, k)] in jobs.items():
                if t != last:
                    at, last = np.where(drawn(ids, plan.seed, t) > 0, nodes[t].reached(cells), -1), t
                mine = np.flatnonzero(at == k)
                if len(mine):
                    yield _table(schema, [[job, 0, ids[mine].tobytes(), cells[mine].tobytes(), y[mine].tobytes()]]).to_batches()[0]

    def work(found: pa.Table) -> pa.Table:
        ids, cells, y = _unpacked(found, plan.features)
        out = []
        for t, k in jobs[found["job"][0].as_py()]:
            tree, gains = grow(cells, y, ids, plan, t, k, levels[t, k])
            out.append([t, k, *tree.packed(), gains])
        return _table(GROWN, out)

    # upper leaves that nothing splits, and (without nodes) what the upper nodes gain
    told = [(t, k, *map(bytearray, upper[t].nodes.leaf(k).packed()), [0.0] * plan.features) for t, k in final]
    told += [] if whole else [(t, -1, *[bytearray()] * 4, _gains(n, plan).tolist()) for t, n in enumerate(nodes)]
    made = spark.createDataFrame(told, GROWN)
    if listed:
        numbers, tasks = keys(spark, len(listed))
        jobs = dict(zip(numbers, listed))
        made = made.unionByName(ready.mapInArrow(deal, schema).repartition(tasks, "job").groupBy("job").applyInArrow(work, GROWN))
    return cut(made)


def votes(
    rows: DataFrame, limits: Sequence[np.ndarray], trees: DataFrame, plan: Plan, parts: dict[int, int], upper: Sequence[Top], n: int,
) -> DataFrame:
    """Column ``votes`` (a share for each class) for every id of the ``n`` rows (id, x). ``parts``: the part of each tree that votes.

    A task reads the trees of a part and as many rows as it may hold; sums of parts meet by block.
    """
    chunks, asked, K = max(1, -(-n * plan.features // HELD)), sorted(set(parts.values())), plan.classes
    weights, nodes = np.array(plan.weights), {t: upper[t].nodes for t in parts}
    numbers, tasks = keys(rows.sparkSession, chunks * len(asked))
    number = F.array(*[F.lit(i) for i in numbers])
    job = lambda chunk, part: number[(chunk * len(asked) + part).cast("int")].alias("job")
    part_of = F.create_map(*[F.lit(v) for t, p in parts.items() for v in (t, asked.index(p))])[F.col("tree")]
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    packed = blocks(rows, limits).select(each(len(asked)).alias("part"), F.pmod(F.xxhash64("block"), F.lit(chunks)).alias("chunk"), "*")
    left = packed.select(job(F.col("chunk"), F.col("part")), "part", "block", "ids", "cells")
    wanted = trees.where(F.col("tree").isin(list(parts)) & (F.col("root") >= 0)).drop("importance").select(each(chunks).alias("chunk"), "*")
    right = wanted.select(job(F.col("chunk"), part_of), "*")
    schema = "block long, part int, ids binary, votes binary"

    def vote(found: pa.Table, woods: pa.Table) -> pa.Table:
        if not found.num_rows or not woods.num_rows:
            return _table(schema, [])
        ids, cells = ([np.frombuffer(b.as_py(), kind) for b in found[c]] for c, kind in (("ids", np.int64), ("cells", np.uint8)))
        cells, routed = np.concatenate(cells).reshape(-1, plan.features), (None, None)
        sums = np.zeros((len(cells), K))
        for i in np.lexsort((woods["root"].to_numpy(), woods["tree"].to_numpy())).tolist():
            row = {c: woods[c][i].as_py() for c in ("tree", "root", "feature", "cell", "left", "counts")}
            tree = Nodes.read(row, K)
            share = _shares(tree.counts * weights)
            if routed[0] != row["tree"]:
                routed = row["tree"], nodes[row["tree"]].reached(cells)
            mine = np.flatnonzero(routed[1] == row["root"])
            sums[mine] += share[tree.reached(cells if len(mine) == len(cells) else cells[mine])]
        ends = np.cumsum([len(i) for i in ids])
        return _table(schema, [
            [found["block"][i].as_py(), found["part"][i].as_py(), one.tobytes(), sums[e - len(one):e].tobytes()] for i, (one, e) in enumerate(zip(ids, ends))])

    def add(found: pa.Table) -> pa.Table:
        found = found.sort_by("part")  # sums of one order
        share = _shares(sum(np.frombuffer(v.as_py(), float) for v in found["votes"]).reshape(-1, K))
        return pa.table({"id": np.frombuffer(found["ids"][0].as_py(), np.int64), "votes": pa.array(list(share), pa.list_(pa.float64()))})

    sides = [side.repartition(tasks, "job").groupBy("job") for side in (left, right)]
    return sides[0].cogroup(sides[1]).applyInArrow(vote, schema).groupBy("block").applyInArrow(add, "id long, votes array<double>")


def importances(trees: DataFrame) -> np.ndarray:
    """Share of each feature in what a tree gains, the mean of all trees that gain."""
    long = trees.select("tree", F.posexplode("importance").alias("k", "v")).groupBy("tree", "k").agg(F.sum("v").alias("v"))
    share = F.try_divide(F.col("v"), F.col("total"))
    told = long.join(long.groupBy("tree").agg(F.sum("v").alias("total")), "tree").groupBy("k").agg(F.sum(share).alias("v")).orderBy("k").collect()  # one row per feature
    found = np.array([r["v"] or 0.0 for r in told])
    return found / (found.sum() or 1.0)
