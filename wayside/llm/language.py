"""Language identification: multinomial naive Bayes over hashed character n-grams.

N-grams of two and three characters of the lower-cased text are hashed into BINS counters per language, over all labelled
texts; tasks count their own rows and only counters meet. Languages are dealt into blocks of LANGUAGES by name; the matrix of
log probabilities of a block (LANGUAGES x BINS, so bounded) is broadcast. Texts are scored in batches: their counters as
one sparse matrix, whose product with the block is the log likelihood of every text in every language. With several blocks
each scores all texts and the answers are joined: the largest likelihood wins, and all enter the posterior.

Nulls: a null text, or one without a letter, is ``und`` with score 0 and is not learned from; a null label is not learned.
Repeated rows count and are answered each. Without any labelled text every answer is ``und``. An empty table gives an empty
result. Of equally likely languages the smaller name is the answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayside.session import cut

BINS = 1 << 14
SIZES = (2, 3)
LANGUAGES = 256  # of one block
HELD = 64  # languages whose counters a task keeps before it hands them on
CHARS = 1 << 19  # characters scored at a time
BLANK = np.where([chr(c).isalpha() for c in range(128)], np.arange(128), 32).astype(np.uint32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The counters of all texts as a sparse matrix: (text, bin, n), sorted. ASCII that is no letter counts as a blank."""
    parts = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    codes = np.concatenate(parts)
    codes = np.where(codes < 128, BLANK[np.minimum(codes, 127)], codes)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), [len(p) for p in parts])
    cells = []
    for size in SIZES:
        h = np.full(max(0, len(codes) - size + 1), size, np.uint32)
        for i in range(size):
            h = (h ^ codes[i:i + len(h)]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        mine = owner[:len(h)]
        inside = mine == owner[size - 1:size - 1 + len(h)]  # not over the border of two texts
        cells.append(mine[inside] * BINS + (h[inside] % np.uint32(BINS)).astype(np.int64))
    cell, n = np.unique(np.concatenate(cells), return_counts=True)
    return cell // BINS, cell % BINS, n


def portions(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about CHARS characters, with the place of the first; a longer text is a run of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHARS:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, texts[start:]


@dataclass(frozen=True)
class Block:
    """Some languages: names, log P(bin | language) as BINS x languages, and log priors."""

    languages: tuple[str, ...]
    weights: np.ndarray
    prior: np.ndarray


@dataclass(frozen=True)
class Model:
    """All languages, sorted by name, and their blocks, which are made one at a time from a written table of counters."""

    languages: tuple[str, ...]
    counters: DataFrame | None
    total: int
    smoothing: float

    def blocks(self) -> Iterator[Block]:
        for at in range(0, len(self.languages), LANGUAGES):
            names = self.languages[at:at + LANGUAGES]
            cells = self.counters.where(F.col("block") == at // LANGUAGES).select("lang", "bin", "n").toPandas()  # LANGUAGES x BINS cells
            column = cells["lang"].map({name: j for j, name in enumerate(names)}).to_numpy()
            bins, n = cells["bin"].to_numpy(), cells["n"].to_numpy()
            counts, rows = np.zeros((BINS, len(names))), np.zeros(len(names))
            rows[column[bins < 0]] = n[bins < 0]
            counts[bins[bins >= 0], column[bins >= 0]] = n[bins >= 0]
            counts += self.smoothing
            yield Block(names, np.log(counts / counts.sum(0)), np.log(rows / self.total))


def learn(docs: DataFrame, text: str, lang: str, smoothing: float = 0.5) -> Model:
    """Fit to all rows of ``docs`` with text and label, whatever the number of languages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}  # per language its counters, and its rows at the end

        def handed_on() -> Iterator[pa.RecordBatch]:
            for label, counts in held.items():
                bins = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([
                    pa.array([label] * len(bins), pa.string()), pa.array(np.where(bins == BINS, -1, bins).astype(np.int32)), pa.array(counts[bins]),
                ], names=["lang", "bin", "n"])
            held.clear()

        for batch in batches:
            texts, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, part in portions(texts):
                for i, (t, label) in enumerate(zip(part, labels[start:], strict=False)):
                    if has_letter(t):
                        if label not in held and len(held) >= HELD:
                            yield from handed_on()
                        mine = held.setdefault(label, np.zeros(BINS + 1, np.int64))
                        _, bins, n = grams([t])
                        mine[bins] += n
                        mine[BINS] += 1
        yield from handed_on()

    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    sums = cut(labelled.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")))
    rows = sums.where("bin = -1").select("lang", "n").collect()  # one row per language: its name and rows
    names = tuple(sorted(r["lang"] for r in rows))
    if not names:
        return Model((), None, 0, smoothing)
    starts = names[::LANGUAGES]  # the first name of every block
    block = sum((F.when(F.col("lang") >= F.lit(s), 1).otherwise(0) for s in starts[1:]), F.lit(0))
    return Model(names, cut(sums.withColumn("block", block)), sum(r["n"] for r in rows), smoothing)


def likelihoods(block: Block, texts: list[str]) -> np.ndarray:
    """Log prior plus log likelihood, texts x languages."""
    out = np.tile(block.prior, (len(texts), 1))
    for start, part in portions(texts):
        owner, bins, n = grams(part)
        if not len(owner):
            continue
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        for at in range(0, len(first), 64):  # the rows of the product of 64 texts at a time
            lo, hi = first[at], first[at + 64] if at + 64 < len(first) else len(owner)
            terms = block.weights[bins[lo:hi]] * n[lo:hi, None]
            out[start + owner[first[at:at + 64]]] += np.add.reduceat(terms, first[at:at + 64] - lo)
    return out


def scored(docs: DataFrame, block: Block, text: str) -> DataFrame:
    """``docs`` without the text, with the block's best language, its log likelihood and the log of the sum of all."""
    shared = docs.sparkSession.sparkContext.broadcast(block)  # LANGUAGES x BINS numbers
    others = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = batch.column(len(others)).to_pylist()
            told = np.array([has_letter(t) for t in texts], bool)
            logs = likelihoods(known, [t if good else "" for t, good in zip(texts, told, strict=True)])
            best = logs.argmax(1)
            top = logs[np.arange(len(logs)), best]
            every = top + np.log(np.exp(logs - top[:, None]).sum(1))
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:-1], pa.array([known.languages[b] if good else None for b, good in zip(best, told, strict=True)], pa.string()),
                pa.array(top), pa.array(every)], names=[*others, "best", "top", "every"])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others]
    return docs.select(*others, text).mapInArrow(run, ", ".join([*fields, "best string, top double, every double"]))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``lang_pred`` and ``score``; only the text is looked at."""
    others = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    slim = docs.select(*others, text)

    def answered(best: Column, score: Column) -> list[Column]:
        return [F.coalesce(best, F.lit("und")).alias("lang_pred"), F.when(best.isNull(), 0.0).otherwise(score).alias("score")]

    if not model.languages:
        return slim.select(*others, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    blocks = model.blocks()
    if len(model.languages) <= LANGUAGES:
        return scored(slim, next(blocks), text).select(*others, *answered(F.col("best"), F.exp(F.col("top") - F.col("every"))))
    rows = cut(slim.withColumn("_row", F.monotonically_increasing_id()))
    parts = [scored(rows.select("_row", text), block, text).withColumn("_block", F.lit(k)) for k, block in enumerate(blocks)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    won = whole.groupBy("_row").agg(
        F.max_by("best", F.struct(F.col("top"), -F.col("_block"))).alias("best"),
        F.max("top").alias("top"), F.collect_list("every").alias("every"))  # one number for every block
    likely = F.aggregate("every", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    return rows.drop(text).join(won, "_row").select(*others, *answered(F.col("best"), 1 / likely))
