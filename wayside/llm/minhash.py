"""Near-duplicates by min-max hashing.

A document is its set of distinct word shingles. Each permutation of hash space gives two values of a set, its minimum and
its maximum, so a signature needs half the hash evaluations. Signatures are cut into bands; documents that agree in a band
are candidates, and candidates are links only after their full sets were compared.

Sets that are equal are one class from the start, found by a 128-bit fingerprint of the sorted set: a third of all rows may
be copies and only one of them goes on. A bucket of a band never makes all its pairs. First every member is compared with
the smallest of its bucket, then with a second leader; in buckets that still hold several components, the members outside
the largest one are compared with all others, in blocks of bounded size that give links and not pairs. So what is found is
exactly what comparing all pairs of a bucket would connect.

With ``rows`` values in each of ``bands`` bands, sets of similarity s are missed with probability (1 - s^rows)^bands:
3e-7 at 0.8 for the defaults, less above.

Nulls: a document without words or text has an empty set and is linked with nothing; one with fewer words than a shingle has
its whole word sequence as its only shingle. Rows with equal ids are linked by their id; rows without id are linked with
nothing and have no component. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayside.llm.components import components
from wayside.session import cut, erase

ROWS, BANDS = 6, 48
KNOWN = 1_000_000  # word hashes a worker remembers before it starts anew
BLOCK = 1 << 17  # shingles handled at a time


class Hashes(dict):
    """Word to 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None, size: int, known: Hashes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes. ASCII case is folded; words are split at ASCII white space."""
    found = text.lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    size = min(size, len(h))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for i in range(size):  # order counts: the sum so far is mixed before the next word is added
        out ^= out >> np.uint64(29)
        out = out * MIX + h[i:i + len(out)]
    out ^= out >> np.uint64(32)
    return np.unique(out)


def permutations(n: int, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**32, n, np.uint32), rng.integers(0, 2**32, n, np.uint32) | np.uint32(1)


def signatures(sets: list[np.ndarray], flips: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Minimum and maximum of each non-empty set under each permutation x -> (x ^ flip) * factor of 32-bit space."""
    out = np.empty((len(sets), 2 * len(flips)), np.uint32)
    sizes = [len(s) for s in sets]
    first = 0
    while first < len(sets):
        last, total = first, 0
        while last < len(sets) and (last == first or total + sizes[last] <= BLOCK):
            total += sizes[last]
            last += 1
        flat = np.concatenate(sets[first:last])
        flat = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
        starts = np.concatenate(([0], np.cumsum(sizes[first:last])[:-1]))
        for i, (flip, factor) in enumerate(zip(flips, factors, strict=True)):
            moved = (flat ^ flip) * factor
            out[first:last, 2 * i] = np.minimum.reduceat(moved, starts)
            out[first:last, 2 * i + 1] = np.maximum.reduceat(moved, starts)
        first = last
    return out


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, which also depends on the band's number."""
    out = np.empty((len(values), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(values), np.uint64((b + 1) * 0x632BE59BD9B4E019 % 2**64))
        for i in range(b * rows, (b + 1) * rows):
            key ^= key >> np.uint64(31)
            key = key * MIX + values[:, i].astype(np.uint64)
        out[:, b] = key ^ (key >> np.uint64(32))
    return out


def sketches(docs: DataFrame, shingle: int, rows: int, bands: int) -> DataFrame:
    """(doc_id, n_shingles, fp_a, fp_b, keys): size, fingerprint and band keys of every document's set."""
    if rows * bands % 2:
        raise ValueError("rows * bands must be even: every permutation gives two values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        flips, factors = permutations(rows * bands // 2)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                sets = [shingles(t.as_buffer().to_pybytes() if t.is_valid else None, shingle, known) for t in part.column(1)]
                full = [s for s in sets if len(s)]
                keys = np.zeros((len(full), bands), np.uint64)
                if full:
                    keys = band_keys(signatures(full, flips, factors), bands, rows)
                lengths = np.array([len(s) for s in sets], np.int64)
                prints = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 2**64) for s in sets], np.uint64)
                prints = prints.reshape(-1, 2).view(np.int64)
                ends = np.concatenate(([0], np.cumsum(np.where(lengths > 0, bands, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(lengths), pa.array(np.ascontiguousarray(prints[:, 0])),
                    pa.array(np.ascontiguousarray(prints[:, 1])),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64).ravel())),
                ], names=["doc_id", "n_shingles", "fp_a", "fp_b", "keys"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(
        run, "doc_id long, n_shingles long, fp_a long, fp_b long, keys array<long>")


def compare(pairs: DataFrame, pool: DataFrame, shingle: int) -> DataFrame:
    """``pairs`` (a, b) with the size of their sets' intersection and union, from the texts in ``pool`` (id, text).

    Both texts come by joins on ids, which are split where an id is hot; every row then holds all it needs, and rows of the
    same ``a`` follow each other, so that its set is mostly made once.
    """
    one = pairs.join(pool.withColumnsRenamed({"id": "b", "text": "text_b"}), "b")
    both = one.join(pool.withColumnsRenamed({"id": "a", "text": "text_a"}), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, mine = Hashes(), None, np.empty(0, np.uint64)
        for batch in batches:
            common, union = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for i, a in enumerate(batch.column(0).to_pylist()):
                if held != a:
                    held, mine = a, shingles(batch.column(2)[i].as_buffer().to_pybytes(), shingle, known)
                other = shingles(batch.column(3)[i].as_buffer().to_pybytes(), shingle, known)
                common[i] = len(np.intersect1d(mine, other, assume_unique=True))
                union[i] = len(mine) + len(other) - common[i]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(common), pa.array(union)], names=["a", "b", "common", "whole"])

    return both.mapInArrow(run, "a long, b long, common long, whole long")


def sizes_allow(n: str, m: str, percent: int):
    """Whether sets of these sizes can be similar at all: the smaller may be the intersection, the larger the union."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def star_pairs(members: DataFrame, lead: str, percent: int) -> DataFrame:
    """Every member of a bucket that is not in the component of ``lead`` (a struct column) yet, with the lead."""
    pairs = members.where(F.col("component") != F.col(f"{lead}.component"))
    pairs = pairs.where(sizes_allow("n", f"{lead}.n", percent))
    return pairs.select(F.least("id", f"{lead}.id").alias("a"), F.greatest("id", f"{lead}.id").alias("b")).distinct()


def rest_links(members: DataFrame, pool: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) between bucket members in different components: all such pairs are compared, none is listed.

    Of a bucket, members outside its largest component (x) meet all members (y). Both sides are dealt into blocks of about
    BLOCK shingles; a group holds one block of each side, whatever the bucket's size, and gives one link for every component
    that an x is linked with.
    """
    parts = members.groupBy("bucket", "component").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    totals = cut(
        parts.groupBy("bucket").agg(F.max(F.struct("size", "component", "n")).alias("most"), F.sum("n").alias("all"))
        .select("bucket", F.col("most.component").alias("main"),
                F.ceil((F.col("all") - F.col("most.n")) / BLOCK).cast("int").alias("h"), F.ceil(F.col("all") / BLOCK).cast("int").alias("v")))
    sized = members.select("bucket", "id", "component").join(totals, "bucket").join(pool, "id")
    mine = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.col(n)).cast("int")
    line = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_x = F.transform(line("v"), lambda j: F.struct(F.lit(0).alias("side"), mine("h", 1).alias("i"), j.alias("j")))
    as_y = F.transform(line("h"), lambda i: F.struct(F.lit(1).alias("side"), i.alias("i"), mine("v", 2).alias("j")))
    both = F.when(F.col("component") != F.col("main"), F.concat(as_x, as_y)).otherwise(as_y)
    dealt = sized.select("bucket", "id", "component", "text", F.explode_outer(both).alias("at"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        known = Hashes()
        sets = [shingles(t, shingle, known) for t in frame["text"]]
        ids, parts, side = (frame[c].to_numpy() for c in ("id", "component", "side"))
        sizes = np.array([len(x) for x in sets])
        of_y = np.flatnonzero(side == 1)
        out = []
        if len(of_y) and len(of_y) < len(side):
            codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
            ends = np.cumsum(sizes)
            y_codes = np.concatenate([codes[ends[k] - sizes[k]:ends[k]] for k in of_y])
            starts = np.concatenate(([0], np.cumsum(sizes[of_y])[:-1]))
            marked = np.zeros(codes.max() + 1, np.int32)
            for k in np.flatnonzero(side == 0):
                held = codes[ends[k] - sizes[k]:ends[k]]
                marked[held] = 1
                common = np.add.reduceat(marked[y_codes], starts)
                marked[held] = 0
                linked = of_y[(100 * common >= percent * (sizes[k] + sizes[of_y] - common)) & (parts[of_y] != parts[k])]
                first = np.unique(parts[linked], return_index=True)[1]
                out += [(ids[k], ids[y]) for y in linked[first]]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    groups = dealt.select("bucket", "id", "component", "text", "at.*").groupBy("bucket", "i", "j")
    return groups.applyInPandas(run, "a long, b long")


def undecided(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members of those buckets that still hold several components, with each one's component and a ``second`` leader,
    of a component other than the leader's."""
    found = cut(components(links))
    placed = cut(members.select("bucket", "id", "n", "lead").join(found, "id", "left").withColumn(
        "component", F.coalesce("component", "id")))
    erase(found)
    one = F.struct("component", "id", "n")
    ends = placed.groupBy("bucket").agg(
        F.min(one).alias("low"), F.max(one).alias("high"),
        F.max(F.when(F.col("id") == F.col("lead.id"), F.col("component"))).alias("led"))
    open_ones = cut(ends.where("low.component != high.component").select(
        "bucket", "led", F.when(F.col("led") == F.col("high.component"), F.col("low")).otherwise(F.col("high")).alias("second")))
    kept = cut(placed.join(open_ones, "bucket"))
    erase(placed)
    erase(open_ones)
    return kept


def near_links(classes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) that connect what comparing all pairs of every bucket would connect.

    ``classes``: id, n, keys of one document for every distinct set; ``docs``: id, text. Two rounds of comparisons with
    leaders come before what is left is compared in blocks; they only save work.
    """
    spread = classes.select(F.explode("keys").alias("bucket"), "id", "n")
    one = F.struct(F.col("id").alias("component"), "id", "n")
    shared = spread.groupBy("bucket").agg(F.min(one).alias("lead"), F.count("*").alias("size")).where("size > 1")
    members = cut(spread.join(shared, "bucket").select("bucket", "id", "n", F.col("id").alias("component"), "lead"))
    pool = cut(docs.join(members.select("id").distinct(), "id", "left_semi"))
    similar = lambda compared: compared.where(100 * F.col("common") >= percent * F.col("whole")).select("a", "b")
    tried = cut(compare(star_pairs(members, "lead", percent), pool, shingle))
    left = undecided(members, similar(tried))
    outside = left.where("component != led")
    tried = tried.unionByName(cut(compare(star_pairs(outside, "second", percent), pool, shingle)))
    left = undecided(left, similar(tried))
    return similar(tried).unionByName(cut(rest_links(left, pool, shingle, percent)))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80,
                    rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links) and kept (its own)."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = cut(sketches(docs, shingle, rows, bands))
    classes = cut(
        sets.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("fp_a", "fp_b")
        .agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    )
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"))
    found = cut(components(near_links(classes, texts, shingle, percent)))
    placed = cut(
        classes.select("fp_a", "fp_b", "id").join(found, "id", "left")
        .select("fp_a", "fp_b", F.coalesce("component", "id").alias("component_id"))
    )
    own = sets.select("doc_id", "n_shingles", "fp_a", "fp_b").join(placed, ["fp_a", "fp_b"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return own.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
