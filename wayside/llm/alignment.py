"""Alignment of two tokenizers over the same bytes: groups of tokens that end together, and how often ids meet in them.

A byte-level BPE (A) and a SentencePiece model (B) cut a text differently. Byte offsets where tokens of both end cut the two
id lists into groups: a dictionary from end to index is made for each side, the ends that both know are sorted, and each
pair of neighbouring ends slices both lists. All A-B pairs of a group are links.

A long text is worked through in portions. They are cut before single blanks with no blank on either side, where neither
tokenizer joins what stands before with what follows (A's pattern starts a token there, B's pieces hold markers only at
their start), so the whole text's tokens and groups are those of its portions. Links are expanded into id pairs with their
multiplicity; a group with very many links is expanded over its distinct ids, so that a long group of few ids stays small.

How many documents hold a pair is counted over the whole corpus by Spark. The counts then have to come back to every text:
pairs so frequent that at most ``held`` of them can exist are broadcast, all others are joined by a shuffle, where no pair has
many rows (``session.join_counted``).

Nulls: a null or empty text, one with U+2581 in it, and one whose tokens' bytes are not those of blank + text have no tokens.
Repeated rows are documents each. Extra columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayside.llm.pieces import MARK, check_model
from wayside.session import cut, join_counted

BEFORE_BLANK = re.compile(r"(?<=\S)(?= \S)")
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
#: Fixed value: how the byte-level tokenizer cuts a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PORTION = 1 << 15  # characters aligned at a time
ROWS = 32  # texts answered at a time
IDS = 1 << 32  # a pair is a * IDS + b
MOST_LINKS = 1 << 16  # links of a group that are listed one by one


@lru_cache(1)
def byte_of_letter() -> dict[str, int]:
    """Byte-level BPE writes each byte as a letter: printable Latin-1 as itself, the others by the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def entry_bytes(byte_bpe: str) -> dict[bytes, int]:
    """Bytes and id of every entry of a byte-level BPE's file, special tokens left out. An id is the rank of its merge."""
    with open(byte_bpe, encoding="utf-8") as file:
        told = json.load(file)
    special = {t["content"] for t in told["added_tokens"]}
    letters = byte_of_letter()
    return {bytes(letters[c] for c in t): i for t, i in told["model"]["vocab"].items() if t not in special}


class Vocabulary:
    """Bytes, lengths and spellings of one side's ids."""

    def __init__(self, entries: dict[int, bytes], last: str) -> None:
        size = max(entries) + 1
        self.bytes = [entries.get(i, b"") for i in range(size)]
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)
        self.spelled = np.array([f"{i}{mark}" for mark in (",", last) for i in range(size)], object)
        self.size = size

    def spell(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Every id with a comma behind it, or the closing mark where a group ends."""
        shown = ids.copy()
        shown[ends - 1] += self.size
        return self.spelled[shown]


class Aligner:
    """Both tokenizers and what is known of their ids."""

    def __init__(self, byte_bpe: str, piece_model: str) -> None:
        import sentencepiece
        import tiktoken

        entries = entry_bytes(byte_bpe)
        self.a = tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=entries, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        check_model(self.b)
        self.of_a = Vocabulary({i: t for t, i in entries.items()}, "|")
        self.of_b = Vocabulary({i: self.piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.vocab_size())}, ";")

    @staticmethod
    def piece_bytes(piece: str) -> bytes:
        byte = BYTE_PIECE.fullmatch(piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace(MARK, " ").encode()

    def tokens(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of both sides for a text that begins with a blank; none if the bytes of one side's tokens are not its own."""
        a, b = self.a.encode_ordinary(text), self.b.encode(text[1:], num_threads=1)
        raw = text.encode()
        # every byte is an entry of A, whose tokens therefore are the text; that its lengths add up is checked all the same
        if int(self.of_a.lengths[a].sum()) != len(raw) or b"".join(map(self.of_b.bytes.__getitem__, b)) != raw:
            return None
        return a, b

    def document(self, text: str | None) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups, n_links, hash of the groups, pairs and their numbers of links."""
        none = (0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64))
        if not text or MARK in text:
            return none
        n = np.zeros(4, np.int64)
        spelled, parts = hashlib.sha256(), []
        for i, portion in enumerate(portions(" " + text)):
            both = self.tokens(portion)
            if both is None:
                return none
            numbers, groups, *counted = self.align(*both)
            n += numbers
            spelled.update((";" + groups if i else groups).encode())
            parts.append(counted)
        return *n.tolist(), spelled.hexdigest(), *added_up(parts)

    def align(self, a: list[int], b: list[int]) -> tuple[tuple[int, int, int, int], str, np.ndarray, np.ndarray]:
        """Numbers of tokens, groups and links, the groups spelled out, the linked pairs and their numbers of links."""
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        # from end to the number of tokens up to it
        a_at = dict(zip(self.of_a.lengths[ids_a].cumsum().tolist(), range(1, len(a) + 1), strict=True))
        b_at = dict(zip(self.of_b.lengths[ids_b].cumsum().tolist(), range(1, len(b) + 1), strict=True))
        shared = sorted(a_at.keys() & b_at.keys())
        a_end, b_end = (np.array(itemgetter(*shared, shared[-1])(at)[:-1], np.int64) for at in (a_at, b_at))
        a_size, b_size = np.diff(a_end, prepend=0), np.diff(b_end, prepend=0)
        pairs, links = linked(ids_a, ids_b, a_end, b_end, a_size, b_size)
        # every id at its place: a group's A ids before its B ids
        group_a, group_b = (np.repeat(np.arange(len(shared)), size) for size in (a_size, b_size))
        out = np.empty(len(ids_a) + len(ids_b), object)
        place_a, place_b = np.arange(len(ids_a)), np.arange(len(ids_b))
        out[place_a + (b_end - b_size)[group_a]] = self.of_a.spell(ids_a, a_end)
        out[place_b + a_end[group_b]] = self.of_b.spell(ids_b, b_end)
        numbers = (len(a), len(b), len(shared), int((a_size * b_size).sum()))
        return numbers, "".join(out.tolist())[:-1], pairs, links


def portions(text: str) -> Iterator[str]:
    """The text in pieces of about PORTION characters, cut where neither tokenizer looks across."""
    start = 0
    while len(text) - start > 2 * PORTION:
        found = BEFORE_BLANK.search(text, start + PORTION)
        if found is None:
            break
        yield text[start:found.start()]
        start = found.start()
    yield text[start:]


def added_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of several (values, counts), and their counts."""
    if len(parts) == 1:
        return tuple(parts[0])
    values, where = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    counts = np.zeros(len(values), np.int64)
    np.add.at(counts, where, np.concatenate([c for _, c in parts]))
    return values, counts


def linked(ids_a, ids_b, a_end, b_end, a_size, b_size) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (a * IDS + b) over all groups, and how many links each has."""
    wide = a_size * b_size > MOST_LINKS
    times = np.repeat(np.where(wide, 0, b_size), a_size)  # links of every A token
    total = int(times.sum())
    first = np.repeat(b_end - b_size, a_size)
    within = np.arange(total) - np.repeat(times.cumsum() - times, times)
    codes = np.repeat(ids_a, times) * IDS + ids_b[np.repeat(first, times) + within]
    parts = [np.unique(codes, return_counts=True)]
    for g in np.flatnonzero(wide):
        left = Counter(ids_a[a_end[g] - a_size[g]:a_end[g]].tolist())
        right = Counter(ids_b[b_end[g] - b_size[g]:b_end[g]].tolist())
        found = {x * IDS + y: n * m for x, n in left.items() for y, m in right.items()}
        parts.append((np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))))
    return added_up(parts)


FIELDS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>"


def align(docs: DataFrame, byte_bpe: str, piece_model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, the numbers of tokens, groups and links, the hash of the groups, and the distinct linked
    ``pairs`` (a * IDS + b) with how many ``links`` each has. The two paths are files that every executor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_bpe, piece_model)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                found = list(zip(*[aligner.document(t) for t in part.column(1).to_pylist()], strict=True))
                lists = []
                for arrays in found[5:]:
                    ends = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays))))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(x, pa.int64()) for x in found[:4]], pa.array(found[4], pa.string()), *lists],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), text).mapInArrow(run, f"doc_id {kind}, {FIELDS}")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Every linked pair of the corpus: pair, n (documents that hold it) and whether no other pair of its A id has more."""
    counts = cut(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    a = F.shiftright("pair", 32).alias("a")
    most = counts.groupBy(a).agg(F.max("n").alias("most"))  # one row per id of A: bounded by its vocabulary
    return counts.join(F.broadcast(most), F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame, held: int = 200_000) -> DataFrame:
    """Documents with n_best (links whose pair is its A id's most frequent) and count_sum (frequencies over all links)."""
    rows = cut(aligned.withColumn("row", F.monotonically_increasing_id()))
    counts = cut(pair_counts(rows))
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select(
        "row", F.col("x.pairs").alias("pair"), F.col("x.links").alias("times"))
    met = join_counted(each, counts, "pair", "n", held)
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    none = F.lit(0).cast("long")
    return rows.drop("pairs", "links").join(sums, "row", "left").drop("row").withColumns(
        {c: F.coalesce(c, none) for c in ("n_best", "count_sum")})
