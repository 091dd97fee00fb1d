"""SentencePiece encoding and decoding with a table of distinct chunks.

The model's pieces hold whitespace markers only at their start, so no piece crosses from a word into the marker of the
next, and merging one marked word does not depend on its neighbours. A text is cut into marked words (one or more markers
and what follows); every distinct one is segmented once by the library, and ids are joined back by position. Decoding works
the same way. The table is one per task: a table over the whole corpus would have to meet every word of every text in a
shuffle many times the input, while a task meets nearly all its words again after its first texts.

Nulls: a null text is empty, which gives the end id alone. Markers that stand in a text are treated as blanks, as the library
does. Columns besides the text are passed on; repeated rows are encoded each. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
CHUNKS = re.compile(" +[^ ]*")
KEPT = 300_000  # distinct chunks a task keeps before it starts anew
ROWS = 64  # texts encoded at a time


class Chunk(NamedTuple):
    ids: list[int]
    text: str


def check_model(model) -> None:
    """The chunk table is exact only if no piece holds a marker after another character."""
    for i in range(model.vocab_size()):
        if MARK in model.id_to_piece(i).lstrip(MARK):
            raise ValueError(f"piece {model.id_to_piece(i)!r} crosses a whitespace marker")


class ChunkTable:
    """Distinct marked words of a model, each segmented and decoded once."""

    def __init__(self, model) -> None:
        self.model, self.held = model, {}

    def look_up(self, texts: list[str]) -> list[list[Chunk]]:
        if len(self.held) > KEPT:
            self.held = {}
        cut = [CHUNKS.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        new = list(set(chain.from_iterable(cut)).difference(self.held))
        # the library puts one marker before a text: what it is given lacks the chunk's first one
        ids = self.model.encode([c[1:] for c in new], num_threads=1)
        for c, found in zip(new, ids, strict=True):
            # a lone marker has no text to encode; inside a text it is the marker's own piece
            self.held[c] = Chunk(found, self.model.decode(found)) if c != " " else self.lone()
        return [list(map(self.held.__getitem__, chunks)) for chunks in cut]

    def lone(self) -> Chunk:
        return Chunk([self.model.piece_to_id(MARK)], "")


def encode(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``ids`` (end id included) and ``decoded``, the text that the ids decode to.

    ``model_file`` is a path that every executor has. Columns named ids or decoded are replaced.
    """
    others = [c for c in docs.columns if c not in (text, "ids", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        check_model(model)
        table, end = ChunkTable(model), [model.eos_id()]
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                found = table.look_up([t or "" for t in part.column(len(others)).to_pylist()])
                ids = [list(chain(chain.from_iterable(c.ids for c in chunks), end)) for chunks in found]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays([
                    *part.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    pa.array([" ".join([c.text for c in chunks]) for chunks in found], pa.string()),
                ], names=[*others, "ids", "decoded"])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others]
    return docs.select(*others, text).mapInArrow(run, ", ".join([*fields, "ids array<int>", "decoded string"]))
