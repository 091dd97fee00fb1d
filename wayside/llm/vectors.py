"""Near-duplicates of embeddings: spherical k-means cells, blocked cosine products within a cell.

Equal vectors of a label are one from the start. Each vector has a home cell, that of its nearest centroid, and visits every
other cell in which a vector within the angle could be at home. A vector y at home in c' is nearer to c' than to c, so it
lies beyond the plane between the two centroids; x in c visits c' if its distance to that plane is at most the sine of the
angle. So all links of x are found in x's home cell, each once, and none is lost. How many cells are visited depends on the
data: few for clustered vectors, nearly all for random directions (then the work is that of comparing all, by label).

Cells are cut into blocks; a task multiplies one block of homes with one of visitors, and gives link counts and the links of
a spanning forest. So the largest cell costs more tasks, not larger ones, and no list of all pairs is made.

Vectors of different lengths have no cosine; those of one length are compared with each other whatever the length. Lengths with
at least BOOKED distinct vectors get their own codebook, the others are one cell each.

Nulls: vectors that are null, zero, or hold null or non-finite components, and vectors with a null label, are linked with
nothing. Rows with a null id take part in nothing and have no component. Rows that repeat an id are rows of their own, linked
if their vectors are: inside, every distinct vector has its own number. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayside.llm.components import components
from wayside.session import cut, erase

MOST_CELLS = 4096  # bounds the codebook that every task holds
BLOCK = 1024
BOOKED = 4096  # distinct vectors of a length from which on it has a codebook


def unit_rows(lists: pa.ListArray) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(lists), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def usable(vector: str, label: str, key: str):
    """Whether a row can be linked at all."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return F.col(key).isNotNull() & F.col(label).isNotNull() & F.coalesce(fine & some & (F.size(v) > 0), F.lit(False))


def codebook(points: DataFrame, cells: int, rounds: int) -> np.ndarray:
    """Centroids of spherical k-means over all ``points`` (vector): unit rows, at most ``cells`` <= MOST_CELLS of them.

    Starts from the vectors with the smallest hashes. A round sums the vectors of each cell within its task; only sums meet.
    """
    first = points.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(cells).collect()  # a codebook, bounded
    centres = np.array([r[0] for r in first], np.float64)
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    for _ in range(rounds):
        now = centres

        def sums(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(now)
            for batch in batches:
                if len(batch):
                    rows = unit_rows(batch.column(0))
                    np.add.at(total, (rows @ now.T).argmax(1), rows)
            held = np.flatnonzero(total.any(1))
            if len(held):
                spread = total[held]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(held, spread.shape[1]).astype(np.int32)),
                    pa.array(np.tile(np.arange(spread.shape[1], dtype=np.int32), len(held))), pa.array(spread.ravel()),
                ], names=["cell", "axis", "value"])

        parts = points.select("vector").mapInArrow(sums, "cell int, axis int, value double")
        whole = parts.groupBy("cell", "axis").agg(F.sum("value").alias("value")).toPandas()  # cells x axes numbers
        moved = np.zeros_like(centres)
        moved[whole["cell"], whole["axis"]] = whole["value"]
        norms = np.linalg.norm(moved, axis=1, keepdims=True)
        centres = np.where(norms > 1e-12, moved / np.maximum(norms, 1e-12), centres)
    return np.unique(centres, axis=0)


def visits(points: DataFrame, centres: np.ndarray, least: float) -> DataFrame:
    """``points`` once for their home cell and once for every cell they must visit: cell, home (boolean) and all columns."""
    sine = math.sqrt(1 - least * least)
    book = points.sparkSession.sparkContext.broadcast(centres)  # MOST_CELLS vectors at most
    gaps = np.linalg.norm(centres[:, None, :] - centres[None, :, :], axis=2) if len(centres) <= 512 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = book.value
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                rows = unit_rows(part.column(part.schema.get_field_index("vector")))
                near = rows @ centres.T
                home = near.argmax(1)
                if gaps is not None:
                    gap = gaps[home]
                else:
                    gap = np.sqrt(np.maximum(2 - 2 * (centres[home] @ centres.T), 0))
                reach = (near[np.arange(len(rows)), home][:, None] - near) <= gap * sine + 1e-9
                reach[np.arange(len(rows)), home] = True
                row, cell = np.nonzero(reach)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(cell.astype(np.int32)), pa.array(cell == home[row])],
                    names=[*part.schema.names, "cell", "home"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    return points.mapInArrow(run, f"{fields}, cell int, home boolean")


def forest(near: np.ndarray, homes: np.ndarray, visitors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (id, id) that connect what the rows of a 0/1 block connect: each id with the smallest one it reaches."""
    rows, cols = homes.copy(), visitors.copy()
    big = np.iinfo(np.int64).max
    while True:
        low = np.where(near, cols[None, :], big).min(1)
        new_rows = np.minimum(rows, low)
        new_cols = np.minimum(cols, np.where(near, new_rows[:, None], big).min(0))
        if (new_rows == rows).all() and (new_cols == cols).all():
            break
        rows, cols = new_rows, new_cols
    ids, roots = np.concatenate([homes, visitors]), np.concatenate([rows, cols])
    moved = ids != roots
    return ids[moved], roots[moved]


def block_links(least: float):
    """What one block of homes and one of visitors give: per home the rows linked with it, and links of a forest."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        homes, seen = frame[frame["side"] == 0], frame[frame["side"] == 1]
        out = {"id": [], "n_links": [], "other": []}
        if len(homes) and len(seen):
            a, b = (np.array(x["vector"].tolist(), np.float64) for x in (homes, seen))
            na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
            near = (a @ b.T) / (na[:, None] * nb[None, :]) >= least
            ids, others, copies = homes["id"].to_numpy(), seen["id"].to_numpy(), seen["copies"].to_numpy()
            near &= ids[:, None] != others[None, :]
            low, root = forest(near, ids, others)
            counts = near @ copies
            out = {"id": np.concatenate([ids, low]), "n_links": np.concatenate([counts, np.zeros(len(low), np.int64)]),
                   "other": np.concatenate([ids, root])}
        return pd.DataFrame(out).astype({"id": "int64", "n_links": "int64", "other": "int64"})

    return run


def near_vectors(rows: DataFrame, least: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                 cells: int | None = None, rounds: int = 3) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest id reachable by links) and kept (its own).

    ``cells``: how many of a codebook; by default a 32nd of the square root of the number of its vectors, at most MOST_CELLS.
    """
    spark = rows.sparkSession
    table = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    able = usable("vector", "label", "vec_id")
    points = cut(table.where(able).groupBy("label", "vector").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumns(
        {"id": F.monotonically_increasing_id(), "length": F.size("vector")}))
    per_length = points.groupBy("length").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= (BOOKED if cells is None else 1))
    booked = {r["length"]: r["n"] for r in per_length.collect()}  # at most one for every BOOKED vectors
    slim = points.select("label", "length", "id", "copies", "vector")
    lone = slim.where(~F.col("length").isin(list(booked))) if booked else slim
    dealt = lone.withColumns({"cell": F.lit(0), "home": F.lit(True)})
    for length, n in booked.items():
        part = slim.where(F.col("length") == length)
        centres = codebook(part, cells or min(MOST_CELLS, max(1, math.isqrt(n) // 32)), rounds)
        dealt = dealt.unionByName(visits(part, centres, least))
    spread = cut(dealt)
    found = cut(compare_cells(spread, least))
    counts = found.groupBy("id").agg(F.sum("n_links").alias("links"))
    reached = cut(components(found.where("id != other").select(F.col("id").alias("a"), F.col("other").alias("b"))))
    erase(spread)
    named = reached.join(points.select("id", "least"), "id").groupBy("component").agg(F.min("least").alias("smallest"))
    placed = cut(points.join(counts, "id", "left").join(reached.join(named, "component"), "id", "left").select(
        "label", "vector", F.lit(True).alias("able"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
        F.coalesce("smallest", "least").alias("component")))
    joined = table.withColumn("able", able).join(placed, ["label", "vector", "able"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return joined.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def compare_cells(spread: DataFrame, least: float) -> DataFrame:
    """(id, n_links, other) over all blocks of all cells of all labels and lengths.

    Cell sizes are counted first. A cell with h blocks of homes and v of visitors gives h * v groups; a home row goes to
    one row of groups, a visitor to one column, so no group holds more than about two blocks.
    """
    sizes = cut(spread.groupBy("label", "length", "cell").agg(
        F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("all")))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    sized = spread.join(sizes, ["label", "length", "cell"]).withColumns({"h": F.greatest(blocks("homes"), F.lit(1)), "v": blocks("all")})
    mine = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.col(n)).cast("int")
    line = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_home = F.when(F.col("home"), F.transform(line("v"), lambda j: F.struct(
        F.lit(0).alias("side"), mine("h", 1).alias("i"), j.alias("j"))))
    as_visitor = F.transform(line("h"), lambda i: F.struct(F.lit(1).alias("side"), i.alias("i"), mine("v", 2).alias("j")))
    dealt = sized.select("label", "length", "cell", "id", "copies", "vector", F.explode(
        F.concat(F.coalesce(as_home, F.array().cast("array<struct<side:int,i:int,j:int>>")), as_visitor)).alias("at"))
    groups = dealt.select("label", "length", "cell", "id", "copies", "vector", "at.*").groupBy("label", "length", "cell", "i", "j")
    return groups.applyInPandas(block_links(least), "id long, n_links long, other long")
