"""Near-duplicate vectors: spherical k-means cells, blocked cosine products."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm._shared import Scratch, block_pairs, components, map_groups

#: Rows that the cells are fitted to at most, rows of a cell at which more cells are made, and most cells.
FIT_ROWS, CELL_ROWS, MAX_CELLS = 20_000, 1000, 512
#: Numbers of a table of vectors by cells that is held at once.
CELL_NUMBERS = 1 << 21
#: Rows of a block; two blocks are all that a task holds of a cell.
BLOCK_ROWS = 8192
#: Cosines that take about as long as dealing a row.
ROW_COSINES = 1000
#: Cosines that are held at once, rows that a worker hands over at once, and rows of the sample that numbers of cells are compared by.
PRODUCTS, OUT_ROWS, TRY_ROWS = 1 << 21, 4096, 2000


def clean(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``vec_id, label, v``: vectors with a label and only finite components, not all zero."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by the largest component first so that no square over- or underflows."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centres; begins with rows that lie far from each other and leaves empty cells where they are."""
    if not len(rows):
        return np.zeros((1, 0))
    centres = [rows[0]]
    nearest = rows @ rows[0]
    for _ in range(min(k, len(rows)) - 1):
        at = int(nearest.argmin())
        centres.append(rows[at])
        nearest = np.maximum(nearest, rows @ rows[at])
    found = np.array(centres)
    for _ in range(rounds):
        cell = (rows @ found.T).argmax(1)
        sums = np.zeros_like(found)
        np.add.at(sums, cell, rows)
        length = np.linalg.norm(sums, axis=1)
        found[length > 0] = sums[length > 0] / length[length > 0, None]
    return found


def visited(rows: np.ndarray, centres: np.ndarray, apart: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Each unit row's own cell, and a matrix of all cells in which it has to be compared."""
    dots = rows @ centres.T
    home = dots.argmax(1)
    between = apart[home]
    away = (dots[np.arange(len(rows)), home][:, None] - dots) / np.where(between > 1e-7, between, 1)
    visits = (away <= slack) & (np.arange(len(centres))[None] < home[:, None])
    visits[np.arange(len(rows)), home] = True
    return home, visits


def gaps(centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (centres @ centres.T)))


def fit(sample: np.ndarray, n: int, together: float, slack: float) -> np.ndarray:
    """Centres for ``n`` vectors, ``together`` of which have a label in common: of several numbers of cells the one that takes the least work.

    Vectors without clusters lie near the border of most cells: each would visit most of them, and one
    cell, whose blocks all meet, takes less. No number of cells misses a link.
    """
    tried = []
    cells = int(np.clip(n // CELL_ROWS, 1, MAX_CELLS))
    while True:
        centres = spherical_kmeans(sample, cells)
        rows = sample[:: max(1, len(sample) // TRY_ROWS)]
        home, visits = visited(rows, centres, gaps(centres), slack)
        own, load = (x * (together / max(1, len(rows))) for x in (np.bincount(home, minlength=len(centres)), visits.sum(0)))
        tried.append((float((load * np.maximum(1, load / BLOCK_ROWS) + own * load / ROW_COSINES).sum()), cells, centres))
        if cells == 1:
            return min(tried, key=lambda t: t[:2])[2]
        cells = max(1, cells // 4)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def assign(reps: DataFrame, centres: dict[int, np.ndarray], slack: float) -> DataFrame:
    """Rows for each cell that a vector has to be compared in: ``vec_id, label, dim, cell, home, copies, v``.

    A vector is at home in the cell of its best centre. It visits each earlier cell whose border, the
    plane between the two centres, is at most ``slack`` away: a vector beyond the border can be linked
    with it only if their distance reaches that far.
    """

    apart = {d: gaps(c) for d, c in centres.items()}

    def pieces(batches):
        most = max((len(c) for c in centres.values()), default=1)
        for batch in batches:
            for k in range(0, batch.num_rows, step := max(1, CELL_NUMBERS // most)):
                yield batch[k : k + step]

    def run(batches):
        for batch in pieces(batches):
            dims = np.array([len(x) for x in batch.column(3)])
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                rows, own = unit(_matrix(part.column(3))), centres[int(dim)]
                home, visits = visited(rows, own, apart[int(dim)], slack)
                every, cells = np.nonzero(visits)
                for k in range(0, len(every), OUT_ROWS):
                    who, cell = every[k : k + OUT_ROWS], cells[k : k + OUT_ROWS]
                    taken = part.take(pa.array(who))
                    ends = pa.array(np.arange(len(who) + 1) * dim, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [
                            taken.column(0), taken.column(1), pa.array(np.full(len(who), dim), pa.int32()), pa.array(cell, pa.int32()),
                            pa.array(cell == home[who], pa.bool_()), taken.column(2),
                            pa.ListArray.from_arrays(ends, pa.array(rows[who].ravel())),
                        ],
                        names=["vec_id", "label", "dim", "cell", "home", "copies", "v"],
                    )

    label = reps.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {label}, dim int, cell int, home boolean, copies long, v array<double>"
    return reps.select("vec_id", "label", "copies", "v").mapInArrow(run, schema)


def compare(batch: pa.RecordBatch, threshold: float) -> pa.RecordBatch | None:
    """Links within a pair of blocks: ``kind`` 0 counts links of ``a`` in ``n``, ``kind`` 1 is an edge ``a, b``.

    At least one side of a pair is at home in the cell; two that are both at home count once.
    """
    ids, copies, block = (batch.column(x).to_numpy() for x in ("vec_id", "copies", "block"))
    home, v = batch.column("home").to_numpy(zero_copy_only=False), _matrix(batch.column("v"))
    low, high = batch.column("i")[0].as_py(), batch.column("j")[0].as_py()
    left, right = np.flatnonzero((block == low) & home), np.flatnonzero(block == high)
    sides = [(left, right)]
    if low != high:
        sides.append((np.flatnonzero((block == high) & home), np.flatnonzero((block == low) & ~home)))
    links, group, edges = np.zeros(len(ids), np.int64), np.arange(len(ids)), []
    for x, y in sides:
        others = v[y].T
        for k in range(0, len(x), step := max(1, PRODUCTS // max(1, len(y)))):
            p, q = np.nonzero(v[x[k : k + step]] @ others >= threshold)
            p, q = x[k : k + step][p], y[q]
            if low == high:
                once = ~home[q] | (ids[p] < ids[q])
                p, q = p[once], q[once]
            np.add.at(links, p, copies[q])
            np.add.at(links, q, copies[p])
            # Of a row's links only those that join two groups become edges.
            starts = np.flatnonzero(np.diff(p, prepend=-1))
            for a, near in zip(p[starts].tolist(), np.split(q, starts[1:]) if len(p) else (), strict=True):
                while len(near := near[group[near] != group[a]]):
                    edges.append((ids[a], ids[near[0]]))
                    group[group == group[near[0]]] = group[a]
    some = np.flatnonzero(links)
    if not len(some):
        return None
    ends = np.array(edges, np.int64).reshape(-1, 2)
    none = np.zeros(len(ends), np.int64)
    columns = [np.r_[some * 0, none + 1].astype(np.int32), np.r_[ids[some], ends[:, 0]], np.r_[some * 0, ends[:, 1]], np.r_[links[some], none]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "a", "b", "n"])


def dedup_embeddings(
    scratch: Scratch, vectors: DataFrame, threshold: float = 0.93, slack: float | None = None,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """Groups of vectors that cosines of at least ``threshold`` join, within equal labels.

    Equal vectors are put together first. Cells of spherical k-means are fitted to at most FIT_ROWS
    vectors, as many cells as take the least work; every vector is indexed. ``slack`` is how far from a cell's border a vector is still
    compared in it: at ``sqrt(2 - 2 * threshold)``, the longest distance of a link and the default, no
    link can be missed. Within a cell, blocks of bounded size are compared by cosine products in double
    precision, which give counts of links and a spanning forest of them, never all pairs.

    Returns one row per input row: ``vec_id, n_links, component_id, kept``. Vectors without label, or
    null, all zero or with a component that is null or not finite, link with nothing; so do those with
    a null id, whose component is null. Vectors of different dimensions aren't compared. Rows that
    repeat an id count as vectors of their own in n_links. An empty table gives no rows.
    """
    slack = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9 if slack is None else slack
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    good = clean(vectors, id_col, vector_col, label_col)
    reps = good.groupBy("label", "v").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
    reps = scratch.table(reps, "reps")
    # Cells per dimension; there are few dimensions.
    sizes = reps.groupBy(F.size("v").alias("dim"), "label").agg(F.count(F.lit(1)).cast("double").alias("n"))
    sizes = sizes.groupBy("dim").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("together")).collect()
    centres = {}
    for dim, n, together in sizes:
        rate = int(min(1.0, FIT_ROWS / n) * 2**31)
        rows = reps.where((F.size("v") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(2**31)) < rate)).select("v").toArrow()
        sample = unit(_matrix(rows.column("v").combine_chunks())) if rows.num_rows else np.eye(1, dim)
        centres[dim] = fit(sample, int(n), together, slack)
    placed = scratch.table(assign(reps, centres, slack), "placed")
    in_cell = ["label", "dim", "cell"]
    dealt = block_pairs(scratch, placed, in_cell, "vec_id", BLOCK_ROWS, "cells")
    found = map_groups(dealt, [*in_cell, "i", "j"], lambda x: compare(x, threshold), "kind int, a long, b long, n long")
    found = scratch.table(found, "found")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    edges = found.where("kind = 1").select("a", "b")
    groups = components(scratch, edges, "links")
    facts = reps.select(F.col("vec_id").alias("rep"), "label", "v", "copies").join(counts, "rep", "left")
    facts = facts.join(groups, facts["rep"] == groups["node"], "left")
    facts = facts.select("label", "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    facts = scratch.table(facts, "facts")
    out = every.join(facts, ["label", "v"], "left")
    linked = F.col("vec_id").isNotNull() & F.col("component").isNotNull()
    return out.select(
        "vec_id",
        F.when(linked, F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(linked, F.col("component")).otherwise(F.col("vec_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
