"""V5: an inverted-file index. Vectors lie in cells, which are partitions of their table; a query reads a few of them.

Cells are learned by spherical k-means on a bounded sample of the vectors, whose buckets are folded
into ``DIMS`` dimensions for that purpose only: scores are always those of whole vectors. Stored
tables are partitioned by ``cell``, so a search for some cells is a join that Spark prunes to their
folders while the query runs. How many cells a wanted recall takes is measured on the sample when
cells are learned: few where vectors are crowded, nearly all where they lie evenly.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.search import Asked, asked_blocks, best_rows, no_hits, ranked

DIMS = 1024
#: Vectors by which cells are learned, at most: those of least hash of their names.
SAMPLE = 16_384
#: Cells, at most; about the square root of the number of vectors.
MOST_CELLS = 1_024
#: Sampled vectors that ask for their neighbours among the sample, and how many, to measure recall.
TRIALS, NEIGHBOURS = 512, 20
#: Cells are learned anew when the table has grown so many times since.
GROWTH = 4


def folded(bucket: np.ndarray, value: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Rows x DIMS of sparse rows, of unit length."""
    out = np.bincount(row * DIMS + bucket % DIMS, value, rows * DIMS).reshape(rows, DIMS)
    return out / np.maximum(np.linalg.norm(out, axis=1), 1e-30)[:, None]


def dense(lists: pa.ListArray) -> np.ndarray:
    flat, size = lists.flatten(), np.diff(np.asarray(lists.offsets))
    return folded(flat.field("bucket").to_numpy(zero_copy_only=False).astype(np.int64), flat.field("value").to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), size), len(lists))


@dataclass
class Cells:
    """``centres`` (cells x DIMS), and the recall that was measured with the nearest 1, 2, ... cells."""

    centres: np.ndarray
    recall: np.ndarray

    def probes(self, wanted: float) -> int:
        """As few cells as reached the wanted recall."""
        return min(int(np.searchsorted(self.recall, wanted)) + 1, len(self.centres))


def learned(vectors: DataFrame, cells: int | None = None, rounds: int = 10) -> Cells:
    """The cells of vectors (name, vector); one for fewer than two vectors."""
    n = vectors.count()
    draw = F.pmod(F.xxhash64("name"), F.lit(1 << 30))
    some = vectors.select("vector", draw.alias("draw"), "name").where(F.col("draw") < min(1.0, 1.2 * SAMPLE / max(n, 1) + 1e-3) * (1 << 30))
    x = dense(some.orderBy("draw", "name").limit(SAMPLE).select("vector").toArrow()["vector"].combine_chunks()) if n else np.zeros((0, DIMS))
    cells = min(cells or round(n**0.5), MOST_CELLS, len(x))
    if cells < 2:
        return Cells(np.zeros((1, DIMS)), np.ones(1))
    rng = np.random.default_rng(5)
    c = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        own, total = (x @ c.T).argmax(axis=1), np.zeros_like(c)
        np.add.at(total, own, x)
        length = np.linalg.norm(total, axis=1)
        # An empty cell takes the vector that is farthest from its own.
        far = np.argsort((x * c[own]).sum(axis=1))[: int((length == 0).sum())]
        c = np.where(length[:, None] > 0, total / np.maximum(length, 1e-30)[:, None], 0)
        c[length == 0] = x[far]
    return Cells(c, measured(x, c, rng))


def measured(x: np.ndarray, centres: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Recall of the nearest ``NEIGHBOURS`` among ``x`` by number of cells; neighbours in the whole table lie nearer, so it is no less there."""
    asks = rng.choice(len(x), min(TRIALS, len(x)), replace=False)
    near = x[asks] @ x.T
    near[np.arange(len(asks)), asks] = -np.inf
    k = min(NEIGHBOURS, len(x) - 1)
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    own = (x @ centres.T).argmax(axis=1)
    order = np.argsort(-(x[asks] @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :], axis=1)
    met = np.take_along_axis(place, own[best], axis=1)
    return np.cumsum(np.bincount(met.ravel(), minlength=len(centres))) / met.size


def placed(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """name, vector, cell: each vector with its nearest cell."""
    c = np.ascontiguousarray(centres.T, dtype=np.float32)

    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), 2048):
                some = batch.slice(k, 2048)
                own = (dense(some.column(1)).astype(np.float32) @ c).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(own)], names=["name", "vector", "cell"])

    return vectors.select("name", "vector").mapInArrow(run, "name string, vector array<struct<bucket: int, value: double>>, cell int")


@dataclass
class Index:
    """A table's folders, oldest first, each partitioned by ``cell`` (name, vector, cell), and its cells."""

    layers: list[DataFrame]
    cells: Cells

    def probed(self, asked: Asked, probes: int) -> np.ndarray:
        """Queries x cells: the ``probes`` cells nearest to each query."""
        size = np.zeros(len(asked.query), dtype=np.int64)
        size[asked.first[1:]] = 1
        q = folded(asked.buckets[np.cumsum(size)] if len(size) else size, asked.value, asked.query, asked.n)
        near = np.argsort(-(q @ self.cells.centres.T), axis=1, kind="stable")[:, :probes]
        out = np.zeros((asked.n, len(self.cells.centres)), dtype=bool)
        np.put_along_axis(out, near, True, axis=1)
        return out

    def rows(self, wanted: list[int]) -> DataFrame:
        """The newest rows of the wanted cells. A row counts unless a later folder, of the few that inserts have added, has its name."""
        spark = self.layers[0].sparkSession
        cells = F.broadcast(spark.createDataFrame([(c,) for c in wanted], "cell int").where("cell >= 0"))
        parts = []
        for k, layer in enumerate(self.layers):
            rows = layer.join(cells, "cell", "left_semi").select("name", "vector", "cell")
            later = [other.select("name") for other in self.layers[k + 1 :]]
            parts.append(rows.join(reduce(DataFrame.union, later).distinct(), "name", "left_anti") if later else rows)
        return reduce(DataFrame.union, parts)

    def top_k(self, queries: DataFrame, k: int, at_least: float = 0.2, recall: float = 0.95, probes: int | None = None, digits: int = 9) -> DataFrame:
        """query_id, name, score, rank: the best rows of each query's nearest cells (``probes``, or as many as the recall takes), scored by whole vectors."""
        probes, parts = probes or self.cells.probes(recall), []
        for asked in asked_blocks(queries):
            allowed = self.probed(asked, probes)
            rows = self.rows(np.flatnonzero(allowed.any(axis=0)).tolist())
            scored = best_rows(rows, asked, k, at_least, allowed).select("query_id", "name", F.round("value", digits).alias("score"))
            parts.append(ranked(scored.where(F.col("score") >= at_least), k, "name"))
        return reduce(DataFrame.union, parts) if parts else no_hits(queries)
