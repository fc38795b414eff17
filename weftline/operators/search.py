"""Exact vector search, dense and sparse."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.vectors import dot

#: Queries that are sent to every task for one pass, dense ones and sparse ones.
QUERY_LIMIT, SPARSE_LIMIT = 10_000, 1_024


def in_blocks(queries: DataFrame, key: str, at_most: int = QUERY_LIMIT) -> list[DataFrame]:
    """A stated query set in parts of about ``at_most`` rows, by a hash of its key, each to be broadcast for one pass."""
    blocks = max(1, -(-queries.count() // at_most))
    part = F.pmod(F.xxhash64(key), F.lit(blocks))
    return [F.broadcast(queries.where(part == k) if blocks > 1 else queries) for k in range(blocks)]


def top_k(queries: DataFrame, vectors: DataFrame, k: int, measure: str = "cosine", at_least: float | None = None, digits: int | None = None) -> DataFrame:
    """query_id, id, score, rank of the k best rows (id, embedding) for each query (query_id, query).

    ``measure`` is cosine or dot; scores count as rounded to ``digits``, if given, and ties go to the
    lesser id. The query set is stated by the caller; each block of ``QUERY_LIMIT`` queries takes a
    pass over the vectors, which are scored where they are read: only a task's best leave it.
    """
    parts, rows = [], vectors.select("id", doubles("embedding"))
    asks = queries.select("query_id", doubles("query"))
    for few in in_blocks(asks, "query_id"):
        scored = best_dense(rows, few.toArrow(), k, measure, at_least, dict(asks.dtypes)["query_id"])
        parts.append(ranked(scored if digits is None else scored.withColumn("score", F.round("score", digits)), k))
    return reduce(DataFrame.union, parts)


def doubles(name: str) -> Column:
    return F.transform(name, lambda x: x.cast("double")).alias(name)


#: Scores that one step of a task holds, and pairs that it scores anew at once.
STEP, AT_ONCE = 1 << 21, 1 << 15


def matrix(lists: pa.Array | pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lists of ``size`` numbers without a null, and these as rows."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    at = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(pc.list_value_length(lists), size), False)))
    some = lists.take(pa.array(at))
    flat = some.flatten()
    whole = ~np.asarray(flat.is_null()).reshape(len(at), size).any(axis=1)
    return at[whole], flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(at), size)[whole]


def folded_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``vectors.dot`` of two arrays' rows, bit by bit: products are added from the first on."""
    with np.errstate(all="ignore"):
        return np.cumsum(a * b, axis=1)[:, -1] if a.shape[1] else np.zeros(len(a))


def best_dense(vectors: DataFrame, asked: pa.Table, k: int, measure: str, at_least: float | None, kind: str) -> DataFrame:
    """query_id, id, score: of each task's rows (id, embedding) the ``k`` best for each query of a block, and what rounding may make their equal.

    Matrix products find the pairs that may be among the best; these are scored as the expressions
    ``dot`` and ``cosine`` do. Pairs with a null have no score, a NaN is above all numbers.
    """
    blocks = []
    for size in sorted({n for n in pc.list_value_length(asked["query"]).to_pylist() if n is not None}):
        at, q = matrix(asked["query"], size)
        length = np.sqrt(folded_dot(q, q))
        fine = ~(length <= 0) if measure == "cosine" else np.ones(len(at), dtype=bool)
        blocks.append((size, at[fine], q[fine], length[fine]))
    ids = asked["query_id"].combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        floor = np.full(len(ids), -np.inf if at_least is None else at_least)
        for batch in batches:
            for size, at, q, q_length in blocks:
                if not len(at):
                    continue
                places, every = matrix(batch.column(1), size)
                step = max(1, STEP // len(at))
                for k0 in range(0, len(places), step):
                    v, place = every[k0 : k0 + step], places[k0 : k0 + step]
                    with np.errstate(all="ignore"):
                        v_length = np.sqrt(folded_dot(v, v))
                        if measure == "cosine":
                            v, place, v_length = (x[~(v_length <= 0)] for x in (v, place, v_length))
                            near, slack = (q / q_length[:, None]) @ (v / v_length[:, None]).T, np.full(len(at), SLACK)
                        else:
                            near, slack = q @ v.T, SLACK * (1 + q_length * v_length.max(initial=0))
                        least = floor[at]
                        if len(v) > k:
                            found = np.partition(np.where(np.isfinite(near), near, -np.inf), len(v) - k, axis=1)[:, len(v) - k]
                            least = np.maximum(least, found)
                        i, j = np.nonzero(~(near < np.where(np.isfinite(slack), least - slack, -np.inf)[:, None]))
                        score = np.zeros(len(i))
                        for n in range(0, len(i), AT_ONCE):
                            a, b = i[n : n + AT_ONCE], j[n : n + AT_ONCE]
                            score[n : n + AT_ONCE] = folded_dot(q[a], v[b])
                        if measure == "cosine":
                            score = score / (q_length[i] * v_length[j])
                    if at_least is not None:  # which a NaN passes
                        i, j, score = (x[~(score < at_least)] for x in (i, j, score))
                    new = pa.table({"query": at[i], "score": score, "id": batch.column(0).take(pa.array(place[j]))})
                    held = best_held(new if held is None else pa.concat_tables([held, new]), k, floor)
        if held is not None and len(held):
            yield from pa.table({"query_id": ids.take(held["query"].combine_chunks()), "id": held["id"], "score": held["score"]}).combine_chunks().to_batches(4096)

    return vectors.mapInArrow(run, f"query_id {kind}, id {dict(vectors.dtypes)['id']}, score double")


def best_held(rows: pa.Table, k: int, floor: np.ndarray) -> pa.Table:
    """The ``k`` best of each query's rows (query, score, id) and those within ``SLACK`` of them, of equal scores the least ids; ``floor`` is raised to the k-th."""
    score = rows["score"].to_numpy()
    keys = pa.table({"query": rows["query"], "number": ~np.isnan(score), "below": -np.where(np.isnan(score), np.inf, score), "id": rows["id"]})
    rows = rows.take(pc.sort_indices(keys, [(c, "ascending") for c in keys.column_names], null_placement="at_start"))
    query, score = rows["query"].to_numpy(), rows["score"].to_numpy()
    if not len(query):
        return rows
    place = np.arange(len(query))
    start = np.maximum.accumulate(np.where(np.append(True, query[1:] != query[:-1]), place, 0))
    # NaN equals NaN here.
    like = np.append(False, (query[1:] == query[:-1]) & ((score[1:] == score[:-1]) | (np.isnan(score[1:]) & np.isnan(score[:-1]))))
    group = np.maximum.accumulate(np.where(like, 0, place))
    last = np.flatnonzero(place - start == k - 1)
    kth = score[last]
    kth_of = np.full(len(floor), -np.inf)
    kth_of[query[last]] = np.where(np.isfinite(kth), kth, -np.inf)
    np.maximum(floor, kth_of, out=floor)
    stays = (place - group < k) & ((place - start < k) | (score >= kth_of[query] - SLACK))
    return rows.filter(pa.array(stays))


def ranked(scored: DataFrame, k: int, tie: str = "id") -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Asked:
    """A block of stated queries as an inverted table: for each bucket that a query holds, the queries and their values there."""

    def __init__(self, block: pa.Table):
        ids, place = np.unique(np.asarray(block["query_id"].to_pylist(), dtype=object), return_inverse=True)
        bucket, value = block["bucket"].to_numpy(), block["value"].to_numpy()
        order = np.lexsort((place, bucket))
        self.ids, self.n = pa.array(ids.tolist(), block["query_id"].type), len(ids)
        self.query, self.value, bucket = place[order], value[order], bucket[order]
        self.buckets, self.first = np.unique(bucket, return_index=True)
        self.count = np.diff(self.first, append=len(bucket))

    def scores(self, row: np.ndarray, bucket: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        """rows x queries: inner products with sparse rows (row, bucket, value)."""
        at = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
        known = self.buckets[at] == bucket
        return self._scores(row[known], at[known], value[known], rows)

    def matrix(self) -> np.ndarray:
        """buckets x queries."""
        own = np.repeat(np.arange(len(self.buckets)), self.count) * self.n + self.query
        return np.bincount(own, self.value, len(self.buckets) * self.n).reshape(-1, self.n)

    def _scores(self, row: np.ndarray, at: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        times, width = self.count[at], len(self.buckets)
        entries = int(times.sum())
        if entries > rows * width and max(rows, self.n) * width <= STEP:  # dense rows or queries
            return np.bincount(row * width + at, value, rows * width).reshape(rows, width) @ self.matrix()
        if entries > 4 * STEP and rows > 1:
            half = rows // 2
            low = row < half
            return np.vstack([self._scores(row[low], at[low], value[low], half), self._scores(row[~low] - half, at[~low], value[~low], rows - half)])
        entry = np.arange(times.sum()) + np.repeat(self.first[at] - np.cumsum(times) + times, times)
        cell = np.repeat(row, times) * self.n + self.query[entry]
        return np.bincount(cell, np.repeat(value, times) * self.value[entry], rows * self.n).reshape(rows, self.n)


#: Scores within this of each other are told apart only after they are rounded.
SLACK = 1e-8


def best_rows(vectors: DataFrame, asked: Asked, k: int, at_least: float, allowed: np.ndarray | None = None) -> DataFrame:
    """query_id, name, value: of each task's rows (name, vector) the ``k`` best for each query, and ties.

    Every row is scored where it is read, against all queries of the block at once, so no pair is
    shuffled and only what may be among the best leaves a task. ``allowed`` (queries x cells) says
    which queries ask for the cell in a third column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.full(asked.n, at_least - SLACK)
        q_held, s_held, n_held = np.zeros(0, np.int64), np.zeros(0), pa.array([], pa.string())
        for batch in batches:
            lists, names = batch.column(1), batch.column(0)
            step = max(1, min(4096, (1 << 21) // max(asked.n, 1)))
            for k0 in range(0, len(batch), step):
                part = lists.slice(k0, step)
                flat, rows = part.flatten(), len(part)
                size = np.asarray(pc.fill_null(pc.list_value_length(part), 0))
                near = asked.scores(np.repeat(np.arange(rows), size), flat.field("bucket").to_numpy(zero_copy_only=False), flat.field("value").to_numpy(zero_copy_only=False), rows)
                fine = near >= floor
                if allowed is not None:
                    fine &= allowed[:, batch.column(2).slice(k0, step).to_numpy(zero_copy_only=False)].T
                r, q = np.nonzero(fine)
                q_held, s_held = np.append(q_held, q), np.append(s_held, near[r, q])
                n_held = pa.concat_arrays([n_held, names.slice(k0, step).take(pa.array(r))])
                order = np.lexsort((-s_held, q_held))
                q_held, s_held, n_held = q_held[order], s_held[order], n_held.take(pa.array(order))
                first = np.searchsorted(q_held, np.arange(asked.n))
                full = np.flatnonzero(np.diff(first, append=len(q_held)) >= k)
                floor[full] = np.maximum(floor[full], s_held[first[full] + k - 1] - SLACK)
                stays = s_held >= floor[q_held]
                q_held, s_held, n_held = q_held[stays], s_held[stays], n_held.filter(pa.array(stays))
        if len(q_held):
            yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(q_held)), n_held, pa.array(s_held)], names=["query_id", "name", "value"])

    kind = "long" if pa.types.is_integer(asked.ids.type) else "string"
    return vectors.mapInArrow(run, f"query_id {kind}, name string, value double")


def sparse_top_k(queries: DataFrame, vectors: DataFrame, k: int, at_least: float = 0.2, digits: int = 9) -> DataFrame:
    """V1 over sparse unit vectors: query_id, name, score, rank of the k best rows (name, vector) for each query (query_id, bucket, value).

    The query set is stated by the caller. Each block of ``SPARSE_LIMIT`` queries is sent to all tasks
    and takes one pass over the vectors; ties go to the lesser name.
    """
    parts = []
    for asked in asked_blocks(queries):
        scored = best_rows(vectors.select("name", "vector"), asked, k, at_least).select("query_id", "name", F.round("value", digits).alias("score"))
        parts.append(ranked(scored.where(F.col("score") >= at_least), k, "name"))
    return reduce(DataFrame.union, parts) if parts else no_hits(queries)


def no_hits(queries: DataFrame) -> DataFrame:
    return queries.limit(0).select("query_id", F.lit("").alias("name"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))


def asked_blocks(queries: DataFrame, at_most: int | None = None) -> Iterator[Asked]:
    """The stated queries (query_id, bucket, value) in blocks of about ``SPARSE_LIMIT``, each small enough for every task."""
    at_most = at_most or SPARSE_LIMIT
    rows = queries.select("query_id", F.col("bucket").cast("long").alias("bucket"), F.col("value").cast("double").alias("value"))
    blocks = max(1, -(-rows.select("query_id").distinct().count() // at_most))
    for b in range(blocks):
        block = (rows.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else rows).toArrow()
        if block.num_rows:
            yield Asked(block)


def unit(v: Column) -> Column:
    return F.transform(v, lambda x: x / F.sqrt(dot(v, v)))
