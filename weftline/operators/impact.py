"""V1 by an impact-ordered inverted index: lists of a bucket's rows by falling value, of which a query reads beginnings.

A row's place in a bucket's list is its level, the magnitude of its value there in quarter octaves.
A row that a query has not met in any list has at most the bound of the next unread level in each of
the query's buckets, and unit length in all; the largest inner product under both limits bounds its
score. So a query reads levels, those first that lower the bound most for the rows they hold, until
no unmet row can be among its best. Two rounds do: the first reads a few levels and scores what it
meets, which gives a score that the k-th best has at least; the second reads as far as that score
asks. Scores are those of whole vectors, so the rows are those of an exact search.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.access import staged
from weftline.operators.search import SLACK, Asked, asked_blocks, no_hits, ranked

LEVELS = 32
#: Rows of lists that the first round reads for each row wanted.
FIRST_READ = 8
#: The largest value of each level, and of nothing.
BOUNDS = np.append(2.0 ** (-np.arange(LEVELS) / 4), 0.0)


def level_of(value: Column) -> Column:
    return F.least(F.floor(-4 * F.log2(F.abs(value))), F.lit(LEVELS - 1)).cast("int")


def postings(vectors: DataFrame) -> DataFrame:
    """level, bucket, name of vectors (name, vector) of unit length; zeros have none."""
    entries = vectors.select("name", F.inline("vector")).where("value <> 0")
    return entries.select(F.greatest(level_of(F.col("value")), F.lit(0)).alias("level"), "bucket", "name")


def sizes(lists: DataFrame) -> DataFrame:
    """bucket, level, n: rows of each list's levels."""
    return lists.groupBy("bucket", "level").agg(F.count("*").alias("n"))


def most(q: np.ndarray, bound: np.ndarray) -> float:
    """The largest inner product of ``q`` with a vector of at most unit length and these entries at most."""
    if float(bound @ bound) <= 1:
        return float(q @ bound)
    order = np.argsort(bound / q)
    q, bound = q[order], bound[order]
    fixed = np.append(0.0, np.cumsum(bound**2))[:-1]  # squares of entries that are at their bound
    left = np.cumsum((q**2)[::-1])[::-1]
    scale = np.sqrt(np.maximum(1 - fixed, 0) / left)
    k = int(np.argmax(scale * q <= bound))  # from here on entries are in proportion to the query's
    return float(q[:k] @ bound[:k] + scale[k] * left[k])


def reading(q: np.ndarray, n: np.ndarray, read: np.ndarray, enough: float, rows: int | None = None) -> np.ndarray:
    """Levels to have read of each list (n: rows by level), from ``read`` on, until an unmet row's bound is below ``enough`` or ``rows`` are read."""
    lists = np.arange(len(q))
    # The first level at or after each that has rows; levels without any cost nothing.
    filled = np.where(np.pad(n, ((0, 0), (0, 2))) > 0, np.arange(LEVELS + 2), LEVELS)
    ahead = np.minimum.accumulate(filled[:, ::-1], axis=1)[:, ::-1]
    read, taken = ahead[lists, read], 0
    while most(q, BOUNDS[read]) >= enough and (rows is None or taken < rows):
        after = ahead[lists, read + 1]
        cost = np.maximum(n[lists, np.minimum(read, LEVELS - 1)], 1)
        gain = np.where(read < LEVELS, q * (BOUNDS[read] - BOUNDS[after]) / cost, 0)
        k = int(gain.argmax())
        if gain[k] <= 0:
            break
        taken += int(cost[k])
        read[k] = after[k]
    return read


@dataclass
class Lists:
    """``lists`` (level, bucket, name), which may hold rows that are no longer so; their ``sizes``; and the ``vectors`` (name, vector) in force."""

    lists: DataFrame
    sizes: DataFrame
    vectors: DataFrame

    def top_k(self, queries: DataFrame, k: int, at_least: float = 0.2, digits: int = 9) -> DataFrame:
        """query_id, name, score, rank: equal to ``search.sparse_top_k`` over the vectors."""
        parts = [self._block(asked, k, at_least, digits) for asked in asked_blocks(queries)]
        return ranked(reduce(DataFrame.union, parts), k, "name") if parts else no_hits(queries)

    def _block(self, asked: Asked, k: int, at_least: float, digits: int) -> DataFrame:
        found = staged(self._scored(asked, self.met(asked, k, at_least), at_least, digits), "near")
        kth = ranked(found, k, "name").where(F.col("rank") == k).select("query_id", "score").collect()  # a row for each query of the block
        more = self.met(asked, k, at_least, {r["query_id"]: r["score"] for r in kth})
        return found.unionByName(self._scored(asked, more, at_least, digits)).distinct()

    def met(self, asked: Asked, k: int, at_least: float, kth: dict | None = None) -> DataFrame:
        """query (its number), name: what the first round meets; with ``kth``, the scores that it found to be enough, what the second adds."""
        spark, buckets = self.lists.sparkSession, asked.buckets
        wanted = F.broadcast(spark.createDataFrame([(int(b),) for b in buckets], "bucket int"))
        n = np.zeros((len(buckets), LEVELS), dtype=np.int64)
        for r in self.sizes.join(wanted, "bucket").groupBy("bucket", "level").agg(F.sum("n").alias("n")).collect():  # 32 for each bucket of the block
            n[np.searchsorted(buckets, r["bucket"]), r["level"]] = r["n"]
        place = np.repeat(np.arange(len(buckets)), asked.count)
        enough = np.array([max(at_least, (kth or {}).get(i, at_least)) for i in asked.ids.to_pylist()])

        def run(batches):
            for batch in batches:
                out = []
                for q in batch.column(0).to_pylist():
                    at = np.flatnonzero((asked.query == q) & (asked.value != 0))
                    if not len(at):
                        continue
                    value, rows = np.abs(asked.value[at]), n[place[at]]
                    lo = np.zeros(len(at), dtype=np.int64)
                    hi = reading(value, rows, lo, at_least - SLACK, FIRST_READ * k)
                    if kth is not None:
                        lo, hi = hi, reading(value, rows, hi, enough[q] - SLACK)
                    levels = np.arange(LEVELS)
                    t, level = np.nonzero((levels >= lo[:, None]) & (levels < hi[:, None]) & (rows > 0))
                    out.append(pa.table({"query": np.full(len(t), q, np.int64), "bucket": buckets[place[at[t]]].astype(np.int32), "level": level.astype(np.int32)}))
                if out:
                    yield from pa.concat_tables(out).combine_chunks().to_batches()

        asks = spark.range(0, asked.n, 1, min(asked.n, 16)).mapInArrow(run, "query long, bucket int, level int").where("level >= 0")
        return self.lists.join(F.broadcast(asks), ["level", "bucket"]).select("query", "name").distinct()

    def _scored(self, asked: Asked, pairs: DataFrame, at_least: float, digits: int) -> DataFrame:
        """query_id, name, score of pairs (query, name), by whole vectors."""
        width = len(asked.buckets)
        key = asked.query * width + np.repeat(np.arange(width), asked.count)
        order = np.argsort(key)
        key, value = key[order], asked.value[order]

        def run(batches):
            for batch in batches:
                query, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
                flat, row = lists.flatten(), np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
                bucket, v = flat.field("bucket").to_numpy(zero_copy_only=False), flat.field("value").to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(asked.buckets, bucket), width - 1)
                own = query[row] * width + at
                to = np.minimum(np.searchsorted(key, own), len(key) - 1)
                fits = (asked.buckets[at] == bucket) & (key[to] == own)
                score = np.bincount(row[fits], v[fits] * value[to[fits]], len(lists))
                yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(query)), batch.column(1), pa.array(score)], names=["query_id", "name", "score"])

        kind = "long" if pa.types.is_integer(asked.ids.type) else "string"
        rows = pairs.join(self.vectors.select("name", "vector"), "name").select("query", "name", "vector").mapInArrow(run, f"query_id {kind}, name string, score double")
        return rows.withColumn("score", F.round("score", digits)).where(F.col("score") >= at_least)
