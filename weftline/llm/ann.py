"""Nearest neighbours by additive quantisation.

Every vector is coded as its nearest codeword of a first codebook plus a stored norm times a sum of
one codeword from each of many more, all full-dimensional, found by beam search over residuals. The
stored norm is that of the first residual, so vectors crowded round one point are told apart as
finely as others. A query's inner products with all codewords form lookup tables, by which all
codes are scored; the best are reranked with the original vectors in double precision. The index
holds codes and vectors together, so a task reranks what it has scored, bucket by bucket, and only a
query's best leave it.

Codebooks are fitted on the driver to at most ``SAMPLE`` vectors, those of least hash. Every vector
is indexed: equal vectors share one entry, which keeps their smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import stash, width

FIRST = 256
BOOKS = 40
WORDS = 32
BEAM = 4
SAMPLE = 8192
#: Entries that each query reranks, out of what the lookup tables put first.
RERANK = 256
#: Queries that are sent to all tasks for one pass over the index (4 MB of 64 doubles each), and those that a task scores at once.
QUERY_BLOCK, AT_ONCE = 8192, 1024
#: Entries of one bucket, the part of the index that a task holds at once (8 MB of 64 doubles), about.
ENTRIES_PER_TASK = 16_384
_SALTS = 16


@dataclass
class Codebooks:
    first: np.ndarray  # words x dimensions, float32
    words: np.ndarray  # books x words x dimensions, of unit residuals

    def residuals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First codeword, unit residual and its norm."""
        own = nearest(x, self.first)
        residual = x - self.first[own]
        norm = np.linalg.norm(residual, axis=1)
        return own.astype(np.uint8), residual / np.maximum(norm, 1e-30)[:, None], norm

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n x (1 + books)) and the norm by which each sum of later codewords counts."""
        own, residual, norm = self.residuals(x)
        codes = beam_search(residual, self.words, beam)
        near = np.linalg.norm(decode(codes, self.words), axis=1)
        return np.column_stack([own, codes]), norm / np.maximum(near, 1e-30)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(-1) - 2 * x @ c.T).argmin(axis=1)


def decode(codes: np.ndarray, words: np.ndarray) -> np.ndarray:
    return reduce(np.add, (c[codes[:, m]] for m, c in enumerate(words)))


def beam_search(x: np.ndarray, books: np.ndarray, beam: int) -> np.ndarray:
    """Codes of the sums of codewords nearest to ``x``; each step keeps the best few partial sums."""
    n = len(x)
    residual, codes = x[:, None, :], np.zeros((n, 1, len(books)), dtype=np.uint8)
    rows = np.arange(n)[:, None]
    for m, c in enumerate(books):
        far = (residual**2).sum(-1)[:, :, None] - 2 * residual @ c.T + (c**2).sum(-1)
        flat = far.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        parent, word = best // len(c), best % len(c)
        codes, residual = codes[rows, parent], residual[rows, parent] - c[word]
        codes[:, :, m] = word
    return codes[np.arange(n), (residual**2).sum(-1).argmin(axis=1)]


def k_means(x: np.ndarray, words: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), words, replace=False)]
    for _ in range(rounds):
        own, total = nearest(x, c), np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.bincount(own, minlength=words)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return c


def fit(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, first: int = FIRST, rounds: int = 2) -> Codebooks:
    """Residual k-means, then rounds of beam-search coding and least squares over all later codebooks at once."""
    rng = np.random.default_rng(7)
    sample = sample.astype(np.float32)
    words = min(words, len(sample))
    model = Codebooks(k_means(sample, min(first, -(-len(sample) // 16)), rng), np.zeros((books, words, sample.shape[1]), np.float32))
    unit = model.residuals(sample)[1]
    residual = unit
    for m in range(books):
        c = k_means(residual, words, rng)
        residual = residual - c[nearest(residual, c)]
        model.words[m] = c
    for _ in range(rounds if len(sample) > 4 * words else 0):
        codes = np.concatenate([beam_search(unit[k : k + 1024], model.words, BEAM) for k in range(0, len(unit), 1024)])
        at = codes.astype(np.int64) + np.arange(books) * words
        gram, moment = np.zeros((books * words, books * words)), np.zeros((books * words, sample.shape[1]))
        for m in range(books):
            np.add.at(gram, (at[:, m : m + 1], at), 1.0)
            np.add.at(moment, at[:, m], unit)
        # The ridge pulls towards the present codewords, so a codeword that no row uses stays.
        old = model.words.reshape(books * words, -1).astype(float)
        solved = np.linalg.solve(gram + np.eye(len(gram)), moment + old)
        model.words = solved.reshape(model.words.shape).astype(np.float32)
    return model


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, vector (doubles): rows with an id and a finite vector that is not zero, of the commonest length."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & fine)
    length = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vector") == (length["d"] if length else 0)).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def entries(rows: DataFrame, keep: int) -> DataFrame:
    """entry (smallest id of equal vectors), vector, vec_id: each entry with its ``keep`` smallest ids.

    Ids are cut within salts first, so no vector that very many rows share meets in one task.
    """
    salted = Window.partitionBy("vector", "salt").orderBy("vec_id")
    some = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(_SALTS))).withColumn("n", F.row_number().over(salted)).where(F.col("n") <= keep)
    whole = Window.partitionBy("vector").orderBy("vec_id")
    return some.withColumn("n", F.row_number().over(whole)).where(F.col("n") <= keep).withColumn("entry", F.first("vec_id").over(whole)).select("entry", "vec_id", "vector")


def coded(heads: DataFrame, model: Codebooks, tasks: int) -> DataFrame:
    """bucket, entry, codes, norm, vector: the index, dealt by hash to so many tasks, each of which makes a bucket.

    The bucket stays with the entries: files that are read together by one task are still reranked
    bucket by bucket, and a bucket's share of candidates does not depend on how files are packed.
    """

    def run(batches):
        for batch in batches:
            out, norms = [], []
            x = matrix(batch.column(1)).astype(np.float32)
            for k in range(0, len(x), 1024):
                codes, norm = model.encode(x[k : k + 1024])
                norms += norm.tolist()
                out += [c.tobytes() for c in codes]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(out, pa.binary()), pa.array(norms, pa.float32()), batch.column(1)], names=["bucket", "entry", "codes", "norm", "vector"])

    dealt = heads.select("entry", "vector").repartition(tasks, "entry").withColumn("bucket", F.spark_partition_id())
    return dealt.mapInArrow(run, "bucket int, entry long, codes binary, norm float, vector array<double>")


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length from an array of lists without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def from_each(rerank: int, buckets: int) -> int:
    """Entries of a bucket that are reranked for a query: its part of ``rerank``, as entries are dealt by hash, and six deviations more."""
    part = rerank / buckets
    return min(rerank, int(np.ceil(part + 6 * np.sqrt(part))))


def by_bucket(batches) -> Iterator[tuple[np.ndarray, ...]]:
    """entry, codes, norm and vectors of one bucket after the other; only one is held."""

    def whole(parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        return np.asarray(t[1]), np.frombuffer(b"".join(t[2].to_pylist()), np.uint8).reshape(len(t), -1), np.asarray(t[3]), matrix(t[4].combine_chunks())

    bucket, held = None, []
    for batch in batches:
        own = np.asarray(batch.column(0))
        ends = np.append(np.flatnonzero(own[1:] != own[:-1]) + 1, len(own))
        for start, end in zip(np.append(0, ends[:-1]), ends, strict=True):
            if start == end:
                continue
            if own[start] != bucket and held:
                yield whole(held)
                held = []
            bucket = own[start]
            held.append(batch.slice(start, end - start))
    if held:
        yield whole(held)


def scored(index: DataFrame, queries: np.ndarray, ids: np.ndarray, model: Codebooks, buckets: int, rerank: int, k: int) -> DataFrame:
    """query_id, entry, score: for each query and bucket the ``k`` best entries of those that the lookup tables put first."""
    shared = index.sparkSession.sparkContext.broadcast((ids, queries, model.first, model.words))
    first_few = from_each(rerank, buckets)

    def run(batches):
        for entry, codes, norm, vectors in by_bucket(batches):
            yield from best_of(entry, codes, norm, vectors)

    def best_of(entry, codes, norm, vectors):
        every, all_queries, first, words = shared.value
        for at in range(0, len(every), AT_ONCE):
            own, q = every[at : at + AT_ONCE], all_queries[at : at + AT_ONCE]
            few = shortlist(codes, norm, first, words, q.astype(np.float32), first_few)
            for k0 in range(0, len(q), 64):
                near = np.einsum("qd,qnd->qn", q[k0 : k0 + 64], vectors[few[k0 : k0 + 64]])
                best = np.lexsort((entry[few[k0 : k0 + 64]], -near), axis=1)[:, :k]
                found, score = np.take_along_axis(few[k0 : k0 + 64], best, 1), np.take_along_axis(near, best, 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own[k0 : k0 + 64], best.shape[1])), pa.array(entry[found].ravel()), pa.array(score.ravel())], names=["query_id", "entry", "score"])

    return index.mapInArrow(run, "query_id long, entry long, score double")


def shortlist(codes: np.ndarray, norm: np.ndarray, first: np.ndarray, words: np.ndarray, q: np.ndarray, keep: int) -> np.ndarray:
    """Rows of ``codes`` that the lookup tables put first for each query (queries x at most ``keep``)."""
    coarse, tables = first @ q.T, [c @ q.T for c in words]  # words x queries
    best, held = np.zeros((len(q), 0), dtype=np.float32), np.zeros((len(q), 0), dtype=np.int64)
    for k in range(0, len(codes), 2048):
        some = codes[k : k + 2048]
        near = tables[0][some[:, 1]]
        for m in range(1, len(tables)):
            near += tables[m][some[:, m + 1]]
        near *= norm[k : k + 2048, None]
        near += coarse[some[:, 0]]
        best = np.concatenate([best, near.T], axis=1)
        held = np.concatenate([held, np.broadcast_to(np.arange(k, k + len(some)), (len(q), len(some)))], axis=1)
        if best.shape[1] > keep:
            at = np.argpartition(-best, keep - 1, axis=1)[:, :keep]
            best, held = np.take_along_axis(best, at, 1), np.take_along_axis(held, at, 1)
    return held


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def search(vectors: DataFrame, is_query: Column, k: int = 20, rerank: int = RERANK, books: int = BOOKS, words: int = WORDS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest rows by inner product, itself left out.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on vec_id. Rows without id or
    whose vector is null, empty, zero or holds null or non-finite components take no part, nor do
    vectors of another length than the commonest; of rows with one id the least vector counts. Equal
    vectors are found together, ties go to the smaller id. With fewer candidates all are returned,
    and an empty table gives no row. Columns beyond the two are not read.
    """
    spark = vectors.sparkSession
    rows = stash(entries(usable(vectors), k + 1), "entries")
    heads = rows.where(F.col("entry") == F.col("vec_id"))
    n = heads.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Those of least hash, thinned before they are sorted.
    draw = F.pmod(F.xxhash64("entry"), F.lit(1 << 30))
    drawn = heads.select("entry", "vector", draw.alias("draw")).where(F.col("draw") < min(1.0, 1.2 * SAMPLE / n + 1e-3) * (1 << 30)).orderBy("draw", "entry").limit(SAMPLE)
    sample = matrix((drawn.select("vector") if n > SAMPLE else heads.select("vector").orderBy("entry")).toArrow().column(0).combine_chunks())
    model = fit(sample, books, words)
    index = stash(coded(heads, model, max(width(spark), -(-n // ENTRIES_PER_TASK))), "index")
    buckets = index.agg(F.count_distinct("bucket")).first()[0]

    asked = stash(usable(vectors).where(is_query), "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "entry")
    passes = []
    for b in range(blocks):
        some = asked.where(block == b).select("vec_id", "vector").toArrow()  # about QUERY_BLOCK rows
        if some.num_rows:
            found = scored(index, matrix(some.column(1).combine_chunks()), some.column(0).to_numpy(), model, buckets, rerank, k + 2)
            best = found.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 2)
            passes.append(stash(best.select("query_id", "entry"), "near"))
    if not passes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    few = reduce(DataFrame.union, passes)

    score = dot(F.col("q"), F.col("vector")).alias("score")
    exact = few.join(heads.select("entry", "vector"), "entry").join(asked.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("q")), "query_id").select("query_id", "entry", score)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        exact.join(rows.select("entry", "vec_id"), "entry")
        .where(F.col("vec_id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
