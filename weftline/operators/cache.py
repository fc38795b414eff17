"""Response caches: exact by key, semantic by likeness to a stored question."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.vectors import cosine, quantised, restored
from weftline.operators.merge import replace_rows
from weftline.operators.search import in_blocks


def exact_hits(questions: DataFrame, cache: DataFrame) -> DataFrame:
    """H1: response by (mode, args_hash), null for a miss."""
    return questions.join(cache.select("mode", "args_hash", "response"), ["mode", "args_hash"], "left")


#: Cosines within this of the limit, or of the best, are told apart by the exact expression.
SLACK = 1e-9


def semantic_hits(questions: DataFrame, cache: DataFrame, above: float = 0.95) -> DataFrame:
    """H2: query_id, response, score: the most like entry of the mode, if its cosine is above the limit.

    Questions are a stated query set: each block of them is sent to all tasks and takes a pass over
    the cache, whose entries are scored where they are read. What leaves a task is the entries that
    may be the best for a question, and few of these pairs are scored by the exact expression.
    Vectors with a null or with other than finite numbers hit nothing. Of equal scores the greatest args_hash counts.
    """
    parts = []
    rows = questions.select("query_id", "mode", F.transform("query", lambda x: x.cast("double")).alias("query"))
    for few in in_blocks(rows, "query_id"):
        near = near_entries(cache, few.toArrow(), above, dict(rows.dtypes)["query_id"])
        scored = near.select("query_id", "args_hash", "response", cosine(F.col("query"), restored(F.col("quantised"))).alias("score")).where((F.col("score") > above) & ~F.isnan("score"))
        best = scored.groupBy("query_id").agg(F.max_by(F.struct("response", "score"), F.struct("score", "args_hash")).alias("hit"))
        parts.append(best.select("query_id", "hit.*"))
    return reduce(DataFrame.union, parts)


def units(flat: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, and which of them have a direction: no null (NaN), infinite or zero vector."""
    v = flat.reshape(rows, -1)
    with np.errstate(all="ignore"):
        length = np.linalg.norm(v, axis=1)
        fine = np.isfinite(v).all(axis=1) & np.isfinite(length) & (length > 0)
        return np.where(fine[:, None], v / length[:, None], 0.0), fine


def near_entries(cache: DataFrame, asked: pa.Table, above: float, kind: str) -> DataFrame:
    """query_id, query, args_hash, response, quantised: of each task's entries those that may be the best of a question of a block."""
    sizes = pc.list_value_length(asked["query"]).combine_chunks()
    blocks: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
    for mode, size in {(m, n) for m, n in zip(asked["mode"].to_pylist(), sizes.to_pylist(), strict=True) if m is not None and n}:
        at = np.flatnonzero(np.asarray(pc.and_(pc.equal(asked["mode"], mode), pc.equal(sizes, size)).fill_null(False)))
        v, fine = units(pc.list_flatten(asked["query"].take(pa.array(at))).to_numpy(), len(at))
        if fine.any():
            blocks[mode, size] = at[fine], v[fine]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.full(len(asked), above - SLACK)
        place, score, held = np.zeros(0, np.int64), np.zeros(0), None
        for batch in batches:
            q, size = batch.column(3), np.asarray(pc.fill_null(pc.list_value_length(pc.struct_field(batch.column(3), "bytes")), 0))
            modes = np.asarray(batch.column(0).to_pylist(), dtype=object)
            for (mode, n), (at, asks) in blocks.items():
                mine = np.flatnonzero((modes == mode) & (size == n))
                step = max(1, (1 << 21) // len(at))
                for k in range(0, len(mine), step):
                    part = q.take(pa.array(mine[k : k + step]))
                    low, high = (pc.struct_field(part, c).to_numpy(zero_copy_only=False)[:, None] for c in ("low", "high"))
                    v = pc.list_flatten(pc.struct_field(part, "bytes")).to_numpy(zero_copy_only=False).reshape(len(part), n) * (high - low) / 255.0 + low
                    v, fine = units(v, len(part))
                    near = asks @ v.T
                    near[:, ~fine] = -2
                    floor[at] = np.maximum(floor[at], near.max(axis=1) - SLACK)
                    i, j = np.nonzero(near >= floor[at][:, None])
                    if not len(i):
                        continue
                    # Of entries with one vector, which all score alike, that of the greatest args_hash stays.
                    names = batch.column(1).take(pa.array(mine[k : k + step]))
                    rank = np.argsort(np.argsort(np.array([(x or "").encode() for x in names.to_pylist()], dtype=object), kind="stable"))
                    _, same = np.unique(v, axis=0, return_inverse=True)
                    order = np.lexsort((-rank[j], same.ravel()[j], i))
                    i, j = i[order], j[order]
                    first = np.append(True, (i[1:] != i[:-1]) | (same.ravel()[j][1:] != same.ravel()[j][:-1]))
                    i, j = i[first], j[first]
                    rows = pa.Table.from_batches([batch]).take(pa.array(mine[k + j]))
                    place, score = np.append(place, at[i]), np.append(score, near[i, j])
                    held = rows if held is None else pa.concat_tables([held, rows])
                    stays = score >= floor[place]
                    place, score, held = place[stays], score[stays], held.filter(pa.array(stays))
        if held is not None and len(held):
            some = asked.take(pa.array(place))
            yield from pa.table({"query_id": some["query_id"], "query": some["query"], "args_hash": held["args_hash"], "response": held["response"], "quantised": held["quantised"]}).combine_chunks().to_batches(4096)

    rows = cache.select("mode", "args_hash", "response", "quantised")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"query_id {kind}, query array<double>, args_hash {kinds['args_hash']}, response {kinds['response']}, quantised {kinds['quantised']}")


def written(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """H3: the cache with entries (mode, args_hash, response, embedding), vectors quantised."""
    return replace_rows(cache, entries.select("mode", "args_hash", "response", quantised(F.col("embedding")).alias("quantised")), "mode", "args_hash")
