"""Best-fit packing by linear grouping.

Lengths above a share of the capacity are sorted, cut into groups of equal cardinality and rounded
up to their group's largest. Configurations (multisets of few sizes that fit one sequence) are
optimised by column generation over that covering problem. Then documents take the places of the
rounded sizes, and all lengths that remain are put, longest first, where the least room is left.

The plan is made from the histogram of lengths alone, which has at most ``capacity`` rows, and is a
list of runs "ranks lo..hi of length L go to sequences base.. at this offset". Documents get their
rank within a length by counts over salted buckets, so no length and no source meets in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.subwords import subwords
from weftline.llm.common import stash, texts, width

END_ID = 2
GROUPS = 96
#: Shares of the capacity above which lengths are grouped; the plan of fewest sequences is kept.
LARGE_SHARES = (1 / 4, 1 / 3)
#: Ranks within a length that are joined with the plan by one key.
STRETCH = 65_536
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int]]:
    """start, length and CRC of each piece; only the first of several may be short."""
    n = len(ids) // 4
    first = n if n <= capacity else n % capacity or capacity
    view, start = memoryview(ids), 0
    while start < n:
        length = first if start == 0 else capacity
        yield start, length, zlib.crc32(view[4 * start : 4 * (start + length)])
        start += length


def token_pieces(docs: DataFrame, capacity: int, vocabulary: str = "byte_bpe_50k.tiktoken", end_id: int = END_ID) -> DataFrame:
    """Pieces of every document's ids (null text: empty, so the end id alone)."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        encoder = subwords(vocabulary)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for piece, (start, length, crc) in enumerate(cut(encoder.encode(text.as_py()).astype("<u4").tobytes() + end, capacity)):
                    for column, value in zip(out, (doc_id, piece, start, length, crc), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return texts(docs).mapInArrow(run, PIECES)


def best_column(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of largest value that fits (unbounded knapsack, one more document in each round)."""
    rooms = np.arange(capacity + 1) - sizes[:, None]
    fits, rooms = rooms >= 0, np.maximum(rooms, 0)
    best, chosen = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        got = np.where(fits, values[:, None] + best[rooms], -1.0)
        k = got.argmax(axis=0)
        more = got[k, np.arange(capacity + 1)]
        better = more > best + 1e-12
        if not better.any():
            break
        chosen.append(np.where(better, k, -1))
        best = np.where(better, more, best)
    column, room = np.zeros(len(sizes)), capacity
    for picks in reversed(chosen):
        if picks[room] >= 0:
            column[picks[room]] += 1
            room -= int(sizes[picks[room]])
    return float(best[capacity]), column


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Column generation for: as few configurations as cover the demand. Returns the basis and its weights."""
    basis = np.diag([float(capacity // s) for s in sizes])
    inverse = np.linalg.inv(basis)
    x = inverse @ demand
    for _ in range(10 * len(sizes)):
        duals = np.ones(len(sizes)) @ inverse
        value, column = best_column(np.maximum(duals, 0), sizes, capacity)
        if value <= 1 + 1e-7:
            break
        step = inverse @ column
        ratios = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratios))
        if not np.isfinite(ratios[out]):
            break
        basis[:, out] = column
        inverse = np.linalg.inv(basis)
        x = np.maximum(inverse @ demand, 0)
    return [(basis[:, k], float(x[k])) for k in range(len(sizes))]


class Plan:
    """Runs of equal sequences, kept by the room that they have left."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left, self.taken, self.capacity = dict(counts), dict.fromkeys(counts, 0), capacity
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0

    def place(self, length: int, base: int, n: int, offset: int) -> None:
        lo = self.taken[length]
        self.rows.append((length, lo, lo + n, base, offset))
        self.taken[length] += n
        self.left[length] -= n

    def start(self, slots: list[int], n: int) -> None:
        """n sequences, each with one document of each of these lengths."""
        offset = 0
        for length in slots:
            self.place(length, self.sequences, n, offset)
            offset += length
        self.open[self.capacity - offset].append((self.sequences, n))
        self.sequences += n

    def best_fit(self, length: int) -> None:
        room = length
        while self.left[length] and room <= self.capacity:
            if not self.open[room]:
                room += 1
                continue
            base, n = self.open[room].pop()
            take = min(n, self.left[length])
            if take < n:
                self.open[room].append((base + take, n - take))
            self.place(length, base, take, self.capacity - room)
            self.open[room - length].append((base, take))
            room = length
        while self.left[length]:
            each = min(self.capacity // length, self.left[length])
            self.start([length] * each, self.left[length] // each)


def plan_sequences(counts: dict[int, int], capacity: int, groups: int = GROUPS, shares: tuple[float, ...] = LARGE_SHARES) -> Plan:
    """Where documents go, by length and rank within the length: the plan of fewest sequences among some bounds of "large"."""
    return min((grouped_plan(counts, capacity, groups, share) for share in shares), key=lambda p: p.sequences)


def rounded(counts: dict[int, int], large: list[int], groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and demand after linear grouping: ``large`` lengths, longest first, in groups of equal cardinality, each rounded up to its longest."""
    total = sum(counts[k] for k in large)
    each, sizes, demand, room = -(-total // min(groups, total)), [], [], 0
    for length in large:
        n = counts[length]
        while n:
            if not room:
                sizes.append(length)
                demand.append(0.0)
                room = each
            take = min(n, room)
            demand[-1] += take
            n, room = n - take, room - take
    # Groups that one length fills have one size.
    merged: dict[int, float] = {}
    for size, n in zip(sizes, demand, strict=True):
        merged[size] = merged.get(size, 0.0) + n
    return np.array(list(merged)), np.array(list(merged.values()))


def grouped_plan(counts: dict[int, int], capacity: int, groups: int, share: float) -> Plan:
    """Configurations of rounded sizes, filled with actual documents; then best fit for all that remain, longest first."""
    plan = Plan({k: v for k, v in counts.items() if v}, capacity)
    if plan.left.get(capacity):
        plan.start([capacity], plan.left[capacity])
    large = sorted((k for k, v in plan.left.items() if v and k > capacity * share), reverse=True)
    if large:
        sizes, demand = rounded(plan.left, large, groups)
        for column, weight in sorted(configurations(sizes, demand, capacity), key=lambda c: -c[1]):
            slots = [int(sizes[k]) for k in np.argsort(-sizes, kind="stable") for _ in range(int(round(column[k])))]
            n = int(weight + 1e-6)
            while n:
                chosen = substituted(plan.left, slots, capacity)
                if not chosen:
                    break
                m = min(n, *(plan.left[k] // chosen.count(k) for k in set(chosen)))
                plan.start(chosen, m)
                n -= m
    for length in sorted(plan.left, reverse=True):
        plan.best_fit(length)
    return plan


def substituted(left: dict[int, int], slots: list[int], capacity: int) -> list[int]:
    """Lengths of documents for the slots of a configuration: the longest that fits each, and for the last one the longest that fits the room left."""
    chosen: list[int] = []
    for k, slot in enumerate(slots):
        room = capacity - sum(chosen) if k == len(slots) - 1 else slot
        length = next((x for x in range(room, 0, -1) if left.get(x, 0) > chosen.count(x)), None)
        if length:
            chosen.append(length)
    return chosen


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds rank: 0, 1, ... within each length, from counts over salted buckets."""
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(4 * width(pieces.sparkSession))).cast("int")
    salted = pieces.withColumn("salt", salt)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    local = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return (
        salted.withColumn("at", F.row_number().over(local) - 1)
        .join(bases, ["length", "salt"])
        .withColumn("rank", F.col("base") + F.col("at"))
        .drop("salt", "base", "at")
    )


def pack(docs: DataFrame, capacity: int = 1024, vocabulary: str = "byte_bpe_50k.tiktoken", end_id: int = END_ID, groups: int = GROUPS) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.
    Null or empty text: the end id alone. Repeated rows are packed as often as they occur. Ties in
    length are ranked by salt, doc_id and piece. An empty table gives no row. Other columns of
    ``docs`` are not read.
    """
    spark = docs.sparkSession
    pieces = stash(token_pieces(docs, capacity, vocabulary, end_id), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    rows = plan_sequences(counts, capacity, groups).rows
    plan = spark.createDataFrame(rows or [(0, 0, 0, 0, 0)], "length long, lo long, hi long, first long, offset long")
    # Runs and pieces meet by length and by stretches of ranks, so that no length is one key.
    stretch = lambda rank: F.floor(rank / STRETCH)
    plan = plan.withColumn("stretch", F.explode(F.sequence(stretch(F.col("lo")), stretch(F.greatest(F.col("hi") - 1, F.col("lo"))))))
    if len(rows) + sum(counts.values()) // STRETCH <= 50_000:  # at most 48 bytes a row: 2.4 MB
        plan = F.broadcast(plan)
    here = (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    return (
        ranked(pieces).withColumn("stretch", stretch(F.col("rank"))).join(plan.withColumnRenamed("length", "size").withColumnRenamed("stretch", "of"), (F.col("length") == F.col("size")) & (F.col("stretch") == F.col("of")) & here)
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")
    )
