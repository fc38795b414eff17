"""Suffix-array dedup: bytes covered by long strings that also start elsewhere.

Every string of ``LENGTH`` bytes holds one gram of ``GRAM`` bytes that its content alone picks (the
least hash in it, leftmost), so equal strings meet in the group of an equal gram, their anchor.
Anchors with equal surroundings, told by a 128-bit BLAKE2 digest of the bytes, are done at once and
leave one of them to the rest. The anchors of a group are sorted by the suffix that starts at the
anchor and by the reversed text before it: a merge sort whose comparisons find the common extension
by binary search over prefix hashes, so each takes a logarithmic number of steps. The neighbours'
common extensions are verified byte by byte; they tell which anchors agree on x bytes before and
``LENGTH`` - x from the anchor on. Groups too large for a task are split by the bytes next to the
anchor, and the parts sorted.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import stash, texts
from weftline.llm.shingles import mix, prefix_hashes

LENGTH, GRAM = 400, 200
#: Anchors that are sorted together (some 3 MB); larger groups are split.
SORTED_GROUP = 5_000
_PLACE_BITS = np.uint64(32)


def anchors(hashes: np.ndarray, down: np.ndarray, size: int, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places of the grams that stand for a string of ``length`` bytes, and their hashes."""
    n = size - gram + 1
    own = mix((hashes[gram : size + 1] - hashes[:n]) * down[:n])
    key = ((own >> _PLACE_BITS) << _PLACE_BITS) | np.arange(n, dtype=np.uint64)
    width = length - gram + 1
    padded = np.concatenate([key, np.full(-n % width, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    at = np.unique(least & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    return at, own[at]


ANCHORS = "doc_id long, k long, at long, before int, after int, own long, d1 long, d2 long"


def anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, k, at, before, after, own, d1, d2: every anchor with the extent of its surroundings and their digest in two halves."""

    def run(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in range(8)]
            for doc_id, text, k in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                if len(raw) < length:
                    continue
                at, own = anchors(*prefix_hashes(raw), len(raw), length, gram)
                lo, hi = np.maximum(at - (length - gram), 0), np.minimum(at + length, len(raw))
                digests = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
                halves = np.frombuffer(digests, np.int64).reshape(-1, 2)
                for c, v, t in zip(columns, ([doc_id] * len(at), [k] * len(at), at, at - lo, hi - at, own.view(np.int64), *halves.T), kind, strict=True):
                    c.append(pa.array(v, t))
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=["doc_id", "k", "at", "before", "after", "own", "d1", "d2"])

    kind = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] * 3
    return docs.mapInArrow(run, ANCHORS)


class Suffixes:
    """Strings in one buffer, compared by hashes of their prefixes."""

    def __init__(self, strings: list[bytes]):
        self.data = b"".join(strings)
        self.limit = np.array([len(s) for s in strings], dtype=np.int64)
        self.start = np.cumsum(self.limit) - self.limit
        self.hashes, self.down = prefix_hashes(self.data)
        self.bytes = np.frombuffer(self.data, dtype=np.uint8)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of strings a and b, by binary search."""
        sa, sb = self.start[a], self.start[b]
        lo, hi = np.zeros(len(a), dtype=np.int64), np.minimum(self.limit[a], self.limit[b])
        while (open_ := lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = (self.hashes[sa + mid] - self.hashes[sa]) * self.down[sa] == (self.hashes[sb + mid] - self.hashes[sb]) * self.down[sb]
            lo, hi = np.where(open_ & same, mid, lo), np.where(open_ & ~same, mid - 1, hi)
        return lo

    def verified(self, a: np.ndarray, b: np.ndarray, found: np.ndarray) -> np.ndarray:
        """The same lengths, with any that rests on colliding hashes put right."""
        out = found.copy()
        for k, (x, y, n) in enumerate(zip(self.start[a].tolist(), self.start[b].tolist(), found.tolist(), strict=True)):
            if self.data[x : x + n] != self.data[y : y + n]:
                out[k] = int(np.flatnonzero(self.bytes[x : x + n] != self.bytes[y : y + n])[0])
        return out

    def less(self, a: np.ndarray, b: np.ndarray, group: np.ndarray, or_equal: bool) -> np.ndarray:
        out = group[a] < group[b]
        same = np.flatnonzero(group[a] == group[b])
        if len(same):
            x, y = a[same], b[same]
            n = self.extension(x, y)
            end_x, end_y = n == self.limit[x], n == self.limit[y]
            last = len(self.bytes) - 1
            byte_less = self.bytes[np.minimum(self.start[x] + n, last)] < self.bytes[np.minimum(self.start[y] + n, last)]
            out[same] = np.where(end_x, or_equal | ~end_y, ~end_y & byte_less)
        return out

    def order(self, group: np.ndarray) -> np.ndarray:
        """Merge sort by group and string; all merges of a round are done together."""
        n = len(self.limit)
        order, width = np.argsort(group, kind="stable"), 1
        while width < n:
            place = np.arange(n)
            block = place // (2 * width) * (2 * width)
            left = place < block + width
            lo = np.where(left, np.minimum(block + width, n), block)
            base, hi = lo.copy(), np.where(left, np.minimum(block + 2 * width, n), np.minimum(block + width, n))
            hi = np.maximum(hi, lo)
            while (live := np.flatnonzero(lo < hi)).size:
                mid = (lo[live] + hi[live]) // 2
                own, other = order[live], order[mid]
                ahead = np.empty(len(live), dtype=bool)  # other comes before own: of equals the left run's first
                for side, equal in ((left[live], False), (~left[live], True)):
                    ahead[side] = self.less(other[side], own[side], group, equal)
                lo[live], hi[live] = np.where(ahead, mid + 1, lo[live]), np.where(ahead, hi[live], mid)
            own_place = np.where(left, place - block, place - np.minimum(block + width, n))
            merged = np.empty(n, dtype=np.int64)
            merged[block + own_place + lo - base] = order
            order, width = merged, 2 * width
        return order

    def neighbours(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order, and each one's common extension with the one before it (-1 at the start of a group)."""
        order = self.order(group)
        near = np.full(len(order), -1, dtype=np.int64)
        inner = np.flatnonzero(group[order[1:]] == group[order[:-1]]) + 1
        a, b = order[inner - 1], order[inner]
        near[inner] = self.verified(a, b, self.extension(a, b))
        return order, near


def agreements(group: np.ndarray, before: list[bytes], after: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the most and the least x such that another of its group agrees on x bytes before and length - x after; -1 without any."""
    n = len(group)
    ranks, near = [], []
    for strings in (before, after):
        order, common = Suffixes(strings).neighbours(group)
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.arange(n)
        ranks.append(rank)
        near.append(common)
    most, least = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    for x in range(max(map(len, before), default=0), -1, -1):
        left, right = np.cumsum(near[0] < x)[ranks[0]], np.cumsum(near[1] < length - x)[ranks[1]]
        _, back, count = np.unique(left * np.int64(n + 1) + right, return_inverse=True, return_counts=True)
        met = count[back] > 1
        most = np.where(met & (most < 0), x, most)
        least = np.where(met, x, least)
    return most, least


def sorted_spans(rows: DataFrame, length: int) -> DataFrame:
    """Spans of anchors by sorting groups (``part``), several small ones at once."""

    def spans(held):
        columns = [sum((c[k] for c in held), []) for k in range(7)]
        part, doc_id, k, at, before, after, alone = columns
        group = np.unique(np.array(part, dtype=object), return_inverse=True)[1]
        most, least = agreements(group, before, after, length)
        use = (most >= 0) & np.array(alone)
        at = np.array(at)
        pick = lambda c: [c[i] for i in np.flatnonzero(use)]
        return pa.RecordBatch.from_arrays(
            [pa.array(pick(doc_id), pa.int64()), pa.array(pick(k), pa.int64()), pa.array((at - most)[use], pa.int64()), pa.array((at + length - least)[use], pa.int64())],
            names=["doc_id", "k", "start", "end"],
        )

    def run(batches):
        held, size = [], 0
        for batch in batches:
            part = batch.column(0).to_pylist()
            cuts = [0, *(i for i in range(1, len(part)) if part[i] != part[i - 1]), len(part)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b == a:
                    continue
                rows = [c.slice(a, b - a).to_pylist() for c in batch.columns]
                if size > 4000 and held[-1][0][-1] != rows[0][0]:
                    yield spans(held)
                    held, size = [], 0
                held.append(rows)
                size += b - a
        if held:
            yield spans(held)

    dealt = rows.repartition("part").sortWithinPartitions("part")
    return dealt.select("part", "doc_id", "k", "at", "left", "right", "alone").mapInArrow(run, "doc_id long, k long, start long, end long")


def counted(rows: DataFrame) -> DataFrame:
    """``rows`` with ``kinds``, the size of their ``part``; counts are combined before the shuffle, and written so that the join may split large parts."""
    return rows.join(stash(rows.groupBy("part").agg(F.count("*").alias("kinds")), "sizes"), "part")


def split_spans(rows: DataFrame, length: int, limit: int) -> DataFrame:
    """Spans of anchors (part, doc_id, k, at, left, right, alone, kinds) by sorting groups of up to ``limit``.

    Larger groups are split by the bytes next to their anchors. Two anchors that agree on x bytes
    before and ``length`` - x after, with x in lo..hi, agree on the lo bytes before and the
    ``length`` - hi after. So a group is dealt into the halves of its range of x, each by those bytes
    (a digest of them), until its parts are small. Members whose bytes are alike over all of a half
    (hi before, ``length`` - lo after) are settled by it and leave one of them to the rest.
    """
    out = [sorted_spans(rows.where(f"kinds <= {limit}"), length)]
    widest = rows.agg(F.max(F.length("left"))).first()[0] or 0
    large = rows.where(f"kinds > {limit}").withColumns({"lo": F.lit(0), "hi": F.lit(widest)})
    while not large.isEmpty():
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = large.withColumn("half", F.explode(F.array(F.struct("lo", mid.alias("hi")), F.struct((mid + 1).alias("lo"), "hi"))))
        halves = halves.withColumns({"lo": F.col("half.lo"), "hi": F.col("half.hi")}).where(f"lo <= hi AND length(left) >= lo AND length(right) >= {length} - hi")
        near = lambda a, b: F.concat(F.substring("left", F.lit(1), a), F.substring("right", F.lit(1), b))
        low = F.greatest("lo", length - F.length("right"))
        high = F.least("hi", F.length("left"))
        dealt = halves.withColumns({
            "part": F.sha2(F.concat(F.col("part").cast("binary"), F.concat_ws(",", F.lit(""), "lo", "hi", F.lit("")).cast("binary"), near(F.col("lo"), length - F.col("hi"))), 256),
            "low": low, "high": high, "bytes": F.sha2(near(high, length - low), 256),
        })
        dealt = stash(dealt.select("part", "doc_id", "k", "at", "left", "right", "alone", "lo", "hi", "low", "high", "bytes"), "halves")
        kind = ["part", "bytes", "low", "high"]
        first = F.struct("doc_id", "k", "at")
        kinds = stash(dealt.groupBy(*kind).agg(F.count("*").alias("same"), F.min(first).alias("first")), "kinds")
        met = dealt.join(kinds, kind)
        settled = met.where("same > 1 AND alone").select("doc_id", "k", (F.col("at") - F.col("high")).alias("start"), (F.col("at") + length - F.col("low")).alias("end"))
        rest = met.where(first.eqNullSafe(F.col("first"))).withColumn("alone", F.col("alone") & (F.col("same") == 1))
        rest = rest.dropDuplicates(["part", "doc_id", "k", "at"])  # a row that repeats comes twice
        rest = stash(rest, "parts")
        rest = stash(counted(rest.select("part", "doc_id", "k", "at", "left", "right", "alone", "lo", "hi")).where("kinds > 1"), "parts")
        out += [stash(settled, "settled"), sorted_spans(rest.where(f"kinds <= {limit}"), length)]
        large = rest.where(f"kinds > {limit}")
    return reduce(DataFrame.union, out)


def repeated_spans(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, k, start, end (bytes): spans covered by strings of ``length`` bytes that also start elsewhere; they overlap."""
    every = stash(anchor_rows(rows, length, gram), "anchors")
    crowd = stash(every.groupBy("own").count().where("count > 1").select("own"), "crowd")
    found = stash(every.join(crowd, "own"), "anchors")
    kind = ["own", "d1", "d2", "before", "after"]
    kinds = stash(found.groupBy(*kind).agg(F.count("*").alias("same"), F.min(F.struct("doc_id", "k", "at")).alias("first")), "kinds")
    twice = stash(kinds.where(f"same > 1 AND before + after >= {length}").select(*kind), "twice")
    done = found.join(twice, kind)
    done = done.select("doc_id", "k", (F.col("at") - F.col("before")).alias("start"), (F.col("at") + F.col("after")).alias("end"))

    # One anchor of each kind of surroundings, in groups that have some that occur once.
    groups = kinds.groupBy("own").agg(F.count("*").alias("kinds"), F.min("same").alias("least")).where("kinds > 1 AND least = 1")
    groups = stash(groups, "groups")
    wanted = kinds.join(groups, "own").select("first.doc_id", "first.k", F.struct("first.at", "before", "after", "own", (F.col("same") == 1).alias("alone"), "kinds").alias("place"))
    wanted = wanted.groupBy("doc_id", "k").agg(F.collect_list("place").alias("places"))

    def surroundings(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc_id, k, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                for p in places:
                    at = p["at"]
                    row = (str(p["own"]), doc_id, k, at, raw[at - p["before"] : at][::-1], raw[at : at + p["after"]], p["alone"], p["kinds"])
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["part", "doc_id", "k", "at", "left", "right", "alone", "kinds"])

    near = rows.alias("r").join(wanted.alias("w"), F.col("r.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("r.k") == F.col("w.k")))
    text = near.select("r.doc_id", "r.k", "r.text", "w.places").mapInArrow(surroundings, "part string, doc_id long, k long, at long, left binary, right binary, alone boolean, kinds long")
    return done.union(split_spans(stash(text, "surroundings"), length, SORTED_GROUP))


def as_text(kept: Column) -> Column:
    """Kept bytes as a string; what is left of characters that a span cut becomes U+FFFD."""
    return F.make_valid_utf8(kept.cast("string"))


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every row.

    Texts are UTF-8 bytes (null: empty). Each byte goes that lies in a string of ``length`` bytes
    which also starts at another place, be it in the same text; strings are judged on the input, so
    all copies lose it. Rows that repeat are each other's copies. Texts shorter than ``length`` stay
    whole. An empty table gives no row. Only doc_id and text are read.
    """
    rows = texts(docs).withColumn("k", F.xxhash64("text"))
    spans = repeated_spans(rows.select("doc_id", "text", "k"), length, gram)
    spans = spans.groupBy("doc_id", "k").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def cut(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw, kept, at, runs, removed = text.as_buffer().to_pybytes(), [], 0, 0, 0
                for start, end in merged(spans or []):
                    kept.append(raw[at:start])
                    at, runs, removed = end, runs + 1, removed + end - start
                kept.append(raw[at:])
                for c, v in zip(out, (len(raw), removed, runs, b"".join(kept)), strict=True):
                    c.append(v)
            kind = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, kind, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    both = rows.alias("r").join(spans.alias("s"), F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("r.k") == F.col("s.k")), "left")
    return both.select("r.doc_id", "r.text", "s.spans").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]
