"""Line dedup: range-partitioned line hashes, streamed in order, give keep bitmaps of documents.

Each line's key (blanks stripped, A-Z lower-cased) is hashed to 128 bits. The rows (hash, document,
position) are partitioned by ranges of all of these columns and sorted within, so a line that very
many documents hold is spread over several tasks in its documents' order. A task streams its rows
and knows, of every key that begins in it, the first document; what follows in other documents
goes. Of the one key that may have begun in a task before, the rows of the task's first document wait
until the tasks' first and last keys, one row each, are put together.

The result is a compressed bitmap of lines to keep for each document. Texts are read only by
``kept``, where the bitmaps are applied.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import stash, texts, width

#: Code points of the shortest key that is compared between documents.
SHORTEST = 10
#: Bytes of text that leave a task at once.
AT_ONCE = 8 << 20

# Fixed value: what is stripped from both ends of a line.
_BLANKS = b" \t\n\x0b\x0c\r"
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_LOW64 = (1 << 64) - 1

HASHED = "hi long, lo long, doc_id long, tag long, position int"


def with_tag(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``tag``, which tells different texts of one doc_id apart."""
    return texts(docs).withColumn("tag", F.xxhash64("text"))


def keys(raw: bytes, shortest: int) -> list[tuple[int, bytes]]:
    """Positions and keys of the lines that are long enough."""
    out = []
    for k, line in enumerate(raw.translate(_LOWER).split(b"\n")):
        key = line.strip(_BLANKS)
        # A code point has four bytes at most.
        if len(key) >= 4 * shortest or (len(key) >= shortest and len(key.decode(errors="replace")) >= shortest):
            out.append((k, key))
    return out


def hashed(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """hi, lo, doc_id, tag, position of every line that is compared; rows without doc_id have none."""

    def run(batches):
        for batch in batches:
            ids, tags, texts_ = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1)
            for k0 in range(0, len(ids), 256):
                own, tag, at, hashes = [], [], [], []
                for doc_id, t, text in zip(ids[k0 : k0 + 256], tags[k0 : k0 + 256], texts_[k0 : k0 + 256], strict=True):
                    found = keys(text.as_buffer().to_pybytes(), shortest)
                    hashes += [xxhash.xxh3_128_digest(key) for _, key in found]
                    at += [k for k, _ in found]
                    own += [doc_id] * len(found)
                    tag += [t] * len(found)
                both = np.frombuffer(b"".join(hashes), dtype=">i8").astype(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(own, pa.int64()), pa.array(tag, pa.int64()), pa.array(at, pa.int32())],
                    names=["hi", "lo", "doc_id", "tag", "position"],
                )

    return with_tag(docs).where("doc_id IS NOT NULL").mapInArrow(run, HASHED)


#: What a task says: lines that go (kind 0), lines of its first key and document, which wait (1), and
#: its first key with its first document (2), and its last key with that key's first document here (3).
STREAMED = "kind int, task int, hi long, lo long, doc_id long, tag long, position int"


def streamed(rows: DataFrame) -> DataFrame:
    """One pass over each range in order. Only the columns of one batch, and of the state before it, are held."""
    names = [c.split(" ")[0] for c in STREAMED.split(", ")]

    def said(kind, task, *columns):
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, task, np.int32)), *(pa.array(c) for c in columns)], names=names)

    def run(batches):
        opening = key = first = task = None  # the task's first key and document; the present key and its first document
        for batch in batches:
            if not len(batch):
                continue
            hi, lo, doc, tag, at = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            task = batch.column(5)[0].as_py()
            new = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
            firsts = doc[new]
            if key == (hi[0], lo[0]):
                firsts = firsts.copy()
                firsts[0] = first
            if opening is None:
                opening = (hi[0], lo[0], doc[0])
                yield said(2, task, hi[:1], lo[:1], doc[:1], tag[:1], at[:1])
            held = np.repeat(firsts, np.diff(new, append=len(doc)))
            waits = (hi == opening[0]) & (lo == opening[1]) & (doc == opening[2])
            for kind, which in ((0, doc != held), (1, waits)):
                if which.any():
                    yield said(kind, task, *(c[which] for c in (hi, lo, doc, tag, at)))
            key, first = (hi[-1], lo[-1]), firsts[-1]
        if key is not None:
            yield said(3, task, *(np.array([v], dtype=np.int64) for v in (*key, first, 0)), np.zeros(1, dtype=np.int32))

    return rows.withColumn("task", F.spark_partition_id()).mapInArrow(run, STREAMED)


def continued(ends: list) -> list[int]:
    """Tasks whose first key has an earlier document in a task before. ``ends`` has two rows for each task."""
    edges: dict[int, dict[int, tuple]] = {}
    for r in ends:
        edges.setdefault(r["task"], {})[r["kind"]] = (r["hi"], r["lo"], r["doc_id"])
    out, key, first = [], None, None
    for task in sorted(edges):
        opening, closing = edges[task][2], edges[task][3]
        known = key == opening[:2]
        if known and first < opening[2]:
            out.append(task)
        # A key that goes on through a whole task keeps the document in which it began.
        if not (known and closing[:2] == key):
            key, first = closing[:2], closing[2]
    return out


def dropped(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, tag, position of the lines whose key an earlier document has."""
    rows = stash(hashed(docs, shortest), "lines")
    order = ("hi", "lo", "doc_id", "tag", "position")
    tasks = max(width(docs.sparkSession), 1)
    said = stash(streamed(rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)), "streamed")
    late = continued(said.where("kind >= 2").select("kind", "task", "hi", "lo", "doc_id").collect())  # two rows for each task
    waiting = F.col("kind") == 1
    some = F.col("task").isin(late) if late else F.lit(False)
    return said.where((F.col("kind") == 0) | (waiting & some)).select("doc_id", "tag", "position")


BITMAPS = "doc_id long, tag long, n_lines long, n_dropped long, keep binary"


def bitmaps(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, tag, n_lines, n_dropped, keep for every document: the zlib-packed bits of its lines, 1 for those that stay.

    Lines are split at line feeds; null and empty texts are one empty line. Keys of ``shortest`` code
    points or more that at least two doc_ids hold stay in the least of these alone, there as often
    as they occur. Rows of one doc_id are one document: different texts of it have a bitmap each,
    told apart by ``tag``, equal rows share one. Rows without doc_id have none. An empty table gives
    no row. Only doc_id and text are read.
    """
    size = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    every = with_tag(docs).where("doc_id IS NOT NULL").select("doc_id", "tag", size.alias("n_lines"), F.lit(None).cast("int").alias("position"))
    gone = dropped(docs, shortest).select("doc_id", "tag", F.lit(0).cast("long").alias("n_lines"), "position")
    own = every.union(gone).groupBy("doc_id", "tag").agg(F.max("n_lines").alias("n_lines"), F.collect_set("position").alias("gone"))

    def pack(batches):
        for batch in batches:
            counts, bits = [], []
            for n, gone in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                keep, at = np.ones(n, dtype=bool), gone.values.to_numpy()
                keep[at] = False
                counts.append(len(at))
                bits.append(zlib.compress(np.packbits(keep).tobytes()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(counts, pa.int64()), pa.array(bits, pa.binary())], names=["doc_id", "tag", "n_lines", "n_dropped", "keep"])

    return own.mapInArrow(pack, BITMAPS)


def kept(docs: DataFrame, maps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, text: every row's lines that its bitmap keeps; without a bitmap all."""
    met = with_tag(docs).join(maps, ["doc_id", "tag"], "left").select("doc_id", "text", "n_lines", "n_dropped", "keep")

    def run(batches):
        for batch in batches:
            start, out, held = 0, [], 0
            for k, (text, n, gone, keep) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True)):
                raw = text.as_buffer().to_pybytes()
                if n is None:
                    n, gone = raw.count(b"\n") + 1, 0
                elif gone:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep.as_py()), np.uint8), count=n).tolist()
                    raw = b"\n".join([line for line, stays in zip(raw.split(b"\n"), bits, strict=True) if stays])
                out.append((n, gone, raw))
                held += len(raw)
                if held > AT_ONCE:
                    yield rows(batch, start, out)
                    start, out, held = k + 1, [], 0
            if out:
                yield rows(batch, start, out)

    def rows(batch, start, out):
        n, gone, raw = (list(c) for c in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([batch.column(0)[start : start + len(out)], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(raw, pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "text"])

    return met.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, text string")


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS position FROM documents),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
held AS (SELECT k, min(doc_id) AS least FROM keyed WHERE length(k) >= 10 GROUP BY k),
marked AS (SELECT doc_id, position, line, coalesce(least < doc_id, false) AS gone FROM keyed LEFT JOIN held USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
