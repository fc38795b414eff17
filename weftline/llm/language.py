"""Language identification by the nearest centroid.

A text becomes a normalised TF-IDF vector of hashed byte 1- to 3-grams. Each language has several
centroids, found by spherical k-means over labelled rows. The language of the centroid of highest
cosine wins; a text that is farther from it than nearly all labelled rows were is rejected.

Document frequencies count every labelled row. The k-means runs on the driver over a sample of at
most ``SAMPLE_ROWS`` distinct texts (``SAMPLE_EACH`` of a language, drawn by a hash of the text, and
one of each at least, so every language is learned however often its texts are repeated).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import texts

DIMENSIONS = 4096
CENTROIDS = 4
SAMPLE_EACH = 600
SAMPLE_ROWS = 4000
UNDETERMINED = "und"
#: A text is rejected below this share of the cosine that all but one in a thousand labelled rows reach.
REJECT_SHARE = 0.4

#: A-Z lowered, other ASCII a blank, bytes of longer characters as they are.
_FOLD = bytes(b if b > 127 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def gram_counts(raw: bytes) -> np.ndarray:
    """How often each hashed 1-, 2- and 3-gram occurs: A-Z lowered, other ASCII a blank, blanks not doubled."""
    b = np.frombuffer((b" " + raw + b" ").translate(_FOLD), np.uint8)
    other = b != 32
    keep = np.ones(len(b), dtype=bool)
    np.logical_or(other[1:], other[:-1], out=keep[1:])
    b = b[keep].astype(np.uint32)
    two = b[:-1] * np.uint32(257)
    two += b[1:]
    three = two[:-1] * np.uint32(257)
    three += b[2:]
    places = np.empty(len(b) + len(two) + len(three), np.int64)
    places[: len(b)] = b
    for at, code in ((len(b), two), (len(b) + len(two), three)):
        code *= np.uint32(2654435761)
        code >>= np.uint32(20)  # 12 bits are left: a place among DIMENSIONS
        places[at : at + len(code)] = code
    return np.bincount(places, minlength=DIMENSIONS)


def tf_rows(column: pa.Array) -> np.ndarray:
    return np.array([np.log1p(gram_counts(t.as_buffer().to_pybytes())) for t in column], dtype=np.float32).reshape(-1, DIMENSIONS)


def packed(counts: np.ndarray) -> bytes:
    """Counts as they are sent to the driver: some 2 KB for most texts."""
    return zlib.compress(counts.astype(np.uint32).tobytes(), 1)


def unpacked(sent: list[bytes]) -> np.ndarray:
    """The rows of ``tf_rows`` from what ``packed`` gives."""
    return np.array([np.log1p(np.frombuffer(zlib.decompress(x), np.uint32)) for x in sent], dtype=np.float32).reshape(-1, DIMENSIONS)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


@dataclass
class Centroids:
    """What was learned; a few hundred kilobytes."""

    languages: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    floor: float

    def nearest(self, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cosines = unit(tf * self.idf) @ self.centroids.T
        best = cosines.argmax(axis=1) if len(self.languages) else np.zeros(len(tf), dtype=int)
        return best, cosines[np.arange(len(tf)), best]


def clusters(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; seeds are the rows least like those taken before."""
    picked = [0]
    like = rows @ rows[0]
    while len(picked) < min(k, len(rows)):
        picked.append(int(like.argmin()))
        like = np.maximum(like, rows @ rows[picked[-1]])
    centres = rows[picked]
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(axis=1)
        centres = unit(np.array([rows[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))]))
    return centres


def labelled(docs: DataFrame) -> DataFrame:
    """Rows to learn from: text and lang known, and not of the fifth that is held out."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out())


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def fit(rows: DataFrame, centroids: int = CENTROIDS, sample_each: int = SAMPLE_EACH, sample_rows: int = SAMPLE_ROWS) -> Centroids:
    """Learn from the columns text and lang of ``rows``, which must hold neither nulls nor texts without letters."""
    rows = rows.select("text", F.col("lang").cast("string").alias("lang"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("n_texts")).orderBy("lang").collect()
    counts = {r["lang"]: r["n"] for r in found}
    if not counts:
        return Centroids([], np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), 0.0)

    def frequencies(batches):
        df = np.zeros(DIMENSIONS, dtype=np.int64)
        for batch in batches:
            for t in batch.column(0):
                df += gram_counts(t.as_buffer().to_pybytes()) > 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS)), pa.array(df)], names=["gram", "df"])

    df = np.zeros(DIMENSIONS)
    for r in rows.select("text").mapInArrow(frequencies, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df")).collect():
        df[r["gram"]] = r["df"]
    idf = (np.log((1 + sum(counts.values())) / (1 + df)) + 1).astype(np.float32)

    each = max(1, min(sample_each, sample_rows // len(counts)))
    # Twice what is taken and 50: fewer than are wanted come with no chance that matters, and few meet in a language's task.
    share = F.create_map(*[F.lit(x) for r in found for x in (r["lang"], min(1.0, (2 * each + 50) / max(r["n_texts"], 1)))])
    draw = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)

    def vectors(batches):
        for batch in batches:
            counts = [packed(gram_counts(t.as_buffer().to_pybytes())) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(counts, pa.binary()), batch.column(2)], names=["lang", "counts", "draw"])

    order = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "h"))
    some = rows.select("lang", "h", draw.alias("draw")).where(F.col("draw") < share[F.col("lang")]).distinct()
    first = some.withColumn("place", order).where(F.col("place") <= each).drop("place")
    drawn = rows.join(F.broadcast(first), ["lang", "h"]).groupBy("lang", "h", "draw").agg(F.min("text").alias("text"))
    sample = drawn.select("text", "lang", "draw").mapInArrow(vectors, "lang string, counts binary, draw double").collect()
    names, centres, own = [], [], []
    for lang in counts:
        picked = sorted((r["draw"], r["counts"]) for r in sample if r["lang"] == lang)
        if picked:
            x = unit(unpacked([counts for _, counts in picked]) * idf)
            c = clusters(x, centroids)
            names += [lang] * len(c)
            centres.append(c)
            own.append((x @ c.T).max(axis=1))
    floor = REJECT_SHARE * float(np.quantile(np.concatenate(own), 0.001)) if own else 0.0
    return Centroids(names, idf, np.concatenate(centres).astype(np.float32) if own else np.zeros((0, DIMENSIONS), np.float32), floor)


def judged(model: Centroids, text: pa.Array, letters: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, cosine and rejection of a batch of texts."""
    letters = letters & bool(model.languages)
    best, score = np.zeros(len(text), dtype=int), np.zeros(len(text))
    for at in range(0, len(text), 512):
        some = np.flatnonzero(letters[at : at + 512]) + at
        if len(some):
            best[some], score[some] = model.nearest(tf_rows(text.take(pa.array(some))))
    langs = [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letters, strict=True)]
    return langs, np.clip(score, 0.0, 1.0), ~letters | (score < model.floor)


def predict(docs: DataFrame, model: Centroids) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row.

    Null texts and texts without a letter: ``und``, score 0, rejected. A text below the model's
    floor keeps its nearest language but is marked rejected. Ties go to the centroid that comes
    first (languages in ascending order). Repeated rows are predicted each; an empty table gives no
    row; a model without languages gives ``und``. Only doc_id and text are read.
    """

    def run(batches):
        for batch in batches:
            langs, score, rejected = judged(model, batch.column(1), np.asarray(batch.column(2).to_pylist(), dtype=bool))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"]
            )

    read = texts(docs).withColumn("letters", F.col("text").rlike(r"\p{L}"))
    return read.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Centroids) -> DataFrame:
    """The rows of ``docs``, all columns, that ``predict`` would not mark as rejected.

    So rows with null text or without a letter go, repeated rows are judged each, and an empty table
    gives no row. Columns beyond text are passed through, whatever their names.
    """
    flag = next(name for name in (f"has_letters{'_' * k}" for k in range(len(docs.columns) + 1)) if name not in docs.columns)

    def run(batches):
        for batch in batches:
            letters = np.asarray(batch.column(batch.num_columns - 1).to_pylist(), dtype=bool)
            text = batch.column(batch.schema.get_field_index("text")).fill_null("")
            kept = batch.filter(pa.array(~judged(model, text, letters)[2]))
            yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=kept.schema.names[:-1])

    return docs.withColumn(flag, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled rows of ``docs`` and predict every row."""
    return predict(docs, fit(labelled(docs)))
