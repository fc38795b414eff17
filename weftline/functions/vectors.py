"""Vector expressions: dot product, cosine, quantisation and the hashing embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import tokens


SPARSE = "array<struct<bucket: int, value: double>>"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """T17; null for a zero vector."""
    lengths = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(lengths > 0, dot(a, b) / lengths)


def quantised(v: Column) -> Column:
    """(low, high, bytes) with bytes 0..255 between the extremes, halves to even; a constant vector is all 0."""
    low, high = F.array_min(v).cast("double"), F.array_max(v).cast("double")
    scale = F.when(high > low, 255.0 / (high - low)).otherwise(0.0)
    return F.struct(low.alias("low"), high.alias("high"), F.transform(v, lambda x: F.rint((x.cast("double") - low) * scale).cast("int")).alias("bytes"))


def restored(q: Column) -> Column:
    """T18 back: floats from (low, high, bytes)."""
    return F.transform(q["bytes"], lambda b: b * (q["high"] - q["low"]) / 255.0 + q["low"])


def embedded(rows: DataFrame, key: str, text: str, dim: int = 1024) -> DataFrame:
    """Key, bucket, value: hashed counts of the lower-cased words, of length one, as sparse rows."""
    words = rows.select(key, F.explode(tokens(F.lower(text))).alias("t"))
    bucket = (F.conv(F.substring(F.md5("t"), 1, 8), 16, 10).cast("long") % dim).cast("int")
    counts = words.groupBy(key, bucket.alias("bucket")).agg(F.count("*").cast("double").alias("n"))
    return counts.select(key, "bucket", (F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))).alias("value"))


def hashed_vectors(rows: DataFrame, key: str, text: str, dim: int = 1024) -> DataFrame:
    """key, vector: ``gathered(embedded(...))`` where no two rows have one key: each text is counted where it lies, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for k in range(0, len(batch), 2048):
                some = batch.slice(k, 2048)
                lists = pc.split_pattern_regex(some.column(1).cast(pa.large_string()), r"[ \t\n\x0b\f\r]+")
                lists = pc.if_else(pc.is_null(lists), pa.scalar([], lists.type), lists)
                words, row = lists.flatten(), np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
                said = np.asarray(pc.not_equal(words, "").to_numpy(zero_copy_only=False), dtype=bool)
                coded = words.dictionary_encode()
                names = coded.dictionary.to_pylist()
                for w in names:
                    if w not in known:
                        known[w] = int(md5(w.encode()).hexdigest()[:8], 16) % dim
                own = np.array([known[w] for w in names], dtype=np.int64)
                cell, n = np.unique((row * dim + own[coded.indices.to_numpy()])[said] if len(names) else np.zeros(0, np.int64), return_counts=True)
                at, length = cell // dim, np.sqrt(np.bincount(cell // dim, n.astype(float) ** 2, len(some)))
                entries = pa.StructArray.from_arrays([pa.array((cell % dim).astype(np.int32)), pa.array(n / length[at])], names=["bucket", "value"])
                starts = np.searchsorted(at, np.arange(len(some) + 1)).astype(np.int32)
                out = pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(starts), entries)], names=[key, "vector"])
                yield out.filter(pa.array(np.diff(starts) > 0))
            if len(known) > 1_000_000:
                known.clear()

    kind = dict(rows.dtypes)[key]
    return rows.select(key, F.lower(text).alias("text")).mapInArrow(run, f"{key} {kind}, vector {SPARSE}")


def embedded_by(rows: DataFrame, key: str, text: str, embed: Callable[[list[str]], np.ndarray], dim: int, at_once: int = 32) -> DataFrame:
    """Key, embedding by any callable from a list of texts to as many vectors of ``dim`` numbers; null text counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            parts = []
            for k in range(0, len(texts), at_once):
                some = texts[k : k + at_once]
                got = np.asarray(embed(some), dtype=float)
                if got.shape != (len(some), dim):
                    raise ValueError(f"{len(some)} texts gave an array of shape {got.shape}, not vectors of {dim}")
                parts += got.tolist()
            yield pd.DataFrame({"key": batch["key"], "embedding": parts})

    kind = dict(rows.dtypes)[key]
    out = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, embedding array<double>")
    return out.withColumnRenamed("key", key)


def sparse_units(rows: DataFrame, key: str) -> DataFrame:
    """Dense vectors (embedding) as key, bucket, value of unit length, without zeros; a zero vector has no row."""
    length = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    each = rows.withColumn("length", length).where("length > 0").select(key, "length", F.posexplode("embedding").alias("bucket", "x"))
    return each.where("x <> 0").select(key, "bucket", (F.col("x") / F.col("length")).alias("value"))


def gathered(rows: DataFrame, key: str = "name") -> DataFrame:
    """key, vector: sparse rows (key, bucket, value) as one array of each key, by bucket."""
    entry = F.struct(F.col("bucket").cast("int").alias("bucket"), F.col("value").cast("double").alias("value"))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("vector"))


def sparse_array(v: Column) -> Column:
    """A dense vector as an array of (bucket, value) of unit length, without zeros; empty for a zero vector."""
    length = F.sqrt(dot(v, v))
    entries = F.transform(v, lambda x, i: F.struct(i.cast("int").alias("bucket"), (x.cast("double") / length).alias("value")))
    return F.when(length > 0, F.filter(entries, lambda e: e["value"] != 0)).otherwise(F.array().cast(SPARSE))
