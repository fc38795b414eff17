"""Chunking and splitting: functions from a text to an array of pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import hash_id, strip, tokens


def windows(docs: DataFrame, key: str, text: str, size: int = 1200, overlap: int = 100) -> DataFrame:
    """K1: chunk_id, full_doc_id, chunk_order_index, tokens, content: windows of ``size`` words, each ``size - overlap`` on.

    The last window may lie wholly in the one before; a text without words gives none.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    words = docs.select(F.col(key).alias("full_doc_id"), tokens(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(step))
    parts = words.select("full_doc_id", F.posexplode(F.transform(starts, lambda s: F.slice("w", s + 1, size))).alias("chunk_order_index", "part"))
    content = strip(F.array_join("part", " "))
    return parts.select(hash_id(content, "chunk-").alias("chunk_id"), "full_doc_id", "chunk_order_index", F.size("part").alias("tokens"), content.alias("content"))


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """K5: one row for each chunk_id, that of the last document and place."""
    rest = [c for c in chunks.columns if c != "chunk_id"]
    last = F.max_by(F.struct(*rest), F.struct("full_doc_id", "chunk_order_index"))
    return chunks.groupBy("chunk_id").agg(last.alias("row")).select("chunk_id", "row.*")


def paragraphs(text: Column, least: int = 100) -> Column:
    """K2: paragraphs between blank lines, joined until a piece with its separator has ``least`` characters."""
    state = F.struct(F.lit("").alias("held"), F.array().cast("array<string>").alias("out"))

    def step(acc, part):
        held = F.concat(acc["held"], strip(part), F.lit("\n\n"))
        full = F.length(held) >= least
        grown = F.struct(F.when(full, "").otherwise(held).alias("held"), F.when(full, F.concat(acc["out"], F.array(strip(held)))).otherwise(acc["out"]).alias("out"))
        return F.when(strip(part) == "", acc).otherwise(grown)

    done = lambda acc: F.when(strip(acc["held"]) == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(strip(acc["held"]))))
    return F.aggregate(F.split(text, "\n\n"), state, step, done)


def sentences(text: Column, group: int = 10) -> Column:
    """K3: sentences (ended by . ! ? and white space), ``group`` to a piece."""
    parts = F.filter(F.split(strip(text), r"(?<=[.!?])\s+"), lambda s: strip(s) != "")
    starts = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts), F.lit(group))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: strip(F.array_join(F.slice(parts, s, group), " ")))


def corpus_rows(files: DataFrame, mode: str = "whole", prefix: str = "doc") -> DataFrame:
    """K4: id, contents, title, source_file, chunk_index of files (path, text), cut as ``mode`` says."""
    pieces = {"whole": F.array("text"), "paragraph": paragraphs(F.col("text")), "sentence": sentences(F.col("text"))}[mode]
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    rows = files.withColumn("pieces", pieces).select("path", F.size("pieces").alias("n"), F.posexplode("pieces").alias("at", "contents"))
    part = F.concat(stem, F.lit(" (Part "), F.col("at") + 1, F.lit("/"), F.col("n"), F.lit(")"))
    return rows.select(
        F.concat_ws("-", F.lit(prefix), F.substring(F.md5("contents"), 1, 16)).alias("id"), "contents",
        F.when(F.col("n") == 1, stem).otherwise(part).alias("title"), name.alias("source_file"), F.when(F.col("n") > 1, F.col("at")).alias("chunk_index"),
    )
