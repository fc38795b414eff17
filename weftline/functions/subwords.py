"""T4, K1: byte-pair tokens of a public vocabulary, in Arrow batches, and windows cut between them."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from weftline.functions.text import hash_id, strip

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the added token of the vocabulary's JSON file, which ``tokenizers`` finds in texts, too.
SPECIAL = {"<|endoftext|>": 50256}
#: Bytes of windows that leave a task at once.
AT_ONCE = 8 << 20


class Subwords:
    """Token ids of texts, and back. The vocabulary is a file that ``public_tokenizers`` finds on every executor.

    ``tiktoken`` gives the ids that ``tokenizers`` gives with the JSON file of the same vocabulary, at
    about six times the speed. Its pattern gives up on runs of blanks of some hundred thousand; such a
    text goes to ``tokenizers``.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers
        import tiktoken

        self.json = public_tokenizers.path(vocabulary.removesuffix(".tiktoken") + ".json")
        with open(public_tokenizers.path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
        self.bytes_of = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in SPECIAL.items()}
        self.size = np.zeros(max(self.bytes_of) + 1, dtype=np.int64)
        self.size[list(self.bytes_of)] = [len(b) for b in self.bytes_of.values()]

    @cached_property
    def slow(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json)

    def encode(self, text: str) -> np.ndarray:
        try:
            ids = self.encoding.encode(text, allowed_special="all")
        except ValueError:  # the pattern's stack is full
            ids = self.slow.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype=np.int32)

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no whole character at either end are left out."""
        raw = b"".join(self.bytes_of[int(i)] for i in ids)
        a = next((k for k, b in enumerate(raw[:4]) if b & 0xC0 != 0x80), len(raw))
        return raw[a : _last_whole(raw)].decode(errors="ignore")


def _last_whole(raw: bytes) -> int:
    """The end of the last whole character."""
    for back in range(1, min(4, len(raw)) + 1):
        b = raw[-back]
        if b & 0xC0 != 0x80:
            need = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            return len(raw) if need <= back else len(raw) - back
    return len(raw)


@lru_cache(maxsize=4)
def subwords(vocabulary: str) -> Subwords:
    return Subwords(vocabulary)


def token_ids(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """T4: the ids of a text; null for null."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(texts):
        return texts.map(lambda t: None if t is None else subwords(vocabulary).encode(t))

    return encode(text)


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """The number of a text's tokens; null for null."""

    @F.pandas_udf(IntegerType())
    def count(texts):
        return texts.map(lambda t: None if t is None else len(subwords(vocabulary).encode(t))).astype("Int32")

    return count(text)


def token_text(ids: Column, vocabulary: str = VOCABULARY) -> Column:
    """T4 back: the text of ids."""

    @F.pandas_udf(StringType())
    def decode(rows):
        return rows.map(lambda r: None if r is None else subwords(vocabulary).decode(r))

    return decode(ids)


def cuts(raw: bytes, sizes: np.ndarray, size: int, step: int) -> Iterator[tuple[int, int, int, int]]:
    """start, tokens and the bytes from .. to of each window. A character that a cut goes through belongs to the window in which it begins."""
    ends, n = np.concatenate([[0], np.cumsum(sizes)]), len(sizes)

    def whole(at: int) -> int:
        while at < len(raw) and raw[at] & 0xC0 == 0x80:
            at += 1
        return at

    for start in range(0, n, step):
        count = min(size, n - start)
        yield start, count, whole(int(ends[start])), whole(int(ends[start + count]))


def windows(docs: DataFrame, key: str, text: str, size: int = 1200, overlap: int = 100, vocabulary: str = VOCABULARY) -> DataFrame:
    """K1: chunk_id, full_doc_id, chunk_order_index, tokens, content: windows of ``size`` tokens, each ``size - overlap`` on.

    Windows are cut in token space and their contents taken from the text itself, stripped, so no
    character is broken: one that a cut goes through stands in the window in which it begins. The last
    window may lie wholly in the one before. Null and empty texts give none.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    kind, names = dict(docs.dtypes)[key], ["full_doc_id", "chunk_order_index", "tokens", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = subwords(vocabulary)
        for batch in batches:
            place, held, out = [], 0, ([], [], [])
            for row, value in enumerate(batch.column(1)):
                raw = value.as_buffer().to_pybytes()
                ids = words.encode(raw.decode())
                for k, (_, count, a, b) in enumerate(cuts(raw, words.size[ids], size, size - overlap)):
                    place.append(row)
                    for column, x in zip(out, (k, count, raw[a:b]), strict=True):
                        column.append(x)
                    held += b - a
                    if held > AT_ONCE:
                        yield rows(batch, place, out)
                        place, held, out = [], 0, ([], [], [])
            if place:
                yield rows(batch, place, out)

    def rows(batch, place, out):
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place)), pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary()).cast(pa.string())], names=names)

    texts = docs.select(F.col(key).alias("full_doc_id"), F.col(text).alias("text")).where("text IS NOT NULL AND text <> ''")
    cut = texts.mapInArrow(run, f"full_doc_id {kind}, chunk_order_index int, tokens int, content string").withColumn("content", strip(F.col("content")))
    return cut.select(hash_id(F.col("content"), "chunk-").alias("chunk_id"), *names)
