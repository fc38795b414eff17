"""Fill-in-the-middle transformation by a run-length encoding of character classes.

A text is stored as its maximal runs of one class of bytes (blank or other), each with its start and
the number of units that are complete at its end. A cut after m units is found by binary search for
the run in which unit m ends; where a run holds many units of one size, the place within it is
computed from what is left. So a cut costs a logarithm of the number of runs, and no list of units
is made. Documents are transformed where they are read: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of output that leave a task at once.
AT_ONCE = 8 << 20

# The blanks that separate tokens.
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes that continue a code point.
_INNER = (np.arange(256) & 0xC0) == 0x80


@dataclass(frozen=True)
class Runs:
    """Maximal runs of one class over a UTF-8 text: ``starts`` (and the text's end), units complete after each, bytes of a unit (0: the run is one)."""

    starts: np.ndarray
    units: np.ndarray
    size: np.ndarray

    @classmethod
    def of_tokens(cls, raw: bytes) -> Runs:
        """Units are words with the blanks before them; blanks at the end are one."""
        starts, blank = cls._spans(_BLANK[np.frombuffer(raw, np.uint8)])
        done = (~blank).astype(np.int64)
        if len(blank) and blank[-1]:
            done[-1] = 1
        return cls(starts, np.cumsum(done), np.zeros(len(done), dtype=np.int64))

    @classmethod
    def of_characters(cls, raw: bytes) -> Runs:
        """Units are code points; a run holds those of one length in bytes."""
        x = np.frombuffer(raw, np.uint8)
        heads = np.flatnonzero(~_INNER[x])
        width = np.diff(heads, append=len(raw))
        starts, _ = cls._spans(np.repeat(width, width))
        size = width[np.searchsorted(heads, starts[:-1])]
        return cls(starts, np.cumsum(np.diff(starts) // np.maximum(size, 1)), size)

    @staticmethod
    def _spans(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.concatenate([np.zeros(min(1, len(kinds)), dtype=np.int64), np.flatnonzero(kinds[1:] != kinds[:-1]) + 1])
        return np.append(starts, len(kinds)), kinds[starts]

    @property
    def n(self) -> int:
        return int(self.units[-1]) if len(self.units) else 0

    def cut(self, m: int) -> int:
        """The byte at which the first ``m`` units end."""
        if m <= 0 or not len(self.units):
            return 0
        k = int(np.searchsorted(self.units, m))
        if not self.size[k]:
            return int(self.starts[k + 1])
        before = int(self.units[k - 1]) if k else 0
        return int(self.starts[k]) + (m - before) * int(self.size[k])


UNITS = {"tokens": Runs.of_tokens, "characters": Runs.of_characters}


@dataclass(frozen=True)
class Draw:
    """Where documents are cut, and how they are put together; ``rate`` of them are transformed, ``spm`` of those suffix first (per cent)."""

    seed: int = 42
    rate: int = 50
    spm: int = 80
    units: str = "tokens"


def numbers(seed: int, doc_id: int | None) -> tuple[int, ...]:
    """Four 32-bit numbers drawn by seed and doc_id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4))


def characters(raw: bytes) -> int:
    return len(raw) - int(_INNER[np.frombuffer(raw, np.uint8)].sum())


def transformed(raw: bytes, doc_id: int | None, draw: Draw) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle, and the output of one text."""
    runs, (h1, h2, h3, h4) = UNITS[draw.units](raw), numbers(draw.seed, doc_id)
    n = runs.n
    if not raw or h3 % 100 >= draw.rate or any(mark.encode() in raw for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, raw
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = runs.cut(a), runs.cut(b)
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    p, s, m = PREFIX.encode() + prefix, SUFFIX.encode() + suffix, MIDDLE.encode() + middle
    form, parts = ("spm", (s, p, m)) if h4 % 100 < draw.spm else ("psm", (p, s, m))
    return n, form, characters(prefix), characters(middle), b"".join(parts)


OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())


def transform(docs: DataFrame, draw: Draw = Draw()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: every text, split into prefix, middle and suffix by two drawn cuts.

    ``n`` counts the text's units. Null and empty texts, texts that hold a marker and those that the
    draw leaves out are plain: the output is the text, both lengths are null. A null doc_id draws as
    an empty string; repeated rows give equal rows; an empty table gives no row. Only doc_id and
    text are read.
    """

    def run(batches):
        for batch in batches:
            out, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out.append((doc_id, *transformed(text.as_buffer().to_pybytes(), doc_id, draw)))
                held += len(out[-1][-1])
                if held > AT_ONCE:
                    yield rows(out)
                    out, held = [], 0
            if out:
                yield rows(out)

    def rows(out):
        columns = [list(c) for c in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns[:-1], _TYPES, strict=False)), pa.array(columns[-1], pa.binary()).cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return texts(docs).mapInArrow(run, OUT)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text again: no marker is in a text that is cut, and none can begin or end within a neighbour."""
    parts = F.split(F.col(output), "<[PSM]>", -1)
    order = F.when(F.col(form) == "psm", F.concat(parts[1], parts[3], parts[2])).when(F.col(form) == "spm", F.concat(parts[2], parts[3], parts[1]))
    return F.coalesce(order, F.col(output))


def digest(rows: DataFrame) -> DataFrame:
    """``transform``'s rows with hashes of the output and of the text restored from it."""
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


FIM_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
numbers AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM drawn),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM numbers),
parts AS (
  SELECT doc_id, text, n, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
