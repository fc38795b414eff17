"""License scans: fuzzy search for short notices.

A text is reduced to its words, lower-cased and joined by one blank. A notice that may hold up to k
edits is cut into k + 1 seeds, so one seed stands in any match unchanged. One pass of an automaton
over all seeds finds the candidate places; there the regex library's bounded-error matching
verifies the notice, counts its edits and tells its span.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import texts


@dataclass(frozen=True)
class Notice:
    label: str
    phrase: str
    base: bool = False

    @property
    def edits(self) -> int:
        """One edit for each nine characters, three at most; none in very short phrases."""
        return min(3, len(self.phrase) // 9) if len(self.phrase) >= 18 else 0

    def seeds(self) -> list[tuple[int, str]]:
        """k + 1 pieces and where each starts."""
        n, k = len(self.phrase), self.edits + 1
        cuts = [n * i // k for i in range(k + 1)]
        return [(a, self.phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


NOTICES = (
    Notice("mit", "under the mit license", base=True),
    Notice("apache-2", "apache license version 2", base=True),
    Notice("cc-by-nc", "cc by nc", base=True),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Notice("cc-by-nc", "creative commons attribution noncommercial"),
    Notice("cc-by-sa", "creative commons attribution sharealike"),
    Notice("gpl", "under the terms of the gnu general public license"),
    Notice("lgpl", "gnu lesser general public license"),
    Notice("agpl", "gnu affero general public license"),
    Notice("mpl-2", "mozilla public license version 2"),
    Notice("bsd", "redistribution and use in source and binary forms"),
    Notice("unlicense", "free and unencumbered software released into the public domain"),
    Notice("all-rights-reserved", "all rights reserved"),
)

FOUND = "doc_id long, n_words long, found array<struct<label:string,base:boolean,first_word:long,last_word:long,edits:int,phrase_chars:int>>"

_WORDS = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)


class Searcher:
    def __init__(self, notices: tuple[Notice, ...]):
        import ahocorasick
        import regex

        self.notices, self.blank = notices, regex.compile(" ")
        places: dict[str, list[tuple[int, int]]] = {}
        for k, notice in enumerate(notices):
            for offset, seed in notice.seeds():
                places.setdefault(seed, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for seed, at in places.items():
            self.automaton.add_word(seed, (len(seed), at))
        self.automaton.make_automaton()
        self.patterns = [
            regex.compile(rf"(?e)\b(?:{n.phrase}){{e<={n.edits}}}\b" if n.edits else rf"\b(?:{n.phrase})\b", regex.V1) for n in notices
        ]

    def search(self, joined: str) -> list[tuple]:
        """(label, base, first word, last word, edits, phrase length) of each place, in order of start."""
        windows: dict[int, list[list[int]]] = {}
        for end, (size, at) in self.automaton.iter(joined):
            for k, offset in at:
                slack = self.notices[k].edits + 1
                lo = max(0, end + 1 - size - offset - slack)
                hi = end + 1 - size - offset + len(self.notices[k].phrase) + slack
                own = windows.setdefault(k, [])
                if own and lo <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], hi)
                    own[-1][0] = min(own[-1][0], lo)
                else:
                    own.append([lo, hi])
        if not windows:
            return []
        out = []
        for k, spans in windows.items():
            notice = self.notices[k]
            size, exact = len(notice.phrase), self.exact(joined, notice.phrase)
            out += [(a, a + size, k, 0) for a in exact]
            done = 0
            for lo, hi in spans if notice.edits else ():
                at = max(lo, done)
                while m := self.patterns[k].search(joined, at, hi):
                    done = max(m.end(), at + 1)
                    # Exact places have one length: the first that ends beyond the match's start is the one that may overlap it.
                    near = bisect_right(exact, m.start() - size)
                    if near == len(exact) or exact[near] >= m.end():
                        out.append((m.start() + (m.group()[:1] == " "), m.end(), k, sum(m.fuzzy_counts)))
                    at = done
        starts = [0, *(m.end() for m in self.blank.finditer(joined))]
        return [self.place(joined, starts, *x) for x in sorted(out)]

    def place(self, joined: str, starts: list[int], start: int, end: int, k: int, edits: int) -> tuple:
        notice, first = self.notices[k], bisect_right(starts, start) - 1
        return notice.label, notice.base and not edits, first, first + joined[start:end].strip().count(" "), edits, len(notice.phrase)

    @staticmethod
    def exact(joined: str, phrase: str) -> list[int]:
        """Starts of all places where the phrase's words stand consecutively."""
        padded, wanted, out, at = f" {joined} ", f" {phrase} ", [], -1
        while (at := padded.find(wanted, at + 1)) >= 0:
            out.append(at)
        return out


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """doc_id, n_words and every place of a notice: label, base, first_word, last_word, edits, phrase_chars.

    ``base`` marks exact places of the base phrases. Null and empty texts have no words and no
    place. Each row is scanned by itself, so repeated rows give repeated results, and an empty table
    gives no row. Only doc_id and text are read.
    """

    def run(batches):
        searcher = Searcher(notices)
        for batch in batches:
            counts, found = [], []
            for text in batch.column(1):
                words = text.as_buffer().to_pybytes().translate(_WORDS).split()
                counts.append(len(words))
                found.append(searcher.search(b" ".join(words).decode()))
            kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("phrase_chars", pa.int32())]))
            names = [f.name for f in kind.value_type]
            rows = [[dict(zip(names, x, strict=True)) for x in places] for places in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(rows, kind)], names=["doc_id", "n_words", "found"])

    return texts(docs).mapInArrow(run, FOUND)


def digest(found: DataFrame) -> DataFrame:
    """One row of counts, labels and score for each row of ``scan``."""
    base = F.filter("found", lambda x: x["base"])
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))), ",")
    closest = F.array_max(F.transform("found", lambda x: 1 - x["edits"] / x["phrase_chars"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["first_word"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        F.coalesce(closest, F.lit(0.0)).cast("double").alias("score"),
        "found",
    )
