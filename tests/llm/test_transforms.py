"""Fill-in-the-middle, line dedup and whitening: brute force, planted cases and awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from conftest import *  # noqa: F403
from pyspark.sql import functions as F
from weftline.llm import catalog, fim, lines, whitening

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
LONG = (1 << 63) - 1


def brute_fim(doc_id, text, rate=50, spm=80):
    units = TOKEN.findall(text)
    n, h = len(units), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return (n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def awkward_texts():
    rng = random.Random(4)
    made = ["".join(rng.choice(" \n\t\r\x0b\x0cab<é漢😀\x00\x1f ") for _ in range(rng.randrange(60))) for _ in range(300)]
    return [None, "", " ", "\n\n", "a", " a", "a ", "<P>", "x <M> y", "a<", "<S", "P><M", "word " * 200_000, " " * 2_000_000, "漢" * 100_000, *made]


def test_fim_brute_force(spark, docs):
    texts = awkward_texts()
    table = docs(*[(k, t) for k, t in enumerate(texts)], (LONG, "one two three"), (-LONG - 1, "one two three"), (None, "one two three"), (7, " a"))
    out = fim.transform(table.withColumns({"output": F.lit(1), "form": F.lit("x"), "n": F.lit("y")}))
    got = sorted((r.doc_id is None, r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out.withColumn("back", fim.restored()).collect() if r.doc_id is not None)
    want = sorted((d is None, d, *brute_fim(d, t or ""), t or "") for d, t in [*enumerate(texts), (LONG, "one two three"), (-LONG - 1, "one two three"), (7, " a")])
    assert got == want and {r[3] for r in want} == {"plain", "psm", "spm"}
    none = [r for r in out.collect() if r.doc_id is None]
    assert [tuple(r)[1:] for r in none] == [brute_fim(None, "one two three")]
    assert fim.digest(fim.transform(docs().limit(0))).collect() == []


def test_fim_runs_hold_every_unit():
    """A cut after each number of units, of tokens and of characters; runs are fewer than units where they hold several."""
    for text in (t for t in awkward_texts() if t and len(t) < 100):
        raw, units = text.encode(), TOKEN.findall(text)
        runs = fim.Runs.of_tokens(raw)
        assert runs.n == len(units)
        assert [runs.cut(m) for m in range(len(units) + 1)] == [len("".join(units[:m]).encode()) for m in range(len(units) + 1)]
        runs = fim.Runs.of_characters(raw)
        assert runs.n == len(text) and [runs.cut(m) for m in range(len(text) + 1)] == [len(text[:m].encode()) for m in range(len(text) + 1)]
    assert len(fim.Runs.of_characters(b"a" * 1000 + "é".encode() * 500).units) == 2


def test_fim_of_characters(docs):
    text = "añ漢😀 " * 50
    r = fim.transform(docs(*[(k, text) for k in range(40)]), fim.Draw(rate=100, spm=0, units="characters"))
    for x in r.withColumn("back", fim.restored()).collect():
        assert x.n == len(text) and x.form == "psm" and x.back == text
        p = x.output.split("<S>")[0][3:]
        assert len(p) == x.prefix_chars and text.startswith(p)


def brute_lines(table, shortest=10):
    """Rows (doc_id, n_lines, n_dropped, text) by plain dictionaries."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    least = {}
    for d, t in table:
        if d is not None:
            for k in map(key, (t or "").split("\n")):
                least[k] = min(least.get(k, d), d)
    out = []
    for d, t in table:
        every = (t or "").split("\n")
        kept = [x for x in every if d is None or len(key(x)) < shortest or least[key(x)] == d]
        out.append((d, len(every), len(every) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.fixture
def tasks(spark):
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.shuffle.partitions", 4)


@pytest.mark.parametrize("n", [1, 3, 32])
def test_lines_brute_force(spark, docs, tasks, n):
    """A line that most documents hold is spread over the tasks; rows of one doc_id, repeated rows, rows without doc_id, extreme ids."""
    tasks(n)
    rng = random.Random(n)
    pool = [f"Shared line number {k}" for k in range(30)] + ["short", "", "  ", "exactly 10", "EXACTLY 10 ", "äöü äöü äö", "\x1fcontrol line", "nine char"]
    hot = "The line that nearly everyone has"
    table = [(k, "\n".join(([hot] if rng.random() < 0.9 else []) + [rng.choice(pool) + rng.choice(["", " ", "\t", "\r"]) for _ in range(rng.randrange(12))] + ([hot.upper()] if k % 5 == 0 else []))) for k in range(400)]
    table += [(LONG, hot), (-LONG - 1, hot + "\n" + pool[0]), (None, hot), (None, None), (401, None), (402, ""), table[7], table[7], (9, "Another text of nine\n" + pool[1]), (500, "Another text of nine"), (501, ("x" * 50 + "\n") * 2000), (502, "y" * 3_000_000), (503, "y" * 3_000_000 + "\n"), (504, "\n" * 50_000)]
    frame = docs(*table).withColumns({"hi": F.lit(1), "keep": F.lit("k"), "tag": F.lit(2), "position": F.lit("p"), "task": F.lit(0)})
    maps = lines.bitmaps(frame)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in lines.kept(frame, maps).collect()), key=repr)
    assert got == brute_lines(table)
    packed = maps.where("doc_id = 504").first()
    assert packed.n_lines == 50_001 and len(packed.keep) < 100 and np.unpackbits(np.frombuffer(zlib.decompress(packed.keep), np.uint8), count=50_001).all()


def test_lines_of_one_key_go_on_through_tasks():
    """First and last keys of the tasks, of which some hold one key only, and one is missing."""
    row = lambda task, kind, key, doc: {"task": task, "kind": kind, "hi": key, "lo": 0, "doc_id": doc}
    ends = [row(0, 2, 1, 4), row(0, 3, 5, 2), row(2, 2, 5, 2), row(2, 3, 5, 2), row(3, 2, 5, 8), row(3, 3, 5, 8), row(4, 2, 5, 9), row(4, 3, 6, 3), row(5, 2, 6, 3), row(5, 3, 7, 1), row(6, 2, 8, 9), row(6, 3, 8, 9)]
    assert lines.continued(ends) == [3, 4]


def test_lines_empty(docs):
    empty = docs().limit(0)
    assert lines.bitmaps(empty).collect() == [] and lines.kept(empty, lines.bitmaps(empty)).collect() == []


VEC = "vec_id long, embedding array<float>, x string, component int"


def brute_white(rows):
    """x, n, S, and all eigenpairs by plain numpy."""
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in rows], dtype=np.int64)
    c = x - x.sum(axis=0) / len(x)
    values, axes = np.linalg.eigh(c.T @ c / len(x))
    return x, c, values[::-1], axes[:, ::-1]


def held(spark, vectors, components, extra=()):
    rows = [(k, [float(c) for c in v], "x", 5) for k, v in enumerate(vectors)] + list(extra)
    return whitening.whiten(spark.createDataFrame(rows, VEC), components).collect()


@pytest.mark.parametrize("kind", ["flat", "steep", "narrow"])
def test_whitening_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    d, k = (6, 32) if kind == "narrow" else (40, 5)
    spread = np.ones(d) if kind == "flat" else 4.0 ** -np.arange(d) * 64
    vectors = (rng.normal(size=(700, d)) * (spread if kind != "narrow" else 1)) + 3
    bad = [(1000, None, "x", 5), (1001, [], "x", 5), (1002, [float("nan")] * d, "x", 5), (1003, [float("inf")] * d, "x", 5), (1004, [None] * d, "x", 5), (1005, [1.0] * (d - 1), "x", 5), (1006, [1e38] * d, "x", 5)]
    got = held(spark, vectors, k, bad)
    x, c, values, axes = brute_white(vectors)
    k = min(k, d)
    assert len(got) == 700 * k and {r.n for r in got} == {700}
    w = np.zeros((700, k))
    for r in got:
        w[r.vec_id, r.component - 1] = r.whitened
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-8
    want = c @ axes[:, :k] / np.sqrt(values[:k])
    want *= np.sign((want * w).sum(axis=0))
    assert np.abs(w - want).max() < 1e-7
    exact = [sum((len(x) * int(v) - int(s)) ** 2 for v, s in zip(row, x.sum(axis=0), strict=True)) for row in x]
    assert {(r.vec_id, r.deviation) for r in got} == set(enumerate(exact))


def test_whitening_range_finder_and_its_fallback(spark, monkeypatch):
    """A steep spectrum is settled within the thin block; a flat one grows to the full dimension."""
    rng = np.random.default_rng(8)
    bases = []
    monkeypatch.setattr(whitening.np, "eye", lambda n, real=np.eye: bases.append(n) or real(n))
    for spread, grows in ((np.append(1000 * 2.0 ** -np.arange(8), np.zeros(42)), False), (np.ones(50), True)):
        bases.clear()
        x = rng.normal(size=(500, 50)) * spread
        rows = whitening.whole(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"))
        model = whitening.fit(rows, components=4, oversampling=6)
        assert (50 in bases) == grows and model.identity_error < 1e-9


def test_whitening_without_variance(spark):
    got = held(spark, [[1.0, 2.0, 3.0]] * 9, 2)
    assert len(got) == 18 and all(r.whitened is None and r.explained == 0 and r.identity_error == 0 and r.deviation == 0 for r in got)
    flat = held(spark, [[float(k), 2.0, 3.0] for k in range(9)], 3, [(None, [4.0, 2.0, 3.0], "x", 5), (3, [3.0, 2.0, 3.0], "x", 5)])
    assert len(flat) == 33 and {r.component for r in flat if r.whitened is not None} == {1} and sum(r.vec_id is None for r in flat) == 3
    assert held(spark, [], 4) == []


def test_whitening_of_large_numbers(spark):
    """Sums and deviations beyond a long's square root are exact, those beyond a long null."""
    base = [(k, [float(k) * 2.0**30, -5.0 * 2.0**20 * (k % 3)]) for k in range(40)]
    table = spark.createDataFrame([*base], "vec_id long, embedding array<double>")
    xs = {k: [int(64 * c) + 1_000_000 for c in v] for k, v in base}
    sums = [sum(x[j] for x in xs.values()) for j in range(2)]
    for r in whitening.whiten(table, 1).collect():
        want = sum((40 * x - s) ** 2 for x, s in zip(xs[r.vec_id], sums, strict=True))
        assert r.deviation == (want if want < 1 << 63 else None)


def test_op13(spark):
    """The registered query on the whole table."""
    table = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}  # noqa: F405
    x, c, values, axes = brute_white(list(table.values()))
    got = catalog.op13_whitening(spark, SF).collect()  # noqa: F405
    at = {v: k for k, v in enumerate(table)}
    w = np.zeros((len(table), 32))
    for r in got:
        w[at[r.vec_id], r.component - 1] = r.whitened
        assert r.identity_error <= 1e-4 and abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-4
    want = c @ axes[:, :32] / np.sqrt(values[:32])
    want *= np.sign((want * w).sum(axis=0))
    assert len(got) == 32 * len(table) and np.abs(w - want).max() < 1e-7
    n, total = len(x), x.sum(axis=0)
    assert {(r.vec_id, r.deviation) for r in got} == {(v, int(((n * x[k] - total) ** 2).sum())) for v, k in at.items()}
