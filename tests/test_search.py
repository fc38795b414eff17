"""Sparse search, the index in cells, and entity resolution, against brute force."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.functions import vectors as vx
from weftline.operators import access, cells, impact, merge, resolution, search
from weftline.plans import catalog, retrieval
from weftline.plans.engine import Engine

SF = "/root/testdata/sf0.01"
VECTOR = f"name string, vector {vx.SPARSE}"


def unit(entries):
    length = sum(v * v for v in entries.values()) ** 0.5
    return {b: v / length for b, v in entries.items()}


def table(spark, rows):
    return spark.createDataFrame([(name, [(b, float(v)) for b, v in sorted(x.items())]) for name, x in rows.items()], VECTOR)


def cosine(x, y):
    return round(sum(v * y[b] for b, v in x.items() if b in y), 9)


def made(n, seed, buckets=40, signed=False):
    rng = random.Random(seed)
    return {f"v{k:04}": unit({rng.randrange(buckets): rng.choice([1, 1, 1, 2, 3, -1 if signed else 1]) for _ in range(rng.randrange(1, 9))}) for k in range(n)}


@pytest.mark.parametrize("kind, limit", [("long", 1000), ("string", 7)])
def test_sparse_top_k(spark, monkeypatch, kind, limit):
    """Ties by name, thresholds, buckets that only one side has, empty vectors; in one block and in several."""
    monkeypatch.setattr(search, "SPARSE_LIMIT", limit)
    held = made(300, 1) | {"copy1": made(300, 1)["v0007"], "copy2": made(300, 1)["v0007"], "empty": {}}
    asks = {k: x for k, (_, x) in enumerate(made(40, 2, buckets=60).items())}
    asks = {(k if kind == "long" else f"q{k}"): x for k, x in asks.items()}
    rows = [(q, b, v) for q, x in asks.items() for b, v in x.items()]
    got = defaultdict(list)
    for r in search.sparse_top_k(spark.createDataFrame(rows, f"query_id {kind}, bucket int, value double"), table(spark, held).repartition(5), 6).collect():
        got[r.query_id].append((r["rank"], r.name, r.score))
    for q, x in asks.items():
        near = sorted(((-cosine(x, y), name) for name, y in held.items() if cosine(x, y) >= 0.2))[:6]
        assert sorted(got[q]) == [(k, name, -s) for k, (s, name) in enumerate(near, 1)]
    none = spark.createDataFrame([], f"query_id {kind}, bucket int, value double")
    assert search.sparse_top_k(none, table(spark, held), 6).collect() == []
    assert search.sparse_top_k(spark.createDataFrame(rows, f"query_id {kind}, bucket int, value double"), table(spark, {}), 6).collect() == []


def test_search_shuffles_no_pairs(spark):
    """Every vector is scored where it is read: no join, and the only exchange is that of the best."""
    held = table(spark, made(50, 3))
    asks = spark.createDataFrame([(1, 3, 1.0)], "query_id long, bucket int, value double")
    plan = search.sparse_top_k(asks, held, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def exact(index, asks, k, at_least=0.2):
    whole = defaultdict(set)
    for layer in index.layers:
        for r in search.sparse_top_k(asks, layer.select("name", "vector"), k, at_least).collect():
            whole[r.query_id].add(r.name)
    return whole


def crowded(n, groups, seed):
    """Vectors around so many points."""
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(groups, 64))
    x = points[rng.integers(groups, size=n)] + 0.35 * rng.normal(size=(n, 64))
    return {f"{k}": unit(dict(enumerate(v.tolist()))) for k, v in enumerate(x)}


@pytest.mark.parametrize("kind", ["even", "crowded"])
def test_recall_and_pruned_scan(spark, tmp_path, kind):
    """Recall of 20 neighbours: over the table of embeddings, which lie evenly, and over crowds, of which a query reads few cells."""
    if kind == "even":
        index, asks = catalog._dense_index(spark, SF)
    else:
        rows = table(spark, crowded(3000, 40, 9))
        own = cells.learned(rows)
        cells.placed(rows, own.centres).repartition("cell").write.partitionBy("cell").parquet(str(tmp_path / "c"))
        index = cells.Index([spark.read.parquet(str(tmp_path / "c"))], own)
        asks = rows.where("cast(name AS int) % 60 = 0").select(F.col("name").cast("long").alias("query_id"), F.inline("vector"))
    n, probes = len(index.cells.centres), index.cells.probes(0.97)
    want, met, got = exact(index, asks, 20, -1.0), 0, index.top_k(asks, 20, -1.0, recall=0.97)
    for r in got.collect():
        met += r.name in want[r.query_id]
    assert met / sum(map(len, want.values())) >= 0.95 and probes < n and (kind == "even" or probes <= n / 5)
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()
    # One query reads the files of its cells and no others.
    block = next(search.asked_blocks(asks.where("query_id = 0")))
    allowed = index.probed(block, 3)
    wanted = np.flatnonzero(allowed.any(axis=0)).tolist()
    rows = index.rows(wanted)
    assert len(wanted) == 3 and {r.cell for r in rows.select("cell").distinct().collect()} == set(wanted)
    rows.collect()
    scan = rows._jdf.queryExecution().executedPlan().collectLeaves().toList().toString()
    assert "dynamicpruning" in scan
    # All cells probed: the exact answer.
    full = index.top_k(asks, 20, -1.0, probes=n)
    assert {(r.query_id, r.name) for r in full.collect()} == {(q, v) for q, names in want.items() for v in names}


def test_cells_by_brute_force(spark):
    """Each vector lies in the cell of its nearest centre; centres are unit means of what was learned."""
    held = made(200, 4, buckets=3000)
    rows = table(spark, held)
    centres = cells.learned(rows, 12).centres
    assert centres.shape == (12, cells.DIMS) and np.allclose(np.linalg.norm(centres, axis=1), 1)
    for r in cells.placed(rows, centres).collect():
        x = np.zeros(cells.DIMS)
        for b, v in held[r.name].items():
            x[b % cells.DIMS] += v
        near = centres @ x
        assert near[r.cell] >= near.max() - 1e-5 and {e.bucket: e.value for e in r.vector} == held[r.name]
    assert all(cells.learned(rows.limit(k)).centres.shape == (1, cells.DIMS) for k in (0, 1))


TEXTS = [
    "The lighthouse keeper watches wonderful seabirds. Seabirds like lighthouse windows.",
    "Mountains collect snowflakes every wintertime. The lighthouse keeper watches wonderful seabirds.",
    "Gardeners cultivate strawberries carefully. Strawberries ripen throughout summertime.",
    "Astronomers photograph spectacular constellations. Constellations illuminate observatories.",
]


def test_engine_indexes_through_inserts(spark, tmp_path, monkeypatch):
    """Cells are learned on insert and anew when outgrown; newer rows of a name hide older ones in whatever cell; all cells probed, and lists, give the exact answer."""
    monkeypatch.setattr(cells, "GROWTH", 2)
    engine = Engine(spark, str(tmp_path / "w"), cells=0, lists=True)
    learned = []
    for texts in (TEXTS[:1], TEXTS[1:2], TEXTS[2:]):
        engine.insert(spark.createDataFrame([(t,) for t in texts], "content string"))
        learned.append(engine.cells_of("entity_vectors")[1])
    assert len(set(learned)) > 1 and learned == sorted(learned)
    held = engine.table("entity_vectors")
    assert held.count() == engine.table("entities").count() and held.select("cell").distinct().count() > 1
    asks = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "query_id long, text string")
    rows = lambda **how: sorted(map(tuple, engine.query(asks, retrieval.QueryParams(mode="local", **how)).collect()))
    assert set(engine.graph().lists) == {"entity", "fact", "chunk"}
    assert rows() == rows(probes=10**6) == rows(lists=True) and 0 < len(rows(probes=1)) <= len(rows())
    engine.delete(spark.createDataFrame([("lighthouse",)], "name string"))
    assert rows() == rows(probes=10**6) == rows(lists=True) and '"LIGHTHOUSE"' not in str(engine.table("entity_vectors").collect())


def linked(rows, at_least):
    """Components by plain union of all similar pairs."""
    names, root = sorted(rows), {n: n for n in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if cosine(rows[a], rows[b]) >= at_least:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in names}


@pytest.mark.parametrize("seed, crowd, signed", [(1, 200, False), (2, 3, False), (3, 3, True), (4, 8, False)])
def test_resolution_brute_force(spark, monkeypatch, seed, crowd, signed):
    """Random vectors over few words, dominated ones among them, with crowds of every size; with negative values, too."""
    monkeypatch.setattr(resolution, "CROWD", crowd)
    rng = random.Random(seed)
    rows = made(150, seed, buckets=12, signed=signed)
    for k in range(60):  # one word and a little more
        x = {0: 10.0, rng.randrange(1, 12): rng.choice([0, 1, 2, 3, 4, 5])}
        rows[f"w{k:03}"] = unit({b: v for b, v in x.items() if v})
    rows |= {"equal1": rows["v0003"], "equal2": rows["v0003"], "zero": {}}
    want = linked({n: x for n, x in rows.items() if x}, 0.9)
    got = {r.entity: r.canonical for r in resolution.aliases(table(spark, rows), 0.9).collect()}
    assert {n: got.get(n, n) for n in want} == want and len(set(want.values())) < len(want)
    for r in resolution.similar_pairs(table(spark, rows), 0.9).collect():
        assert r.score >= 0.9 and abs(r.score - cosine(rows[r.a], rows[r.b])) < 1e-8


def test_crowds_make_no_pairs(spark, monkeypatch):
    """Vectors dominated by one word, each with a word of its own: as many pairs as vectors; four times the vectors, four times the pairs."""
    monkeypatch.setattr(resolution, "CROWD", 20)
    seen = []
    real = resolution.scored
    monkeypatch.setattr(resolution, "scored", lambda pairs, *a: seen.append(pairs.count()) or real(pairs, *a))
    for n in (200, 800):
        rows = {f"v{k:04}": unit({0: 10.0, k + 1: 1.0 + k % 3}) for k in range(n)}
        names = {r.canonical for r in resolution.aliases(table(spark, rows), 0.9).collect()}
        assert names == {"v0000"}
    assert seen[0] <= 200 and seen[1] <= 4.2 * seen[0]


def test_engine_resolution(spark, tmp_path):
    """Two spellings become one entity in every table; an insert afterwards keeps the name; degrees are those of the edges."""
    said = lambda *names: "##".join(f'("hyper-relation"<|>"{names[0]} stands there"<|>7)##' + "##".join(f'("entity"<|>"{n}"<|>"place"<|>"the tall old tower"<|>80)' for n in names) for _ in (0,)) + "<|COMPLETE|>"
    answers = {"first": said("lighthouse", "lighthouse one"), "second": said("LightHouse the", "Meadow"), "third": said("lighthouse the", "Meadow")}
    fixed = lambda chunks: chunks.select("chunk_id", F.element_at(F.create_map(*[F.lit(x) for kv in answers.items() for x in kv]), F.col("content")).alias("response"))
    engine = Engine(spark, str(tmp_path / "w"), extractor=fixed, cells=2)
    for word in ("first", "second"):
        engine.insert(spark.createDataFrame([(word,)], "content string"))
    assert {'"LIGHTHOUSE"', '"LIGHTHOUSE ONE"', '"LIGHTHOUSE THE"', '"MEADOW"'} <= {r.entity for r in engine.table("entities").collect()}
    engine.resolve(0.9)
    left = {r.entity: r for r in engine.table("entities").collect()}
    moved = {r.entity: r.canonical for r in engine.table("aliases").collect()}
    assert moved == dict.fromkeys(('"LIGHTHOUSE"', '"LIGHTHOUSE THE"'), '"LIGHTHOUSE ONE"') and not set(moved) & set(left) and len(left['"LIGHTHOUSE ONE"'].source_ids) == 2
    engine.insert(spark.createDataFrame([("third",)], "content string"))
    assert {r.entity for r in engine.table("entities").collect()} == set(left)
    edges = engine.table("edges").collect()
    assert not [e for e in edges if e.entity in moved] and sorted(map(tuple, access.node_degree(engine.table("edges")).collect())) == sorted(map(tuple, engine.table("degrees").collect()))
    assert {r.name for r in engine.table("entity_vectors").collect()} == set(left)
    before = sorted(map(repr, engine.table("entities").collect()))
    engine.resolve(0.9)
    assert sorted(map(repr, engine.table("entities").collect())) == before


def test_joined_entities_vote(spark):
    rows = [("a", "X", ["d"], ["1"]), ("b", "Y", ["e"], ["2"]), ("c", "Y", ["d"], ["2"]), ("m", "Z", ["f"], ["3"]), ("n", "W", [], [])]
    names = spark.createDataFrame([("b", "a"), ("c", "a"), ("n", "m")], "entity string, canonical string")
    got = {r.entity: tuple(r)[1:] for r in merge.joined_entities(spark.createDataFrame(rows, "entity string, entity_type string, descriptions array<string>, source_ids array<string>"), names).collect()}
    assert got == {"a": ("Y", ["d", "e"], ["1", "2"]), "m": ("Z", ["f"], ["3"])}


def brute_most(q, bound):
    """By a fine search over the scale at which free entries follow the query."""
    return max(min(1.0, 1 / max(np.linalg.norm(d), 1e-12)) * float(q @ d) if np.linalg.norm(d) > 1 else float(q @ d) for s in np.append(np.geomspace(1e-3, 1e3, 4000), 1e9) for d in [np.minimum(bound, s * q)])


def test_bound_of_unmet_rows():
    rng = np.random.default_rng(1)
    for _ in range(60):
        m = rng.integers(1, 7)
        q, bound = rng.random(m) + 0.05, rng.random(m) * rng.integers(0, 2, m)
        top = impact.most(q, bound)
        assert top >= brute_most(q, bound) - 1e-3 and top <= float(q @ bound) + 1e-9 and top <= float(np.linalg.norm(q)) + 1e-9
        for _ in range(50):  # no row under the limits scores more
            d = np.minimum(rng.random(m), bound)
            assert float(q @ (d / max(1, np.linalg.norm(d)))) <= top + 1e-9


def test_reading_covers_all_that_may_be_best():
    rng = np.random.default_rng(2)
    for _ in range(40):
        m = int(rng.integers(1, 6))
        rows = rng.random((200, m)) * (rng.random((200, m)) < 0.5)
        rows /= np.maximum(np.linalg.norm(rows, axis=1), 1)[:, None]
        level = np.where(rows > 0, np.minimum(np.floor(-4 * np.log2(np.maximum(rows, 1e-12))), impact.LEVELS - 1), -1).astype(int)
        n = np.array([np.bincount(level[level[:, k] >= 0, k], minlength=impact.LEVELS) for k in range(m)])
        q = rng.random(m) + 0.05
        enough = float(rng.random() * np.linalg.norm(q))
        read = impact.reading(q, n, np.zeros(m, dtype=np.int64), enough)
        unmet = ~((level >= 0) & (level < read)).any(axis=1)
        assert not unmet.any() or (rows[unmet] @ q).max() < enough


@pytest.mark.parametrize("kind, limit", [("long", 1000), ("string", 7)])
def test_lists_give_the_rows_of_the_scan(spark, monkeypatch, kind, limit):
    monkeypatch.setattr(search, "SPARSE_LIMIT", limit)
    held = table(spark, made(400, 5, signed=True) | {"copy1": made(400, 5, signed=True)["v0007"], "empty": {}})
    asks = [((k if kind == "long" else f"q{k}"), b, v) for k, x in enumerate(made(30, 6, buckets=60, signed=True).values()) for b, v in x.items()]
    asks = spark.createDataFrame(asks, f"query_id {kind}, bucket int, value double")
    lists = impact.postings(held)
    stale = lists.unionByName(spark.createDataFrame([(0, b, f"gone{b}") for b in range(40)], "level int, bucket int, name string"))
    for k in (1, 6):
        got = impact.Lists(stale, impact.sizes(stale), held).top_k(asks, k)
        assert sorted(map(tuple, got.select("query_id", "name", "score", "rank").collect())) == sorted(map(tuple, search.sparse_top_k(asks, held, k).select("query_id", "name", "score", "rank").collect()))


def test_lists_read_a_tenth_of_all_pairs(spark):
    """Rows and questions of which a few words make most: a search meets less than a tenth of the pairs that have a word in common."""
    rng = np.random.default_rng(3)
    draw = lambda n: unit({int(b): float(v) for b, v in zip(rng.choice(400, n, replace=False), rng.lognormal(0, 2.5, n), strict=True)})
    rows = table(spark, {f"v{k:05}": draw(12) for k in range(4000)})
    asks = spark.createDataFrame([(k, b, v) for k in range(20) for b, v in draw(12).items()], "query_id long, bucket int, value double")
    index = impact.Lists(impact.postings(rows), impact.sizes(impact.postings(rows)), rows)
    block = next(search.asked_blocks(asks))
    first = index.met(block, 5, 0.2)
    kth = {r.query_id: r.score for r in index.top_k(asks, 5).where("rank = 5").collect()}
    met = first.count() + index.met(block, 5, 0.2, kth).count()
    every = asks.join(rows.select("name", F.inline("vector").alias("bucket", "v")), "bucket").count()
    assert 0 < met < every / 10


def test_semantic_cache_scores_blocks_of_questions(spark, monkeypatch):
    """Hits are those of plain loops: ties, copies, modes, lengths, zeros, nulls and blocks; no pair is scored by expressions on lists."""
    import math
    from functools import reduce

    import numpy as np
    from pyspark.sql import functions as F

    from weftline.functions.vectors import quantised
    from weftline.operators import cache, search

    monkeypatch.setattr(search, "QUERY_LIMIT", 40)
    monkeypatch.setattr(search.in_blocks, "__defaults__", (40,))
    rng = np.random.default_rng(6)
    base = rng.normal(size=(30, 8))
    entries = [("ab"[k % 2], f"k{k}", f"r{k}", (base[k % 30] + (k % 3) * 0.05 * rng.normal(size=8)).tolist()) for k in range(300)]
    entries += [("a", "zero", "r", [0.0] * 8), ("a", "short", "r", [1.0, 2.0]), ("a", "null", "r", None)]
    asks = [(k, "ab"[k % 2], (base[k % 30] + (k % 4) * 0.05 * rng.normal(size=8)).tolist()) for k in range(120)]
    asks += [(200, "a", [0.0] * 8), (201, "a", [1.0, 2.0]), (202, "a", None), (203, "none", base[0].tolist()), (204, "a", [math.nan] * 8), (205, None, base[0].tolist())]
    stored = spark.createDataFrame(entries, "mode string, args_hash string, response string, e array<double>").select("mode", "args_hash", "response", quantised(F.col("e")).alias("quantised")).repartition(3)
    hits = cache.semantic_hits(spark.createDataFrame(asks, "query_id long, mode string, query array<double>"), stored)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
    got = {r.query_id: r for r in hits.collect()}

    def cosine(a, b):
        dot = lambda x, y: reduce(lambda s, p: s + p[0] * p[1], zip(x, y, strict=True), 0.0)
        return dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)))

    restored = [(m, h, r, [x * (q.high - q.low) / 255.0 + q.low for x in q.bytes]) for m, h, r, q in stored.collect() if q is not None and q.bytes]
    for key, mode, v in asks:
        fits = [(cosine(v, e), h, r) for m, h, r, e in restored if m == mode and v and len(v) == len(e) and any(v) and any(e) and not math.isnan(v[0])]
        best = max([f for f in fits if f[0] > 0.95], default=None)
        assert (key in got) == (best is not None)
        if best:
            assert got[key].response == best[2] and got[key].score == best[0]
    assert len(got) > 100


@pytest.mark.parametrize("measure", ["cosine", "dot"])
def test_dense_search_scores_where_vectors_are_read(spark, monkeypatch, measure):
    """No pair is a row of Spark; rows are those of the plain expression, by rounded scores, with ties to the lesser id."""
    from weftline.functions.vectors import cosine, dot

    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.integers(-3, 4, 6)]) for k in range(300)] + [(1000 + k, [1.0, 2.0, 0.0, 1e-12 * (k % 3), 1.0, 0.0]) for k in range(40)]
    rows += [(2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2002, [1.0]), (2003, [float("nan")] * 6), (2004, [0.0] * 6)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    asks = v.where("id % 10 = 0").toDF("query_id", "query")
    monkeypatch.setattr(search, "STEP", 400)
    score = (cosine if measure == "cosine" else dot)(F.col("query"), F.col("embedding"))
    plain = v.crossJoin(asks).select("query_id", "id", F.round(score, 9).alias("score")).where("score IS NOT NULL")
    for at_least in (None, 0.2):
        got = search.top_k(asks, v, 5, measure, at_least, digits=9)
        want = search.ranked(plain if at_least is None else plain.where(F.col("score") >= at_least), 5)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_dense_rows_make_no_entry_of_each_pair():
    """Rows and queries that hold every bucket are multiplied as matrices; wide ones are taken in parts."""
    import tracemalloc

    rng = np.random.default_rng(2)
    n, width, rows = 256, 64, 512
    q, v = rng.normal(size=(n, width)), rng.normal(size=(rows, width))
    asked = search.Asked(pa.table({"query_id": np.repeat(np.arange(n), width), "bucket": np.tile(np.arange(width), n), "value": q.ravel()}))
    tracemalloc.start()
    got = asked.scores(np.repeat(np.arange(rows), width), np.tile(np.arange(width), rows), v.ravel(), rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, v @ q.T) and most < 32 << 20
    search.STEP, before = 1000, search.STEP
    try:
        assert np.allclose(asked.scores(np.repeat(np.arange(rows), width), np.tile(np.arange(width), rows), v.ravel(), rows), v @ q.T)
    finally:
        search.STEP = before
