"""Merges, ranking and the engine: votes, ties, fusion, running an insert again."""

from pyspark.sql import functions as F

from weftline.functions import chunks, text, vectors
from weftline.operators import access, evaluation, extraction, merge
from weftline.plans import retrieval
from weftline.plans.engine import Engine
from weftline.sources.workspace import Workspace


def test_vote_collapse(spark):
    schema = "chunk_id string, pos int, entity string, entity_type string, description string"
    first = merge.merged_entities(spark.createDataFrame([("a", k, "N", "X", "d") for k in range(3)], schema))
    second = merge.merged_entities(spark.createDataFrame([("b", k, "N", "Y", "e") for k in range(2)], schema), first)
    row = second.collect()[0]
    assert (row.entity_type, row.descriptions, row.source_ids) == ("Y", ["d", "e"], ["a", "b"])


def test_fusion_counts_every_occurrence(spark):
    schema = "query_id long, knowledge string, position int"
    first = spark.createDataFrame([(1, "k", 1), (1, "k", 2), (1, "m", 3)], schema)
    second = spark.createDataFrame([(1, "m", 1)], schema)
    got = [(r.rank, r.knowledge, r.coherence) for r in retrieval.fused(first, second, 10).orderBy("rank").collect()]
    assert got == [(1, "k", 1.5), (2, "m", 1.333)]


def test_chunk_windows(spark):
    docs = spark.createDataFrame([("d", " ".join(f"w{k}" for k in range(1150))), ("e", "  "), ("f", None)], "id string, t string")
    assert sorted(r.tokens for r in chunks.windows(docs, "id", "t").collect()) == [50, 1150]


def test_scalars(spark):
    row = spark.range(1).select(
        text.normal_answer(F.lit("The  Cat, a dog!")).alias("n"),
        text.json_body(F.lit("x {'a':\n1} y")).alias("j"),
        text.split_markers(F.lit(" a ## b##"), "##").alias("s"),
        text.shortened(F.lit("abcdef"), 3).alias("d"),
        text.unicode_unescape(F.lit("\\u00e9")).alias("u"),
        vectors.quantised(F.array(F.lit(1.0), F.lit(1.0)))["bytes"].alias("q"),
        chunks.paragraphs(F.lit("a\n\nb\n\n\n\nc"), 4).alias("p"),
        text.contains_any(F.lit("It is Paris!"), F.array(F.lit("paris"))).alias("c"),
    ).first()
    assert (row.n, row.j, row.s, row.d, row.u, row.q, row.c) == ("cat dog", '{"a":1}', ["a", "b"], "abc...", "é", [0, 0], True)
    assert row.p == ["a\n\nb", "c"]


def test_scores(spark):
    rows = [("Politician and a good person.", ["Politician"]), ("By going to ball.", ["By going to the ball."]), ("New York.", ["Rockland County"])]
    got = evaluation.scores(spark.createDataFrame(rows, "prediction string, golds array<string>")).first()
    assert (got.n, round(got.em, 4), round(got.f1, 4)) == (3, 0.3333, 0.4667)


def test_components(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "a string, b string")
    assert {(r.node, r.label) for r in access.components(pairs).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    assert {(r.a, r.b) for r in access.largest_component(pairs).collect()} == {("a", "b"), ("b", "c")}


def test_engine(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "w"))
    docs = spark.createDataFrame([("The lighthouse keeper watches wonderful seabirds. Seabirds like lighthouse windows.",), ("Mountains collect snowflakes every wintertime.",)], "content string")
    engine.insert(docs)
    before = {(r.name, r.n) for r in engine.store.stats().collect()}
    weight = engine.table("facts").agg(F.sum("weight")).first()[0]
    engine.insert(docs)
    assert {(r.name, r.n) for r in engine.store.stats().collect()} == before
    assert engine.table("facts").agg(F.sum("weight")).first()[0] == weight
    asks = spark.createDataFrame([(1, "lighthouse keeper watches"), (2, "zzz")], "query_id long, text string")
    got = engine.query(asks).orderBy("query_id", "rank").collect()
    assert got[0].knowledge.startswith('"The lighthouse keeper') and {r.query_id for r in got} == {1}
    engine.delete(spark.createDataFrame([("lighthouse",)], "name string"))
    assert engine.table("edges").where("entity = '\"LIGHTHOUSE\"'").isEmpty()


def state(engine):
    """All tables' rows, as sets."""
    from weftline.plans.engine import SCHEMAS

    return {name: sorted(map(repr, engine.table(name).collect())) for name in SCHEMAS}


SENTENCES = [
    "The lighthouse keeper watches wonderful seabirds. Seabirds like lighthouse windows.",
    "Mountains collect snowflakes every wintertime. The lighthouse keeper watches wonderful seabirds.",
    "Gardeners cultivate strawberries carefully.",
]


def test_insert_is_atomic_and_repeatable(spark, tmp_path, monkeypatch):
    """A failure at any write of the second insert leaves the first's state, and the insert run again equals a clean one."""
    first = spark.createDataFrame([(SENTENCES[0],)], "content string")
    second = spark.createDataFrame([(t,) for t in SENTENCES[1:]], "content string")
    clean = Engine(spark, str(tmp_path / "clean"))
    clean.insert(first)
    before = state(clean)
    clean.insert(second)
    after = state(clean)
    real = Workspace._write
    engine = Engine(spark, str(tmp_path / "w"))
    engine.insert(first)
    for fails_at in (1, 5, 9):  # of nine tables
        seen = []

        def write(self, name, rows):
            seen.append(name)
            if len(seen) == fails_at:
                raise OSError("lost")
            return real(self, name, rows)

        monkeypatch.setattr(Workspace, "_write", write)
        try:
            engine.insert(second)
        except OSError:
            pass
        monkeypatch.setattr(Workspace, "_write", real)
        assert len(seen) == fails_at and engine.table("facts").count() == len(before["facts"]) and engine.table("docs").count() == 1
    engine.insert(second)
    assert state(engine) == after
    counted = access.node_degree(engine.table("edges"))
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, engine.table("degrees").collect()))


def test_rebuild_vacuum_and_compaction(spark, tmp_path, monkeypatch):
    from weftline.sources import workspace

    monkeypatch.setattr(workspace, "MOST_FOLDERS", 2)
    docs = lambda texts: spark.createDataFrame([(t,) for t in texts], "content string")
    engine = Engine(spark, str(tmp_path / "w"))
    for t in SENTENCES:
        engine.insert(docs([t]))
    assert max(map(len, engine.store.folders().values())) <= 2
    held = state(engine)
    engine.store.vacuum()
    assert state(engine) == held and engine.store.missing("docs", "facts", "nothing") == ["nothing"]
    assert {f for parts in engine.store.folders().values() for f in parts} == {p.name for p in (tmp_path / "w" / "tables").iterdir()}
    engine.rebuild(docs(SENTENCES))
    again = state(engine)
    assert all(again[n] == held[n] for n in ("docs", "facts", "edges", "degrees", "fact_vectors"))
    engine.rebuild(docs(SENTENCES[2:]))
    assert engine.table("docs").count() == 1 and engine.table("facts").count() == 1


def test_small_commits_leave_large_folders(spark, tmp_path, monkeypatch):
    """Thirty small commits after a large one: the large folder stays, folders stay few, rows are those of a dictionary."""
    from weftline.sources import workspace

    monkeypatch.setattr(workspace, "MOST_FOLDERS", 3)
    store, held = Workspace(spark, str(tmp_path / "w"), {"t": ("k",)}), {}
    written = []
    real = Workspace._write
    monkeypatch.setattr(Workspace, "_write", lambda self, name, rows: written.append(rows.count()) or real(self, name, rows))

    def commit(rows):
        held.update(rows)
        store.commit(append={"t": spark.createDataFrame([(k, v) for k, v in rows.items()], "k long, v string")})

    commit({k: f"{k}" * 9 for k in range(20_000)})
    large = store.folders()["t"][0]
    for n in range(12):
        commit({n * 1000 + j: f"new{n}" for j in range(20)})
        assert len(store.folders()["t"]) <= 3
    assert store.folders()["t"][0] == large and sum(written[1:]) < 20_000 / 10
    assert {r.k: r.v for r in store.read("t").collect()} == held


def test_custom_graph_and_delete(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "w"))
    engine.insert(spark.createDataFrame([(SENTENCES[0],)], "content string"))
    chunks = spark.createDataFrame([("s", "Paris is in France")], "source_id string, content string")
    entities = spark.createDataFrame([("Paris", "CITY", "a city", "s"), ("lighthouse", "ANIMAL", "a bird", "s")], "entity_name string, entity_type string, description string, source_id string")
    relations = spark.createDataFrame([("Paris", "France", "in", "place", 2.0, "s"), ("Paris", "lighthouse", "has", "life", None, None)], "src_id string, tgt_id string, description string, keywords string, weight double, source_id string")
    for _ in range(2):
        engine.insert_graph(chunks, entities, relations)
    kinds = {r.entity: (r.entity_type, r.descriptions) for r in engine.table("entities").collect()}
    assert kinds['"PARIS"'] == ("CITY", ["a city"]) and kinds['"FRANCE"'][0] == "UNKNOWN" and kinds['"LIGHTHOUSE"'][0] == "ANIMAL" and len(kinds['"LIGHTHOUSE"'][1]) > 1
    assert {(r.src, r.tgt, r.weight) for r in engine.table("kg_edges").collect()} == {('"PARIS"', '"FRANCE"', 2.0), ('"PARIS"', '"LIGHTHOUSE"', 1.0)}
    engine.delete(spark.createDataFrame([("lighthouse",), ("france",)], "name string"))
    left = {r.entity for r in engine.table("entities").collect()}
    assert not left & {'"LIGHTHOUSE"', '"FRANCE"'} and engine.table("kg_edges").count() == 0
    assert {r.name for r in engine.table("entity_vectors").collect()} == left
    assert engine.table("edges").where("entity = '\"LIGHTHOUSE\"'").isEmpty() and '"LIGHTHOUSE"' not in {r.node for r in engine.table("degrees").collect()}


def test_own_embedder(spark, tmp_path):
    """Any callable over lists of texts; vectors of a wrong shape are refused."""
    import numpy as np
    import pytest

    def letters(texts):
        return np.array([[t.lower().count(c) for c in "abcdefghij"] for t in texts], dtype=float)

    rows = spark.createDataFrame([("x", "abba"), ("y", "zz"), ("z", None)], "name string, content string")
    got = {r.name: r.embedding for r in vectors.embedded_by(rows, "name", "content", letters, 10).collect()}
    assert got["x"][:2] == [2.0, 2.0] and got["y"] == [0.0] * 10 and got["z"] == [0.0] * 10
    with pytest.raises(Exception, match="10 vectors|of 9"):
        vectors.embedded_by(rows, "name", "content", letters, 9).collect()
    sparse = lambda r: vectors.sparse_units(vectors.embedded_by(r, "name", "content", letters, 10), "name")
    engine = Engine(spark, str(tmp_path / "w"), embedder=sparse)
    engine.insert(spark.createDataFrame([(t,) for t in SENTENCES], "content string"))
    asks = spark.createDataFrame([(1, "gardeners cultivate strawberries carefully")], "query_id long, text string")
    assert engine.query(asks, retrieval.QueryParams(mode="naive", at_least=0.9)).first().knowledge == SENTENCES[2]


def test_small_operators(spark, tmp_path):
    """Operators that no registered query uses."""
    from weftline.operators import extraction, search
    from weftline.sources import corpus

    path = str(tmp_path / "c")
    rows = spark.createDataFrame([("1", "x", "t", "f", 0)], corpus.CORPUS)
    corpus.write_corpus(rows, path)
    corpus.append_corpus(rows, path)
    assert corpus.read_corpus_strict(spark, path).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"id": "1"}\nbroken\n')
    for attempt in (lambda: corpus.read_corpus_strict(spark, str(tmp_path / "bad.jsonl")).collect(), lambda: corpus.write_corpus(rows, path)):
        try:
            attempt()
        except Exception:
            continue
        raise AssertionError("accepted")
    (tmp_path / "q.json").write_text('[{"question": "a?", "golden_answers": ["b", "c"]}]')
    assert [tuple(r) for r in corpus.read_questions(spark, str(tmp_path / "q.json")).collect()] == [("a?", ["b", "c"])]
    corpus.write_questions(corpus.read_questions(spark, str(tmp_path / "q.json")), str(tmp_path / "q.parquet"))
    assert spark.read.parquet(str(tmp_path / "q.parquet")).first().golden_answers == ["b", "c"]
    corpus.write_json(rows, str(tmp_path / "dump"))
    assert spark.read.json(str(tmp_path / "dump")).first().contents == "x"
    files = spark.createDataFrame([("a.txt", b"fine"), ("a.pdf", b"x"), ("b.txt", b"\xff\xfe"), ("c.txt", b" ")], "path string, content binary")
    assert [r.error for r in corpus.valid_uploads(files).collect()] == [None, "only .txt files", "not UTF-8", "empty file"]
    table = spark.createDataFrame([("E", ["word " * 600]), ("F", ["short"])], "entity string, descriptions array<string>")
    got = {r.entity: r.description for r in merge.summarised(table, lambda c: F.left(c, F.lit(4))).collect()}
    assert got == {"E": "word", "F": "short"}
    row = spark.range(1).select(search.unit(F.array(F.lit(3.0), F.lit(4.0))).alias("u"), text.csv_line(F.lit("a,b"), F.lit(1)).alias("c"), text.args_hash(F.lit(1), F.lit("x")).alias("h"), text.args_hash(F.lit(1), F.lit("y")).alias("g"), text.parsed_json(F.lit("so {'k': 3} ok"), "k int")["k"].alias("k")).first()
    assert row.u == [0.6, 0.8] and row.c == '"a,b",1' and row.h != row.g and row.k == 3
    assert extraction.prompt("Of {kind}: {input_text}", F.lit("x"), kind="facts") is not None
    entities = spark.createDataFrame([("A", "T", "d", "s")], "id string, entity_type string, description string, source_id string")
    edges = spark.createDataFrame([("A", "B", 2.5, "d", "k", "s")], "source string, target string, weight double, description string, keywords string, source_id string")
    corpus.write_graphml(entities, edges, str(tmp_path / "g"))
    nodes, back = corpus.read_graphml(spark, str(tmp_path / "g" / "edges")), corpus.read_graphml(spark, str(tmp_path / "g" / "nodes"))
    assert [(r.source, r.target, r.weight) for r in nodes[1].collect()] == [("A", "B", 2.5)] and [tuple(r) for r in back[0].collect()] == [("A", "T", "d", "s")]


def test_search_in_blocks(spark, monkeypatch):
    from weftline.operators import search

    points = spark.createDataFrame([(k, [float(k % 7), float(k % 5), 1.0]) for k in range(60)], "id long, embedding array<double>")
    asks = points.where("id < 20").toDF("query_id", "query")
    whole = sorted(map(tuple, search.top_k(asks, points, 3, "dot").collect()))
    monkeypatch.setattr(search.in_blocks, "__defaults__", (6,))
    assert len(search.in_blocks(asks, "query_id")) == 4 and sorted(map(tuple, search.top_k(asks, points, 3, "dot").collect())) == whole and len(whole) == 60


def test_prompts(spark):
    """The examples of the extraction prompt are in the grammar that the parser reads; slots are safe against braces; keywords fall back to none."""
    from weftline.operators import context, extraction
    from weftline.plans import prompts

    template = prompts.extraction_template(examples=1)
    said = template[template.index('("hyper-relation"<|>"Mira') : template.index("<|COMPLETE|>\n\nPassage") + 12]
    rows = extraction.records(spark.createDataFrame([("c", said)], "chunk_id string, response string"))
    assert {r.entity for r in extraction.mentions(rows).collect()} == {'"MIRA"', '"OLD MILL"'} and extraction.facts(rows).first().weight == 9.0
    assert template.count("Passage:") == 2 and "{input_text}" in template and prompts.extraction_template(examples=0).count("Passage:") == 1
    row = spark.range(1).select(
        extraction.prompt(template, F.lit("a {types} b")).alias("p"),
        context.filled("{q} of {c}!", q=F.lit("{c}"), c=F.lit(None).cast("string")).alias("f"),
        extraction.keywords(F.lit('ok {"high_level_keywords": ["x"]}')).alias("k"), extraction.keywords(F.lit("none")).alias("n"),
    ).first()
    assert "a {types} b" in row.p and row.f == "{c} of !" and row.k.high_level_keywords == ["x"] and row.n.low_level_keywords == []


def test_stream(spark, tmp_path, monkeypatch):
    """A batch that fails in its last write is retried, and its documents are counted once."""
    from weftline.streaming.ingest import ingest

    engine = Engine(spark, str(tmp_path / "w"))
    source = tmp_path / "in"
    spark.createDataFrame([("Gardeners cultivate strawberries carefully.",)], "content string").write.json(str(source))
    run = lambda: ingest(spark.readStream.schema("content string").json(str(source)), engine, str(tmp_path / "cp")).awaitTermination()
    real = Workspace._write
    monkeypatch.setattr(Workspace, "_write", lambda self, name, rows: real(self, name, rows) if name != "chunk_vectors" else 1 / 0)
    try:
        run()
    except Exception:
        pass
    monkeypatch.setattr(Workspace, "_write", real)
    assert engine.table("docs").isEmpty()
    for _ in range(2):
        run()
    assert engine.table("docs").count() == 1 and engine.table("facts").count() == 1
    weight = engine.table("facts").first().weight
    once = Engine(spark, str(tmp_path / "o"))
    once.insert(spark.createDataFrame([("Gardeners cultivate strawberries carefully.",)], "content string"))
    assert once.table("facts").first().weight == weight


def test_files(spark, tmp_path):
    from weftline.sources import corpus

    path = tmp_path / "c.jsonl"
    path.write_text('{"id": "1", "contents": "x", "title": "t"}\nbroken\n{"contents": "y"}\n')
    rows = corpus.read_corpus(spark, str(path)).orderBy("contents").collect()
    assert [(r.contents, r.title == "t") for r in rows] == [("x", True), ("y", False)]
    folder = tmp_path / "d"
    folder.mkdir()
    (folder / "a.txt").write_bytes(" caf\xe9 ".encode("latin-1"))
    (folder / "b.md").write_text("ß")
    (folder / "c.bin").write_text("no")
    assert sorted(r.text for r in corpus.read_texts(spark, str(folder)).collect()) == ["café", "ß"]
    xml = tmp_path / "g.graphml"
    xml.write_text('<graphml><graph><node id="&quot;A&quot;"><data key="d0">T</data></node><edge source="&quot;A&quot;" target="B"><data key="d3">2.5</data></edge></graph></graphml>')
    nodes, edges = corpus.read_graphml(spark, str(xml))
    assert [tuple(r) for r in nodes.collect()] == [("A", "T", "", "")]
    assert [(r.source, r.target, r.weight) for r in edges.collect()] == [("A", "B", 2.5)]


def test_training_rows_of_like_conversations(spark, tmp_path):
    """One row for each question, also where two conversations ask the same in the same turn, or nothing."""
    from weftline.plans import catalog

    turns = [(1, 0, "user", "Where?"), (2, 0, "user", "Where?"), (2, 1, "assistant", "Here."), (3, 0, "user", None)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    text = "Answer from the knowledge base. Question: Where?"
    got = catalog.qa_training_rows(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, text, "0"), (2, 0, text, "0"), (3, 0, None, "0")]


def test_stable_names(spark, tmp_path):
    """Names in the query and in its SQL are Python's: letters whose upper case is two, white space, character references."""
    import html

    import duckdb

    from oracle import assert_same
    from weftline.plans import catalog

    texts = ["straße", "\u3000ﬁn\t", "a&lt;b", "&#0065;", "\\&lt;", "&#223;&#x41;&#128;&#xd800;&#9999999999;", "&", "&NOTIT; &copyx &#; &#x &&amp;lt;", "plain"]
    want = [html.unescape(t.upper().strip()) for t in texts]
    names = catalog.unescaped_sql("u")
    held = f"SELECT i, {catalog.upper_sql(f'trim(t, concat({catalog._WHITE}))')} AS u FROM rows"
    con = duckdb.connect()
    con.execute("CREATE TABLE rows (i INT, t TEXT)")
    con.executemany("INSERT INTO rows VALUES (?, ?)", list(enumerate(texts)))
    assert [r[0] for r in con.execute(f"WITH {catalog.REFERENCES}, held AS ({held}) SELECT {names} FROM held, refs ORDER BY i").fetchall()] == want
    folder = tmp_path / "t"
    folder.mkdir()
    con.execute(f"COPY (SELECT 1::BIGINT AS doc_id, 'Gardeners in der Straße. Die Straße unverändert gardeners großzügig.' AS text) TO '{folder}/documents.parquet'")
    assert_same(spark, str(folder), catalog.QUERIES["stable_component"], catalog.ORACLE_SQL["stable_component"])
    assert any("STRASSE" in r.b or "STRASSE" in r.a for r in catalog.stable_component(spark, str(folder)).collect())


def test_derived_tables_are_those_of_an_insert(spark, tmp_path):
    """Reading a part of the graph makes no more than that, and what it makes is what an insert gives."""
    import pytest

    from weftline.plans.engine import DerivedGraph

    docs = spark.createDataFrame([("Gardeners cultivate strawberries carefully. Gardeners whistle.",), ("Strawberries disappear overnight!",), ("Strawberries disappear overnight! ",), (" ",), (None,)], "content string")
    whole, part = Engine(spark, str(tmp_path / "w"), cells=0), Engine(spark, str(tmp_path / "p"), cells=0)
    whole.insert(docs.where("content IS NOT NULL"))
    graph = DerivedGraph(part, docs.where("content IS NOT NULL"))
    assert graph.entities.count() == 6
    assert set(part.store.folders()) == {"docs", "chunks", "records", "mentions", "entities"}
    for name in ("entities", "facts", "edges", "chunks", "degrees", "entity_vectors", "fact_vectors", "chunk_vectors"):
        rows = lambda df: sorted(map(str, df.drop("cell").collect()))
        assert rows(getattr(graph, name)) == rows(whole.table(name)), name
    assert part.cells_of("fact_vectors") == (None, 0) and len(graph.indexes["entity"].cells.centres) == len(whole.cells_of("entity_vectors")[0].centres)
    with pytest.raises(ValueError):
        part.insert(docs)


def test_vectors_of_texts_by_themselves(spark):
    """The vectors are bit by bit those of the embedder's rows; texts without a word have none."""
    texts = ["One one  two", "", None, " \t\n", "É é ẞ x y", "a\x0bb\x1cc", "z " * 5000, "w"]
    rows = spark.createDataFrame([(f"n{k}", t) for k, t in enumerate(texts)], "name string, content string")
    got = {r.name: r.vector for r in vectors.hashed_vectors(rows, "name", "content").collect()}
    assert got == {r.name: r.vector for r in vectors.gathered(vectors.embedded(rows, "name", "content")).collect()} and len(got) == 5


def test_strip(spark):
    texts = ["　a b ", "\x85\xa0", "", "x", " \x1c\ty\x0b\r\n", "​ z ᠎"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    assert [r[0] for r in rows.orderBy("k").select(text.strip(F.col("t"))).collect()] == [t.strip() for t in texts]


def test_statements_are_the_records_facts_and_mentions(spark):
    """A response read by itself gives what its records give by windows over all rows, stray records and references included."""
    texts = [
        '("entity"<|>"early"<|>"t"<|>"d"<|>5)##("hyper-relation"<|>"A &amp; b"<|>7)##("entity"<|>"x&AMP;y"<|>"term"<|>"d1"<|>3.5)##noise##("entity"<|>" "<|>"t"<|>"d"<|>1)##("entity"<|>"z"<|>"t"<|>"d2"<|>bad)<|COMPLETE|>',
        '("hyper-relation"<|>"one"<|>x)##("hyper-relation"<|>"two"<|>2)##("entity"<|>"w"<|>"t"<|>1)##("entity"<|>"w"<|>"t"<|>"d"<|>4)', "", "nothing", None, '("entity"<|>"lone"<|>"t"<|>"d"<|>5)',
    ]
    said = spark.createDataFrame([(f"c{k}", t) for k, t in enumerate(texts)], "chunk_id string, response string")
    rows, got = extraction.records(said), extraction.statements(said)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect())) and a.count() > 2
    assert same(extraction.facts(rows), got)
    mentions = extraction.mentions(rows)
    inlined = got.select("chunk_id", F.col("fact"), F.inline("named"))
    assert same(mentions, inlined)
    assert same(merge.merged_edges(mentions), merge.edges_of_statements(got))
    plan = got._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_stored_rows_leave_no_shuffle_files(spark, tmp_path):
    """What a table was shuffled by is gone when it is written, and the session's own setting stays."""
    import glob
    import os

    jvm = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    kept = lambda: {os.path.basename(f) for d in jvm.localDirs() for f in glob.glob(f"{d.getPath()}/*/shuffle_*.data")}
    before = kept()
    access.saved(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count(), str(tmp_path / "t"))
    assert kept() <= before and spark.conf.get(access.CLEANED, "false") == "false"


def test_components_of_ends_that_are_apart(spark):
    """The largest component by links among one side's nodes alone is that of the whole graph, ties by the least node of both sides included."""
    import random

    r = random.Random(3)
    for rows in (sorted({(f"{r.choice('AZ')}f{r.randrange(30)}", f"Me{r.randrange(30)}") for _ in range(26)}), [("Zf1", "Me1"), ("Af2", "Me2"), ("Bf3", "Me0")]):
        pairs = spark.createDataFrame(rows, "a string, b string")
        want = sorted(access.largest_component(pairs).collect())
        assert want and sorted(access.largest_component(pairs, apart=True).collect()) == want
        assert sorted(access.stable_component(pairs).collect()) == access.stable_component(pairs, apart=True).collect()
