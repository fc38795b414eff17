"""Registered queries of the graph engine, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import chunks as ch
from weftline.functions import subwords
from weftline.functions import text as tx
from weftline.functions import vectors as vx
from weftline.operators import access, cache, cells, context, evaluation, extraction, impact, merge, resolution, search, walks
from weftline.plans import prompts, retrieval
from weftline.plans.engine import DerivedGraph, Engine

SIZE, OVERLAP = 120, 10
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.distinct_chunks(ch.windows(read(spark, sf_dir, "documents"), "doc_id", "text", SIZE, OVERLAP))


def record_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.records(extraction.rule_responses(chunk_table(spark, sf_dir)))


def graph_of(spark: SparkSession, sf_dir: str) -> DerivedGraph:
    """The graph of ``documents`` in a workspace of the session: each table is made when a query first reads it, and kept for later ones."""
    folder = zlib.crc32(f"{sf_dir}/{spark.sparkContext.applicationId}".encode())
    engine = Engine(spark, f"{access.scratch(spark)}/weftline-graph-{folder}", SIZE, OVERLAP, cells=0)
    return DerivedGraph(engine, read(spark, sf_dir, "documents").select(F.col("text").alias("content")))


def built(spark: SparkSession, sf_dir: str) -> DerivedGraph:
    """``graph_of`` with all its tables and indexes made."""
    graph = graph_of(spark, sf_dir)
    for name in ("entities", "facts", "edges", "chunks", "degrees"):
        getattr(graph, name)
    for kind in ("entity", "fact", "chunk"):
        graph.indexes[kind]
    return graph


CHUNKS = r"""
words AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda t: t <> '') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(0, len(w), 110)) AS s FROM words WHERE len(w) > 0),
every_chunk AS (SELECT doc_id AS full_doc_id, (s // 110)::INT AS chunk_order_index, len(list_slice(w, s + 1, s + 120))::INT AS tokens,
  array_to_string(list_slice(w, s + 1, s + 120), ' ') AS content FROM places),
chunks AS (SELECT 'chunk-' || md5(content) AS chunk_id, arg_max(full_doc_id, (full_doc_id, chunk_order_index)) AS full_doc_id,
  arg_max(chunk_order_index, (full_doc_id, chunk_order_index)) AS chunk_order_index, max(tokens) AS tokens, content FROM every_chunk GROUP BY content)
"""
MENTIONS = CHUNKS + r""",
said AS (SELECT chunk_id, list_filter(list_transform(regexp_extract_all(translate(regexp_replace(content, '\s+', ' ', 'g'), '#<>|"()', ''), '[^.!?]+[.!?]*'), lambda x: trim(x)), lambda x: x <> '') AS ss FROM chunks),
sentences AS (SELECT chunk_id, unnest(ss) AS s, unnest(range(1, len(ss) + 1)) AS i FROM said),
facts_raw AS (SELECT chunk_id, i, s, '<bipartite_edge>"' || s || '"' AS fact, length(s) % 10 + 1.0 AS weight FROM sentences),
mentions AS (SELECT chunk_id, i, fact, '"' || upper(w) || '"' AS entity, '"' || left(s, 40) || '"' AS description, least(length(w) * 5, 100)::DOUBLE AS weight
  FROM (SELECT *, unnest(list_distinct(regexp_extract_all(lower(s), '[a-z]{9,}'))) AS w FROM facts_raw)),
facts AS (SELECT fact, sum(weight) AS weight, list_sort(list_distinct(list(chunk_id))) AS source_ids FROM facts_raw GROUP BY fact),
entities AS (SELECT entity, list_sort(list_distinct(list(description))) AS descriptions, list_sort(list_distinct(list(chunk_id))) AS source_ids FROM mentions GROUP BY entity),
edges AS (SELECT fact, entity, sum(weight) AS weight, min((chunk_id, i)) AS seq, list_sort(list_distinct(list(chunk_id))) AS source_ids FROM mentions GROUP BY fact, entity),
ends AS (SELECT fact AS node, entity AS other FROM edges UNION ALL SELECT entity, fact FROM edges),
degrees AS (SELECT node, count(*) AS degree FROM ends GROUP BY node)
"""


def embed_sql(name: str, key: str, source: str, text: str) -> str:
    return f"""
{name}_counts AS (SELECT {key}, ('0x' || left(md5(t), 8))::BIGINT % 1024 AS bucket, count(*)::DOUBLE AS n
  FROM (SELECT {key}, unnest(list_filter(string_split_regex(lower({text}), '\\s+'), lambda t: t <> '')) AS t FROM {source}) GROUP BY ALL),
{name} AS (SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS value FROM {name}_counts)"""


def hits_sql(name: str, vectors: str, key: str) -> str:
    return f"""
{name} AS (SELECT * FROM (SELECT query_id, {key}, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS rank FROM (
  SELECT q.query_id, v.{key}, round(sum(q.value * v.value), 9) AS score FROM qv q JOIN {vectors} v ON q.bucket = v.bucket GROUP BY ALL) WHERE score >= 0.2) WHERE rank <= 60)"""


PATHS = (
    "questions AS (SELECT item_id AS query_id, text FROM benchmark),"
    + embed_sql("qv", "query_id", "questions", "text")
    + ","
    + embed_sql("ev", "entity", "entities", "replace(entity, '\"', '') || ' ' || array_to_string(descriptions, ' ')")
    + ","
    + embed_sql("fv", "fact", "facts", "replace(replace(fact, '<bipartite_edge>', ''), '\"', '')")
    + ","
    + hits_sql("eh", "ev", "entity")
    + ","
    + hits_sql("fh", "fv", "fact")
    + """,
local_path AS (SELECT query_id, replace(fact, '<bipartite_edge>', '') AS knowledge, row_number() OVER (PARTITION BY query_id ORDER BY a.degree + b.degree DESC, weight DESC, rank, seq, fact) AS position
  FROM eh JOIN edges e USING (entity) JOIN degrees a ON a.node = e.entity JOIN degrees b ON b.node = e.fact),
global_path AS (SELECT query_id, replace(fact, '<bipartite_edge>', '') AS knowledge, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, rank) AS position FROM fh JOIN facts USING (fact))
"""
)


def fused_sql(*paths: str) -> str:
    both = " UNION ALL ".join(f"SELECT query_id, knowledge, position, {k} AS path FROM {p}" for k, p in enumerate(paths))
    return f"""SELECT query_id, rank::INT AS rank, knowledge, round(score, 3) AS coherence FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS rank FROM (
    SELECT query_id, knowledge, round(sum(1.0::DOUBLE / position), 9) AS score, min((path, position)) AS seen FROM ({both}) GROUP BY query_id, knowledge)) WHERE rank <= 60"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def answers(mode: str):
    return lambda spark, sf_dir: retrieval.answer(graph_of(spark, sf_dir), asked(spark, sf_dir), retrieval.QueryParams(mode=mode))


for _name, _mode, _sql in (
    ("rrf_fusion", "hybrid", f"WITH {MENTIONS}, {PATHS} " + fused_sql("local_path", "global_path")),
    ("mode_local", "local", f"WITH {MENTIONS}, {PATHS} " + fused_sql("local_path")),
    ("mode_global", "global", f"WITH {MENTIONS}, {PATHS} " + fused_sql("global_path")),
    (
        "mode_naive", "naive",
        f"WITH {CHUNKS}, questions AS (SELECT item_id AS query_id, text FROM benchmark), {embed_sql('qv', 'query_id', 'questions', 'text')}, {embed_sql('cv', 'chunk_id', 'chunks', 'content')}, {hits_sql('hits', 'cv', 'chunk_id')}, path AS (SELECT query_id, content AS knowledge, rank AS position FROM hits JOIN chunks USING (chunk_id)) " + fused_sql("path"),
    ),
):
    QUERIES[_name], ORACLE_SQL[_name] = answers(_mode), _sql


@query(f"WITH {MENTIONS}, {PATHS}, nearest AS (SELECT query_id, fact, max(score) AS score FROM eh JOIN edges USING (entity) GROUP BY ALL), path AS (SELECT query_id, replace(fact, '<bipartite_edge>', '') AS knowledge, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact) AS position FROM nearest) " + fused_sql("path"))
def mode_local_max_score(spark, sf_dir):
    """Q1 where a fact has the score of its nearest entity."""
    return retrieval.answer(graph_of(spark, sf_dir), asked(spark, sf_dir), retrieval.QueryParams(mode="local", entity_path="max_score"))


@query("SELECT doc_id, 'doc-' || md5(trim(text, chr(32) || chr(10) || chr(9) || chr(13))) AS doc_key, 'doc-' || left(md5(text), 16) AS short_id FROM documents")
def doc_ids(spark, sf_dir):
    text = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", tx.hash_id(tx.strip(text), "doc-").alias("doc_key"), tx.short_doc_id(text, "doc").alias("short_id"))


@query("SELECT 'doc-' || md5(trim(text, chr(32) || chr(10) || chr(9) || chr(13))) AS doc_key, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def doc_hash_dedup(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(tx.hash_id(tx.strip(F.col("text")), "doc-").alias("doc_key")).agg(F.min("doc_id").alias("doc_id"))


@query("SELECT doc_id FROM documents d WHERE doc_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM documents o WHERE o.doc_id % 2 = 1 AND o.text = d.text)")
def new_doc_filter(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("key"))
    return merge.new_keys(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "key").select("doc_id")


@query(f"WITH {CHUNKS} SELECT full_doc_id, chunk_order_index, tokens, 'chunk-' || md5(content) AS chunk_id FROM every_chunk")
def chunk_windows(spark, sf_dir):
    return ch.windows(read(spark, sf_dir, "documents"), "doc_id", "text", SIZE, OVERLAP).drop("content")


@query(f"WITH {CHUNKS} SELECT chunk_id, full_doc_id, chunk_order_index, tokens FROM chunks")
def chunk_merge(spark, sf_dir):
    return chunk_table(spark, sf_dir).drop("content")


@query(r"""
WITH marked AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(text, chr(32) || chr(10) || chr(9) || chr(13)), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '') AS s FROM documents)
SELECT doc_id, (k // 10)::INT AS part, array_to_string(list_slice(s, k + 1, k + 10), ' ') AS content FROM (SELECT doc_id, s, unnest(range(0, len(s), 10)) AS k FROM marked)""")
def sentence_groups(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(ch.sentences(F.col("text"), 10)).alias("part", "content"))


@query("""
WITH marks AS (SELECT chr(32) || chr(9) || chr(10) || chr(13) AS w),
parts AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, w)), lambda x: x <> '') AS p FROM documents, marks),
packed AS (SELECT doc_id, list_reduce(p, lambda acc, x: acc[1:len(acc) - 1] || CASE WHEN length(acc[len(acc)] || x) + 2 >= 100 THEN [trim(acc[len(acc)] || x), ''] ELSE [acc[len(acc)] || x || chr(10) || chr(10)] END, ['']) AS out FROM parts),
done AS (SELECT doc_id, list_filter(list_transform(out, lambda x: trim(x, w)), lambda x: x <> '') AS out FROM packed, marks)
SELECT doc_id, unnest(range(len(out)))::INT AS part, unnest(out) AS content FROM done""")
def paragraph_pack(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(ch.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")), 100)).alias("part", "content"))


@query()
def clean_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", tx.clean(F.col("html")).alias("text"))


@query("SELECT event_id, trim(regexp_extract('so: ' || props || ' ok', '(?s)\\{.*\\}')) AS body FROM events")
def json_body(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", tx.json_body(F.concat(F.lit("so: "), "props", F.lit(" ok"))).alias("body"))


@query(f"WITH {MENTIONS} SELECT chunk_id, fact, weight FROM facts_raw")
def parse_records(spark, sf_dir):
    return extraction.facts(record_table(spark, sf_dir)).drop("pos")


@query(f"WITH {MENTIONS} SELECT chunk_id, fact, entity, '\"TERM\"' AS entity_type, description, weight FROM mentions")
def bind_entities(spark, sf_dir):
    return extraction.mentions(record_table(spark, sf_dir)).drop("pos")


@query(f"WITH {MENTIONS} SELECT fact, weight, array_to_string(source_ids, ',') AS sources FROM facts")
def fact_merge(spark, sf_dir):
    return graph_of(spark, sf_dir).facts.select("fact", "weight", F.array_join("source_ids", ",").alias("sources"))


@query(f"WITH {MENTIONS} SELECT entity, '\"TERM\"' AS entity_type, array_to_string(descriptions, '<SEP>') AS description, array_to_string(source_ids, ',') AS sources FROM entities")
def entity_merge(spark, sf_dir):
    return graph_of(spark, sf_dir).entities.select("entity", "entity_type", F.array_join("descriptions", "<SEP>").alias("description"), F.array_join("source_ids", ",").alias("sources"))


@query(f"WITH {MENTIONS} SELECT fact, entity, weight, array_to_string(source_ids, ',') AS sources FROM edges")
def edge_merge(spark, sf_dir):
    return graph_of(spark, sf_dir).edges.select("fact", "entity", "weight", F.array_join("source_ids", ",").alias("sources"))


@query(f"WITH {MENTIONS} SELECT fact, weight, array_to_string(source_ids, ',') AS sources FROM facts")
def incremental_merge(spark, sf_dir):
    """Two halves of the chunks, the second merged into the first's state, give the facts of all."""
    facts = extraction.facts(record_table(spark, sf_dir))
    half = F.crc32("chunk_id") % 2
    state = merge.merged_facts(facts.where(half == 0))
    return merge.merged_facts(facts.where(half == 1), state).select("fact", "weight", F.array_join("source_ids", ",").alias("sources"))


@query(f"WITH {MENTIONS} SELECT node, degree FROM degrees")
def node_degree(spark, sf_dir):
    return access.node_degree(graph_of(spark, sf_dir).edges)


@query(f"WITH {MENTIONS} SELECT node, degree FROM degrees")
def stored_degrees(spark, sf_dir):
    """The degrees that the insert has kept."""
    return graph_of(spark, sf_dir).degrees


@query(f"WITH {MENTIONS}, {PATHS} SELECT entity AS name, count(*) AS n_buckets, round(sum(value * value), 6) AS squares, sum(bucket)::BIGINT AS buckets FROM ev GROUP BY entity")
def vector_upsert(spark, sf_dir):
    """The entities' stored vectors after two inserts, the second of which touches entities of the first."""
    folder = f"{access.scratch(spark)}/weftline-twice-{uuid.uuid4().hex}"
    engine, docs = Engine(spark, folder, SIZE, OVERLAP, embeds=("entity",)), read(spark, sf_dir, "documents")
    half = F.crc32(F.coalesce("text", F.lit(""))) % 2
    for k in (0, 1):
        engine.insert(docs.where(half == k).select(F.col("text").alias("content")))
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x["value"] * x["value"])
    return engine.table("entity_vectors").select("name", F.size("vector").cast("long").alias("n_buckets"), F.round(squares, 6).alias("squares"), F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x["bucket"]).alias("buckets"))


@query(f"WITH {MENTIONS} SELECT e.fact, e.entity, a.degree + b.degree AS degree FROM edges e JOIN degrees a ON a.node = e.fact JOIN degrees b ON b.node = e.entity")
def edge_degree(spark, sf_dir):
    return access.edge_degree(graph_of(spark, sf_dir).edges)


@query(f"WITH {MENTIONS} SELECT n.entity AS node, e.other FROM entities n LEFT JOIN ends e ON e.node = n.entity")
def incident_edges(spark, sf_dir):
    graph = graph_of(spark, sf_dir)
    return access.incident_edges(graph.entities.select(F.col("entity").alias("node")), graph.edges)


@query(f"WITH {MENTIONS}, {PATHS} SELECT query_id, entity, fact, a.degree + b.degree AS degree, weight FROM eh JOIN edges e USING (entity) JOIN degrees a ON a.node = e.entity JOIN degrees b ON b.node = e.fact")
def related_edges(spark, sf_dir):
    graph = graph_of(spark, sf_dir)
    return access.related_edges(_seeds(spark, sf_dir, graph, "entity"), graph.edges).drop("rank")


_TOP = "SELECT query_id, id, score, rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, round({0}, 9) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({0}, 9) DESC, v.vec_id)::INT AS rank FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0 {1}) WHERE rank <= 20"
_DOT = "list_sum(list_transform(list_zip(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), lambda p: p[1] * p[2]))"
_COS = f"({_DOT} / (sqrt(list_sum(list_transform(q.embedding::DOUBLE[], lambda x: x * x))) * sqrt(list_sum(list_transform(v.embedding::DOUBLE[], lambda x: x * x)))))"


def _search(spark, sf_dir, measure, k=20, at_least=None):
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    return search.top_k(q, v, k, measure, at_least, digits=9)


@query(_TOP.format(_COS, ""))
def vector_topk_cosine(spark, sf_dir):
    return _search(spark, sf_dir, "cosine")


@query(_TOP.format(_DOT, ""))
def vector_topk_dot(spark, sf_dir):
    return _search(spark, sf_dir, "dot")


@query(_TOP.format(_COS, f"AND {_COS} >= 0.2"))
def vector_radius(spark, sf_dir):
    return _search(spark, sf_dir, "cosine", at_least=0.2)


@query("""
WITH v AS (SELECT vec_id, list_min(embedding)::DOUBLE AS low, list_max(embedding)::DOUBLE AS high, embedding::DOUBLE[] AS e FROM embeddings)
SELECT vec_id, low, high, list_sum(list_transform(e, lambda x: round_even((x - low) * (255.0::DOUBLE / (high - low)), 0)))::BIGINT AS total FROM v""")
def quantize_roundtrip(spark, sf_dir):
    q = read(spark, sf_dir, "embeddings").select("vec_id", vx.quantised(F.col("embedding")).alias("q"))
    return q.select("vec_id", "q.low", "q.high", F.aggregate("q.bytes", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("SELECT vec_id AS query_id, 'answer ' || vec_id AS response FROM embeddings WHERE vec_id % 10 = 0")
def semantic_cache(spark, sf_dir):
    """Every tenth vector asks a cache that holds them all; each finds its own entry."""
    v = read(spark, sf_dir, "embeddings")
    entries = v.select(F.lit("hybrid").alias("mode"), F.col("vec_id").cast("string").alias("args_hash"), F.concat(F.lit("answer "), "vec_id").alias("response"), "embedding")
    empty = entries.limit(0).select("mode", "args_hash", "response", vx.quantised(F.col("embedding")).alias("quantised"))
    asks = v.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.lit("hybrid").alias("mode"), F.col("embedding").alias("query"))
    return cache.semantic_hits(asks, cache.written(empty, entries)).select("query_id", "response")


@query("SELECT doc_id, source, used FROM (SELECT doc_id, source, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS used FROM documents) WHERE used <= 40000")
def token_budget(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("n"))
    return context.within_budget(docs, "source", "doc_id", F.col("n"), 40000).select("doc_id", "source", "used")


_UNIT_SQL = f"WITH {MENTIONS}, {PATHS}, around AS (SELECT e.entity, u.chunk_id, count(*) AS n FROM edges e JOIN (SELECT fact, unnest(source_ids) AS chunk_id FROM facts) u USING (fact) GROUP BY ALL) SELECT query_id, chunk_id, min(rank)::INT AS seed_rank, sum(coalesce(n, 0))::BIGINT AS relation_counts FROM eh JOIN (SELECT entity, unnest(source_ids) AS chunk_id FROM entities) USING (entity) LEFT JOIN around USING (entity, chunk_id) GROUP BY query_id, chunk_id"


def _seeds(spark, sf_dir, graph, kind):
    stored = graph.entity_vectors if kind == "entity" else graph.fact_vectors
    hits = search.sparse_top_k(graph.asked(asked(spark, sf_dir)), stored, 60)
    return hits.select("query_id", F.col("name").alias(kind), F.col("rank").alias("seed_rank"))


@query(_UNIT_SQL)
def text_units_from_entities(spark, sf_dir):
    graph = graph_of(spark, sf_dir)
    return access.text_units_from_entities(_seeds(spark, sf_dir, graph, "entity"), graph.entities, graph.edges, graph.facts)


@query(f"WITH {MENTIONS}, {PATHS} SELECT query_id, chunk_id, min(rank)::INT AS seed_rank FROM fh JOIN (SELECT fact, unnest(source_ids) AS chunk_id FROM facts) USING (fact) GROUP BY ALL")
def text_units_from_facts(spark, sf_dir):
    graph = graph_of(spark, sf_dir)
    return access.text_units_from_facts(_seeds(spark, sf_dir, graph, "fact"), graph.facts)


@query(f"WITH {MENTIONS}, {PATHS}, near AS (SELECT query_id, entity, min(rank)::INT AS seed_rank FROM fh JOIN edges USING (fact) GROUP BY ALL) SELECT query_id, entity, seed_rank, degree FROM near JOIN degrees ON node = entity")
def entities_from_facts(spark, sf_dir):
    graph = graph_of(spark, sf_dir)
    return access.entities_from_facts(_seeds(spark, sf_dir, graph, "fact"), graph.edges)


_LARGEST = f"""WITH RECURSIVE {MENTIONS},
labels(node, label) USING KEY (node) AS (SELECT DISTINCT node, node AS label FROM ends
  UNION SELECT e.other, min(l.label) FROM labels l JOIN ends e ON e.node = l.node JOIN recurring.labels r ON r.node = e.other WHERE l.label < r.label GROUP BY e.other),
top AS (SELECT label FROM labels GROUP BY label ORDER BY count(*) DESC, label LIMIT 1),
kept AS (SELECT DISTINCT least(fact, entity) AS a, greatest(fact, entity) AS b FROM edges JOIN labels ON node = fact WHERE label IN (SELECT label FROM top))"""


@query(_LARGEST + " SELECT a, b FROM kept")
def largest_component(spark, sf_dir):
    edges = graph_of(spark, sf_dir).edges
    return access.largest_component(edges.select(F.col("fact").alias("a"), F.col("entity").alias("b")), apart=True)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _map_sql(pairs: dict) -> str:
    return f"map([{', '.join(map(str, pairs))}], [{', '.join(map(_quoted, pairs.values()))}])"


#: One row: HTML's names, and the numbers that stand for other characters.
REFERENCES = f"refs AS (SELECT {_map_sql({_quoted(k): v for k, v in html5.items()})} AS names, {_map_sql({f'{k}::BIGINT': v for k, v in tx._ODD.items()})} AS odd)"


def upper_sql(text: str) -> str:
    """Upper case where one letter may give several, as ``ß`` does; DuckDB's own maps letters one to one."""
    for c in (chr(k) for k in range(0x110000) if len(chr(k).upper()) > 1):
        text = f"replace({text}, '{c}', '{c.upper()}')"
    return f"upper({text})"


def unescaped_sql(text: str) -> str:
    """``text.unescaped`` beside a row of ``refs``."""
    let = lambda name, value, body: f"list_transform([{value}], lambda {name}: {body})[1]"
    number = let("bare", r"regexp_replace(regexp_extract(said, '^#[xX]?([0-9a-fA-F]+)', 1), '^0+(.)', '\1')", let(
        "code", "CASE WHEN length(bare) > 9 THEN 2147483648 WHEN regexp_matches(said, '^#[xX]') THEN try_cast('0x' || bare AS BIGINT) ELSE try_cast(bare AS BIGINT) END",
        "coalesce(odd[code], CASE WHEN code BETWEEN 55296 AND 57343 OR code > 1114111 THEN chr(65533) ELSE chr(code::INT) END)"))
    name = let("known", "list_filter(list_transform(range(length(said), 1, -1), lambda n: {'n': n, 'c': names[left(said, n)]}), lambda t: t.c IS NOT NULL)[1]", "coalesce(known.c || substr(said, known.n + 1), '&' || said)")
    said = r"regexp_extract(part, '^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)', 1)"
    part = let("said", said, f"(CASE WHEN said = '' THEN '&' WHEN starts_with(said, '#') THEN {number} ELSE {name} END) || substr(part, length(said) + 1)")
    return f"CASE WHEN contains({text}, '&') THEN string_split({text}, '&')[1] || array_to_string(list_transform(string_split({text}, '&')[2:], lambda part: {part}), '') ELSE {text} END"


_WHITE = ", ".join(f"chr({k})" for k in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_STABLE = f"""{REFERENCES},
upper_names AS (SELECT {upper_sql(f"trim(a, concat({_WHITE}))")} AS a, {upper_sql(f"trim(b, concat({_WHITE}))")} AS b FROM kept),
named AS (SELECT {unescaped_sql('a')} AS x, {unescaped_sql('b')} AS y FROM upper_names, refs)"""


@query(_LARGEST + f", {_STABLE} SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM named")
def stable_component(spark, sf_dir):
    edges = graph_of(spark, sf_dir).edges
    return access.stable_component(edges.select(F.col("fact").alias("a"), F.col("entity").alias("b")), apart=True)


@query()
def walk_embeddings(spark, sf_dir):
    """Two walks of six nodes from every node of the graph."""
    edges = graph_of(spark, sf_dir).edges.select(F.col("fact").alias("a"), F.col("entity").alias("b"), "weight")
    return walks.embeddings(edges, 32, 2, 6)


@query(f"WITH {MENTIONS} SELECT entity, string_agg(content, chr(10) ORDER BY chunk_id) AS content FROM (SELECT entity, unnest(source_ids) AS chunk_id FROM entities) LEFT JOIN chunks USING (chunk_id) GROUP BY entity")
def nodes_with_content(spark, sf_dir):
    graph = graph_of(spark, sf_dir)
    return access.with_content(graph.entities, graph.chunks, "entity")


@query(f"WITH {MENTIONS} SELECT fact, entity, string_agg(content, chr(10) ORDER BY chunk_id) AS content FROM (SELECT fact, entity, unnest(source_ids) AS chunk_id FROM edges) LEFT JOIN chunks USING (chunk_id) GROUP BY ALL")
def edges_with_content(spark, sf_dir):
    """D10."""
    graph = graph_of(spark, sf_dir)
    return access.with_content(graph.edges, graph.chunks, "fact", "entity")


@query(f"WITH {MENTIONS}, latest AS (SELECT * FROM facts ORDER BY weight DESC, fact LIMIT 40) SELECT fact, string_agg(content, chr(10) ORDER BY chunk_id) AS content FROM (SELECT fact, unnest(source_ids) AS chunk_id FROM latest) LEFT JOIN chunks USING (chunk_id) GROUP BY ALL")
def latest_with_content(spark, sf_dir):
    """D9 with its limit: the 40 facts that come first by a column."""
    graph = graph_of(spark, sf_dir)
    return access.with_content(graph.facts, graph.chunks, "fact", latest=40, by="weight")


@query(f"WITH {MENTIONS} SELECT (SELECT count(*) FROM entities) AS n_entities, (SELECT count(*) FROM facts) AS n_facts, (SELECT count(*) FROM edges) AS n_edges")
def graph_stats(spark, sf_dir):
    graph = graph_of(spark, sf_dir)
    nodes = graph.entities.select(F.lit("node").alias("type"), F.col("entity").alias("id")).union(graph.facts.select(F.lit("fact"), "fact")).union(graph.edges.select(F.lit("edge"), F.concat_ws("\x1f", "fact", "entity"))).distinct()
    one = lambda t: F.count(F.when(F.col("type") == t, F.col("id")))
    return nodes.agg(one("node").alias("n_entities"), one("fact").alias("n_facts"), one("edge").alias("n_edges"))


# Every order is stored, new, or both.
_SPLIT = "o_orderkey % 2 <> 0 OR o_orderkey % 3 = 0"


def _halves(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    old, new = orders.where(_SPLIT), orders.where("o_orderkey % 2 = 0")
    return old, new.withColumns({"o_orderstatus": F.lit("N"), "o_totalprice": F.when(F.col("o_orderkey") % 4 == 0, F.col("o_totalprice") + 1)})


_HALVES_SQL = f"WITH old AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE {_SPLIT}), new AS (SELECT o_orderkey, 'N' AS o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice + 1 END AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0) "


@query(_HALVES_SQL + "SELECT * FROM old UNION ALL SELECT * FROM new WHERE o_orderkey NOT IN (SELECT o_orderkey FROM old)")
def upsert_absent(spark, sf_dir):
    return merge.insert_absent(*_halves(spark, sf_dir), "o_orderkey")


@query(_HALVES_SQL + "SELECT * FROM new UNION ALL SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)")
def upsert_replace(spark, sf_dir):
    return merge.replace_rows(*_halves(spark, sf_dir), "o_orderkey")


@query(_HALVES_SQL + "SELECT o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice FROM old o FULL JOIN new n USING (o_orderkey)")
def upsert_merge(spark, sf_dir):
    return merge.merge_attributes(*_halves(spark, sf_dir), "o_orderkey")


@query(f"WITH {MENTIONS} SELECT fact, entity, weight FROM edges WHERE left(entity, 2) <> '\"A'")
def delete_entity(spark, sf_dir):
    """Every entity that starts with A goes, with its edges."""
    graph = graph_of(spark, sf_dir)
    names = graph.entities.select(F.regexp_replace("entity", '"', "").alias("name")).where("name LIKE 'A%'")
    return merge.delete_entity(graph.entities, graph.edges, names)[1].select("fact", "entity", "weight")


@query(f"WITH {MENTIONS}, left_over AS (SELECT * FROM edges WHERE left(entity, 2) <> '\"A') SELECT node, count(*) AS degree FROM (SELECT fact AS node FROM left_over UNION ALL SELECT entity FROM left_over) GROUP BY node UNION ALL SELECT entity, -1 FROM entities WHERE left(entity, 2) <> '\"A'")
def delete_entity_nodes(spark, sf_dir):
    """Degrees of what is left, and the entities that are left (-1)."""
    graph = graph_of(spark, sf_dir)
    names = graph.entities.select(F.regexp_replace("entity", '"', "").alias("name")).where("name LIKE 'A%'")
    entities, edges = merge.delete_entity(graph.entities, graph.edges, names)
    return access.node_degree(edges).union(entities.select("entity", F.lit(-1).cast("long")))


@query("""
WITH mentions AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS chunk, lang AS entity, source AS type, left(text, 12) AS description, doc_id % 2 AS half FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL),
first_votes AS (SELECT entity, type, count(*) AS n, min(chunk) AS seen FROM mentions WHERE half = 0 GROUP BY ALL),
stored AS (SELECT entity, arg_min(type, (-n, seen)) AS type FROM first_votes GROUP BY entity),
votes AS (SELECT entity, type, sum(n) AS n, min(seen) AS seen FROM (SELECT entity, type, count(*) AS n, min((0, chunk)) AS seen FROM mentions WHERE half = 1 GROUP BY ALL UNION ALL SELECT entity, type, 1, (1, '') FROM stored) GROUP BY ALL)
SELECT entity, entity_type, n_descriptions, n_sources FROM (SELECT entity, arg_min(type, (-n, seen)) AS entity_type FROM votes GROUP BY entity)
JOIN (SELECT entity, count(DISTINCT '"' || description) AS n_descriptions, count(DISTINCT chunk) AS n_sources FROM mentions GROUP BY entity) USING (entity)""")
def entity_vote(spark, sf_dir):
    """Types by votes over two merges, where the stored type has one; languages stand for entities, sources for types."""
    docs = read(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL")
    mentions = docs.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("chunk_id"), F.lit(0).alias("pos"), F.col("lang").alias("entity"), F.col("source").alias("entity_type"), F.left("text", F.lit(12)).alias("description"), (F.col("doc_id") % 2).alias("half"))
    state = merge.merged_entities(mentions.where("half = 0"))
    merged = merge.merged_entities(mentions.where("half = 1"), state)
    return merged.select("entity", "entity_type", F.size("descriptions").cast("long").alias("n_descriptions"), F.size("source_ids").cast("long").alias("n_sources"))


@query("""
WITH places AS (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT '"' || upper(n_name) || '"' AS entity, 'NATION' AS entity_type, n_name AS description, 'chunk-' || md5(r_name) AS source_id FROM places
UNION ALL SELECT '"' || upper(c_name) || '"', 'UNKNOWN', 'UNKNOWN', min('chunk-' || md5(r_name)) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY c_name""")
def custom_kg_nodes(spark, sf_dir):
    """Named nodes, and both ends of relations that no one has named."""
    return _custom_graph(spark, sf_dir)[1]


@query("""
SELECT '"' || upper(c_name) || '"' AS src, '"' || upper(n_name) || '"' AS tgt, c_acctbal AS weight, 'chunk-' || md5(r_name) AS source_id
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def custom_kg(spark, sf_dir):
    return _custom_graph(spark, sf_dir)[2].select("src", "tgt", "weight", "source_id")


def _custom_graph(spark, sf_dir):
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    places = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    chunks = region.select(F.col("r_name").alias("source_id"), F.col("r_name").alias("content"))
    entities = places.select(F.col("n_name").alias("entity_name"), F.lit("NATION").alias("entity_type"), F.col("n_name").alias("description"), F.col("r_name").alias("source_id"))
    relations = read(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_name").alias("src_id"), F.col("n_name").alias("tgt_id"), F.lit("lives in").alias("description"), F.lit("home").alias("keywords"), F.col("c_acctbal").alias("weight"), F.col("r_name").alias("source_id"))
    return merge.custom_graph(chunks, entities, relations)


def _pairs(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    a, b = turns.where("role = 'user'"), turns.where("role = 'assistant'")
    gold = a.groupBy("conv_id").agg(F.array_sort(F.collect_set("text")).alias("golds"))
    said = b.groupBy("conv_id").agg(F.min_by("text", F.struct("turn", "text")).alias("prediction"))
    return gold.join(said, "conv_id")


def _words(text: str) -> str:
    marks = tx.PUNCTUATION.replace("'", "''")
    return f"list_filter(string_split_regex(translate(lower({text}), '{marks}', ''), '\\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the'))"


def _bare(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}\\s]', '', 'g'))"


_PAIRS = """pairs AS (SELECT conv_id, golds, prediction
  FROM (SELECT conv_id, list_sort(list_distinct(list(text))) AS golds FROM conversations WHERE role = 'user' GROUP BY conv_id)
  JOIN (SELECT conv_id, arg_min(text, (turn, text)) AS prediction FROM conversations WHERE role = 'assistant' GROUP BY conv_id) USING (conv_id))"""


@query(f"WITH {_PAIRS} SELECT conv_id, (CASE WHEN list_contains(list_transform(golds, lambda g: {_words('g')}), {_words('prediction')}) THEN 1 ELSE 0 END)::DOUBLE AS em FROM pairs")
def qa_em(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", evaluation.exact_match(F.col("prediction"), F.col("golds")).alias("em"))


@query(f"""WITH {_PAIRS},
each AS (SELECT conv_id, {_words('prediction')} AS p, unnest(list_transform(golds, lambda g: {_words('g')})) AS g FROM pairs),
same AS (SELECT conv_id, len(p) + len(g) AS n, coalesce(list_sum(list_transform(list_intersect(p, g), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(g, lambda x: x = w))))), 0) AS s FROM each)
SELECT conv_id, round(max(CASE WHEN s = 0 THEN 0 ELSE 2.0::DOUBLE * s / n END), 9) AS f1 FROM same GROUP BY conv_id""")
def qa_f1(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", F.round(evaluation.best_f1(F.col("prediction"), F.col("golds")), 9).alias("f1"))


@query(f"WITH {_PAIRS} SELECT conv_id, len(list_filter(golds, lambda g: contains({_bare('prediction')}, {_bare('g')}))) > 0 AS met FROM pairs")
def qa_contains(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", tx.contains_any(F.col("prediction"), F.col("golds")).alias("met"))


@query(f"WITH {_PAIRS}, met AS (SELECT prediction, len(list_filter(golds, lambda g: contains({_bare('prediction')}, {_bare('g')}))) > 0 AS met, golds FROM pairs) SELECT count(*) AS n, avg(CASE WHEN trim(golds[1]) <> '' THEN 1.0::DOUBLE ELSE 0 END) AS retrieved, avg(CASE WHEN trim(prediction) <> '' THEN 1.0::DOUBLE ELSE 0 END) AS answered, avg(CASE WHEN trim(prediction) <> '' AND met THEN 1.0::DOUBLE ELSE 0 END) AS matched FROM met")
def rag_summary(spark, sf_dir):
    """E4 over conversations: the user's first text stands for the context, the assistant's for the answer."""
    rows = _pairs(spark, sf_dir).select(F.col("golds")[0].alias("context"), F.col("prediction").alias("answer"), "golds")
    return evaluation.rag_summary(rows)


@query("SELECT conv_id, turn, 'Answer from the knowledge base. Question: ' || text AS content, turn::VARCHAR AS index FROM conversations WHERE role = 'user'")
def qa_training_rows(spark, sf_dir):
    asks = read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("turn").alias("index"), F.col("text").alias("question"), F.array("text").alias("golden_answers"))
    rows = evaluation.training_rows(asks, "conversations", "train", "Answer from the knowledge base. ", "conv_id", "turn")
    return rows.select("conv_id", "turn", F.col("prompt")[0]["content"].alias("content"), F.col("extra_info.index").alias("index"))


@query(f"WITH {MENTIONS}, {PATHS}, top AS ({fused_sql('local_path', 'global_path')}) SELECT query_id, string_agg('[Source ' || rank || ']' || chr(10) || knowledge, chr(10) || chr(10) ORDER BY rank) AS context FROM top WHERE rank <= 5 GROUP BY query_id")
def rag_context(spark, sf_dir):
    return context.sources_text(answers("hybrid")(spark, sf_dir), 5)


@query(f"WITH {MENTIONS}, {PATHS}, top AS ({fused_sql('local_path', 'global_path')}) SELECT query_id, json_object('query', query_id, 'results', list(json_object('<knowledge>', knowledge, '<coherence>', coherence) ORDER BY rank))::VARCHAR AS json FROM top GROUP BY query_id")
def search_json(spark, sf_dir):
    return context.answers_json(answers("hybrid")(spark, sf_dir))


_NAMES = "names AS (SELECT DISTINCT '\"' || upper(w) || '\"' AS entity FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) AS w FROM benchmark))"


def _names(spark, sf_dir):
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0)))
    return read(spark, sf_dir, "benchmark").select(words.alias("w")).select(F.concat(F.lit('"'), F.upper("w"), F.lit('"')).alias("entity")).distinct()


@query(f"WITH {MENTIONS}, {_NAMES} SELECT entity, coalesce(array_to_string(descriptions, '<SEP>'), 'none') AS description FROM names LEFT JOIN entities USING (entity)")
def lookup_default(spark, sf_dir):
    """The descriptions of the benchmark's long words, where the graph has them as entities, else a default."""
    entities = graph_of(spark, sf_dir).entities.withColumn("description", F.array_join("descriptions", "<SEP>"))
    return access.looked_up(_names(spark, sf_dir), entities, "entity", "description", default={"description": "none"})


@query(f"WITH {MENTIONS}, {_NAMES} SELECT entity FROM names WHERE entity IN (SELECT entity FROM entities)")
def node_exists(spark, sf_dir):
    return access.present(_names(spark, sf_dir), graph_of(spark, sf_dir).entities, "entity")


@query(f"WITH {MENTIONS}, {_NAMES} SELECT e.fact, e.entity FROM edges e JOIN names USING (entity)")
def edge_exists(spark, sf_dir):
    near = graph_of(spark, sf_dir).edges.select("fact", "entity").join(_names(spark, sf_dir), "entity", "left_semi")  # no other edges are looked through
    return access.present(near, near, "fact", "entity").select("fact", "entity")


@query("SELECT vec_id AS query_id, CASE WHEN vec_id % 3 = 0 THEN 'answer ' || vec_id END AS response FROM embeddings")
def exact_cache(spark, sf_dir):
    """All questions asked of a cache that holds every third's response."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.lit("local").alias("mode"), tx.args_hash(F.col("vec_id")).alias("args_hash"))
    held = v.where("query_id % 3 = 0").select("mode", "args_hash", F.concat(F.lit("answer "), "query_id").alias("response"))
    return cache.exact_hits(v, held).select("query_id", "response")


@query("""
WITH a AS (SELECT source AS "group", doc_id AS pos, lang AS item, 0 AS part FROM documents WHERE doc_id % 2 = 0), b AS (SELECT source, doc_id, left(text, 3), 1 FROM documents WHERE doc_id % 2 = 1),
seen AS (SELECT "group", item, min((part, pos)) AS first_at FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE item <> '' GROUP BY ALL)
SELECT "group", item, row_number() OVER (PARTITION BY "group" ORDER BY first_at)::INT AS pos FROM seen""")
def combine_contexts(spark, sf_dir):
    """Two lists for each source: languages of the even documents, and beginnings of the odd ones."""
    docs = read(spark, sf_dir, "documents")
    rows = lambda odd, item: docs.where(F.col("doc_id") % 2 == odd).select(F.col("source").alias("group"), F.col("doc_id").alias("pos"), item.alias("item"))
    return context.combined(rows(0, F.col("lang")), rows(1, F.left("text", F.lit(3))))


@query(f"WITH {MENTIONS}, {PATHS}, top AS ({fused_sql('local_path', 'global_path')}), best AS (SELECT query_id, max(coherence) AS c FROM questions LEFT JOIN top USING (query_id) GROUP BY query_id) SELECT count(*) AS n, avg(CASE WHEN c IS NULL THEN 0.0 ELSE 1.0 END)::DOUBLE AS success, round(coalesce(avg(c), 0), 6) AS coherence FROM best")
def retrieval_summary(spark, sf_dir):
    found = asked(spark, sf_dir).select("query_id").join(answers("hybrid")(spark, sf_dir), "query_id", "left")
    return evaluation.retrieval_summary(found).select("n", "success", F.round("coherence", 6).alias("coherence"))


@query(r"""SELECT 'doc-' || left(md5(text), 16) AS id, text AS contents, 'd' || doc_id || '.x' AS title, 'd' || doc_id || '.x.txt' AS source_file, NULL::INT AS chunk_index FROM documents WHERE text IS NOT NULL""")
def corpus_rows(spark, sf_dir):
    files = read(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.concat(F.lit("in/d"), "doc_id", F.lit(".x.txt")).alias("path"), "text")
    return ch.corpus_rows(files, "whole")


@query("SELECT event_id, event_id || ',' || user_id AS line FROM events")
def csv_lines(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", tx.csv_line(F.col("event_id"), F.col("user_id")).alias("line"))


@query("SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events")
def parsed_props(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", tx.parsed_json(F.concat(F.lit("reply: "), "props", F.lit(" end")), "k int")["k"].alias("k"))


@query(f"WITH {MENTIONS}, {PATHS}, near AS (SELECT query_id, entity, min(rank)::INT AS seed_rank FROM fh JOIN edges USING (fact) GROUP BY ALL), sized AS (SELECT n.*, sum(len(list_filter(string_split_regex(array_to_string(descriptions, ' '), '\\s+'), lambda t: t <> ''))) OVER (PARTITION BY query_id ORDER BY seed_rank, entity) AS used FROM near n JOIN entities USING (entity)) SELECT query_id, entity, seed_rank FROM sized WHERE used <= 300")
def budget_entities(spark, sf_dir):
    """Entities next to the nearest facts, while their descriptions hold 300 words at most."""
    graph = graph_of(spark, sf_dir)
    return access.entities_from_facts(_seeds(spark, sf_dir, graph, "fact"), graph.edges, graph.entities, 300).drop("degree")


@query(f"WITH {MENTIONS}, {PATHS}, near AS (SELECT query_id, chunk_id, min(rank)::INT AS seed_rank FROM fh JOIN (SELECT fact, unnest(source_ids) AS chunk_id FROM facts) USING (fact) GROUP BY ALL), sized AS (SELECT n.*, sum(tokens) OVER (PARTITION BY query_id ORDER BY seed_rank, chunk_id) AS used FROM near n JOIN chunks USING (chunk_id)) SELECT query_id, chunk_id, seed_rank FROM sized WHERE used <= 500")
def budget_text_units(spark, sf_dir):
    graph = graph_of(spark, sf_dir)
    return access.text_units_from_facts(_seeds(spark, sf_dir, graph, "fact"), graph.facts, graph.chunks, 500)


@query("SELECT item_id, array_to_string(list_sort(list_filter(w, lambda x: length(x) >= 9)), ',') AS high, array_to_string(list_sort(list_filter(w, lambda x: length(x) < 9)), ',') AS low FROM (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM benchmark)")
def question_keywords(spark, sf_dir):
    found = read(spark, sf_dir, "benchmark").select("item_id", extraction.rule_keywords(F.col("text")).alias("k"))
    joined = lambda c: F.array_join(F.array_sort(f"k.{c}"), ",")
    return found.select("item_id", joined("high_level_keywords").alias("high"), joined("low_level_keywords").alias("low"))


@query(f"WITH {MENTIONS}, {PATHS}, top AS ({fused_sql('local_path', 'global_path')}), sources AS (SELECT query_id, string_agg('[Source ' || rank || ']' || chr(10) || knowledge, chr(10) || chr(10) ORDER BY rank) AS context FROM top WHERE rank <= 5 GROUP BY query_id) SELECT query_id, 'Answer the question from the sources alone, and name those that you used.' || chr(10) || chr(10) || 'Sources:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || text || chr(10) AS prompt FROM sources JOIN questions USING (query_id)")
def answer_prompts(spark, sf_dir):
    """What a model would be asked for each question."""
    found = context.sources_text(answers("hybrid")(spark, sf_dir), 5).join(asked(spark, sf_dir), "query_id")
    return found.select("query_id", context.filled(prompts.ANSWER, context=F.col("context"), question=F.col("text")).alias("prompt"))


_ALIKE = f"WITH RECURSIVE {MENTIONS}, {PATHS}, pairs AS (SELECT a.entity AS a, b.entity AS b FROM ev a JOIN ev b ON a.bucket = b.bucket AND a.entity <> b.entity GROUP BY ALL HAVING round(sum(a.value * b.value), 9) >= 0.9), reach AS (SELECT entity AS a, entity AS b FROM entities UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b), named AS (SELECT a AS entity, min(b) AS canonical FROM reach GROUP BY a)"


@query(_ALIKE + " SELECT entity, canonical FROM named WHERE entity <> canonical")
def entity_resolution(spark, sf_dir):
    """Entities that another one of the graph stands for: vectors linked by cosines of 0.9 or more."""
    stored = graph_of(spark, sf_dir).entity_vectors
    return resolution.aliases(stored.select("name", "vector"), 0.9).where("entity <> canonical")


_HALF = _ALIKE.replace("FROM documents)", "FROM documents WHERE length(text) % 2 = 0)")


@query(f"WITH {MENTIONS}, names AS (SELECT * FROM ({_HALF} SELECT entity, canonical FROM named)) SELECT fact, coalesce(canonical, entity) AS entity, sum(weight) AS weight FROM mentions LEFT JOIN names USING (entity) GROUP BY ALL")
def resolved_edges(spark, sf_dir):
    """Edges of a graph of half of the documents that is resolved before the other half is inserted: later mentions come under canonical names."""
    engine = Engine(spark, f"{access.scratch(spark)}/weftline-resolved-{uuid.uuid4().hex}", SIZE, OVERLAP, embeds=("entity",))
    docs = read(spark, sf_dir, "documents").select(F.col("text").alias("content"))
    engine.insert(docs.where("length(content) % 2 = 0"))
    engine.resolve(0.9)
    engine.insert(docs.where("length(content) % 2 = 1"))
    return engine.table("edges").select("fact", "entity", "weight")


@query(_ALIKE + " SELECT fact, canonical AS entity, sum(weight) AS weight FROM edges JOIN named USING (entity) GROUP BY ALL")
def merged_edges_of_resolved(spark, sf_dir):
    """The graph's edges under canonical names."""
    graph = graph_of(spark, sf_dir)
    names = resolution.aliases(graph.entity_vectors.select("name", "vector"), 0.9)
    return merge.joined_edges(resolution.renamed(graph.edges, names)).select("fact", "entity", "weight")


def _dense_index(spark, sf_dir) -> tuple[cells.Index, DataFrame]:
    """The table of embeddings as an index in cells, and every hundredth vector as a query."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("name"), vx.sparse_array(F.col("embedding")).alias("vector")).where(F.size("vector") > 0)
    own = cells.learned(v)
    path = f"{access.scratch(spark)}/weftline-cells-{uuid.uuid4().hex}"
    cells.placed(v, own.centres).repartition("cell").write.partitionBy("cell").parquet(path)
    asks = v.where("cast(name AS long) % 100 = 0").select(F.col("name").cast("long").alias("query_id"), F.inline("vector"))
    return cells.Index([spark.read.parquet(path)], own), asks


def _lists(vectors: DataFrame) -> impact.Lists:
    """Stored lists of (name, vector)."""
    spark = vectors.sparkSession
    path = f"{access.scratch(spark)}/weftline-lists-{uuid.uuid4().hex}"
    impact.postings(vectors).repartition("level", F.pmod(F.xxhash64("bucket"), F.lit(4))).sortWithinPartitions("level", "bucket").write.partitionBy("level").parquet(path)
    lists = spark.read.schema("level int, bucket int, name string").parquet(path)
    return impact.Lists(lists, access.staged(impact.sizes(lists), "sizes"), vectors)


@query(f"WITH {MENTIONS}, {PATHS} SELECT 'entity' AS kind, query_id, entity AS name, score, rank::INT AS rank FROM eh UNION ALL SELECT 'fact', query_id, fact, score, rank::INT FROM fh")
def impact_hits(spark, sf_dir):
    """V1 by lists in order of impact: the 60 nearest entities and facts of each question."""
    graph = graph_of(spark, sf_dir)
    asks = graph.asked(asked(spark, sf_dir))
    parts = [_lists(v).top_k(asks, 60).select(F.lit(kind).alias("kind"), "query_id", "name", "score", "rank") for kind, v in (("entity", graph.entity_vectors), ("fact", graph.fact_vectors))]
    return parts[0].union(parts[1])


@query()
def approximate_topk(spark, sf_dir):
    """V5: the 20 nearest by cosine among the cells nearest to each query."""
    index, asks = _dense_index(spark, sf_dir)
    return index.top_k(asks, 20, -1.0, recall=0.97)


@query()
def mode_local_approximate(spark, sf_dir):
    """Q1 with the engine's index: each question reads a few cells of the entities' vectors."""
    return retrieval.answer(graph_of(spark, sf_dir), asked(spark, sf_dir), retrieval.QueryParams(mode="local", recall=0.97))


@query()
def subword_windows(spark, sf_dir):
    """K1 in byte-pair tokens of a public vocabulary."""
    return subwords.windows(read(spark, sf_dir, "documents"), "doc_id", "text", SIZE, OVERLAP)


def _hops_sql() -> str:
    """Three hops; the paths of each by degree, weight, rank of the seed and place."""
    count = lambda words: "len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{x}'" for x in words) + ")))"
    case = lambda k: "CASE complexity " + " ".join(f"WHEN '{name}' THEN {b[k]}" for name, b in retrieval.BREADTH.items()) + " END"
    out = f"""
worded AS (SELECT query_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM questions),
leveled AS (SELECT query_id, CASE WHEN {count(retrieval.ASKING)} = 1 AND len(list_filter(list_distinct(w), lambda x: length(x) >= 9)) <= 2 THEN 'simple' WHEN {count(retrieval.ASKING)} <= 2 AND {count(retrieval.JOINING)} <= 1 THEN 'moderate' ELSE 'complex' END AS complexity FROM worded),
plan AS (SELECT query_id, complexity, {case(0)} AS n_entities, {case(1)} AS n_facts, {case(2)} AS hops FROM leveled),
seeds1 AS (SELECT query_id, entity, rank AS seed_rank FROM eh JOIN plan USING (query_id) WHERE rank <= n_entities),
near1 AS (SELECT query_id, fact, rank FROM fh JOIN plan USING (query_id) WHERE rank <= n_facts),
path1 AS (SELECT query_id, fact AS knowledge, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, rank) AS position, 1 AS path FROM near1 JOIN facts USING (fact)
  UNION ALL SELECT query_id, fact, row_number() OVER (PARTITION BY query_id ORDER BY a.degree + b.degree DESC, weight DESC, seed_rank, seq, fact), 0
  FROM seeds1 s JOIN edges e USING (entity) JOIN degrees a ON a.node = e.entity JOIN degrees b ON b.node = e.fact)"""
    for hop in (1, 2, 3):
        if hop > 1:
            started = " UNION ALL ".join(f"SELECT query_id, entity FROM seeds{k}" for k in range(1, hop))
            known = " UNION ALL ".join(f"SELECT query_id, knowledge, {k} AS hop, rank FROM hop{k}" for k in range(1, hop))
            out += f""",
known{hop} AS ({known}),
ends{hop} AS (SELECT query_id, entity, min((k.hop, k.rank)) AS place FROM known{hop} k JOIN edges e ON e.fact = k.knowledge JOIN plan USING (query_id) WHERE hops >= {hop} GROUP BY ALL),
seeds{hop} AS (SELECT query_id, entity, seed_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, entity) AS seed_rank FROM ends{hop} WHERE (query_id, entity) NOT IN ({started})) JOIN plan USING (query_id) WHERE seed_rank <= n_entities),
path{hop} AS (SELECT query_id, fact AS knowledge, row_number() OVER (PARTITION BY query_id ORDER BY a.degree + b.degree DESC, weight DESC, seed_rank, seq, fact) AS position, 0 AS path
  FROM seeds{hop} s JOIN edges e USING (entity) JOIN degrees a ON a.node = e.entity JOIN degrees b ON b.node = e.fact WHERE (query_id, fact) NOT IN (SELECT query_id, knowledge FROM known{hop}))"""
        out += f""",
hop{hop} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS rank FROM (SELECT query_id, knowledge, round(sum(1.0::DOUBLE / position), 9) AS score, min((path, position)) AS seen FROM path{hop} GROUP BY query_id, knowledge)) WHERE rank <= {retrieval.PER_HOP})"""
    every = " UNION ALL ".join(f"SELECT query_id, {k}::INT AS hop, rank::INT AS rank, knowledge, round(score, 3) AS coherence FROM hop{k}" for k in (1, 2, 3))
    return out + f" SELECT query_id, complexity, hop, rank, replace(knowledge, '<bipartite_edge>', '') AS knowledge, coherence FROM ({every}) JOIN plan USING (query_id)"


@query(f"WITH {MENTIONS}, {PATHS}, {_hops_sql()}")
def adaptive_retrieval(spark, sf_dir):
    """Breadth and hops by each question's complexity, all questions in one plan."""
    return retrieval.adaptive(graph_of(spark, sf_dir), asked(spark, sf_dir))
