"""Query plans: the entity path, the fact path and their fusion."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.vectors import embedded, gathered
from weftline.operators.access import few, related_edges, staged
from weftline.operators.cells import Index
from weftline.operators.extraction import FACT_MARK
from weftline.operators.impact import Lists
from weftline.operators.search import sparse_top_k


@dataclass(frozen=True)
class QueryParams:
    """``mode`` is local (entities), global (facts), hybrid (both) or naive (chunks).

    ``recall`` or ``probes`` asks for the approximate search: each query reads as many cells of an
    index as took that recall, or so many. Without them, or where a table has no index, the search is
    exact: by lists of rows that ``lists`` asks for and an engine keeps, or by a scan. ``entity_path``
    ranks the facts next to the nearest entities by degree and weight, or ("max_score") by the score of
    the nearest one.
    """

    mode: str = "hybrid"
    top_k: int = 60
    at_least: float = 0.2
    rrf_k: int = 0
    recall: float | None = None
    probes: int | None = None
    lists: bool = False
    entity_path: str = "degree"


@dataclass
class Graph:
    """A graph's tables, as the merges give them, with the vectors (name, vector), indexes and degrees that an insert stored, if any."""

    entities: DataFrame
    facts: DataFrame
    edges: DataFrame
    chunks: DataFrame
    degrees: DataFrame | None = None
    entity_vectors: DataFrame | None = None
    fact_vectors: DataFrame | None = None
    chunk_vectors: DataFrame | None = None
    embedder: Callable[[DataFrame], DataFrame] = lambda rows: embedded(rows, "name", "content")
    indexes: dict[str, Index] = field(default_factory=dict)
    lists: dict[str, Lists] = field(default_factory=dict)

    def asked(self, queries: DataFrame) -> DataFrame:
        """query_id, bucket, value of queries (query_id, text)."""
        return self.embedder(queries.select(F.col("query_id").alias("name"), F.col("text").alias("content"))).withColumnRenamed("name", "query_id")

    def near(self, queries: DataFrame, kind: str, texts: DataFrame, params: QueryParams) -> DataFrame:
        """query_id, name, score, rank by the stored vectors of ``kind`` (entity, fact, chunk), or by those of ``texts`` (name, content)."""
        asked, stored = self.asked(queries), getattr(self, f"{kind}_vectors")
        if (params.recall or params.probes) and kind in self.indexes:
            return self.indexes[kind].top_k(asked, params.top_k, params.at_least, params.recall or 1.0, params.probes)
        if params.lists and kind in self.lists:
            return self.lists[kind].top_k(asked, params.top_k, params.at_least)
        return sparse_top_k(asked, gathered(self.embedder(texts)) if stored is None else stored, params.top_k, params.at_least)


def _plain(fact):
    return F.replace(fact, F.lit(FACT_MARK), F.lit(""))


def entity_texts(entities: DataFrame) -> DataFrame:
    """What is embedded of an entity: its name and descriptions."""
    return entities.select(F.col("entity").alias("name"), F.concat_ws(" ", F.regexp_replace("entity", '"', ""), F.array_join("descriptions", " ")).alias("content"))


def fact_texts(facts: DataFrame) -> DataFrame:
    """What is embedded of a fact: its sentence."""
    return facts.select(F.col("fact").alias("name"), F.regexp_replace(_plain("fact"), '"', "").alias("content"))


def entity_path(graph: Graph, queries: DataFrame, params: QueryParams) -> DataFrame:
    """Q1: query_id, knowledge, position: facts next to the nearest entities, with one position for each (entity, fact)."""
    hits = graph.near(queries, "entity", entity_texts(graph.entities), params)
    if params.entity_path == "max_score":
        nearest = hits.withColumnRenamed("name", "entity").join(graph.edges.select("entity", "fact"), "entity").groupBy("query_id", "fact").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "fact")
        return nearest.select("query_id", _plain("fact").alias("knowledge"), F.row_number().over(order).alias("position"))
    seeds = hits.select("query_id", F.col("name").alias("entity"), F.col("rank").alias("seed_rank"))
    found = related_edges(seeds, graph.edges, graph.degrees)
    return found.select("query_id", _plain("fact").alias("knowledge"), F.col("rank").alias("position"))


def fact_path(graph: Graph, queries: DataFrame, params: QueryParams) -> DataFrame:
    """Q2: query_id, knowledge, position: the nearest facts by weight, ties in order of nearness."""
    hits = graph.near(queries, "fact", fact_texts(graph.facts), params)
    order = Window.partitionBy("query_id").orderBy(F.desc("weight"), "rank")
    met = graph.facts.select(F.col("fact").alias("name"), "weight").join(few(hits, "hits"), "name")
    return met.select("query_id", _plain("name").alias("knowledge"), F.row_number().over(order).alias("position"))


def fused(first: DataFrame, second: DataFrame, top_k: int, rrf_k: int = 0) -> DataFrame:
    """Q3: query_id, rank, knowledge, coherence: the sum of 1 / (rrf_k + position) over every occurrence in both lists."""
    both = first.withColumn("path", F.lit(0)).unionByName(second.withColumn("path", F.lit(1)))
    score = F.round(F.sum(1.0 / (F.col("position") + rrf_k)), 9)
    summed = both.groupBy("query_id", "knowledge").agg(score.alias("score"), F.min(F.struct("path", "position")).alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen")
    ranked = summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return ranked.select("query_id", "rank", "knowledge", F.round("score", 3).alias("coherence"))


def naive_path(graph: Graph, queries: DataFrame, params: QueryParams) -> DataFrame:
    """Chunks nearest to the query."""
    texts = graph.chunks.select(F.col("chunk_id").alias("name"), "content")
    hits = graph.near(queries, "chunk", texts, params)
    return hits.join(texts, "name").select("query_id", F.col("content").alias("knowledge"), F.col("rank").alias("position"))


def answer(graph: Graph, queries: DataFrame, params: QueryParams = QueryParams()) -> DataFrame:
    """Q4-Q6: query_id, rank, knowledge, coherence for every query (query_id, text); no row where nothing is near."""
    none = lambda d: d.limit(0)
    if params.mode == "naive":
        path = naive_path(graph, queries, params)
        return fused(path, none(path), params.top_k, params.rrf_k)
    if params.mode == "local":
        path = entity_path(graph, queries, params)
        return fused(path, none(path), params.top_k, params.rrf_k)
    if params.mode == "global":
        path = fact_path(graph, queries, params)
        return fused(path, none(path), params.top_k, params.rrf_k)
    return fused(entity_path(graph, queries, params), fact_path(graph, queries, params), params.top_k, params.rrf_k)


# Words that ask, words that join clauses, and for simple, moderate and complex questions
# the entities and facts to start from, and the hops.
ASKING, JOINING = ("what", "which", "who", "where", "when"), ("and", "or", "but")
BREADTH = {"simple": (3, 5, 1), "moderate": (5, 7, 2), "complex": (7, 10, 3)}
#: Facts that a hop adds.
PER_HOP = 5


def complexity(text: Column, least: int = 9) -> Column:
    """simple (one asking word and at most two names), moderate (at most two asking words and one joining word) or complex; names are words of ``least`` letters."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    count = lambda some: F.size(F.filter(words, lambda w: w.isin(*some)))
    names = F.size(F.filter(F.array_distinct(words), lambda w: F.length(w) >= least))
    return F.when((count(ASKING) == 1) & (names <= 2), "simple").when((count(ASKING) <= 2) & (count(JOINING) <= 1), "moderate").otherwise("complex")


def adaptive(graph: Graph, queries: DataFrame, params: QueryParams = QueryParams()) -> DataFrame:
    """query_id, complexity, hop, rank, knowledge, coherence: retrieval as broad and as deep as each question asks for, all in one plan.

    The first hop fuses both paths from the question's nearest entities and facts, as many as its
    complexity says. A further one starts from the entities of the facts found so far that no hop has
    started from, those of the best facts first, and ranks the facts next to them that are new.
    """
    most = [max(b[k] for b in BREADTH.values()) for k in range(3)]
    level = complexity(F.col("text"))
    by_level = lambda k: F.element_at(F.create_map(*[F.lit(x) for name, b in BREADTH.items() for x in (name, b[k])]), level)
    asks = staged(queries.select("query_id", level.alias("complexity"), *[by_level(k).alias(c) for k, c in enumerate(("n_entities", "n_facts", "hops"))]), "asks")
    few = F.broadcast(asks) if asks.count() <= 100_000 else asks
    near = graph.near(queries, "entity", entity_texts(graph.entities), replace(params, top_k=most[0]))
    seeds = near.join(few, "query_id").where(F.col("rank") <= F.col("n_entities")).select("query_id", F.col("name").alias("entity"), F.col("rank").alias("seed_rank"))
    hits = graph.near(queries, "fact", fact_texts(graph.facts), replace(params, top_k=most[1])).join(few, "query_id").where(F.col("rank") <= F.col("n_facts"))
    order = Window.partitionBy("query_id").orderBy(F.desc("weight"), "rank")
    by_fact = hits.join(graph.facts.select(F.col("fact").alias("name"), "weight"), "name").select("query_id", F.col("name").alias("knowledge"), F.row_number().over(order).alias("position"))
    seeds = staged(seeds, "seeds")
    by_entity = related_edges(seeds, graph.edges, graph.degrees).select("query_id", F.col("fact").alias("knowledge"), F.col("rank").alias("position"))
    found = staged(fused(by_entity, by_fact, PER_HOP, params.rrf_k).withColumn("hop", F.lit(1)), "hop")
    started = seeds.select("query_id", "entity")
    for hop in range(2, most[2] + 1):
        facts = found.join(few, "query_id").where(F.col("hops") >= hop).select("query_id", F.col("knowledge").alias("fact"), F.struct("hop", "rank").alias("place"), "n_entities")
        ends = facts.join(graph.edges.select("fact", "entity"), "fact").groupBy("query_id", "entity", "n_entities").agg(F.min("place").alias("place")).join(started, ["query_id", "entity"], "left_anti")
        first = Window.partitionBy("query_id").orderBy("place", "entity")
        seeds = staged(ends.withColumn("seed_rank", F.row_number().over(first)).where(F.col("seed_rank") <= F.col("n_entities")).select("query_id", "entity", "seed_rank"), "seeds")
        known = found.select("query_id", F.col("knowledge").alias("fact"))
        path = related_edges(seeds, graph.edges, graph.degrees).join(known, ["query_id", "fact"], "left_anti")
        again = Window.partitionBy("query_id").orderBy("rank")
        path = path.select("query_id", F.col("fact").alias("knowledge"), F.row_number().over(again).alias("position"))
        more = fused(path, path.limit(0), PER_HOP, params.rrf_k).withColumn("hop", F.lit(hop))
        found, started = staged(found.unionByName(more), "hop"), started.union(seeds.select("query_id", "entity"))
    return found.join(few, "query_id").select("query_id", "complexity", "hop", "rank", _plain("knowledge").alias("knowledge"), "coherence")
