"""The engine: insert, rebuild, query, delete and custom graphs over a workspace."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import subwords
from weftline.functions.chunks import distinct_chunks, windows
from weftline.functions.text import hash_id, strip
from weftline.functions.vectors import embedded, gathered, hashed_vectors
from weftline.operators import cells, extraction, impact, merge, resolution, summaries
from weftline.operators.access import node_degree
from weftline.plans.retrieval import Graph, QueryParams, answer, entity_texts, fact_texts
from weftline.sources.workspace import Workspace

VECTOR = "name string, vector array<struct<bucket: int, value: double>>, cell int"
SCHEMAS = {
    "docs": "doc_key string, content string",
    "chunks": "chunk_id string, full_doc_id string, chunk_order_index int, tokens int, content string",
    "facts": "fact string, weight double, source_ids array<string>",
    "entities": "entity string, entity_type string, descriptions array<string>, source_ids array<string>",
    "edges": "fact string, entity string, weight double, source_ids array<string>, seq struct<chunk_id: string, pos: int>",
    "degrees": "node string, degree long",
    "entity_vectors": VECTOR,
    "fact_vectors": VECTOR,
    "chunk_vectors": VECTOR,
    **{f"{kind}_lists": "level int, bucket int, name string" for kind in ("entity", "fact", "chunk")},
    **{f"{kind}_sizes": "bucket int, level int, n long" for kind in ("entity", "fact", "chunk")},
    "summaries": "entity string, covers string, summary string",
    "summary_parts": "hash string, summary string",
    "aliases": "entity string, canonical string",
    "cells": "of string, cell int, n long, centre array<double>, recall double",
    "records": extraction.STATEMENT,
    "mentions": "chunk_id string, pos int, entity string, entity_type string, description string",
    "kg_edges": "src string, tgt string, weight double, description string, keywords string, source_id string",
}
KEYS = {
    "docs": ("doc_key",), "chunks": ("chunk_id",), "facts": ("fact",), "entities": ("entity",), "edges": ("fact", "entity"),
    "degrees": ("node",), "entity_vectors": ("name",), "fact_vectors": ("name",), "chunk_vectors": ("name",), "cells": ("of", "cell"), "aliases": ("entity",), "summaries": ("entity",), "summary_parts": ("hash",), "kg_edges": ("src", "tgt"),
}
VECTORS = ("entity_vectors", "fact_vectors", "chunk_vectors")
LISTS = ("entity_lists", "fact_lists", "chunk_lists")
KEYS |= dict.fromkeys(LISTS, ("level", "bucket", "name"))  # rows of sizes add up


def hashed(rows: DataFrame) -> DataFrame:
    """The default embedder: name, bucket, value of (name, content)."""
    return embedded(rows, "name", "content")


@dataclass
class Engine:
    """G12 and the facade.

    ``extractor`` turns chunks (chunk_id, content) into responses (chunk_id, response), ``embedder``
    texts (name, content) into sparse unit vectors (name, bucket, value); questions go through it, too.
    With ``cells`` every insert keeps an approximate index of the vectors in so many cells (0: about
    the square root of their number), which a query uses that names a recall or its probes; with ``lists`` it
    keeps lists of rows by bucket and value, for exact searches that read their beginnings. With
    ``vocabulary`` chunks are windows of its byte-pair tokens instead of words. Inserts keep vectors of
    the kinds in ``embeds``; only those can be searched.
    """

    spark: SparkSession
    path: str
    size: int = 1200
    overlap: int = 100
    extractor: Callable[[DataFrame], DataFrame] = field(default=extraction.rule_responses)
    embedder: Callable[[DataFrame], DataFrame] = field(default=hashed)
    cells: int | None = None
    lists: bool = False
    vocabulary: str | None = None
    embeds: tuple[str, ...] = ("entity", "fact", "chunk")
    summariser: summaries.Model | None = None
    summary_limit: int = 500

    def __post_init__(self):
        self.store = Workspace(self.spark, self.path, KEYS, SCHEMAS, dict.fromkeys(VECTORS, "cell") | dict.fromkeys(LISTS, "level"))

    def table(self, name: str) -> DataFrame:
        return self.store.read_or(name, SCHEMAS[name])

    def vectors(self, texts: DataFrame) -> DataFrame:
        """Name, vector, cell of (name, content), all in one cell; texts without a word have no row."""
        rows = hashed_vectors(texts, "name", "content") if self.embedder is hashed else gathered(self.embedder(texts))
        return rows.withColumn("cell", F.lit(0))

    def cells_of(self, name: str) -> tuple[cells.Cells | None, int]:
        """A table's cells, and the number of vectors when they were learned."""
        rows = self.table("cells").where(F.col("of") == name).orderBy("cell").collect()  # at most ``cells.MOST_CELLS``
        return (cells.Cells(np.array([r["centre"] for r in rows]), np.array([r["recall"] for r in rows])), rows[0]["n"]) if rows else (None, 0)

    def _indexed(self, changes: dict[str, DataFrame], fresh: bool) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
        """The tables to append and to replace: new vectors go to their cells, which are learned anew where a table has outgrown them."""
        append, replace, learned = changes | self._listed(changes), {}, {}
        for name in VECTORS if self.cells is not None else ():
            if name not in changes:
                continue
            new = self.store.stage(name, changes[name])
            own, n = (None, 0) if fresh else self.cells_of(name)
            held = [] if fresh else self.store.layers(name)
            size = new.count() + sum(layer.count() for layer in held)  # from the files' footers
            if own is None or size > cells.GROWTH * n:
                if held:
                    new = self.store.stage(name, new.unionByName(self.table(name).join(new.select("name"), "name", "left_anti")))
                own = cells.learned(new, self.cells or None)
                learned[name] = (own, size)
                replace[name] = append.pop(name)
            rows = cells.placed(new, own.centres).repartition("cell", F.pmod(F.xxhash64("name"), F.lit(4)))
            (replace if name in replace else append)[name] = rows
        if learned:
            old = self.table("cells").where(~F.col("of").isin(list(learned))) if not fresh else self.spark.createDataFrame([], SCHEMAS["cells"])
            replace["cells"] = reduce(DataFrame.unionByName, [self._cell_rows(name, own, n) for name, (own, n) in learned.items()], old)
        return append, replace

    def _cell_rows(self, name: str, own: cells.Cells, n: int) -> DataFrame:
        return self.spark.createDataFrame([(name, k, n, c.tolist(), float(r)) for k, (c, r) in enumerate(zip(own.centres, own.recall, strict=True))], SCHEMAS["cells"])

    def _listed(self, changes: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Rows of lists for new vectors. Those of vectors that are replaced or deleted stay: searches score by the vectors in force."""
        out = {}
        for name in VECTORS if self.lists else ():
            if name in changes:
                kind = name.removesuffix("_vectors")
                rows = self.store.stage(f"{kind}_lists", impact.postings(changes[name]))
                out |= {f"{kind}_lists": rows.repartition("level", F.pmod(F.xxhash64("bucket"), F.lit(4))).sortWithinPartitions("level", "bucket"), f"{kind}_sizes": impact.sizes(rows)}
        return out

    def _summarised(self, entities: DataFrame, table: Callable[[str], DataFrame]) -> dict[str, DataFrame]:
        """Summaries of those entities whose descriptions are others than their summary covers, and the parts made for them."""
        covered = entities.withColumn("covers", F.md5(F.array_join("descriptions", summaries.SEPARATOR)))
        changed = covered.join(table("summaries").select("entity", "covers"), ["entity", "covers"], "left_anti")
        found, parts = summaries.summarised(changed, table("summary_parts"), self.summariser, self.summary_limit)
        return {"summaries": found.join(changed.select("entity", "covers"), "entity").select("entity", "covers", "summary"), "summary_parts": parts}

    def described(self) -> DataFrame:
        """entity, description: the summary where there is one that covers all descriptions, else these between separators."""
        text = F.array_join("descriptions", summaries.SEPARATOR)
        held = self.table("entities").select("entity", text.alias("text"), F.md5(text).alias("covers"))
        return held.join(self.table("summaries"), ["entity", "covers"], "left").select("entity", F.coalesce("summary", "text").alias("description"))

    def insert(self, docs: DataFrame) -> None:
        """Add documents (content). Known documents and chunks change nothing.

        The new rows of all tables are published by one commit: an insert that fails leaves
        everything as it was, and may be run again, as a stream does with a batch. Of the stored
        state only the keys that the new chunks touch are read into the merges and written.
        """
        self._add(docs, self.table)

    def rebuild(self, docs: DataFrame) -> None:
        """The same from nothing; the old tables stay in force until the new ones are complete."""
        self._add(docs, lambda name: self.spark.createDataFrame([], SCHEMAS[name]), fresh=True)

    def keyed(self, docs: DataFrame, distinct: bool = True) -> DataFrame:
        """doc_key, content: the texts, each once unless they need not be ``distinct``."""
        text = strip(F.col("content"))
        rows = docs.select(hash_id(text, "doc-").alias("doc_key"), text.alias("content"))
        return rows.dropDuplicates(["doc_key"]) if distinct else rows

    def cut(self, docs: DataFrame) -> DataFrame:
        """The distinct chunks of documents (doc_key, content)."""
        if self.vocabulary is not None:
            return distinct_chunks(subwords.windows(docs, "doc_key", "content", self.size, self.overlap, self.vocabulary))
        return distinct_chunks(windows(docs, "doc_key", "content", self.size, self.overlap))

    def derived(self, docs: DataFrame, name: str) -> DataFrame:
        """One table as an insert of ``docs`` into an empty workspace gives it, made now with what it is made of, unless it is there.

        So a job that reads a part of the graph makes no more than that. Each table is a commit of
        its own; a workspace of derived tables takes no inserts. Disk is what a large graph lacks first:
        ``docs`` lists keys alone, as the contents lie where ``docs`` is read from, vectors are made
        where they are read, and mentions go without their facts, which the records hold once.
        """
        get = lambda of: self.derived(docs, of)
        makers = {
            "docs": lambda: self.keyed(docs).select("doc_key", F.lit(None).cast("string").alias("content")),
            "chunks": lambda: get("docs") and self.cut(self.keyed(docs, distinct=False)),  # equal texts have equal chunks
            "records": lambda: extraction.statements(self.extractor(get("chunks"))),
            "mentions": lambda: get("records").select("chunk_id", F.inline("named")).drop("weight").select("chunk_id", "pos", "entity", "entity_type", "description"),
            "facts": lambda: merge.merged_facts(get("records")),
            "entities": lambda: merge.merged_entities(get("mentions")),
            "edges": lambda: merge.edges_of_statements(get("records")),
            "degrees": lambda: node_degree(get("edges")),
            "entity_vectors": lambda: self.vectors(entity_texts(get("entities"))),
            "fact_vectors": lambda: self.vectors(fact_texts(get("facts"))),
            "chunk_vectors": lambda: self.vectors(get("chunks").select(F.col("chunk_id").alias("name"), "content")),
        }
        if not self.store.exists(name):
            if name in VECTORS:
                return makers[name]()
            self.store.commit(replace={name: makers[name]()})
        return self.table(name)

    def derived_index(self, docs: DataFrame, kind: str) -> cells.Index:
        """A kind's vectors in cells, learned now unless they are there."""
        name = f"{kind}_vectors"
        vectors, (own, _) = self.derived(docs, name), self.cells_of(name)
        if own is None:
            own = cells.learned(vectors, self.cells or None)
            rows = cells.placed(vectors, own.centres).repartition("cell", F.pmod(F.xxhash64("name"), F.lit(4)))
            self.store.commit(replace={name: rows}, append={"cells": self._cell_rows(name, own, vectors.count())})
        return cells.Index(self.store.layers(name), own)

    def _add(self, docs: DataFrame, table: Callable[[str], DataFrame], fresh: bool = False) -> None:
        if self.store.exists("records"):
            raise ValueError("a workspace of derived tables takes no inserts")
        stage = self.store.stage
        new = stage("docs", merge.new_keys(self.keyed(docs), table("docs"), "doc_key"))
        chunks = stage("chunks", merge.new_keys(self.cut(new), table("chunks"), "chunk_id"))
        if chunks.isEmpty() and not fresh:
            return
        rows = stage("records", extraction.records(self.extractor(chunks)))
        facts = stage("said", extraction.facts(rows))
        if facts.isEmpty() and not fresh:
            return
        mentions = stage("mentions", resolution.renamed(extraction.mentions(rows), table("aliases")))
        touched = lambda name, keys, *on: table(name).join(keys.select(*on).distinct(), list(on), "left_semi")
        merged_facts = stage("facts", merge.merged_facts(facts, touched("facts", facts, "fact")))
        entities = stage("entities", merge.merged_entities(mentions, touched("entities", mentions, "entity")))
        edges = stage("edges", merge.merged_edges(mentions, touched("edges", mentions, "fact", "entity")))
        fresh_ends = node_degree(edges.join(table("edges").select("fact", "entity"), ["fact", "entity"], "left_anti"))
        degrees = fresh_ends.unionByName(touched("degrees", fresh_ends, "node")).groupBy("node").agg(F.sum("degree").alias("degree"))
        new_facts = merged_facts.join(table("fact_vectors").select(F.col("name").alias("fact")), "fact", "left_anti")
        texts = {"entity": entity_texts(entities), "fact": fact_texts(new_facts), "chunk": chunks.select(F.col("chunk_id").alias("name"), "content")}
        changes = {
            "docs": new, "chunks": chunks, "facts": merged_facts, "entities": entities, "edges": edges, "degrees": degrees,
            **{f"{kind}_vectors": self.vectors(texts[kind]) for kind in self.embeds},
        }
        if self.summariser is not None:
            changes |= self._summarised(entities, table)
        append, replace = self._indexed(changes, fresh)
        self.store.commit(**({"replace": append | replace} if fresh else {"append": append, "replace": replace}))

    def insert_graph(self, chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> None:
        """Add a hand-made graph (see ``merge.custom_graph``); a known entity keeps its chunks and gets the new type and description, too."""
        texts, nodes, kg_edges = merge.custom_graph(chunks, entities, relations)
        names = self.table("aliases")
        nodes, kg_edges = resolution.renamed(nodes, names), resolution.renamed(resolution.renamed(kg_edges, names, "src"), names, "tgt")
        new = nodes.select("entity", "entity_type", F.array("description").alias("descriptions"), F.array("source_id").alias("source_ids"))
        old = self.table("entities").join(new.select("entity").distinct(), "entity", "left_semi")
        every = new.withColumn("age", F.lit(1)).unionByName(old.withColumn("age", F.lit(0))).groupBy("entity").agg(
            F.max_by("entity_type", F.struct("age", "entity_type")).alias("entity_type"), merge.set_of("descriptions").alias("descriptions"), merge.set_of("source_ids").alias("source_ids"),
        )
        every = self.store.stage("entities", every)
        held = texts.join(self.table("chunks").select("chunk_id"), "chunk_id", "left_anti").select(
            "chunk_id", F.lit(None).cast("string").alias("full_doc_id"), F.lit(0).alias("chunk_order_index"), F.size(F.split("content", r"\s+")).alias("tokens"), "content"
        )
        one = merge.one_relation(kg_edges)
        append, replace = self._indexed({"chunks": held, "entities": every, "kg_edges": one, "entity_vectors": self.vectors(entity_texts(every))}, False)
        self.store.commit(append=append, replace=replace)

    def graph(self) -> Graph:
        tables = {k: self.table(k) for k in (*VECTORS, "degrees")}
        indexes = {}
        for name in VECTORS if self.cells is not None else ():
            own, _ = self.cells_of(name)
            if own is not None:
                indexes[name.removesuffix("_vectors")] = cells.Index(self.store.layers(name), own)
        lists = {}
        for name in LISTS if self.lists else ():
            kind = name.removesuffix("_lists")
            if layers := self.store.layers(name):
                lists[kind] = impact.Lists(reduce(DataFrame.union, layers), self.table(f"{kind}_sizes"), tables[f"{kind}_vectors"])
        return Graph(*(self.table(k) for k in ("entities", "facts", "edges", "chunks")), embedder=self.embedder, indexes=indexes, lists=lists, **tables)

    def query(self, queries: DataFrame, params: QueryParams = QueryParams()) -> DataFrame:
        """query_id, rank, knowledge, coherence for queries (query_id, text)."""
        return answer(self.graph(), queries, params)

    def resolve(self, at_least: float = 0.9) -> None:
        """Make one entity of those whose vectors are linked by cosines of ``at_least`` or more, under the least of their names.

        Entities, edges, relations, degrees and vectors are rewritten under one manifest, with the names
        that went: later inserts write their mentions under the canonical names.
        """
        vectors = self.table("entity_vectors")
        found = resolution.aliases(vectors.select("name", "vector"), at_least)
        moved = self.store.stage("aliases", found.where("entity <> canonical"))
        if moved.isEmpty():
            return
        known = resolution.renamed(self.table("aliases"), moved, "canonical")
        entities = self.store.stage("entities", merge.joined_entities(self.table("entities"), moved))
        edges = self.store.stage("edges", merge.joined_edges(resolution.renamed(self.table("edges"), moved)))
        kg_edges = merge.one_relation(resolution.renamed(resolution.renamed(self.table("kg_edges"), moved, "src"), moved, "tgt"))
        changed = entities.join(moved.select(F.col("canonical").alias("entity")).distinct(), "entity", "left_semi")
        gone = moved.select(F.col("entity").alias("name")).union(moved.select("canonical")).distinct()
        fresh, (own, _) = self.store.stage("entity_vectors", self.vectors(entity_texts(changed))), self.cells_of("entity_vectors")
        if own is not None:
            fresh = cells.placed(fresh, own.centres)
        kept = vectors.join(gone, "name", "left_anti").unionByName(fresh)
        self.store.commit(append=self._listed({"entity_vectors": fresh}), replace={
            "aliases": known.unionByName(moved), "entities": entities, "edges": edges, "kg_edges": kg_edges, "degrees": node_degree(edges),
            "entity_vectors": kept if own is None else kept.repartition("cell", F.pmod(F.xxhash64("name"), F.lit(4))),
        })

    def delete(self, names: DataFrame) -> None:
        """Remove the entities (name), their edges and vectors, and count the degrees anew, in one commit."""
        entities, edges = merge.delete_entity(self.table("entities"), self.table("edges"), names)
        left = self.store.stage("edges", edges)
        vectors = self.table("entity_vectors").join(entities.select(F.col("entity").alias("name")), "name", "left_semi")
        kg_edges = self.table("kg_edges")
        for end in ("src", "tgt"):
            kg_edges = merge.delete_entity(kg_edges.withColumnRenamed(end, "entity"), self.table("edges"), names)[0].withColumnRenamed("entity", end)
        self.store.commit(replace={"entities": entities, "edges": left, "degrees": node_degree(left), "entity_vectors": vectors, "kg_edges": kg_edges.select("src", "tgt", "weight", "description", "keywords", "source_id")})


class DerivedGraph(Graph):
    """The graph of ``docs`` whose tables and indexes an engine derives when they are first asked for."""

    def __init__(self, engine: Engine, docs: DataFrame):
        super().__init__(*[None] * 4, embedder=engine.embedder)
        self.__dict__ |= {"engine": engine, "docs": docs}

    def __getattribute__(self, name: str):
        if name in ("entities", "facts", "edges", "chunks", "degrees", *VECTORS):
            return self.engine.derived(self.docs, name)
        return DerivedIndexes(self.engine, self.docs) if name == "indexes" else super().__getattribute__(name)


class DerivedIndexes(dict):
    def __init__(self, engine: Engine, docs: DataFrame):
        self.engine, self.docs = engine, docs

    def __contains__(self, kind: str) -> bool:
        return f"{kind}_vectors" in VECTORS

    def __missing__(self, kind: str) -> cells.Index:
        return self.engine.derived_index(self.docs, kind)
