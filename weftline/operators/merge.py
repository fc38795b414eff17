"""Merging mentions into the graph, upserts and deletes. Every merge is a union with the stored state and an aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_of(arrays: str) -> Column:
    """The sorted set of all members of a group's arrays."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(arrays))))


def merged_facts(facts: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Fact, weight (sum), source_ids (sorted set)."""
    new = facts.select("fact", "weight", F.array("chunk_id").alias("source_ids"))
    return (new.unionByName(state) if state is not None else new).groupBy("fact").agg(F.sum("weight").alias("weight"), set_of("source_ids").alias("source_ids"))


def merged_entities(mentions: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Entity, entity_type (most votes, a stored type has one; ties to the type first seen, new ones before stored), descriptions, source_ids."""
    new = mentions.select("entity", "entity_type", F.struct(F.lit(0).alias("old"), "chunk_id", "pos").alias("seen"), F.array("description").alias("descriptions"), F.array("chunk_id").alias("source_ids"))
    if state is not None:
        old = state.select("entity", "entity_type", F.struct(F.lit(1).alias("old"), F.lit("").alias("chunk_id"), F.lit(0).alias("pos")).alias("seen"), "descriptions", "source_ids")
        new = new.unionByName(old)
    # Rows of an entity meet once, for both groupings.
    by_type = new.repartition("entity").groupBy("entity", "entity_type").agg(F.count("*").alias("votes"), F.min("seen").alias("first"), set_of("descriptions").alias("descriptions"), set_of("source_ids").alias("source_ids"))
    best = F.min_by("entity_type", F.struct(-F.col("votes"), F.col("first")))
    return by_type.groupBy("entity").agg(best.alias("entity_type"), set_of("descriptions").alias("descriptions"), set_of("source_ids").alias("source_ids"))


def merged_edges(mentions: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Fact, entity, weight (sum), source_ids, seq (chunk and place first seen)."""
    new = mentions.select("fact", "entity", "weight", F.array("chunk_id").alias("source_ids"), F.struct("chunk_id", "pos").alias("seq"))
    both = new.unionByName(state) if state is not None else new
    return both.groupBy("fact", "entity").agg(F.sum("weight").alias("weight"), set_of("source_ids").alias("source_ids"), F.min("seq").alias("seq"))


def edges_of_statements(rows: DataFrame) -> DataFrame:
    """``merged_edges`` of facts with the entities bound to them (see ``extraction.statements``): a fact is moved once for all its entities, and its edges lie together."""
    moved = rows.where(F.size("named") > 0).select("fact", "chunk_id", F.transform("named", lambda e: F.struct(e["entity"].alias("entity"), e["weight"].alias("weight"), e["pos"].alias("pos"))).alias("named")).repartition("fact")
    return merged_edges(moved.select("fact", "chunk_id", F.inline("named"))).sortWithinPartitions("fact", "entity")


def joined_entities(entities: DataFrame, names: DataFrame) -> DataFrame:
    """Entities under their canonical names (entity, canonical): the type that most of them have, ties to that of the least name; all descriptions and sources."""
    moved = entities.join(names.select("entity", "canonical"), "entity", "left").withColumn("canonical", F.coalesce("canonical", "entity"))
    by_type = moved.groupBy("canonical", "entity_type").agg(F.count("*").alias("votes"), F.min("entity").alias("first"), set_of("descriptions").alias("descriptions"), set_of("source_ids").alias("source_ids"))
    best = F.min_by("entity_type", F.struct(-F.col("votes"), F.col("first")))
    return by_type.groupBy(F.col("canonical").alias("entity")).agg(best.alias("entity_type"), set_of("descriptions").alias("descriptions"), set_of("source_ids").alias("source_ids"))


def joined_edges(edges: DataFrame) -> DataFrame:
    """One edge for each fact and entity after entities were renamed: summed weights, all sources, first place."""
    return edges.groupBy("fact", "entity").agg(F.sum("weight").alias("weight"), set_of("source_ids").alias("source_ids"), F.min("seq").alias("seq"))


def one_relation(kg_edges: DataFrame) -> DataFrame:
    """One hand-made relation for each pair of ends: the greatest row."""
    greatest = F.max(F.struct("weight", "description", "keywords", "source_id"))
    return kg_edges.groupBy("src", "tgt").agg(greatest.alias("row")).select("src", "tgt", "row.*")


def summarised(entities: DataFrame, summarise, limit: int = 500) -> DataFrame:
    """Descriptions of ``limit`` words or more go through ``summarise`` (Column to Column); others stay."""
    text = F.array_join("descriptions", "<SEP>")
    long = F.size(F.split(text, r"\s+")) >= limit
    return entities.where(~long).withColumn("description", text).unionByName(entities.where(long).withColumn("description", summarise(text)))


def new_keys(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """incoming rows whose key is not stored."""
    return incoming.join(stored.select(key).distinct(), key, "left_anti")


def insert_absent(stored: DataFrame, incoming: DataFrame, *key: str) -> DataFrame:
    """Stored rows, and incoming ones with a new key; of several incoming rows of one key the least."""
    rest = [c for c in incoming.columns if c not in key]
    once = incoming.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row")).select(*key, "_row.*") if rest else incoming.distinct()
    return stored.unionByName(once.join(stored.select(*key).distinct(), list(key), "left_anti"))


def replace_rows(stored: DataFrame, incoming: DataFrame, *key: str) -> DataFrame:
    """Incoming rows, and stored ones with no incoming row of their key."""
    return incoming.unionByName(stored.join(incoming.select(*key).distinct(), list(key), "left_anti"))


def merge_attributes(stored: DataFrame, incoming: DataFrame, *key: str) -> DataFrame:
    """All keys of both; an attribute that an incoming row has goes before the stored one."""
    rest = [c for c in stored.columns if c not in key]
    joined = stored.alias("s").join(incoming.alias("n"), list(key), "full")
    return joined.select(*key, *[F.coalesce(F.col(f"n.{c}"), F.col(f"s.{c}")).alias(c) for c in rest])


def delete_entity(entities: DataFrame, edges: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and edges without the named entities (``name``, unquoted); facts that are left alone stay."""
    gone = names.select(F.concat(F.lit('"'), F.upper("name"), F.lit('"')).alias("entity")).distinct()
    return entities.join(gone, "entity", "left_anti"), edges.join(gone, "entity", "left_anti")


def custom_graph(chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks (chunk_id, content), nodes and kg_edges from hand-made tables; unknown sources and missing end points are UNKNOWN."""
    from weftline.functions.text import hash_id

    ids = chunks.select("source_id", hash_id(F.col("content"), "chunk-").alias("chunk_id"), "content")
    source = ids.groupBy("source_id").agg(F.max("chunk_id").alias("chunk_id"))
    quoted = lambda c: F.concat(F.lit('"'), F.upper(c), F.lit('"'))
    nodes = entities.join(source, "source_id", "left").select(
        quoted("entity_name").alias("entity"), F.coalesce("entity_type", F.lit("UNKNOWN")).alias("entity_type"),
        F.coalesce("description", F.lit("No description provided")).alias("description"), F.coalesce("chunk_id", F.lit("UNKNOWN")).alias("source_id"),
    )
    edges = relations.join(source, "source_id", "left").select(
        quoted("src_id").alias("src"), quoted("tgt_id").alias("tgt"), F.coalesce("weight", F.lit(1.0)).alias("weight"), "description", "keywords", F.coalesce("chunk_id", F.lit("UNKNOWN")).alias("source_id"),
    )
    ends = edges.select(F.col("src").alias("entity"), "source_id").union(edges.select("tgt", "source_id")).groupBy("entity").agg(F.min("source_id").alias("source_id"))
    missing = ends.join(nodes.select("entity").distinct(), "entity", "left_anti").select("entity", F.lit("UNKNOWN").alias("entity_type"), F.lit("UNKNOWN").alias("description"), "source_id")
    return ids.select("chunk_id", "content").distinct(), nodes.unionByName(missing), edges
