"""Reading the graph: degrees, incident edges, one-hop ranking, text units, components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.text import strip, tokens, unescaped
from weftline.operators.context import within_budget


def symmetric(edges: DataFrame, a: str = "fact", b: str = "entity") -> DataFrame:
    """Each edge from both ends: node, other, weight, seq."""
    cols = [c for c in ("weight", "seq") if c in edges.columns]
    return edges.select(F.col(a).alias("node"), F.col(b).alias("other"), *cols).union(edges.select(b, a, *cols))


def node_degree(edges: DataFrame) -> DataFrame:
    """Node, degree (edges are distinct)."""
    return symmetric(edges).groupBy("node").agg(F.count("*").alias("degree"))


def edge_degree(edges: DataFrame) -> DataFrame:
    """Fact, entity, degree: the sum of both ends'."""
    degree = node_degree(edges)
    return (
        edges.join(degree.toDF("fact", "d1"), "fact", "left").join(degree.toDF("entity", "d2"), "entity", "left")
        .select("fact", "entity", (F.coalesce("d1", F.lit(0)) + F.coalesce("d2", F.lit(0))).alias("degree"))
    )


def incident_edges(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Node, other for every seed; other is null for a node without edges."""
    return seeds.select("node").join(symmetric(edges).select("node", "other"), "node", "left")


def present(keys: DataFrame, table: DataFrame, *on: str) -> DataFrame:
    """The keys that the table has."""
    return keys.join(table, list(on), "left_semi")


def looked_up(keys: DataFrame, table: DataFrame, key: str, *fields: str, default: dict | None = None) -> DataFrame:
    """The fields of each key; where the table lacks it, ``default`` (null for fields not given there)."""
    return keys.join(table.select(key, *fields), key, "left").fillna(default or {}) if default else keys.join(table.select(key, *fields), key, "left")


def related_edges(seeds: DataFrame, edges: DataFrame, degrees: DataFrame | None = None) -> DataFrame:
    """query_id, entity, fact, degree, weight, rank: edges of the seeds (query_id, entity, seed_rank), by degree, then weight, then discovery.

    ``degrees`` (node, degree) are those that an insert has stored; without them they are counted
    for the ends of the seeds' edges alone.
    """
    own = few(seeds.groupBy("query_id", "entity").agg(F.min("seed_rank").alias("seed_rank")), "seeds")
    found = few(edges.select("fact", "entity", "weight", "seq").join(own, "entity"), "found")
    if degrees is None:
        near = edges.join(seeds.select("entity").distinct(), "entity", "left_semi")
        facts = edges.join(near.select("fact").distinct(), "fact", "left_semi").groupBy(F.col("fact").alias("node")).agg(F.count("*").alias("degree"))
        degrees = near.groupBy(F.col("entity").alias("node")).agg(F.count("*").alias("degree")).union(facts)
    ranked = found.join(degrees.toDF("fact", "d1"), "fact").join(degrees.toDF("entity", "d2"), "entity").withColumn("degree", F.col("d1") + F.col("d2"))
    order = Window.partitionBy("query_id").orderBy(F.desc("degree"), F.desc("weight"), "seed_rank", "seq", "fact")
    return ranked.select("query_id", "entity", "fact", "degree", "weight", F.row_number().over(order).alias("rank"))


def text_units_from_entities(seeds: DataFrame, entities: DataFrame, edges: DataFrame, facts: DataFrame) -> DataFrame:
    """query_id, chunk_id, seed_rank, relation_counts: source chunks of the seeds; counted are neighbours that share the chunk."""
    own = seeds.select("entity").distinct()
    held = seeds.join(entities.select("entity", "source_ids"), "entity").withColumn("chunk_id", F.explode("source_ids")).drop("source_ids")
    near = edges.select("entity", "fact").join(own, "entity", "left_semi")  # only the seeds' edges and their facts are opened
    around = near.join(facts.select("fact", "source_ids"), "fact").select("entity", F.explode("source_ids").alias("chunk_id"))
    shared = around.groupBy("entity", "chunk_id").agg(F.count("*").alias("n"))
    counted = held.join(shared, ["entity", "chunk_id"], "left")
    return counted.groupBy("query_id", "chunk_id").agg(F.min("seed_rank").alias("seed_rank"), F.sum(F.coalesce("n", F.lit(0))).alias("relation_counts"))


def entities_from_facts(seeds: DataFrame, edges: DataFrame, entities: DataFrame | None = None, budget: int | None = None) -> DataFrame:
    """query_id, entity, seed_rank, degree of entities next to the seed facts (query_id, fact, seed_rank).

    With ``budget`` a query's entities, in order of rank and name, are kept while the words of their
    descriptions (of ``entities``) stay within it.
    """
    found = few(edges.select("fact", "entity").join(few(seeds, "seeds"), "fact").groupBy("query_id", "entity").agg(F.min("seed_rank").alias("seed_rank")), "found")
    near = edges.select("entity").join(few(found.select("entity").distinct(), "ends"), "entity", "left_semi")
    out = found.join(near.groupBy("entity").agg(F.count("*").alias("degree")), "entity").select("entity", "query_id", "seed_rank", "degree")
    if budget is None:
        return out
    sizes = entities.select("entity", F.size(tokens(F.array_join("descriptions", " "))).alias("n"))
    ordered = sizes.join(few(out, "near"), "entity").withColumn("place", F.struct("seed_rank", "entity"))
    return within_budget(ordered, "query_id", "place", F.col("n"), budget).select("entity", "query_id", "seed_rank", "degree")


def text_units_from_facts(seeds: DataFrame, facts: DataFrame, chunks: DataFrame | None = None, budget: int | None = None) -> DataFrame:
    """query_id, chunk_id, seed_rank: source chunks of the seed facts, by the first fact that has them; within ``budget`` words of ``chunks``, if given."""
    out = seeds.join(facts.select("fact", F.explode("source_ids").alias("chunk_id")), "fact").groupBy("query_id", "chunk_id").agg(F.min("seed_rank").alias("seed_rank"))
    if budget is None:
        return out
    ordered = out.join(chunks.select("chunk_id", "tokens"), "chunk_id").withColumn("place", F.struct("seed_rank", "chunk_id"))
    return within_budget(ordered, "query_id", "place", F.col("tokens"), budget).select("query_id", "chunk_id", "seed_rank")


def with_content(held: DataFrame, chunks: DataFrame, *key: str, latest: int | None = None, by: str | None = None) -> DataFrame:
    """The key and ``content``, the chunks of ``source_ids`` in order of their ids; only the ``latest`` rows by column ``by``, if given."""
    rows = held if latest is None else held.orderBy(F.desc(by), *key).limit(latest)
    met = rows.select(*key, F.explode("source_ids").alias("chunk_id")).join(chunks.select("chunk_id", "content"), "chunk_id", "left")
    parts = F.array_sort(F.collect_list(F.struct("chunk_id", "content")))
    return met.groupBy(*key).agg(F.array_join(F.transform(parts, lambda p: p["content"]), "\n").alias("content"))


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a local one only where the master is local."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named is None and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or "/tmp/checkpoints").rstrip("/")


#: Whether the shuffle files of a statement go when it ends; else they stay until the driver happens to collect its garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(rows: DataFrame, path: str, *by: str) -> None:
    """Rows written as Parquet in folders of ``by``, if given; shuffle files that they were made of are deleted at once."""
    spark, writer = rows.sparkSession, rows.write.option("compression", "zstd")
    before = spark.conf.get(CLEANED, "false")
    spark.conf.set(CLEANED, "true")
    try:
        (writer.partitionBy(*by) if by else writer).parquet(path)
    finally:
        spark.conf.set(CLEANED, before)


def staged(rows: DataFrame, tag: str) -> DataFrame:
    """Rows written to the shared folder and read back: their lineage is cut, and lost executors cost a stage."""
    path = f"{scratch(rows.sparkSession)}/weftline-{tag}-{uuid.uuid4().hex}"
    saved(rows, path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


#: Rows that are sent to all tasks, at most.
FEW = 100_000


def few(rows: DataFrame, tag: str) -> DataFrame:
    """``staged`` rows, which joins send to all tasks where they are few, so that no large table is shuffled for them."""
    rows = staged(rows, tag)
    return F.broadcast(rows) if rows.count() <= FEW else rows


def components(pairs: DataFrame) -> DataFrame:
    """node, label (the least member of its component) of the undirected pairs (a, b).

    Rounds of stars: each node's greater neighbours are hung on its least one, then its lesser ones
    too, until nothing changes. Each round is written.
    """

    def hung_low(edges: DataFrame) -> DataFrame:
        down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        return down.join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).union(low.select("m", "u")).where("a <> b").distinct()

    def hung_high(edges: DataFrame) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.join(low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()

    now, before = staged(hung_low(pairs), "stars"), None
    while before is None or before.count() != now.count() or not now.join(before, ["a", "b"], "left_anti").isEmpty():
        now, before = staged(hung_low(hung_high(now)), "stars"), now
    return now.select(F.col("b").alias("node"), F.col("a").alias("label")).union(now.select("a", "a").distinct())


def largest_component(pairs: DataFrame, apart: bool = False) -> DataFrame:
    """The edges of the largest component, each from its lesser end, in order; of equal ones that with the least member.

    ``apart`` says that pairs are distinct and no ``a`` is a ``b``, as of facts and entities. Then an
    ``a`` only links its ``b``s with the least of them, and rounds go without the ``a``s.
    """
    pairs = pairs.select("a", "b")
    if apart:
        kept = pairs.join(_largest_of_ends(pairs), "b", "left_semi")
        return kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    labels = components(pairs)
    top = labels.groupBy("label").count().orderBy(F.desc("count"), "label").limit(1)
    kept = labels.join(top.select("label"), "label", "left_semi").select(F.col("node").alias("a"))
    return pairs.join(kept, "a", "left_semi").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _largest_of_ends(pairs: DataFrame) -> DataFrame:
    """b: those of the largest component of pairs that are apart."""
    least = pairs.withColumn("low", F.min("b").over(Window.partitionBy("a")))
    met = staged(least.groupBy("low", "b").agg(F.count(F.when(F.col("b") == F.col("low"), 1)).alias("n")), "links")  # n: of the a's whose least end is b
    linked = components(met.where("low <> b").select(F.col("low").alias("a"), "b"))
    ends = met.groupBy("b").agg(F.sum("n").alias("n")).join(linked.withColumnRenamed("node", "b"), "b", "left")
    ends = staged(ends.select("b", "n", F.coalesce("label", "b").alias("label")), "ends")
    sizes = staged(ends.groupBy("label").agg(F.sum(F.col("n") + 1).alias("size")), "sizes")
    top = sizes.where(F.col("size") == (sizes.agg(F.max("size")).first()[0] or 0)).select("label")
    if top.limit(2).count() > 1:  # their least members, a's included
        members = ends.join(top, "label", "left_semi").select("label", "b")
        top = pairs.join(members, "b").groupBy("label").agg(F.least(F.min("a"), F.min("b")).alias("least")).orderBy("least").limit(1).select("label")
    return ends.join(top, "label", "left_semi").select("b")


def stable_component(pairs: DataFrame, apart: bool = False) -> DataFrame:
    """``largest_component`` under names that are stripped, upper-cased and without character references, each edge once from its lesser end, in order."""
    name = lambda c: unescaped(F.upper(strip(F.col(c))))
    named = staged(largest_component(pairs, apart).select(name("a").alias("x"), name("b").alias("y")), "named")
    edges = named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return edges.repartitionByRange("a", "b").distinct().orderBy("a", "b")  # one shuffle serves both
