"""A training corpus from raw documents: language ID, near-duplicate removal, secret masking, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import language, mixing, packing, partenum, secrets
from weftline.llm.common import stash, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIX = mixing.Targets(shares={"lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}}, keep=0.5)


#: Ids below which, or above whose negative, there is room for numbers of monotonically_increasing_id.
ROOM = 1 << 62


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those that are rejected (no letters, or far from every centroid) go."""
    return language.accepted(docs.select(COLUMNS), language.fit(language.labelled(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group linked by five-word shingles at 0.75 or more.

    A document is a doc_id with a text (null: empty): different texts of one doc_id go only if they
    are linked. Of rows equal in both, that of least lang, source and n_chars stays. Rows without
    doc_id take no part and all stay.
    """
    rows = docs.select(COLUMNS)
    named = rows.where("doc_id IS NOT NULL").withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    # The first text of a doc_id is known by it; any others get numbers that no document has.
    span = named.groupBy("doc_id").agg(F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi"))
    several = stash(span.where("lo <> hi").select("doc_id", "lo"), "several")
    others = named.join(several, "doc_id").where("text_hash <> lo").select("doc_id", "text_hash").distinct()
    least, most = named.agg(F.min("doc_id"), F.max("doc_id")).first()
    number = F.monotonically_increasing_id()
    if several.isEmpty():
        others = several.select("doc_id", F.col("lo").alias("text_hash"))
    elif most < ROOM:
        number = number + (max(most, -1) + 1)
    elif least > -ROOM:
        number = min(least, 0) - 1 - number
    else:  # ids at both ends of a long leave no room: every text is known by a number
        others = named.select("doc_id", "text_hash").distinct()
    others = stash(others.withColumn("other", number), "others")
    n_others = others.count()
    if n_others:
        few = F.broadcast(others) if n_others <= partenum.BROADCAST_IDS else others
        named = named.join(few, ["doc_id", "text_hash"], "left").withColumn("node", F.coalesce("other", "doc_id"))
    else:
        named = named.withColumn("node", F.col("doc_id"))
    groups = partenum.groups_of(named.select(F.col("node").alias("doc_id"), "text")).select(F.col("doc_id").alias("node"), "component_id")
    known = groups.join(others.select(F.col("other").alias("node"), F.col("doc_id").alias("own")), "node", "left")
    kept = known.groupBy("component_id").agg(F.min(F.struct(F.coalesce("own", "node").alias("own"), "node")).alias("least")).select("least.node")
    left = named.join(kept, "node", "left_semi").groupBy("node").agg(*(F.first(c).alias(c) for c in ("doc_id", "text")), F.min(F.struct("lang", "source", "n_chars")).alias("rest"))
    return left.select("doc_id", "text", "rest.*").select(COLUMNS).union(rows.where("doc_id IS NULL"))


def secret_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each reported secret replaced by a mask; n_chars is counted anew where text changed."""
    return secrets.redact(docs.select(COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights of languages, sources and topics."""
    return mixing.draw(docs.select(COLUMNS), MIX).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences of 1024 tokens."""
    return packing.pack(docs, capacity=1024)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_masks", secret_masks),
    ("mix", mix),
    ("pack", pack),
]

#: Raking, learned centroids and packing are no SQL; the tests hold near duplicates, masks, mixing and
#: packing against brute force on a small table, and language ID against its model, row by row.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
