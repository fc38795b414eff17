"""Chat formatting: logged snapshots of a growing conversation collapse into the longest one.

The rolling hash of a prefix is the exclusive or of its turns' hashes, each with the turn's place,
so one window pass gives the hash of every prefix. A conversation whose whole hash is the hash of a
proper prefix of another goes (anti-join); of equal ones the smallest conv_id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def placed_turns(conversations: DataFrame) -> DataFrame:
    """Turns with their place from 1: by turn, then role and text (null role and text: empty; null conv_id goes)."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    return rows.withColumn("place", F.row_number().over(order))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, place, h1, h2: two 64-bit hashes of the turns up to this place."""
    so_far = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return turns.select(
        "conv_id",
        "place",
        F.bit_xor(F.xxhash64("place", "role", "text")).over(so_far).alias("h1"),
        F.bit_xor(F.xxhash64("text", "place", "role")).over(so_far).alias("h2"),
        F.lead("place").over(Window.partitionBy("conv_id").orderBy("place")).isNull().alias("whole"),
    )


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that are no proper prefix of another."""
    prefixes = prefix_hashes(placed_turns(conversations))
    whole = prefixes.where("whole").groupBy("h1", "h2", "place").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = prefixes.where("not whole").select("h1", "h2", "place").distinct()
    return whole.join(inner, ["h1", "h2", "place"], "left_anti").select("conv_id", F.col("place").cast("long").alias("n_turns"), "n_copies")


def render(conversations: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """Maximal conversations as one text each: conv_id, n_turns, n_copies, text.

    Null roles and texts count as empty, null turns come last, ties in turn go by role and text, and
    rows without conv_id are left out. Repeated rows are turns of their own. An empty table gives no
    row. Columns beyond conv_id, turn, role and text are not read. Roles and texts are rendered as they
    are: marks that a text itself holds are not escaped, so who trains on untrusted logs removes them first.
    """
    turns = placed_turns(conversations).join(maximal(conversations), "conv_id")
    line = F.concat(F.lit(start), "role", F.lit("\n"), "text", F.lit(end + "\n"))
    parts = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))
    return turns.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "").alias("text"))


RENDER_SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
whole AS (
  SELECT conv_id, count(*) AS n_turns, list(role || chr(31) || text ORDER BY place) AS said,
         string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
  FROM turns GROUP BY conv_id),
one AS (SELECT said, n_turns, text, min(conv_id) AS conv_id, count(*) AS n_copies FROM whole GROUP BY ALL),
inner_prefixes AS (
  SELECT DISTINCT list_slice(said, 1, k) AS said FROM (SELECT said, unnest(range(1, n_turns)) AS k FROM one))
SELECT conv_id, n_turns, n_copies, text FROM one WHERE said NOT IN (SELECT said FROM inner_prefixes)
"""
