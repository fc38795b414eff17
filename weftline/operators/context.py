"""Context assembly: token budgets, merged sources, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within_budget(rows: DataFrame, group: str, rank: str, tokens: Column, limit: int) -> DataFrame:
    """The longest prefix by rank whose tokens sum to the limit at most."""
    so_far = Window.partitionBy(group).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(tokens).over(so_far)).where((F.col("used") <= limit) & F.lit(limit > 0))


def combined(first: DataFrame, second: DataFrame) -> DataFrame:
    """Distinct items (group, pos, item) of both lists, the first list's before the second's, numbered anew."""
    both = first.select("group", F.lit(0).alias("part"), "pos", "item").union(second.select("group", F.lit(1), "pos", "item"))
    once = both.where("item <> ''").groupBy("group", "item").agg(F.min(F.struct("part", "pos")).alias("at"))
    return once.select("group", "item", F.row_number().over(Window.partitionBy("group").orderBy("at")).alias("pos"))


def sources_text(rows: DataFrame, top: int = 5) -> DataFrame:
    """Q9: query_id, context: "[Source i]" blocks of the top rows (query_id, rank, knowledge), a blank line between."""
    kept = rows.where(F.col("rank") <= top)
    block = F.concat(F.lit("[Source "), F.col("rank"), F.lit("]\n"), F.col("knowledge"))
    parts = F.array_sort(F.collect_list(F.struct("rank", block.alias("text"))))
    return kept.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("context"))


def answers_json(rows: DataFrame) -> DataFrame:
    """Q8: query_id, json: the query's ranked results as one JSON string."""
    items = F.array_sort(F.collect_list(F.struct("rank", "knowledge", "coherence")))
    results = F.transform(items, lambda r: F.struct(r["knowledge"].alias("<knowledge>"), r["coherence"].alias("<coherence>")))
    return rows.groupBy("query_id").agg(F.to_json(F.struct(F.col("query_id").alias("query"), results.alias("results"))).alias("json"))


def filled(template: str, **slots: Column) -> Column:
    """A template with each {slot} replaced by a column (null: empty); braces in the values are safe, as each slot is cut out first."""
    parts, rest = [], template
    while places := [(rest.find("{" + name + "}"), name) for name in slots if "{" + name + "}" in rest]:
        at, name = min(places)
        parts += [F.lit(rest[:at]), F.coalesce(slots[name].cast("string"), F.lit(""))]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts, F.lit(rest))
