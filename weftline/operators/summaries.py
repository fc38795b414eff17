"""Long description lists reduced by a model in a tree, whose parts are kept by the hash of what they cover.

Descriptions of an entity are cut into groups where the hash of one says so, so a new description
changes the group that it falls in and no other; groups beyond what a model reads are cut again.
Each group's summary stands for it, and so on until what is left is short. A group whose hash is
known is not sent to the model again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import tokens
from weftline.operators.access import staged

SEPARATOR = "<SEP>"
#: One description in so many ends its group.
GROUP = 8
#: Levels of the tree, at most; what is still long then stays as it is.
LEVELS = 8

#: From (hash, content), where content is descriptions between separators, to (hash, summary).
Model = Callable[[DataFrame], DataFrame]


def rule_summaries(parts: DataFrame, words: int = 40) -> DataFrame:
    """Offline model: the first words of each description of a group, ``words`` in all."""
    each = F.split("content", rf"\Q{SEPARATOR}\E")
    share = F.greatest(F.lit(1), F.floor(words / F.size(each)).cast("int"))
    return parts.select("hash", F.array_join(F.transform(each, lambda d: F.array_join(F.slice(tokens(d), F.lit(1), share), " ")), "; ").alias("summary"))


def summarised(entities: DataFrame, known: DataFrame, model: Model, limit: int = 500, reads: int = 4000) -> tuple[DataFrame, DataFrame]:
    """Summaries (entity, summary) of entities (entity, descriptions) of ``limit`` words or more, and the parts (hash, summary) that were made.

    ``known`` are the parts made before. A model gets at most about ``reads`` words at once, unless
    one description alone has more.
    """
    each = entities.select("entity", F.posexplode("descriptions").alias("place", "text")).withColumn("n", F.size(tokens(F.col("text"))))
    whole = Window.partitionBy("entity")
    rows = staged(each.withColumn("total", F.sum("n").over(whole)).where(F.col("total") >= limit).drop("total"), "long")
    made = known.limit(0).select("hash", "summary")
    done = rows.limit(0)
    for level in range(LEVELS):
        sized = rows.withColumn("total", F.sum("n").over(whole))
        done = done.unionByName(sized.where(F.col("total") < limit).drop("total"))
        rows = sized.where(F.col("total") >= limit).drop("total")
        if rows.isEmpty():
            break
        before = Window.partitionBy("entity").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        ends = F.coalesce(F.sum((F.pmod(F.crc32("text"), F.lit(GROUP)) == 0).cast("int")).over(before), F.lit(0)) if level == 0 else F.lit(0)
        grouped = rows.withColumn("g", ends)
        within = Window.partitionBy("entity", "g").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        grouped = grouped.withColumn("h", F.floor((F.sum("n").over(within) - F.col("n")) / reads))
        in_order = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda p: p["text"])
        groups = grouped.groupBy("entity", "g", "h").agg(F.min("place").alias("place"), F.array_join(in_order, SEPARATOR).alias("content"))
        groups = staged(groups.withColumn("hash", F.md5("content")), "groups")
        new = groups.select("hash", "content").distinct().join(known.select("hash").union(made.select("hash")), "hash", "left_anti")
        made = staged(made.unionByName(model(new).select("hash", "summary")), "parts")
        parts = known.select("hash", "summary").unionByName(made)
        rows = groups.join(parts, "hash").select("entity", "place", F.col("summary").alias("text"), F.size(tokens(F.col("summary"))).alias("n"))
        rows = staged(rows, "level")
    left = done.unionByName(rows)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda p: p["text"])
    return left.groupBy("entity").agg(F.array_join(texts, " ").alias("summary")), made
