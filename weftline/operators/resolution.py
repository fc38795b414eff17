"""Entity resolution: an all-pairs similarity join of sparse unit vectors, and the renaming of what is alike.

Features are ordered, rare ones first. Two unit vectors of cosine t or more share a feature among
those of each at which the norm of what follows, itself included, is still t or more (what follows
a shorter prefix could not reach t alone). So only these prefixes meet. Vectors that are equal are
one before that. A feature in the prefixes of very many vectors is not joined with itself: there
all meet the one of the largest value, which is linked with every two whose values there alone
give t, and the others must share a second feature of a longer prefix as well. Both ways lose no
link between components (for vectors without negative values; others are joined plainly).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.access import components, staged

#: Vectors that meet in one feature beyond which a second feature is asked for.
CROWD = 200
SLACK = 1e-9
RARE_FIRST = "array<struct<n: long, bucket: int, value: double>>"


def similar_pairs(vectors: DataFrame, at_least: float = 0.9, digits: int = 9) -> DataFrame:
    """a, b, score of vectors (name, vector) of cosine ``at_least`` or more, enough of them to link all that are linked.

    Equal vectors are linked with the least name among them, those of a crowd with its head (see
    above); every pair that is returned is scored by whole vectors. Empty vectors take no part.
    """
    rows = staged(vectors.select("name", "vector").where(F.size("vector") > 0), "vectors")
    heads = rows.groupBy("vector").agg(F.min("name").alias("head"))
    same = rows.join(heads, "vector").where("name <> head").select(F.col("head").alias("a"), F.col("name").alias("b"), F.lit(1.0).alias("score"))
    entries = heads.select(F.col("head").alias("name"), F.inline("vector"))
    n = entries.groupBy("bucket").agg(F.count("*").alias("n"), F.min("value").alias("low"))
    ordered = entries.join(n.select("bucket", "n"), "bucket").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("n", "bucket", "value"))).alias("features"))
    ordered = staged(ordered, "ordered")

    found = prefixes(ordered, at_least)
    crowded = staged(found.groupBy("bucket").agg(F.count("*").alias("c"), F.max(F.struct("value", "name")).alias("top")).where(F.col("c") > CROWD), "crowded")
    signed = not n.where("low < 0").isEmpty()
    pairs = met(found if signed else found.join(crowded, "bucket", "left_anti"), ["bucket"], at_least)
    if not signed and not crowded.isEmpty():
        in_crowds = found.join(crowded, "bucket")
        head = in_crowds.where((F.col("name") != F.col("top.name")) & (F.col("value") * F.col("top.value") >= at_least - SLACK))
        pairs = pairs.union(head.select(F.least("name", "top.name").alias("a"), F.greatest("name", "top.name").alias("b")))
        second = second_prefixes(in_crowds.select("name", "bucket").join(ordered, "name"), at_least)
        pairs = pairs.union(met(second, ["bucket", "second"], at_least))
    return scored(staged(pairs.distinct(), "pairs"), rows, at_least, digits).union(same)


def prefixes(ordered: DataFrame, at_least: float) -> DataFrame:
    """bucket, name, value, rest: the features by which each vector must be met, with the squares of what follows each."""

    def run(batches):
        for batch in batches:
            out = []
            for name, features in zip(batch.column(0), batch.column(1), strict=True):
                bucket, value, left = arrays(features)
                keep = int((left >= at_least**2 - SLACK).sum())
                rest = np.append(left[1:], 0.0)
                out.append(pa.table({"bucket": bucket[:keep], "name": pa.array([name.as_py()] * keep, pa.string()), "value": value[:keep], "rest": rest[:keep]}))
            if out:
                yield from pa.concat_tables(out).combine_chunks().to_batches()

    return ordered.mapInArrow(run, "bucket int, name string, value double, rest double")


def second_prefixes(rows: DataFrame, at_least: float) -> DataFrame:
    """bucket, second, name, value, rest: for each crowd (bucket) of a vector its further features, up to where crowd and what follows could not reach the cosine."""

    def run(batches):
        for batch in batches:
            out = []
            for name, crowd, features in zip(*(batch.column(k) for k in range(3)), strict=True):
                bucket, value, _ = arrays(features)
                own = bucket == crowd.as_py()
                bucket, value, held = bucket[~own], value[~own], float((value[own] ** 2).sum())
                left = np.cumsum((value**2)[::-1])[::-1]
                keep = int((held + left >= at_least**2 - SLACK).sum())
                # The crowd's feature and the second one are told apart from what follows.
                out.append(pa.table({"bucket": np.full(keep, crowd.as_py(), np.int32), "second": bucket[:keep], "name": pa.array([name.as_py()] * keep, pa.string()), "value": np.sqrt(held + value[:keep] ** 2), "rest": np.append(left[1:], 0.0)[:keep]}))
            if out:
                yield from pa.concat_tables(out).combine_chunks().to_batches()

    return rows.select("name", "bucket", "features").mapInArrow(run, "bucket int, second int, name string, value double, rest double")


def arrays(features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, values, and the squares from each on."""
    flat = features.values
    bucket, value = flat.field("bucket").to_numpy(zero_copy_only=False), flat.field("value").to_numpy(zero_copy_only=False)
    return bucket, value, np.cumsum((value**2)[::-1])[::-1]


def met(rows: DataFrame, on: list[str], at_least: float) -> DataFrame:
    """a, b of rows that share a key, unless what they share there and the norms of what follows fall short."""
    a = rows.select(*on, F.col("name").alias("a"), F.col("value").alias("va"), F.col("rest").alias("ra"))
    b = rows.select(*on, F.col("name").alias("b"), F.col("value").alias("vb"), F.col("rest").alias("rb"))
    most = F.col("va") * F.col("vb") + F.sqrt(F.col("ra") * F.col("rb"))
    return a.join(b, on).where((F.col("a") < F.col("b")) & (most >= at_least - SLACK)).select("a", "b").distinct()


def scored(pairs: DataFrame, vectors: DataFrame, at_least: float, digits: int) -> DataFrame:
    """The pairs whose whole vectors have the cosine."""

    def run(batches):
        for batch in batches:
            score = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                (bx, vx), (by, vy) = ((f.values.field("bucket").to_numpy(zero_copy_only=False), f.values.field("value").to_numpy(zero_copy_only=False)) for f in (x, y))
                _, i, j = np.intersect1d(bx, by, assume_unique=True, return_indices=True)
                score.append(float(vx[i] @ vy[j]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], names=["a", "b", "score"])

    both = pairs.join(vectors.toDF("a", "x"), "a").join(vectors.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a string, b string, score double").withColumn("score", F.round("score", digits)).where(F.col("score") >= at_least)


def aliases(vectors: DataFrame, at_least: float = 0.9) -> DataFrame:
    """entity, canonical: names whose vectors are linked by cosines of ``at_least`` or more, with the least name among them."""
    found = components(similar_pairs(vectors, at_least).select("a", "b"))
    return found.select(F.col("node").alias("entity"), F.col("label").alias("canonical"))


def renamed(rows: DataFrame, names: DataFrame, column: str = "entity") -> DataFrame:
    """``rows`` with the canonical name (of entity, canonical) in ``column``, where there is one."""
    known = names.select(F.col("entity").alias(column), F.col("canonical").alias("_canonical"))
    return rows.join(known, column, "left").select(*[F.coalesce("_canonical", column).alias(c) if c == column else F.col(c) for c in rows.columns])
