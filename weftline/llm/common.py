"""Helpers that the operators share: scratch tables, document columns, table paths."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.access import scratch

def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/weftline-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Shuffle partitions of the session; the unit in which salts and ranges are dealt out."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id and text (null: empty), with the named columns; columns beyond those are left behind."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *keep,
    )
