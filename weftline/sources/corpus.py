"""Corpus files: JSON lines, plain text, GraphML, QA arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import strip

CORPUS = "id string, contents string, title string, source_file string, chunk_index int"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are no JSON are left out; missing id and title come from a hash of the row, missing contents are empty."""
    raw = spark.read.schema(CORPUS + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    good = raw.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    name = F.substring(F.md5(F.coalesce("contents", F.lit(""))), 1, 16)
    return good.withColumns({"id": F.coalesce("id", F.concat(F.lit("doc-"), name)), "title": F.coalesce("title", F.concat(F.lit("Document "), name)), "contents": F.coalesce("contents", F.lit(""))})


def read_corpus_strict(spark: SparkSession, path: str) -> DataFrame:
    """Any bad line fails the job."""
    return spark.read.schema(CORPUS).option("mode", "FAILFAST").json(path)


def read_texts(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("txt", "md", "text")) -> DataFrame:
    """Path, text of whole files, stripped; UTF-8, else Latin-1; blank files are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").option("recursiveFileLookup", "true").load(path)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    return files.select("path", strip(text).alias("text")).where("text <> ''")


def write_corpus(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Refuses to replace a corpus unless told to."""
    rows.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def append_corpus(rows: DataFrame, path: str) -> None:
    """Uploads, with their time and origin."""
    rows.withColumns({"upload_date": F.current_timestamp().cast("string"), "source": F.lit("upload")}).write.mode("append").json(path)


def valid_uploads(files: DataFrame) -> DataFrame:
    """A2: files (path, content) with ``error``: null, or why the upload is refused."""
    name, text = F.lower("path"), F.col("content").cast("string")
    error = F.when(~name.endswith(".txt"), "only .txt files").when(~F.is_valid_utf8(text), "not UTF-8").when(strip(text) == "", "empty file")
    return files.withColumn("error", error)


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a GraphML file; quotes are dropped, missing attributes empty or 0."""
    data = "data array<struct<_key string, _VALUE string>>"
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    value = lambda k: F.coalesce(F.replace(F.try_element_at(F.filter("data", lambda x: x["_key"] == k), F.lit(1))["_VALUE"], F.lit('"'), F.lit("")), F.lit(""))
    bare = lambda c: F.replace(F.col(c), F.lit('"'), F.lit(""))
    nodes = read("node", f"_id string, {data}").select(bare("_id").alias("id"), value("d0").alias("entity_type"), value("d1").alias("description"), value("d2").alias("source_id"))
    edges = read("edge", f"_source string, _target string, {data}").select(
        bare("_source").alias("source"), bare("_target").alias("target"), F.coalesce(value("d3").try_cast("double"), F.lit(0.0)).alias("weight"),
        value("d4").alias("description"), value("d5").alias("keywords"), value("d6").alias("source_id"),
    )
    return nodes, edges


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges (as ``read_graphml`` gives them) under ``path``/nodes and ``path``/edges, each part a GraphML file."""
    data = lambda fields: F.array(*[F.struct(F.lit(k).alias("_key"), F.col(c).cast("string").alias("_VALUE")) for k, c in fields]).alias("data")
    write = lambda rows, tag, to: rows.write.format("xml").option("rootTag", "graphml").option("rowTag", tag).save(f"{path}/{to}")
    write(nodes.select(F.col("id").alias("_id"), data((("d0", "entity_type"), ("d1", "description"), ("d2", "source_id")))), "node", "nodes")
    write(edges.select(F.col("source").alias("_source"), F.col("target").alias("_target"), data((("d3", "weight"), ("d4", "description"), ("d5", "keywords"), ("d6", "source_id")))), "edge", "edges")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question, golden_answers of a JSON array."""
    return spark.read.schema("question string, golden_answers array<string>").option("multiLine", True).json(path)


def write_questions(questions: DataFrame, path: str) -> None:
    """The questions as Parquet."""
    questions.select("question", "golden_answers").write.mode("overwrite").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines; replaces what is there."""
    rows.write.mode("overwrite").json(path)


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database, with partition options passed through."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
