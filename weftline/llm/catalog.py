"""The subpackage's registered queries, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import ann, chat, fim, language, licenses, lines, merkle, mixing, packing, partenum, secrets, suffixes, whitening
from weftline.llm.common import table


#: Wanted shares of languages; sources and topics are flattened by the default temperature.
MIX = mixing.Targets(shares={"lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}}, keep=0.5)


def op1_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_report(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.groups_of(table(spark, sf_dir, "documents"))


def op4_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=1024)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    predicted = language.predict(docs, language.fit(language.labelled(docs)))
    return predicted.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.draw(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), MIX, text=False)
    return drawn.select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("tokens"), "probability")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.dedup(table(spark, sf_dir, "documents"))
    kept = kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), suffixes.as_text(F.col("kept")).alias("text"))
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.transform(table(spark, sf_dir, "documents")))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lines.digest(lines.kept(docs, lines.bitmaps(docs)))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_additive_quantisation": op1_additive_quantisation,
    "op2_merkle_fingerprint": op2_merkle_fingerprint,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_chat_collapse": op4_chat_collapse,
    "op5_license_scan": op5_license_scan,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_language_id": op7_language_id,
    "op8_secret_scan": op8_secret_scan,
    "op9_source_mix": op9_source_mix,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_line_dedup": op12_line_dedup,
    "op13_whitening": op13_whitening,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op2_merkle_fingerprint": merkle.EDIT_SQL,
    "op3_ngram_jaccard": partenum.JOIN_SQL,
    "op4_chat_collapse": chat.RENDER_SQL,
    "op11_fill_in_middle": fim.FIM_SQL,
    "op12_line_dedup": lines.LINES_SQL,
}
