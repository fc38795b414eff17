"""QA scores and training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import contains_any, normal_answer, strip


def exact_match(prediction: Column, golds: Column) -> Column:
    """1 if any gold equals the prediction, both normalised."""
    return F.when(F.exists(golds, lambda g: normal_answer(g) == normal_answer(prediction)), 1.0).otherwise(0.0)


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 of the words' multisets; 0 without a common word."""
    words = lambda c: F.filter(F.split(normal_answer(c), " "), lambda w: w != "")
    p, g = words(prediction), words(gold)
    count = lambda a, w: F.size(F.filter(a, lambda x: x == w))
    same = F.aggregate(F.array_intersect(p, g), F.lit(0), lambda s, w: s + F.least(count(p, w), count(g, w)))
    return F.when(same == 0, 0.0).otherwise(2.0 * same / (F.size(p) + F.size(g)))


def best_f1(prediction: Column, golds: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(golds, lambda g: token_f1(prediction, g))), F.lit(0.0))


def scores(examples: DataFrame) -> DataFrame:
    """N, em, f1 over (prediction, golds); 0 for no example."""
    return examples.agg(
        F.count("*").alias("n"),
        F.coalesce(F.avg(exact_match(F.col("prediction"), F.col("golds"))), F.lit(0.0)).alias("em"),
        F.coalesce(F.avg(best_f1(F.col("prediction"), F.col("golds"))), F.lit(0.0)).alias("f1"),
    )


def retrieval_summary(results: DataFrame) -> DataFrame:
    """Rate of queries with a result and their mean top coherence, over (query_id, coherence, null without result)."""
    top = results.groupBy("query_id").agg(F.max("coherence").alias("c"))
    return top.agg(F.count("*").alias("n"), F.avg(F.when(F.col("c").isNotNull(), 1.0).otherwise(0.0)).alias("success"), F.coalesce(F.avg("c"), F.lit(0.0)).alias("coherence"))


def rag_summary(results: DataFrame) -> DataFrame:
    """N and the rates of questions with a retrieved context, with an answer, and with an answer that holds one of the golds, over (context, answer, golds)."""
    there = lambda c: F.coalesce(strip(F.col(c)) != "", F.lit(False))
    met = there("answer") & F.coalesce(contains_any(F.col("answer"), F.col("golds")), F.lit(False))
    rate = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    return results.agg(F.count("*").alias("n"), rate(there("context")).alias("retrieved"), rate(there("answer")).alias("answered"), rate(met).alias("matched"))


def training_rows(questions: DataFrame, source: str, split: str, instruction: str, *keep: str) -> DataFrame:
    """Nested rows for training from (index, question, golden_answers), with the columns ``keep``."""
    asked = F.concat(F.lit(instruction + "Question: "), "question")
    return questions.select(
        *keep,
        F.lit(source).alias("data_source"),
        F.array(F.struct(F.lit("user").alias("role"), asked.alias("content"))).alias("prompt"),
        F.lit("multihop_qa").alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.col("golden_answers").alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), F.col("index").cast("string").alias("index"), F.col("golden_answers").alias("answer"), "question").alias("extra_info"),
    )
