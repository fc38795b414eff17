"""From chunks to mentions: prompts, model calls, and the parser of the record grammar."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import clean, number_or, parsed_json, split_markers, strip

# Delimiters of the record grammar and the mark of facts.
FIELD, RECORD, DONE = "<|>", "##", "<|COMPLETE|>"
FACT_MARK = "<bipartite_edge>"

Model = Callable[[str, list[dict]], str]


def prompt(template: str, content: Column, **slots: str) -> Column:
    """The template with its slots filled; braces in the content are safe, as it goes in last."""
    for name, value in slots.items():
        template = template.replace("{" + name + "}", value)
    return F.replace(F.lit(template), F.lit("{input_text}"), content)


def extracted(chunks: DataFrame, model: Model, ask: Column, gleanings: int = 2, more: str = "MORE", again: str = "LOOP") -> DataFrame:
    """chunk_id, response: a model's answer to ``ask`` and up to ``gleanings`` further passes, appended without separator."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = []
            for question in batch["ask"]:
                text = model(question, [])
                history = [{"role": "user", "content": question}, {"role": "assistant", "content": text}]
                for k in range(gleanings):
                    extra = model(more, history)
                    history += [{"role": "user", "content": more}, {"role": "assistant", "content": extra}]
                    text += extra
                    if k == gleanings - 1 or model(again, history).strip().strip("\"'").lower() != "yes":
                        break
                answers.append(text)
            yield pd.DataFrame({"chunk_id": batch["chunk_id"], "response": answers})

    return chunks.select("chunk_id", ask.alias("ask")).mapInPandas(run, "chunk_id string, response string")


def rule_responses(chunks: DataFrame, least: int = 9) -> DataFrame:
    """Offline extractor: chunk_id, response in the record grammar. A sentence is a fact, its words of ``least`` letters are entities."""
    plain = F.translate(F.regexp_replace("content", r"\s+", " "), '#<>|"()', "")
    facts = F.filter(F.transform(F.regexp_extract_all(plain, F.lit("[^.!?]+[.!?]*"), F.lit(0)), strip), lambda s: s != "")

    def records(s):
        words = F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit(f"[a-z]{{{least},}}"), F.lit(0)))
        fact = F.concat(F.lit(f'("hyper-relation"{FIELD}"'), s, F.lit(f'"{FIELD}'), (F.length(s) % 10 + 1).cast("string"), F.lit(")"))
        entity = lambda w: F.concat(F.lit(f'("entity"{FIELD}"'), w, F.lit(f'"{FIELD}"term"{FIELD}"'), F.left(s, F.lit(40)), F.lit(f'"{FIELD}'), F.least(F.length(w) * 5, F.lit(100)).cast("string"), F.lit(")"))
        return F.concat(F.array(fact), F.transform(words, entity))

    text = F.concat(F.array_join(F.flatten(F.transform(facts, records)), RECORD), F.lit(DONE))
    return chunks.select("chunk_id", text.alias("response"))


def records(responses: DataFrame) -> DataFrame:
    """chunk_id, pos, attrs: the fields of each record in parentheses."""
    split = responses.select("chunk_id", F.posexplode(split_markers(F.col("response"), RECORD, DONE)).alias("pos", "record"))
    body = F.regexp_extract("record", r"(?d)\((.*)\)", 1)
    return split.where(F.col("record").rlike(r"(?d)\(.*\)")).select("chunk_id", "pos", split_markers(body, FIELD).alias("attrs"))


#: A row of ``statements``; ``named`` are the entities bound to the fact.
STATEMENT = "chunk_id string, pos int, fact string, weight double, named array<struct<pos: int, entity: string, entity_type: string, description: string, weight: double>>"


def statements(responses: DataFrame) -> DataFrame:
    """The ``facts`` of the responses' records, each with the ``mentions`` bound to it; a response is read by itself, so nothing is shuffled."""
    split = responses.select("chunk_id", split_markers(F.col("response"), RECORD, DONE).alias("parts"))
    fields = lambda part: F.when(part.rlike(r"(?d)\(.*\)"), split_markers(F.regexp_extract(part, r"(?d)\((.*)\)", 1), FIELD))

    def record(a: Column) -> Column:
        attr = lambda k: F.get(a, F.lit(k))
        is_fact, is_entity = (F.size(a) >= 3) & (attr(0) == '"hyper-relation"'), (F.size(a) >= 5) & (attr(0) == '"entity"')
        said = F.when(is_fact, F.array(attr(1))).when(is_entity, F.array(F.upper(attr(1)), F.upper(attr(2)), attr(3)))
        return F.struct(is_fact.alias("is_fact"), F.try_element_at(a, F.lit(-1)).alias("last"), F.transform(said, clean).alias("said"))

    rows = split.select("chunk_id", F.transform("parts", fields).alias("rows")).select("chunk_id", F.transform("rows", record).alias("rows"))
    places = F.filter(F.transform("rows", lambda r, i: F.when(r["is_fact"], i)), lambda i: i.isNotNull())
    # An explode that is not outer has Spark check its array in a filter of its own, which reads the whole response thrice.
    each = rows.select("chunk_id", "rows", places.alias("places")).select("chunk_id", "rows", "places", F.posexplode_outer("places").alias("k", "pos")).where("pos IS NOT NULL")
    until = F.coalesce(F.get("places", F.col("k") + 1), F.size("rows"))
    said = each.select("chunk_id", "pos", F.get("rows", "pos").alias("fact"), F.slice("rows", F.col("pos") + 2, until - F.col("pos") - 1).alias("after"))
    part = lambda r, k: F.get(r["said"], F.lit(k))
    entity = lambda r, i: F.when(
        strip(part(r, 0)) != "",
        F.struct((F.col("pos") + 1 + i).alias("pos"), part(r, 0).alias("entity"), part(r, 1).alias("entity_type"), part(r, 2).alias("description"), number_or(r["last"], 50.0).alias("weight")),
    )
    named = F.filter(F.transform("after", entity), lambda e: e.isNotNull())
    return said.select("chunk_id", "pos", F.concat(F.lit(FACT_MARK), part(F.col("fact"), 0)).alias("fact"), number_or(F.col("fact.last"), 1.0).alias("weight"), named.alias("named"))


def facts(rows: DataFrame) -> DataFrame:
    """chunk_id, pos, fact, weight."""
    attr = lambda k: F.try_element_at("attrs", F.lit(k))
    good = rows.where((F.size("attrs") >= 3) & (attr(1) == '"hyper-relation"'))
    return good.select("chunk_id", "pos", F.concat(F.lit(FACT_MARK), clean(attr(2))).alias("fact"), number_or(attr(-1), 1.0).alias("weight"))


def mentions(rows: DataFrame) -> DataFrame:
    """Entities, each bound to the fact last named before it in its chunk; those before the first fact go."""
    attr = lambda k: F.try_element_at("attrs", F.lit(k))
    is_fact = (F.size("attrs") >= 3) & (attr(1) == '"hyper-relation"')
    is_entity = (F.size("attrs") >= 5) & (attr(1) == '"entity"')
    said = F.when(is_fact, F.array(attr(2))).when(is_entity, F.array(F.upper(attr(2)), F.upper(attr(3)), attr(4)))
    cleaned = rows.where(is_fact | is_entity).select("chunk_id", "pos", is_fact.alias("is_fact"), attr(-1).alias("last"), F.transform(said, clean).alias("said"))
    so_far = Window.partitionBy("chunk_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    fact = F.when(F.col("is_fact"), F.concat(F.lit(FACT_MARK), F.col("said")[0]))
    bound = cleaned.withColumn("fact", F.last(fact, ignorenulls=True).over(so_far)).where(~F.col("is_fact") & F.col("fact").isNotNull())
    part = lambda k: F.get("said", F.lit(k))
    named = bound.select("chunk_id", "pos", "fact", part(0).alias("entity"), part(1).alias("entity_type"), part(2).alias("description"), number_or(F.col("last"), 50.0).alias("weight"))
    return named.where(strip(F.col("entity")) != "")


KEYWORDS = "high_level_keywords array<string>, low_level_keywords array<string>"


def keywords(response: Column) -> Column:
    """Struct of both lists from a model's answer; empty lists where it holds no such JSON."""
    found, none = parsed_json(response, KEYWORDS), F.array().cast("array<string>")
    return F.struct(*[F.coalesce(found[k], none).alias(k) for k in ("high_level_keywords", "low_level_keywords")])


def rule_keywords(question: Column, least: int = 9) -> Column:
    """The offline rule for X10: distinct lower-cased words of ``least`` letters as themes, those of four or more as particulars."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(question), F.lit("[a-z]{4,}"), F.lit(0)))
    return F.struct(F.filter(words, lambda w: F.length(w) >= least).alias("high_level_keywords"), F.filter(words, lambda w: F.length(w) < least).alias("low_level_keywords"))
