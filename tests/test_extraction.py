"""The parser's pitfalls, by hand-made records."""

from weftline.operators import extraction


def parse(spark, text):
    rows = extraction.records(spark.createDataFrame([("c", text)], "chunk_id string, response string"))
    return extraction.facts(rows), extraction.mentions(rows)


FACT_A, FACT_B = '("hyper-relation"<|>"A b."<|>7)', '("hyper-relation"<|>"B c."<|>8)'


def entity(name, weight="90"):
    return f'("entity"<|>"{name}"<|>"t"<|>"d"<|>{weight})'


def test_forward_fill(spark):
    facts, mentions = parse(spark, "##".join([entity("x"), FACT_A, entity("y"), entity("z"), FACT_B, entity("w")]) + "<|COMPLETE|>")
    assert {(r.fact, r.weight) for r in facts.collect()} == {('<bipartite_edge>"A b."', 7.0), ('<bipartite_edge>"B c."', 8.0)}
    assert {(r.entity, r.fact[-5:]) for r in mentions.collect()} == {('"Y"', 'A b."'), ('"Z"', 'A b."'), ('"W"', 'B c."')}


def test_weights(spark):
    cases = {'"95"': 50.0, "1e5": 50.0, "5.": 50.0, ".5": 0.5, "-2": -2.0}
    for text, weight in cases.items():
        _, mentions = parse(spark, FACT_A + "##" + entity("n", text))
        assert [r.weight for r in mentions.collect()] == [weight]


def test_bad_shapes(spark):
    bad = ['("entity"<|>"n"<|>"t"<|>"d")', '(entity<|>"n"<|>"t"<|>"d"<|>9)', '("entity"<|><|>"T"<|>"d"<|>7)', '("entity"<|>"n\nm"<|>"t"<|>"d"<|>9)', '("hyper-relation"<|>"x")']
    facts, mentions = parse(spark, FACT_A + "##" + "##".join(bad))
    assert facts.count() == 1 and mentions.count() == 0


def test_unescape(spark):
    _, mentions = parse(spark, FACT_A + "##" + entity("a &amp; b") + "##" + entity("c &nbsp; d") + "##" + entity("e &apos; f"))
    assert {r.entity for r in mentions.collect()} == {'"A & B"', '"C &NBSP; D"', '"E &APOS; F"'}


def test_gleaning(spark):
    chunks = spark.createDataFrame([("c", "text")], "chunk_id string, content string")
    said = extraction.extracted(chunks, lambda p, h: "yes" if p == "LOOP" else ("more|" if p == "MORE" else "first|"), extraction.prompt("{input_text}", chunks["content"]))
    assert said.collect()[0].response == "first|more|more|"
