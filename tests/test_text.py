"""Text functions against Python's own."""

import html
import random
import re

from pyspark.sql import functions as F

from weftline.functions import subwords, text


def test_character_references(spark):
    rng = random.Random(2)
    heads = ["amp", "AMP", "lt", "nbsp", "NBSP", "notit;", "notin;", "NotEqualTilde;", "apos", "apos;", "#", "#x", "#X1F600", "#x1F600;", "#0", "#13;", "#128", "#x80;", "#xD800;", "#xDFFF", "#1114111;", "#1114112;", "#99999999999999999999999;", "#00000000000000065;", "#xFDD0;", "#1", "#x0B;", "acE;", "x" * 40, "", "&", "é;", "aé", "copy2", "copy;2", "hellip", "CounterClockwiseContourIntegral;", "#65a", "#x41g;"]
    made = ["".join(rng.choice(["&" + rng.choice(heads), rng.choice(["a", ";", " ", "\n", "<", "é", "😀", "#", "&&", "\t"])]) for _ in range(rng.randrange(8))) for _ in range(1500)]
    rows = [(k, t) for k, t in enumerate([*("&" + h for h in heads), *("&" + h + ";" for h in heads), *made, None])]
    got = {r.k: (r.u, r.c) for r in spark.createDataFrame(rows, "k int, t string").select("k", text.unescaped(F.col("t")).alias("u"), text.clean(F.col("t")).alias("c")).collect()}
    for k, t in rows:
        assert got[k][0] == (None if t is None else html.unescape(t)), t
        assert got[k][1] == (None if t is None else re.sub(r"[\x00-\x1f\x7f-\x9f]", "", html.unescape(t.strip()))), t


def test_clean_runs_no_python(spark):
    from weftline.operators import extraction

    rows = extraction.mentions(spark.createDataFrame([("c", 0, ["a"])], "chunk_id string, pos int, attrs array<string>"))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()


def test_unicode_escapes(spark):
    b = chr(92)
    cases = {f"caf{b}u00e9": "caf" + chr(0xE9), f"{b}uD83D{b}uDE00!": chr(0x1F600) + "!", f"a{b}b {b}u0041": f"a{b}b A", f'"{b}u0042"': '"B"', "plain": "plain", f"{b}u00g1 {b}u0043": f"{b}u00g1 C", f"{b}u": f"{b}u", f"{b}u0022{b}u000a": '"' + chr(10), None: None}
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "k int, t string").select("k", text.unicode_unescape(F.col("t")).alias("u")).orderBy("k").collect()
    assert [r.u for r in rows] == list(cases.values())


def awkward():
    rng = random.Random(6)
    return ["", " ", "a", "naïve café " * 40, "漢字かな" * 30, "😀🎉" * 50, "word " * 500, " " * 300_000, "<|endoftext|> x", "".join(rng.choice("aé漢😀 \n") for _ in range(700))]


def test_subword_windows(spark):
    """Windows are the tokens of the public tokenizer; contents are their decoding where no cut goes through a character."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame([*enumerate(awkward()), (99, None)], "id int, t string")
    got = {}
    for r in subwords.windows(docs, "id", "t", 17, 5).collect():
        got.setdefault(r.full_doc_id, {})[r.chunk_order_index] = r
    broken = whole = 0
    for k, value in enumerate(awkward()):
        ids = t.encode(value, add_special_tokens=False).ids
        starts = range(0, len(ids), 12)
        assert sorted(got.get(k, {})) == list(range(len(starts)))
        for n, start in enumerate(starts):
            r, part = got[k][n], ids[start : start + 17]
            decoded = t.decode(part, skip_special_tokens=False)
            assert r.tokens == len(part) and "�" not in r.content and r.chunk_id == "chunk-" + __import__("hashlib").md5(r.content.encode()).hexdigest()
            if "�" in decoded:
                broken += 1
                assert decoded.strip("�").strip() in r.content and r.content in value and len(r.content) <= len(decoded)
            else:
                whole += 1
                assert r.content == decoded.strip()
    assert broken > 20 and whole > 100


def test_subword_functions(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame([*enumerate(awkward()), (99, None)], "id int, t string")
    rows = docs.withColumn("ids", subwords.token_ids(F.col("t"))).withColumns({"n": subwords.token_count(F.col("t")), "back": subwords.token_text(F.col("ids"))}).collect()
    for r in rows:
        if r.t is None:
            assert r.ids is None and r.n is None and r.back is None
        else:
            assert r.ids == t.encode(r.t, add_special_tokens=False).ids and r.n == len(r.ids) and r.back == r.t


def test_subword_chunks_in_the_engine(spark, tmp_path):
    from weftline.plans.engine import Engine

    engine = Engine(spark, str(tmp_path / "w"), size=12, overlap=2, vocabulary=subwords.VOCABULARY)
    value = "Unbelievably long-winded sentences describe extraordinary lighthouses. Nobody understands them."
    engine.insert(spark.createDataFrame([(value,)], "content string"))
    parts = engine.table("chunks").orderBy("chunk_order_index").collect()
    assert all(r.tokens == 12 for r in parts[:-1]) and len(parts) > 1 and value.startswith(parts[0].content)
