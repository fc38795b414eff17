"""Registered queries: against SQL where there is some, else against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from conftest import *  # noqa: F403
from oracle import assert_same
from weftline.llm import catalog

SF = "/root/testdata/sf0.001"


SECRETS = "/root/testdata/sf0.01"  # the smaller tables hold none


def rows(spark, name, folder=SF):
    return spark.read.parquet(f"{folder}/{name}.parquet").collect()


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_sql(spark, name):
    assert_same(spark, SF, catalog.QUERIES[name], catalog.ORACLE_SQL[name])


def test_op1(spark):
    got = defaultdict(list)
    for r in catalog.op1_additive_quantisation(spark, SF).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    table = {r.vec_id: np.array(r.embedding, dtype=float) for r in rows(spark, "embeddings")}
    met = 0
    for q in (v for v in table if v % 20 == 0):
        want = sorted((v for v in table if v != q), key=lambda v: (-float(table[v] @ table[q]), v))[:20]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(abs(s - table[v] @ table[q]) < 1e-12 for _, v, s in found)
        met += len(set(want) & {v for _, v, _ in found})
    assert met / (20 * len(got)) >= 0.9


def test_op5(spark):
    """Base places by plain word lists, for every document, those without any included; the method's labels hold the base ones."""
    import re

    phrases = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
    got = {r.doc_id: r for r in catalog.op5_license_scan(spark, SF).collect()}
    seen = 0
    for d in rows(spark, "documents"):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), d.text or ""))
        places = sorted((k, label) for phrase, label in phrases for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
        r, labels = got.pop(d.doc_id), {x for _, x in places}
        first, last = (places[0][0], places[-1][0]) if places else (None, None)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), first, last, ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and (r.score == 1.0) == bool(places or any(not x.edits for x in r.found))
        seen += len(places)
    assert seen and not got


def test_op6(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = catalog.op6_best_fit_packing(spark, SF).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    total = 0
    for d in rows(spark, "documents"):
        ids = np.array([*t.encode(d.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at, total = 0, total + len(ids)
        for k, p in enumerate(sorted(pieces[d.doc_id], key=lambda p: p.piece)):
            assert (p.piece, p.start, p.ids_crc32) == (k, at, zlib.crc32(ids[at : at + p.length].tobytes()))
            assert k == 0 or p.length == 1024
            at += p.length
        assert at == len(ids)
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(filled) <= 1.05 * total / 1024 + 1


def test_op7(spark):
    labels = {d.doc_id: d.lang for d in rows(spark, "documents")}
    got = catalog.op7_language_id(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == labels[r.doc_id] for r in held) / len(held) > 0.95


def test_op7_by_plain_numpy(spark):
    """Document frequencies of all labelled rows, and every prediction, score and rejection from the centroids."""
    from weftline.llm import language

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model, table = language.fit(language.labelled(docs)), docs.collect()
    letters = lambda t: any(c.isalpha() for c in t or "")
    learn = [d for d in table if d.lang is not None and letters(d.text) and zlib.crc32(str(d.doc_id).encode()) % 5]
    grams = lambda t: np.asarray(language.gram_counts(t.encode()))
    df = sum((grams(d.text) > 0).astype(int) for d in learn)
    assert np.allclose(model.idf, np.log((1 + len(learn)) / (1 + df)) + 1, rtol=1e-6)
    assert set(model.languages) == {d.lang for d in learn} and len(model.languages) == len(model.centroids)
    got, seen = {r.doc_id: r for r in language.predict(docs, model).collect()}, Counter()
    for d in table:
        r = got[d.doc_id]
        if not letters(d.text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        v = np.log1p(grams(d.text)) * model.idf
        near = model.centroids @ (v / np.linalg.norm(v))
        assert near[[k for k, x in enumerate(model.languages) if x == r.lang_pred]].max() >= near.max() - 1e-5
        assert abs(r.score - min(max(near.max(), 0), 1)) < 1e-5
        if abs(near.max() - model.floor) > 1e-5:
            assert r.rejected == (near.max() < model.floor)
        seen[r.lang_pred] += 1
    assert len(seen) >= 4


def test_op8(spark):
    import re

    patterns = {
        "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    }
    texts = {d.doc_id: d.text or "" for d in rows(spark, "documents", SECRETS)}
    seen = 0
    for r in catalog.op8_secret_scan(spark, SECRETS).collect():
        spans = sorted((m.start(), k, kind, m.end()) for k, (kind, (p, ok)) in enumerate(patterns.items()) for m in p.finditer(texts[r.doc_id]) if ok(m))
        line = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(line.split(",")) - {""} <= set(r.spans.split(","))
        count = Counter(kind for _, _, kind, _ in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == (count["assign"], count["access"], count["hex"])
        seen += len(spans)
    assert seen


def test_op9(spark):
    """Every document's probability by a plain rake over the whole table, and the marginals that are met."""
    from pyspark.sql import functions as F

    from test_operators import brute_rake, topics_of

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    topics, table = topics_of(docs), docs.collect()
    chance = brute_rake([(d.source, d.lang, d.text) for d in table], catalog.MIX, topics)
    u = {r.doc_id: r.u for r in docs.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(42)), F.lit(1 << 53)) / float(1 << 53)).alias("u")).collect()}
    got = {r.doc_id: r for r in catalog.op9_source_mix(spark, SF).collect()}
    edge = lambda d: chance[d.source, d.lang, d.text]
    assert set(got) == {d.doc_id for d in table if u[d.doc_id] < edge(d)}
    for d in table:
        if d.doc_id in got:
            r = got[d.doc_id]
            assert abs(r.probability - edge(d)) < 1e-6 and r.topic == topics[d.text] and r.tokens == (len(d.text.split(" ")) if d.text else 0)
    met = {r.value: r.share for r in catalog.mixing.achieved(catalog.mixing.calibrated(docs, catalog.MIX)).where("axis = 'lang'").collect()}
    shares = catalog.MIX.shares["lang"]
    # A language gives its share, or all that it has.
    spent = {k for k in shares if all(edge(d) > 0.999 for d in table if d.lang == k and d.text)}
    ratios = {k: met[k] / v for k, v in shares.items()}
    others = [ratios[k] for k in shares if k not in spent]
    assert abs(sum(met.values()) - 1) < 1e-9 and len(others) >= 3 and max(others) / min(others) < 1.01
    assert all(ratios[k] <= min(others) for k in spent)


def test_op9_draws_without_reading_the_texts_again(spark):
    """What is drawn comes from rows that were weighed and written once."""
    assert not [f for f in catalog.op9_source_mix(spark, SF).inputFiles() if "documents.parquet" in f]


def brute_dedup(texts, length):
    raws = {d: (t or "").encode() for d, t in texts}
    count = Counter(raw[i : i + length] for raw in raws.values() for i in range(len(raw) - length + 1))
    out = {}
    for d, raw in raws.items():
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if count[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[d] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_op10(spark):
    """The registered query on the whole table."""
    texts = {d.doc_id: d.text for d in rows(spark, "documents")}
    want = brute_dedup(list(texts.items()), 400)
    got = catalog.op10_suffix_dedup(spark, SF).collect()
    assert {r[0]: tuple(r)[1:5] for r in got} == want and len(got) == len(want)
    assert any(n for _, n, *_ in want.values())
    for r in got:
        assert r.n_chars == len(r.text) and (r.n_removed or r.text == (texts[r.doc_id] or ""))


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = c.stash(c.language_id(spark, docs, SF), "t")
    assert docs.count() - first.count() <= 0.02 * docs.count()
    second = c.stash(c.near_duplicates(spark, first, SF), "t")
    groups = {r.component_id for r in c.partenum.groups_of(first).collect()}
    assert {r.doc_id for r in second.collect()} == groups
    third = c.stash(c.secret_masks(spark, second, SF), "t")
    assert third.count() == second.count() and third.columns == c.COLUMNS
    assert not [r for r in catalog.secrets.digest(catalog.secrets.scan(third)).collect() if r.n_hex or r.n_access]
    fourth = c.stash(c.mix(spark, third, SF), "t")
    assert {r.doc_id for r in c.pack(spark, fourth, SF).collect()} == {r.doc_id for r in fourth.collect()}
