"""Operators on small hand-made tables: planted cases and awkward rows."""

import random
from collections import Counter

import pytest

from conftest import *  # noqa: F403
from test_queries import brute_dedup
from weftline.llm import ann, chat, language, licenses, merkle, mixing, packing, partenum, secrets, suffixes


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def test_near_copies_and_passages(docs):
    base, passage = words(200, 1), " ".join(words(60, 2))
    near = [*base]
    near[50] = "changed"
    texts = [" ".join(base), " ".join(near), " ".join(base), *(" ".join(words(80, 10 + k)) + " " + passage for k in range(30))]
    got = {r.doc_id: r for r in partenum.groups_of(docs(*texts)).collect()}
    assert [got[k].component_id for k in range(33)] == [0, 0, 0, *range(3, 33)]
    assert got[0].n_shingles == 196


def test_jaccard_brute_force(docs):
    """Near copies at all distances round the limit, with a passage that all share."""
    r, base, passage = random.Random(5), words(120, 3), words(60, 4)
    texts = []
    for k in range(60):
        own = [*base] if k % 2 else words(40, 100 + k)
        for _ in range(r.randrange(8)):
            own[r.randrange(len(own))] = f"x{r.random()}"
        texts.append(own + passage)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    label = list(range(60))
    for a in range(60):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    got = {x.doc_id: x.component_id for x in partenum.groups_of(docs(*map(" ".join, texts))).collect()}
    assert got == dict(enumerate(label))


def test_partenum_signatures_meet():
    """Any two sets at the limit or above share a signature, in every band and across bands; most of unlike ones share none."""
    import numpy as np

    rng, met, unlike = np.random.default_rng(3), 0, 0
    for _ in range(1500):
        a = int(np.exp(rng.uniform(0, np.log(1500))))
        b = int(rng.integers(-(-3 * a // 4), a * 4 // 3 + 1))
        common = -(-75 * (a + b) // 175)
        if common > min(a, b):
            continue
        u = np.unique(rng.integers(1 << 63, size=3 * a + 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        rng.shuffle(u)
        x, y = np.sort(u[:a]), np.sort(np.concatenate([u[:common], u[a : a + b - common]]))
        sign = lambda s: partenum.signatures(s, (75, 100))
        common = np.intersect1d(sign(x), sign(y)) & np.uint64(31)
        bands = np.bincount(common.astype(int), minlength=32)
        assert any(n > partenum.Scheme(1 << k).spare for k, n in enumerate(bands))
        met += 1
        z = np.sort(np.concatenate([u[: a // 4], u[2 * a : 3 * a - a // 4]]))
        unlike += np.intersect1d(sign(x), sign(z)).size > 0.1 * len(sign(x))
    assert met > 1000 and unlike < 0.1 * met
    small, large = partenum.Scheme(64), partenum.Scheme(256)
    assert (small.cells, small.spoiled, small.subsets) == (3, 1, [(0, 1), (0, 2), (1, 2)]) and large.subsets == [(0,)]


def test_partenum_decides_the_candidates(docs, monkeypatch):
    """Without signatures no pair is found, however alike the texts."""
    import numpy as np

    monkeypatch.setattr(partenum, "signatures", lambda s, similarity: np.zeros(0, dtype=np.uint64))
    base = words(200, 1)
    got = {r.doc_id: r.component_id for r in partenum.groups_of(docs(" ".join(base), " ".join([*base[:-1], "changed"]))).collect()}
    assert got == {0: 0, 1: 1}


def test_jaccard_awkward(awkward):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.groups_of(awkward).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (1, 3), 4: (1, 4), 5: (1, 4), 6: (0, 6), 7: (1, 7), 8: (3, 8)}


def test_suffixes(docs):
    r = random.Random(9)
    passage = "".join(r.choice("abcd ") for _ in range(700))
    noise = lambda n: "".join(r.choice("efgh ") for _ in range(n))
    texts = [noise(300) + passage + noise(200), passage[100:650] + noise(50), noise(20) + passage[:399], noise(900), None, "", "z" * 1000, noise(500)]
    texts += [texts[-1], *(noise(150) + passage[:420] + noise(150) for _ in range(12))]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans) for x in suffixes.dedup(docs(*texts)).collect()}
    assert got == {k: v[:3] for k, v in brute_dedup(list(enumerate(texts)), 400).items()}


@pytest.mark.parametrize("limit", [1, 3])
def test_suffix_groups_beyond_one_task(docs, monkeypatch, limit):
    """Groups that are split: shifted passages, exact copies, a repeated row, edits at all places."""
    monkeypatch.setattr(suffixes, "SORTED_GROUP", limit)
    r = random.Random(9)
    passage = "".join(r.choice("abcd ") for _ in range(500))
    texts = ["".join(r.choice("efgh ") for _ in range(150)) + passage[k : 450 + k] for k in range(8)]
    for k in range(12):
        texts.append(passage[: 40 * k] + "X" + passage[40 * k + 1 :])
    texts += [texts[0], texts[9], "z" * 900]
    every = list(enumerate(texts))
    got = [(x.doc_id, (x.n_bytes, x.n_removed, x.n_spans)) for x in suffixes.dedup(docs(*every, every[3])).collect()]
    want = brute_dedup([*every, (99, texts[3])], 400)
    assert dict(got) == {k: v[:3] for k, v in want.items() if k != 99} and len(got) == len(every) + 1


def test_suffix_sort():
    r = random.Random(3)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randrange(12))) for _ in range(200)]
    import numpy as np

    group = np.array([r.randrange(4) for _ in strings])
    order = suffixes.Suffixes(strings).order(group)
    assert [(group[k], strings[k]) for k in order] == sorted(zip(group.tolist(), strings, strict=True))


def test_repeated_rows_are_copies(awkward):
    got = {r.doc_id: (r.n_removed, r.n_bytes) for r in suffixes.dedup(awkward).collect()}
    assert got[4] == got[5] == (150_000, 150_000) and got[7] == (10_000, 10_000) and got[1] == (0, 0)


def test_licenses(docs):
    texts = ["Released under the MIT License.", "relaesed undr the MIT-License", "(Apache License, Version 2.0) CC BY-NC, cc by nc", "permit license of nothing", None, "all about the mitten"]
    got = {r.doc_id: r for r in licenses.digest(licenses.scan(docs(*texts))).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].base_labels, got[0].score) == (1, 1, "mit", 1.0)
    assert (got[1].n_base, got[1].labels) == (0, "mit") and 0.8 < got[1].score < 1
    assert (got[2].n_base, got[2].base_labels, got[2].last_word) == (3, "apache-2,cc-by-nc", 8)
    assert [(got[k].n_base, got[k].labels, got[k].score) for k in (3, 4, 5)] == [(0, "", 0.0)] * 3
    assert got[4].n_words == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        prev, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], min(prev + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1]


def test_license_labels_brute_force(docs):
    """The method's labels on notices with planted edits: those within the bound, by edit distance over all runs of words."""
    r = random.Random(6)
    texts = []
    for _ in range(120):
        phrase = list(r.choice(licenses.NOTICES).phrase)
        for _ in range(r.randrange(6)):
            at = r.randrange(2, len(phrase) - 2)
            phrase[at : at + r.randrange(2)] = r.choice(["", "q", "zz"])
        texts.append(" ".join(words(5, r.random()) + ["".join(phrase)] + words(5, r.random())))

    def labels(text):
        w, out = text.split(), set()
        for n in licenses.NOTICES:
            size = len(n.phrase.split())
            for k in range(max(1, size - 3), size + 4):
                out |= {n.label for i in range(len(w) - k + 1) if edit_distance(" ".join(w[i : i + k]), n.phrase) <= n.edits}
        return ",".join(sorted(out))

    got = {x.doc_id: x.labels for x in licenses.digest(licenses.scan(docs(*texts))).collect()}
    assert got == {k: labels(t) for k, t in enumerate(texts)} and len(set(got.values())) > 8


def test_license_scan_is_linear():
    """A text of very many notices, exact and edited."""
    import time

    searcher = licenses.Searcher(licenses.NOTICES)
    start = time.process_time()
    found = searcher.search("under the mit license and undr the mit license or cc by nc " * 30_000)
    assert len(found) == 90_000 and found[-1][2] == 30_000 * 13 - 3
    assert time.process_time() - start < 15


def test_secrets(docs):
    key = "AKIA" + "A1B2" * 4
    texts = [
        f"id {key}\npwd = hunter2 and more",
        "pwd = hunter2 alone",
        "é login: alice, token='abcdef12'",
        "login: alice" + " " * 300 + "token = abcdef12",
        "secret=token: abcdef; password = abc",
        None,
        "0123456789abcdef01234567",
    ]
    got = {r.doc_id: r.spans for r in secrets.digest(secrets.scan(docs(*texts))).collect()}
    assert got[0] == "access:3:23,weak_secret:24:37"
    assert got[1] == "" and got[5] == "" and got[6] == "hex:0:24"
    assert got[2] == "identifier:2:14,assign:16:31"
    assert got[3] == "assign:312:328"
    assert got[4] == ""
    assert secrets.redact(docs(texts[0])).first().text == "id <secret>\n<secret> and more"


def test_secrets_repeated(awkward):
    assert secrets.scan(awkward).count() == 9
    clashing = awkward.withColumnRenamed("node", "found").withColumnRenamed("sig", "k0").withColumnRenamed("n", "row")
    masked = secrets.redact(clashing)
    assert masked.columns == clashing.columns and sorted(map(repr, masked.collect())) == sorted(map(repr, clashing.collect()))


def test_secrets_without_id_and_repeated(spark):
    """Rows without doc_id link their weak parts like others, and rows that repeat keep their spans once."""
    key = "AKIA" + "A1B2" * 4
    text = f"id {key}\npwd = hunter2 and more"
    table = spark.createDataFrame([(None, text), (None, text), (7, text), (None, "pwd = hunter2"), (0, text)], "doc_id long, text string")
    got = [(r.doc_id, r.spans) for r in secrets.digest(secrets.scan(table)).collect()]
    assert sorted(got, key=repr) == sorted([(None, "access:3:23,weak_secret:24:37")] * 2 + [(k, "access:3:23,weak_secret:24:37") for k in (7, 0)] + [(None, "")], key=repr)


def brute_spans(text, scope=200):
    """All spans by Python's re and every pair of parts."""
    import re

    flags = lambda k: re.A | (re.I if k.pattern.startswith("(?i)") else 0)
    found = [(m.start(), n, m.end(), k) for n, k in enumerate(secrets.KINDS) for m in re.finditer(k.pattern.removeprefix("(?i)"), text, flags(k)) if len(m[k.group]) >= k.least]
    near = lambda x, y: abs(x[0] - y[0]) <= scope and y[3].role in secrets.COMPLEMENTS[x[3].role]
    return ",".join(f"{k.name}:{a}:{b}" for a, _, b, k in sorted((x for x in found if x[3].base or any(near(x, y) for y in found)), key=lambda x: x[:3]))


def test_secrets_brute_force(docs):
    """Texts of parts at random distances: every span and link, by all pairs."""
    r = random.Random(4)
    piece = lambda: r.choice(["pwd = hunter2", "login: alice", "token='abcdef12'", "https://a.example.com:80", "host = db.internal.net", "secret: abc", "AKIA" + "Z9" * 8, "AKIA123", "0123456789abcdef" * 2, "auth: xyz1", "x" * r.randrange(250), "é" * r.randrange(90), " "])
    texts = [" ".join(piece() for _ in range(r.randrange(1, 14))) for _ in range(150)]
    got = {x.doc_id: x.spans for x in secrets.digest(secrets.scan(docs(*texts))).collect()}
    assert got == {k: brute_spans(t) for k, t in enumerate(texts)}


def test_merkle(docs):
    texts = ["A one. B two.\nC three.\n\nD four.", "A one. B two.\nC changed.\n\nD four.", "", None]
    got = {r.doc_id: r for r in merkle.fingerprints(docs(*texts)).collect()}
    assert got[2].fingerprint == got[3].fingerprint != got[0].fingerprint
    from pyspark.sql import functions as F

    def walk(a, b):
        rows = docs((0, None)).select(merkle.tree(F.lit(a)).alias("x"), merkle.tree(F.lit(b)).alias("y"))
        r = merkle.compared(rows, "x", "y", "like", "at").first()
        return r.at, round(r.like, 6)

    # Leaves: "A one.", " B two.", "C three.", "D four."; one differs, of five in all.
    assert walk(texts[0], texts[1]) == ("0.1", 0.6)
    assert walk(texts[0], texts[0]) == (None, 1.0) and walk("", "") == (None, 1.0) and walk("", "x") == ("0.0", 0.0)
    # An inserted section moves those behind it, which are still passed by from the end.
    many = "\n\n".join(f"Section {k}. It has a sentence {k}." for k in range(20))
    at, like = walk(many, many.replace("\n\nSection 9.", "\n\nNew one.\n\nSection 9."))
    assert at == "9.0" and like == round(40 / 41, 6)


def test_merkle_likeness_comes_from_the_tree(docs, monkeypatch):
    """If digests of branches told nothing apart, unlike texts would be passed by as equal."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(merkle, "equal_run", lambda a, b, reverse=False: F.least(F.size(a), F.size(b)) if not reverse else F.lit(0))
    rows = docs((0, None)).select(merkle.tree(F.lit("one thing.")).alias("x"), merkle.tree(F.lit("another.")).alias("y"))
    assert merkle.compared(rows, "x", "y", "like").first().like == 1.0


def test_merkle_next(docs):
    got = {r.doc_id: r for r in merkle.edit_report(docs((5, "abcdefgh"), (1, "xy"), (9, ""), (7, None))).collect()}
    import hashlib

    edited = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].edited_sha256 == edited("xy") and got[5].edited_sha256 == edited("abcdef")
    assert got[9].near_next == 0.0 and got[7].near_next == 1.0


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, None, None), (None, 0, "user", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.text) for r in chat.render(table).collect()}
    assert set(got) == {1, 4} and got[1][:2] == (2, 2)
    assert got[1][2] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"


def test_mixing():
    import numpy as np

    cells = [((s, g, t), 1000.0 * (1 + k)) for k, (s, g, t) in enumerate((s, g, t) for s in "ab" for g in ("en", "de") for t in "xy")]
    take = mixing.rake(cells, mixing.Targets(shares={"lang": {"en": 0.5, "de": 0.5}, "source": {"a": 0.4, "b": 0.6}}, keep=0.2))
    total = take.sum()
    share = lambda k, v: sum(x for (c, _), x in zip(cells, take, strict=True) if c[k] == v) / total
    assert abs(total - 7200) < 1 and abs(share(1, "en") - 0.5) < 1e-6 and abs(share(0, "a") - 0.4) < 1e-6
    assert (take <= np.array([n for _, n in cells])).all()


def topics_of(table):
    """Topic of each text of a table, by the operator's own model."""
    model, texts = mixing.fit_topics(table), list({r.text for r in table.collect()})
    letters = mixing.np.array([any(c.isalpha() for c in t or "") for t in texts], dtype=bool)
    return dict(zip(texts, model.of(mixing.pa.array(texts, mixing.pa.string()).fill_null(""), letters), strict=True))


def brute_rake(docs, targets, topics):
    """Probability of each (source, lang, text) by plain dictionaries."""

    def cell(source, lang, text):
        return str(source or "null"), str(lang or "null"), topics[text]

    have = Counter()
    for d in docs:
        have[cell(*d)] += len(d[2].split(" ")) if d[2] else 0
    total = sum(have.values())
    take = {c: targets.keep * n for c, n in have.items()}
    sums = [Counter(), Counter(), Counter()]
    for c, n in have.items():
        for k in range(3):
            sums[k][c[k]] += n
    for turn in range(2 * targets.rounds):
        for k, axis in sorted(enumerate(("source", "lang", "topic")), key=lambda x: x[1] in targets.shares):
            if turn >= targets.rounds and axis not in targets.shares:
                continue
            if axis in targets.shares:
                listed = {v: targets.shares[axis][v] for v in sums[k] if v in targets.shares[axis]}
                rest = total - sum(n for v, n in sums[k].items() if v not in listed)
                want = {v: listed[v] / sum(listed.values()) * rest if v in listed else n for v, n in sums[k].items()}
            else:
                flat = {v: n**targets.temperature for v, n in sums[k].items()}
                want = {v: x / sum(flat.values()) * total for v, x in flat.items()}
            now = Counter()
            for c, t in take.items():
                now[c[k]] += t
            take = {c: min(have[c], t * targets.keep * want[c[k]] / now[c[k]]) if now[c[k]] else 0.0 for c, t in take.items()}
    return {d: take[cell(*d)] / have[cell(*d)] if have[cell(*d)] else 1.0 for d in docs}


def mixed(spark, docs, targets):
    table = spark.createDataFrame([(k, t, g, s) for k, (s, g, t) in enumerate(docs)], "doc_id long, text string, lang string, source string")
    rows = mixing.calibrated(table, targets).collect()
    assert len(rows) == len(docs)
    return {(r.source, r.lang, r.text): r.probability for r in rows}, brute_rake(docs, targets, topics_of(table))


def test_topics_are_of_whole_texts(spark):
    """Texts that begin alike and differ afterwards; nulls and texts without letters."""
    r = random.Random(3)
    kinds = (["river", "mountain", "meadow", "forest"], ["protein", "enzyme", "membrane", "kinase"])
    texts = ["The same beginning for everyone. " + " ".join(r.choice(kinds[k % 2]) for _ in range(60)) for k in range(60)]
    table = spark.createDataFrame([(t,) for t in [*texts, None, "12 34", ""]], "text string")
    model = mixing.fit_topics(table, topics=2)
    got = model.of(mixing.pa.array(texts), mixing.np.ones(60, dtype=bool))
    assert len(set(got[::2])) == len(set(got[1::2])) == 1 and got[0] != got[1]
    assert model.of(mixing.pa.array(["", "12 34"]), mixing.np.zeros(2, dtype=bool)) == ["none", "none"]


def test_topics_tell_texts_of_one_language_apart(spark):
    """At least three topics among the commonest language's documents, none of fewer than five; clusters are those of plain numpy from the same centres."""
    import numpy as np

    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    topics, rows = topics_of(table), table.where("text IS NOT NULL").collect()
    common = Counter(r.lang for r in rows).most_common(1)[0][0]
    sizes = Counter(topics[r.text] for r in rows if topics[r.text] != "none")
    assert len({topics[r.text] for r in rows if r.lang == common} - {"none"}) >= 3 and min(sizes.values()) >= 5
    model = mixing.fit_topics(table)
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-4) and len(model.means) == len({r.lang for r in rows if r.lang})
    x = language.unit(language.tf_rows(mixing.pa.array([r.text for r in rows[:200]])) * model.idf)
    for r, v in zip(rows[:200], x, strict=True):
        own = max(model.means, key=lambda m: float(m @ v))
        rest = v - float(v @ own) * own
        if topics[r.text] != "none":
            near = model.centroids @ rest
            assert near[int(topics[r.text][1:])] >= near.max() - 1e-5


def test_mixing_keeps_values_that_no_target_lists(spark):
    """A third of the rows have no language or one that is not listed."""
    r = random.Random(8)
    docs = [(r.choice("abc"), r.choice(["en", "en", "de", "de", None, "it"]), " ".join(r.choice(["some", "plain", "different", "languages"]) for _ in range(9)) + f" {k}") for k in range(400)]
    targets = mixing.Targets(shares={"lang": {"en": 0.75, "de": 0.25, "fr": 0.5}}, keep=0.4, rounds=30)
    got, want = mixed(spark, docs, targets)
    assert all(abs(got[d] - want[d]) < 1e-6 for d in docs) and min(got.values()) > 0
    size = {g: sum(len(d[2].split()) for d in docs if d[1] == g) for g in ("en", "de", None, "it")}
    taken = {g: sum(got[d] * len(d[2].split()) for d in docs if d[1] == g) for g in size}
    for g in (None, "it"):
        assert abs(taken[g] / sum(taken.values()) - size[g] / sum(size.values())) < 1e-3


@pytest.mark.parametrize("driver_cells", [0, 100_000])
def test_mixing_rakes_every_source(spark, monkeypatch, driver_cells):
    """More sources than any cap, one of them called other, and a wanted language that is rare; by both ways."""
    monkeypatch.setattr(mixing, "DRIVER_CELLS", driver_cells, raising=False)
    r = random.Random(9)
    docs = [(f"s{k % 260}", r.choice(["en", "de"]), " ".join(r.choice(["some", "plain", "different", "languages"]) for _ in range(2 + k % 7)) + f" {k}") for k in range(700)]
    docs += [("other", "en", f"several words here {k}") for k in range(20)] + [("s3", "fr", "rare words")] + [(f"s{k}", f"x{k}", f"one {k}") for k in range(210)] + [("s5", None, "")]
    targets = mixing.Targets(shares={"lang": {"en": 0.5, "de": 0.4, "fr": 0.1}}, keep=0.5, rounds=4)
    got, want = mixed(spark, docs, targets)
    assert all(abs(got[d] - want[d]) < 1e-9 for d in docs) and min(got.values()) > 0


def test_encoder_gives_the_ids_of_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    t, encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.subwords("byte_bpe_50k.tiktoken")
    for text in ("hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n b", "<|endoftext|", "Été, 12345  \n\n\tso!", "日本語 🙂", ""):
        assert encoder.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_packing_plan(monkeypatch):
    """Grouping, configurations and substitution decide the plan, and beat best fit where lengths go badly together."""
    counts = {401: 300, 312: 300, 311: 300, 60: 40}

    def checked(plan):
        held, seen = {}, {k: [] for k in counts}
        for length, lo, hi, base, offset in plan.rows:
            seen[length] += range(lo, hi)
            for k in range(hi - lo):
                held.setdefault(base + k, []).append((offset, length))
        assert all(sorted(v) == list(range(counts[k])) for k, v in seen.items())
        for parts in held.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end <= 1024
        return len(held)

    grouped = checked(packing.plan_sequences(counts, 1024))
    asked = []
    real = packing.configurations
    monkeypatch.setattr(packing, "configurations", lambda *a: asked.append(a) or [])
    best_fit = checked(packing.plan_sequences(counts, 1024))
    assert asked and grouped < best_fit
    sizes, demand = packing.rounded({520: 300, 401: 300, 352: 800, 340: 100}, [520, 401, 352, 340], 5)
    assert sizes.tolist() == [520, 401, 352] and demand.tolist() == [300, 300, 900]
    assert sum(w for _, w in real(sizes, demand, 1024)) >= 1500 * 352 / 1024


def test_column_is_the_best_that_fits():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(30):
        sizes, values = rng.choice(np.arange(20, 100), 5, replace=False), rng.random(5)
        best, column = packing.best_column(values, sizes, 130)
        fitting = [n for n in itertools.product(range(7), repeat=5) if np.dot(n, sizes) <= 130]
        assert abs(best - max(np.dot(n, values) for n in fitting)) < 1e-9 and np.dot(column, sizes) <= 130 and abs(np.dot(column, values) - best) < 1e-9


def test_vectors_that_take_no_part(spark):
    rows = [(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(45)] + [(100, None), (120, [0.0, 0.0, 0.0]), (140, [float("nan"), 1.0, 1.0]), (160, [None, 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), __import__("pyspark.sql.functions", fromlist=["x"]).expr("vec_id % 20 = 0"))
    rows = [(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()]
    assert {q for q, *_ in rows} == {0, 20, 40} and len(rows) == 60 and all(v < 100 for _, _, v, _ in rows)
    for q in (0, 20, 40):
        vec = lambda k: (k % 7, 1, k % 3)
        want = sorted((k for k in range(45) if k != q), key=lambda k: (-sum(x * y for x, y in zip(vec(k), vec(q), strict=True)), k))[:20]
        assert [v for x, _, v, _ in sorted(rows) if x == q] == want


def test_vectors_awkward(spark, monkeypatch):
    """Several blocks and tasks, repeated ids and vectors, ties, clashing columns; an empty table."""
    from pyspark.sql import functions as F

    import numpy as np

    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    monkeypatch.setattr(ann, "AT_ONCE", 3)
    rng = np.random.default_rng(5)
    vectors = {k: rng.integers(-3, 4, 8).astype(float) for k in range(400)}
    for k in range(300, 360):
        vectors[k] = vectors[11]
    table = spark.createDataFrame([(k, v.tolist(), "x", 1.0) for k, v in vectors.items() if v.any()] + [(5, vectors[5].tolist(), "y", 2.0)], "vec_id long, embedding array<double>, entry string, score double")
    got = {}
    for r in ann.search(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    fine = {k: v for k, v in vectors.items() if v.any()}
    met = 0
    for q in (k for k in fine if k % 20 == 0):
        want = sorted((k for k in fine if k != q), key=lambda k: (-float(fine[k] @ fine[q]), k))[:20]
        found = [v for _, v, _ in sorted(got[q])]
        assert len(found) == 20 and all(s == fine[v] @ fine[q] for _, v, s in got[q])
        met += found == want
    assert met >= 0.9 * len(got)
    assert ann.search(table.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_lookup_tables_choose_the_candidates(spark, monkeypatch):
    """With tables that put the worst first, the search finds little."""
    import numpy as np

    real = ann.shortlist
    monkeypatch.setattr(ann, "shortlist", lambda codes, norm, first, words, q, keep: real(codes, norm, -first, -words, q, keep))
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 16))
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(table, F.col("vec_id") % 500 == 0, rerank=64).collect()
    assert len(got) == 80 and sum(r.score for r in got) < 0


EMPTY = {
    "merkle": merkle.edit_report,
    "jaccard": partenum.groups_of,
    "licenses": lambda d: licenses.digest(licenses.scan(d)),
    "packing": packing.pack,
    "language": language.identify,
    "secrets": lambda d: secrets.digest(secrets.scan(d)),
    "mixing": mixing.draw,
    "suffixes": suffixes.dedup,
}


@pytest.mark.parametrize("name", EMPTY)
def test_empty(docs, name):
    assert EMPTY[name](docs().limit(0)).collect() == []


@pytest.mark.parametrize("name", sorted(set(EMPTY) - {"jaccard"}))
def test_awkward(awkward, name):
    assert EMPTY[name](awkward).count() >= (0 if name == "mixing" else 9)


def test_pipeline_stages_on_empty_tables_and_clashing_columns(spark, docs, awkward):
    from pyspark.sql import functions as F

    import corpus_pipeline as c

    empty = docs().limit(0)
    for name, stage in c.STAGES:
        assert stage(spark, empty, "").collect() == [], name
    clashing = awkward.withColumns({"has_letters": F.lit("h"), "found": F.lit("f"), "of_id": F.lit(1), "row": F.lit(2)})
    model = language.fit(language.labelled(clashing))
    kept = language.accepted(clashing, model)
    assert kept.columns == clashing.columns and {r.has_letters for r in kept.collect()} == {"h"}
    for name, stage in c.STAGES[:-1]:
        assert stage(spark, clashing, "").columns == c.COLUMNS, name


def test_chat_awkward(spark):
    rows = [(1, 0, "user", "a", "x", 1), (1, 0, "user", "a", "y", 2), (2, None, "user", "", "z", 3), (3, 0, "user", "long " * 50_000, "z", 3)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string, h1 int")
    got = {r.conv_id: (r.n_turns, r.n_copies, len(r.text)) for r in chat.render(table).collect()}
    assert set(got) == {1, 2, 3} and got[1][:2] == (2, 1) and got[3][2] > 250_000
    assert chat.render(table.limit(0)).collect() == []


def test_language_of_few_texts_is_learned(spark, monkeypatch):
    """A language whose rows are copies of few texts, and a text that many rows of another hold."""
    from pyspark.sql import functions as F

    en = [" ".join(words(3, k)) + " the quick brown fox and the lazy dog" for k in range(60)]
    pool = ["der schnelle braune fuchs", "ein ganz anderer satz", "noch ein kurzer text"]
    table = spark.createDataFrame([(t, "en") for t in en] + [(en[0], "en")] * 700 + [(t, "de") for t in pool for _ in range(300)], "text string, lang string")
    seen = []
    monkeypatch.setattr(language, "clusters", lambda x, k: seen.append(len(x)) or x[:k])
    model = language.fit(table, sample_each=5)
    assert set(model.languages) == {"de", "en"} and seen == [3, 5]
    by_hash = sorted(table.select("text", "lang", F.pmod(F.xxhash64("text"), F.lit(1 << 30)).alias("h")).distinct().collect(), key=lambda r: r.h)
    want = language.unit(language.tf_rows(language.pa.array([r.text for r in by_hash if r.lang == "en"][:5])) * model.idf)[:4]
    assert language.np.allclose(model.centroids[[g == "en" for g in model.languages]], want)


def test_pipeline_brute_force(spark):
    """All stages on rows without doc_id, doc_ids of several texts, equal rows, near copies and secrets."""
    import re
    import zlib
    from pyspark.sql import functions as F

    import corpus_pipeline as c

    r = random.Random(12)
    prose = lambda n: [r.choice(["river", "mountain", "ordinary", "weather", "little", "garden"]) + r.choice("abcdefgh") for _ in range(n)]
    rows, lang = [], lambda: r.choice(["en", "en", "de", None, "it"])
    for k in range(40):
        text = prose(60)
        rows.append((k, " ".join(text), lang(), f"s{k % 3}"))
        if k % 4 == 0:  # another text under the same id
            rows.append((k, " ".join(prose(50)), lang(), "s1"))
        if k % 5 == 0:  # a near copy, under a larger id or an id that has another text
            text[30] = "changed"
            rows.append((1000 + k if k % 2 else k + 1, " ".join(text), lang(), "s2"))
        if k % 6 == 0:  # no id
            rows.append((None, " ".join(text), lang(), "s0"))
        if k % 7 == 0:  # the same row again, of another source
            rows.append((*rows[-1][:3], "s9"))
    rows += [(500, " ".join(prose(30)) + " password=Abcdef123456 " + " ".join(prose(20)), "en", "s1"), (501, None, "en", "s1"), (502, "12 34 56", "en", "s1")]
    docs = c.stash(spark.createDataFrame([(d, t, g, s, len(t or "")) for d, t, g, s in rows], DOCS), "t")  # noqa: F405
    plain = lambda df: sorted((tuple(x[n] for n in ("doc_id", "text", "lang", "source", "n_chars")) for x in df.collect()), key=repr)

    first = c.stash(c.language_id(spark, docs, ""), "t")
    model = language.fit(language.labelled(docs))
    judged = [bool(t and re.search("[a-z]", t)) and not language.judged(model, language.pa.array([t]), language.np.array([True]))[2][0] for _, t, _, _ in rows]
    assert plain(first) == sorted(((d, t, g, s, len(t or "")) for ok, (d, t, g, s) in zip(judged, rows, strict=True) if ok), key=repr)

    second = c.stash(c.near_duplicates(spark, first, ""), "t")
    came = plain(first)
    nodes = sorted({(d, t) for d, t, *_ in came if d is not None})
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in nodes]
    label = list(range(len(nodes)))
    for a in range(len(nodes)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    want = [x for x in came if x[0] is None]
    for group in set(label):
        own = min(nodes[k][0] for k in range(len(nodes)) if label[k] == group)
        texts = {nodes[k][1] for k in range(len(nodes)) if label[k] == group and nodes[k][0] == own}
        here = [x for x in came if x[0] == own and x[1] in texts]
        assert len(texts) == 1
        want.append(min(here, key=lambda x: (x[2] or "", x[3])))
    assert plain(second) == sorted(want, key=repr)
    assert len({x[0] for x in want if x[0] is not None}) < len([x for x in want if x[0] is not None])

    third = c.stash(c.secret_masks(spark, second, ""), "t")
    masked = [(d, re.sub(r"(password=)[A-Za-z0-9]+", "<secret>", t), g, s) for d, t, g, s, _ in plain(second)]
    assert plain(third) == sorted(((d, t, g, s, len(t)) for d, t, g, s in masked), key=repr)

    fourth = c.stash(c.mix(spark, third, ""), "t")
    chance = brute_rake([(s, g, t) for _, t, g, s, _ in plain(third)], c.MIX, topics_of(third))
    draw = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(42))).otherwise(F.xxhash64("doc_id", F.lit(42)))
    u = {(x.doc_id, x.text): x.u for x in third.select("doc_id", "text", (F.pmod(draw, F.lit(1 << 53)) / float(1 << 53)).alias("u")).collect()}
    assert len({v for (d, _), v in u.items() if d is None}) > 1
    assert plain(fourth) == [x for x in plain(third) if u[x[0], x[1]] < chance[x[3], x[2], x[1]]]

    encoder = packing.subwords("byte_bpe_50k.tiktoken")
    ids = lambda t: encoder.encode(t).astype("<u4").tobytes() + (2).to_bytes(4, "little")
    packed = c.pack(spark, fourth, "").collect()
    assert sorted(((x.doc_id, x.length, x.ids_crc32) for x in packed), key=repr) == sorted(((d, len(ids(t)) // 4, zlib.crc32(ids(t))) for d, t, *_ in plain(fourth)), key=repr)
    for q in {x.sequence_id for x in packed}:
        parts = sorted((x.offset, x.length) for x in packed if x.sequence_id == q)
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 1024


def paragraphs_of(n, pool, own, seed):
    """Texts of six of a pool of paragraphs of 12 to 60 words; each third one is an earlier one with one paragraph or a few words changed."""
    r = random.Random(seed)
    shared = [words(r.randrange(12, 60), 900 + k) for k in range(pool)]
    texts = []
    for k in range(n):
        if k % 3 == 2:
            parts = [[*p] for p in r.choice(texts)]
            if own and k % 2:
                p = r.choice(parts)
                p[r.randrange(len(p))] = f"x{k}"
            else:
                parts[r.randrange(6)] = r.choice(shared)
        else:
            parts = r.sample(shared, 6)
        texts.append(parts)
    return [sum(t, []) for t in texts]


def linked(texts):
    """The least place that each text reaches by links, by all pairs."""
    sets = [{tuple(t[i : i + 5]) for i in range(max(len(t) - 4, 0))} for t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("most", [256, 0])
def test_jaccard_of_shared_paragraphs(docs, monkeypatch, most):
    """Texts put together from few paragraphs, against all pairs; by passages, and by rare features alone."""
    monkeypatch.setattr(partenum, "MOST_SUBSETS", most)
    texts = paragraphs_of(300, 14, True, 21)
    want = linked(texts)
    assert 20 < len(set(want)) < 280
    table = [(k, " ".join(t)) for k, t in enumerate(texts)]
    assert dict(enumerate(want)) == {x.doc_id: x.component_id for x in partenum.groups_of(docs(*table, *table[:40:7])).collect()}


def test_jaccard_pairs_of_shared_paragraphs(docs, monkeypatch):
    """Of 1,200 texts of shared paragraphs a signature makes a pair with one leader, and what is compared after that is less than a pair a text."""
    seen = []
    verify = partenum.verified
    monkeypatch.setattr(partenum, "verified", lambda docs, sizes, pairs, *rest: seen.append(pairs.count()) or verify(docs, sizes, pairs, *rest))
    texts = paragraphs_of(1200, 30, False, 22)
    partenum.groups_of(docs(*map(" ".join, texts))).count()
    assert seen[0] <= sum(map(len, texts)) // 2 and seen[2] <= 1200, seen


def test_droppable():
    from itertools import combinations

    weights = [5, 1, 4, 9]
    every = {tuple(sorted(c)): sum(weights[k] for k in c) for r in range(5) for c in combinations(range(4), r)}
    assert {tuple(sorted(c)): t for c, t in partenum.droppable(weights, 9)} == {c: t for c, t in every.items() if t <= 9}
    assert partenum.droppable(weights, -1) == [] and partenum.droppable([1] * 40, 40) is None


ENDS = [-(1 << 63), -(1 << 63) + 1, -(1 << 62) - 1, -5, 0, (1 << 62) - 1, 1 << 62, (1 << 63) - 2, (1 << 63) - 1]


def test_jaccard_ids_at_both_ends_of_long(docs):
    """Near copies and texts alone under the least and the greatest ids."""
    text = " ".join(words(200, 3))
    table = [(i, text if k % 2 else " ".join(words(150, 50 + k))) for k, i in enumerate(ENDS)]
    got = {r.doc_id: r.component_id for r in partenum.groups_of(docs(*table)).collect()}
    assert got == {i: ENDS[1] if k % 2 else i for k, i in enumerate(ENDS)}


@pytest.mark.parametrize("ids", [ENDS, ENDS[3:], ENDS[:5], [3, 4, 5]])
def test_pipeline_numbers_texts_of_one_id(spark, docs, ids):
    """Different texts of one doc_id, with ids at either end of long, at both, and at none."""
    import corpus_pipeline as c

    table = [(i, " ".join(words(80, 200 + k))) for k, i in enumerate(ids)]
    table += [(ids[0], " ".join(words(80, 300))), (ids[-1], " ".join(words(80, 301))), (ids[1], " ".join(words(80, 301))), (ids[0], " ".join(words(80, 300)))]
    kept = sorted((r.doc_id, r.text) for r in c.near_duplicates(spark, docs(*table), "").collect())
    # The copies of one text stay once, under the least id.
    assert kept == sorted(set(table) - {(ids[-1], " ".join(words(80, 301)))})


def test_packing_of_long_runs(docs):
    """Runs of blanks, line ends and letters of a million and more; the pieces are those of tokenizers."""
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" " * 2_000_000, "a" + "\n" * 1_000_001 + "b", "\t \n" * 400_000, "word " * 300_000, "ab" * 200_000, "<|endoftext|> " + " " * 1_000_000]
    pieces = {}
    for r in packing.pack(docs(*texts)).collect():
        pieces.setdefault(r.doc_id, []).append((r.piece, r.length, r.ids_crc32))
    for k, text in enumerate(texts):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        first = len(ids) % 1024 or 1024
        cuts = [ids[:first], *np.split(ids[first:], range(1024, len(ids) - first, 1024))] if len(ids) > first else [ids]
        assert sorted(pieces[k]) == [(n, len(c), zlib.crc32(c.tobytes())) for n, c in enumerate(cuts)]


@pytest.mark.parametrize("partitions", [4, 211])
def test_recall_does_not_depend_on_partitions(spark, partitions):
    """A crowd round one point among others, indexed in 4 and in 211 parts, whose files are read by few tasks."""
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(12)
    x = rng.normal(size=(6000, 32))
    x[:2000] = x[0] + 0.02 * rng.normal(size=(2000, 32))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {}
        for r in ann.search(table, F.col("vec_id") % 40 == 0).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    met = 0
    for q in range(0, 6000, 40):
        near = x @ x[q]
        near[q] = -np.inf
        met += len(got[q] & set(np.argsort(-near)[:20].tolist()))
    assert met / (20 * len(got)) >= 0.97


def test_topics_are_fitted_to_all_texts(spark, docs):
    """Weights, means and clusters count every distinct text, also beyond those that give the starts, and whichever way the rows are dealt out."""
    import numpy as np

    from weftline.llm.language import gram_counts, unit

    texts = [f"{w} " * (3 + n % 5) + f"{w}{n}" for n in range(30) for w in ("apple", "stone", "river", "qqzz")]
    table = docs(*texts, *texts[:9])
    model, again = mixing.fit_topics(table, 4, sample=10), mixing.fit_topics(table.repartition(7), 4, sample=10)
    tf = np.array([np.log1p(gram_counts(t.encode())) for t in texts], dtype=np.float32)
    assert np.allclose(model.idf, np.log((1 + len(tf)) / (1 + (tf > 0).sum(axis=0))) + 1, atol=1e-5)
    x = unit(tf * model.idf)
    assert np.allclose(model.means, unit(x.mean(axis=0, keepdims=True)), atol=1e-5)
    rest = mixing.left_over(x, model.means)
    own = (rest @ model.centroids.T).argmax(axis=1)
    assert np.allclose(model.centroids, unit(np.array([rest[own == j].mean(axis=0) for j in range(len(model.centroids))])), atol=1e-4)
    assert np.allclose(model.centroids, again.centroids, atol=1e-6)


def test_drawn_rows_take_their_topics_by_hash(spark, docs):
    """Texts' n-grams are counted once, not anew for each pass over the documents, and no text is shuffled that the result does not hold."""
    rows = mixing.draw(docs("some plain words", "some plain words", "other words", "12", "", None)).select("doc_id", "mix_topic", "probability")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and not [x for x in plan.splitlines() if "Exchange" in x and "text" in x]
    every = mixing.calibrated(docs("some plain words", "some plain words", "other words", "12", "", None)).collect()
    topics = {r.doc_id: r.mix_topic for r in every}
    assert len(every) == 6 and topics[0] == topics[1] and {topics[3], topics[4], topics[5]} == {"none"} and topics[0][0] == topics[2][0] == "t"


def test_topics_of_texts_alike(spark, docs):
    """More texts than the driver takes that differ in digits alone, and one that is far from them."""
    table = docs(*[f"the same words {k}" for k in range(40)])
    model = mixing.fit_topics(table, 4, sample=10)
    assert set(model.of(mixing.pa.array(["the same words 7", "the same words 99"]), mixing.np.ones(2, dtype=bool))) == {"t0"}
    long = "a " * 70_000 + "bcd " * 300
    grams = mixing.Grams([mixing.Grams.of(language.gram_counts(t.encode())) for t in ("", "a", long)])
    assert np_close(grams.dense(grams.tf), language.tf_rows(mixing.pa.array(["", "a", long])))


def np_close(a, b):
    return a.shape == b.shape and bool((abs(a - b) < 1e-6).all())


def test_grams_by_the_plain_rule():
    """Counts of n-grams of awkward texts, and their sums by row."""
    import re

    np = mixing.np
    texts = [b"", b" ", b"a", b"A!", b"  a   b  ", "Äé ß\n\t日本".encode(), bytes(range(256)), b"z" * 5000, b" " * 999 + b"x"]
    for raw in texts:
        b = re.sub(b" +", b" ", b" " + bytes(c if c > 127 or chr(c).isalpha() else 32 for c in raw.lower()) + b" ")
        want = np.zeros(language.DIMENSIONS, int)
        for k in range(len(b)):
            want[b[k]] += 1
            if k + 1 < len(b):
                want[((b[k] * 257 + b[k + 1]) * 2654435761 % 2**32) >> 20] += 1
            if k + 2 < len(b):
                want[(((b[k] * 257 + b[k + 1]) * 257 + b[k + 2]) * 2654435761 % 2**32) >> 20] += 1
        assert (language.gram_counts(raw) == want).all()
    grams = mixing.Grams([mixing.Grams.of(language.gram_counts(t)) for t in texts])
    assert np.allclose(grams.add(grams.tf.astype(float)), grams.dense(grams.tf).sum(axis=1, dtype=float), atol=1e-3) and len(mixing.Grams([]).add(grams.tf[:0])) == 0


def test_drawn_rows_without_texts(spark, docs):
    """Texts left behind change nothing else; letters count wherever they stand, and tokens by single blanks."""
    texts = ["some plain words", "some plain words", "7" * 200 + " é", "ümlaut  two blanks ", "12", "1" * 99, " ", "", None]
    table = docs(*texts)
    with_texts = sorted(mixing.calibrated(table).drop("text").collect(), key=lambda r: r.doc_id)
    without = mixing.calibrated(table, text=False)
    assert "text" not in without.columns and sorted(without.select(*with_texts[0].asDict()).collect(), key=lambda r: r.doc_id) == with_texts
    for r, text in zip(with_texts, texts, strict=True):
        assert r.mix_tokens == (len(text.split(" ")) if text else 0) and (r.mix_topic == "none") == (not any(c.isalpha() for c in text or ""))
