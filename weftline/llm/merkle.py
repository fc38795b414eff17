"""Merkle fingerprints of documents, in DataFrame functions alone.

A text is cut at blank lines into sections, these at line ends into paragraphs, and these into
leaves (sentences, or 80 characters of a longer one). A leaf's digest is of its text, a paragraph's
of its leaves' digests, a section's of its paragraphs', the root of the sections'. Roots test
equality. Where they differ, two trees are compared from the root down: equal branches at either end
are passed by as a whole, and only the differing ones between them are opened. They locate the edit,
and their leaves tell how alike the texts are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import texts, width

LEAF = r"[^.!?\n]{1,80}[.!?\n]*|[.!?\n]+"


def tree(text: Column) -> Column:
    """array<struct<digest, paragraphs: array<struct<digest, leaves>>>>: the sections."""

    def paragraph(p):
        leaves = F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.md5(x))
        return F.struct(F.md5(F.array_join(leaves, ",")).alias("digest"), leaves.alias("leaves"))

    def section(s):
        paragraphs = F.transform(F.split(s, "\n"), paragraph)
        return F.struct(F.md5(F.array_join(F.transform(paragraphs, lambda p: p["digest"]), ",")).alias("digest"), paragraphs.alias("paragraphs"))

    return F.transform(F.split(text, "\n\n"), section)


def root(tree: Column) -> Column:
    return F.sha2(F.array_join(F.transform(tree, lambda s: s["digest"]), ","), 256)


def equal_run(a: Column, b: Column, reverse: bool = False) -> Column:
    """How many branches at the start (or the end) of two arrays have equal digests."""
    digests = lambda x: F.reverse(F.transform(x, lambda n: n["digest"])) if reverse else F.transform(x, lambda n: n["digest"])
    size = F.least(F.size(a), F.size(b))
    unequal = F.array_position(F.zip_with(digests(a), digests(b), lambda x, y: x.eqNullSafe(y)), False)
    return F.when(unequal > 0, F.least(unequal - 1, size)).otherwise(size).cast("int")


def opened(pairs: DataFrame, a: str, b: str, branches: str) -> DataFrame:
    """``pairs`` with a and b cut to the branches that differ, one level further down, and ``{a}_{b}_{branches}``: how many were passed by at the start."""
    head = f"{a}_{b}_{branches}"
    out = pairs.withColumn(head, equal_run(F.col(a), F.col(b)))
    rest = lambda c: F.slice(c, F.col(head) + 1, F.size(c))
    out = out.withColumns({a: rest(a), b: rest(b)})
    out = out.withColumn("tail", equal_run(F.col(a), F.col(b), reverse=True))
    cut = lambda c: F.flatten(F.transform(F.slice(c, F.lit(1), F.size(c) - F.col("tail")), lambda n: n[branches]))
    return out.withColumns({a: cut(a), b: cut(b)}).drop("tail")


def compared(pairs: DataFrame, a: str, b: str, like: str, at: str | None = None) -> DataFrame:
    """``pairs`` with the likeness ``like`` (0 to 1) of the trees a and b and the place ``at`` of their first difference.

    ``like`` is the share of equal leaves: those in branches that were passed by, and the distinct
    common ones of the opened branches, to all of them; 1 for two texts without any. ``at`` is
    "section.paragraph", from 0, null for equal trees; where several sections differ, paragraphs are
    counted through them.
    """
    whole = F.aggregate(F.col(a), F.lit(0), lambda n, s: n + F.aggregate(s["paragraphs"], F.lit(0), lambda m, p: m + F.size(p["leaves"])))
    work = pairs.withColumns({"_n": whole, "_a": F.col(a), "_b": F.col(b), "_same": root(F.col(a)) == root(F.col(b))})
    work = opened(opened(work, "_a", "_b", "paragraphs"), "_a", "_b", "leaves")
    passed = F.col("_n") - F.size("_a")
    common, every = F.size(F.array_intersect("_a", "_b")), F.size(F.array_union("_a", "_b"))
    work = work.withColumn(like, F.when(passed + every == 0, 1.0).otherwise((passed + common) / (passed + every)).cast("double"))
    if at:
        work = work.withColumn(at, F.when(~F.col("_same"), F.concat_ws(".", "_a__b_paragraphs", "_a__b_leaves")))
    return work.drop("_n", "_a", "_b", "_same", "_a__b_paragraphs", "_a__b_leaves")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (root) and tree of every row; null text counts as empty."""
    rows = texts(docs).withColumn("tree", tree(F.col("text")))
    return rows.select("doc_id", root(F.col("tree")).alias("fingerprint"), "tree")


def range_bucket(rows: DataFrame, column: str, buckets: int) -> Column:
    """Bucket of a value among about ``buckets`` ranges of equal share, ascending; found in two steps."""
    side = max(1, math.isqrt(buckets - 1) + 1)
    cuts = [k / (side * side) for k in range(1, side * side)]
    bounds = (rows.agg(F.percentile_approx(column, cuts, 20_000).alias("b")).first()["b"] if cuts else None) or []
    if not bounds:
        return F.lit(0)
    fine = [bounds[k * side : (k + 1) * side - 1] for k in range(side)]
    coarse = F.array(*[F.lit(bounds[(k + 1) * side - 1]) for k in range(side - 1)]) if side > 1 else None
    value = F.coalesce(F.col(column), F.lit(min(bounds)))
    if coarse is None:
        return F.lit(0)
    first = F.size(F.filter(coarse, lambda b: b < value))
    nested = F.array(*[F.array(*[F.lit(b) for b in part]) for part in fine])
    return first * side + F.size(F.filter(F.element_at(nested, first + 1), lambda b: b < value))


def with_next(docs: DataFrame, payload: list[Column]) -> DataFrame:
    """doc_id and the payload of every row and, as ``next``, the payload of the next row by doc_id (after the last: the first).

    Rows are dealt by ranges of doc_id; each range also gets the first row of the following one, so
    no task sees more than a range.
    """
    rows = texts(docs)
    bucket = range_bucket(rows, "doc_id", 2 * width(docs.sparkSession))
    rows = rows.withColumn("bucket", bucket.cast("int")).withColumn("tie", F.xxhash64("text"))
    firsts = rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "tie")).alias("f"))  # a row for each range
    order = Window.orderBy("bucket")
    to = F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    before = firsts.select(F.col("f.doc_id").alias("d"), F.col("f.tie").alias("t"), to.alias("to"))
    guests = rows.join(F.broadcast(before), rows["doc_id"].eqNullSafe(before["d"]) & (rows["tie"] == before["t"]))
    guests = guests.select("doc_id", "text", F.col("to").alias("bucket"), "tie", F.lit(True).alias("guest"))
    dealt = rows.withColumn("guest", F.lit(False)).unionByName(guests).select("doc_id", "bucket", "tie", "guest", *payload)
    names = [c for c in dealt.columns if c not in ("doc_id", "bucket", "tie", "guest")]
    along = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first(), "tie")
    return dealt.withColumn("next", F.lead(F.struct(*names)).over(along)).where("not guest").select("doc_id", *names, "next")


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited text, with their likeness and that to the next text.

    The edit puts the first quarter's length of the next document in place of the text's last
    quarter. Null text counts as empty. Rows of one doc_id are ordered by a hash of their text, rows
    without doc_id come first, and a lone row is its own next. An empty table gives no row. Only
    doc_id and text are read.
    """
    pairs = with_next(docs, [F.col("text")])
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    edited = pairs.select("doc_id", "text", F.col("next.text").alias("next"), n.cast("long").alias("n_chars"), edited.alias("edited"))
    trees = edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        *[tree(F.col(c)).alias(f"{c}_tree") for c in ("text", "edited", "next")],
    )
    roots = trees.withColumns({"fingerprint": root(F.col("text_tree")), "edited_fingerprint": root(F.col("edited_tree"))})
    near = compared(compared(roots, "text_tree", "edited_tree", "near_edited", "edited_at"), "text_tree", "next_tree", "near_next")
    return near.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_at")


def _sql_tree(text: str) -> str:
    return f"list_transform(string_split({text}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: regexp_extract_all(p, '[^.!?\\n]{{1,80}}[.!?\\n]*|[.!?\\n]+')))"


def _sql_root(tree: str) -> str:
    chain = lambda inner: f"md5(coalesce(array_to_string({inner}, ','), ''))"
    leaf = chain("list_transform(p, lambda x: md5(x))")
    section = chain(f"list_transform(s, lambda p: {leaf})")
    return f"sha256(array_to_string(list_transform({tree}, lambda s: {section}), ','))"


def _sql_trim(a: str, b: str, out_a: str, out_b: str, n: str, source: str, keep: str) -> str:
    """Both lists without their equal heads (their number is ``n``) and tails, flattened by one level."""
    run = lambda x, y: f"coalesce(nullif(list_position(list_transform(list_zip({x}, {y}, true), lambda z: z[1] = z[2]), false), 0) - 1, least(len({x}), len({y})))"
    head = f"SELECT *, {run(a, b)} AS {n} FROM {source}"
    rest = f"SELECT *, list_slice({a}, {n} + 1, len({a})) AS ra, list_slice({b}, {n} + 1, len({b})) AS rb FROM ({head})"
    tail = f"SELECT *, {run('list_reverse(ra)', 'list_reverse(rb)')} AS tail FROM ({rest})"
    cut = lambda x: f"flatten(list_slice({x}, 1, len({x}) - tail))"
    return f"SELECT {keep}, {n}, {cut('ra')} AS {out_a}, {cut('rb')} AS {out_b} FROM ({tail})"


def _sql_like(mine: str, other: str) -> str:
    passed = f"len(flatten(flatten(t))) - len({mine})"
    common, every = f"len(list_intersect({mine}, {other}))", f"len(list_distinct(list_concat({mine}, {other})))"
    return f"CASE WHEN {passed} + {every} = 0 THEN 1.0 ELSE ({passed} + {common})::DOUBLE / ({passed} + {every}) END"


EDIT_SQL = f"""
WITH rows AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
ordered AS (
  SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next FROM rows),
edited AS (
  SELECT *, left(text, (length(text) - length(text) // 4)::BIGINT) || left(next, (length(text) // 4)::BIGINT) AS edited FROM ordered),
trees AS (SELECT doc_id, text, edited, {_sql_tree('text')} AS t, {_sql_tree('edited')} AS e, {_sql_tree('next')} AS n FROM edited),
e1 AS ({_sql_trim('t', 'e', 'a1', 'b1', 'h1', 'trees', 'doc_id, text, edited, t, e, n')}),
e2 AS ({_sql_trim('a1', 'b1', 'a2', 'b2', 'h2', 'e1', 'doc_id, text, edited, t, e, n, h1')}),
n1 AS ({_sql_trim('t', 'n', 'c1', 'd1', 'h3', 'e2', 'doc_id, text, edited, t, e, n, h1, h2, a2, b2')}),
n2 AS ({_sql_trim('c1', 'd1', 'c2', 'd2', 'h4', 'n1', 'doc_id, text, edited, t, e, n, h1, h2, a2, b2')})
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, {_sql_root('t')} AS fingerprint, {_sql_root('e')} AS edited_fingerprint,
  {_sql_like('a2', 'b2')} AS near_edited, {_sql_like('c2', 'd2')} AS near_next,
  CASE WHEN text <> edited THEN h1::VARCHAR || '.' || h2::VARCHAR END AS edited_at
FROM n2
"""
