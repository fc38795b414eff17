"""Secret scans with multipart credential linking, in DataFrame functions alone.

Strong patterns (password assignments, access keys, long hex) always report. Weak ones (short
assignments, user names, endpoints) report only when a complementary part stands in the same scope:
parts of one text whose starts are at most ``SCOPE`` characters apart. The parts are joined by
interval buckets, of which each keeps only its first and last start for a role, so a text with very
many parts makes no pairs of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import stash, texts

SCOPE = 200

_SET = r"""["']?\x20*[:=]\x20*["']?"""
_VALUE = r"[A-Za-z0-9+/_.=-]+"


@dataclass(frozen=True)
class Kind:
    """A pattern. Matches whose ``group`` is shorter than ``least`` fail; base kinds are always reported."""

    name: str
    pattern: str
    group: int
    least: int
    role: str
    base: bool


KINDS = (
    Kind("assign", rf"(?i)(password|passwd|secret|token|api_?key){_SET}({_VALUE})", 2, 6, "secret", True),
    # Runs of at least the least length: a shorter one cannot hide a longer one, as both end where the run ends.
    Kind("access", r"AKIA[A-Z0-9]{16,}", 0, 20, "identifier", True),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24, "secret", True),
    Kind("endpoint", r"(?i)(https?://[a-z0-9.-]+(:[0-9]+)?|(host|endpoint|server)" + _SET + r"[a-z0-9-]+\.[a-z0-9.-]+)", 0, 4, "endpoint", False),
    Kind("identifier", rf"(?i)(user_?name|user|login|client_?id|account|access_?key_?id){_SET}([A-Za-z0-9._@-]+)", 2, 3, "identifier", False),
    Kind("weak_secret", rf"(?i)(pwd|passphrase|credential|private_?key|auth){_SET}({_VALUE})", 2, 4, "secret", False),
)

KEY = ["k0", "k1", "k2"]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and a key without nulls; rows with the same doc_id and text have the same key."""
    rows = texts(docs)
    key = (F.coalesce("doc_id", F.lit(0)), F.xxhash64("text", F.col("doc_id").isNull()), F.length("text"))
    return rows.withColumns(dict(zip(KEY, key, strict=True)))


def searched(docs: DataFrame) -> DataFrame:
    """doc_id, key and, for each kind, the lengths (gap before, match, its group) of all matches in order; the one pass over the texts."""
    text = F.col("text")

    def lengths(kind: Kind) -> Column:
        matches, gaps = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), F.split(text, kind.pattern, -1)
        both = F.slice(F.arrays_zip(gaps.alias("g"), matches.alias("m")), F.lit(1), F.size(matches))
        sizes = F.transform(both, lambda x: F.struct(F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("size"), F.length(F.regexp_extract(x["m"], kind.pattern, kind.group)).alias("inner")))
        return F.when(text.rlike(kind.pattern), sizes).alias(kind.name)

    return keyed(docs).select("doc_id", *KEY, *[lengths(k) for k in KINDS])


def parts(scanned: DataFrame) -> DataFrame:
    """key, kind, kind_order, role, base, start, end: all strong and weak matches, in code points."""
    sizes = F.array(*[F.struct(F.lit(order).alias("kind_order"), F.col(kind.name).alias("sizes")) for order, kind in enumerate(KINDS)])
    some = scanned.where(" OR ".join(f"{k.name} IS NOT NULL" for k in KINDS)).dropDuplicates(KEY)
    each = some.select(*KEY, F.explode(sizes).alias("of")).select(*KEY, "of.kind_order", F.posexplode("of.sizes").alias("at", "x"))
    before = Window.partitionBy(*KEY, "kind_order").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.sum(F.col("x.gap") + F.col("x.size")).over(before)
    of = lambda field: F.element_at(F.array(*[F.lit(getattr(k, field)) for k in KINDS]), F.col("kind_order") + 1)
    rows = each.select(*KEY, "kind_order", of("name").alias("kind"), of("role").alias("role"), of("base").alias("base"), (ends - F.col("x.size")).alias("start"), ends.alias("end"), F.col("x.inner").alias("inner"))
    return rows.where(F.col("inner") >= of("least")).drop("inner")


#: Roles that make a weak part of the role on the left worth a report.
COMPLEMENTS = {"secret": ("identifier", "endpoint"), "identifier": ("secret",), "endpoint": ("secret",)}


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The parts to report: strong ones, and weak ones with a complementary part in their scope."""
    key = KEY
    bucket = F.floor(F.col("start") / scope)
    ends = found.groupBy(*key, bucket.alias("bucket"), "role").agg(F.min("start").alias("lowest"), F.max("start").alias("highest"))
    weak = found.where(~F.col("base")).select(*key, "kind", "role", "start", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    other = ends.withColumnRenamed("role", "other")
    fits = F.lit(False)
    for role, wanted in COMPLEMENTS.items():
        fits = fits | ((F.col("role") == role) & F.col("other").isin(*wanted))
    near = F.least(F.abs(F.col("start") - F.col("lowest")), F.abs(F.col("start") - F.col("highest"))) <= scope
    kept = weak.join(other, [*key, "bucket"]).where(fits & near).select(*key, "kind", "start").distinct()
    return found.where("base").unionByName(found.join(kept, [*key, "kind", "start"], "left_semi"))


def spans_of(scanned: DataFrame, scope: int) -> DataFrame:
    """key, found: the reported spans of texts that have some."""
    reported = linked(stash(parts(scanned), "parts"), scope)
    return reported.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "kind_order", "end", "kind", "base"))).alias("found"))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id and reported spans of every row.

    ``found`` is an array of (start, kind_order, end, kind, base), ordered by start and kind, in code
    points with exclusive ends. Null text counts as empty and has no spans; rows that repeat (doc_id
    and text) each get the same spans, as do those without doc_id; an empty table gives no row. Other
    columns are not read. Texts are read once.
    """
    scanned = stash(searched(docs), "searched")
    empty = F.array().cast("array<struct<start:bigint,kind_order:int,end:bigint,kind:string,base:boolean>>")
    return scanned.select("doc_id", *KEY).join(spans_of(scanned, scope), KEY, "left").select("doc_id", F.coalesce("found", empty).alias("found"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts and hashes of the spans of ``scan``, a row for each document."""
    base = F.filter("found", lambda x: x["base"])
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def redact(docs: DataFrame, mask: str = "<secret>", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every reported span replaced by ``mask`` and n_chars counted anew; all rows and columns stay.

    Null text stays null, rows that repeat or have no doc_id are treated each like any other, and an
    empty table gives no row. Columns beyond doc_id, text and n_chars pass through, whatever their names.
    """
    spans = spans_of(stash(searched(docs), "searched"), scope)
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    whole = whole.select("row", F.coalesce("doc_id", F.lit(0)).cast("long").alias("k0"), F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").isNull()).alias("k1"), F.length(F.coalesce("text", F.lit(""))).alias("k2"))
    both = whole.join(spans, KEY, "left")
    text = F.when(F.col("found").isNull(), F.col("row.text")).otherwise(masked(F.col("row.text"), F.col("found"), mask))
    both = both.select("row", text.alias("text"), F.col("found").isNull().alias("same"))
    fields = {"text": F.col("text"), "n_chars": F.when(F.col("same"), F.col("row.n_chars")).otherwise(F.length("text").cast("long"))}
    return both.select(*[fields.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def masked(text: Column, found: Column, mask: str) -> Column:
    """The text with every reported span, or run of overlapping ones, replaced by ``mask``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(acc, span):
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(span["start"] - acc["at"], F.lit(0)).cast("int"))
        fresh = span["start"] >= acc["at"]
        return F.struct(F.when(fresh, F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], span["end"]).alias("at"))

    return F.when(F.size(found) == 0, text).otherwise(
        F.aggregate(found, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    )
