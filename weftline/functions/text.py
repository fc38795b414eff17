"""Text projections as Column expressions."""

from __future__ import annotations

import html
import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numeric references that stand for other characters, or for none.
_ODD = {**dict.fromkeys(sorted(html._invalid_codepoints), ""), **html._invalid_charrefs}
# The white space that Python's str.strip removes.
WHITE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def hash_id(content: Column, prefix: str = "") -> Column:
    """Prefix and md5 of the content."""
    return F.concat(F.lit(prefix), F.md5(content))


def short_doc_id(content: Column, prefix: str) -> Column:
    """Prefix, a dash and the first 16 digits of the md5."""
    return F.concat_ws("-", F.lit(prefix), F.substring(F.md5(content), 1, 16))


def args_hash(*args: Column) -> Column:
    """One hash of several arguments."""
    return F.md5(F.to_json(F.struct(*[a.alias(f"a{k}") for k, a in enumerate(args)])))


def strip(text: Column) -> Column:
    """Python's white space off both ends."""
    return F.btrim(text, F.lit(WHITE))


def tokens(text: Column) -> Column:
    """T4: words between white space; an empty array without any."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def split_markers(text: Column, *markers: str) -> Column:
    """T5: stripped, non-empty parts between any of the markers."""
    if not markers:
        return F.array(text)
    pattern = "|".join(rf"\Q{m}\E" for m in markers)
    return F.filter(F.transform(F.split(text, pattern), strip), lambda x: x != "")


def unescaped(text: Column) -> Column:
    """HTML character references to characters, as browsers read them: numbers, names, and names without a semicolon by their longest known beginning."""
    # Both tables stand once in the expression: plans carry them.
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    odd = F.from_json(F.lit(json.dumps({str(k): v for k, v in _ODD.items()})), "map<string,string>")

    def number(said: Column) -> Column:
        bare = F.regexp_replace(F.regexp_extract(said, "^#[xX]?([0-9a-fA-F]+)", 1), "^0+(?=.)", "")
        code = F.when(F.length(bare) > 9, F.lit(1 << 31)).when(said.rlike("^#[xX]"), F.conv(bare, 16, 10).cast("long")).otherwise(bare.cast("long"))
        character = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        wrong = ((code >= 0xD800) & (code <= 0xDFFF)) | (code > 0x10FFFF)
        return F.coalesce(F.element_at(odd, code.cast("string")), F.when(wrong, "\ufffd").otherwise(character))

    def name(said: Column) -> Column:
        # The whole, then its beginnings of two characters and more, longest first.
        tried = F.transform(F.sequence(F.length(said), F.least(F.lit(2), F.length(said)), F.lit(-1)), lambda n: F.struct(n.alias("n"), F.element_at(names, F.left(said, n)).alias("c")))
        met = F.try_element_at(F.filter(tried, lambda t: t["c"].isNotNull()), F.lit(1))
        return F.coalesce(F.concat(met["c"], F.substring(said, met["n"] + 1, F.length(said))), F.concat(F.lit("&"), said))

    def reference(part: Column) -> Column:
        said = F.regexp_extract(part, r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)", 1)
        whole = F.when(said == "", "&").when(said.startswith("#"), number(said)).otherwise(name(said))
        return F.concat(whole, F.substring(part, F.length(said) + 1, F.length(part)))

    parts = F.split(text, "&", -1)
    return F.when(text.contains("&"), F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), reference), ""))).otherwise(text)


def clean(text: Column) -> Column:
    """Stripped, character references decoded, control characters deleted; all by built-ins."""
    return F.regexp_replace(unescaped(strip(text)), r"[\x00-\x1f\x7f-\x9f]", "")


def number_or(text: Column, default: float) -> Column:
    """The number that the text is, else the default; neither exponents nor a bare trailing point count."""
    return F.when(text.rlike(r"^[-+]?[0-9]*\.?[0-9]+$"), text.try_cast("double")).otherwise(F.lit(default))


def unicode_unescape(text: Column) -> Column:
    r"""T10: \uXXXX escapes to characters."""
    def character(part: Column) -> Column:
        code = F.regexp_extract(part, "^[0-9a-fA-F]{4}", 0)
        return F.when(code == "", F.concat(F.lit("\\u"), part)).otherwise(F.concat(F.decode(F.unhex(code), "UTF-16BE"), F.substring(part, 5, F.length(part))))

    # Two escapes that make one character are read together.
    pairs = F.split(text, r"\\u(?=[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2})", -1)
    wide = lambda p: F.concat(F.decode(F.unhex(F.concat(F.left(p, F.lit(4)), F.substring(p, 7, 4))), "UTF-16BE"), F.substring(p, 11, F.length(p)))
    whole = F.concat(pairs[0], F.array_join(F.transform(F.slice(pairs, 2, F.size(pairs)), wide), ""))
    parts = F.split(whole, r"\\u", -1)
    return F.when(text.contains("\\u"), F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), character), ""))).otherwise(text)


def json_body(text: Column) -> Column:
    """The widest {...} of the text, line ends out and single quotes doubled; empty without one."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.replace(F.replace(F.replace(body, F.lit("\\n"), F.lit("")), F.lit("\n"), F.lit("")), F.lit("'"), F.lit('"'))


def parsed_json(text: Column, schema: str) -> Column:
    """The body of T11 by a schema; null where there is none."""
    return F.from_json(json_body(text), schema)


def csv_line(*cells: Column) -> Column:
    """Cells as one CSV line."""
    return F.to_csv(F.struct(*[c.alias(f"c{k}") for k, c in enumerate(cells)]))


def normal_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single blanks."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    return strip(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), r"\s+", " "))


def contains_any(answer: Column, golds: Column) -> Column:
    """Whether the answer holds one of the golds, both lowered and without punctuation."""
    bare = lambda c: strip(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", ""))
    return F.exists(golds, lambda g: F.contains(bare(answer), bare(g)))


def shortened(text: Column, n: int) -> Column:
    """The first n characters and dots, where there are more."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)
