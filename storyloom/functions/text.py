"""String, regular-expression and JSON functions on columns. All but the offsets of pieces stay in the JVM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

WORD = r"[\p{L}\p{N}_]"
DASHES = "-‐-―"
MARK = "\u0001"  # never part of a text: it is removed first
EDGE_PUNCTUATION = ",.;:!?\"'()[]{}"


def lit(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_text(c: Column) -> Column:
    """Line ends to \\n, no blanks before them, at most one empty line."""
    c = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")


def token_count(c: Column) -> Column:
    """Tokens: runs of letters, digits and _, or one other character that is no white space."""
    return F.size(F.regexp_extract_all(c, F.lit(rf"(?U)({WORD}+|[^\p{{L}}\p{{N}}_\s])"), F.lit(1)))


PIECES = ArrayType(StructType([StructField("start", IntegerType()), StructField("piece", StringType())]))


def _cut(marked: pa.Array, matches: bool) -> pa.Array:
    """Parts between marks with their offsets in code points, in one pass over the batch; or every second part."""
    parts = pa.compute.split_pattern(marked, MARK)
    size = pa.compute.fill_null(pa.compute.list_value_length(parts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten()
    upto = np.concatenate([[0], np.cumsum(pa.compute.utf8_length(flat).to_numpy(zero_copy_only=False), dtype=np.int64)])
    first = np.cumsum(size) - size
    nth = np.arange(len(flat)) - np.repeat(first, size)
    start = upto[:-1] - np.repeat(upto[first], size)
    if matches:
        odd = np.flatnonzero(nth % 2)
        flat, start, size = flat.take(pa.array(odd)), start[odd], size // 2
    values = pa.StructArray.from_arrays([pa.array(start, pa.int32()), flat.cast(pa.string())], ["start", "piece"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), values, mask=marked.is_null())


def _sliced_cut(marked: pa.Array, matches: bool) -> pa.Array:
    done = [_cut(x, matches) for x in by_bytes(marked)]
    return done[0] if len(done) == 1 else pa.concat_arrays(done) if done else _cut(marked, matches)


@F.arrow_udf(PIECES)
def _parts(marked: pa.Array) -> pa.Array:
    return _sliced_cut(marked, False)


@F.arrow_udf(PIECES)
def _matched(marked: pa.Array) -> pa.Array:
    return _sliced_cut(marked, True)


SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
SPACE = " \t\n\x0b\f\r"  # what \s stands for
SLICE = 8 << 20


def by_bytes(a: pa.Array, most: int = SLICE) -> list[pa.Array]:
    """A column of texts in slices of bounded bytes (one text at least)."""
    upto = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(a), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts, at = [], 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
        cuts.append(a.slice(at, to - at))
        at = to
    return cuts


def _trimmed_spans(marked: pa.Array, trim: bool, tail: bool) -> pa.Array:
    """The places of the parts between marks; trim: without white space around them and without those of nothing else;
    tail: a part that ends with the text keeps it at its end. Texts do not go back to the JVM."""
    parts = pa.compute.split_pattern(marked, MARK)
    size = pa.compute.fill_null(pa.compute.list_value_length(parts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten()
    length = lambda x: pa.compute.utf8_length(x).to_numpy(zero_copy_only=False).astype(np.int64)
    n = length(flat)
    upto = np.concatenate([[0], np.cumsum(n)])
    first = np.cumsum(size) - size
    row = np.repeat(np.arange(len(size)), size)
    start = upto[:-1] - upto[first[row]]
    end, kept = start + n, n > 0
    if trim:
        left = length(pa.compute.utf8_ltrim(flat, SPACE))
        right = length(pa.compute.utf8_rtrim(flat, SPACE))
        kept = left > 0
        whole = upto[first + size][row] - upto[first[row]]
        end = np.where(tail & (end == whole), end, start + right)
        start = start + n - left
    values = pa.StructArray.from_arrays([pa.array(start[kept], pa.int32()), pa.array(end[kept], pa.int32())], ["start", "end"])
    size = np.bincount(row[kept], minlength=len(size))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), values, mask=marked.is_null())


def _spans_udf(trim: bool, tail: bool):
    @F.arrow_udf(SPANS)
    def spans(marked: pa.Array) -> pa.Array:
        done = [_trimmed_spans(x, trim, tail) for x in by_bytes(marked)]
        return pa.concat_arrays(done) if done else _trimmed_spans(marked, trim, tail)

    return spans


def piece_spans(c: Column, pattern: str | Column, replacement: str, trim: bool = False, tail: bool = False) -> Column:
    """array<struct<start, end>> of the pieces that are not empty; see pieces and _trimmed_spans."""
    return _spans_udf(trim, tail)(_marked(c, pattern, replacement))


def _marked(c: Column, pattern: str | Column, replacement: str) -> Column:
    clean = F.translate(c, MARK, " ")
    return F.regexp_replace(clean, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(replacement))


def pieces(c: Column, pattern: str | Column, replacement: str) -> Column:
    """Split where `replacement` puts MARK: array<struct<start, piece>> with code-point offsets.

    `replacement` is that of regexp_replace, for instance MARK + '$0' + MARK (odd pieces are the matches) or
    '$0' + MARK (pieces end with a delimiter). The pattern runs in the JVM; the offsets are running sums, which no
    JVM function gives in linear time, so they are taken over whole Arrow batches."""
    return _parts(_marked(c, pattern, replacement))


def matches(c: Column, pattern: str | Column) -> Column:
    """All non-overlapping matches: array<struct<start, piece>>."""
    return _matched(_marked(c, pattern, f"{MARK}$0{MARK}"))


def normalize_alias(c: Column) -> Column:
    """Trimmed, lower case, single spaces, no punctuation at either end."""
    edge = r"[,.;:!?\"'()\[\]{}]+"
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"\s+", " "), f"^{edge}|{edge}$", ""))


def split_list(c: Column) -> Column:
    """A list field: a JSON array of strings, or parts between ; or |; trimmed, without empty ones."""
    parsed = F.from_json(c, "array<string>")
    parts = F.when(F.trim(c).rlike(r"^\[.*\]$"), F.coalesce(parsed, F.array().cast("array<string>"))).otherwise(F.split(F.translate(F.coalesce(c, F.lit("")), ";", "|"), r"\|"))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def json_list(c: Column) -> Column:
    """A JSON array's strings; anything else is an empty list."""
    return F.filter(F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull())


def extract_json(c: Column, schema: str) -> Column:
    """The first of these that parses: the whole text, a fenced block, the widest span of brackets."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    swept = F.regexp_extract(c, r"(?s)([\[{].*[\]}])", 1)
    options = {"mode": "PERMISSIVE"}
    kind = F.when(F.ltrim(c).rlike(r"^[\[{]"), F.from_json(c, schema, options))
    return F.coalesce(kind, F.from_json(F.nullif(F.trim(fenced), F.lit("")), schema, options), F.from_json(F.nullif(swept, F.lit("")), schema, options))


def truncated(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def excerpt(c: Column, start: Column, end: Column, before: int = 160, after: int = 160) -> Column:
    """The surroundings of a span on one line, with an ellipsis where text was left out."""
    a, b = F.greatest(F.lit(0), start - before), F.least(F.length(c), end + after)
    left, right = (F.when(x, F.lit("…")).otherwise(F.lit("")) for x in (a > 0, b < F.length(c)))
    return F.regexp_replace(F.regexp_replace(F.concat(left, c.substr(a + 1, b - a), right), r"^\s+|\s+$", ""), r"\s+", " ")


def escaped_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escaped_xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escaped_csv(c: Column) -> Column:
    return F.when(c.rlike('[",\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def display_quotes(c: Column) -> Column:
    """Letters that a wrong code page made of quotes and dashes (fixed values)."""
    return F.translate(c, "ÒÓÕÔÊ", "“”’——")


def parsed_edit(expr: Column, start: Column, end: Column) -> Column:
    """struct<start, end> of an edit: absolute `a,b` or `a b`, relative if either number has a sign (`+a,-b`); null
    where it is neither."""
    part = lambda k: F.regexp_extract(expr, r"^\s*([+-]?\d+)\s*[, ]\s*([+-]?\d+)\s*$", k)
    signed = part(1).rlike("^[+-]") | part(2).rlike("^[+-]")
    one = lambda k, now: F.when(signed, now + part(k).cast("int")).otherwise(part(k).cast("int"))
    return F.when(part(1) != "", F.struct(one(1, start).alias("start"), one(2, end).alias("end")))


def pastel(c: Column, alpha: str = "0.45") -> Column:
    """`rgba(r,g,b,alpha)` from the first 24 bits of the md5: five bits for each channel on a light base."""
    h = F.conv(F.substring(F.md5(c.cast("binary")), 1, 6), 16, 10).cast("int")
    channel = lambda base, shift: (F.lit(base) + F.shiftright(h, shift).bitwiseAND(F.lit(31))).cast("string")
    return F.concat(F.lit("rgba("), F.concat_ws(",", channel(180, 0), channel(170, 5), channel(160, 10)), F.lit(f",{alpha})"))


def hue(c: Column) -> Column:
    """0 to 359: the 31-fold hash of the code points, in 32 bits, as a browser would colour a name."""
    points = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    return F.pmod(F.aggregate(points, F.lit(0).cast("long"), lambda h, x: F.pmod(h * 31 + x, F.lit(1 << 32))), F.lit(360)).cast("int")


def scene_label(chapter: Column, scene: Column) -> Column:
    return F.coalesce(F.concat(F.lit("c"), chapter.cast("string"), F.lit(":s"), scene.cast("string")), F.concat(F.lit("s"), scene.cast("string")))


def motif_text(name: Column, summary: Column, aliases: Column, most: int = 12) -> Column:
    """What stands for a motif in the vector space: name, summary and its shorter aliases."""
    short = F.slice(F.filter(aliases, lambda a: F.length(a) <= 40), 1, most)
    listed = F.when(F.size(short) > 0, F.concat(F.lit("Aliases: "), F.array_join(short, ", ")))
    return F.concat_ws("  ", name, F.when(F.trim(summary) != "", F.concat(F.lit("— "), F.trim(summary))), listed)


def motif_query(name: Column, summary: Column, aliases: Column) -> Column:
    some = F.array_join(F.slice(aliases, 1, 3), "; ")
    return F.when(F.trim(summary) != "", F.concat(name, F.lit(". "), F.trim(summary))).when(F.size(aliases) > 0, F.concat(name, F.lit(". "), some)).otherwise(name)


def mentioned(texts: Column, phrases: Column) -> Column:
    """Whether any phrase stands in any text: phrases with a space as substrings, single words whole."""
    flat = lambda x: F.regexp_replace(F.lower(x), r"\s+", " ")
    quoted = lambda p: F.regexp_replace(p, r"([^\p{L}\p{N}_ ])", r"\\$1")
    hit = lambda t, p: F.when(F.contains(p, F.lit(" ")), F.contains(t, p)).otherwise(F.regexp(t, F.concat(F.lit(rf"(?<!{WORD})"), quoted(p), F.lit(rf"(?!{WORD})"))))
    return F.exists(F.transform(texts, flat), lambda t: F.exists(F.filter(F.transform(phrases, flat), lambda p: F.trim(p) != ""), lambda p: hit(t, p)))


NEGATION = r"(?iuU)\b(no|not|never|without|hardly|rarely|seldom|none)\b"
STRONG_NEGATION = r"(?iuU)\b(no|never|without|lack(?:ing)?(?:\s+of)?|absence(?:\s+of)?|free\s+of)\b"
META_CUES = r"(?iuU)\b(parody|satire|meta|lampshad\p{L}*|deconstruct\p{L}*|clich(?:e|é)s?)(?![\p{L}\p{N}_])"
ANTI_EDGE = rf"(?iuU)(?<!{WORD})anti(?:[{DASHES}]|\s)+"
