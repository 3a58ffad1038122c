"""Text as columns: length-preserving normalisation, search with offsets, trimming, numbers (T and N of the inventory).

Offsets are code points, half-open, in the untouched text.  Everything here stays in JVM expressions.  ``(?U)`` makes
Java's classes Unicode-aware; ``WS`` adds the four separators that Java's white space leaves out.
"""
from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import arrow_column, lists, struct

# --- fixed values: white space, line breaks, edge characters of spans, numbers and ranges --------------------------------
WS = r"[\s\x1c-\x1f]"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: Edge characters of spans: rules, dictionary tokens (left, right), de-noising (right edge, left edge).
TRIM = " \t\r\n,;:.•-"
TOKEN_LEFT, TOKEN_RIGHT = " \t([{\"'“‘", " \t,.;:)]}\"'”’"
SPAN_RIGHT, SPAN_LEFT = " \t.,;:-–—)）]", " \t.,;:-–—(（["
NUMBER = r"[+-]?(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+[.,]\d+|\d+)"
RANGE = rf"(?U)([+-]?\d+(?:[.,]\d+)?){WS}*(?:-->|->|—|–){WS}*([+-]?\d+(?:[.,]\d+)?)"

_NUMBER = re.compile(NUMBER, re.ASCII)
_THOUSANDS = re.compile(r"[+-]?\d{1,3}(?:,\d{3})+(?:\.\d+)?", re.ASCII)

MATCHES = "array<struct<start:int,end:int,raw:string>>"


def bind(rows: DataFrame, **values: Column) -> DataFrame:
    """Add or replace columns whose values are computed once a row.

    Filters on plain projections are pushed down with the whole expression in them; with chains of text steps that grows
    without end.  A one-element generator stops it and stays in generated code.
    """
    keep = [c for c in rows.columns if c not in values]
    one = F.explode(F.array(F.struct(*[v.alias(n) for n, v in values.items()]))).alias("_b")
    return rows.select(*keep, one).select(*keep, *[F.col(f"_b.{n}").alias(n) for n in values])


# --- T1-T4: one character to one character


@lru_cache(maxsize=8)
def _alphabet(lower: bool, deaccent: bool) -> tuple[str, str]:
    """Source and target characters of the map, from Unicode's own tables; only what changes is listed."""
    src, dst = [], []
    for code in range(0x80 if not lower else 0x41, 0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        x = c
        if deaccent:
            base = [b for b in unicodedata.normalize("NFD", c) if not unicodedata.combining(b)]
            x = {"đ": "d", "Đ": "D"}.get(c) or (base[0] if base else c)
        if lower and len(x.lower()) == 1:
            x = x.lower()
        if x != c:
            src.append(c)
            dst.append(x)
    return "".join(src), "".join(dst)


def normalize(c: Column, lower: bool = True, deaccent: bool = True) -> Column:
    """Lower case without accents; length and offsets are kept."""
    src, dst = _alphabet(lower, deaccent)
    return F.translate(c, src, dst)


def normalize_literal(s: str) -> str:
    """The same for a driver-side string."""
    return normal_form(s)


@lru_cache(maxsize=1)
def _table() -> dict[int, int]:
    return str.maketrans(*_alphabet(True, True))


def normal_form(s: str) -> str:
    """The same inside Arrow functions."""
    return s.translate(_table())


def char_view(raw: Column) -> Column:
    """The normalised text, checked to be as long as ``raw``."""
    norm = normalize(raw)
    return F.when(F.length(norm) == F.length(raw), norm).otherwise(F.raise_error(F.lit("normalisation changed a length")))


# --- trimming


def char_class(chars: str) -> str:
    """A pattern for one of the characters."""
    return "[" + "".join("\\" + c if c in "[]\\^-&" else c for c in chars) + "]"


def strip(c: Column) -> Column:
    """White space off both ends, Unicode's included."""
    return F.regexp_replace(c, f"(?U)^{WS}+|{WS}+$", "")


def lead(c: Column, chars: str) -> Column:
    """How many characters at the beginning are of ``chars``."""
    return F.length(F.regexp_extract(c, f"^{char_class(chars)}*", 0))


def trim_edges(c: Column, chars: str = TRIM) -> Column:
    return F.regexp_replace(c, f"^{char_class(chars)}+|{char_class(chars)}+\\z", "")


def trimmed(text: Column, start: Column, left: str = TRIM, right: str | None = None) -> tuple[Column, Column]:
    """(text without edge characters, its start); T9 and T11."""
    head = lead(text, left)
    rest = F.substring(text, head + 1, F.length(text))
    return F.regexp_replace(rest, f"{char_class(right or left)}+\\z", ""), (start + head).cast("int")


def strip_span(text: Column, start: Column) -> tuple[Column, Column]:
    """White space, trailing bracket groups while something precedes them, then edge punctuation once."""
    head = F.length(F.regexp_extract(text, f"(?U)^{WS}*", 0))
    body = F.regexp_replace(F.substring(text, head + 1, F.length(text)), f"(?U){WS}+\\z", "")
    cut = F.regexp_replace(body, rf"(?U)(?<=.)(?:{WS}*[(（\[][^)）\]]*[)）\]]{WS}*)+\z", "")
    right = F.regexp_replace(cut, f"{char_class(SPAN_RIGHT)}+\\z", "")
    more = lead(right, SPAN_LEFT)
    return F.substring(right, more + 1, F.length(right)), (start + head + more).cast("int")


def words(c: Column, lower: bool = False) -> Column:
    """White-space tokens; T14."""
    return F.filter(F.split(F.lower(c) if lower else c, f"(?U){WS}+"), lambda t: t != "")


def n_words(c: Column) -> Column:
    return F.size(words(c))


def collapse(c: Column) -> Column:
    """Normalised, white space runs to one space, no ends."""
    return F.trim(F.regexp_replace(normalize(c), f"(?U){WS}+", " "))


@lru_cache(maxsize=1)
def _compositions() -> list[tuple[str, str]]:
    """Pairs of two characters and the letter that composes them, up to U+1EFF, from Unicode's tables; bases without marks first.

    Marks of different classes may come in any order, so a letter with two marks is reached by either.
    """
    found: dict[str, str] = {}
    for code in range(0xC0, 0x1F00):
        c = chr(code)
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and unicodedata.normalize("NFC", c) == c:
            for i in range(1, len(parts)):
                begun = unicodedata.normalize("NFC", parts[:i] + parts[i + 1 :])
                if len(begun) == 1 and unicodedata.normalize("NFC", begun + parts[i]) == c:
                    found[begun + parts[i]] = c
    return sorted(found.items(), key=lambda x: (len(unicodedata.normalize("NFD", x[0])), x))


def composed(c: Column) -> Column:
    """Letters and their combining marks as single characters (for letters up to U+1EFF); other texts are left alone."""
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _compositions()])
    return F.when(c.rlike("[\\x{300}-\\x{36f}]"), F.aggregate(table, c, lambda acc, x: F.replace(acc, x["a"], x["b"]))).otherwise(c)


def text_key(c: Column) -> Column:
    """Key of exact-text alignment: composed, lower case, white space collapsed."""
    return F.regexp_replace(F.lower(strip(composed(c))), f"(?U){WS}+", " ")


def lookup(key: Column, table: dict[str, str]) -> Column:
    """A small constant table as a column; null for other keys."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def expand_abbreviation(norm: Column, table: dict[str, str] | None = None) -> Column:
    """The full form of a normalised abbreviation, else the text itself."""
    from .config import ABBREVIATIONS

    return F.coalesce(lookup(F.trim(norm), table or ABBREVIATIONS), norm)


# --- T6-T8: search


_RUN = 64


def grown(acc: Column, item: Column) -> Column:
    """``acc`` (struct of full, part) with one item more: parts of ``_RUN`` items are closed, so that a long list isn't copied for every item."""
    part = F.concat(acc["part"], F.array(item))
    whole = F.size(part) >= _RUN
    return F.struct(F.when(whole, F.concat(acc["full"], F.array(part))).otherwise(acc["full"]).alias("full"), F.when(whole, F.slice(part, 1, 0)).otherwise(part).alias("part"))


def no_items(kind: str) -> Column:
    """The empty list to grow, of items of a type."""
    return F.struct(F.array().cast(f"array<array<{kind}>>").alias("full"), F.array().cast(f"array<{kind}>").alias("part"))


def items(acc: Column) -> Column:
    return F.concat(F.flatten(acc["full"]), acc["part"])


def match_positions(c: Column, pattern: Column | str, target: Column | None = None) -> Column:
    """All matches with offsets: one fold over gaps and matches.

    ``target`` is the text whose substrings are returned (the raw text when ``c`` is its normalised view).
    """
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(c, p, F.lit(0))
    gaps = F.transform(F.split(c, p, -1), lambda g: F.length(g))
    begin = F.struct(F.lit(0).alias("at"), no_items("struct<start:int,end:int>").alias("out"))

    def step(acc, x):
        s = acc["at"] + F.coalesce(x["g"], F.lit(0))
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), grown(acc["out"], F.struct(s.alias("start"), e.alias("end"))).alias("out"))

    pairs = F.filter(F.arrays_zip(found.alias("m"), gaps.alias("g")), lambda x: x["m"].isNotNull())
    spans = F.aggregate(pairs, begin, step, lambda acc: items(acc["out"]))
    raw = c if target is None else target
    return F.transform(spans, lambda x: F.struct(x["start"], x["end"], F.substring(raw, x["start"] + 1, x["end"] - x["start"]).alias("raw")))


def needle_pattern(needle: str, ws_flexible: bool = True, whole_word: bool = False) -> str:
    """T5: a Java pattern that finds ``needle`` in a normalised text."""
    n = normalize_literal(needle)
    body = (WS + "+").join(_quote(t) for t in n.split()) if ws_flexible and n.split() else _quote(n)
    guard = "0-9A-Za-zÀ-ỹ"
    return "(?U)" + (f"(?<![{guard}]){body}(?![{guard}])" if whole_word else body)


def _quote(s: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}\-])", r"\\\1", s)


def needle_pattern_column(needle: Column) -> Column:
    """T5 for needles in a column, white-space-flexible."""
    quoted = F.transform(words(normalize(needle)), lambda t: F.regexp_replace(t, r"([\\^$.|?*+()\[\]{}\-])", r"\\$1"))
    return F.concat(F.lit("(?U)"), F.array_join(quoted, WS + "+"))


def find_all(raw: Column, needle: str | Column, ws_flexible: bool = True, whole_word: bool = False, norm: Column | None = None) -> Column:
    """Occurrences of the needle, accents and case ignored; text comes from ``raw``; a blank needle finds nothing."""
    if isinstance(needle, str):
        if not needle.strip():
            return F.array().cast(MATCHES)
        pattern: Column | str = needle_pattern(needle, ws_flexible, whole_word)
        return match_positions(normalize(raw) if norm is None else norm, pattern, raw)
    return F.when(strip(needle) == "", F.array().cast(MATCHES)).otherwise(match_positions(normalize(raw) if norm is None else norm, needle_pattern_column(needle), raw))


def first_match(matches: Column, start: Column | int = 0) -> Column:
    """The first match at or after ``start``, or null."""
    return F.get(F.filter(matches, lambda m: m["start"] >= start), 0)


def is_grounded(raw: Column, text: Column, start: Column, end: Column) -> Column:
    """T8."""
    return F.coalesce((start >= 0) & (start <= end) & (end <= F.length(raw)) & (F.substring(raw, start + 1, end - start) == text), F.lit(False))


# --- T18-T20


def parse_marked(marked: Column) -> Column:
    """struct(text, concepts) of ``<c type="..." a="...">...</c>`` mark-up; offsets are in the clean text."""
    from .config import ASSERTABLE, FAMILY, HISTORICAL, NEGATED, TYPES

    tag = r'(?s)<c(?U:\s+)type="([^"]+)"(?:(?U:\s+)a="([^"]*)")?(?U:\s*)>(.*?)</c>'
    parts = F.arrays_zip(
        F.split(marked, tag, -1).alias("plain"),
        F.regexp_extract_all(marked, F.lit(tag), F.lit(1)).alias("kind"),
        F.regexp_extract_all(marked, F.lit(tag), F.lit(2)).alias("a"),
        F.regexp_extract_all(marked, F.lit(tag), F.lit(3)).alias("inner"),
    )
    blank = "array<struct<text:string,type:string,start:int,end:int,assertions:array<string>>>"
    begin = F.struct(F.lit("").alias("text"), F.array().cast(blank).alias("out"))

    def step(acc, x):
        s = F.length(acc["text"]) + F.length(x["plain"])
        kind = strip(F.coalesce(x["kind"], F.lit("")))
        marks = F.filter(F.transform(F.split(F.coalesce(x["a"], F.lit("")), ","), strip), lambda a: a.isin(NEGATED, FAMILY, HISTORICAL))
        made = F.struct(
            x["inner"].alias("text"), kind.alias("type"), s.alias("start"), (s + F.length(x["inner"])).alias("end"),
            F.when(kind.isin(ASSERTABLE), marks).otherwise(F.array().cast("array<string>")).alias("assertions"),
        )
        valid = kind.isin(TYPES) & (strip(F.coalesce(x["inner"], F.lit(""))) != "")
        out = F.when(valid, F.concat(acc["out"], F.array(made))).otherwise(acc["out"])
        return F.struct(F.concat(acc["text"], x["plain"], F.coalesce(x["inner"], F.lit(""))).alias("text"), out.alias("out"))

    return F.aggregate(parts, begin, step, lambda acc: F.struct(acc["text"].alias("text"), acc["out"].alias("concepts")))


def mark(raw: Column, start: Column, end: Column, before: int = 300, after: int = 80) -> Column:
    """The concept between markers in a clamped window of its text."""
    left = F.greatest(F.lit(0), start - before)
    return F.concat(F.substring(raw, left + 1, start - left), F.lit(" [E] "), F.substring(raw, start + 1, end - start), F.lit(" [/E] "), F.substring(raw, end + 1, F.lit(after)))


def multi_hot(assertions: Column) -> Column:
    """One number per assertion: negated, historical, family."""
    from .config import FAMILY, HISTORICAL, NEGATED

    return F.array(*[F.array_contains(assertions, a).cast("double") for a in (NEGATED, HISTORICAL, FAMILY)])


# --- N1-N5


def number_kind(token: Column) -> Column:
    return F.when(token.rlike(r"^[+-]?\d{1,3}(?:,\d{3})+(?:\.\d+)?$"), "thousands").when(token.rlike("[.,]"), "decimal").otherwise("int")


def number_value(token: Column) -> Column:
    kind = number_kind(token)
    return F.when(kind == "thousands", F.replace(token, F.lit(","), F.lit(""))).when(kind == "decimal", F.replace(token, F.lit(","), F.lit("."))).otherwise(token).try_cast("double")


def find_numbers(c: Column) -> Column:
    """Array of (start, end, raw, kind, value)."""
    return arrow_column(numbers_of, "array<struct<start:int,end:int,raw:string,kind:string,value:double>>", c)


def numbers_of(texts: pa.Array, kind: pa.DataType) -> pa.Array:
    """The numbers of each text, field by field."""
    counts, start, end, raw, kinds, value = [], [], [], [], [], []
    for text in texts.to_pylist():
        before = len(raw)
        for m in _NUMBER.finditer(text or ""):
            t = m[0]
            start.append(m.start())
            end.append(m.end())
            raw.append(t)
            many = _THOUSANDS.fullmatch(t) is not None
            kinds.append("thousands" if many else "decimal" if "." in t or "," in t else "int")
            value.append(float(t.replace(",", "" if many else ".")))
        counts.append(None if text is None else len(raw) - before)
    columns = [pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(raw, pa.string()), pa.array(kinds, pa.string()), pa.array(value, pa.float64())]
    return lists(counts, struct(kind.value_type, columns), kind)


def find_ranges(c: Column) -> Column:
    """Array of (start, end, raw, a, b); two numbers joined by an arrow or a long dash, never a bare hyphen."""
    value = lambda m, g: F.replace(F.regexp_extract(m["raw"], RANGE, g), F.lit(","), F.lit(".")).try_cast("double")
    return F.transform(match_positions(c, RANGE), lambda m: F.struct(m["start"], m["end"], m["raw"], value(m, 1).alias("a"), value(m, 2).alias("b")))


def looks_like_measurement(c: Column) -> Column:
    """N4."""
    t = strip(c)
    return (t != "") & (F.length(t) <= 80) & t.rlike(r"(?U)\d")


def dose(norm: Column) -> tuple[Column, Column, Column]:
    """(text before the dose, number with a point, unit) of the first dose; empty strings if there is none."""
    p = rf"(?iU)(\d+(?:[.,]\d+)?){WS}*(mg|mcg|ug|g|ml|iu)\b"
    return F.regexp_extract(norm, rf"(?iUs)^(.*?){p[5:]}", 1), F.replace(F.regexp_extract(norm, p, 1), F.lit(","), F.lit(".")), F.lower(F.regexp_extract(norm, p, 2))
