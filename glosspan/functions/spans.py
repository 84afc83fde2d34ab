"""Span primitives as Columns: everything here stays on the JVM.

A span is a half-open pair of code-point offsets into one immutable text.  Patterns never use ``\\b`` (Java's is
Unicode-aware): ``bounded`` puts ASCII look-arounds instead.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MASK = "\ufffd"
SPAN = "array<struct<start:int,end:int,text:string>>"
_ALNUM = r"[\p{L}\p{N}]"
WORD = _ALNUM + f"(?:{_ALNUM}|['\u2019](?={_ALNUM})|[-.](?={_ALNUM}))*"


def bounded(pattern: str) -> str:
    """``pattern`` between ASCII word boundaries."""
    return rf"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def find_spans(text: Column, pattern: str | Column) -> Column:
    """All matches of a pattern that never matches empty, with offsets, in a short text (a sentence or a block)."""
    rx = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.coalesce(F.regexp_extract_all(text, rx, F.lit(0)), F.array())
    gaps = F.transform(F.split(text, rx, -1), F.length)
    sizes = F.transform(found, F.length)
    sum_of = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    return F.transform(found, lambda m, i: F.struct(
        (sum_of(F.slice(gaps, 1, i + 1)) + sum_of(F.slice(sizes, 1, i))).alias("start"),
        (sum_of(F.slice(gaps, 1, i + 1)) + sum_of(F.slice(sizes, 1, i + 1))).alias("end"), m.alias("text")))


def explode_spans(df: DataFrame, keys: list[str], text: str, pattern: str) -> DataFrame:
    """(keys, ordinal, start, end, match) of every match in long texts: linear, by running sums in a window.

    The window is over one document's own matches, keyed by ``keys``, which must identify the row.
    """
    rx = F.lit(pattern)
    zipped = df.select(*keys, F.posexplode(F.arrays_zip(
        F.split(F.col(text), rx, -1).alias("gap"), F.regexp_extract_all(F.col(text), rx, F.lit(0)).alias("hit"))).alias("ordinal", "z"))
    w = Window.partitionBy(*keys).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    run = zipped.withColumn("end", F.sum(size(F.col("z.gap")) + size(F.col("z.hit"))).over(w))
    return run.where(F.col("z.hit").isNotNull()).select(
        *keys, "ordinal", (F.col("end") - F.length("z.hit")).cast("int").alias("start"), F.col("end").cast("int"), F.col("z.hit").alias("match"))


def mask_matches(text: Column, pattern: str) -> Column:
    """The text with every match replaced, character for character, by the mask; line ends stay."""
    rx = F.lit(pattern)
    gaps = F.split(text, rx, -1)
    hits = F.transform(F.coalesce(F.regexp_extract_all(text, rx, F.lit(0)), F.array()), lambda m: F.regexp_replace(m, r"[^\r\n]", MASK))
    pairs = F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.coalesce(h, F.lit(""))))
    return F.array_join(pairs, "")


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def contains(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_start) & (b_end <= a_end)


def merge_ranges(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping or adjacent ranges of each key united (gaps and islands)."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    opened = F.when(F.coalesce(F.max(end).over(before), F.lit(-1)) < F.col(start), 1).otherwise(0)
    return (df.select(*keys, start, end).withColumn("_new", opened).withColumn("_island", F.sum("_new").over(upto))
            .groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island"))


def normalise_line_ends(text: Column) -> Column:
    return F.regexp_replace(text, "\r(?=\n)", " ")


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of an offset; a negative offset counts as 0."""
    at = F.greatest(offset, F.lit(0))
    return F.lit(1) + F.length(F.regexp_replace(F.substring(text, F.lit(1), at), "[^\n]", ""))


def column_of(text: Column, offset: Column) -> Column:
    """0-based column of an offset."""
    head = F.substring(text, F.lit(1), F.greatest(offset, F.lit(0)))
    return F.length(F.regexp_extract(head, r"([^\n]*)\z", 1))


def content_hash(*parts: Column) -> Column:
    """SHA-256 over the parts, each followed by a unit separator."""
    return F.sha2(F.concat(*[F.concat(p, F.lit("\x1f")) for p in parts]), 256)


def match_capitals(source: Column, replacement: Column) -> Column:
    """The replacement in the source's capitals: all, first letter, or as it is."""
    letters = F.regexp_replace(source, r"[^\p{L}]", "")
    shout = (F.length(letters) > 1) & (source == F.upper(source)) & source.rlike(r"\p{Lu}")
    lead = F.substring(source, 1, 1)
    initial = (lead == F.upper(lead)) & (lead != F.lower(lead))
    return F.when(shout, F.upper(replacement)).when(
        initial, F.concat(F.upper(F.substring(replacement, 1, 1)), F.substring(replacement, F.lit(2), F.length(replacement)))).otherwise(replacement)


def excerpt(text: Column, most: int = 120) -> Column:
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def syllables(word: Column) -> Column:
    """Vowel groups, less a silent final e, at least one."""
    low = F.lower(word)
    groups = F.length(F.regexp_replace(F.regexp_replace(low, r"[aeiouy]+", "#"), r"[^#]", ""))
    silent = F.when(low.rlike(r"[^aeiouyl]e$") & (groups > 1), 1).otherwise(0)
    return F.greatest(F.lit(1), groups - silent)


def grade_level(text: Column) -> Column:
    """Flesch-Kincaid grade of one sentence: 0.39 words + 11.8 syllables per word - 15.59; null without words."""
    found = F.regexp_extract_all(text, F.lit(r"[A-Za-z]+"), F.lit(0))
    n = F.size(found)
    total = F.aggregate(found, F.lit(0), lambda a, w: a + syllables(w))
    return F.when(n > 0, F.lit(0.39) * n + F.lit(11.8) * total / n - F.lit(15.59))


def reading_ease(text: Column) -> Column:
    """Flesch reading ease of one sentence; null without words."""
    found = F.regexp_extract_all(text, F.lit(r"[A-Za-z]+"), F.lit(0))
    n = F.size(found)
    total = F.aggregate(found, F.lit(0), lambda a, w: a + syllables(w))
    return F.when(n > 0, F.lit(206.835) - F.lit(1.015) * n - F.lit(84.6) * total / n)


# == fix safety

_NEGATION = "cannot|neither|without|never|none|not|nor|no"
_MODAL = "should|could|might|would|ought|shall|must|will|need|can|may"
_ORDER = "finally|before|during|while|until|after|first|then|next|when|once"


def comparable(text: Column) -> Column:
    """Lower case with contractions and register variants spelt out, so that meanings compare and not spellings."""
    t = F.regexp_replace(F.lower(text), "\u2019", "'")
    for pattern, plain in ((bounded("whilst"), "while"), (bounded(r"pri(?:or)\s+to|previous\s+to"), "before"), (bounded(r"subsequent\s+to"), "after"),
                           (bounded("cannot"), "can not"), (bounded("won't"), "will not"), (bounded("can't"), "can not"), (bounded("shan't"), "shall not"),
                           (r"(?<![a-z0-9_])([a-z]+)n't(?![a-z0-9_])", "$1 not")):
        t = F.regexp_replace(t, pattern, plain)
    return t


def _bag(text: Column, alternatives: str) -> Column:
    return F.sort_array(F.coalesce(F.regexp_extract_all(text, F.lit(bounded(alternatives)), F.lit(0)), F.array().cast("array<string>")))


def numbers(text: Column) -> Column:
    found = F.coalesce(F.regexp_extract_all(text, F.lit("[+-]?" + r"\d+" + r"(?:[,.]\d+)*"), F.lit(0)), F.array().cast("array<string>"))
    return F.transform(found, lambda n: F.regexp_replace(n, ",", "."))


def fix_refusal(before: Column, after: Column) -> Column:
    """Why a replacement may not be applied, or null: numbers in order, then negation, modals, ordering words."""
    a, b = comparable(before), comparable(after)
    return (F.when(~numbers(before).eqNullSafe(numbers(after)), "number changed")
            .when(_bag(a, _NEGATION) != _bag(b, _NEGATION), "negation changed")
            .when(_bag(a, _MODAL) != _bag(b, _MODAL), "modal changed")
            .when(_bag(a, _ORDER) != _bag(b, _ORDER), "ordering changed"))


def either(terms: Iterable[str]) -> str:
    """An alternation of literal terms, longest first, white space matching any run of it."""
    quote = lambda t: "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in t)
    return "|".join(r"\s+".join(map(quote, t.split())) for t in sorted(terms, key=lambda t: (-len(t), t)))
