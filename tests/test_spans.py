"""Span primitives: offsets slice back, lengths stay, ranges stay ordered."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glosspan.functions import spans
from glosspan.operators import regions as R

TEXTS = ["", "abc", "a bb  ccc", "x\ny\n", "don't stop—now", "Ünïcode wörds 12", "a,b,,c", "  "]


def test_find_spans_matches_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string")
    for rx in (r"[a-z]+", r",", r"\d+"):
        got = {r.id: [(x.start, x.end, x.text) for x in r.s] for r in df.select("id", spans.find_spans(F.col("t"), rx).alias("s")).collect()}
        assert got == {i: [(m.start(), m.end(), m[0]) for m in re.finditer(rx, t)] for i, t in enumerate(TEXTS)}


def test_explode_spans_is_the_same_for_long_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string")
    got = {(r.id, r.start, r.end, r["match"]) for r in spans.explode_spans(df, ["id"], "t", "[a-z]+").collect()}
    assert got == {(i, m.start(), m.end(), m[0]) for i, t in enumerate(TEXTS) for m in re.finditer("[a-z]+", t)}


def test_mask_keeps_length_and_line_ends(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in df.select("t", spans.mask_matches(F.col("t"), r"[a-z\n]+").alias("m")).collect():
        assert len(r.m) == len(r.t) and r.m.count("\n") == r.t.count("\n") and not re.search("[a-z]", r.m)


def test_merge_ranges(spark):
    df = spark.createDataFrame([(1, 0, 3), (1, 3, 5), (1, 7, 9), (1, 8, 8), (2, 4, 6)], "k int, start int, end int")
    assert sorted(map(tuple, spans.merge_ranges(df, ["k"]).collect())) == [(1, 0, 5), (1, 7, 9), (2, 4, 6)]


def test_lines_and_columns(spark):
    text = "ab\ncd\n\ne"
    df = spark.createDataFrame([(i,) for i in range(-1, len(text) + 1)], "o int").withColumn("t", F.lit(text))
    for r in df.select("o", spans.line_of(F.col("t"), F.col("o")).alias("l"), spans.column_of(F.col("t"), F.col("o")).alias("c")).collect():
        head = text[:max(r.o, 0)]
        assert (r.l, r.c) == (1 + head.count("\n"), len(head) - (head.rfind("\n") + 1))


def test_fix_refusals(spark):
    cases = [("1.5 mm", "15 mm", "number changed"), ("do not go", "do go", "negation changed"), ("don't go", "do not go", None), ("you must go", "you may go", "modal changed"),
             ("prior to use", "before use", None), ("before use", "after use", "ordering changed"), ("whilst on", "while on", None), ("not not", "not", "negation changed"), ("can't", "cannot", None)]
    df = spark.createDataFrame(cases, "a string, b string, want string")
    for r in df.select("*", spans.fix_refusal(F.col("a"), F.col("b")).alias("got")).collect():
        assert r.got == r.want, r


def test_capitals_excerpt_hash(spark):
    df = spark.createDataFrame([("UTILISE", "use"), ("Utilise", "use"), ("utilise", "use")], "a string, b string")
    assert [r[0] for r in df.select(spans.match_capitals(F.col("a"), F.col("b"))).collect()] == ["USE", "Use", "use"]
    long = spark.createDataFrame([("x " * 100,)], "t string").select(spans.excerpt(F.col("t"))).first()[0]
    assert len(long) == 120 and long.endswith("…")


def test_grade_of_empty_is_null(spark):
    assert spark.createDataFrame([("...",)], "t string").select(spans.grade_level(F.col("t"))).first()[0] is None


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab `*#\n[](){}<>!-|.:/_=\"'$%1AZ~>\t", max_size=80))
def test_regions_are_ordered_and_inside(text):
    found = R.protected_regions(text)
    assert all(0 <= a < b <= len(text) for _, a, b in found)
    assert found == sorted(found, key=lambda r: (r[1], r[2]))
    for kind in {k for k, _, _ in found}:
        own = sorted((a, b) for k, a, b in found if k == kind)
        assert all(x[1] <= y[0] for x, y in zip(own, own[1:]))
    masked = R.mask(text, [(a, b) for _, a, b in found])
    assert len(masked) == len(text) and masked.count("\n") == text.count("\n")
