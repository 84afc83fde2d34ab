"""Every registered query with SQL equals DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from glosspan.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def canon(df):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)

    names = sorted(df.columns)
    return names, sorted(tuple(cell(v) for v in r) for r in df[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, sf, duck, name):
    assert canon(catalogue.QUERIES[name](spark, sf).toPandas()) == canon(duck.sql(catalogue.ORACLES[name]).df())


def test_entry_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "rule_findings" in e.queries()


def _table(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_whole_texts_are_hashed(spark, tmp_path):
    rows = [(1, 1, "user", "Please rewrite this: one"), (1, 2, "user", "Please rewrite this: two"), (1, 3, "user", "Please rewrite this: one"), (1, 4, "user", "Please rewrite this: two"),
            (1, 5, "user", "Please rewrite this: three"), (1, 6, "user", None), (2, 1, "assistant", "")]
    at = _table(spark, tmp_path, "conversations", rows, "conv_id long, turn int, role string, text string")
    assert {tuple(r) for r in catalogue.QUERIES["dedup_requests"](spark, at).collect()} == {("user", 6, 4), ("assistant", 1, 1)}
    assert [r.misses for r in catalogue.QUERIES["cache_misses"](spark, at).collect()] == [1]


def test_every_offset_is_located(spark, tmp_path):
    texts = ["a! b!\n\n!!c\nno mark\nd\u00e9 \U0001f600!", "none", "!", "", None, "x\r\n y!\n!", "!"]
    at = _table(spark, tmp_path, "documents", [(min(k, 5), t) for k, t in enumerate(texts)], "doc_id long, text string")
    want = sorted((min(k, 5), i, t[:i].count("\n") + 1, i - (t.rfind("\n", 0, i) + 1)) for k, t in enumerate(texts) for i, c in enumerate(t or "") if c == "!")
    assert sorted((r.doc_id, r["off"], r.line, r["col"]) for r in catalogue.QUERIES["line_columns"](spark, at).collect()) == want
