"""Registered queries over the driver's tables, each with its DuckDB counterpart.

Where the prose of the tables has nothing for an operator to find, the query derives text from other columns, the
same way on both sides.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import spans, vocab
from ..functions.shared import spread_rows
from ..operators import adjudicate, evaluate, gate
from ..operators.analyse import analyse_documents
from ..operators.rules import RuleConfig
from . import manuals, relations  # noqa: F401  their queries register themselves
from .pipeline import lint
from .registry import ORACLES, QUERIES, query
from .registry import table as _t

# == tokens, offsets, blocks


@query("line_columns", """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE contains(text, '!')),
l AS (SELECT k, doc_id, unnest(ls) AS s, generate_subscripts(ls, 1) AS line FROM d),
p AS (SELECT *, sum(length(s) + 1) OVER (PARTITION BY k ORDER BY line) - length(s) - 1 AS start FROM l),
g AS (SELECT k, doc_id, line, start, len(string_split(s, '!')) AS n, unnest(string_split(s, '!')) AS gap, generate_subscripts(string_split(s, '!'), 1) AS i FROM p WHERE contains(s, '!')),
h AS (SELECT *, sum(length(gap) + 1) OVER (PARTITION BY k, line ORDER BY i) - 1 AS col FROM g)
SELECT doc_id, (start + col)::INT AS off, line::INT AS line, col::INT AS col FROM h WHERE i < n""")
def line_columns(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").where(F.col("text").contains("!")).withColumn("k", F.monotonically_increasing_id())
    d = d.withColumn("n", F.size(F.split("text", "!", -1)))  # before the explode, else the text is split again for each row
    gaps = d.select("k", "doc_id", "n", F.posexplode(F.split("text", "!", -1)).alias("i", "gap"))
    sizes = gaps.select("k", "doc_id", "n", "i", F.length("gap").alias("size"), (F.length("gap") - F.length(F.replace("gap", F.lit("\n"), F.lit("")))).alias("breaks"),
                        F.when(F.col("gap").contains("\n"), F.length(F.substring_index("gap", "\n", -1))).alias("tail"))  # lengths are shuffled, not the text
    upto = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    at = sizes.withColumn("off", F.sum(F.col("size") + 1).over(upto) - 1).withColumn("line", F.sum("breaks").over(upto) + 1)
    at = at.withColumn("begin", F.coalesce(F.max(F.col("off") - F.col("tail")).over(upto), F.lit(0))).where(F.col("i") < F.col("n") - 1)
    return at.select("doc_id", F.col("off").cast("int").alias("off"), F.col("line").cast("int").alias("line"), (F.col("off") - F.col("begin")).cast("int").alias("col"))


@query("content_hashes", "SELECT doc_id, sha256(coalesce(lang, '') || chr(31) || coalesce(text, '') || chr(31)) AS hash FROM documents")
def content_hashes(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", spans.content_hash(F.coalesce("lang", F.lit("")), F.coalesce("text", F.lit(""))).alias("hash"))


# == masks and regions

_HOST = "[0-9A-Za-z-]+"
_EMAIL = "[0-9A-Za-z._%+-]+@" + _HOST + r"(?:\." + _HOST + ")+"
_HEX = r"[0-9a-f]{32,}"


def _mask_sql(rx: str) -> str:
    return f"""
WITH d AS (SELECT doc_id, text, string_split_regex(text, '{rx}') AS gaps, regexp_extract_all(text, '{rx}') AS hits FROM documents WHERE regexp_matches(text, '{rx}'))
SELECT doc_id, len(hits)::INT AS n_regions, sha256(list_aggregate(list_transform(generate_series(1, len(gaps)),
  lambda i: gaps[i] || coalesce(repeat(chr(65533), length(hits[i])), '')), 'string_agg', '')) AS digest FROM d"""


def _masked(spark, sf_dir, rx):
    d = _t(spark, sf_dir, "documents").where(F.col("text").rlike(rx))
    return d.select("doc_id", F.regexp_count("text", F.lit(rx)).alias("n_regions"), F.sha2(spans.mask_matches(F.col("text"), rx), 256).alias("digest"))


@query("mask_emails", _mask_sql(_EMAIL))
def mask_emails(spark, sf_dir):
    return _masked(spark, sf_dir, _EMAIL)


@query("mask_credentials", _mask_sql(_HEX))
def mask_credentials(spark, sf_dir):
    return _masked(spark, sf_dir, _HEX)


@query("merged_ranges", """
WITH r AS (SELECT l_orderkey, l_partkey % 200 AS a, l_partkey % 200 + l_quantity::INT AS b FROM lineitem),
m AS (SELECT l_orderkey, a, b, CASE WHEN coalesce(max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) < a THEN 1 ELSE 0 END AS new FROM r),
g AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT l_orderkey, min(a)::BIGINT AS start, max(b)::BIGINT AS "end" FROM g GROUP BY l_orderkey, island""")
def merged_ranges(spark, sf_dir):
    a = F.col("l_partkey") % 200
    r = _t(spark, sf_dir, "lineitem").select("l_orderkey", a.alias("start"), (a + F.col("l_quantity").cast("int")).alias("end"))
    return spans.merge_ranges(r, ["l_orderkey"])


# == rules over prose

_PLAIN_SENT = r"[^.!?\n]+[.!?]?"
_SYL = ("list_aggregate(list_transform(regexp_extract_all(s, '[A-Za-z]+'), lambda w: greatest(1, len(regexp_extract_all(lower(w), '[aeiouy]+')) - "
        "CASE WHEN regexp_matches(lower(w), '[^aeiouyl]e$') AND len(regexp_extract_all(lower(w), '[aeiouy]+')) > 1 THEN 1 ELSE 0 END)), 'sum')")


@query("reading_grade_violations", f"""
WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?\\n]+[.!?]?')) AS s FROM documents),
g AS (SELECT doc_id, len(regexp_extract_all(s, '[A-Za-z]+')) AS n, {_SYL} AS syl FROM s WHERE len(regexp_extract_all(s, '[A-Za-z]+')) >= 20)
SELECT doc_id, count(*) AS n_long, round(max(0.39::DOUBLE * n + 11.8::DOUBLE * syl / n - 15.59::DOUBLE), 6) AS worst
FROM g WHERE 0.39::DOUBLE * n + 11.8::DOUBLE * syl / n - 15.59::DOUBLE > 8 GROUP BY doc_id""")
def reading_grade_violations(spark, sf_dir):
    s = _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_PLAIN_SENT), F.lit(0))).alias("s"))
    s = s.where(F.regexp_count("s", F.lit("[A-Za-z]+")) >= vocab.LIMITS["sentenceReadabilityFloorWords"]).select("doc_id", spans.grade_level(F.col("s")).alias("grade"))
    return s.where(F.col("grade") > vocab.LIMITS["descriptiveMaxGradeLevel"]).groupBy("doc_id").agg(F.count("*").alias("n_long"), F.round(F.max("grade"), 6).alias("worst"))


# == fixes


@query("fix_safety_refusals", """
WITH f AS (SELECT p_partkey, 'Turn it ' || p_size || ' times, do not stop before ' || p_retailprice::INT AS a,
 CASE p_partkey % 5 WHEN 0 THEN 'Turn it ' || p_size || ' times, do stop before ' || p_retailprice::INT WHEN 1 THEN 'Turn it ' || (p_size + 1) || ' times, do not stop before ' || p_retailprice::INT
  WHEN 2 THEN 'Turn it ' || p_size || ' times, do not stop after ' || p_retailprice::INT WHEN 3 THEN 'You must turn it ' || p_size || ' times, do not stop before ' || p_retailprice::INT
  ELSE 'Turn it ' || p_size || ' times, don''t stop prior to ' || p_retailprice::INT END AS b FROM part),
r AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'negation changed' WHEN 1 THEN 'number changed' WHEN 2 THEN 'ordering changed' WHEN 3 THEN 'modal changed' END AS refusal FROM f)
SELECT coalesce(refusal, 'none') AS refusal, count(*) AS n FROM r GROUP BY 1""")
def fix_safety_refusals(spark, sf_dir):
    size, price = F.col("p_size").cast("string"), F.round("p_retailprice").cast("int").cast("string")
    line = lambda a, n, b: F.concat(F.lit(a), n, F.lit(b), price)
    k = F.col("p_partkey") % 5
    before = line("Turn it ", size, " times, do not stop before ")
    after = (F.when(k == 0, line("Turn it ", size, " times, do stop before ")).when(k == 1, line("Turn it ", (F.col("p_size") + 1).cast("string"), " times, do not stop before "))
             .when(k == 2, line("Turn it ", size, " times, do not stop after ")).when(k == 3, line("You must turn it ", size, " times, do not stop before "))
             .otherwise(line("Turn it ", size, " times, don't stop prior to ")))
    parts = spread_rows(_t(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey")
    return parts.select(F.coalesce(spans.fix_refusal(before, after), F.lit("none")).alias("refusal")).groupBy("refusal").agg(F.count("*").alias("n"))


@query("capital_transfer", """
SELECT n_name, CASE WHEN n_nationkey % 3 = 0 THEN 'USE' WHEN n_nationkey % 3 = 1 THEN 'Use' ELSE 'use' END AS replaced FROM nation""")
def capital_transfer(spark, sf_dir):
    source = F.when(F.col("n_nationkey") % 3 == 0, "UTILISE").when(F.col("n_nationkey") % 3 == 1, "Utilise").otherwise("utilise")
    return _t(spark, sf_dir, "nation").select("n_name", spans.match_capitals(source, F.lit("use")).alias("replaced"))


# == suppression

# == adjudication


@query("dedup_requests", """
WITH q AS (SELECT role, sha256(coalesce(role, '') || chr(31) || coalesce(text, '') || chr(31)) AS hash FROM conversations)
SELECT role, count(*) AS n, count(DISTINCT hash) AS n_distinct FROM q GROUP BY role""")
def dedup_requests(spark, sf_dir):
    """Requests that differ anywhere are different."""
    h = spans.content_hash(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    per = _t(spark, sf_dir, "conversations").select("role", h.alias("hash")).groupBy("role", "hash").agg(F.count("*").alias("c"))
    return per.groupBy("role").agg(F.sum("c").alias("n"), F.count("*").alias("n_distinct"))


@query("cache_misses", """
WITH q AS (SELECT DISTINCT sha256(coalesce(text, '') || chr(31)) AS hash, turn >= 4 AS late FROM conversations)
SELECT count(*) AS misses FROM (SELECT hash FROM q WHERE late) l WHERE NOT EXISTS (SELECT 1 FROM q e WHERE NOT e.late AND e.hash = l.hash)""")
def cache_misses(spark, sf_dir):
    q = _t(spark, sf_dir, "conversations").select(spans.content_hash(F.coalesce("text", F.lit(""))).alias("hash"), (F.col("turn") >= 4).alias("late")).distinct()
    _, misses = adjudicate.with_cache(q.where("late"), q.where("NOT late").select("hash", F.lit("").alias("reply")))
    return misses.agg(F.count("*").alias("misses"))


_VERDICT_SQL = "v AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'violation' WHEN quality = 1 THEN 'compliant' ELSE 'uncertain' END AS status, (doc_id % 100) / 100.0::DOUBLE AS confidence, CASE WHEN doc_id % 17 = 0 THEN 'transport' END AS failure FROM labels)"


def _verdicts(spark, sf_dir):
    return _t(spark, sf_dir, "labels").select("doc_id", "toxic", "quality", F.when(F.col("toxic") == 1, "violation").when(F.col("quality") == 1, "compliant").otherwise("uncertain").alias("status"),
                                              ((F.col("doc_id") % 100) / F.lit(100.0)).alias("confidence"), F.when(F.col("doc_id") % 17 == 0, "transport").alias("failure"))


@query("verdict_policy", f"""
WITH {_VERDICT_SQL}
SELECT coalesce(CASE WHEN failure IS NOT NULL THEN 'review-required' WHEN status = 'compliant' AND confidence >= 0.7::DOUBLE THEN NULL WHEN status = 'compliant' THEN 'review-required' WHEN status = 'uncertain' THEN 'review-required'
 WHEN confidence >= 0.7::DOUBLE THEN 'probable-violation' END, 'none') AS category, count(*) AS n FROM v GROUP BY 1""")
def verdict_policy(spark, sf_dir):
    v = _verdicts(spark, sf_dir)
    c = F.when(F.col("failure").isNotNull(), "review-required").otherwise(adjudicate.verdict_category(F.col("status"), F.col("confidence")))
    return v.groupBy(F.coalesce(c, F.lit("none")).alias("category")).agg(F.count("*").alias("n"))


# == evaluation


@query("gold_labels", """
WITH r AS (SELECT l_orderkey AS doc, l_linenumber AS id, (l_partkey % 300)::INT AS a, CASE WHEN l_discount > 0.07 THEN NULL WHEN l_tax > 0.04 THEN 'violation' ELSE 'non-violation' END AS label FROM lineitem),
c AS (SELECT o_orderkey AS doc, (o_custkey % 250)::INT AS a FROM orders),
g AS (SELECT c.doc, count(DISTINCT coalesce(label, '?')) AS n, min(label) AS label, count(*) FILTER (label IS NULL) AS open FROM c JOIN r ON c.doc = r.doc AND c.a < r.a + 60 AND r.a < c.a + 60 GROUP BY c.doc)
SELECT CASE WHEN n = 1 AND open = 0 THEN label ELSE 'unlabelled' END AS gold, count(*) AS n_docs FROM g GROUP BY 1""")
def gold_labels(spark, sf_dir):
    verdict = F.when(F.col("l_discount") > 0.07, "undecidable").when(F.col("l_tax") > 0.04, "violation").otherwise("non-violation")
    a = (F.col("l_partkey") % 300).cast("int")
    r = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit("r").alias("rule_id"), a.alias("r_start"), (a + 60).alias("r_end"), verdict.alias("verdict"))
    c = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("r").alias("rule_id"), F.lit("c").alias("id"), (F.col("o_custkey") % 250).cast("int").alias("start")).withColumn("end", F.col("start") + 60)
    gold = evaluate.gold_labels(c, r).where("size(labels) > 0").dropDuplicates(["doc_id", "id"])  # candidates that no record overlaps are not counted
    return gold.groupBy("gold").agg(F.count("*").alias("n_docs"))


def _cases(spark, sf_dir):
    v = _verdicts(spark, sf_dir)
    return v.select(F.concat(F.lit("e"), (F.col("doc_id") % 3).cast("string")).alias("evaluator"), F.when(F.col("doc_id") % 11 == 0, "unlabelled").when(F.col("quality") == 0, "violation").otherwise("non-violation").alias("gold"),
                    evaluate.prediction(F.col("status"), F.col("confidence"), F.col("failure")).alias("predicted"), ((F.col("doc_id") * 37 % 1000) / F.lit(4.0)).alias("latency_ms"), (F.col("doc_id") % 13 == 0).alias("cached"))


_CASES_SQL = f"""{_VERDICT_SQL},
c AS (SELECT 'e' || (v.doc_id % 3) AS evaluator, CASE WHEN v.doc_id % 11 = 0 THEN 'unlabelled' WHEN quality = 0 THEN 'violation' ELSE 'non-violation' END AS gold,
 CASE WHEN failure IS NOT NULL THEN 'failure' WHEN status = 'uncertain' THEN 'uncertain' WHEN status = 'violation' AND confidence >= 0.7::DOUBLE THEN 'violation' ELSE 'non-violation' END AS predicted,
 (v.doc_id * 37 % 1000) / 4.0::DOUBLE AS latency_ms, v.doc_id % 13 = 0 AS cached FROM v JOIN labels USING (doc_id))"""


@query("confusion_matrix", f"WITH {_CASES_SQL} SELECT gold, predicted, count(*) AS n FROM c GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    return _cases(spark, sf_dir).groupBy("gold", "predicted").agg(F.count("*").alias("n"))


@query("metrics_rollup", f"""
WITH {_CASES_SQL},
m AS (SELECT evaluator, count(*) AS cases, count(*) FILTER (gold <> 'unlabelled') AS labelled, count(*) FILTER (gold = 'violation') AS positives,
 count(*) FILTER (gold = 'violation' AND predicted = 'violation') AS tp, count(*) FILTER (gold = 'non-violation' AND predicted = 'violation') AS fp,
 count(*) FILTER (gold = 'violation' AND predicted = 'non-violation') AS fn, count(*) FILTER (gold = 'non-violation' AND predicted = 'non-violation') AS tn,
 count(*) FILTER (predicted = 'uncertain') AS u, count(*) FILTER (predicted = 'failure') AS f,
 quantile_disc(latency_ms, 0.9) FILTER (NOT cached) AS p90, avg(latency_ms) FILTER (NOT cached) AS mean FROM c GROUP BY ROLLUP (evaluator)),
r AS (SELECT *, tp::DOUBLE / nullif(tp + fp, 0) AS p, CASE WHEN positives >= 10 THEN tp::DOUBLE / nullif(tp + fn, 0) END AS q FROM m)
SELECT coalesce(evaluator, 'overall') AS evaluator, cases, labelled, positives, tp, fp, fn, tn, round(p, 9) AS "precision", round(q, 9) AS recall, round(2 * p * q / nullif(p + q, 0), 9) AS f1,
 round(u::DOUBLE / cases, 9) AS uncertain_rate, round(f::DOUBLE / cases, 9) AS failure_rate, p90 AS latency_p90, round(mean, 6) AS latency_mean FROM r""")
def metrics_rollup(spark, sf_dir):
    m = evaluate.metrics(_cases(spark, sf_dir))
    rounded = [F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "uncertain_rate", "failure_rate")]
    return m.select(F.coalesce("evaluator", F.lit("overall")).alias("evaluator"), "cases", "labelled", "positives", "tp", "fp", "fn", "tn", *rounded, "latency_p90", F.round("latency_mean", 6).alias("latency_mean"))


# == corpus


@query("verdict_drift", """
WITH a AS (SELECT DISTINCT doc_id AS k FROM labels WHERE quality = 1), b AS (SELECT DISTINCT doc_id AS k FROM labels WHERE toxic = 1 OR doc_id % 5 = 0)
SELECT CASE WHEN a.k IS NULL THEN 'unmatched' WHEN b.k IS NULL THEN 'missing' ELSE 'merged' END AS state, count(*) AS n FROM a FULL OUTER JOIN b ON a.k = b.k GROUP BY 1""")
def verdict_drift(spark, sf_dir):
    l = _t(spark, sf_dir, "labels")
    packets = l.where("quality = 1").select("doc_id", F.lit("r").alias("rule_id"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("q").alias("quote")).distinct()
    verdicts = l.where("toxic = 1 OR doc_id % 5 = 0").select("doc_id", F.lit("r").alias("rule_id"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("q").alias("quote"), F.lit("a").alias("reviewer"), F.lit("violation").alias("verdict")).distinct()
    return evaluate.merge_verdicts(packets, verdicts).groupBy("state").agg(F.count("*").alias("n"))


@query("severity_summary", """
WITH f AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'deterministic-violation' WHEN l_returnflag = 'A' THEN 'probable-violation' ELSE 'review-required' END AS category, l_shipdate >= TIMESTAMP '1996-01-01' AS late FROM lineitem),
s AS (SELECT CASE category WHEN 'deterministic-violation' THEN 'error' WHEN 'probable-violation' THEN 'warning' ELSE 'info' END AS severity FROM f WHERE late)
SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos, count(*) AS total, CASE WHEN count(*) FILTER (severity = 'error') > 0 THEN 1 ELSE 0 END AS exit_code FROM s""")
def severity_summary(spark, sf_dir):
    f = _t(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp")).select(
        F.lit("r").alias("rule_id"), F.when(F.col("l_returnflag") == "R", "deterministic-violation").when(F.col("l_returnflag") == "A", "probable-violation").otherwise("review-required").alias("category"))
    return gate.totals(gate.with_severity(f))


@query("applied_fixes", "SELECT p_partkey AS doc_id, 'Use ' || p_name || ' now and then, before noon.' AS fixed, 3 AS n_fixes FROM part")
def applied_fixes(spark, sf_dir):
    text = F.concat(F.lit("Utilise "), "p_name", F.lit(" now and and then, prior to noon."))
    d = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text"), F.length("p_name").alias("n"))
    fix = lambda lo, hi, t: F.struct(lo.cast("int").alias("start"), hi.cast("int").alias("end"), F.lit(t).alias("text"), F.lit(True).alias("safe"))
    at = F.col("n") + 8
    edits = d.withColumn("fix", F.explode(F.array(fix(F.lit(0), F.lit(7), "Use"), fix(at + 8, at + 12, ""), fix(at + 19, at + 27, "before"))))
    return gate.apply_fixes(edits, d)


@query("canonical_digests", """SELECT n_nationkey, sha256('{"key":"' || n_nationkey || '","name":"' || n_name || '","region":"' || n_regionkey || '"}') AS digest FROM nation""")
def canonical_digests(spark, sf_dir):
    unsorted = F.create_map(F.lit("region"), F.col("n_regionkey").cast("string"), F.lit("name"), F.col("n_name"), F.lit("key"), F.col("n_nationkey").cast("string"))
    return _t(spark, sf_dir, "nation").select("n_nationkey", evaluate.canonical_digest(unsorted).alias("digest"))


@query("reading_ease", f"""
WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?\\n]+[.!?]?')) AS s FROM documents),
g AS (SELECT doc_id, len(regexp_extract_all(s, '[A-Za-z]+')) AS n, {_SYL} AS syl FROM s WHERE len(regexp_extract_all(s, '[A-Za-z]+')) > 0)
SELECT doc_id, count(*) AS n_sentences, round(avg(206.835::DOUBLE - 1.015::DOUBLE * n - 84.6::DOUBLE * syl / n), 4) AS ease FROM g GROUP BY doc_id""")
def reading_ease(spark, sf_dir):
    s = _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_PLAIN_SENT), F.lit(0))).alias("s"))
    e = s.select("doc_id", spans.reading_ease(F.col("s")).alias("e")).where("e IS NOT NULL")
    return e.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.round(F.avg("e"), 4).alias("ease"))


@query("protected_literals", """
WITH p AS (SELECT p_partkey, 'Set `' || p_brand || '` to ' || p_size || ' mm, see https://a.example/' || p_partkey || ' now.' AS text FROM part)
SELECT p_partkey AS doc_id, unnest(['`' || regexp_extract(text, '`([^`]*)`', 1) || '`', regexp_extract(text, '[0-9]+ mm'), regexp_extract(text, 'https://[^ ]+')]) AS literal FROM p""")
def protected_literals(spark, sf_dir):
    text = F.concat(F.lit("Set `"), "p_brand", F.lit("` to "), F.col("p_size").cast("string"), F.lit(" mm, see https://a.example/"), F.col("p_partkey").cast("string"), F.lit(" now."))
    return evaluate.protected_literals(analyse_documents(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text")), parts=("regions",)))


# == the whole analysis: rows only


@query("rule_findings")
def rule_findings(spark, sf_dir):
    """Findings per rule and category over all documents, as plain text."""
    r = lint(_t(spark, sf_dir, "documents").select("doc_id", "text"), {"format": "text", "ordered": False})
    return r.findings.groupBy("rule_id", "category", "severity").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


__all__ = ["ORACLES", "QUERIES", "RuleConfig"]
