"""Queries that give operators their input relations straight from the tables: gate, suppression, evaluation, corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate, gate, suppress
from ..operators.analyse import BLOCK, REGION, Analysed
from .registry import query, table


# == fixes


@query("overlapping_fix_conflicts", """
WITH f AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey % 500 AS a, l_partkey % 500 + 20 AS b FROM lineitem)
SELECT DISTINCT x.l_orderkey AS doc_id, 'r' || x.l_linenumber AS rule_id, x.a::INT AS "start" FROM f x JOIN f y
ON x.l_orderkey = y.l_orderkey AND (x.l_linenumber <> y.l_linenumber OR x.a <> y.a) AND x.a < y.b AND y.a < x.b""")
def overlapping_fix_conflicts(spark, sf_dir):
    a = (F.col("l_partkey") % 500).cast("int")
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("r"), F.col("l_linenumber").cast("string")).alias("rule_id"), a.alias("start"), (a + 20).alias("end")).distinct()
    f = f.withColumn("category", F.lit("deterministic-violation")).withColumn("message", F.lit("m")).withColumn(
        "fix", F.struct("start", "end", F.col("rule_id").alias("text"), F.lit(True).alias("safe")))
    kept, _ = gate.resolve_overlaps(f)
    return kept.where("fix IS NULL").select("doc_id", "rule_id", "start")


def _gate_input(spark, sf_dir):
    """One document and finding for each order line, and the facts the gate asks of them."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_discount", "l_returnflag", "l_linestatus")).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    text = F.concat(F.lit("Turn "), F.col("l_partkey").cast("string"))
    after = F.when(F.col("l_partkey") % 2 == 1, F.concat(F.lit("Turn "), (F.col("l_partkey") + 1).cast("string"))).otherwise(text)
    rows = li.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("doc_id"), "l_partkey", "l_discount", "l_returnflag", "l_linestatus", text.alias("text"), after.alias("after"), F.length(text).alias("n"))
    register = F.when(F.col("l_returnflag") == "R", "warning").otherwise("none")
    span = F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("end"), register.alias("admonition")))
    region = F.when(F.col("l_linestatus") == "F", F.array(F.struct(F.lit("identifier").alias("kind"), F.lit(0).alias("start"), F.lit(4).alias("end"), F.lit(True).alias("opaque"), F.lit(False).alias("marker"))))
    documents = rows.select("doc_id", "text", F.col("text").alias("masked"), span.alias("sentences"), span.alias("blocks"), F.coalesce(region, F.array().cast(f"array<{REGION.simpleString()}>")).alias("regions"))
    rule = F.when(F.col("l_partkey") % 4 == 0, "punctuation-constraints").otherwise("unapproved-vocabulary")
    findings = rows.select("doc_id", rule.alias("rule_id"), F.lit("deterministic-violation").alias("category"), F.lit("m").alias("message"), F.lit(0).alias("start"), F.col("n").alias("end"),
                           F.struct(F.lit(0).alias("start"), F.col("n").alias("end"), F.col("after").alias("text"), F.lit(True).alias("safe")).alias("fix"), (F.col("l_discount") > 0.08).alias("off"))
    return findings, Analysed(documents)


@query("fix_gate", """
WITH l AS (SELECT l_orderkey, l_linenumber, min({'p': l_partkey, 'd': l_discount, 'r': l_returnflag, 's': l_linestatus}) AS x FROM lineitem GROUP BY ALL),
f AS (SELECT x.p AS p, x.d > 0.08 AS off, x.r = 'R' AS warned, x.s = 'F' AS touching FROM l)
SELECT coalesce(CASE WHEN off THEN 'automatic fixes are off' WHEN p % 4 = 0 THEN 'the rule does not fix' WHEN warned THEN 'the text is in an admonition' WHEN touching THEN 'the edit touches protected text'
 WHEN p % 2 = 1 THEN 'number changed' END, 'allowed') AS outcome, CASE WHEN warned THEN 'warning' ELSE 'none' END AS admonition, count(*) AS n FROM f GROUP BY ALL""")
def fix_gate(spark, sf_dir):
    findings, a = _gate_input(spark, sf_dir)
    out = gate.gate_fixes(findings.where("off"), a, autofix=False).unionByName(gate.gate_fixes(findings.where("NOT off"), a))
    return out.groupBy(F.coalesce("refusal", F.lit("allowed")).alias("outcome"), "admonition").agg(F.count("*").alias("n"))


# == suppression

_DIRECTIVES_SQL = """d AS (SELECT l_orderkey AS doc, l_linenumber * 100 AS pos, CASE WHEN l_linenumber % 2 = 1 THEN 'disable' ELSE 'enable' END AS key FROM lineitem GROUP BY ALL),
p AS (SELECT doc, pos, key, lead(pos) OVER (PARTITION BY doc ORDER BY pos) AS nxt FROM d),
r AS (SELECT doc, pos AS d_start, pos + 9 AS claim_start, coalesce(nxt, 1000) AS claim_end FROM p WHERE key = 'disable'),
f AS (SELECT DISTINCT l_orderkey AS doc, (l_partkey % 900)::INT AS start, l_returnflag = 'R' AS guarded FROM lineitem),
h AS (SELECT f.doc, f.start, f.guarded, min(r.d_start) AS d_start FROM f JOIN r ON f.doc = r.doc AND f.start >= r.claim_start AND f.start < r.claim_end GROUP BY ALL)"""


def _suppressed(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    at = (F.col("l_linenumber") * 100).cast("int")
    keyword = F.when(F.col("l_linenumber") % 2 == 1, "disable").otherwise("enable")
    directives = li.select(F.col("l_orderkey").alias("doc_id"), at.alias("start"), (at + 9).alias("end"), keyword.alias("keyword")).distinct().withColumn("rule_ids", F.array().cast("array<string>")).withColumn("reason", F.lit("x"))
    claimed, notices = suppress.pair_ranges(directives, li.select(F.col("l_orderkey").alias("doc_id"), F.lit(" " * 1000).alias("text")).distinct())
    start = (F.col("l_partkey") % 900).cast("int")
    rows = li.select(F.col("l_orderkey").alias("doc_id"), F.lit("r").alias("rule_id"), F.lit("c").alias("category"), start.alias("start"), (start + 1).alias("end"),
                     F.when(F.col("l_returnflag") == "R", "warning").otherwise("none").alias("admonition")).distinct()
    return rows, claimed, notices, suppress.apply_suppressions(rows, claimed, directives)


@query("suppression_claims", f"WITH {_DIRECTIVES_SQL} SELECT doc AS doc_id, \"start\", d_start::INT AS d_start FROM h WHERE NOT guarded")
def suppression_claims(spark, sf_dir):
    """What directives withhold, outside guarded admonitions."""
    return _suppressed(spark, sf_dir)[3][1].select("doc_id", "start", "d_start")


@query("suppression_notices", f"""WITH {_DIRECTIVES_SQL}
SELECT 'suppression-unused' AS code, count(*) AS n FROM r WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc = r.doc AND h.d_start = r.d_start)
UNION ALL SELECT 'suppression-refused-in-admonition', count(*) FROM h WHERE guarded
UNION ALL SELECT 'suppressions-applied', count(DISTINCT doc) FROM h WHERE NOT guarded
UNION ALL SELECT 'suppression-unclosed-range', count(*) FROM p WHERE key = 'disable' AND nxt IS NULL
UNION ALL SELECT 'suppression-end-without-start', count(*) FROM (SELECT key, lag(key) OVER (PARTITION BY doc ORDER BY pos) AS prev FROM d) WHERE key = 'enable' AND (prev IS NULL OR prev = 'enable')""")
def suppression_notices(spark, sf_dir):
    _, _, pairing, (_, _, applied) = _suppressed(spark, sf_dir)
    return pairing.select("code").unionByName(applied.select("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("next_block_claim", """
WITH d AS (SELECT DISTINCT l_orderkey AS doc, (l_partkey % 800)::INT AS pos FROM lineitem WHERE l_linenumber = 1),
b AS (SELECT l_orderkey AS doc, (l_suppkey * l_linenumber % 1000)::INT AS b_end, (l_suppkey * l_linenumber % 1000 - l_quantity)::INT AS b_start FROM lineitem),
k AS (SELECT d.doc, d.pos, b.b_end, b.b_start, row_number() OVER (PARTITION BY d.doc, d.pos ORDER BY b.b_end, b.b_start DESC) AS n FROM d JOIN b ON d.doc = b.doc AND b.b_end > d.pos + 5)
SELECT doc AS doc_id, pos AS d_start, greatest(pos + 5, b_start)::INT AS claim_start, b_end AS claim_end FROM k WHERE n = 1""")
def next_block_claim(spark, sf_dir):
    """The block that a disable-next-line claims: the first to end after it, the narrower at a tie."""
    li = table(spark, sf_dir, "lineitem").withColumn("doc_id", F.col("l_orderkey"))
    at = (F.col("l_partkey") % 800).cast("int")
    directives = li.where("l_linenumber = 1").select("doc_id", at.alias("start"), (at + 5).alias("end"), F.lit("disable-next-line").alias("keyword"),
                                                     F.array().cast("array<string>").alias("rule_ids"), F.lit("x").alias("reason")).distinct()
    end = F.col("l_suppkey") * F.col("l_linenumber") % 1000
    values = {"start": (end - F.col("l_quantity")).cast("int"), "end": end.cast("int"), "in_list": F.lit(False)}
    block = F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in BLOCK])
    documents = li.groupBy("doc_id").agg(F.collect_list(block).alias("blocks")).withColumn("masked", F.lit(" " * 2000))
    return suppress.next_block_claims(directives, Analysed(documents)).select("doc_id", "d_start", "claim_start", "claim_end")


# == evaluation and corpus


@query("latency_percentiles", """
SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.99) AS p99, round(avg(value), 6) AS mean FROM events GROUP BY event_type
UNION ALL SELECT 'overall', quantile_disc(value, 0.5), quantile_disc(value, 0.9), quantile_disc(value, 0.99), round(avg(value), 6) FROM events""")
def latency_percentiles(spark, sf_dir):
    cases = table(spark, sf_dir, "events").select("event_type", F.lit("unlabelled").alias("gold"), F.lit("uncertain").alias("predicted"), F.col("value").alias("latency_ms"), F.lit(False).alias("cached"))
    m = evaluate.metrics(cases, "event_type")
    return m.select(F.coalesce("event_type", F.lit("overall")).alias("event_type"), F.col("latency_p50").alias("p50"), F.col("latency_p90").alias("p90"), F.col("latency_p99").alias("p99"), F.round("latency_mean", 6).alias("mean"))


def _manifest(spark, sf_dir) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    digest = F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat(text, F.lit("?"))).otherwise(text), 256)
    manifest = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("category"), F.when(F.col("doc_id") % 5 == 0, "heldout").otherwise("dev").alias("split"), text.alias("original"),
                                                        text.alias("rewritten"), digest.alias("original_sha256"), F.when(F.col("doc_id") % 9 == 0, "unknown").otherwise("MIT").alias("licence"), F.col("doc_id").alias("provenance_key"))
    return evaluate.corpus_problems(manifest, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key")))


@query("corpus_constraints", """
SELECT * FROM (SELECT 'length' AS "check", count(*) AS n FROM documents WHERE length(coalesce(text, '')) < 300 OR length(coalesce(text, '')) > 2400
UNION ALL SELECT 'duplicate-id', count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'digest', count(*) FROM documents WHERE doc_id % 7 = 0
UNION ALL SELECT 'licence', count(*) FROM documents WHERE doc_id % 9 = 0
UNION ALL SELECT 'category-size', count(*) FROM (SELECT source FROM documents GROUP BY source HAVING count(*) < 2)
UNION ALL SELECT 'provenance', count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
UNION ALL SELECT 'split-leak', count(*) FROM (SELECT 1 FROM documents GROUP BY sha256(coalesce(text, '')) HAVING count(DISTINCT doc_id % 5 = 0) > 1)
UNION ALL SELECT 'corpus-size', count(*) FROM (SELECT count(*) AS c FROM documents) WHERE c < 15
UNION ALL SELECT 'heldout-share', count(*) FROM (SELECT avg((doc_id % 5 = 0)::INT) AS r FROM documents) WHERE r < 0.25) WHERE n > 0""")
def corpus_constraints(spark, sf_dir):
    return _manifest(spark, sf_dir).groupBy("check").agg(F.count("*").alias("n"))


@query("cross_split_leakage", "SELECT sha256(coalesce(text, '')) AS digest FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 5 = 0) > 1")
def cross_split_leakage(spark, sf_dir):
    return _manifest(spark, sf_dir).where(F.col("check") == "split-leak").select(F.col("key").alias("digest"))
