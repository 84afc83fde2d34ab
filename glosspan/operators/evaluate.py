"""Evaluation of verdicts against reviewers' labels, and checks of an annotated corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import by_key, pieces

LEAST_POSITIVES = 10


def gold_labels(candidates: DataFrame, records: DataFrame) -> DataFrame:
    """Candidates with ``labels``, what the overlapping records of the same rule say, and ``gold``: they must agree, else unlabelled.

    A document's records meet its candidates as one array: each side is shuffled once, and no pair is made a row.

    ``records`` has doc_id, rule_id, r_start, r_end, verdict (violation, non-violation, accepted, disputed, ...).
    """
    label = F.when(F.col("verdict").isin("violation", "accepted"), "violation").when(F.col("verdict").isin("non-violation", "disputed"), "non-violation").otherwise("?")
    n = pieces(records, candidates)
    own = records.where("doc_id IS NOT NULL").select("doc_id", F.struct("rule_id", "r_start", "r_end", label.alias("label")).alias("r")).repartition(n, "doc_id")
    met = candidates.repartition(n, "doc_id").join(by_key(own.groupBy("doc_id").agg(F.collect_list("r").alias("_r"))), "doc_id", "left")
    hits = F.filter("_r", lambda r: (r["rule_id"] == F.col("rule_id")) & (F.col("start") < r["r_end"]) & (r["r_start"] < F.col("end")))
    labels = F.coalesce(F.array_distinct(F.transform(hits, lambda r: r["label"])), F.array().cast("array<string>"))
    same = Window.partitionBy("doc_id", "id")
    met = met.withColumn("labels", labels).drop("_r").withColumn("labels", F.array_distinct(F.flatten(F.collect_list("labels").over(same))))
    sure = (F.size("labels") == 1) & (F.get("labels", F.lit(0)) != "?")
    return met.withColumn("gold", F.when(sure, F.get("labels", F.lit(0))).otherwise("unlabelled"))


def prediction(status: Column, confidence: Column, failure: Column, threshold: float = 0.7) -> Column:
    """A violation below the threshold predicts non-violation; compliant is not thresholded here."""
    return (F.when(failure.isNotNull(), "failure").when(status == "uncertain", "uncertain")
            .when((status == "violation") & (confidence >= threshold), "violation").otherwise("non-violation"))


def split_cases(cases: DataFrame, split: str) -> DataFrame:
    """The cases of a split, or all; an empty split is an error and not a perfect score."""
    chosen = cases if split == "all" else cases.where(F.col("split") == split)
    if not chosen.head(1):
        raise ValueError(f"no cases in split {split!r}")
    return chosen


def metrics(cases: DataFrame, by: str = "evaluator") -> DataFrame:
    """Per evaluator and overall (null): confusion counts, precision, recall, F1, rates and latency percentiles.

    Ratios without a denominator are null, and F1 where precision or recall is or both are 0; recall and F1 are withheld below ten positives; latencies of cached
    answers do not count and are 0 where there are none.  ``cases`` has gold, predicted, latency_ms, cached.
    """
    lab, pos = F.col("gold") != "unlabelled", F.col("gold") == "violation"
    said = F.col("predicted") == "violation"
    sure = F.col("predicted").isin("violation", "non-violation")
    fresh = F.when(~F.coalesce("cached", F.lit(False)), F.col("latency_ms"))
    pct = lambda q: F.coalesce(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY CASE WHEN NOT coalesce(cached, false) THEN latency_ms END)"), F.lit(0.0))
    out = cases.rollup(by).agg(
        F.count("*").alias("cases"), F.count_if(lab).alias("labelled"), F.count_if(pos).alias("positives"), F.count_if(lab & pos & said).alias("tp"),
        F.count_if(lab & ~pos & said).alias("fp"), F.count_if(lab & pos & sure & ~said).alias("fn"), F.count_if(lab & ~pos & sure & ~said).alias("tn"),
        F.count_if(F.col("predicted") == "uncertain").alias("uncertain"), F.count_if(F.col("predicted") == "failure").alias("failures"),
        F.coalesce(F.avg(fresh), F.lit(0.0)).alias("latency_mean"), pct(0.5).alias("latency_p50"), pct(0.9).alias("latency_p90"), pct(0.99).alias("latency_p99"))
    ratio = lambda a, b: F.try_divide(F.col(a), b)
    enough = F.col("positives") >= LEAST_POSITIVES
    return (out.withColumn("precision", ratio("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.when(enough, ratio("tp", F.col("tp") + F.col("fn"))))
            .withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
            .withColumn("uncertain_rate", ratio("uncertain", F.col("cases"))).withColumn("failure_rate", ratio("failures", F.col("cases"))))


def report_lines(scores: DataFrame) -> DataFrame:
    """The metrics as text lines."""
    show = lambda c: F.coalesce(F.format_string("%.3f", c), F.lit("n/a"))
    return scores.select(F.concat_ws("  ", F.coalesce("evaluator", F.lit("overall")), F.format_string("cases=%d labelled=%d", "cases", "labelled"),
                                     F.concat(F.lit("precision="), F.when(F.col("precision").isNotNull(), show("precision")).otherwise("n/a")),
                                     F.concat(F.lit("recall="), F.when(F.col("recall").isNotNull(), show("recall")).otherwise("n/a"))).alias("line"))


# == corpus

LITERAL_KINDS = ("inline-code", "math", "autolink", "url", "email", "credential", "approved-term", "identifier", "placeholder", "file-path", "config-fragment",
                 "numeric-expression", "quoted-literal", "constant", "fenced-code", "indented-code", "shell-command", "reference-definition", "link-destination")


def protected_literals(a) -> DataFrame:
    """(doc_id, literal): distinct trimmed protected literals of at least two characters."""
    r = a.documents.select("doc_id", "text", F.explode("regions").alias("r")).where(F.col("r.kind").isin(list(LITERAL_KINDS)))
    lit = F.trim(F.expr("substring(text, r.start + 1, r.end - r.start)"))
    return r.select("doc_id", lit.alias("literal")).where(F.length("literal") >= 2).distinct()


def missing_literals(literals: DataFrame, rewrites: DataFrame) -> DataFrame:
    """Literals of an original that its rewrite (doc_id, rewritten) does not contain."""
    return literals.join(rewrites, "doc_id").where(~F.col("rewritten").contains(F.col("literal"))).select("doc_id", "literal")


def corpus_problems(manifest: DataFrame, provenance: DataFrame) -> DataFrame:
    """(check, key) of each broken constraint of a corpus manifest.

    ``manifest`` has id, category, split, original, rewritten, original_sha256, licence, provenance_key;
    ``provenance`` has key.
    """
    problem = lambda df, name, key: df.select(F.lit(name).alias("check"), F.col(key).cast("string").alias("key"))
    digest = F.sha2(F.col("original"), 256)
    size = F.length("original")
    parts = [
        problem(manifest.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "duplicate-id", "id"),
        problem(manifest.where(digest != F.col("original_sha256")), "digest", "id"),
        problem(manifest.where((size < 300) | (size > 2400)), "length", "id"),
        problem(manifest.join(provenance.withColumnRenamed("key", "provenance_key"), "provenance_key", "left_anti"), "provenance", "id"),
        problem(manifest.where(~F.col("licence").rlike(r"(?i)^(CC|MIT|Apache|BSD|OGL|public domain)")), "licence", "id"),
        problem(manifest.groupBy("category").agg(F.count("*").alias("n")).where("n < 2"), "category-size", "category"),
        problem(manifest.groupBy(digest.alias("d")).agg(F.count_distinct("split").alias("n")).where("n > 1"), "split-leak", "d"),
        problem(manifest.agg(F.count("*").alias("n")).where("n < 15").select(F.lit("corpus").alias("k")), "corpus-size", "k"),
        problem(manifest.agg(F.avg((F.col("split") == "heldout").cast("int")).alias("r")).where("r < 0.25").select(F.lit("corpus").alias("k")), "heldout-share", "k"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merge_verdicts(packets: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Full outer join of candidate packets and reviewers' verdicts on document, rule, span and quote with a state:
    merged, missing (no verdict), unmatched (no candidate) or duplicate (more than one by a reviewer)."""
    key = ["doc_id", "rule_id", "start", "end", "quote"]
    v = verdicts.groupBy(*key, "reviewer").agg(F.count("*").alias("n"), F.max("verdict").alias("verdict"))
    joined = packets.select(*key).withColumn("p", F.lit(1)).join(v, key, "full_outer")
    state = F.when(F.col("p").isNull(), "unmatched").when(F.col("reviewer").isNull(), "missing").when(F.col("n") > 1, "duplicate").otherwise("merged")
    return joined.select(*key, "reviewer", "verdict", state.alias("state"))


def canonical_digest(column: Column) -> Column:
    """SHA-256 of a map column as JSON with sorted keys."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(column)))), 256)
