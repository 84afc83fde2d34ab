"""What lets queries grow with their input: spread tasks, one reading of the texts, bounded joins."""

import pytest

from glosspan.operators import blocks, rules
from glosspan.operators.analyse import analyse_documents
from glosspan.plans import catalogue


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_of_one_file_are_spread(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert docs.rdd.getNumPartitions() < 4 <= analyse_documents(docs, parts=("regions",)).documents.rdd.getNumPartitions()


@pytest.mark.parametrize("name", sorted("rule_" + r.replace("-", "_") for r in rules.ORDER if not r.endswith("procedural")))
def test_a_rule_reads_its_texts_once(spark, sf, name):
    assert plan(catalogue.QUERIES[name](spark, sf)).count("MapInArrow") <= 1  # none where the sentences it needs were written


def test_only_the_parts_asked_for_are_made(spark):
    docs = spark.createDataFrame([("d", "Set it to 5 mm. Stop.")], "doc_id string, text string")
    a = analyse_documents(docs, parts=("sentences",))
    assert a.documents.columns == ["doc_id", "format", "text", "sentences"] and "words" not in a.sentences.columns
    whole = analyse_documents(docs)
    assert a.sentences.collect() == whole.sentences.drop("words").collect()
    assert analyse_documents(docs, parts=("regions",)).regions.collect() == whole.regions.collect()


def test_words_of_many_regions_match_a_plain_search():
    text = " ".join(f"Use `k{i}` at {i} mm{'.' if i % 3 else ','} then `a {i}` b." for i in range(60))
    found = blocks.analyse(text, "markdown", {})
    regions = [(r["kind"], r["start"], r["end"]) for r in found["regions"] if r["kind"] in blocks.CONTENT]
    for s in found["sentences"]:
        kept = sorted((max(a, s["start"]), min(b, s["end"])) for _, a, b in regions if a < s["end"] and s["start"] < b)
        assert [(w["start"], w["end"]) for w in s["words"] if w["protected_kind"]] == kept


def test_neighbours_of_a_pronoun_come_from_its_own_document(spark):
    docs = spark.createDataFrame([("d", "The pump drives. It stops."), ("e", "It stops.")], "doc_id string, text string")
    _, c = rules.run_rules(analyse_documents(docs), rules.RuleConfig(), ("ambiguous-pronoun-candidate",))
    assert [r.doc_id for r in c.collect()] == ["d"] and "Window" not in plan(c)


def test_checks_of_one_reading_are_all_reported(spark):
    docs = spark.createDataFrame([("d", "Set it to 3,5mm; then a, b, c, d, e! Go (on) (off)."), ("l", "- Lift it.\n- drop it\n- Hold it.\n\n1. Go on. Stop it.\n2. Stop")], "doc_id string, text string")
    f, _ = rules.run_rules(analyse_documents(docs), rules.RuleConfig(), ("number-unit-format", "punctuation-constraints", "list-instruction-structure"))
    got = sorted((r.doc_id, r.meta["check"], r.meta.get("count")) for r in f.collect())
    assert got == [("d", "commas", "4"), ("d", "decimal-comma", None), ("d", "exclamation", None), ("d", "parenthesis", None), ("d", "semicolon", None), ("d", "spacing", None),
                   ("l", "capital", None), ("l", "step", None), ("l", "terminal", None), ("l", "terminal", None)], got


def test_fixes_of_one_file_are_compared_in_many_tasks(spark, sf):
    assert "REPARTITION_BY_NUM" in plan(catalogue.QUERIES["fix_safety_refusals"](spark, sf))


def test_gold_labels_need_no_pairs(spark, sf):
    from glosspan.operators import evaluate

    c = spark.createDataFrame([("d", "r", "a", 0, 9), ("d", "r", "b", 20, 30), ("d", "s", "c", 0, 9), ("e", "r", "a", 0, 9), ("e", "r", "a", 50, 60), ("f", "r", "a", 0, 9)],
                              "doc_id string, rule_id string, id string, start int, end int")
    r = spark.createDataFrame([("d", "r", 5, 25, "accepted"), ("d", "r", 22, 24, "undecidable"), ("d", "s", 9, 12, "violation"), ("e", "r", 1, 2, "violation"), ("e", "r", 55, 56, "disputed"),
                               (None, "r", 0, 9, "violation")], "doc_id string, rule_id string, r_start int, r_end int, verdict string")
    got = {(x.doc_id, x.id, x.start): x.gold for x in evaluate.gold_labels(c, r).collect()}
    assert got == {("d", "a", 0): "violation", ("d", "b", 20): "unlabelled", ("d", "c", 0): "unlabelled", ("e", "a", 0): "unlabelled", ("e", "a", 50): "unlabelled", ("f", "a", 0): "unlabelled"}
    p = plan(catalogue.QUERIES["gold_labels"](spark, sf))
    assert p.count("Join") == 1 and "Broadcast" not in p


def test_pieces_follow_the_input(spark, sf):
    from glosspan.functions.shared import pieces

    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    assert pieces(t) == 4 and pieces(*[t] * 400) > 10


def test_nothing_of_the_corpus_is_broadcast(spark):
    from glosspan.operators import gate, suppress

    docs = spark.createDataFrame([("d", "<!-- glosspan-disable -- why -->\nDon't go.\n")], "doc_id string, text string")
    a = analyse_documents(docs)
    f, _ = rules.run_rules(a, rules.RuleConfig(), ("no-repeated-words",))
    gated = gate.gate_fixes(f, a)
    directives = suppress.scan_directives(a)
    claimed, _ = suppress.claims(a, directives)
    kept, records, notes = suppress.apply_suppressions(gated, claimed, directives)
    out, _ = gate.resolve_overlaps(kept)
    assert not any("Broadcast" in plan(x) for x in (directives, claimed, out, records, notes))
