"""Rules, gate, suppression and the whole plan on inline documents."""

import pytest

from glosspan.operators import blocks as B
from glosspan.operators import gate
from glosspan.operators.analyse import analyse_documents
from glosspan.operators.rules import ORDER, RuleConfig, run_rules
from glosspan.plans.pipeline import lint

DOCS = {
    "contraction": "Don't open the valve.", "ambiguous": "It's full.", "admonition": "> [!WARNING]\n> Don't lean here.", "code": "Use `don't` here.", "safe-term": "Utilise the clamp.",
    "phrase": "Prior to launch, wait.", "unsafe-term": "Commence heating.", "repeat": "Lift the the lid.", "negation": "Do not not lift it.", "apart": "Wait. Wait for the lamp.", "unit": "Set it to 25Nm.",
    "unit-ok": "Set it to 25 Nm, then 80%.", "two": "Lift the lid and fit the seal.", "two-nouns": "Lift the lid and the seal.", "descr": "The pump reads and writes data.",
    "marks": "Stop; go! Wait... a/b c/d", "commas": "One, two, three, four, five.", "abbr": "The XYZW fails. The XYZW stops.", "abbr-ok": "The flow unit (XYZW) fails. The XYZW stops.",
    "list": "- Lift it.\n- Drop it.\n- hold it", "step": "1. Lift it. Drop it.", "passive": "The lid is closed by the clerk.", "cluster": "The main hydraulic pump pressure relief valve failed.",
    "pronoun": "The pump drives the wheel. It stops.", "preferred": "Open the web site.", "empty": "", "null": None,
    "suppressed": "<!-- glosspan-disable-next-line no-contractions -- reason -->\nDon't go.\n", "range": "<!-- glosspan-disable -- why -->\nDon't go!\n<!-- glosspan-enable -->\n\nDon't go.",
    "no-reason": "<!-- glosspan-disable-next-line -->\nDon't go.", "unused": "<!-- glosspan-disable-next-line no-contractions -- reason -->\nGo on.",
    "guarded": "> [!WARNING]\n> <!-- glosspan-disable-next-line no-contractions -- r -->\n> Don't lean here.",
    "long": "The operator of the installation investigates the considerable accumulation of particularly problematic sedimentary material inside the horizontal distribution pipeline after every unscheduled interruption.",
}


@pytest.fixture(scope="module")
def result(spark):
    docs = spark.createDataFrame(list(DOCS.items()), "doc_id string, text string")
    r = lint(docs)
    found = {}
    for x in r.findings.collect():
        found.setdefault(x.doc_id, []).append(x)
    notes = {(n.doc_id, n.code) for n in r.notices.collect()}
    fixed = {x.doc_id: x.fixed for x in gate.apply_fixes(r.findings, r.analysed.documents).collect()}
    return r, found, notes, fixed


def of(found, doc, rule):
    return [x for x in found.get(doc, []) if x.rule_id == rule]


def test_contractions(result):
    _, found, _, fixed = result
    assert of(found, "contraction", "no-contractions")[0].fix.text == "Do not" and fixed["contraction"] == "Do not open the valve."
    assert of(found, "ambiguous", "no-contractions")[0].fix is None
    held = of(found, "admonition", "no-contractions")[0]
    assert held.fix is None and "admonition" in held.refusal
    assert not of(found, "code", "no-contractions")


def test_terms(result):
    _, found, _, fixed = result
    assert fixed["safe-term"] == "Use the clamp." and fixed["phrase"] == "Before launch, wait."
    assert of(found, "unsafe-term", "unapproved-vocabulary")[0].fix is None
    assert fixed["preferred"] == "Open the website."


def test_repeats(result):
    _, found, _, fixed = result
    assert fixed["repeat"] == "Lift the lid."
    assert "negation" in of(found, "negation", "no-repeated-words")[0].refusal
    assert not of(found, "apart", "no-repeated-words")


def test_units(result):
    _, found, _, _ = result
    assert len(of(found, "unit", "number-unit-format")) == 1 and not of(found, "unit-ok", "number-unit-format")


def test_instructions(result):
    _, found, _, _ = result
    assert len(of(found, "two", "one-instruction-per-sentence")) == 1
    assert not of(found, "two-nouns", "one-instruction-per-sentence") and not of(found, "descr", "one-instruction-per-sentence")


def test_marks_and_lists(result):
    _, found, _, _ = result
    checks = sorted(x.meta["check"] for x in of(found, "marks", "punctuation-constraints"))
    assert checks == ["ellipsis", "exclamation", "semicolon", "slash", "slash"]
    assert [x.meta["check"] for x in of(found, "commas", "punctuation-constraints")] == ["commas"]
    assert sorted(x.meta["check"] for x in of(found, "list", "list-instruction-structure")) == ["capital", "terminal"]
    assert [x.meta["check"] for x in of(found, "step", "list-instruction-structure")] == ["step"]


def test_abbreviations_and_length(result):
    _, found, _, _ = result
    assert len(of(found, "abbr", "abbreviation-introduction")) == 1 and not of(found, "abbr-ok", "abbreviation-introduction")
    assert of(found, "long", "sentence-length-descriptive")


def test_candidates_are_reviewed_without_a_model(result):
    _, found, notes, _ = result
    for doc, rule in (("passive", "passive-voice-candidate"), ("cluster", "noun-cluster-candidate"), ("pronoun", "ambiguous-pronoun-candidate")):
        assert {x.category for x in of(found, doc, rule)} == {"review-required"}
        assert (doc, "semantic-disabled") in notes


def test_suppression(result):
    r, found, notes, _ = result
    assert not of(found, "suppressed", "no-contractions") and len(of(found, "range", "no-contractions")) == 1
    assert of(found, "no-reason", "no-contractions") and ("no-reason", "suppression-reason-missing") in notes
    assert ("unused", "suppression-unused") in notes and ("suppressed", "suppressions-applied") in notes
    assert of(found, "guarded", "no-contractions") and ("guarded", "suppression-refused-in-admonition") in notes
    assert {x.doc_id for x in r.suppressions.collect()} >= {"suppressed", "range"}


def test_empty_documents_have_no_findings(result):
    _, found, _, fixed = result
    assert "empty" not in found and "null" not in found and fixed["null"] == ""


def test_every_offset_slices_back(spark):
    docs = spark.createDataFrame(list(DOCS.items()), "doc_id string, text string")
    a = analyse_documents(docs)
    text = {k: v or "" for k, v in DOCS.items()}
    for w in a.words.collect():
        assert text[w.doc_id][w.start:w.end] == w.text
    for s in a.sentences.collect():
        assert text[s.doc_id][s.start:s.end] == s.raw and len(s.masked) == len(s.raw)


def test_enabled_rules_prune_the_plan(spark):
    docs = spark.createDataFrame([("a", "Don't go!")], "doc_id string, text string")
    f, c = run_rules(analyse_documents(docs), RuleConfig(), gate.enabled_rules(ORDER, {}, {}, "no-contractions"))
    assert c is None and {x.rule_id for x in f.collect()} == {"no-contractions"}
    assert gate.enabled_rules(ORDER, {"no-contractions": False}, {}) == [r for r in ORDER if r != "no-contractions"]


def test_overlapping_fixes_are_both_dropped(spark):
    rows = [("d", "a", "c", 0, 5, (0, 5, "x", True)), ("d", "b", "c", 3, 8, (3, 8, "y", True)), ("d", "c", "c", 10, 12, (10, 12, "z", True)), ("d", "e", "c", 10, 12, (10, 12, "z", True))]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id string, rule_id string, category string, start int, end int, fix struct<start:int,end:int,text:string,safe:boolean>").withColumn("message", F.lit("m"))
    out, notices = gate.resolve_overlaps(df)
    assert {x.rule_id: x.fix is not None for x in out.collect()} == {"a": False, "b": False, "c": True, "e": False}
    assert [n.code for n in notices.collect()] == ["overlapping-fixes-refused"]


def test_admonitions_and_openers():
    assert [B.detect_admonition(x) for x in ("> [!NOTE]", "!!! danger", ":::tip", ".. warning::", "WARNING: hot", "Warnings are given")] == ["note", "danger", "note", "warning", "warning", "none"]
    assert B.opens_imperative("1. Lift the lid") and B.opens_imperative("Never touch it") and not B.opens_imperative("The lid") and not B.opens_imperative("List items") and B.opens_imperative("List items", frozenset(["list"]))


def test_markdown_blocks():
    a = B.analyse("# T\n\npara one\ncontinues\n\n- x\n  - y\n3. z\n\n| a | b |\n|--|--|\n| c | d |\n\n!!! note\n    inner text\n\nafter", "markdown", {})
    got = [(b["kind"], b["admonition"], b["depth"], b["ordinal"]) for b in a["blocks"]]
    assert got[:5] == [("heading", "none", 0, None), ("paragraph", "none", 0, None), ("list-item", "none", 0, None), ("list-item", "none", 1, None), ("list-item", "none", 0, 3)]
    assert [k for k, *_ in got].count("table-cell") == 4 and ("paragraph", "none", 0, None) == got[-1]
