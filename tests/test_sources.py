"""Readers, configuration, prompts, reports and the stream."""

import json

import pytest

from glosspan.plans.pipeline import lint
from glosspan.sources import documents as S
from glosspan.streaming.lint_stream import lint_stream


def test_files_and_formats(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\nDon't go.")
    (tmp_path / "b.TXT").write_text("Don't go.")
    rows = {r.path.rsplit("/", 1)[1]: r.format for r in S.read_files(spark, [str(tmp_path)]).collect()}
    assert rows == {"a.md": "markdown", "b.TXT": "text"}


def test_rule_packs(tmp_path):
    assert S.load_rule_pack()["limits"]["maxNounClusterLength"] == 3
    f = tmp_path / "p.json"
    f.write_text(json.dumps({"dictionary": {"unapproved": [dict(alternatives=["bar"], safeSubstitution=True, term="foo")]}, "metadata": {"id": "p"}}))
    assert S.load_rule_pack("p.json", str(tmp_path))["unapproved"] == {"foo": {"use": ["bar"], "safe": True}}
    for bad in ({}, {"metadata": {"id": "x"}, "limits": {"nope": 1}}, "missing.json"):
        with pytest.raises(S.PackError):
            S.load_rule_pack(bad, str(tmp_path))


def test_config(tmp_path, monkeypatch):
    (tmp_path / "glosspan.config.jsonc").write_text('{"a": "x // y", /* c */ "b": 1 // z\n}')
    monkeypatch.delenv("GLOSSPAN_CONFIG", raising=False)
    assert S.load_config(str(tmp_path)) == {"a": "x // y", "b": 1}


def test_prompts():
    p = S.parse_prompt("id: q\nversion: 2\n---\nsys {{a}}\n---\nuser {{ b }}\n", "q.v2.md")
    assert p["variables"] == ["a", "b"] and S.render("x {{a}}", {"a": ["p", "q"]}) == "x - p\n- q"
    for t, v in (("{{a}}", {}), ("x", {"a": 1})):
        with pytest.raises(ValueError):
            S.render(t, v)
    with pytest.raises(ValueError):
        S.parse_prompt("id: q\nversion: 1\n---\na\n---\nb", "q.v2.md")


def test_reports(spark):
    r = lint(spark.createDataFrame([("d", "Ok.\nDon't go!")], "doc_id string, text string"))
    body = json.loads(S.json_report(r.findings).first().value)
    assert body["doc_id"] == "d" and {f["rule_id"] for f in body["findings"]} == {"no-contractions", "punctuation-constraints"}
    assert any("d:2:1 error" in x.value for x in S.text_report(r.findings, r.analysed.documents).collect())
    host = S.host_report(r.findings, "no-contractions").first()
    assert host.severity_code == 2 and len(host.suggestions) <= 3
    assert S.rule_list(spark).count() == 14 and S.evaluator_list(spark).count() == 8
    assert S.candidate_packets(r.candidates, r.analysed.documents).count() == r.candidates.count()


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a", "Don't go."), ("b", "Fine.")], "doc_id string, text string").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("doc_id string, text string").parquet(str(tmp_path / "in"))
    q = lint_stream(s, str(tmp_path / "out"), str(tmp_path / "ck"), {"only_rule": "no-contractions"})
    q.awaitTermination(240)
    assert [r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a"]
