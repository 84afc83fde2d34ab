"""Exit codes and output of the command line."""

import json

from glosspan.__main__ import main


def test_exit_codes(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "good.md").write_text("Lift the lid.")
    (tmp_path / "bad.md").write_text("Don't lift it!")
    assert main(["lint"], spark) == 2 and main(["lint", "--nope", "x"], spark) == 2 and main([], spark) == 2
    assert main(["lint", "good.md", "--only", "no-contractions"], spark) == 0
    capsys.readouterr()
    assert main(["lint", "bad.md", "--json", "--only", "no-contractions"], spark) == 1
    body = json.loads(capsys.readouterr().out)
    assert [f["rule_id"] for x in body["files"] for f in x["findings"]] == ["no-contractions"]
    assert main(["rules"], spark) == 0 and len(capsys.readouterr().out.split()) == 14
