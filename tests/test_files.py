"""Files by their true names, project rules and the command line."""

import json

import pytest

from prosewell.__main__ import main
from prosewell.sources import suppression
from prosewell.sources.files import markdown_files


def test_names_are_as_they_are(spark, tmp_path):
    names = ["doc a/x y.md", "100%/é+b#.md", "plain.md", "node_modules/z.md", "c%20d.md"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("text", "utf-8")
    got = {r.file for r in markdown_files(spark, str(tmp_path)).collect()}
    assert got == {f"{tmp_path}/{n}" for n in names if "node_modules" not in n}


def test_project_rules_are_read_where_they_are(spark, tmp_path):
    path = tmp_path / suppression.PROJECT_FILE
    path.write_text("suppress:\n  - file: '**/x.md'\n    reason: own\n", "utf-8")
    assert suppression.read(spark, str(tmp_path / "none.yaml"), str(path)) == [{"file": "**/x.md", "reason": "own"}]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert main([], spark) == 3 and "No markdown files found under: ." in capsys.readouterr().err
    for wrong in (["--unknown"], ["--lang", "xx"]):
        with pytest.raises(SystemExit) as e:
            main(wrong, spark)
        assert e.value.code == 3
    (tmp_path / "a b.md").write_text("TODO: [your name] here\n", "utf-8")
    assert main(["--lang", "th", "--json", "."], spark) == 1
    found = json.loads(capsys.readouterr().out)["findings"]
    assert {f["file"].rpartition("/")[2] for f in found} == {"a b.md"} and {f["priority"] for f in found} == {"P0"}
    (tmp_path / ".prosewell.yaml").write_text("suppress:\n  - file: '**/a b.md'\n    reason: a template\n", "utf-8")
    assert main(["--lang", "th", str(tmp_path)], spark) == 0
    assert "a template" in capsys.readouterr().out
    assert main([str(tmp_path / "a b.md")], spark) == 2  # English: an outside tool is missing
