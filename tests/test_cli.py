"""The command line: exit codes, precedence of flags over the file, whole-or-nothing writes."""

import json

from glyphmill import cli


def test_in_place_and_exit_codes(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    (tmp_path / cli.CONFIG_NAME).write_text(json.dumps({"rules": {"*": False, "number.en_range": True, "dash.em": True}}))
    a, b = tmp_path / "a.txt", tmp_path / "b.txt"
    a.write_text("дом 5-6\n")
    b.write_text("дом - тут")
    assert cli.run(["-w", str(a), str(b), "--rule", "dash.em=off"], spark) == 0
    assert a.read_text() == "дом 5–6\n" and b.read_text() == "дом - тут"
    assert cli.run(["--input", "json", str(a)], spark) == 1 and "a.txt" in capsys.readouterr().err
    assert cli.run(["--input", "nothing", str(a)], spark) == 2
    assert cli.run(["-w"], spark) == 2 and cli.run(["--no-such-flag"], spark) == 2
    assert cli.run(["--max-input", "1", str(a)], spark) == 1
    assert cli.run([str(a)], spark) == 0 and capsys.readouterr().out == "дом 5–6\n"


def test_file_and_flags_are_merged(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    (tmp_path / cli.CONFIG_NAME).write_text(json.dumps({"html": True, "rules": {"*": False, "number.en_range": True}, "render": {"nowrap": "nobr", "paragraphs": False}}))
    args = cli.parser().parse_args(["--set", "rules.dash.em=true", "--set", "render.prefix=x-", "--set", 'fields=["title"]', "--max-ms", "500", "--rule", "number.en_range=off"])
    config = cli.settings(args)
    assert config.rules == {"*": False, "number.en_range": "off", "dash.em": True} and config.render == {"nowrap": "nobr", "paragraphs": False, "prefix": "x-"}
    assert config.html and config.fields == ("title",) and config.max_processing_ms == 500
    a = tmp_path / "a.txt"
    a.write_text("дом 5-6")
    assert cli.run([str(a), "--set", "no_such=1"], spark) == 2 and cli.run([str(a), "--set", "rules"], spark) == 2
    (tmp_path / cli.CONFIG_NAME).write_text('{"rules": {"__proto__": {"x": 1}}}')
    assert cli.run([str(a)], spark) == 2
    capsys.readouterr()
