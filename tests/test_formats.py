"""Structured formats, scanners, selectors, edit ranges and the stream."""

import json

import pytest

from glyphmill.functions.diff import ranges
from glyphmill.plans.config import Config
from glyphmill.plans.engine import Typesetter
from glyphmill.sources import scan

NB = "\u00a0"


def run(spark, text, fmt, status=False, **config):
    rows = spark.createDataFrame([(text,)], "text string")
    r = Typesetter(Config(format=fmt, **config)).transform(rows, status="st").first()
    return (r.typeset, r.st) if status else r.typeset


def test_json(spark):
    doc = {"a - b": "в доме - \"тепло\"", "n": 5, "list": ["и т.д.", {"x": " край "}]}
    got = json.loads(run(spark, json.dumps(doc, ensure_ascii=False), "json"))
    assert got == {"a - b": f"в{NB}доме{NB}— «тепло»", "n": 5, "list": [f"и{NB}т.{NB}д.", {"x": " край "}]}
    only = json.loads(run(spark, json.dumps(doc, ensure_ascii=False), "json", fields=("/list/*",)))
    assert only["a - b"] == doc["a - b"] and only["list"][0] != "и т.д."
    none, status = run(spark, '{"a": ', "json", status=True)
    assert none is None and status.code == "INPUT"


def test_scanners_paths():
    spans = scan.scan_json('{"a": ["x", {"b/c": "y"}]}')
    assert [(s[5]) for s in spans if not s[2]] == [["a", "0"], ["a", "1", "b/c"]]
    toml = scan.scan_toml('[[p]]\nn = "a"\n[[p]]\nn = "b"\n')
    assert [s[5] for s in toml if not s[2]] == [["p", "0", "n"], ["p", "1", "n"]]
    yaml = scan.scan_yaml("a:\n  - x y\n  - k: z w\nb: true\n")
    assert [s[5] for s in yaml if not s[2]] == [["a", "0"], ["a", "1", "k"]]
    with pytest.raises(scan.ScanError):
        scan.scan_toml('a = "x')
    assert scan.validate_xml("<a><b/></a>") is None and scan.validate_xml("<a></b>") is not None


def test_yaml_words_stay():
    for word in ("true", "null", "12", "-5", "1e3", "~"):
        assert not scan.yaml_plain_is_text(word)
    assert scan.yaml_plain_is_text("5 км") and scan.yaml_plain_is_text("дом")


def test_markdown_code_is_untouched(spark):
    text = "# а - к\n\n```\nа - к\n```\n\nс `а - к` [в - г](http://x.ru/а-к)"
    got = run(spark, text, "markdown")
    assert "```\nа - к\n```" in got and "`а - к`" in got and "(http://x.ru/а-к)" in got and got.startswith(f"# а{NB}— к")


def test_frontmatter(spark):
    assert run(spark, "---\nt: а - к\n---\n\nв - г", "frontmatter") == f"---\nt: а{NB}— к\n---\nв{NB}— г"
    assert run(spark, "+++\nt = \"а - к\"\n+++\nв - г", "frontmatter") == f"+++\nt = \"а{NB}— к\"\n+++\nв{NB}— г"
    none, status = run(spark, "---\nt: а\n", "frontmatter", status=True)
    assert none is None and status is not None


def test_xml(spark):
    assert run(spark, " <a><!-- а - к --><b>а - к</b></a>\n", "xml", entities=True) == " <a><!-- а - к --><b>а&#160;&#8212; к</b></a>\n"


def test_html_markup(spark):
    got = run(spark, "а - к\n\nв\nг", "html", html=True, entities=True)
    assert got == "<p>а&nbsp;&mdash; к</p>\n\n<p>в<br>\nг</p>"


def test_ranges_cover_all_edits():
    before, after = "😀 дом - да", f"😀 дом{NB}— да!"
    got = ranges(before, after)
    assert got == sorted(got) and all(a <= b for a, b in got)
    units = after.encode("utf-16-le")
    outside, at = b"", 0
    for a, b in got:
        outside += units[2 * at : 2 * a]
        at = b
    rest = iter(before)
    assert all(c in rest for c in (outside + units[2 * at :]).decode("utf-16-le"))
    assert ranges("x", "x") == [] and ranges(None, "x") == []


def test_stream_equals_batch(spark, tmp_path):
    from glyphmill.streaming.files import typeset_stream

    path = str(tmp_path / "in")
    batch = spark.createDataFrame([(1, "5-6"), (2, None)], "id long, text string")
    batch.write.parquet(path)
    config = Config(rules={"*": False, "number.en_range": True})
    q = typeset_stream(spark, path, batch.schema, config).writeStream.format("memory").queryName("typeset_out").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.id: r.typeset for r in spark.sql("select * from typeset_out").collect()}
    assert got == {r.id: r.typeset for r in Typesetter(config).transform(batch).collect()} == {1: "5–6", 2: None}


def test_entry_without_llm(tmp_path):
    """A copy without the optional subpackage imports and keeps every other query; one whose subpackage lacks a module that it needs doesn't import."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    skip = lambda folder, names: {"llm", "__pycache__"} & set(names)
    shutil.copytree(f"{root}/glyphmill", tmp_path / "glyphmill", ignore=skip)
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    ask = "import __spark_entry__ as e; q = set(e.queries()); assert set(e.oracle_sql()) <= q; print(len(q), 'op1_best_fit_packing' in q, 'typeset_documents' in q)"
    done = subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode == 0 and done.stdout.split()[1:] == ["False", "True"] and int(done.stdout.split()[0]) > 140, done.stderr
    (tmp_path / "glyphmill/llm").mkdir()
    (tmp_path / "glyphmill/llm/__init__.py").write_text("")
    (tmp_path / "glyphmill/llm/registry.py").write_text("import no_such_module_here\n")
    done = subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode and "no_such_module_here" in done.stderr
