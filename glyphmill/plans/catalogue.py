"""Registered queries of the typesetting engine and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import glyphs
from ..functions.rx import NBSP
from . import constructs, evidence
from .cases import CASES, parts
from .config import Config
from .engine import Typesetter

_NUMBERS = {"n": "100 + o_orderkey % 900", "t": "10 + o_orderkey % 50", "d": "1 + o_orderkey % 9"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sentence(template: str) -> Column:
    return F.concat(*[F.lit(v) if k == "text" else F.expr(_NUMBERS[v]).cast("string") for k, v in parts(template)])


def _sql(template: str) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return " || ".join(quoted(v) if k == "text" else f"CAST({_NUMBERS[v]} AS VARCHAR)" for k, v in parts(template))


def _case(rule: str, template: str):
    html, ids = rule.startswith("html:"), rule.removeprefix("html:").split("+")
    config = Config(html=html, rules={"*": False} | dict.fromkeys(ids, True), render={"layout": "style"})

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = _table(spark, sf_dir, "orders").select("o_orderkey", _sentence(template).alias("text"))
        return Typesetter(config).transform(orders).select("o_orderkey", "typeset")

    return run


def _slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quantity range and a price for every order line, under the default rules."""
    lines = _table(spark, sf_dir, "lineitem")
    text = F.concat(
        F.lit("Партия "), F.col("l_orderkey").cast("string"), F.lit(" - "), (F.col("l_orderkey") + F.col("l_linenumber")).cast("string"), F.lit(" шт.,  цена "),
        F.col("l_quantity").cast("int").cast("string"), F.lit(" руб. за место"),
    )
    rows = lines.select("l_orderkey", "l_linenumber", text.alias("text"))
    config = Config(rules={"*": False, "dash.en_range": True, "abbr.currency": True, "space.collapse_spaces": True})
    return Typesetter(config).transform(rows).select("l_orderkey", "l_linenumber", "typeset")


_SLICE_SQL = """
SELECT l_orderkey, l_linenumber, 'Партия ' || CAST(l_orderkey AS VARCHAR) || '–' || CAST(l_orderkey + l_linenumber AS VARCHAR) || ' шт., цена ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || chr(160) || '₽ за место' AS typeset
FROM lineitem
"""


def _documents(**config):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
        return Typesetter(Config(max_input_length=5_000_000, **config)).transform(docs).select("doc_id", "lang", "typeset")

    return run


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collapsed spaces over whole documents as they are; the only other changes are the newline rule, folded marks and the trim."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    engine = Typesetter(Config(max_input_length=5_000_000, rules={"*": False, "space.collapse_spaces": True}))
    return engine.transform(docs).select("doc_id", F.length("typeset").cast("long").alias("n"), F.md5("typeset").alias("digest"))


_PLAIN_SQL = r"""
SELECT doc_id, CAST(length(t) AS BIGINT) AS n, md5(t) AS digest FROM (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(marks, '([^ \t\n])[ \t]+', '\1 ', 'g'), '(?m)^[ \t]+$', ' ', 'g'), '^[ \t\n]*\n|[ \t\n]+$', '', 'g') AS t
  FROM (SELECT doc_id, regexp_replace(translate(text, '“„‟”‐‒', '"««»--'), '\n{3,}', chr(10) || chr(10), 'g') AS marks FROM documents) y) x
"""


def _letters(html: bool):
    """All default rules over whole documents, and of the result the letters and digits alone: the rules set spaces, marks and markup, and neither lose nor move a letter."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
        out = Typesetter(Config(max_input_length=5_000_000, html=html, render={"nowrap": "nobr"})).transform(docs)
        bare = F.regexp_replace("typeset", r"</?(?:p|br|nobr)>|<a href=\"[^\"]*\">|</a>", "") if html else F.col("typeset")
        return out.select("doc_id", F.md5(F.regexp_replace(bare, r"[^\p{L}0-9]+", "")).alias("digest"))

    return run


_LETTERS_SQL = r"SELECT doc_id, md5(regexp_replace(text, '[^\p{L}0-9]+', '', 'g')) AS digest FROM documents"


def _entities(xml: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("«"), "n_name", F.lit("» — 5 °…")).alias("text"))
        encode = glyphs.encode_xml if xml else glyphs.encode_html
        return rows.select("n_nationkey", encode(F.col("text")).alias("typeset"))

    return run


def _decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("&laquo;"), "n_name", F.lit("&raquo;&nbsp;&mdash; &#8239;&amp;lt;&hellip; “„”")).alias("text"))
    return rows.select("n_nationkey", glyphs.decode(F.col("text")).alias("typeset"))


def _json(fields=(), exclude=()):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        k = F.col("o_orderkey").cast("string")
        doc = F.to_json(F.struct(F.concat(F.lit("Заказ 5-6 "), k).alias("title"), F.struct(F.concat(F.lit("сказал \"5-6\" "), k).alias("note"), F.array(F.lit("5-6")).alias("list")).alias("body"), F.col("o_orderkey").alias("key 1-2")))
        rows = _table(spark, sf_dir, "orders").select("o_orderkey", doc.alias("text"))
        config = Config(format="json", fields=fields, exclude=exclude, rules={"*": False, "number.en_range": True})
        out = Typesetter(config).transform(rows)
        read = out.select("o_orderkey", F.from_json("typeset", "title string, body struct<note: string, list: array<string>>, `key 1-2` string").alias("j"))  # parsed once, not once a column
        return read.select("o_orderkey", "j.title", "j.body.note", F.col("j.body.list")[0].alias("item"), F.col("j")["key 1-2"].alias("kept"))

    return run


def _json_sql(title: str, note: str, item: str) -> str:
    return (
        f"SELECT o_orderkey, 'Заказ 5{title}6 ' || CAST(o_orderkey AS VARCHAR) AS title, 'сказал \"5{note}6\" ' || CAST(o_orderkey AS VARCHAR) AS note, '5{item}6' AS item, CAST(o_orderkey AS VARCHAR) AS kept FROM orders"
    )


def _other_format(fmt: str, template: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _table(spark, sf_dir, "orders").select("o_orderkey", _sentence(template).alias("text"))
        return Typesetter(Config(format=fmt, rules={"*": False, "number.en_range": True, "dash.em": True})).transform(rows).select("o_orderkey", "typeset")

    return run


_FORMATS = {
    "yaml": ('title: "сорт 5-6 - {n}"\nlist:\n  - груз 5-6 номер {n}\n  - {n}\ncode: 5-6\ntext: |\n  строка 5-6 - {n}\n', 'title: "сорт 5–6 — {n}"\nlist:\n  - груз 5–6 номер {n}\n  - {n}\ncode: 5-6\ntext: |\n  строка 5–6 — {n}\n'),
    "toml": ("# a 5-6\n[сорт]\nname = \"груз 5-6 - {n}\"\nraw = 'груз 5-6'\nn = {n}\nlist = [\"5-6\", {n}]\n", "# a 5-6\n[сорт]\nname = \"груз 5–6 — {n}\"\nraw = 'груз 5–6'\nn = {n}\nlist = [\"5–6\", {n}]\n"),
    "xml": ('<a n="5-6"><b>груз 5-6 - {n}</b><!-- 5-6 --><c xml:space="preserve">5-6 {n}</c></a>', '<a n="5-6"><b>груз 5–6 — {n}</b><!-- 5-6 --><c xml:space="preserve">5-6 {n}</c></a>'),
    "markdown": ("# груз 5-6 - {n}\n\nа `5-6` [груз 5-6](http://a.ru/5-6)\n\n```\nкод 5-6\n```\nконец", "# груз 5–6 — {n}\n\nа `5-6` [груз 5–6](http://a.ru/5-6)\n\n```\nкод 5-6\n```\nконец"),
    "frontmatter": ("---\ntitle: груз 5-6 - {n}\n---\n\nтекст 5-6 - {n}", "---\ntitle: груз 5–6 — {n}\n---\nтекст 5–6 — {n}"),
    "html": ('<p class="5-6">груз 5-6 - {n} <code>5-6</code></p>', '<p class="5-6">груз 5–6 — {n} <code>5-6</code></p>'),
}


def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses under all default rules come back byte for byte; only the space around them may have become a no-break space."""
    pages = _table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("x "), "url", F.lit(" y")).alias("text"))
    return Typesetter(Config()).transform(pages).select("page_id", F.replace("typeset", F.lit(NBSP), F.lit(" ")).alias("typeset"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.lit(" груз 5-6 и 7-8")).alias("text"))
    out = Typesetter(Config(rules={"*": False, "number.en_range": True})).changes(rows)
    return out.select("o_orderkey", "start", "end")


def _caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts over the cap get a status and no result. Emoji count as two units."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("😀"), "text").alias("text"))
    out = Typesetter(Config(max_input_length=5000, presets=False)).transform(rows, status="status")
    return out.select("doc_id", F.col("typeset").isNull().alias("refused"), F.col("status.code").alias("code"))


def _rules_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Typesetter().rules_table(spark).groupBy("group").agg(F.count(F.lit(1)).alias("rules"), F.sum(F.col("default_enabled").cast("int")).alias("on_by_default"))


_GROUP_COUNTS = {"quote": (6, 6), "dash": (9, 9), "symbol": (6, 6), "punctuation": (12, 10), "number": (11, 11), "space": (15, 15), "abbr": (24, 24), "nobr": (13, 10), "date": (6, 5), "hanging": (2, 0), "other": (9, 8), "text": (5, 4)}


def _template(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", _sentence("груз 5-6 {{ a 5-6 }} и {% if 5-6 %} {n}").alias("text"))
    return Typesetter(Config(template="jinja", rules={"*": False, "number.en_range": True})).transform(rows).select("o_orderkey", "typeset")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.files import typeset_stream_once

    return typeset_stream_once(spark, f"{sf_dir}/events.parquet", Config(rules={"*": False, "number.en_range": True}))


def queries() -> dict:
    found = {"typeset_documents": _documents(), "typeset_documents_html": _documents(html=True, entities=True), "typeset_order_lines": _slice, "typeset_plain_documents": _plain}
    for rule, template, _ in CASES:
        found["rule_" + rule.removeprefix("html:").split("+")[-1].replace(".", "_")] = _case(rule, template)
    found |= {"entity_encode_html": _entities(False), "entity_encode_xml": _entities(True), "entity_decode": _decode}
    found |= {"json_values": _json(), "json_fields": _json(fields=("note",)), "json_exclude": _json(exclude=("/body/*",)), "json_dotted": _json(fields=("body.list.*",))}
    found |= {f"format_{k}": _other_format(k, v[0]) for k, v in _FORMATS.items()}
    found |= {"typeset_documents_letters": _letters(False), "typeset_documents_html_letters": _letters(True)}
    found |= evidence.queries() | constructs.queries()
    found |= {"mask_round_trip": _round_trip, "change_ranges": _changes, "length_cap": _caps, "rule_catalogue": _rules_by_group, "template_delimiters": _template, "stream_equals_batch": _stream}
    return found


def oracle_sql() -> dict[str, str]:
    found = {"typeset_order_lines": _SLICE_SQL, "typeset_plain_documents": _PLAIN_SQL}
    for rule, _, expected in CASES:
        found["rule_" + rule.removeprefix("html:").split("+")[-1].replace(".", "_")] = f"SELECT o_orderkey, {_sql(expected)} AS typeset FROM orders"
    name = "' || n_name || '"
    found["entity_encode_html"] = f"SELECT n_nationkey, '&laquo;{name}&raquo;&nbsp;&mdash; 5&#8239;&deg;&hellip;' AS typeset FROM nation"
    found["entity_encode_xml"] = f"SELECT n_nationkey, '&#171;{name}&#187;&#160;&#8212; 5&#8239;&#176;&#8230;' AS typeset FROM nation"
    found["entity_decode"] = f"SELECT n_nationkey, '«{name}»' || chr(160) || '— ' || chr(8239) || '&amp;lt;… \"«»' AS typeset FROM nation"
    found |= {"json_values": _json_sql("–", "–", "–"), "json_fields": _json_sql("-", "–", "-"), "json_exclude": _json_sql("–", "-", "–"), "json_dotted": _json_sql("-", "-", "–")}
    found |= {f"format_{k}": f"SELECT o_orderkey, {_sql(v[1])} AS typeset FROM orders" for k, v in _FORMATS.items()}
    found |= {"typeset_documents_letters": _LETTERS_SQL, "typeset_documents_html_letters": _LETTERS_SQL} | evidence.oracle_sql() | constructs.oracle_sql()
    found["mask_round_trip"] = "SELECT page_id, 'x ' || url || ' y' AS typeset FROM pages"
    size = "length(CAST(o_orderkey AS VARCHAR))"
    found["change_ranges"] = " UNION ALL ".join(f'SELECT o_orderkey, CAST({size} + {k} AS INTEGER) AS start, CAST({size} + {k + 1} AS INTEGER) AS "end" FROM orders' for k in (7, 13))
    found["length_cap"] = "SELECT doc_id, length(text) + 2 > 5000 AS refused, CASE WHEN length(text) + 2 > 5000 THEN 'INPUT' END AS code FROM documents"
    found["rule_catalogue"] = " UNION ALL ".join(f"SELECT '{g}' AS \"group\", CAST({a} AS BIGINT) AS rules, CAST({b} AS BIGINT) AS on_by_default" for g, (a, b) in _GROUP_COUNTS.items())
    found["template_delimiters"] = f"SELECT o_orderkey, {_sql('груз 5–6 {{ a 5-6 }} и {% if 5-6 %} {n}')} AS typeset FROM orders"
    found["stream_equals_batch"] = "SELECT event_id, 'событие 5–6 ' || event_type AS typeset FROM events"
    return found
