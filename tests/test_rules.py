"""Every rule on its isolated sentence, switched off, applied twice, and guards."""

import random

import pytest

from glyphmill.plans import catalogue
from glyphmill.plans.cases import CASES
from glyphmill.plans.config import Config, ConfigError, selected
from glyphmill.plans.engine import RuleGroup, Typesetter
from glyphmill.operators.rules import GROUPS, RULES

NB = "\u00a0"


def run(spark, text, **config):
    rows = spark.createDataFrame([(text,)], "text string")
    return Typesetter(Config(**config)).transform(rows).first().typeset


def test_counts():
    want = dict(quote=6, dash=9, symbol=6, punctuation=12, number=11, space=15, abbr=24, nobr=13, date=6, hanging=2, other=9, text=5)
    assert len(RULES) == 118 and {g: sum(r.group == g for r in RULES) for g in GROUPS} == want
    assert {r.removeprefix("html:").split("+")[-1] for r, _, _ in CASES} == {r.id for r in RULES}


@pytest.mark.parametrize("rule,text,expected", [c for c in CASES if c[0].split(".")[0].removeprefix("html:") in ("quote", "number", "abbr", "date")][:24])
def test_case(spark, rule, text, expected):
    fill = lambda s: s.replace("{n}", "457").replace("{t}", "31").replace("{d}", "5")
    ids = rule.removeprefix("html:").split("+")
    got = run(spark, fill(text), html=rule.startswith("html:"), rules={"*": False} | dict.fromkeys(ids, True))
    assert got == fill(expected)


def test_off_switch_and_presets(spark):
    text = "Заказ 5-6 - готов..."
    assert run(spark, text, rules={"*": False}) == text
    assert run(spark, "  &laquo;x&raquo;\r\n\r\n\r\ny - z ", presets=False) == "  «x»\n\ny - z"
    assert run(spark, text, rules={"dash": False, "number.en_range": False}) == "Заказ 5-6 - готов…"


def test_guards(spark):
    assert run(spark, "т. 8 100 644", rules={"*": False, "number.thin_space_triads": True}) == "т. 8\u202f100\u202f644"
    assert run(spark, "ISBN 978-5-389-12345-6", rules={"*": False, "other.split_triads": True}) == "ISBN 978-5-389-12345-6"
    assert run(spark, "2024-05-06", rules={"*": False, "number.en_range": True}) == "2024-05-06"
    assert run(spark, "сайт ya.ru и v1.2.3", rules={"*": False, "space.space_after_period": True}) == "сайт ya.ru и v1.2.3"
    assert run(spark, "10.300.1.1", html=True, rules={"*": False, "nobr.nowrap_ip": True}) == "10.300.1.1"
    assert run(spark, "цена 5 руб. Потом", rules={"*": False, "abbr.currency": True}) == f"цена 5{NB}₽. Потом"


def test_nulls_empty_and_long(spark):
    rows = spark.createDataFrame([(None,), ("",), ("слово " * 20_000,)], "text string")
    got = [r.typeset for r in Typesetter(Config(max_input_length=1_000_000)).transform(rows).collect()]
    assert got[0] is None and got[1] == "" and len(got[2]) == 119_999


def test_idempotent(spark):
    text = "«Заказ» — 5 км, 100 руб. и т. д. Что?.. Да — в доме 1999–2003 гг."
    once = run(spark, text)
    assert run(spark, once) == once


def test_masks_keep_bytes(spark):
    text = "см http://a.ru/x-y...z и x--y@a.ru <b title=\"a - b\">м</b> <code>a - b</code> 2001:db8::1 123e4567-e89b-12d3-a456-426614174000"
    got = run(spark, text)
    for kept in ("http://a.ru/x-y...z", "x--y@a.ru", '<b title="a - b">', "<code>a - b</code>", "2001:db8::1", "123e4567-e89b-12d3-a456-426614174000"):
        assert kept in got


def test_quotes(spark):
    rules = {"*": False, "quote": True}
    assert run(spark, '"Амбер" и "Хаос"', rules=rules) == "«Амбер» и «Хаос»"
    assert run(spark, 'он: "Книга "Амбер" тут"', rules=rules) == "он: «Книга „Амбер“ тут»"
    assert run(spark, 'доска 5" шире', rules=rules) == "доска 5″ шире"


def test_config_errors_come_together():
    with pytest.raises(ConfigError) as e:
        Config(format="doc", rules={"nope.x": True}, render={"nope": 1})
    assert len(e.value.issues) == 3
    with pytest.raises(ConfigError):
        Config.from_json('{"__proto__": 1}')
    assert "dash.em" in selected("dash") and len(selected("*")) == 118
    with pytest.raises(ConfigError):
        selected("*a*b*c*d*e")


def test_own_group_and_positions(spark):
    shout = RuleGroup("shout", (lambda t: t.upper(),), "before:dash")
    rows = spark.createDataFrame([("а - б",)], "text string")
    assert Typesetter(Config(), groups=(shout,)).transform(rows).first().typeset == f"А{NB}— Б"
    with pytest.raises(ValueError):
        Typesetter(Config(), groups=(RuleGroup("x", (), "after:nothing"),))


def test_status_strict_and_cap(spark):
    rows = spark.createDataFrame([("😀😀",), ("ab",)], "text string")
    got = Typesetter(Config(max_input_length=3)).transform(rows, status="st").collect()
    assert got[0].typeset is None and got[0].st.code == "INPUT" and got[1].typeset == "ab"
    with pytest.raises(Exception, match="too long"):
        Typesetter(Config(max_input_length=3, strict=True)).transform(rows).collect()


def test_no_shuffle(spark):
    rows = spark.createDataFrame([("x",)], "text string")
    plan = Typesetter(Config()).transform(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_line_indents_stay(spark):
    verse = "\n  Стих  один\n\t\tвторой - да\n \n    «третий»   1"
    assert run(spark, verse, rules={"*": False, "space.collapse_spaces": True}) == "  Стих один\n\t\tвторой - да\n \n    «третий» 1"
    assert run(spark, "а\r\n   - б\r   в  г") == "а\n   — б\n   в г".replace("— ", f"—{NB}")
    got = run(spark, "<ul>\n    <li>5-6  к</li>\n    <li\n      class='x'>в</li>\n</ul>", html=True)
    assert "\n    <li>5–6 к</li>\n    <li\n      class='x'>в</li>\n</ul>" in got


def test_plain_oracle_keeps_indents(spark, tmp_path):
    """The oracle of typeset_plain_documents and the query on texts of blanks, tabs and line breaks, which the tables' documents don't begin lines with."""
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(1)
    rows = list(enumerate("".join(rng.choice(" \t\nаб ") for _ in range(rng.randint(0, 25))) for _ in range(1000)))
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = {tuple(r) for r in catalogue.queries()["typeset_plain_documents"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert got == set(con.execute(catalogue.oracle_sql()["typeset_plain_documents"]).fetchall())
