"""Time: ceilings of single documents on one core, growth on adversarial texts, and the time budget."""

import re
import sys
import time

import pytest

from glyphmill.functions.diff import ranges
from glyphmill.operators.quotes import levels, typeset_quotes
from glyphmill.plans.config import Config
from glyphmill.plans.engine import DocumentError, RuleGroup, Typesetter

LONG = {"max_input_length": 5_000_000}


def took(plan, text, best=3):
    out = []
    for _ in range(best):
        began = time.perf_counter()
        plan.typeset(text)
        out.append(time.perf_counter() - began)
    return min(out)


PROSE = "\n\n".join(["Заказ №5 — «Амбер» - был готов в 2020 г., цена 100 руб. за 5 кг. Он сказал: \"Да, в доме 5-6 и т. д.\""] * 30)


def test_ceilings():
    """A machine under load gets ten times the ceilings of single documents (0.5, 5, 10, 600 and 80 ms)."""
    plain, html = Typesetter(Config(**LONG)).plan(), Typesetter(Config(html=True, **LONG)).plan()
    plain.typeset(PROSE), html.typeset(PROSE)
    assert took(plain, "Партия 5-6 - готова в срок.") < 0.005
    assert took(plain, PROSE) < 0.05
    assert took(html, f"<article>{PROSE}</article><pre>a  - b</pre>") < 0.1
    assert took(html, "<p>а</p><code>b - c</code>\n" * 3000) < 6
    json_plan = Typesetter(Config(format="json", fields=("/items/*/note", "/items/*/title"), **LONG)).plan()
    assert took(json_plan, '{"items":[' + ",".join(f'{{"title":"т {k} - к","note":"н 5-6 {k}","x":{k}}}' for k in range(250)) + "]}") < 0.8


@pytest.mark.parametrize("unit", ["a", "я", "1", " ", "\n", "a.", "1.", "(", "<", "<b", "<!--", "{{", "[", "](", '"', "«", "»", '5" ', 'a" "b ', "http://", "a@", "::", "a-", "&", "<pre>", "`", "> ", "- ", "!?", ",,", " ,", "\t", "x ", "P. ", "<p>\n\n", "</p>", "<svg>"])
def test_growth(unit):
    """Four times the text takes less than eight times as long, beyond a fixed part."""
    for config in (Config(html=True, **LONG), Config(format="markdown", template="jinja", **LONG)):
        plan = Typesetter(config).plan()
        short, long_ = unit * (8_000 // len(unit)), unit * (32_000 // len(unit))
        took(plan, short, 1)
        assert took(plan, long_) < 8 * took(plan, short) + 0.3


def test_quotes_grow_linearly():
    for unit in ('«а «б» в» ', '"а "б 5" в" ', '" а " ', 'а 5" б ', "«а "):
        one = lambda n: min(_timed(unit * n) for _ in range(3))  # noqa: B023, E731
        assert one(4000) < 8 * one(1000) + 0.3


def _timed(text):
    began = time.perf_counter()
    typeset_quotes(text, frozenset(("around_link", "open", "open_cyrillic", "close", "fix_orphan_open", "nested")))
    return time.perf_counter() - began


def test_scanners_grow_linearly():
    for fmt, unit, head, tail in (("yaml", "- к: 'з 5-6'\n", "", ""), ("yaml", "'a', ", "[", "x]"), ("toml", 'a = "x 5-6"\n', "", ""), ("toml", '"x", ', "a = [", "]"), ("json", '"x", ', "[", "1]"), ("xml", "<a b='5-6'>x</a>", "<r>", "</r>")):
        plan = Typesetter(Config(format=fmt, rules={"*": False, "number.en_range": True}, **LONG)).plan()
        doc = lambda n: head + unit * n + tail  # noqa: B023, E731
        took(plan, doc(500), 1)
        assert took(plan, doc(8000)) < 8 * took(plan, doc(2000)) + 0.3, (fmt, unit)


def test_budget():
    plan = Typesetter(Config(max_processing_ms=1, **LONG)).plan()
    with pytest.raises(DocumentError) as e:
        plan.typeset(PROSE * 200)
    assert e.value.code == "BUDGET"


def test_levels():
    assert levels("«а «б» в»", True, True) == "«а „б“ в»" and levels("«а «б» в»", False, True) == "«а «б» в»"
    assert levels("а 5» б", True, True) == "а 5″ б" and levels("а 5» б", True, False) == "а 5» б" and levels("а» б", True, True) == 'а" б'
    assert levels("«а 5» б» в", True, True) == "«а 5″ б» в" and levels("«а «б в", True, True) == "«а «б в"
    assert levels("«а «5» б» в» г", True, True) == "«а „5″ б“ в» г"


def calls(function, *args):
    """Calls of Python and C functions that a second call takes: the same on every machine."""
    function(*args)
    count = [0]

    def see(frame, event, arg):
        count[0] += event in ("call", "c_call")

    sys.setprofile(see)
    try:
        function(*args)
    finally:
        sys.setprofile(None)
    return count[0]


LINE = {"*": False, "dash.en_range": True, "abbr.currency": True, "space.collapse_spaces": True}


def test_short_lines_take_few_calls():
    """Order lines (F5): what a line doesn't hold isn't looked for with patterns one by one. Before, 88 calls a line."""
    plan = Typesetter(Config(rules=LINE)).plan()
    lines = [f"Партия {k} - {k + 3} шт.,  цена {k % 50} руб. за место" for k in range(1, 201)]
    assert calls(lambda: [plan.typeset(t) for t in lines]) < 60 * len(lines)
    assert plan.typeset_all(lines)[0] == [f"Партия {k}–{k + 3} шт., цена {k % 50} ₽ за место" for k in range(1, 201)]
    assert calls(plan.typeset_all, lines) < 45 * len(lines)


def test_stretches_equal_single_texts():
    """Whether a stretch holds anything to mark or not, each text comes out as it does alone."""
    texts = ["груз 5-6  тут", "", None, " груз 5-6", "a\n  5-6", "“5-6” <b>7-8</b>", "https://a.ru/5-6 7-8", "1:2:3:4:5:6:7:8", "550e8400-e29b-41d4-a716-446655440000", "&nbsp;5-6", "5-6", "цена 5 руб. Да", "кое-как  5-6", "x" * 40_000]
    for config in (Config(), Config(rules=LINE), Config(html=True, rules={"*": False, "nobr.nowrap_hyphen_short": True}), Config(html=True, entities=True)):
        plan = Typesetter(config).plan()
        for stretch in ([t] for t in texts), [texts]:
            for some in stretch:
                out, codes, _ = plan.typeset_all(some)
                for text, typeset, code in zip(some, out, codes):
                    if text is None or len(text) > 30_000:
                        assert typeset is None and code == (None if text is None else "INPUT")
                    else:
                        assert (typeset, code) == (plan.typeset(text), None)


YAML = 'title: "сорт 5-6 - {n}"\nlist:\n  - груз 5-6 номер {n}\n  - {n}\ncode: 5-6\ntext: |\n  строка 5-6 - {n}\n'


def test_yaml_takes_few_calls():
    """YAML documents (F8): lines try only the patterns that their first characters allow, and equal texts of a batch are done once. Before, 514 calls a document."""
    plan = Typesetter(Config(format="yaml", rules={"*": False, "number.en_range": True, "dash.em": True})).plan()
    assert calls(plan.typeset, YAML.replace("{n}", "107")) < 360
    texts = [YAML.replace("{n}", str(100 + k % 20)) for k in range(200)]
    assert calls(plan.typeset_all, texts) < 60 * len(texts)
    assert plan.typeset_all(texts)[0] == [plan.typeset(t) for t in texts]


def test_own_steps_see_every_text():
    """A group of the user's own may give another result for the same text, so those aren't kept."""
    seen = []
    plan = Typesetter(Config(), groups=(RuleGroup("own", (lambda t: seen.append(t) or f"{t} {len(seen)}",)),)).plan()
    assert plan.typeset_all(["а", "а", None])[0] == ["а 1", "а 2", None]


@pytest.mark.parametrize("config", [Config(html=True, entities=True, **LONG), Config(html=True, render={"nowrap": "nobr"}, **LONG)], ids=["F1", "F2"])
def test_documents_cost_few_passes(config):
    """Whole HTML documents (F1, F2) take as long as few plain passes over their words. Before, some 20 times as long as one, now under 6."""
    text = "\n".join(["Thlyouble the is of inesea ononedth edshhe thes onrein ndwhst thouinor edston the blein by. Thed the and, where it stood."] * 40)
    plan, words = Typesetter(config).plan(), re.compile("[a-z]+")
    one_pass = min(_timed_call(lambda: words.findall(text)) for _ in range(30))
    assert min(_timed_call(lambda: plan.typeset(text)) for _ in range(30)) < 12 * one_pass


def _timed_call(function):
    began = time.perf_counter()
    function()
    return time.perf_counter() - began


def json_document(k):
    return '{"title":"Заказ 5-6 %d","body":{"note":"сказал \\"5-6\\" %d","list":["5-6"]},"key 1-2":%d}' % (k, k, k)


@pytest.mark.parametrize("field, most", [("note", 130), ("body.list.*", 115)], ids=["F3", "F6"])
def test_json_takes_few_calls(field, most):
    """JSON documents (F3, F6): no path, key or value is decoded that needn't be. Before, 234 and 222 calls a document."""
    plan = Typesetter(Config(format="json", fields=(field,), rules={"*": False, "number.en_range": True})).plan()
    texts = [json_document(k) for k in range(100)]
    assert calls(plan.typeset_all, texts) < most * len(texts)
    assert plan.typeset_all(texts)[0] == [plan.typeset(t) for t in texts]


def test_ranges_take_few_calls():
    """Edit ranges of short texts (F4): no place is tried from which too few characters are left to agree. Before, 105 calls a text."""
    assert ranges("12345 груз 5-6 и 7-8", "12345 груз 5–6 и 7–8") == [(12, 13), (18, 19)]
    assert calls(ranges, "12345 груз 5-6 и 7-8", "12345 груз 5–6 и 7–8") < 70


def test_changes_cross_to_python_once(spark):
    """The ranges come from the function that typesets (F4), null, refused and unchanged texts included."""
    rows = spark.createDataFrame([(1, "a 5-6"), (2, None), (3, "x"), (4, "y" * 40_000), (5, "😀 5-6")], "k int, text string")
    out = Typesetter(Config(rules={"*": False, "number.en_range": True})).changes(rows)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [(r.k, r.typeset, r.start, r.end) for r in out.orderBy("k").collect()] == [(1, "a 5–6", 3, 4), (2, None, None, None), (3, "x", None, None), (4, None, None, None), (5, "😀 5–6", 4, 5)]


def test_repeated_rule_cases_are_done_once():
    """Short rule texts (F7): 68 calls a text before; now a text that repeats in its batch costs next to nothing, and one that doesn't less than half."""
    plan = Typesetter(Config(html=True, rules={"*": False, "nobr.nowrap_hyphen_short": True}, render={"layout": "style"})).plan()
    once, often = [f"купил кое-как {k}" for k in range(200)], [f"купил кое-как {k % 10}" for k in range(200)]
    assert calls(plan.typeset_all, once) < 34 * len(once)
    assert calls(plan.typeset_all, often) < 10 * len(often)
    assert plan.typeset_all(often)[0] == [f'купил <span style="white-space:nowrap;">кое-как</span> {k % 10}' for k in range(200)]
