"""Evidence for every rule beyond its hit: a text it must leave alone, what it makes of its own result, and the hit on two lines, in brackets and between tags.

Expected texts follow from the hit's: the same result twice, in brackets, between tags. Where a rule looks at the line, the text's end or its neighbours, EXPECTED states the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import BY_ID, GROUPS
from ..ship import ship
from .cases import CASES
from .config import Config
from .engine import Typesetter

#: rule: a text that it doesn't change.
MISSES = {
    "quote.around_link": '<b>"Заказ {n}"</b>',
    "quote.open": 'груз Амбер" {n}',
    "quote.open_cyrillic": 'груз" ждёт {n}',
    "quote.close": '"груз {n}',
    "quote.fix_orphan_open": "слово «тут {n}",
    "quote.nested": "«Заказ {n}» и «Амбер»",
    "dash.em_double_hyphen": "Заказ--готов {n}",
    "dash.en_range": "от {n}-{t} штук",
    "dash.em": "Заказ -готов {n}",
    "dash.em_line_start": "-Заказ {n}",
    "dash.em_after_sentence": "Готово!-Заказ {n}",
    "dash.compound_preposition": "из затеи {n}",
    "dash.indefinite_pronoun": "кто тонет {n}, что то: да",
    "dash.hyphenated_particle": "кое какао {n}",
    "dash.emphatic_particle": "возьми карту {n}",
    "symbol.trademark": "(tma) {n}",
    "symbol.registered": "(rr) {n}",
    "symbol.copyright": "(cd) {n}",
    "symbol.apostrophe": "слово' {n}",
    "symbol.fahrenheit": "код {n}FA",
    "symbol.arrows": "{n} --> {t}",
    "punctuation.comma_before_conjunction": "ночь на {n}",
    "punctuation.repeat_limit": "Готово! Да? {n}",
    "punctuation.collapse_repeated": "std::x, да; {n}",
    "punctuation.ellipsis": "Заказ {n}..",
    "punctuation.mark_ellipsis": "Заказ… {n}?",
    "punctuation.swap_exclamation_question": "Заказ {n}?! Да",
    "punctuation.drop_terminal_garbage": "Заказ {n}! Да, да?",
    "punctuation.collapse_doubled": "Заказ {n}?.. Да",
    "punctuation.trim_bracket_terminal_punct": "(заказ {n}: да)",
    "punctuation.bracket_spaces": "(заказ {n}) :( да",
    "punctuation.space_before_bracket": "{n}(заказ)",
    "punctuation.period_at_end": "Заказ {n}!",
    "number.time": "{n} : {t}",
    "number.en_range": "2024-05-{t}",
    "number.minus_range": "{t}-{n}",
    "number.times": "x{t}y",
    "number.sub": "имя_файла {n}",
    "number.sup": "x^y {n}",
    "number.fraction": "31/24 и {n}",
    "number.math": "a=b {n}",
    "number.thin_space_triads": "{t} {n}1",
    "number.nbsp_numero": "№ Амбер {n}",
    "number.nbsp_section": "{n} §",
    "space.nbsp_two_letter": "сеть РФИ {n}",
    "space.trim_before_punctuation": "Заказ ,да {n}",
    "space.space_after_comma": "{n},{t}",
    "space.space_after_punctuation": "заказ:{n}",
    "space.space_after_period": "сайт ya.ru и {n}.5",
    "space.space_after_ellipsis": "Что?.. да {n}",
    "space.collapse_spaces": "Заказ {n} готов",
    "space.strip_quote_padding": "«Заказ {n}»",
    "space.trim_before_percent": "скидка %{t}",
    "space.nbsp_before_quote": "тут «Амбер» {n}",
    "space.nbsp_before_month": "{t} майка",
    "space.trim_line_end": "Заказ {n}",
    "space.no_space_after_opening_ellipsis": "да … заказ {n}",
    "space.trim_before_parenthetical_ellipsis": "(заказ … {n})",
    "space.space_after_year": "в {t}году",
    "abbr.nbsp_dpi": "печать {n} dpis",
    "abbr.nbsp_short_acronym": "рис и гл {n}",
    "abbr.nbsp_reference": "сам.заказ{n}",
    "abbr.nbsp_location": "город. Амбер {n}",
    "abbr.nbsp_unit": "путь {n} кмов",
    "abbr.nbsp_fraction_unit": "½ кгов {n}",
    "abbr.nbsp_weight_unit": "вес {n} кгов",
    "abbr.nbsp_volume_unit": "объём {n} млн",
    "abbr.nbsp_time_unit": "время {n} минут",
    "abbr.nbsp_data_unit": "файл {n} МБит",
    "abbr.nbsp_frequency_unit": "частота {d} гц",
    "abbr.nbsp_css_unit": "ширина {n} PX",
    "abbr.nbsp_volt": "сеть {n} вт",
    "abbr.nbsp_magnitude": "{n} тысяч",
    "abbr.nowrap_postscript": "Да. PS заказ {n}",
    "abbr.nowrap_etc": "заказ {n} и так далее",
    "abbr.nowrap_ie": "заказ {n}, то есть груз",
    "abbr.nowrap_era": "{n} нашей эры",
    "abbr.nbsp_honorific": "г-нан Корвин {n}",
    "abbr.currency": "цена {n} рублик",
    "abbr.nbsp_money_magnitude": "{n} тыс. уеед",
    "abbr.nbsp_currency_prefix": "цена {n} €",
    "abbr.nbsp_organization": "ОООЗ Амбер {n}",
    "abbr.nowrap_gost": "гостья {n}",
    "nobr.nbsp_short_word": "слово {n}",
    "nobr.nbsp_final_word": "это сам. {n}",
    "nobr.nowrap_phone": "код {n}-{t}",
    "nobr.nowrap_phone_alt": "код +(495) {n}",
    "nobr.nowrap_ip": "10.{n}.1.1.",
    "nobr.initials_dots": "Корвин {n}",
    "nobr.nowrap_initials": "К. Корвин {n}",
    "nobr.nbsp_particle": "слово лист {n}",
    "nobr.nbsp_after_particle": "что-то {n}",
    "nobr.nbsp_namely": "как тот: {n}",
    "nobr.nbsp_celsius": "{t}°К",
    "nobr.nowrap_hyphen_short": "длинное-слово {n}",
    "nobr.nowrap_hyphen": "слово - слово {n}",
    "date.year_range": "код 1999-2003 {n}",
    "date.month_range": "март апрель {n}",
    "date.day_month_range": "{d} мая - 3 мая",
    "date.nowrap_day_range": "1-3 мая<{n}",
    "date.nowrap_date": "код 03.5.2024 {n}",
    "date.nbsp_year_suffix": "{n} гр.",
    "hanging.quote": "да «Амбер» {n}",
    "hanging.bracket": "да(нет) {n}",
    "other.acute_accent": "к`р {n}",
    "other.sup_word": "x^слово {n}",
    "other.roman_range_dash": "XV-XXA {n}",
    "other.en_century_range": "XV-XX {n}",
    "other.en_time_range": "10:30 12:05 {n}",
    "other.split_triads": "{n}4",
    "other.drop_nested_nowrap": "заказ {n}",
    "other.strip_nbsp_in_nowrap": "заказ {n}",
    "other.nbsp_in_nowrap": "заказ {n}",
    "text.autolink": "http: a.ru {n}",
    "text.email": "a@ b.ru {n}",
    "text.deduplicate_words": "слово слава {n}",
    "text.paragraphs": "<div>Заказ {n}</div>",
    "text.breakline": "Заказ {n}",
}
_AROUND = {"lines": lambda s: f"{s}\n{s}", "bracket": lambda s: f"({s})", "tags": lambda s: f"<i>{s}</i>"}
#: (kind, rule): the result where it isn't the hit's with the same surroundings.
EXPECTED = {
    ("again", "quote.nested"): "«Заказ «Амбер\" {n}» ушёл",
    ("bracket", "dash.em_line_start"): "(- Заказ {n})",
    ("bracket", "symbol.apostrophe"): "(д'Артаньян {n})",
    ("lines", "punctuation.period_at_end"): "Заказ {n}\nЗаказ {n}.",
    ("bracket", "punctuation.period_at_end"): "(Заказ {n})",
    ("tags", "punctuation.period_at_end"): "<i>Заказ {n}</i>",
    ("tags", "number.times"): "<i>плита {n}×{t} и {d} х {d}</i>",
    ("bracket", "space.space_after_punctuation"): "(заказ{n}:готов)",
    ("tags", "space.space_after_punctuation"): "<i>заказ{n}:готов</i>",
    ("lines", "space.space_after_period"): "конец{n}. Начало и файл{n}.json\nконец{n}.Начало и файл{n}.json",
    ("bracket", "space.space_after_period"): "(конец{n}.Начало и файл{n}.json)",
    ("tags", "space.space_after_period"): "<i>конец{n}.Начало и файл{n}.json</i>",
    ("tags", "space.nbsp_before_month"): "<i>{t}\u00a0мая и {d} июня</i>",
    ("lines", "space.trim_line_end"): "Заказ {n}  \nЗаказ {n}",
    ("bracket", "space.trim_line_end"): "(Заказ {n}  )",
    ("tags", "space.trim_line_end"): "<i>Заказ {n}  </i>",
    ("bracket", "abbr.nbsp_money_magnitude"): "({n} тыс. у.е.)",
    ("tags", "abbr.nbsp_money_magnitude"): "<i>{n} тыс. у.е.</i>",
    ("bracket", "nobr.nbsp_after_particle"): "(поди-ка узнай {n})",
    ("tags", "date.nowrap_day_range"): "<i>с {d}-{t} мая</i>",
    ("bracket", "hanging.bracket"): '<span style="margin-left:-0.3em;">(</span>заказ<span style="margin-right:0.3em;"> </span><span style="margin-left:-0.3em;">(</span>{n}))',
    ("lines", "text.paragraphs"): "<p>Заказ {n}</p>\n\n<p>Готов\nЗаказ {n}</p>\n\n<p>Готов</p>",
    ("bracket", "text.paragraphs"): "<p>(Заказ {n}</p>\n\n<p>Готов)</p>",
    ("tags", "text.paragraphs"): "<p><i>Заказ {n}\n\nГотов</i></p>",
    ("lines", "text.breakline"): "Заказ {n}<br>\nГотов<br>\nЗаказ {n}<br>\nГотов",
    ("tags", "text.breakline"): "<i>Заказ {n}\nГотов</i>",
}


def rows_of(group: str) -> list[tuple[str, str, str, str]]:
    """(rules as in cases, kind, text, expected) of a group."""
    out, seen = [], set()
    for rule, text, expected in CASES:
        own = rule.removeprefix("html:").split("+")[-1]
        if own.split(".")[0] != group:
            continue
        number = sum(r[0] == rule for r in out if r[1].startswith("hit"))
        tail = str(number + 1) if number else ""
        out.append((rule, "hit" + tail, text, expected))
        out.append((rule, "again" + tail, expected, EXPECTED.get(("again" + tail, own), expected)))
        for kind, around in _AROUND.items():
            out.append((rule, kind + tail, around(text), EXPECTED.get((kind + tail, own), around(expected))))
        if own not in seen:
            seen.add(own)
            html = "html:" if BY_ID[own].html_only or own == "quote.around_link" else ""
            out.append((html + own, "miss", MISSES[own], MISSES[own]))
    return out


def _config(rule: str) -> Config:
    ids = rule.removeprefix("html:").split("+")
    return Config(html=rule.startswith("html:"), rules={"*": False} | dict.fromkeys(ids, True), render={"layout": "style"})


def _typeset(rule, text):
    """Each text under the rules that stand beside it."""
    import pyarrow as pa

    plans: dict = {}

    @F.arrow_udf("string")
    def run(rules, texts):
        out = []
        for r, t in zip(rules.to_pylist(), texts.to_pylist()):
            if r not in plans:
                plans[r] = Typesetter(_config(r)).plan()
            out.append(plans[r].typeset(t))
        return pa.array(out, pa.string())

    return run(rule, text)


_KEYS = {"{n}": "100 + n_nationkey", "{t}": "10 + n_nationkey", "{d}": "1 + n_nationkey % 9"}


def query(group: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        cases = F.array(*[F.struct(F.lit(r).alias("config"), F.lit(k).alias("kind"), F.lit(t).alias("text")) for r, k, t, _ in rows_of(group)])
        rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.explode(cases).alias("c")).select("n_nationkey", "c.*")
        for name, key in _KEYS.items():
            rows = rows.withColumn("text", F.replace("text", F.lit(name), F.expr(f"cast({key} as string)")))
        rule = F.regexp_extract("config", r"([^:+]+)$", 1)
        return rows.select("n_nationkey", rule.alias("rule"), "kind", _typeset(F.col("config"), F.col("text")).alias("typeset"))

    return run


def sql(group: str) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(r.removeprefix('html:').split('+')[-1])}, {quoted(k)}, {quoted(e)})" for r, k, _, e in rows_of(group))
    text = "t"
    for name, key in _KEYS.items():
        text = f"replace({text}, '{name}', CAST({key} AS VARCHAR))"
    return f"SELECT n_nationkey, rule, kind, {text} AS typeset FROM nation, (VALUES {values}) v(rule, kind, t)"


def queries() -> dict:
    return {f"rules_{g}": query(g) for g in GROUPS}


def oracle_sql() -> dict[str, str]:
    return {f"rules_{g}": sql(g) for g in GROUPS}
