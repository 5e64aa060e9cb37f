"""One isolated query per rule: sentences built from the keys of orders, and what the rule makes of them.

{n} is a number from 100 to 999, {t} one from 10 to 59 and {d} a digit from 1 to 9, all taken from the order key. The expected sentence is built from the same columns, so the
oracle states the result and doesn't repeat the pattern.
"""

from __future__ import annotations

from ..functions.rx import NBSP as N
from ..functions.rx import NNBSP as T

_SPAN, _END = '<span style="white-space:nowrap;">', "</span>"

#: (rule, input, expected); a rule may have several. HTML cases begin with "html:".
CASES: tuple[tuple[str, str, str], ...] = (
    ("quote.open", 'груз "Амбер {n} прибыл', "груз «Амбер {n} прибыл"),
    ("quote.open_cyrillic", 'груз{n}"ждёт', "груз{n} «ждёт"),
    ("quote.close", 'груз {n}" прибыл', "груз {n}» прибыл"),
    ("quote.fix_orphan_open", "слово{n}« тут", "слово{n}» тут"),
    ("quote.nested", "«Заказ «Амбер» {n}» ушёл", "«Заказ „Амбер“ {n}» ушёл"),
    ("html:quote.around_link", '<a href="x">"Заказ {n}"</a>', '"<a href="x">Заказ {n}</a>"'),
    ("dash.em_double_hyphen", "Заказ {n} -- готов", "Заказ {n} — готов".replace(" —", " —")),
    ("dash.en_range", "от {n} - {t} штук", "от {n}–{t} штук"),
    ("dash.em", "Заказ{n}а - готов", "Заказ{n}а" + N + "— готов"),
    ("dash.em_line_start", "- Заказ {n}", "—" + N + "Заказ {n}"),
    ("dash.em_after_sentence", "Готово! - Заказ {n}", "Готово! —" + N + "Заказ {n}"),
    ("dash.compound_preposition", "заказ {n} из за склада", "заказ {n} из-за склада"),
    ("dash.indefinite_pronoun", "кто то взял {n}", "кто-то взял {n}"),
    ("dash.hyphenated_particle", "всё таки {n}", "всё-таки {n}"),
    ("dash.emphatic_particle", "возьми ка {n}", "возьми-ка {n}"),
    ("symbol.trademark", "Марка{n}(tm)", "Марка{n}™"),
    ("symbol.registered", "Марка{n}(R)", "Марка{n}®"),
    ("symbol.copyright", "(c) {n}", "©" + N + "{n}"),
    ("symbol.apostrophe", "д'Артаньян {n}", "д’Артаньян {n}"),
    ("symbol.fahrenheit", "было {n}F, стало", "было {n}" + N + "°F, стало"),
    ("symbol.arrows", "{n} -> {t}", "{n} → {t}"),
    ("punctuation.comma_before_conjunction", "заказ {n}а но пусто", "заказ {n}а, но пусто"),
    ("punctuation.repeat_limit", "Готово {n}!!!!! Да??", "Готово {n}!!! Да?"),
    ("punctuation.collapse_repeated", "один,,{n};; два", "один,{n}; два"),
    ("punctuation.ellipsis", "Заказ {n}.....", "Заказ {n}…"),
    ("punctuation.mark_ellipsis", "Заказ {n}?…", "Заказ {n}?.."),
    ("punctuation.swap_exclamation_question", "Заказ {n}!? Да", "Заказ {n}?! Да"),
    ("punctuation.drop_terminal_garbage", "Заказ {n}!,! Да", "Заказ {n}! Да"),
    ("punctuation.collapse_doubled", "Заказ {n}.. Да", "Заказ {n}. Да"),
    ("punctuation.trim_bracket_terminal_punct", "(заказ {n},) да", "(заказ {n}) да"),
    ("punctuation.bracket_spaces", "( заказ {n} ) да", "(заказ {n}) да"),
    ("punctuation.space_before_bracket", "заказ(номер {n})", "заказ (номер {n})"),
    ("punctuation.period_at_end", "Заказ {n}", "Заказ {n}."),
    ("number.time", "в {t} : {t} ровно", "в {t}:{t} ровно"),
    ("number.en_range", "Партия {n}-{t} шт.", "Партия {n}–{t} шт."),
    ("number.minus_range", "холод -{d}…{t}", "холод −{d}…{t}"),
    ("number.times", "плита {n}x{t} и {d} х {d}", "плита {n}×{t} и {d}×{d}"),
    ("html:number.sub", "H_{d} есть", "H<sub><small>{d}</small></sub> есть"),
    ("html:number.sup", "x^{d} есть", "x<sup><small>{d}</small></sup> есть"),
    ("number.fraction", "взял 1/2 и 3/4 от {n}", "взял ½ и ¾ от {n}"),
    ("number.math", "{n} != {t} и {d} <= {n}", "{n} ≠ {t} и {d} ≤ {n}"),
    ("number.thin_space_triads", "сумма {t} {n} {n} итого", "сумма {t}" + T + "{n}" + T + "{n} итого"),
    ("number.nbsp_numero", "№ {n}", "№" + T + "{n}"),
    ("number.nbsp_section", "§ {n}", "§" + T + "{n}"),
    ("space.nbsp_two_letter", "сеть РФ {n}", "сеть" + N + "РФ {n}"),
    ("space.trim_before_punctuation", "Заказ {n} , да", "Заказ {n}, да"),
    ("space.space_after_comma", "один,два {n}", "один, два {n}"),
    ("space.space_after_punctuation", "заказ{n}:готов", "заказ{n}: готов"),
    ("space.space_after_period", "конец{n}.Начало и файл{n}.json", "конец{n}. Начало и файл{n}.json"),
    ("space.space_after_ellipsis", "Что?..да {n}", "Что?.. да {n}"),
    ("space.collapse_spaces", "Заказ   {n}  готов", "Заказ {n} готов"),
    ("space.strip_quote_padding", "« Заказ {n} »", "«Заказ {n}»"),
    ("space.trim_before_percent", "скидка {t} %", "скидка {t}%"),
    ("space.nbsp_before_quote", "в «Амбере» {n}", "в" + N + "«Амбере» {n}"),
    ("space.nbsp_before_month", "{t} мая и {d} июня", "{t}" + N + "мая и {d}" + N + "июня"),
    ("space.trim_line_end", "Заказ {n}  ", "Заказ {n}"),
    ("space.no_space_after_opening_ellipsis", "« … заказ {n}", "«…заказ {n}"),
    ("space.trim_before_parenthetical_ellipsis", "(заказ {n} …) да", "(заказ {n}…) да"),
    ("space.space_after_year", "в {n}году", "в {n} году"),
    ("abbr.nbsp_dpi", "печать {n} dpi", "печать {n}" + N + "dpi"),
    ("abbr.nbsp_short_acronym", "рис. {n} и гл. {d}", "рис." + N + "{n} и гл." + N + "{d}"),
    ("abbr.nbsp_reference", "см. заказ{n}", "см." + N + "заказ{n}"),
    ("abbr.nbsp_location", "ул. Ардена, д. {n}", "ул." + N + "Ардена, д." + N + "{n}"),
    ("abbr.nbsp_unit", "путь {n} км и {d} м2", "путь {n}" + N + "км и {d}" + N + "м²"),
    ("abbr.nbsp_fraction_unit", "½ кг и {n}", "½" + N + "кг и {n}"),
    ("abbr.nbsp_weight_unit", "вес {n} кг", "вес {n}" + N + "кг"),
    ("abbr.nbsp_volume_unit", "объём {n} мл", "объём {n}" + N + "мл"),
    ("abbr.nbsp_time_unit", "время {n} мин", "время {n}" + N + "мин"),
    ("abbr.nbsp_data_unit", "файл {n} МБ и {d} ТБ/с", "файл {n}" + N + "МБ и {d}" + N + "ТБ/с"),
    ("abbr.nbsp_frequency_unit", "частота {d}.{d} ГГц", "частота {d}.{d}" + N + "ГГц"),
    ("abbr.nbsp_css_unit", "ширина {n} px", "ширина {n}" + N + "px"),
    ("abbr.nbsp_volt", "сеть {n}в", "сеть {n}" + N + "В"),
    ("abbr.nbsp_magnitude", "{n}тыс. штук", "{n}" + N + "тыс. штук"),
    ("abbr.nowrap_postscript", "Да. P.S. заказ {n}", "Да. P." + N + "S. заказ {n}"),
    ("abbr.nowrap_etc", "заказ {n} и т.д. да", "заказ {n} и" + N + "т." + N + "д. да"),
    ("abbr.nowrap_ie", "заказ {n}, т.е. груз", "заказ {n}, т." + N + "е. груз"),
    ("abbr.nowrap_era", "{n} до н.э. было", "{n} до" + N + "н." + N + "э. было"),
    ("abbr.nbsp_honorific", "г-н Корвин {n}", "г-н" + N + "Корвин {n}"),
    ("abbr.currency", "цена {n} руб. за штуку", "цена {n}" + N + "₽ за штуку"),
    ("abbr.nbsp_money_magnitude", "{n} тыс. у.е.", "{n}" + N + "тыс." + N + "у.е."),
    ("abbr.nbsp_currency_prefix", "цена €{n}", "цена €" + N + "{n}"),
    ("abbr.nbsp_organization", "ООО Амбер {n}", "ООО" + N + "Амбер {n}"),
    ("abbr.nowrap_gost", "по ГОСТ {n}-{t}", "по ГОСТ" + N + "{n}–{t}"),
    ("nobr.nbsp_short_word", "стоит в доме {n}", "стоит в" + N + "доме {n}"),
    ("nobr.nbsp_final_word", "видел заказ {n} сам не. Да", "видел заказ {n} сам" + N + "не. Да"),
    ("nobr.nowrap_phone", "звони +7{n}{n}{t}{t} всегда", "звони +7" + N + "{n}" + N + "{n}-{t}-{t} всегда"),
    ("nobr.nowrap_phone_alt", "звони +7({n}){n}{t}{t} всегда", "звони +7" + N + "{n}" + N + "{n}-{t}-{t} всегда"),
    ("html:nobr.nowrap_ip", "узел 10.0.{t}.{d} жив", f"узел {_SPAN}10.0.{{t}}.{{d}}{_END} жив"),
    ("nobr.initials_dots", "автор А Б Корвин, {n}", "автор А." + N + "Б." + N + "Корвин, {n}"),
    ("nobr.nowrap_initials", "автор А. Б. Корвин, {n}", "автор А." + N + "Б." + N + "Корвин, {n}"),
    ("nobr.nbsp_particle", "заказ {n} ли это", "заказ {n}" + N + "ли это"),
    ("nobr.nbsp_after_particle", "поди-ка узнай {n}", "поди-ка" + N + "узнай {n}"),
    ("nobr.nbsp_namely", "как то: {n}", "как" + N + "то: {n}"),
    ("nobr.nbsp_celsius", "жар {t} °С и", "жар {t}" + N + "°C и"),
    ("html:nobr.nowrap_hyphen_short", "купил кое-как {n}", f"купил {_SPAN}кое-как{_END} {{n}}"),
    ("html:nobr.nowrap_hyphen", "купил бизнес-план {n}", f"купил {_SPAN}бизнес-план{_END} {{n}}"),
    ("date.year_range", "в 1{n}-2{n} гг. было", "в 1{n}–2{n}" + N + "гг. было"),
    ("date.month_range", "март-апрель {n}", "март–апрель {n}"),
    ("date.day_month_range", "{d} мая-{t} июня", "{d} мая–{t} июня"),
    ("html:date.nowrap_day_range", "с {d}-{t} мая", f"с {_SPAN}{{d}}—{{t}} мая{_END}"),
    ("html:date.nowrap_date", "дата {t}.0{d}.2{n} г. да", f"дата {_SPAN}{{t}}.0{{d}}.2{{n}} г.{_END} да"),
    ("date.nbsp_year_suffix", "к 1{n} г. всё", "к 1{n}" + N + "г. всё"),
    ("html:hanging.quote", "заказ «{n}»", 'заказ<span style="margin-right:0.44em;"> </span><span style="margin-left:-0.44em;">«</span>{n}»'),
    ("html:hanging.bracket", "заказ ({n})", 'заказ<span style="margin-right:0.3em;"> </span><span style="margin-left:-0.3em;">(</span>{n})'),
    ("other.acute_accent", "замо`к {n}", "замо́к {n}"),
    ("html:other.sup_word", "метр ^кв{n} да", "метр<sup><small>кв{n}</small></sup> да"),
    ("other.roman_range_dash", "главы XV-XX, {n}", "главы XV–XX, {n}"),
    ("other.en_century_range", "были XV-XX вв. и {n}", "были XV–XX" + N + "вв. и {n}"),
    ("html:other.en_time_range", "с 1{d}:{t}-1{d}:{t} ждём", f"с {_SPAN}1{{d}}:{{t}}–1{{d}}:{{t}}{_END} ждём"),
    ("other.split_triads", "сумма {t}{n}{n} итого", "сумма {t}" + T + "{n}" + T + "{n} итого"),
    ("html:abbr.nowrap_ie+other.drop_nested_nowrap", "заказ {n}, т.е. груз", f"заказ {{n}}, {_SPAN}т. е.{_END} груз"),
    ("html:abbr.nowrap_ie+nobr.nbsp_short_word+other.strip_nbsp_in_nowrap", "заказ {n}, т.е. груз", f"заказ {{n}}, {_SPAN}т. е.{_END} груз"),
    ("html:abbr.nowrap_ie+other.nbsp_in_nowrap", "заказ {n}, т.е. груз", f"заказ {{n}}, {_SPAN}т.{N}е.{_END} груз"),
    ("html:text.autolink", "вот http://a.ru/{n} тут", 'вот <a href="http://a.ru/{n}">a.ru/{n}</a> тут'),
    ("html:text.email", "пиши x{n}@a.ru тут", 'пиши <a href="mailto:x{n}@a.ru">x{n}@a.ru</a> тут'),
    ("html:text.deduplicate_words", "очень очень {n}", "очень {n}"),
    ("html:text.paragraphs", "Заказ {n}\n\nГотов", "<p>Заказ {n}</p>\n\n<p>Готов</p>"),
    ("html:text.breakline", "Заказ {n}\nГотов", "Заказ {n}<br>\nГотов"),
)


def parts(template: str) -> list[tuple[str, str]]:
    """("text" or the name of a number, value) in order."""
    import re

    return [("col", p[1]) if re.fullmatch(r"\{[ntd]\}", p) else ("text", p) for p in re.split(r"(\{[ntd]\})", template) if p]
