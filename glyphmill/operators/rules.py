"""The 118 rules in execution order, each a function from text to text.

A rule is data (identifier, default, restriction to HTML, the characters a text must hold) plus steps. Patterns and word lists, also those inside the table, are fixed values of the norms, in
the dialect that functions.rx translates.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from ..functions.rx import CLOSE, CONTENT_START, NBSP, NNBSP, OPEN, Step, chain, compiled, fixpoint, mapped, sub
from . import layout, quotes

#: Markup that rules emit: token of the opening and of the closing tag (see layout.emitted).
TOKENS = {k: (f"{OPEN}T{9000000 + 2 * i}{CLOSE}", f"{OPEN}T{9000001 + 2 * i}{CLOSE}") for i, k in enumerate(("nowrap", "small", "sub", "sup", "oa_oquote_sp_s", "oa_oquote_sp_q", "oa_oquote_nl", "oa_obracket_sp_s", "oa_obracket_sp_b", "oa_obracket_nl_b"))}


@dataclass(frozen=True)
class Context:
    """What a rule may ask of the configuration."""

    html: bool = False
    nowrap: str = "span"
    hanging: str = "class"
    prefix: str = ""
    nested: bool = True
    inch: bool = True
    enabled: frozenset = frozenset()
    #: Cycled rules that still changed a text in their last round, for whoever asks.
    unsettled: set = field(default_factory=set, compare=False)
    #: The marks of the text at hand.
    now: list = field(default_factory=lambda: [None], compare=False)

    @property
    def frame(self):
        return self.now[0]

    def tag(self, inner: str, kind: str = "nowrap") -> str:
        """Replacement text that marks a phrase. Markup is a protected token until the end; without HTML a phrase that must not wrap gets no-break spaces."""
        if not self.html:
            return inner.replace(" ", NBSP) if kind == "nowrap" else inner
        start, end = TOKENS[kind]
        return f"<{start}>{inner}</{end}>"

    def is_on(self, rule: str) -> bool:
        return rule in self.enabled


@dataclass(frozen=True)
class Rule:
    id: str
    build: Callable[[Context], Step]
    default: bool = True
    html_only: bool = False
    cycled: bool = False
    #: A text needs a character of each of these sets for the rule to do anything.
    need: tuple[str, ...] = ()
    #: And a match of one of these, where the rule's own patterns are slow to fail. A pattern that begins with a character, the rarest best, is looked for fastest.
    hint: str | tuple[str, ...] | None = None

    @property
    def group(self) -> str:
        return self.id.split(".")[0]

    def step(self, ctx: Context) -> tuple[tuple[frozenset[str], ...], Step]:
        body = self.build(ctx)
        if self.cycled:
            body = fixpoint(body, on_limit=lambda: ctx.unsettled.add(self.id))
        if self.hint:
            body = _hinted(body, (self.hint,) if isinstance(self.hint, str) else self.hint)
        return tuple(map(frozenset, self.need)), body


def _hinted(inner: Step, hints: tuple[str, ...]) -> Step:
    quick = tuple(compiled(h).search for h in hints)
    if len(quick) == 1:
        only = quick[0]
        return lambda t: inner(t) if only(t) else t

    def run(t: str) -> str:
        for search in quick:
            if search(t):
                return inner(t)
        return t

    return run


def _subs(*pairs: tuple[str, str], ignore_case: bool = True) -> Callable[[Context], Step]:
    return lambda ctx: chain([sub(p, r, ignore_case) for p, r in pairs])


def _tagged(*pairs: tuple[str, Callable[[Context], str]], ignore_case: bool = True) -> Callable[[Context], Step]:
    return lambda ctx: chain([sub(p, r(ctx), ignore_case) for p, r in pairs])


# --- fixed values: months, units and other lists of the norms ---
MONTHS = "января|февраля|марта|апреля|мая|июня|июля|августа|сентября|октября|ноября|декабря"
_MONTH_CASES = "(январ|феврал|сентябр|октябр|ноябр|декабр)([ьяюе]|[её]м)|(апрел|июн|июл)([ьяюе]|ем)|(март|август)([ауе]|ом)?|ма[йяюе]|маем"
LENGTHS = "м|мм|см|дм|км|гм|km|dm|cm|mm"
DATA_UNITS = "(?:Кбит|кбит|Мбит|мбит|Гбит|гбит|Тбит|kbit|Mbit|Gbit|Tbit|Kbps|Mbps|Gbps|kbps|mbps|gbps|KiB|MiB|GiB|TiB|кБ|КБ|МБ|Мб|ГБ|Гб|ТБ|Тб|ПБ|kB|KB|MB|GB|TB|PB|бит|Б|B)(?:\\/[сs])?"
CSS_UNITS = "px|pt|pc|em|rem|vh|vw|vmin|vmax|vi|vb|svh|svw|lvh|lvw|dvh|dvw|ch|ex|cap|ic|lh|rlh|fr|deg|rad|grad|turn|s|ms"
#: Zones after which a period belongs to a host.
ZONES = (
    "ru рф ру ком орг уа ua uk co fr com net edu gov org mil int info biz name pro io dev app me tv cc us eu de jp cn br in au ai xyz example test invalid online store cloud email site website "
    "agency digital systems software technology network solutions studio space world group media center expert academy community moscow рус онлайн сайт москва"
).split()
#: Suffixes before which a period belongs to a file.
SUFFIXES = (
    "js mjs cjs jsx ts tsx py rb go rs php java kt swift c cpp cc h hpp cs lua sh bat html htm css scss sass less xml svg json yaml yml toml ini conf env md mdx rst txt rtf pdf doc docx odt png jpg jpeg "
    "gif webp avif bmp ico tiff mp3 mp4 webm wav ogg flac mov avi mkv zip tar gz bz2 xz rar 7z exe dll so dmg app deb rpm"
).split()
_GAP = r"( |\t|\u{00A0})+"


def _hyphen(head: str, tail: str, lead: str = "-?", trail: str = "-?", not_before: str = "") -> tuple[str, str]:
    return rf"@S({head}){lead}{_GAP}{trail}({tail}){not_before}@E", "$1$2-$4"


def _unit(units: str, number: str = r"(\d+)") -> tuple[str, str]:
    return rf"@S{number}( |\u{{00A0}})?({units})@E", f"$1$2{NBSP}$4"


# --- rules that need more than substitutions ---
def _thin_triads(ctx: Context) -> Step:
    # a hyphen behind makes it no quantity, and one more digit a space further makes it a telephone number
    return mapped(r"(?<!\d)(?<!\p{L})(?<!\d )[0-9]{1,3}(?: [0-9]{3})+(?!\d)(?!-)(?! \d)(?=.|$)", lambda m: m[0].replace(" ", NNBSP), False)


def _split_triads(ctx: Context) -> Step:
    def grouped(m: re.Match) -> str:
        head = len(m[0]) % 3
        return NNBSP.join(filter(None, [m[0][:head], *(m[0][k : k + 3] for k in range(head, len(m[0]), 3))]))

    return mapped(r"(?<![\p{L}0-9<)])(?<!\d-)(?<!\d )(?<!&#)[0-9]{5,}(?=[^a-zA-Z>(0-9-]|$)", grouped, False)


def _trim_before_punctuation(ctx: Context) -> Step:
    # gluing must not build a pair of marks that punctuation would take apart; a period of an abbreviation is no such mark
    pairs = r"(?:(?<=(?<![\p{L}\p{N}])\.)(?=[ \t\u{00A0}]+[.!?])|(?<=!)(?=[ \t\u{00A0}]+[.!?…])|(?<=\?)(?=[ \t\u{00A0}]+[?…])|(?<=,)(?=[ \t\u{00A0}]+,)|(?<=;)(?=[ \t\u{00A0}]+;))"
    return sub(rf"(?<!\.\.)(?<=[^ \t\u{{00A0}}])(?!{pairs})[ \t\u{{00A0}}]+([,:.;?!…]+)(?=\s|$)", "$1", False)


_CAPITALISED, _CAPITAL, _SMALL = compiled(r"^[A-ZА-ЯЁ][a-zа-яё]"), compiled(r"^[A-ZА-ЯЁ]"), compiled(r"^[a-zа-яё0-9]+$")


def _space_after_period(ctx: Context) -> Step:
    zones, suffixes = frozenset(ZONES), frozenset(SUFFIXES)

    def body(m: re.Match) -> str:
        lead, host, zone, behind = m.groups()
        low, further = zone.lower(), m.string[m.end() : m.end() + 1]
        is_host = low in zones and (behind == ":" and "0" <= further <= "9" or not _CAPITALISED.search(zone))
        is_name = _CAPITAL.search(host) and _SMALL.search(zone)
        glued = is_host or low in suffixes or is_name or behind == "." or "0" <= behind <= "9"
        return f"{lead}{host}.{'' if glued else ' '}{zone}{behind}"

    return chain([
        mapped(r"( |\t|\u{00A0}|^)([a-zа-яё0-9]+)(?: |\t|\u{00A0})?\.([а-яёa-z]{5,})($|[^a-zа-яё])", body),
        mapped(r"( |\t|\u{00A0}|^)([a-zа-яё0-9]+)\.([а-яёa-z]{1,4})($|[^a-zа-яё])", body),
    ])


def _short_word(ctx: Context) -> Step:
    # the boundary in front is consumed, so a word is looked at only where the one before it ended
    pattern = rf"([ \t\n\r(\[{{«„>{CLOSE}\u{{00A0}}])(?:(?<!\u{{00A0}})|(?<=—\u{{00A0}}))([A-Za-zА-Яа-яЁё]{{1,2}})[ \t]+(?:([A-Za-zА-Яа-яЁё]{{1,2}})[ \t]+)?([A-Za-zА-Яа-яЁё0-9-]{{2,}}|[0-9])"
    bind = mapped(pattern, lambda m: f"{m[1]}{m[2]}{NBSP}{m[3]}{NBSP}{m[4]}" if m[3] else f"{m[1]}{m[2]}{NBSP}{m[4]}", False)
    return lambda t: bind("\n" + t)[1:]  # the text's start is such a boundary, and a pattern that begins with one set of characters is sooner done


def _year_range(ctx: Context) -> Step:
    cue = r"(с|по|период|середины|начала|начало|конца|конец|половины|в|между|\([cс]\)|©)(\s+)"

    def body(m: re.Match) -> str:
        first, dash, last, suffix = m[3], m[4], m[5], m[6]
        return f"{m[1]}{m[2]}{first}{'–' if int(first) < int(last) else dash}{last}{NBSP + 'гг.' if suffix else ''}"

    return mapped(cue + r"(\d{4})([-—−–])(\d{4})((?: |\u{00A0})?(?:г\.г\.|гг\.|гг|г\.|г)(?![а-яёa-z]))?", body)


def _dedup_second(ctx: Context) -> Step:
    pattern = r"(\s|^|\.|!|\?)(([А-ЯЁ])([а-яё]{2,}))[ \t\u{00A0}](([а-яё])\4)"
    return mapped(pattern, lambda m: m[1] + m[2] if m[6] == m[3].lower() else m[0], False)


def _phone(ctx: Context) -> Step:
    gap = r"( |\u{00A0}|\u{2009})"
    form = rf"\+?[0-9]{{1,3}}{gap}(?:[0-9]{{3,4}}|\([0-9]{{3,4}}\)){gap}[0-9]{{2,3}}[-−][0-9]{{2}}[-−][0-9]{{2}}"
    parts = rf"(\+?[0-9]{{1,3}}){gap}([0-9]{{3,4}}|\([0-9]{{3,4}}\)){gap}([0-9]{{2,3}})[-−]([0-9]{{2}})[-−]([0-9]{{2}})"
    plain = "$1 $3 $5-$6-$7"
    steps = []
    if ctx.html:  # a number that a tag encloses gets no wrapper
        steps.append(sub(rf"(?:(?<=>){parts}(?=[^\d]|$)|(?<=[^\d+]|^){parts}(?=<))", r"$1$8 $3$10 $5$12-$6$13-$7$14", False))
        steps.append(sub(rf"(?<=[^\d+>]|^){parts}(?=[^\d<]|$)", ctx.tag(plain), False))
        steps.append(sub(r"(?<=[^\d+>]|^)\+7([0-9]{3})([0-9]{3})([0-9]{2})([0-9]{2})(?=[^\d<]|$)", ctx.tag("+7 $1 $2-$3-$4"), False))
        steps.append(sub(r"((?<![a-zа-яё0-9+])(?:тел|телефон)\.?:?\s*)8([0-9]{3})([0-9]{3})([0-9]{2})([0-9]{2})(?=[^\d<]|$)", "$1" + ctx.tag("8 $2 $3-$4-$5")))
    else:
        steps.append(sub(rf"(?<=[^\d+]|^){parts}(?=[^\d]|$)", ctx.tag(plain), False))
        steps.append(sub(r"(?<=[^\d+]|^)\+7([0-9]{3})([0-9]{3})([0-9]{2})([0-9]{2})(?=[^\d]|$)", ctx.tag("+7 $1 $2-$3-$4"), False))
        steps.append(sub(r"((?<![a-zа-яё0-9+])(?:тел|телефон)\.?:?\s*)8([0-9]{3})([0-9]{3})([0-9]{2})([0-9]{2})(?=[^\d]|$)", "$1" + ctx.tag("8 $2 $3-$4-$5")))
    return chain(steps)


_OCTET = r"(?:0*(?:25[0-5]|2[0-4]\d|1?\d?\d))"
#: A sentence ends here: nothing more, or a capital, an opening quote, a line or markup, seen through spaces, brackets and inline markup.
_INLINE = rf"(?:[ \t\u{{00A0}}(]|<\/?{OPEN}[TA]\d+{CLOSE}>|{OPEN}[NHWFDG]\d+{CLOSE})*"
_ENDS = rf"(?={_INLINE}(?:\s*$|[ \t\u{{00A0}}]*(?:[\n«„]|<(?!\/?{OPEN}[TA])|(?-i:\p{{Lu}}))))"


def _where(step: Step, a: str, b: str | None = None) -> Step:
    """step where the text holds one of the tokens."""
    b = b or a
    return lambda t: step(t) if a in t or b in t else t


#: What the end of a sentence behind a currency's period needs, without properties and so sooner done.
_MAY_END = compiled(r"[бБрРлЛ]\.[ \t\u{00A0}]*(?:[^ \t\u{00A0}a-zа-яё0-9]|$)")


def _currency(ctx: Context) -> Step:
    def short(word: str, sign: str) -> list[Step]:
        ends = sub(rf"(\d) ?(?:{word})\.{_ENDS}", f"$1{NBSP}{sign}.")
        return [
            _where(sub(rf"(\d) ?(?:{word})\.?(?![а-яёa-z]) —\u{{00A0}}", f"$1{NBSP}{sign}{NBSP}— "), f" —{NBSP}"),
            lambda t: ends(t) if _MAY_END.search(t) else t,
            sub(rf"(\d) ?(?:{word})\.?(?![а-яёa-z])", f"$1{NBSP}{sign}"),
        ]

    dollars = sub(r"(\d) ?(?:долларами|долларах|долларам|долларов|долларе|доллару|доллара|доллар)(?![а-яёa-z])", f"$1{NBSP}\\$")
    return chain([
        _where(sub(r"(\d) ?(?:рублями|рублях|рублям|рублей|рублём|рубле|рубля|рубль)(?![а-яёa-z])", f"$1{NBSP}₽"), "л", "Л"),
        _where(chain(short("руб|р", "₽")), "р", "Р"),
        _where(chain([dollars, *short("долл", "\\$")]), "л", "Л"),
        _where(sub(r"(\d) ?евро(?![а-яёa-z])", f"$1{NBSP}€"), "р", "Р"),
        sub(r"(\d) ?([₽€$])", f"$1{NBSP}$2", False),
    ])


def _sup_map(ctx: Context) -> Step:
    body = rf"@S(\d+)( |\u{{00A0}})?({LENGTHS})"
    return chain([sub(*_unit(LENGTHS)), sub(body + "[2²]@E", f"$1$2{NBSP}$4²"), sub(body + "[3³]@E", f"$1$2{NBSP}$4³"), sub(*_unit(r"(?:мм|см|дм|км|гм|м)\/(?:с|ч|мин|сут)"))])


def _bracket_punct(ctx: Context) -> Step:
    return chain([
        sub(r"(?<=[a-zа-яё0-9]),[ \t\u{00A0}]*(?=\))", ""),
        sub(r"(?<=[a-zа-яё0-9])(?<!&[0-9a-z#]{1,32});[ \t\u{00A0}]*(?=\))", ""),
        sub(r"(?<=\([ \t\u{00A0}]{0,20}…[^()]{0,150}[a-zа-яё0-9])[ \t\u{00A0}]*:[ \t\u{00A0}]*(?=\))", ""),
    ])


def _nowrap_spans(ctx: Context) -> tuple[str, str]:
    start, end = TOKENS["nowrap"]
    return f"<{start}>", f"</{end}>"


def _drop_nested(ctx: Context) -> Step:
    if not ctx.html:
        return lambda t: t
    a, b = _nowrap_spans(ctx)
    # a wrapper directly inside another says nothing new; innermost first, until none is left
    return fixpoint(sub(rf"({a}[^<]*){a}([^<]*){b}((?:(?!{a}).)*?{b})", "$1$2$3", False))


def _strip_nbsp(ctx: Context) -> Step:
    if not ctx.html:
        return lambda t: t
    a, b = _nowrap_spans(ctx)
    return chain([
        fixpoint(sub(rf"(^|[^a-zа-яё])([a-zа-яё]+)\u{{00A0}}({a})", "$1$3$2 ")),
        fixpoint(sub(rf"({b})\u{{00A0}}([a-zа-яё]+)($|[^a-zа-яё])", " $2$1$3")),
        mapped(rf"{a}.*?{b}", lambda m: m[0].replace(NBSP, " "), False),
    ])


def _nbsp_nowrap(ctx: Context) -> Step:
    if not ctx.html:
        return lambda t: t
    a, b = _nowrap_spans(ctx)
    return mapped(rf"{a}.*?{b}", lambda m: m[0].replace(" ", NBSP), False)


_INITIAL = r"(\s|^|\.|,|;|:|\?|!)"
_AFTER_NAME = r"(\s|$|\.|,|;|:|\?|!)"
_SHORT_HYPHEN = r"[a-zа-яё]{1}-[a-zа-яё]{4}|[a-zа-яё]{2}-[a-zа-яё]{3}|[a-zа-яё]{3}-[a-zа-яё]{2}|[a-zа-яё]{4}-[a-zа-яё]{1}|когда-то|кое-как|кой-кого|вс[её]-таки|[а-яё]+-(?:кась|ка|де)"
#: Sets of characters that rules need.
D, DASH, DASHES, CAPITALS = "0123456789", "—–-", "-—−–", "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"


RULES: tuple[Rule, ...] = (
    *(Rule(f"quote.{n}", lambda ctx: lambda t: t) for n in quotes.RULE_IDS),  # run together, see quotes.typeset_quotes
    Rule("dash.em_double_hyphen", _subs((rf"(\s|^|{CLOSE})--(?=\s)", "$1—"), ignore_case=False), need=("-",)),
    Rule("dash.en_range", _subs((r"(?<![\d–-])(\d+)(?: |\t|\u{00A0})+[–-](?: |\t|\u{00A0})+(\d+)(?![\d–-])", "$1–$2"), ignore_case=False), need=(D, "–-")),
    Rule("dash.em", _subs((r"([^\s(\[{<.!?«„…–—-])( |\t|\u{00A0})+([—–-])(\s|$|<)", f"$1{NBSP}—$4"), (r'(,|:|\)|")([—–-])(\s|$|<)', f"$1{NBSP}—$3")), need=(DASH,)),
    Rule("dash.em_line_start", _subs((rf"(\n|\r|^|>|{CLOSE})[—–-](\t| )", f"$1—{NBSP}"), ignore_case=False), need=(DASH,)),
    Rule("dash.em_after_sentence", _subs((r"([.!?…])(?: |\t|\u{00A0})+[—–-](?: |\t|\u{00A0})+", f"$1 —{NBSP}"), (r"([.!?…])(?: |\t|\u{00A0})+[—–-]$", f"$1{NBSP}—"), ignore_case=False), need=(DASH, ".!?…")),
    Rule("dash.compound_preposition", _subs(_hyphen("из", "за|под", lead="")), need=("зЗ", "иИ")),
    Rule("dash.indefinite_pronoun", _subs(_hyphen("кто|кем|когда|зачем|почему|как|что|чем|где|чего|кого", "то|либо|нибудь", not_before="(?!:)")), need=("тлнТЛН", "кзпчгКЗПЧГ")),
    Rule("dash.hyphenated_particle", _subs(
        _hyphen("кое", "как|что|кто|кого|кому|чей|чья|чьё|чьи|где|куда|откуда|когда|какой|какая|какое|какие|каких|каким"), _hyphen("кой", "кого"), _hyphen("вс[её]", "таки")), need=("кКвВ", "оОсС")),
    Rule("dash.emphatic_particle", _subs(_hyphen("[а-яё]+", "кась|тка|тко|ка|де", lead="", trail="")), need=("кКтТдД",)),
    Rule("symbol.trademark", _subs((r"\(tm\)", "™")), need=("(", "mM")),
    Rule("symbol.registered", _subs((r"\(r\)", "®")), need=("(", "rR")),
    Rule("symbol.copyright", _subs(
        (r"\((?:c|с)\)(?=\s|[a-zа-яёA-ZА-ЯЁ0-9.,!?]|$)", "©"), (rf"©[ \t]+(?={OPEN}|<|[©®™]|\((?:c|с)\))", "© "), (rf"©(?: (?!{OPEN}|<|[©®™]|\((?:c|с)\))|\t[ \t]*|[ \t]{{2,}})(?!{OPEN}|<|[©®™ \t]|\((?:c|с)\))", f"©{NBSP}")), need=("©(",)),
    Rule("symbol.apostrophe", _subs((r"(\s|^|>|’)([a-zа-яё]{1,})'{1,2}([a-zа-яё]+)", "$1$2’$3")), cycled=True, need=("'",)),
    Rule("symbol.fahrenheit", _tagged((r"(?<!\d)([0-9]+)F($|\s|\.|,|;|:|\u{00A0}|\?|!)", lambda c: c.tag("$1 °F") + "$2"), ignore_case=False), need=("F", D)),
    Rule("symbol.arrows", _subs((r"([^-]|^)->", "$1→"), (r"<-(?!-)", "←")), need=("<>", "-")),
    Rule("punctuation.comma_before_conjunction", _subs((r"([a-zа-яё])(\s|\u{00A0})(но|а)(\s|\u{00A0})", "$1,$2$3$4"), ignore_case=False), default=False, need=("на",)),
    Rule("punctuation.repeat_limit", lambda ctx: mapped(r"([!?])\1+", lambda m: m[1] if len(m[0]) == 2 else m[1] * 3), need=("!?",)),
    Rule("punctuation.collapse_repeated", _subs((r"(,){2,}", "$1"), (r"(:){3,}", "$1"), (r"(;){2,}", "$1"), (r"((,|:);){2,}", "$1"), (r",\s+,", ",")), cycled=True, need=(",:;",), hint=(r",(?:,|;[,:]|\s+,)", r":(?:::|;[,:])", r";;")),
    Rule("punctuation.ellipsis", _subs((r"\.{3,}", "…"), ignore_case=False), need=(".",), hint=r"\.\.\."),
    Rule("punctuation.mark_ellipsis", _subs((r"([?!])…", "$1..")), need=("…", "?!")),
    Rule("punctuation.swap_exclamation_question", _subs((r"([a-zа-яё0-9])(?: |\t|\u{00A0})?!\?(\s|$|<)", "$1?!$2")), need=("!", "?")),
    Rule("punctuation.drop_terminal_garbage", _subs((r"([!?])[,;]+[!?]+", "$1"), (r"\.»\.", "».")), need=("!?»",), hint=r"[!?][,;]|»\."),
    Rule("punctuation.collapse_doubled", _subs((r"([a-zа-яё0-9]|\s|^)\.\.(\s|$|<|[),\]}»“])", "$1.$2"), (r"([a-zа-яё0-9])(!|\.)(!|\.|\?)(\s|$|<)", "$1$2$4"), (r"([a-zа-яё0-9])(\?)(\?)(\s|$|<)", "$1$2$4")), need=(".!?",), hint=(r"\.[.!?]", r"![.!?]", r"\?[.!?]")),
    Rule("punctuation.trim_bracket_terminal_punct", _bracket_punct, need=(")", ",;:"), hint=r"[,;:][ \t\u{00A0}]*\)"),
    Rule("punctuation.bracket_spaces", _subs((r"(?<![:;=])(\()( |\t)+", "$1"), (r"(?<![ \t])( |\t)+(\))", "$2")), need=("()",)),
    Rule("punctuation.space_before_bracket", _subs((r"([a-zа-яё])(\()", "$1 $2")), need=("(",)),
    Rule("punctuation.period_at_end", _subs((r"([a-zа-яё0-9])( |\t|\u{00A0})*$", "$1.")), default=False),
    Rule("number.time", _subs((r"(?<![\d:])(\d{1,2})\s*:\s*(\d{2})\s*:\s*(\d{2})(?![\d:])", "$1:$2:$3"), (r"(?<![\d:])(\d{1,2})\s*:\s*(\d{2})(?!\s*:\s*\d{2}(?![\d:]))(?![\d:])", "$1:$2")), need=(":", D)),
    Rule("number.en_range", _subs((r"(?<![\d—−-])(\d+)[—−-](\d+)(?![\d—−-])", "$1–$2")), need=(D, "—−-")),
    Rule("number.minus_range", _subs((r"(^|\s)[−-](\d+)(\.\.\.|…)(\s)?[-−](\d+)", "$1−$2$3$4−$5"), (r"(^|\s)[−-](\d+)(\.\.\.|…)(\s)?(\+)?(\d+)", "$1−$2$3$4$5$6")), need=(D, "−-", ".…")),
    Rule("number.times", _subs((r"([^a-zA-Z><]|^)(×)?(?<!\d)(\d+)( *)(x|х|×)( *)(\d+)([^a-zA-Z><]|$)", "$1$2$3×$7$8"), ignore_case=False), cycled=True, need=(D, "xXхХ×")),
    Rule("number.sub", lambda ctx: sub(r"([a-zа-яё0-9])_(\d{1,3})([^@а-яёa-z0-9]|$)", "$1" + ctx.tag(ctx.tag("$2", "small"), "sub") + "$3"), html_only=True, need=("_", D)),
    Rule("number.sup", lambda ctx: sub(r"([a-zа-яё0-9])\^(\d{1,3})([^а-яёa-z0-9]|$)", "$1" + ctx.tag(ctx.tag("$2", "small"), "sup") + "$3"), html_only=True, need=("^", D)),
    Rule("number.fraction", _subs((r'(^|\D)1\/2(?![\d"″′])', "$1½"), (r'(^|\D)1\/4(?![\d"″′])', "$1¼"), (r'(^|\D)3\/4(?![\d"″′])', "$1¾")), need=("/",)),
    Rule("number.math", _subs((r"!=", "≠"), (r"<=", "≤"), (rf"([^={OPEN}{CLOSE}]|^)>=", "$1≥"), (r"~=", "≅"), (r"(?<![-+])\+-(?![-+])", "±")), need=("=+",)),
    Rule("number.thin_space_triads", _thin_triads, need=(D, " "), hint=r"\d \d"),
    Rule("number.nbsp_numero", _subs((r"[№]\s*(\d)", f"№{NNBSP}$1")), need=("№",)),
    Rule("number.nbsp_section", _subs((r"§\s*(\d+|[IVX]+|[a-zа-яё]+)", f"§{NNBSP}$1")), need=("§",)),
    Rule("space.nbsp_two_letter", _subs((r"(?<=[a-zA-Zа-яёА-ЯЁ])( |\t)+([A-ZА-ЯЁ]{2})(?=[\s;.?!:(\"»“]|$)".replace('\\"', '"'), f"{NBSP}$2"), ignore_case=False), hint=(r" [A-ZА-ЯЁ]{2}", r"\t[A-ZА-ЯЁ]{2}")),
    Rule("space.trim_before_punctuation", _trim_before_punctuation, need=(",:.;?!…",), hint=r"[ \t\u{00A0}][,:.;?!…]"),
    Rule("space.space_after_comma", _subs((r"( |\t|\u{00A0}),([а-яёa-z0-9])", ", $2"), (r"([^0-9]),([а-яёa-z0-9«„])", "$1, $2")), need=(",",), hint=r",[A-Za-zА-Яа-яЁё0-9«„]"),
    Rule("space.space_after_punctuation", _subs((r"( |\t|\u{00A0}|^|\n)([a-zа-яё0-9]+)( |\t|\u{00A0})?(:|\)|,|…|(?:!|\?)+)([а-яёa-z])", "$1$2$4 $5")), need=(":),…!?",), hint=r"[:),…!?][A-Za-zА-Яа-яЁё]"),
    Rule("space.space_after_period", _space_after_period, need=(".",), hint=r"\.[A-Za-zА-Яа-яЁё]"),
    Rule("space.space_after_ellipsis", _subs((r"([?!]\.\.)([а-яёa-z])", "$1 $2")), need=("?!", ".")),
    Rule("space.collapse_spaces", _subs((r"(?: [ \t]+|\t[ \t]*)", " "), ignore_case=False), need=(" \t",), hint=(r"\t", r"  ")),
    Rule("space.strip_quote_padding", _subs((r"([«„])( |\t|\u{00A0})+", "$1"), (r"( |\t|\u{00A0})+([»“])", "$2")), need=("«„»“",)),
    Rule("space.trim_before_percent", _subs((r"(?<!\d)(\d+)([\t ]+)%", "$1%")), need=("%", D)),
    Rule("space.nbsp_before_quote", _subs((r"@S([a-zа-яё]{1,2}) ([«„])", f"$1$2{NBSP}$3"), ignore_case=False), need=("«„",)),
    Rule("space.nbsp_before_month", _subs((rf"(\d)(\s)+({MONTHS})([^<]|$)", f"$1{NBSP}$3$4")), need=(D, "яатй")),
    Rule("space.trim_line_end", _subs((r" +$", "")), hint=r" $"),
    Rule("space.no_space_after_opening_ellipsis", _subs((r"([«„(])( |\u{00A0})?…( |\u{00A0})?([a-zа-яё])", "$1…$4")), need=("…", "«„(")),
    Rule("space.trim_before_parenthetical_ellipsis", _subs((r"([a-zа-яё0-9])(?: |\t|\u{00A0})+…(\))", "$1…$2")), need=("…", ")")),
    Rule("space.space_after_year", _subs((r"(^| |\u{00A0})([0-9]{3,4})(год([ауе]|ом)?)([^a-zа-яё]|$)", "$1$2 $3$5")), need=(D, "гГ")),
    Rule("abbr.nbsp_dpi", _subs((r"@S(\d+)( |\t)*(dpi|lpi)@E", f"$1$2{NBSP}$4")), need=(D, "dDlL")),
    Rule("abbr.nbsp_short_acronym", _subs((r"@S(гл|стр|рис|илл?|ст|п|с)\.( |\t)*(\d+)@E", f"$1$2.{NBSP}$4")), need=(D, ".", "гсрипГСРИП")),
    Rule("abbr.nbsp_reference", _subs((r"@S(см|им)\.( |\t)*([а-яё0-9a-z]+)@E", f"$1$2.{NBSP}$4")), need=(".", "сиСИ", "мМ")),
    Rule("abbr.nbsp_location", _subs(
        (r"@S(г|ул|пер|просп|пл|бул|наб|пр|ш|туп)\.( |\t)*([а-яё0-9a-z]+)@E", f"$1$2.{NBSP}$4"), (r"@S(б-р|пр-кт)( |\t)*([а-яё0-9a-z]+)@E", f"$1$2{NBSP}$4"), (r"@S(д|кв|эт)\.( |\t)*(\d+)@E", f"$1$2.{NBSP}$4")), need=("гупбшткдэГУПБШТКДЭ",)),
    Rule("abbr.nbsp_unit", _sup_map, need=(D, "мсдкгМСДКГkdcmKDCM"), hint=r"\d[ \u{00A0}]?[A-Za-zА-Яа-яЁё]"),
    Rule("abbr.nbsp_fraction_unit", _subs((r"([½¼¾])( )(кг|мг|км|мм|см|дм|гм|г|м|т)(?![а-яё])", f"$1{NBSP}$3")), need=("½¼¾",)),
    Rule("abbr.nbsp_weight_unit", _subs(_unit("г|кг|мг|т")), need=(D, "гкмтГКМТ")),
    Rule("abbr.nbsp_volume_unit", _subs(_unit("мл|л")), need=(D, "млМЛ")),
    Rule("abbr.nbsp_time_unit", _subs(_unit("мин|ч")), need=(D, "мчМЧ")),
    Rule("abbr.nbsp_data_unit", _subs(_unit(DATA_UNITS), ignore_case=False), need=(D,), hint=r"\d[ \u{00A0}]?[A-Za-zА-Яа-яЁё]"),
    Rule("abbr.nbsp_frequency_unit", _subs(_unit("(?:к|М|Г|Т)?Гц|(?:k|M|G|T)?Hz", r"(?<![\d.,])([\d.,]+)"), ignore_case=False), need=(D, "цz")),
    Rule("abbr.nbsp_css_unit", _subs(_unit(CSS_UNITS, r"(?<![\d.,])([\d.,]+)"), ignore_case=False), need=(D,), hint=r"\d[ \u{00A0}]?[a-z]"),
    Rule("abbr.nbsp_volt", _subs((r"(?<!\d)(\d+)([вВ]| В)@E", f"$1{NBSP}В"), ignore_case=False), need=(D, "вВ")),
    Rule("abbr.nbsp_magnitude", _subs((r"(\d)(млрд|трлн|млн|тыс)(?![а-яё])", f"$1{NBSP}$2")), need=(D, "мтМТ")),
    Rule("abbr.nowrap_postscript", _tagged(
        (r"(^| |\t|>|\r|\n)(p\.) ?(p\.) ?(s\.)([^<])", lambda c: "$1" + c.tag("$2 $3 $4") + "$5"), (r"(^| |\t|>|\r|\n)(p\.) ?(s\.)([^<])", lambda c: "$1" + c.tag("$2 $3") + "$4")), need=("pP", "sS", "."), hint=r"[pP]\. ?[pPsS]\."),
    Rule("abbr.nowrap_etc", _tagged(
        *((rf"@W{a}( |\u{{00A0}})т\.?[ ]?{b}\.", lambda c, a=a, b=b: "$1" + c.tag(f"{a} т. {b}.")) for a, b in (("и", "д"), ("и", "п"), ("в", "ч"))),
        *((rf"@W{a}( |\u{{00A0}})(?:т[ ]?|т\.[ ]?){b}($|\s)", lambda c, a=a, b=b: "$1" + c.tag(f"{a} т. {b}.") + "$3") for a, b in (("и", "д"), ("и", "п"), ("в", "ч"))), ignore_case=False), cycled=True, need=("ив", "т")),
    Rule("abbr.nowrap_ie", _tagged((r"@W([тТ])\.?[ ]?е\.", lambda c: "$1" + c.tag("$2. е.")), ignore_case=False), need=("тТ", "е", ".")),
    Rule("abbr.nowrap_era", _tagged((r"@Wдо н\.?[ ]?э\.", lambda c: "$1" + c.tag("до н. э.")), (r"@Wн\.?[ ]?э\.", lambda c: "$1" + c.tag("н. э.")), ignore_case=False), need=("н", "э", ".")),
    Rule("abbr.nbsp_honorific", _subs((r"@S([гГ])-(н|жа)( |\u{00A0})", f"$1$2-$3{NBSP}"), ignore_case=False), need=("гГ", "-")),
    Rule("abbr.currency", _currency, need=(D, "рРдДеЕ₽€$")),
    Rule("abbr.nbsp_money_magnitude", _subs(
        (r"(\d)[ \u{00A0}]?тыс\.?[ \u{00A0}]{0,2}у\.? ?е\.?(?=\s|$)", f"$1{NBSP}тыс.{NBSP}у.е."), (r"(\d)[ \u{00A0}]?(млн|млрд)\.?[ \u{00A0}]{0,2}у\.? ?е\.?(?=\s|$)", f"$1{NBSP}$2{NBSP}у.е."), (r"(\d)[ \u{00A0}]?у\.? ?е\.?(?=\s|$)", f"$1{NBSP}у.е.")), need=(D, "уУ", "еЕ")),
    Rule("abbr.nbsp_currency_prefix", _subs((r"(€|\$|₽)\s?(\d)", f"$1{NBSP}$2"), ignore_case=False), need=("€$₽",)),
    Rule("abbr.nbsp_organization", _subs((r'([^a-zA-Zа-яёА-ЯЁ]|^)(ООО|ЗАО|ОАО|НИИ|ПБОЮЛ) ([a-zA-Zа-яёА-ЯЁ]|"|«|„|<)', f"$1$2{NBSP}$3"), ignore_case=False), need=("ОИ",)),
    Rule("abbr.nowrap_gost", _tagged(
        (r"( |\t|\u{00A0}|^)ГОСТ( |\u{00A0})?(\d+(?:\.\d+)*)[-−—–](\d+)( |\u{00A0})[-—]", lambda c: "$1" + c.tag("ГОСТ $3–$4 —")), (r"( |\t|\u{00A0}|^)ГОСТ( |\u{00A0})?(\d+(?:\.\d+)*)[-−—–](\d+)", lambda c: "$1" + c.tag("ГОСТ $3–$4")),
        (rf"( |\t|\u{{00A0}}|^)ГОСТ( )?(\d+(?:\.\d+)*)(?![\d.]*\d)( |\u{{00A0}})[-—]", lambda c: "$1" + c.tag("ГОСТ $3 —")), (r"( |\t|\u{00A0}|^)ГОСТ( )?(\d+(?:\.\d+)*)(?![\d–])", lambda c: "$1" + c.tag("ГОСТ $3")),
        (r"( |\t|\u{00A0}|^|>)ГОСТ( )(\d+(?:\.\d+)*)([-−—])(\d+)", lambda c: "$1ГОСТ $3–$5")), need=(D, "гГ", "тТ")),
    Rule("nobr.nbsp_short_word", _short_word),
    Rule("nobr.nbsp_final_word", _subs((r" (?=[a-zа-яё]{1,2}\.)(?<=[a-zа-яё0-9-]{3} )([a-zа-яё]{1,2})\.( [A-ZА-ЯЁ]|$)", f"{NBSP}$1.$2"), ignore_case=False), need=(".",)),
    Rule("nobr.nowrap_phone", _phone, need=(D, "-−+8"), hint=(r"-(?<=\d{2}-)\d{2}", r"−(?<=\d{2}−)\d{2}", r"\+7", r"8\d{10}")),
    Rule("nobr.nowrap_phone_alt", _tagged((r"([^\d]|^)\+\s?([0-9]{1})\s?\(([0-9]{3,4})\)\s?(\d{3})(\d{2})(\d{2})([^\d]|$)", lambda c: "$1" + c.tag("+$2 $3 $4-$5-$6") + "$7")), need=("+", "(")),
    Rule("nobr.nowrap_ip", _tagged((rf"(\s|\u{{00A0}}|^)(?=\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}})({_OCTET}(?!\d)\.{_OCTET}(?!\d)\.{_OCTET}(?!\d)\.{_OCTET}(?!\d))", lambda c: "$1" + c.tag("$2")), ignore_case=False), need=(D, "."), hint=r"\d\.\d"),
    Rule("nobr.initials_dots", _tagged(
        (rf"{_INITIAL}([А-ЯЁ])\.?(\s)?([А-ЯЁ])(\s)([А-ЯЁ][а-яё]+){_AFTER_NAME}", lambda c: "$1" + c.tag("$2. $4. $6") + "$7"), (rf"{_INITIAL}([А-ЯЁ][а-яё]+)(\s)([А-ЯЁ])\.?(\s)?([А-ЯЁ])\.?{_AFTER_NAME}", lambda c: "$1" + c.tag("$2 $4. $6.") + "$7"), ignore_case=False), default=False, need=(CAPITALS,)),
    Rule("nobr.nowrap_initials", _tagged(
        (rf"{_INITIAL}([А-ЯЁ])\.(\s)?([А-ЯЁ])\.(\s)?([А-ЯЁ][а-яё]+){_AFTER_NAME}", lambda c: "$1" + c.tag("$2. $4. $6") + "$7"), (rf"{_INITIAL}([А-ЯЁ][а-яё]+)(\s)([А-ЯЁ])\.(\s)?([А-ЯЁ])\.{_AFTER_NAME}", lambda c: "$1" + c.tag("$2 $4. $6.") + "$7"),
        (rf"{_INITIAL}([А-ЯЁ])\s([А-ЯЁ])\s([А-ЯЁ][а-яё]+){_AFTER_NAME}", lambda c: "$1" + c.tag("$2 $3 $4") + "$5"), (rf"{_INITIAL}([А-ЯЁ])([А-ЯЁ])\s([А-ЯЁ][а-яё]+){_AFTER_NAME}", lambda c: "$1" + c.tag("$2$3 $4") + "$5"),
        (rf"{_INITIAL}([А-ЯЁ][а-яё]+)\s([А-ЯЁ])\s([А-ЯЁ]){_AFTER_NAME}", lambda c: "$1" + c.tag("$2 $3 $4") + "$5"), (rf"{_INITIAL}([А-ЯЁ][а-яё]+)\s([А-ЯЁ])([А-ЯЁ]){_AFTER_NAME}", lambda c: "$1" + c.tag("$2 $3$4") + "$5"), ignore_case=False), need=(CAPITALS,)),
    Rule("nobr.nbsp_particle", _subs((r"( |\t)+(ли|бы|б|же|ж)\u{00A0}", f"{NBSP}$2 "), (r"( |\t)+(ли|бы|б|же|ж)(\.|,|:|;|…|\?|\s)", f"{NBSP}$2$3")), need=("лбжЛБЖ",)),
    Rule("nobr.nbsp_after_particle", _subs((r"(\s|^|\u{00A0}|>)([а-яё]+-(?:кась|тка|тко|ка|де))( )([а-яё]+)", f"$1$2{NBSP}$4")), need=("-", "ктдКТД")),
    Rule("nobr.nbsp_namely", _subs((r"как то:", f"как{NBSP}то:")), need=("тТ", ":")),
    Rule("nobr.nbsp_celsius", _subs((rf"(^|[{CONTENT_START}+±])(\d+)( |\u{{00A0}})?°[CС]@E", f"$1$2{NBSP}°C"), (rf"(^|[{CONTENT_START}+±])(\d+)( |\u{{00A0}})?°F@E", f"$1$2{NBSP}°F"), ignore_case=False), need=("°",)),
    Rule("nobr.nowrap_hyphen_short", _tagged((rf"(\s|>|^)({_SHORT_HYPHEN})(\s|\.|,|!|\?|…|$)", lambda c: "$1" + c.tag("$2") + "$3")), default=False, cycled=True, need=("-",)),
    Rule("nobr.nowrap_hyphen", _tagged((r"(\u{00A0}|\s|>|^)([a-zа-яё]+)((-([a-zа-яё]+)){1,2})(\s|\.|,|!|\?|\u{00A0}|…|$)", lambda c: "$1" + c.tag("$2$3") + "$6")), default=False, cycled=True, need=("-",)),
    Rule("date.year_range", _year_range, need=(D, DASHES), hint=r"\d{4}[-—−–]\d{4}"),
    Rule("date.month_range", _subs((rf"(?<![а-яёa-z])({_MONTH_CASES})-({_MONTH_CASES})(?![а-яёa-z])", "$1–$8")), need=("-", "аеАЕ")),
    Rule("date.day_month_range", _subs((rf"(\d{{1,2}}\s(?:{MONTHS}))-(\d{{1,2}}\s(?:{MONTHS}))", "$1–$2")), need=("-", D, "аяй")),
    Rule("date.nowrap_day_range", _tagged((rf"([^>]|^)(\d+)([-−—–])(\d+)( |\u{{00A0}})({MONTHS})([^<]|$)", lambda c: "$1" + c.tag("$2—$4 $6") + "$7")), default=False, need=(D, DASHES, "аяй")),
    Rule("date.nowrap_date", _tagged(
        (r"(\s|\u{00A0})([0-9]{2}\.[0-9]{2}\.([0-9]{2})?[0-9]{2})(\s|\u{00A0})?г\.", lambda c: "$1" + c.tag("$2 г.")), (r"(\s|\u{00A0})([0-9]{2}\.[0-9]{2}\.([0-9]{2})?[0-9]{2})(\s|\u{00A0})?г(\s|\u{00A0})", lambda c: "$1" + c.tag("$2 г.") + " "),
        (r"(\s|\u{00A0})([0-9]{2}\.[0-9]{2}\.([0-9]{2})?[0-9]{2})(\s|\u{00A0}(?!г\.)|\.(\s|\u{00A0}|$)|$)", lambda c: "$1" + c.tag("$2") + "$4")), need=(D, "."), hint=r"\d{2}\.\d{2}\.\d{2}"),
    Rule("date.nbsp_year_suffix", _subs((r'(^| |\u{00A0}|"|«)([0-9]{3,4})[ ]?(г\.)([^a-zа-яё]|$)', f"$1$2{NBSP}$3$4")), need=(D, "гГ")),
    Rule("hanging.quote", lambda ctx: chain([
        sub(r"([a-zа-яё-]{3,})( |\u{00A0}|\t)(«)", "$1" + ctx.tag("$2", "oa_oquote_sp_s") + ctx.tag("$3", "oa_oquote_sp_q")), sub(r"(\n|\r|^)(«)", "$1" + ctx.tag("$2", "oa_oquote_nl"))]), default=False, html_only=True, need=("«",)),
    Rule("hanging.bracket", lambda ctx: chain([
        sub(r"( |\u{00A0}|\t)\(", ctx.tag("$1", "oa_obracket_sp_s") + ctx.tag("(", "oa_obracket_sp_b")), sub(r"(\n|\r|^)\(", "$1" + ctx.tag("(", "oa_obracket_nl_b"))]), default=False, html_only=True, need=("(",)),
    Rule("other.acute_accent", _subs((r"([уеыаоэяиюёУЕЫАОЭЯИЮЁ])`(\p{L})", "$1\u0301$2"), ignore_case=False), need=("`",)),
    Rule("other.sup_word", lambda ctx: sub(r"(?<!\s)(\s+|^)\^([a-zа-яё0-9.:,-]+)(\s|$|\.$)", ctx.tag(ctx.tag("$2", "small"), "sup") + "$3"), html_only=True, need=("^",)),
    Rule("other.roman_range_dash", _subs((r"(^|[\s(])([XIV]{1,5})[-−]([XIV]{1,5})(?=[\s).,;:!?]|$)", "$1$2–$3"), ignore_case=False), need=("XIV", "-−")),
    Rule("other.en_century_range", _tagged((r"([\s(]|^)([XIV]{1,5})([-—–])([XIV]{1,5})(( |\u{00A0})?(в\.в\.|вв\.|вв|в\.|в)(?![а-яёa-z]))", lambda c: "$1" + c.tag("$2–$4 вв.")), ignore_case=False), need=("XIV", "-—–")),
    Rule("other.en_time_range", _tagged((r"(?<![\d>])(\d{1,2}:\d{2})([-—−–])(\d{1,2}:\d{2})([^\d<]|$)", lambda c: c.tag("$1–$3") + "$4"), ignore_case=False), need=(D, ":", DASHES)),
    Rule("other.split_triads", _split_triads, need=(D,), hint=r"\d{5}"),
    Rule("other.drop_nested_nowrap", _drop_nested, need=(OPEN,)),
    Rule("other.strip_nbsp_in_nowrap", _strip_nbsp, need=(OPEN,)),
    Rule("other.nbsp_in_nowrap", _nbsp_nowrap, default=False, need=(OPEN,)),
    Rule("text.autolink", layout.autolink, html_only=True, need=(":", "/")),
    Rule("text.email", layout.email, html_only=True, need=("@",)),
    Rule("text.deduplicate_words", lambda ctx: chain([sub(r"([а-яё]{3,})( |\t|\u{00A0})\1", "$1"), _dedup_second(ctx)]), default=False, html_only=True, need=("аеиоуыэяюёАЕИОУЫЭЯЮЁ",)),
    Rule("text.paragraphs", layout.paragraphs, html_only=True),
    Rule("text.breakline", layout.breakline, html_only=True),
)
BY_ID = {r.id: r for r in RULES}
GROUPS = tuple(dict.fromkeys(r.group for r in RULES))
