"""Rules that write markup: links, paragraphs and line breaks, and what becomes of the tokens of emitted markup at the end.

Paragraphs are laid over the top level of a document: outermost block-level elements are items of their own, blank lines outside inline elements part segments, and what lies inside an element
of the author's stays as it is. Author paragraphs are lifted to the same marks first, and what stands in front of the first and behind the last is laid out apart.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.rx import CLOSE, NBSP, OPEN, SPACES, mapped, sub
from .protect import BLOCK_TAGS, VOID_TAGS, excess

POP, PCL, BR = "\ue100POP\ue101", "\ue100PCL\ue101", "\ue100BR\ue101"
_MARK = rf"{OPEN}[TAL]\d+{CLOSE}"
#: Styles of emitted classes, and elements that a start tag closes.
STYLES = {
    "nowrap": "white-space:nowrap;", "oa_obracket_sp_s": "margin-right:0.3em;", "oa_obracket_sp_b": "margin-left:-0.3em;", "oa_obracket_nl_b": "margin-left:-0.3em;",
    "oa_oquote_nl": "margin-left:-0.44em;", "oa_oquote_sp_s": "margin-right:0.44em;", "oa_oquote_sp_q": "margin-left:-0.44em;",
}
_ROWS, _PARTS = {"td", "th", "tr"}, {"td", "th", "tr", "thead", "tbody", "tfoot"}
IMPLIED_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": _ROWS, "thead": _PARTS, "tbody": _PARTS, "tfoot": _PARTS}
_BLOCKS = BLOCK_TAGS | {"hr", "html", "head", "body"}


# --- links ---
def autolink(ctx):
    """Addresses become links whose text is the address without its scheme; a final period or unbalanced bracket stays outside."""

    def link(m: re.Match) -> str:
        core = m[0].rstrip(".")
        core = core[: len(core) - excess(core)]
        return f'<a href="{core}">{re.sub(r"^[a-zA-Z]+://", "", core)}</a>{m[0][len(core):]}'

    return mapped(r"(?<![^\s])(?:http|ftp|mailto|https):\/\/[^\s,!<>\"'\u{E000}\u{E001}\u{E100}\u{E101}]{4,}(?=\s|\.|,|!|\?|<|$)", link)


def email(ctx):
    return sub(r"(?<![^\s(])([a-z0-9\-_.]{2,}@[a-z0-9\-.]{2,}\.[a-z]{2,6})(?=\)|\s|\.|,|!|\?|$|<)", '<a href="mailto:$1">$1</a>')


# --- the tags of a text ---
_ANY_TAG = re.compile(rf"<(/?)({_MARK})>|{POP}({_MARK})|({_MARK}){PCL}")


def _tags(text: str, names: dict[str, tuple[str, bool]]):
    """(start, end, name, opens) of every tag that opens or closes an element, in order."""
    if not names:
        return
    for m in _ANY_TAG.finditer(text):
        named = names.get(m[2] or m[3] or m[4])
        if named is None:
            continue
        name, slash = named
        opens = bool(m[3]) or m[2] is not None and not m[1]
        if opens and slash and name in ("svg", "math"):
            continue
        yield m.start(), m.end(), name, opens


def _shut(stack: list[str], name: str) -> bool:
    """Closes the nearest open element of that name and all inside it; False if none is open."""
    if name not in stack:
        return False
    while stack.pop() != name:
        pass
    return True


def lift_paragraphs(text: str, names: dict[str, tuple[str, bool]]) -> str:
    """Author paragraph tags to marks of paragraphs that keep their own tag."""
    if not any(n == "p" for n, _ in names.values()):
        return text
    return re.sub(rf"<(/?)({_MARK})>", lambda m: m[0] if names.get(m[2], ("",))[0] != "p" else f"{m[2]}{PCL}" if m[1] else f"{POP}{m[2]}", text)


# --- paragraphs ---
@dataclass
class _Item:
    text: str
    kind: str  # "prose", "gap" or "block"
    opens: bool = False
    closed: bool = False
    wrapped: bool = False  # inside an inline element

    @property
    def solid(self) -> bool:
        return self.kind == "block" or self.kind == "prose" and bool(self.text.strip(SPACES))


_GAP, _GAP_HINT = re.compile(r"(?<![ \t])[ \t]*\n+[ \t]*\n+"), re.compile(r"\n[ \t]*\n")


def _items(text: str, names: dict) -> tuple[list[_Item], bool]:
    """Items of the top level, and whether an inline element is open at the end."""
    out: list[_Item] = []
    inline: list[str] = []
    block: list[str] = []
    at = start = 0
    wrapped = False

    def prose(end: int) -> None:
        """Text up to `end`, parted by its blank lines; those inside an inline element were taken out of `gaps`."""
        nonlocal at
        for a, b in gaps:
            if at <= a and b <= end:
                if a > at:
                    out.append(_Item(text[at:a], "prose"))
                out.append(_Item(text[a:b], "gap"))
                at = b
        gaps.clear()
        if end > at:
            out.append(_Item(text[at:end], "prose"))
        at = end

    gaps: list[tuple[int, int]] = []
    seen = 0

    def look(end: int) -> None:
        nonlocal seen
        if not inline and not block and _GAP_HINT.search(text, seen, end):
            for m in _GAP.finditer(text, seen, end):
                lead = len(m[0]) - len(m[0].lstrip(" \t"))
                gaps.append((m.start() + lead, m.end()))
        seen = end

    for a, b, name, opens in _tags(text, names):
        look(a)
        seen = b
        if name in _BLOCKS:
            if opens:
                if len(block) == 1 and block[0] in IMPLIED_ENDS.get(name, ()):
                    out.append(_Item(text[start:a], "block", True, True, wrapped))
                    at, block = a, []
                if not block:
                    prose(a)
                    start, wrapped = a, bool(inline)
                    if name == "hr":
                        out.append(_Item(text[a:b], "block", False, False, wrapped))
                        at = b
                        continue
                block.append(name)
            elif block and _shut(block, name) and not block:
                out.append(_Item(text[start:b], "block", True, True, wrapped))
                at = b
        elif name not in VOID_TAGS and not block:
            if opens:
                inline.append(name)
            else:
                _shut(inline, name)
    if block:
        out.append(_Item(text[start:], "block", True, text.rstrip(SPACES).endswith(">"), wrapped))
    else:
        look(len(text))
        prose(len(text))
    return out, bool(inline)


def _edges(s: str) -> tuple[str, str, str]:
    core = s.strip(" \t\n")
    lead = len(s) - len(s.lstrip(" \t\n"))
    return s[:lead], core, s[lead + len(core) :]


def _kept(edge: str) -> str:
    return edge if "\n" in edge else ""


def _rebound(core: str) -> str:
    """A dash that the rules bound to the word in front of the block opens this paragraph instead."""
    back = f"{NBSP}— "
    return f"—{NBSP}{core[len(back):]}" if core.startswith(back) else core


def _segment(items: list[_Item], first: bool, last: bool) -> str:
    if any(i.wrapped for i in items):
        return "".join(i.text for i in items)
    if all(i.kind == "prose" for i in items):
        lead, core, trail = _edges("".join(i.text for i in items))
        if not core:
            return ""
        inner = f"{'' if first else lead}{core}{'' if last else trail}"
        return f"{_kept(lead) if first else ''}{POP}{inner}{PCL}{_kept(trail) if last else ''}"
    solid = [k for k, i in enumerate(items) if i.solid]
    items = items[solid[0] : solid[-1] + 1]
    bare = items[0].opens and items[-1].closed
    out = []
    for k, i in enumerate(items):
        if i.kind == "block" or bare:
            out.append(i.text)
            continue
        lead, core, trail = _edges(i.text)
        if not core:
            out.append("\n")
            continue
        before = "\n" if k else _kept(lead) if first else ""
        after = "\n" if k < len(items) - 1 else _kept(trail) if last else ""
        out.append(f"{before}{POP}{_rebound(core) if k else core}{PCL}{after}")
    return "".join(out)


def _chunk(raw: str, names: dict, gap: str, head: bool = False) -> tuple[str, str]:
    """A stretch without author paragraphs laid out, and what goes between it and an author paragraph beside it."""
    text = raw.strip(SPACES)
    if not text:
        return "", ""
    items, unclosed = _items(text, names)
    segments: list[list[_Item]] = [[]]
    for i in items:
        if i.kind == "gap":
            segments.append([])
        else:
            segments[-1].append(i)
    segments = [s for s in segments if s] or [[]]
    inside = head and (unclosed or items and items[-1].kind == "block" and not items[-1].closed)
    if head and unclosed and segments[-1]:
        segments[-1][-1].wrapped = True
    out, was = [], False
    for k, s in enumerate(segments):
        as_is = any(i.wrapped for i in s)
        if k:
            out.append("\n\n" if was or as_is else gap)
        out.append(_segment(s, k == 0, k == len(segments) - 1))
        was = as_is
    facing = raw[len(raw.rstrip(SPACES)) :] if head else raw[: len(raw) - len(raw.lstrip(SPACES))]
    return "".join(out), facing if inside else "\n"


def _open_at(text: str, names: dict) -> list[str]:
    stack: list[str] = []
    for _, _, name, opens in _tags(text, names):
        if name in VOID_TAGS:
            continue
        if opens:
            stack.append(name)
        else:
            _shut(stack, name)
    return stack


_TAIL = re.compile(rf"(?:<{OPEN}[TA]\d+{CLOSE}>|<!--)?{OPEN}[EF]\d+{CLOSE}")


def _before_tail(text: str, body) -> str:
    """body over the text in front of what is left open to the end; nothing is written inside or behind that."""
    m = _TAIL.search(text) if f"{OPEN}E" in text or f"{OPEN}F" in text else None
    if not m:
        return body(text, False)
    head = text[: m.start()]
    core = head.rstrip(SPACES)
    return body(core, True) + text[len(core) :]


def paragraphs(ctx):
    def lay(text: str, runs_on: bool) -> str:
        names, gap = ctx.frame.tag_names(), ctx.frame.put("H", "\n\n")
        first, last = text.find(POP), text.rfind(PCL)
        if runs_on and first >= 0 and text.rfind(POP) > last:
            done, sep = _chunk(text[:first], names, gap, True)
            return done + sep + text[first:]
        if not 0 <= first < last:
            return _chunk(text, names, gap)[0]
        end = last + len(PCL)
        done, sep = _chunk(text[:first], names, gap, True)
        rest, kept = text[end:], ""
        if rest.strip(SPACES) and (stack := _open_at(text[:end], names)):
            cut = 0  # what closes the elements open around the author's paragraph, and what stands in front of it, stays
            for a, b, name, opens in _tags(rest, names):
                if name in VOID_TAGS:
                    continue
                if opens:
                    stack.append(name)
                elif _shut(stack, name):
                    cut = b
                if not stack:
                    break
            kept, rest = (rest[:cut], rest[cut:]) if not stack else (rest, "")
        tail, behind = _chunk(rest, names, gap)
        return done + sep + text[first:end] + kept + behind + tail

    return lambda t: _before_tail(t, lay)


# --- line breaks ---
_BETWEEN = re.compile(rf"({PCL})([\r\n \t]+)({POP})")


def _stretches(text: str, names: dict) -> list[tuple[int, int]]:
    """Stretches outside elements that hold a line break, with the outer tags of those elements."""
    out, stack, at, inner = [], [], 0, 0
    for a, b, name, opens in _tags(text, names):
        if name in VOID_TAGS:
            continue
        if opens:
            if not stack:
                inner = b
            stack.append(name)
        elif _shut(stack, name) and not stack and "\n" in text[inner:a]:
            out.append((at, inner))
            at = a
    out.append((at, inner if stack else len(text)))
    return out


def breakline(ctx):
    """Single line ends become breaks, but not beside block-level tags, paragraphs or another break, where a blank line stands."""

    def lay(text: str, _: bool) -> str:
        if "\n" not in text and PCL not in text:
            return text
        names, put = ctx.frame.tag_names(), lambda s: ctx.frame.put("H", s)
        blocks = "|".join(m for m, (n, _) in names.items() if n in _BLOCKS)
        breaks = "|".join(m for m, (n, _) in names.items() if n == "br")
        has_breaks = BR in text

        def top(part: str) -> str:
            part = _BETWEEN.sub(lambda m: m[1] + put("\n\n" if "\n" in m[2] or "\r" in m[2] else m[2]) + m[3], part)
            if blocks:
                part = re.sub(rf"(?<![ \t])[ \t]*[\r\n][\r\n \t]*(?=</?(?:{blocks})>)", lambda m: put("\n\n"), part)
                part = re.sub(rf"(</?(?:{blocks})>)[ \t]*[\r\n][\r\n \t]*", lambda m: m[1] + put("\n\n"), part)
            if has_breaks:
                return part
            if breaks:
                return re.sub(rf"(<(?:{breaks})>)?\n", lambda m: m[0] if m[1] else f"{BR}\n", part)
            return part.replace("\n", f"{BR}\n")

        parts, at = [], 0
        for a, b in _stretches(text, names):
            parts += [text[at:a], top(text[a:b])]
            at = b
        return "".join(parts) + text[at:]

    return lambda t: _before_tail(t, lay)


# --- the end ---
_OWN_P = re.compile(rf"{POP}({_MARK})|({_MARK}){PCL}")


def restore_paragraphs(t: str) -> str:
    if "\ue100" not in t:
        return t
    if OPEN in t:
        t = _OWN_P.sub(lambda m: f"<{m[1]}>" if m[1] else f"</{m[2]}>", t)
    return t.replace(POP, "<p>").replace(PCL, "</p>").replace(BR, "<br>")


_NAMES = "|".join(sorted(BLOCK_TAGS))
_AROUND_BLOCK = re.compile(rf"<p>(\s*)(<(?:{_NAMES})\b[^>]*>(?:(?!</p>)[\s\S])*?</(?:{_NAMES})>)(\s*)</p>|<p>(\s*)(<hr\b[^>]*/?>)(\s*)</p>", re.I)


_AROUND_HINT = re.compile(r"<[pP]>\s*<")


def unwrap(t: str) -> str:
    """A plain paragraph directly around a block-level element goes."""
    while _AROUND_HINT.search(t):
        new = _AROUND_BLOCK.sub(lambda m: m[2] or m[5], t)
        if new == t:
            break
        t = new
    return t


def emitted(t: str, layout: str, nowrap: str, prefix: str) -> str:
    """Tokens of markup that rules wrote, back to tags."""
    from .rules import TOKENS

    if f"{OPEN}T9" not in t:
        return t
    for kind, (start, end) in TOKENS.items():
        if start not in t and end not in t:
            continue
        if kind in ("small", "sub", "sup"):
            a, b = f"<{kind}>", f"</{kind}>"
        elif kind == "nowrap" and nowrap == "nobr":
            a, b = "<nobr>", "</nobr>"
        else:
            attrs = (f' class="{prefix}{kind}"' if layout in ("class", "both") else "") + (f' style="{STYLES[kind]}"' if layout in ("style", "both") else "")
            a, b = f"<span{attrs}>", "</span>"
        t = t.replace(f"<{start}>", a).replace(f"</{end}>", b)
    return t
