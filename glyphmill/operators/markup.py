"""Markdown and XML constructs that stay as they are.

Markdown is read in the order in which its constructs hide one another: code blocks by lines, reference definitions with the uses of their labels, inline constructs of which the one that
opens first wins, elements, link destinations, line prefixes, hard breaks and comments.
"""

from __future__ import annotations

import re

from . import protect
from .protect import Frame, Span

_BOUND = 8192
_BLANK = re.compile(r"[ \t]*(?:\r?\n|\Z)")
_QUOTE = re.compile(r"(?: {0,3}>[ \t]?)+")
_ITEM = re.compile(r"([ \t]*)(?:[-*+]|\d{1,9}[.)])(?=[ \t]|\r?\n|\Z)([ \t]*)")
_FENCE = re.compile(r"[ \t]*(`{3,}(?=[^`\n]*(?:\n|\Z))|~{3,})")
_HTML_OPEN = re.compile(r" {0,3}(?:<(script|pre|style|textarea)(?=[\s>]|\Z)|<!--)", re.I)


def _columns(space: str) -> int:
    n = 0
    for c in space:
        n += 4 - n % 4 if c == "\t" else 1
    return n


def _lines(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    while at < len(text):
        end = text.find("\n", at) + 1 or len(text)
        out.append((at, end))
        at = end
    return out


def _depth(prefix: str) -> int:
    return prefix.count(">")


def code_blocks(text: str) -> list[Span]:
    """Fenced and indented code, and HTML blocks that nothing closes. A fence ends at its closer, with its block quote, or with the text; four columns beyond the content of
    the list item around it make a line code after a blank line or more code."""
    lines = _lines(text)
    out: list[Span] = []
    items: list[int] = []  # content columns of the open list items
    blank, code, k = True, False, 0
    while k < len(lines):
        start, end = lines[k]
        quote = _QUOTE.match(text, start, end)
        at = quote.end() if quote else start
        deep = _depth(quote[0]) if quote else 0
        if _BLANK.match(text, at, end):
            blank, k = True, k + 1
            continue
        space = re.compile(r"[ \t]*").match(text, at, end)[0]
        column = _columns(space)
        while items and column < items[-1]:
            items.pop()
        base = items[-1] if items else 0
        fence = _FENCE.match(text, at, end)
        if fence and column - base < 4:
            mark, last = fence[1], k + 1
            stop = re.compile(rf"[ \t]*{mark[0]}{{{len(mark)},}}[ \t]*\r?\n?\Z")
            while last < len(lines):
                a, b = lines[last]
                q = _QUOTE.match(text, a, b)
                if (_depth(q[0]) if q else 0) < deep:
                    break
                last += 1
                if stop.match(text[q.end() if q else a : b]):
                    break
            finish = lines[last - 1][1]
            out.append((start, finish - (text[finish - 1 : finish] == "\n"), "B"))
            blank, code, k = True, False, last
            continue
        if column - base >= 4 and (blank or code):
            if code and out and not text[out[-1][1] : start].strip():
                out[-1] = (out[-1][0], end - (text[end - 1 : end] == "\n"), "B")
            else:
                out.append((start, end - (text[end - 1 : end] == "\n"), "B"))
            blank, code, k = False, True, k + 1
            continue
        html = _HTML_OPEN.match(text, at, end)
        if html and (text.find("-->", html.end()) < 0 if not html[1] else not re.compile(rf"</{html[1]}>", re.I).search(text, html.end())):
            out.append((start, len(text), "B"))
            return out
        inner = at
        while item := _ITEM.match(text, inner, end):
            width = item.end() - len(item[2]) - inner + (column if inner == at else base) - (len(item[1]) if inner == at else 0)
            gap = _columns(item[2])
            items.append(width + (gap if 1 <= gap <= 4 else 1))
            base, inner = items[-1], item.end()
            if not item[2]:
                break
        blank, code, k = False, False, k + 1
    return out


_DEFINITION = re.compile(
    r"^ {0,3}(?:>[ \t]?)*\[(?!\^)((?:[^\[\]\\]|\\.){1,999})\]:[ \t]*(?:\n[ \t]*)?(?:<[^<>\n]*>|[^\s<]\S*)(?:[ \t]+|[ \t]*\n[ \t]*)?(?:(?<=\s)(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*$", re.M
)
_BRACKETS = re.compile(r"(?<!\\)\[((?:[^\[\]\\]|\\.)+)\]")


def _label(text: str) -> str:
    return " ".join(text.split()).lower().upper().lower()


def references(text: str, opaque: list[Span]) -> list[Span]:
    """Definitions, and labels where they are used: both sides have to stay alike. Footnotes are prose."""
    if "]:" not in text:
        return []
    found = [m for m in _DEFINITION.finditer(text) if m[1].strip() and not protect.inside(opaque, m.start())]
    labels = {_label(m[1]) for m in found}
    out = [(m.start(), m.end(), "B") for m in found]
    for m in _BRACKETS.finditer(text):
        if protect.inside(out[: len(found)], m.start()) or protect.inside(opaque, m.start()) or _label(m[1]) not in labels:
            continue
        behind = text[m.end() : m.end() + 1]
        if behind == "(" or behind == "[" and (after := _BRACKETS.match(text, m.end())) and _label(after[1]) in labels:
            continue  # text of a link whose label or destination follows
        out.append((m.start(1), m.end(1), "B"))
    return sorted(out)


_TICKS = re.compile(r"`+")
_PARAGRAPH = re.compile(r"\n[ \t]*\n")


def code_spans(text: str) -> list[Span]:
    """Runs of backticks paired with the next run of the same length within the paragraph; an escaped run loses its first backtick."""
    if "`" not in text:
        return []
    out, base = [], 0
    for part in [*(m.end() for m in _PARAGRAPH.finditer(text)), len(text)]:
        runs = [[m.start(), m.end()] for m in _TICKS.finditer(text, base, part)]
        later: dict[int, list[int]] = {}
        for j in range(len(runs) - 1, -1, -1):
            later.setdefault(runs[j][1] - runs[j][0], []).append(j)
        k = 0
        while k < len(runs):
            a, b = runs[k]
            slashes = len(text[base:a]) - len(text[base:a].rstrip("\\"))
            width = b - a - slashes % 2
            queue = later.get(width, []) if width else []
            while queue and queue[-1] <= k:
                queue.pop()
            if queue:
                j = queue[-1]
                out.append((a + slashes % 2, runs[j][1], "B"))
                k = j
            k += 1
        base = part
    return out


def earliest(*lists: list[Span]) -> list[Span]:
    """Spans that overlap are parted by which opens first; what begins inside it is none."""
    out, at = [], 0
    for s in sorted(s for spans in lists for s in spans):
        if s[0] >= at:
            out.append(s)
            at = s[1]
    return out


_LINK = re.compile(r"\]\(")
_STRING = re.compile(r"\"(?:[^\"\\]|\\.)*+\"|'(?:[^'\\]|\\.)*+'", re.S)


def destinations(text: str) -> list[Span]:
    """What stands in the brackets behind a link's text: balanced, with a destination in angle brackets and a title as they are."""
    out, at = [], 0
    while m := _LINK.search(text, at):
        k, depth, stop, fresh = m.end(), 1, min(len(text), m.end() + _BOUND), True
        while k < stop and depth:
            c = text[k]
            if c == "\\":
                k += 2
                continue
            if c == "<" and fresh and 0 < (close := text.find(">", k, stop)) and "\n" not in text[k:close]:
                k = close + 1
                fresh = False
                continue
            if c in "\"'" and text[k - 1] in " \t\n" and (s := _STRING.match(text, k, stop)) and "\n\n" not in s[0]:
                k = s.end()
                continue
            if c == "\n" and _BLANK.match(text, k + 1):
                break
            depth += (c == "(") - (c == ")")
            fresh = fresh and c in " \t\n"
            k += 1
        at = m.end()
        if not depth and k - 1 > m.end():
            out.append((m.end(), k - 1, "B"))
            at = k
    return out


_PREFIX = re.compile(r"^[ \t]*(?:(?:(?:>|[-*+]|\d{1,9}[.)])[ \t]+|#{1,6}[ \t]+|>)+|(?<=[ \t])(?=[^\s]))", re.M)
_BREAK = re.compile(r"(?<=[^ \n]) {2,}(?=\r?\n)")


def mask_markdown(text: str, frame: Frame, dialect: str | None, safe_tags: tuple[str, ...]) -> str:
    text = frame.cover(text, code_blocks(text))
    expressions = protect.templates(text, dialect) if dialect else []
    tagged = bool(protect.HAS_TAG.search(text))
    inline = earliest(code_spans(text), expressions, protect.elements(text, safe_tags) if tagged else [], protect.comments(text) if tagged else [])
    text = frame.cover(text, earliest(references(text, inline), inline))
    if tagged:
        text = frame.cover(text, protect.elements(text, safe_tags))
    text = frame.cover(text, destinations(text))
    text = frame.cover(text, [(*m.span(), "B") for m in _PREFIX.finditer(text) if m[0]])
    text = frame.cover(text, [(*m.span(), "B") for m in _BREAK.finditer(text)])
    return frame.cover(text, protect.comments(text)) if tagged else text


# --- XML ---
_XML_TAG = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<(/?)([A-Za-z_:][^\s/<>]*)((?:[^<>\"'/]++|\"[^\"]*+\"|'[^']*+'|/(?!>))*+)(/?)>", re.S)
_PRESERVE = re.compile(r"\sxml:space\s*=\s*(?:\"preserve\"|'preserve')")
_DOCTYPE = re.compile(r"<!DOCTYPE(?:[^\[>\"']|\"[^\"]*\"|'[^']*')*(?:\[(?:<!--.*?-->|<\?.*?\?>|\"[^\"]*\"|'[^']*'|[^\]\"'])*\](?:[^>\"'])*)?>", re.S)
_CONSTRUCTS = (re.compile(r"<!--(.*?)-->", re.S), re.compile(r"<!\[CDATA\[(.*?)\]\]>", re.S), re.compile(r"<\?(.*?)\?>", re.S))
_REFERENCE = re.compile(r"&(?:#[0-9]+|#x[0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def xml_tags(text: str):
    """(match, opens, closes) of each tag of the document, leaving out comments, CDATA sections and processing instructions."""
    at = 0
    while m := _XML_TAG.search(text, at):
        at = m.end()
        if m[2] is None:
            continue
        yield m, not m[1], bool(m[1] or m[4])


def preserved(text: str) -> list[Span]:
    """Outermost elements with xml:space="preserve", by a stack of the open elements."""
    if "xml:space" not in text:
        return []
    out, depth, since = [], 0, None
    for m, opens, closes in xml_tags(text):
        if opens:
            if since is None and _PRESERVE.search(m[3]):
                since = (m.start(), depth)
            depth += 1
        if closes:
            depth -= 1
            if since and depth == since[1]:
                out.append((since[0], m.end(), "B"))
                since = None
    return out


def mask_xml(text: str, frame: Frame) -> str:
    text = frame.cover(text, preserved(text))
    if "<!DOCTYPE" in text:
        text = frame.cover(text, [(*m.span(), "B") for m in _DOCTYPE.finditer(text)])
    if "<!" in text or "<?" in text:
        text = frame.cover(text, earliest(*([(*m.span(), "B") for m in p.finditer(text)] for p in _CONSTRUCTS)))
    return frame.cover(text, [(*m.span(), "B") for m in _REFERENCE.finditer(text)]) if "&" in text else text
