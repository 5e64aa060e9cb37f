"""What stays as it is: addresses and identifiers, elements, comments, indents, template expressions, tags and blocks of the user's own give way to marks, and come back at the end.

A mark is U+E000, the letters of its kind, a number and U+E001; equal contents share a number. None can be in a text already, since those characters are escaped first (see reserved).
Addresses are marked by words that rules read as addresses; those words hold a nonce that the text doesn't.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable

from ..functions import glyphs
from ..functions.rx import CLOSE, OPEN, SPACES, compiled

Span = tuple[int, int, str]

#: Block-level elements, those without an end, and elements whose content stays as it is: up to their first closer, or as pairs; and those that show nothing.
BLOCK_TAGS = frozenset(
    "blockquote ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption aside section article header footer nav main menu dialog h1 h2 h3 h4 h5 h6 div form fieldset address details summary pre".split()
)
BOUNDARY_TAGS = BLOCK_TAGS | {"hr", "p", "br"}
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS, PAIRED_TAGS, HIDDEN_TAGS = ("script", "style", "textarea"), ("pre", "code", "kbd", "samp", "var", "tt"), frozenset(("script", "style"))
#: Tags that leave foreign content, and elements of it that hold HTML again.
BREAKOUT_TAGS = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
HTML_POINTS = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
#: Delimiters of template dialects, the longer first.
TEMPLATES = {
    "handlebars": (("{{{", "}}}"), ("{{!--", "--}}"), ("{{", "}}")), "mustache": (("{{{", "}}}"), ("{{", "}}")), "twig": (("{{", "}}"), ("{%", "%}"), ("{#", "#}")), "jinja": (("{{", "}}"), ("{%", "%}"), ("{#", "#}")),
    "nunjucks": (("{{", "}}"), ("{%", "%}"), ("{#", "#}")), "liquid": (("{{", "}}"), ("{%", "%}")), "erb": (("<%", "%>"),),
}
TEMPLATE_BOUND = 8192
MARK = re.compile(f"{OPEN}([A-Za-z]+)(\\d+){CLOSE}")
TAG_MARK = re.compile(f"<(/?){OPEN}([TAL])(\\d+){CLOSE}>")


class Frame:
    """The marks of one text and what they stand for."""

    def __init__(self):
        self.held: dict[str, list[str]] = {}
        self.known: dict[tuple[str, str], int] = {}

    def put(self, kind: str, content: str) -> str:
        k = self.known.get((kind, content))
        if k is None:
            held = self.held.setdefault(kind, [])
            k = self.known[(kind, content)] = len(held)
            held.append(content)
        return f"{OPEN}{kind}{k}{CLOSE}"

    def cover(self, text: str, spans: Iterable[Span]) -> str:
        parts, at = [], 0
        for start, end, kind in spans:
            if start >= at and end > start:
                parts += [text[at:start], self.put(kind, text[start:end])]
                at = end
        return "".join(parts) + text[at:] if parts else text

    def _content(self, m: re.Match) -> str:
        held = self.held.get(m[1], ())
        return held[int(m[2])] if int(m[2]) < len(held) else m[0]

    def restored(self, text: str, kinds: str) -> str:
        """Marks of these kinds back to their contents, also those inside contents."""
        if not any(k in self.held for k in kinds):
            return text
        pattern = re.compile(f"{OPEN}([{kinds}])(\\d+){CLOSE}")
        while True:
            new = pattern.sub(self._content, text)
            if new == text:
                return new
            text = new

    def tags_restored(self, text: str) -> str:
        def back(m: re.Match) -> str:
            held = self.held.get(m[2], ())
            return f"<{m[1]}{held[int(m[3])]}>" if int(m[3]) < len(held) else m[0]

        return TAG_MARK.sub(back, text) if OPEN in text else text

    def tag_names(self) -> dict[str, tuple[str, bool]]:
        """Mark to (name in lower case, whether a slash ends the tag)."""
        out = {}
        for kind in "TAL":
            for k, content in enumerate(self.held.get(kind, ())):
                if m := _TAG_NAME.match(content):
                    out[f"{OPEN}{kind}{k}{CLOSE}"] = (m[0].lower(), content.endswith("/"))
        return out


# --- addresses and identifiers ---
#: Patterns of sequences.
_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
_URL = compiled(_EDGE + r"(?:(?:https?|ftps?|mailto):(?:\/{1,3}|[a-z0-9%])|www\d{0,3}[.]|[a-z0-9.-]{1,253}[.][a-z]{2,24}\/)[^\s<>\"'`]*[^\s`!\[\]{};:'\".,<>?«»“”‘’]", True)
_SCHEME, _WWW, _ZONE = re.compile(r"(?:https?|ftps?|mailto)\Z", re.I), re.compile(r"www\d{0,3}\.", re.I), re.compile(r"\.[a-z]{2,24}/", re.I)
_LOCAL = compiled(r"[\p{L}0-9!#$%&'*+/=?^_`{|}~.-]+$")
_DOMAIN = compiled(r"[\p{L}0-9.-]+\.[\p{L}0-9-]{2,}")
_LOCAL_MOST = 254
_UUID = re.compile(r"(?<![a-zA-Z0-9])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![a-zA-Z0-9])")
#: What every UUID holds.
_UUID_HINT = re.compile(r"-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-")
_IPV6 = re.compile(
    r"(?<![a-zA-Z0-9:])\[?(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,7}:(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4})*)?|::(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4})*))\]?(?::\d{1,5})?(?:\/\d{1,3})?(?![a-zA-Z0-9])"
)
_HOST = "glyphmill-xyz"


def excess(address: str) -> int:
    """Closing brackets at the end of an address that nothing in it opens."""
    trailing = len(address) - len(address.rstrip(")"))
    return max(0, min(trailing, address.count(")") - address.count("(")))


def url_likely(t: str) -> bool:
    """Whether a scheme, `www` or a host before a slash is there; found from the rare character in each, not by a pattern tried at every place."""
    at = t.find(":")
    while at >= 0:
        if t[at - 1] in "spoSPOſ" and _SCHEME.search(t, max(0, at - 6), at):
            return True
        at = t.find(":", at + 1)
    return "." in t and ("/" in t and bool(_ZONE.search(t)) or ("ww" in t or "WW" in t or "wW" in t or "Ww" in t) and bool(_WWW.search(t)))


def uuid_likely(t: str) -> bool:
    return bool(_UUID_HINT.search(t))


def may_hold_sequences(t: str) -> bool:
    return "@" in t or (":" in t or "." in t) and (url_likely(t) or "::" in t or t.count(":") > 6) or "-" in t and uuid_likely(t)


class Sequences:
    """Addresses and identifiers of one text, behind words that hold a nonce."""

    def __init__(self, text: str):
        nonce = "q"
        while f"SAFE{nonce}" in text:
            nonce += "q"
        self.nonce, self.held = nonce, {"0": [], "1": [], "u": [], "v": []}

    def _word(self, kind: str, content: str) -> str:
        held = self.held[kind]
        held.append(content)
        body = f"A{kind}SAFE{self.nonce}{len(held) - 1}"
        return f"http://{_HOST}/{body}ID" if kind == "0" else f"{body}ID@glyphmill.xyz" if kind == "1" else f"{body}TK"

    def masked(self, t: str) -> str:
        if url_likely(t):

            def url(m: re.Match) -> str:
                more = excess(m[0])
                return self._word("0", m[0][: len(m[0]) - more]) + ")" * more

            t = _URL.sub(url, t)
        if "@" in t:
            t = self._emails(t)
        if uuid_likely(t):
            t = _UUID.sub(lambda m: self._word("u", m[0]), t)
        if "::" in t or t.count(":") > 6:
            t = _IPV6.sub(lambda m: self._word("v", m[0]), t)
        return t

    def _emails(self, t: str) -> str:
        parts, at = [], 0
        for m in re.finditer("@", t):
            sign = m.start()
            if sign < at:
                continue
            local = _LOCAL.search(t, max(at, sign - _LOCAL_MOST), sign)
            domain = _DOMAIN.match(t, sign + 1)
            if local and domain:
                parts += [t[at : local.start()], self._word("1", t[local.start() : domain.end()])]
                at = domain.end()
        return "".join(parts) + t[at:] if parts else t

    def restored(self, t: str) -> str:
        if f"SAFE{self.nonce}" not in t:
            return t
        for kind in "vu1":
            if self.held[kind]:
                end = "ID@glyphmill\\.xyz" if kind == "1" else "TK"
                t = re.sub(f"A{kind}SAFE{self.nonce}(\\d+){end}", lambda m: self._at(kind, m), t)  # noqa: B023
        if self.held["0"]:
            t = re.sub(f"(http://)?{_HOST}/A0SAFE{self.nonce}(\\d+)ID", self._url, t)
        return t

    def _at(self, kind: str, m: re.Match) -> str:
        return self.held[kind][int(m[1])] if int(m[1]) < len(self.held[kind]) else m[0]

    def _url(self, m: re.Match) -> str:
        if int(m[2]) >= len(self.held["0"]):
            return m[0]
        whole = self.held["0"][int(m[2])]
        return whole if m[1] else re.sub(r"^[^:]+://", "", whole)  # a link shows its address without the scheme


# --- tags ---
_S = r" \t\n\r\f"
_START = re.compile(r"</?[a-zA-Z!?]")
_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_END = re.compile(rf"[^{_S}/>]*+(?:[{_S}/]++|[^{_S}/>][^=/>]*+(?:=[{_S}]*+(?:\"[^\"]*+\"|'[^']*+'|[^{_S}>\"'][^{_S}>]*+|(?=>))|(?!=)))*+>")
_NOTG = re.compile(r"<notg(?:\s(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)?>([\s\S]*?)</notg>", re.I)
_COMMENT = re.compile(r"<!--(?:-?>|(.*?)-->)", re.S)
_TAG = re.compile(r"</?[a-zA-Z](?:[^\"'<>]++|\"[^\"]*+\"|'[^']*+')*+>|<[!?][^>]*>")
#: What a text needs for any of the scans below.
HAS_TAG = re.compile("<[a-zA-Z/!?]")


def inside(spans: list, at: int) -> bool:
    """Whether `at` lies in one of the ascending, disjoint spans."""
    k = bisect_right(spans, at, key=lambda s: s[0]) - 1
    return k >= 0 and at < spans[k][1]


class Tags:
    """One pass over a document's tags: by name their (start, end, opens), the start of a tag that never ends or -1, and the starts of comments that never end.

    A raw element's tags are skipped up to its closer. In SVG and MathML a slash ends an element and nothing is raw; where it is in doubt, a tag is read as HTML.
    """

    def __init__(self, text: str, xml: bool = False):
        self.by_name: dict[str, list[tuple[int, int, bool]]] = {}
        self.unended, self.open_comments = -1, []
        absent: set[str] = set()
        foreign: list[str] = []  # open elements from the outermost svg or math on; an HTML point among them means HTML
        at, dashes = 0, 0
        while m := _START.search(text, at):
            start = m.start()
            if text.startswith("<!--", start):
                empty = re.compile(r"-?>").match(text, start + 4)
                if empty:
                    at = empty.end()
                    continue
                if -1 < dashes < start + 4:
                    dashes = text.find("-->", start + 4)
                if dashes == -1:
                    self.open_comments.append(start)
                    at = start + 1
                else:
                    at = dashes + 3
                continue
            strange = bool(foreign) and foreign[-1] not in HTML_POINTS
            if strange and text.startswith("<![CDATA[", start) and (close := text.find("]]>", start)) >= 0:
                at = close + 3
                continue
            if text[m.end() - 1] in "!?":
                end = text.find(">", start) + 1
            else:
                found = _END.match(text, m.end() - 1)
                end = found.end() if found else 0
            if not end:
                self.unended = start
                return
            at = end
            named = _TAG_NAME.match(text, m.end() - 1, end)
            if not named:
                continue
            name, opens, slash = named[0].lower(), text[start + 1] != "/", text[end - 2] == "/"
            if strange and opens and name in BREAKOUT_TAGS:
                foreign.clear()
                strange = False
            if opens:
                if not slash and (foreign or name in ("svg", "math")):
                    foreign.append(name)
            elif name in foreign:
                while foreign.pop() != name:
                    pass
            if (strange or xml) and opens and slash:
                continue
            if opens or not text[named.end() : end - 1].strip(" \t\n\r\f"):
                self.by_name.setdefault(name, []).append((start, end, opens))
            if opens and name in RAW_TAGS and not xml and not strange and name not in absent:
                closer = re.compile(rf"</{name}(?=[{_S}/>])", re.I).search(text, end)
                if closer:
                    at = closer.start()
                else:
                    absent.add(name)


def _pairs(events: list[tuple[int, int, bool]], raw: bool) -> tuple[list[tuple[int, int, int, int]], tuple[int, int] | None]:
    """Outermost elements as (start, end, end of the opener, start of the closer), and the opener of the outermost one that is never closed."""
    found, stack = [], []
    for start, end, opens in events:
        if opens:
            if not (raw and stack):
                stack.append((start, end))
        elif stack:
            first = stack.pop()
            if not stack:
                found.append((first[0], end, first[1], start))
    return found, stack[0] if stack else None


def elements(text: str, extra: tuple[str, ...] = (), xml: bool = False, document: bool = False) -> list[Span]:
    """Contents that stay: (start, end, kind) in order, B of an element, N of one that shows nothing; in a document at most one E or F from what is left open to the end."""
    tags = Tags(text, xml)
    cover: list[tuple[int, int, int, int]] = []
    opaque = [m.span() for m in _NOTG.finditer(text)] if document else []
    left_open: list[tuple[int, int, bool]] = []
    own = tuple(t.lower() for t in extra)
    for name in (*RAW_TAGS, *PAIRED_TAGS, *own):
        events = [e for e in tags.by_name.get(name, ()) if not inside(cover, e[0])]
        if name in own:  # the user's own may be empty by a slash
            events = [e for e in events if not (e[2] and text[e[1] - 2] == "/")]
        raw = name in RAW_TAGS and not xml
        found, first = _pairs(events, raw)
        if first and opaque:
            first = _pairs([e for e in events if not inside(opaque, e[0])], raw)[1]
        if first:
            left_open.append((*first, name in HIDDEN_TAGS))
        if found:
            cover = sorted([c for c in cover if not inside(found, c[0])] + found)
    hidden = {e[0] for name in HIDDEN_TAGS for e in tags.by_name.get(name, ())}
    out = [(b, c, "N" if a in hidden or glyphs.shows_nothing(text[b:c]) else "B") for a, _, b, c in cover if c > b]
    if document:
        left_open += [(c, c + 4, False) for c in tags.open_comments if not inside(opaque, c)]
        if tags.unended >= 0 and not inside(opaque, tags.unended):
            left_open.append((tags.unended, tags.unended, False))
        left_open = [f for f in left_open if not inside(cover, f[0])]
        if left_open:
            start, at, quiet = min(left_open)
            out = [s for s in out if s[1] <= start]
            if at < len(text):
                out.append((at, len(text), "F" if quiet or start == at or glyphs.shows_nothing(text[at:]) else "E"))
    return out


def comments(text: str) -> list[Span]:
    """Contents of closed comments; they show nothing."""
    return [(m.start(1), m.end(1), "N") for m in _COMMENT.finditer(text) if m[1]]


_INDENT = re.compile(r"(?:(?<=[\n\r])|\A)[ \t]++(?=[^\n\r])")


def indents(text: str) -> list[Span]:
    if text[:1] not in (" ", "\t") and "\n " not in text and "\n\t" not in text and ("\r" not in text or "\r " not in text and "\r\t" not in text):
        return []
    return [(*m.span(), "W") for m in _INDENT.finditer(text)]


def lifted(text: str) -> str:
    """Each masked indent on a line of its own while the rules run, so that its content opens a line for them."""
    return re.sub(f"\n({OPEN}W\\d+{CLOSE})", r"\n\1\n", text)


def settled(text: str, frame: Frame) -> str:
    """Lifted indents back in front of their content as white space; one whose line break a rule took stays a mark."""
    held = frame.held.get("W")
    return re.sub(f"\n{OPEN}W(\\d+){CLOSE}\n", lambda m: "\n" + held[int(m[1])], text) if held else text


def notg(text: str, frame: Frame) -> str:
    """The content of <notg> stays, its tags go."""
    return _NOTG.sub(lambda m: frame.put("H" if glyphs.shows_nothing(m[1]) else "I", m[1]) if m[1] else "", text) if "<notg" in text.lower() else text


def tag_masked(text: str, frame: Frame) -> str:
    def mark(m: re.Match) -> str:
        closing = m[0][1] == "/"
        content = m[0][2 if closing else 1 : -1]
        named = _TAG_NAME.match(content)
        name = named[0].lower() if named else ""
        kind = "A" if name == "a" else "L" if name in BOUNDARY_TAGS else "T"
        return f"<{'/' if closing else ''}{frame.put(kind, content)}>"

    return _TAG.sub(mark, text)


# --- templates and blocks of the user's own ---
def templates(text: str, dialect: str) -> list[Span]:
    """Expressions with their delimiters. Strings inside may hold the closer; one that isn't closed within TEMPLATE_BOUND characters is none."""
    pairs = TEMPLATES[dialect]
    opener = re.compile("|".join(re.escape(a) for a, _ in pairs))
    closers = {a: re.compile(rf"\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|({re.escape(b)})") for a, b in pairs}
    ends, ahead = dict(pairs), {}
    out, at = [], 0
    while m := opener.search(text, at):
        limit = min(len(text), m.end() + TEMPLATE_BOUND)
        if m[0] not in ahead or -1 < ahead[m[0]] < m.end():  # the next closer of any kind, looked for once a stretch
            ahead[m[0]] = text.find(ends[m[0]], m.end())
        end = -1
        if -1 < ahead[m[0]] < limit:
            end = next((c.end() for c in closers[m[0]].finditer(text, m.end(), limit) if c[1]), -1)
        if end < 0:
            at = m.end()
        else:
            out.append((m.start(), end, "B"))
            at = end
    return out


def own_block(opened: str, closed: str) -> Callable[[str], list[Span]]:
    """Contents between two delimiters, which are plain text or, within slashes, patterns."""
    plain = lambda d: d[1:-1] if len(d) > 2 and d[0] == d[-1] == "/" else re.escape(d)
    start, stop = re.compile(plain(opened)), re.compile(plain(closed))

    def scan(text: str) -> list[Span]:
        out, at = [], 0
        while (a := start.search(text, at)) and (b := stop.search(text, a.end())):
            if b.start() > a.end():
                out.append((a.end(), b.start(), "B"))
            at = max(b.end(), a.end() + 1)
        return out

    return scan


def trimmed(text: str) -> str:
    return text.strip(SPACES)
