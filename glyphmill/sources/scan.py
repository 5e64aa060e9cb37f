"""Scanners of structured formats: which spans of a document are string values, keys, or neither.

A span is (start, end, is_key, eligible, delim, path): code-point offsets of the content without its quotes, the quote that delimits it and the path of segments.
What a scanner doesn't recognise yields no span and so stays as it is, byte for byte.
"""

from __future__ import annotations

import json
import re


class ScanError(ValueError):
    pass


_SURROGATE = re.compile("[\ud800-\udfff]")
_JSON = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\],]', re.S)


def scan_json(text: str) -> list[tuple]:
    try:
        json.loads(text)
    except (ValueError, RecursionError) as e:
        raise ScanError(f"malformed JSON: {e}") from None
    spans, path, counts, waits = [], [], [], False  # counts: of an array its index, of an object -1; waits: for a key
    for m in _JSON.finditer(text):
        start, end = m.span()
        c = text[start]
        if c == '"':
            if waits:
                spans.append((start + 1, end - 1, True, False, '"', path[:-1]))
                raw = text[start + 1 : end - 1]
                path[-1], waits = json.loads(f'"{raw}"') if "\\" in raw else raw, False
            else:
                spans.append((start + 1, end - 1, False, True, '"', path[:]))
        elif c == ",":
            if counts[-1] < 0:
                waits = True
            else:
                counts[-1] += 1
                path[-1] = str(counts[-1])
        elif c in "{[":
            waits = c == "{"
            path.append("0")
            counts.append(-1 if waits else 0)
        else:
            path.pop()
            counts.pop()
            waits = False
    return spans


_TOML_KEY = re.compile(r"""\s*((?:"(?:[^"\\\n]|\\.)*"|'[^'\n]*'|[^\s.=\[\]{}\"'#,]+)(?:\s*\.\s*(?:"(?:[^"\\\n]|\\.)*"|'[^'\n]*'|[^\s.=\[\]{}\"'#,]+))*)\s*=\s*""")
_TOML_PART = re.compile(r"""\"((?:[^"\\]|\\.)*)\"|'([^']*)'|([^\s.=\[\]{}\"'#,]+)""")
_TOML_STRING = re.compile(r'"""(?:[^\\]|\\.)*?"{3,5}|\'\'\'.*?\'{3,5}|"(?:[^"\\\n]|\\.)*"|\'[^\'\n]*\'', re.S)


def _toml_path(text: str) -> list[str]:
    return [unescaped(m[1]) if m[1] is not None else m[2] if m[2] is not None else m[3] for m in _TOML_PART.finditer(text)]


_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|x([0-9a-fA-F]{2})|(.))", re.S)
#: Escapes of one letter in keys.
_LETTERS = {"b": "\b", "t": "\t", "n": "\n", "f": "\f", "r": "\r", "e": "\x1b", "0": "\0", "a": "\a", "v": "\v"}


def unescaped(key: str) -> str:
    """A key with its escapes decoded; what is no escape stays."""

    def read(m: re.Match) -> str:
        digits = m[1] or m[2] or m[3]
        if not digits:
            return _LETTERS.get(m[4], m[4])
        code = int(digits, 16)
        return chr(code) if code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else m[0]

    return _ESCAPE.sub(read, key) if "\\" in key else key


_REST = re.compile(r"[ \t]*(?:#[^\n]*)?\r?(?:\n|\Z)")
_TOML_KEY_BEHIND, _BARE_KEY = re.compile(r"\s*[=.]"), re.compile(r"[^\s.=\[\]{}\"'#,]+(?=\s*[=.])")


def scan_toml(text: str) -> list[tuple]:
    spans, base, at, counts = [], [], 0, {}
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end].strip()
        if line.startswith("["):
            m = re.match(r"\s*(\[\[?)(.*?)(\]\]?)\s*(#.*)?$", text[at:end])
            if not m or len(m.group(1)) != len(m.group(3)):
                raise ScanError(f"malformed header: {line[:60]}")
            names = _toml_path(m.group(2))
            if not names or re.search(r"\.\s*(?:\.|$)|^\s*\.", re.sub(r"\"(?:[^\"\\]|\\.)*\"|'[^']*'", "k", m.group(2))):
                raise ScanError(f"empty segment in header: {line[:60]}")
            path: list[str] = []
            for k, n in enumerate(names):
                path.append(n)
                here = ".".join(names[: k + 1])
                if k == len(names) - 1 and len(m.group(1)) == 2:
                    counts[here] = counts.get(here, -1) + 1
                    for inner in [c for c in counts if c.startswith(here + ".")]:
                        del counts[inner]
                if here in counts:
                    path.append(str(counts[here]))
            base, at = path, end + 1
            continue
        m = _TOML_KEY.match(text, at, end)
        if not m or line.startswith("#"):
            if re.match(r"(?:=|[^#=\"']*\.\s*=)", line):
                raise ScanError(f"empty key segment: {line[:60]}")
            at = end + 1
            continue
        spans.append((m.start(1), m.end(1), True, False, "", base))
        at = _toml_value(text, m.end(), base + _toml_path(m.group(1)), spans)
    return spans


def _toml_value(text: str, at: int, path: list[str], spans: list[tuple]) -> int:
    """Records the strings of one value; returns the offset of the line after it."""
    stack: list[list] = []
    while at < len(text):
        c = text[at]
        if c in "\"'":
            closed = not stack
            m = _TOML_STRING.match(text, at)
            if not m:
                raise ScanError("unterminated string")
            wide = 3 if m.group()[:3] in ('"""', "'''") else 1
            here = path + [str(x[1]) for x in stack]
            body = m.group()[wide:-wide]
            if stack and stack[-1][0] == "{" and _TOML_KEY_BEHIND.match(text, m.end()):
                stack[-1][1] = unescaped(body) if c == '"' else body
            else:
                spans.append((at + wide, m.end() - wide, False, c == "'" or "\\" not in body, m.group()[:wide], here))
            at = m.end()
            if closed:
                return _toml_end(text, at)
        elif c in "[{":
            stack.append([c, 0 if c == "[" else ""])
            at += 1
        elif c in "]}":
            if not stack or (stack.pop()[0] == "[") != (c == "]"):
                raise ScanError("mismatched collection")
            at += 1
            if not stack:
                return _toml_end(text, at)
        elif c == "," and stack:
            if stack[-1][0] == "[":
                stack[-1][1] += 1
            at += 1
        elif c == "#":
            at = (text.find("\n", at) + 1) or len(text)
            if not stack:
                return at
        elif c == "\n" and not stack:
            return at + 1
        elif stack and stack[-1][0] == "{" and (m := _BARE_KEY.match(text, at)):
            stack[-1][1] = m.group()
            at = m.end()
        else:
            at += 1
    if stack:
        raise ScanError("unclosed collection")
    return at


def _toml_end(text: str, at: int) -> int:
    """The offset of the next line, if nothing but a comment stands behind a value."""
    rest = _REST.match(text, at)
    if not rest:
        raise ScanError(f"content after a value: {text[at : at + 40]!r}")
    return rest.end()


_YAML_LINE = re.compile(r"^(?P<indent> *)(?P<dashes>(?:- +)*)(?:(?P<key>(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^\s#\-?:,\[\]{}&*!|>'\"%@`][^#\n]*?|[\-?:](?=[^\s])[^#\n]*?))[ \t]*:(?=[ \t]|$)[ \t]*)?(?P<value>.*)$".replace('\\"', '"'))
#: Fixed value: plain scalars that aren't strings.
_YAML_WORDS = set("~ null true false yes no on off y n .inf .nan = << --- ...".split())


def yaml_plain_is_text(s: str) -> bool:
    """A plain scalar is a string if it is no keyword, has a letter, and either holds a space or doesn't begin as a number would."""
    return s.lower() not in _YAML_WORDS and any(map(str.isalpha, s)) and (s[0] not in "-+.0123456789" or any(map(str.isspace, s)))


_YAML_QUOTED = re.compile(r"\"((?:[^\"\\]|\\.)*)\"|'((?:[^']|'')*)'", re.S)
_YAML_PROPERTY = re.compile(r"(?:[&!]\S*(?:[ \t]+|$))+")
_YAML_BLOCK = re.compile(r"[|>]([-+]?\d?|\d[-+]?)[ \t]*(#.*)?$")
_YAML_EXPLICIT = re.compile(r"^( *)((?:- +)*)\?(?:[ \t]+|$)(.*)$")
_YAML_VALUE = re.compile(r"^( *):(?:[ \t]+|$)(.*)$")
_NO_FOLD = re.compile(r"\s*(?:- |#|\? )|.*:(?:\s|$)")
_NOT_PLAIN, _FLOW_SIGN = re.compile(r": |:$| #|^[-?:,\[\]{}#&*!|>'\"%@`]|\n"), re.compile(r"[,\[\]{}]")
_YAML_PLAIN = re.compile(r".*?(?=[ \t]+#|[ \t]*$)")


class _Yaml:
    """One pass over the lines of a YAML text. The stack holds (column, segment) of the open containers; a segment of None has no address, and neither has anything under it."""

    def __init__(self, text: str):
        self.text, self.lines, self.offsets, at = text, text.split("\n"), [], 0
        for ln in self.lines:
            self.offsets.append(at)
            at += len(ln) + 1
        self.spans: list[tuple] = []
        self.stack: list[list] = []
        self.pending: tuple[int, str | None] | None = None  # column and name of an explicit key that waits for its value

    def path(self) -> list[str] | None:
        path = [s for _, s in self.stack]
        return None if None in path else path

    def indent(self, k: int) -> int:
        line = self.lines[k]
        return len(line) - len(line.lstrip(" ")) if line[:1] == " " else 0

    def _items(self, column: int, dashes: str) -> None:
        at = 0
        for d in re.finditer("-", dashes):
            c = column + d.start() + 0.5
            while self.stack and self.stack[-1][0] > c:
                self.stack.pop()
            if self.stack and self.stack[-1][0] == c:
                self.stack[-1][1] = str(int(self.stack[-1][1]) + 1)
            else:
                self.stack.append([c, "0"])
            at = d.end()

    def _key(self, column: float, name: str | None) -> None:
        while self.stack and self.stack[-1][0] >= column:
            self.stack.pop()
        self.stack.append([column, name])

    def _name(self, raw: str) -> str | None:
        """What a key is called: one plain or quoted scalar; a tag makes it anonymous unless the scalar is spelled as the tag's type would be."""
        prop = _YAML_PROPERTY.match(raw) if raw[:1] in ("&", "!") else None
        tags = prop[0].split() if prop else ()
        raw = raw[prop.end() :].strip() if prop else raw.strip()
        if tags and any(t.startswith("!!") and t != "!!str" and not (t == "!!int" and re.fullmatch(r"0|-?[1-9]\d*", raw) or t == "!!bool" and raw in ("true", "false")) for t in tags):
            return None
        q = _YAML_QUOTED.fullmatch(raw) if raw[:1] in ("'", '"') else None
        if q:
            return unescaped(q[1]) if q[1] is not None else q[2].replace("''", "'")
        return None if not raw or raw[0] in "[{*|>&!'\"" else raw

    def scan(self) -> list[tuple]:
        k = 0
        while k < len(self.lines):
            line = self.lines[k].rstrip("\r")
            bare = line.strip()
            if not bare or bare.startswith("#"):
                k += 1
            elif line.startswith(("---", "...")) and not line[3:].strip():
                self.stack, self.pending, k = [], None, k + 1
            elif line.startswith("%") and not self.stack:
                k += 1
            else:
                k = self._line(k, line, bare)
        return self.spans

    def _line(self, k: int, line: str, bare: str) -> int:
        explicit = _YAML_EXPLICIT.match(line) if "?" in line else None
        if explicit:
            column = len(explicit[1])
            self._items(column, explicit[2])
            column += len(explicit[2])
            raw, k = explicit[3], k + 1
            wide = False
            while k < len(self.lines) and (not self.lines[k].strip() or self.indent(k) > column):  # a key of several lines names nothing
                wide = wide or bool(self.lines[k].strip())
                k += 1
            self.pending = (column, None if wide else self._name(re.sub(r"[ \t]+#.*$", "", raw)))
            return k
        valued = _YAML_VALUE.match(line) if self.pending else None
        if valued and self.pending[0] == len(valued[1]):
            self._key(self.pending[0], self.pending[1])
            self.pending = None
            return self._value(k, len(valued[1]), valued[2], valued.start(2), True)
        m = _YAML_LINE.match(line)
        indent, dashes, key, value = m.groups()
        column = len(indent)
        if bare == "-":
            self._items(column, "-")
            return k + 1
        if dashes:
            self._items(column, dashes)
        if key is not None:
            self._key(column + len(dashes), "")
            outer = self.path()
            self.spans.append((self.offsets[k] + m.start(3), self.offsets[k] + m.end(3), True, False, "", outer and outer[:-1]))
            self.stack[-1][1] = self._name(key)
        elif not dashes:
            while self.stack and self.stack[-1][0] >= column + 1:
                self.stack.pop()
        return self._value(k, column, value, m.start(4), key is not None)

    def _value(self, k: int, column: int, value: str, at: int, keyed: bool) -> int:
        start, first = self.offsets[k] + at, value[:1]
        prop = _YAML_PROPERTY.match(value) if first in ("&", "!") else None
        if prop:
            start, value = start + prop.end(), value[prop.end() :]
            first = value[:1]
        header = _YAML_BLOCK.match(value) if first in ("|", ">") else None
        if header:
            return self._block(k + 1, column, header[1], self.path(), keyed)
        if first in ("\"", "'"):
            return self._quoted(k, start, bool(prop), self.path())
        if first in ("[", "{"):
            return self._flow(start, k, self.path(), bool(prop))
        if value and first not in "*|>%@`#":
            plain = _YAML_PLAIN.match(value)[0] if "#" in value else value.rstrip(" \t")
            if k + 1 < len(self.lines) and self._folds(k + 1, column):
                k += 1
                while k < len(self.lines) and self._folds(k, column):
                    k += 1
                return k
            if plain and not prop and yaml_plain_is_text(plain):
                self.spans.append((start, start + len(plain), False, True, "plain", self.path()))
        return k + 1

    def _folds(self, k: int, column: int) -> bool:
        """Whether a line goes on with the plain scalar before it."""
        ln = self.lines[k]
        return ln[column : column + 1] == " " and self.indent(k) > column and bool(ln.strip()) and not _NO_FOLD.match(ln)

    def _block(self, k: int, column: int, header: str, path, keyed: bool) -> int:
        """Each line of a block scalar's content is a value of its own."""
        digit = re.search(r"\d", header) if header else None
        inner = column + int(digit[0]) if digit else None
        while k < len(self.lines) and (not self.lines[k].strip() or self.indent(k) > column or not self.stack and inner is None and self.indent(k) >= column and not keyed):
            if self.lines[k].strip():
                inner = self.indent(k) if inner is None else inner
                body = self.lines[k].rstrip("\r")
                if self.indent(k) >= inner:
                    self.spans.append((self.offsets[k] + inner, self.offsets[k] + len(body), False, True, "", path))
            k += 1
        return k

    def _after(self, at: int, k: int) -> int:
        """The line after the one that holds offset at - 1, if nothing but a comment stands behind at."""
        if self.text[at : at + 1] not in ("", "\n") and not _REST.match(self.text, at):
            raise ScanError(f"content after a scalar: {self.text[at : at + 40]!r}")
        while k < len(self.lines) and self.offsets[k] < max(at, 1):
            k += 1
        return k

    def _quoted(self, k: int, start: int, prop: bool, path) -> int:
        q = _YAML_QUOTED.match(self.text, start)
        if not q:
            raise ScanError("unterminated scalar")
        body = q[0][1:-1]
        if "\n" not in body:  # one that closes on a later line stays as it is
            self.spans.append((start + 1, q.end() - 1, False, not prop and "\\" not in body and "''" not in body, q[0][0], path))
        return self._after(q.end(), k)

    def _flow(self, start: int, k: int, path, prop: bool) -> int:
        """Strings in a flow collection, quoted or plain, on one line each; returns the line after it."""
        text, at, last = self.text, start, ""
        stack: list[list] = []

        def here():
            return None if path is None or any(x[1] is None for x in stack) else path + [str(x[1]) for x in stack]

        while at < len(text):
            c = text[at]
            if c.isspace():
                at += 1
            elif c == "#" and (at == start or text[at - 1].isspace()):
                at = text.find("\n", at)
                at = len(text) if at < 0 else at
            elif c in "\"'" and last in "[{,:?":
                q = _YAML_QUOTED.match(text, at)
                if not q:
                    raise ScanError("unterminated scalar")
                body = q[0][1:-1]
                if stack[-1][0] == "{" and last in "{,?" and _COLON.match(text, q.end()):
                    stack[-1][1] = self._name(q[0])
                else:
                    self.spans.append((at + 1, q.end() - 1, False, not prop and "\\" not in body and "\n" not in body and "''" not in body, c, here()))
                at, last = q.end(), c
            elif c in "[{":
                stack.append([c, 0 if c == "[" else None])
                at, last = at + 1, c
            elif c in "]}":
                if not stack or (stack.pop()[0] == "[") != (c == "]"):
                    raise ScanError("mismatched flow collection")
                at, last = at + 1, c
                if not stack:
                    return self._after(at, k)
            elif c == ",":
                stack[-1][1] = stack[-1][1] + 1 if stack[-1][0] == "[" else None
                at, last = at + 1, c
            elif c in ":?" and (text[at + 1 : at + 2] in ("", " ", "\t", "\n", "\r", ",", "[", "]", "{", "}") or last in "\"'"):
                at, last = at + 1, c
            elif last in "[{,:?":
                m = _FLOW_PLAIN.match(text, at)
                plain = m[0].rstrip() if m else c
                end = at + max(1, len(plain))
                if stack[-1][0] == "{" and last in "{,?":
                    stack[-1][1] = self._name(plain)
                elif stack[-1][0] == "[" and _COLON.match(text, end):
                    pass  # a pair in a sequence
                elif plain and plain[0] not in "&!*" and "\n" not in plain and not prop and yaml_plain_is_text(plain):
                    self.spans.append((at, end, False, True, "flow", here()))
                at, last = end, "x"
            else:
                at += 1
        raise ScanError("unclosed flow collection")


_COLON = re.compile(r"[ \t]*:")
_FLOW_PLAIN = re.compile(r"(?:[^\s,\[\]{}:#]|:(?![\s,\[\]{}])|(?<=\S)#|[ \t]+(?![\s#])|:(?=\S)(?![,\[\]{}]))+")


def scan_yaml(text: str) -> list[tuple]:
    return _Yaml(text).scan()


_XML_TAG = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!DOCTYPE(?:[^\[>]|\[[^\]]*\])*>|<(/?)([A-Za-z_:][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>".replace('\\"', '"'), re.S)


def validate_xml(text: str) -> str | None:
    """What is wrong with the tags, or None."""
    stack = []
    for m in _XML_TAG.finditer(text):
        if m.group(2) is None or m.group(4):
            continue
        if not m.group(1):
            stack.append(m.group(2))
        elif not stack or stack.pop() != m.group(2):
            return f"</{m.group(2)}> closes nothing"
        elif m.group(3).strip():
            return f"</{m.group(2)}> has attributes"
    return f"<{stack[-1]}> is not closed" if stack else None


SCANNERS = {"json": scan_json, "toml": scan_toml, "yaml": scan_yaml}


def splice(text: str, spans: list[tuple[int, int]], values: list[str]) -> str:
    out, at = [], 0
    for (s, e), v in zip(spans, values):
        out += [text[at:s], v]
        at = e
    out.append(text[at:])
    return "".join(out)


def rewrapped(fmt: str, raw: str, typed: str, delim: str) -> str:
    """The new content of a span, or the old where the new would no longer be one value."""
    if fmt == "json":
        body = json.encoder.encode_basestring(typed)[1:-1]
        return body if not _SURROGATE.search(body) else "".join(c if not 0xD800 <= ord(c) <= 0xDFFF else f"\\u{ord(c):04x}" for c in body)
    if delim in ("plain", "flow"):
        ok = not (delim == "flow" and _FLOW_SIGN.search(typed)) and yaml_plain_is_text(typed) and not _NOT_PLAIN.search(typed) and typed == typed.strip()
        return typed if ok else raw
    if "\n" in typed and "\n" not in raw:
        return raw
    return raw if delim and (delim in typed or (delim[0] == '"' and "\\" in typed)) else typed
