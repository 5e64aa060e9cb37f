"""Structured documents: scan, select, typeset the selected values, put them back. A document is one row, and nothing leaves it."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from ..functions.rx import SPACES
from . import scan


_JSON_STRING = json.JSONDecoder(strict=False).decode


class Selectors:
    """What `fields` and `exclude` select, looked up by the last segment of a path; only selectors that end in a star are tried one by one.

    A JSON pointer matches the whole path, a dotted selector the whole dotted path, a bare one the last piece of the dotted path; a star is any one segment.
    """

    def __init__(self, selectors: tuple[str, ...]):
        self.bare: set[str] = set()
        self.any = False
        self.by_tail: dict[tuple[bool, str], list[list[str]]] = {}
        for s in selectors:
            if s.startswith("/"):
                self._add(True, [p.replace("~1", "/").replace("~0", "~") for p in s[1:].split("/")])
            elif "." in s:
                self._add(False, s.split("."))
            elif s == "*":
                self.any = True
            else:
                self.bare.add(s)

    def _add(self, pointer: bool, want: list[str]) -> None:
        self.by_tail.setdefault((pointer, want[-1]), []).append(want)

    def match(self, path: list[str]) -> bool:
        if self.any:
            return True
        if self.bare and (path[-1].rpartition(".")[2] if path else "") in self.bare:
            return True
        if not self.by_tail:
            return False
        dotted = ".".join(path).split(".")
        for pointer, have in ((True, path), (False, dotted)):
            if not have:
                continue
            for tail in (have[-1], "*"):
                for want in self.by_tail.get((pointer, tail), ()):
                    if len(want) == len(have) and all(w in ("*", h) for w, h in zip(want, have)):
                        return True
        return False


def typeset_document(text: str, fmt: str, fields: Selectors | None, exclude: Selectors | None, value: Callable[[str], str], done: dict | None = None) -> str:
    """A value is chosen if it is eligible, a field matches it where there are fields, and no exclusion does; one without an address is excluded by any exclusion and selected by no field.

    done holds the values of this and earlier documents of the same configuration.
    """
    out, at, done = [], 0, {} if done is None else done
    for start, end, is_key, eligible, delim, path in scan.SCANNERS[fmt](text):
        if is_key or not eligible:
            continue
        if fields and (path is None or not fields.match(path)) or exclude and (path is None or exclude.match(path)):
            continue
        raw = text[start:end]
        if (raw, delim) not in done:
            whole = _JSON_STRING(f'"{raw}"') if fmt == "json" and "\\" in raw else raw
            core = whole.strip(SPACES)
            new = value(core) if core else core
            head = len(whole) - len(whole.lstrip(SPACES)) if core else 0
            done[(raw, delim)] = raw if new == core else scan.rewrapped(fmt, raw, whole[:head] + new + whole[head + len(core) :], delim)
        out += [text[at:start], done[(raw, delim)]]
        at = end
    return "".join(out) + text[at:]


_LINE = re.compile(r"([^\r\n]*)(\r\n?|\n|\Z)")


def split_frontmatter(text: str) -> tuple[str, str, str, str, str] | None:
    """(delimiter, opening line, header, closing line, body), or None without a header; an opening line without a closing one is an error. A YAML header may end with "..."."""
    head = _LINE.match(text, 1 if text.startswith("\ufeff") else 0)
    if head[1] not in ("---", "+++"):
        return None
    ends, at = ("+++",) if head[1] == "+++" else ("---", "..."), head.end()
    while at < len(text):
        line = _LINE.match(text, at)
        if line[1] in ends:
            return head[1], text[: head.end()], text[head.end() : at], line[0], text[line.end() :]
        at = line.end()
    raise scan.ScanError("front matter is not closed")
