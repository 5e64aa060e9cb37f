"""Regular expressions and the idioms that rules are made of.

Rule patterns are written in the ECMAScript dialect in which the norms are published, where white space, digits, the end anchor, the dot and brackets inside classes mean something
else than here. They are compiled once a configuration and worker. A rule also says which characters a text must hold for it to do anything, so that most rules cost a
set comparison on most texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import regex

NBSP, NNBSP, THINSP = "\u00a0", "\u202f", "\u2009"
OPEN, CLOSE = "\ue000", "\ue001"
#: Fixed value: white space as ECMAScript defines it.
SPACE_CLASS = r"\t-\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPACES = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

#: What may stand before content, before a wrapped phrase, and after content.
_BRACKETS = "([{«„"
_INSIDE = rf"\s,\-{CLOSE}−—–{_BRACKETS}"
CONTENT_START = f">{_INSIDE}"
CONTENT_START_GROUP = f"(^|[{CONTENT_START}])"
WRAPPER_START_GROUP = f"(^|[{_INSIDE}])"
CONTENT_END = rf"(?=[\s.,;:!?±%<{OPEN})\]}}»“…]|$)"

Step = Callable[[str], str]
_SHORT = {r"\s": SPACE_CLASS, r"\d": "0-9"}
_NEGATED = {r"\S": SPACE_CLASS, r"\D": "0-9"}
_BRACED = re.compile(r"\\u\{([0-9A-Fa-f]+)\}")


def translated(pattern: str) -> str:
    """The same pattern in Python's dialect. `@S` stands for the content boundary before, `@W` for the wrapper boundary, `@E` for the boundary after."""
    p = pattern.replace("@S", CONTENT_START_GROUP).replace("@W", WRAPPER_START_GROUP).replace("@E", CONTENT_END)
    p = _BRACED.sub(lambda m: f"\\u{int(m[1], 16):04x}", p)
    out, inside = [], False
    pieces = iter(re.findall(r"\\u[0-9A-Fa-f]{4}|\\[pP]\{\w+\}|\\.|\[\^?|[\s\S]", p))
    for c in pieces:
        if c in _SHORT:
            out.append(_SHORT[c] if inside else f"[{_SHORT[c]}]")
        elif c in _NEGATED and not inside:
            out.append(f"[^{_NEGATED[c]}]")
        elif c[0] == "[":
            out.append(c if not inside else r"\[" + ("" if c == "[" else r"\^"))
            inside = True
        elif c == "]":
            inside = False
            out.append(c)
        elif inside or c not in ("$", "."):
            out.append(c)
        else:
            out.append(r"\Z" if c == "$" else r"[^\n\r\u2028\u2029]")
    return "".join(out)


@lru_cache(maxsize=None)
def compiled(pattern: str, ignore_case: bool = False):
    """The standard library's engine where it knows the pattern; the other for properties and look-behinds of any width."""
    p = translated(pattern)
    if not re.search(r"\\[pP]\{", p):
        try:
            return re.compile(p, re.I if ignore_case else 0)
        except re.error:
            pass
    return regex.compile(p, regex.I if ignore_case else 0)


def sub(pattern: str, replacement: str, ignore_case: bool = True) -> Step:
    """Replaces all matches; $1 to $9 are groups."""
    template = re.sub(r"\$([1-9])", r"\\g<\1>", replacement.replace("\\$", "\0").replace("\\", r"\\")).replace("\0", "$")
    p = compiled(pattern, ignore_case)
    return lambda t: p.sub(template, t)


def mapped(pattern: str, body: Callable[[re.Match], str], ignore_case: bool = True) -> Step:
    """Replaces each match by what body makes of it."""
    p = compiled(pattern, ignore_case)
    return lambda t: p.sub(body, t)


def chain(steps: Iterable[Step]) -> Step:
    steps = tuple(steps)
    if len(steps) == 1:
        return steps[0]

    def run(t: str) -> str:
        for s in steps:
            t = s(t)
        return t

    return run


def fixpoint(step: Step, rounds: int = 100, on_limit: Callable[[], None] | None = None) -> Step:
    """step until nothing changes, at most `rounds` times; on_limit is called where the last round still changed something."""

    def run(t: str) -> str:
        for _ in range(rounds):
            new = step(t)
            if new == t:
                return t
            t = new
        if on_limit:
            on_limit()
        return t

    return run


#: Fixed value: steps up to which characters are looked for one need at a time.
_FEW = 4


def guarded(steps: Iterable[tuple[tuple[frozenset[str], ...], Step]]) -> Step:
    """Each step in order, where the text holds a character of each of the sets that the step needs."""
    steps = tuple(steps)
    if len(steps) <= _FEW:  # looking for their characters takes less than collecting those of the text after every change
        looked = tuple((tuple(re.compile(f"[{re.escape(''.join(sorted(n)))}]").search for n in needs), step) for needs, step in steps)

        def run_few(t: str) -> str:
            for needs, step in looked:
                for need in needs:
                    if not need(t):
                        break
                else:
                    t = step(t)
            return t

        return run_few

    def run(t: str) -> str:
        there = None
        for needs, step in steps:
            if needs and there is None:
                there = set(t)
            for need in needs:
                if there.isdisjoint(need):
                    break
            else:
                new = step(t)
                if new != t:
                    t, there = new, None
        return t

    return run
