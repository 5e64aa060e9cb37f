"""The four characters that marks are made of: swapped for unused private-use characters in texts that hold them, and what groups of the user's own may return of them."""

from __future__ import annotations

import re
from collections import Counter

RESERVED = "\ue000\ue001\ue100\ue101"
_TOKEN = re.compile(r"\ue000[A-Za-z]+\d+\ue001|\ue100(?:POP|PCL|BR)\ue101|(?:http://)?glyphmill-xyz/A0SAFEq+\d+ID|A1SAFEq+\d+ID@glyphmill\.xyz|A[uv]SAFEq+\d+TK|[\ue000\ue001\ue100\ue101]")
EXHAUSTED = "too many distinct private-use characters to escape the reserved ones"


class Exhausted(ValueError):
    pass


def held(text: str) -> bool:
    return "\ue000" in text or "\ue001" in text or "\ue100" in text or "\ue101" in text


def escaped(text: str) -> tuple[str, dict[int, int] | None]:
    """The text with its reserved characters as the lowest private-use characters that it doesn't hold, and how to turn them back."""
    if not held(text):
        return text, None
    there = set(text)
    free = (c for c in range(0xE000, 0xF900) if chr(c) not in there and chr(c) not in RESERVED)
    swap = {}
    for c in RESERVED:
        if c in there:
            try:
                swap[ord(c)] = next(free)
            except StopIteration:
                raise Exhausted(EXHAUSTED) from None
    return text.translate(swap), {new: old for old, new in swap.items()}


def scrubbed(before: str, after: str) -> str:
    """after without the marks it has beyond those of before, each counted as it is spelled, and without reserved characters outside marks."""
    if before == after:
        return after
    left = Counter(m for m in _TOKEN.findall(before) if len(m) > 1)

    def kept(m: re.Match) -> str:
        left[m[0]] -= 1
        return m[0] if left[m[0]] >= 0 else ""

    return _TOKEN.sub(kept, after)
