"""Edit ranges between a text and its typeset form.

Typesetting changes a text in short, scattered places. Both texts are read in step; where they part, the nearest place where they agree again for a few characters is looked for, first
by trying all short distances, then by an index over windows that grow, and only the short stretch in between is compared exactly. Time is linear in both texts.
"""

from __future__ import annotations

from difflib import SequenceMatcher

from . import glyphs

#: Characters that must agree, the most first; distances that are all tried; first window of the index; longest stretch that is compared exactly.
_AGREE, _NEAR, _WINDOW, _EXACT = (4, 2, 1), 32, 256, 128


def _same(a: str, i: int, b: str, j: int, most: int) -> int:
    """How many characters agree from i and j on, `most` at most."""
    n, step = 0, 64
    while n < most and a[i + n : i + n + min(step, most - n)] == b[j + n : j + n + min(step, most - n)]:
        n += min(step, most - n)
        step *= 4
    low, high = n, min(most, n + step)
    while low < high:  # the last block holds the first difference
        mid = (low + high + 1) // 2
        if a[i + n : i + mid] == b[j + n : j + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _again(a: str, i: int, end_a: int, b: str, j: int, end_b: int, k: int) -> tuple[int, int]:
    """The nearest places at or after i and j from which k characters agree, else both ends."""
    most_a, most_b = end_a - k - i, end_b - k - j
    if most_a < 0 or most_b < 0:
        return end_a, end_b
    for d in range(1, min(_NEAR, most_a + most_b) + 1):
        for x in range(max(0, d - most_b), min(d, most_a) + 1):
            p, q = i + x, j + d - x
            if a[p] == b[q] and a[p : p + k] == b[q : q + k]:
                return p, q
    width = _WINDOW
    while True:
        stop_a, stop_b = min(end_a, i + width), min(end_b, j + width)
        first: dict[str, int] = {}
        for p in range(stop_a - k, i - 1, -1):
            first[a[p : p + k]] = p
        best = None
        for q in range(j, stop_b - k + 1):
            p = first.get(b[q : q + k])
            if p is not None and (best is None or p + q < best[0]):
                best = (p + q, p, q)
        if best:
            return best[1], best[2]
        if stop_a == end_a and stop_b == end_b:
            return end_a, end_b
        width *= 4


def _alone(x: str, y: str) -> int | None:
    """How much of y is new, if x and y agree in their last characters and what stands before those agrees with nothing; the exact comparison would say the same."""
    n, most = 0, min(len(x), len(y))
    while n < most and x[-1 - n] == y[-1 - n]:
        n += 1
    new = y[: len(y) - n]
    return len(new) if len(x) + len(y) > 2 * n and set(x[: len(x) - n]).isdisjoint(y) and set(new).isdisjoint(x) else None


def _walk(a: str, i: int, end_a: int, b: str, j: int, end_b: int, level: int, out: list[list[int]]) -> None:
    while True:
        n = _same(a, i, b, j, min(end_a - i, end_b - j))
        i, j = i + n, j + n
        if i == end_a or j == end_b:
            if i != end_a or j != end_b:
                out.append([j, end_b])
            return
        p, q = _again(a, i, end_a, b, j, end_b, _AGREE[level])
        if p - i + q - j <= _EXACT and (alone := _alone(a[i:p], b[j:q])) is not None:
            out.append([j, j + alone])
        elif p - i + q - j <= _EXACT:
            for kind, _, _, start, end in SequenceMatcher(None, a[i:p], b[j:q], autojunk=False).get_opcodes():
                if kind != "equal":
                    out.append([j + start, j + end])
        elif level + 1 < len(_AGREE):
            _walk(a, i, p, b, j, q, level + 1, out)
        else:
            out.append([j, q])
        i, j = p, q


def ranges(before: str | None, after: str | None) -> list[tuple[int, int]]:
    """Sorted disjoint [start, end) over `after` in UTF-16 units; an empty range is a pure deletion. What lies outside the ranges is a subsequence of `before`."""
    if before is None or after is None or before == after:
        return []
    found: list[list[int]] = []
    _walk(before, 0, len(before), after, 0, len(after), 0, found)
    out: list[list[int]] = []
    for s, e in found:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    if glyphs.units(after) == len(after):
        return [(s, e) for s, e in out]
    units, at, done = 0, 0, []
    for s, e in out:  # code points to UTF-16 units, in one pass
        units += len(after[at:s].encode("utf-16-le", "surrogatepass")) // 2
        width = len(after[s:e].encode("utf-16-le", "surrogatepass")) // 2
        done.append((units, units + width))
        units, at = units + width, e
    return done


def ranges_array(before: list[str | None], after: list[str | None]):
    """An Arrow array of the ranges of each pair."""
    import pyarrow as pa

    offsets, starts, ends = [0], [], []
    for a, b in zip(before, after):
        for s, e in ranges(a, b):
            starts.append(s)
            ends.append(e)
        offsets.append(len(starts))
    pairs = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)
