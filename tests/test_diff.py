"""Edit ranges: fixed cases, the covering property on random edits, and time on long texts."""

import random
import time

from glyphmill.functions.diff import ranges


def covered(before, after, found):
    kept, at = "", 0
    for s, e in found:
        assert at <= s <= e <= len(after)
        kept, at = kept + after[at:s], e
    kept += after[at:]
    i = 0
    for c in before:
        i += i < len(kept) and kept[i] == c
    return i == len(kept)


def test_fixed():
    assert ranges("x", "x") == [] and ranges("", "abc") == [(0, 3)] and ranges("ab", "") == [(0, 0)]
    assert ranges("a - b", "a — b") == [(2, 3)] and ranges("a  b", "a b") == [(2, 2)]
    assert ranges("x y", "x<b>y</b>") == [(1, 4), (5, 9)]
    assert ranges('Он сказал: "Да" - и ушёл', "Он сказал: «Да» — и ушёл") == [(11, 12), (14, 17)]
    assert ranges("ab" * 200, "xy" * 300) == [(0, 600)]
    assert ranges("😀 - b", "😀 — b") == [(3, 4)]


def test_every_other_character():
    found = ranges('"a" ' * 2000, "«a» " * 2000)
    assert len(found) == 4000 and found[:2] == [(0, 1), (2, 3)]


def test_random_edits_are_covered():
    rng = random.Random(7)
    for _ in range(400):
        before = "".join(rng.choice('ab -"«» ') for _ in range(rng.randrange(60)))
        after = "".join("" if (r := rng.random()) < 0.1 else rng.choice('ab"«') + c if r < 0.2 else rng.choice("ab ") if r < 0.3 else c for c in before)
        assert covered(before, after, ranges(before, after))


def test_long_texts_in_linear_time():
    before = ('слово "раз" - два ' * 60_000)[:1_000_000]
    after = before.replace('"р', "«р").replace('з"', "з»").replace(" - ", " — ")
    began = time.perf_counter()
    assert len(ranges(before, after)) > 100_000
    assert time.perf_counter() - began < 30
