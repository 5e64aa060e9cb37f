"""External suffix sorting by recursive induction, with common prefixes carried along.

The beginnings of rising runs (S*) in order induce the order of all suffixes in two passes: ascending for falling suffixes, descending for rising ones. What a pass produces for a character waits in a
priority queue with the character as key and arrival as tie-break, as tuples of position and common prefix with the tuple queued before it: one more than the least common prefix among
the suffixes scanned between the two that produced them. The order of the S* themselves comes from a first induction that sorts the pieces between them, gives equal pieces
one name, and sorts the string of names by the same procedure, each name written as one or two digits so that every level has a small alphabet. Common prefixes of
names become a first bound for those of the S*, which reading on in the text completes.

Text, types, seeds and queues are arrays of a Scratch: in memory up to its limit and in files beyond it, which are read and written by blocks. Memory is a few blocks, the queues' limit,
one bucket group and what sorts the last string of names: one of at most SMALL names fits in memory and is sorted there by doubling, as external sorters end their recursion.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 16
#: Names that one digit holds; names of a string that is sorted in memory.
DIGIT, SMALL = 1500, 3_000_000


class Scratch:
    """Arrays in memory up to `limit` bytes each, in files beyond that; the files lie in the folder that Spark gives its workers for spilling and go with the object."""

    def __init__(self, limit: int = 64 << 20, queued: int = 1 << 22):
        self.limit, self.queued = limit, queued
        self.folder: str | None = None
        self.files = 0
        self.on_disk = 0

    def _path(self) -> str:
        if self.folder is None:
            base = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
            self.folder = tempfile.mkdtemp(prefix="induced-", dir=base if base and os.path.isdir(base) else None)
        self.files += 1
        return os.path.join(self.folder, str(self.files))

    def empty(self, n: int, dtype) -> np.ndarray:
        size = n * np.dtype(dtype).itemsize
        if size <= self.limit or not n:
            return np.zeros(n, dtype)
        self.on_disk += size
        return np.memmap(self._path(), dtype=dtype, mode="w+", shape=(n,))

    def file(self):
        return open(self._path(), "w+b", buffering=0)  # noqa: SIM115

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


class Queues:
    """Tuples by character, first in, first out. Characters share groups of 2 ** shift; a group is parted by character when it is opened."""

    def __init__(self, size: int, scratch: Scratch, place, carries: bool):
        self.shift = max(0, int(size - 1).bit_length() - 8) if size > 512 else 0
        self.held: list[list] = [[] for _ in range((size >> self.shift) + 1)]
        self.fine: dict[int, list] = {}
        self.group = -1
        self.scratch, self.count, self.out = scratch, 0, None
        self.shape = np.dtype([("c", "<u2"), ("p", place), ("l", "<i2")])
        self.carries = carries

    def put(self, c: np.ndarray, p: np.ndarray, common: np.ndarray | None) -> None:
        """Tuples sorted by character, in order of arrival within one."""
        n = len(c)
        key = c >> self.shift
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        ends = [*cuts.tolist(), n]
        a = 0
        for b in ends:
            g = int(key[a])
            part = (c[a:b], p[a:b], None if common is None else common[a:b])
            if self.shift and g == self.group:
                self._part(part)
            else:
                self.held[g].append(part)
            a = b
        self.count += n
        if self.count > self.scratch.queued:
            self._spill()

    def _part(self, part) -> None:
        c, p, common = part
        cuts = np.flatnonzero(c[1:] != c[:-1]) + 1
        a = 0
        for b in [*cuts.tolist(), len(c)]:
            self.fine.setdefault(int(c[a]), []).append((c[a:b], p[a:b], None if common is None else common[a:b]))
            a = b

    def _spill(self) -> None:
        """Everything but the open group goes to the file; a reference takes its place."""
        if self.out is None:
            self.out = self.scratch.file()
        for g, parts in enumerate(self.held):
            mine = [x for x in parts if not isinstance(x, int)]
            if not mine:
                continue
            kept: list = []
            for x in parts:
                if isinstance(x, int):
                    kept.append(x)
            rows = np.empty(sum(len(x[0]) for x in mine), self.shape)
            rows["c"] = np.concatenate([x[0] for x in mine])
            rows["p"] = np.concatenate([x[1] for x in mine])
            rows["l"] = np.concatenate([x[2] for x in mine]) if self.carries else 0
            for a in range(0, len(rows), BLOCK):
                data = rows[a : a + BLOCK].tobytes()
                at = self.out.seek(0, 2)
                self.out.write(data)
                self.scratch.on_disk += len(data)
                kept.append(at * (BLOCK + 1) + len(data) // self.shape.itemsize)
            self.held[g] = kept
        self.count = 0

    def _load(self, x):
        if not isinstance(x, int):
            return x
        self.out.seek(x // (BLOCK + 1))
        rows = np.frombuffer(self.out.read(x % (BLOCK + 1) * self.shape.itemsize), self.shape)
        return rows["c"], rows["p"].copy(), rows["l"].copy() if self.carries else None

    def _joined(self, parts: list):
        if len(parts) == 1:
            return self._load(parts[0])
        loaded = [self._load(x) for x in parts]
        return np.concatenate([x[0] for x in loaded]), np.concatenate([x[1] for x in loaded]), np.concatenate([x[2] for x in loaded]) if self.carries else None

    def take(self, c: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """Empties a character's queue by blocks, also of what is put there meanwhile."""
        if self.shift and c >> self.shift != self.group:
            self.group, self.fine = c >> self.shift, {}
            parts, self.held[self.group] = self.held[self.group], []
            if parts:
                cs, p, common = self._joined(parts)
                order = np.argsort(cs, kind="stable")
                self._part((cs[order], p[order], None if common is None else common[order]))
        while True:
            parts = self.fine.get(c) if self.shift else self.held[c]
            if not parts:
                return
            n = k = 0
            while k < len(parts) and n < BLOCK:
                n += parts[k] % (BLOCK + 1) if isinstance(parts[k], int) else len(parts[k][0])
                k += 1
            now, parts[:k] = parts[:k], []
            _, p, common = self._joined(now)
            yield p, common

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def rising(t: np.ndarray, scratch: Scratch) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last, a unique smallest character, counts as rising."""
    n = len(t)
    up = scratch.empty(n, bool)
    up[n - 1] = nxt = True
    for b in range(n - 1, 0, -(1 << 20)):
        a = max(0, b - (1 << 20))
        here, then = np.asarray(t[a:b]), np.asarray(t[a + 1 : b + 1])
        kind = here < then
        last = np.where(here == then, b - a, np.arange(b - a))  # an equal neighbour hands down its own kind
        last = np.minimum.accumulate(last[::-1])[::-1]
        out = np.append(kind, nxt)[last]
        up[a:b] = out
        nxt = bool(out[0])
    return up


def _least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo : hi + 1] for each pair, by a table of the leasts over powers of two."""
    length = hi - lo + 1
    power = np.frexp(length.astype(np.float64))[1] - 1
    out = np.empty(len(lo), values.dtype)
    level, table = 0, values
    most = int(power.max()) if len(power) else 0
    for level in range(most + 1):
        at = np.flatnonzero(power == level)
        if len(at):
            out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << level) + 1])
        if level < most:
            half = 1 << level
            table = np.minimum(table[:-half], table[half:]) if len(table) > half else table
    return out


class _Scan:
    """What scanned suffixes put into the queues: their predecessors of one kind."""

    def __init__(self, t, up, want: bool, size: int, cap: int, queues: Queues, carries: bool):
        self.t, self.up, self.want, self.cap, self.queues, self.carries = t, up, want, cap, queues, carries
        self.carry = np.full(size, cap, np.int16)  # least common prefix scanned since a character's last tuple
        self.seen = np.zeros(size, bool)

    def feed(self, p: np.ndarray, common: np.ndarray | None) -> None:
        before = p - 1
        if not len(p):
            return
        ok = self.up[before] == self.want  # place -1 is the last one, whose kind is rising; it is left out below
        ok &= p > 0
        sel = np.flatnonzero(ok)
        if self.carries:
            low = int(common.min())
        if not len(sel):
            if self.carries:
                np.minimum(self.carry, low, out=self.carry)
            return
        ch = self.t[before[sel]]
        order = np.argsort(ch, kind="stable")
        sel, ch = sel[order], ch[order]
        if not self.carries:
            self.queues.put(ch, before[sel], None)
            return
        first = np.empty(len(ch), bool)
        first[0] = True
        np.not_equal(ch[1:], ch[:-1], out=first[1:])
        lo = np.empty(len(sel), np.int64)
        lo[0] = 0
        lo[1:] = sel[:-1] + 1
        lo[first] = 0
        least = _least(common, lo, sel)
        heads = ch[first]
        least[first] = np.minimum(least[first], self.carry[heads])
        new = np.minimum(least + 1, self.cap).astype(np.int16)
        fresh = ~self.seen[heads]
        if fresh.any():
            new[np.flatnonzero(first)[fresh]] = 0
            self.seen[heads] = True
        np.minimum(self.carry, low, out=self.carry)
        ends = np.flatnonzero(np.append(first[1:], True))
        tail = np.append(np.minimum.accumulate(common[::-1])[::-1], self.cap)
        self.carry[ch[ends]] = tail[sel[ends] + 1]
        self.queues.put(ch, before[sel], new)


def _shared(t: np.ndarray, a: int, b: int, cap: int) -> int:
    """Common prefix of two suffixes, read off the text."""
    n = min(cap, len(t) - max(a, b))
    bad = np.flatnonzero(np.asarray(t[a : a + n]) != np.asarray(t[b : b + n]))
    return int(bad[0]) if len(bad) else n


def induced(t, up, seeds, seed_common, size: int, cap: int, scratch: Scratch) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """All suffixes in descending order by blocks, each with its common prefix with the one before it in that order (capped), from the S* in ascending order with theirs; without those
    (the S* known by their first character only) no common prefixes are carried."""
    carries = seed_common is not None
    n = len(t)
    place = seeds.dtype
    first = np.asarray([np.searchsorted(t[seeds], c) for c in range(size + 1)]) if len(seeds) <= BLOCK else _starts(t, seeds, size)
    falling_p, falling_l = scratch.empty(n, place), scratch.empty(n if carries else 0, np.int16)
    bounds = np.zeros(size + 1, np.int64)
    queues = Queues(size, scratch, place, carries)
    scan = _Scan(t, up, False, size, cap, queues, carries)
    at = 0
    for c in range(size):
        bounds[c] = at
        for p, common in queues.take(c):
            falling_p[at : at + len(p)] = p
            if carries:
                falling_l[at : at + len(p)] = common
            at += len(p)
            scan.feed(p, common)
        for a in range(first[c], first[c + 1], BLOCK):
            b = min(first[c + 1], a + BLOCK)
            p, common = np.asarray(seeds[a:b]), None
            if carries:
                common = np.array(seed_common[a:b])
                if a == first[c]:
                    common[0] = _shared(t, int(falling_p[at - 1]), int(p[0]), cap) if at > bounds[c] else 0
            scan.feed(p, common)
    bounds[size] = at
    queues.close()
    queues = Queues(size, scratch, place, carries)
    scan = _Scan(t, up, True, size, cap, queues, carries)
    for c in range(size - 1, -1, -1):
        last = -1
        if c == t[n - 1]:
            p, common = np.array([n - 1], place), np.zeros(1, np.int16) if carries else None
            yield p, common
            last = n - 1
            scan.feed(p, common)
        for p, common in queues.take(c):
            yield p, common
            last = int(p[-1])
            scan.feed(p, common)
        nxt = None
        for b in range(bounds[c + 1], bounds[c], -BLOCK):
            a = max(bounds[c], b - BLOCK)
            p, common = np.asarray(falling_p[a:b])[::-1].copy(), None
            if carries:
                own = np.asarray(falling_l[a:b])[::-1]
                if nxt is None:
                    nxt = _shared(t, last, int(p[0]), cap) if last >= 0 else 0
                common = np.empty(len(p), np.int16)
                common[0], common[1:] = nxt, own[:-1]
                nxt = int(own[-1])
            yield p, common
            scan.feed(p, common)
    queues.close()


def _starts(t, seeds, size: int) -> np.ndarray:
    count = np.zeros(size + 1, np.int64)
    for a in range(0, len(seeds), 1 << 20):
        count[1:] += np.bincount(t[seeds[a : a + (1 << 20)]], minlength=size)
    return np.cumsum(count)


def _extended(t: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of pairs of suffixes that share `known` characters at least; pairs that differ early leave early."""
    out = known.astype(np.int64)
    at = np.flatnonzero(out < cap)
    n = len(t)
    while len(at):
        x, y = a[at] + out[at], b[at] + out[at]
        inside = (x < n) & (y < n)
        same = np.zeros(len(at), bool)
        same[inside] = t[x[inside]] == t[y[inside]]
        at = at[same]
        out[at] += 1
        at = at[out[at] < cap]
    return np.minimum(out, cap).astype(np.int16)


def _doubled(names: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of a string of names that fits in memory, as far as `depth` names tell them apart, and how many each shares with the one before it, as far as found.

    A rank is the number of smaller suffixes; only those that share theirs are sorted again, by the rank half a width on. The ranks of all widths are kept, and give the shared names.
    """
    n = len(names)
    count = np.bincount(names)
    bits = n.bit_length()
    low = (1 << bits) - 1
    rank = np.full(n + max(1, depth), -1, np.int32)  # behind the end there is nothing, which is smaller than all
    rank[:n] = (np.cumsum(count) - count)[names]
    left = np.flatnonzero(count[names] > 1)
    mine = rank[left]
    width, ranks = 1, [rank]
    while len(left) and width < depth:
        key = mine.astype(np.int64) << bits
        key |= rank[left + width] + 1
        if 3 * bits < 64:  # rank, next rank and place in one number, which sorts without an index
            key <<= bits
            key |= left
            key.sort()
            left = key & low
            key >>= bits
        else:
            order = np.argsort(key)
            left, key = left[order], key[order]
        old = (key >> bits).astype(np.int32)
        fresh = np.empty(len(left) + 1, bool)
        fresh[0] = fresh[-1] = True
        np.not_equal(key[1:], key[:-1], out=fresh[1:-1])
        heads = np.flatnonzero(fresh)  # of groups of equal pairs, with the end
        size = np.diff(heads)
        old = old[heads[:-1]]
        first = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
        old += heads[:-1] - np.repeat(heads[first], np.diff(np.append(first, len(old))))
        mine = np.repeat(old, size)
        rank = rank.copy()
        rank[left] = mine
        shared = np.repeat(size > 1, size)
        left, mine = left[shared], mine[shared]
        ranks.append(rank)
        width *= 2
    order = np.argsort(rank[:n].astype(np.int64) << bits | np.arange(n))
    shared = np.zeros(n, np.int64)
    if n > 1:
        a, b = order[:-1].copy(), order[1:].copy()
        for k in range(len(ranks) - 1, -1, -1):
            here = ranks[k][a]
            step = (((here == ranks[k][b]) & (here >= 0)).astype(np.int64)) << k
            a += step
            b += step
        shared[1:] = a - order[:-1]
    return order, shared


def _words(t, seeds, size: int, scratch: Scratch) -> tuple[np.ndarray, int]:
    """The first characters of each seed's piece in one number, and how many they are; what is behind the piece counts as 0."""
    bits = max(1, int(size - 1).bit_length())
    most, m = 62 // bits, len(seeds)
    most = min(most, 6)
    words = scratch.empty(m, np.int64)
    for a in range(0, m, 1 << 20):
        s = np.asarray(seeds[a : a + (1 << 20) + 1]).astype(np.int64)
        size_of = np.diff(np.append(s, len(t) - 1) if len(s) <= 1 << 20 else s) + 1
        s = s[: len(size_of)]
        word = np.zeros(len(s), np.int64)
        for step in range(most):
            word <<= bits
            word |= np.where(step < size_of, t[np.minimum(s + step, len(t) - 1)], 0)
        words[a : a + len(s)] = word
    return words, most


def _seeds_in_order(t, up, seeds, size: int, cap: int, scratch: Scratch, carries: bool = True):
    """The S* in ascending order and each one's common prefix with the one before it."""
    m, place = len(seeds), seeds.dtype
    is_seed = scratch.empty(len(t), bool)
    for a in range(0, m, 1 << 20):
        is_seed[seeds[a : a + (1 << 20)]] = True
    by_char = scratch.empty(m, place)
    starts, fill = _starts(t, seeds, size), None
    fill = starts[:-1].copy()
    for a in range(0, m, BLOCK):
        s = seeds[a : a + BLOCK]
        c = t[s]
        o = np.argsort(c, kind="stable")
        c = c[o]
        run = np.arange(len(c)) - np.searchsorted(c, c)
        by_char[fill[c] + run] = s[o]
        fill += np.bincount(c, minlength=size)
    order, at = scratch.empty(m, place), m
    for p, _ in induced(t, up, by_char, None, size, cap, scratch):
        p = p[is_seed[p]]
        order[at - len(p) : at] = p[::-1]
        at -= len(p)
    index = scratch.empty(len(t), place)  # of a seed among the seeds
    for a in range(0, m, 1 << 20):
        index[seeds[a : a + (1 << 20)]] = np.arange(a, min(m, a + (1 << 20)))
    names = scratch.empty(m, np.int64)
    count = 0
    words, most = _words(t, seeds, size, scratch)
    for a in range(0, m, 1 << 20):  # pieces run from one seed to the next, both included; equal ones are neighbours
        s = np.asarray(order[max(0, a - 1) : a + (1 << 20)]).astype(np.int64)
        k = np.asarray(index[s]).astype(np.int64)
        end = np.where(k + 1 < m, seeds[np.minimum(k + 1, m - 1)], len(t) - 1)
        size_of = end - s + 1
        word = words[k]
        like = (size_of[:-1] == size_of[1:]) & (word[:-1] == word[1:])
        pair = np.flatnonzero(like)
        step = most
        while len(pair):
            pair = pair[step < size_of[pair]]
            bad = t[s[pair] + step] != t[s[pair + 1] + step]
            like[pair[bad]] = False
            pair = pair[~bad]
            step += 1
        new = np.cumsum(np.concatenate([[a == 0], ~like]))
        if a:
            new, k = new[1:], k[1:]
        names[k] = count + new - 1
        count += int(new[-1])
    if count == m:
        common = scratch.empty(m, np.int16)
        known = lambda a, b: np.zeros(b - a, np.int64)
        rank_order = order
    else:
        depth = cap // 2 + 2  # a piece goes on by two characters at least
        if m <= SMALL or _digits(count) * m > 0.85 * len(t):  # a string that wouldn't shrink is sorted in memory as well
            at_, shared = _doubled(np.asarray(names), depth)
        else:
            at_, shared = _names_in_order(names, count, depth, scratch)
        rank_order = scratch.empty(m, place)
        common = scratch.empty(m, np.int16)
        for a in range(0, m, 1 << 20):
            rank_order[a : a + (1 << 20)] = seeds[at_[a : a + (1 << 20)]]

        def known(a: int, b: int) -> np.ndarray:
            i, k = np.asarray(at_[a:b]).astype(np.int64), np.asarray(shared[a:b]).astype(np.int64)
            return np.where(k > 0, np.asarray(seeds[np.minimum(i + k, m - 1)]).astype(np.int64) - seeds[i] + (i + k < m), 0)

    if carries:
        for a in range(0, m, 1 << 20):
            b = min(m, a + (1 << 20))
            here = np.asarray(rank_order[a:b]).astype(np.int64)
            prev = np.asarray(rank_order[max(0, a - 1) : b - (a == 0)]).astype(np.int64)
            if a == 0:
                prev = np.concatenate([here[:1], prev])
            low = np.minimum(np.maximum(known(a, b), 0), cap)
            got = _extended(t, prev[: len(here)], here, low, cap)
            if a == 0:
                got[0] = 0
            common[a:b] = got
    return rank_order, common


def _digits(count: int) -> int:
    return 1 if count <= DIGIT else 2 if count <= DIGIT * DIGIT else 3


def _names_in_order(names, count: int, depth: int, scratch: Scratch):
    """Order of the suffixes of a string of names, and how many names each shares with the one before: the same procedure over the digits of the names."""
    m = len(names)
    wide = _digits(count)
    base = int(np.ceil(count ** (1 / wide))) + 1
    u = scratch.empty(m * wide + 1, np.uint16)
    for a in range(0, m, 1 << 20):
        x = np.asarray(names[a : a + (1 << 20)])
        for k in range(wide):
            u[a * wide + k : (a + len(x)) * wide + k : wide] = (x // base ** (wide - 1 - k)) % base + 1
    u[m * wide] = 0
    order, shared, at = scratch.empty(m, np.int64), scratch.empty(m, np.int32), m
    low = None  # least common prefix since the last whole name
    for p, common in suffixes(u, depth * wide, scratch):
        keep = np.flatnonzero((p % wide == 0) & (p < m * wide))
        if low is not None and len(common):
            common = common.copy()
            common[0] = min(int(common[0]), low)
        if len(keep):
            least = np.minimum.reduceat(common[: keep[-1] + 1], np.concatenate([[0], keep[:-1] + 1]))
            order[at - len(keep) : at] = (p[keep] // wide)[::-1]
            # in descending order a suffix's value is its prefix in common with the next greater one
            vals = least // wide
            lo = at - len(keep)
            if at < m:
                shared[at] = vals[0]
            shared[lo + 1 : at] = vals[1:][::-1]
            at = lo
            rest = common[keep[-1] + 1 :]
            low = int(rest.min()) if len(rest) else None
        else:
            low = min(low if low is not None else 1 << 14, int(common.min())) if len(common) else low
    return order, shared


def suffixes(t: np.ndarray, cap: int, scratch: Scratch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffixes of t in descending order of their first `cap` characters by blocks, each with its common prefix with the one before it, `cap` at most. t: small integers, of which the last is the only 0."""
    n = len(t)
    place = np.int32 if n < 1 << 31 else np.int64
    if n == 1:
        yield np.zeros(1, place), np.zeros(1, np.int16)
        return
    size = max(int(np.asarray(t[a : a + (1 << 20)]).max()) for a in range(0, n, 1 << 20)) + 1
    up = rising(t, scratch)
    found = []
    for a in range(0, n, 1 << 20):
        here = np.asarray(up[max(0, a - 1) : a + (1 << 20)])
        found.append((np.flatnonzero(here[1:] & ~here[:-1]) + max(0, a - 1) + 1).astype(place))
    seeds = scratch.empty(sum(map(len, found)), place)
    at = 0
    for f in found:
        seeds[at : at + len(f)] = f
        at += len(f)
    del found
    order, common = _seeds_in_order(t, up, seeds, size, cap, scratch)
    yield from induced(t, up, order, common, size, cap, scratch)
