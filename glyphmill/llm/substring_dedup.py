"""Suffix-array deduplication: bytes covered by a 400-byte string that also starts anywhere else are removed, and repeated passages of more than 50 words are counted.

Runs. Every window of PASSAGE bytes has a minimiser, the least hash of its GRAM-byte strings, so equal windows have the same one at the same place. Runs of window starts with one minimiser are the
unit: rows of (minimiser, digest of the run's context, document, start). A context is the run and what its last window of WINDOW bytes reaches. Minimisers that occur once drop out, and runs
whose contexts are identical are one class that is covered whole.

Anchors. Contexts are dealt to shards by minimiser. A window of PASSAGE bytes around a minimiser holds SIDE more bytes on its left or on its right, so equal windows share one of two longer
strings, the anchors of their contexts: a context keeps only the starts whose anchor another one of its minimiser has. Contexts of a minimiser with more than HOT of them are dealt by anchor,
each side apart. This parts a frequent minimiser by its surroundings; only contexts with GRAM + SIDE equal bytes still meet.

Sorting. A shard streams its contexts, ordered by anchor, into a text that is suffix-sorted by induced.suffixes, in files beyond its limits; neighbours among the run starts in that order with
WINDOW or PASSAGE bytes in common mark both as repeated. Classes hand their spans back to all their runs, and a document's spans are merged and cut out. Strings are judged on the input, and
contexts never cross documents.

Defined results: a null or empty text has no bytes and nothing removed; texts under 400 bytes lose nothing; two equal rows remove each other's windows wholly; documents are known by their id,
and if an id repeats, spans found in any of its rows apply to each; an empty table gives an empty table; extra columns aren't read.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .shared import discard, written

#: Bytes of a string that is removed, of the least repeated stretch that is looked at, and words that make one a passage if there are more.
WINDOW, PASSAGE, PASSAGE_WORDS = 400, 256, 50
GRAM = 32
SIDE = (PASSAGE - GRAM) // 2
#: Bytes of a shard, about; contexts from which on a minimiser is parted by anchors.
SHARD, HOT = 6_000_000, 4000
#: Contexts whose names and places are in memory at once.
PART = 1 << 14
_SEGMENT = 1 << 23
_PLACE = np.uint64((1 << 24) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at every place."""
    n = len(data) - GRAM + 1
    padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
    words = np.empty(len(data), dtype=np.uint64)
    for j in range(8):
        part = np.frombuffer(padded[j : j + (len(padded) - j) // 8 * 8].tobytes(), "<u8")
        slots = words[j::8]
        slots[:] = part[: len(slots)]
    h = np.zeros(n, dtype=np.uint64)
    for j in range(0, GRAM, 8):
        h = (h ^ words[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def window_runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first start, number of starts and place of the minimiser behind the first start, of the runs of windows with one minimiser."""
    out: list[tuple] = []
    for at in range(0, max(1, len(data) - PASSAGE + 1), _SEGMENT):
        part = data[at : at + _SEGMENT + PASSAGE - 1]
        if len(part) < PASSAGE:
            break
        h = gram_hashes(part)
        width = PASSAGE - GRAM + 1
        key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)  # leftmost of equal hashes
        short = -len(key) % width
        rows = np.concatenate([key, np.full(short, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, width)
        left = np.minimum.accumulate(rows, axis=1).ravel()
        right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(part) - PASSAGE + 1
        place = (np.minimum(right[:n], left[width - 1 : width - 1 + n]) & _PLACE).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        out.append((h[place[first]].view(np.int64), at + first, np.diff(np.append(first, n)), place[first] - first))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 4


def _bytes(text) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


_RUN = "hash long, digest binary, doc_id long, start int, starts int, size int, at int"


def runs_of(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text). Every run: minimiser, digest of the context, document, first start, number of starts, bytes of the context, place of the minimiser."""
    import pyarrow as pa

    ship(docs.sparkSession)

    def run(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            parts: list[tuple] = []
            digests: list[bytes] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = _bytes(text.as_py())
                if len(raw) < PASSAGE:
                    continue
                h, s, k, at = window_runs(np.frombuffer(raw, dtype=np.uint8))
                e = np.minimum(len(raw), s + k + WINDOW - 1)
                digests += [xxh3_128_digest(raw[a:b]) for a, b in zip(s.tolist(), e.tolist())]
                parts.append((h, np.full(len(h), doc), s, k, e - s, at))
            cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 6
            arrays = [pa.array(cols[0], pa.int64()), pa.array(digests, pa.binary()), pa.array(cols[1], pa.int64()), *(pa.array(c.astype(np.int32), pa.int32()) for c in cols[2:])]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in _RUN.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _RUN)


def contexts_of(docs: DataFrame) -> DataFrame:
    """docs: (text, picks: array of hash, digest, start, starts, size, at, hot). Each pick's context under its minimiser (side 2), or if that is hot once for each side on which it has an anchor."""
    import pyarrow as pa

    names, types = ["side", "anchor", "hash", "digest", "starts", "at", "bytes"], [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches):
        from xxhash import xxh3_64_intdigest

        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            held = 0
            for text, picks in zip(batch.column(0), batch.column(1).to_pylist()):
                raw = _bytes(text.as_py())
                for p in picks:
                    body = raw[p["start"] : p["start"] + p["size"]]
                    g = p["at"]
                    sides = [] if p["hot"] else [(2, None)]
                    if p["hot"] and g >= SIDE:
                        sides.append((0, body[g - SIDE : g + GRAM]))
                    if p["hot"] and g + GRAM + SIDE <= len(body):
                        sides.append((1, body[g : g + GRAM + SIDE]))
                    for side, anchor in sides:
                        for c, v in zip(cols, (side, p["hash"] if anchor is None else signed(xxh3_64_intdigest(anchor)), p["hash"], p["digest"], p["starts"], g, body)):
                            c.append(v)
                        held += len(body)
                    if held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
                        cols, held = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return docs.select("text", "picks").mapInArrow(run, "side int, anchor long, hash long, digest binary, starts int, at int, bytes binary")


def packed(home: np.ndarray, starts: np.ndarray, width: int, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """Maximal [start, end) covered by the windows at starts, which are sorted by home and place: the home of each, and start, end and kind in one number (see SHIFT)."""
    if not len(starts):
        return home, starts
    new = np.concatenate([[True], (home[1:] != home[:-1]) | (starts[1:] - starts[:-1] > width)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return home[first], (starts[first] << 33) | ((starts[last] + width) << 1) | int(wide)


#: A span is start * 2 ** 33 + end * 2 + kind in a long, so that spans sort by start and move by n with n * SHIFT. Kind 1: WINDOW bytes; 0: PASSAGE bytes.
SHIFT = (1 << 33) + 2


class Shard:
    """The text of a shard, added context by context and held in a file, as are the contexts' names; its repeated starts by an external sort, marked in an array over the text."""

    def __init__(self, scratch):
        self.scratch, self.file, self.log = scratch, scratch.file(), None
        self.size = 0
        self.lengths: list[int] = []
        self.last: list[tuple] = []

    def add(self, name: tuple, starts: int, body: bytes) -> None:
        self.last.append((self.size, self.size + len(body), starts, name))
        self.file.write(body + b"\0")
        self.size += len(body) + 1
        if len(self.last) >= PART:
            self.log = self.log or self.scratch.file()
            data = pickle.dumps(self.last)
            self.log.write(data)
            self.lengths.append(len(data))
            self.last = []

    def parts(self):
        """The contexts in order by lists of (begin, end, starts, name)."""
        at = 0
        for length in self.lengths:
            self.log.seek(at)
            yield pickle.loads(self.log.read(length))
            at += length
        if self.last:
            yield self.last

    def marked(self) -> np.ndarray:
        """Bytes in common with another start, for each start with PASSAGE bytes that also start elsewhere; 0 at other places."""
        from .induced import suffixes

        n = self.size + 1
        t, own = self.scratch.empty(n, np.uint16), self.scratch.empty(n, bool)
        self.file.seek(0)
        at = 0
        while data := self.file.read(1 << 20):
            t[at : at + len(data)] = np.frombuffer(data, np.uint8).astype(np.uint16) + 2
            at += len(data)
        self.file.close()
        for part in self.parts():
            for b, e, k, _ in part:
                own[b : b + k] = True
                t[e] = 1
        marks = self.scratch.empty(n, np.int16)
        before, low = -1, 0
        for p, common in suffixes(t, WINDOW, self.scratch):
            common = common.copy()
            if before >= 0:
                common[0] = min(int(common[0]), low)
            keep = np.flatnonzero(own[p])
            if not len(keep):
                low = int(common.min())
                continue
            least = np.minimum.reduceat(common[: keep[-1] + 1], np.concatenate([[0], keep[:-1] + 1]))
            mine = p[keep].astype(np.int64)
            prev = np.concatenate([[before], mine[:-1]])
            found = np.flatnonzero((least >= PASSAGE) & (prev >= 0))
            for x in (mine[found], prev[found]):
                marks[x] = np.maximum(marks[x], least[found])
            before = int(mine[-1])
            rest = common[keep[-1] + 1 :]
            low = int(rest.min()) if len(rest) else WINDOW
        return marks

    def found(self):
        """By lists of contexts: the list, and number of the context in it, start in it and bytes in common with another start, of each repeated start in order."""
        marks = self.marked()
        for part in self.parts():
            begin, ends = np.array([x[0] for x in part]), np.array([x[1] for x in part])
            here = np.asarray(marks[begin[0] : ends[-1]])
            at = np.flatnonzero(here)
            places = at + begin[0]
            home = np.searchsorted(begin, places, side="right") - 1
            common = np.minimum(here[at], ends[home] - places)  # nothing counts beyond the end of a context
            keep = common >= PASSAGE
            yield part, home[keep], (places - begin[home])[keep], common[keep]

    def repeated(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the context, start in it and bytes in common with another start, of each start with PASSAGE bytes that also start elsewhere, in order."""
        none, number, out = np.zeros(0, np.int64), 0, []
        for part, home, starts, common in self.found():
            out.append((home + number, starts, common))
            number += len(part)
        return tuple(np.concatenate([none, *c]) for c in zip(*out)) if out else (none, none, none)

    def spans(self):
        """By lists: (name, packed spans) of each context that has any."""
        for part, home, starts, common in self.found():
            wide = common >= WINDOW
            h1, s1 = packed(home[wide], starts[wide], WINDOW, True)
            h0, s0 = packed(home, starts, PASSAGE, False)
            homes, both = np.concatenate([h1, h0]), np.concatenate([s1, s0])
            order = np.argsort(homes, kind="stable")
            homes, both = homes[order], both[order].tolist()
            first = np.flatnonzero(np.concatenate([[True], homes[1:] != homes[:-1]])) if len(homes) else homes
            bounds = [*first.tolist(), len(both)]
            yield [(part[k][3], both[a:b]) for k, a, b in zip(homes[first].tolist(), bounds[:-1], bounds[1:])]


def trimmed(starts: int, at: int, body: bytes, left: bool, right: bool) -> tuple[int, int, bytes]:
    """(bytes cut off in front, starts, context) of a context whose starts can match by the anchor on the left, on the right, or both; at: place of its minimiser."""
    middle = at - SIDE  # the last start with SIDE bytes in front of the minimiser, and the first with SIDE behind it
    if not left:
        front = max(0, middle)
        return front, starts - front, body[front:]
    if not right:
        starts = min(starts, middle + 1)
        return 0, starts, body[: starts - 1 + WINDOW]
    return 0, starts, body


def _of_group(group: list[tuple]):
    """A minimiser's contexts (hash, digest, starts, at, body), trimmed to the starts whose anchor stands in two of them, as (name, starts, body)."""
    from collections import Counter

    from xxhash import xxh3_64_intdigest

    sides = []
    for _, _, _, g, body in group:
        left = xxh3_64_intdigest(body[g - SIDE : g + GRAM]) if g >= SIDE else None
        right = xxh3_64_intdigest(body[g : g + GRAM + SIDE]) if g + GRAM + SIDE <= len(body) else None
        sides.append((left, right))
    counts = [Counter(x[k] for x in sides if x[k] is not None) for k in (0, 1)]
    for (hash_, digest, starts, g, body), (left, right) in zip(group, sides):
        two = left is not None and counts[0][left] > 1, right is not None and counts[1][right] > 1
        if any(two):
            front, starts, body = trimmed(starts, g, body, *two)
            if starts > 0:
                yield (hash_, digest, front), starts, body


def _sort_shards(batches):
    """Rows in order of shard and anchor to (hash, digest, spans); a shard's contexts go to its file as they come."""
    import pyarrow as pa

    from .induced import Scratch

    kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64())]

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def done(shard):
        for found in shard.spans():
            spans = [[x + front * SHIFT for x in xs] if front else xs for (_, _, front), xs in found]
            yield pa.RecordBatch.from_arrays([pa.array([f[0][0] for f in found], kinds[0]), pa.array([f[0][1] for f in found], kinds[1]), pa.array(spans, kinds[2])], ["hash", "digest", "spans"])

    current = shard = scratch = last = None
    group: list[tuple] = []  # a minimiser's contexts, HOT at most; of an anchor's the first one, which waits for a second

    def flush():
        if shard is not None and current % 3 == 2:
            for x in _of_group(group):
                shard.add(*x)
        group.clear()

    def add(side, hash_, digest, starts, at, body):
        front, starts, body = trimmed(starts, at, body, side == 0, side == 1)
        if starts > 0:
            shard.add((hash_, digest, front), starts, body)

    try:
        for number, anchor, *context in rows():
            if number != current:
                flush()
                if shard is not None and shard.size:
                    yield from done(shard)
                if scratch is not None:
                    scratch.__exit__()
                scratch = Scratch()
                current, shard, last = number, Shard(scratch), None
            if anchor != last:
                flush()
                last = anchor
                group.append(tuple(context))
            elif number % 3 == 2:
                group.append(tuple(context))
            else:
                if group:
                    add(number % 3, *group.pop())
                add(number % 3, *context)
        flush()
        if shard is not None and shard.size:
            yield from done(shard)
    finally:
        if scratch is not None:
            scratch.__exit__()


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal runs of sorted spans within raw, and what remains without them."""
    runs: list[list[int]] = []
    for s, e in spans:
        e = min(e, len(raw))
        if s < e:
            if runs and s <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], e)
            else:
                runs.append([s, e])
    kept, at = [], 0
    for s, e in runs:
        kept.append(raw[at:s])
        at = e
    return [tuple(r) for r in runs], b"".join([*kept, raw[at:]])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, spans, n_passages) of every row of docs (doc_id, text). kept: the bytes that remain; n_passages: maximal repeated stretches of PASSAGE bytes and
    more than PASSAGE_WORDS words, which a text may keep."""
    import pyarrow as pa

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    runs = written(runs_of(docs))
    row = F.struct("doc_id", "start", "starts", "size", "at")
    classes = written(runs.groupBy("hash", "digest").agg(F.count(F.lit(1)).alias("c"), F.min(row).alias("row")))
    shared = classes.groupBy("hash").agg(F.count(F.lit(1)).alias("d")).where("d > 1").select(F.greatest("hash", F.lit(-(1 << 63))).alias("hash"), (F.col("d") > HOT).alias("hot"))
    picks = written(classes.join(shared, "hash").select("hash", "digest", "row.*", "hot"))
    total = picks.agg(F.sum(F.col("size").cast("long"))).first()[0] or 0
    per_doc = picks.groupBy("doc_id").agg(F.collect_list(F.struct("hash", "digest", "start", "starts", "size", "at", "hot")).alias("picks"))
    contexts = contexts_of(docs.join(per_doc.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id")))
    shards = max(1, int(total) // SHARD)
    # a shard has anchors of one side only, so that no context meets itself
    numbered = contexts.select((F.pmod("anchor", F.lit(shards)) * 3 + F.col("side")).alias("shard"), "anchor", "hash", "digest", "starts", "at", "bytes")
    found = written(numbered.repartition(shards, "shard").sortWithinPartitions("shard", "anchor").mapInArrow(_sort_shards, "hash long, digest binary, spans array<long>"))
    discard(picks)
    whole = classes.where("c > 1").select(
        "hash", "digest",
        F.expr(
            f"if(row.size >= {WINDOW}, array((row.starts + {PASSAGE - 1}) * 2L, (least(row.starts - 1, row.size - {WINDOW}) + {WINDOW}) * 2L + 1L), array((row.starts + {PASSAGE - 1}) * 2L))"
        ).alias("spans"),
    )
    marked = found.join(whole.select("hash", "digest"), ["hash", "digest"], "left_anti").unionByName(whole)
    marked = marked.select(F.greatest("hash", F.lit(-(1 << 63))).alias("hash"), F.concat("digest", F.lit(b"")).alias("digest"), "spans")
    hits = runs.join(marked, ["hash", "digest"]).select("doc_id", F.expr(f"transform(spans, x -> x + start * {SHIFT}L)").alias("spans"))
    spans = written(hits.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")).withColumnRenamed("doc_id", "_id"))

    def cut(batches):
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans", "n_passages"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])), pa.int64()]
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for doc, text, found_ in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                raw = _bytes(text.as_py())
                runs_, rest = _cut(raw, [(x >> 33, x >> 1 & 0xFFFFFFFF) for x in found_ or () if x & 1])
                some, _ = _cut(raw, [(x >> 33, x >> 1 & 0xFFFFFFFF) for x in found_ or ()])
                passages = sum(len(raw[s:e].split()) > PASSAGE_WORDS for s, e in some)
                for c, v in zip(cols, (doc, len(raw), len(raw) - len(rest), len(runs_), rest, [{"s": s, "e": e} for s, e in runs_], passages)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    for done in (runs, classes, found):
        discard(done)
    joined = docs.join(spans, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<s:int,e:int>>, n_passages long")


def op9_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and repeated: whether the text has a passage of more than PASSAGE_WORDS words that also stands elsewhere, be it shorter than what is removed."""
    from .shared import table

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_passages") > 0).alias("repeated"))
