"""Pattern packing by non-negative least squares.

Documents become token pieces of at most `length` tokens; only longer documents are cut, and their first piece takes the remainder. Packing then works on the histogram
of piece lengths alone: patterns of one to three lengths that fill a sequence are enumerated, their repeat counts are fitted to the histogram by
non-negative least squares, rounded down and held to what the histogram has; what remains is packed best-fit in decreasing length, still as counts.
The plan says for each length which ranks go to which run of sequences and at which offset, so its size depends on `length` only, whatever the number of documents.
Pieces get their rank within their length by a two-step count over (length, bucket), and so a length that a third of all pieces have is spread over tasks.

Defined results: a null or empty text is the terminator alone; repeated ids are packed row by row; an empty table gives an empty table; extra columns aren't read.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ship import ship
from .shared import written

LENGTH = 2048
#: Patterns of three lengths take their shortest from multiples of length / THIRD.
THIRD = 32
STEPS = 300
SHARES = (1.0, 0.6, 0.3)


def patterns(hist: np.ndarray) -> np.ndarray:
    """Rows of three lengths (0: none) that fill a sequence exactly and whose lengths occur. hist[n]: pieces of length n."""
    top = len(hist) - 1
    rows = [(top, 0, 0)]
    rows += [(a, top - a, 0) for a in range(1, top // 2 + 1)]
    for a in range(max(1, top // THIRD), top // 3 + 1, max(1, top // THIRD)):
        rows += [(a, b, top - a - b) for b in range(a, (top - a) // 2 + 1)]
    out = np.array(rows)
    there = (hist > 0) | (np.arange(top + 1) == 0)
    return out[there[out].all(axis=1)]


def fit(pats: np.ndarray, hist: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths near the histogram in the least-squares sense (accelerated projected gradient)."""
    n, width = len(hist), pats.shape[1]
    if not len(pats):
        return np.zeros(0)
    target = hist.astype(float)
    target[0] = 0

    def use(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(pats[:, k], x, n) for k in range(width))
        out[0] = 0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        return sum(r[pats[:, k]] for k in range(width))

    v = np.ones(len(pats))
    for _ in range(20):
        v = back(use(v))
        v /= np.linalg.norm(v) or 1
    step = 1 / (1.05 * float(v @ back(use(v))) or 1)
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(use(y) - target))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def plan_packing(hist: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """(lengths of a sequence, how many such sequences), ...; and the number of sequences. hist[n]: pieces of length n, n from 0 to the sequence length; hist[0] is ignored.

    The fitted counts are rounded whole and scaled down by SHARES, which leaves more or less to the residual packing, and the plan with the fewest sequences is taken.
    """
    first = [0, *(int(x) for x in hist[1:])]
    pats = patterns(np.array(first))
    x = fit(pats, np.array(first))
    return min((_rounded(first, pats, share * x) for share in SHARES), key=lambda plan: plan[1])


def _rounded(first: list[int], pats: np.ndarray, x: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    left = list(first)
    top = len(left) - 1
    done: dict[tuple[int, ...], int] = defaultdict(int)
    for k in np.argsort(-x, kind="stable"):
        times = int(round(x[k]))
        if times < 1:
            break
        lengths = tuple(int(n) for n in pats[k] if n)
        need = {n: lengths.count(n) for n in lengths}
        times = min(times, *(left[n] // c for n, c in need.items()))
        if times > 0:
            done[lengths] += times
            for n, c in need.items():
                left[n] -= times * c
    # best fit in decreasing length over what remains; open sequences are kept as counts by their free room
    rooms: list[dict[tuple[int, ...], int]] = [{} for _ in range(top + 1)]

    def put(free: int, lengths: tuple[int, ...], times: int) -> None:
        rooms[free][lengths] = rooms[free].get(lengths, 0) + times

    for n in range(top, 0, -1):
        c = left[n]
        room = n
        while c and room <= top:
            if not rooms[room]:
                room += 1
                continue
            lengths, times = rooms[room].popitem()
            each = room // n
            whole = min(times, c // each)
            if whole:
                put(room - each * n, lengths + (n,) * each, whole)
                c -= whole * each
                times -= whole
            if times and c:
                put(room - c * n, lengths + (n,) * c, 1)
                times, c = times - 1, 0
            if times:
                rooms[room][lengths] = rooms[room].get(lengths, 0) + times
        if c:
            each = top // n
            if c // each:
                put(top - each * n, (n,) * each, c // each)
            if c % each:
                put(top - (c % each) * n, (n,) * (c % each), 1)
    for open_ in rooms:
        for lengths, times in open_.items():
            done[lengths] += times
    runs = sorted(done.items())
    return runs, sum(t for _, t in runs)


def place_table(runs: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length, runs of ranks: rank r of length n from `first` on goes to sequence base + r - first, at offset."""
    used: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for lengths, times in runs:
        at = 0
        for n in lengths:
            rows.append((n, used[n], base, at))
            used[n] += times
            at += n
        base += times
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return {"key": (cols[:, 0] << 48) + cols[:, 1], "first": cols[:, 1], "base": cols[:, 2], "offset": cols[:, 3]}


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the remainder comes first."""
    head = n % length or length
    return [(0, head)] + [(s, length) for s in range(head, n, length)]


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row."""
    import pyarrow as pa

    ship(docs.sparkSession)

    def run(batches):
        import zlib

        from .tokens import encoder

        encode = encoder(tokenizer)
        for batch in batches:
            cols = [[], [], [], [], []]
            ids = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = encode(text or "") + b"\0\0\0\0"
                for k, (s, n) in enumerate(cut(len(body) // 4, length)):
                    part = body[4 * s : 4 * (s + n)]
                    for c, v in zip(cols, (i, k, s, n, zlib.crc32(part))):
                        c.append(v)
                    if keep_ids:
                        ids.append(np.frombuffer(part, "<u4").astype("i4").tolist())
            arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    shape = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, shape)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """The pieces of every row with their place: sequence_id and offset."""
    import pyarrow as pa

    spark = docs.sparkSession
    cut_up = written(pieces(docs, tokenizer, length, id_col, text_col, keep_ids))
    counts = cut_up.groupBy("length").count().collect()  # at most `length` rows
    hist = np.zeros(length + 1, dtype=np.int64)
    for r in counts:
        hist[r["length"]] = r["count"]
    runs, _ = plan_packing(hist)
    places = spark.sparkContext.broadcast(place_table(runs))  # bounded by the number of patterns, a function of length
    buckets = max(64, int(hist.sum()) // 200_000)
    rows = cut_up.withColumn("_p_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    per = rows.groupBy("length", "_p_bucket").agg(F.count(F.lit(1)).alias("_p_n"))
    before = Window.partitionBy("length").orderBy("_p_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("length", "_p_bucket", F.coalesce(F.sum("_p_n").over(before), F.lit(0)).alias("_p_before"))
    inside = Window.partitionBy("length", "_p_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("_p_rank", F.row_number().over(inside) - 1).join(per, ["length", "_p_bucket"]).withColumn("rank", F.col("_p_rank") + F.col("_p_before"))
    out_cols = ["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if keep_ids else [])

    def place(batches):
        t = places.value
        for batch in batches:
            n, r = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            k = np.searchsorted(t["key"], (n << 48) + r, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in out_cols), pa.array(t["base"][k] + r - t["first"][k]), pa.array(t["offset"][k])], [*out_cols, "sequence_id", "offset"]
            )

    shape = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "") + ", sequence_id long, offset long"
    return ranked.select(*out_cols, F.col("rank").cast("long").alias("rank")).mapInArrow(place, shape)


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
