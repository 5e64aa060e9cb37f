"""MinHash near-deduplication with tensored banding.

Signatures. A document's distinct five-word shingles become 64-bit hashes. Two families of TABLES collections hold ROWS minhashes each; every pair of one collection of either
family keys one table, so 2 * TABLES * ROWS minhashes serve TABLES ** 2 tables of 2 * ROWS rows. At similarity 0.85 a pair meets in no table with
probability 1 - (1 - (1 - 0.85 ** 3) ** 9) ** 2 < 0.0004.

Candidates. Documents with equal shingle sets are one class with its smallest id. Per table key only the smallest class is kept (an aggregate with a partial step), and each
class is tied to it; connected ties are families, and a link can only join classes of one family. Inside a family a shingle that one class alone has can't
be shared, so a class of which more than 15 of 100 shingles are its own can't be linked at all: this drops, exactly, what shared passages and chance bring together.

Links. The full sets of the classes that remain are dealt by family into blocks that hold a bounded number of sets and of shingles, and each pair of blocks is one group of
an exchange of its own: shared shingles become the columns of a 0/1 matrix whose product gives all intersection sizes, so every pair is confirmed on full sets and no pair
leaves the task; what leaves is a spanning forest. A family beyond a few sets is cut into up to SPREAD blocks to use many tasks, and into more only as the bounds demand:
its sets are copied once for each of its blocks, so the work inside one family of distinct, able sets grows with its square. Components of the forests give the result.

Defined results: null text counts as empty, is linked with nothing and is its own component; fewer than five words are one shingle of the whole sequence; rows with the same id are
one document that has the links of each; an empty table gives an empty table; extra columns aren't read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .shared import components, discard, written

WORDS = 5
TABLES, ROWS = 9, 3
SEED = 20_240_607
#: Shingles and sets of a block, about; blocks of a family from NEAR * 2 sets on, as far as the bounds don't ask for more.
BLOCK, SETS, NEAR, SPREAD = 1_000_000, 2_000, 64, 16
_P = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    import xxhash

    out = []
    for w in (text or "").encode("utf-8", "surrogatepass").lower().split():  # both know ASCII only
        h = known.get(w)
        if h is None:
            if len(known) > 500_000:
                known.clear()
            h = known[w] = xxhash.xxh64_intdigest(w, 7)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, known: dict[bytes, int], size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    w = word_hashes(text, known)
    if not len(w):
        return w
    n = max(1, len(w) - size + 1)
    h = np.full(n, np.uint64(min(len(w), size)))
    for k in range(min(size, len(w))):
        h = _mixed(h * _P + w[k : k + n])
    return np.unique(h)


def _coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)


def minhashes(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(s), 4096):
        part = s[None, k : k + 4096] * a[:, None] + b[:, None]
        low = np.minimum(low, (part ^ (part >> np.uint64(32))).min(axis=1))
    return low


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, set_key, keys): 128 bits of the set, and the hash of each collection, first family first."""
    import pyarrow as pa

    ship(docs.sparkSession)

    def run(batches):
        import xxhash

        known: dict[bytes, int] = {}
        a, b = _coefficients(2 * TABLES * ROWS)
        for batch in batches:
            ids, sizes, sets, keys = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingles(text.as_py(), known)
                ids.append(i)
                sizes.append(len(s))
                if len(s):
                    sets.append(xxhash.xxh3_128_digest(s.tobytes()))
                    m = minhashes(s, a, b).reshape(2 * TABLES, ROWS)
                    h = np.zeros(2 * TABLES, dtype=np.uint64)
                    for r in range(ROWS):
                        h = _mixed(h * _P + m[:, r])
                    keys.append(h.view(np.int64))
                else:
                    sets.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "keys"]
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, keys array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """docs: (node, family, text). The same with the text's shingle hashes and the key of that set in its place."""
    import pyarrow as pa

    def run(batches):
        import xxhash

        known: dict[bytes, int] = {}
        for batch in batches:
            sets = [shingles(t.as_py(), known) for t in batch.column(2)]
            keys = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), keys], ["node", "family", "set", "set_key"])

    return docs.select("node", "family", "text").mapInArrow(run, "node long, family long, set array<long>, set_key binary")


def linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among sets, as pairs of places: 100 * intersection >= percent * union."""
    alive = np.arange(len(sets))
    n = np.array([len(s) for s in sets])
    while len(alive) > 1:  # what only one set has can't be shared; leaving a set out makes more of that
        flat = np.concatenate([sets[k] for k in alive])
        owner = np.repeat(np.arange(len(alive)), n[alive])
        _, col, times = np.unique(flat, return_inverse=True, return_counts=True)
        own = np.bincount(owner, weights=times[col] == 1, minlength=len(alive))
        stay = 100 * (n[alive] - own) >= percent * n[alive]
        if stay.all():
            break
        alive = alive[stay]
    if len(alive) < 2:
        return []
    shared = times[col] > 1
    names, col = np.unique(col[shared], return_inverse=True)
    owner = owner[shared]
    size = n[alive].astype(np.float64)
    inter = np.zeros((len(alive), len(alive)), dtype=np.float32)
    wide = max(1, 16_000_000 // len(alive))
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    for at in range(0, len(names), wide):
        lo, hi = np.searchsorted(col, (at, at + wide))
        x = np.zeros((len(alive), min(wide, len(names) - at)), dtype=np.float32)
        x[owner[lo:hi], col[lo:hi] - at] = 1
        inter += x @ x.T
    root = np.arange(len(alive))
    forest = []

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k in range(len(alive)):
        both = inter[k, k + 1 :].astype(np.float64)
        for j in np.nonzero(100 * both >= percent * (size[k] + size[k + 1 :] - both))[0] + k + 1:
            a, b = find(k), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                forest.append((int(alive[k]), int(alive[j])))
    return forest


def _block_links(percent: int):
    def run(pdf):
        import pandas as pd

        rows = pdf.drop_duplicates(["node", "set_key"]).sort_values(["node", "set_key"])
        nodes = rows["node"].to_numpy()
        pairs = linked([np.asarray(s, dtype=np.int64) for s in rows["set"]], percent)
        return pd.DataFrame({"a": [nodes[x] for x, _ in pairs], "b": [nodes[y] for _, y in pairs]}, dtype="int64").query("a != b")

    return run


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    signed = written(signatures(docs, id_col, text_col))
    classes = signed.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys"))
    classes = written(classes)
    sides = lambda k: F.slice("keys", 1 + k * TABLES, TABLES)
    first = classes.select("node", F.posexplode(sides(0)).alias("i", "x"), sides(1).alias("ys"))
    tables = first.select("node", "i", "x", F.posexplode("ys").alias("j", "y")).select("node", F.xxhash64("i", "j", "x", "y").alias("key"))
    low = tables.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    # Spark's estimate counts the exploded rows of a class as one, so below its broadcast threshold both sides can hold millions of rows: never broadcast
    low = low.select(F.greatest("key", F.lit(-(1 << 63))).alias("key"), "low").hint("merge")
    ties = tables.join(low, "key").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    families = written(components(ties).select("node", F.col("root").alias("family")))
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).join(families, "node")
    # an id can have several texts, and some of them may belong to a class of another id
    named = classes.select(F.greatest("node", F.lit(-(1 << 63))).alias("node"), "set_key")
    sets = written(shingle_sets(texts).dropDuplicates(["node", "set_key"]).join(named, ["node", "set_key"], "left_semi"))
    one = F.struct("node", "set_key").alias("one")
    own = sets.select(one, "family", F.explode("set").alias("s")).groupBy("family", "s").agg(F.count(F.lit(1)).alias("n"), F.min("one").alias("one")).where("n = 1")
    own = own.groupBy("one").agg(F.count(F.lit(1)).alias("own")).select("one.node", "one.set_key", "own")
    able = sets.join(own, ["node", "set_key"], "left").where(100 * (F.size("set") - F.coalesce("own", F.lit(0))) >= percent * F.size("set")).select("node", "set_key", "family", "set")
    needed = lambda x, bound: F.ceil(x / bound)
    blocks = able.groupBy("family").agg(F.sum(F.size("set")).alias("s"), F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = blocks.select(F.greatest("family", F.lit(-(1 << 63))).alias("family"), F.greatest(needed(F.col("s"), BLOCK), needed(F.col("n"), SETS), F.least(F.lit(SPREAD), needed(F.col("n"), NEAR))).cast("int").alias("blocks"))
    dealt = able.join(blocks, "family").withColumn("mine", F.pmod(F.xxhash64("node", "set_key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("family", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "node", "set_key", "set")
    # the join has dealt rows by family, which would do for the grouping as well and leave all pairs of a family to one task
    links = written(dealt.repartition("family", "p", "q").groupBy("family", "p", "q").applyInPandas(_block_links(percent), "a long, b long"))
    roots = components(links)
    members = signed.join(classes.select("set_key", "node"), "set_key", "left").select("doc_id", "n_shingles", "set_key", F.coalesce("node", "doc_id").alias("node"))
    out = members.join(roots, "node", "left").select("doc_id", "n_shingles", F.coalesce("root", "node").alias("component_id"))
    for done in (families, sets):
        discard(done)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op4_near_dup(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    return near_duplicates(table(spark, sf_dir, "documents"))
