"""Edges of the ten operators and of the pipeline's stages: repeated rows and ids, clashing columns, nulls, empty and very long texts, ties, empty tables; and the registered queries as they are."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import exact_dedup, line_dedup, mixing, near_dup, packing, quality, registry, secret_scan, substring_dedup, tokens, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names of results of any operator, as columns of the input.
CLASHING = ("epoch", "tokens", "tokens_before", "leaf_budget", "kept_text", "n_lines", "n_dropped", "rejected_by", "base", "spans", "kept", "score", "predicted", "node", "family", "hash", "digest", "bytes", "key", "component_id", "piece", "salt")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Repeated rows, one id with several texts, ties, nulls, empty texts, one of a megabyte."""
    rng = random.Random(5)
    line = "a line that is long enough to count and that many rows of these documents share"
    rows = [(i, prose(rng, 30) + "\n" + line, "en", "src1", 1) for i in (1, 1, 1, 2, 2)]
    rows += [(7, prose(rng, 60), "de", None, 2), (7, prose(rng, 60), None, "src0", 2)]
    twin = prose(rng, 80)
    rows += [(8, twin, "en", "src7", 3)] * 3 + [(9, twin.upper(), "en", "src7", 3), (7, twin + " x", "en", "src7", 3)]
    rows += [(20, None, None, None, None), (20, None, None, None, None), (21, "", "en", "src0", 0), (22, prose(rng, 180_000), "fr", "src9", 9), (23, "x" * 1_000_000, "es", "src9", 9)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, odd):
    out = spark.createDataFrame(odd, SCHEMA)
    for k, name in enumerate(CLASHING):
        out = out.withColumn(name, F.lit(k))
    return out.repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_quality(docs, odd, empty):
    out = quality.apply_rules(docs)
    assert out.count() == len(odd) and set(out.columns) == set(docs.columns) and quality.apply_rules(empty).count() == 0
    assert {r.doc_id for r in out.where("rejected_by = 'too_few_words'").collect()} == {20, 21, 23}


def test_secrets(docs, odd, empty):
    out = secret_scan.scan(docs, secret_scan.train(docs))
    assert out.count() == len(odd) and set(out.columns) == set(docs.columns) and out.where("size(base) > 0").count() == 0
    assert secret_scan.scan(empty, secret_scan.train(empty)).count() == 0


def test_models_know_no_order(spark, docs):
    rng = random.Random(3)
    rows = [(i, f'{prose(rng, 20)} token = "{"".join(rng.choice("0123456789abcdef") for _ in range(30))}"') for i in range(300)]
    one = spark.createDataFrame(rows, "doc_id long, text string")
    rng.shuffle(rows)
    other = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert secret_scan.train(one, sample_rows=40) == secret_scan.train(other, sample_rows=40)


def test_lines(docs, odd, empty):
    got = line_dedup.dedup_lines(docs)
    assert got.count() == len(odd) and set(got.columns) == set(docs.columns)
    assert got.where("n_dropped > 0").count() == 0  # five rows, but two documents
    want = collections.Counter((i, hashlib.md5((t or "").encode()).hexdigest()) for i, t, *_ in odd)
    assert collections.Counter((r.doc_id, r.h) for r in got.select("doc_id", F.md5("kept_text").alias("h")).collect()) == want
    more = docs.unionByName(docs.where("doc_id = 1").limit(1).withColumn("doc_id", F.explode(F.array(F.lit(30), F.lit(31), F.lit(32)))))
    dropped = {(r.doc_id, r.n_dropped) for r in line_dedup.dedup_lines(more).where("n_dropped > 0").collect()}
    assert {i for i, _ in dropped} == {1, 2, 30, 31} and (1, 1) in dropped
    assert line_dedup.dedup_lines(empty).count() == 0


def test_many_dropped_lines(spark):
    """A text whose every second of 20,000 lines goes, line by line in its place."""
    common = [f"line number {k} of those that all of the five documents hold in common" for k in range(10_000)]
    rows = [(i, "\n".join(x for k, ln in enumerate(common) for x in (ln, f"own {i} {k}"))) for i in range(5)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[4].n_dropped == 0 and all(got[i].n_dropped == 10_000 and got[i].kept_text == "\n".join(f"own {i} {k}" for k in range(10_000)) for i in range(4))


def test_near(docs, odd, empty):
    out = {}
    for r in near_dup.near_duplicates(docs).collect():
        out.setdefault(r.doc_id, set()).add(r.component_id)
    assert out[7] == out[8] == out[9] == {7} and out[20] == {20} and out[1] == {1} and out[2] == {2} and out[22] == {22}
    assert near_dup.near_duplicates(docs).count() == len(odd) and near_dup.near_duplicates(empty).count() == 0


def test_blocks_of_a_large_family(spark, monkeypatch):
    """A family of near copies parted into many blocks and pairs of blocks gives the same components."""
    rng = random.Random(9)
    words = prose(rng, 300).split()
    rows = []
    for i in range(300):
        w = list(words)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = "q" + str(rng.randrange(10**6))
        rows.append((i, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    one = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame).collect()}
    monkeypatch.setattr(near_dup, "SETS", 20)
    monkeypatch.setattr(near_dup, "BLOCK", 3_000)
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame).collect()} == one and len(set(one.values())) < 300


def broadcast_rows(spark, work):
    """Rows of each table that was broadcast while work ran, by Spark's own counts."""
    bus, store = spark._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty(30_000)
    runs = store.executionsList()
    before = max((runs.apply(k).executionId() for k in range(runs.size())), default=-1)
    work()
    bus.waitUntilEmpty(30_000)
    runs, out = store.executionsList(), []
    for run in (runs.apply(k).executionId() for k in range(runs.size())):
        if run > before:
            nodes, counts = store.planGraph(run).allNodes(), store.executionMetrics(run)
            for node in (nodes.apply(k) for k in range(nodes.size())):
                for m in (node.metrics().apply(k) for k in range(node.metrics().size())):
                    if node.name().startswith("BroadcastExchange") and m.name() == "number of output rows" and counts.contains(m.accumulatorId()):
                        out.append(int(counts.apply(m.accumulatorId()).replace(",", "")))
    return out


@pytest.fixture
def small_broadcasts(spark):
    """300 texts of their own and near copies of 30, under a broadcast threshold that their estimated band keys pass and the real ones exceed."""
    rng = random.Random(12)
    rows = [(i, prose(rng, 60), "en", "src0", 1) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " x", "en", "src0", 1) for i in range(30)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    yield spark.createDataFrame(rows, SCHEMA).repartition(2).cache()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_pipeline_broadcasts_no_bands(spark, small_broadcasts):
    import corpus_pipeline

    kept = []
    sent = broadcast_rows(spark, lambda: kept.extend(r.doc_id for r in corpus_pipeline.near_duplicates(spark, small_broadcasts, "").collect()))
    assert sorted(kept) == list(range(300)) and max(sent, default=0) <= 2 * 330


def test_near_duplicates_broadcast_no_bands(spark, small_broadcasts):
    got = []
    sent = broadcast_rows(spark, lambda: got.extend(near_dup.near_duplicates(small_broadcasts).collect()))
    assert {r.doc_id: r.component_id for r in got} == {i: i % 1000 for i in [*range(300), *range(1000, 1030)]} and max(sent, default=0) <= 2 * 330


def test_mixing(docs, odd, empty):
    out = mixing.mix(docs, mixing.domain_of(F.col("source")), fraction=1.0, epochs=1)
    assert set(out.columns) == set(docs.columns) and {r.doc_id for r in out.collect()} <= {r[0] for r in odd} and out.count() >= len(odd) - 3
    assert mixing.mix(empty, mixing.domain_of(F.col("source"))).count() == 0


def test_exact(spark, docs, odd, tmp_path):
    path = str(tmp_path / "d.parquet")
    docs.write.parquet(path)
    got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup_exact(spark, path).collect())
    groups = collections.defaultdict(list)
    for i, t, *_ in odd:
        groups[(t or "").lower()].append(i)
    assert got == collections.Counter((i, max(g), len(g), i == max(g)) for g in groups.values() for i in g)
    docs.where("false").write.parquet(str(tmp_path / "none.parquet"))
    assert exact_dedup.dedup_exact(spark, str(tmp_path / "none.parquet")).count() == 0


def test_exact_with_a_hot_text_and_a_false_hit(spark, tmp_path, monkeypatch):
    """A text of a third of all rows is salted; two texts under one digest are told apart by their bytes."""
    rows = [(i, "the same hot text" if i % 3 else f"text {i}") for i in range(900)]
    path = str(tmp_path / "hot.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(path)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.dedup_exact(spark, path).collect()}
    assert got == {i: (899, 600) if i % 3 else (i, 1) for i, _ in rows}
    sha2 = F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.substring(sha2(c, n), 1, 1))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.dedup_exact(spark, path).collect()}
    assert got == {i: (899, 600) if i % 3 else (i, 1) for i, _ in rows}


def test_substrings(docs, odd, empty):
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect())
    assert sum(got.values()) == len(odd) and (22, len(odd[-2][1]), 0) in got and (23, 1_000_000, 1_000_000) in got and got[(20, 0, 0)] == 2
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_packing(docs, odd, empty):
    encode = tokens.encoder(packing.tokenizer_path())
    got = packing.pack(docs, packing.tokenizer_path()).collect()
    want = sum(len(encode(t or "")) // 4 + 1 for _, t, *_ in odd)
    assert sum(r.length for r in got) == want and sum(r.piece == 0 for r in got) == len(odd)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.pack(empty, packing.tokenizer_path()).count() == 0


def test_toxicity(spark, docs, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (8, 0), (22, 0)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = toxicity.score(docs, model)
    assert got.count() == len(odd) and got.where("score < 0 or score > 1").count() == 0 and toxicity.score(empty, model).count() == 0


def test_lexicon_hits_against_search():
    """The automaton finds what a search for every entry finds, and spares what lies in an exception."""
    rng = random.Random(11)
    entries = {f" {prose(rng, 1)} ": 2.0 for _ in range(40)} | {f" {prose(rng, 1)[:4]}": 1.5 for _ in range(40)}
    exceptions = [f" {prose(rng, 2)} " for _ in range(20)] + [e + "harm " for e in list(entries)[:10]]
    model = toxicity.Model(entries, exceptions, (0.0, 1.0))
    for _ in range(60):
        text = " " + " ".join(rng.choice([prose(rng, 1), rng.choice(list(entries)).strip(), rng.choice(exceptions).strip()]) for _ in range(60)) + " "
        spared = [(m.start(), m.start() + len(e) - 1) for e in exceptions for m in re.finditer(f"(?={re.escape(e)})", text)]
        best: dict = {}
        for e, w in entries.items():
            for m in re.finditer(f"(?={re.escape(e)})", text):
                if not any(a <= m.start() < b for a, b in spared):
                    best[m.start()] = max(best.get(m.start(), 0.0), w)
        assert model.hits(text) == sorted(best.items())


def test_warc(spark):
    big = "<p>" + "x é " * 600 + "</p>"
    rows = [(1, "u", big), (1, "u", big + "!"), (2, "u", big), (2, "u", big), (3, None, None), (3, "u", "short"), (4, "u", "y" * 1_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit(5)).withColumn("mark", F.lit("m"))
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    want = collections.Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        later = h == big and i == 1
        want[(i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if later else "response", 2 if later else None)] += 1
    assert got == want


def test_secret_models_on_held_out_samples(spark):
    """Random strings and ordinary identifiers that no model has seen: recall by length, precision."""
    rng = random.Random(17)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    stems = "request handler parser token buffer network service customer account record window string method factory builder session stream config value index result target source message element version system module object context default number process thread manager filter update create delete select insert order".split()
    ident = lambda: rng.choice(["_", "-", ""]).join(rng.choice([str.lower, str.capitalize])(rng.choice(stems)) for _ in range(rng.randint(1, 4)))
    train = [(i, " ".join(ident() for _ in range(40)) + f' token = "{"".join(rng.choice(alphabet) for _ in range(32))}"') for i in range(400)]
    ratios = secret_scan.train(spark.createDataFrame(train, "doc_id long, text string"))
    tests = [(f"r{n}", "".join(rng.choice(alphabet) for _ in range(n))) for n in (10, 12, 16, 20, 24, 32) for _ in range(200)] + [("id", ident()) for _ in range(2000)]
    rows = spark.createDataFrame([(k, f"the {t} here") for k, t in tests], "kind string, text string")
    hit = {r.kind: r.share for r in secret_scan.scan(rows, ratios).groupBy("kind").agg(F.avg((F.size("spans") > 0).cast("int")).alias("share")).collect()}
    print(hit)
    assert hit["id"] < 0.01 and hit["r16"] > 0.9 and hit["r20"] > 0.97 and hit["r32"] > 0.99


# --- the pipeline and the registered queries ---
@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(23)
    line = "This Line is shared by many of the documents and is long enough"
    rows = []
    for i in range(80):
        text = prose(rng, rng.randint(6, 160))
        if i % 4 == 0:
            text += "\n" + line
        if i % 6 == 5:
            text = rows[i - 3][1] + " tail"
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["src0", "src1", "src7", None]), len(text)))
    rows += [(90, None, None, None, None), (91, "", "en", "src0", 0), (92, prose(rng, 9000), "en", "src0", 1)]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(i, "u", t) for i, t, *_ in rows], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path, rows


def brute(rows):
    """The pipeline's first four stages in plain Python; the mixture keeps, in each leaf, the seeded prefix within its budget."""
    kept = []
    for r in rows:
        w = WORD.findall(r[1] or "")
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        if len(w) >= 10 and 100 * len(cover) <= 20 * len(w) and 2 * len(w) <= sum(map(len, w)) <= 14 * len(w):
            kept.append(list(r))
    held = collections.defaultdict(set)
    key = lambda ln: ln.strip(" \t\n\x0b\x0c\r").lower()
    for r in kept:
        for ln in r[1].split("\n"):
            if len(key(ln)) >= 40:
                held[key(ln)].add(r[0])
    for r in kept:
        r[1] = "\n".join(ln for ln in r[1].split("\n") if not (len(held[key(ln)]) >= 5 and max(held[key(ln)]) != r[0]))
    sets = {r[0]: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for r in kept if (w := WORD.findall(r[1].lower()))}
    root = {r[0]: r[0] for r in kept}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [r for r in kept if find(r[0]) == r[0]]


def fill(nodes, budget):
    """Water-filling: nodes {name: (cap, weight)} to {name: share}; what saturated ones leave goes to the others by weight."""
    share, open_, left = {}, dict(nodes), budget
    while open_:
        total = sum(w for _, w in open_.values())
        full = {k: c for k, (c, w) in open_.items() if c <= left * w / total}
        if not full:
            return share | {k: left * w / total for k, (_, w) in open_.items()}
        for k, c in full.items():
            share[k] = c
            left -= c
            del open_[k]
    return share


def mixture(rows, fraction):
    digit = lambda s: "web" if s and s[-1] in "0123456" else "books" if s and s[-1] in "78" else "code" if s and s[-1] == "9" else "other"
    leaf = {r[0]: (digit(r[3]), r[2] or "", r[3] or "") for r in rows}
    size = {r[0]: len(WORD.findall(r[1])) for r in rows}
    caps = collections.Counter()
    for i, k in leaf.items():
        caps[k] += size[i]
    cap = lambda *pre: sum(c for k, c in caps.items() if k[: len(pre)] == pre)
    taken = set()
    top = fill({d: (cap(d), mixing.DOMAIN_WEIGHTS.get(d, 1.0)) for d in {k[0] for k in caps}}, fraction * sum(caps.values()))
    for d, b in top.items():
        mid = fill({x: (cap(d, x), mixing.LANG_WEIGHTS.get(x, 1.0)) for x in {k[1] for k in caps if k[0] == d}}, b)
        for x, b2 in mid.items():
            for s, b3 in fill({s: (caps[(d, x, s)], 1.0) for s in {k[2] for k in caps if k[:2] == (d, x)}}, b2).items():
                before = 0
                for i in sorted((i for i, k in leaf.items() if k == (d, x, s)), key=lambda i: hashlib.md5(f"7:0:{i}".encode()).hexdigest()):
                    if before < b3 - 1e-9:
                        taken.add(i)
                    before += size[i]
    return taken


def test_pipeline_against_plain_python(spark, folder):
    import corpus_pipeline as c

    path, rows = folder
    cur = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in c.STAGES[:3]:
        cur = stage(spark, cur, path)
        assert cur.columns == [x.split()[0] for x in SCHEMA.split(", ")], name
    want = brute(rows)
    assert {(r.doc_id, r.text) for r in cur.collect()} == {(r[0], r[1]) for r in want}
    left = mixture(want, c.MIX_FRACTION)
    mixed = c.mixture(spark, cur, path)
    assert {r.doc_id for r in mixed.collect()} == left
    encode = tokens.encoder(packing.tokenizer_path())
    pieces = {}
    for i, t, *_ in want:
        if i in left:
            body = encode(t) + b"\0\0\0\0"
            for k, (s, n) in enumerate(packing.cut(len(body) // 4, 2048)):
                pieces[(i, k)] = (s, n, zlib.crc32(body[4 * s : 4 * (s + n)]))
    out = c.run(spark, path).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out} == pieces and len(out) == len(pieces)
    by = collections.defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    assert all(sorted(p)[k][0] == sum(n for _, n in sorted(p)[:k]) for p in by.values() for k in range(len(p)))


def test_pipeline_on_odd_and_empty_tables(spark, docs, odd, tmp_path):
    import corpus_pipeline as c

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id for r in c.run(spark, str(tmp_path)).collect()} <= {r[0] for r in odd}
    docs.where("false").write.parquet(str(tmp_path / "none/documents.parquet"))
    assert c.run(spark, str(tmp_path / "none")).count() == 0
    for name, stage in c.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() >= 0 and (name == "packing" or set(out.columns) == set(docs.columns)), name


COLUMNS = {
    "op1_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset", "op2_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op3_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans", "op4_near_dup": "doc_id n_shingles component_id kept", "op6_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op7_exact_dedup": "doc_id keep_id group_size kept text_sha256", "op8_warc": "page_id payload_bytes payload_digest record_type refers_to", "op9_suffix_array_dedup": "doc_id n_bytes n_removed n_spans kept_sha256", "op10_toxicity": "doc_id held_out score predicted",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_registered_query(spark, folder, name):
    path, rows = folder
    out = registry.queries()[name](spark, path)
    assert out.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()
    got = out.collect()
    if name == "op1_best_fit_packing":
        assert {r.doc_id for r in got} == {r[0] for r in rows}
    else:
        assert len(got) == len(rows)
    if name == "op3_secret_scan":
        assert all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got)
    if name == "op10_toxicity":
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for r in got)
