"""Secret scans: base patterns plus two character Markov models compared by log-likelihood ratio.

The base finds assignments, access keys and long hexadecimal runs. Their values, from a bounded sample, are the labelled random strings; words of a bounded
sample are the labelled ordinary identifiers. A row is in a sample by the hash of its id and text alone, so neither order nor partitions matter. Two order-one Markov models over a fixed alphabet are fitted from their bigram counts, and every token of 8 characters or more
of every whole text is scored by its log-likelihood ratio; tokens above a threshold that depends on their length become spans of kind "random" unless a base span overlaps them.

Native DataFrame operations only and no shuffle over texts; only bigram counts (at most two alphabets squared) reach the driver.

Defined results: null counts as empty and has no spans; an empty table gives an empty table and fits nothing; extra columns are carried along unless they
begin with "_s_"; columns named base or spans are replaced by the results. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import whole_text

#: The patterns, in the order in which kinds are listed.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
TOKEN = r"[A-Za-z0-9+/_=-]{8,}"
PLAIN = r"[A-Za-z0-9+/_=-]{2,}"
#: A token is a secret if its log-likelihood ratio exceeds THRESHOLD for each pair of characters and MARGIN for the whole, so a short one needs a higher mean. Under 8 characters
#: words and random strings overlap, whatever the threshold: of sf0.01's words the highest have 13, and 5 of 100 random strings of 6 characters are below that.
THRESHOLD = 0.4
MARGIN = 14.0
#: Weight of the single-character model in the identifiers' model.
BACK_OFF = 8.0
#: Bounds of the labelled samples, in expectation: words come from so many rows, base values from those of SEARCHED times as many rows that have one.
SAMPLE_ROWS, SEARCHED = 2000, 64


def _spans(pattern: str, kind: int, keep: str) -> str:
    """SQL for array<struct<start, kind, end, hit>> of the pattern's matches, from the pieces between matches; keep is a condition over h (the match) and v (group 2 or the match)."""
    n = 2 if kind == 0 else 0
    fold = (
        "aggregate(sequence(0, size(b.hits) - 1), named_struct('at', 0, 'out', cast(array() as array<struct<start:int,kind:int,end:int,hit:string,v:string>>)), "
        f"(a, i) -> named_struct('at', a.at + length(b.parts[i]) + length(b.hits[i]), 'out', array_append(a.out, named_struct('start', a.at + length(b.parts[i]), "
        f"'kind', {kind}, 'end', a.at + length(b.parts[i]) + length(b.hits[i]), 'hit', b.hits[i], 'v', b.vals[i]))), a -> a.out)"
    )
    bound = f"array(struct(split(_s_text, r'{pattern}', -1) as parts, regexp_extract_all(_s_text, r'{pattern}', 0) as hits, regexp_extract_all(_s_text, r'{pattern}', {n}) as vals))"
    return f"case when _s_text rlike r'{pattern}' then filter(transform({bound}, b -> {fold})[0], x -> {keep}) else cast(array() as array<struct<start:int,kind:int,end:int,hit:string,v:string>>) end"


def with_base(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds _s_base: the base spans in order of start, then kind."""
    d = docs.withColumn("_s_text", whole_text(text_col))
    # a run that fails its length takes part in no other match, so these two bounds can stand in the pattern
    access, hexes = f"AKIA[A-Z0-9]{{{ACCESS_MIN - 4},}}", f"[0-9a-f]{{{HEX_MIN},}}"
    d = d.select("*", F.expr(_spans(ASSIGN, 0, f"length(x.v) >= {ASSIGN_MIN}")).alias("_s_0"), F.expr(_spans(access, 1, "true")).alias("_s_1"), F.expr(_spans(hexes, 2, "true")).alias("_s_2"))
    return d.withColumn("_s_base", F.array_sort(F.concat("_s_0", "_s_1", "_s_2")))


def train(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id") -> list[float]:
    """Log-likelihood ratios of the two models, one for each pair of alphabet characters, row by row. The prior of random strings is uniform, so they need few samples."""
    rows = max(1, docs.count())
    place = F.pmod(F.xxhash64(*([id_col] if id_col in docs.columns else []), text_col), F.lit(1 << 32))
    d = docs.select(F.col(text_col).alias("text"), place.alias("place"))
    among = lambda wanted: d.where(F.col("place") < min(1 << 32, -(-(wanted << 32) // rows))).select("text")
    hit = F.col("text").rlike(f"{ASSIGN}|{ACCESS}|[0-9a-f]{{{HEX_MIN},}}")
    secrets = with_base(among(SEARCHED * sample_rows).where(hit)).select(F.explode("_s_base.v").alias("s"), F.lit(1).alias("label"))
    # samples have the shape of the tokens that are judged, so that hyphens, slashes and rules of signs count as ordinary
    rest = F.regexp_replace("text", f"{ASSIGN}|{ACCESS}|[0-9a-f]{{{HEX_MIN},}}", " ")
    plain = among(sample_rows).where("text is not null").select(F.explode(F.array_distinct(F.regexp_extract_all(rest, F.lit(PLAIN), F.lit(0)))).alias("s"))
    # long tokens with digits are what is to be judged, so they are no samples of ordinary identifiers
    plain = plain.where(~((F.length("s") >= 16) & F.col("s").rlike("[0-9]"))).withColumn("label", F.lit(0))
    # characters as an array: one step each, however long a token is
    pairs = f"transform(array(transform(split(s, ''), c -> instr('{ALPHABET}', c))), p -> transform(sequence(1, size(p) - 1), i -> struct(p[i - 1] as a, p[i] as b)))[0]"
    grams = secrets.union(plain.select("s", "label")).where("length(s) > 1").select("label", F.explode(F.expr(pairs)).alias("g")).select("label", "g.a", "g.b")
    counts = grams.where("a > 0 and b > 0").groupBy("label", "a", "b").count().collect()
    n = len(ALPHABET)
    random, plain_ = [1.0] * (n * n), [0.0] * (n * n)
    for r in counts:
        (random if r["label"] else plain_)[(r["a"] - 1) * n + r["b"] - 1] += r["count"]
    # after a character that identifiers don't show, their model falls back on how often each character occurs in them at all
    once = [0.5 + sum(plain_[b::n]) for b in range(n)]
    out = []
    for a in range(n):
        x, y = random[a * n : (a + 1) * n], plain_[a * n : (a + 1) * n]
        out += [math.log(x[b] / sum(x)) - math.log((y[b] + BACK_OFF * once[b] / sum(once)) / (sum(y) + BACK_OFF)) for b in range(n)]
    return out


def scan(docs: DataFrame, ratios: list[float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with base (array of start, kind, end, hit, v) and spans (the same, base and random ones together, in order)."""
    n = len(ALPHABET)
    places = f"transform(split(x.hit, ''), c -> instr('{ALPHABET}', c) - 1)"
    score = f"transform(array({places}), p -> aggregate(sequence(1, size(p) - 1), 0D, (a, i) -> a + _s_ratios[p[i - 1] * {n} + p[i]]))[0] - {MARGIN}D"
    d = with_base(docs.drop(*[c for c in ("base", "spans") if c in docs.columns]), text_col).withColumn("_s_ratios", F.from_json(F.lit(json.dumps(ratios)), "array<double>"))
    apart = "not exists(_s_base, y -> y.start < x.end and x.start < y.end)"
    d = d.withColumn("_s_3", F.expr(_spans(TOKEN, 3, f"{apart} and {score} > {threshold}D * (length(x.hit) - 1)")))
    d = d.withColumn("base", F.col("_s_base")).withColumn("spans", F.array_sort(F.concat("_s_base", "_s_3")))
    return d.drop("_s_text", "_s_0", "_s_1", "_s_2", "_s_3", "_s_base", "_s_ratios")


def _joined(col: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({col}, x -> concat({names}[x.kind], ':', x.start, ':', x.end)), ',')"


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(docs))
    count = lambda k: F.expr(f"cast(size(filter(base, x -> x.kind = {k})) as bigint)")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.expr(_joined("base")).cast("binary"), 256).alias("base_sha256"), F.expr(_joined("spans")).alias("spans"),
    )
