"""Quality rules as a short-circuit cascade.

Each rule has a measure and a bound. On a bounded sample (rows by the hash of their text, from a few files) the operator estimates what evaluating each rule costs and how much it rejects, and orders the rules
by rejection per cost. The verdict is one nested CASE in that order, so a document that an early cheap rule rejects never reaches the dear ones. The order changes cost only, never the verdict.

Native DataFrame operations only and no shuffle: everything about a document is computed in its own row. Repeated five-word windows are found by
64-bit hashes of word hashes; only documents with a repeated hash sort theirs.

Defined results: a null text has no words and fails the base; an empty table gives an empty table; extra columns are carried along unless they begin with "_q_"; a column
named rejected_by is replaced by the result.
"""

from __future__ import annotations

import hashlib
import time
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, whole_text, words, written

WINDOW = 5
#: Rows of the sample on which cost and selectivity are estimated; the order of rules is all that depends on it.
SAMPLE_ROWS, SAMPLE_FILES = 1000, 8


@dataclass(frozen=True)
class Rule:
    """A rule rejects where the SQL condition holds. It may name the measures below, which are inlined where they are used."""

    name: str
    rejects: str


#: Bounds of the rules.
RULES = (
    Rule("too_few_words", "{n_words} < 10"),
    Rule("repeated_windows", "100 * {n_repeat_words} > 20 * {n_words}"),
    Rule("symbols", "10 * {n_symbols} > {n_words}"),
    Rule("duplicate_lines", "{n_dup_lines} > 2 and 10 * {n_dup_lines} > 3 * {n_lines}"),
    Rule("word_length", "{word_chars} < 2 * {n_words} or {word_chars} > 14 * {n_words}"),
    Rule("bullet_lines", "{n_lines} > 2 and 10 * {n_bullet_lines} > 9 * {n_lines}"),
    Rule("ellipsis_lines", "{n_lines} > 2 and 10 * {n_ellipsis_lines} > 3 * {n_lines}"),
    Rule("letterless_words", "2 * {n_letterless} > {n_words}"),
)
BASE_RULES = ("too_few_words", "repeated_windows")


_BULLET, _ELLIPSIS, _LETTER = r"^[ \\t]*[-*•]", r"(?:…|[.][.][.])[ \\t]*$", r"[\\p{L}]"
#: Measures that the query returns for every row; the others are worked out only where the cascade gets to their rule.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _lines() -> str:
    return "split(_q_text, '\\n')"


def _measures() -> dict[str, str]:
    spaces = "concat(' ', char(9), char(10), char(11), char(12), char(13))"
    worded = f"filter({_lines()}, s -> btrim(s, {spaces}) <> '')"
    return {
        "n_words": "cast(size(_q_words) as bigint)",
        "word_chars": "cast(length(array_join(_q_words, '')) as bigint)",
        "n_symbols": "cast(length(regexp_replace(_q_text, '[^#*$%&|<>]+', '')) as bigint)",
        "n_lines": f"cast(size({worded}) as bigint)",
        "n_dup_lines": f"cast(size({worded}) - size(array_distinct({worded})) as bigint)",
        "n_repeat_words": _repeated(),
        "n_bullet_lines": f"cast(size(filter({_lines()}, s -> s rlike '{_BULLET}')) as bigint)",
        "n_ellipsis_lines": f"cast(size(filter({_lines()}, s -> s rlike '{_ELLIPSIS}')) as bigint)",
        "n_letterless": f"cast(size(filter(_q_words, w -> not w rlike '{_LETTER}')) as bigint)",
    }


def _repeated() -> str:
    """Words covered by windows whose hash occurs twice or more: sort (hash, place) where any hash repeats, keep places beside an equal hash, add up their cover."""
    k = WINDOW
    # word hashes first: an element of an array costs the same at any length, a slice costs the whole array
    hashes = f"transform(array(transform(_q_words, x -> xxhash64(x))), w -> transform(sequence(0, size(w) - {k}), i -> xxhash64({', '.join(f'w[i + {j}]' for j in range(k))})))[0]"
    # one-element arrays bind an expensive value once
    order = "sort_array(transform(h, (x, i) -> struct(x as h, i as p)))"
    hits = "filter(transform(s, (x, i) -> case when x.h = get(s, i - 1).h or x.h = get(s, i + 1).h then x.p end), p -> p is not null)"
    cover = f"aggregate(transform(p, (x, i) -> least({k}L, cast(get(p, i + 1) - x as bigint))), 0L, (a, x) -> a + x)"
    places = f"transform(array({order}), s -> sort_array({hits}))[0]"
    return (
        f"case when size(_q_words) <= {k} then 0L else transform(array({hashes}), h -> case when size(array_distinct(h)) = size(h) then 0L "
        f"else transform(array({places}), p -> {cover})[0] end)[0] end"
    )


def with_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumn("_q_text", whole_text(text_col)).withColumn("_q_words", words(F.col("_q_text")))


def _condition(rule: Rule, names: dict[str, str]) -> str:
    return rule.rejects.format(**{k: f"({v})" for k, v in names.items()})


def _sample(docs: DataFrame, text_col: str, rows: int) -> DataFrame:
    """About so many texts, by their hash, of the first SAMPLE_FILES files by the digest of their names, in the shared folder."""
    files = docs.inputFiles()
    if len(files) > SAMPLE_FILES:
        chosen = sorted(files, key=lambda f: hashlib.md5(f.encode()).hexdigest())[:SAMPLE_FILES]
        try:
            docs = docs.where(F.col("_metadata.file_path").isin(chosen))
        except AnalysisException:  # not a plain scan
            pass
    wanted = min(1 << 32, -(-(rows << 32) // max(1, docs.count())))
    return written(docs.where(F.pmod(F.xxhash64(text_col), F.lit(1 << 32)) < wanted).select(F.col(text_col).alias("text")))


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """The rules with cost in seconds and share rejected, as measured on sample_rows rows, in the order in which the cascade applies them."""
    sample = with_words(_sample(docs, text_col, sample_rows)).cache()
    n = sample.count()
    found, names = [], _measures()
    for rule in rules:
        hit = sample.agg(F.sum(F.expr(_condition(rule, names)).cast("int")).alias("n"))
        began = time.perf_counter()
        rejected = hit.first()["n"] or 0
        cost = time.perf_counter() - began
        found.append({"rule": rule, "cost": cost, "share": rejected / max(1, n)})
    sample.unpersist()
    floor = min(x["cost"] for x in found) * 0.9
    # nothing rejected: the cheapest go first
    return sorted(found, key=lambda x: (-x["share"] / (x["cost"] - floor), x["cost"]))


def cascade(order: list[Rule], names: dict[str, str]) -> str:
    """SQL for the name of the first rule that rejects, else null; later rules aren't evaluated then."""
    return "case " + " ".join(f"when {_condition(r, names)} then '{r.name}'" for r in order) + " end"


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """docs with rejected_by: the first rule of the cascade that rejects the row, or null."""
    order = [x["rule"] for x in plan_cascade(docs, rules, text_col)]
    # text and words are bound inside the expression: a filter on the verdict is pushed down with it, and names of columns would be replaced by what computes them
    names = {k: v.replace("_q_text", "q.t").replace("_q_words", "q.w") for k, v in _measures().items()}
    bound = F.array(F.struct(whole_text(text_col).alias("t"), words(whole_text(text_col)).alias("w")))
    docs = docs.drop("rejected_by").withColumn("_q_bound", bound)
    return docs.withColumn("rejected_by", F.expr(f"transform(_q_bound, q -> {cascade(order, names)})[0]")).drop("_q_bound")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    order = [x["rule"] for x in plan_cascade(docs)]
    m = _measures()
    rows = with_words(docs).select("doc_id", "_q_text", "_q_words", *[F.expr(m[k]).alias(k) for k in MEASURES])
    known = m | {k: k for k in MEASURES}
    base = " or ".join(f"({_condition(r, known)})" for r in RULES if r.name in BASE_RULES)
    judged = rows.withColumn("base_failed", F.expr(base)).withColumn("kept", ~F.col("base_failed") & F.expr(cascade(order, known)).isNull())
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tok AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
win AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS g
        FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win WHERE g IS NOT NULL) x WHERE c >= 2),
cov AS (SELECT doc_id, sum(least(5, coalesce(lead_i - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS lead_i FROM rep) y GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
        len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^[ \t]*[-*•]'))) AS n_bullet, len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '(?:…|[.][.][.])[ \t]*$'))) AS n_ellipsis,
        len(list_filter(ws, lambda x: NOT regexp_matches(x, '\pL'))) AS n_letterless
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT ((n_lines > 2 AND (10 * n_bullet > 9 * n_lines OR 10 * n_ellipsis > 3 * n_lines)) OR 2 * n_letterless > n_words OR n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words OR (n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines)
       OR word_chars < 2 * n_words OR word_chars > 14 * n_words) AS kept
FROM m
"""
