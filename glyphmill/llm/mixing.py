"""Mixing sources to target weights: a hierarchical budget over a tree of domain, language and source, then a seeded token prefix of each leaf.

Every node gets its parent's budget by weight. A node whose subtree holds less than its share takes all it has, and what it leaves goes to its siblings by
their weights; only what a whole sibling group can't hold goes to the parent's siblings, because a node's share is bounded by its subtree before its parent's
group is filled. This is water-filling, level by level from the root. Each leaf then reads its rows in a seeded order, epoch after epoch, and keeps the prefix that
begins before its budget is used up; the last row may go over it.

Native DataFrame operations only. Budgets are computed on one row per node. A leaf's running sum is taken in two steps, over buckets of the seeded order
first and inside each bucket after. There are as many buckets as the root of the number of rows, so no window holds a whole leaf, even if one source has a third of all rows,
and neither step grows faster than that root.

Defined results: null text has no tokens and null domain, language or source is a node of its own named ""; rows without tokens stay with a leaf that has a budget above zero;
repeated ids are ordered by the digest of their text; an empty table gives an empty table; extra columns are carried along unless they begin with "_m_";
columns with the name of a result (epoch, tokens, tokens_before, leaf_budget) are replaced by it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import whole_text, words

RESULTS = ("epoch", "tokens", "tokens_before", "leaf_budget")
#: Domains of the op5 query by the last digit of a source, and the weights of domains and languages; anything else weighs 1.
DOMAIN_OF_DIGIT = {"web": "0123456", "books": "78", "code": "9"}
DOMAIN_WEIGHTS = {"web": 5.0, "books": 3.0, "code": 2.0}
LANG_WEIGHTS = {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}


def domain_of(source: Column) -> Column:
    last = F.substring(F.coalesce(source, F.lit("")), -1, 1)
    out = F.lit("other")
    for name, digits in DOMAIN_OF_DIGIT.items():
        out = F.when((last != "") & F.contains(F.lit(digits), last), F.lit(name)).otherwise(out)
    return out


def _weight(col: str, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for k, v in weights.items():
        out = F.when(F.col(col) == k, F.lit(float(v))).otherwise(out)
    return out


def _fill(nodes: DataFrame, parents: list[str], me: str, budget: str, weight: Column) -> DataFrame:
    """Water-filling among siblings: nodes has one row per node with cap, and its parent's budget; adds share.

    In order of cap over weight the saturated siblings come first: a sibling is saturated if the level that its cap would need still fits the parent's budget.
    """
    rows = nodes.withColumn("_m_w", weight).withColumn("_m_r", F.col("cap") / F.col("_m_w"))
    order = Window.partitionBy(*parents).orderBy("_m_r", me)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parents)
    rows = rows.withColumn("_m_cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("_m_w_before", F.coalesce(F.sum("_m_w").over(before), F.lit(0.0)))
    rows = rows.withColumn("_m_w_rest", F.sum("_m_w").over(whole) - F.col("_m_w_before"))
    full = F.col("_m_cap_before") + F.col("_m_r") * F.col("_m_w_rest") <= F.col(budget)
    rows = rows.withColumn("_m_full", full)
    # what is left for those that aren't saturated, by weight
    rows = rows.withColumn("_m_left", F.col(budget) - F.sum(F.when(full, F.col("cap")).otherwise(0.0)).over(whole)).withColumn("_m_open", F.sum(F.when(full, F.lit(0.0)).otherwise(F.col("_m_w"))).over(whole))
    return rows.withColumn("share", F.when(F.col("_m_full"), F.col("cap")).otherwise(F.col("_m_left") * F.col("_m_w") / F.col("_m_open")))


def budgets(leaves: DataFrame, total: Column, weights: list[dict[str, float]], epochs: int) -> DataFrame:
    """leaves: (domain, lang, source, tokens). Returns them with budget. total: share of all tokens as a column over the one-row sum "all_tokens"."""
    leaves = leaves.withColumn("cap", F.col("tokens").cast("double") * epochs)
    top = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"))
    all_tokens = F.sum("cap").over(Window.partitionBy()) / epochs
    top = top.withColumn("_m_b", all_tokens).withColumn("_m_b", total)
    one = F.lit(0).alias("_m_root")
    top = _fill(top.select("*", one), ["_m_root"], "domain", "_m_b", _weight("domain", weights[0])).select("domain", F.col("share").alias("_m_b"))
    mid = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(top, "domain")
    mid = _fill(mid, ["domain"], "lang", "_m_b", _weight("lang", weights[1])).select("domain", "lang", F.col("share").alias("_m_b"))
    low = leaves.join(mid, ["domain", "lang"])
    low = _fill(low, ["domain", "lang"], "source", "_m_b", _weight("source", weights[2]))
    return low.select("domain", "lang", "source", "tokens", F.col("share").alias("budget"))


def mix(
    docs: DataFrame, domain: Column, fraction: float = 0.6, epochs: int = 1, seed: int = 7, weights: list[dict[str, float]] | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """docs that the mixture takes, one row per epoch, with epoch, tokens, tokens_before and leaf_budget. fraction: tokens to take over tokens there are."""
    weights = weights or [DOMAIN_WEIGHTS, LANG_WEIGHTS, {}]
    none = F.lit("")
    buckets = math.isqrt(docs.count()) + 1
    docs = docs.drop(*[c for c in RESULTS if c in docs.columns])
    rows = docs.withColumns({
        "_m_domain": F.coalesce(domain, none), "_m_lang": F.coalesce(F.col("lang"), none), "_m_source": F.coalesce(F.col("source"), none),
        "_m_tokens": F.size(words(whole_text(text_col))).cast("long"), "_m_tie": F.md5(whole_text(text_col)),
    })
    slim = rows.select(F.col("_m_domain").alias("domain"), F.col("_m_lang").alias("lang"), F.col("_m_source").alias("source"), F.col("_m_tokens").alias("tokens"), F.col(id_col).alias("_m_id"), "_m_tie")
    leaves = slim.groupBy("domain", "lang", "source").agg(F.sum("tokens").alias("tokens"))
    plan = budgets(leaves, F.col("_m_b") * F.lit(float(fraction)), weights, epochs).select("domain", "lang", "source", "budget")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "epoch", F.coalesce(F.col("_m_id").cast("string"), none)))
    turns = slim.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("_m_order", order).withColumn("_m_bucket", F.shiftright(F.conv(F.substring("_m_order", 1, 8), 16, 10).cast("long") * buckets, 32))
    leaf = ["domain", "lang", "source"]
    sums = turns.groupBy(*leaf, "epoch", "_m_bucket").agg(F.sum("tokens").alias("_m_sum"))
    running = Window.partitionBy(*leaf).orderBy("epoch", "_m_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_m_start", F.coalesce(F.sum("_m_sum").over(running), F.lit(0))).join(plan, leaf).where("_m_start < budget")
    # an own exchange for this side lets adaptive execution split hot buckets
    starts = starts.select(*leaf, "epoch", F.greatest("_m_bucket", F.lit(-1)).alias("_m_bucket"), "_m_start", "budget")
    inside = Window.partitionBy(*leaf, "epoch", "_m_bucket").orderBy("_m_order", "_m_tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("_m_inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(starts, [*leaf, "epoch", "_m_bucket"])
    taken = placed.withColumn("tokens_before", F.col("_m_start") + F.col("_m_inside")).where("tokens_before < budget")
    picks = taken.select("_m_id", F.col("_m_tie").alias("_m_tie2"), "epoch", "tokens", "tokens_before", F.col("budget").alias("leaf_budget")).distinct()
    out = rows.join(picks, rows[id_col].eqNullSafe(picks["_m_id"]) & (rows["_m_tie"] == picks["_m_tie2"]))
    return out.select(*[rows[c] for c in docs.columns], "epoch", "tokens", "tokens_before", "leaf_budget")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = mix(docs, domain_of(F.col("source")), fraction=0.6, epochs=2)
    return out.select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", "epoch", "tokens", "tokens_before", F.round("leaf_budget", 3).alias("leaf_budget"))


def _level(name: str, parents: str, me: str, weight: str, src: str) -> str:
    part = f"PARTITION BY {parents}" if parents else ""
    return f"""
{name}_a AS (SELECT *, {weight} AS w FROM {src}),
{name}_b AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS cap_before, sum(w) OVER ({part}) - coalesce(sum(w) OVER o, 0) AS w_rest FROM {name}_a
  WINDOW o AS ({part} ORDER BY cap / w, {me} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_c AS (SELECT *, cap_before + cap / w * w_rest <= b AS is_full FROM {name}_b),
{name} AS (SELECT *, CASE WHEN is_full THEN cap ELSE (b - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({part})) * w / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({part}) END AS share FROM {name}_c)"""


OP5_SQL = (
    r"""
WITH d AS (SELECT doc_id, lang, source, CASE WHEN right(source, 1) IN ('7', '8') THEN 'books' WHEN right(source, 1) = '9' THEN 'code' WHEN regexp_matches(right(source, 1), '[0-6]') THEN 'web' ELSE 'other' END AS domain,
  CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, 2.0::DOUBLE * sum(tokens) AS cap FROM d GROUP BY domain, lang, source),
t0 AS (SELECT domain, sum(cap) AS cap, 0.6::DOUBLE * (SELECT sum(cap) FROM leaves) / 2 AS b FROM leaves GROUP BY domain),"""
    + _level("t", "", "domain", "CASE domain WHEN 'web' THEN 5.0::DOUBLE WHEN 'books' THEN 3.0 WHEN 'code' THEN 2.0 ELSE 1.0 END", "t0")
    + ",\nm0 AS (SELECT l.domain, l.lang, sum(l.cap) AS cap, any_value(t.share) AS b FROM leaves l JOIN t ON l.domain = t.domain GROUP BY l.domain, l.lang),"
    + _level("m", "domain", "lang", "CASE lang WHEN 'en' THEN 4.0::DOUBLE WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 WHEN 'es' THEN 2.0 ELSE 1.0 END", "m0")
    + ",\ns0 AS (SELECT l.domain, l.lang, l.source, l.cap, m.share AS b FROM leaves l JOIN m ON l.domain = m.domain AND l.lang = m.lang),"
    + _level("s", "domain, lang", "source", "1.0::DOUBLE", "s0")
    + r""",
turns AS (SELECT d.*, CAST(e.epoch AS INTEGER) AS epoch, md5('7:' || e.epoch || ':' || doc_id) AS o FROM d, (SELECT unnest([0, 1]) AS epoch) e),
run AS (SELECT *, CAST(coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY epoch, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS tokens_before FROM turns)
SELECT run.doc_id, run.domain, run.lang, run.source, epoch, tokens, tokens_before, round(s.share, 3) AS leaf_budget
FROM run JOIN s ON run.domain = s.domain AND run.lang = s.lang AND run.source = s.source WHERE tokens_before < s.share
"""
)
