"""Line deduplication: explode normalised lines, count documents per line digest, drop frequent lines, reassemble by position.

Native DataFrame operations only. What is shuffled is digests and places of long lines, pre-aggregated per digest, and never the lines; texts move only where
the list of documents with drops is too large to broadcast. A line that a third of all documents hold is one key of aggregates with a partial step,
and on the way back one key of a join whose hot side adaptive execution splits. Dropping costs one step a line, however many of a text's lines go.

Defined results: a null or empty text is one empty line and stays ""; blank lines and lines with short keys always stay; repeated lines inside one
document count once and stay or go together; rows with the same id are one document when documents are counted, and each keeps its own text; an empty table gives
an empty table; extra columns are carried along unless they begin with "_ld_"; columns named kept_text, n_lines or n_dropped are replaced by the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, whole_text, written


RESULTS = ("kept_text", "n_lines", "n_dropped")


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds kept_text, n_lines and n_dropped to every row of docs."""
    docs = docs.drop(*[c for c in RESULTS if c in docs.columns]).withColumn("_ld_row", F.xxhash64(text_col))
    lines = F.split(whole_text(text_col), "\n")
    # the length of a line bounds that of its key, so most lines need no key
    digest = lambda k: F.when(F.length(k) >= min_chars, F.unhex(F.md5(k)))
    keys = F.transform(lines, lambda s, i: F.when(F.length(s) >= min_chars, F.struct(i.alias("pos"), digest(line_key(s)).alias("key"))))
    held = docs.select(F.col(id_col).alias("_ld_id"), "_ld_row", F.explode(F.filter(keys, lambda k: k["key"].isNotNull())).alias("_ld_k"))
    # read three times below, and dearer to work out than to read
    held = written(held.select("_ld_id", "_ld_row", F.col("_ld_k.pos").alias("_ld_pos"), F.col("_ld_k.key").alias("_ld_key")))
    # the count of lines has a partial step and bounds that of documents; documents themselves are counted only for the few keys that pass it
    often = held.groupBy("_ld_key").agg(F.count(F.lit(1)).alias("_ld_n")).where(F.col("_ld_n") >= min_docs)
    # an expression over the key gives each side an exchange of its own: adaptive execution can split the hot keys of a join, and documents of one key are counted by all tasks
    own = lambda df, *more: df.select(F.concat("_ld_key", F.lit(b"")).alias("_ld_key"), *more)
    hits = own(held.join(own(often), "_ld_key"), "_ld_id").distinct()
    frequent = hits.groupBy("_ld_key").agg(F.count(F.lit(1)).alias("_ld_docs"), F.max("_ld_id").alias("_ld_keeper")).where(F.col("_ld_docs") >= min_docs)
    drops = held.join(own(frequent, "_ld_keeper"), "_ld_key").where("_ld_id <> _ld_keeper")
    drops = drops.groupBy("_ld_id", "_ld_row").agg(F.sort_array(F.collect_set("_ld_pos")).alias("_ld_drops"))
    joined = docs.join(drops, (docs[id_col] == drops["_ld_id"]) & (docs["_ld_row"] == drops["_ld_row"]), "left")
    # a byte for each line up to the last dropped one, 1 where it goes: reassembling by position takes one step a line
    gap = lambda p, i: F.concat(F.repeat(F.lit("0"), p - F.coalesce(F.get("_ld_drops", i - 1), F.lit(-1)) - 1), F.lit("1"))
    marks = F.array_join(F.transform("_ld_drops", gap), "").cast("binary")
    # the marks are bound by a one-element array, or the optimiser would work them out again for every line
    kept = F.transform(F.array(marks), lambda m: F.filter(lines, lambda s, i: F.coalesce(F.substring(m, i + 1, F.lit(1)) != F.lit(b"1"), F.lit(True))))[0]
    out = joined.withColumn("n_lines", F.size(lines).cast("long")).withColumn("n_dropped", F.coalesce(F.size("_ld_drops"), F.lit(0)).cast("long"))
    out = out.withColumn("kept_text", F.when(F.col("_ld_drops").isNull(), whole_text(text_col)).otherwise(F.array_join(kept, "\n")))
    return out.select(*[docs[c] for c in docs.columns if c != "_ld_row"], "kept_text", "n_lines", "n_dropped")


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
frequent AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.keeper AS dropped
  FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN NOT dropped THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
