"""Exact deduplication as a streaming aggregate over disk-backed keyed state that never expires.

A file stream of documents is reduced to (digest, stable identifier, content locator) per row and fed to a stateful aggregate whose RocksDB state holds,
per SHA-256 digest and byte length of the normalised text, the row that stays (largest doc_id, with the file that holds it) and the number of rows seen. State has no
watermark and is kept for as long as the checkpoint folder is, so a later run over new files goes on where this one ended. Every hit is checked against
the full bytes of the row that stays; rows that only share the digest are regrouped by their whole text.

Native DataFrame and Structured Streaming operations only. The aggregate has a partial step, so a text that a third of all rows hold sends one row per
task to its key. On the way back from state to rows the digests with more than HOT rows, or rows / HOT_KEYS if that is more, are salted by row and their texts checked apart: there are at most
HOT_KEYS of them, which bounds the list that is broadcast, and no task meets more than that many rows of one.

Defined results: null counts as an empty text, and empty texts are copies of each other; lower-casing touches A-Z only; an empty table gives an empty result;
extra columns are not read; repeated rows count as rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, whole_text, work_dir, written

#: State lives in RocksDB on the executors' disks and as change logs in the checkpoint; preallocation would cost each small store megabytes.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: A digest with more rows than both HOT and all rows over HOT_KEYS is salted.
HOT, HOT_KEYS = 64, 4096
#: Rows that aren't hits are mostly told apart before their texts are shuffled.
_BLOOM = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}


def _set(spark: SparkSession, conf: dict[str, str | None]) -> dict[str, str | None]:
    """Sets (None: unsets) and returns what was there."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return before


def normalised(col: str = "text"):
    return F.translate(whole_text(col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _keyed(docs: DataFrame, *more) -> DataFrame:
    body = normalised().cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("n_bytes"), *more)


def stream_state(spark: SparkSession, path: str, schema, checkpoint: str, files_per_batch: int | None = None) -> DataFrame:
    """Runs the stateful aggregate over all files at path that this checkpoint hasn't seen; returns the state's rows (digest, n_bytes, keep_id, locator, group_size)."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # as a pattern the path may name one file as well as a folder
    files = reader.parquet(f"{path[:-1]}[{path[-1]}]")
    body = normalised().cast("binary")
    rows = files.select(
        F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("n_bytes"),
        F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("_metadata.file_path").alias("locator")).alias("row"),
    )
    state = rows.groupBy("digest", "n_bytes").agg(F.max("row").alias("row"), F.count(F.lit(1)).alias("group_size"))
    sink = f"{checkpoint}/emitted"

    def emit(batch: DataFrame, number: int) -> None:
        # rewriting a batch's own folder makes a replay after a failure harmless
        batch.select("digest", "n_bytes", F.col("row.doc_id").alias("keep_id"), F.col("row.locator").alias("locator"), "group_size").write.mode("overwrite").parquet(f"{sink}/batch={number}")

    before = _set(spark, _STATE)
    try:
        query = state.writeStream.outputMode("update").foreachBatch(emit).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        _set(spark, before)
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(sink)
    shape = "digest string, n_bytes int, keep_id long, locator string, group_size long"
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], shape)
    emitted = spark.read.schema(shape + ", batch int").option("basePath", sink).parquet(sink)
    # a key's last emission is its state
    last = emitted.groupBy("digest", "n_bytes").agg(F.max_by(F.struct("keep_id", "locator", "group_size"), "batch").alias("s"))
    return last.select("digest", "n_bytes", "s.keep_id", "s.locator", "s.group_size")


def dedup_exact(spark: SparkSession, path: str, checkpoint: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """One row per document at path: doc_id, keep_id, group_size, kept, text_sha256, locator."""
    docs = spark.read.parquet(path)
    state = written(stream_state(spark, path, docs.schema, checkpoint or work_dir(spark), files_per_batch))
    least = max(HOT, (state.agg(F.sum("group_size")).first()[0] or 0) // HOT_KEYS)
    salts = F.when(F.col("group_size") > least, F.ceil(F.col("group_size") / least)).otherwise(1).cast("int")
    hot = F.broadcast(state.where(F.col("group_size") > least).select("digest", "n_bytes", salts.alias("salts")))  # HOT_KEYS rows at most
    salted = lambda df: df.join(hot, ["digest", "n_bytes"], "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "at"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts", "at")
    at = F.monotonically_increasing_id().alias("at")  # copies of one row part as well
    found = salted(_keyed(docs, at)).join(state.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))), ["digest", "n_bytes", "salt"]).drop("salt")
    hits = state.where("group_size > 1")
    # full bytes: whole texts of hits are grouped by equality, once a task before they are shuffled; a digest with two texts is a false hit
    with_text = _keyed(docs, normalised().alias("norm"))
    key = ["digest", "n_bytes"]
    before = _set(spark, _BLOOM)
    try:
        whole = with_text.join(hits.where(F.col("group_size") <= least).select(*key), key, "left_semi").select(*key, "norm").distinct()
        if hot.head(1):  # these never shuffle before each task has brought its rows of one text down to one
            whole = whole.unionByName(with_text.join(hot.select(*key), key, "left_semi").select(*key, "norm").distinct())
        odd = written(whole.groupBy("digest", "n_bytes").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest", "n_bytes"))
    finally:
        _set(spark, before)
    plain = found
    if odd.head(1):  # texts that differ under one digest: regroup those digests' rows by whole text
        plain = found.join(odd, ["digest", "n_bytes"], "left_anti")
        whole = with_text.join(odd, ["digest", "n_bytes"], "left_semi")
        regrouped = whole.groupBy("digest", "n_bytes", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        apart = whole.join(regrouped, ["digest", "n_bytes", "norm"]).select("digest", "n_bytes", "doc_id", "keep_id", F.lit(None).cast("string").alias("locator"), "group_size")
        plain = plain.unionByName(apart)
    else:
        discard(odd)
    return plain.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"), "locator")


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_exact(spark, f"{sf_dir}/documents.parquet").drop("locator")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
"""
