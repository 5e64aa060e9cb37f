"""File streams: the same projections over unbounded input. Rows are independent, so append mode needs no state and no watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.config import Config
from ..plans.engine import Typesetter


def typeset_stream(spark: SparkSession, path: str, schema, config: Config, col: str = "text", prepare=None) -> DataFrame:
    """A streaming DataFrame over the files at path (as a pattern the path may name one file as well as a folder)."""
    rows = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return Typesetter(config).transform(prepare(rows) if prepare else rows, col)


def typeset_stream_once(spark: SparkSession, path: str, config: Config) -> DataFrame:
    """All files there are now, through the stream, and what the sink then holds. Sink and checkpoint are in the shared folder of spark.checkpoint.dir, or else below the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"
    base = f"{shared.rstrip('/')}/{uuid.uuid4().hex}"
    sentence = lambda d: d.select("event_id", F.concat(F.lit("событие 5-6 "), "event_type").alias("text"))
    rows = typeset_stream(spark, path, spark.read.parquet(path).schema, config, prepare=sentence).select("event_id", "typeset")
    query = rows.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("event_id long, typeset string").parquet(f"{base}/out")
