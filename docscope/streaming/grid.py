"""Responses that arrive over time.

The engine's plans are batch plans; these are the two that have a natural incremental form. Requests are a static
table, recorded responses a stream of files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docscope.operators.grid import parse_body
from docscope.sources.tables import RESPONSES


def response_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New files of a response table, under its stated schema."""
    return spark.readStream.schema(RESPONSES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def replay_stream(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Stream-static join: each arriving response meets the requests that wait for it."""
    return responses.join(requests.withColumnRenamed("arm", "r_arm").withColumnRenamed("request_key", "r_key"), F.expr("arm = r_arm AND request_key = r_key")).drop("r_arm", "r_key")


def parsed_stream(responses: DataFrame) -> DataFrame:
    return responses.select("arm", "request_key", "is_failure", *(c.alias(n) for n, c in parse_body(F.col("body")).items() if n not in ("latency_s",)), "latency_s")


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and key; rows later than ``late`` are left out once a window has closed."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def start(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet sink, exactly once, and stop when what is there has been read."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
