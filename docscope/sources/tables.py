"""Parquet tables, JSON lines, page trees, and the append-only response table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RESPONSES = "arm string, request_key string, body string, is_failure boolean, latency_s double"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines under a stated schema; a malformed line fails the read, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_rejects(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """``(file, line)`` of the lines that do not parse."""
    full = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).filter(F.trim("value") != "")
    return raw.filter(F.from_json("line", full, {"mode": "PERMISSIVE"}).isNull() | F.try_parse_json("line").isNull()).select("file", "line")


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """JSON lines with null fields kept; ``order`` sorts rows across files."""
    out = df.orderBy(*order) if order else df
    out.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def stale_fields(df: DataFrame, schema: str) -> list[str]:
    """Fields that a reader expects and a table lacks (a schema comparison; no rows are read)."""
    want = StructType.fromDDL(schema)
    return [f.name for f in want.fields if f.name not in df.columns]


def read_pages(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """``(path, text)`` of every page under a folder, the path relative to it."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:(?://)?", "")
    return raw.select(F.regexp_replace(path, "^.*?" + _quoted(root.rstrip("/")) + "/", "").alias("path"), F.col("value").alias("text"))


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "") + "\\E"


def append_responses(new: DataFrame, path: str) -> None:
    """Add responses that the table at ``path`` does not hold yet; running it again adds nothing."""
    spark = new.sparkSession
    new = new.dropDuplicates(["arm", "request_key"])
    try:
        held = spark.read.schema(RESPONSES).parquet(path).select("arm", "request_key")
        new = new.join(held, ["arm", "request_key"], "left_anti")
    except Exception as e:  # the first append makes the table
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").parquet(path)


def write_documents(docs: DataFrame, path: str) -> None:
    """One row per document; what an earlier build left there goes."""
    docs.write.mode("overwrite").parquet(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.mode("overwrite").text(path)
