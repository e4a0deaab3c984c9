"""Small literal tables for queries whose inputs the driver tables do not hold. They measure nothing about any model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# name, input_type, scope, aliases, extension
CATALOG = [
    ("HeapLimit", "BIGINT", "GLOBAL", "", "core"),
    ("and", "BIGINT", "GLOBAL", "", "core"),
    ("con", "DOUBLE", "GLOBAL", "", "ext_a"),
    ("der", "VARCHAR", "LOCAL", "", "core"),
    ("el", "BOOLEAN", "LOCAL", "", "core"),
    ("los", "BOOLEAN", "LOCAL", "el", "core"),
    ("ment", "VARCHAR", "LOCAL", "", "ext_a"),
    ("que", "DOUBLE", "GLOBAL", "con", "ext_a"),
    ("the", "VARCHAR", "GLOBAL", "", "core"),
    ("tion", "UBIGINT", "GLOBAL", "", "core"),
    ("und", "BIGINT", "GLOBAL", "", "ext_b"),
]
CATALOG_COLUMNS = "name, input_type, scope, aliases, extension"
DISTRACTORS = ("and", "und")
MACHINE = ("and",)
# name, scope, type, default_value, default_is_empty_cell
REFERENCE = [
    ("the", "GLOBAL", "VARCHAR", "full", False),
    ("los", "LOCAL", "BOOLEAN", None, True),
    ("que", "GLOBAL", "DOUBLE", None, False),
    ("and", "GLOBAL", "BIGINT", "8", False),
    ("der", "GLOBAL", "VARCHAR", "Full", False),
    ("ghost", "GLOBAL", "BIGINT", "1", False),
]
REFERENCE_COLUMNS = "name, scope, type, default_value, default_is_empty_cell"
FAULTY_CATALOG = [*CATALOG, ("bad", "BIGINT", "GLOBAL", "el,tion", "core")]
# ln, line
REF_PAGE = [
    (1, "### Other settings"),
    (2, "### Settings"),
    (3, "text"),
    (4, "| Name | Description | Type | Default |"),
    (5, "|:----|----|----|:----|"),
    (6, "| `threads`, `worker_threads` | How many, see {% link docs/a.md %} | `BIGINT` | `8` |"),
    (7, "| `home` | Where | `VARCHAR` | |"),
    (8, "| `limit` | Most | `BIGINT` | `NULL` |"),
    (9, "| `cut` | a | b | `VARCHAR` | x |"),
    (10, "| `9lives` | No name | `BIGINT` | 1 |"),
    (11, "| `open` | No end | `BIGINT` | 1"),
    (12, ""),
    (13, "| `late` | Not in the table | `BIGINT` | 1 |"),
]
# path, text
MD_PAGES = [
    ("docs/a.md", "---\ntitle: \"Memory\"\nlayout: x\n---\nIntro line\n\n# Limits\nText one\n## Heap\nText two\n### Deep\nText three\n## Disk\nText four\n"),
    ("core_extensions/b.md", "---\ntitle: Files\n---\n# Files\nText\n### Skipped\nMore\n## Back\nEnd\n## Empty\n\n```\n# comment\n```\n"),
    ("plain.md", "No front matter\n# One\nBody #\n"),
]
# arm, model_id, price_in, price_out, wants_seed
ARMS = [("A0", "m0", 1.0, 2.0, True), ("A1", "m1", 0.0, 0.5, False), ("A2", "m2", 2.0, 4.0, True), ("A3", "m3", 1.0, 1.0, False), ("A4", "m4", 0.1, 0.2, False)]
# model_id, live_in, live_out, has_seed
LIVE = [("m0", 1.0005, 2.0, True), ("m1", 0.1, 0.5, True), ("m2", 2.01, 4.0, False), ("m4", 0.1, 0.2, True)]
ERRORS = [
    (1, 'HTTP 500: {"error": {"message": "upstream", "code": 500}} [gave up after 4 attempts]'),
    (2, 'HTTP 500: {"error": {"message": "upstream", "code": 500}} [gave up after 2 attempts]'),
    (3, 'HTTP 500: {"error": {"message": "cut sho'),
    (4, "connection reset"),
]
TARGET_DOCS = [
    (1, "### Settings\n\n| Name | Description | Type | Default |\n|---|---|---|---|\n| `home` | Where | VARCHAR | |"),
    (2, "### Settings\n\n| Name | Description | Type | Default |\n|---|---|---|---|\n| `threads`, `worker_threads` | Many | BIGINT | 8 |"),
]


def values(rows: list[tuple], columns: str) -> str:
    """``rows`` as SQL that Spark and DuckDB both read."""

    def one(x: object) -> str:
        if x is None:
            return "CAST(NULL AS STRING)"
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        return f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else repr(x)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({columns})"


def frame(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    names = [c.strip() for c in columns.split(",")]
    kinds = {bool: "boolean", str: "string", int: "int", float: "double"}
    types = [next((kinds[type(r[i])] for r in rows if r[i] is not None), "string") for i in range(len(names))]
    return spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)))


def catalog(spark: SparkSession, rows: list[tuple] = CATALOG) -> DataFrame:
    """The catalog with its aliases as arrays."""
    return frame(spark, rows, CATALOG_COLUMNS).withColumn("aliases", F.array_remove(F.split("aliases", ","), ""))


def reference(spark: SparkSession) -> DataFrame:
    return frame(spark, REFERENCE, REFERENCE_COLUMNS)
