"""Secret scans with multipart credential linking.

Base findings stand alone: assignments, access identifiers and long hex runs. Weak candidates, which would be noise
alone, are reported only where complementary parts co-occur: a weak identifier needs a secret near it, a weak secret an
identifier, an endpoint both. Near means that the starts are at most ``WINDOW`` code points apart in one document (the
scope). The interval join is an equi-join on (document, bucket of WINDOW code points): each bucket is first reduced to
the least and greatest start of each part, so a scope with thousands of parts emits three rows per bucket, not pairs.

Null text is empty. Repeated rows give equal results. An empty table gives an empty result. Positions are code points,
stop exclusive. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docscope.llm.common import cut, row_keys, spread_join, table
from docscope.llm.spans import LABELLED, blank, digest, labelled, matches

WINDOW = 200

# Fixed values of the contract.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

# Weak parts. A weak secret is a whole run of its characters that has a digit and letters in both cases.
WEAK_ID = r"""(?i:access[_-]?key(?:[_-]?id)?|client[_-]?id|account[_-]?id|user(?:name)?)["']?\x20{0,4}[:=]\x20{0,4}["']?[A-Za-z0-9._-]{4,}+"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*+[0-9])(?=[a-z0-9+/]*+[A-Z])(?=[A-Z0-9+/]*+[a-z])[A-Za-z0-9+/]{20,}+={0,2}"
ENDPOINT = r"""(?:https?|ftp|s3|jdbc:[a-z]{2,12}|mongodb|postgres(?:ql)?|amqps?|redis)://[^\x20\x09-\x0D"'<>]{3,}+"""

KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")


def base_spans(text: Column) -> dict[str, Column]:
    return {
        "assign": F.filter(matches(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= ASSIGN_LEAST),
        "access": matches(text, ACCESS),
        "hex": matches(text, HEX),
    }


def _linked(rows: DataFrame) -> DataFrame:
    """``(row_id, linked)``: the weak spans of each row that have their complements near."""
    weak = F.concat(*(labelled(k, i, F.col(k)) for i, k in enumerate(KINDS) if i > 2))
    every = F.concat(*(labelled(k, i, F.col(k)) for i, k in enumerate(KINDS)))
    parts = rows.filter(F.size(weak) > 0).select("row_id", F.explode(every).alias("x")).select("row_id", "x.*")
    parts = parts.withColumn("bucket", F.floor(F.col("start") / WINDOW).cast("int"))
    ids, secrets = F.col("kind").isin("access", "weak_id"), F.col("kind").isin("assign", "hex", "weak_secret")
    reach = parts.groupBy("row_id", "bucket").agg(
        *(f(F.when(c, F.col("start"))).alias(f"{n}_{side}") for n, c in (("id", ids), ("secret", secrets)) for side, f in (("lo", F.min), ("hi", F.max)))
    )
    around = reach.select("row_id", F.explode(F.array(*(F.col("bucket") + d for d in (-1, 0, 1)))).alias("at"), "bucket", "id_lo", "id_hi", "secret_lo", "secret_hi")
    around = around.withColumnsRenamed({"bucket": "their", "at": "bucket"})
    seen = parts.filter(F.col("ord") > 2).join(around, ["row_id", "bucket"])

    def near(n: str) -> Column:
        # In the same bucket any start is near; before it the greatest start counts, after it the least.
        inside = (F.col("their") == F.col("bucket")) & F.col(f"{n}_lo").isNotNull()
        ahead = (F.col("their") < F.col("bucket")) & (F.col("start") - F.col(f"{n}_hi") <= WINDOW)
        after = (F.col("their") > F.col("bucket")) & (F.col(f"{n}_lo") - F.col("start") <= WINDOW)
        return F.coalesce(F.bool_or(inside | ahead | after), F.lit(False))

    found = seen.groupBy("row_id", "start", "ord", "kind", "stop").agg(near("id").alias("with_id"), near("secret").alias("with_secret"))
    keep = (
        F.when(F.col("kind") == "weak_id", F.col("with_secret"))
        .when(F.col("kind") == "weak_secret", F.col("with_id"))
        .otherwise(F.col("with_id") & F.col("with_secret"))
    )
    return found.filter(keep).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("start", "ord", "kind", "stop"))).alias("linked"))


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, assign, access, hex, base, spans, ka, kb)`` for every row, ``base`` and ``spans`` as labelled spans.

    Texts are matched once; what is kept of them is their spans, and 128 bits that name the row's id and text.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    found = base_spans(body) | {"weak_id": matches(body, WEAK_ID), "weak_secret": matches(body, WEAK_SECRET), "endpoint": matches(body, ENDPOINT)}
    small = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))
    rows = cut(docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", *row_keys("doc_id", "text"), *(small(c).alias(k) for k, c in found.items())))
    base = F.concat(*(labelled(k, i, F.col(k)) for i, k in enumerate(KINDS[:3])))
    out = rows.join(_linked(rows), "row_id", "left").withColumn("base", F.array_sort(base))
    out = out.withColumn("spans", F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(LABELLED)))))
    return out.select("doc_id", *KINDS[:3], "base", "spans", "ka", "kb")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span replaced by ``mark`` (overlapping spans by one), and ``n_chars`` to fit.

    Rows without findings come back as they were, null texts included. Only rows with findings meet their spans by a
    join; texts are shuffled only if the findings are too many to broadcast.
    """
    hits = scan(docs).filter(F.size("spans") > 0).groupBy("ka", "kb").agg(F.first("spans").alias("spans"), F.count(F.lit(1)).alias("weight"))
    rows = docs.select(F.struct("*").alias("row")).select("row", F.xxhash64("row.doc_id", "row.text").alias("ka"), F.xxhash64(F.lit(1), "row.text", "row.doc_id").alias("kb"))
    out = spread_join(rows, cut(hits), ["ka", "kb"])
    text = F.col("row.text")
    out = out.withColumn("new", F.when(F.size("spans") > 0, blank(text, F.col("spans"), mark)).otherwise(text))
    cols = {c: F.col(f"row.`{c}`") for c in docs.columns}
    cols["text"] = F.col("new")
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.size("spans") > 0, F.length("new").cast("long")).otherwise(cols["n_chars"])
    return out.select(*(c.alias(k) for k, c in cols.items()))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(digest(F.col("base")), 256).alias("base_sha256"),
        digest(F.col("spans")).alias("spans"),
    )
