"""Costs, latencies, errors, provenance, arm checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docscope.functions import text as T
from docscope.functions.numbers import price_drifted, ratio
from docscope.operators.sizes import small


def latency(calls: DataFrame, key: str, value: str) -> DataFrame:
    p = lambda q: F.percentile(value, F.lit(q))
    return calls.groupBy(key).agg(F.count(value).alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.max(value).alias("max_value"))


def billed_vs_predicted(calls: DataFrame, key: str, alarm: float = 0.05) -> DataFrame:
    """Sums, their ratio, and whether they are more than ``alarm`` apart."""
    out = calls.groupBy(key).agg(F.sum("billed").alias("billed"), F.sum("predicted").alias("predicted"))
    return out.withColumn("ratio", ratio(F.col("billed"), F.col("predicted"))).withColumn("alarm", F.abs(F.col("billed") - F.col("predicted")) > alarm * F.col("predicted"))


def cost_rollup(calls: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """Cost per (outer, inner), per outer, and in all."""
    return calls.rollup(outer, inner).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


def error_groups(rows: DataFrame, message: str) -> DataFrame:
    """How often each error occurs, retry epilogues and envelopes aside; the commonest first, then by text."""
    return rows.groupBy(T.error_group(F.col(message)).alias("error")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "error")


def check_arms(arms: DataFrame, live: DataFrame) -> DataFrame:
    """Problems per arm against a live catalogue: ``(arm, problems, ok)``."""
    out = arms.join(small(live.withColumn("found", F.lit(True))), "model_id", "left")
    gone = F.col("found").isNull()
    named = [
        (gone, "missing"),
        (~gone & price_drifted(F.col("price_in"), F.col("live_in")), "input price"),
        (~gone & price_drifted(F.col("price_out"), F.col("live_out")), "output price"),
        (~gone & F.col("wants_seed") & ~F.col("has_seed"), "seed"),
    ]
    found = F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in named)))
    return out.select("arm", found.alias("problems"), (F.size(found) == 0).alias("ok"))


def provenance(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows, distinct keys, and rows carried in from an earlier run."""
    n = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(*keys).alias("n_keys"))
    c = rows.join(carried.select(*keys).distinct(), keys, "left_semi").agg(F.count(F.lit(1)).alias("n_carried"))
    return n.crossJoin(c)
