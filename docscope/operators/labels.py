"""Hand labels: merge, coverage, problems, worksheet. ``documents`` null means not judged, an empty array judged empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(fresh: DataFrame, prior: DataFrame, key: str = "doc_id") -> DataFrame:
    """Fresh label rows, with finished judgements of ``prior`` carried over (an empty judgement is finished)."""
    done = prior.filter("documents IS NOT NULL").select(key, F.struct(*(c for c in prior.columns if c != key)).alias("was"))
    out = fresh.join(done, key, "left")
    keep = lambda c: F.when(F.col("was").isNotNull(), F.col(f"was.{c}")).otherwise(F.col(c)).alias(c)
    return out.select(key, *(keep(c) for c in fresh.columns if c != key))


def coverage(labels: DataFrame) -> DataFrame:
    """Counts over all labels, in one row."""
    size = lambda c: F.sum(F.coalesce(F.size(c), F.lit(0)))
    return labels.agg(
        F.count(F.lit(1)).alias("n_labels"),
        F.count("documents").alias("n_judged"),
        F.count_if(F.col("documents").isNull()).alias("n_open"),
        F.count_if(F.size("documents") == 0).alias("n_empty"),
        size("documents").alias("n_documents"),
        size("candidates").alias("n_candidates"),
        F.count_if(F.col("documents").isNotNull() & (F.size(F.array_except("documents", "candidates")) > 0)).alias("n_beyond_candidates"),
    )


def problems(labels: DataFrame, known: DataFrame) -> DataFrame:
    """``(rule, key, detail)``. ``known (key)`` lists the resolvable names."""
    rule = lambda df, r, d: df.select(F.lit(r).alias("rule"), F.col("doc_id").cast("string").alias("key"), d.alias("detail"))
    twice = labels.groupBy("doc_id").count().filter("count > 1")
    both = labels.filter(F.arrays_overlap("documents", "cross_referenced"))
    listed = labels.select("doc_id", F.explode("documents").alias("name"))
    unknown = listed.join(known, F.lower("name") == F.col("key"), "left_anti")
    not_absent = labels.select("doc_id", F.explode("absent").alias("name")).join(known, F.lower("name") == F.col("key"), "left_semi")
    return (
        rule(twice, "labelled twice", F.col("count").cast("string"))
        .unionByName(rule(both, "documented and cross-referenced", F.array_join(F.array_sort(F.array_intersect("documents", "cross_referenced")), ",")))
        .unionByName(rule(unknown, "unknown name", F.col("name")))
        .unionByName(rule(not_absent, "known name in the absent list", F.col("name")))
    )


def worksheet(labels: DataFrame) -> DataFrame:
    """``(doc_id, sheet)``: a markdown block per label, a box per candidate ticked if it is documented."""
    box = lambda c: F.concat(F.lit("- ["), F.when(F.array_contains(F.coalesce("documents", F.array().cast("array<string>")), c), "x").otherwise(" "), F.lit("] "), c)
    state = F.when(F.col("documents").isNull(), "[ ] open").otherwise("[x] judged")
    return labels.select("doc_id", F.array_join(F.concat(F.array(F.concat(F.lit("## "), F.col("doc_id").cast("string"), F.lit(" "), state)), F.transform("candidates", box)), "\n").alias("sheet"))
