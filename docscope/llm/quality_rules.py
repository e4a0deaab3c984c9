"""Document quality rules with host-level verdicts.

Rule statistics of each text are built-in array functions over its words, inside one row. Failures, of each rule and of
any, are then summed by host (the ``source`` column), each host's failure rate is shrunk by a beta prior whose two
parameters are fitted to all hosts by moments, without the binomial noise of small hosts, and hosts whose shrunk rate
exceeds ``HOST_RATE`` lose all their documents.

A null text has no words and fails (too few words). Null hosts form one host of their own. Repeated rows count as rows.
An empty table gives an empty result. Sums by host are combined before the shuffle, and verdicts go back to documents
by a spread join, so a host with a third of all rows is dealt to as many tasks as it fills. Only doc_id, text and source are
read; other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docscope.llm.common import cut, spread_join, table

LEAST_WORDS, WINDOW, REPEAT_PERCENT = 50, 3, 50
SYMBOLS = "[#*$%&|<>]"
#: A host is refused if its shrunk failure rate is above this.
HOST_RATE = 0.5

_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE), "")


def _window_order(words: Column) -> Column:
    """Hashes of the 3-word windows with their positions, sorted; empty if no window occurs twice."""
    at = F.sequence(F.lit(0), F.size(words) - WINDOW)
    key = lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW)))
    order = F.array_sort(F.transform(at, lambda i: F.struct(key(i).alias("h"), i.alias("i"))))
    unique = F.size(F.array_distinct(F.transform(at, key))) == F.size(at)
    return F.when((F.size(words) > WINDOW) & ~unique, order).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def _covered(order: Column) -> Column:
    """Words under repeated windows: equal neighbours of the sorted windows are repeats, and each repeat, by position,
    adds the words that the repeat before it did not cover. ``order`` must be a column (lambdas read it by index)."""
    same = lambda x, k: F.coalesce(F.get(order, k)["h"] == x["h"], F.lit(False))
    repeats = F.transform(order, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
    return F.aggregate(
        F.array_sort(F.array_compact(repeats)),
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("sum")),
        lambda acc, i: F.struct(i.alias("last"), (acc["sum"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("sum")),
        lambda acc: acc["sum"],
    )


def statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)``."""
    body = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.col("text"), F.lit("")).alias("body"))
    # Two steps, so that what lambdas read by index is computed once for a row.
    split = body.withColumn("words", words_of(F.col("body")))
    split = split.withColumn("order", _window_order(F.col("words")))
    lines = F.filter(F.split("body", "\n"), lambda x: x.rlike(_WORD))
    out = split.select(
        "doc_id",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _covered(F.col("order")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


RULES = {"few_words": f"n_words < {LEAST_WORDS}", "repeats": f"100 * n_repeat_words > {REPEAT_PERCENT} * n_words"}


def host_verdicts(stats: DataFrame, rate: float = HOST_RATE) -> DataFrame:
    """``(source, n, failed, [failed_RULE ...,] host_rate, host_kept)``: one row per host.

    The prior's mean is the pooled failure rate m. Its strength s comes from the share r of the variance m(1 - m) that
    lies between hosts: with N documents on K hosts of n each, the sum of n (rate - m)^2 is expected to be
    m(1 - m) (K - 1 + r (N - sum(n^2) / N - K + 1)); s is 1 / r - 1, held between 1 and 1000, and 1000 where nothing
    lies between hosts. A host's rate is (failed + m s) / (n + s).
    """
    rules = {k: F.count_if(F.expr(c)).alias(f"failed_{k}") for k, c in RULES.items() if {"n_words", "n_repeat_words"} <= set(stats.columns)}
    hosts = stats.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("base_failed").alias("failed"), *rules.values())
    total = hosts.agg(
        F.sum("n").cast("double").alias("N"), F.sum("failed").alias("all_failed"), F.count(F.lit(1)).alias("K"),
        F.sum(F.col("n") * F.col("n").cast("double")).alias("nn"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("squares"),
    )
    m = F.col("all_failed") / F.col("N")
    spread = F.try_divide(F.col("squares") - F.col("N") * m * m, m * (1 - m)) - (F.col("K") - 1)
    share = F.try_divide(spread, F.col("N") - F.col("nn") / F.col("N") - (F.col("K") - 1))
    strength = F.when(share > 0, F.least(F.lit(1000.0), F.greatest(F.lit(1.0), 1 / share - 1))).otherwise(F.lit(1000.0))
    prior = total.select(m.alias("m"), strength.alias("s"))  # one row
    shrunk = (F.col("failed") + F.col("m") * F.col("s")) / (F.col("n") + F.col("s"))
    return hosts.crossJoin(F.broadcast(prior)).select("source", "n", "failed", *(f"failed_{k}" for k in rules), shrunk.alias("host_rate"), (shrunk <= rate).alias("host_kept"))


def judge(docs: DataFrame, rate: float = HOST_RATE) -> DataFrame:
    """Statistics and verdict of every row: ``kept`` unless the document or its host fails."""
    stats = cut(statistics(docs))
    named = [F.coalesce("source", F.lit("")).alias("host"), F.col("source").isNotNull().alias("has_host")]
    hosts = cut(host_verdicts(stats, rate).select(*named, F.col("n").alias("weight"), "host_rate", "host_kept"))
    out = spread_join(stats.select("*", *named), hosts, ["host", "has_host"])
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("host_kept")).alias("kept"), "source", "host_rate",
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("source", "host_rate")
