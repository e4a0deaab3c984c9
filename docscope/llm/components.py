"""Distributed connected components over an edge table (alternating large-star and small-star rounds)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docscope.llm.common import cut, lean, parts_for, release, ship

#: Rounds grow with the logarithm of the node count; reaching this many means that the edges changed while running.
MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    near = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each partition's edges as stars around the least node of what it connects (union by path halving)."""
    root: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            for x in (a, b):
                root.setdefault(x, x)
            while root[a] != a:
                root[a] = a = root[root[a]]
            while root[b] != b:
                root[b] = b = root[root[b]]
            root[max(a, b)] = min(a, b)
    ends, tops = [], []
    for x in root:
        top = x
        while root[top] != top:
            top = root[top]
        if top != x:
            ends.append(x), tops.append(top)
            root[x] = top
    yield pa.RecordBatch.from_arrays([pa.array(ends, pa.int64()), pa.array(tops, pa.int64())], ["a", "b"])


def connected_components(edges: DataFrame, python: bool = False) -> DataFrame:
    """Map every node of ``edges (a, b)`` to the least node it reaches.

    With ``python`` each partition of at most about ROWS_A_PART edges first becomes a forest of stars, in every round,
    which leaves little or nothing to the rounds; such ``edges`` should be materialised, as they are read twice and not
    copied. Without, all of it is built-in functions.

    Returns ``(node, component)`` with one row per node, roots included. Self-loops and null ends are ignored;
    repeated and reversed edges count once. No edges give no rows. A hub of any degree is only ever a grouped
    minimum (combined before the shuffle) and an equi-join, so no neighbour list is gathered anywhere.
    """
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    if python:
        ship(edges)
        rows = edges.count()
        edges = edges.coalesce(parts_for(rows)).mapInArrow(lean(_forest), "a long, b long")
    edges = cut(edges if python else edges.distinct())
    print_of = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = print_of(edges)
    alone = python and parts_for(rows) == 1  # one forest is the answer
    for _ in range(MAX_ROUNDS if before[0] and not alone else 0):
        # A round never has more edges than twice the one before it.
        stars = _small_star(_large_star(edges))
        if python:
            stars = stars.coalesce(parts_for(2 * before[0])).mapInArrow(lean(_forest), "a long, b long").distinct()
        edges = cut(stars, 2 * before[0])
        now = print_of(edges)
        release(edges.sparkSession)
        if now == before:
            break
        before = now
    else:
        if before[0] and not alone:
            raise RuntimeError("connected components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
