"""Near-duplicate detection by a MinHash LSH forest.

A text's set is its distinct 5-word shingles (words are runs without ASCII white space, A-Z folded). Every distinct
set gets ``TREES * DEPTH`` 16-bit min-hashes. Each tree is one order of those: the signature rotated so that the
tree's own values come first. In each order the rows are range-partitioned and sorted, so neighbours are the rows
with the longest common prefix, and the REACH nearest on a side are looked at: where few rows share the first value
that one is enough, and the more rows share a prefix, the deeper the prefix that a neighbour has to share. Neighbours
become candidates by the agreement of their whole signatures. Candidates are then confirmed on the full sets, best first, in rounds: a pair whose ends are already connected needs no check.

The forest finds most links but promises none, so a prefix-filter join finds the rest: two sets of the least similarity
share a value among the first of each in any one order of all shingles (common ones last, so that shared passages meet
in few prefixes), and every pair of different components that meets there is confirmed too, if what both sets have left from that value on
can still reach the similarity. A run of shared neighbours counts once. The links between components are then complete.

Edge cases: a null or blank text has an empty set and is linked with nothing; fewer than five words make one shingle;
equal sets are one class before any candidate search, so copies cost nothing more; repeated rows and null ids are
kept as rows (a null id has no component of its own: the row gets the least id of its class, or null). An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docscope.llm.common import constants, cut, lean, mix, release, shingle_hashes, ship, spread_join, table, text_slices, word_hashes
from docscope.llm.components import connected_components
from docscope.operators.sizes import small

SHINGLE, PERCENT = 5, 75
TREES, DEPTH = 16, 3
HASHES = TREES * DEPTH
#: Values that neighbours share at least, wherever they are few.
LEAST_DEPTH = 1
#: Neighbours looked at on each side in an order, and how many of those a row proposes (the best by signature).
REACH, PROPOSE = 12, 3
#: Signature agreement below which a pair of 75 % similarity is not expected (four standard deviations).
AGREE = HASHES // 2
#: Documents looked at for common shingles and how many of those are kept; both only decide the order of prefixes.
LOOK, COMMON = 10_000, 100_000
#: Pairs of a shingle that are compared at once.
BLOCK = 1 << 20
#: Up to so many rows of a shingle all its pairs are taken at once.
SMALL = 32

_SEEDS = constants(HASHES, 41)
_ODD = constants(HASHES, 43, odd=True)


def signature(shingles: np.ndarray) -> bytes:
    """Big-endian 16-bit min-hashes of a set; empty for the empty set."""
    if not len(shingles):
        return b""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        part = shingles[i : i + 4096]
        for k in range(HASHES):
            low[k] = min(low[k], ((part ^ _SEEDS[k]) * _ODD[k]).min())
    return (mix(low) >> np.uint64(48)).astype(">u2").tobytes()


def _set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    a = np.bitwise_xor.reduce(mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5))) if len(shingles) else np.uint64(0)
    b = mix(shingles + np.uint64(len(shingles))).sum(dtype=np.uint64) if len(shingles) else np.uint64(0)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, ka, kb, sig = [], [], [], []
        for _, _, data, offsets in text_slices(batch.column("text")):
            for s in shingle_hashes(*word_hashes(data, offsets), SHINGLE):
                a, b = _set_key(s)
                n.append(len(s)), ka.append(a), kb.append(b), sig.append(signature(s))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("row_key"), batch.column("row_key2"), pa.array(n, pa.int64()), pa.array(ka, pa.int64()), pa.array(kb, pa.int64()), pa.array(sig, pa.binary())],
            ["doc_id", "row_key", "row_key2", "n_shingles", "ka", "kb", "sig"],
        )


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cls = batch.column("cls")
        if not len(cls):
            continue
        sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
        for t in range(TREES):
            label = np.roll(sigs, -t * DEPTH, axis=1).tobytes()
            label = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * HASHES), len(cls), [None, pa.py_buffer(label)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cls), t, np.int32)), label, cls], ["tree", "label", "cls"])


def _compare(tree: np.ndarray, label: np.ndarray, cls: np.ndarray, fresh: int) -> tuple[np.ndarray, ...]:
    """Candidates that each row from ``fresh`` on makes with the REACH rows before it: (a, b, agreement)."""
    n = len(cls)
    score = np.zeros((n, REACH), np.int16)
    for s in range(1, min(REACH, n - 1) + 1):
        same = label[s:] == label[:-s]
        ok = same[:, :LEAST_DEPTH].all(1) & (tree[s:] == tree[:-s])
        score[s:, s - 1] = np.where(ok, same.sum(1), 0)
    score[:fresh] = 0
    score[score < AGREE] = 0
    best = np.argsort(-score, axis=1, kind="stable")[:, :PROPOSE]
    row, col = np.nonzero(np.take_along_axis(score, best, 1))
    back = best[row, col]
    return cls[row], cls[row - back - 1], score[row, back]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order; a partition also hands on its first and last REACH rows, for the seams between partitions."""
    tail: tuple[np.ndarray, ...] | None = None
    head_left = REACH
    names = ["kind", "tree", "label", "a", "b", "agree"]

    def rows(t: np.ndarray, label: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        n = len(c)
        return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.array(t), pa.array([x.tobytes() for x in label], pa.binary()), pa.array(c), pa.array(c), pa.array(np.zeros(n, np.int32))], names)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        t = batch.column("tree").to_numpy(zero_copy_only=False).astype(np.int32)
        label = np.frombuffer(b"".join(batch.column("label").to_pylist()), np.uint16).reshape(n, HASHES)
        c = batch.column("cls").to_numpy(zero_copy_only=False).astype(np.int64)
        if head_left:
            yield rows(t[:head_left], label[:head_left], c[:head_left])
            head_left -= min(n, head_left)
        fresh = 0
        if tail is not None:
            fresh = len(tail[2])
            t, label, c = (np.concatenate([x, y]) for x, y in zip(tail, (t, label, c), strict=True))
        a, b, agree = _compare(t, label, c, fresh)
        k = len(a)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.array(agree.astype(np.int32))], names)
        tail = (t[-REACH:].copy(), label[-REACH:].copy(), c[-REACH:].copy())
    if tail is not None:
        yield rows(*tail)


def candidates(classes: DataFrame, parts: int) -> DataFrame:
    """Candidate pairs ``(a, b, agree)``, a > b, from ``classes (cls, sig)``."""
    orders = classes.select("cls", "sig").mapInArrow(lean(_orders), "tree int, label binary, cls long")
    found = cut(
        orders.repartitionByRange(parts, "tree", "label", "cls")
        .sortWithinPartitions("tree", "label", "cls")
        .mapInArrow(lean(_neighbours), "kind int, tree int, label binary, a long, b long, agree int")
    )
    # The seams are REACH rows at either side of each border: rows of one prefix, ranked there as within a partition.
    seams = found.filter("kind = 1").select("tree", "label", F.col("a").alias("cls")).distinct()
    near = Window.partitionBy("tree", F.substring("label", 1, 2 * LEAST_DEPTH)).orderBy("label", "cls")
    ahead = [F.struct(F.lag("cls", s).over(near).alias("b"), F.lag("label", s).over(near).alias("other")) for s in range(1, REACH + 1)]
    pairs = seams.withColumn("ahead", F.array(*ahead)).select("cls", "label", F.explode("ahead").alias("x")).filter("x.b IS NOT NULL").select("cls", "x.b", "label", "x.other")
    agree = sum(
        (F.substring("label", 2 * i + 1, 2) == F.substring("other", 2 * i + 1, 2)).cast("int") for i in range(HASHES)
    )
    pairs = pairs.select(F.greatest("cls", "b").alias("a"), F.least("cls", "b").alias("b"), agree.alias("agree")).filter(F.col("agree") >= AGREE)
    return found.filter("kind = 0").select("a", "b", "agree").union(pairs).filter("a != b").groupBy("a", "b").agg(F.max("agree").alias("agree"))


def _set_of(text: str) -> np.ndarray:
    (one,) = (x for _, _, data, offsets in text_slices(pa.array([text], pa.large_string())) for x in shingle_hashes(*word_hashes(data, offsets), SHINGLE))
    return one


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose whole sets are similar. Texts were found by 64 bits of id and text: only those of the class's set count."""
    for batch in batches:
        keep = []
        last, x = None, None
        for r in batch.to_pylist():
            if last != r["ta"]:
                last, x = r["ta"], _set_of(r["ta"])
            y = _set_of(r["tb"])
            right = _set_key(x) == (r["aka"], r["akb"]) and _set_key(y) == (r["bka"], r["bkb"])
            both = len(np.intersect1d(x, y, assume_unique=True)) if right and 100 * min(len(x), len(y)) >= PERCENT * max(len(x), len(y)) else 0
            keep.append(both > 0 and 100 * both >= PERCENT * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in text_slices(batch.column("text")):
            out = np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(*word_hashes(data, offsets), SHINGLE)])
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], ["token"])


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that recur in some of the documents, and their counts there."""
    every = max(1, docs.count() // LOOK)
    some = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0).select("text").mapInArrow(lean(_shingles), "token long")
    rows = some.groupBy("token").count().filter("count > 1").orderBy(F.desc("count"), "token").limit(COMMON).collect()
    found = sorted((r["token"] % 2**64, r["count"]) for r in rows)
    return np.array([x for x, _ in found], np.uint64), np.array([c for _, c in found], np.int64)


def _prefixes(common: np.ndarray, counts: np.ndarray):
    """A mapper to ``(row_key, ka, kb, n, prefix)``: the first values of each set that a partner must share one of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ka, kb, out = [], [], [], []
            for _, _, data, offsets in text_slices(batch.column("text")):
                for s in shingle_hashes(*word_hashes(data, offsets), SHINGLE):
                    a, b = _set_key(s)
                    n.append(len(s)), ka.append(a), kb.append(b)
                    if len(common):
                        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                        s = s[np.argsort(np.where(common[at] == s, counts[at], 0), kind="stable")]
                    out.append(s[: len(s) + PERCENT * -len(s) // 100 + 1].tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), pa.array(ka, pa.int64()), pa.array(kb, pa.int64()), pa.array(n, pa.int64()), pa.array(out, pa.binary())], ["row_key", "ka", "kb", "n", "prefix"])

    return run


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each of a set's first values: its place in the set's order, and the value before it."""
    for batch in batches:
        texts = batch.column("prefix").to_pylist()
        size = np.array([len(x) // 8 for x in texts], np.int64)
        token = np.frombuffer(b"".join(texts), np.int64)
        place = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
        before = np.where(place > 0, np.r_[np.zeros(1, np.int64), token][: len(token)], 0)
        cls, component, n = (np.repeat(batch.column(c).to_numpy(), size) for c in ("cls", "component", "n"))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token, cls, component, n.astype(np.int32), place.astype(np.int32), before)], ["token", "cls", "component", "n", "place", "before"])


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of shingles that sets of different components have. Rows come by shingle and component.

    Rows of one component wait for another one, at most BLOCK of them: more are handed on as they are.
    """
    kept: list[pa.RecordBatch] = []
    sure: int | None = None
    for batch in _ended(batches):
        if batch is not None and not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*kept, batch] if batch is not None else kept).combine_chunks() if kept or batch is not None else None
        if rows is None:
            return
        token, comp = rows["token"].to_numpy(), rows["component"].to_numpy()
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        last = np.r_[first[1:], len(token)] - 1
        good = (comp[first] != comp[last]) | (token[first] == sure if sure is not None else np.zeros(len(first), bool))
        if batch is not None and not good[-1]:
            if len(token) - first[-1] > BLOCK:
                good[-1] = True
            else:  # the last shingle may go on
                kept = rows.slice(int(first[-1])).to_batches()
                rows, good, first, last = rows.slice(0, int(first[-1])), good[:-1], first[:-1], last[:-1]
        else:
            kept = []
        if len(good) and good[-1]:
            sure = int(token[first[-1]])
        yield from rows.filter(pa.array(np.repeat(good, last - first + 1), pa.bool_())).to_batches()


def _worth(n: np.ndarray, i: np.ndarray, before: np.ndarray, m: np.ndarray, j: np.ndarray, before_m: np.ndarray) -> np.ndarray:
    """For two sets of n and m values that share those at places i and j: what they can have in common from there on, in
    1024ths of what they need; 0 if that is not enough, or if the pair is met at the value before anyway.

    Both sets are in one order of all values, so the first value that a pair shares leaves it the most, and a run of
    shared neighbours need only be met where it begins: no similar pair gets 0 at the first value it shares.
    """
    least = -(-PERCENT * (n.astype(np.int64) + m) // (100 + PERCENT))
    most = np.minimum(n - i, m - j).astype(np.int64)
    begins = (i == 0) | (j == 0) | (before != before_m)
    near = 100 * np.minimum(n, m).astype(np.int64) >= PERCENT * np.maximum(n, m).astype(np.int64)
    return np.where(near & begins & (most >= least), 1024 * most // least, 0)


def _meeting(cls: np.ndarray, comp: np.ndarray, n: np.ndarray, place: np.ndarray, before: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of different components at one shingle that can be similar, and their worth."""
    _, group, size = np.unique(comp, return_inverse=True, return_counts=True)
    order = np.lexsort((group, -size[group]))  # the largest component first: its rows only meet those of others
    cls, n, place, before, group = (x[order] for x in (cls, n, place, before, group))
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    border = [*first.tolist(), len(cls)]
    for a, b in zip(border[1:-1], border[2:], strict=True):
        for x in range(a, b, step := max(1, BLOCK // a)):
            y = min(b, x + step)
            worth = _worth(n[x:y, None], place[x:y, None], before[x:y, None], n[None, :a], place[None, :a], before[None, :a])
            p, q = np.nonzero(worth)
            yield cls[x + p], cls[q], worth[p, q]


def _near_rows(token: np.ndarray, cls: np.ndarray, comp: np.ndarray, n: np.ndarray, place: np.ndarray, before: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """The same pairs for shingles of at most SMALL rows, many shingles at once."""
    for s in range(1, min(SMALL, len(token))):
        q = np.flatnonzero(token[s:] == token[:-s])
        if not len(q):
            return
        p = q + s
        worth = np.where(comp[p] != comp[q], _worth(n[p], place[p], before[p], n[q], place[q], before[q]), 0)
        ok = worth > 0
        yield cls[p[ok]], cls[q[ok]], worth[ok]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(a, b, worth)`` of sets of different components that share a shingle and can be similar. Rows come by shingle."""
    kept = [np.zeros(0, np.int64)] * 6
    out: list[tuple[np.ndarray, ...]] = []
    made = 0

    def batch_of() -> pa.RecordBatch:
        p, q, worth = (np.concatenate([x[k] for x in out]) for k in range(3))
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(p, q)), pa.array(np.minimum(p, q)), pa.array(worth.astype(np.int32))], ["a", "b", "worth"])

    for batch in _ended(batches):
        if batch is not None:
            kept = [np.concatenate([x, batch.column(k).to_numpy()]) for k, x in enumerate(kept)]
        token = kept[0]
        if not len(token):
            continue
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        border = [*first.tolist(), len(token)]
        if batch is not None:
            border.pop()  # the last shingle may go on
        size = np.diff(border)
        some = [c[: border[-1]][np.repeat(size <= SMALL, size)] for c in kept]
        out += [x for x in _near_rows(*some) if len(x[0])]
        made = sum(len(x[0]) for x in out)
        for k in np.flatnonzero(size > SMALL).tolist():
            x, y = border[k : k + 2]
            for pair in _meeting(*(c[x:y] for c in kept[1:])):
                out.append(pair)
                made += len(pair[0])
                if made > BLOCK // 8:
                    yield batch_of()
                    out, made = [], 0
        kept = [c[border[-1] :] for c in kept]
    if out:
        yield batch_of()


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(cls, n, bits)``: for each of at least twice as many slots as the set has values, whether it holds an odd number of them."""
    for batch in batches:
        cls, n, bits = [], [], []
        for r in batch.to_pylist():
            x = _set_of(r["text"])
            if _set_key(x) != (r["ka"], r["kb"]):
                continue
            slots = max(64, 1 << (2 * len(x) - 1).bit_length())
            odd = np.bincount((x & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
            cls.append(r["cls"]), n.append(len(x)), bits.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.array(bits, pa.binary())], ["cls", "n", "bits"])


def _folded(bits: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(bits, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose parities allow similarity: a slot of unlike parity holds at least one value that only one set has."""
    for batch in batches:
        keep = []
        for r in batch.select(["na", "abits", "nb", "bbits"]).to_pylist():
            size = min(len(r["abits"]), len(r["bbits"]))
            apart = int(np.bitwise_count(_folded(r["abits"], size) ^ _folded(r["bbits"], size)).sum())
            both = r["na"] + r["nb"]
            keep.append(apart <= both - 2 * -(-PERCENT * both // (100 + PERCENT)))
        yield batch.select(["a", "b", "agree"]).filter(pa.array(keep, pa.bool_()))


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _link(docs: DataFrame, classes: DataFrame, pairs: DataFrame, component: DataFrame | None, repeated: bool, sift: bool) -> DataFrame | None:
    """Confirm ``pairs (a, b, agree)``, best first, beside what ``component`` joins; returns the components of both.

    With ``sift``, few of the pairs are expected to be similar. Earlier links are kept as the stars of their components,
    so a round reads its own links and no earlier round's.
    """
    spark = docs.sparkSession
    todo, left_over = pairs, pairs.count()
    if not left_over:
        return component
    release(spark)
    nodes = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    rows = cut(classes.select("cls", "row_key", "ka", "kb").join(nodes, "cls", "left_semi"), 2 * left_over, apart=True)
    # Texts travel, not sets: they are smaller. A row repeated as a whole is one of its class once.
    texts = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), "text").join(small(rows) if sift else rows, "row_key").select("cls", "ka", "kb", "text")
    texts = cut(texts.dropDuplicates(["cls", "text"]) if repeated else texts)
    if sift:
        # Most pairs of the prefix-filter join are far apart; a few bits for each value tell, so their texts need not meet.
        bits = cut(texts.mapInArrow(lean(_parities), "cls long, n long, bits binary"))
        first = bits.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("bits").alias("abits"))
        second = bits.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bbits"))
        todo = cut(pairs.join(first, "a").join(second, "b").mapInArrow(lean(_sift), "a long, b long, agree int"), left_over, apart=True)
        left_over = todo.count()
        if not left_over:
            return component
        rows = cut(todo.select(F.col("a").alias("cls")).union(todo.select(F.col("b").alias("cls"))).distinct(), 2 * left_over)
        texts = texts.join(small(rows), "cls", "left_semi")
    top, n_nodes = 1, rows.count()
    while True:
        # The best pairs of each row as the greater end, and of each row as the lesser one; all, once they are few.
        place = lambda end: F.row_number().over(Window.partitionBy(end).orderBy(F.desc("agree"), "a", "b"))
        picked = (place("a") <= top) | (place("b") <= top) if left_over > n_nodes else F.lit(True)
        ranked = cut(todo.select("a", "b", "agree", picked.alias("picked")), left_over)
        chosen = ranked.filter("picked").select("a", "b")
        first = texts.select(F.col("cls").alias("a"), F.col("text").alias("ta"), F.col("ka").alias("aka"), F.col("kb").alias("akb"))
        second = texts.select(F.col("cls").alias("b"), F.col("text").alias("tb"), F.col("ka").alias("bka"), F.col("kb").alias("bkb"))
        held = cut(chosen.join(first, "a").join(second, "b").mapInArrow(lean(_confirm), "a long, b long"), left_over, apart=True)
        links = held if component is None else held.union(component.select(F.col("node").alias("a"), F.col("component").alias("b")))
        component = cut(connected_components(links, python=True), left_over)
        if left_over <= n_nodes:
            release(spark)
            return component
        at = lambda c: component.select(F.col("node").alias(c), F.col("component").alias(f"{c}_c"))
        left = ranked.filter("NOT picked").join(at("a"), "a", "left").join(at("b"), "b", "left")
        todo = cut(left.filter(F.coalesce("a_c", "a") != F.coalesce("b_c", "b")).select("a", "b", "agree"), left_over)
        left_over = todo.count()
        release(spark)
        if not left_over:
            return component
        top *= 4


def _of(rows: DataFrame, component: DataFrame | None) -> DataFrame:
    """``rows (cls, ...)`` with the component of each class, by default itself."""
    if component is None:
        return rows.withColumn("component", F.col("cls"))
    known = component.select(F.col("node").alias("cls"), "component")
    return rows.join(known, "cls", "left").withColumn("component", F.coalesce("component", "cls"))


def complete(docs: DataFrame, classes: DataFrame, component: DataFrame | None, repeated: bool) -> DataFrame | None:
    """Components with every link between them that the forest did not propose."""
    release(docs.sparkSession)
    common, counts = common_shingles(docs)
    found = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), "text").mapInArrow(lean(_prefixes(common, counts)), "row_key long, ka long, kb long, n long, prefix binary")
    of = _of(classes.select("cls", "row_key", "ka", "kb"), component)
    # Rows repeated as a whole have one name: their postings are equal, and make no pairs of different components.
    prefixes = found.join(of, ["row_key", "ka", "kb"]).select("cls", "component", "n", "prefix")
    postings = prefixes.mapInArrow(lean(_postings), "token long, cls long, component long, n int, place int, before long")
    # A shingle all of whose sets are connected has nothing to add.
    open_ = cut(postings.repartition("token").sortWithinPartitions("token", "component").mapInArrow(lean(_mixed), postings.schema))
    release(docs.sparkSession)
    met = open_.repartition("token").sortWithinPartitions("token").mapInArrow(lean(_meet), "a long, b long, worth int")
    pairs = cut(met.groupBy("a", "b").agg(F.max("worth").alias("agree")))
    return _link(docs, classes, pairs, component, repeated, sift=True)


def groups(docs: DataFrame) -> DataFrame:
    """``(row_key, row_key2, doc_id, n_shingles, ka, kb, component, component_id)`` of every row.

    ``component`` names the group, ``component_id`` is its least id; both are null for sets that are empty or have no id.
    """
    spark = docs.sparkSession
    ship(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"), F.xxhash64(F.lit(1), "text", "doc_id").alias("row_key2"))
    signed = cut(rows.mapInArrow(lean(_sign), "doc_id long, row_key long, row_key2 long, n_shingles long, ka long, kb long, sig binary"))
    # A class is named by its set, as texts may share an id.
    classes = cut(
        signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("ka", "kb", "n_shingles")
        .agg(F.min("doc_id").alias("id"), F.min("row_key").alias("row_key"), F.min("sig").alias("sig"), F.count(F.lit(1)).alias("weight"))
        .withColumn("cls", F.monotonically_increasing_id())
    )
    pairs = cut(candidates(classes, parts))
    repeated = not signed.groupBy("row_key", "row_key2").count().filter("count > 1").isEmpty()
    component = _link(docs, classes, pairs, None, repeated, sift=False)
    component = complete(docs, classes, component, repeated)
    # Class -> component. A class may hold most rows and a component most classes, so both joins are spread.
    named = _of(classes.select("ka", "kb", "n_shingles", "id", "cls", F.col("weight").alias("copies")), component)
    least = named.groupBy("component").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("weight"))
    n_classes = classes.count()
    named = spread_join(named, cut(least, n_classes, apart=True), ["component"], "inner").select("ka", "kb", "n_shingles", "component", "component_id", F.col("copies").alias("weight"))
    signed = signed.drop("sig")
    out = spread_join(signed.filter("n_shingles > 0"), cut(named, n_classes, apart=True), ["ka", "kb", "n_shingles"])
    none = signed.filter("n_shingles = 0")
    return out.unionByName(none.withColumn("component", F.lit(None).cast("long")).withColumn("component_id", F.lit(None).cast("long")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Return ``(doc_id, n_shingles, component_id, kept)`` for ``docs (doc_id, text, ...)``."""
    out = groups(docs)
    component_id = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", component_id.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
