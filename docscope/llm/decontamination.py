"""Benchmark decontamination by greedy string tiling.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z folded. A document meets a benchmark item where
they share ``SEED`` consecutive words. For each pair the longest common run of unmarked words is marked as a tile, again
and again, until none of at least SEED words is left; tiles do not overlap on either side, so passages whose sentences
changed places still count. A document is contaminated if the tiles cover at least ``COVER`` of an item's words. Equal
longest runs: the earliest in the item, then in the text.

1. The windows of all items mark the bits of a filter of fixed size, whatever the benchmark's. One pass over the texts
   keeps the windows that pass it, as places and hashes: all that the later steps read of a text.
2. Windows are counted over the documents. Tiles that cover a share of an item must use one of its rarer windows: those
   left when the commonest ones, which together cover less than ``FLOOR``, are taken away. Documents and items are
   joined on these, so common phrases pair nothing.
3. Each pair is tiled on its shared windows. The longest run is searched by halving with Karp-Rabin hashes of runs, and
   all runs of that length are marked before shorter ones are looked for, so that pairs of repetitive texts cost a
   few passes over both, not the product of their lengths.

Items with fewer than SEED words must occur as a whole; items without a word match nothing. Null texts match nothing.
Repeated rows get equal results. Empty tables: nothing is contaminated. Shares below FLOOR are given as 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docscope.llm.common import _INVERSE, _power, constants, cut, lean, mix, release, row_keys, ship, spread_join, table, text_slices, word_hashes

SEED = 5
COVER = 0.6
#: Shares of an item that are reported, and the bits of the filter (2 MiB).
FLOOR, FILTER_BITS = 0.25, 24
#: Tables of items that are broadcast; larger ones are joined by shuffles.
BLOCK_BYTES = 8 << 20

SEPARATORS = np.ones(256, bool)
SEPARATORS[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    SEPARATORS[_a:_b] = False
_ODD = constants(SEED, 61, odd=True)


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on; positions too near the end give unused values."""
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    out = np.zeros(len(words), np.uint64)
    for i in range(size):
        out += padded[i : i + len(words)] * _ODD[i]
    return mix(out + np.uint64(size))



def _windows_of(words: np.ndarray) -> tuple[int, np.ndarray]:
    """An item's window size and its windows."""
    size = min(SEED, len(words))
    return size, windows(words, size)[: len(words) - size + 1] if size else np.zeros(0, np.uint64)


def share(item: np.ndarray, size: int, places: np.ndarray, hashes: np.ndarray, floor: float = 0.0) -> float:
    """What part of an item's words greedy tiles cover, from its windows and a text's windows by place.

    ``places`` are sorted. Below ``floor`` the share may be given as 0. A run of k windows is one of k + size - 1 words.
    """
    known = np.sort(item)
    own = known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes
    places, hashes = places[own].astype(np.int64), hashes[own]
    n_words = len(item) + size - 1
    if not len(hashes):
        return 0.0
    if len(item) == 1:
        return 1.0
    theirs_known = np.sort(hashes)
    shared = theirs_known[np.minimum(np.searchsorted(theirs_known, item), len(theirs_known) - 1)] == item
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, np.flatnonzero(shared), 1)
    np.add.at(edge, np.flatnonzero(shared) + size, -1)
    if (np.cumsum(edge)[:-1] > 0).sum() < floor * n_words:
        return 0.0
    # Words of the text that no shared window covers are left out; runs stay together.
    words = np.unique(places[:, None] + np.arange(size))
    at = np.searchsorted(words, places)
    mine, theirs = np.zeros(n_words, bool), np.zeros(len(words), bool)
    base = 0x9E3779B97F4A7C15 | 1
    inverse = pow(base, -1, 1 << 64)
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * _power(base, len(x)), dtype=np.uint64)]) for x in (item, hashes)]
    holes = np.concatenate([[0], np.cumsum(~shared)])

    def runs(k: int) -> tuple[np.ndarray, ...]:
        """Free runs of k windows on either side that the other has too: positions and hashes."""
        long = k + size - 1
        p = np.arange(len(item) - k + 1)
        p = p[(holes[p + k] == holes[p]) & ~mine[p] & ~mine[p + long - 1]]
        i = np.arange(max(0, len(hashes) - k + 1))
        i = i[places[i + k - 1] - places[i] == k - 1]
        i = i[~theirs[at[i]] & ~theirs[at[i] + long - 1]]
        x, y = (((s[q + k] - s[q]) * _power(inverse, len(s))[q]) for s, q in ((sums[0], p), (sums[1], i)))
        if not len(p) or not len(i):
            return p[:0], x[:0], i[:0], y[:0]
        both = np.isin(x, y)
        other = np.isin(y, x[both])
        return p[both], x[both], i[other], y[other]

    # Marked tiles are never shorter than the runs looked for, so a run is free if its first and last words are.
    covered, top = 0, min(len(item), len(hashes))
    while top > 0:
        got = runs(top)
        low, high = 0, top
        if not len(got[0]):
            while high - low > 1:  # a run of k exists (k = low), none of k = high
                mid = (low + high) // 2
                if len(runs(mid)[0]):
                    low = mid
                else:
                    high = mid
            top = low
            if not top:
                break
            got = runs(top)
        p, x, i, y = got
        long = top + size - 1
        order = np.argsort(y, kind="stable")
        i, y = i[order], y[order]
        first = np.searchsorted(y, x)
        last = np.searchsorted(y, x, "right")
        seen: dict[int, int] = {}
        for a, b, e in zip(p.tolist(), first.tolist(), last.tolist(), strict=True):
            if mine[a] or mine[a + long - 1]:
                continue
            q = seen.get(b, b)
            while q < e and (theirs[at[i[q]]] or theirs[at[i[q]] + long - 1]):
                q += 1
            seen[b] = q
            if q < e and np.array_equal(item[a : a + top], hashes[i[q] : i[q] + top]):
                mine[a : a + long] = theirs[at[i[q]] : at[i[q]] + long] = True
                covered += long
        top = min(top - 1, len(item))
    return covered / n_words


class Items:
    """A few items in memory, for texts at hand: the same shares without Spark."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.ids, self.items = [i for i, _ in rows], []
        for _, _, data, offsets in text_slices(pa.array([t or "" for _, t in rows], pa.large_string())):
            w, b = word_hashes(data, offsets, separators=SEPARATORS)
            self.items += [_windows_of(w[x:y]) for x, y in zip(b[:-1], b[1:], strict=True)]

    def coverage(self, words: np.ndarray, borders: np.ndarray) -> list[dict[int, float]]:
        """For each text the share of each met item that tiles cover."""
        out = []
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            found = {}
            for k, (size, own) in enumerate(self.items):
                if size and size <= b - a and (x := share(own, size, np.arange(b - a - size + 1), windows(words[a:b], size)[: b - a - size + 1])):
                    found[k] = x
            out.append(found)
        return out


def _read_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, own = [], []
        for _, _, data, offsets in text_slices(batch.column("text")):
            w, b = word_hashes(data, offsets, separators=SEPARATORS)
            for x, y in zip(b[:-1], b[1:], strict=True):
                n, h = _windows_of(w[x:y])
                size.append(n), own.append(h.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), pa.array(size, pa.int32()), pa.array(own, pa.binary())], ["item", "item_id", "size", "own"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [np.frombuffer(x, np.int64) for x in batch.column("own").to_pylist()]
        n = np.array([len(x) for x in own], np.int64)
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(k) for k in n)]).astype(np.int32)
        cols = [np.concatenate([np.zeros(0, np.int64), *own]), np.repeat(batch.column("item").to_numpy(), n), np.repeat(batch.column("size").to_numpy(), n), place]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["hash", "item", "size", "place"])


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the filter, one row for each stretch of 64 KiB that has a bit set."""
    parts: dict[int, np.ndarray] = {}
    for batch in batches:
        slot = batch.column("slot").to_numpy()
        for part in np.unique(slot >> 19).tolist():
            bits = parts.setdefault(part, np.zeros(1 << 19, bool))
            bits[slot[slot >> 19 == part] & (1 << 19) - 1] = True
    rows = [np.packbits(x).tobytes() for x in parts.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array(rows, pa.binary())], ["part", "bits"])


def window_filter(postings: DataFrame) -> np.ndarray:
    """A bit for each value of the first FILTER_BITS bits of a window: 1 << (FILTER_BITS - 3) bytes."""
    slots = postings.select(F.shiftrightunsigned("hash", 64 - FILTER_BITS).cast("int").alias("slot")).distinct()
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in slots.repartition(F.shiftright("slot", 19)).mapInArrow(lean(_bits), "part int, bits binary").collect():
        out[r["part"] << 16 : (r["part"] + 1) << 16] = np.frombuffer(r["bits"], np.uint8)
    return out


def _hits(bits: np.ndarray, sizes: list[int]):
    """A mapper that adds to each row the places and hashes of its windows that pass the filter, by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, found = [], []
            for _, _, data, offsets in text_slices(batch.column("text")):
                words, borders = word_hashes(data, offsets, separators=SEPARATORS)
                at, hit = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for n in sizes:
                    h = windows(words, n)
                    slot = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                    p = np.flatnonzero(bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1)
                    p = p[p + n <= borders[np.searchsorted(borders, p, "right")]]  # within one text
                    at.append(p), hit.append(h[p])
                p, h = np.concatenate(at), np.concatenate(hit)
                order = np.argsort(p, kind="stable")
                p, h = p[order], h[order]
                cuts = np.searchsorted(p, borders)
                for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                    place.append((p[a:b] - borders[k]).astype(np.int32).tobytes()), found.append(h[a:b].tobytes())
            keep = batch.select([c for c in batch.schema.names if c != "text"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(place, pa.binary()), pa.array(found, pa.binary())], [*keep.schema.names, "places", "hashes"])

    return run


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's different windows."""
    for batch in batches:
        found = [np.unique(np.frombuffer(x, np.int64)) for x in batch.column("hashes").to_pylist()]
        rows = np.repeat(batch.column("row_id").to_numpy(), [len(h) for h in found])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found])), pa.array(rows)], ["hash", "row_id"])


def _rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each item one of which any text has whose tiles cover FLOOR of it."""
    for batch in batches:
        out: list[tuple[int, int, int]] = []
        for item, size, rows in zip(batch.column("item").to_pylist(), batch.column("size").to_pylist(), batch.column("rows").to_pylist(), strict=True):
            h, place, n = (np.array([r[c] for r in rows], np.int64) for c in ("hash", "place", "n"))
            words = int(place.max()) + size
            seen = n > 0
            if not seen.any():
                continue
            # Windows in order of their counts, the commonest first; a word is covered from the first one over it on.
            order = np.lexsort((h[seen], -n[seen]))
            hs, ps = h[seen][order], place[seen][order]
            rank = np.cumsum(np.concatenate([[0], hs[1:] != hs[:-1]]))
            since = np.full(words, len(hs), np.int64)
            for k in range(size):
                np.minimum.at(since, ps + k, rank)
            since = np.sort(since)
            need = max(1, int(np.ceil(FLOOR * words)))
            if since[need - 1] == len(hs):
                continue  # no text can cover so much
            keep = rank >= since[need - 1]
            one = np.unique(hs[keep], return_index=True)[1]
            out += [(int(x), item, int(c)) for x, c in zip(hs[keep][one], n[seen][order][keep][one], strict=True)]
        cols = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["hash", "item", "weight"])


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by row_id, a text's windows before its items: one text and one item are held at a time."""
    places = hashes = None
    for batch in batches:
        rows, ids, shares = [], [], []
        for r in batch.to_pylist():
            if r["places"] is not None:
                places, hashes = np.frombuffer(r["places"], np.int32), np.frombuffer(r["hashes"], np.uint64)
                continue
            x = share(np.frombuffer(r["hashes"], np.uint64), r["size"], places, hashes, FLOOR)
            if x >= FLOOR:
                rows.append(r["row_id"]), ids.append(r["item_id"]), shares.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(shares, pa.float64())], ["row_id", "item_id", "share"])


def _contaminated(docs: DataFrame, benchmark: DataFrame, cover: float) -> DataFrame:
    """``(row_id, doc_id, ka, kb, items, coverage)`` for every row."""
    if cover < FLOOR:
        raise ValueError(f"cover must be at least {FLOOR}")
    ship(docs)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL").distinct()
    items = items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text").mapInArrow(lean(_read_items), "item long, item_id long, size int, own binary")
    items = cut(items.filter("size > 0"), 100 * benchmark.count(), apart=True)  # items are wide
    postings = items.mapInArrow(lean(_postings), "hash long, item long, size int, place int")
    by_size = items.groupBy("size").agg(F.sum(F.length("own") / 8).cast("long").alias("windows")).collect()  # at most SEED rows
    sizes = sorted(r["size"] for r in by_size)
    n_windows = sum(r["windows"] for r in by_size)
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), *row_keys("doc_id", "text"), "text")
    met = cut(rows.mapInArrow(lean(_hits(window_filter(postings), sizes)), "row_id long, doc_id long, ka long, kb long, places binary, hashes binary"))
    seeds = met.filter(F.length("hashes") > 0).mapInArrow(lean(_seeds), "hash long, row_id long")
    # Windows of the benchmark with the texts that have them (combined before the shuffle), and how many items do.
    texts = seeds.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    counted = cut(postings.groupBy("hash").agg(F.count(F.lit(1)).alias("weight")).join(texts, "hash"), n_windows, apart=True)
    rated = spread_join(postings, counted, ["hash"], size=BLOCK_BYTES)
    rated = rated.groupBy("item", "size").agg(F.collect_list(F.struct("hash", "place", F.coalesce("n", F.lit(0)).alias("n"))).alias("rows"))
    rare = cut(rated.mapInArrow(lean(_rare), "hash long, item long, weight long"), n_windows, apart=True)
    pairs = cut(spread_join(seeds, rare, ["hash"], "inner", size=BLOCK_BYTES).select("row_id", "item").distinct())
    release(docs.sparkSession)
    held = cut(items.join(pairs.groupBy("item").agg(F.count(F.lit(1)).alias("weight")), "item"), n_windows, apart=True)
    sides = spread_join(pairs, held, ["item"], "inner", size=BLOCK_BYTES).select("row_id", F.lit(1).alias("side"), "item_id", "size", F.lit(None).cast("binary").alias("places"), F.col("own").alias("hashes"))
    sides = sides.unionByName(met.join(pairs.select("row_id").distinct(), "row_id", "left_semi").select("row_id", F.lit(0).alias("side"), F.lit(None).cast("long").alias("item_id"), F.lit(0).alias("size"), "places", "hashes"))
    tiled = sides.repartition("row_id").sortWithinPartitions("row_id", "side").mapInArrow(lean(_tile), "row_id long, item_id long, share double")
    found = tiled.groupBy("row_id").agg(F.array_sort(F.collect_set(F.when(F.col("share") >= cover, F.col("item_id")))).alias("items"), F.max("share").alias("coverage"))
    out = met.select("row_id", "doc_id", "ka", "kb").join(found, "row_id", "left")
    return out.withColumn("items", F.coalesce("items", F.array().cast("array<bigint>"))).withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))


def contamination(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """``(doc_id, contaminated, items, coverage)`` for every row: the items it leaks, and the largest share of any."""
    return _contaminated(docs, benchmark, cover).select("doc_id", (F.col("coverage") >= cover).alias("contaminated"), "items", "coverage")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """``docs`` without contaminated rows. Rows are matched by 128 bits of id and text; texts are shuffled only if the
    contaminated ones are too many to broadcast."""
    bad = _contaminated(docs, benchmark, cover).filter(F.col("coverage") >= cover).groupBy("ka", "kb").agg(F.count(F.lit(1)).alias("weight"))
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.select("row", F.xxhash64("row.doc_id", "row.text").alias("ka"), F.xxhash64(F.lit(1), "row.text", "row.doc_id").alias("kb"))
    return spread_join(rows, cut(bad), ["ka", "kb"], "left_anti").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
