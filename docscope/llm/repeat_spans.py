"""Exact removal of repeated 200-byte strings, by blockwise suffix sorting with a difference cover.

A byte goes if a 200-byte string over it starts anywhere else in the corpus too. Sorting all suffixes of the corpus
would move many times its size, so suffixes first fall into buckets that keep equal 200-byte prefixes together: the
bucket of position p is named by the least-hashed 32-gram of the 200 bytes from p on (its anchor). Neighbouring
positions share an anchor; the stretch of positions with one anchor and the bytes they span is a segment.

1. Each text's segments are listed as (bucket, segment hash, place), and counted. A bucket with one occurrence has no
   repeat. A segment that occurs twice is repeated at each of its positions.
2. Buckets with several different segments are sorted, a block of buckets at a time: one copy of each segment is
   fetched, laid out with anchors in one column, and the suffixes of each column (they alone can tie) are sorted by
   bucket, by their first bytes up to the next cover column, by that column's rank, and by the bytes left. The ranks
   order the strings of RANKED bytes at the columns of a difference cover modulo PERIOD; they are computed once per
   block by doubling in steps of the period, so a tie of any length costs one comparison of ranks and memory is a few
   ranks for each sample column. Equal neighbours are the repeats.
3. The repeated positions go back to every place of their segment, and each text drops the union of their strings.

Texts are UTF-8 bytes; null is empty. Matches never cross documents. Repeated rows are repeats of each other, so texts
of 200 bytes or more that occur twice vanish. An empty table gives an empty result. Only doc_id and text are read.
Segments are named by 128 bits, texts by 80. Shorter texts take part in no join. A text with more than 1/512 of all rows (there
are fewer than 512 such) is known to vanish, so its rows stay where they are and one of them stands for all.
A bucket with more than SPLIT segments is split by the bytes before the anchor and, again, by those after it: every
200-byte string has enough bytes on one side to fall whole into one of these finer buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docscope.llm.common import constants, cut, HOT, _INVERSE, mix, _power, release, row_keys, ship, table

LENGTH, GRAM = 200, 32
SPAN = LENGTH - GRAM + 1  # grams in a string: 169
ANCHOR = SPAN - 1  # the anchor's column in a block, and the most positions before it
WIDTH = ANCHOR + LENGTH  # columns of a block
PERIOD, COVER = 16, (0, 1, 2, 5, 8)  # every difference modulo 16 is one of two members
RANKED = 11 * PERIOD
#: Segments sorted at once, and segments of one bucket beyond which it is split.
BLOCK, SPLIT = 8192, 20_000
LEFT, RIGHT = 32, 100
#: Text is worked on in stretches of this many positions, so long texts need no more memory.
STRETCH = 1 << 20

_BYTE = constants(256, 71)
_PLACE = np.uint64((1 << 24) - 1)
#: A place in a text is one number: first position, positions, anchor, and NAMED bits of the text's second key.
NAMED = (1 << 16) - 1


def _sums(d: np.ndarray) -> np.ndarray:
    out = np.empty(len(d) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_BYTE[d] * _power(0x5851F42D4C957F2D, len(d)), out=out[1:])
    return out


def _hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return mix((sums[stop] - sums[start]) * _power(_INVERSE, len(sums))[start] + (stop - start).astype(np.uint64))


def segments(d: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of one text: bucket, segment hash, first position, positions, anchor's distance from the first."""
    out = []
    for at in range(0, max(0, len(d) - LENGTH + 1), STRETCH):
        x = d[at : at + STRETCH + LENGTH - 1]
        sums = _sums(x)
        grams = np.arange(len(x) - GRAM + 1)
        h = _hash(sums, grams, grams + GRAM)
        key = (h & ~_PLACE) | grams.astype(np.uint64)  # ties: the first
        least = key
        size = 1
        while 2 * size <= SPAN:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[: len(least) - (SPAN - size)], least[SPAN - size :])
        anchor = (least & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        count = np.diff(np.concatenate([first, [len(anchor)]]))
        a = anchor[first]
        whole = mix(_hash(sums, first, first + count - 1 + LENGTH) + (a - first).astype(np.uint64))
        out.append((h[a], whole, first + at, count, a - first))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    for x in column:
        yield np.frombuffer((x.as_py() or "").encode(), np.uint8)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of segments, about 50,000 rows at a time: bucket, segment, the text's first key, place."""
    got: list[tuple[np.ndarray, ...]] = []
    waiting = 0
    for batch in batches:
        keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("ka", "kb"))
        for ka, kb, d in zip(*keys, _texts(batch.column("text")), strict=True):
            bucket, seg, first, n, anchor = segments(d)
            if len(bucket):
                place = first << 32 | n << 24 | anchor << 16 | kb
                got.append((bucket.view(np.int64), seg.view(np.int64), np.full(len(bucket), ka, np.int64), place))
                waiting += len(bucket)
            if waiting > 50_000:
                yield [np.concatenate(x) for x in zip(*got, strict=True)]
                got, waiting = [], 0
    if got:
        yield [np.concatenate(x) for x in zip(*got, strict=True)]


def _fresh(*columns: np.ndarray) -> np.ndarray:
    """Which of the sorted rows differ from the row before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with how often they were seen and one of their places, combined before the shuffle."""
    for cols in _listed(batches):
        order = np.lexsort((cols[1], cols[0]))
        at = np.flatnonzero(_fresh(cols[0][order], cols[1][order]))
        times = np.diff(np.append(at, len(order)))
        yield pa.RecordBatch.from_arrays([pa.array(c[order[at]]) for c in cols] + [pa.array(times)], ["bucket", "seg", "ka", "place", "times"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cols in _listed(batches):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["home", "seg", "ka", "place"])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each text; there are fewer than HOT texts."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        keep = []
        for i, key in enumerate(zip(batch.column("ka").to_pylist(), batch.column("kb").to_pylist(), strict=True)):
            if key not in seen:
                seen.add(key)
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int32()))


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut wanted segments out of their texts; segments of split buckets go out twice, under finer names."""
    names = ["bucket", "home", "seg", "n", "anchor", "body"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    before = None
    for batch in batches:
        rows: list[tuple] = []
        keys = zip(batch.column("ka").to_pylist(), batch.column("kb").to_pylist(), strict=True)
        for key, d, wanted in zip(keys, _texts(batch.column("text")), batch.column("wanted").to_pylist(), strict=True):
            again, before = key == before, key
            for w in () if again else wanted:  # copies of a text stand together
                first, n, anchor = w["place"] >> 32, w["place"] >> 24 & 255, w["place"] >> 16 & 255
                body = d[first : first + n - 1 + LENGTH].tobytes()
                if not w["split"]:
                    rows.append((w["bucket"], w["bucket"], w["seg"], n, anchor, body))
                    continue
                name = w["bucket"].to_bytes(8, "little", signed=True)
                left, right = body[max(0, anchor - LEFT) : anchor], body[anchor + GRAM : anchor + GRAM + RIGHT]
                for side, near, whole in ((b"L", left, LEFT), (b"R", right, RIGHT)):
                    if len(near) == whole:
                        fine = hashlib.blake2b(name + side + near, digest_size=8).digest()
                        rows.append((int.from_bytes(fine, "little", signed=True), w["bucket"], w["seg"], n, anchor, body))
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _name(*keys: np.ndarray) -> np.ndarray:
    """Ranks of rows by several keys, the first the most significant; equal rows share a rank."""
    order = np.lexsort(keys[::-1])
    step = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        step[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int32)
    out[order] = np.cumsum(step, dtype=np.int32)
    return out


def _word(block: np.ndarray, at: int, size: int) -> np.ndarray:
    """``size`` <= 8 bytes from column ``at`` as one number."""
    out = np.zeros(len(block), np.uint64)
    for i in range(at, at + size):
        out = out << np.uint64(8) | block[:, i]
    return out


def sort_block(bucket: np.ndarray, n: np.ndarray, anchor: np.ndarray, bodies: list[bytes]) -> np.ndarray:
    """Boolean rows x SPAN: which of a row's positions (by their column) start a string that another row has too.

    Rows of a bucket are different segments, so equal strings are in different rows.
    """
    rows = len(bucket)
    block = np.zeros((rows, WIDTH), np.uint8)
    for r, body in enumerate(bodies):
        at = ANCHOR - anchor[r]
        block[r, at : at + len(body)] = np.frombuffer(body, np.uint8)
    low, high = ANCHOR - anchor, ANCHOR - anchor + n  # columns of the positions
    name = np.unique(bucket, return_inverse=True)[1].astype(np.int32)
    first, last = int(low.min()), int(high.max())
    # Ranks at the cover columns: PERIOD bytes, then doubled; a cover column's successor by the period is one as well.
    cover = [c for c in range(first, min(WIDTH, last + PERIOD + RANKED)) if c % PERIOD in COVER and c + PERIOD <= WIDTH]
    rank = {c: _name(_word(block, c, 8), _word(block, c + 8, 8)) for c in cover}
    size = PERIOD
    while 2 * size <= RANKED:
        rank = {c: _name(r, rank[c + size]) for c, r in rank.items() if c + size in rank}
        size *= 2
    rest = RANKED - size
    rank = {c: _name(r, rank[c + rest]) for c, r in rank.items() if c + rest in rank} if rest else rank
    out = np.zeros((rows, SPAN), bool)
    for c in range(first, last):
        use = np.flatnonzero((low <= c) & (c < high))
        if len(use) < 2:
            continue
        part = block[use]
        to = next(k for k in range(c, c + PERIOD) if k % PERIOD in COVER)
        keys = [name[use]]
        for a in range(c, to, 8):
            keys.append(_word(part, a, min(8, to - a)))
        keys.append(rank[to][use])
        for a in range(to + RANKED, c + LENGTH, 8):
            keys.append(_word(part, a, min(8, c + LENGTH - a)))
        order = np.lexsort(keys[::-1])
        tie = np.ones(len(order) - 1, bool)
        for k in keys:
            s = k[order]
            tie &= s[1:] == s[:-1]
        out[use[order[1:][tie]], c] = True
        out[use[order[:-1][tie]], c] = True
    return out


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in bucket order; whole buckets are sorted together, several to a block."""
    held: list[pa.RecordBatch] = []
    size, full = 0, BLOCK

    def done(rows: pa.Table) -> pa.RecordBatch:
        named = [rows[c].to_numpy() for c in ("bucket", "home", "seg")]
        order = np.lexsort(named[::-1])
        rows = rows.take(pa.array(order[_fresh(*(c[order] for c in named))]))  # one row for each segment of a bucket
        bucket = rows["bucket"].to_numpy()
        n, anchor = rows["n"].to_numpy(), rows["anchor"].to_numpy()
        found = sort_block(bucket, n, anchor, rows["body"].to_pylist())
        hit = np.flatnonzero(found.any(1))
        bits = [np.packbits(found[r, ANCHOR - anchor[r] : ANCHOR - anchor[r] + n[r]]).tobytes() for r in hit]
        return pa.RecordBatch.from_arrays([pa.array(rows[c].to_numpy()[hit]) for c in ("home", "seg")] + [pa.array(bits, pa.binary())], ["home", "seg", "bits"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size < full:
            continue
        rows = pa.Table.from_batches(held)
        bucket = rows["bucket"].to_numpy()
        border = int(np.flatnonzero(bucket != bucket[-1])[-1]) + 1 if (bucket != bucket[-1]).any() else 0
        if border:
            yield done(rows.slice(0, border))
        held = rows.slice(border).combine_chunks().to_batches()
        size = rows.num_rows - border
        full = max(BLOCK, 2 * size)  # one large bucket is put together anew only as often as it doubles
    if held:
        yield done(pa.Table.from_batches(held))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch = batch.filter(pc.invert(batch.column("stands")))
        size, removed, spans, digest = [], [], [], []
        for d, runs in zip(_texts(batch.column("text")), batch.column("runs").to_pylist(), strict=True):
            starts = np.zeros(len(d) + 1, bool)
            for x in runs or ():
                first, n = x["place"] >> 32, x["place"] >> 24 & 255
                if x["bits"] is None:
                    starts[first : first + n] = True
                else:
                    starts[first : first + n] |= np.unpackbits(np.frombuffer(x["bits"], np.uint8))[:n].astype(bool)
            at = np.flatnonzero(starts)
            edge = np.zeros(len(d) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + LENGTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            size.append(len(d))
            removed.append(int(gone.sum()))
            spans.append(int((gone[1:] & ~gone[:-1]).sum() + (gone[:1].sum())))
            digest.append(hashlib.sha256(d[~gone].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row of ``docs (doc_id, text, ...)``.

    Places are named by the text's hash, so equal texts share what is found for them.
    """
    ship(docs)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["ka", "kb"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ka, kb = row_keys("text")
    named_row = [ka, kb.bitwiseAND(NAMED).alias("kb"), "doc_id", "text"]
    long = rows.filter(F.octet_length("text") >= LENGTH).select(*named_row, F.lit(False).alias("stands"))
    texts, hot = long, None
    often = cut(long.groupBy(*keys).count().filter(F.col("count") * HOT > F.lit(max(docs.count(), HOT))).select(*keys))
    if not often.isEmpty():  # fewer than HOT rows whatever the size
        hot = long.join(F.broadcast(often), keys, "left_semi")
        one = hot.mapInArrow(_once, "ka long, kb long, doc_id long, text string, stands boolean").dropDuplicates(keys)
        # Named anew, as keys out of a Python step may be null: an inner join would test them, a left join would not, and
        # the two would not share an exchange.
        twice = cut(one.select(*named_row, F.lit(True).alias("stands"), F.explode(F.array(F.lit(0), F.lit(1))).alias("x")).drop("x"))
        texts = long.join(F.broadcast(often), keys, "left_anti").union(twice)
    # One shuffle by bucket serves both counts: places of a segment, and segments of a bucket.
    counted = texts.select(*keys, "text").mapInArrow(_counted, "bucket long, seg long, ka long, place long, times long").repartition(parts, "bucket")
    found = counted.groupBy("bucket", "seg").agg(F.sum("times").alias("times"), F.min(F.struct("ka", "place")).alias("at"))
    found = found.withColumn("kinds", F.count(F.lit(1)).over(Window.partitionBy("bucket")))
    status = cut(found.filter("times > 1 OR kinds > 1"))
    release(docs.sparkSession)
    named = lambda place: F.col(place).bitwiseAND(NAMED).alias("kb")
    wanted = status.filter("kinds > 1").select("at.ka", named("at.place"), F.struct("bucket", "seg", "at.place", (F.col("kinds") > SPLIT).alias("split")).alias("w"))
    wanted = wanted.groupBy(*keys).agg(F.collect_list("w").alias("wanted"))
    # Texts are shuffled by key once: both joins with them read the same exchange, for which their columns are alike.
    held = texts.join(wanted, keys).select(*keys, "doc_id", "text", "stands", "wanted")
    bodies = held.mapInArrow(_fetch, "bucket long, home long, seg long, n int, anchor int, body binary")
    ties = bodies.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_sort, "home long, seg long, bits binary")
    known = status.filter("times > 1").select(F.col("bucket").alias("home"), "seg", F.lit(None).cast("binary").alias("bits"))
    single = ties.join(status.filter("times = 1").select(F.col("bucket").alias("home"), "seg"), ["home", "seg"], "left_semi")
    places = texts.select(*keys, "text").mapInArrow(_placed, "home long, seg long, ka long, place long")
    runs = places.join(known.union(single), ["home", "seg"]).select("ka", named("place"), F.struct("place", "bits").alias("run"))
    runs = runs.groupBy(*keys).agg(F.collect_set("run").alias("runs"))
    out = texts.join(runs, keys, "left").select(*keys, "doc_id", "text", "stands", "runs")
    out = out.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    whole = lambda df, gone, spans, kept: df.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), gone.alias("n_removed"), F.lit(spans).cast("long").alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256")
    )
    out = out.union(whole(rows.filter(F.octet_length("text") < LENGTH), F.lit(0).cast("long"), 0, F.col("text").cast("binary")))
    return out if hot is None else out.union(whole(hot, F.octet_length("text").cast("long"), 1, F.lit("").cast("binary")))


def op5_repeat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
