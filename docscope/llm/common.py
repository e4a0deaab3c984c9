"""Helpers the corpus operators share: table access, lineage cuts, text batches, word hashes."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docscope.operators.sizes import BROADCAST_BYTES, is_small

#: Text handed to numpy at once; scratch arrays take about 60 bytes for each byte of it.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(df: DataFrame) -> None:
    """Hand this package to the session's Python workers, once: they may start where it cannot be imported."""
    context = df.sparkSession.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    archive = Path(tempfile.mkdtemp(prefix="package-")) / "docscope.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted((root / "docscope").rglob("*.py")):
            z.write(path, path.relative_to(root))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


#: Rows that one partition of a small cut table should hold.
ROWS_A_PART = 100_000


def cut(df: DataFrame, rows: int | None = None, apart: bool = False) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``; only a local session without that setting gets one of its own. ``rows``,
    a bound on the row count where one is known, keeps small tables from being spread over as many files as a shuffle
    has partitions. The tasks that make the rows become as few; with ``apart``, for narrow rows that take work to make, they
    stay as many and the rows are shuffled into the files. Without Hadoop's native library an executor launches a process
    for each file and checksum file it writes, so files are not free.
    """
    if rows is not None:
        df = df.repartition(parts_for(rows)) if apart else df.coalesce(parts_for(rows))
    spark = df.sparkSession
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[[^,]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def parts_for(rows: int) -> int:
    return max(1, -(-rows // ROWS_A_PART))


#: A key with more than one in so many of all rows is dealt to several tasks.
HOT = 512


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], how: str = "left", weight: str = "weight", size: int = BROADCAST_BYTES) -> DataFrame:
    """Join ``many`` with ``one``, which says for each of its keys how many rows of ``many`` have it (``weight``).

    A small ``one`` (by rows and bytes, see ``sizes``) is broadcast. Else keys with more than a HOT-th of all rows, of
    which there are fewer than HOT whatever the size, are told to all tasks, and their rows are salted, each key by as
    many salts as it holds HOT-ths. ``one`` is looked at three times, so it should be materialised. Null keys meet
    nothing.
    """
    if is_small(one, size=size):
        return many.join(F.broadcast(one.drop(weight)), keys, how)
    total = one.agg(F.sum(weight)).first()[0] or 0
    salts = F.ceil(F.col(weight) * HOT / F.lit(float(max(total, 1)))).cast("int")
    heavy = one.filter(salts > 1).select(*keys, salts.alias("_salts")).distinct()
    many = many.join(F.broadcast(heavy), keys, "left")
    # Salts come from the rows themselves, so that a task that is run again deals its rows out as before.
    told = F.xxhash64(*(f.name for f in many.schema.fields if "map<" not in f.dataType.simpleString()))
    many = many.withColumn("_salt", F.coalesce(F.pmod(told, F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")
    one = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1))).drop(weight)
    return many.join(one, [*keys, "_salt"], how).drop("_salt")


def row_keys(*columns: str) -> list[Column]:
    """128 bits that name the values of ``columns``, as ``ka`` and ``kb``."""
    return [F.xxhash64(*columns).alias("ka"), F.xxhash64(F.lit(1), *reversed(columns)).alias("kb")]


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle and checkpoint files of tables that nothing refers to any more.

    Spark's cleaner acts on the driver's garbage collections, which an iterative job on a roomy heap may not see.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_kept: dict[str, dict] = {}
#: Resident MB from which a Python worker hands freed memory back, and how many more it has before it tries again.
ROOM_MB, MORE_MB = 100, 16
_resident = [ROOM_MB]


def kept_by(owner: str, things: dict) -> dict:
    """``things``, known from now on as what ``owner`` keeps in a worker between tasks."""
    _kept[owner] = things
    return things


def forget_others(owner: str) -> None:
    others = [things for name, things in _kept.items() if name != owner and things]
    for things in others:
        things.clear()
    if others:
        gc.collect()  # they may hold themselves
        _resident[0] = 0
        hand_back()


def hand_back() -> None:
    """Give freed memory back to the system, where it has become much."""

    def resident() -> int:
        try:
            return int(Path("/proc/self/statm").read_text().split()[1]) >> 8  # pages of 4 KB
        except (OSError, ValueError):
            return 0

    if resident() < _resident[0] + MORE_MB:
        return
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass
    _resident[0] = max(ROOM_MB, resident())


def lean(run: Callable, owner: str = "") -> Callable:
    """``run``, a function for mapInArrow, in workers that many stages share and that outlive each of them.

    What operators other than ``owner`` keep there goes before, and memory that ``run`` has freed goes back after it.
    """

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(owner)
        try:
            yield from run(batches)
        finally:
            hand_back()

    return out


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(first, last, data, offsets)`` for runs of rows of at most ``limit`` bytes (one row at least).

    ``data`` holds the UTF-8 bytes of rows ``first:last``, ``offsets`` their ``last - first + 1`` borders. Null is empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, borders, data = column.buffers()
    borders = np.frombuffer(borders, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    first, n = 0, len(column)
    while first < n:
        last = max(first + 1, int(np.searchsorted(borders, borders[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, last, data[borders[first] : borders[last]], borders[first : last + 1] - borders[first]
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words (the finaliser of splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def constants(n: int, seed: int, odd: bool = False) -> np.ndarray:
    """``n`` fixed 64-bit words."""
    words = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return words | np.uint64(1) if odd else words


_BYTE_LOWER = constants(256, 11)
_BYTE_LOWER[65:91] = _BYTE_LOWER[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown by doubling and kept."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = 1 << max(10, (n - 1).bit_length())
        got = np.full(size, base, np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        _powers[base] = got
    return got[:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without separator bytes, by default ASCII white space) and each row's range among them.

    A-Z count as a-z. Returns ``(hashes, borders)``: row i has ``hashes[borders[i]:borders[i + 1]]``.
    """
    n, rows = len(data), len(offsets) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    inside = ~separators[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    border = offsets[1:-1]
    border = border[(border > 0) & (border < n)]
    begins[border] |= inside[border]
    ends[border - 1] |= inside[border - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_LOWER[data] * _power(_BASE, n), out=sums[1:])
    h = (sums[end] - sums[start]) * _power(_INVERSE, n)[start]
    return mix(h + (end - start).astype(np.uint64)), np.searchsorted(start, offsets)


def shingle_hashes(words: np.ndarray, borders: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Each row's sorted distinct hashes of ``size`` consecutive words; fewer words make one shingle, none no shingle."""
    if not len(words):
        return [np.zeros(0, np.uint64)] * (len(borders) - 1)
    odd = constants(size, 23, odd=True)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    whole = np.zeros(len(words), np.uint64)
    for i in range(size):
        whole += padded[i : i + len(words)] * odd[i]
    whole = mix(whole)
    out = []
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        elif b > a:
            out.append(mix(np.array([(words[a:b] * odd[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
