"""Language identification with string kernels.

The kernel is the blended-spectrum presence kernel: two texts share the byte n-grams (n = 1 to 4, A-Z folded) that
occur in both, over the geometric mean of how many each has. N-grams are hashed to ``BUCKETS`` presence bits. A fixed
number of labelled texts per language serve as Nyström landmarks; kernel ridge regression, one language against the
rest, is solved in their feature space and folded into one matrix, so that scoring a batch of texts is one product of
presence bits with landmarks and one with that matrix.

Learned from rows with a language and crc32(doc_id as text) mod 5 other than 0, at most about ``PER_LANGUAGE`` of each
language, drawn by a hash of doc_id (the documented bound of the fit; every row is scored, on its whole text).

Null texts and texts without a letter are ``und`` with score 0; so is everything if nothing could be learned. Null
doc_ids are not learned from and not held out. Ties go to the language first by name. Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docscope.llm.common import ship, table, text_slices

ORDERS, BITS = 4, 14
BUCKETS = 1 << BITS
PER_LANGUAGE, LANDMARKS = 400, 32
RIDGE = 1e-3
FOLDS = 5
UNKNOWN = "und"
#: More languages than this cannot be learned in one model (it bounds what reaches the driver).
MAX_LANGUAGES = 500

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_ODD = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STEP = 1 << 20


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Boolean matrix rows x BUCKETS: which hashed n-grams each row's text holds."""
    rows = len(offsets) - 1
    out = np.zeros((rows, BUCKETS), bool)
    flat = out.reshape(-1)
    for at in range(0, len(data), _STEP):
        # A step overlaps the next by the longest n-gram, so long texts need no more scratch space.
        b = _FOLD[data[at : at + _STEP + ORDERS - 1]]
        row = np.searchsorted(offsets, np.arange(at, at + len(b)), "right") - 1
        end = offsets[row + 1] - at
        h = np.zeros(len(b), np.uint32)
        for n in range(1, ORDERS + 1):
            shifted = b[n - 1 :]
            m = len(shifted)
            h[:m] += (shifted + np.uint32(1)) * _ODD[n - 1]
            ok = np.arange(m) + n <= end[:m]
            bucket = ((h[:m] * np.uint32(0x2C1B3C6D + 2 * n)) >> np.uint32(32 - BITS)).astype(np.int64)
            flat[(row[:m] * BUCKETS + bucket)[ok]] = True
    return out


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    out = letters[offsets[1:]] > letters[offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # packed bits, landmarks x BUCKETS / 8
    weights: np.ndarray  # landmarks x languages

    def scores(self, bits: np.ndarray) -> np.ndarray:
        marks = np.unpackbits(self.landmarks, axis=1).astype(np.float32)
        return kernel(bits, marks) @ self.weights


def kernel(bits: np.ndarray, marks: np.ndarray) -> np.ndarray:
    own = np.sqrt(np.maximum(1, bits.sum(1, dtype=np.float32)))[:, None]
    return bits.astype(np.float32) @ marks.T / own / np.sqrt(np.maximum(1, marks.sum(1)))[None, :]


def train(languages: list[str], packed: np.ndarray) -> Model:
    """Fit from one packed presence row per labelled text; the first LANDMARKS of each language are landmarks."""
    names = sorted(set(languages))
    labels = np.array([names.index(x) for x in languages])
    chosen = np.concatenate([np.flatnonzero(labels == k)[:LANDMARKS] for k in range(len(names))])
    bits = np.unpackbits(packed, axis=1).astype(bool)
    marks = bits[chosen].astype(np.float32)
    cross = kernel(bits, marks).astype(np.float64)
    values, vectors = np.linalg.eigh(cross[chosen])
    use = values > 1e-6 * values.max()
    root = vectors[:, use] / np.sqrt(values[use])
    phi = cross @ root
    target = np.where(labels[:, None] == np.arange(len(names)), 1.0, -1.0)
    # Languages weigh alike, however many texts each has.
    weight = (1 / np.bincount(labels))[labels][:, None]
    solved = np.linalg.solve(phi.T @ (phi * weight) + RIDGE * np.eye(phi.shape[1]), phi.T @ (target * weight))
    return Model(names, packed[chosen], (root @ solved).astype(np.float32))


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for _, _, data, offsets in text_slices(batch.column("text")):
            out += [x.tobytes() for x in np.packbits(presence(data, offsets), axis=1)]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("ord"), pa.array(out, pa.binary())], ["lang", "ord", "bits"])


def fit(docs: DataFrame) -> Model | None:
    """Learn from ``docs (doc_id, text, lang)`` without the held-out fold; None if there is nothing to learn from."""
    ship(docs)
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (fold_of(F.col("doc_id")) != 0))
    counts = usable.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return None
    rate = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, PER_LANGUAGE / r["count"]))))
    # Drawn by id and text, repeated rows once: neither an id nor a row that recurs can swell what is collected.
    order = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    drawn = usable.withColumn("ord", order).filter(F.col("ord") < rate[F.col("lang")] * float(1 << 40))
    drawn = drawn.select("lang", "ord", "text").dropDuplicates(["lang", "ord"])
    rows = drawn.mapInArrow(_packed, "lang string, ord long, bits binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["ord"], bytes(r["bits"])))
    return train([r["lang"] for r in rows], np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8).reshape(len(rows), -1))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``; only the text decides."""

    ship(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = None
        for batch in batches:
            names, scores = [], []
            for _, _, data, offsets in text_slices(batch.column("text")):
                known = has_letter(data, offsets)
                for i in range(0, len(offsets) - 1, 256):
                    part = offsets[i : i + 257]
                    if model is None:
                        names += [UNKNOWN] * (len(part) - 1)
                        scores += [0.0] * (len(part) - 1)
                        continue
                    if marks is None:
                        marks = np.unpackbits(model.landmarks, axis=1).astype(np.float32)
                    value = kernel(presence(data[part[0] : part[-1]], part - part[0]), marks) @ model.weights
                    best = value.argmax(1)
                    top = np.clip((value[np.arange(len(best)), best] + 1) / 2, 0, 1)
                    ok = known[i : i + 256]
                    names += [model.languages[k] if y else UNKNOWN for k, y in zip(best, ok, strict=True)]
                    scores += np.where(ok, top, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
