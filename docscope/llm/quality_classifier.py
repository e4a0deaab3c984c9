"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every text. Expectation-maximisation over the counts of
vote patterns (one row per pattern, whatever the corpus size) estimates each labeller's accuracy on good and on bad
texts and the share of good ones; each pattern's posterior is then the soft label that trains a linear scorer over
hashed features. No human label is read. The scorer's training set is at most about ``SAMPLE`` texts per side (likely
good, likely bad), drawn by a hash of the text (the documented bound of the fit); votes, pattern counts and scores
cover every row and whole texts.

A null or wordless text gets no votes and no features, and so the scorer's prior: it is kept (nothing speaks against
it). Repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docscope.llm.common import cut, lean, mix, ship, table, text_slices, word_hashes

BITS = 11
BUCKETS = 1 << BITS
SAMPLE = 1500
#: A document is rejected if the scorer gives it at most this probability of being good.
KEEP_ABOVE = 0.5
#: Before any vote is counted: the share of good texts, and how often a labeller is silent, says good, says bad on either side.
PRIOR, START = 0.9, ((0.500, 0.498, 0.002), (0.50, 0.35, 0.15))
#: A labeller is built to be sure before it says bad: how often it may be wrong on good texts, at most.
FALSE_ALARMS = 0.005

_CLASS = np.full(256, 7, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 space, 4 newline, 5 stop, 6 high, 7 symbol
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 6
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10] = 3, 4
for _c in b".,;:'\"-()?":
    _CLASS[_c] = 5
_SHAPE = np.arange(256, dtype=np.uint32)  # letters, digits and spaces by class, symbols as themselves
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:], _SHAPE[[9, 11, 12, 13]] = 1, 2, 3, 1, 32

# Name, votes bad from this measure on, votes good up to that one (-1: never votes good).
LABELLERS = (
    ("symbols", 0.04, 0.01),
    ("capitals", 0.35, -1),
    ("echoes", 0.15, 0.03),
    ("repeated_words", 0.85, -1),
    ("loose_marks", 0.12, -1),
    ("word_length", 14.0, -1),
    ("line_repeats", 0.40, -1),
    ("shouts", 0.08, -1),
)
LEAST_WORDS = 10


def measures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows x labellers measures, and each row's word count."""
    rows = len(offsets) - 1
    words, borders = word_hashes(data, offsets)
    kind = _CLASS[data]
    counts = np.zeros((8, rows))
    row_of = np.repeat(np.arange(rows), np.diff(offsets))
    for c in range(8):
        counts[c] = np.bincount(row_of[kind == c], minlength=rows)
    n = np.diff(borders).astype(float)
    some = np.maximum(n, 1)
    size = np.maximum(1, counts[:3].sum(0) + counts[5:].sum(0))
    letters = np.maximum(1, counts[0] + counts[1] + counts[6])
    owner = np.repeat(np.arange(rows), np.diff(borders))
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    echo = np.bincount(owner[same], minlength=rows) / some
    distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(borders[:-1], borders[1:], strict=True)], float)
    alone = (kind == 7) & np.concatenate([[True], kind[:-1] == 3]) & np.concatenate([kind[1:] == 3, [True]]) if len(kind) else np.zeros(0, bool)
    loose = np.bincount(row_of[alone], minlength=rows) / some
    double = (data == 33) if len(data) else np.zeros(0, bool)
    shout = np.bincount(row_of[double], minlength=rows) / some
    lines = np.zeros(rows)
    for i in np.flatnonzero(counts[4] > 2):
        own = [x for x in data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n") if x.strip()]
        lines[i] = 1 - len(set(own)) / max(1, len(own))
    return np.stack([counts[7] / size, counts[1] / letters, echo, 1 - distinct / some, loose, size / some, lines, shout], 1), n


def votes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x labellers: 1 good, 2 bad, 0 nothing."""
    value, n = measures(data, offsets)
    bad = value >= np.array([x[1] for x in LABELLERS])
    good = value <= np.array([x[2] for x in LABELLERS])
    out = np.where(bad, 2, np.where(good, 1, 0)).astype(np.int64)
    out[n < LEAST_WORDS] = 0
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x BUCKETS: log-scaled shares of hashed shape 3-grams (runs collapsed) and of hashed repeats at distance 1 and 2."""
    rows = len(offsets) - 1
    out = np.zeros((rows, BUCKETS), np.float32)
    if not len(data):
        return out
    row_of = np.repeat(np.arange(rows), np.diff(offsets))
    shape = _SHAPE[data]
    turn = np.ones(len(shape), bool)
    turn[1:] = (shape[1:] != shape[:-1]) | (row_of[1:] != row_of[:-1])
    shape, owner = shape[turn], row_of[turn]
    for n in (1, 2, 3):
        m = len(shape) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for i in range(n):
            h = h * np.uint64(257) + shape[i : i + m]
        ok = owner[n - 1 :] == owner[:m]
        np.add.at(out.reshape(-1), owner[:m][ok] * BUCKETS + (mix(h)[ok] >> np.uint64(64 - BITS)).astype(np.int64), 1)
    words, borders = word_hashes(data, offsets)
    for gap in (1, 2):
        row = np.searchsorted(borders, np.arange(len(words)), "right") - 1
        hit = (words[gap:] == words[:-gap]) & (row[gap:] == row[:-gap])
        np.add.at(out[:, gap], row[gap:][hit], 8)
    total = np.maximum(1, np.bincount(owner, minlength=rows))[:, None]
    return np.log1p(100 * out / total).astype(np.float32)


def fit_labellers(patterns: list[tuple[int, int]]) -> tuple[dict[int, float], np.ndarray, float]:
    """EM over (pattern, count). Returns each pattern's chance of being good, the labellers' vote rates, and the prior.

    Rates are P(vote | side), side 0 good and 1 bad, vote as in ``votes``; not voting is an outcome of its own, since
    a labeller that knows one kind of bad text is silent or content on the other kinds. Counts are smoothed by START.
    """
    k = len(LABELLERS)
    codes = np.array([p for p, _ in patterns], np.int64)
    weight = np.array([c for _, c in patterns], float)
    vote = (codes[:, None] // 3 ** np.arange(k)) % 3
    rate = np.repeat(np.array(START)[None], k, 0)
    prior, good = PRIOR, np.full(len(codes), PRIOR)
    for _ in range(200):
        fit = np.log(rate[np.arange(k), :, vote]).sum(1) + np.log([prior, 1 - prior])
        new = 1 / (1 + np.exp(np.clip(fit[:, 1] - fit[:, 0], -60, 60)))
        moved, good = np.abs(new - good).max(), new
        for side, chance in enumerate((good, 1 - good)):
            cast = np.stack([((vote == v) * (weight * chance)[:, None]).sum(0) for v in range(3)], 1)
            rate[:, side] = (cast + 4 * np.array(START[side])) / (cast.sum(1, keepdims=True) + 4)
        rate[:, 0, 2] = np.minimum(rate[:, 0, 2], FALSE_ALARMS)
        rate = np.clip(rate, 1e-3, None)
        prior = float(np.clip((weight * good).sum() / weight.sum(), 0.05, 0.98))
        if moved < 1e-6:
            break
    return dict(zip(codes.tolist(), good.tolist(), strict=True)), rate, prior


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -40, 40)))


def fit_scorer(x: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 300, ridge: float = 1e-4) -> Scorer:
    """Logistic regression on soft labels (gradient descent with momentum)."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    vw, vb = np.zeros_like(w), 0.0
    weight = weight / weight.sum()
    step = 4.0 / max(1e-6, float((weight * (x * x).sum(1)).sum()))
    for _ in range(rounds):
        gap = (1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40))) - label) * weight
        vw = 0.9 * vw - step * (x.T @ gap + ridge * w)
        vb = 0.9 * vb - step * gap.sum()
        w, b = (w + vw).astype(np.float32), b + vb
    return Scorer(w, float(b))


def _vote_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    power = 3 ** np.arange(len(LABELLERS))
    for batch in batches:
        codes = [np.zeros(0, np.int64)]
        for _, _, data, offsets in text_slices(batch.column("text")):
            codes.append(votes(data, offsets) @ power)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(codes)), batch.column("draw")], ["code", "draw"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    power = 3 ** np.arange(len(LABELLERS))
    seen: set[int] = set()
    for batch in batches:
        fresh = []
        for draw in batch.column("draw").to_pylist():  # copies of a text count once, and cost nothing more
            fresh.append(draw not in seen)
            seen.add(draw)
        batch = batch.filter(pa.array(fresh, pa.bool_()))
        codes, rows = [np.zeros(0, np.int64)], []
        for _, _, data, offsets in text_slices(batch.column("text")):
            codes.append(votes(data, offsets) @ power)
            rows += [x.tobytes() for x in features(data, offsets).astype(np.float16)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(codes)), pa.array(rows, pa.binary()), batch.column("draw")], ["code", "x", "draw"])


def fit(docs: DataFrame) -> Scorer | None:
    """Learn a scorer from the texts alone; None for an empty table."""
    ship(docs)
    texts = docs.select("text", F.pmod(F.xxhash64("text"), F.lit(1 << 30)).cast("long").alias("draw"))
    coded = texts.mapInArrow(lean(_vote_codes), "code long, draw long")
    coded = cut(coded.groupBy("code", "draw").agg(F.count(F.lit(1)).alias("n")))  # copies once; files by size, not by input split
    patterns = [(r["code"], r["count"]) for r in coded.groupBy("code").agg(F.sum("n").alias("count")).collect()]
    if not patterns:
        return None
    good, _, _ = fit_labellers(sorted(patterns))
    side = {c: p >= 0.5 for c, p in good.items()}
    totals = {s: max(1, sum(n for c, n in patterns if side[c] == s)) for s in (True, False)}
    # Draw below a bound on the text's hash: each side by its own rate.
    limit = {s: int(min(1.0, SAMPLE / totals[s]) * (1 << 30)) for s in totals}
    wide, narrow = sorted(limit.values(), reverse=True)
    few = [c for c, s in side.items() if limit[s] == wide]
    drawn = coded.filter((F.col("draw") < narrow) | ((F.col("draw") < wide) & F.col("code").isin(few))).select("draw").distinct()
    # About 2 * SAMPLE numbers, whatever the corpus: small enough to send to the texts.
    rows = texts.filter(F.col("draw") < wide).join(F.broadcast(drawn), "draw", "left_semi").mapInArrow(lean(_features), "code long, x binary, draw long")
    rows = rows.groupBy("draw").agg(F.min(F.struct("code", "x")).alias("row")).select("row.*").collect()
    rows.sort(key=lambda r: (r["code"], bytes(r["x"])))
    if not rows:
        return None
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float16).reshape(len(rows), -1).astype(np.float32)
    label = np.array([good[r["code"]] for r in rows], np.float32)
    known = np.array([r["code"] > 0 for r in rows])
    weight = np.where(known, 1.0, 0.01) / np.where(label >= 0.5, max(1, (known & (label >= 0.5)).sum()), max(1, (known & (label < 0.5)).sum()))
    return fit_scorer(x, label, weight.astype(np.float32))


def chances(scorer: Scorer | None, text: pa.Array) -> np.ndarray:
    """Each text's chance of being good; 1 for texts of too few words to tell."""
    out = [np.zeros(0)]
    for _, _, data, offsets in text_slices(text):
        n = np.diff(word_hashes(data, offsets)[1])
        p = np.ones(len(n))
        for i in range(0, len(n) if scorer is not None else 0, 512):
            part = offsets[i : i + 513]
            p[i : i + 512] = scorer(features(data[part[0] : part[-1]], part - part[0]))
        out.append(np.where(n < LEAST_WORDS, 1.0, p))
    return np.concatenate(out)


def score(docs: DataFrame, scorer: Scorer | None) -> DataFrame:
    """``(doc_id, quality, kept)`` for every row."""
    ship(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = chances(scorer, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array(p > KEEP_ABOVE)], ["doc_id", "quality", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, quality double, kept boolean")


def keep_good(docs: DataFrame, scorer: Scorer | None) -> DataFrame:
    """``docs`` without the rows that the scorer rejects."""
    names = docs.columns
    ship(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(chances(scorer, batch.column("row").field("text")) > KEEP_ABOVE))

    rows = docs.select(F.struct(*names).alias("row"))
    return rows.mapInArrow(lean(run), rows.schema).select(*(F.col(f"row.`{c}`").alias(c) for c in names))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs))
