"""Near-duplicates, components, exact repeats and decontamination against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from docscope.llm import common, decontamination, lsh_forest, repeat_spans
from docscope.llm.common import word_hashes
from docscope.llm.components import connected_components
from docscope.llm.decontamination import op10_decontamination
from docscope.llm.lsh_forest import op8_minhash_near_dedup
from docscope.llm.repeat_spans import op5_repeat_spans
from tests.llm.conftest import prose


def shingles(text):
    w = (text or "").translate({i: i + 32 for i in range(65, 91)})
    for c in "\t\n\r\x0b\x0c":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


def near_rows(seed=5):
    """Chains and groups of edited copies with similarities around the threshold."""
    rng = random.Random(seed)
    rows = []
    for g in range(12):
        words = prose(rng.randint(20, 200), 100 + g).split()
        for _ in range(rng.randint(2, 14)):
            w = list(words)
            for _ in range(rng.randint(0, max(1, len(w) // 14))):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            rows.append(" ".join(w))
            if rng.random() < 0.3:
                words = w
    rows += [prose(60, 900 + i) for i in range(40)] + ["A b c", "a B  c", "a b c d", "", None, "x"]
    rng.shuffle(rows)
    return [(i, t, None, None, 0) for i, t in enumerate(rows)]


@pytest.mark.parametrize("parts", ["4", "40"])
def test_near_duplicates(spark, make, parts):
    """Many partitions put most neighbours on seams between them."""
    rows = near_rows()
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op8_minhash_near_dedup(spark, make(documents=rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == components(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_sets_and_components(spark, make, monkeypatch, seed):
    """A third of all rows are copies of one text and a third near copies; nothing is broadcast, so both are dealt out."""
    monkeypatch.setattr(common, "is_small", lambda df, *a, **k: False)
    rng = random.Random(seed)
    words = prose(60, 77).split()
    rows = [" ".join(words)] * 60 + [" ".join([*words[:i], f"x{i}", *words[i + 1 :]]) for i in range(60)] + [prose(40, 500 + i) for i in range(50)] + [""] * 30
    rng.shuffle(rows)
    rows = [(i, t, None, None, 0) for i, t in enumerate(rows)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op8_minhash_near_dedup(spark, make(documents=rows)).collect()}
    assert got == components(rows)


def test_links_in_a_crowd_of_near_misses(spark, make):
    """A shared passage makes all pairs 72 % alike; two more shared shingles make 40 pairs that are just above 75 %."""
    passage = " ".join(f"p{i}" for i in range(76))
    rows = []
    for i in range(1200):
        own = [f"own{i}x{k}" for k in range(14)]
        if i < 80:
            own[:2] = [f"both{i // 2}x{k}" for k in range(2)]
        rows.append((i, f"{passage} {' '.join(own)}", None, None, 0))
    got = {r["doc_id"]: r["component_id"] for r in op8_minhash_near_dedup(spark, make(documents=rows)).collect()}
    assert got == {i: i - i % 2 if i < 80 else i for i in range(1200)}


@pytest.mark.parametrize("seed", [5, 6])
def test_prefix_join_alone_finds_all_links(spark, make, monkeypatch, seed):
    """Without any candidate of the forest, every link comes from the prefix-filter join."""
    none = lambda classes, parts: classes.selectExpr("cls AS a", "cls AS b", "0 AS agree").limit(0)
    monkeypatch.setattr(lsh_forest, "candidates", none)
    rows = near_rows(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op8_minhash_near_dedup(spark, make(documents=rows)).collect()}
    assert got == components(rows)


def test_threshold_is_inclusive(spark, make):
    # 8 and 6 shared of 8 shingles: exactly three quarters; one word less is below.
    w = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join(w), None, None, 0), (2, " ".join(w[:10]), None, None, 0), (3, " ".join(f"v{i}" for i in range(12)), None, None, 0), (4, " ".join(f"v{i}" for i in range(9)), None, None, 0)]
    got = {r["doc_id"]: r["component_id"] for r in op8_minhash_near_dedup(spark, make(documents=rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 600)] + [(7, 7), (1, 2), (2, 1), (1, 2), (None, 4)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 600)} | {1: 1, 2: 1}


def repeats(rows):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = {}
    for d in texts:
        for p in range(len(d) - 199):
            seen[d[p : p + 200]] = seen.get(d[p : p + 200], 0) + 1
    out = []
    for (i, *_), d in zip(rows, texts, strict=True):
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - 199):
            if seen[d[p : p + 200]] > 1:
                gone[p : p + 200] = True
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out.append((i, len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def repeat_rows(seed=11):
    rng = random.Random(seed)
    shared = [prose(60, 40 + k) for k in range(6)]
    rows = []
    for k in range(40):
        parts = [prose(rng.randint(5, 60), 1000 + 7 * k)]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared).encode()
            n = rng.choice([150, 199, 200, 201, 230, len(s)])
            at = rng.randint(0, max(0, len(s) - n))
            parts += [s[at : at + n].decode(), prose(rng.randint(1, 40), 5000 + rng.randrange(10**5))]
        rows.append("".join(parts))
    rows += [rows[0], "é" * 150, "x" * 500, "y" * 200, "ab" * 130, None, "", "z" * 199, "z" * 199]
    return [(i, t, None, None, 0) for i, t in enumerate(rows)]


@pytest.mark.parametrize("split, hot", [(None, 512), (1, 512), (None, 1), (1, 1)])
def test_exact_repeats(spark, make, monkeypatch, split, hot):
    """With ``split`` every bucket takes the way of crowded ones; with ``hot`` 512 every copied text that of hot ones."""
    monkeypatch.setattr(repeat_spans, "HOT", hot)
    if split is not None:
        monkeypatch.setattr(repeat_spans, "SPLIT", split)
    rows = repeat_rows()
    got = op5_repeat_spans(spark, make(documents=rows)).collect()
    assert sorted(str((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in got) == repeats(rows)


def test_cover_reaches_every_difference():
    for d in range(repeat_spans.PERIOD):
        assert any((a + d) % repeat_spans.PERIOD in repeat_spans.COVER for a in repeat_spans.COVER)


def test_long_text_is_cut_in_stretches(monkeypatch):
    d = np.frombuffer(prose(400, 3).encode(), np.uint8)
    bucket, _, first, n, anchor = repeat_spans.segments(d)
    monkeypatch.setattr(repeat_spans, "STRETCH", 300)
    b2, _, f2, n2, a2 = repeat_spans.segments(d)
    where = lambda f, n, a: {int(p): int(x + y) for x, c, y in zip(f, n, a, strict=True) for p in range(x, x + c)}
    assert where(first, n, anchor) == where(f2, n2, a2)
    assert set(bucket.tolist()) == set(b2.tolist())


def tiling(item, text, least):
    """Greedy string tiling as it is defined: again and again the longest run of unmarked words."""
    a, b = [False] * len(item), [False] * len(text)
    total = 0
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] and not a[p + n] and not b[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        n, p, t = best
        if n < least or not n:
            return total
        a[p : p + n], b[t : t + n] = [True] * n, [True] * n
        total += n


def test_tiles_against_the_definition():
    rng = random.Random(9)
    for _ in range(60):
        item = [f"w{rng.randrange(8)}" for _ in range(rng.randint(5, 30))]
        text = []
        for _ in range(rng.randint(1, 6)):
            at = rng.randrange(len(item))
            text += item[at : at + rng.randint(1, 12)] + [f"w{rng.randrange(8)}" for _ in range(rng.randint(0, 4))]
        block = decontamination.Items([(1, " ".join(item))])
        data = np.frombuffer(" ".join(text).encode(), np.uint8)
        words, borders = word_hashes(data, np.array([0, len(data)]), separators=decontamination.SEPARATORS)
        got = block.coverage(words, borders)[0].get(0, 0.0)
        assert got == pytest.approx(tiling(item, text, min(decontamination.SEED, len(item))) / len(item))


def test_reordered_passages_are_caught(spark, make):
    item = prose(40, 77).split()
    turned = item[20:30] + ["and"] + item[:10] + ["then"] + item[30:] + item[10:20]
    docs = [
        (1, "before " + " ".join(item).upper().replace(" ", "  ") + ", after", None, None, 0),
        (2, prose(30, 1) + " " + " ".join(turned), None, None, 0),
        (3, prose(200, 78), None, None, 0),
        (4, " ".join(item[:12]), None, None, 0),
        (5, None, None, None, 0),
    ]
    got = {r["doc_id"]: r for r in op10_decontamination(spark, make(documents=docs, benchmark=[(9, " ".join(item)), (10, "of a"), (11, None)])).collect()}
    assert [got[i]["contaminated"] for i in range(1, 6)] == [True, True, False, False, False]
    assert got[2]["items"] == [9] and got[2]["coverage"] == 1.0
    assert got[4]["coverage"] == pytest.approx(0.3)


def test_blocks_of_items_add_up(spark, make, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 200)
    items = [(i, prose(12, 300 + i)) for i in range(12)]
    docs = [(i, f"x {t} y", None, None, 0) for i, t in items] + [(99, items[0][1] + " . " + items[7][1], None, None, 0)]
    got = {r["doc_id"]: r["items"] for r in op10_decontamination(spark, make(documents=docs, benchmark=items)).collect()}
    assert all(i in got[i] for i in range(12)) and {0, 7} <= set(got[99])


def test_repetitive_pairs_cost_a_few_passes(spark, make):
    """Long repetitive items and texts: no list of all pairs of equal windows is made."""
    item = "go on and on " * 2000
    docs = [(1, "go on and on " * 20_000, None, None, 0), (2, "on and on go " * 9 + "stop", None, None, 0)]
    got = {r["doc_id"]: r["coverage"] for r in op10_decontamination(spark, make(documents=docs, benchmark=[(1, item), (2, "go " * 3000)])).collect()}
    assert got == {1: 1.0, 2: 0.0}


def test_common_windows_pair_nothing_alone(spark, make):
    """Items share a phrase that every text has; only texts with the rest of an item are contaminated."""
    phrase = "it is the case that one may say so"
    items = [(i, f"{phrase} {prose(12, 700 + i)}") for i in range(20)]
    docs = [(i, f"{prose(20, 800 + i)} {phrase} {prose(20, 900 + i)}", None, None, 0) for i in range(100)]
    docs += [(200 + i, f"{prose(9, i)} {t.split('so ')[1]} {phrase}", None, None, 0) for i, t in items[:7]]
    got = {r["doc_id"]: r["items"] for r in op10_decontamination(spark, make(documents=docs, benchmark=items)).collect()}
    assert got == {i: [] for i in range(100)} | {200 + i: [i] for i in range(7)}


def test_signatures_agree_as_sets_do():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:340], rng.integers(0, 2**63, 60).astype(np.uint64)])
    same = np.frombuffer(lsh_forest.signature(a), ">u2") == np.frombuffer(lsh_forest.signature(b), ">u2")
    assert abs(same.mean() - 340 / 460) < 0.25
    assert lsh_forest.signature(a[::-1].copy()) == lsh_forest.signature(a)


def test_forests_read_links_without_a_copy_of_their_files(spark, monkeypatch):
    """Links of many small files are not written again, file by file, before their components are sought."""
    from docscope.llm import components as module

    wrote = []
    monkeypatch.setattr(module, "cut", lambda df, rows=None: wrote.append((out := common.cut(df, rows)).rdd.getNumPartitions()) or out)
    links = common.cut(spark.createDataFrame([(3, 1), (2, 3), (9, 8), (5, 5), (None, 4), (8, 9)], "a long, b long").repartition(40))
    assert links.rdd.getNumPartitions() == 40
    got = {r["node"]: r["component"] for r in connected_components(links, python=True).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    assert wrote == [1]


def test_rounds_do_not_pile_up_links(spark, make, monkeypatch):
    """In a crowd of near misses there are many rounds; each reads its own links and the components so far, no more."""
    real, leaves = lsh_forest.connected_components, []

    def seen(links, python):
        leaves.append(links._jdf.queryExecution().analyzed().collectLeaves().size())
        return real(links, python=python)

    monkeypatch.setattr(lsh_forest, "connected_components", seen)
    passage = " ".join(f"p{i}" for i in range(76))
    rows = []
    for i in range(240):
        own = [f"own{i}x{k}" for k in range(14)]
        if i < 40:
            own[:2] = [f"both{i // 2}x{k}" for k in range(2)]
        rows.append((i, f"{passage} {' '.join(own)}", None, None, 0))
    got = {r["doc_id"]: r["component_id"] for r in op8_minhash_near_dedup(spark, make(documents=rows)).collect()}
    assert got == {i: i - i % 2 if i < 40 else i for i in range(240)}
    assert len(leaves) > 2 and max(leaves) == 2
