"""Held-out accuracy of the learned operators, and the exact round trip of the codec."""

from __future__ import annotations

import hashlib
import random
import string

import numpy as np
import pytest
import sentencepiece

from docscope.llm import quality_classifier
from docscope.llm.language_id import UNKNOWN, fit, op4_language_id, predict
from docscope.llm.piece_codec import PieceCodec, default_model, op7_piece_codec
from docscope.llm.quality_classifier import op9_quality_classifier

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def codec():
    return PieceCodec(default_model())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=default_model())


def strange_texts():
    rng = random.Random(4)
    out = ["", " ", "   ", "a", " a", "a ", "▁", "▁▁ a", "\n", "\n\n a\t b", "a\x00b", "<s> </s> <unk> <0x41>", "é½ ﬁ 　", "😀😀", "日本語のテキスト", "a" * 300, " " * 37 + "x" + " " * 5, " \u0085x"]
    alphabet = "abcdefghijklmnop  ▁ '.\n\t0123éüßñ漢字日😀ABThequick"
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    out += ["".join(rng.choice(string.printable) for _ in range(rng.randint(1, 120))) for _ in range(500)]
    return out


def test_codec_equals_the_library(codec, library):
    for t in strange_texts():
        ids = library.encode(t)
        assert codec.encode(t) == ids, t
        assert codec.parts(t)[2] == library.decode(ids) == codec.decode(ids), t


def test_backtracking_needs_no_fallback(codec):
    """Random piece sequences: every split is found by backtracking alone, and is what merging gives."""
    rng = random.Random(8)
    pieces = [p for p in codec.id if "▁" not in p]
    for _ in range(800):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 6)))
        assert codec.backtrack(text) == codec.merge(text)


def test_one_scan_names_the_longest_reachable_piece(codec):
    for t in ("▁international▁understandings", "aaaaaaab", "▁x"):
        for at, piece in enumerate(codec._longest(t)):
            reachable = [t[at:end] for end in range(at + 1, len(t) + 1) if t[at:end] in codec.id and codec.merge(t[at:end]) == [t[at:end]]]
            assert piece == max(reachable, key=len)
            assert codec._next(piece) == max((p for p in reachable if p != piece), key=len, default=None)


def test_full_memo_changes_nothing(codec, library, monkeypatch):
    monkeypatch.setattr("docscope.llm.piece_codec.MEMO", 20)
    for t in strange_texts()[:300]:
        assert codec.encode(t) == library.encode(t)


def segmented(codec, monkeypatch):
    made, own = [], codec._segment
    monkeypatch.setattr(codec, "_segment", lambda seg: (made.append(seg), own(seg))[1])
    return made


def test_words_are_one_segment_whatever_follows_them(library, monkeypatch):
    codec = PieceCodec(default_model())
    made = segmented(codec, monkeypatch)
    text = "river, stone, garden, river. stone. garden. river! stone! garden! river stone garden"
    assert codec.encode(text) == library.encode(text)
    assert len(made) == 6  # three words and three marks


def test_words_in_use_stay_when_the_memo_fills(library, monkeypatch):
    monkeypatch.setattr("docscope.llm.piece_codec.MEMO", 20)
    codec = PieceCodec(default_model())
    made = segmented(codec, monkeypatch)
    for i in range(200):
        text = f"the {'abcdefghijklmnopqrst'[i % 20]}{'uvwxyzabcd'[i // 20]}"
        assert codec.encode(text) == library.encode(text)
    assert made.count("▁the") == 1


def test_pieces_next_to_marks_and_other_scripts(codec, library):
    rng = random.Random(6)
    pieces = sorted(codec.id)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(2000)]
    texts += ["".join(rng.choice("ab.,x:’”«»…éжщя日本 \t\n▁1'\"()😀\x00\x7fﬁ") for _ in range(rng.randint(1, 30))) for _ in range(2000)]
    for t in texts:
        ids, n, text = codec.parts(t)
        want = library.encode(t)
        assert (ids, n, text) == (",".join(map(str, want)), len(want), library.decode(want)), t


def test_codec_query(spark, library):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in op7_piece_codec(spark, SF).collect():
        ids = library.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_languages_held_out(spark):
    got = op4_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 150
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spoiled = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 'zz' ELSE lang END AS lang")
    rows = lambda m: sorted(predict(docs, m).collect())
    assert rows(fit(docs)) == rows(fit(spoiled))


def test_texts_without_letters_are_unknown(spark, make):
    docs = [(i, "the quick and the dead", "en", None, 0) for i in range(20)] + [(30 + i, "der und die das", "de", None, 0) for i in range(20)] + [(90, "123 !", "en", None, 0), (91, None, "en", None, 0), (92, "é", None, None, 0)]
    got = {r["doc_id"]: r for r in op4_language_id(spark, make(documents=docs)).collect()}
    assert got[90]["lang_pred"] == got[91]["lang_pred"] == UNKNOWN and got[90]["score"] == 0
    assert got[92]["lang_pred"] in ("de", "en") and got[1]["lang_pred"] == "en" and got[31]["lang_pred"] == "de"


def test_quality_against_human_labels(spark):
    """Labels are never trained on; they only measure."""
    hand = spark.read.parquet(f"{SF}/labels.parquet").withColumnRenamed("quality", "human")
    got = op9_quality_classifier(spark, SF).join(hand, "doc_id").collect()
    assert np.mean([r["kept"] for r in got if r["human"] == 1]) > 0.97
    assert np.mean([r["kept"] for r in got if r["human"] == 0]) < 0.2


def test_em_finds_labeller_rates():
    """Patterns drawn from known rates: EM recovers who is good."""
    rng = np.random.default_rng(2)
    k = len(quality_classifier.LABELLERS)
    truth = rng.random(20_000) < 0.85
    kinds = rng.integers(0, k, len(truth))
    votes = np.zeros((len(truth), k), int)
    for j in range(k):
        votes[:, j] = np.where(truth, (rng.random(len(truth)) < 0.002) * 2, ((kinds == j) | (rng.random(len(truth)) < 0.1)) * 2)
    votes[:, 0] = np.where((votes[:, 0] == 0) & truth, 1, votes[:, 0])
    codes = votes @ 3 ** np.arange(k)
    values, counts = np.unique(codes, return_counts=True)
    good, rate, prior = quality_classifier.fit_labellers(list(zip(values.tolist(), counts.tolist(), strict=True)))
    said = np.array([good[c] >= 0.5 for c in codes.tolist()])
    assert (said == truth).mean() > 0.97 and abs(prior - 0.85) < 0.05
