"""The pipeline, stage by stage as files, against plain Python."""

from __future__ import annotations

import hashlib
import re
import weakref
from pathlib import Path

import pyarrow as pa
import pytest
import sentencepiece

import corpus_pipeline
from docscope.llm import piece_codec, quality_classifier
from docscope.llm.common import cut, lean
from docscope.llm.piece_codec import codec, default_model
from tests.llm.conftest import prose
from tests.llm.test_dedup import components, tiling
from tests.llm.test_scans import secrets

ITEM = prose(30, 4242)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents():
    rows = [(i, prose(60 + i % 50, 3000 + i), "en", f"s{i % 3}", 0) for i in range(120)]
    rows += [(200 + i, " ".join(f"{w}%%% $$$" for w in prose(60, 6000 + i).split()), "en", "junk", 0) for i in range(25)]  # junk
    rows += [(300, rows[3][1], "en", "copy", 0), (301, rows[5][1] + " tail", "en", "copy", 0)]  # an exact and a near copy
    rows += [(310, f"{prose(40, 71)} {ITEM} {prose(20, 72)}", "en", "leak", 0)]
    rows += [(320, f"é {prose(40, 73)} token = \"{'ab12' * 10}\" {prose(9, 74)}", "en", "secret", 0)]
    rows += [(330, None, None, None, None), (331, "", "en", "s", 0)]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s, _ in rows]


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def blanked(text):
    out, at = [], 0
    for span in filter(None, secrets(text).split(",")):
        start, stop = map(int, span.split(":")[1:])
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, stop)
    return "".join(out) + text[at:]


@pytest.fixture(scope="module")
def stages(spark, make, tmp_path_factory):
    """Each stage's result, written and read again."""
    folder = make(documents=documents(), benchmark=[(1, ITEM)])
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(*COLUMNS)
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path_factory.mktemp('stage')}/{k}"
        stage(spark, out[-1], folder).write.parquet(path)
        out.append(spark.read.parquet(path))
    return folder, out


def test_each_stage_against_plain_python(spark, stages):
    folder, (docs, good, single, clean, safe, coded) = stages
    rows = lambda df: {r["doc_id"]: r for r in df.collect()}
    before, after = rows(docs), rows(good)
    scorer = quality_classifier.fit(docs)
    texts = list(before)
    chance = quality_classifier.chances(scorer, pa.array([before[i]["text"] for i in texts], pa.string()))
    assert set(after) == {i for i, p in zip(texts, chance, strict=True) if p > quality_classifier.KEEP_ABOVE}
    assert not [i for i in after if 200 <= i < 225] and {i for i in before if i < 200 or i >= 300} <= set(after)

    group = components([(i, r["text"]) for i, r in after.items()])
    assert set(rows(single)) == {i for i in after if group[i][1] == i}
    assert 300 not in rows(single) and 301 not in rows(single)

    item = words(ITEM)
    leaks = {i for i, r in rows(single).items() if tiling(item, words(r["text"] or ""), 5) >= 0.6 * len(item)}
    assert leaks == {310} and set(rows(clean)) == set(rows(single)) - leaks

    for i, r in rows(clean).items():
        got = rows(safe)[i] if i in (320, 330, 331) else None
        if got is not None:
            want = None if r["text"] is None else blanked(r["text"])
            assert got["text"] == want and got["n_chars"] == (None if want is None else len(want))
    assert {i: r["text"] for i, r in rows(safe).items()} == {i: None if r["text"] is None else blanked(r["text"]) for i, r in rows(clean).items()}
    assert all(df.columns == COLUMNS for df in (good, single, clean, safe))

    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    final = rows(coded)
    assert set(final) == set(rows(safe))
    for i, r in rows(safe).items():
        ids = library.encode(r["text"] or "")
        assert (final[i]["n_tokens"], final[i]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_run_equals_its_stages(spark, stages):
    folder, results = stages
    assert sorted(corpus_pipeline.run(spark, folder).collect()) == sorted(results[-1].collect())


def test_repeated_ids_stay_once(spark):
    docs = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (2, "four five")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()) == [1, 2]


def test_null_and_reused_ids_keep_their_texts(spark):
    a, b, c = prose(60, 1), prose(60, 2), prose(60, 3)
    rows = [(None, a), (None, a), (None, b), (2, b), (1, b), (3, c), (3, "other words entirely here now"), (3, c), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect())))
    assert got == sorted(map(str, [(None, a), (1, b), (3, c), (3, "other words entirely here now"), (None, None)]))


CLASHING = ["kept_id", "kept_key", "row", "row_key", "row_key2", "ka", "kb", "weight", "spans", "new", "component", "text2", "side", "_salt"]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_awkward_tables(spark, make, nasty, name, stage):
    """Columns of names that stages use inside, repeated rows, nulls and long texts; and empty tables."""
    folder = make(documents=nasty, benchmark=[(1, None), (2, ""), (3, ITEM)])
    docs = spark.createDataFrame(nasty, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHING:
        docs = docs.selectExpr("*", f"'x' AS `{c}`")
    got = stage(spark, docs, folder)
    rows = got.collect()
    if name != corpus_pipeline.STAGES[-1][0]:
        assert got.columns == docs.columns
        assert all(r[c] == "x" for r in rows for c in CLASHING)
    if name == "MinHash near-dedup":
        assert sorted(str(r["doc_id"]) for r in rows if r["doc_id"] is None or r["doc_id"] < 10) == ["1", "2", "3", "4", "5", "6", "9"]
    elif name != "quality classifier":
        assert len(rows) == len(nasty)
    empty = stage(spark, docs.limit(0), folder)
    assert empty.collect() == [] and (name == corpus_pipeline.STAGES[-1][0] or empty.columns == docs.columns)


def test_a_stage_leaves_no_tables_to_the_next_ones():
    """Workers outlive their stage: the codec's tables go when another operator's task begins, and stay for its own."""
    gone = weakref.ref(codec(default_model()))
    list(lean(iter, piece_codec.__name__)([]))
    assert gone() is not None
    list(lean(iter)([]))
    assert gone() is None


def test_workers_start_a_stage_without_the_codec(spark):
    docs = spark.createDataFrame([(i, prose(30, i)) for i in range(8)], "doc_id long, text string").coalesce(1)

    def kept(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(piece_codec._codecs)], pa.int64())})

    piece_codec.encode_documents(docs).collect()
    assert docs.mapInArrow(lean(kept), "n long").collect()[0]["n"] == 0


def files(spark):
    """Files that checkpoints of this session have written so far."""
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    return 0 if folder.isEmpty() else len(list(Path(re.sub("^file:/*", "/", folder.get())).rglob("part-*")))


@pytest.mark.parametrize("k,most", [(1, 280), (2, 140)])
def test_small_tables_take_few_files(spark, make, k, most):
    """Each file costs an executor a process or two, so tables of few rows are not spread over a file for each shuffle partition."""
    folder = make(documents=documents(), benchmark=[(1, ITEM)])
    docs = cut(spark.read.parquet(f"{folder}/documents.parquet").select(*COLUMNS))
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {c: spark.conf.get(c) for c in held}
    try:
        for c, v in held.items():
            spark.conf.set(c, v)
        n = files(spark)
        corpus_pipeline.STAGES[k][1](spark, docs, folder)
        assert files(spark) - n <= most
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_the_fit_takes_few_files(spark):
    docs = spark.createDataFrame([(i, prose(30, i)) for i in range(200)], "doc_id long, text string").repartition(40)
    cut(docs)  # so that there is a folder
    n = files(spark)
    quality_classifier.fit(docs)
    assert files(spark) - n <= 4
