"""Readers, writers and streams."""

from __future__ import annotations

import datetime

import pytest

from docscope.sources import tables
from docscope.streaming import grid as stream


def test_json_lines_keep_nulls(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "é")], "id int, name string")
    tables.write_jsonl(df, f"{tmp_path}/out", ["id"])
    lines = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == ['{"id":1,"name":"é"}', '{"id":2,"name":null}']
    assert sorted(tables.read_jsonl(spark, f"{tmp_path}/out", "id int, name string").collect()) == sorted(df.collect(), key=lambda r: r[0])


def test_malformed_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n{"id": \n{"id": 2}\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id int").collect()
    bad = tables.jsonl_rejects(spark, str(tmp_path / "a.jsonl"), "id int").collect()
    assert [r["line"] for r in bad] == ['{"id": '] and bad[0]["file"].endswith("a.jsonl")


def test_stale_fields(spark):
    assert tables.stale_fields(spark.range(1), "id long, name string") == ["name"]


def test_pages(spark, tmp_path):
    (tmp_path / "core_extensions").mkdir()
    (tmp_path / "a.md").write_text("# A\nx")
    (tmp_path / "core_extensions" / "b.md").write_text("b")
    (tmp_path / "c.txt").write_text("no")
    got = {r["path"]: r["text"] for r in tables.read_pages(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "# A\nx", "core_extensions/b.md": "b"}


def test_appending_responses_twice(spark, tmp_path):
    new = spark.createDataFrame([("a", "k", "B", False, 1.0), ("a", "k", "B", False, 1.0)], tables.RESPONSES)
    for _ in range(2):
        tables.append_responses(new, f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/r").count() == 1


def test_replay_of_a_stream(spark, tmp_path):
    tables.append_responses(spark.createDataFrame([("a", "k", '{"usage": {"prompt_tokens": 5}}', False, 1.0), ("a", "x", "{}", False, 1.0)], tables.RESPONSES), f"{tmp_path}/r")
    requests = spark.createDataFrame([("a", "k", 7)], "arm string, request_key string, doc_id int")
    df = stream.replay_stream(requests, stream.parsed_stream(stream.response_stream(spark, f"{tmp_path}/r")))
    stream.start(df, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(60)
    assert [(r["doc_id"], r["tokens_in"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(7, 5)]


def test_windowed_counts(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 10, 5)
    spark.createDataFrame([(at, "a", 1.0), (at, "a", 2.0), (at + datetime.timedelta(hours=2), "b", 1.0)], "ts timestamp, kind string, value double").write.parquet(f"{tmp_path}/e")
    events = spark.readStream.schema("ts timestamp, kind string, value double").parquet(f"{tmp_path}/e")
    q = stream.windowed_counts(events, "ts", "kind").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["kind"], r["n"], r["total"]) for r in spark.table("counts").collect()} == {("a", 2, 3.0), ("b", 1, 1.0)}
