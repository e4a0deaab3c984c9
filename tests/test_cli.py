"""The command line from pages to report, on a tiny workspace with recorded responses."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from docscope import cli
from docscope.functions import schema
from docscope.operators import grid
from docscope.sources import live, tables

PAGE = """---
title: Memory
---
# Limits

The setting `memory_limit` bounds how much memory is used. It defaults to 80% of the memory.

## Threads

Use `threads` to choose how many workers run at once, for instance on small machines. See threads.
"""
REFERENCE = """### Global

| Name | Description | Type | Default value |
|---|---|---|---|
| `memory_limit` | Most memory | `VARCHAR` | `80%` |
| `threads`, `workers` | How many | `BIGINT` | `8` |
"""


@pytest.fixture(scope="module")
def work(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("work")
    (root / "pages").mkdir()
    (root / "pages" / "a.md").write_text(PAGE)
    (root / "ref.md").write_text(REFERENCE)
    rows = [("memory_limit", "VARCHAR", []), ("threads", "BIGINT", ["workers"])]
    (root / "catalog.jsonl").write_text("".join(json.dumps({"name": n, "description": "", "input_type": t, "scope": "GLOBAL", "aliases": a, "extension": "core", "version": "1"}) + "\n" for n, t, a in rows))
    (root / "arms.jsonl").write_text(json.dumps({"arm": "A", "model_id": "m", "price_in": 1.0, "price_out": 2.0, "wants_seed": False}) + "\n")
    (root / "live.jsonl").write_text(json.dumps({"model_id": "m", "live_in": 1.0, "live_out": 2.0, "has_seed": True}) + "\n")
    return root


def test_end_to_end(spark, work, capsys):
    run = lambda *a: cli.main([str(work), *a], spark)
    assert run("oracle", "build", "--catalog", f"{work}/catalog.jsonl", "--reference", f"{work}/ref.md", "--heading", "### Global=GLOBAL") == 0
    assert run("oracle", "verify") == 0
    assert run("corpus", "build", "--pages", f"{work}/pages", "--quota", "narrative-signal=9") == 2
    assert "pool smaller than quota" in capsys.readouterr().out
    assert run("corpus", "build", "--pages", f"{work}/pages", "--quota", "narrative-signal=2", "--least", "20") == 0
    assert run("corpus", "verify") == 0 and run("corpus", "stats") == 0
    assert run("arms", "verify", "--arms", f"{work}/arms.jsonl", "--live", f"{work}/live.jsonl") == 0
    assert run("arms", "cost") == 0
    spark.createDataFrame([("v1", "List the settings.")], "prompt string, text string").write.parquet(f"{work}/prompts.parquet")
    requests = cli._requests(cli.Workspace(spark, str(work)))
    spark.createDataFrame([], tables.RESPONSES).write.parquet(f"{work}/responses.parquet")
    assert run("extract", "run") == 2 and run("extract", "cache") == 1

    def body(content):
        return json.dumps({"choices": [{"finish_reason": "stop", "message": {"content": content}}], "usage": {"prompt_tokens": 10, "completion_tokens": 5, "cost": 0.5}, "_latency_s": 1.0})

    record = {"name": "memory_limit", "input_type": "VARCHAR", "scope": "GLOBAL", "evidence": "bounds how much memory is used", "default_kind": "literal", "default_value": "80%", "default_evidence": "defaults to 80% of the memory"}
    rows = []
    for r in requests.collect():
        if "memory_limit" in r["text"]:
            bad = json.dumps({"settings": [record | {"name": "`memory_limit`"}]})
            rows.append(("A", r["request_key"], body(bad), False, 1.0))
            second = spark.range(1).select(F.sha2(F.concat_ws(":", F.lit(r["request_key"]), F.lit(bad)), 256)).first()[0]
            rows.append(("A", second, body(json.dumps({"settings": [record]})), False, 1.0))
        else:
            rows.append(("A", r["request_key"], body('{"settings": []}'), False, 1.0))
    tables.append_responses(spark.createDataFrame(rows, tables.RESPONSES), f"{work}/responses.parquet")
    assert run("extract", "cache") == 0 and run("extract", "run") == 0
    assert run("labels", "init") == 0 and run("labels", "init") == 0 and run("labels", "verify") == 0
    assert run("score", "run") == 0 and run("report") == 0
    row = spark.read.parquet(f"{work}/summary.parquet").first()
    assert (row["n_documents"], row["n_records"], row["n_type_correct"], row["n_default_value_correct"], row["recall"]) == (2, 1, 1, 1, 0.5)
    got = {r["outcome"]: (r["tokens_in"], r["cost"]) for r in spark.read.parquet(f"{work}/extractions.parquet").collect()}
    assert got == {"valid_after_repair": (20, 1.0), "valid_first_pass": (10, 0.5)}


def test_reference_rows_and_draws(spark, work, tmp_path):
    """Rows of a reference page are documents whatever their length; a labelled draw is proportional, with pins."""
    run = lambda *a: cli.main([str(tmp_path), *a], spark)
    ref = ("--reference", f"{work}/ref.md", "--heading", "### Global=GLOBAL")
    assert run("oracle", "build", "--catalog", f"{work}/catalog.jsonl", *ref) == 0
    assert run("corpus", "build", "--pages", f"{work}/pages", *ref, "--quota", "narrative-signal=2", "--quota", "reference=2", "--least", "20", "--most", "160") == 0
    docs = {(r["bucket"], r["start_line"]): r for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    assert {k for k in docs if k[0] == "reference"} == {("reference", 5), ("reference", 6)}
    lines = REFERENCE.split("\n")
    assert docs["reference", 6]["text"] == "\n".join([*lines[:4], lines[5]])
    assert run("labels", "init", "--total", "1") == 0
    one = [r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/labels.parquet").collect()]
    other = ({r["doc_id"] for k, r in docs.items() if k[0] != "reference"} - set(one)).pop()
    assert len(one) == 1 and run("labels", "init", "--total", "1", "--pin", other) == 0
    assert {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/labels.parquet").collect()} == {one[0], other}
    assert run("arms", "verify", "--arms", f"{work}/arms.jsonl", "--live", f"{work}/live.jsonl") == 0
    spark.createDataFrame([("v1", "List.")], "prompt string, text string").write.parquet(f"{tmp_path}/prompts.parquet")
    got = cli._requests(cli.Workspace(spark, str(tmp_path)), 2).select("doc_id").distinct().collect()
    assert sorted(r["doc_id"].rsplit("-", 1)[0] for r in got) == ["narrative-signal", "reference"]


def test_unusable_input(spark, tmp_path):
    assert cli.main([str(tmp_path), "score", "run"], spark) == 2
    assert cli.main([str(tmp_path), "score", "nothing"], spark) == 2


def test_request_schema_is_strict_and_whole():
    """Every object, at any depth, asks for all of its fields and allows no others; nothing refers to a definition."""
    whole = schema.record_schema()
    todo, objects = [whole], []
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            assert not {"$ref", "$defs"} & set(x)
            objects += [x] if x.get("type") == "object" else []
            todo += list(x.values())
        elif isinstance(x, list):
            todo += x
    assert len(objects) == 2
    assert all(o["required"] == sorted(o["properties"]) and o["additionalProperties"] is False for o in objects)
    record = whole["properties"]["settings"]["items"]["properties"]
    assert set(record) == set(grid.FIELDS) and record["default_value"] == {"anyOf": [{"type": "string"}, {"type": "null"}]}
    assert record["scope"] == {"enum": list(grid.SCOPES)}

def test_live_calls_are_bounded_and_recorded(spark):
    slept, answers = [], iter([(None, "down", 500), ("{}", None, 200)])
    assert live.call(lambda p: next(answers), "x", slept.append, random.Random(1))[:2] == ("{}", False)
    assert len(slept) == 1 and 3.75 <= slept[0] <= 6.25
    body, failed, _ = live.call(lambda p: (None, "gone", 404), "x", slept.append)
    assert failed and json.loads(body)["attempts"] == 1 and len(slept) == 1
    body, failed, _ = live.call(lambda p: (None, "down", 500), "x", lambda s: None)
    assert failed and json.loads(body)["attempts"] == len(live.PAUSES) + 1
    got = live.call_missing(spark.createDataFrame([("a", "k", "p")], "arm string, request_key string, payload string"), lambda p: (p.upper(), None, 200)).collect()
    assert [(r["body"], r["is_failure"]) for r in got] == [("P", False)]
