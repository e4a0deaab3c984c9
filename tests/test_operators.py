"""Single operators on inline rows."""

from __future__ import annotations

import ast
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docscope import fixtures
from docscope.functions import numbers, text
from docscope.operators import catalog, corpus, grid, labels, reports, scoring

REPO = Path(__file__).resolve().parents[1]
DOC = "Memory\nThe limit is set by\n`memory_limit` and defaults to 80%\nof RAM, see below."


def one(spark, column, **values):
    kind = {str: "string", int: "int", float: "double", bool: "boolean"}
    schema = ", ".join(f"{k} {kind[type(v)] if v is not None else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()[0]


def test_html_density_separates_dumps_from_prose(spark):
    dump = "<div><table>" + "<tr><td>x</td></tr>" * 20 + "</table></div>"
    prose = "word " * 200 + "<em>x</em><a href='y'>z</a>"
    assert not one(spark, text.is_prose(F.col("h")), h=dump)
    assert one(spark, text.is_prose(F.col("h")), h=prose)
    assert one(spark, text.html_density(F.col("h")), h="") == 0


@pytest.mark.parametrize("page,title,body", [("---\ntitle: 'A b'\n---\nrest", "A b", "rest"), ("---\r\ntitle: x\r\n---\r\nr", "x", "r"), ("no front", "", "no front"), ("a\n---\ntitle: x\n---\n", "", "a\n---\ntitle: x\n---\n")])
def test_front_matter(spark, page, title, body):
    assert one(spark, text.title_of(F.col("p")), p=page) == title
    assert one(spark, text.body_of(F.col("p")), p=page) == body


def test_sections_keep_order_and_drop_blank_ones(spark):
    pages = spark.createDataFrame([("x/a.md", "# A\n\n#### Deep\ntext\n## Empty\n\n## B\nb")], "path string, text string")
    got = [(r["heading"], r["heading_path"]) for r in corpus.sections(pages).orderBy("start_line").collect()]
    assert got == [("Deep", " > A > Deep"), ("B", " > A > B")]


def test_mentions_are_whole_words_and_case_sensitive(spark):
    docs = spark.createDataFrame([(1, "limit limits Limit limit_x (limit) max-limit old_limit")], "doc_id int, text string")
    names = spark.createDataFrame([("limit", "limit"), ("old_limit", "limit"), ("limit_x", "limit_x")], "label string, canonical string")
    got = {r["name"]: r["n"] for r in corpus.mentions(docs, names).collect()}
    assert got == {"limit": 4, "limit_x": 1}


def test_backticks(spark):
    assert one(spark, corpus.backticked(F.col("t"), F.lit("limit")), t="a `limit` b")
    assert not one(spark, corpus.backticked(F.col("t"), F.lit("limit")), t="a limit b")


def test_large_sides_are_not_broadcast(spark):
    df = spark.range(50)
    assert "BroadcastExchange" not in spark.range(10).join(corpus.small(df, 10).hint("merge"), "id")._jdf.queryExecution().toString()
    assert corpus.small(df, 10) is df and corpus.small(df, 50) is not df


def test_sample_is_seeded_and_takes_pages_first(spark):
    docs = spark.createDataFrame([(i, "b", f"p{i % 5}") for i in range(100)], "id int, bucket string, page string")
    draw = lambda seed, n: {r["id"] for r in corpus.sample(docs, "bucket", "page", "id", {"b": n}, seed).collect()}
    assert draw(1, 20) == draw(1, 20) != draw(2, 20)
    assert len({i % 5 for i in draw(1, 5)}) == 5 and len(draw(1, 20)) == 20
    assert corpus.check_quotas(docs, "bucket", {"b": 101, "c": 1}).count() == 2


def test_allocation_sums_to_the_total(spark):
    counts = spark.createDataFrame([("a", 10), ("b", 10), ("c", 11)], "key string, n long")
    got = {r["key"]: r["share"] for r in corpus.allocate(counts, "key", "n", 10).collect()}
    assert sum(got.values()) == 10 and got == {"a": 3, "b": 3, "c": 4}


def test_pilot_takes_buckets_in_turn(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "c")], "id int, bucket string")
    assert [r["id"] for r in corpus.pilot(docs, "bucket", "id", 4).collect()] == [1, 4, 5, 2]


def test_alias_wins_even_if_the_twin_sorts_first(spark):
    index = {r["label"]: r["canonical"] for r in catalog.labels(fixtures.catalog(spark)).collect()}
    assert index["el"] == "los" and index["con"] == "que" and index["the"] == "the"


def test_first_listing_owns_a_name(spark):
    rows = spark.createDataFrame([("a", "core", 0), ("a", "ext", 1), ("b", "ext", 1)], "name string, extension string, probe int")
    assert {r["name"]: r["extension"] for r in catalog.first_attribution(rows).collect()} == {"a": "core", "b": "ext"}


def test_duplicate_names_of_a_table_are_found(spark):
    rows = spark.createDataFrame([(1, "| `a` | x | T | |"), (2, "| `a` | y | T | NULL |")], "ln int, line string")
    parsed = catalog.parse_rows(rows)
    assert parsed.groupBy("name").count().filter("count > 1").count() == 1
    assert [(r["default_value"], r["default_is_empty_cell"]) for r in parsed.orderBy("ln").collect()] == [(None, True), (None, False)]


RECORD = {"name": "memory_limit", "input_type": "VARCHAR", "scope": "GLOBAL", "evidence": "`memory_limit` and defaults to 80% of RAM", "default_kind": "literal", "default_value": "80%", "default_evidence": "defaults to 80%"}


def errors(spark, *records, document=DOC, **top):
    content = json.dumps({"settings": list(records)} | top)
    df = spark.createDataFrame([(content, document)], "content string, document string")
    return grid.validate(df).first()["errors"]


@pytest.mark.parametrize(
    "change,error",
    [
        ({}, None),
        ({"name": "`memory_limit`"}, "name"),
        ({"name": "not_in_any_catalog"}, None),
        ({"extra": "x"}, "extra_field"),
        ({"default_value": ...}, "missing_field"),
        ({"input_type": "TEXT"}, "input_type"),
        ({"scope": "SESSION"}, "scope"),
        ({"default_kind": "maybe"}, "default_kind"),
        ({"evidence": "memory"}, "evidence_short"),
        ({"evidence": "something that is not said there"}, "evidence_not_verbatim"),
        ({"default_kind": "absent"}, "default"),
        ({"default_kind": "absent", "default_value": None, "default_evidence": None}, None),
        ({"default_value": " "}, "default"),
        ({"default_evidence": "defaults to 90%"}, "default"),
        ({"default_kind": "machine_dependent"}, None),
    ],
)
def test_record_checks(spark, change, error):
    record = {k: v for k, v in (RECORD | change).items() if v is not ...}
    got = errors(spark, record)
    assert (got == []) if error is None else (error in got)


def test_shape_checks(spark):
    assert errors(spark, RECORD, RECORD) == ["duplicate_name"]
    assert errors(spark, RECORD, more=1) == ["shape"]
    assert errors(spark) == []
    df = spark.createDataFrame([("{", DOC), (None, DOC), ("[]", DOC)], "content string, document string")
    assert [r["errors"][0] for r in grid.validate(df).collect()] == ["not_json", "not_json", "shape"]
    assert errors(spark, RECORD | {"evidence": "said nowhere, but nothing to check"}, document=None) == []


def test_body_projection(spark):
    bodies = [
        '{"choices": [{"finish_reason": "stop", "message": {"content": "c"}}], "usage": {"prompt_tokens": 3, "completion_tokens": 4, "cost": 0.5, "completion_tokens_details": {"reasoning_tokens": 2}}, "_latency_s": 1.5}',
        '{"error": {"message": "gone", "code": 404}}',
        '{"error": {"message": "down", "code": 500}}',
        "not json",
    ]
    df = spark.createDataFrame([(b,) for b in bodies], "body string").select(*(c.alias(n) for n, c in grid.parse_body(F.col("body")).items()))
    ok, gone, down, broken = df.collect()
    assert (ok["tokens_in"], ok["tokens_out"], ok["reasoning_tokens"], ok["cost"], ok["content"]) == (3, 4, 2, 0.5, "c")
    assert (gone["error"], gone["unavailable"], down["unavailable"]) == ("gone", True, False)
    assert broken["tokens_in"] == 0 and broken["error"] is None


def test_request_key_depends_on_every_part_but_not_on_order(spark):
    key = lambda **k: one(spark, grid.request_key(**{n: F.lit(v) for n, v in k.items()}), z=1)
    assert key(model="m", payload="p") == key(payload="p", model="m") != key(model="m", payload="q")


def test_backfill_twice_adds_nothing(spark):
    results = spark.createDataFrame([("a", "k", "down", 1.0), ("a", "j", None, 1.0)], "arm string, request_key string, error string, latency_s double")
    held = spark.createDataFrame([], "arm string, request_key string, body string, is_failure boolean, latency_s double")
    first = grid.backfill(results, held)
    assert first.count() == 1 and json.loads(first.first()["body"])["_failure"] is True
    assert grid.backfill(results, held.unionByName(first)).count() == 0


def test_a_body_beats_a_failure_record(spark):
    requests = spark.createDataFrame([("a", "k"), ("a", "j"), ("a", "i")], "arm string, request_key string")
    responses = spark.createDataFrame([("a", "k", "B", False), ("a", "k", "F", True), ("a", "j", "F", True)], "arm string, request_key string, body string, is_failure boolean")
    got = {r["request_key"]: (r["replay"], r["body"]) for r in grid.replay(requests, responses).collect()}
    assert got == {"k": ("hit", "B"), "j": ("failure", "F"), "i": ("miss", None)}


def test_default_states(spark):
    """(documented value, empty cell, said kind, said value) -> kind right, value right."""
    cases = [
        ("8", False, "literal", "`8`", True, True), ("8", False, "literal", "9", True, False), ("8", False, "absent", None, False, False),
        (None, True, "absent", None, True, None), (None, True, "literal", "x", False, None),
        (None, False, "literal", "NULL", True, None), (None, False, "absent", None, True, None), (None, False, "machine_dependent", None, False, None),
    ]
    for d_value, d_empty, kind, value, k_ok, v_ok in cases:
        df = spark.createDataFrame([(kind, value, d_value, d_empty, "T")], "kind string, value string, d_value string, d_empty boolean, c_type string")
        a, b = scoring.score_default({c: F.col(c) for c in df.columns}, F.lit(False))
        assert tuple(df.select(a, b).first()) == (k_ok, v_ok)
    df = spark.createDataFrame([("machine_dependent", None, "8", False, "T")], "kind string, value string, d_value string, d_empty boolean, c_type string")
    assert tuple(df.select(*scoring.score_default({c: F.col(c) for c in df.columns}, F.lit(True))).first()) == (True, None)


def test_rates_of_empty_cells_are_zero(spark):
    docs = spark.createDataFrame([(0, "no_answer", ["x"], [], None)], "a int, status string, expected array<string>, returned array<string>, empty_was_correct boolean")
    recs = spark.createDataFrame([], "a int, hallucinated boolean, documented_not_in_binary boolean, grounded boolean, input_type_correct boolean, scope_correct boolean, default_kind_correct boolean, default_value_correct boolean")
    row = scoring.summary(docs, recs, ["a"]).first()
    assert row["availability"] == 0 and row["recall"] == 0 and row["recall_answered"] == 0 and row["n_expected"] == 1 and row["type_accuracy"] == 0


def test_upper_median(spark):
    df = spark.createDataFrame([(x,) for x in (5, 1, 4, 2)], "v int")
    assert df.agg(numbers.upper_median(F.col("v"))).first()[0] == 4


def test_label_merge_keeps_finished_judgements(spark):
    schema = "doc_id int, candidates array<string>, documents array<string>"
    prior = spark.createDataFrame([(1, ["a"], []), (2, ["a"], None)], schema)
    fresh = spark.createDataFrame([(1, ["a", "b"], None), (2, ["b"], None), (3, ["c"], None)], schema)
    got = {r["doc_id"]: (r["candidates"], r["documents"]) for r in labels.merge(fresh, prior).collect()}
    assert got == {1: (["a"], []), 2: (["b"], None), 3: (["c"], None)}


def test_label_problems_are_all_reported(spark):
    rows = [(1, ["a"], ["a"], [], []), (1, [], [], [], []), (2, [], ["a"], ["a"], []), (3, [], ["nope"], [], ["a"])]
    df = spark.createDataFrame(rows, "doc_id int, candidates array<string>, documents array<string>, cross_referenced array<string>, absent array<string>")
    known = spark.createDataFrame([("a",)], "key string")
    assert {r["rule"] for r in labels.problems(df, known).collect()} == {"labelled twice", "documented and cross-referenced", "unknown name", "known name in the absent list"}


def test_price_drift(spark):
    f = lambda a, b: one(spark, numbers.price_drifted(F.col("a"), F.col("b")), a=a, b=b)
    assert [f(1.0, 1.0005), f(1.0, 1.01), f(0.0, 0.0), f(0.0, 0.1)] == [False, True, False, True]


def test_error_groups_unwrap_whole_envelopes_only(spark):
    got = {r["error"]: r["n"] for r in reports.error_groups(fixtures.frame(spark, fixtures.ERRORS, "id, message"), "message").collect()}
    assert got["upstream"] == 2 and len(got) == 3


def test_extraction_does_not_know_the_truth():
    """The grid may import neither catalogs nor scores, nor may fixtures or plans reach it."""
    tree = ast.parse((REPO / "docscope/operators/grid.py").read_text())
    names = [n.module or "" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)] + [a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names]
    assert not [n for n in names if any(x in n for x in ("catalog", "scoring", "labels", "fixtures", "plans"))]


def test_nothing_outside_imports_the_corpus_operators():
    for path in (REPO / "docscope").rglob("*.py"):
        if "llm" not in path.parts:
            assert "docscope.llm" not in path.read_text(), path
