"""Every operator on awkward rows and on empty tables."""

from __future__ import annotations

import pytest

from docscope.llm.queries import QUERIES

DOCUMENT_QUERIES = [q for q in QUERIES if q != "op1_url_filters"]


@pytest.fixture(scope="module")
def awkward(make, nasty):
    return make(documents=nasty, benchmark=[(1, None), (2, ""), (3, "one two three four"), (None, "river stone window garden little market")])


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_awkward_documents(spark, awkward, nasty, name):
    rows = QUERIES[name](spark, awkward).collect()
    assert len(rows) == len(nasty)
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in nasty)
    fives = [r for r in rows if r["doc_id"] == 5]
    assert len(fives) == 2 and fives[0] == fives[1]


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, make, name):
    assert QUERIES[name](spark, make()).collect() == []
