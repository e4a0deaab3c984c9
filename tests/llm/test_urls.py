"""URL rules and redirect equivalence."""

from __future__ import annotations

import pytest

from docscope.llm.url_filters import op1_url_filters


def canonical(url):
    return f'<html><head><LINK href="{url}" rel=canonical></head></html>'


def refresh(url):
    return f'<meta http-equiv="Refresh" content="0; URL={url}">'


PAGES = [
    (1, "http://a.example.org/es/x", None, "example.org/es/", "block", "rule"),
    (2, "https://EXAMPLE.org/en/12?q#f", "", "example.org/en/1", "block", "rule"),
    (3, "https://example.org/en/2", "", "org/", "allow", "rule"),
    (4, "http://notexample.org/es/", "", "org/", "allow", "rule"),
    (5, "http://shop.com/fr/", "", "com/fr/", "allow", "rule"),
    (6, "http://shop.com/fr", "", None, "allow", "default"),
    (7, "http://host.org", "", None, "allow", "default"),
    (8, None, "x", None, "allow", "default"),
    (9, "no scheme.org/es/", canonical("http://b.com/de/1"), None, "allow", "default"),
    # A blocked page's aliases are blocked, over two links and against their direction.
    (20, "http://mirror.net/1", canonical("http://mirror.net/2#top"), None, "block", "alias"),
    (21, "http://MIRROR.net/2", refresh("//b.com/de/9"), None, "block", "alias"),
    (22, "http://b.com/de/9", "", "com/de/", "block", "rule"),
    (23, "http://mirror.net/1#part", None, None, "block", "alias"),
    # One allowed member frees a class that has a blocked one too, but not the blocked page itself.
    (30, "http://c.net/a/b", canonical("c"), None, "allow", "alias"),
    (31, "http://c.net/a/c", canonical("http://d.com/de/1"), None, "allow", "alias"),
    (32, "http://d.com/de/1", canonical("/fr/1"), "com/de/", "block", "rule"),
    # A target need not be a page; links between pages without verdict decide nothing.
    (40, "http://e.net/x", canonical("http://f.com/de/none"), None, "block", "alias"),
    (41, "http://g.net/x", canonical("http://g.net/y"), None, "allow", "default"),
    (42, "http://g.net/y", canonical("http://g.net/y"), None, "allow", "default"),
]


@pytest.fixture(scope="module")
def judged(spark, make):
    return {r["page_id"]: r for r in op1_url_filters(spark, make(pages=[p[:3] for p in PAGES])).collect()}


@pytest.mark.parametrize("page", PAGES, ids=lambda p: str(p[0]))
def test_verdicts(judged, page):
    got = judged[page[0]]
    assert (got["rule"], got["verdict"], got["via"]) == page[3:]


def test_parts(judged):
    assert (judged[2]["host"], judged[2]["path"]) == ("example.org", "/en/12")
    assert (judged[7]["host"], judged[7]["path"]) == ("host.org", "")
    assert (judged[8]["host"], judged[9]["host"], judged[9]["path"]) == ("", "", "")


def test_long_redirect_chains(spark, make):
    pages = [(i, f"http://chain.net/{i}", refresh(f"/{i + 1}")) for i in range(60)] + [(60, "http://chain.net/60", canonical("http://z.com/de/"))]
    got = op1_url_filters(spark, make(pages=pages)).collect()
    assert {r["verdict"] for r in got} == {"block"}


def test_hub_of_aliases(spark, make):
    pages = [(i, f"http://h{i}.net/", canonical("http://hub.com/de/x")) for i in range(300)]
    assert {r["verdict"] for r in op1_url_filters(spark, make(pages=pages)).collect()} == {"block"}
