from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns of other meaning whose names operators use inside.
EXTRA = ["row", "spans", "base", "component_id", "kept", "key", "bucket", "seg", "label", "words", "order", "salt", "host", "draw", "held_out", "row_key", "linked", "body", "cls", "sig", "items", "coverage"]


@pytest.fixture(scope="session")
def make(spark, tmp_path_factory):
    """Write tables as one folder of Parquet and return its path; documents get extra columns."""

    def build(documents=None, pages=None, benchmark=None):
        folder = tmp_path_factory.mktemp("tables")
        docs = spark.createDataFrame(documents or [], DOCUMENTS)
        for c in EXTRA:
            docs = docs.selectExpr("*", f"'x' AS `{c}`")
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(pages or [], "page_id long, url string, html string").selectExpr("*", "'x' AS node", "'x' AS verdict", "1 AS host").write.parquet(f"{folder}/pages.parquet")
        spark.createDataFrame(benchmark or [], "item_id long, text string").selectExpr("*", "'x' AS items").write.parquet(f"{folder}/benchmark.parquet")
        return str(folder)

    return build


def prose(n: int, seed: int = 0) -> str:
    words = "river stone window garden little market yellow evening quiet corner harbour letter walking promise winter summer bridge".split()
    x = seed * 7919 + 17
    out = []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2147483648
        out.append(words[x // 65536 % len(words)] + str(x // 1024 % 7 or ""))
    return " ".join(out)


LONG = {
    "letters": "a" * 60_000,
    "digits": "7" * 60_000,
    "dots": "1.2." * 15_000,
    "mail": "x@y" + ".z" * 20_000,
    "same word": "go " * 20_000,
    "blanks": " " * 5_000 + "end",
}


@pytest.fixture(scope="session")
def nasty():
    """Null and empty texts, null in every column, ties, repeated rows, long runs."""
    rows = [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, " \t\n\r\x0b\x0c ", None, None, 7),
        (4, "one", "en", "a", 3),
        (5, "one two three four", "en", "a", 18),
        (5, "one two three four", "en", "a", 18),
        (None, "one two three four", None, "b", 18),
        (6, prose(80), "en", "a", 1),
        (7, prose(80), "en", "b", 1),
        (8, prose(79) + " changed", "en", "b", 1),
        (9, "é½😀 　 ﬁ\x00 ▁▁ x", "xx", "c", 12),
        (10, "password: hunter22 AKIA" + "A1" * 10 + " mail a.b@c.de_f@g.hi 1.2.3.4 4111 1111 1111 1111 +1 (415) 555-0100 " + "ab12" * 8, "en", "c", 99),
    ]
    return rows + [(100 + i, t, "en", "long", len(t)) for i, t in enumerate(LONG.values())]
