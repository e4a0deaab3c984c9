"""The SQL of corpus queries against their Spark form, on the driver's tables and on rows made for each operator."""

from __future__ import annotations

import duckdb
import pytest

from docscope.llm.queries import ORACLE, QUERIES
from tests.llm.test_dedup import near_rows, repeat_rows
from tests.llm.test_scans import TRICKY
from tests.llm.test_urls import PAGES

SF = "/root/testdata/sf0.001"
WEAK = "Ab3dEf6hIj9kLm2nOp5q"
LINKED = [f"client_id=alpha12 and {WEAK}", f"client_id=alpha12 {'word ' * 60}{WEAK}", f"https://host.example/x client_id=alpha12 {WEAK}==", f"{WEAK} https://h.example/{WEAK}", "username: 'bob.the' token=abcdef1 redis://x:y@z", "é" * 30 + f"access_key_id = AAAA {'x' * 183}{WEAK}"]


@pytest.fixture(scope="module")
def made(make):
    texts = TRICKY + LINKED + [r[1] for r in near_rows() + repeat_rows()]
    return make(documents=[(i, t, "en", f"s{i % 4}" if i % 9 else None, 0) for i, t in enumerate(texts)], pages=[p[:3] for p in PAGES])


@pytest.mark.parametrize("where", ["driver", "made"])
@pytest.mark.parametrize("name", list(ORACLE))
def test_sql(spark, made, name, where):
    folder = SF if where == "driver" else made
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'' if where == 'driver' else '/*.parquet'}'")
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    result = con.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(str(row[names.index(c)]) for c in columns) for row in result.fetchall())
