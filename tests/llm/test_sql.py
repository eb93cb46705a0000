"""The registered queries against their SQL on the smallest tables."""

import duckdb
import pytest
from conftest import SMALL

from textmill import llm


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    rel = con.execute(llm.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    df = llm.queries()[name](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    want = sorted(tuple(r[names.index(c)] for c in sorted(names)) for r in rel.fetchall())
    assert sorted(tuple(r[c] for c in sorted(names)) for r in df.collect()) == want


def test_every_operator_is_registered():
    found = {int(n[2:].split("_")[0]) for n in llm.queries()}
    assert found == set(range(1, 14)) and set(llm.oracle_sql()) <= set(llm.queries())
