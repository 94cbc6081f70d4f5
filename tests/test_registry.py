"""Every query with SQL gives the rows that DuckDB gives for it."""

import duckdb
import pytest

from cairn import registry
from cairn.session import TABLES

BIG = {"grounding", "evictable"}


def rows(records):
    def plain(x):
        if isinstance(x, list):
            return tuple(x)
        return round(x, 9) if isinstance(x, float) else x

    return sorted((tuple(map(plain, r)) for r in records), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows(got.select(*columns).collect()) == rows([[r[i] for i in order] for r in want.fetchall()])


def test_content_chunks_tile_the_text(spark, sf):
    chunks = registry.QUERIES["content_chunks"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas()
    sizes = {i: len(x.encode()) for i, x in zip(docs.doc_id, docs.text)}
    for doc, g in chunks.sort_values("seq").groupby("doc_id"):
        assert g.offset.tolist() == [0, *g.len.cumsum().tolist()[:-1]]
        assert g.len.sum() == sizes[doc]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
