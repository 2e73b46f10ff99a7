"""Registered text queries against their SQL on the smallest tables."""

import duckdb
import pytest

from quillspark.plans import oracles, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Operators that no SQL expresses; their logic is tested in test_operators.py.
ROWS_ONLY = {"dedupe_jaccard", "compress", "compress_output", "summarize", "bm25_line_keep", "chunk_semantic", "resolve_chunk", "evidence_budget"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(repr(tuple(float(f"{x:.9g}") if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(oracles.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert plain(map(tuple, got.select(*names).collect())) == plain(want.fetchall())


def test_all_queries_are_accounted_for():
    assert set(queries.QUERIES) == set(oracles.ORACLE_SQL) | ROWS_ONLY


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_rows_only_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
