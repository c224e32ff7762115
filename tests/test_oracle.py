"""Every query with SQL gives DuckDB's rows on the small tables; the others give rows with stable columns."""

import math
import os

import duckdb
import pytest

from folio.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz"}
#: May be empty on the smallest tables.
SPARSE = {"q_watermark", "q_missing_sigs", "q_term_backfill", "q_rotated_top", "q_varying_digits", "q_first_abbrev", "q_first_expansion", "q_ngrams", "q_definitions", "q_recurring", "q_canonical_resolve", "q_footer_check"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    frame = QUERIES[name](spark, SF)
    names = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in frame.collect())
    found = con.execute(SQL[name])
    kinds = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in found.description}
    order = [d[0] for d in found.description]
    want = sorted(tuple(plain(r[order.index(c)]) for c in names) for r in found.fetchall())
    assert dict(frame.dtypes) == kinds
    assert got == want
    assert got or name in SPARSE


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_without_sql(spark, name):
    frame = QUERIES[name](spark, SF)
    assert frame.count() > 0
    assert frame.columns == QUERIES[name](spark, SF).columns


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
