"""Queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from check import as_set, same_kind
from tidalframe.llm.queries import ORACLE, QUERIES

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize(("name", "folder"), [*((n, SMALL) for n in sorted(ORACLE)), ("op10_url_filter", MORE), ("op12_secret_scan", MORE), ("op13_merkle_manifest", MORE)])
def test_query_equals_its_sql(spark, name, folder):
    db = duckdb.connect()
    for table in ("documents", "pages"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    frame = QUERIES[name](spark, folder)
    want = db.execute(ORACLE[name])
    names, kinds = [c[0] for c in want.description], {c[0]: str(c[1]) for c in want.description}
    assert sorted(frame.columns) == sorted(names)
    assert all(same_kind(f.dataType.simpleString(), kinds[f.name]) for f in frame.schema.fields)
    assert as_set([tuple(r) for r in frame.collect()], frame.columns) == as_set(want.fetchall(), names)
