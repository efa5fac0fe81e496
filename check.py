"""Compare registered queries with their checking SQL: python check.py [sf_dir] [name part ...]."""

from __future__ import annotations

import sys
import time

import duckdb

from tidalframe.plans import catalog
from tidalframe.plans.standins import TABLES
from tidalframe.session import build_session


def normal(value):
    if isinstance(value, float):
        return repr(round(value, 6))  # as text, so that -0.0 and 0.0 differ
    if hasattr(value, "isoformat"):
        return value.isoformat()[:19].replace("T00:00:00", "")
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def as_set(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, db, name, folder):
    start = time.time()
    frame = catalog.QUERIES[name](spark, folder)
    rows = [tuple(r) for r in frame.collect()]
    took = time.time() - start
    if name not in catalog.ORACLE:
        return True, f"{len(rows)} rows, no SQL", took
    result = db.execute(catalog.ORACLE[name])
    names = [c[0] for c in result.description]
    expected = result.fetchall()
    if sorted(names) != sorted(frame.columns):
        return False, f"columns {sorted(frame.columns)} vs {sorted(names)}", took
    kinds = {c[0]: str(c[1]) for c in result.description}
    got, want = as_set(rows, frame.columns), as_set(expected, names)
    odd = [f"{f.name}: {f.dataType.simpleString()}/{kinds[f.name]}" for f in frame.schema.fields if not same_kind(f.dataType.simpleString(), kinds[f.name])]
    if got != want:
        diff = [(g, w) for g, w in zip(got, want) if g != w][:3]
        return False, f"{len(got)} vs {len(want)} rows, first {diff}", took
    return not odd, f"{len(rows)} rows equal {odd or ''}", took


SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "array<string>": "VARCHAR[]"}


def same_kind(spark_type: str, duck_type: str) -> bool:
    return SAME.get(spark_type, spark_type) == duck_type


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    catalog.load_all()
    spark = build_session("check")
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    bad = 0
    for name in catalog.QUERIES:
        if parts and not any(name.startswith(p) for p in parts):
            continue
        try:
            ok, note, took = compare(spark, db, name, folder)
        except Exception as e:  # report and go on to the next query
            ok, note, took = False, f"{type(e).__name__}: {str(e)[:600]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {took:.2f}s {note}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
