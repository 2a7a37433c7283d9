"""Run a registered query in Spark and its check SQL in DuckDB and compare the rows.

As a script: ``python tests/compare.py SF_DIR [name-part ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from florapark.plans.catalog import CHECKS, QUERIES  # noqa: E402
from florapark.plans.inputs import TABLES  # noqa: E402


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "as_tuple"):  # Decimal
        return round(float(v), 9) + 0.0
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def problem(spark, con, sf_dir, name):
    """None when both engines agree, else a short description."""
    df = QUERIES[name](spark, sf_dir)
    got_cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    problem.rows = len(got)
    if name not in CHECKS:
        return None if got else "no rows"
    cur = con.execute(CHECKS[name])
    want_cols, want = _rows([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}; e.g. {got[:2]} / {want[:2]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[:2]}" if bad else None


problem.rows = -1


if __name__ == "__main__":
    from florapark.session import local_session

    sf_dir, parts = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in QUERIES:
        if parts and not any(name.startswith(p) for p in parts):
            continue
        t0 = time.time()
        problem.rows = -1
        try:
            text = problem(spark, con, sf_dir, name)
        except Exception as e:  # noqa: BLE001
            text = f"{type(e).__name__}: {str(e)[:1200]}"
        failed += text is not None
        print(f"{'ok  ' if text is None else 'FAIL'} {name:34s} {time.time() - t0:6.2f}s {problem.rows:7d} rows {text or ''}", flush=True)
    print("failed:", failed)
    sys.exit(1 if failed else 0)
