"""Run registered queries beside their SQL twins and compare whole results.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return repr(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([plain(row[i]) for i in order] for row in rows)


def difference(spark, con, sf_dir, name):
    """None when both sides agree, else a short account of the first difference."""
    sql = entry.oracle_sql().get(name)
    frame = entry.queries()[name](spark, sf_dir)
    got = normal(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return None if got[1] else "no rows"
    cursor = con.execute(sql)
    want = normal([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} vs {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} vs {len(want[1])}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if bad:
        cells = [(a, b) for a, b in zip(*bad[0]) if a != b][0]
        return f"{len(bad)} rows differ, e.g. {cells[0][:300]} vs {cells[1][:300]} in {str(bad[0][0])[:200]}"
    return None


def main():
    from corpusmill.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = local_session(8)
    con = connect(sf_dir)
    for name in names:
        started = time.time()
        try:
            problem = difference(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        kind = "sql " if name in entry.oracle_sql() else "rows"
        print(f"{'OK  ' if problem is None else 'FAIL'} {kind} {time.time() - started:6.2f}s {name} {problem or ''}", flush=True)


if __name__ == "__main__":
    main()
