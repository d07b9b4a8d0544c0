"""Run queries beside their SQL twins: ``python tests/parity.py SF_DIR [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf: str):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return db


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def normal_form(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, db, sf: str, query, sql: str | None) -> str:
    """Empty if equal, else what differs."""
    df = query(spark, sf)
    got = normal_form(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "" if got[1] else "no rows"
    result = db.execute(sql)
    expected = normal_form([d[0] for d in result.description], result.fetchall())
    if got[0] != expected[0]:
        return f"columns {got[0]} != {expected[0]}"
    if got[1] != expected[1]:
        extra = sorted(set(got[1]) - set(expected[1]))[:3]
        lacking = sorted(set(expected[1]) - set(got[1]))[:3]
        return f"{len(got[1])} rows != {len(expected[1])}; only Spark {extra}; only SQL {lacking}"
    return ""


if __name__ == "__main__":
    from plumbline.session import local_session
    from __spark_entry__ import oracle_sql, queries

    folder, *names = sys.argv[1:]
    session = local_session(cpus=8)
    session.sparkContext.setLogLevel("ERROR")
    database, oracles = connect(folder), oracle_sql()
    bad = 0
    for key, function in queries().items():
        if names and key not in names:
            continue
        started = time.time()
        try:
            problem = compare(session, database, folder, function, oracles.get(key))
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += bool(problem)
        print(f"{'BAD ' if problem else 'ok  '}{key:34s}{time.time() - started:6.2f}s"
              f"{'' if key in oracles else '  (rows only)'}  {problem}", flush=True)
    print("bad:", bad)
