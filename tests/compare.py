"""Run registered queries against their DuckDB text and compare values regardless of row order."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(repr(r[i]) for i in order) for r in rows))


def compare(spark, con, name: str, sf_dir: str) -> str:
    """Empty when the query matches its oracle, else what differs."""
    from postsift.plans import catalog

    df = catalog.QUERIES[name](spark, sf_dir)
    got = _rows(df.columns, df.collect())
    if name not in catalog.ORACLES:
        return "" if got else "no rows"
    rel = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in rel.description]
    want = _rows(names, rel.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if got != want:
        a, b = set(got), set(want)
        return f"rows {len(got)} vs {len(want)}; only spark {sorted(a - b)[:2]}; only sql {sorted(b - a)[:2]}"
    return "" if got else "no rows"


if __name__ == "__main__":
    from postsift.plans import catalog
    from postsift.session import local_session

    sf = f"/root/testdata/{sys.argv[1]}"
    wanted = sys.argv[2:] or list(catalog.QUERIES)
    session, db = local_session(), connect(sf)
    for query in wanted:
        began = time.time()
        try:
            outcome = compare(session, db, query, sf)
        except Exception as error:  # noqa: BLE001
            outcome = f"{type(error).__name__}: {str(error)[:1200]}"
        print(f"{'ok  ' if not outcome else 'FAIL'} {query:28s} {time.time() - began:6.1f}s "
              f"{'' if query in catalog.ORACLES else '(rows only)'} {outcome[:1500]}", flush=True)
