"""Compare queries with their SQL: ``python tests/oracle.py SF_DIR [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def type_gaps(df, con, sql: str) -> list[str]:
    sql_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return [
        f"{c}: {t} / {sql_types.get(c)}"
        for c, t in df.dtypes
        if TYPES.get(t, t) != sql_types.get(c)
    ]


def compare(df, con, sql: str):
    """(matches, message)"""
    got = df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    gaps = type_gaps(df, con, sql)
    if gaps:
        return False, f"types differ: {gaps}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return True, f"{len(got)} rows"
    only_a, only_b = list((a - b).items())[:2], list((b - a).items())[:2]
    return False, f"{len(got)} vs {len(want)} rows\n   spark {only_a}\n   sql   {only_b}"


def main(sf_dir: str, wanted: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from conftest import new_session

    import __spark_entry__ as entry

    spark, con = new_session(), duck(sf_dir)
    oracles, bad = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in oracles:
                ok, note = compare(fn(spark, sf_dir), con, oracles[name])
            else:
                ok, note = True, f"{fn(spark, sf_dir).count()} rows, no SQL"
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += [] if ok else [name]
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{len(bad)} failed: {bad}")
    return len(bad)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
