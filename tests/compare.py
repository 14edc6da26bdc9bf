"""Runs queries beside their SQL twins: ``python tests/compare.py SF_DIR [NAME...]``."""

from __future__ import annotations

import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows: list[tuple]) -> list[str]:
    def cell(x):
        if x is None:
            return "null"
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, float):
            return f"{x:.9g}"
        return str(x)

    return sorted("\x1f".join(map(cell, r)) for r in rows)


def differences(spark, con, query, sql: str, sf_dir: str) -> str:
    """What differs between a query and its twin; empty if nothing."""
    df = query(spark, sf_dir)
    got = df.select(sorted(df.columns)).collect()
    rel = con.sql(sql)
    names = sorted(rel.columns)
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} and {names}"
    want = rel.select(*(f'"{n}"' for n in names)).fetchall()
    a, b = canonical([tuple(r) for r in got]), canonical(want)
    if a != b:
        odd = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"{len(a)} and {len(b)} rows, only here {odd[0]}, only there {odd[1]}"
    return ""


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


if __name__ == "__main__":
    import __spark_entry__ as entry

    from tallyframe.session import local_session

    where, names = sys.argv[1], sys.argv[2:]
    spark = local_session(int(__import__("os").environ.get("CORES", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = connect(where), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or sql:
        began = time.time()
        try:
            said = differences(spark, con, queries[name], sql[name], where)
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(said)
        print(f"{name}: {'ok' if not said else 'DIFFERS ' + said} ({time.time() - began:.1f} s)", flush=True)
    print(f"{bad} of {len(names or sql)} differ")
