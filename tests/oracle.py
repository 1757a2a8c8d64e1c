"""Compare a registered query with its SQL: same columns, same rows, order ignored."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canon(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return repr(value)


def canon_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda j: columns[j])
    return sorted(columns), sorted(tuple(canon(r[j]) for j in order) for r in rows)


TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "timestamp": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def compare(spark, con, folder, query, sql):
    df = query(spark, folder)
    left = canon_rows(df.columns, [tuple(r) for r in df.collect()])
    done = con.execute(sql)
    columns = [d[0] for d in done.description]
    types = {d[0]: str(d[1]) for d in done.description}
    right = canon_rows(columns, done.fetchall())
    unlike = {c: (t, types.get(c)) for c, t in df.dtypes if TYPES.get(t) != types.get(c)}
    if unlike:
        return f"types {unlike}"
    if left[0] != right[0]:
        return f"columns {left[0]} vs {right[0]}"
    if left[1] != right[1]:
        a, b = set(left[1]), set(right[1])
        return f"rows {len(left[1])} vs {len(right[1])}: only ours {sorted(a - b)[:3]}, only SQL {sorted(b - a)[:3]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from conftest import session

    import __spark_entry__ as e

    folder = sys.argv[1]
    names = sys.argv[2:] or list(e.queries())
    spark, con = session(), connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            sql = e.oracle_sql().get(name)
            if sql is None:
                problem = f"rows only: {len(e.queries()[name](spark, folder).collect())}"
            else:
                problem = compare(spark, con, folder, e.queries()[name], sql)
                bad += problem is not None
        except Exception as x:  # noqa: BLE001
            problem = f"{type(x).__name__}: {str(x)[:600]}"
            bad += 1
        print(f"{name:32s} {time.time() - start:6.1f}s {problem or 'ok'}", flush=True)
    print("failed", bad)
