"""Compare registered queries with their SQL twins in DuckDB.

    python tests/oracle_check.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canon(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if isinstance(v, (list, tuple)):
        return str([canon(x) for x in v])
    if hasattr(v, "asDict"):
        return str({k: canon(x) for k, x in v.asDict().items()})
    return str(v)


def compare(spark, con, sf, name, fn, sql):
    df = fn(spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_rows = cur.fetchall()
    if sorted(names) != cols:
        return len(got), f"columns {sorted(names)} != {cols}"
    idx = [names.index(c) for c in cols]
    want = sorted(tuple(canon(r[i]) for i in idx) for r in want_rows)
    if got == want:
        return len(got), None
    only_got = sorted(set(got) - set(want))[:3]
    only_want = sorted(set(want) - set(got))[:3]
    return len(got), f"rows {len(got)} vs {len(want)}\n   cols {cols}\n   spark {only_got}\n   duck  {only_want}"


def main():
    from barlytics.session import local_session
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = local_session(8)
    con = connect(sf)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                n, err = compare(spark, con, sf, name, fn, oracles[name])
            else:
                n, err = fn(spark, sf).count(), None
        except Exception as exc:
            n, err = -1, "".join(traceback.format_exception_only(exc))[:1500]
        bad += err is not None
        kind = "sql" if name in oracles else "rows"
        print(f"{'FAIL' if err else 'ok  '} {name:32s} {kind} rows={n} {time.time() - start:.2f}s {err or ''}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
