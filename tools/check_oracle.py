"""Run registered queries on Spark and their SQL on DuckDB and compare all values.

usage: python tools/check_oracle.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from stagelens.catalog import all_queries  # noqa: E402
from stagelens.session import get_session  # noqa: E402


def norm(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return repr(v)
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = get_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    bad = 0
    for name, q in all_queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            t0 = time.time()
            df = q.run(spark, sf)
            got = df.collect()
            t1 = time.time() - t0
            if q.sql is None:
                print(f"rows  {name:32} {len(got):8} {t1:6.2f}s")
                continue
            cur = con.execute(q.sql)
            desc = [(d[0], str(d[1])) for d in cur.description]
            want = cur.fetchall()
            a, b = rows_of(df.columns, got), rows_of([c for c, _ in desc], want)
            ok = sorted(df.columns) == sorted(c for c, _ in desc) and a == b
            bad += not ok
            print(f"{'ok   ' if ok else 'FAIL '} {name:32} {len(got):8} {t1:6.2f}s duck {time.time() - t0 - t1:5.2f}s")
            types = dict(df.dtypes)
            if ok:
                short = {"INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double",
                         "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz"}
                diff = {c: (types[c], t) for c, t in desc if short.get(t, t).lower() != types[c]}
                if diff:
                    print("      types differ:", diff)
            else:
                print("   spark", sorted(types.items()), "\n   duck ", sorted(desc))
                sa, sb = set(a), set(b)
                print("   only spark", len(sa - sb), sorted(sa - sb, key=repr)[:3])
                print("   only duck ", len(sb - sa), sorted(sb - sa, key=repr)[:3])
        except Exception as e:  # report and go on with the next query
            bad += 1
            print(f"ERROR {name}: {type(e).__name__} {str(e)[:1500]}")
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
