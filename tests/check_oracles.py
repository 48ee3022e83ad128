"""Run registered queries against DuckDB: python tests/check_oracles.py [sf] [name-prefix ...]"""

import os
import sys
import time

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import duckdb

TIMES = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return repr(v + 0.0)
    return v if v is None or isinstance(v, (str, bool)) else str(v)


def canonical(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def compare(df, con, sql):
    """None when equal, else a message."""
    t0 = time.time()
    cur = con.execute(sql)
    cur_rows = cur.fetchall()
    TIMES["duck"] = time.time() - t0
    ocols = [d[0] for d in cur.description]
    otypes = [str(d[1]) for d in cur.description]
    orows = canonical(cur_rows, ocols)
    t0 = time.time()
    rows = canonical(df.collect(), df.columns)
    TIMES["spark"] = time.time() - t0
    if sorted(df.columns) != sorted(ocols):
        return f"columns {sorted(df.columns)} != {sorted(ocols)}"
    st = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    pair = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}
    for c, o in zip(ocols, otypes):
        want = pair.get(st[c], st[c])
        if o != want and not o.endswith("[]") and "STRUCT" not in o:
            return f"type of {c}: spark {st[c]} duckdb {o}"
    if rows != orows:
        diff = [(a, b) for a, b in zip(rows, orows) if a != b][:2]
        return f"rows {len(rows)} vs {len(orows)}; first diffs {str(diff)[:700]}"
    return None if rows else "EMPTY (equal)"


def main():
    import logging

    from palaver.session import local_session
    import __spark_entry__ as e

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    spark = local_session(os.environ.get("CPUS", "8"))
    folder = f"/root/testdata/sf{sf}"
    con = connect(folder)
    bad = 0
    for name, fn in e.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, folder)
            sql = e.oracle_sql().get(name)
            msg = compare(df, con, sql) if sql else f"rows-only {df.count()}"
        except Exception as ex:
            msg = f"ERROR {type(ex).__name__}: {str(ex)[:900]}"
        status = "ok" if msg is None else msg
        if msg and not msg.startswith("rows-only"):
            bad += 1
        split = " ".join(f"{k} {x:.1f}" for k, x in TIMES.items())
        TIMES.clear()
        print(f"{name:42s} {time.time() - t0:6.2f}s {status} {split}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
