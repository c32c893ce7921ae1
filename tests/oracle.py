"""Run registered queries against their SQL in DuckDB: python tests/oracle.py [sf_dir] [prefix ...]"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, int):
        return repr(float(v)) if abs(v) < 2**53 else str(v)
    if type(v).__name__ == "Decimal":
        return repr(float(v))
    return str(v)


def compare(spark, con, sf: str, name: str, query, sql: str):
    """None when equal, else a short description of the difference."""
    df = query(spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = sorted(tuple(norm(r[i]) for i in at) for r in cur.fetchall())
    if not want:
        return "oracle returned no rows"
    if got == want:
        return None
    extra, missing = [r for r in got if r not in set(want)], [r for r in want if r not in set(got)]
    return f"{cols} rows {len(got)} vs {len(want)}; {len(extra)} differ; spark {extra[:2]} sql {missing[:2]}"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from sigspark.session import local_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con = local_session(8), connect(sf)
    if "SIGSPARK_SLICES" in os.environ:                    # many slices cut every key
        spark.conf.set("spark.sql.shuffle.partitions", os.environ["SIGSPARK_SLICES"])
        spark.conf.set("sigspark.sliceBytes", "1")
    sqls, bad = oracle_sql(), 0
    for name, q in queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            if name in sqls:
                diff = compare(spark, con, sf, name, q, sqls[name])
            else:
                n = q(spark, sf).count()
                diff = None if n else "no rows"
                name += " (rows only)"
        except Exception as ex:  # report and go on with the next query
            diff = f"{type(ex).__name__}: {str(ex)[:600]}"
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {name} {time.time() - start:.1f}s {diff or ''}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
