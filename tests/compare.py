"""python tests/compare.py [SF] NAME...: a query against its SQL in DuckDB, row by row."""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings parent_chunks child_chunks gold_records hybrid_rows tree_rows structure_files eval_passages".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def rows_of(con, sql: str):
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return repr(int(v)) if isinstance(v, int) and not isinstance(v, bool) else str(v)


def compare(spark, con, name: str, f, sql: str, sf_dir: str) -> str:
    t = time.time()
    df = f(spark, sf_dir)
    mine = df.collect()
    took = time.time() - t
    cols, theirs = rows_of(con, sql)
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(cols)}"
    order = sorted(cols)
    a = sorted(tuple(norm(r[c]) for c in order) for r in mine)
    at = [cols.index(c) for c in order]
    b = sorted(tuple(norm(r[i]) for i in at) for r in theirs)
    if a != b:
        x, y = [r for r in a if r not in set(b)][:2], [r for r in b if r not in set(a)][:2]
        return f"rows {len(a)} against {len(b)}: only here {x}, only there {y}"
    return f"ok {len(a)} rows {took:.1f} s"


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("sf") else "sf0.01"
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, q, s = connect(f"/root/testdata/{sf}"), e.queries(), e.oracle_sql()
    for n in args or sorted(q):
        try:
            if n in s:
                print(n, compare(spark, con, n, q[n], s[n], f"/root/testdata/{sf}"), flush=True)
            else:
                t = time.time()
                print(n, "rows", q[n](spark, f"/root/testdata/{sf}").count(), f"{time.time() - t:.1f} s", flush=True)
        except Exception as x:  # the next one still runs
            print(n, "FAILED", str(x)[:700], flush=True)
