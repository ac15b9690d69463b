"""Side-by-side comparison of registered queries with their SQL in DuckDB (also used from the command line)."""
import datetime
import decimal
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def kind(v):
    return "num" if isinstance(v, (int, float)) and not isinstance(v, bool) else type(v).__name__


def compare(df, con, sql: str) -> str | None:
    """None when names, kinds and values agree; else what differs."""
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    wanted = [dict(zip(names, r)) for r in res.fetchall()]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(names)
    got = [tuple(plain(r[c]) for c in order) for r in df.select(*[f"`{c}`" for c in order]).collect()]
    want = [tuple(plain(r[c]) for c in order) for r in wanted]
    key = lambda r: tuple((x is None, str(type(x).__name__), str(x)) for x in r)
    got.sort(key=key)
    want.sort(key=key)
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; only spark {[r for r in got if r not in set(want)][:2]}; only sql {[r for r in want if r not in set(got)][:2]}"
    for g, w in zip(got, want):
        if g != w or [kind(x) for x in g] != [kind(x) for x in w]:
            extra = [r for r in got if r not in set(want)][:3]
            missing = [r for r in want if r not in set(got)][:3]
            return f"columns {order}\n   spark {extra or g}\n   sql   {missing or w}"
    float_names = [c for c, t in df.dtypes if t in ("double", "float")]
    for c in float_names:
        bad = [r[c] for r in wanted if r[c] is not None and not isinstance(r[c], float)]
        if bad:
            return f"column {c}: double in Spark, {type(bad[0]).__name__} in SQL"
    int_names = [c for c, t in df.dtypes if t in ("int", "bigint")]
    for c in int_names:
        bad = [r[c] for r in wanted if r[c] is not None and not isinstance(r[c], int)]
        if bad:
            return f"column {c}: integer in Spark, {type(bad[0]).__name__} in SQL"
    if not got:
        return "EMPTY RESULT"
    return None


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession
    sys.path.insert(0, ".")
    from evalspark.bindings import ORACLES, QUERIES
    folder = argv[0]
    wanted = [n for n in QUERIES if not argv[1:] or any(n.startswith(p) for p in argv[1:])]
    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config(
        "spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    for name in wanted:
        t = time.time()
        try:
            df = QUERIES[name](spark, folder)
            verdict = compare(df, con, ORACLES[name]) if name in ORACLES else f"rows only: {df.count()}"
        except Exception as error:  # report and go on
            verdict = "ERROR " + str(error)[:700]
        ok = verdict is None or verdict.startswith("rows only")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - t:.2f}s {verdict or ''}", flush=True)
    print("bad:", bad, "of", len(wanted))
    return bad


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1))
