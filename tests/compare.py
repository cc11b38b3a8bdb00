"""Run a registered query on Spark and its check SQL on DuckDB and compare the rows.

    python -m tests.compare [name-prefix …] [--sf 0.01]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from kinweave.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
DATA = "/root/testdata/sf{}"


def cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if hasattr(v, "normalize"):  # Decimal
        return round(float(v), 9)
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = [tuple(cell(r[c]) for c in cols) for r in df.collect()]
    return cols, [types[c] for c in cols], rows


def duck_rows(sql: str, sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA.format(sf)}/{t}.parquet')")
    rel = con.sql(sql)
    pos = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    types = [str(rel.types[i]) for i in pos]
    return [rel.columns[i] for i in pos], types, [tuple(cell(r[i]) for i in pos) for r in rel.fetchall()]


SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
}


def differences(df, sql: str, sf: str) -> str | None:
    """None when rows, columns and types agree, else what differs."""
    sc, st, sr = spark_rows(df)
    dc, dt, dr = duck_rows(sql, sf)
    if sc != dc:
        return f"columns {sc} vs {dc}"
    kinds = [(c, a, b) for c, a, b in zip(sc, st, dt) if SAME_TYPE.get(a, a) != b and not a.startswith("array")]
    if kinds:
        return f"types {kinds}"
    if len(sr) != len(dr):
        return f"rows {len(sr)} vs {len(dr)}; spark {sorted(map(repr, set(sr) - set(dr)))[:3]} duck {sorted(map(repr, set(dr) - set(sr)))[:3]}"
    a, b = sorted(map(repr, sr)), sorted(map(repr, dr))
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} of {len(a)} rows, first {bad[0]}"
    return None


def main() -> None:
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = "0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i:i + 2]
    spark = build_session("compare", "8")
    spark.sparkContext.setLogLevel("ERROR")
    oracle, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t = time.time()
        try:
            if name in oracle:
                df = fn(spark, DATA.format(sf))
                n = None
                msg = differences(df, oracle[name], sf)
            else:
                n = fn(spark, DATA.format(sf)).count()
                msg = None
        except Exception as e:  # report and go on with the next query
            msg = f"{type(e).__name__}: {str(e)[:300]}"
        bad += msg is not None
        print(f"{'ok ' if msg is None else 'BAD'} {name} {time.time() - t:.2f}s {msg or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
