"""Compare a query with its SQL in DuckDB: column names, row count and values, in any order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def connection(sf_dir: str = SF):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def one(v):
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float) or type(v).__name__ == "Decimal":
            v = float(v)
            return "nan" if math.isnan(v) else str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(round(v, 6))
        return str(v)

    return sorted(tuple(one(r[k]) for k in order) for r in rows)


def compare(spark, name, fn, sql, con, sf_dir: str = SF):
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    exp = cur.fetchall()
    assert sorted(columns) == sorted(df.columns), (name, columns, df.columns)
    a, b = canonical(got, df.columns), canonical(exp, columns)
    assert len(a) == len(b), (name, len(a), len(b))
    diff = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not diff, (name, len(diff), diff[:3])
    return len(a)
