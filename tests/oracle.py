"""Local re-implementation of the correctness gate: run a registered query on Spark
and its oracle SQL on DuckDB over the same parquet files; compare row count, column
names and an order-insensitive hash of the values."""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v) -> str:
    if v is None or v is pd.NaT:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        if v.is_integer() and abs(v) < 2**53:
            return str(int(v))
        return f"{round(v, 6):.6f}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.6f}"
    if isinstance(v, pd.Timestamp):
        if pd.isna(v):
            return "NULL"
        return v.tz_localize(None).isoformat() if v.tzinfo else v.isoformat()
    if isinstance(v, dt.datetime):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, dt.date):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int,)):
        return str(v)
    try:
        if pd.isna(v):
            return "NULL"
    except (TypeError, ValueError):
        pass
    return str(v)


def rows_of(pdf: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    out.sort()
    return cols, out


def digest(rows: list[tuple]) -> str:
    h = hashlib.sha256()
    for r in rows:
        h.update("\x1f".join(r).encode())
        h.update(b"\x1e")
    return h.hexdigest()


def spark_rows(df) -> pd.DataFrame:
    rows = df.collect()
    return pd.DataFrame([r.asDict() for r in rows], columns=df.columns)


def compare(spark, name: str, build, sql: str | None, sf_dir: str) -> dict:
    sp = spark_rows(build(spark, sf_dir))
    res = {"query": name, "spark_rows": len(sp)}
    if sql is None:
        res["mode"] = "rows-only"
        return res
    con = duck(sf_dir)
    od = con.sql(sql).df()
    c1, r1 = rows_of(sp)
    c2, r2 = rows_of(od)
    res.update(
        mode="sql",
        oracle_rows=len(od),
        schema_match=c1 == c2,
        hash_match=(c1 == c2 and digest(r1) == digest(r2)),
    )
    if not res["hash_match"]:
        res["spark_cols"], res["oracle_cols"] = c1, c2
        s1, s2 = set(r1), set(r2)
        res["only_spark"] = sorted(s1 - s2)[:3]
        res["only_oracle"] = sorted(s2 - s1)[:3]
    return res
