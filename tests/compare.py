"""Run catalog queries on Spark and their SQL on DuckDB and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(spark, con, sf_dir: str, name: str, query, sql: str) -> tuple[bool, str]:
    t0 = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    t1 = time.time()
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    want = rows_of(columns, result.fetchall())
    t2 = time.time()
    times = f"spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s rows {len(got)}"
    if sorted(df.columns) != sorted(columns):
        return False, f"{times} columns {sorted(df.columns)} <> {sorted(columns)}"
    if got != want:
        only_got = [r for r in got if r not in set(want)][:3]
        only_want = [r for r in want if r not in set(got)][:3]
        return False, f"{times} want {len(want)}\n   only spark {only_got}\n   only sql {only_want}"
    if not got:
        return False, f"{times} no rows"
    return True, times


def main() -> None:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry

    from tests.conftest import make_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = make_session()
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = []
    for name in queries:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            if name in oracle:
                ok, message = compare(spark, con, sf_dir, name, queries[name], oracle[name])
            else:
                t = time.time()
                n = queries[name](spark, sf_dir).count()
                ok, message = n > 0, f"rows only: {n} in {time.time() - t:.1f}s"
        except Exception as error:  # noqa: BLE001
            ok, message = False, f"{type(error).__name__}: {str(error)[:600]}"
        print(("ok   " if ok else "FAIL ") + name, message, flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
