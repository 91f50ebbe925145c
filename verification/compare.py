"""Run registered queries against their SQL and report differences.

python -m verification.compare [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

import duckdb

from verification.relations import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, bool):
        return int(value)
    return value


def rows_of(names, rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def difference(df, connection, sql: str) -> str | None:
    """None if the DataFrame and the SQL give the same rows, else what differs."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    expected = rows_of(names, result.fetchall())
    got = rows_of(df.columns, df.collect())
    if got == expected:
        return None
    only_got = sorted(set(got) - set(expected), key=str)[:3]
    only_expected = sorted(set(expected) - set(got), key=str)[:3]
    return f"{len(got)} rows against {len(expected)}; only here {only_got}; only in SQL {only_expected}"


def main(argv: list[str]) -> int:
    from assentlake.session import local_session
    from verification import ORACLES, QUERIES

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = local_session(8)
    connection = connect(folder)
    bad = 0
    for name in names:
        started = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in ORACLES:
                problem = difference(df, connection, ORACLES[name])
            else:
                problem = None if df.count() else "no rows"
        except Exception as error:  # one broken query must not hide the others
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - started:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
