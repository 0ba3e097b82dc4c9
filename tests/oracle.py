"""Compare registered queries with their SQL, row for row and type for type.

Usage: python tests/oracle.py [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, types as T

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

#: The folder of tables that tests use.
SMALL = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {
    T.LongType(): "BIGINT",
    T.IntegerType(): "INTEGER",
    T.DoubleType(): "DOUBLE",
    T.StringType(): "VARCHAR",
    T.BooleanType(): "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return value


def normalized(columns, rows, ordered=False):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return plain if ordered else sorted(plain, key=lambda r: repr(r))


def is_ordered(sql: str) -> bool:
    """Whether the whole result has an order: an ``order by`` outside all parentheses."""
    after = sql.lower().rpartition("order by")[2] if "order by" in sql.lower() else ")"
    depth = 0
    for char in after:
        depth += (char == "(") - (char == ")")
        if depth < 0:
            return False
    return True


def compare(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Differences between a Spark result and the SQL result."""
    relation = con.execute(sql)
    theirs_columns = [d[0] for d in relation.description]
    theirs_types = {d[0]: str(d[1]) for d in relation.description}
    ordered = is_ordered(sql)
    theirs = normalized(theirs_columns, relation.fetchall(), ordered)
    ours = normalized(df.columns, [tuple(r) for r in df.collect()], ordered)
    problems = []
    if sorted(df.columns) != sorted(theirs_columns):
        return [f"columns {sorted(df.columns)} != {sorted(theirs_columns)}"]
    for field in df.schema.fields:
        expected = TYPES.get(field.dataType)
        actual = theirs_types[field.name]
        if expected != actual:
            problems.append(f"type of {field.name}: {field.dataType.simpleString()} vs {actual}")
    if len(ours) != len(theirs):
        problems.append(f"rows {len(ours)} != {len(theirs)}")
    different = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if different:
        problems.append(f"{len(different)} rows differ, first: {different[0]}")
    return problems


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from rowforge.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or sorted(entry.queries())
    spark = build_session(
        "oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = connect(sf_dir), entry.oracle_sql(), 0
    for name in names:
        started = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            if name in oracles:
                problems = compare(df, con, oracles[name])
                state = "ok" if not problems else "; ".join(problems)
            else:
                problems, state = [], f"rows only: {df.count()}"
        except Exception as error:  # a broken query must not hide the others
            problems = state = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problems)
        print(f"{name:28s} {time.time() - started:6.2f}s {state}", flush=True)
    print(f"{len(names) - failed} of {len(names)} good")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
