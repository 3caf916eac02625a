"""Run registered queries beside their SQL twins and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda at: columns[at])
    return sorted((tuple(plain(record[at]) for at in order) for record in records), key=repr)


def duck(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def compare(spark, connection, sf, function, sql):
    """None when the rows agree, else a short account of the difference."""
    frame = function(spark, sf)
    ours = rows_of(frame.columns, frame.collect())
    cursor = connection.execute(sql)
    names = [column[0] for column in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} / {sorted(names)}"
    if ours == theirs:
        return None
    left, right = set(map(repr, ours)), set(map(repr, theirs))
    return (f"{len(ours)}/{len(theirs)} rows; only ours {sorted(left - right)[:2]}; "
            f"only oracle {sorted(right - left)[:2]}")


def main():
    from rolescope.plans import ORACLES, QUERIES
    from rolescope.session import local_session
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    connection = duck(sf)
    wanted = sys.argv[1:] or list(QUERIES)
    for name in wanted:
        start = time.time()
        try:
            if name in ORACLES:
                result = compare(spark, connection, sf, QUERIES[name], ORACLES[name]) or "ok"
            else:
                result = f"rows only: {len(QUERIES[name](spark, sf).collect())}"
        except Exception as error:  # noqa: BLE001
            result = f"ERROR {type(error).__name__}: {str(error)[:700]}"
        print(f"{name:24s} {time.time() - start:6.1f}s {result}", flush=True)


if __name__ == "__main__":
    main()
