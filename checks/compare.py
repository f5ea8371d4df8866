"""Run every query in Spark and its SQL in DuckDB, and compare rows.

    python -m checks.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import collections
import sys
import time

import duckdb

from checks.fixtures import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), collections.Counter(tuple(row[i] for i in order) for row in rows)


def compare(df, con, sql: str):
    """(equal, Spark rows, DuckDB rows, examples of what differs)."""
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    answer = con.execute(sql)
    theirs = _rows([d[0] for d in answer.description], answer.fetchall())
    missing, extra = theirs[1] - ours[1], ours[1] - theirs[1]
    notes = [] if ours[0] == theirs[0] else [("columns", ours[0], theirs[0])]
    notes += [("only DuckDB", *list(missing)[:2])] if missing else []
    notes += [("only Spark", *list(extra)[:2])] if extra else []
    return not notes, sum(ours[1].values()), sum(theirs[1].values()), notes


def main(argv: list[str]) -> int:
    from checks.catalogue import ORACLES, QUERIES
    from rehome.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for name in argv[1:] or QUERIES:
        start = time.time()
        try:
            same, ours, theirs, notes = compare(QUERIES[name](spark, sf_dir), con, ORACLES[name])
        except Exception as error:  # noqa: BLE001
            same, ours, theirs, notes = False, 0, 0, [str(error)[:900]]
        failed += not same
        print(f"{'ok  ' if same else 'FAIL'} {name:28} {ours:8} {theirs:8} {time.time() - start:6.1f}s", flush=True)
        for note in notes:
            print("     ", note)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
