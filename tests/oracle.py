"""Run a registered query and its SQL counterpart, and compare the rows."""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return f"{type(value).__name__}:{value}"


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql: str, sf_dir: str) -> list[str]:
    """Differences between both sides; empty when they agree."""
    df = query(spark, sf_dir)
    got_columns = df.columns
    got = _rows([tuple(r) for r in df.collect()], got_columns)
    cursor = con.execute(sql)
    want_columns = [d[0] for d in cursor.description]
    want = _rows(cursor.fetchall(), want_columns)
    if sorted(got_columns) != sorted(want_columns):
        return [f"columns {sorted(got_columns)} != {sorted(want_columns)}"]
    if got == want:
        return []
    notes = [f"rows {len(got)} vs {len(want)}; columns {sorted(got_columns)}"]
    have, need = set(got), set(want)
    missing = [r for r in want if r not in have][:2]
    extra = [r for r in got if r not in need][:2]
    return notes + [f"only SQL: {r}"[:900] for r in missing] + [f"only Spark: {r}"[:900] for r in extra]


def main(argv: list[str]) -> int:
    sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from shelfwright import build_session

    sf_dir, names = argv[0], argv[1:]
    spark = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.log.level": "ERROR",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    queries, oracle = entry.queries(), entry.oracle_sql()
    con = connect(sf_dir)
    bad = 0
    for name in sorted(queries):
        if names and not any(n in name for n in names):
            continue
        started = time.time()
        try:
            if name in oracle:
                notes = compare(spark, con, queries[name], oracle[name], sf_dir)
                state = "ok" if not notes else "DIFFERS"
            else:
                notes, state = [], f"rows {queries[name](spark, sf_dir).count()}"
        except Exception as error:  # noqa: BLE001 - report and go on
            notes, state = [str(error)[:1500]], "FAILED"
        bad += bool(notes)
        print(f"@@ {name}: {state} {time.time() - started:.1f}s", flush=True)
        for note in notes:
            print("   ", note)
    print(f"@@ {bad} with differences")
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1:])))
