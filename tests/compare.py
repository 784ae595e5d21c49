"""Strict comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return v


def difference(df, con, sql: str) -> str | None:
    """None when both give the same rows, otherwise what differs."""
    names = sorted(df.columns)
    got = Counter(tuple(_cell(r[c]) for c in names) for r in df.collect())
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    if sorted(cols) != names:
        return f"columns {names} != {sorted(cols)}"
    places = [cols.index(c) for c in names]
    want = Counter(tuple(_cell(r[i]) for i in places) for r in cur.fetchall())
    if got == want:
        return None
    extra, missing = list((got - want).elements()), list((want - got).elements())
    return (
        f"{sum(got.values())} rows, expected {sum(want.values())}; "
        f"{len(extra)} extra e.g. {[str(x)[:300] for x in extra[:2]]}; missing e.g. {[str(x)[:300] for x in missing[:2]]}"
    )


def main() -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from textpair.session import get_session

    sf_dir = sys.argv[1]
    only = sys.argv[2:]
    spark = get_session(
        "compare", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    oracles = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                problem = difference(df, con, oracles[name])
            else:
                problem = None if df.count() else "no rows"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        kind = "sql" if name in oracles else "rows"
        print(f"{name:32s} {kind:5s} {time.time() - start:6.1f}s {'ok' if problem is None else problem}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
