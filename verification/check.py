"""Run registered queries beside their oracles: python -m verification.check SF_DIR [name ...]"""

from __future__ import annotations

import math
import sys
import tempfile
import time

import duckdb

from verification import cases

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return repr(value)


def _canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    """(equal, note) of a query and its oracle on the same tables."""
    start = time.time()
    df = cases.QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    note = f"{len(rows)} rows, {took:.1f}s"
    if name not in cases.ORACLES:
        return True, note + ", no oracle"
    start = time.time()
    relation = con.execute(cases.ORACLES[name])
    columns = [d[0] for d in relation.description]
    expected = relation.fetchall()
    note += f", oracle {time.time() - start:.1f}s"
    if sorted(df.columns) != sorted(columns):
        return False, note + f", columns {sorted(df.columns)} / {sorted(columns)}"
    left, right = _canonical(df.columns, rows), _canonical(columns, expected)
    if left != right:
        only_left = [r for r in left if r not in set(right)][:2]
        only_right = [r for r in right if r not in set(left)][:2]
        return False, note + f", {len(left)} / {len(right)} rows, spark {only_left}, oracle {only_right}"
    return True, note


def main() -> None:
    from surveyalign.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="check-")})
    spark.sparkContext.setLogLevel("ERROR")
    cases.load_all()
    con = oracle_connection(sf_dir)
    failed = []
    for name in names or sorted(cases.QUERIES):
        try:
            ok, note = compare(spark, con, sf_dir, name)
        except Exception as error:
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
