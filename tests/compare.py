"""Run registered queries on Spark and their SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def canonical(pdf: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    names = sorted(pdf.columns)

    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return bool(v)
        if isinstance(v, pd.Timestamp) or type(v).__name__ in ("date", "datetime"):
            return str(pd.Timestamp(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return float(v) + 0.0
        return str(v)
    rows = [tuple(cell(v) for v in r) for r in pdf[names].itertuples(index=False, name=None)]
    return names, sorted(rows, key=repr)


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> str:
    a_names, a = canonical(spark_pdf)
    b_names, b = canonical(duck_pdf)
    if a_names != b_names:
        return f"columns differ: {a_names} / {b_names}"
    if len(a) != len(b):
        return f"rows differ: {len(a)} / {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g. {a_names}: {bad[0][0]} / {bad[0][1]}"
    kinds = [(c, str(spark_pdf[c].dtype), str(duck_pdf[c].dtype)) for c in a_names
             if len(a) and spark_pdf[c].dtype.kind != duck_pdf[c].dtype.kind]
    return f"ok (types differ: {kinds})" if kinds else "ok"


def main() -> None:
    from clientele.plans.registry import all_queries
    from clientele.session import build_session

    sf_dir = sys.argv[1]
    names = [n for n in sys.argv[2:] if not n.startswith("-")]
    skip = [n[1:] for n in sys.argv[2:] if n.startswith("-")]
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries = all_queries()
    failed = []
    for name, q in queries.items():
        if names and not any(n == name or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        if name in skip:
            continue
        start = time.time()
        try:
            got = q.run(spark, sf_dir).toPandas()
            took = time.time() - start
            verdict = f"rows {len(got)}" if q.oracle is None else compare(got, con.execute(q.oracle).df())
        except Exception as e:  # report and go on with the others
            took, verdict = time.time() - start, f"ERROR {type(e).__name__}: {str(e)[:700]}"
        if not (verdict.startswith("ok") or verdict.startswith("rows ") and q.oracle is None):
            failed.append(name)
        print(f"{name:24s} {took:6.2f}s {verdict}", flush=True)
    print(f"failed: {failed}")


if __name__ == "__main__":
    main()
