"""Run registered queries in Spark and their SQL in DuckDB over the same tables and compare the rows."""

from __future__ import annotations

import sys
import time

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame:
        if frame[c].map(lambda v: v is None or v is pd.NA or isinstance(v, (bool, np.bool_))).all():
            frame[c] = frame[c].map(lambda v: None if v is None or v is pd.NA else str(bool(v)))
        elif pd.api.types.is_numeric_dtype(frame[c]):
            frame[c] = frame[c].astype(float)
        else:
            frame[c] = frame[c].map(lambda v: list(v) if isinstance(v, (list, tuple, np.ndarray)) else v)
            frame[c] = frame[c].map(lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else str(v))
    exact = [c for c in frame if frame[c].dtype != float]
    rest = [c for c in frame if c not in exact]
    return frame.sort_values(exact + rest, na_position="last").reset_index(drop=True)


def compare(spark_frame: pd.DataFrame, duck_frame: pd.DataFrame, tol: float = 1e-9) -> str | None:
    """None when equal, otherwise what differs."""
    a, b = _canonical(spark_frame), _canonical(duck_frame)
    if list(a.columns) != list(b.columns):
        return f"columns {list(a.columns)} vs {list(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    for c in a:
        if a[c].dtype == float and b[c].dtype == float:
            same = np.isclose(a[c], b[c], rtol=0, atol=tol, equal_nan=True)
        else:
            same = a[c].astype(str).to_numpy() == b[c].astype(str).to_numpy()
        if not same.all():
            i = int(np.argmin(same))
            return f"column {c}: {int((~same).sum())} differ, first {a.loc[i].to_dict()} vs {b.loc[i].to_dict()}"
    return None


def main(argv: list[str]) -> None:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from cellshift.session import get_spark

    sf_dir = "/root/testdata/sf0.01"
    names = argv or list(entry.queries())
    if names[0].startswith("/"):
        sf_dir, names = names[0], names[1:] or list(entry.queries())
    spark = get_spark(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    for name in names:
        t0 = time.time()
        try:
            got = entry.queries()[name](spark, sf_dir).toPandas()
            t1 = time.time()
            if name in oracle:
                rel = con.sql(oracle[name])
                odd = [f"{c}:{t}" for c, t in zip(rel.columns, rel.types) if "HUGE" in str(t) or "DECIMAL" in str(t)]
                verdict = (compare(got, rel.df()) or f"ok {len(got)} rows") + (f" ODD TYPES {odd}" if odd else "")
            else:
                verdict = f"rows only {len(got)}"
            print(f"{name}: {verdict}  spark {t1 - t0:.1f}s duck {time.time() - t1:.1f}s", flush=True)
        except Exception as error:  # report and go on with the next query
            print(f"{name}: FAILED {type(error).__name__} {str(error)[:1500]}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
