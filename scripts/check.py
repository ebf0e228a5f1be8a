"""Compare registered queries with their DuckDB twins: check.py [sf] [name prefix ...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from tallycell.plans import registry  # noqa: E402
from tallycell.session import local_session  # noqa: E402


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        s = df[c]
        if s.dtype.kind in "iufb" or str(s.dtype).startswith(("Int", "Float")):
            df[c] = pd.to_numeric(s).astype(float)
        else:
            df[c] = s.map(lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v)
                          else str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else
                          float(v) if type(v).__name__ == "Decimal" else str(v))
    return df.sort_values(list(df.columns), na_position="first", key=lambda s: s.astype(str)
                          if s.dtype == object else s).reset_index(drop=True)


def differs(a: pd.DataFrame, b: pd.DataFrame) -> str:
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} vs {sorted(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    if not len(a):
        return "EMPTY"
    a, b = canonical(a), canonical(b)
    for c in a.columns:
        x, y = a[c], b[c]
        same = (x == y) | (x.isna() & y.isna())
        if not same.all():
            i = (~same).idxmax()
            return f"{c}: {(~same).sum()} of {len(a)} differ, e.g. {x[i]!r} vs {y[i]!r}"
    return ""


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    root = f"/root/testdata/sf{sf}"
    spark = local_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for p in Path(root).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    sqls, bad = registry.oracle_sql(), 0
    for name, fn in registry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            got = fn(spark, root).toPandas()
            t1 = time.time() - t
            t = time.time()
            if name in sqls:
                why = differs(got, con.execute(sqls[name]).df())
            else:
                why = "" if len(got) else "EMPTY"
            t2 = time.time() - t
            note = "ok" if not why else f"MISMATCH {why}"
            bad += bool(why)
            print(f"{name:32s} {len(got):7d} rows {t1:6.2f}s duck {t2:5.2f}s "
                  f"{'' if name in sqls else '(rows only) '}{note}", flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{name:32s} FAILED {type(e).__name__}: {str(e)[:600]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
