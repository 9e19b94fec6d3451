"""Compare registered queries with their oracle SQL in DuckDB.

usage: python tools/check.py [sf] [name ...]     names may be prefixes
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402
import numpy as np  # noqa: E402

from palimpsest.catalog import all_oracles, all_queries  # noqa: E402
from palimpsest.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _norm(pdf):
    pdf = pdf[sorted(pdf.columns)]
    kinds = {c: str(pdf[c].dtype) for c in pdf.columns}
    rows = [
        tuple(
            None if v is None or (isinstance(v, float) and np.isnan(v)) else str(v) for v in row
        )
        for row in pdf.itertuples(index=False, name=None)
    ]
    return kinds, sorted(rows, key=lambda r: tuple((x is None, x or "") for x in r))


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    oracles, bad = all_oracles(), 0
    for name, fn in all_queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            t1 = time.time()
            if name not in oracles:
                print(f"rows  {name:28s} {len(got):8d} rows  spark {t1 - t0:6.2f}s")
                continue
            want = con.execute(oracles[name]).df()
            t2 = time.time()
            (gk, gr), (wk, wr) = _norm(got), _norm(want)
            ok = gk.keys() == wk.keys() and gr == wr
            note = ""
            if gk != wk:
                note = " types " + str({c: (gk.get(c), wk.get(c)) for c in {*gk, *wk} if gk.get(c) != wk.get(c)})
            print(
                f"{'ok   ' if ok else 'DIFF '} {name:28s} {len(got):8d}/{len(want)} rows  "
                f"spark {t1 - t0:6.2f}s duck {t2 - t1:6.2f}s{note}", flush=True
            )
            if not ok:
                bad += 1
                a, b = set(gr), set(wr)
                print("   columns", sorted(gk))
                for row in sorted(a - b, key=str)[:3]:
                    print("   spark only", str(row)[:400])
                for row in sorted(b - a, key=str)[:3]:
                    print("   duck only ", str(row)[:400])
        except Exception as exc:  # noqa: BLE001 - report and continue with the next query
            bad += 1
            print(f"FAIL  {name}: {type(exc).__name__}: {str(exc)[:1500]}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
