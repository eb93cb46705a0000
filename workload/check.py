"""Run registered queries and their SQL side by side: ``python -m workload.check [sf_dir] [names...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import numpy as np

from workload.oracle import ORACLE
from workload.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canon(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(canon(x) for x in v)
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v


def compare(spark, sf_dir: str, name: str) -> dict:
    t = time.time()
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(canon(r[c]) for c in cols) for r in df.collect()]
    out = {"name": name, "rows": len(got), "spark_s": round(time.time() - t, 2)}
    if name not in ORACLE:
        return {**out, "ok": False, "note": "no SQL to compare with"}
    con = duckdb.connect()
    for tb in TABLES:
        con.execute(f"CREATE VIEW {tb} AS SELECT * FROM '{sf_dir}/{tb}.parquet'")
    t = time.time()
    rel = con.execute(ORACLE[name])
    names = [d[0] for d in rel.description]
    order = [names.index(c) for c in sorted(names)]
    want = [tuple(canon(r[i]) for i in order) for r in rel.fetchall()]
    out["duck_s"] = round(time.time() - t, 2)
    if sorted(names) != cols:
        return {**out, "ok": False, "note": f"columns {cols} vs {sorted(names)}"}
    a, b = sorted(map(repr, got)), sorted(map(repr, want))
    out["ok"] = a == b
    if a != b:
        sa, sb = set(a), set(b)
        out["note"] = f"{len(a)} vs {len(b)} rows; only spark {len(sa - sb)}, only sql {len(sb - sa)}"
        out["sample"] = (sorted(sa - sb)[:2], sorted(sb - sa)[:2])
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    duck = {d[0]: str(d[1]) for d in rel.description} if rel.description else {}
    out["types"] = {c: (types[c], duck.get(c)) for c in cols}
    return out


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names:
        try:
            r = compare(spark, sf_dir, name)
        except Exception as exc:  # report and go on with the next query
            r = {"name": name, "ok": False, "note": f"{type(exc).__name__}: {str(exc)[:1500]}"}
        bad += not r["ok"]
        extra = f" {r.get('note', '')} {str(r.get('sample', ''))[:1500]}" if not r["ok"] or r.get("note") else ""
        print(("ok  " if r["ok"] else "FAIL"), name, r.get("rows"), r.get("spark_s"), r.get("duck_s"), extra, flush=True)
        if "--types" in sys.argv:
            print("    ", r.get("types"))
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main([a for a in sys.argv[1:] if not a.startswith("--")]))
