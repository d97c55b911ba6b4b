"""Run registered queries against their DuckDB statements: python tools/check.py [sf] [key-prefix ...]"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from notewright.plans.registry import load  # noqa: E402
from notewright.session import local_session  # noqa: E402
from notewright.sources.corpus import TABLES  # noqa: E402


def canonical(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canonical(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(spark, con, run, sql, folder):
    df = run(spark, folder)
    columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows only: {len(got)}", True
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    wanted_columns, wanted = rows_of(names, result.fetchall())
    if columns != wanted_columns:
        return f"columns {columns} != {wanted_columns}", False
    if len(got) != len(wanted):
        return f"{len(got)} rows != {len(wanted)}", False
    for g, w in zip(got, wanted):
        if g != w:
            where = [(c, a, b) for c, a, b in zip(columns, g, w) if a != b]
            return f"first difference {str(where)[:600]}", False
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names_of = {"INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}
    odd = {c: (spark_types[c], types[c]) for c in columns if names_of.get(types[c], types[c]) != spark_types[c]}
    return f"{len(got)} rows" + (f" TYPES {odd}" if odd else ""), True


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    queries, oracles = load()
    bad = []
    for key, run in queries.items():
        if wanted and not any(key == w or (key.startswith(w) and not w[-1].isdigit()) for w in wanted):
            continue
        began = time.time()
        try:
            note, ok = compare(spark, con, run, oracles.get(key), folder)
        except Exception as e:  # noqa: BLE001
            note, ok = f"{type(e).__name__}: {str(e)[:700]}", False
            if "-v" in sys.argv:
                traceback.print_exc()
        print(f"{'ok  ' if ok else 'FAIL'} {key} {time.time() - began:.1f}s {note}", flush=True)
        if not ok:
            bad.append(key)
    print("failed:", bad, "of", len(queries), "registered;", len(oracles), "with SQL")


main()
