"""Run registered queries and their oracle side by side: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb

from checks import oracle, registry
from loadlens.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(str(row[i]) for i in order) for row in rows)


def compare(spark, sf_dir: str, only=()) -> int:
    duck = duckdb.connect()
    for name in TABLES:
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    queries, sqls = registry.queries(), oracle.oracle_sql()
    assert set(sqls) <= set(queries), set(sqls) - set(queries)
    bad = 0
    for name, query in queries.items():
        if only and name not in only:
            continue
        started = time.time()
        try:
            df = query(spark, sf_dir)
            mine = _rows(df.columns, [tuple(r) for r in df.collect()])
        except Exception as error:  # report and go on
            bad += 1
            print(f"FAIL  {name}: {str(error)[:600]}", flush=True)
            continue
        took = time.time() - started
        if name not in sqls:
            print(f"rows  {name} {len(mine[1])} {took:.1f}s", flush=True)
            continue
        try:
            cursor = duck.execute(sqls[name])
            theirs = _rows([d[0] for d in cursor.description], cursor.fetchall())
        except Exception as error:
            bad += 1
            print(f"ORACLE {name}: {str(error)[:600]}", flush=True)
            continue
        if mine == theirs:
            print(f"ok    {name} {len(mine[1])} {took:.1f}s", flush=True)
            continue
        bad += 1
        print(f"DIFF  {name} rows {len(mine[1])} vs {len(theirs[1])} columns {mine[0] == theirs[0]}", flush=True)
        if mine[0] != theirs[0]:
            print("   ", mine[0], theirs[0])
        shown = 0
        for a, b in zip(mine[1], theirs[1]):
            if a != b:
                print("   spark ", [x for x, y in zip(a, b) if x != y][:6], "\n   duckdb", [y for x, y in zip(a, b) if x != y][:6])
                shown += 1
                if shown == 2:
                    break
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sys.exit(1 if compare(local_session(), folder, set(sys.argv[2:])) else 0)
