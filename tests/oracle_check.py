"""Compare registered queries with their SQL: python tests/oracle_check.py <sf_dir> [query ...]"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


_KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
          "date": "DATE", "timestamp": "TIMESTAMP"}


def compare(df, db, sql: str) -> tuple[str | None, list[str]]:
    """What differs (None if nothing), and notes on types that differ."""
    names, mine = _rows(df.columns, df.collect())
    cursor = db.execute(sql)
    theirs_names, theirs = _rows([d[0] for d in cursor.description], cursor.fetchall())
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    notes = [f"{c}: {k} vs {kinds[c]}" for c, k in df.dtypes if c in kinds and _KINDS.get(k, k) != kinds[c]]
    if names != theirs_names:
        return f"columns {sorted(set(names) ^ set(theirs_names))}", notes
    if len(mine) != len(theirs):
        return f"{len(mine)} rows, SQL has {len(theirs)}", notes
    for a, b in zip(mine, theirs):
        if a != b:
            off = [(n, x, y) for n, x, y in zip(names, a, b) if x != y]
            return f"first difference {str(off)[:500]}", notes
    return None, notes


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from fleetscore.session import get_session

    spark = get_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                         "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = sys.argv[1]
    db, plans, sqls = connect(sf_dir), queries(), oracle_sql()
    failed = 0
    for name in sys.argv[2:] or plans:
        start = time.time()
        if name not in sqls:
            print(f"{name:28s} no SQL   {plans[name](spark, sf_dir).count()} rows", flush=True)
            continue
        try:
            wrong, notes = compare(plans[name](spark, sf_dir), db, sqls[name])
        except Exception as e:
            wrong, notes = f"{type(e).__name__} {str(e)[:400]}", []
        failed += wrong is not None
        print(f"{name:28s} {'ok' if wrong is None else 'WRONG ' + wrong}  {time.time() - start:.1f}s "
              f"{'types ' + str(notes) if notes else ''}", flush=True)
    print("wrong:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
