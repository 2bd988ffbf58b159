"""Runs registered queries beside their SQL: ``python tests/compare.py [sf] [names…]``."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return value


def differences(frame, con, sql: str) -> str | None:
    """None when columns, types of values and rows agree."""
    names = sorted(frame.columns)
    ours = Counter(tuple(plain(r[n]) for n in names) for r in frame.collect())
    result = con.execute(sql)
    theirs_names = [c[0] for c in result.description]
    if sorted(theirs_names) != names:
        return f"columns {names} against {sorted(theirs_names)}"
    place = [theirs_names.index(n) for n in names]
    theirs = Counter(tuple(plain(r[i]) for i in place) for r in result.fetchall())
    if ours == theirs:
        kinds = [{type(v).__name__ for row in list(c)[:50] for v in row if v is not None} for c in (ours, theirs)]
        return None if kinds[0] == kinds[1] else f"value types {kinds}"
    more, less = ours - theirs, theirs - ours
    return (f"{sum(ours.values())} rows against {sum(theirs.values())}; "
            f"only here {list(more)[:2]}; only there {list(less)[:2]} ({sum(more.values())} differ) {names}")


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from prepforge.session import build_session

    sf = argv[0] if argv else "0.01"
    wanted = argv[1:]
    spark = build_session("compare")
    sf_dir = f"{DATA}/sf{sf}"
    con = connect(sf_dir)
    oracles, bad = entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        began = time.time()
        try:
            if name in oracles:
                said = differences(run(spark, sf_dir), con, oracles[name])
            else:
                rows = run(spark, sf_dir).collect()
                said = None if rows else "no rows"
            state = "ok  " if said is None else "BAD "
        except Exception as e:
            state, said = "FAIL", f"{type(e).__name__}: {str(e)[:700]}"
        bad += said is not None
        print(f"{state} {name:32s} {time.time() - began:6.2f}s {'' if name in oracles else '(no sql) '}{said or ''}",
              flush=True)
    print(f"{bad} not ok")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1))
