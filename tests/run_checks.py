"""Command line: python -m tests.run_checks FOLDER [name ...] checks queries against their SQL."""

from __future__ import annotations

import sys
import time
import traceback

from postflock.catalog import QUERIES, SQL
from postflock.session import build_session
from tests.harness import connect, differences


def main(path: str, names: list[str]) -> int:
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="12g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(path), 0
    for name in names or list(QUERIES):
        began = time.time()
        try:
            found = QUERIES[name](spark, path).toPandas()
            spent = time.time() - began
            if name in SQL:
                began = time.time()
                verdict = differences(found, con.sql(SQL[name]).df())
                note = f"{'DIFF ' + verdict if verdict else 'ok'} rows={len(found)} spark={spent:.1f}s sql={time.time() - began:.1f}s"
                bad += bool(verdict)
            else:
                note = f"rows-only rows={len(found)} spark={spent:.1f}s"
        except Exception as error:  # noqa: BLE001
            bad += 1
            text = str(error).split("JVM stacktrace")[0][:600]
            note = f"ERROR {type(error).__name__}: {text}"
            if "-v" in sys.argv:
                traceback.print_exc()
        print(f"{name}: {note}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], [a for a in sys.argv[2:] if a != "-v"]) else 0)
