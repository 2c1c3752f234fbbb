"""Run registered queries next to their SQL oracle and report differences.

usage: check_oracles.py [sf_dir] [name ...]
"""

import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from cladeframe.session import get_spark  # noqa: E402
from tests.oracle import QUERIES, compare, connect  # noqa: E402


def main():
    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = get_spark(8)
    con = connect(d)
    bad = 0
    for n in names:
        try:
            status, msg, sec = compare(spark, con, d, n)
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            status, msg, sec = "ERROR", str(e)[:600], 0.0
        bad += status in ("FAIL", "ERROR")
        print(f"{status:5} {n:28} {sec:6.2f}s  {msg}", flush=True)
    print("bad:", bad)


main()
