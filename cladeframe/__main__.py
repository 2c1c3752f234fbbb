"""``python -m cladeframe`` / ``spark-submit``: run one command."""

from __future__ import annotations

import logging
import sys

from pyspark.sql import DataFrame, SparkSession

from cladeframe.plans.commands import run
from cladeframe.plans.options import OptionError, parse
from cladeframe.session import ship

LEVELS = {"error": logging.ERROR, "warning": logging.WARNING, "result": logging.WARNING, "info": logging.INFO,
          "progress": logging.INFO, "verbose": logging.INFO, "debug": logging.DEBUG}


def main(argv: list[str]) -> int:
    try:
        o = parse(argv)
    except OptionError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    logging.basicConfig(level=LEVELS.get(o.log.lower(), logging.INFO), format="%(message)s")
    if o.command in ("help", "version"):
        print(run(None, o)["text"])
        return 0
    spark = SparkSession.builder.appName(f"cladeframe {o.command}").getOrCreate()
    ship(spark)
    try:
        out = run(spark, o)
    except (ValueError, NotImplementedError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    for k, v in out.items():
        if isinstance(v, DataFrame):
            v.show(50, truncate=False)
        elif isinstance(v, (str, int, float, list, dict)):
            print(f"{k}: {v}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
