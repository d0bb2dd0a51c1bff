"""python -m lemmary list | run QUERY SF_DIR [OUT] | explain QUERY SF_DIR"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from lemmary.plans.catalog import QUERIES


def main(args: list[str]) -> int:
    if args[:1] == ["list"]:
        print("\n".join(sorted(QUERIES)))
        return 0
    if len(args) < 3 or args[0] not in ("run", "explain") or args[1] not in QUERIES:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName(f"lemmary {args[1]}").getOrCreate()
    frame = QUERIES[args[1]](spark, args[2])
    if args[0] == "explain":
        frame.explain("formatted")
    elif len(args) > 3:
        frame.write.mode("overwrite").parquet(args[3])
    else:
        frame.show(50, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
