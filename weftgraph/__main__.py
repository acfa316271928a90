"""python -m weftgraph list | query NAME FOLDER [ROWS] | load TEXT PARQUET"""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession


def main(args: list[str]) -> int:
    from weftgraph.catalog import QUERIES as WITH_SQL, WITHOUT_SQL

    QUERIES = WITH_SQL | WITHOUT_SQL
    from weftgraph.sources.text import read_edges

    if args[:1] == ["list"]:
        print("\n".join(sorted(QUERIES)))
        return 0
    if args[:1] == ["query"] and len(args) in (3, 4) and args[1] in QUERIES:
        spark = SparkSession.builder.getOrCreate()
        began = time.time()
        df = QUERIES[args[1]](spark, args[2])
        df.show(int(args[3]) if len(args) == 4 else 20, truncate=False)
        print(f"{time.time() - began:.1f} s")
        return 0
    if args[:1] == ["load"] and len(args) == 3:
        read_edges(SparkSession.builder.getOrCreate(), args[1]).write.parquet(args[2])
        return 0
    print(__doc__, file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
