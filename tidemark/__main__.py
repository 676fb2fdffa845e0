"""Put, get, delete and stats of a store from a shell: ``python -m tidemark STORE get KEY``.

Each call starts Spark, so this is for a look at a store, not for its use.
"""

from __future__ import annotations

import sys

USAGE = "usage: python -m tidemark STORE put KEY VALUE | get KEY | delete KEY | flush | compact | stats"


def main(args: list[str]) -> int:
    if len(args) < 2 or (args[1], len(args)) not in {("put", 4), ("get", 3), ("delete", 3), ("flush", 2), ("compact", 2), ("stats", 2)}:
        print(USAGE, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from tidemark.errors import StoreError
    from tidemark.sources.store import Store

    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        store = Store(spark, args[0])
        key = args[2].encode() if len(args) > 2 else b""
        match args[1]:
            case "put":
                store.put(spark.createDataFrame([(key, args[3].encode())], "key binary, value binary"))
            case "delete":
                store.delete(spark.createDataFrame([(key,)], "key binary"))
            case "get":
                value = store.get(key)
                sys.stdout.buffer.write(value if value.endswith(b"\n") else value + b"\n")
            case "flush":
                store.flush()
            case "compact":
                store.compact_all()
            case "stats":
                print(store.stats().toJSON().first())
    except StoreError as error:
        print(f"{type(error).__name__}: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
