"""``python -m corvane index FOLDER STORE | status STORE | ask STORE QUESTION | chat STORE``: index a folder and ask it."""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from corvane.plans.engine import Engine
from corvane.session import build_session

USAGE = {"index": 2, "status": 1, "ask": 2, "chat": 1}
#: Rounds of a conversation that a further question is put behind.
REMEMBERED = 6


def show(engine: Engine, question: str) -> None:
    found = engine.ask(engine.spark.createDataFrame([(1, question)], "id int, question string"))
    found.orderBy("place").select("place", "key", "source", "section", "tier", F.substring("text", 1, 200).alias("text")).show(truncate=False)


def main(args: list[str]) -> int:
    if not args or USAGE.get(args[0]) != len(args) - 1:
        print(__doc__)
        return 2
    spark = build_session("corvane")
    store = args[-1] if args[0] == "index" else args[1]
    if args[0] == "index":
        made = Engine.from_folder(spark, args[1])
        for name, rows in (("chunks", made.chunks), ("parents", made.parents)):
            rows.write.mode("overwrite").parquet(f"{store}/{name}")
    engine = Engine(spark, spark.read.parquet(f"{store}/chunks"), spark.read.parquet(f"{store}/parents"))
    if args[0] == "ask":
        show(engine, args[2])
    elif args[0] == "chat":
        said: list[str] = []
        for line in sys.stdin:
            if line.strip():
                said = [*said, line.strip()][-REMEMBERED:]
                show(engine, " ".join(said))
    else:
        engine.status().show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
