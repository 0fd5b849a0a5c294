"""Time windows, limits and caches over event tables."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a column of timestamps with or without a zone (then UTC sessions)."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def sliding_sum(df: DataFrame, key: str, ts: str, value: str, seconds: int, name: str) -> DataFrame:
    """Each row with the sum of ``value`` over its key's last ``seconds``, both ends included.

    Rows are cut into stretches of that length and each joins its own and the next
    stretch, so a window never holds more than two stretches of a key, however
    long its history.
    """
    stretch = F.floor(micros(ts) / F.lit(seconds * 1_000_000))
    rows = df.withColumn("_own", stretch).withColumn("_at", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    frame = Window.partitionBy(key, "_at").orderBy(micros(ts)).rangeBetween(-seconds * 1_000_000, 0)
    return rows.withColumn(name, F.sum(value).over(frame)).where("_own = _at").drop("_own", "_at")


def rising_edge(over: Column, *by: str, order: list[Column]) -> Column:
    """True where a condition holds and didn't on the row before."""
    return over & ~F.coalesce(F.lag(over).over(Window.partitionBy(*by).orderBy(*order)), F.lit(False))


def fixed_window_limit(df: DataFrame, key: str, ts: str, order: str, length: str, limit: int) -> DataFrame:
    """Each row with ``allowed``: among the first ``limit`` of its key in its window of the clock."""
    place = F.row_number().over(Window.partitionBy(key, F.date_trunc(length, ts)).orderBy(ts, order))
    return df.withColumn("allowed", place <= limit)


def bucket_step(level: float, last: float, now: float, need: float, capacity: float, rate: float) -> tuple[bool, float, float]:
    """One request at a token bucket: (allowed, level afterwards, seconds until it could be)."""
    level = min(capacity, level + max(0.0, now - last) * rate)
    if need <= 0:
        return True, level, 0.0
    if need > capacity:
        return False, level, float("inf")
    if need <= level + 1e-9:
        return True, level - need, 0.0
    return False, level, (need - level) / rate if rate > 0 else float("inf")


def token_bucket(df: DataFrame, key: str, ts: str, order: str, need: str, capacity: float, per_minute: float, priority: str | None = None, classes: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Each request with ``allowed`` and ``retry_after``, by a bucket of tokens for each key and priority class.

    ``classes`` has (capacity, per_minute) of the classes with a budget of their own; requests of another class than
    these and ``default`` are free, as are those of a class without a rate.  The rows of a key and class follow each
    other in time; they pass as a stream of sorted batches, so none is gathered.
    """
    known = {"default": (capacity, per_minute), **(classes or {})}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, level, last = None, 0.0, 0.0
        for batch in batches:
            allowed, wait = [], []
            for k, c, at, n in zip(batch["key"], batch["class"], batch["at"], batch["need"]):
                most, rate = known.get(c, (0.0, 0.0))
                if rate <= 0:
                    allowed.append(True)
                    wait.append(0.0)
                    continue
                if current != (k, c):
                    current, level, last = (k, c), most, at
                ok, level, retry = bucket_step(level, last, at, n, most, rate / 60.0)
                last = max(last, at)
                allowed.append(ok)
                wait.append(round(retry, 6))
            yield pd.DataFrame({"id": batch["id"], "allowed": allowed, "retry_after": wait})

    name = priority_class(F.col(priority)) if priority else F.lit("default")
    rows = df.select(F.col(key).alias("key"), name.alias("class"), (micros(ts) / 1e6).alias("at"), F.col(order).alias("id"), F.col(need).cast("double").alias("need"))
    kind = rows.schema["id"].dataType.simpleString()
    ordered = rows.where("key is not null").repartition("key", "class").sortWithinPartitions("key", "class", "at", "id")
    return ordered.mapInPandas(run, f"id {kind}, allowed boolean, retry_after double").withColumnRenamed("id", order)


# Other names of the priority class with its own budget.
PRIORITY_ALIASES = {"noncritical": "non_critical", "non-critical": "non_critical", "query": "non_critical"}


def priority_class(name: Column) -> Column:
    """The class a priority stands for; ``default`` where none is named."""
    low = F.coalesce(F.nullif(F.trim(F.lower(name)), F.lit("")), F.lit("default"))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in PRIORITY_ALIASES.items() for x in pair)), low), low)


def ttl_hits(df: DataFrame, key: str, ts: str, order: str, seconds: int) -> DataFrame:
    """Each access with ``hit``: the key was written again within ``seconds``."""
    before = F.lag(micros(ts)).over(Window.partitionBy(key).orderBy(ts, order))
    return df.withColumn("hit", F.coalesce(micros(ts) - before <= seconds * 1_000_000, F.lit(False)))


def _touch(cache: OrderedDict, key, capacity: int) -> None:
    cache[key] = None
    cache.move_to_end(key)
    if len(cache) > capacity:
        cache.popitem(last=False)


def lru_hits(df: DataFrame, owner: str, key: str, ts: str, order: str, capacity: int, seconds: int = 86_400) -> DataFrame:
    """Each access with ``hit``: its key is among the ``capacity`` last used ones of its owner.

    An owner's accesses are cut into spans of ``seconds``.  What a span leaves in the cache is at most ``capacity`` keys,
    whatever was there before, so these lists are made in parallel, laid over each other in one pass, and each span is
    then played through from the keys it begins with.  A busy owner is one task's work only for the lists.
    """
    rows = df.select(F.col(owner).alias("owner"), F.col(key).alias("key"), micros(ts).alias("at"), F.col(order).alias("id")).where("owner is not null and key is not null")
    rows = rows.withColumn("span", F.floor(F.col("at") / (seconds * 1_000_000)))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("owner", "key", "id")}

    def left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, cache = None, OrderedDict()
        for batch in batches:
            done = []
            for who, span, k in zip(batch["owner"], batch["span"], batch["key"]):
                if current != (who, span):
                    if current is not None:
                        done.append((*current, list(cache)))
                    current, cache = (who, span), OrderedDict()
                _touch(cache, k, capacity)
            if done:
                yield pd.DataFrame(done, columns=["owner", "span", "keys"])
        if current is not None:
            yield pd.DataFrame([(*current, list(cache))], columns=["owner", "span", "keys"])

    def begun(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, cache = None, OrderedDict()
        for batch in batches:
            begin = []
            for who, span, keys in zip(batch["owner"], batch["span"], batch["keys"]):
                if current is None or who != current:
                    current, cache = who, OrderedDict()
                begin += [(who, span, k, place) for place, k in enumerate(cache)]
                for k in keys:
                    _touch(cache, k, capacity)
            yield pd.DataFrame(begin, columns=["owner", "span", "key", "place"])

    def played(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, cache = None, OrderedDict()
        for batch in batches:
            hits = []
            for who, span, k in zip(batch["owner"], batch["span"], batch["key"]):
                if current != (who, span):
                    current, cache = (who, span), OrderedDict()
                hits.append(k in cache)
                _touch(cache, k, capacity)
            asked = ~batch["seed"].to_numpy(dtype=bool)
            yield pd.DataFrame({"id": batch["id"][asked], "hit": pd.Series(hits, index=batch.index, dtype=bool)[asked]})

    spans = rows.repartition("owner", "span").sortWithinPartitions("owner", "span", "at", "id").select("owner", "span", "key")
    lists = spans.mapInPandas(left, f"owner {kinds['owner']}, span bigint, keys array<{kinds['key']}>")
    seeds = lists.repartition("owner").sortWithinPartitions("owner", "span").mapInPandas(begun, f"owner {kinds['owner']}, span bigint, key {kinds['key']}, place bigint")
    # a null would turn the batch's whole numbers into floats, which hold no large ones
    none = F.lit(0).cast(kinds["id"]) if kinds["id"] in ("tinyint", "smallint", "int", "bigint") else F.lit(None).cast(kinds["id"])
    both = rows.select("owner", "span", "key", "at", "id", F.lit(False).alias("seed")).unionByName(
        seeds.select("owner", "span", "key", F.col("place").alias("at"), none.alias("id"), F.lit(True).alias("seed"))
    )
    ordered = both.repartition("owner", "span").sortWithinPartitions("owner", "span", F.desc("seed"), "at", "id")
    return ordered.mapInPandas(played, f"id {kinds['id']}, hit boolean").withColumnRenamed("id", order)


def session_windows(df: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Count and bounds of each key's sessions, which a pause of ``gap`` ends."""
    return df.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
