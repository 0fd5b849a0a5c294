"""Top N items of every group by skipping Parquet row groups on their statistics.

The items are laid out once, whatever N will be: files clustered by group, within
a file groups of like score levels next to each other, and in a level the rows in
descending score.  Each file is then read row group by row group in descending
maximum score, and a row group is skipped when its maximum lies strictly below
the current N-th score of every group it contains.  As groups of a level have
their best scores alike, that holds for most of its row groups, also where a
row group has rows of many groups.  A group with more rows than a file should
hold is spread over several files, each of which yields at most N rows of it;
those few rows are merged at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.catalog import register
from corvane.session import materialize, scratch_path, shuffle_partitions, table

ROW_GROUP_BYTES = 4 * 2**20
#: Row groups a file should have, and the least and most rows of one.
ROW_GROUPS, LEAST_ROWS, MOST_ROWS = 32, 1_024, 131_072
ROWS_PER_FILE = 2_000_000
#: A group's level is its score at this place, to a quarter of a power of two; of smaller groups the least.
PLACE = 8
LEVEL = """case when reached = 0 then 0 when abs(reached) = double('infinity') then signum(reached) * 1e6
           else signum(reached) * (5000 + floor(4 * log2(abs(reached)))) end"""
ROW = "g string, item bigint, score double"


def _cluster(items: DataFrame, row_group_bytes: int, rows_per_file: int) -> list[str]:
    """Write (g, item, score) clustered by group; the paths of the files."""
    spark = items.sparkSession
    sizes = materialize(items.groupBy("g").count(), "top-sizes")
    total = sizes.agg(F.sum("count")).first()[0] or 0
    files = max(shuffle_partitions(spark), -(-total // rows_per_file))
    share = max(1, total // files)
    # each hot group holds more than 1/files of the rows, so there are fewer than ``files`` of them
    hot = sizes.where(F.col("count") > share).select("g", F.ceil(F.col("count") / share).cast("int").alias("spread"))
    hot = spark.createDataFrame(hot.collect(), hot.schema)
    path = scratch_path(spark, "top-items")
    # a group's rows are in one task now, so its level needs no further shuffle
    own = Window.partitionBy("g", "salt").orderBy(F.desc("score"))
    placed = F.row_number().over(own)
    (
        items.join(F.broadcast(hot), "g", "left")
        .withColumn("salt", F.pmod(F.xxhash64("item"), F.coalesce("spread", F.lit(1))))
        .repartition(files, "g", "salt")
        .withColumn("place", placed)
        .withColumn("reached", F.min(F.when(F.col("place") <= PLACE, F.col("score"))).over(Window.partitionBy("g", "salt")))
        .withColumn("level", F.expr(LEVEL))
        .sortWithinPartitions(F.desc("level"), F.desc("score"))
        .select("g", "item", "score")
        .write.option("parquet.block.size", row_group_bytes)
        .option("parquet.block.row.count.limit", min(MOST_ROWS, max(LEAST_ROWS, share // ROW_GROUPS)))
        .option("parquet.page.size", row_group_bytes // 4)
        .parquet(path)
    )
    return list(spark.read.schema(ROW).parquet(path).inputFiles())


class _Best:
    """The best n rows of each group seen so far, in arrays with one line a group."""

    def __init__(self, n: int):
        self.n, self.names, self.numbers = n, [], {}
        self.score = np.full((16, n), -np.inf)
        self.item = np.zeros((16, n), dtype=np.int64)
        self.held = np.zeros(16, dtype=np.int64)

    def lines(self, names: list[str]) -> np.ndarray:
        """The lines of some groups; new ones get one."""
        for name in names:
            if name not in self.numbers:
                self.numbers[name] = len(self.names)
                self.names.append(name)
        if len(self.names) > len(self.held):
            more = len(self.names)  # room for twice as many
            self.score = np.vstack([self.score, np.full((more, self.n), -np.inf)])
            self.item = np.vstack([self.item, np.zeros((more, self.n), dtype=np.int64)])
            self.held = np.append(self.held, np.zeros(more, dtype=np.int64))
        return np.array([self.numbers[name] for name in names], dtype=np.int64)

    def all_above(self, names: list[str], top: float) -> bool:
        """Whether every one of the groups has n rows, none of which ``top`` can replace."""
        own = [self.numbers.get(name, -1) for name in names]
        return min(own) >= 0 and bool((self.held[own] == self.n).all() and (self.score[own, self.n - 1] > top).all())

    def add(self, names: list[str], code: np.ndarray, item: np.ndarray, score: np.ndarray) -> None:
        """Merge rows of a row group, which touches only the lines of its groups."""
        line = self.lines(names)
        kept = np.arange(self.n)[None, :] < self.held[line][:, None]
        code = np.concatenate([code, np.nonzero(kept)[0]])
        item = np.concatenate([item, self.item[line][kept]])
        score = np.concatenate([score, self.score[line][kept]])
        order = np.lexsort((item, -score, code))
        code, item, score = code[order], item[order], score[order]
        new = np.append(True, (code[1:] != code[:-1]) | (item[1:] != item[:-1]) | (score[1:] != score[:-1]))
        code, item, score = code[new], item[new], score[new]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        place = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
        best = place < self.n
        self.score[line[code[best]], place[best]] = score[best]
        self.item[line[code[best]], place[best]] = item[best]
        self.held[line] = np.bincount(code[best], minlength=len(names))

    def table(self) -> pd.DataFrame:
        count = len(self.names)
        held = np.arange(self.n)[None, :] < self.held[:count, None]
        names = np.array(self.names, dtype=object)[np.nonzero(held)[0]]
        return pd.DataFrame({"g": names, "item": self.item[:count][held], "score": self.score[:count][held]})


def read_top(uri: str, n: int, seen: dict | None = None) -> pd.DataFrame:
    """The first n rows of every group in one clustered file.

    ``seen`` receives the number of row groups read and skipped; of a skipped row
    group of several groups only their names are read.
    """
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    best = _Best(n)
    read = skipped = 0
    with store.open_input_file(path) as handle:
        file = pq.ParquetFile(handle, read_dictionary=["g"])
        meta = file.metadata
        names = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
        spans = []
        for i in range(meta.num_row_groups):
            group = meta.row_group(i).column(names["g"]).statistics
            score = meta.row_group(i).column(names["score"]).statistics
            known = group is not None and group.has_min_max and score is not None and score.has_min_max
            spans.append((score.max if known else float("inf"), i, (group.min, group.max) if known else (None, "")))
        spans.sort(key=lambda s: (-s[0], s[1]))
        for top, i, (first, last) in spans:
            if read and top < float("inf"):
                inside = [first] if first == last else file.read_row_group(i, columns=["g"]).column("g").unique().to_pylist()
                if best.all_above(inside, top):
                    skipped += 1
                    continue
            read += 1
            rows = file.read_row_group(i).combine_chunks()
            groups = rows.column("g").combine_chunks()
            codes = groups.indices.to_numpy()
            used, code = np.unique(codes, return_inverse=True)
            names_used = groups.dictionary.take(used).to_pylist()
            best.add(names_used, code, rows.column("item").to_numpy(), rows.column("score").to_numpy())
    if seen is not None:
        seen["read"], seen["skipped"] = seen.get("read", 0) + read, seen.get("skipped", 0) + skipped
    return best.table()


def top_n_per_group(
    df: DataFrame,
    *,
    group: str,
    item: str,
    score: str,
    n: int,
    row_group_bytes: int = ROW_GROUP_BYTES,
    rows_per_file: int = ROWS_PER_FILE,
) -> DataFrame:
    """The first ``n`` items of every group by score descending, then item ascending.

    Rows with a null group, item or score, or a NaN score, take no part; repeated
    rows count once; groups with fewer than ``n`` items give all they have; an
    empty table gives an empty result.  Other columns of ``df`` don't matter.
    Returns (group, item, score).
    """
    spark = df.sparkSession
    items = df.select(
        F.col(group).cast("string").alias("g"), F.col(item).cast("bigint").alias("item"), F.col(score).cast("double").alias("score")
    ).where("g is not null and item is not null and score is not null and not isnan(score)")
    # Parquet readers may distrust the sign of a zero maximum, so zeros are written as 0.0
    items = items.withColumn("score", F.col("score") + F.lit(0.0))
    files = _cluster(items, row_group_bytes, rows_per_file)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["uri"]:
                yield read_top(uri, n)[["g", "item", "score"]]

    listed = spark.createDataFrame([(f,) for f in files], "uri string")
    if files:
        listed = listed.repartition(len(files))
    # a spread group still has n rows of each of its files
    place = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score"), "item"))
    merged = listed.mapInPandas(read, ROW).withColumn("place", place).where(F.col("place") <= n)
    return merged.select(F.col("g").alias(group), F.col("item").alias(item), F.col("score").alias(score))


@register(
    "p5_found",
    """
    SELECT item_id, entry_id FROM (
      SELECT item_id, entry_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, entry_id) AS place
      FROM (SELECT DISTINCT item_id, entry_id, score FROM evidence_entries
            WHERE item_id IS NOT NULL AND entry_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score))
    ) WHERE place <= 5
    """,
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_n_per_group(
        table(spark, sf_dir, "evidence_entries"), group="item_id", item="entry_id", score="score", n=5
    )
    return found.select("item_id", "entry_id")
