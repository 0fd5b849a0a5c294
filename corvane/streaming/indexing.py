"""Incremental indexing: new and changed files of a folder, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import materialize
from corvane.sources.manifest import upsert

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def watch_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """New files of a folder as a stream of binary rows."""
    return spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)


#: Parts a table is kept in; a batch writes only those that hold one of its files.
PARTS = 64


def index_batch(files: DataFrame, table_path: str, parts: int = PARTS) -> dict[str, int]:
    """Upsert the texts of the files that changed into a table with one row a file; counts what was done.

    The table is kept in parts by the digest of the file's name, each with versions of its own.  A batch reads and
    writes the parts of its files only, next to their last versions, so a failed batch leaves those whole and a batch
    that comes again finds nothing to do.
    """
    spark = files.sparkSession
    part = F.pmod(F.xxhash64("source"), F.lit(parts)).cast("int")
    new = files.select(F.col("path").alias("source"), F.sha1("content").alias("digest"), F.decode("content", "utf-8").alias("text"))
    newest = new.groupBy("source").agg(F.max_by(F.struct("digest", "text"), "digest").alias("n")).select("source", "n.digest", "n.text").withColumn("part", part)
    newest = materialize(newest, "index-batch")  # read to compare, to count and to write
    touched = sorted(r.part for r in newest.select("part").distinct().collect())  # at most ``parts`` numbers
    last = {p: _versions(spark, f"{table_path}/part={p}") for p in touched}
    paths = [f"{table_path}/part={p}/version={v[-1]}" for p, v in last.items() if v]
    plain = newest.select("source", "digest", "text")
    old = spark.read.schema(plain.schema).parquet(*paths) if paths else spark.createDataFrame([], plain.schema)
    changed = newest.join(old.select("source", F.col("digest").alias("had")), "source", "left").where("had is null or had <> digest").drop("had")
    counts = {r.part: r.n for r in changed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    for p in counts:
        # the newest rows of a part replace its old ones, which leaves unchanged ones as they are
        version = (last[p][-1] if last[p] else 0) + 1
        kept = spark.read.schema(plain.schema).parquet(f"{table_path}/part={p}/version={last[p][-1]}") if last[p] else None
        fresh = newest.where(F.col("part") == p).select("source", "digest", "text")
        rows = upsert(kept, fresh, "source") if kept is not None else fresh
        rows.coalesce(1).write.mode("overwrite").parquet(f"{table_path}/part={p}/version={version}")
    return {"indexed": sum(counts.values()), "skipped": newest.count() - sum(counts.values())}


def read_index(spark: SparkSession, table_path: str, parts: int = PARTS) -> DataFrame:
    """The table as it is: the last version of each part."""
    last = ((p, _versions(spark, f"{table_path}/part={p}")) for p in range(parts))
    paths = [f"{table_path}/part={p}/version={v[-1]}" for p, v in last if v]
    schema = "source string, digest string, text string"
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _versions(spark: SparkSession, path: str) -> list[int]:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(hadoop):
        return []
    return sorted(int(s.getPath().getName().split("=")[1]) for s in store.listStatus(hadoop) if "=" in s.getPath().getName())
