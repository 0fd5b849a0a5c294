"""Session helpers and shared scratch storage.

Multi-phase operators cut lineage by writing a Parquet table under the shared
folder the cluster names in ``spark.checkpoint.dir``.  Those tables survive the
loss of any executor; nothing is kept in executor-local checkpoints.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def build_session(app: str = "corvane", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; ``conf`` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where none is set.

    A machine-local default is accepted for local masters only, because the
    executors of a cluster would not see it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="corvane-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"file://{folder}"
    spark.conf.set("spark.checkpoint.dir", path)
    return path


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables this driver has written; results that still read them must be stored before."""
    dropped = 0
    while _SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        dropped += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return dropped


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to shared scratch and read it back, cutting its lineage.

    The shuffle files behind the written table are no longer needed afterwards,
    so the write runs with shuffle clean-up switched on.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


#: Surplus rows of a stored table that every worker may hold; more are taken out by storing the table again.
SURPLUS_HELD = 1_000_000


def once(df: DataFrame, key: str, label: str) -> DataFrame:
    """Store the rows as they come and read them back with each key once.

    Only keys and row numbers are moved to find the surplus rows, which repeated keys leave; the rows themselves stay.
    """
    numbered = materialize(df.withColumn("__row", F.monotonically_increasing_id()), label, compression="zstd")
    place = F.row_number().over(Window.partitionBy(key).orderBy("__row"))
    surplus = materialize(numbered.select("__row", place.alias("place")).where("place > 1").select("__row"), f"{label}-surplus")
    many = surplus.count()
    if many <= SURPLUS_HELD:
        left = numbered.join(F.broadcast(surplus), "__row", "left_anti") if many else numbered
        return left.drop("__row")
    return materialize(numbered.join(surplus, "__row", "left_anti").drop("__row"), label, compression="zstd")


#: Rows of keys that every worker may hold.
FEW = 100_000


def few(df: DataFrame, label: str) -> DataFrame:
    """Store rows of keys to look up in a large table; if they turn out to be few, every worker holds them, so that the table isn't moved."""
    stored = materialize(df, label)
    return F.broadcast(stored) if stored.count() <= FEW else stored


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan, spread over all cores if its few small files would keep only some of them busy.

    A large input has splits enough and is left alone.  Only the size of the files
    is looked at, which tells more than a plan's guess from the columns' types;
    nothing runs.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    split = min(64 * 2**20, int(df._jdf.sparkSession().sessionState().conf().filesMaxPartitionBytes()))
    if len(df.inputFiles()) < cores and size < cores * split:
        return df.repartition(cores)
    return df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
