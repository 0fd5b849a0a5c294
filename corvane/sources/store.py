"""Stored tables, reports, artifacts and traces: creation, reset, lists and retention."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.files import report_markdown, report_name
from corvane.sources.manifest import fingerprint

#: What a row of the vector table holds; the cell is its partition.
CHUNK_COLUMNS = "chunk_id string, source string, file_type string, parent_id string, section_path string, start_index bigint, page bigint, start_line bigint, end_line bigint, text string, vector array<float>, cell int"


# ---- the vector table -----------------------------------------------------------------------
def ensure_table(spark: SparkSession, name: str, columns: str = CHUNK_COLUMNS, partition: str = "cell") -> None:
    """Create a Parquet table, partitioned by cell, unless it is there."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY ({partition})")


def insert_rows(df: DataFrame, name: str) -> None:
    """Append rows to a table, columns by name."""
    columns = df.sparkSession.table(name).columns
    df.select(*(F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns)).repartition("cell").write.insertInto(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name} PURGE")


# ---- files ----------------------------------------------------------------------------------
def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """One small file from the driver, over what was there."""
    where, store = _hadoop(spark, path)
    out = store.create(where, True)
    out.write(bytearray(text.encode("utf-8", "surrogatepass")))
    out.close()
    return path


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, or nothing if it isn't there."""
    where, store = _hadoop(spark, path)
    if not store.exists(where):
        return None
    return bytes(spark.read.format("binaryFile").load(path).first().content).decode("utf-8", "replace")


def list_files(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """(path, modified, length) of the files of a folder, the newest first; none if there is no folder."""
    where, store = _hadoop(spark, folder)
    found = store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, pattern)) if store.exists(where) else None
    rows = [(s.getPath().toString(), s.getModificationTime(), s.getLen()) for s in found or [] if s.isFile()]
    return spark.createDataFrame(rows, "path string, modified bigint, length bigint").orderBy(F.desc("modified"), F.desc("path"))


def load_json(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """The object in a file; nothing if it isn't there or can't be read."""
    try:
        found = json.loads(read_text(spark, path) or "")
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def _compact(stamp: str) -> str:
    return stamp.replace("-", "").replace(":", "")


# ---- reports --------------------------------------------------------------------------------
def write_report(spark: SparkSession, report: dict[str, Any], folder: str, stamp: str, label: str | None = None) -> str:
    """Store a report as JSON beside a Markdown rendering; the path of the JSON."""
    path = f"{folder.rstrip('/')}/{report_name(label, _compact(stamp))}"
    write_text(spark, path[:-5] + ".md", report_markdown(f"Evaluation {stamp}", report.get("metrics", {})))
    return write_text(spark, path, json.dumps(report, ensure_ascii=False, indent=2, sort_keys=True, default=str))


def latest_report(spark: SparkSession, folder: str) -> dict[str, Any] | None:
    first = list_files(spark, folder, "rag_eval_*.json").first()
    return load_json(spark, first.path) if first else None


def comparison_markdown(rows: DataFrame, title: str = "Comparison of evaluations") -> str:
    """A table of (metric, current, baseline, delta, verdict) rows, which are few."""
    lines = [f"# {title}", "", "| metric | baseline | current | change | verdict |", "| --- | --- | --- | --- | --- |"]
    lines += [f"| {r.metric} | {r.baseline:.3f} | {r.current:.3f} | {r.delta:+.3f} | {r.verdict} |" for r in rows.orderBy("metric").collect()]
    return "\n".join(lines) + "\n"


# ---- artifacts and traces -------------------------------------------------------------------
def save_artifact(spark: SparkSession, folder: str, request: str, stamp: str, parts: dict[str, Any]) -> str:
    """All of a request in one file, and each part in a file of the request's bundle; the path of the one file."""
    base = f"{folder.rstrip('/')}/{_compact(stamp)}_{request}"
    for name, value in parts.items():
        if value is not None:
            write_text(spark, f"{base}/{name}.json", json.dumps(value, ensure_ascii=False, indent=2, default=str))
    whole = {"request_id": request, "timestamp": stamp, **{k: v for k, v in parts.items() if k in ("request", "response")}}
    return write_text(spark, f"{base}.json", json.dumps(whole, ensure_ascii=False, indent=2, default=str))


def save_trace(spark: SparkSession, folder: str, trace: dict[str, Any], stamp: str) -> str:
    """One file a request below ``traces``, named by the request, else by the time."""
    name = str(trace.get("request_id") or trace.get("run_id") or f"trace_{_compact(stamp)}")
    return write_text(spark, f"{folder.rstrip('/')}/traces/{name}.json", json.dumps({**trace, "_saved_at": stamp, "_trace_id": name}, ensure_ascii=False, default=str))


def clean_traces(spark: SparkSession, folder: str, now_ms: int, days: int = 7) -> int:
    """Delete the traces that are older than ``days``; how many."""
    old = list_files(spark, f"{folder.rstrip('/')}/traces").where(F.col("modified") < now_ms - days * 86_400_000).collect()
    for row in old:
        where, store = _hadoop(spark, row.path)
        store.delete(where, False)
    return len(old)


# ---- manifest -------------------------------------------------------------------------------
def write_manifest(spark: SparkSession, path: str, config: dict[str, Any], sources: dict[str, str], version: int = 4) -> str:
    """What is indexed, and with which configuration."""
    return write_text(spark, path, json.dumps({"version": version, "fingerprint": fingerprint(config), "sources": sources}, ensure_ascii=False, sort_keys=True))


def reset_on_mismatch(spark: SparkSession, manifest: dict[str, Any], config: dict[str, Any], tables: list[str], paths: list[str]) -> bool:
    """Drop an index that was made with another configuration: its tables and its files; whether it was."""
    if not manifest.get("sources") or manifest.get("fingerprint") == fingerprint(config):
        return False
    for name in tables:
        drop_table(spark, name)
    for path in paths:
        where, store = _hadoop(spark, path)
        store.delete(where, True)
    return True
