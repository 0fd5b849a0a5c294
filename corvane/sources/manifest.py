"""The index manifest: what is indexed, and what has changed since."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T

#: The parts of the configuration that decide whether an index can be used.
BLOCKS = ("schema_version", "embeddings", "vector_store", "chunking", "advanced_index", "source_loader")


def source_digests(rows: DataFrame, source: str, key: str, text: str) -> DataFrame:
    """(source, digest): what identifies the texts of a source, whatever their order.

    Each row's digest enters as two numbers, one added and one combined by XOR, so
    partial aggregation does the work and no source is gathered.
    """
    digest = F.md5(F.concat_ws(chr(0), T.text(F.col(key).cast("string")), T.text(F.col(text))).cast("binary"))
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")
    by = rows.groupBy(source).agg(F.count("*").alias("n"), F.sum(part(1)).alias("added"), F.bit_xor(part(9)).alias("mixed"))
    return by.select(source, F.concat_ws("-", F.col("n").cast("string"), F.col("added").cast("string"), F.col("mixed").cast("string")).alias("digest"))


def diff_manifest(now: DataFrame, before: DataFrame, source: str) -> DataFrame:
    """(source, state): added, changed, skipped, or deleted."""
    rows = now.withColumnRenamed("digest", "n").join(before.withColumnRenamed("digest", "b"), source, "full")
    state = F.when(F.col("b").isNull(), "added").when(F.col("n").isNull(), "deleted").when(F.col("n") == F.col("b"), "skipped").otherwise("changed")
    return rows.select(source, state.alias("state"))


def upsert(old: DataFrame, changed: DataFrame, source: str, deleted: DataFrame | None = None) -> DataFrame:
    """The stored rows with those of the changed sources replaced and those of the deleted ones removed."""
    gone = changed.select(source).distinct()
    if deleted is not None:
        gone = gone.unionByName(deleted.select(source)).distinct()
    return old.join(gone, source, "left_anti").unionByName(changed)


def fingerprint(config: dict[str, Any]) -> str:
    """A digest of the configuration blocks an index depends on, as canonical JSON."""
    chosen = {name: config.get(name) for name in BLOCKS}
    return hashlib.sha1(json.dumps(chosen, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def index_ready(manifest: dict[str, Any] | None, config: dict[str, Any]) -> tuple[bool, str]:
    """Whether an index exists and was made with this configuration."""
    if not manifest or not manifest.get("sources"):
        return False, "missing_index"
    if manifest.get("fingerprint") != fingerprint(config):
        return False, "schema_mismatch"
    return True, "ok"
