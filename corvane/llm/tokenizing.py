"""Encoding a column of texts with a public byte-level tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.bpe import Encoder, load_merges
from corvane.llm.catalog import register
from corvane.session import spread, table

TOKENIZERS = os.environ.get("CORVANE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"
CHARS_AT_ONCE = 4_000_000


def slices(texts: list[str | None], chars: int = CHARS_AT_ONCE) -> Iterator[slice]:
    """Consecutive slices of a batch with about ``chars`` characters, one text at least."""
    begin = total = 0
    for at, text in enumerate(texts):
        total += len(text) if text else 0
        if total >= chars:
            yield slice(begin, at + 1)
            begin, total = at + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def encode(df: DataFrame, text: str, *, keep: list[str], vocabulary: str | None = None, counts_only: bool = False) -> DataFrame:
    """The columns ``keep`` and the token ``ids`` of ``text`` (or their number, ``n_tokens``).

    One row per row of ``df``, in place, without a shuffle.  No special tokens are
    added, their strings are ordinary text; empty and null texts give an empty
    list (0 tokens).  ``vocabulary`` is the path of the vocabulary file, read on
    the driver; its merges are broadcast, a fixed size of a few MB.
    """
    spark = df.sparkSession
    merges = spark.sparkContext.broadcast(load_merges(vocabulary or f"{TOKENIZERS}/{VOCABULARY}"))
    kept = spread(df.select(*keep, F.col(text).alias("__text")))
    name, kind = ("n_tokens", "bigint") if counts_only else ("ids", "array<int>")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), f"{name} {kind}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(merges.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for part in slices(texts):
                ids = encoder.encode_batch(texts[part])
                rows = batch.slice(part.start, part.stop - part.start)
                column = pa.array([len(i) for i in ids], pa.int64()) if counts_only else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], column], names=[*batch.schema.names[:-1], name])

    return kept.mapInArrow(run, schema)


@register("p7_ids")
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), "text", keep=["doc_id"])
