"""Prompt and response pairs whose response fails the prompt, with the kind of defect."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.catalog import register
from corvane.llm.pairs import classify, endings
from corvane.llm.tokenizing import slices
from corvane.session import materialize, table

CHARS_AT_ONCE = 2_000_000
VERDICT = "record_table string, record_id string, defect string, keys array<bigint>"


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tables, ids, prompts, responses = (c.to_pylist() for c in batch.columns)
        verdicts = [classify(p, r) for p, r in zip(prompts, responses)]
        said = [k for k, v in enumerate(verdicts) if v.defect or v.keys]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([tables[k] for k in said], pa.string()),
                pa.array([ids[k] for k in said], pa.string()),
                pa.array([verdicts[k].defect for k in said], pa.string()),
                pa.array([verdicts[k].keys and list(verdicts[k].keys) for k in said], pa.list_(pa.int64())),
            ],
            names=["record_table", "record_id", "defect", "keys"],
        )


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        responses, prompts = (c.to_pylist() for c in batch.columns)
        for part in slices(responses, CHARS_AT_ONCE):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in endings(responses[part], prompts[part])], names=["key", "x", "y", "z"])


def defective_pairs(pairs: DataFrame) -> DataFrame:
    """Defects of (record_table, record_id, prompt, response) rows, one row per defective pair.

    ``empty``: no words, or only a label or a stand-in for a missing value, also a
    null response; ``copies_question``: a suffix automaton of the prompt, or for
    very long texts its substrings of the least length, which cover the same,
    covers nearly all of the response; ``refusal``: refusal phrases and nothing that
    answers; ``other_language``: stopword votes of prompt and response differ;
    ``truncated``: an open delimiter, an empty list item, an ellipsis, or a last
    sentence that stops where the same words go on elsewhere in the corpus, which
    each different response tells once; an answer without a stop that nothing else
    tells about is complete if three prompts got it.  The first that holds counts.
    A null or blank prompt can only be judged as to ``empty``, ``refusal`` and
    ``truncated``; null identifiers are kept; repeated rows count once; an empty
    table gives an empty result.  Other columns don't
    matter.  Returns (record_table, record_id, defect).
    """
    rows = pairs.select("record_table", F.col("record_id").cast("string").alias("record_id"), "prompt", "response")
    verdicts = materialize(rows.mapInArrow(_verdicts, VERDICT), "pair-verdicts")
    open_tails = verdicts.where("keys is not null")
    asked = open_tails.select(F.explode("keys").alias("key")).distinct()
    counts = (
        rows.where("response is not null")
        # copies of a response are no further evidence of how its words end
        .groupBy("response")
        .agg(F.countDistinct(F.xxhash64("prompt")).alias("prompts"))
        .mapInArrow(_endings, "key bigint, x bigint, y bigint, z bigint")
        .join(asked, "key", "left_semi")
        .groupBy("key")
        .agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum("z").alias("z"))
    )
    at = lambda slot, column: F.coalesce(F.max(F.when(F.col("slot") == slot, F.col(column))), F.lit(0))
    cut = (
        open_tails.select("record_table", "record_id", "keys", F.posexplode("keys").alias("slot", "key"))
        .join(counts, "key", "left")
        .groupBy("record_table", "record_id", "keys")
        .agg(
            at(0, "x").alias("whole"),
            at(0, "y").alias("starts"),
            at(1, "y").alias("before"),
            at(2, "x").alias("ends"),
            at(2, "y").alias("goes_on"),
            at(0, "z").alias("unstopped"),
        )
        .where(
            # the rule of pairs.breaks_off
            """case when unstopped >= 3 and unstopped >= 10 * (starts - whole) and unstopped + starts >= 0.15 * (unstopped + before) then false
                    when starts >= 3 then whole < 0.5 * starts or starts < 0.15 * before
                    when before >= 10 then true
                    else not (ends >= 2 and ends >= 0.3 * (ends + goes_on)) end"""
        )
        .select("record_table", "record_id", F.lit("truncated").alias("defect"))
    )
    known = verdicts.where("defect is not null").select("record_table", "record_id", "defect")
    return known.unionByName(cut).distinct()


@register("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = (("questions", "id", "question", "reference_answer"), ("structured_payload", "request_id", "query", "report"))
    parts = [
        table(spark, sf_dir, name).select(
            F.lit(name).alias("record_table"), F.col(key).alias("record_id"), F.col(prompt).alias("prompt"), F.col(response).alias("response")
        )
        for name, key, prompt, response in sources
    ]
    return defective_pairs(reduce(DataFrame.unionByName, parts))
