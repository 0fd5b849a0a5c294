"""Capping the records of each contributor by distributed radix selection.

A record's rank inside its contributor is written as a key of order-preserving
bytes (score, then identifier), so "the first k" is "keys up to a cut-off key".
The cut-off is found digit by digit: each pass counts the still undecided keys
per group and byte, which partial aggregation shrinks to at most 256 rows per
group and task, and fixes the byte in which the k-th key falls.  Rows are never
sorted or gathered per group, so a group with a third of all rows costs no more
than any other rows.  Bytes that all undecided keys of a group share are skipped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.catalog import register
from corvane.session import materialize, table

KEY_BYTES = 16
SIGN = -(2**63)


def _eight_bytes(number: Column) -> Column:
    return F.unhex(F.lpad(F.hex(number), 16, "0"))


def descending_score_bytes(score: Column) -> Column:
    """Eight bytes whose unsigned order is score descending; null and NaN last."""
    # adding 0.0 turns -0.0 into 0.0, which the order must not tell apart
    value = F.coalesce(score.cast("double"), F.lit(0.0)) + F.lit(0.0)
    bits = F.call_function(
        "java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value
    ).cast("bigint")
    code = F.when(bits < 0, bits).otherwise(F.bitwise_not(bits).bitwiseXOR(F.lit(SIGN)))
    missing = score.isNull() | F.isnan(score)
    return _eight_bytes(F.when(missing, F.lit(-1).cast("bigint")).otherwise(code))


def ascending_id_bytes(identifier: Column) -> Column:
    return _eight_bytes(identifier.cast("bigint").bitwiseXOR(F.lit(SIGN)))


def _shared_bytes(low: Column, high: Column) -> Column:
    """Length of the common prefix of two keys."""
    same = F.transform(
        F.sequence(F.lit(1), F.lit(KEY_BYTES)),
        lambda i: F.substring(low, i, F.lit(1)) == F.substring(high, i, F.lit(1)),
    )
    at = F.array_position(same, F.lit(False))
    return F.when(at == 0, F.lit(KEY_BYTES)).otherwise(at.cast("int") - 1)


def radix_cutoffs(rows: DataFrame, groups: list[str], k: int, label: str) -> DataFrame:
    """The k-th smallest ``key`` of every group of ``rows`` that has more than k.

    ``rows`` needs the columns ``groups`` (no nulls) and ``key`` (binary of
    KEY_BYTES bytes) and should be a stored table, since each pass reads it.
    Returns ``groups`` and ``cutoff``.  Equal keys count separately; if they
    straddle the k-th place all of them lie at or below the cut-off.
    """
    state = materialize(
        rows.groupBy(*groups)
        .agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        .where(F.col("n") > k)
        .select(*groups, F.lit(k).cast("bigint").alias("need"), "n", "low", "high"),
        label,
    )
    decided = []
    for _ in range(KEY_BYTES + 1):
        done = (F.col("low") == F.col("high")) | (F.col("n") == F.col("need"))
        decided.append(state.where(done).select(*groups, F.col("high").alias("cutoff")))
        going = state.where(~done).select(
            *groups, "need", _shared_bytes(F.col("low"), F.col("high")).alias("depth"), "low"
        )
        if going.isEmpty():
            break
        going = going.select(
            *groups, "need", "depth", F.substring(F.col("low"), F.lit(1), F.col("depth")).alias("prefix")
        )
        counted = (
            rows.join(going, groups)
            .where(F.substring(F.col("key"), F.lit(1), F.col("depth")) == F.col("prefix"))
            .groupBy(*groups, "need", F.substring(F.col("key"), F.col("depth") + 1, F.lit(1)).alias("digit"))
            .agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        )
        running = F.sum("n").over(Window.partitionBy(*groups).orderBy("digit"))
        state = materialize(
            counted.withColumn("upto", running)
            .where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
            .select(*groups, (F.col("need") - F.col("upto") + F.col("n")).alias("need"), "n", "low", "high"),
            label,
        )
    return reduce(DataFrame.unionByName, decided)


def up_to_cutoff(rows: DataFrame, cutoffs: DataFrame, groups: list[str]) -> DataFrame:
    """The rows whose key doesn't exceed their group's cut-off; groups without one stay whole."""
    return (
        rows.join(cutoffs, groups, "left")
        .where(F.col("cutoff").isNull() | (F.col("key") <= F.col("cutoff")))
        .drop("cutoff")
    )


def cap_contributors(
    df: DataFrame,
    *,
    identifier: str,
    contributor: Column,
    part: Column,
    score: str,
    cap: int,
    part_cap: int,
) -> DataFrame:
    """Kept identifiers of the contributors that have more than ``cap`` records.

    A contributor's records are ordered by score descending (null and NaN last),
    then identifier ascending.  In that order at most ``part_cap`` records of one
    ``part`` stay (null and empty parts aren't limited), and of those the first
    ``cap``.  Rows with a null contributor or identifier take no part; rows that
    repeat count once; ties in the score are ordered by the identifier; an empty
    table gives an empty result.  Other columns of ``df`` don't matter, whatever
    their names.  Returns ``identifier``.
    """
    keyed = (
        df.select(
            F.col(identifier).alias("rid"),
            contributor.alias("who"),
            F.when(part == "", None).otherwise(part).alias("part"),
            F.concat(descending_score_bytes(F.col(score)), ascending_id_bytes(F.col(identifier))).alias("key"),
        )
        .where(F.col("who").isNotNull() & F.col("rid").isNotNull())
        .distinct()
    )
    keyed = materialize(keyed, "cap-keys")
    over = materialize(keyed.groupBy("who").count().where(F.col("count") > cap).select("who"), "cap-over")
    rows = keyed.join(over, "who", "left_semi")
    first = radix_cutoffs(rows.where(F.col("part").isNotNull()), ["who", "part"], part_cap, "cap-part")
    kept = materialize(up_to_cutoff(rows, first, ["who", "part"]), "cap-kept")
    second = radix_cutoffs(kept, ["who"], cap, "cap-who")
    return up_to_cutoff(kept, second, ["who"]).select(F.col("rid").alias(identifier))


def contributor_name(source: Column) -> Column:
    """Lower case, ``/`` for a backslash, no surrounding blanks and no leading ``./``."""
    name = F.regexp_replace(F.translate(F.lower(source), "\\", "/"), r"^\s+|\s+$", "")
    return F.regexp_replace(name, r"^\./", "")


@register(
    "p3_found",
    r"""
    WITH d AS (
      SELECT DISTINCT retrieval_id, rerank_score, nullif(section_path, '') AS part,
             regexp_replace(regexp_replace(replace(lower(source), chr(92), '/'), '^\s+|\s+$', '', 'g'), '^\./', '') AS who
      FROM retrieved_docs WHERE source IS NOT NULL AND retrieval_id IS NOT NULL
    ), big AS (SELECT who FROM d GROUP BY who HAVING count(*) > 40),
    a AS (
      SELECT d.*, row_number() OVER (PARTITION BY who, part ORDER BY rerank_score DESC NULLS LAST, retrieval_id) AS rn
      FROM d WHERE who IN (SELECT who FROM big)
    ), b AS (
      SELECT *, row_number() OVER (PARTITION BY who ORDER BY rerank_score DESC NULLS LAST, retrieval_id) AS rw
      FROM a WHERE part IS NULL OR rn <= 4
    )
    SELECT retrieval_id FROM b WHERE rw <= 40
    """,
)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_contributors(
        table(spark, sf_dir, "retrieved_docs"),
        identifier="retrieval_id",
        contributor=contributor_name(F.col("source")),
        part=F.col("section_path"),
        score="rerank_score",
        cap=40,
        part_cap=4,
    )
