"""Mixing sources to target weights by the cube method.

Every text of a source is used ``floor`` times and once more with the same
fractional probability.  The cube method turns those probabilities into zeros and
ones while it keeps, for each source, the number of texts and of tokens: each
step moves three of them through the null space of the two constraints until one
is settled.  That is done in blocks of bounded size, in parallel; the at most two
unsettled texts of a block meet in the next round, until a source has at most two
left: rounding them and one exchange bring it nearest to its target.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.catalog import register
from corvane.llm.tokenizing import encode
from corvane.session import materialize, table

BLOCK = 50_000
SETTLED = 1e-9


def fly(chances: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """The flight phase: at most two of the chances stay between 0 and 1; their sum and the sum of chance x size are kept."""
    rng = random.Random(seed)
    p = chances.tolist()
    z = sizes.tolist()
    loose: list[int] = []
    for k in range(len(p)):
        if SETTLED < p[k] < 1 - SETTLED:
            loose.append(k)
        while len(loose) == 3:
            i, j, m = loose
            # the direction in which count and tokens don't change: the cross product of (1,1,1) and the sizes
            u = (z[m] - z[j], z[i] - z[m], z[j] - z[i])
            if u == (0, 0, 0):
                u = (1.0, -1.0, 0.0)
            up = min((1 - p[a]) / d if d > 0 else p[a] / -d for a, d in zip(loose, u) if d)
            down = min(p[a] / d if d > 0 else (1 - p[a]) / -d for a, d in zip(loose, u) if d)
            step = up if rng.random() * (up + down) < down else -down
            for a, d in zip(loose, u):
                p[a] += step * d
                if p[a] <= SETTLED:
                    p[a] = 0.0
                elif p[a] >= 1 - SETTLED:
                    p[a] = 1.0
            loose = [a for a in loose if 0.0 < p[a] < 1.0]
    return np.array(p)


def land(chances: np.ndarray, sizes: np.ndarray, wanted: float) -> np.ndarray:
    """The landing phase: round the at most two open chances so that the tokens come nearest to ``wanted``.

    One exchange of a taken text for one left out, which keeps the count, then
    closes most of what rounding leaves.
    """
    loose = [k for k, p in enumerate(chances) if 0.0 < p < 1.0]
    out = chances.copy()
    base, count = float(sum(out[k] * sizes[k] for k in range(len(out)) if k not in loose)), sum(chances[k] for k in loose)

    def miss(option: int) -> tuple[float, float]:
        taken = [k for b, k in enumerate(loose) if option >> b & 1]
        return abs(len(taken) - count) >= 1, abs(base + sum(sizes[k] for k in taken) - wanted)

    best = min(range(1 << len(loose)), key=miss)
    for b, k in enumerate(loose):
        out[k] = float(best >> b & 1)
    gap = wanted - float(out @ sizes)
    taken, left = np.flatnonzero(out == 1.0), np.flatnonzero(out == 0.0)
    if abs(gap) > 0.5 and len(taken) and len(left):
        left = left[np.argsort(sizes[left], kind="stable")]
        at = np.searchsorted(sizes[left], sizes[taken] + gap)
        near = np.clip(np.stack([at - 1, at]), 0, len(left) - 1)
        miss_by = np.abs(sizes[left[near]] - sizes[taken] - gap)
        which, i = np.unravel_index(miss_by.argmin(), miss_by.shape)
        off, i, j = miss_by[which, i], taken[i], left[near[which, i]]
        if off < abs(gap):
            out[i], out[j] = 0.0, 1.0
    return out


def _settle(rows: DataFrame, block: int, last: bool, round_: int) -> DataFrame:
    """One round: fly within blocks of each source, and land where a source is a single block."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place", kind="stable").reset_index(drop=True)
        before, sizes = part["chance"].to_numpy(), part["tokens"].to_numpy(dtype=float)
        chances = fly(before, sizes, int(part["place"].iloc[0]) ^ round_)
        if last:
            chances = land(chances, sizes, float(before @ sizes))
        part["chance"] = chances
        return part[["doc", "source", "tokens", "copies", "chance", "place"]]

    blocks = rows.withColumn("block", F.lit(0) if last else F.pmod(F.xxhash64("place", F.lit(round_)), F.col("blocks"))).drop("blocks")
    return blocks.groupBy("source", "block").applyInPandas(
        run, "doc bigint, source string, tokens bigint, copies bigint, chance double, place bigint"
    )


def mix_sources(
    df: DataFrame, targets: DataFrame, *, identifier: str, source: str, text: str, total_tokens: int | None = None, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """How often each text enters the mix, and the shares reached.

    ``targets`` has ``source``, ``target_share`` and ``max_repeats`` and is of a
    fixed small size; rows of it with a null are left out.  Sizes are tokens of the public tokenizer.  A text that
    occurs in several rows is one text and belongs to the row with the smallest
    identifier among the listed sources.  Sources that are absent, hold no token
    or may not be used get nothing and the others their shares in proportion.
    Without ``total_tokens`` the mix is as large as it can be with every present
    source at its share; with it, a source that can't reach its share is used as
    often as it may be.  Null, empty and unlisted texts and null identifiers aren't
    used; repeated rows count once; an empty table gives an empty mix.

    Returns ``mix`` (identifier, source, n_tokens, repeats), one row for each text
    that is used, and ``shares``, one row for each listed source.
    """
    listed = {
        r.source: (float(r.target_share), int(r.max_repeats))
        for r in targets.select("source", "target_share", "max_repeats").where("source is not null and target_share is not null and max_repeats is not null").distinct().collect()
    }
    spark = df.sparkSession
    usable = [s for s, (share, repeats) in listed.items() if share > 0 and repeats > 0]
    rows = df.select(F.col(identifier).cast("bigint").alias("doc"), F.col(source).alias("source"), F.col(text).alias("text")).where(
        F.col("source").isin(usable) & F.col("text").isNotNull() & (F.col("text") != "") & F.col("doc").isNotNull()
    )
    counted = encode(rows.withColumn("same", F.sha2("text", 256)), "text", keep=["doc", "source", "same"], counts_only=True)
    texts = (
        counted.groupBy("same")
        .agg(F.min(F.struct("doc", "source", "n_tokens")).alias("first"))
        .select("first.doc", "first.source", F.col("first.n_tokens").alias("tokens"))
        .where("tokens > 0")
    )
    texts = materialize(texts, "mix-texts")
    held = {r.source: (r.n, r.tokens) for r in texts.groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).collect()}
    present = sum(listed[s][0] for s in held)
    share = {s: listed[s][0] / present for s in held}
    most = {s: listed[s][1] * held[s][1] for s in held}
    total = total_tokens if total_tokens is not None else min((most[s] / share[s] for s in held), default=0.0)
    plan = []
    for s in held:
        rate = min(share[s] * total / held[s][1], float(listed[s][1]))
        copies = int(rate + SETTLED)
        chance = rate - copies
        plan.append((s, copies, chance if SETTLED < chance < 1 - SETTLED else 0.0, -(-held[s][0] // block)))
    planned = spark.createDataFrame(plan, "source string, copies bigint, chance double, blocks bigint")
    open_ = texts.join(F.broadcast(planned), "source").withColumn("place", F.xxhash64("doc"))
    settled = [open_.where("chance = 0").select("doc", "source", "tokens", "copies", "chance")]
    open_ = open_.where("chance > 0").select("doc", "source", "tokens", "copies", "chance", "place", "blocks")
    most_blocks = max((b for *_, b in plan), default=1)
    for round_ in range(64):
        last = most_blocks <= 1
        done = materialize(_settle(open_, block, last, round_), "mix-settled")
        settled.append(done.where("chance = 0 or chance = 1").select("doc", "source", "tokens", "copies", "chance"))
        if last:
            break
        # at most two a block are left
        most_blocks = -(-2 * most_blocks // block)
        open_ = done.where("chance > 0 and chance < 1").withColumn("blocks", F.lit(most_blocks).cast("bigint"))
    every = settled[0]
    for part in settled[1:]:
        every = every.unionByName(part)
    mix = every.select(
        F.col("doc").alias(identifier), "source", F.col("tokens").alias("n_tokens"), (F.col("copies") + F.col("chance").cast("bigint")).alias("repeats")
    ).where("repeats > 0")
    reached = mix.groupBy("source").agg(
        F.count("*").alias("texts_used"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("mix_tokens"), F.max("repeats").alias("most_repeats")
    )
    facts = spark.createDataFrame(
        [(s, a, b, *(held.get(s, (0, 0)))) for s, (a, b) in sorted(listed.items())],
        "source string, target_share double, max_repeats int, texts bigint, tokens bigint",
    )
    everything = F.sum("mix_tokens").over(_all_rows())
    shares = (
        facts.join(reached, "source", "left")
        .fillna(0, ["texts_used", "mix_tokens", "most_repeats"])
        .withColumn("actual_share", F.when(everything > 0, F.col("mix_tokens") / everything).otherwise(F.lit(0.0)))
        .withColumn("present_share", F.col("target_share") * F.when(F.col("tokens") > 0, 1.0 / (present or 1.0)).otherwise(0.0))
    )
    return mix, shares


def _all_rows():
    """A window over the few rows of the target table."""
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "mix_targets")
    return mix_sources(table(spark, sf_dir, "documents"), targets, identifier="doc_id", source="source", text="text")


@register("p8_mix")
def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


@register("p8_shares")
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]
