"""Near-duplicate texts by banded MinHash candidates and odd sketches.

Texts with equal shingle sets form a class, and only one member of a class is
compared.  Bands of MinHash values meet in a sorted shuffle, where equal bands
give candidate pairs of classes.  The odd sketches of a pair (parity bitmaps of
all its MinHash samples) estimate the similarity from one XOR; pairs far below
the threshold are dropped, and the rest are measured on their shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import shingles as sh
from corvane.llm.catalog import register
from corvane.llm.tokenizing import slices
from corvane.session import materialize, table

ROWS, BANDS = 4, 50
SKETCH_BITS = 1024
SEED = 20240131
CHARS_AT_ONCE = 1_500_000
#: Two bands' members are paired inside one task up to this many; larger ones are paired in blocks.
BLOCK = 1000
#: How far the estimate may lie below the threshold before a pair is dropped: over five standard deviations of it.
MARGIN = 0.25

ENTRY = "band bigint, class bigint, id string, sketch binary"
FOUND = "a bigint, b bigint, id string, sketch binary"


def _entries(width: int, least_words: int, rows: int, bands: int):
    """Of each text: one row with its class and sketch, and one row for each band of a new class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emitted: set[int] = set()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in slices(texts, CHARS_AT_ONCE):
                hashes, starts, owner = sh.shingle_sets(texts[part], width, least_words)
                if not len(starts):
                    continue
                classes = sh.set_fingerprints(hashes, starts).view(np.int64)
                samples = sh.min_hashes(hashes, starts, rows * bands, SEED)
                sketches = sh.odd_sketches(samples, SKETCH_BITS)
                names = [ids[part.start + int(o)] for o in owner]
                # the sketch is needed once a class; a copy in another partition repeats it
                new = np.array([c not in emitted and not emitted.add(c) for c in classes.tolist()], dtype=bool)
                carried = [s.tobytes() if n else None for s, n in zip(sketches, new)]
                # these rows only pass through the shuffle, so those of a class go everywhere
                anywhere = sh.mix(classes.view(np.uint64) + np.arange(len(classes), dtype=np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anywhere), pa.array(classes), pa.array(names, pa.string()), pa.array(carried, pa.binary())],
                    names=["band", "class", "id", "sketch"],
                )
                grouped = samples[new].reshape(-1, bands, rows)
                keys = np.broadcast_to(sh.mix(np.arange(1, bands + 1, dtype=np.uint64)), grouped.shape[:2])
                for r in range(rows):
                    keys = sh.mix(keys * sh.ODD + grouped[:, :, r])
                flat = keys.reshape(-1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat), pa.array(np.repeat(classes[new], bands)), pa.nulls(len(flat), pa.string()), pa.nulls(len(flat), pa.binary())],
                    names=["band", "class", "id", "sketch"],
                )

    return run


def _pairs_of_bands(block: int):
    """Candidate pairs of the classes that share a band, from rows sorted by band and class.

    Rows that carry a text pass through.  The members of a band with more than
    ``block`` classes come out singly, as (a = band, id = 'hot', b = class).
    """

    def batch_of(a, b, ids=None, sketches=None) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(a, pa.int64()),
                pa.array(b, pa.int64()),
                ids if ids is not None else pa.nulls(n, pa.string()),
                sketches if sketches is not None else pa.nulls(n, pa.binary()),
            ],
            names=["a", "b", "id", "sketch"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_band = rest_class = np.zeros(0, np.int64)
        hot: int | None = None  # the band whose members already come out singly

        def finish(band: np.ndarray, cls: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(band):
                return
            cut = np.flatnonzero(np.diff(band)) + 1
            starts, ends = np.append(0, cut), np.append(cut, len(band))
            size = ends - starts
            left, right = [], []
            two = size == 2
            left.append(cls[starts[two]])
            right.append(cls[starts[two] + 1])
            for s, e in zip(starts[size > 2], ends[size > 2]):
                own = cls[s:e]
                if len(own) > block or band[s] == hot:
                    yield batch_of(np.full(len(own), band[s]), own, ids=pa.array(["hot"] * len(own)))
                else:
                    i, j = np.triu_indices(len(own), 1)
                    left.append(own[i])
                    right.append(own[j])
            a, b = np.concatenate(left), np.concatenate(right)
            for at in range(0, len(a), 100_000):
                yield batch_of(a[at : at + 100_000], b[at : at + 100_000])

        for batch in batches:
            text_row = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            if text_row.any():
                own = batch.filter(pa.array(text_row))
                yield batch_of(own.column(1), pa.nulls(own.num_rows, pa.int64()), own.column(2), own.column(3))
            band = np.concatenate([rest_band, batch.column(0).to_numpy()[~text_row]])
            cls = np.concatenate([rest_class, batch.column(1).to_numpy()[~text_row]])
            again = np.zeros(len(band), dtype=bool)
            again[1:] = (band[1:] == band[:-1]) & (cls[1:] == cls[:-1])
            band, cls = band[~again], cls[~again]
            if not len(band):
                continue
            # the last band may go on in the next batch
            open_from = int(np.searchsorted(band, band[-1]))
            if hot is not None and (open_from > 0 or band[-1] != hot):
                own = band == hot
                if own.any():
                    yield batch_of(band[own], cls[own], ids=pa.array(["hot"] * int(own.sum())))
                    band, cls = band[~own], cls[~own]
                    open_from = int(np.searchsorted(band, band[-1])) if len(band) else 0
                hot = None
            yield from finish(band[:open_from], cls[:open_from])
            rest_band, rest_class = band[open_from:], cls[open_from:]
            if len(rest_band) > block:
                hot = int(rest_band[-1])
                # keep the last member, by which a repeated one is known
                yield batch_of(rest_band[:-1], rest_class[:-1], ids=pa.array(["hot"] * (len(rest_band) - 1)))
                rest_band, rest_class = rest_band[-1:], rest_class[-1:]
        if hot is not None and len(rest_band):
            yield batch_of(rest_band, rest_class, ids=pa.array(["hot"] * len(rest_band)))
        else:
            yield from finish(rest_band, rest_class)

    return run


def _pairs_in_blocks(members: DataFrame, group: str, item: str, block: int) -> DataFrame:
    """All pairs (a, b), a < b, of the items of each group, one bounded cell of two blocks at a time."""
    sizes = members.groupBy(group).count().where("count > 1").select(group, F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    placed = members.join(sizes, group).withColumn("block", F.pmod(F.xxhash64(item), F.col("blocks")).cast("int"))
    row = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = row.where("block <= other").select(group, F.col("block").alias("i"), F.col("other").alias("j"), F.col(item).alias("x"))
    right = row.where("other <= block").select(group, F.col("other").alias("i"), F.col("block").alias("j"), F.col(item).alias("y"))
    both = left.join(right, [group, "i", "j"]).where("x <> y and (i <> j or x < y)")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _close_sketches(threshold: float, samples: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (2, 3)
            )
            apart = np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64)
            near = sh.estimated_similarity(apart, samples, SKETCH_BITS) >= threshold - MARGIN
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(near))

    return run


def _measured(width: int, threshold: float):
    """Exact similarity of pairs of texts that have enough words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ones, twos = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep, sims = np.zeros(batch.num_rows, dtype=bool), np.zeros(batch.num_rows)
            for part in slices([x + y for x, y in zip(ones, twos)], CHARS_AT_ONCE):
                texts = [t for pair in zip(ones[part], twos[part]) for t in pair]
                hashes, starts, owner = sh.shingle_sets(texts, width, 0)
                ends = np.append(starts[1:], len(hashes))
                spans = {int(o): (s, e) for o, s, e in zip(owner, starts, ends)}
                for k in range(part.stop - part.start):
                    x, y = spans.get(2 * k), spans.get(2 * k + 1)
                    if x is None or y is None:
                        continue
                    one, two = hashes[x[0] : x[1]], hashes[y[0] : y[1]]
                    common = len(np.intersect1d(one, two, assume_unique=True))
                    union = len(one) + len(two) - common
                    sims[part.start + k] = common / union
                    # whole numbers decide, so that a similarity of just the threshold counts
                    keep[part.start + k] = common >= threshold * union - 1e-9
            out = pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sims)], names=["a", "b", "similarity"])
            yield out.filter(pa.array(keep))

    return run


def near_duplicate_classes(
    df: DataFrame,
    *,
    identifier: str,
    text: str,
    threshold: float,
    width: int,
    least_words: int,
    rows: int = ROWS,
    bands: int = BANDS,
    block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """Classes of texts with equal shingle sets and the near-duplicate pairs of classes.

    Returns ``members`` (id, class), one row per identifier, and ``pairs`` (a, b,
    similarity) of different classes, a < b, whose similarity is ``threshold`` or
    more.  Words are taken in lower case; a shingle is ``width`` words in a row;
    texts with fewer than ``least_words`` words, null texts and null identifiers
    have no class; rows that repeat an identifier count once.  Nothing limits the
    members of a band: those above ``block`` are paired block by block.  With the
    default bands a pair at similarity 0.6 is missed with probability 0.001, at
    0.7 with 0.000001.
    """
    chosen = df.select(F.col(identifier).cast("string").alias("id"), F.col(text).alias("text")).where(
        "id is not null and text is not null"
    )
    entries = chosen.mapInArrow(_entries(width, least_words, rows, bands), ENTRY)
    met = entries.repartition("band").sortWithinPartitions("band", "class").mapInArrow(_pairs_of_bands(block), FOUND)
    met = materialize(met, "near-met")
    known = met.where("b is null").select(F.col("a").alias("class"), "id", "sketch")
    hot = met.where("id = 'hot' and b is not null").select(F.col("a").alias("band"), F.col("b").alias("class"))
    plain = met.where("id is null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    candidates = plain.unionByName(_pairs_in_blocks(hot, "band", "class", block)).distinct()
    sketches = known.where("sketch is not null").groupBy("class").agg(F.max("sketch").alias("sketch"))
    close = (
        candidates.join(sketches.select(F.col("class").alias("a"), F.col("sketch").alias("one")), "a")
        .join(sketches.select(F.col("class").alias("b"), F.col("sketch").alias("two")), "b")
        .select("a", "b", "one", "two")
        .mapInArrow(_close_sketches(threshold, rows * bands), "a bigint, b bigint")
    )
    close = materialize(close, "near-close")
    # one text of each class that is still in question
    wanted = close.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    speaker = known.groupBy("class").agg(F.min("id").alias("id")).join(wanted, "class", "left_semi")
    spoken = materialize(
        chosen.join(speaker, "id").groupBy("class").agg(F.max("text").alias("text")), "near-texts"
    )
    pairs = (
        close.join(spoken.select(F.col("class").alias("a"), F.col("text").alias("one")), "a")
        .join(spoken.select(F.col("class").alias("b"), F.col("text").alias("two")), "b")
        .select("a", "b", "one", "two")
        .mapInArrow(_measured(width, threshold), "a bigint, b bigint, similarity double")
    )
    return known.select("id", "class").distinct(), pairs


def near_duplicate_pairs(df: DataFrame, **settings) -> DataFrame:
    """All pairs of identifiers (one, two), one < two, of near-duplicate texts; copies are expanded."""
    members, pairs = near_duplicate_classes(df, **settings)
    pairs = pairs.select("a", "b")
    across = (
        pairs.join(members.select(F.col("class").alias("a"), F.col("id").alias("x")), "a")
        .join(members.select(F.col("class").alias("b"), F.col("id").alias("y")), "b")
        .select(F.least("x", "y").alias("one"), F.greatest("x", "y").alias("two"))
    )
    copies = _pairs_in_blocks(members, "class", "id", settings.get("block", BLOCK)).select(F.col("a").alias("one"), F.col("b").alias("two"))
    return across.unionByName(copies)


@register("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_pairs(
        table(spark, sf_dir, "chunks"), identifier="chunk_id", text="page_content", threshold=0.6, width=3, least_words=20
    )
    return found.select(F.col("one").alias("chunk_a"), F.col("two").alias("chunk_b"))
