"""Cutting long texts at natural boundaries by pointer doubling.

For every text the places where a cut may fall are found with array operations,
each is joined to its farthest legal successor (overlap included), and the
successor table is squared until the cuts reached from the start are known.
A place can only become a cut if some window holds no place of a better class,
so the others are dropped beforehand, which leaves few places to join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.catalog import register
from corvane.session import table

SIZE, LEAST, OVERLAP = 4000, 2000, 200


def _classes(points: np.ndarray) -> list[np.ndarray]:
    """Cut places by class, best first: after a blank line, a line, a sentence, a space."""
    line = np.flatnonzero(points == 10)
    after = line + 1
    blank = np.zeros(len(line), dtype=bool)
    has1 = line >= 1
    blank[has1] = points[line[has1] - 1] == 10
    has2 = line >= 2
    blank[has2] |= (points[line[has2] - 1] == 13) & (points[line[has2] - 2] == 10)
    space = np.flatnonzero(points == 32)
    stop = np.zeros(len(space), dtype=bool)
    has1 = space >= 1
    before = points[space[has1] - 1]
    stop[has1] = (before == 46) | (before == 33) | (before == 63)
    ideographic = np.flatnonzero((points == 0x3002) | (points == 0xFF01) | (points == 0xFF1F))
    sentence = np.union1d(space[stop], ideographic)
    return [after[blank], after, sentence + 1, space + 1]


def cut_places(text: str, size: int = SIZE, least: int = LEAST, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of one text, in order.

    A text of at most ``size`` characters, also the empty one, is one piece.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    length = len(points)
    if length <= size:
        return np.zeros(1, np.int64), np.full(1, length, np.int64)
    classes = _classes(points)
    reach = size - least
    better = np.zeros(0, np.int64)
    nodes = [np.array([overlap], np.int64)]
    for places in classes:
        if len(better):
            at = np.searchsorted(better, places)
            after = np.where(at < len(better), better[np.minimum(at, len(better) - 1)], length + size)
            before = np.where(at > 0, better[np.maximum(at - 1, 0)], -size)
            nodes.append(places[(after != places) & (after - before > reach)])
        else:
            nodes.append(places)
        better = np.union1d(better, places)

    def successor(ends: np.ndarray) -> np.ndarray:
        start = ends - overlap
        found = start + size
        open_ = np.ones(len(start), dtype=bool)
        for places in classes:
            if not len(places):
                continue
            at = np.searchsorted(places, start + size, "right") - 1
            place = np.where(at >= 0, places[np.maximum(at, 0)], -1)
            hit = open_ & (place > start + least)
            found[hit] = place[hit]
            open_ &= ~hit
        return np.where(length - start <= size, length, found)

    # every boundary and its successor; in a stretch without boundaries the cuts are evenly spaced nodes of their own
    keys = np.unique(np.concatenate(nodes))
    ends = successor(keys)
    step = size - overlap
    pairs = [(keys, ends)]
    known, new = keys, np.setdiff1d(ends[ends < length], keys)
    while len(new):
        at = np.searchsorted(better, new - overlap + least, "right")
        ahead = np.minimum(np.where(at < len(better), better[np.minimum(at, len(better) - 1)], length), length) if len(better) else np.full(len(new), length)
        more = np.maximum(0, -((new - overlap + size - ahead) // step))
        first = np.repeat(new, more)
        place = np.arange(len(first)) - np.repeat(np.cumsum(more) - more, more)
        pairs.append((first + place * step, first + (place + 1) * step))
        last = new + more * step
        ends = successor(last)
        pairs.append((last, ends))
        known = np.union1d(known, np.concatenate([pairs[-2][0], last]))
        new = np.setdiff1d(ends[ends < length], known)
    keys = np.concatenate([k for k, _ in pairs])
    keys, place = np.unique(keys, return_index=True)
    ends = np.concatenate([e for _, e in pairs])[place]
    last = len(keys)
    jump = np.append(np.where(ends >= length, last, np.searchsorted(keys, ends)), last)
    reached = np.zeros(last + 1, dtype=bool)
    reached[np.searchsorted(keys, overlap)] = True
    while True:
        ahead = jump[np.flatnonzero(reached)]
        if reached[ahead].all():
            break
        reached[ahead] = True
        jump = jump[jump]
    starts = keys[reached[:-1]] - overlap
    return starts, ends[reached[:-1]]


SCHEMA = "id string, piece_no bigint, start_char bigint, end_char bigint"


def split_oversized(
    df: DataFrame, *, identifier: str, text: str, size: int = SIZE, least: int = LEAST, overlap: int = OVERLAP
) -> DataFrame:
    """Pieces of the texts of more than ``size`` characters.

    A piece ends at the last place within ``size`` characters and beyond
    ``least`` that follows a blank line, else a line feed, else the end of a
    sentence, else a space, else after ``size`` characters; the next piece starts
    ``overlap`` characters before that end.  Null and short texts give no rows;
    rows that repeat an identifier count once; a null identifier is kept as an
    identifier of its own; an empty table gives an empty result.  Other columns
    don't matter.  Returns (identifier, piece_no, start_char, end_char), pieces
    counted from 1, characters from 0, ``end_char`` exclusive.
    """
    if not 0 <= overlap < least < size:
        raise ValueError("0 <= overlap < least < size is needed, or pieces would not advance")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, starts, ends = [], [], [], []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                begin, end = cut_places(content.as_py(), size, least, overlap)
                ids.extend([name] * len(begin))
                numbers.append(np.arange(1, len(begin) + 1))
                starts.append(begin)
                ends.append(end)
            join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(join(numbers), pa.int64()), pa.array(join(starts), pa.int64()), pa.array(join(ends), pa.int64())],
                names=["id", "piece_no", "start_char", "end_char"],
            )

    long = df.select(F.col(identifier).cast("string").alias("id"), F.col(text).alias("text")).where(F.length("text") > size)
    # repeated rows are cut alike; dropping them afterwards moves the small rows instead of the texts
    cut = long.mapInArrow(pieces, SCHEMA).dropDuplicates(["id", "piece_no"])
    return cut.select(F.col("id").alias(identifier), "piece_no", "start_char", "end_char")


@register("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "parents"), identifier="parent_id", text="page_content")
