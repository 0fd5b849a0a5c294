"""Separating the main body of web pages from what the site puts around it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.catalog import register
from corvane.llm.page_text import ASIDE, SLOTS, LineReader, Pages, Wordings, contents, main_body, title_line
from corvane.session import materialize, spread, table

#: A line recurs on a site if this share of the site's other pages has it.
SHARE = 0.1
LINES = "number array<bigint>, density array<double>, key array<bigint>, flags array<tinyint>, sizes array<smallint>, slots array<int>, anchor int"


def _site(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#]*)", 1))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as arrays over their lines: each page is parsed only here."""
    reader = LineReader()
    for batch in batches:
        rows = {name: batch.column(name) for name in batch.schema.names}
        urls, kinds, titles, texts = (rows[c].to_pylist() for c in ("url", "markup", "title", "content"))
        kept, anchors, columns, counts, slots = [], [], [[] for _ in range(5)], [], []
        number, density, key, flags, sizes = columns
        for k, text in enumerate(texts):
            lines = reader.read(text, bool(kinds[k]))
            if not lines:
                continue
            at = title_line(lines, titles[k], urls[k])
            kept.append(k)
            anchors.append(-1 if at is None else at)
            counts.append(len(lines))
            number += [x.number for x in lines]
            density += [x.density for x in lines]
            key += [x.key for x in lines]
            flags += [x.flags | ASIDE * (c and i != at) for i, (x, c) in enumerate(zip(lines, contents(lines)))]
            sizes += [len(x.words) for x in lines]
            slots += [s for x in lines for s in x.words]
        ends = np.append(0, np.cumsum(counts)).astype(np.int32)
        lists = [
            pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))
            for values, kind in zip(columns, (pa.int64(), pa.float64(), pa.int64(), pa.int8(), pa.int16()))
        ]
        slot_ends = np.append(0, np.cumsum(sizes))[ends].astype(np.int32)
        lists.append(pa.ListArray.from_arrays(pa.array(slot_ends), pa.array(slots, pa.int32())))
        chosen = pa.array(kept, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [rows[c].take(chosen) for c in ("id", "site", "same")] + lists + [pa.array(anchors, pa.int32())],
            names=["id", "site", "same", "number", "density", "key", "flags", "sizes", "slots", "anchor"],
        )


def recurring_lines(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """The lines that recur over the pages of each site, as (site, keys, shares).

    Pages of equal content, as of an article fetched again, are one page.  A line's share is that of the site's other
    pages that have it, so a site of one page has none.  Counted per site and line with partial aggregation, so a site
    with most of the pages isn't gathered anywhere; a site's list has at most (lines of an average page) / ``share`` keys.
    """
    once = pages.select("site", "same", F.array_distinct("key").alias("key")).dropDuplicates(["site", "same"])
    counted = once.select("site", F.explode("key").alias("key")).groupBy("site", "key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = once.groupBy("site").agg(F.count("*").alias("pages"))
    return (
        counted.join(sizes, "site")
        .withColumn("share", (F.col("n") - 1) / (F.col("pages") + 1))
        .where(F.col("share") >= share)
        .groupBy("site")
        .agg(F.collect_list(F.struct("key", "share")).alias("own"))
        .select("site", F.col("own.key").alias("keys"), F.col("own.share").alias("shares"))
    )


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def _pages(batch: pa.RecordBatch) -> Pages:
    lists = batch.column("key")
    ends = lists.offsets.to_numpy().astype(np.int64)
    ends -= ends[0]
    key = _flat(batch, "key")
    recurs = np.zeros(len(key))
    # the pages of a site have the same list
    sites = np.array(batch.column("site").to_pylist(), dtype=object)
    keys, shares = batch.column("keys"), batch.column("shares")
    line_site = np.repeat(np.unique(sites, return_inverse=True)[1], np.diff(ends))
    for number, row in enumerate(np.unique(sites, return_index=True)[1]):
        if keys[int(row)].is_valid:
            own, values = keys[int(row)].values.to_numpy(), shares[int(row)].values.to_numpy()
            order = np.argsort(own)
            lines = np.flatnonzero(line_site == number)
            at = np.minimum(np.searchsorted(own[order], key[lines]), len(own) - 1)
            recurs[lines] = np.where(own[order][at] == key[lines], values[order][at], 0.0)
    anchor = batch.column("anchor").to_numpy(zero_copy_only=False).astype(np.int64)
    return Pages(ends[:-1], anchor, _flat(batch, "density"), _flat(batch, "flags"), recurs, _flat(batch, "sizes").astype(np.int64), _flat(batch, "slots"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many lines inside and outside of first regions fill each slot: one number a slot, however many pages."""
    seen = np.zeros((2, 3 * SLOTS), dtype=np.int64)
    for batch in batches:
        if batch.num_rows:
            pages = _pages(batch)
            inside = np.repeat(main_body(pages), pages.sizes)
            seen[0] += np.bincount(pages.slots[inside], minlength=3 * SLOTS)
            seen[1] += np.bincount(pages.slots[~inside], minlength=3 * SLOTS)
    slots = np.flatnonzero(seen.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(seen[0][slots]), pa.array(seen[1][slots])], names=["slot", "inside", "outside"])


def learn_wordings(pages: DataFrame) -> Wordings:
    """Counts of the wordings inside and outside of the content regions that ratios and recurrence give, over all pages.

    The table has ``3 * SLOTS`` slots at any size of the corpus, which bounds what reaches the driver.
    """
    counted = pages.mapInArrow(_counted, "slot int, inside bigint, outside bigint").groupBy("slot").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    found = Wordings()
    rows = counted.toPandas()
    found.inside[rows["slot"]], found.outside[rows["slot"]] = rows["inside"], rows["outside"]
    return found


def page_furniture(df: DataFrame, *, identifier: str, url: str, kind: str, title: str, content: str) -> DataFrame:
    """Lines of pages that show text but aren't main body, as (identifier, line_no).

    Lines are the parts between line feeds, counted from 1; a trailing carriage
    return doesn't matter.  A ``kind`` of html is parsed as markup, any other read
    as Markdown text.  Null and empty contents give no rows; a null title or
    address is no hint; on a page without a recognisable article every line that
    shows text is furniture; rows that repeat an identifier count once; an empty
    table gives an empty result.  Other columns don't matter.
    """
    scan = df.select(
        F.col(identifier).alias("id"),
        _site(F.col(url)).alias("site"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.lower(F.col(kind)) == "html", F.lit(False)).alias("markup"),
        F.col(title).cast("string").alias("title"),
        F.col(content).alias("content"),
    )
    scan = spread(scan.where("content is not null and content <> ''")).withColumn("same", F.xxhash64("content", "markup"))
    id_type = scan.schema["id"].dataType.simpleString()
    pages = materialize(scan.mapInArrow(_described, f"id {id_type}, site string, same bigint, {LINES}"), "page-lines")
    # a site's list is small; Spark broadcasts the lists if all of them are, else joins by site
    recurring = materialize(recurring_lines(pages), "page-recurring")
    known = pages.join(recurring, "site", "left").select("id", "site", "number", "density", "key", "flags", "sizes", "slots", "anchor", "keys", "shares")
    wordings = df.sparkSession.sparkContext.broadcast(learn_wordings(known))

    def outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                pages = _pages(batch)
                lines = np.flatnonzero(~main_body(pages, wordings.value))
                rows = np.searchsorted(pages.starts, lines, "right") - 1
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.array(_flat(batch, "number")[lines])], names=["id", "line_no"])

    found = known.mapInArrow(outside, f"id {id_type}, line_no bigint")
    return found.dropDuplicates(["id", "line_no"]).select(F.col("id").alias(identifier), "line_no")


@register("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_furniture(
        table(spark, sf_dir, "web_docs"), identifier="page_id", url="source", kind="file_type", title="title", content="page_content"
    )
