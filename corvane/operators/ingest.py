"""From loaded documents to sections, parents, chunks, summaries and vectors.

Everything per document is an expression over its own row, so none of these
operators shuffles.  Greedy cutters, whose next cut depends on the last one, run
as Arrow functions on batches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T

HEADING = r"^(#{1,6})\s+(.+?)\s*$"
LINE_END = r"\r\n|\n|\r"
VECTOR_TOKEN = re.compile(r"\w+|[^\w\s]")


def sections(df: DataFrame, identifier: str, content: str) -> DataFrame:
    """Markdown sections of each document, with the path of their headings.

    Rows (identifier, ordinal, section_path, text, start_line, end_line,
    start_char): a section reaches from its heading to the next one, lines counted
    from 0, ``end_line`` exclusive, characters as if lines ended in one.  A text
    before the first heading is a section without a path; a document without
    headings gives no rows.
    """
    lines = df.select(F.col(identifier).alias("_id"), F.split(T.text(F.col(content)), LINE_END).alias("lines"))
    marked = lines.withColumn(
        "heads",
        F.filter(
            F.transform(
                "lines",
                lambda line, i: F.struct(
                    i.alias("at"), F.length(F.regexp_extract(line, HEADING, 1)).alias("level"), F.regexp_extract(line, HEADING, 2).alias("title")
                ),
            ),
            lambda h: h["level"] > 0,
        ),
    ).where(F.size("heads") > 0)
    first = F.struct(F.lit(0).alias("at"), F.lit(0).alias("level"), F.lit("").alias("title"))
    starts = F.when(F.get("heads", F.lit(0))["at"] > 0, F.concat(F.array(first), F.col("heads"))).otherwise(F.col("heads"))
    own = "struct<at:int,level:int,title:string>"
    begin = F.expr(f"cast(named_struct('at', 0, 'chars', 0L, 'open', array(), 'done', array()) as struct<at:int,chars:bigint,open:array<{own}>,done:array<struct<at:int,path:string,chars:bigint>>>)")

    def step(state: Column, h: Column) -> Column:
        # the lines between two headings are measured once, and a heading closes those of its level and below
        between = F.when(h["at"] > state["at"], F.length(F.array_join(F.slice("lines", state["at"] + 1, h["at"] - state["at"]), "\n")) + 1).otherwise(0)
        chars = state["chars"] + between
        open_ = F.when(h["level"] > 0, F.concat(F.filter(state["open"], lambda k: k["level"] < h["level"]), F.array(h))).otherwise(state["open"])
        path = F.array_join(F.transform(open_, lambda k: k["title"]), " / ")
        done = F.struct(h["at"].alias("at"), path.alias("path"), chars.alias("chars"))
        return F.struct(h["at"].alias("at"), chars.alias("chars"), open_.alias("open"), F.concat(state["done"], F.array(done)).alias("done"))

    walked = marked.select("_id", "lines", F.aggregate(starts, begin, step, lambda state: state["done"]).alias("done"))
    # an outer one, for the other adds a filter that walks the headings again
    cut = walked.select("_id", "lines", "done", F.posexplode_outer("done").alias("ordinal", "own"))
    cut = cut.withColumn("end_line", F.coalesce(F.try_element_at("done", F.col("ordinal") + 2)["at"], F.size("lines")))
    return cut.select(
        F.col("_id").alias(identifier),
        F.col("ordinal").cast("bigint").alias("ordinal"),
        F.col("own.path").alias("section_path"),
        F.array_join(F.slice("lines", F.col("own.at") + 1, F.col("end_line") - F.col("own.at")), "\n").alias("text"),
        F.col("own.at").cast("bigint").alias("start_line"),
        F.col("end_line").cast("bigint").alias("end_line"),
        F.col("own.chars").alias("start_char"),
    )


def parents(df: DataFrame, identifier: str, content: str, source: str, file_type: str, page: str | None = None) -> DataFrame:
    """Parent documents: the sections with text of Markdown that has any, else the whole document or page.

    Sections come stripped, a document as it is; lines count from 1 in Markdown and are 0 elsewhere.
    """
    number = F.coalesce(F.col(page).cast("int"), F.lit(0)) if page else F.lit(0)
    named = df.select(
        F.col(identifier).alias("_id"), T.text(F.col(source)).alias("source"), F.col(file_type).alias("file_type"), number.alias("page"), T.text(F.col(content)).alias("content")
    ).withColumn("md", (F.lower(F.trim(T.text(F.col("file_type")))) == "md") | F.lower("source").endswith(".md"))
    own = sections(named.where("md"), "_id", "content")
    cut = own.withColumn("text", T.strip(F.col("text"))).where("text <> ''").join(named.select("_id", "source", "file_type"), "_id").select(
        "_id", "source", F.lit("md_section").alias("parent_type"), "section_path", "start_char", (F.col("start_line") + 1).alias("start_line"), "end_line", F.lit(0).alias("page"), "text"
    )
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    whole = named.join(own.select("_id").distinct(), "_id", "left_anti").select(
        "_id",
        "source",
        F.when(F.col("md"), "md_file").when(F.col("page") != 0, "pdf_page").otherwise("doc").alias("parent_type"),
        F.lit("").alias("section_path"),
        none.alias("start_char"),
        F.when(F.col("md"), one).otherwise(none).alias("start_line"),
        F.when(F.col("md"), F.length("content") - F.length(F.replace(F.col("content"), F.lit("\n"))) + 1).otherwise(0).cast("bigint").alias("end_line"),
        F.when(F.col("md"), 0).otherwise(F.col("page")).alias("page"),
        F.col("content").alias("text"),
    )
    return cut.unionByName(whole).withColumn(
        "parent_id", T.short_sha1(F.col("source"), F.col("section_path"), F.col("start_char"), F.col("page"))
    ).withColumnRenamed("_id", identifier)


def fixed_chunks(df: DataFrame, identifier: str, content: str, size: int = 800, overlap: int = 100) -> DataFrame:
    """Windows of ``size`` characters every ``size - overlap``; rows (identifier, chunk_index, start_index, text)."""
    step = size - overlap
    length = F.length(content)
    begins = F.sequence(F.lit(0), F.greatest(length - overlap - 1, F.lit(0)), F.lit(step))
    return df.where(length > 0).select(identifier, content, F.posexplode(begins).alias("chunk_index", "start_index")).select(
        identifier,
        F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.col("start_index").cast("bigint").alias("start_index"),
        F.substring(F.col(content), F.col("start_index") + 1, F.lit(size)).alias("text"),
    )


def _each_text(df: DataFrame, identifier: str, content: str, cut) -> DataFrame:
    """Rows (identifier, chunk_index, start_index, text) of a function text -> [(start, end)]."""
    kind = df.schema[identifier].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (name, i, a, text[a:b]) for name, text in zip(batch[identifier], batch[content]) for i, (a, b) in enumerate(cut(text))
            ]
            yield pd.DataFrame(rows, columns=["id", "chunk_index", "start_index", "text"])

    kept = df.select(identifier, content).where(F.length(content) > 0)
    return kept.mapInPandas(run, f"id {kind}, chunk_index bigint, start_index bigint, text string").withColumnRenamed("id", identifier)


def seek_cuts(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Windows that end at a blank line near their limit, else at the last sentence or line end before it."""
    out, start, length = [], 0, len(text)
    while start < length:
        end = min(start + size, length)
        if end < length:
            low, high = end - overlap, end + overlap
            blank = text.find("\n\n", max(start, low), high)
            if blank >= 0:
                end = blank + 2
            else:
                for mark in (". ", "。", "\n"):
                    at = text.rfind(mark, max(start, low), high)
                    if at >= 0:
                        end = at + len(mark)
                        break
        end = min(end, length)
        out.append((start, end))
        if end >= length:
            break
        start = end - overlap if end - overlap > start else end
    return out


def seeking_chunks(df: DataFrame, identifier: str, content: str, size: int = 800, overlap: int = 100) -> DataFrame:
    """Chunks that seek a boundary around their limit (it may be passed by the overlap)."""
    return _each_text(df, identifier, content, lambda text: seek_cuts(text, size, overlap))


def recursive_cuts(text: str, size: int, overlap: int, marks: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[tuple[int, int]]:
    """Spans of at most ``size`` characters, split at the coarsest mark that is fine enough, then merged with overlap."""

    def atoms(begin: int, end: int, level: int) -> list[tuple[int, int]]:
        if end - begin <= size:
            return [(begin, end)]
        mark = marks[level]
        if not mark:
            return [(at, min(at + size, end)) for at in range(begin, end, size)]
        spans, at = [], begin
        while at < end:
            hit = text.find(mark, at + 1, end)
            stop = end if hit < 0 else hit
            spans += atoms(at, stop, level + 1)
            at = stop
        return spans

    out: list[tuple[int, int]] = []
    held: list[tuple[int, int]] = []
    for span in atoms(0, len(text), 0):
        if held and span[1] - held[0][0] > size:
            out.append((held[0][0], held[-1][1]))
            while held and (held[-1][1] - held[0][0] > overlap or span[1] - held[0][0] > size):
                held.pop(0)
        held.append(span)
    if held:
        out.append((held[0][0], held[-1][1]))
    trimmed = []
    for begin, end in out:
        part = text[begin:end]
        left, right = len(part) - len(part.lstrip()), len(part.rstrip())
        if right > left:
            trimmed.append((begin + left, begin + right))
    return trimmed


def recursive_chunks(df: DataFrame, identifier: str, content: str, size: int = 800, overlap: int = 100) -> DataFrame:
    return _each_text(df, identifier, content, lambda text: recursive_cuts(text, size, overlap))


def clean_noise(c: Column) -> Column:
    """Without reference marks and edit links; runs of blanks and of blank lines squeezed."""
    out = F.regexp_replace(T.text(c), r"\^?\[\d+\]|\[edit\]|\[citation needed\]", "")
    out = F.regexp_replace(out, r"[ \t]{2,}", " ")
    return T.strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def chunk_id(source: Column, start: Column, text: Column) -> Column:
    """``file:digest``, or the digest alone without a source."""
    digest = T.short_sha1(source, start, text)
    return F.when(T.text(source) == "", digest).otherwise(F.concat(T.base_name(source), F.lit(":"), digest))


def line_span(text: Column, begin: Column, length: Column) -> tuple[Column, Column]:
    """First and last line, from 1, of a part of a text."""
    first = F.regexp_count(F.substring(text, F.lit(1), begin), F.lit("\n")) + 1
    last = F.regexp_count(F.substring(text, F.lit(1), begin + length), F.lit("\n")) + 1
    return first, last


def extractive_summary(c: Column, most: int = 900) -> Column:
    """The first twelve lines if they are long enough, else whole sentences, up to ``most`` characters."""

    def begin(raw: Column) -> Column:
        lines = F.filter(F.transform(F.split(raw, LINE_END), T.strip), lambda x: x != "")
        return F.array_join(F.slice(lines, 1, 12), "\n")

    def sentences(raw: Column) -> Column:
        parts = F.filter(
            F.transform(F.split(F.regexp_replace(raw, r"([.!?])\s+", "$1\u0001"), "\u0001"), T.strip), lambda s: F.length(s) >= 30
        )
        empty = F.struct(F.lit(0).alias("total"), F.array().cast("array<string>").alias("kept"))
        taken = F.aggregate(
            parts,
            empty,
            lambda acc, s: F.when(
                acc["total"] < most,
                F.struct((acc["total"] + F.length(s) + 1).alias("total"), F.concat(acc["kept"], F.array(s)).alias("kept")),
            ).otherwise(acc),
        )
        return F.array_join(taken["kept"], " ")

    def chosen(raw: Column) -> Column:
        other = lambda head: T.bind(sentences(raw), lambda body: F.when(body != "", body).otherwise(head))
        return T.bind(begin(raw), lambda head: F.when(F.length(head) >= min(most, 240), head).otherwise(other(head)))

    return F.substring(T.bind(T.strip(T.text(c)), chosen), 1, most)


def hypothetical_question(text: Column, section_path: Column) -> Column:
    """A question the text may answer, from its section and the first twelve words of a short summary."""
    last = F.regexp_replace(T.strip(F.element_at(F.split(T.strip(T.text(section_path)), "/"), -1)), r"\s+", " ")
    key = F.array_join(F.slice(F.regexp_extract_all(extractive_summary(text, 240), F.lit("([A-Za-z0-9]+)"), F.lit(1)), 1, 12), " ")
    return (
        F.when(last != "", T.strip(F.concat(F.lit("What is "), last, F.lit(" and why does it matter "), key)))
        .when(key != "", F.concat(F.lit("What is "), key, F.lit(" and how is it used in risk systems")))
        .otherwise("What is the definition and background")
    )


def hash_vector(c: Column, size: int = 64) -> Column:
    """A deterministic vector of unit length: signed digest bytes of all tokens, summed.

    Tokens are word runs or single other visible characters, in lower case; a text
    without any counts as one empty token.
    """
    found = F.regexp_extract_all(F.lower(T.text(c)), F.lit(r"((?U)\w+|[^\w\s])"), F.lit(1))
    tokens = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))
    return T.bind(F.transform(tokens, lambda t: F.sha2(t.cast("binary"), 256)), lambda digests: _sum_of_digests(digests, size))


def _signed_digests(tokens: Iterable[str]) -> np.ndarray:
    digests = np.frombuffer(b"".join(hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in tokens), np.uint8).astype(np.int16).reshape(-1, 32)
    return np.where(np.roll(digests, -7, axis=1) % 2 == 0, digests, -digests).astype(np.float64)  # whole numbers, so any order gives the same sum


TEXTS_AT_ONCE = 500  # of a batch, as their tokens' digests are held one by one


def hash_vectors(df: DataFrame, key: str, content: str, size: int = 64) -> DataFrame:
    """(key, vector): the vectors of ``hash_vector`` for whole corpora, as array operations over batches of texts."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            number: dict[str, int] = {}
            texts, parts = batch.column(1).to_pylist(), []
            for some in range(0, len(texts), TEXTS_AT_ONCE):
                tokens = [VECTOR_TOKEN.findall((t or "").lower()) or [""] for t in texts[some : some + TEXTS_AT_ONCE]]
                number.clear()
                codes = [number.setdefault(t, len(number)) for own in tokens for t in own]
                digests = _signed_digests(number)
                starts = np.cumsum([0, *map(len, tokens)])[:-1]
                parts.append(np.add.reduceat(digests[codes], starts))
            sums = np.concatenate(parts)
            sums /= np.maximum(np.sqrt((sums * sums).sum(axis=1, keepdims=True)) * np.sqrt(size // 32), 1e-300)
            values = np.tile(sums, size // 32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], values.ravel())], names=["key", "vector"])

    return df.select(F.col(key).alias("key"), F.col(content).alias("text")).mapInArrow(run, f"key {kind}, vector array<double>")


def _sum_of_digests(digests: Column, size: int) -> Column:
    byte = lambda h, i: F.conv(F.substring(h, 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("int")
    signed = lambda h, i: F.when(byte(h, i + 7) % 2 == 0, 1).otherwise(-1) * byte(h, i)
    # whole numbers are summed, so the order of the tokens can't show; the digest has
    # 32 bytes, so the second half of the vector repeats the first
    sums = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.aggregate(digests, F.lit(0), lambda total, h: total + signed(h, i)))
    whole = F.flatten(F.array_repeat(sums, size // 32))
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda total, x: total + x * x))
    return T.bind(whole, lambda v: T.bind(length(v), lambda n: F.transform(v, lambda x: x / F.when(n > 0, n).otherwise(1.0))))
