"""Scans of documents, corpora, datasets, traces and reports; and their sinks."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import Any
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T

#: File name endings and the kinds of documents they stand for.
FORMATS = {".md": "md", ".txt": "md", ".pdf": "pdf", ".docx": "docx", ".xlsx": "excel", ".html": "html", ".htm": "html"}
DOCUMENT = "source string, file_type string, page int, title string, text string, error string"


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(FORMATS.items()), "suffix string, file_type string")


class _Page(HTMLParser):
    """Title, headings by level, and the text of the main part of an HTML page."""

    SKIPPED = frozenset(("script", "style", "nav", "footer", "header"))
    BLOCKS = frozenset(("p", "div", "li", "tr", "br", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "main", "table", "ul", "ol"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.title = ""
        self.headings: dict[str, list[str]] = {f"h{i}": [] for i in range(1, 7)}
        self.all: list[str] = []
        self.main: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self._add("\n")
        if tag not in ("br", "img", "meta", "link", "input", "hr"):
            named = dict(attrs)
            main = tag in ("main", "article") or named.get("role") == "main" or (named.get("id") or "") in ("content", "main", "main-content")
            self.stack.append("main" if main else tag)
        if tag in self.headings and not self._hidden():
            self.headings[tag].append("")

    def handle_endtag(self, tag):
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at] == tag or (self.stack[at] == "main" and tag in ("main", "article", "div", "section")):
                del self.stack[at:]
                break
        if tag in self.BLOCKS:
            self._add("\n")

    def handle_data(self, data):
        if "title" in self.stack:
            self.title += data
        elif not self._hidden():
            for tag in reversed(self.stack):
                if tag in self.headings and self.headings[tag]:
                    self.headings[tag][-1] += data
                    break
            self._add(data)

    def _hidden(self) -> bool:
        return any(t in self.SKIPPED for t in self.stack)

    def _add(self, part: str) -> None:
        if not self._hidden():
            self.all.append(part)
            if "main" in self.stack:
                self.main.append(part)


def parse_html(markup: str) -> tuple[str, str]:
    """Title and text of a page: its first twenty headings by level, then the main part, else everything."""
    page = _Page()
    page.feed(markup)
    headings = [f"{'#' * int(tag[1])} {re.sub(r'\s+', ' ', h).strip()}" for tag in sorted(page.headings) for h in page.headings[tag] if h.strip()][:20]
    body = "".join(page.main) if "".join(page.main).strip() else "".join(page.all)
    body = re.sub(r"[ \t]+", " ", re.sub(r"\n\s*\n+", "\n\n", body)).strip()
    return re.sub(r"\s+", " ", page.title).strip(), "\n".join([*headings, "", body]).strip()


def parse_docx(content: bytes) -> str:
    """Paragraphs of a DOCX file, headings marked, tables as Markdown at the end."""
    word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    body = root.find(f"{word}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{word}t"))
    parts, tables = [], []
    for element in body if body is not None else ():
        if element.tag == f"{word}p":
            style = element.find(f"{word}pPr/{word}pStyle")
            text = said(element).strip()
            if text:
                parts.append(f"\n## {text}\n" if style is not None and style.get(f"{word}val", "").startswith("Heading") else text)
        elif element.tag == f"{word}tbl":
            rows = [[said(c).strip() for c in r.iter(f"{word}tc")] for r in element.iter(f"{word}tr")]
            if rows:
                lines = ["| " + " | ".join(r) + " |" for r in rows]
                tables.append("\n".join([lines[0], "| " + " | ".join("---" for _ in rows[0]) + " |", *lines[1:]]))
    return "\n".join([*parts, *(["\n## Tables\n", *tables] if tables else [])]).strip()


def _documents(path: str, content: bytes) -> list[tuple]:
    kind = FORMATS[path[path.rfind(".") :].lower()]
    if kind == "md":
        return [(path, kind, 0, None, content.decode("utf-8", "ignore"), None)]
    if kind == "html":
        title, text = parse_html(content.decode("utf-8", "ignore"))
        return [(path, kind, 0, title or None, text, None)]
    if kind == "docx":
        return [(path, kind, 0, None, parse_docx(content), None)]
    if kind == "pdf":
        from pypdf import PdfReader  # an optional extra

        pages = PdfReader(io.BytesIO(content)).pages
        return [(path, kind, i, None, page.extract_text() or "", None) for i, page in enumerate(pages, 1)]
    sheets = pd.read_excel(io.BytesIO(content), sheet_name=None)  # needs the optional openpyxl
    return [(path, kind, 0, name, sheet_text(name, rows), None) for name, rows in sheets.items()]


def sheet_text(name: str, rows: pd.DataFrame) -> str:
    """A sheet as text: a line of named cells for each row, then a Markdown table; empty cells and zeros are left out of the lines."""
    lines = [" | ".join(f"{c}: {v}" for c, v in r.items() if not pd.isna(v) and v) for r in rows.to_dict("records")]
    head = "| " + " | ".join(map(str, rows.columns)) + " |"
    table = ["| " + " | ".join("" if pd.isna(v) else str(v) for v in r) + " |" for r in rows.itertuples(index=False)]
    return "\n".join([f"# {name}", *filter(None, lines), "", head, "| " + " | ".join("---" for _ in rows.columns) + " |", *table])


def scan_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All documents of a folder and its subfolders, one row a file, page or sheet.

    Readme files and other formats are left out.  A file that can't be read gives
    a row with its ``error`` instead of ending the job.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    low = F.lower("path")
    ending = F.regexp_extract(low, r"(\.[a-z]+)$", 1)
    wanted = files.where(ending.isin(*FORMATS) & ~low.endswith("/readme.md")).select("path", "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows += _documents(path, content)
                except Exception as problem:  # one bad file must not stop a scan of millions
                    rows.append((path, FORMATS[path[path.rfind(".") :].lower()], 0, None, None, f"{type(problem).__name__}: {problem}"[:500]))
            yield pd.DataFrame(rows, columns=["source", "file_type", "page", "title", "text", "error"])

    return wanted.mapInPandas(read, DOCUMENT)


def html_pages(df: DataFrame, identifier: str, content: str) -> DataFrame:
    """(identifier, title, text) of a column of HTML pages."""
    kind = df.schema[identifier].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parsed = [parse_html(c) if isinstance(c, str) else (None, None) for c in batch["content"]]
            yield pd.DataFrame({"id": batch["id"], "title": [t or None for t, _ in parsed], "text": [x for _, x in parsed]})

    rows = df.select(F.col(identifier).alias("id"), F.col(content).alias("content"))
    return rows.mapInPandas(read, f"id {kind}, title string, text string").withColumnRenamed("id", identifier)


# ---- JSON lines -----------------------------------------------------------------------------
CORPUS = "page_content string, metadata map<string,string>"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus of JSON lines; a malformed line raises, a missing map is empty."""
    rows = spark.read.schema(CORPUS).option("mode", "FAILFAST").json(path)
    return rows.withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))


def write_corpus(df: DataFrame, path: str) -> None:
    df.select("page_content", "metadata").write.mode("overwrite").json(path)


def read_traces(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Trace files of one trace each, or with one a line; corrupt ones are left out."""
    node = "struct<name:string,latency_ms:double,token_usage:struct<prompt_tokens:int,completion_tokens:int>>"
    return spark.read.schema(f"request_id string, nodes array<{node}>").option("mode", "DROPMALFORMED").option("multiLine", not lines).json(path)


def latest_file(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """The path of the newest file that matches."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]


def read_dataset(spark: SparkSession, items: str, judgements: str | None = None, labels: str | None = None) -> DataFrame:
    """Evaluation items with their judgements and gate labels, where those files are given."""
    rows = spark.read.option("multiLine", True).schema(
        "id string, question string, reference_answer string, ground_truth_contexts array<string>, tags array<string>"
    ).json(items)
    if judgements:
        one = "struct<qrel_id:string,text:string,chunk_id:string,source:string,section_path:string,parent_id:string,relevance:int>"
        rows = rows.join(spark.read.option("multiLine", True).schema(f"id string, qrels array<{one}>").json(judgements), "id", "left")
    if labels:
        rows = rows.join(spark.read.option("multiLine", True).schema("id string, should_block boolean").json(labels), "id", "left")
    return rows


def text_only_judgements(items: DataFrame, allowed: DataFrame) -> DataFrame:
    """Judgements without a chunk whose item isn't on the allow-list: a dataset with any must not be admitted."""
    each = items.select("id", F.explode("qrels").alias("q"))
    return each.where(T.text(F.col("q.chunk_id")) == "").join(allowed.select("id"), "id", "left_anti").select("id", "q.qrel_id")


def read_thresholds(text: str) -> dict[str, Any]:
    """A threshold configuration, as JSON or, if that fails and the library is there, YAML."""
    try:
        found = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as problem:
            raise ValueError("the thresholds are no JSON, and YAML can't be read here") from problem
        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError("the thresholds must be an object")
    return found


def read_manifest(text: str | None) -> dict[str, Any]:
    """A manifest laid over an empty one; anything unreadable counts as empty."""
    empty: dict[str, Any] = {"version": 4, "fingerprint": "", "sources": {}}
    try:
        found = json.loads(text or "")
    except ValueError:
        return empty
    return empty | found if isinstance(found, dict) else empty


# ---- sinks ----------------------------------------------------------------------------------
def report_name(label: str | None, stamp: str) -> str:
    clean = re.sub(r"^-+|-+$", "", re.sub(r"[^a-z0-9_-]+", "-", (label or "").strip().lower()))
    return f"rag_eval_{clean + '_' if clean else ''}{stamp}.json"


def report_markdown(title: str, metrics: dict[str, float]) -> str:
    lines = [f"# {title}", "", "| metric | value |", "| --- | --- |"]
    return "\n".join([*lines, *(f"| {name} | {value:.4f} |" for name, value in sorted(metrics.items()))]) + "\n"


def write_bundles(df: DataFrame, path: str) -> None:
    """One folder for each request with its response."""
    df.write.mode("overwrite").partitionBy("request_id").json(path)


def write_vectors(df: DataFrame, path: str, rows_per_file: int = 500_000) -> None:
    """Vector rows by cell, so that a search reads the cells it probes and no others."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("cell").parquet(path)


def keep_recent(df: DataFrame, ts: str, now: Column, days: int = 7) -> DataFrame:
    """Rows no older than ``days``."""
    return df.where(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))
