"""Reading level of every document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import levels as lv
from corvane.llm.catalog import register
from corvane.llm.tokenizing import slices
from corvane.session import materialize, spread, table

#: Labelled rows the model is fitted to at most, by the order of their hash.
MOST_EXAMPLES = 20_000
CHARS_AT_ONCE = 1_000_000
#: The rarity of a term is taken from the corpus too if this share of a language's documents holds it, which bounds the number of terms.
LEAST_SHARE = 0.001


#: The sentences of a text as arrays.
PARSED = "lang string, sizes array<int>, part array<boolean>, commas array<int>, chars array<int>, linking array<int>, small array<int>, words array<bigint>"
COLUMNS = (("sizes", pa.int32()), ("part", pa.bool_()), ("commas", pa.int32()), ("chars", pa.int32()), ("linking", pa.int32()), ("small", pa.int32()))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that say anything, cut and counted: the only place where they are read."""
    for batch in batches:
        texts, labels = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for part in slices(texts, CHARS_AT_ONCE):
            kept = [k for k in range(part.start, part.stop) if lv.says_anything(texts[k])]
            read = [lv.parse(texts[k], labels[k]) for k in kept]
            for lang in lv.LANGUAGES:
                rows = [(k, found) for k, (own, found) in zip(kept, read) if own == lang]
                if not rows:
                    continue
                sentences = lv.Sentences.of([u for _, found in rows for u in found], lang)
                ends = np.append(0, np.cumsum([len(found) for _, found in rows])).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(getattr(sentences, name), kind)) for name, kind in COLUMNS]
                word_ends = np.append(0, np.cumsum(sentences.sizes))[ends].astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(word_ends), pa.array(sentences.words)))
                ids = batch.column(0).take(pa.array([k for k, _ in rows]))
                yield pa.RecordBatch.from_arrays([ids, pa.array([lang] * len(rows)), *lists], names=["id", "lang", *(n for n, _ in COLUMNS), "words"])


def parse_texts(rows: DataFrame) -> DataFrame:
    """(id, text, lang) rows as stored sentences, which both the statistics and the grading read."""
    kind = rows.schema["id"].dataType.simpleString()
    return materialize(rows.select("id", "text", "lang").mapInArrow(_parsed, f"id {kind}, {PARSED}"), "level-sentences")


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, lv.Sentences, np.ndarray]]:
    """The rows of each language in a batch: numbers of the rows, sentences, and the row of each sentence."""
    languages = np.array(batch.column("lang").to_pylist(), dtype=object)
    for lang in lv.LANGUAGES:
        rows = np.flatnonzero(languages == lang)
        if not len(rows):
            continue
        own = batch.take(pa.array(rows))
        flat = {name: own.column(name).flatten().to_numpy(zero_copy_only=False) for name in (*(n for n, _ in COLUMNS), "words")}
        counts = np.diff(own.column("sizes").offsets.to_numpy())
        sentences = lv.Sentences(*(flat[n].astype(bool if n == "part" else np.int64) for n in ("sizes", "part", "commas", "chars", "linking", "small", "words")))
        yield lang, rows, sentences, np.repeat(np.arange(len(rows)), counts)


#: What a row of the corpus statistics counts: texts and sentences, a term's sentences, or a word.
TOTAL, TERM, WORD = 0, 1, 2


def _corpus(parsed: DataFrame, model: lv.LevelModel, needed: dict[str, np.ndarray]):
    """Counts of the examples' words, of all words, and the company of frequent terms, over all documents in one pass."""
    known = parsed.sparkSession.sparkContext.broadcast((model, needed))  # no more words than the examples have

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, need = known.value
        for batch in batches:
            for lang, rows, sentences, text in _by_language(batch):
                if not len(text):
                    continue
                own = lv.company(sentences, text, len(rows), lang, first.languages[lang])
                wanted = np.isin(own.words, need[lang])
                kinds = np.repeat([TOTAL, TERM, WORD], [1, len(own.terms), 1 + wanted.sum()]).astype(np.int32)
                keys = np.concatenate([[0], own.terms, [0], own.words[wanted]]).astype(np.int64)
                sums = np.zeros((5, len(kinds)))
                sums[:, : len(own.terms) + 1] = np.vstack([np.append(own.weight, own.texts), np.column_stack([own.shares, own.documents])]).T
                sums[0, len(own.terms) + 1 :] = np.append(own.times.sum(), own.times[wanted])
                # the count of all words has its mark in the last column
                sums[4, len(own.terms) + 1] = 1
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kinds)), pa.array(kinds), pa.array(keys), *map(pa.array, sums)], names=["lang", "kind", "term", *"abcdn"])

    sums = parsed.mapInArrow(gather, "lang string, kind int, term bigint, a double, b double, c double, d double, n double")
    # shares are rounded, so that the order of addition can't show
    sums = sums.groupBy("lang", "kind", "term", F.expr("kind = 2 and n > 0").alias("all")).agg(*(F.round(F.sum(c), 6).alias(c) for c in "abcdn"))
    sums = materialize(sums, "level-terms")
    totals_by = sums.where(F.col("kind") == TOTAL).select("lang", F.col("n").alias("documents"))
    # each document has a bounded number of terms on average, so few can be in a thousandth of them
    frequent = sums.join(F.broadcast(totals_by), "lang").where(  # one row a language
        (F.col("kind") != TERM) | (F.col("n") >= LEAST_SHARE * F.col("documents"))
    )
    found = frequent.orderBy("lang", "kind", "term").toPandas()
    counts: dict[str, dict[int, int]] = {}
    totals: dict[str, int] = {}
    shares: dict[str, lv.TermShares] = {}
    for lang, own in found.groupby("lang"):
        words = own[(own["kind"] == WORD) & ~own["all"]]
        counts[lang] = dict(zip(words["term"].tolist(), words["a"].astype(int).tolist()))
        totals[lang] = int(own.loc[own["all"], "a"].sum())
        terms = own[own["kind"] == TERM]
        shares[lang] = lv.TermShares(own.loc[own["kind"] == TOTAL, list("abcd")].to_numpy()[0], terms["term"].to_numpy(), terms[list("abcd")].to_numpy())
    return counts, totals, shares


def fit_levels(parsed: DataFrame, examples: DataFrame, most_examples: int = MOST_EXAMPLES) -> lv.LevelModel:
    """The level model, from (text, lang, level) examples and the statistics of all parsed documents."""
    graded = examples.where("text is not null and level between 1 and 4").select("text", "lang", "level")
    rows = graded.orderBy(F.xxhash64("text"), "text", "level").limit(most_examples).collect()
    known = [(r.text, r.lang, int(r.level)) for r in rows]
    # a first model, with the examples' own word counts, reads the corpus; the final one has the corpus' counts
    own = lv.example_words(known)
    first = lv.fit(known, own, {lang: sum(n.values()) for lang, n in own.items()})
    return lv.fit(known, *_corpus(parsed, first, {lang: np.array(sorted(n), dtype=np.int64) for lang, n in own.items()}))


def reading_levels(df: DataFrame, examples: DataFrame, *, identifier: str, text: str, language: str) -> DataFrame:
    """The level, 1 to 4, of each text, as (identifier, level).

    The level is the one at which most sentences are written, the lower of equally
    frequent ones.  Null and empty texts and those of white or invisible
    characters have none and give no row; the language is taken from the text, and
    from its label (null and misspelt ones don't matter) only if the text doesn't
    tell; texts without words have level 1; repeated rows count once; an empty
    table gives an empty result.  Other columns don't matter.
    """
    rows = df.select(F.col(identifier).alias("id"), F.col(text).alias("text"), F.col(language).cast("string").alias("lang"))
    parsed = parse_texts(spread(rows.where("text is not null and text <> ''")))
    model = df.sparkSession.sparkContext.broadcast(fit_levels(parsed, examples))
    kind = rows.schema["id"].dataType.simpleString()

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, own, sentences, text in _by_language(batch):
                votes = lv.text_votes(sentences, text, len(own), lang, model.value.languages[lang]) if len(text) else np.zeros((len(own), len(lv.LEVELS)))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(own)), pa.array(lv.most_voted(votes).astype(np.int64))], names=["id", "level"])

    return parsed.mapInArrow(grade, f"id {kind}, level bigint").distinct().select(F.col("id").alias(identifier), "level")


@register("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = table(spark, sf_dir, "level_examples")
    return reading_levels(table(spark, sf_dir, "documents"), examples, identifier="doc_id", text="text", language="lang")


@register("p9_profile")
def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters of each source at each level."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("chars"))
    return (
        documents.join(p9_found(spark, sf_dir), "doc_id")
        .groupBy("source", "level")
        .agg(F.count("*").alias("documents"), F.sum("chars").alias("chars"))
    )
