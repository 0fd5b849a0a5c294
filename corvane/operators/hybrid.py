"""The whole retrieval of many questions at once: dense and lexical search, fusion, rescoring, expansion, second rounds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.config import DEFAULT, RetrievalConfig
from corvane.functions import text as T
from corvane.operators import filters as P
from corvane.operators import grading as G
from corvane.operators import ingest as I
from corvane.operators import retrieval as R
from corvane.session import few, materialize, once

#: A model's rewriting or reranking: a function from rows to rows.
Model = Callable[[DataFrame], DataFrame]
#: A model's vectors of (key, text) rows, as (key, vector).
Embedding = Callable[[DataFrame, str, str], DataFrame]


@dataclass(frozen=True)
class Corpus:
    """Chunks (chunk_id, source, section, parent_id, text) and parents (parent_id, section, text) with their indexes.

    Repeated rows of a key count once; they are dropped when filters and joins have left little to move.
    """

    chunks: DataFrame
    parents: DataFrame
    words: R.Lexicon
    vectors: DataFrame
    summaries: R.Lexicon
    hypothetical: R.Lexicon
    embed: Embedding = I.hash_vectors


def index(chunks: DataFrame, parents: DataFrame, embed: Embedding = I.hash_vectors) -> Corpus:
    """Index a corpus: words and vectors of its chunks, summaries and hypothetical questions of its parents."""
    # a filter on the column would be moved below it and make each summary twice
    made = F.filter(F.array(I.extractive_summary(F.col("text"))), lambda s: s != "")
    summaries = parents.select("parent_id", F.explode_outer(made).alias("summary")).where("summary is not null")
    asked = parents.select("parent_id", I.hypothetical_question(F.col("text"), F.col("section")).alias("question"))
    vectors = embed(chunks, "chunk_id", "text").select("key", F.col("vector").cast("array<float>").alias("vector"))  # as they are multiplied
    return Corpus(
        chunks, parents, R.lexicon(chunks, "chunk_id", "text"), once(vectors, "key", "chunk-vectors"),
        R.lexicon(summaries, "parent_id", "summary"), R.lexicon(asked, "parent_id", "question"), embed,
    )


def hybrid(corpus: Corpus, queries: DataFrame, config: RetrievalConfig = DEFAULT, rerank: Model | None = None) -> DataFrame:
    """(qid, key, place, score, gap) of the chosen chunks of (qid, text) queries.

    The lists of dense and lexical search are fused by rank; half the normalised lexical score and the boost of words in
    source and section make the coarse score; ``rerank`` may add ``rerank_score`` to the best of these; quotas by source
    and section choose.  ``gap`` is the distance to the best score.
    """
    wording = T.text(F.col("text"))
    wordings = queries.select(wording.alias("text"), wording.alias("wording")).distinct()  # each is searched for once
    asked = corpus.embed(wordings, "text", "wording")
    near = R.nearest_streamed(corpus.vectors, "key", "vector", asked, "key", "vector", config.dense_k)
    dense = queries.select("qid", wording.alias("wording")).join(near.withColumnRenamed("qid", "wording"), "wording")
    sparse = R.search(corpus.words, queries, "qid", "text", config.sparse_k)
    none = F.lit(None)
    lists = dense.select("qid", "key", F.col("rank").alias("dense_rank"), none.cast("int").alias("sparse_rank"), none.cast("double").alias("bm25")).unionByName(
        sparse.select("qid", "key", none.cast("int").alias("dense_rank"), F.col("rank").alias("sparse_rank"), F.col("score").alias("bm25"))
    )
    part = lambda c: F.coalesce(1.0 / (config.rrf_k + F.col(c)), F.lit(0.0))
    merged = lists.repartition("qid").groupBy("qid", "key").agg(*(F.max(c).alias(c) for c in ("dense_rank", "sparse_rank", "bm25")))
    merged = merged.withColumn("rrf", F.round(part("dense_rank") + part("sparse_rank"), 9)).withColumn("top", F.max("bm25").over(Window.partitionBy("qid")))
    texts = corpus.chunks.select(F.col("chunk_id").alias("key"), "source", "section", "parent_id", "text").where(P.passes_quality(F.col("text"), config.min_chunk_chars)).dropDuplicates(["key"])
    tokens = queries.select("qid", F.col("text").alias("query"), F.array_distinct(T.tokens_a(F.col("text"))).alias("tokens"))
    if rerank is None:  # texts are a model's to read
        texts, tokens = texts.drop("parent_id", "text"), tokens.drop("query")
    candidates = R.top_k(merged.join(texts, "key"), "qid", config.candidate_k, F.desc("rrf"), F.asc("key"), name="candidate").join(tokens, "qid")
    coarse = F.col("rrf") + 0.5 * F.coalesce(F.col("bm25") / F.col("top"), F.lit(0.0)) + R.metadata_boost(F.col("tokens"), F.col("source"), F.col("section"))
    pool = R.top_k(candidates.withColumn("coarse", F.round(coarse, 9)), "qid", config.rerank_k, F.desc("coarse"), F.asc("key"), name="pooled")
    score = F.col("coarse")
    if rerank is not None:
        pool, score = rerank(pool), F.coalesce("rerank_score", "coarse")
    own = Window.partitionBy("qid").orderBy(F.desc("score"), "key")
    ranked = pool.withColumn("score", score).select(
        "qid", "key", "source", "section", "score", F.row_number().over(own).alias("rank"), F.round(F.first("score").over(own) - F.col("score"), 9).alias("gap")
    )
    return R.diverse(ranked, "qid", config.hybrid_k, config.max_per_source, config.max_per_section, also=("score", "gap"))


def fan_out(questions: DataFrame, config: RetrievalConfig = DEFAULT, rewrite: Model | None = None) -> DataFrame:
    """(id, ordinal, qid, text): each question and its variants; simple ones stay alone.

    ``rewrite`` maps (id, question) rows to such rows with other wordings, which are then searched for.
    """
    rows = rewrite(questions) if rewrite else questions
    made = rows.select("id", P.complexity(F.col("question")).alias("c"), F.posexplode(R.query_variants(F.col("question"), config.max_variants, config.expansion_n)).alias("ordinal", "text"))
    kept = made.where("c.needs_fanout or ordinal = 0")
    return kept.select("id", "ordinal", F.concat_ws("#", F.col("id").cast("string"), F.col("ordinal").cast("string")).alias("qid"), "text")


def fused_variants(corpus: Corpus, variants: DataFrame, config: RetrievalConfig = DEFAULT, rerank: Model | None = None) -> DataFrame:
    """(id, key, place, fused, hits, score, gap): the best chunks over all variants; score and gap are of the first variant that found them."""
    found = hybrid(corpus, variants.select("qid", "text"), config, rerank).where(F.col("place") <= config.per_query_k).join(variants.select("qid", "id", "ordinal"), "qid")
    fused = found.groupBy("id", "key").agg(
        F.round(F.sum(1.0 / (config.rrf_k + F.col("place"))), 9).alias("fused"), F.count("*").alias("hits"), F.min_by("score", "ordinal").alias("score"), F.min_by("gap", "ordinal").alias("gap")
    )
    return R.top_k(fused, "id", config.hybrid_k, F.desc("fused"), F.asc("key"), name="place")


def _signal(index_: R.Lexicon, questions: DataFrame, k: int, name: str) -> DataFrame:
    """(id, parent_id, name): the lexical score of parents through their summaries or questions, over the best one's."""
    found = R.search(index_, questions, "id", "question", k, repeat=True)
    top = F.max("score").over(Window.partitionBy("qid"))
    return found.select(F.col("qid").alias("id"), F.col("key").alias("parent_id"), F.round(F.col("score") / top, 6).alias(name))


def expand_route(question: Column) -> Column:
    """The route that says how far parents are attached: numeric questions first."""
    return F.when(P.question_type(question) == "numeric", "numeric").otherwise(P.route(question))


def rescored(corpus: Corpus, questions: DataFrame, fused: DataFrame, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """The final chunks, (id, key, place, score, adv, summary, hyde, reason, expanded, text, source, section, parent_id, gap).

    Signals of the parents' summaries and hypothetical questions are added to the score; the policy of the question's
    route says which chunks get their parent's text attached.
    """
    about = corpus.chunks.select(F.col("chunk_id").alias("key"), "source", "section", "parent_id", F.length(T.text(F.col("text"))).alias("chars"))
    found = materialize(about.join(few(fused, "fused"), "key").dropDuplicates(["id", "key"]), "found")
    rows = found.join(questions.select("id", expand_route(F.col("question")).alias("route")), "id")
    for signal, index_, k in (("summary", corpus.summaries, config.summary_k), ("hyde", corpus.hypothetical, config.hyde_k)):
        rows = rows.join(_signal(index_, questions, k, signal), ["id", "parent_id"], "left")
    rows = rows.fillna(0.0, ["summary", "hyde"])
    rows = rows.withColumn("adv", F.round(F.col("score") + config.summary_weight * F.col("summary") + config.hyde_weight * F.col("hyde"), 9))
    final = few(R.top_k(rows, "id", config.final_k, F.desc("adv"), F.asc("place"), name="last"), "final")  # texts are read for these alone
    wanted = few(final.select("parent_id").distinct(), "wanted-parents")
    parents = corpus.parents.join(wanted, "parent_id", "left_semi").select("parent_id", F.trim(T.text(F.col("text"))).alias("parent_text")).where("parent_text <> ''").dropDuplicates(["parent_id"])
    texts = corpus.chunks.select(F.col("chunk_id").alias("key"), "text").join(final.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    reason = P.expand_reason(F.col("route"), F.col("place") - 1, F.col("chars"), F.greatest("summary", "hyde"), F.col("gap"))
    rows = final.join(parents, "parent_id", "left").withColumn("reason", F.when(F.col("parent_text").isNotNull(), reason).otherwise(""))
    expanded = F.when(F.col("reason") != "", F.substring(F.col("parent_text"), F.lit(1), P.expand_chars(F.col("route"))))
    rows = rows.withColumn("expanded", expanded).drop("parent_text").join(texts, "key")
    return rows.select("id", "key", F.col("last").alias("place"), "score", "adv", "summary", "hyde", "reason", "expanded", "text", "source", "section", "parent_id", "gap")


def retrieve(corpus: Corpus, questions: DataFrame, config: RetrievalConfig = DEFAULT, rewrite: Model | None = None, rerank: Model | None = None) -> DataFrame:
    """One round of the whole retrieval of (id, question) rows."""
    variants = materialize(fan_out(questions, config, rewrite), "variants")
    return rescored(corpus, questions, fused_variants(corpus, variants, config, rerank), config)


def grade(questions: DataFrame, found: DataFrame) -> DataFrame:
    """The verdict on what was found for each question; nothing found is irrelevant."""
    docs = found.select("id", "place", "source", "section", "parent_id", F.col("text").alias("content"), "expanded", "gap")
    graded = G.grade_documents(questions, docs, "id", "question").select("id", "tier", "sufficient", "reason", "top_isrel", "claim_coverage")
    return questions.select("id").join(graded, "id", "left").select(
        "id", F.coalesce("tier", F.lit("irrelevant")).alias("tier"), F.coalesce("sufficient", F.lit(False)).alias("sufficient"), F.coalesce("reason", F.lit("no_docs")).alias("reason"), "top_isrel", "claim_coverage"
    )


def rounds(
    corpus: Corpus, questions: DataFrame, config: RetrievalConfig = DEFAULT, most: int = 2, revise: Model | None = None, rerank: Model | None = None
) -> tuple[DataFrame, DataFrame]:
    """Up to ``most`` rounds of retrieval and grading, all questions of a round in one plan.

    A question whose documents are irrelevant is searched for again with every k doubled; one whose documents are
    insufficient with the wording ``revise`` gives, if there is one; the others are done.  Returns the chunks of each
    question's last round, with its number, and one row of state a question: rounds, tier, reason.
    """
    chunks: list[DataFrame] = []
    states: list[DataFrame] = []
    open_, rewrite = questions.select("id", "question"), None
    for number in range(1, most + 1):
        found = materialize(retrieve(corpus, open_, config, rewrite, rerank), "round")
        verdicts = materialize(grade(open_, found).withColumn("round", F.lit(number)), "verdicts")
        wanted = F.col("tier") == "irrelevant"
        if revise is not None:
            wanted = wanted | (F.col("tier") == "insufficient")
        again = verdicts.where(wanted if number < most else F.lit(False)).select("id")
        states.append(verdicts.join(again, "id", "left_anti"))
        chunks.append(found.join(again, "id", "left_anti").withColumn("round", F.lit(number)))
        if number == most:
            break
        open_ = materialize(open_.join(again, "id"), "again")
        if open_.isEmpty():
            break
        config, rewrite = config.expanded(), revise
    every, state = chunks[0], states[0]
    for more, further in zip(chunks[1:], states[1:]):
        every, state = every.unionByName(more), state.unionByName(further)
    return every, state
