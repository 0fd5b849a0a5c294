"""The batch facade: index a folder, ask questions, and report on an index."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.config import DEFAULT, RetrievalConfig
from corvane.operators import filters as P
from corvane.operators import hybrid as H
from corvane.operators import ingest as I
from corvane.operators import retrieval as R
from corvane.operators.hybrid import Embedding, Model
from corvane.operators.models import Tool
from corvane.sources.files import scan_documents
from corvane.sources.manifest import diff_manifest, source_digests, upsert


def build_chunks(documents: DataFrame, config: RetrievalConfig = DEFAULT, cut=I.seeking_chunks) -> tuple[DataFrame, DataFrame]:
    """Parents and cleaned, named chunks of (source, file_type, text) documents.

    ``cut`` makes (parent_id, chunk_index, start_index, text) rows of parents; a model's chunker can take its place.
    """
    named = documents.where("text is not null").select(F.col("source").alias("doc"), "source", "file_type", "text")
    parents = I.parents(named, "doc", "text", "source", "file_type").drop("doc")
    rows = cut(parents, "parent_id", "text").join(parents.select("parent_id", "source", "section_path", "start_char"), "parent_id").withColumn("text", I.clean_noise(F.col("text")))
    kept = rows.where(P.long_enough(F.col("text"), config.ingest_min_chars) & ~P.is_junk(F.col("text")))
    start = F.col("start_char") + F.col("start_index")
    return parents, kept.select(
        I.chunk_id(F.col("source"), start, F.col("text")).alias("chunk_id"), "chunk_index", "parent_id", "source", "section_path", start.alias("start_index"), "text"
    )


class Engine:
    """Chunks and parents of a corpus with the plans over them; the models are pluggable, none is needed.

    ``rewrite`` gives other wordings of questions whose documents are insufficient, ``rerank`` scores of candidates,
    ``embed`` vectors of texts.
    """

    def __init__(
        self, spark: SparkSession, chunks: DataFrame, parents: DataFrame, config: RetrievalConfig = DEFAULT, rewrite: Model | None = None, rerank: Model | None = None, embed: Embedding = I.hash_vectors
    ):
        self.spark, self.chunks, self.parents, self.config = spark, chunks, parents, config
        self.rewrite, self.rerank, self.embed = rewrite, rerank, embed
        self._corpus: H.Corpus | None = None

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str, config: RetrievalConfig = DEFAULT, **models) -> Engine:
        parents, chunks = build_chunks(scan_documents(spark, folder).where("error is null"), config)
        return cls(spark, chunks, parents, config, **models)

    @property
    def corpus(self) -> H.Corpus:
        """The indexes, made when they are first needed."""
        if self._corpus is None:
            chunks = self.chunks.select("chunk_id", "source", F.col("section_path").alias("section"), "parent_id", "text")
            parents = self.parents.select("parent_id", F.col("section_path").alias("section"), "text")
            self._corpus = H.index(chunks, parents, self.embed)
        return self._corpus

    def ask(self, questions: DataFrame, most_rounds: int = 2) -> DataFrame:
        """(id, key, place, adv, expanded, level, round, tier, ...) of the final chunks of (id, question) rows.

        All questions of a round are one plan.  Questions that need no retrieval give no rows.
        """
        routed = questions.withColumn("c", P.complexity(F.col("question"))).where("c.needs_retrieval")
        chunks, state = H.rounds(self.corpus, routed.select("id", "question"), self.config, most_rounds, self.rewrite, self.rerank)
        return chunks.join(state.select("id", "tier", "sufficient"), "id").join(routed.select("id", F.col("c.level").alias("level")), "id")

    def tools(self, most: int = 5) -> dict[str, Tool]:
        """The searches a planner may call, by name; each returns at most ``most`` rows as JSON."""
        shown = lambda rows, *columns: json.dumps([r.asDict() for r in rows.select(*columns, F.substring("text", 1, 200).alias("snippet")).collect()], ensure_ascii=False)
        texts = self.corpus.chunks.withColumnRenamed("chunk_id", "key")
        one = lambda query: self.spark.createDataFrame([("1", query)], "qid string, text string")

        def semantic_search(query: str) -> str:
            found = H.hybrid(self.corpus, one(query), self.config, self.rerank).where(F.col("place") <= most)
            return shown(found.join(texts, "key").orderBy("place"), "key", "source", "section", "score")

        def keyword_search(query: str) -> str:
            found = R.search(self.corpus.words, one(query), "qid", "text", most, repeat=True)
            return shown(found.join(texts, "key").orderBy("rank"), "key", "source", "section", "score")

        def structured_lookup(source: str = "", section: str = "") -> str:
            rows = P.structured_lookup(self.corpus.chunks.withColumn("section_path", F.col("section")), source, section)
            return shown(rows.limit(most), "chunk_id", "source", "section")

        def chunk_read(chunk_id: str) -> str:
            own = self.chunks.where(F.col("chunk_id") == chunk_id).select("parent_id")
            siblings = self.chunks.join(own, "parent_id", "left_semi")
            # the chunk itself first, then its neighbours in order
            return shown(siblings.orderBy(F.col("chunk_id") != chunk_id, "chunk_index").limit(most + 1), "chunk_id", "source", "section_path")

        return {f.__name__: f for f in (semantic_search, keyword_search, structured_lookup, chunk_read)}

    def update(self, documents: DataFrame) -> Engine:
        """An engine in which the changed and deleted sources of ``documents``, a whole corpus, are brought up to date."""
        parents, chunks = build_chunks(documents, self.config)
        now, before = (source_digests(c, "source", "chunk_id", "text") for c in (chunks, self.chunks))
        state = diff_manifest(now, before, "source")
        deleted = state.where("state = 'deleted'").select("source")
        fresh = state.where("state in ('added', 'changed')").select("source")
        pick = lambda new, old: upsert(old, new.join(fresh, "source", "left_semi"), "source", deleted)
        return Engine(self.spark, pick(chunks, self.chunks), pick(parents, self.parents), self.config, self.rewrite, self.rerank, self.embed)

    def status(self) -> DataFrame:
        """Chunks and parents of each source."""
        count = lambda df, a, b: df.select("source", F.lit(a).alias("chunks"), F.lit(b).alias("parents"))
        both = count(self.chunks, 1, 0).unionByName(count(self.parents, 0, 1))
        return both.groupBy("source").agg(F.sum("chunks").alias("chunks"), F.sum("parents").alias("parents"))
