"""Queries of search, fusion and selection, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.config import DEFAULT
from corvane.functions import text as T
from corvane.operators import filters as P
from corvane.operators import hybrid as H
from corvane.operators import ingest as I
from corvane.operators import retrieval as R
from corvane.plans.catalog import register
from corvane.plans.ingest_queries import PARENTS, SQL_COMPLEXITY, SQL_HYDE, SQL_QUALITY, SQL_ROUTE, SQL_TYPE, _parents, _sql_summary
from corvane.plans.text_queries import ANSWERS, CHUNKS, ITEMS, SQL_A, _answers, _chunk_rows, _chunks, _items, sql_list, sql_strip
from corvane.session import materialize, table

#: The stated query set: every question whose number is divisible by 50, against all rows.
ASKED = f"(SELECT * FROM {ITEMS} WHERE try_cast(substr(id, 2) AS BIGINT) % 50 = 0)"


def _asked(spark, sf_dir):
    return _items(spark, sf_dir).where("try_cast(substring(id, 2) as bigint) % 50 = 0")


def bm25_sql(docs: str, key: str, text: str, terms: str) -> str:
    """CTEs up to ``scored`` (qid, key, score) for documents and a (qid, token) query."""
    return f"""
    WITH t AS (SELECT {key} AS key, {SQL_A.format(text)} AS toks FROM {docs}),
    n AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM t),
    p AS (SELECT key, dl, token, count(*) AS tf FROM (SELECT key, len(toks) AS dl, unnest(toks) AS token FROM t) GROUP BY key, dl, token),
    raw AS (SELECT token, ln((SELECT n FROM n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p GROUP BY token),
    idf AS (SELECT token, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
    terms AS ({terms}),
    scored AS (SELECT qid, key, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM n)))), 6) AS score
               FROM terms JOIN idf USING (token) JOIN p USING (token) GROUP BY qid, key HAVING score > 0)"""


_TERMS = f"SELECT id AS qid, unnest(u[1:24]) AS token FROM (SELECT id, list_transform(list_filter(list_zip(a, range(1, len(a) + 1)), lambda p: list_position(a, p[1]) = p[2]), lambda p: p[1]) AS u FROM (SELECT id, {SQL_A.format('question')} AS a FROM {ASKED}))"


@register(
    "ret1_dense_exact",
    """SELECT qid, key, score, rank FROM (SELECT qid, key, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM (
       SELECT q.vec_id AS qid, d.vec_id AS key, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS score
       FROM embeddings d, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q)) WHERE rank <= 30""",
)
def ret1(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    found = R.nearest(rows, "vec_id", "embedding", rows.where("vec_id % 50 = 0"), "vec_id", "embedding", DEFAULT.dense_k)
    return found.select("qid", "key", "score", F.col("rank").cast("bigint").alias("rank"))


@register("ret1_dense_cells")
def ret1_cells(spark, sf_dir):
    """The inverted-file index, fitted to at most 20,000 rows and probed to a recall of 0.95 in them; the tests measure it."""
    rows = table(spark, sf_dir, "embeddings")
    cells = R.fit_cells(rows, "embedding", DEFAULT.dense_k)
    return R.nearest_in_cells(rows, "vec_id", "embedding", rows.where("vec_id % 50 = 0"), "vec_id", "embedding", DEFAULT.dense_k, cells)


@register(
    "ret2_bm25_index",
    bm25_sql(CHUNKS, "chunk_id", "page_content", _TERMS)
    + " SELECT token, count(*) AS documents, sum(tf) AS occurrences, round(any_value(idf), 6) AS idf FROM p JOIN idf USING (token) GROUP BY token",
)
def ret2(spark, sf_dir):
    index = R.lexicon(table(spark, sf_dir, "chunks"), "chunk_id", "page_content")
    return index.weights.select("token", "documents", "occurrences", F.round("idf", 6).alias("idf"))


@register(
    "ret3_bm25_top",
    bm25_sql(CHUNKS, "chunk_id", "page_content", _TERMS)
    + " SELECT qid, key, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM scored) WHERE rank <= 30",
)
def ret3(spark, sf_dir):
    found = R.sparse_search(table(spark, sf_dir, "chunks"), "chunk_id", "page_content", _asked(spark, sf_dir), "id", "question", DEFAULT.sparse_k)
    return found.select("qid", "key", "score", F.col("rank").cast("bigint").alias("rank"))


@register(
    "ret3_keyword_tool",
    bm25_sql(CHUNKS, "chunk_id", "page_content", f"SELECT id AS qid, unnest({SQL_A.format('question')}) AS token FROM {ASKED}")
    + " SELECT qid, key, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM scored) WHERE rank <= 5",
)
def ret3_tool(spark, sf_dir):
    found = R.sparse_search(table(spark, sf_dir, "chunks"), "chunk_id", "page_content", _asked(spark, sf_dir), "id", "question", 5, repeat=True)
    return found.select("qid", "key", "score")


DOCS = "(SELECT DISTINCT * EXCLUDE (loaded_at) FROM retrieved_docs)"


def _docs(spark, sf_dir, *columns):
    """The given columns of the retrieved records, each record once; repeated rows agree in all of them."""
    return table(spark, sf_dir, "retrieved_docs").select("retrieval_id", *columns).distinct()


def _rank_lists(docs):
    lists = [docs.where(F.col(c).isNotNull()).select("request_id", "chunk_id", F.col(c).alias("rank")) for c in ("dense_rank", "sparse_rank")]
    return lists[0].unionByName(lists[1])


@register(
    "ret4_rrf",
    f"""SELECT request_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS rrf FROM (
        SELECT request_id, chunk_id, dense_rank AS rank FROM {DOCS} WHERE dense_rank IS NOT NULL UNION ALL SELECT request_id, chunk_id, sparse_rank FROM {DOCS} WHERE sparse_rank IS NOT NULL) GROUP BY request_id, chunk_id""",
)
def ret4(spark, sf_dir):
    fused = R.fuse(_rank_lists(_docs(spark, sf_dir, "request_id", "chunk_id", "dense_rank", "sparse_rank")), ["request_id", "chunk_id"])
    return fused.select("request_id", "chunk_id", F.round("rrf", 9).alias("rrf"))


@register("ret5_document_key", f"SELECT chunk_id, CASE WHEN coalesce(chunk_id, '') <> '' THEN concat_ws('::', coalesce(source, ''), chunk_id) ELSE sha256(coalesce(page_content, '')) END AS key FROM {CHUNKS}", once=True)
def ret5(spark, sf_dir):
    return _chunk_rows(spark, sf_dir).select("chunk_id", R.document_key(F.col("source"), F.col("chunk_id"), F.col("page_content")).alias("key"))


@register(
    "ret6_merge_lists",
    f"""SELECT coalesce(d.retrieval_id, s.retrieval_id) AS retrieval_id, CAST(d.dense_rank AS VARCHAR) AS dense_rank, CAST(s.sparse_rank AS VARCHAR) AS sparse_rank,
        CASE WHEN d.retrieval_id IS NULL THEN 'bm25' WHEN s.retrieval_id IS NULL THEN 'dense' ELSE 'dense,bm25' END AS found_by
        FROM (SELECT * FROM {DOCS} WHERE dense_rank IS NOT NULL) d FULL JOIN (SELECT * FROM {DOCS} WHERE sparse_rank IS NOT NULL) s ON d.retrieval_id = s.retrieval_id""",
)
def ret6(spark, sf_dir):
    docs = _docs(spark, sf_dir, "dense_rank", "sparse_rank")
    dense = docs.where("dense_rank is not null").select("retrieval_id", "dense_rank")
    sparse = docs.where("sparse_rank is not null").select("retrieval_id", "sparse_rank")
    tags = F.array_join(F.array_compact(F.array(F.when(F.col("dense_rank").isNotNull(), "dense"), F.when(F.col("sparse_rank").isNotNull(), "bm25"))), ",")
    ranks = [F.col(c).cast("string").alias(c) for c in ("dense_rank", "sparse_rank")]
    return dense.join(sparse, "retrieval_id", "full").select("retrieval_id", *ranks, tags.alias("found_by"))


_BOOSTED = f"""SELECT d.retrieval_id, d.request_id, d.chunk_id, d.source, d.section_path, d.rrf_score, d.coarse_score, d.rerank_score,
    least(0.15, 0.05 * len(list_filter(list_distinct({SQL_A.format('a.query')}), lambda t: contains(lower(coalesce(d.source, '')), t) OR contains(lower(coalesce(d.section_path, '')), t)))) AS boost
    FROM {DOCS} d JOIN {ANSWERS} a USING (request_id)"""


def _boosted(spark, sf_dir):
    asked = _answers(spark, sf_dir).select("request_id", F.array_distinct(T.tokens_a(F.col("query"))).alias("tokens"))
    rows = _docs(spark, sf_dir, "request_id", "chunk_id", "source", "section_path", "rrf_score", "coarse_score", "rerank_score").join(asked, "request_id")
    return rows.withColumn("boost", R.metadata_boost(F.col("tokens"), F.col("source"), F.col("section_path"))).drop("tokens")


@register("ret7_metadata_boost", f"SELECT retrieval_id, round(boost, 6) AS boost FROM ({_BOOSTED})")
def ret7(spark, sf_dir):
    return _boosted(spark, sf_dir).select("retrieval_id", F.round("boost", 6).alias("boost"))


_COARSE = f"""SELECT *, round(rrf_score + 0.5 * bm25 / CASE WHEN top > 0 THEN top ELSE 1 END + boost, 6) AS coarse FROM (
    SELECT *, max(bm25) OVER (PARTITION BY request_id) AS top FROM (SELECT *, coalesce(coarse_score, 0.0) AS bm25, row_number() OVER (PARTITION BY request_id ORDER BY rrf_score DESC, retrieval_id) AS cand FROM ({_BOOSTED})) WHERE cand <= 50)"""


def _coarse(spark, sf_dir):
    """Candidates by fused rank, then the coarse score; the stored lexical score stands in for BM25."""
    rows = _boosted(spark, sf_dir).withColumn("bm25", F.coalesce("coarse_score", F.lit(0.0)))
    candidates = R.top_k(rows, "request_id", DEFAULT.candidate_k, F.desc("rrf_score"), F.asc("retrieval_id"), name="cand")
    top = F.max("bm25").over(Window.partitionBy("request_id"))
    return candidates.withColumn("coarse", F.round(F.col("rrf_score") + 0.5 * F.col("bm25") / F.when(top > 0, top).otherwise(1.0) + F.col("boost"), 6))


@register("ret8_coarse_cut", f"SELECT retrieval_id, coarse, place FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY coarse DESC, retrieval_id) AS place FROM ({_COARSE})) WHERE place <= 50")
def ret8(spark, sf_dir):
    cut = R.top_k(_coarse(spark, sf_dir), "request_id", DEFAULT.rerank_k, F.desc("coarse"), F.asc("retrieval_id"), name="place")
    return cut.select("retrieval_id", "coarse", F.col("place").cast("bigint").alias("place"))


@register("ret10_confidence_gap", f"SELECT retrieval_id, round(max(s) OVER (PARTITION BY request_id) - s, 9) AS gap FROM (SELECT retrieval_id, request_id, coalesce(rerank_score, coarse_score) AS s FROM {DOCS}) WHERE s IS NOT NULL")
def ret10(spark, sf_dir):
    rows = _docs(spark, sf_dir, "request_id", "rerank_score", "coarse_score").withColumn("s", F.coalesce("rerank_score", "coarse_score")).where("s is not null")
    own = Window.partitionBy("request_id").orderBy(F.desc("s"), "retrieval_id")
    return rows.select("retrieval_id", F.round(F.first("s").over(own) - F.col("s"), 9).alias("gap"))


@register(
    "ret11_diverse",
    f"""WITH RECURSIVE r AS MATERIALIZED (SELECT request_id, retrieval_id, trim(coalesce(source, '')) AS source, trim(coalesce(section_path, '')) AS section, row_number() OVER (PARTITION BY request_id ORDER BY coarse DESC, retrieval_id) AS rank FROM ({_COARSE})),
      walk AS (SELECT request_id, 0::BIGINT AS rank, []::BIGINT[] AS ids, []::VARCHAR[] AS sources, []::VARCHAR[] AS sections FROM r GROUP BY request_id
        UNION ALL SELECT w.request_id, r.rank,
          CASE WHEN ok THEN list_append(ids, r.retrieval_id) ELSE ids END, CASE WHEN ok THEN list_append(sources, r.source) ELSE sources END, CASE WHEN ok THEN list_append(sections, r.section) ELSE sections END
        FROM walk w JOIN r ON r.request_id = w.request_id AND r.rank = w.rank + 1,
        LATERAL (SELECT len(w.ids) < 12 AND (r.source = '' OR len(list_filter(w.sources, lambda x: x = r.source)) < 2) AND (r.section = '' OR len(list_filter(w.sections, lambda x: x = r.section)) < 1) AS ok) o
        WHERE r.rank <= 50),
      done AS (SELECT request_id, ids FROM walk QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY rank DESC) = 1)
      SELECT request_id, retrieval_id AS key, place FROM (SELECT r.request_id, r.retrieval_id, row_number() OVER (PARTITION BY r.request_id ORDER BY CASE WHEN list_contains(d.ids, r.retrieval_id) THEN 0 ELSE 1 END, r.rank) AS place
        FROM r JOIN done d USING (request_id) WHERE r.rank <= 50) WHERE place <= 12""",
)
def ret11(spark, sf_dir):
    own = Window.partitionBy("request_id").orderBy(F.desc("coarse"), "retrieval_id")
    ranked = _coarse(spark, sf_dir).select(
        "request_id", F.row_number().over(own).alias("rank"), F.col("retrieval_id").alias("key"), "source", F.col("section_path").alias("section")
    )
    return R.diverse(ranked, "request_id", DEFAULT.hybrid_k, DEFAULT.max_per_source, DEFAULT.max_per_section)


def _distinct(a: str) -> str:
    """First occurrences of a list, in order."""
    return f"list_transform(list_filter(list_zip({a}, range(1, len({a}) + 1)), lambda p: list_position({a}, p[1]) = p[2]), lambda p: p[1])"


_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.ABBREVIATIONS.items()) + "}"
_VARIANTS = rf"""
  WITH b AS (SELECT id, {sql_strip("coalesce(question, '')")} AS base FROM {ITEMS}),
  c AS (SELECT id, base, {SQL_ROUTE.format('lower(base)')} AS route, {SQL_A.format('base')} AS toks,
        list_filter(list_transform(regexp_split_to_array(base, '(?i)\s*(?:and|以及|同时|并且|,|;|/|\\+|&)\s*'), lambda p: {sql_strip('p')}), lambda p: length(p) >= 8) AS p0 FROM b),
  d AS (SELECT *, list_filter(toks, lambda t: NOT list_contains({sql_list(T.QUERY_STOPWORDS)}, t)) AS k0, list_filter(list_transform(toks, lambda t: {_MAP}[t]), lambda x: x IS NOT NULL) AS a0 FROM c),
  e AS (SELECT id, base, route, {_distinct('k0')}[1:24] AS kept, {_distinct('a0')} AS spelled, {_distinct('p0')} AS parts FROM d),
  f AS (SELECT *, CASE WHEN len(kept) > 0 THEN array_to_string(kept, ' ') ELSE base END AS kw FROM e),
  g AS (SELECT id, base, route, list_concat([kw], CASE WHEN len(spelled) > 0 THEN [base || ' ' || array_to_string(spelled, ' ')] ELSE [] END, ['overview definition background ' || array_to_string(regexp_split_to_array(kw, '\s+')[1:6], ' ')],
        CASE WHEN route = 'compare' AND len(parts) > 1 THEN parts[1:4] ELSE [] END) AS x0 FROM f),
  h AS (SELECT id, base, route, CASE WHEN route = 'default' THEN [] ELSE list_filter(x0, lambda v: v <> '' AND v <> base) END AS x1 FROM g),
  i AS (SELECT id, base, {_distinct('x1')}[1:CASE WHEN route = 'compare' THEN 5 ELSE 3 END] AS x2 FROM h),
  variants AS (SELECT id, unnest(list_concat([base], x2)) AS variant, generate_subscripts(list_concat([base], x2), 1) - 1 AS ordinal FROM i)"""


def variants(items):
    made = items.select("id", F.posexplode(R.query_variants(F.col("question"))).alias("ordinal", "variant"))
    return made.select("id", F.col("ordinal").cast("bigint").alias("ordinal"), "variant")


@register("ret12_variants", _VARIANTS + " SELECT id, ordinal, variant FROM variants")
def ret12(spark, sf_dir):
    return variants(_items(spark, sf_dir))


@register(
    "ret13_multi_query",
    (
        bm25_sql(CHUNKS, "chunk_id", "page_content", "SELECT 1")
        .replace("terms AS (SELECT 1)", _VARIANTS.strip()[5:] + f""",
      vt AS (SELECT id, ordinal, {SQL_A.format('variant')} AS a FROM variants WHERE try_cast(substr(id, 2) AS BIGINT) % 50 = 0),
      terms AS (SELECT id || '#' || ordinal AS qid, unnest({_distinct('a')}[1:24]) AS token FROM vt)""")
        .replace(" n AS (", " nn AS (").replace("FROM n)", "FROM nn)").replace(" p AS (SELECT key", " pp AS (SELECT key").replace("FROM p GROUP BY token", "FROM pp GROUP BY token").replace("JOIN p USING", "JOIN pp USING")
    )
    + """, best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM scored QUALIFY rank <= 15),
      fused AS (SELECT string_split(qid, '#')[1] AS id, key, round(sum(1.0 / (60 + rank)), 9) AS rrf, count(*) AS hits FROM best GROUP BY 1, 2)
      SELECT id, key, rrf, hits FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rrf DESC, key) AS place FROM fused) WHERE place <= 12""",
)
def ret13(spark, sf_dir):
    return multi_query(spark, sf_dir, _asked(spark, sf_dir))


def multi_query(spark, sf_dir, questions):
    """The best chunks of all variants of each question, fused."""
    asked = variants(questions).withColumn("qid", F.concat_ws("#", "id", F.col("ordinal").cast("string")))
    found = R.sparse_search(table(spark, sf_dir, "chunks"), "chunk_id", "page_content", asked, "qid", "variant", DEFAULT.per_query_k)
    lists = found.select(F.split("qid", "#")[0].alias("id"), "key", "rank")
    fused = lists.groupBy("id", "key").agg(F.round(F.sum(1.0 / (DEFAULT.rrf_k + F.col("rank"))), 9).alias("rrf"), F.count("*").alias("hits"))
    return R.top_k(fused, "id", DEFAULT.hybrid_k, F.desc("rrf"), F.asc("key"), name="place").select("id", "key", "rrf", "hits")


def _parent_scores_sql(name: str, docs: str, text: str) -> str:
    body = bm25_sql(docs, "parent_id", text, f"SELECT id AS qid, unnest({SQL_A.format('question')}) AS token FROM {ASKED}")
    return f"""{name} AS (SELECT qid, key, round(score / max(score) OVER (PARTITION BY qid), 6) AS score FROM ({body.strip()} SELECT * FROM scored) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) <= 12)"""


def _parent_scores(docs, text, asked):
    found = R.sparse_search(docs, "parent_id", text, asked, "id", "question", DEFAULT.summary_k, repeat=True)
    top = F.max("score").over(Window.partitionBy("qid"))
    return found.select("qid", "key", F.round(F.col("score") / top, 6).alias("score"))


_SUMMARIES = f"(SELECT * FROM (SELECT parent_id, {_sql_summary('page_content', 900)} AS summary FROM {PARENTS} p) WHERE summary <> '')"
_BASE = bm25_sql(CHUNKS, "chunk_id", "page_content", _TERMS)


@register(
    "ret14_parent_rescoring",
    f"""WITH base AS (SELECT qid, key, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM ({_BASE.strip()} SELECT * FROM scored) QUALIFY rank <= 12),
      norm AS (SELECT qid, key, score / max(score) OVER (PARTITION BY qid) AS score FROM base),
      {_parent_scores_sql('summary', _SUMMARIES, 'summary')}
      SELECT qid, chunk_id, adv FROM (SELECT n.qid, n.key AS chunk_id, round(n.score + 0.35 * coalesce(s.score, 0), 6) AS adv, row_number() OVER (PARTITION BY n.qid ORDER BY round(n.score + 0.35 * coalesce(s.score, 0), 6) DESC, n.key) AS place
      FROM norm n JOIN {CHUNKS} c ON c.chunk_id = n.key LEFT JOIN summary s ON s.qid = n.qid AND s.key = c.parent_id) WHERE place <= 4""",
)
def ret14(spark, sf_dir):
    asked, chunks = _asked(spark, sf_dir), table(spark, sf_dir, "chunks")
    base = R.sparse_search(chunks, "chunk_id", "page_content", asked, "id", "question", DEFAULT.hybrid_k)
    base = base.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy("qid")))
    summaries = table(spark, sf_dir, "parents").select("parent_id", I.extractive_summary(F.col("page_content")).alias("summary")).where("summary <> ''")
    signal = _parent_scores(summaries, "summary", asked).select("qid", F.col("key").alias("parent_id"), F.col("score").alias("signal"))
    rows = base.join(chunks.select(F.col("chunk_id").alias("key"), "parent_id").dropDuplicates(["key"]), "key").join(signal, ["qid", "parent_id"], "left")
    rows = rows.withColumn("adv", F.round(F.col("score") + DEFAULT.summary_weight * F.coalesce("signal", F.lit(0.0)), 6))
    return R.top_k(rows, "qid", DEFAULT.final_k, F.desc("adv"), F.asc("key"), name="place").select("qid", F.col("key").alias("chunk_id"), "adv")


@register(
    "ret15_parent_expansion",
    f"""SELECT d.retrieval_id, length(left(trim(p.page_content), 900)) AS expanded_len, md5(left(trim(p.page_content), 900)) AS digest
        FROM {DOCS} d JOIN {PARENTS} p USING (parent_id) WHERE trim(coalesce(p.page_content, '')) <> '' AND d.coarse_score >= 0.2""",
)
def ret15(spark, sf_dir):
    texts = _parents(spark, sf_dir).select("parent_id", F.substring(F.trim("page_content"), 1, 900).alias("expanded")).where("expanded <> ''")
    rows = _docs(spark, sf_dir, "parent_id", "coarse_score").where("coarse_score >= 0.2").join(texts, "parent_id")
    return rows.select("retrieval_id", F.length("expanded").cast("bigint").alias("expanded_len"), F.md5(F.col("expanded").cast("binary")).alias("digest"))


@register(
    "ret16_chunk_read",
    f"""WITH c AS (SELECT * FROM {CHUNKS}), t AS (SELECT DISTINCT chunk_id, parent_id FROM c WHERE chunk_id IN (SELECT key FROM ({_BASE.strip()} SELECT key FROM scored QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) = 1)))
        SELECT target, sibling, left(text, 200) AS snippet FROM (SELECT t.chunk_id AS target, s.chunk_id AS sibling, s.page_content AS text, row_number() OVER (PARTITION BY t.chunk_id ORDER BY s.chunk_index, s.chunk_id) AS place
        FROM t JOIN c s ON s.parent_id = t.parent_id AND s.chunk_id <> t.chunk_id) WHERE place <= 5""",
)
def ret16(spark, sf_dir):
    chunks = table(spark, sf_dir, "chunks")
    first = R.sparse_search(chunks, "chunk_id", "page_content", _asked(spark, sf_dir), "id", "question", 1)
    targets = chunks.join(first.select(F.col("key").alias("chunk_id")).distinct(), "chunk_id", "left_semi").select(F.col("chunk_id").alias("target"), "parent_id")
    targets = materialize(targets.dropDuplicates(["target"]), "targets")  # one a question at most, so that Spark sees how few they are
    siblings = chunks.select("parent_id", F.col("chunk_id").alias("sibling"), "chunk_index", F.substring("page_content", 1, 200).alias("snippet"))
    met = siblings.join(targets, "parent_id").where("target <> sibling").dropDuplicates(["target", "sibling"])  # repeated chunks meet, but little else
    return R.top_k(met, "target", 5, F.asc("chunk_index"), F.asc("sibling")).select("target", "sibling", "snippet")


@register(
    "ret17_semantic_tool",
    """SELECT qid, key, score FROM (SELECT qid, key, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM (
       SELECT q.vec_id AS qid, d.vec_id AS key, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS score
       FROM embeddings d, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q WHERE q.vec_id <> d.vec_id)) WHERE rank <= 5""",
)
def ret17(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    # one more than wanted, for the query itself is among the rows
    found = R.nearest(rows, "vec_id", "embedding", rows.where("vec_id % 50 = 0"), "vec_id", "embedding", 6).where("qid <> key").drop("rank")
    return R.top_k(found, "qid", 5, F.desc("score"), F.asc("key")).select("qid", "key", "score")


_KEYWORDS = f"list_distinct(list_filter({SQL_A.format('question')}, lambda t: length(t) >= 3 AND NOT list_contains({sql_list(T.FOCUS_STOPWORDS)}, t)))"


@register(
    "join14_gap_fill",
    f"""WITH q AS (SELECT id, {_KEYWORDS} AS ks FROM {ASKED}), k AS (SELECT id, len(ks) AS n, unnest(ks) AS token FROM q), d AS (SELECT chunk_id, unnest(list_distinct({SQL_A.format('page_content')})) AS token FROM {CHUNKS}),
        s AS (SELECT id, chunk_id, round(count(*) / any_value(n), 6) AS score FROM k JOIN d USING (token) GROUP BY id, chunk_id), b AS (SELECT *, max(score) OVER (PARTITION BY id) AS best FROM s)
        SELECT id, chunk_id, score, CASE WHEN place = 1 THEN 2 ELSE 1 END AS relevance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk_id) AS place FROM b WHERE score >= greatest(0.5, 0.99 * best)) WHERE place <= 3""",
)
def join14(spark, sf_dir):
    """Chunks that hold most of a question's key words; found by the words, not by comparing all with all."""
    keywords = F.array_distinct(F.filter(T.without_stopwords(T.tokens_a(F.col("question")), "focus"), lambda t: F.length(t) >= 3))
    asked = _asked(spark, sf_dir).select("id", keywords.alias("ks")).select("id", F.size("ks").alias("n"), F.explode("ks").alias("token"))
    held = _chunks(spark, sf_dir).select("chunk_id", F.explode(F.array_distinct(T.tokens_a(F.col("page_content")))).alias("token"))
    scored = held.join(asked, "token").groupBy("id", "chunk_id").agg(F.round(F.count("*") / F.max("n"), 6).alias("score"))
    good = scored.withColumn("best", F.max("score").over(Window.partitionBy("id"))).where("score >= greatest(0.5, 0.99 * best)")
    top = R.top_k(good, "id", 3, F.desc("score"), F.asc("chunk_id"))
    return top.select("id", "chunk_id", "score", F.when(F.col("rank") == 1, 2).otherwise(1).cast("bigint").alias("relevance"))


ENTRIES = "(SELECT DISTINCT * EXCLUDE (loaded_at) FROM evidence_entries)"


def _entries(spark, sf_dir, *columns):
    """The given columns of the evidence entries, each entry once; a score that isn't a number is none."""
    rows = table(spark, sf_dir, "evidence_entries").select("entry_id", *columns).distinct()
    return rows.withColumn("score", F.when(~F.isnan("score"), F.col("score"))) if "score" in columns else rows


@register(
    "ret18_evidence_budget",
    f"""SELECT request_id, entry_id, place FROM (SELECT request_id, entry_id, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN isnan(score) THEN NULL ELSE score END DESC NULLS LAST, seq, entry_id) AS place FROM {ENTRIES}) WHERE place <= 5""",
)
def ret18(spark, sf_dir):
    kept = R.evidence_budget(_entries(spark, sf_dir, "request_id", "score", "seq"), ["request_id"], "score", ["seq", "entry_id"], DEFAULT.evidence_capacity)
    return kept.select("request_id", "entry_id", F.col("place").cast("bigint").alias("place"))


@register(
    "ret19_best_score",
    f"""SELECT retrieval_id, coalesce(rerank_score, rrf_score, coarse_score, 0.0) AS score, CASE WHEN rerank_score IS NOT NULL THEN 'rerank' WHEN rrf_score IS NOT NULL THEN 'rrf' WHEN coarse_score IS NOT NULL THEN 'coarse' ELSE 'none' END AS stage FROM {DOCS}""",
)
def ret19(spark, sf_dir):
    score, stage = R.best_score(F.col("rerank_score"), F.col("rrf_score"), F.col("coarse_score"))
    return _docs(spark, sf_dir, "rerank_score", "rrf_score", "coarse_score").select("retrieval_id", score.alias("score"), stage.alias("stage"))


# ---- the whole flow -------------------------------------------------------------------------
_VECTOR_TOKENS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')"
_OR_EMPTY = "CASE WHEN len({0}) > 0 THEN {0} ELSE [''] END"


def _parent_signal_sql(docs: str, text: str, asked: str) -> str:
    body = bm25_sql(docs, "parent_id", text, f"SELECT id AS qid, unnest({SQL_A.format('question')}) AS token FROM {asked}")
    return f"(SELECT qid AS id, key AS parent_id, round(score / max(score) OVER (PARTITION BY qid), 6) AS score FROM (SELECT * FROM ({body.strip()} SELECT * FROM scored) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) <= 12))"


def _flow_sql() -> str:
    """CTEs up to ``final``: the first round for the asked questions."""
    sparse = bm25_sql(CHUNKS, "chunk_id", "page_content", f"SELECT qid, unnest({_distinct('a')}[1:24]) AS token FROM (SELECT qid, {SQL_A.format('variant')} AS a FROM vq)")
    signed = "CASE WHEN CAST('0x' || substr(d, 2 * ((i + 7) % 32) + 1, 2) AS INT) % 2 = 0 THEN 1 ELSE -1 END * CAST('0x' || substr(d, 2 * i + 1, 2) AS INT)"
    policy = lambda slot: "CASE route " + " ".join(f"WHEN '{row[0]}' THEN {row[slot]}" for row in P.EXPAND) + " END"
    return f"""WITH RECURSIVE asked AS MATERIALIZED (SELECT * FROM {ASKED}), {_VARIANTS.strip()[5:]},
  vq AS MATERIALIZED (SELECT v.id, ordinal, v.id || '#' || ordinal AS qid, variant FROM variants v JOIN ({SQL_COMPLEXITY}) x ON x.id = v.id WHERE v.id IN (SELECT id FROM asked) AND (x.needs_fanout OR ordinal = 0)),
  tk AS (SELECT kind, key, unnest({_OR_EMPTY.format('a')}) AS token FROM (SELECT 'c' AS kind, chunk_id AS key, {_VECTOR_TOKENS.format('page_content')} AS a FROM {CHUNKS} UNION ALL SELECT 'q', qid, {_VECTOR_TOKENS.format('variant')} FROM vq)),
  tn AS MATERIALIZED (SELECT kind, key, token, count(*) AS n FROM tk GROUP BY ALL),
  td AS MATERIALIZED (SELECT token, i, {signed} AS s FROM (SELECT token, sha256(token) AS d FROM (SELECT DISTINCT token FROM tn)), range(0, 32) r(i)),
  ts AS (SELECT kind, key, i, sum(n * s) AS s FROM tn JOIN td USING (token) GROUP BY kind, key, i),
  tv AS MATERIALIZED (SELECT kind, key, list(CAST(CAST(x AS FLOAT) AS DOUBLE) ORDER BY i) AS v FROM (SELECT kind, key, i, s / greatest(sqrt(sum(s * s) OVER (PARTITION BY kind, key)) * sqrt(2.0), 1e-300) AS x FROM ts) GROUP BY kind, key),
  dense AS (SELECT qid, key, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM (SELECT q.key AS qid, c.key, round(list_cosine_similarity(q.v, c.v), 6) AS score FROM tv q, tv c WHERE q.kind = 'q' AND c.kind = 'c') QUALIFY rank <= 30),
  sparse AS (SELECT qid, key, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM ({sparse.strip()} SELECT * FROM scored) QUALIFY rank <= 30),
  merged AS (SELECT qid, key, dense.rank AS dr, sparse.rank AS sr, score AS bm25 FROM dense FULL JOIN sparse USING (qid, key)),
  ranks AS (SELECT *, round(coalesce(1.0 / (60 + dr), 0) + coalesce(1.0 / (60 + sr), 0), 9) AS rrf, max(bm25) OVER (PARTITION BY qid) AS top FROM merged),
  good AS (SELECT r.*, k.source, k.section_path, list_distinct({SQL_A.format('vq.variant')}) AS toks FROM ranks r JOIN (SELECT *, {sql_strip("coalesce(page_content, '')")} AS t FROM {CHUNKS}) k ON k.chunk_id = r.key JOIN vq USING (qid) WHERE {SQL_QUALITY}),
  cand AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, key) <= 50),
  coarse AS MATERIALIZED (SELECT qid, key, trim(coalesce(source, '')) AS source, trim(coalesce(section_path, '')) AS section, round(rrf + 0.5 * coalesce(bm25 / top, 0) + least(0.15, 0.05 * len(list_filter(toks, lambda t: contains(lower(coalesce(source, '')), t) OR contains(lower(coalesce(section_path, '')), t)))), 9) AS score FROM cand),
  ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank, round(max(score) OVER (PARTITION BY qid) - score, 9) AS gap FROM coarse),
  walk AS (SELECT qid, 0::BIGINT AS rank, []::VARCHAR[] AS ids, []::VARCHAR[] AS sources, []::VARCHAR[] AS sections FROM ranked GROUP BY qid
    UNION ALL SELECT w.qid, r.rank, CASE WHEN ok THEN list_append(ids, r.key) ELSE ids END, CASE WHEN ok THEN list_append(sources, r.source) ELSE sources END, CASE WHEN ok THEN list_append(sections, r.section) ELSE sections END
    FROM walk w JOIN ranked r ON r.qid = w.qid AND r.rank = w.rank + 1,
    LATERAL (SELECT len(w.ids) < 12 AND (r.source = '' OR len(list_filter(w.sources, lambda x: x = r.source)) < 2) AND (r.section = '' OR len(list_filter(w.sections, lambda x: x = r.section)) < 1) AS ok) o WHERE r.rank <= 50),
  picked AS (SELECT qid, ids FROM walk QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank DESC) = 1),
  diverse AS (SELECT r.qid, r.key, r.score, r.gap, row_number() OVER (PARTITION BY r.qid ORDER BY CASE WHEN list_contains(p.ids, r.key) THEN 0 ELSE 1 END, r.rank) AS place FROM ranked r JOIN picked p USING (qid) WHERE r.rank <= 50 QUALIFY place <= 12),
  fused AS (SELECT vq.id, x.key, round(sum(1.0 / (60 + place)), 9) AS fused, arg_min(score, ordinal) AS score, arg_min(gap, ordinal) AS gap FROM diverse x JOIN vq USING (qid) GROUP BY vq.id, x.key),
  best AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fused DESC, key) AS place FROM fused QUALIFY place <= 12),
  summary AS MATERIALIZED {_parent_signal_sql(_SUMMARIES, 'summary', 'asked')}, hyde AS MATERIALIZED {_parent_signal_sql(f'({SQL_HYDE})', 'question', 'asked')},
  adv AS (SELECT b.id, b.key, b.place, b.gap, k.parent_id, coalesce(s.score, 0.0) AS summary, coalesce(h.score, 0.0) AS hyde, round(b.score + 0.35 * coalesce(s.score, 0.0) + 0.35 * coalesce(h.score, 0.0), 9) AS adv, nullif(trim(coalesce(p.page_content, '')), '') AS parent_text,
      length(coalesce(k.page_content, '')) AS chars, CASE WHEN {SQL_TYPE.format("lower(coalesce(a.question, ''))")} = 'numeric' THEN 'numeric' ELSE {SQL_ROUTE.format("lower(coalesce(a.question, ''))")} END AS route
    FROM best b JOIN {CHUNKS} k ON k.chunk_id = b.key JOIN asked a ON a.id = b.id LEFT JOIN summary s ON s.id = b.id AND s.parent_id = k.parent_id LEFT JOIN hyde h ON h.id = b.id AND h.parent_id = k.parent_id LEFT JOIN {PARENTS} p ON p.parent_id = k.parent_id),
  pol AS (SELECT *, place - 1 < {policy(1)} AS room, CASE WHEN {policy(3)} > 0 THEN greatest(summary, hyde) >= {policy(3)} ELSE greatest(summary, hyde) > 0 END AS strong, gap <= {policy(4)} AS near, chars <= {policy(5)} AS short, {policy(2)} AS most FROM adv),
  reasoned AS (SELECT *, CASE WHEN parent_text IS NULL OR NOT room THEN '' WHEN route IN ('compare', 'background', 'procedure') THEN CASE WHEN strong THEN 'parent_signal' WHEN near THEN 'near_top' WHEN short THEN 'short_chunk' ELSE '' END
      WHEN route = 'numeric' THEN CASE WHEN strong AND near AND short THEN 'numeric_backing' ELSE '' END WHEN strong AND near THEN 'default_signal' WHEN near AND short THEN 'default_short_chunk' ELSE '' END AS reason FROM pol),
  final AS (SELECT id, key, row_number() OVER (PARTITION BY id ORDER BY adv DESC, place) AS last, adv, summary, hyde, reason, CASE WHEN reason <> '' THEN md5(left(parent_text, most)) END AS expanded FROM reasoned QUALIFY last <= 4)"""


def corpus(spark, sf_dir):
    """The chunks and parents of the tables with their indexes."""
    chunks = table(spark, sf_dir, "chunks").select("chunk_id", "source", F.col("section_path").alias("section"), "parent_id", F.col("page_content").alias("text"))
    parents = table(spark, sf_dir, "parents").select("parent_id", F.col("section_path").alias("section"), F.col("page_content").alias("text"))
    return H.index(chunks, parents)


def hybrid_flow(spark, sf_dir, asked):
    """Questions to their final chunks through the whole of retrieval."""
    found = H.retrieve(corpus(spark, sf_dir), asked.select("id", "question"))
    return found.select("id", "key", F.col("place").cast("bigint").alias("place"), "adv", "summary", "hyde", "reason", F.md5(F.col("expanded").cast("binary")).alias("expanded"))


@register("flow_hybrid", _flow_sql() + " SELECT id, key, last AS place, adv, summary, hyde, reason, expanded FROM final")
def flow(spark, sf_dir):
    return hybrid_flow(spark, sf_dir, _asked(spark, sf_dir))


def _rounds(spark, sf_dir):
    """Rounds of retrieval and grading for every question: (chunks, state).  Equal wordings are run once, under their first id."""
    items = _items(spark, sf_dir).select("id", "question").withColumn("first", F.min("id").over(Window.partitionBy("question")))
    items = materialize(items, "wordings")
    same = items.select(F.col("first"), F.col("id").alias("own"))
    return [
        rows.withColumnRenamed("id", "first").join(same, "first").withColumnRenamed("own", "id")
        for rows in H.rounds(corpus(spark, sf_dir), items.where("id = first").select("id", "question"))
    ]


@register("ret21_expanded_round")
def ret21(spark, sf_dir):
    """Rounds of retrieval and grading: irrelevant results are searched for again with every k doubled."""
    return _rounds(spark, sf_dir)[1].select("id", "round", "tier", "sufficient", "reason")


@register("ret21_expanded_chunks")
def ret21_chunks(spark, sf_dir):
    """The chunks of each question's last round."""
    return _rounds(spark, sf_dir)[0].select("id", "round", "key", F.col("place").cast("bigint").alias("place"), "adv")
