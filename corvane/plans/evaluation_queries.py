"""Queries of joins, metrics, grading and gates, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import evaluation as E
from corvane.operators import filters as P
from corvane.operators import grading as G
from corvane.operators import retrieval as R
from corvane.plans.catalog import register
from corvane.plans.ingest_queries import CLAIMS, MARKED, PARENTS, SQL_JUNK, SQL_TYPE, _any, _parents, claims, marked, sql_claims
from corvane.plans.retrieval_queries import DOCS, ENTRIES, _docs, _entries
from corvane.plans.text_queries import (
    ANSWERS, CHUNKS, ITEMS, SQL_A, SQL_B, SQL_DOMAIN_NUMBERS, SQL_GATE_NUMBERS, _answer_rows, _answers, _chunks, _items, sql_list, sql_relevancy, sql_squeeze, sql_strip, sql_support,
)
from corvane.session import materialize, table

KS = (1, 3, 5)

# Retrieved rows in their final order, with content, and the judgements of each request: the chunks its answer
# cites (relevance 2) and the gold texts of its item (relevance 1).
_RETRIEVED = f"""retrieved AS (SELECT d.request_id, row_number() OVER (PARTITION BY d.request_id ORDER BY coalesce(d.rerank_score, d.coarse_score) DESC NULLS LAST, d.retrieval_id) AS position,
    d.chunk_id, trim(coalesce(c.source, '')) AS source, trim(coalesce(c.section_path, '')) AS section, trim(coalesce(c.parent_id, '')) AS parent_id, {sql_squeeze('c.page_content')} AS content,
    {sql_squeeze('left(p.page_content, 900)')} AS expanded, d.dense_rank, d.sparse_rank, d.rrf_score, d.rerank_score FROM {DOCS} d LEFT JOIN {CHUNKS} c USING (chunk_id) LEFT JOIN {PARENTS} p ON p.parent_id = c.parent_id)"""
_JUDGED = f"""cited AS (SELECT DISTINCT request_id, c.chunk_id AS chunk_id FROM (SELECT request_id, unnest(citations) AS c FROM {ANSWERS}) WHERE c.chunk_id IS NOT NULL),
  gold AS (SELECT DISTINCT a.request_id, {sql_squeeze('g')} AS text FROM {ANSWERS} a JOIN (SELECT id, unnest(ground_truth_contexts) AS g FROM {ITEMS}) q ON q.id = a.item_id),
  by_chunk AS (SELECT c.request_id, 'chunk ' || c.chunk_id AS qrel_id, c.chunk_id, trim(coalesce(k.source, '')) AS source, trim(coalesce(k.section_path, '')) AS section, trim(coalesce(k.parent_id, '')) AS parent_id, {sql_squeeze('k.page_content')} AS text, 2 AS relevance FROM cited c LEFT JOIN {CHUNKS} k USING (chunk_id)),
  judged AS (SELECT * FROM by_chunk UNION ALL SELECT DISTINCT request_id, 'place ' || md5(source || '|' || section), NULL, source, section, '', 'not looked at', 1 FROM by_chunk WHERE source <> ''
    UNION ALL SELECT request_id, 'text ' || md5(text), NULL, '', '', '', text, 1 FROM gold WHERE text <> '')"""
_EITHER = "j.text <> '' AND (r.content <> '' AND (contains(r.content, j.text) OR contains(j.text, r.content)) OR r.expanded <> '' AND (contains(r.expanded, j.text) OR contains(j.text, r.expanded)))"
_MATCHES = f"""matches AS (SELECT request_id, position, qrel_id, relevance, tier FROM (SELECT r.request_id, r.position, j.qrel_id, j.relevance,
    CASE WHEN r.chunk_id = j.chunk_id THEN 'chunk'
      WHEN j.source || j.section || j.parent_id <> '' THEN CASE WHEN (j.source = '' OR j.source = r.source) AND (j.section = '' OR j.section = r.section) AND (j.parent_id = '' OR j.parent_id = r.parent_id)
        AND (j.chunk_id IS NULL OR ({_EITHER})) THEN 'place' END
      WHEN j.chunk_id IS NULL AND ({_EITHER}) THEN 'text' END AS tier
    FROM retrieved r JOIN judged j USING (request_id)) WHERE tier IS NOT NULL)"""
_WITH = f"WITH {_RETRIEVED}, {_JUDGED}, {_MATCHES}"


def _placed_texts(spark, sf_dir, name: str):
    return _chunks(spark, sf_dir).select(
        "chunk_id", *(F.trim(T.text(F.col(c))).alias(n) for c, n in (("source", "source"), ("section_path", "section"), ("parent_id", "parent_id"))), T.squeeze(F.col("page_content")).alias(name)
    )


def _retrieved(spark, sf_dir):
    place = Window.partitionBy("request_id").orderBy(F.desc_nulls_last(F.coalesce("rerank_score", "coarse_score")), "retrieval_id")
    scores = ["dense_rank", "sparse_rank", "rrf_score", "rerank_score"]
    rows = _docs(spark, sf_dir, "request_id", "chunk_id", "coarse_score", *scores).select("request_id", "chunk_id", *scores, F.row_number().over(place).cast("bigint").alias("position"))
    parents = _parents(spark, sf_dir).select("parent_id", T.squeeze(F.substring("page_content", 1, 900)).alias("expanded"))
    texts = _placed_texts(spark, sf_dir, "content").join(parents, "parent_id", "left")
    return rows.join(texts, "chunk_id", "left").fillna("", ["source", "section", "parent_id", "content", "expanded"])


def _judged(spark, sf_dir):
    """Judgements of each request: the chunks its answer cites, the places of these, and the gold texts of its item."""
    answers, items = _answers(spark, sf_dir), _items(spark, sf_dir)
    cited = answers.select("request_id", F.explode("citations.chunk_id").alias("chunk_id")).where("chunk_id is not null").distinct()
    by_chunk = cited.join(_placed_texts(spark, sf_dir, "text"), "chunk_id", "left").fillna("", ["source", "section", "parent_id", "text"]).select(
        "request_id", F.concat(F.lit("chunk "), "chunk_id").alias("qrel_id"), "chunk_id", "source", "section", "parent_id", "text", F.lit(2).alias("relevance")
    )
    digest = lambda c: F.md5(c.cast("binary"))
    none = F.lit(None).cast("string")
    by_place = by_chunk.where("source <> ''").select("request_id", "source", "section").distinct().select(
        "request_id", F.concat(F.lit("place "), digest(F.concat_ws("|", "source", "section"))).alias("qrel_id"), none.alias("chunk_id"), "source", "section",
        F.lit("").alias("parent_id"), F.lit("not looked at").alias("text"), F.lit(1).alias("relevance"),
    )
    gold = items.select(F.col("id").alias("item_id"), F.explode("ground_truth_contexts").alias("g")).select("item_id", T.squeeze(F.col("g")).alias("text"))
    by_text = answers.select("request_id", "item_id").join(gold, "item_id").where("text <> ''").select("request_id", "text").distinct().select(
        "request_id", F.concat(F.lit("text "), digest(F.col("text"))).alias("qrel_id"), none.alias("chunk_id"),
        *(F.lit("").alias(c) for c in ("source", "section", "parent_id")), "text", F.lit(1).alias("relevance"),
    )
    return by_chunk.unionByName(by_place).unionByName(by_text)


def _matched(spark, sf_dir):
    retrieved, judged = _retrieved(spark, sf_dir), materialize(_judged(spark, sf_dir), "judged")
    return retrieved, judged, materialize(E.match_judgements(retrieved, judged, "request_id"), "matches")


@register("join1_parent_lookup", f"SELECT c.chunk_id, p.parent_type, length(coalesce(p.page_content, '')) AS parent_chars FROM {CHUNKS} c LEFT JOIN {PARENTS} p USING (parent_id)")
def join1(spark, sf_dir):
    parents = _parents(spark, sf_dir).select("parent_id", "parent_type", F.length("page_content").cast("bigint").alias("parent_chars"))
    return _chunks(spark, sf_dir).select("chunk_id", "parent_id").join(parents, "parent_id", "left").select("chunk_id", "parent_type", F.coalesce("parent_chars", F.lit(0)).cast("bigint").alias("parent_chars"))


@register("join3_judgement_matches", _WITH + " SELECT request_id, position, qrel_id, tier FROM matches")
def join3(spark, sf_dir):
    return _matched(spark, sf_dir)[2].select("request_id", "position", "qrel_id", "tier")


def _sql_linked(claims_: str) -> str:
    return f"""WITH c AS (SELECT request_id, ordinal, claim, cited, list_distinct({SQL_B.format('claim')}) AS toks, {SQL_GATE_NUMBERS.format('claim')} AS nums FROM {claims_}),
  e AS (SELECT DISTINCT e.request_id, e.entry_id, e.chunk_id, left(coalesce(k.page_content, ''), 600) AS snippet FROM {ENTRIES} e JOIN {CHUNKS} k USING (chunk_id)),
  s AS (SELECT c.request_id, c.ordinal, e.entry_id, len(list_intersect(c.toks, list_distinct({SQL_B.format('e.snippet')}))) AS common FROM c JOIN e USING (request_id)),
  named AS (SELECT c.request_id, c.ordinal, max(e.entry_id) AS entry_id FROM (SELECT DISTINCT request_id, ordinal, unnest(cited) AS chunk_id FROM c) c JOIN e USING (request_id, chunk_id) GROUP BY c.request_id, c.ordinal, chunk_id),
  best AS (SELECT request_id, ordinal, entry_id FROM s ANTI JOIN named USING (request_id, ordinal) WHERE common > 0 QUALIFY row_number() OVER (PARTITION BY request_id, ordinal ORDER BY common DESC, entry_id) <= 3),
  fallback AS (SELECT s.request_id, s.ordinal, s.entry_id FROM s ANTI JOIN named USING (request_id, ordinal) ANTI JOIN best USING (request_id, ordinal) QUALIFY row_number() OVER (PARTITION BY s.request_id, s.ordinal ORDER BY s.entry_id) = 1),
  links AS (SELECT * FROM named UNION ALL SELECT * FROM best UNION ALL SELECT * FROM fallback)"""


_LINKED = _sql_linked(CLAIMS)


def _snippets(spark, sf_dir):
    texts = _chunks(spark, sf_dir).select("chunk_id", F.substring(T.text(F.col("page_content")), 1, 600).alias("snippet"), "source", "start_index")
    return _entries(spark, sf_dir, "request_id", "chunk_id").join(texts, "chunk_id").withColumnRenamed("entry_id", "evidence_id")


def _links(spark, sf_dir):
    return E.link_claims(claims(_answers(spark, sf_dir)), _snippets(spark, sf_dir), "request_id")


def _linked(links):
    return links.where("evidence_id is not null").select("request_id", "ordinal", F.col("evidence_id").alias("entry_id"))


@register("join4_claim_evidence", _LINKED + " SELECT request_id, ordinal, entry_id FROM links")
def join4(spark, sf_dir):
    return _linked(_links(spark, sf_dir))


@register("join4_cited_evidence", _sql_linked(sql_claims(MARKED)) + " SELECT request_id, ordinal, entry_id FROM links")
def join4_cited(spark, sf_dir):
    """Evidence of claims that name some chunks, which then are the only ones."""
    return _linked(E.link_claims(claims(marked(_answers(spark, sf_dir))), _snippets(spark, sf_dir), "request_id"))


@register(
    "join5_items_with_labels",
    f"""SELECT i.id, coalesce(q.n, 0) AS judgements, {sql_strip("coalesce(i.reference_answer, '')")} = '' AS should_block FROM {ITEMS} i LEFT JOIN (SELECT item_id AS id, count(DISTINCT c.chunk_id) AS n FROM (SELECT item_id, unnest(citations) AS c FROM {ANSWERS}) GROUP BY item_id) q ON q.id = i.id""",
)
def join5(spark, sf_dir):
    cited = _answers(spark, sf_dir).select(F.col("item_id").alias("id"), F.explode("citations.chunk_id").alias("c")).groupBy("id").agg(F.count_distinct("c").alias("n"))
    rows = _items(spark, sf_dir).join(cited, "id", "left")
    return rows.select("id", F.coalesce("n", F.lit(0)).cast("bigint").alias("judgements"), (T.strip(T.text(F.col("reference_answer"))) == "").alias("should_block"))


def _period_metrics(spark, sf_dir, low: str, high: str):
    """Two reports made of the events: per type its mean value and its share of all events."""
    rows = table(spark, sf_dir, "events").where(f"ts >= timestamp'{low}' and ts < timestamp'{high}'")
    total = rows.groupBy().count().withColumnRenamed("count", "total")
    by = rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).crossJoin(F.broadcast(total))  # one row
    both = F.array(
        F.struct(F.concat("event_type", F.lit("_mean")).alias("metric"), F.col("mean").alias("value")),
        F.struct(F.concat("event_type", F.lit("_rate")).alias("metric"), F.round(F.col("n") / F.col("total"), 6).alias("value")),
    )
    return by.select(F.explode(both).alias("m")).select("m.metric", "m.value")


def _period_sql(name: str, low: str, high: str) -> str:
    where = f"ts >= TIMESTAMP '{low}' AND ts < TIMESTAMP '{high}'"
    return f"""{name} AS (SELECT event_type || '_mean' AS metric, round(avg(value), 6) AS value FROM events WHERE {where} GROUP BY event_type
      UNION ALL SELECT event_type || '_rate', round(count(*) / (SELECT count(*) FROM events WHERE {where}), 6) FROM events WHERE {where} GROUP BY event_type)"""


_HALVES = f"WITH {_period_sql('base', '2024-01-01', '2024-01-16')}, {_period_sql('cur', '2024-01-16', '2024-02-01')}"


def _halves(spark, sf_dir):
    return _period_metrics(spark, sf_dir, "2024-01-16", "2024-02-01"), _period_metrics(spark, sf_dir, "2024-01-01", "2024-01-16")


@register("join7_common_metrics", _HALVES + " SELECT metric, cur.value AS current, base.value AS baseline FROM cur JOIN base USING (metric)")
def join7(spark, sf_dir):
    current, base = _halves(spark, sf_dir)
    return current.withColumnRenamed("value", "current").join(base.withColumnRenamed("value", "baseline"), "metric")


@register(
    "join8_report_comparison",
    _HALVES + " SELECT metric, round(coalesce(c.value, 0) - coalesce(b.value, 0), 6) AS delta, CASE WHEN abs(round(coalesce(c.value, 0) - coalesce(b.value, 0), 6)) <= 0.05 THEN 'no change' WHEN coalesce(c.value, 0) > coalesce(b.value, 0) THEN 'improved' ELSE 'regressed' END AS verdict FROM cur c FULL JOIN base b USING (metric)",
)
def join8(spark, sf_dir):
    current, base = _halves(spark, sf_dir)
    rows = current.withColumnRenamed("value", "c").join(base.withColumnRenamed("value", "b"), "metric", "full").fillna(0.0, ["c", "b"])
    delta = F.round(F.col("c") - F.col("b"), 6)
    verdict = F.when(F.abs(delta) <= 0.05, "no change").when(delta > 0, "improved").otherwise("regressed")
    return rows.select("metric", delta.alias("delta"), verdict.alias("verdict"))


#: A small configuration table, as a threshold file gives it.
RULES = (("error_rate", "lower_is_better", 0.0, 0.19, 0.0), ("click_mean", "higher_is_better", 40.0, 0.0, 1.0), ("view_mean", None, 10.0, 20.0, 0.5), ("absent_rate", None, 0.0, 1.0, 0.0))
_RULES = "rules(metric, direction, minimum, maximum, tolerance) AS (VALUES " + ", ".join(f"('{a}', {'NULL' if b is None else repr(b)}, {c}, {d}, {e})" for a, b, c, d, e in RULES) + ")"


def _rules(spark):
    return spark.createDataFrame(list(RULES), "metric string, direction string, minimum double, maximum double, tolerance double")


@register("join9_missing_metrics", _HALVES + f", {_RULES} SELECT metric FROM rules ANTI JOIN cur USING (metric)")
def join9(spark, sf_dir):
    return _rules(spark).join(_halves(spark, sf_dir)[0], "metric", "left_anti").select("metric")


SQL_NEAR = "(abs({v} - {c}) <= {a} OR (abs({c}) > 1e-9 AND abs({v} - {c}) <= {r} * abs({c})))"


@register(
    "join10_unsupported_numbers",
    f"""SELECT request_id, v AS number FROM (SELECT a.request_id, unnest({SQL_DOMAIN_NUMBERS.format('a.report')}) AS v, list_concat({SQL_DOMAIN_NUMBERS.format("array_to_string(coalesce(i.ground_truth_contexts, []), ' ')")}, {SQL_DOMAIN_NUMBERS.format('i.reference_answer')}) AS cs FROM {ANSWERS} a JOIN {ITEMS} i ON i.id = a.item_id)
        WHERE len(list_filter(cs, lambda c: {SQL_NEAR.format(v='v', c='c', a='1e-6', r='0.01')})) = 0""",
)
def join10(spark, sf_dir):
    items = _items(spark, sf_dir).select(
        F.col("id").alias("item_id"),
        F.concat(T.numbers_domain(F.array_join(F.coalesce("ground_truth_contexts", F.array().cast("array<string>")), " ")), T.numbers_domain(F.col("reference_answer"))).alias("given"),
    )
    rows = _answers(spark, sf_dir).select("request_id", "item_id", F.explode(T.numbers_domain(F.col("report"))).alias("number")).join(items, "item_id")
    return rows.where(~F.exists("given", lambda c: T.near(F.col("number"), c, 1e-6, 0.01))).select("request_id", "number")


@register(
    "join11_changed_sources",
    f"""WITH now AS (SELECT source, count(*) || '-' || sum(CAST('0x' || left(md5(concat_ws(chr(0), chunk_id, coalesce(page_content, ''))), 8) AS BIGINT)) || '-' || bit_xor(CAST('0x' || substr(md5(concat_ws(chr(0), chunk_id, coalesce(page_content, ''))), 9, 8) AS BIGINT)) AS digest FROM {CHUNKS} WHERE source IS NOT NULL GROUP BY source),
        before AS (SELECT source, count(*) || '-' || sum(CAST('0x' || left(md5(concat_ws(chr(0), chunk_id, coalesce(page_content, ''))), 8) AS BIGINT)) || '-' || bit_xor(CAST('0x' || substr(md5(concat_ws(chr(0), chunk_id, coalesce(page_content, ''))), 9, 8) AS BIGINT)) AS digest FROM {CHUNKS} WHERE source IS NOT NULL AND chunk_index % 7 <> 3 GROUP BY source)
        SELECT coalesce(n.source, b.source) AS source, CASE WHEN b.source IS NULL THEN 'added' WHEN n.source IS NULL THEN 'deleted' WHEN n.digest = b.digest THEN 'skipped' ELSE 'changed' END AS state FROM now n FULL JOIN before b USING (source)""",
)
def join11(spark, sf_dir):
    """Sources against a manifest; the manifest stands for a state in which every seventh chunk was missing."""
    from corvane.sources.manifest import diff_manifest, source_digests

    chunks = _chunks(spark, sf_dir).where("source is not null")
    digests = lambda rows: source_digests(rows, "source", "chunk_id", "page_content")
    return diff_manifest(digests(chunks), digests(chunks.where("chunk_index % 7 <> 3")), "source")


_GOLD = f"""g AS (SELECT DISTINCT i.id, x.gold, regexp_extract(replace(c.source, chr(92), '/'), '([^/]*)$', 1) AS file FROM (SELECT id, unnest(ground_truth_contexts) AS gold FROM {ITEMS}) i JOIN (SELECT item_id, unnest(citations) AS cit FROM {ANSWERS}) a ON a.item_id = i.id
      JOIN {CHUNKS} c ON c.chunk_id = a.cit.chunk_id, LATERAL (SELECT i.gold AS gold) x WHERE trim(coalesce(i.gold, '')) <> '' AND coalesce(c.source, '') <> '')"""
_SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace(gold, '([.!?。])\s+|\n+', '\1' || chr(1), 'g'), chr(1)), lambda s: {sql_strip('s')}), lambda s: length(s) >= 12)"
_GOLD_WORDS = f"list_distinct(list_filter(regexp_extract_all(lower(gold), '[a-z]{{4,}}'), lambda w: NOT list_contains({sql_list(E.GOLD_STOPWORDS)}, w)))"


@register(
    "join13_gold_chunks",
    f"""WITH {_GOLD}, k AS (SELECT chunk_id, coalesce(page_content, '') AS text, trim(coalesce(section_path, '')) AS section, regexp_extract(replace(coalesce(source, ''), chr(92), '/'), '([^/]*)$', 1) AS file FROM {CHUNKS}),
        w AS (SELECT *, {_SENTENCES} AS sentences, {_GOLD_WORDS} AS words FROM g),
        exact AS (SELECT w.id, w.gold, w.file, min(k.chunk_id) AS chunk_id, 1.0 AS score FROM w JOIN k ON {sql_strip('w.gold')} = {sql_strip('k.text')} GROUP BY w.id, w.gold, w.file),
        scored AS (SELECT w.id, w.gold, w.file, k.chunk_id, round(greatest(coalesce(list_sum(list_transform(list_filter(sentences, lambda s: contains(k.text, left(s, 80))), lambda s: length(s))), 0) / length(w.gold),
            CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda x: contains(lower(k.text), x))) / len(words) ELSE 0 END), 6) AS score FROM w ANTI JOIN exact USING (id, gold, file) JOIN k USING (file)),
        best AS (SELECT * FROM exact UNION ALL SELECT * FROM scored WHERE score >= 0.4 QUALIFY row_number() OVER (PARTITION BY id, gold, file ORDER BY score DESC, chunk_id) = 1),
        extra AS (SELECT b.id, b.gold, b.file, o.chunk_id FROM best b JOIN k ON k.chunk_id = b.chunk_id JOIN k o ON o.file = b.file AND o.section = k.section AND o.chunk_id <> b.chunk_id WHERE k.section <> '' QUALIFY row_number() OVER (PARTITION BY b.id, b.gold, b.file ORDER BY o.chunk_id) <= 2)
        SELECT id, md5(gold) AS gold, file, chunk_id, 2 AS relevance, CAST(score AS DOUBLE) AS score FROM best UNION ALL SELECT id, md5(gold), file, chunk_id, 1, NULL FROM extra""",
)
def join13(spark, sf_dir):
    """The chunk of each gold text of an item in each file its answers cite, and up to two more of the same section."""
    chunks = _chunks(spark, sf_dir).select("chunk_id", F.col("source"), T.text(F.col("page_content")).alias("text"), F.trim(T.text(F.col("section_path"))).alias("section"))
    cited = _answers(spark, sf_dir).select(F.col("item_id").alias("id"), F.explode("citations.chunk_id").alias("chunk_id")).distinct()
    files_ = cited.join(chunks, "chunk_id").where("coalesce(source, '') <> ''").select("id", T.base_name(F.col("source")).alias("file")).distinct()
    gold = _items(spark, sf_dir).select("id", F.explode("ground_truth_contexts").alias("gold")).where("trim(gold) <> ''").distinct()
    found = E.gold_chunks(gold.join(files_, "id"), chunks.withColumn("file", T.base_name(T.text(F.col("source")))), ["id"])
    return found.select("id", F.md5(F.col("gold").cast("binary")).alias("gold"), "file", "chunk_id", "relevance", "score")


@register(
    "join15_paragraph_citations",
    f"""WITH p AS (SELECT request_id, ordinal, list_distinct({SQL_B.format('claim')}) AS toks FROM {CLAIMS}), c AS (SELECT DISTINCT a.request_id, k.chunk_id, left(coalesce(k.page_content, ''), 300) AS snippet FROM (SELECT request_id, unnest(citations) AS c FROM {ANSWERS}) a JOIN {CHUNKS} k ON k.chunk_id = a.c.chunk_id)
        SELECT request_id, ordinal, chunk_id FROM (SELECT p.request_id, p.ordinal, c.chunk_id, len(list_intersect(p.toks, list_distinct({SQL_B.format('c.snippet')}))) AS common FROM p JOIN c USING (request_id)) WHERE common >= 2
        QUALIFY row_number() OVER (PARTITION BY request_id, ordinal ORDER BY common DESC, chunk_id) <= 3""",
)
def join15(spark, sf_dir):
    answers = _answers(spark, sf_dir)
    cited = answers.select("request_id", F.explode("citations.chunk_id").alias("chunk_id")).distinct()
    texts = cited.join(_chunks(spark, sf_dir).select("chunk_id", F.substring(T.text(F.col("page_content")), 1, 300).alias("snippet")), "chunk_id")
    met = claims(answers).join(texts, "request_id").select("request_id", "ordinal", "chunk_id", T.overlap(T.token_set_b(F.col("claim")), T.token_set_b(F.col("snippet"))).alias("common"))
    return R.top_k(met.where("common >= 2"), ["request_id", "ordinal"], 3, F.desc("common"), F.asc("chunk_id")).select("request_id", "ordinal", "chunk_id")


@register("join16_dangling_citations", f"SELECT request_id, c.chunk_id AS chunk_id FROM (SELECT request_id, unnest(citations) AS c FROM {ANSWERS}) a WHERE c.chunk_id NOT IN (SELECT chunk_id FROM {DOCS} d WHERE d.request_id = a.request_id AND chunk_id IS NOT NULL)")
def join16(spark, sf_dir):
    cited = _answers(spark, sf_dir).select("request_id", F.explode("citations.chunk_id").alias("chunk_id")).where("chunk_id is not null")
    return cited.join(_docs(spark, sf_dir, "request_id", "chunk_id").select("request_id", "chunk_id"), ["request_id", "chunk_id"], "left_anti")


_METRICS = _WITH + """, totals AS (SELECT request_id, count(*) FILTER (relevance >= 2) AS prim, count(*) AS every, list(relevance ORDER BY relevance DESC) AS ideal FROM judged GROUP BY request_id),
  first AS (SELECT request_id, qrel_id, min(position) AS position, max(relevance) AS relevance FROM matches GROUP BY request_id, qrel_id),
  hits AS (SELECT f.request_id, count(*) FILTER (position <= 1) AS h1, count(*) FILTER (position <= 3) AS h3, count(*) FILTER (position <= 5) AS h5 FROM first f JOIN totals t USING (request_id) WHERE prim = 0 OR relevance >= 2 GROUP BY f.request_id),
  pos AS (SELECT request_id, position, max(relevance) AS relevance FROM matches GROUP BY request_id, position),
  gains AS (SELECT request_id, min(position) AS first, """ + ", ".join(f"sum(CASE WHEN position <= {k} THEN (pow(2, relevance) - 1) / log2(position + 1) ELSE 0 END) AS d{k}" for k in KS) + """ FROM pos GROUP BY request_id),
  kinds AS (SELECT request_id, count(dense_rank) > 0 AS dense, count(sparse_rank) > 0 AS sparse FROM retrieved GROUP BY request_id),
  lifts AS (SELECT request_id, arg_max(position, (coalesce(rrf_score, 0.0), -position)) - arg_max(position, (coalesce(rerank_score, 0.0), -position)) AS uplift FROM retrieved SEMI JOIN matches USING (request_id, position) GROUP BY request_id),
  per AS (SELECT t.request_id, coalesce(1.0 / first, 0.0) AS mrr, CAST(coalesce(dense, false) AS INT) AS dense_hit_rate, CAST(coalesce(sparse, false) AS INT) AS sparse_hit_rate,
    CAST(coalesce(dense AND sparse AND first IS NOT NULL, false) AS INT) AS hybrid_gain_rate, coalesce(uplift, 0) AS rerank_uplift, """ + ", ".join(f"coalesce(h{k} / CASE WHEN prim > 0 THEN prim ELSE every END, 0.0) AS recall_{k}" for k in KS) + ", " + ", ".join(
    f"round(coalesce(d{k} / list_sum(list_transform(ideal[1:{k}], lambda r, i: (pow(2, r) - 1) / log2(i + 1))), 0.0), 6) AS ndcg_{k}" for k in KS) + " FROM totals t LEFT JOIN hits USING (request_id) LEFT JOIN gains USING (request_id) LEFT JOIN kinds USING (request_id) LEFT JOIN lifts USING (request_id))"


def _metrics(spark, sf_dir):
    retrieved, judged, matches = _matched(spark, sf_dir)
    return E.retrieval_metrics(retrieved, judged, matches, "request_id", KS)


_NAMES = ["mrr", "dense_hit_rate", "sparse_hit_rate", "hybrid_gain_rate", "rerank_uplift", *(f"recall_{k}" for k in KS), *(f"ndcg_{k}" for k in KS)]


@register("agg1_retrieval_metrics", _METRICS + " SELECT request_id, " + ", ".join(f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in _NAMES) + " FROM per")
def agg1(spark, sf_dir):
    return _metrics(spark, sf_dir).select("request_id", *(F.round(n, 6).alias(n) for n in _NAMES))


@register(
    "agg2_metric_slices",
    _METRICS
    + f""", s AS (SELECT a.request_id, unnest(CASE WHEN len(i.tags) > 0 THEN i.tags ELSE [NULL] END) AS tag, {', '.join(f'coalesce(p.{n}, 0.0) AS {n}' for n in _NAMES)} FROM {ANSWERS} a JOIN {ITEMS} i ON i.id = a.item_id LEFT JOIN per p ON p.request_id = a.request_id),
      w AS (SELECT DISTINCT request_id, {', '.join(_NAMES)} FROM s)
      SELECT tag, count(*) AS requests, {', '.join(f'round(avg({n}), 6) AS {n}' for n in _NAMES)} FROM s WHERE trim(coalesce(tag, '')) <> '' GROUP BY tag
      UNION ALL SELECT '(all)', count(*), {', '.join(f'round(avg({n}), 6) AS {n}' for n in _NAMES)} FROM w""",
)
def agg2(spark, sf_dir):
    tagged = _answers(spark, sf_dir).select("request_id", F.col("item_id").alias("id")).join(_items(spark, sf_dir).select("id", "tags"), "id")
    rows = tagged.join(_metrics(spark, sf_dir), "request_id", "left").fillna(0.0, _NAMES)
    # the whole and each tag in one pass over the metrics
    marks = F.concat(F.array(F.lit("(all)")), F.array_compact(F.coalesce("tags", F.array().cast("array<string>"))))
    sliced = rows.withColumn("tag", F.explode(marks)).where(F.trim("tag") != "")
    return sliced.groupBy("tag").agg(F.count("*").alias("requests"), *(F.round(F.avg(n), 6).alias(n) for n in _NAMES))


_LABELLED = f"SELECT a.request_id, a.status <> 'ok' AS blocked, a.failure_reason, {sql_strip("coalesce(i.reference_answer, '')")} = '' AS should_block, i.id IS NOT NULL AS labelled FROM {ANSWERS} a LEFT JOIN {ITEMS} i ON i.id = a.item_id"


def _labelled(spark, sf_dir):
    labels = _items(spark, sf_dir).select(F.col("id").alias("item_id"), (T.strip(T.text(F.col("reference_answer"))) == "").alias("should_block"), F.lit(True).alias("labelled"))
    rows = _answers(spark, sf_dir).join(labels, "item_id", "left")
    return rows.select("request_id", (F.col("status") != "ok").alias("blocked"), "failure_reason", "should_block", F.coalesce("labelled", F.lit(False)).alias("labelled"))


@register(
    "agg3_gate_confusion",
    f"""SELECT round(avg(CASE WHEN blocked THEN 1.0 ELSE 0.0 END), 6) AS block_rate, round(count(*) FILTER (labelled AND blocked AND should_block) / greatest(count(*) FILTER (labelled), 1), 6) AS benefit_rate,
        round(count(*) FILTER (labelled AND blocked AND NOT should_block) / greatest(count(*) FILTER (labelled), 1), 6) AS false_kill_rate, round(count(*) FILTER (labelled AND NOT blocked AND should_block) / greatest(count(*) FILTER (labelled), 1), 6) AS miss_rate FROM ({_LABELLED})""",
)
def agg3(spark, sf_dir):
    b, s, known = F.coalesce("blocked", F.lit(False)), F.coalesce("should_block", F.lit(False)), F.col("labelled")
    bottom = F.greatest(F.count_if(known), F.lit(1))
    return _labelled(spark, sf_dir).agg(
        F.round(F.avg(F.when(b, 1.0).otherwise(0.0)), 6).alias("block_rate"),
        F.round(F.count_if(known & b & s) / bottom, 6).alias("benefit_rate"),
        F.round(F.count_if(known & b & ~s) / bottom, 6).alias("false_kill_rate"),
        F.round(F.count_if(known & ~b & s) / bottom, 6).alias("miss_rate"),
    )


@register("agg3_failure_reasons", f"SELECT CASE WHEN NOT blocked THEN 'ok' WHEN failure_reason IS NULL THEN 'none' ELSE coalesce(nullif(left(failure_reason.message, 80), ''), 'unknown') END AS reason, coalesce(failure_reason.category, '') AS category, count(*) AS n FROM ({_LABELLED}) GROUP BY 1, 2")
def agg3_reasons(spark, sf_dir):
    message = F.coalesce(F.nullif(F.substring("failure_reason.message", 1, 80), F.lit("")), F.lit("unknown"))
    reason = F.when(~F.col("blocked"), "ok").when(F.col("failure_reason").isNull(), "none").otherwise(message)
    return _labelled(spark, sf_dir).groupBy(reason.alias("reason"), T.text(F.col("failure_reason.category")).alias("category")).agg(F.count("*").alias("n"))


#: Prices of a thousand tokens, of prompts and of completions.
PRICES = (0.5, 1.5)


@register(
    "agg4_reliability",
    f"""SELECT round(count(*) FILTER (event_type <> 'error') / greatest(count(*), 1), 6) AS success_rate, round(count(*) FILTER (event_type = 'error') / greatest(count(*), 1), 6) AS error_rate,
       round(count(*) FILTER (event_type = 'error' AND contains(lower(props), '7')) / greatest(count(*), 1), 6) AS timeout_rate, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99,
       round(avg(length(coalesce(props, '')) / 4.0), 6) AS prompt_tokens, round(avg(length(event_type) / 4.0), 6) AS completion_tokens,
       round(avg(length(coalesce(props, '')) / 4.0) / 1000 * {PRICES[0]} + avg(length(event_type) / 4.0) / 1000 * {PRICES[1]}, 9) AS usd, round(count(*) FILTER (user_id % 4 = 0) / greatest(count(*), 1), 6) AS cache_hit_rate FROM events""",
)
def agg4(spark, sf_dir):
    """Events stand for answered requests: errors that name a 7 for timeouts, properties for prompts, types for answers."""
    rows = table(spark, sf_dir, "events").select(
        (F.col("event_type") != "error").alias("ok"), F.contains(F.lower("props"), F.lit("7")).alias("timeout"), F.length(T.text(F.col("props"))).alias("prompt_chars"),
        F.length("event_type").alias("answer_chars"), (F.col("user_id") % 4 == 0).alias("cached"), F.col("value").alias("latency"),
    )
    return E.reliability(rows, _P, PRICES)


@register("agg4_node_latency", "SELECT event_type AS node, count(value) AS n, round(quantile_cont(value, 0.95), 6) AS p95 FROM events WHERE value >= 0 GROUP BY event_type")
def agg4_nodes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("value >= 0").select(F.col("event_type").alias("node"), "value")
    return E.exact_quantiles(rows, ["node"], "value", {"p95": 0.95}).select("node", "n", "p95")


_P = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@register(
    "agg5_latency_stats",
    """SELECT event_type, CASE WHEN grouping(user_group) = 1 THEN -1 ELSE user_group END AS user_group, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, min(value) AS low, max(value) AS high
       FROM (SELECT event_type, user_id % 5 AS user_group, value FROM events) GROUP BY GROUPING SETS ((event_type), (event_type, user_group))""",
)
def agg5(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 5).alias("user_group"), "value")
    whole = E.exact_quantiles(rows, ["event_type"], "value", _P).withColumn("user_group", F.lit(-1).cast("bigint"))
    return E.exact_quantiles(rows, ["event_type", "user_group"], "value", _P).unionByName(whole)


@register("agg6_node_maximum", "SELECT user_id, event_type, max(value) AS value FROM events GROUP BY user_id, event_type")
def agg6(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("value"))


@register("agg7_citation_coverage", f"SELECT status, count(*) AS n, round(avg(CASE WHEN len(list_filter(citations, lambda c: coalesce(c.source, '') <> '' AND coalesce(c.chunk_id, '') <> '' AND contains('/' || replace(c.source, chr(92), '/'), '/corpus/'))) > 0 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM {ANSWERS} GROUP BY status")
def agg7(spark, sf_dir):
    good = F.exists("citations", lambda c: P.valid_citation(c["source"], c["chunk_id"]))
    return _answers(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg(F.when(good, 1.0).otherwise(0.0)), 6).alias("coverage"))


@register(
    "agg8_refusal_rates",
    f"""SELECT round(coalesce(count(*) FILTER (refused AND NOT expected) / nullif(count(*) FILTER (NOT expected), 0), 0.0), 6) AS false_refusal_rate, round(coalesce(count(*) FILTER (refused AND expected) / nullif(count(*) FILTER (expected), 0), 0.0), 6) AS true_refusal_rate
        FROM (SELECT a.status <> 'ok' AS expected, coalesce(len(citations), 0) = 0 AND {_any("lower(coalesce(report, ''))", P.REFUSAL_WORDS)} AS refused FROM {ANSWERS} a)""",
)
def agg8(spark, sf_dir):
    rows = _answers(spark, sf_dir).select((F.col("status") != "ok").alias("expected"), P.is_refusal(F.col("report"), F.col("citations")).alias("refused"))
    rate = lambda c: F.round(F.coalesce(F.try_divide(F.count_if(c & F.col("refused")), F.count_if(c)), F.lit(0.0)), 6)
    return rows.agg(rate(~F.col("expected")).alias("false_refusal_rate"), rate(F.col("expected")).alias("true_refusal_rate"))


_CONTEXTS = "list_concat(coalesce(i.ground_truth_contexts, []), coalesce(i.reference_contexts, []))"
_SUPPORT = rf"""s AS (SELECT request_id, unnest(list_filter(list_transform(regexp_split_to_array(report, '[。！？!?.]+\s*|\n+'), lambda s: {sql_strip('s')}), lambda s: s <> '')) AS sentence, cs FROM (SELECT a.request_id, a.report, {_CONTEXTS} AS cs FROM {ANSWERS} a JOIN {ITEMS} i ON i.id = a.item_id WHERE {sql_strip("coalesce(a.report, '')")} <> '')),
  j AS (SELECT request_id, sentence, cs, {sql_support('sentence')} AS toks FROM s),
  v AS (SELECT request_id, len(toks) = 0 OR len(list_filter(cs, lambda c: coalesce(c, '') <> '' AND ((length(sentence) >= 12 AND contains(c, sentence)) OR (len(list_intersect(toks, {sql_support('c')})) >= 2 AND len(list_intersect(toks, {sql_support('c')})) >= 0.5 * len(toks))))) > 0 AS ok FROM j)"""


@register("agg9_sentence_support", f"WITH {_SUPPORT} SELECT request_id, count(*) AS sentences, count(*) FILTER (ok) AS supported, round(count(*) FILTER (ok) / count(*), 6) AS precision, count(*) FILTER (NOT ok) > 0 AS hallucinated FROM v GROUP BY request_id")
def agg9(spark, sf_dir):
    none = F.array().cast("array<string>")
    gold = _items(spark, sf_dir).select(F.col("id").alias("item_id"), F.concat(F.coalesce("ground_truth_contexts", none), F.coalesce("reference_contexts", none)).alias("contexts"))
    rows = _answers(spark, sf_dir).where(T.strip(T.text(F.col("report"))) != "").join(gold, "item_id")
    said = rows.select("request_id", "contexts", F.explode(T.sentences(F.col("report"))).alias("sentence"))
    judged = said.select("request_id", E.supported(F.col("sentence"), F.col("contexts")).alias("ok"))
    return judged.groupBy("request_id").agg(
        F.count("*").alias("sentences"), F.count_if("ok").alias("supported"), F.round(F.count_if("ok") / F.count("*"), 6).alias("precision"), (F.count_if(~F.col("ok")) > 0).alias("hallucinated")
    )


_GLOSSARY_USED = " + ".join(f"CASE WHEN contains(low, '{t}') THEN 1 ELSE 0 END" for t in E.GLOSSARY)
_GLOSSARY_WRONG = " + ".join(f"CASE WHEN contains(low, '{t}') AND {_any('low', w)} THEN 1 ELSE 0 END" for t, w in E.GLOSSARY.items())


@register(
    "agg10_domain_consistency",
    f"""SELECT request_id, round(CASE WHEN len(ns) > 0 THEN len(list_filter(ns, lambda v: len(list_filter(cs, lambda c: {SQL_NEAR.format(v='v', c='c', a='0.1', r='0.1')})) > 0)) / len(ns) ELSE 1.0 END, 6) AS numeric_score, round(CASE WHEN used > 0 THEN 1.0 - wrong / used ELSE 1.0 END, 6) AS glossary_score
        FROM (SELECT a.request_id, {SQL_DOMAIN_NUMBERS.format('a.report')} AS ns, {SQL_DOMAIN_NUMBERS.format("array_to_string(" + _CONTEXTS + ", ' ')")} AS cs, lower(coalesce(a.report, '')) AS low, {_GLOSSARY_USED} AS used, {_GLOSSARY_WRONG} AS wrong FROM {ANSWERS} a JOIN {ITEMS} i ON i.id = a.item_id)""",
)
def agg10(spark, sf_dir):
    none = F.array().cast("array<string>")
    joined = F.array_join(F.concat(F.coalesce("ground_truth_contexts", none), F.coalesce("reference_contexts", none)), " ")
    gold = _items(spark, sf_dir).select(F.col("id").alias("item_id"), T.numbers_domain(joined).alias("given"))
    rows = _answers(spark, sf_dir).join(gold, "item_id")
    return rows.select(
        "request_id", F.round(E.numeric_score(T.numbers_domain(F.col("report")), F.col("given"), 0.1), 6).alias("numeric_score"), F.round(E.glossary_score(F.col("report")), 6).alias("glossary_score")
    )


@register(
    "join6_enriched_samples",
    f"""WITH {_SUPPORT}, s2 AS (SELECT request_id, count(*) AS sentences, count(*) FILTER (ok) AS supported FROM v GROUP BY request_id),
        g AS (SELECT a.request_id, round(CASE WHEN used > 0 THEN 1.0 - wrong / used ELSE 1.0 END, 6) AS glossary_score FROM (SELECT a.request_id, lower(coalesce(a.report, '')) AS low, {_GLOSSARY_USED} AS used, {_GLOSSARY_WRONG} AS wrong FROM {ANSWERS} a JOIN {ITEMS} i ON i.id = a.item_id) a)
        SELECT a.request_id, a.status, coalesce(s2.sentences, 0) AS sentences, coalesce(s2.supported, 0) AS supported, g.glossary_score FROM {ANSWERS} a LEFT JOIN s2 USING (request_id) LEFT JOIN g USING (request_id)""",
)
def join6(spark, sf_dir):
    support = agg9(spark, sf_dir).select("request_id", "sentences", "supported")
    domain = agg10(spark, sf_dir).select("request_id", "glossary_score")
    rows = _answers(spark, sf_dir).select("request_id", "status").join(support, "request_id", "left").join(domain, "request_id", "left")
    return rows.fillna(0, ["sentences", "supported"])


_Q, _R, _AN = sql_relevancy("a.query"), sql_relevancy("i.reference_answer"), sql_relevancy("a.report")


_RELEVANCY = f"""SELECT request_id, round(CASE WHEN r > 0 THEN greatest(q, 0.6 * q + 0.4 * r) ELSE q END, 6) AS relevancy FROM (
        SELECT request_id, CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, at_)) / len(qt) ELSE 0.0 END AS q, CASE WHEN len(rt) > 0 THEN len(list_intersect(rt, at_)) / len(rt) ELSE 0.0 END AS r FROM (
        SELECT a.request_id, {_Q} AS qt, {_R} AS rt, {_AN} AS at_ FROM {ANSWERS} a LEFT JOIN {ITEMS} i ON i.id = a.item_id WHERE {sql_strip("coalesce(a.report, '')")} <> ''))"""


@register("agg11_answer_relevancy", _RELEVANCY)
def agg11(spark, sf_dir):
    gold = _items(spark, sf_dir).select(F.col("id").alias("item_id"), "reference_answer")
    rows = _answers(spark, sf_dir).where(T.strip(T.text(F.col("report"))) != "").join(gold, "item_id", "left")
    return rows.select("request_id", F.round(E.relevancy(F.col("query"), F.col("report"), F.col("reference_answer")), 6).alias("relevancy"))


_RAISED = " ".join(f"WHEN kind = '{k}' AND token = '{w}' THEN {v}" for k, words in G.KIND_WEIGHTS.items() for w, v in words.items())
_WEIGHT = f"greatest(CASE WHEN list_contains({sql_list(G.CORE_TERMS)}, token) THEN 2.5 WHEN length(token) < 2 OR list_contains({sql_list(T.FOCUS_STOPWORDS)}, token) THEN 0.2 ELSE 1.0 END, CASE {_RAISED} ELSE 0.0 END)"
_NUMBER_TERMS = sql_list(G.NUMBER_TERMS)


@register(
    "agg12_document_grades",
    f"""WITH kinds AS (SELECT request_id, {SQL_TYPE.format("lower(coalesce(query, ''))")} AS kind, list_distinct({SQL_A.format('query')}) AS own FROM {ANSWERS}),
        q AS (SELECT request_id, kind, token, {_WEIGHT} AS w, length(token) >= 2 AND NOT list_contains({sql_list(T.FOCUS_STOPWORDS)}, token) AS focus FROM (SELECT request_id, kind, unnest(own) AS token FROM kinds)),
        total AS (SELECT k.request_id, k.kind, round(coalesce(sum(w), 0), 6) AS total, count(*) FILTER (focus) AS focused, count(*) FILTER (focus AND list_contains({_NUMBER_TERMS}, token)) AS number_focus FROM kinds k LEFT JOIN q USING (request_id) GROUP BY k.request_id, k.kind),
        d AS (SELECT x.request_id, x.retrieval_id AS doc, place, nullif(trim(coalesce(c.source, '')), '') AS source, nullif(trim(coalesce(c.parent_id, '')), '') AS parent_id, gap, lower(coalesce(c.page_content, '')) AS content,
            CASE WHEN place = 1 THEN lower(left(coalesce(p.page_content, ''), 900)) ELSE '' END AS expanded, lower(coalesce(c.section_path, '')) AS section
          FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY coalesce(rerank_score, coarse_score) DESC NULLS LAST, retrieval_id) AS place,
              max(coalesce(rerank_score, coarse_score)) OVER (PARTITION BY request_id) - coalesce(rerank_score, coarse_score) AS gap FROM {DOCS}) x JOIN {CHUNKS} c USING (chunk_id) LEFT JOIN {PARENTS} p ON p.parent_id = c.parent_id),
        t AS (SELECT *, list_distinct({SQL_A.format("CASE WHEN expanded <> '' THEN expanded ELSE content END")}) AS toks, concat_ws(' ', expanded, content, section) AS everything FROM d),
        h AS (SELECT t.request_id, t.doc, round(coalesce(sum(q.w) FILTER (list_contains(t.toks, q.token)), 0), 6) AS hit,
            coalesce(sum(q.w) FILTER (t.place = 1 AND (contains(t.content, q.token) OR contains(t.section, q.token))), 0) AS top FROM t LEFT JOIN q USING (request_id) GROUP BY t.request_id, t.doc),
        g AS (SELECT t.*, total.total, total.kind, total.focused, h.hit, h.top, round(h.hit / greatest(total.total, 8.0), 9) AS isrel,
            regexp_matches(everything, '\\p{{Nd}}') OR (number_focus > 0 AND len(list_intersect({SQL_A.format('everything')}, {_NUMBER_TERMS})) > 0) AS numeric FROM t JOIN h USING (request_id, doc) JOIN total USING (request_id)),
        seen AS (SELECT t.request_id, count(DISTINCT q.token) FILTER (q.focus AND list_contains(t.toks, q.token)) AS seen FROM t LEFT JOIN q USING (request_id) GROUP BY t.request_id),
        cc AS (SELECT request_id, sum(w) AS covered FROM (SELECT DISTINCT q.request_id, q.token, q.w FROM q JOIN t USING (request_id) WHERE contains(t.expanded, q.token) OR contains(t.content, q.token) OR contains(t.section, q.token)) GROUP BY request_id),
        pen AS (SELECT request_id, round(least(sum(CASE WHEN parent_id IS NOT NULL AND n > 3 THEN (n - 3) * 0.05 ELSE 0.0 END), 0.3), 6) AS redundancy_penalty FROM (SELECT request_id, parent_id, count(*) AS n FROM d GROUP BY request_id, parent_id) GROUP BY request_id),
        r AS (SELECT g.request_id, g.kind, count(*) AS documents, max(isrel) AS top_isrel, round(sum(isrel) / count(*) + 1e-10, 6) AS avg_isrel, count(*) FILTER (hit >= 2.0) AS supporting, count(*) FILTER (CASE WHEN gap IS NOT NULL THEN gap <= 0.4 ELSE isrel >= 0.15 END) AS useful,
            count(DISTINCT source) AS sources, count(DISTINCT parent_id) AS parents, bool_or(numeric) AS numeric_evidence, max(pen.redundancy_penalty) AS redundancy_penalty,
            round(CASE WHEN max(focused) > 0 THEN max(seen.seen) / max(focused) ELSE 0.0 END, 9) AS query_coverage, round(CASE WHEN max(total) > 0 THEN coalesce(max(covered), 0) / max(total) ELSE 0.0 END, 9) AS claim_coverage,
            round(max(top) / greatest(max(total), 1.0), 9) AS top_claim_score FROM g JOIN pen USING (request_id) JOIN seen USING (request_id) LEFT JOIN cc USING (request_id) GROUP BY g.request_id, g.kind),
        v AS (SELECT *, CASE WHEN top_isrel < 0.2 OR supporting = 0 THEN 'low_relevance'
            WHEN kind = 'compare' THEN CASE WHEN query_coverage >= 0.3 AND claim_coverage >= 0.4 AND (sources >= 2 OR parents >= 2) AND top_isrel >= 0.35 THEN 'ok_compare' ELSE 'compare_needs_broader_coverage' END
            WHEN kind = 'numeric' THEN CASE WHEN query_coverage >= 0.25 AND claim_coverage >= 0.3 AND numeric_evidence THEN 'ok_numeric' ELSE 'numeric_backing_weak' END
            WHEN kind = 'procedure' THEN CASE WHEN query_coverage >= 0.25 AND claim_coverage >= 0.3 AND parents >= 1 THEN 'ok_procedure' ELSE 'procedure_context_thin' END
            WHEN kind = 'definition' THEN CASE WHEN query_coverage >= 0.3 AND claim_coverage >= 0.4 AND top_claim_score >= 0.5 THEN 'ok_definition' ELSE 'definition_coverage_thin' END
            WHEN query_coverage >= 0.25 AND claim_coverage >= 0.3 AND top_isrel >= 0.3 THEN 'ok' ELSE 'coverage_thin' END AS reason FROM r)
        SELECT *, starts_with(reason, 'ok') AS sufficient, CASE WHEN top_isrel < 0.1 AND claim_coverage < 0.15 THEN 'irrelevant' WHEN top_isrel >= 0.2 AND claim_coverage >= 0.3 THEN 'sufficient' ELSE 'insufficient' END AS tier FROM v""",
)
def agg12(spark, sf_dir):
    score = F.coalesce("rerank_score", "coarse_score")
    own = Window.partitionBy("request_id")
    docs = _docs(spark, sf_dir, "request_id", "chunk_id", "rerank_score", "coarse_score").select(
        "request_id", "chunk_id", F.row_number().over(own.orderBy(F.desc_nulls_last(score), "retrieval_id")).alias("place"), (F.max(score).over(own) - score).alias("gap")
    )
    parents = _parents(spark, sf_dir).select("parent_id", F.substring(T.text(F.col("page_content")), 1, 900).alias("parent_text"))
    texts = _chunks(spark, sf_dir).select("chunk_id", "source", F.col("section_path").alias("section"), "parent_id", F.col("page_content").alias("content")).join(parents, "parent_id", "left")
    rows = docs.join(texts, "chunk_id").withColumn("expanded", F.when(F.col("place") == 1, F.col("parent_text")))
    return G.grade_documents(_answers(spark, sf_dir).select("request_id", "query"), rows, "request_id", "query")


def _sufficiency_sql(expression: str) -> str:
    return f"list_distinct(list_filter({SQL_A.format(expression)}, lambda t: length(t) >= 3 AND NOT list_contains({sql_list(T.SUFFICIENCY_STOPWORDS)}, t)))"


@register(
    "agg13_sufficiency",
    f"""WITH q AS (SELECT request_id, {_sufficiency_sql('query')} AS toks FROM {ANSWERS}), d AS (SELECT x.request_id, {_sufficiency_sql('left(c.page_content, 2000)')} AS toks FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY coalesce(rerank_score, coarse_score) DESC NULLS LAST, retrieval_id) AS place FROM {DOCS}) x JOIN {CHUNKS} c USING (chunk_id) WHERE place <= 4),
        b AS (SELECT q.request_id, len(q.toks) AS n, max(len(list_intersect(q.toks, d.toks))) AS common FROM q LEFT JOIN d USING (request_id) GROUP BY q.request_id, len(q.toks))
        SELECT request_id, round(CASE WHEN n = 0 THEN 1.0 ELSE coalesce(common, 0) / n END, 6) AS best, CASE WHEN n = 0 THEN true ELSE coalesce(common, 0) / n >= 0.2 END AS sufficient FROM b""",
)
def agg13(spark, sf_dir):
    kept = lambda c: F.array_distinct(F.filter(T.without_stopwords(T.tokens_a(c), "sufficiency"), lambda t: F.length(t) >= 3))
    asked = _answers(spark, sf_dir).select("request_id", kept(F.col("query")).alias("q"))
    order = (F.desc_nulls_last(F.coalesce("rerank_score", "coarse_score")), F.asc("retrieval_id"))
    four = R.top_k(_docs(spark, sf_dir, "request_id", "chunk_id", "rerank_score", "coarse_score"), "request_id", 4, *order).select("request_id", "chunk_id")
    texts = four.join(_chunks(spark, sf_dir).select("chunk_id", kept(F.substring("page_content", 1, 2000)).alias("d")), "chunk_id").select("request_id", "d")
    best = asked.join(texts, "request_id", "left").groupBy("request_id", F.size("q").alias("n")).agg(F.coalesce(F.max(T.overlap(F.col("q"), F.col("d"))), F.lit(0)).alias("common"))
    share = F.when(F.col("n") == 0, 1.0).otherwise(F.greatest("common", F.lit(0)) / F.when(F.col("n") > 0, F.col("n")))
    return best.select("request_id", F.round(share, 6).alias("best"), (share >= 0.2).alias("sufficient"))


@register(
    "agg14_index_counts",
    f"""SELECT coalesce(c.source, p.source) AS source, coalesce(c.n, 0) AS chunks, coalesce(p.n, 0) AS parents FROM (SELECT source, count(*) AS n FROM {CHUNKS} GROUP BY source) c FULL JOIN (SELECT source, count(*) AS n FROM {PARENTS} GROUP BY source) p ON c.source IS NOT DISTINCT FROM p.source""",
)
def agg14(spark, sf_dir):
    count = lambda rows, name: rows.select("source", F.lit(1 if name == "chunks" else 0).alias("chunks"), F.lit(1 if name == "parents" else 0).alias("parents"))
    both = count(_chunks(spark, sf_dir), "chunks").unionByName(count(_parents(spark, sf_dir), "parents"))
    return both.groupBy("source").agg(F.sum("chunks").alias("chunks"), F.sum("parents").alias("parents"))


@register("agg15_source_groups", f"SELECT source, count(*) AS n, min(chunk_id) AS first, CAST(sum(length(coalesce(page_content, ''))) AS BIGINT) AS chars FROM {CHUNKS} GROUP BY source")
def agg15(spark, sf_dir):
    chars = F.sum(F.length(T.text(F.col("page_content"))))
    return _chunks(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first"), chars.alias("chars"))


@register(
    "agg16_token_usage",
    """SELECT coalesce(event_type, '(all)') AS model, sum(tokens) AS tokens, sum(prompt) AS prompt_tokens, count(*) AS calls FROM (SELECT event_type, CAST(floor(value) AS BIGINT) AS tokens, CAST(floor(value / 2) AS BIGINT) AS prompt FROM events) GROUP BY ROLLUP (event_type)""",
)
def agg16(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.floor("value").alias("tokens"), F.floor(F.col("value") / 2).alias("prompt"))
    rolled = rows.rollup("event_type").agg(F.sum("tokens").alias("tokens"), F.sum("prompt").alias("prompt_tokens"), F.count("*").alias("calls"))
    return rolled.select(F.coalesce("event_type", F.lit("(all)")).alias("model"), "tokens", "prompt_tokens", "calls")


@register(
    "agg17_budget_stats",
    f"""WITH k AS (SELECT request_id, CASE WHEN isnan(score) THEN NULL ELSE score END AS score, source, round FROM {ENTRIES} QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN isnan(score) THEN NULL ELSE score END DESC NULLS LAST, seq, entry_id) <= 5)
        SELECT request_id, count(*) AS size, max(score) AS best, min(score) AS worst, round(avg(score), 6) AS mean, count(DISTINCT source) AS sources, count(DISTINCT round) AS rounds FROM k GROUP BY request_id""",
)
def agg17(spark, sf_dir):
    kept = R.evidence_budget(_entries(spark, sf_dir, "request_id", "score", "seq", "source", "round"), ["request_id"], "score", ["seq", "entry_id"], 5)
    return kept.groupBy("request_id").agg(
        F.count("*").alias("size"), F.max("score").alias("best"), F.min("score").alias("worst"), F.round(F.avg("score"), 6).alias("mean"), F.count_distinct("source").alias("sources"), F.count_distinct("round").alias("rounds")
    )


@register(
    "agg18_recall_gaps",
    _WITH
    + """, f AS (SELECT j.request_id, count(*) AS gold, count(m.qrel_id) AS hit FROM judged j LEFT JOIN (SELECT DISTINCT request_id, qrel_id FROM matches WHERE position <= 5) m USING (request_id, qrel_id) GROUP BY j.request_id)
      SELECT CASE WHEN hit = 0 THEN 'zero' WHEN hit < gold THEN 'partial' ELSE 'full' END AS kind, count(*) AS requests, CAST(sum(gold) AS BIGINT) AS gold, CAST(sum(hit) AS BIGINT) AS hit FROM f GROUP BY 1""",
)
def agg18(spark, sf_dir):
    _, judged, matches = _matched(spark, sf_dir)
    hit = matches.where("position <= 5").select("request_id", "qrel_id").distinct().withColumn("hit", F.lit(1))
    by = judged.join(hit, ["request_id", "qrel_id"], "left").groupBy("request_id").agg(F.count("*").alias("gold"), F.count("hit").alias("hit"))
    kind = F.when(F.col("hit") == 0, "zero").when(F.col("hit") < F.col("gold"), "partial").otherwise("full")
    return by.groupBy(kind.alias("kind")).agg(F.count("*").alias("requests"), F.sum("gold").alias("gold"), F.sum("hit").alias("hit"))


@register("agg19_run_tokens", "SELECT user_id, CAST(sum(floor(value)) AS BIGINT) AS tokens FROM events GROUP BY user_id")
def agg19(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.floor("value")).alias("tokens"))


#: Metrics that can be computed one by one, by name.
METRIC_REGISTRY = {"citation_coverage": agg7, "refusal_rates": agg8, "answer_relevancy": agg11}


@register("agg20_single_metric", f"SELECT round(avg(relevancy), 6) AS answer_relevancy FROM ({_RELEVANCY})")
def agg20(spark, sf_dir):
    return METRIC_REGISTRY["answer_relevancy"](spark, sf_dir).agg(F.round(F.avg("relevancy"), 6).alias("answer_relevancy"))


# ---- gates ----------------------------------------------------------------------------------
_COUNTS = f"""SELECT a.request_id, a.report, coalesce(d.n, 0) AS docs, coalesce(e.n, 0) AS evidence FROM {ANSWERS} a LEFT JOIN (SELECT request_id, count(*) AS n FROM {DOCS} GROUP BY 1) d USING (request_id) LEFT JOIN (SELECT request_id, count(*) AS n FROM {ENTRIES} GROUP BY 1) e USING (request_id)"""
_REFUSAL = f"""CASE WHEN docs = 0 OR evidence = 0 THEN CASE WHEN length(low) < 20 THEN 'refusal_incomplete' WHEN NOT {_any('low', E.REFUSAL_WORDS)} THEN CASE WHEN docs = 0 THEN 'retrieval_empty' ELSE 'no_evidence' END WHEN NOT {_any('low', E.NEXT_WORDS)} THEN 'refusal_unclear' END END"""


def _counts(spark, sf_dir):
    docs = _docs(spark, sf_dir, "request_id").groupBy("request_id").agg(F.count("*").alias("docs"))
    evidence = _entries(spark, sf_dir, "request_id").groupBy("request_id").agg(F.count("*").alias("evidence"))
    return _answers(spark, sf_dir).join(docs, "request_id", "left").join(evidence, "request_id", "left").fillna(0, ["docs", "evidence"])


@register("gate1_refusal", f"SELECT request_id, {_REFUSAL} AS category FROM (SELECT *, lower(coalesce(report, '')) AS low FROM ({_COUNTS}))")
def gate1(spark, sf_dir):
    return _counts(spark, sf_dir).select("request_id", E.refusal_gate(F.col("docs"), F.col("evidence"), F.col("report")).alias("category"))


_EVIDENCE = f"""{_LINKED}, ev AS (SELECT DISTINCT e.request_id, e.entry_id, left(coalesce(k.page_content, ''), 600) AS snippet, coalesce(k.source, '') <> '' AND trim(coalesce(k.page_content, '')) <> '' AND k.start_index >= 0 AS complete FROM {ENTRIES} e JOIN {CHUNKS} k USING (chunk_id)),
  jj AS (SELECT c.request_id, c.ordinal, c.claim, l.entry_id, e.snippet, list_distinct({SQL_B.format('c.claim')}) AS ct, list_distinct({SQL_B.format('e.snippet')}) AS et, {SQL_GATE_NUMBERS.format('c.claim')} AS cn, {SQL_GATE_NUMBERS.format('e.snippet')} AS en
         FROM {CLAIMS} c LEFT JOIN links l USING (request_id, ordinal) LEFT JOIN ev e ON e.request_id = c.request_id AND e.entry_id = l.entry_id),
  sc AS (SELECT request_id, ordinal, count(entry_id) AS links, count(*) FILTER (entry_id IS NOT NULL AND snippet IS NULL) AS lost, max(len(list_intersect(ct, et))) AS common, max(CASE WHEN len(ct) > 0 THEN len(list_intersect(ct, et)) / len(ct) ELSE 0.0 END) AS ratio,
         bool_or(len(list_filter(cn, lambda v: len(list_filter(en, lambda c: {SQL_NEAR.format(v='v', c='c', a='1e-6', r='0.01')})) = 0)) = 0) AS numbers FROM jj GROUP BY request_id, ordinal),
  failed AS (SELECT request_id, ordinal, CASE WHEN links = 0 THEN 'evidence_missing' WHEN lost > 0 THEN 'evidence_not_found' WHEN common < 3 OR ratio < 0.25 THEN 'evidence_not_supporting' WHEN NOT numbers THEN 'evidence_numeric_mismatch' END AS category FROM sc
    UNION ALL SELECT DISTINCT request_id, -1, 'evidence_incomplete' FROM ev WHERE NOT complete),
  gate AS (SELECT request_id, min_by(category, ordinal) AS category FROM failed WHERE category IS NOT NULL GROUP BY request_id)"""


def _evidence_gate(spark, sf_dir):
    complete = P.anchor_complete(F.col("source"), F.col("chunk_id"), F.col("snippet"), F.col("start_index"))
    evidence = _snippets(spark, sf_dir).withColumn("complete", complete)
    return E.evidence_gate(E.link_claims(claims(_answers(spark, sf_dir)), evidence, "request_id"), evidence, "request_id")


@register("gate2_evidence", _EVIDENCE + " SELECT request_id, category FROM gate")
def gate2(spark, sf_dir):
    return _evidence_gate(spark, sf_dir)


# A third of the requests is taken to have run a tool, whose output has the first number of the report, or half as much again.
_TOOL_SQL = f"""CASE WHEN length(coalesce(query, '')) % 3 = 0 THEN [coalesce({SQL_GATE_NUMBERS.format('report')}[1], 0) * CASE WHEN length(coalesce(report, '')) % 2 = 0 THEN 1.0 ELSE 1.5 END] END"""
_SHOWN = "CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END"
_AROUND = f"substr(low, greatest(instr(low, {_SHOWN}) - 50, 1), instr(low, {_SHOWN}) - greatest(instr(low, {_SHOWN}) - 50, 1) + 50)"
_NUMERIC = f"""WITH said AS (SELECT request_id, flatten(list({SQL_GATE_NUMBERS.format('claim')})) AS nums FROM {CLAIMS} GROUP BY request_id),
  rows_ AS (SELECT a.request_id, lower(coalesce(a.report, '')) AS low, list_distinct(list_concat({SQL_GATE_NUMBERS.format('a.report')}, coalesce(s.nums, []))) AS nums, {_TOOL_SQL} AS tools, coalesce(e.n, 0) AS evidence
    FROM {ANSWERS} a LEFT JOIN said s USING (request_id) LEFT JOIN (SELECT request_id, count(*) AS n FROM {ENTRIES} GROUP BY 1) e USING (request_id)),
  open_ AS (SELECT *, list_sort(list_filter(list_filter(nums, lambda v: instr(low, {_SHOWN}) > 0 AND ({_any(_AROUND, P.CALCULATION_WORDS)})), lambda v: len(list_filter(tools, lambda c: {SQL_NEAR.format(v='v', c='c', a='1e-6', r='0.01')})) = 0)) AS lost FROM rows_)
  SELECT request_id, CASE WHEN len(nums) = 0 THEN NULL WHEN tools IS NULL THEN CASE WHEN evidence = 0 THEN 'numeric_stated_without_evidence' END WHEN len(lost) > 0 THEN 'numeric_calculated_mismatch' END AS category,
    CASE WHEN tools IS NULL THEN '' ELSE array_to_string(list_transform(lost[1:5], lambda x: round(x, 6)), ' ') END AS unmatched FROM open_"""


def _numeric_gate(spark, sf_dir):
    first = F.try_element_at(T.numbers_gate(F.col("report")), F.lit(1))
    value = F.coalesce(first, F.lit(0.0)) * F.when(F.length(T.text(F.col("report"))) % 2 == 0, 1.0).otherwise(1.5)
    tools = F.when(F.length(T.text(F.col("query"))) % 3 == 0, F.array(value))
    said = claims(_answers(spark, sf_dir)).groupBy("request_id").agg(F.flatten(F.collect_list(T.numbers_gate(F.col("claim")))).alias("said"))
    rows = _counts(spark, sf_dir).join(said, "request_id", "left").withColumn("tools", tools)
    none = F.array().cast("array<double>")
    return rows.select("request_id", E.numeric_gate(F.col("report"), F.coalesce("said", none), F.col("tools"), F.col("evidence")).alias("g"))


@register("gate3_numeric", _NUMERIC)
def gate3(spark, sf_dir):
    shown = F.array_join(F.transform("g.unmatched", lambda x: F.round(x, 6).cast("string")), " ")
    return _numeric_gate(spark, sf_dir).select("request_id", F.col("g.category").alias("category"), shown.alias("unmatched"))


@register(
    "gate4_combined",
    f"""WITH g1 AS (SELECT request_id, {_REFUSAL} AS category FROM (SELECT *, lower(coalesce(report, '')) AS low FROM ({_COUNTS}))), g2 AS ({_EVIDENCE} SELECT request_id, category FROM gate), g3 AS ({_NUMERIC})
        SELECT request_id, coalesce(g1.category, g2.category, g3.category) AS category FROM g1 LEFT JOIN g2 USING (request_id) LEFT JOIN g3 USING (request_id)""",
)
def gate4(spark, sf_dir):
    parts = [g.withColumnRenamed("category", f"c{i}") for i, g in enumerate((gate1(spark, sf_dir), _evidence_gate(spark, sf_dir), _numeric_gate(spark, sf_dir).select("request_id", "g.category")))]
    rows = parts[0].join(parts[1], "request_id", "left").join(parts[2], "request_id", "left")
    return rows.select("request_id", F.coalesce("c0", "c1", "c2").alias("category"))


@register(
    "gate5_thresholds",
    _HALVES
    + f""", {_RULES} SELECT metric, reason FROM (SELECT r.metric, CASE WHEN c.value IS NULL THEN 'missing_metric' WHEN coalesce(direction, '') <> 'lower_is_better' AND c.value < minimum - abs(tolerance) THEN 'below_minimum' WHEN coalesce(direction, '') <> 'higher_is_better' AND c.value > maximum + abs(tolerance) THEN 'above_maximum' END AS reason FROM rules r LEFT JOIN cur c USING (metric)) WHERE reason IS NOT NULL""",
)
def gate5(spark, sf_dir):
    return E.threshold_gate(_halves(spark, sf_dir)[0], _rules(spark))


@register(
    "gate6_baseline_diff",
    _HALVES
    + """, d AS (SELECT metric, c.value AS current, b.value AS baseline, round(c.value - b.value, 9) AS delta, metric LIKE '%\\_rate' ESCAPE '\\' AS lower FROM cur c JOIN base b USING (metric))
      SELECT metric, current, baseline, delta, CASE WHEN lower THEN delta > 0.001 ELSE delta < -0.001 END AS regression, CASE WHEN lower THEN false ELSE current < 20.0 END AS failure FROM d""",
)
def gate6(spark, sf_dir):
    return E.compare_metrics(*_halves(spark, sf_dir), tolerance=0.001, minimum=20.0)


@register("gate7_contract", "SELECT event_id, CASE WHEN len(json_keys(props)) = 1 AND json_keys(props)[1] = 'k' AND try_cast(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL THEN 'ok' ELSE 'parse_error' END AS verdict FROM events WHERE props IS NOT NULL")
def gate7(spark, sf_dir):
    keys = F.json_object_keys("props")
    good = (F.array_except(keys, F.array(F.lit("k"))) == F.array().cast("array<string>")) & F.get_json_object("props", "$.k").try_cast("bigint").isNotNull()
    return table(spark, sf_dir, "events").where("props is not null").select("event_id", F.when(good, "ok").otherwise("parse_error").alias("verdict"))


@register("gate8_admission", f"SELECT id FROM {ITEMS} WHERE len(ground_truth_contexts) > 0 AND id NOT IN (SELECT item_id FROM {ANSWERS} WHERE item_id IS NOT NULL AND len(citations) > 0)")
def gate8(spark, sf_dir):
    """Items whose only judgements are texts, which an allow-list would have to name."""
    cited = _answers(spark, sf_dir).where("item_id is not null and size(citations) > 0").select(F.col("item_id").alias("id")).distinct()
    return _items(spark, sf_dir).where("size(ground_truth_contexts) > 0").join(cited, "id", "left_anti").select("id")


@register("gate10_generation", f"SELECT request_id, failure_reason IS NULL AS ok FROM {ANSWERS}", once=True)
def gate10(spark, sf_dir):
    return _answer_rows(spark, sf_dir).select("request_id", F.col("failure_reason").isNull().alias("ok"))
