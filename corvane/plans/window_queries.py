"""Queries of windows, sorts, set operations, stateful operators, sources and sinks, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import windows as W
from corvane.plans.catalog import register
from corvane.plans.retrieval_queries import DOCS, ENTRIES, _docs, _entries
from corvane.plans.text_queries import ANSWERS, CHUNKS, ITEMS, SQL_B, _answers, _chunks, _items
from corvane.operators import ingest as I
from corvane.operators import retrieval as R
from corvane.plans.ingest_queries import PARENTS, _parents
from corvane.session import scratch_path, table
from corvane.sources import files
from corvane.sources.manifest import upsert
from corvane.streaming import indexing, usage


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@register("win1_rank", f"SELECT retrieval_id, row_number() OVER (PARTITION BY request_id ORDER BY rrf_score DESC, retrieval_id) AS rank FROM {DOCS}")
def win1(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("rrf_score"), "retrieval_id"))
    return _docs(spark, sf_dir, "request_id", "rrf_score").select("retrieval_id", place.cast("bigint").alias("rank"))


@register(
    "win4_replacements",
    f"""SELECT request_id, count(*) FILTER (arrived > 5 AND score > kth) AS replaced FROM (SELECT request_id, arrived, score, list_sort(list(score) OVER (PARTITION BY request_id ORDER BY arrived ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'DESC')[5] AS kth FROM (
        SELECT request_id, coalesce(CASE WHEN isnan(score) THEN NULL ELSE score END, 0.0) AS score, row_number() OVER (PARTITION BY request_id ORDER BY seq, entry_id) AS arrived FROM {ENTRIES})) GROUP BY request_id""",
)
def win4(spark, sf_dir):
    """How often a store of five entries replaces its weakest, from the running fifth best."""
    row = F.struct("seq", "entry_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    lists = _entries(spark, sf_dir, "request_id", "seq", "score").groupBy("request_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    start = F.struct(F.array().cast("array<double>").alias("kept"), F.lit(0).cast("bigint").alias("replaced"))

    def step(acc, x):
        better = (F.size(acc["kept"]) >= 5) & (x["score"] > F.try_element_at(acc["kept"], F.lit(5)))
        grown = F.reverse(F.array_sort(F.concat(acc["kept"], F.array(x["score"]))))
        return F.struct(F.slice(grown, 1, 5).alias("kept"), (acc["replaced"] + F.when(better, 1).otherwise(0)).cast("bigint").alias("replaced"))

    return lists.select("request_id", F.aggregate("rows", start, step)["replaced"].alias("replaced"))


@register("win5_sliding_tokens", "SELECT event_id, CAST(sum(floor(value)) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS BIGINT) AS last_hour, CAST(sum(floor(value)) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS BIGINT) AS last_day FROM events")
def win5(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", "user_id", "ts", F.floor("value").alias("tokens"))
    hour = W.sliding_sum(rows, "user_id", "ts", "tokens", 3600, "last_hour")
    return W.sliding_sum(hour, "user_id", "ts", "tokens", 86400, "last_day").select("event_id", "last_hour", "last_day")


@register(
    "win6_alert_edges",
    """SELECT event_id, over AND NOT coalesce(lag(over) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS alert FROM (SELECT event_id, user_id, ts, sum(floor(value)) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) > 150 AS over FROM events)""",
)
def win6(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", "user_id", "ts", F.floor("value").alias("tokens"))
    day = W.sliding_sum(rows, "user_id", "ts", "tokens", 86400, "last_day")
    edge = W.rising_edge(F.col("last_day") > 150, "user_id", order=[F.asc("ts"), F.asc("event_id")])
    return day.select("event_id", edge.alias("alert"))


@register("win7_pairing", f"SELECT request_id, lead(request_id) OVER (PARTITION BY item_id ORDER BY created_at, request_id) AS next_request FROM {ANSWERS} WHERE item_id IS NOT NULL")
def win7(spark, sf_dir):
    own = Window.partitionBy("item_id").orderBy("created_at", "request_id")
    return _answers(spark, sf_dir).where("item_id is not null").select("request_id", F.lead("request_id").over(own).alias("next_request"))


@register("win8_prefix_sums", f"SELECT chunk_id, CAST(coalesce(sum(length(coalesce(page_content, '')) + 1) OVER (PARTITION BY parent_id ORDER BY chunk_index, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM {CHUNKS}")
def win8(spark, sf_dir):
    own = Window.partitionBy("parent_id").orderBy("chunk_index", "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    return _chunks(spark, sf_dir).select("chunk_id", F.coalesce(F.sum(F.length(T.text(F.col("page_content"))) + 1).over(own), F.lit(0)).cast("bigint").alias("before"))


@register("srt1_top_scores", f"SELECT retrieval_id, coarse_score FROM {DOCS} WHERE coarse_score IS NOT NULL ORDER BY coarse_score DESC, retrieval_id LIMIT 100")
def srt1(spark, sf_dir):
    """A top-100 report by design."""
    return _docs(spark, sf_dir, "coarse_score").where("coarse_score is not null").orderBy(F.desc("coarse_score"), "retrieval_id").limit(100).select("retrieval_id", "coarse_score")


@register("srt2_newest_sources", "SELECT source, epoch_us(max(indexed_at)) AS newest FROM parents WHERE source IS NOT NULL GROUP BY source")
def srt2(spark, sf_dir):
    return table(spark, sf_dir, "parents").where("source is not null").groupBy("source").agg(F.unix_micros(F.max("indexed_at").cast("timestamp")).alias("newest"))


@register("set1_union_all", f"SELECT request_id, chunk_id, 'retrieved' AS origin FROM {DOCS} UNION ALL SELECT request_id, chunk_id, 'evidence' FROM {ENTRIES}")
def set1(spark, sf_dir):
    one = _docs(spark, sf_dir, "request_id", "chunk_id").select("request_id", "chunk_id", F.lit("retrieved").alias("origin"))
    return one.unionByName(_entries(spark, sf_dir, "request_id", "chunk_id").select("request_id", "chunk_id", F.lit("evidence").alias("origin")))


@register("set2_union_distinct", f"SELECT request_id, chunk_id FROM {DOCS} UNION SELECT request_id, chunk_id FROM {ENTRIES}")
def set2(spark, sf_dir):
    return set1(spark, sf_dir).select("request_id", "chunk_id").distinct()


@register("set3_intersect", f"SELECT request_id, chunk_id FROM {DOCS} INTERSECT SELECT request_id, chunk_id FROM {ENTRIES}")
def set3(spark, sf_dir):
    return _docs(spark, sf_dir, "request_id", "chunk_id").drop("retrieval_id").intersect(_entries(spark, sf_dir, "request_id", "chunk_id").drop("entry_id"))


@register("set4_missed", f"SELECT request_id, chunk_id FROM {DOCS} d WHERE NOT EXISTS (SELECT 1 FROM {ENTRIES} e WHERE e.request_id = d.request_id AND e.chunk_id = d.chunk_id)")
def set4(spark, sf_dir):
    used = _entries(spark, sf_dir, "request_id", "chunk_id").drop("entry_id").distinct()
    return _docs(spark, sf_dir, "request_id", "chunk_id").drop("retrieval_id").join(used, ["request_id", "chunk_id"], "left_anti")


# ---- stateful -------------------------------------------------------------------------------
@register("stm1_hourly_usage", "SELECT epoch_us(date_trunc('hour', ts)) AS start, event_type AS model, count(*) AS calls, CAST(sum(floor(value)) AS BIGINT) AS tokens FROM events GROUP BY 1, 2")
def stm1(spark, sf_dir):
    """The tumbling windows as a streaming query run over all events."""
    stream = usage.windowed_usage(usage.read_events(spark, sf_dir))
    return usage.run_to_table(stream, "complete", "usage").select(F.unix_micros("start").alias("start"), "model", "calls", "tokens")


@register("stm1_sliding_usage", "SELECT s AS start, event_type AS model, count(*) AS calls, CAST(sum(floor(value)) AS BIGINT) AS tokens FROM (SELECT *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY 1, 2")
def stm1_sliding(spark, sf_dir):
    rows = _events(spark, sf_dir).groupBy(F.window("ts", "2 hours", "1 hour").alias("w"), F.col("event_type").alias("model"))
    return rows.agg(F.count("*").alias("calls"), F.sum(F.floor("value")).alias("tokens")).select(F.col("w.start").alias("start"), "model", "calls", "tokens")


@register(
    "stm1_sessions",
    """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""",
)
def stm1_sessions(spark, sf_dir):
    return W.session_windows(_events(spark, sf_dir), "user_id", "ts", "6 hours")


_BUCKET = """WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS sec, floor(value) AS need, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL),
      walk AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, 60.0::DOUBLE AS level, NULL::DOUBLE AS last, true AS allowed, 0.0::DOUBLE AS retry_after FROM e GROUP BY user_id
        UNION ALL SELECT user_id, n, event_id, CASE WHEN need > 0 AND ok THEN filled - need ELSE filled END, greatest(last, sec), ok, CASE WHEN ok THEN 0.0 WHEN need > 60 THEN 'inf'::DOUBLE ELSE round((need - filled) / (0.02 / 60.0), 6) END FROM (
          SELECT *, need <= 0 OR (need <= 60 AND need <= filled + 1e-9) AS ok FROM (
            SELECT e.user_id, e.n, e.event_id, e.sec, e.need, coalesce(w.last, e.sec) AS last, least(60.0, w.level + greatest(0.0, e.sec - coalesce(w.last, e.sec)) * (0.02::DOUBLE / 60.0)) AS filled FROM walk w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)))"""


@register("stm2_token_bucket", _BUCKET + " SELECT event_id, allowed, retry_after FROM walk WHERE n > 0")
def stm2(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("need", F.floor("value"))
    return W.token_bucket(rows, "user_id", "ts", "event_id", "need", capacity=60, per_minute=0.02)


@register("stm2_stream_bucket", _BUCKET + " SELECT event_id, user_id, allowed FROM walk WHERE n > 0")
def stm2_stream(spark, sf_dir):
    stream = usage.token_bucket(usage.read_events(spark, sf_dir), 60, 0.02)
    return usage.run_to_table(stream, "append", "bucket")


@register("stm2_priority_bucket")
def stm2_priority(spark, sf_dir):
    """Buckets by user and priority class: views are not critical, errors have a class without a budget."""
    rows = _events(spark, sf_dir).withColumn("need", F.floor("value")).withColumn("priority", F.when(F.col("event_type") == "view", "query").when(F.col("event_type") == "error", "vip"))
    return W.token_bucket(rows, "user_id", "ts", "event_id", "need", 60, 0.02, "priority", {"non_critical": (30, 0.01)})


@register("stm3_rate_limit", "SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) <= 1 AS allowed FROM events")
def stm3(spark, sf_dir):
    return W.fixed_window_limit(_events(spark, sf_dir), "user_id", "ts", "event_id", "hour", 1).select("event_id", "allowed")


@register(
    "stm4_lru_hits",
    """WITH e AS (SELECT event_id, user_id, sha256(event_type || props) AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), p AS (SELECT *, lag(n) OVER (PARTITION BY user_id, key ORDER BY n) AS last FROM e)
       SELECT p.event_id, p.last IS NOT NULL AND count(DISTINCT q.key) < 40 AS hit FROM p LEFT JOIN e q ON q.user_id = p.user_id AND q.n > p.last AND q.n < p.n GROUP BY p.event_id, p.last""",
)
def stm4(spark, sf_dir):
    """Hits of a least-recently-used cache of 40 keys for each user."""
    rows = _events(spark, sf_dir).select("event_id", "user_id", "ts", F.sha2(F.concat("event_type", "props").cast("binary"), 256).alias("key"))
    return W.lru_hits(rows, "user_id", "key", "ts", "event_id", 40)


@register("stm5_ttl_hits", "SELECT event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= 86400 * 1000000::BIGINT, false) AS hit FROM events")
def stm5(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("key", F.concat_ws("/", F.col("user_id").cast("string"), "event_type"))
    return W.ttl_hits(rows, "key", "ts", "event_id", 86400).select("event_id", "hit")


@register("stm7_retention", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def stm7(spark, sf_dir):
    return files.keep_recent(_events(spark, sf_dir), "ts", F.lit("2024-01-31").cast("timestamp")).select("event_id")


@register("stm9_counters", "SELECT event_type, user_id % 2 = 0 AS cached, count(*) AS n, CAST(floor(value / 25) AS BIGINT) AS bucket FROM events GROUP BY ALL")
def stm9(spark, sf_dir):
    rows = _events(spark, sf_dir).groupBy("event_type", (F.col("user_id") % 2 == 0).alias("cached"), F.floor(F.col("value") / 25).alias("bucket"))
    return rows.agg(F.count("*").alias("n"))


# ---- sources and sinks ----------------------------------------------------------------------
@register("src6_html")
def src6(spark, sf_dir):
    pages = table(spark, sf_dir, "web_docs").where("file_type = 'html'").dropDuplicates(["page_id"])
    return files.html_pages(pages, "page_id", "page_content").select("page_id", F.length("text").cast("bigint").alias("n_chars"))


@register("src6_html_tags", r"SELECT page_id, trim(regexp_replace(regexp_replace(page_content, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM (SELECT DISTINCT page_id, page_content FROM web_docs WHERE file_type = 'html' AND page_content IS NOT NULL)")
def src6_tags(spark, sf_dir):
    pages = table(spark, sf_dir, "web_docs").where("file_type = 'html' and page_content is not null").select("page_id", "page_content").distinct()
    bare = F.regexp_replace(F.regexp_replace("page_content", "<[^>]*>", " "), r"\s+", " ")
    return pages.select("page_id", F.trim(bare).alias("text"))


@register("src7_formats", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in files.FORMATS.items()) + ") t(suffix, file_type)")
def src7(spark, sf_dir):
    return files.formats(spark)


@register("src8_corpus_lines", f"SELECT page_content, source FROM {CHUNKS} WHERE page_content IS NOT NULL AND source IS NOT NULL")
def src8(spark, sf_dir):
    """Chunks written as a corpus of JSON lines and read again."""
    rows = _chunks(spark, sf_dir).where("page_content is not null and source is not null")
    path = scratch_path(spark, "corpus")
    files.write_corpus(rows.select("page_content", F.create_map(F.lit("source"), "source").alias("metadata")), path)
    return files.read_corpus(spark, path).select("page_content", F.element_at("metadata", "source").alias("source"))


@register(
    "snk2_upsert",
    f"""WITH o AS (SELECT chunk_id, source, length(page_content) AS n FROM {CHUNKS} WHERE source IS NOT NULL), new AS (SELECT chunk_id, source, n + 1 AS n FROM o WHERE contains(source, 'regulatory') AND n > 200)
        SELECT chunk_id, source, n FROM o WHERE source NOT IN (SELECT source FROM new) UNION ALL SELECT * FROM new""",
)
def snk2(spark, sf_dir):
    old = _chunks(spark, sf_dir).where("source is not null").select("chunk_id", "source", F.length("page_content").cast("bigint").alias("n"))
    new = old.where(F.contains("source", F.lit("regulatory")) & (F.col("n") > 200)).withColumn("n", F.col("n") + 1)
    return upsert(old, new, "source")


@register("snk4_delete", f"SELECT chunk_id FROM {CHUNKS} WHERE source IS DISTINCT FROM (SELECT min(source) FROM {CHUNKS})")
def snk4(spark, sf_dir):
    rows = _chunks(spark, sf_dir)
    gone = rows.agg(F.min("source").alias("source"))
    return rows.join(gone, "source", "left_anti").select("chunk_id")


@register(
    "src10_vector_rows",
    f"SELECT chunk_id, source, file_type, parent_id, section_path, start_index, page, start_line, end_line, length(coalesce(page_content, '')) AS n_chars, 64 AS dimensions FROM {CHUNKS}",
)
def src10(spark, sf_dir):
    """The rows of a vector table, stored by cell and read again."""
    chunks = _chunks(spark, sf_dir)
    vectors = I.hash_vectors(chunks, "chunk_id", "page_content").select(F.col("key").alias("chunk_id"), "vector")
    path = scratch_path(spark, "vectors")
    files.write_vectors(R.with_cells(chunks.join(vectors, "chunk_id"), "vector", R.fit_cells(vectors, "vector", 10).centers), path)
    kept = ["chunk_id", "source", "file_type", "parent_id", "section_path", "start_index", "page", "start_line", "end_line"]
    text = F.length(T.text(F.col("page_content"))).cast("bigint")
    return spark.read.parquet(path).select(*kept, text.alias("n_chars"), F.size("vector").alias("dimensions"))


@register(
    "src12_traces",
    """SELECT CAST(event_id // 4 AS VARCHAR) AS request_id, count(*) AS nodes, round(max(value), 6) AS slowest, CAST(sum(CAST(floor(value) AS INT)) AS BIGINT) AS prompt_tokens FROM events GROUP BY 1""",
)
def src12(spark, sf_dir):
    """Traces of four nodes each, written as JSON and read again."""
    node = F.struct(F.col("event_type").alias("name"), F.col("value").alias("latency_ms"), F.struct(F.floor("value").cast("int").alias("prompt_tokens"), F.lit(0).alias("completion_tokens")).alias("token_usage"))
    request = F.expr("event_id div 4").cast("string")
    path = scratch_path(spark, "traces")
    _events(spark, sf_dir).groupBy(request.alias("request_id")).agg(F.collect_list(node).alias("nodes")).write.json(path)
    rows = files.read_traces(spark, path, lines=True).select("request_id", F.explode("nodes").alias("n"))
    return rows.groupBy("request_id").agg(
        F.count("*").alias("nodes"), F.round(F.max("n.latency_ms"), 6).alias("slowest"), F.sum("n.token_usage.prompt_tokens").alias("prompt_tokens")
    )


@register("stm6_incremental_index", f"SELECT parent_id AS source, length(page_content) AS n_chars, page % 3 = 1 AS changed FROM {PARENTS} WHERE page_content IS NOT NULL")
def stm6(spark, sf_dir):
    """Two batches of files into the incremental index: all, some of them unfinished, then all as they are."""
    rows = _parents(spark, sf_dir).where("page_content is not null")
    late = F.coalesce(F.col("page") % 3 == 1, F.lit(False))
    as_files = lambda text: rows.select(F.col("parent_id").alias("path"), text.cast("binary").alias("content"))
    path = scratch_path(spark, "index")
    indexing.index_batch(as_files(F.when(late, F.lit("unfinished")).otherwise(F.col("page_content"))), path, parts=8)
    first = indexing.read_index(spark, path, parts=8).select("source", F.col("digest").alias("before"))
    indexing.index_batch(as_files(F.col("page_content")), path, parts=8)
    now = indexing.read_index(spark, path, parts=8).join(first, "source")
    # the page of a parent is null where it has none
    known = rows.select(F.col("parent_id").alias("source"), F.col("page").isNull().alias("unknown"))
    changed = F.when(~F.col("unknown"), F.col("digest") != F.col("before"))
    return now.join(known, "source").select("source", F.length("text").cast("bigint").alias("n_chars"), changed.alias("changed"))
