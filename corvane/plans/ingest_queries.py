"""Queries of ingestion and of the predicates, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import filters as P
from corvane.operators import ingest as I
from corvane.operators import tools as X
from corvane.plans.catalog import register
from corvane.plans.text_queries import (
    ANSWERS, CHUNKS, ITEMS, _answer_rows, _answers, _chunk_rows, _chunks, _item_rows, _items, sql_list, sql_squeeze, sql_strip,
)
from corvane.session import spread, table

PARENTS = "(SELECT * EXCLUDE (indexed_at) FROM parents QUALIFY row_number() OVER (PARTITION BY parent_id ORDER BY indexed_at) = 1)"


def _parent_rows(spark, sf_dir):
    """Parents as they come, without the load time."""
    return spread(table(spark, sf_dir, "parents").drop("indexed_at"))


def _parents(spark, sf_dir):
    """Parents, each once."""
    return table(spark, sf_dir, "parents").drop("indexed_at").dropDuplicates(["parent_id"])


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "web_docs").where("file_type = 'md'").select("page_id", "source", "file_type", "page_content").dropDuplicates(["page_id"])


_SECTIONS = r"""
  WITH p AS (SELECT page_id, any_value(regexp_split_to_array(page_content, '\r\n|\n|\r')) AS lines FROM web_docs WHERE file_type = 'md' AND page_content IS NOT NULL GROUP BY page_id),
  l AS (SELECT page_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM p),
  h AS (SELECT page_id, pos, length(regexp_extract(line, '^(#{1,6})\s+(.+?)\s*$', 1)) AS level, regexp_extract(line, '^(#{1,6})\s+(.+?)\s*$', 2) AS title
        FROM l WHERE regexp_matches(line, '^(#{1,6})\s+(.+?)\s*$')),
  s AS (SELECT page_id, pos, level FROM h UNION ALL SELECT page_id, 0, 0 FROM h GROUP BY page_id HAVING min(pos) > 0),
  o AS (SELECT page_id, pos, level, row_number() OVER w - 1 AS ordinal, lead(pos) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
  path AS (SELECT o.page_id, o.pos, string_agg(h.title, ' / ' ORDER BY h.pos) AS section_path FROM o JOIN h ON h.page_id = o.page_id AND h.pos <= o.pos AND o.level > 0
           WHERE NOT EXISTS (SELECT 1 FROM h k WHERE k.page_id = h.page_id AND k.pos > h.pos AND k.pos <= o.pos AND k.level <= h.level) GROUP BY o.page_id, o.pos),
  r AS (SELECT o.page_id, o.ordinal, coalesce(path.section_path, '') AS section_path, o.pos, coalesce(o.nxt, len(p.lines)) AS end_line, p.lines
        FROM o JOIN p USING (page_id) LEFT JOIN path ON path.page_id = o.page_id AND path.pos = o.pos),
  sections AS (SELECT page_id, ordinal, section_path, array_to_string(lines[pos + 1 : end_line], chr(10)) AS text, pos AS start_line, end_line,
        coalesce(list_sum(list_transform(lines[1 : pos], lambda x: length(x) + 1)), 0) AS start_char FROM r)
"""


@register("prj1_sections", _SECTIONS + "SELECT page_id, ordinal, section_path, start_line, end_line, CAST(start_char AS BIGINT) AS start_char, length(text) AS n_chars FROM sections")
def prj1(spark, sf_dir):
    found = I.sections(_pages(spark, sf_dir), "page_id", "page_content")
    return found.select("page_id", "ordinal", "section_path", "start_line", "end_line", "start_char", F.length("text").cast("bigint").alias("n_chars"))


def _sources_of_parents(spark, sf_dir):
    """Loaded pages, and the pages of PDF files, as documents with a page number."""
    pages = table(spark, sf_dir, "web_docs").select(F.col("page_id").cast("string").alias("doc"), "source", "file_type", F.lit(0).alias("page"), "page_content").dropDuplicates(["doc"])
    pdf = _parents(spark, sf_dir).where("file_type = 'pdf'").select(F.col("parent_id").alias("doc"), "source", "file_type", "page", "page_content")
    return pages.unionByName(pdf)


@register(
    "prj2_parents",
    _SECTIONS
    + rf""", named AS (SELECT DISTINCT CAST(page_id AS VARCHAR) AS doc, page_id, source, file_type, 0 AS page, coalesce(page_content, '') AS content FROM web_docs
      UNION ALL SELECT parent_id, NULL, source, file_type, coalesce(page, 0), coalesce(page_content, '') FROM {PARENTS} WHERE file_type = 'pdf'),
    cut AS (SELECT n.doc, n.source, 'md_section' AS parent_type, section_path, CAST(start_char AS BIGINT) AS start_char, start_line + 1 AS start_line, end_line, 0 AS page, {sql_strip('text')} AS text FROM sections s JOIN named n USING (page_id) WHERE {sql_strip('text')} <> ''),
    whole AS (SELECT doc, source, CASE WHEN md THEN 'md_file' WHEN page <> 0 THEN 'pdf_page' ELSE 'doc' END AS parent_type, '' AS section_path, 0 AS start_char, CASE WHEN md THEN 1 ELSE 0 END AS start_line,
        CASE WHEN md THEN length(content) - length(replace(content, chr(10), '')) + 1 ELSE 0 END AS end_line, CASE WHEN md THEN 0 ELSE page END AS page, content AS text
      FROM (SELECT *, lower(trim(coalesce(file_type, ''))) = 'md' OR lower(coalesce(source, '')) LIKE '%.md' AS md FROM named WHERE doc NOT IN (SELECT CAST(page_id AS VARCHAR) FROM sections)))
    SELECT doc, parent_type, section_path, start_line, end_line, page, left(sha1(concat_ws(':', coalesce(source, ''), section_path, start_char, page)), 12) AS parent_id, length(text) AS n_chars
    FROM (SELECT * FROM cut UNION ALL SELECT * FROM whole)""",
)
def prj2(spark, sf_dir):
    found = I.parents(_sources_of_parents(spark, sf_dir), "doc", "page_content", "source", "file_type", "page")
    return found.select("doc", "parent_type", "section_path", "start_line", "end_line", "page", "parent_id", F.length("text").cast("bigint").alias("n_chars"))


@register("prj3_recursive_chunks")
def prj3(spark, sf_dir):
    found = I.recursive_chunks(_parents(spark, sf_dir), "parent_id", "page_content")
    return found.select("parent_id", "chunk_index", "start_index", F.length("text").cast("bigint").alias("n_chars"))


@register(
    "prj4_fixed_chunks",
    f"""SELECT parent_id, i AS chunk_index, i * 700 AS start_index, length(substr(page_content, i * 700 + 1, 800)) AS n_chars, md5(substr(page_content, i * 700 + 1, 800)) AS digest
        FROM (SELECT parent_id, page_content, unnest(range(0, CAST(floor(greatest(length(page_content) - 101, 0) / 700) AS BIGINT) + 1)) AS i FROM {PARENTS} WHERE length(page_content) > 0)""",
)
def prj4(spark, sf_dir):
    found = I.fixed_chunks(_parents(spark, sf_dir), "parent_id", "page_content")
    return found.select("parent_id", "chunk_index", "start_index", F.length("text").cast("bigint").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


_LAST = r"CASE WHEN regexp_matches(w, '{0}') THEN a + length(regexp_extract(w, '(?s)^(.*){0}', 1)) + {1} END"


@register(
    "prj4_seeking_chunks",
    rf"""WITH RECURSIVE p AS MATERIALIZED (SELECT parent_id, page_content AS t, length(page_content) AS n FROM {PARENTS} WHERE length(page_content) > 0),
      walk AS (SELECT parent_id, -1::BIGINT AS i, 0::BIGINT AS s, 0::BIGINT AS e, 0::BIGINT AS nxt FROM p
        UNION ALL SELECT parent_id, i + 1, s, e, CASE WHEN e >= n THEN n WHEN e - 100 > s THEN e - 100 ELSE e END FROM (
          SELECT parent_id, i, s, n, least(n, CASE WHEN lim >= n THEN n WHEN instr(w, chr(10) || chr(10)) > 0 THEN a + instr(w, chr(10) || chr(10)) + 1
            ELSE coalesce({_LAST.format(r'\. ', 2)}, {_LAST.format('。', 1)}, {_LAST.format(r'\n', 1)}, lim) END)::BIGINT AS e FROM (
            SELECT *, substr(t, a + 1, lim + 100 - a) AS w FROM (SELECT *, greatest(s, lim - 100) AS a FROM (
              SELECT w.parent_id, w.i, w.nxt AS s, p.t, p.n, least(w.nxt + 800, p.n) AS lim FROM walk w JOIN p USING (parent_id) WHERE w.nxt < p.n)))))
      SELECT parent_id, i AS chunk_index, s AS start_index, e - s AS n_chars FROM walk WHERE i >= 0""",
)
def prj4b(spark, sf_dir):
    found = I.seeking_chunks(_parents(spark, sf_dir), "parent_id", "page_content")
    return found.select("parent_id", "chunk_index", "start_index", F.length("text").cast("bigint").alias("n_chars"))


_CLEAN = sql_strip(r"regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''), '\^?\[\d+\]|\[edit\]|\[citation needed\]', '', 'g'), '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


@register("prj7_clean", f"SELECT chunk_id, {_CLEAN.format('page_content')} AS cleaned FROM {CHUNKS}", once=True)
def prj7(spark, sf_dir):
    return _chunk_rows(spark, sf_dir).select("chunk_id", I.clean_noise(F.col("page_content")).alias("cleaned"))


@register(
    "prj6_chunk_driver",
    f"""WITH c AS (SELECT parent_id, source, page_content, i, i * 700 AS start_index, {_CLEAN.format('substr(page_content, i * 700 + 1, 800)')} AS text
        FROM (SELECT parent_id, source, page_content, unnest(range(0, CAST(floor(greatest(length(page_content) - 101, 0) / 700) AS BIGINT) + 1)) AS i FROM {PARENTS} WHERE length(page_content) > 0))
        SELECT parent_id, i AS chunk_index, left(sha1(concat_ws(':', coalesce(source, ''), start_index, text)), 12) AS digest FROM c WHERE length(text) >= 30
        AND NOT regexp_matches(text, '(?i)^({P.NAVIGATION})\\b') AND NOT starts_with(text, '^')
        AND list_sum(list_transform(regexp_extract_all(text, '{P.CITATION_NOISE}'), lambda m: length(m))) IS NOT DISTINCT FROM NULL
        AND NOT (len(regexp_extract_all(text, '[A-Za-z]{{3,}}')) > 0 AND len(regexp_extract_all(regexp_replace(text, '\\p{{L}}', 'x', 'g'), '\\b\\d{{4}}\\b')) / greatest(len(regexp_extract_all(text, '[A-Za-z]{{3,}}')), 1) > 0.25)""",
)
def prj6(spark, sf_dir):
    cut = I.fixed_chunks(_parents(spark, sf_dir), "parent_id", "page_content").withColumn("text", I.clean_noise(F.col("text")))
    named = cut.join(_parents(spark, sf_dir).select("parent_id", "source"), "parent_id")
    noisy = F.size(F.regexp_extract_all(F.col("text"), F.lit(f"({P.CITATION_NOISE})"), F.lit(1))) > 0
    kept = named.where(P.long_enough(F.col("text"), 30) & ~P.is_junk(F.col("text")) & ~noisy)
    return kept.select("parent_id", "chunk_index", T.short_sha1(F.col("source"), F.col("start_index"), F.col("text")).alias("digest"))


@register(
    "prj8_chunk_ids",
    f"""SELECT c.chunk_id, CASE WHEN coalesce(c.source, '') = '' THEN d ELSE regexp_extract(replace(c.source, chr(92), '/'), '([^/]*)$', 1) || ':' || d END AS made,
        len(regexp_extract_all(left(p.page_content, least(500, length(p.page_content))), chr(10))) + 1 AS last_line
        FROM (SELECT *, left(sha1(concat_ws(':', coalesce(source, ''), coalesce(start_index, 0), coalesce(page_content, ''))), 12) AS d FROM {CHUNKS}) c
        JOIN {PARENTS} p USING (parent_id) WHERE p.page_content IS NOT NULL""",
)
def prj8(spark, sf_dir):
    own = _chunks(spark, sf_dir)
    made = own.select("chunk_id", "parent_id", I.chunk_id(F.col("source"), F.coalesce("start_index", F.lit(0)), F.col("page_content")).alias("made"))
    texts = _parents(spark, sf_dir).where("page_content is not null").select("parent_id", F.col("page_content").alias("parent_text"))
    _, last = I.line_span(F.col("parent_text"), F.lit(0), F.least(F.lit(500), F.length("parent_text")))
    return made.join(texts, "parent_id").select("chunk_id", "made", last.cast("bigint").alias("last_line"))


def _sql_summary(expression: str, most: int) -> str:
    raw = sql_strip(f"coalesce({expression}, '')")
    lines = rf"list_filter(list_transform(regexp_split_to_array({raw}, '\r\n|\n|\r'), lambda x: {sql_strip('x')}), lambda x: x <> '')"
    head = f"array_to_string({lines}[1:12], chr(10))"
    parts = rf"list_filter(list_transform(string_split(regexp_replace({raw}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {sql_strip('s')}), lambda s: length(s) >= 30)"
    return f"(SELECT left(CASE WHEN length(h) >= {min(most, 240)} THEN h WHEN b <> '' THEN b ELSE h END, {most}) FROM (SELECT {head} AS h, (SELECT coalesce(array_to_string(list_filter(q, lambda s, i: coalesce(list_sum(list_transform(q[1:i - 1], lambda z: length(z) + 1)), 0) < {most}), ' '), '') FROM (SELECT {parts} AS q)) AS b))"


@register("prj9_summary", f"SELECT parent_id, {_sql_summary('page_content', 900)} AS summary FROM {PARENTS} p", once=True)
def prj9(spark, sf_dir):
    return _parent_rows(spark, sf_dir).select("parent_id", I.extractive_summary(F.col("page_content")).alias("summary"))


@register("prj10_summary_docs", f"SELECT parent_id, 'summary' AS doc_type, summary FROM (SELECT parent_id, {_sql_summary('page_content', 900)} AS summary FROM {PARENTS} p WHERE trim(parent_id) <> '') WHERE summary <> ''", once=True)
def prj10(spark, sf_dir):
    made = prj9(spark, sf_dir).where("summary <> '' and trim(parent_id) <> ''")
    return made.select("parent_id", F.lit("summary").alias("doc_type"), "summary")


SQL_HYDE = rf"""SELECT parent_id, CASE WHEN l <> '' THEN {sql_strip("'What is ' || l || ' and why does it matter ' || k")} WHEN k <> '' THEN 'What is ' || k || ' and how is it used in risk systems' ELSE 'What is the definition and background' END AS question
        FROM (SELECT parent_id, regexp_replace({sql_strip("string_split(" + sql_strip("coalesce(section_path, '')") + ", '/')[-1]")}, '\s+', ' ', 'g') AS l,
              array_to_string(regexp_extract_all({_sql_summary('page_content', 240)}, '[A-Za-z0-9]+')[1:12], ' ') AS k FROM {PARENTS} p)"""


@register("prj11_hyde", SQL_HYDE, once=True)
def prj11(spark, sf_dir):
    return _parent_rows(spark, sf_dir).select("parent_id", I.hypothetical_question(F.col("page_content"), F.col("section_path")).alias("question"))


@register("prj12_context_brief", f"SELECT chunk_id, CASE WHEN coalesce(context_brief, '') <> '' THEN context_brief || chr(10) || coalesce(page_content, '') ELSE coalesce(page_content, '') END AS embedded FROM {CHUNKS}", once=True)
def prj12(spark, sf_dir):
    brief, body = T.text(F.col("context_brief")), T.text(F.col("page_content"))
    return _chunk_rows(spark, sf_dir).select("chunk_id", F.when(brief != "", F.concat(brief, F.lit("\n"), body)).otherwise(body).alias("embedded"))


@register(
    "prj13_hash_vectors",
    rf"""WITH t AS (SELECT id, unnest(CASE WHEN len(a) > 0 THEN a ELSE [''] END) AS token FROM (SELECT id, regexp_extract_all(lower(coalesce(question, '')), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]') AS a FROM {ITEMS})),
        v AS (SELECT id, i, sum(CASE WHEN CAST('0x' || substr(sha256(token), 2 * ((i + 7) % 32) + 1, 2) AS INT) % 2 = 0 THEN 1 ELSE -1 END * CAST('0x' || substr(sha256(token), 2 * (i % 32) + 1, 2) AS INT)) / 255.0 AS x
              FROM t, range(0, 64) r(i) GROUP BY id, i)
        SELECT id, i, round(x / CASE WHEN n > 0 THEN n ELSE 1 END, 9) AS x FROM (SELECT id, i, x, sqrt(sum(x * x) OVER (PARTITION BY id)) AS n FROM v)""",
)
def prj13(spark, sf_dir):
    made = _items(spark, sf_dir).select("id", F.posexplode(I.hash_vector(F.col("question"))).alias("i", "x"))
    return made.select("id", F.col("i").cast("bigint").alias("i"), F.round("x", 9).alias("x"))


@register(
    "prj15_citations",
    f"""SELECT chunk_id, source, start_index, section_path, CASE WHEN page <> 0 THEN CAST(page AS VARCHAR) END AS page, start_line, end_line, left(coalesce(page_content, ''), 300) AS snippet FROM {CHUNKS}""",
    once=True,
)
def prj15(spark, sf_dir):
    return _chunk_rows(spark, sf_dir).select(
        "chunk_id", "source", "start_index", "section_path", F.when(F.col("page") != 0, F.col("page").cast("string")).alias("page"), "start_line", "end_line", F.substring(T.text(F.col("page_content")), 1, 300).alias("snippet")
    )


@register(
    "prj16_evidence",
    """SELECT request_id, 'ev_' || (row_number() OVER (PARTITION BY request_id ORDER BY seq, entry_id) - 1) AS evidence_id, chunk_id, left(page_content, 600) AS snippet FROM (
       SELECT DISTINCT e.request_id, e.seq, e.entry_id, e.chunk_id, c.page_content FROM evidence_entries e JOIN """ + CHUNKS + " c USING (chunk_id))",
)
def prj16(spark, sf_dir):


    entries = table(spark, sf_dir, "evidence_entries").select("request_id", "seq", "entry_id", "chunk_id").distinct()
    rows = entries.join(_chunks(spark, sf_dir).select("chunk_id", F.substring("page_content", 1, 600).alias("snippet")), "chunk_id")
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("seq", "entry_id")) - 1
    return rows.select("request_id", F.concat(F.lit("ev_"), place.cast("string")).alias("evidence_id"), "chunk_id", "snippet")


@register(
    "prj17_eval_rows",
    f"""SELECT id, ordinal, left(c, 1800) AS context, {sql_squeeze('left(c, 200)')} AS snippet FROM (
        SELECT id, unnest(cs[1:4]) AS c, generate_subscripts(cs[1:4], 1) - 1 AS ordinal FROM (SELECT id, ground_truth_contexts AS cs FROM {ITEMS} WHERE ground_truth_contexts IS NOT NULL))
        WHERE {sql_strip("coalesce(c, '')")} <> ''""",
)
def prj17(spark, sf_dir):
    rows = _items(spark, sf_dir).select("id", F.posexplode(F.slice("ground_truth_contexts", 1, 4)).alias("ordinal", "c")).where(T.strip(T.text(F.col("c"))) != "")
    return rows.select("id", F.col("ordinal").cast("bigint").alias("ordinal"), F.substring("c", 1, 1800).alias("context"), T.squeeze(F.substring("c", 1, 200)).alias("snippet"))


@register(
    "prj18_tool_documents",
    """SELECT 'tool:monitor:' || s_name || ':2024-01-31' AS chunk_id,
       'Desk ' || s_name || ' has a balance of ' || printf('%.2f', s_acctbal) || ' as of 2024-01-31.' AS content FROM supplier""",
)
def prj18(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("tool:monitor:"), F.col("s_name"), F.lit(":2024-01-31")).alias("chunk_id"),
        F.format_string("Desk %s has a balance of %.2f as of 2024-01-31.", F.col("s_name"), F.col("s_acctbal")).alias("content"),
    )


@register(
    "prj19_history",
    f"""SELECT item_id, string_agg('User: ' || coalesce(query, '') || chr(10) || 'Assistant: ' || coalesce(report, ''), chr(10) ORDER BY created_at, request_id) AS history FROM (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY created_at DESC, request_id DESC) AS back FROM {ANSWERS}
        WHERE item_id IS NOT NULL AND ({sql_strip("coalesce(query, '')")} <> '' OR {sql_strip("coalesce(report, '')")} <> '')) WHERE back <= 3 GROUP BY item_id""",
)
def prj19(spark, sf_dir):


    turn = F.concat(F.lit("User: "), T.text(F.col("query")), F.lit("\nAssistant: "), T.text(F.col("report")))
    said = (T.strip(T.text(F.col("query"))) != "") | (T.strip(T.text(F.col("report"))) != "")
    rows = _answers(spark, sf_dir).where("item_id is not null").where(said)
    back = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("created_at"), F.desc("request_id")))
    last = rows.select("item_id", "created_at", "request_id", turn.alias("turn"), back.alias("back")).where("back <= 3")
    # at most three turns of an item are gathered
    kept = last.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "request_id", "turn"))).alias("t"))
    return kept.select("item_id", F.array_join(F.transform("t", lambda x: x["turn"]), "\n").alias("history"))


@register(
    "prj20_context_format",
    f"""WITH c AS (SELECT id, i, s, sum(length('[ctx ' || i || ']' || chr(10)) + length(s) + 1) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto FROM (
        SELECT id, unnest(ground_truth_contexts) AS s, generate_subscripts(ground_truth_contexts, 1) AS i FROM {ITEMS} WHERE ground_truth_contexts IS NOT NULL) WHERE s IS NOT NULL)
        SELECT id, string_agg('[ctx ' || i || ']' || chr(10) || s, chr(10) ORDER BY i) AS context FROM c WHERE upto <= 1200 GROUP BY id""",
)
def prj20(spark, sf_dir):
    parts = F.filter(
        F.transform("ground_truth_contexts", lambda s, i: F.struct(F.concat(F.lit("[ctx "), (i + 1).cast("string"), F.lit("]\n"), s).alias("part"))), lambda p: p["part"].isNotNull()
    )
    empty = F.struct(F.lit(0).alias("total"), F.array().cast("array<string>").alias("kept"))
    add = lambda acc, p: F.struct(
        (acc["total"] + F.length(p["part"]) + 1).alias("total"),
        F.when(acc["total"] + F.length(p["part"]) + 1 <= 1200, F.concat(acc["kept"], F.array(p["part"]))).otherwise(acc["kept"]).alias("kept"),
    )
    rows = _items(spark, sf_dir).where("ground_truth_contexts is not null").select("id", F.aggregate(parts, empty, add)["kept"].alias("kept"))
    return rows.where(F.size("kept") > 0).select("id", F.array_join("kept", "\n").alias("context"))


# Phrases of lines that speak about the answer instead of giving one.
META_LINES = r"(?i)\bi'?m unable to answer\b|\bi do not know\b|\bno relevant information was found\b|\bnext actions\s*:|\bsuggested next steps\s*:|\bthe provided context does not\b|\bthe context does not\b|\bno further detail\b|\bbased on the provided context\b|\bbecause the information is insufficient\b"
_META_SQL = META_LINES.replace("'", "''")


@register(
    "prj21_sanitised",
    rf"""SELECT request_id, array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(report, ''), '\n\n'), lambda b: array_to_string(list_filter(list_transform(regexp_split_to_array(b, '\r\n|\n|\r'), lambda x: {sql_strip('x')}), lambda x: x <> '' AND NOT regexp_matches(x, '{_META_SQL}')), chr(10))), lambda b: b <> '' AND NOT regexp_full_match(b, '\d+\)\s+[^\n]*')), chr(10) || chr(10)) AS answer FROM {ANSWERS}""",
    once=True,
)
def prj21(spark, sf_dir):
    block = lambda b: F.array_join(
        F.filter(F.transform(F.split(b, I.LINE_END), T.strip), lambda x: (x != "") & ~x.rlike(META_LINES)), "\n"
    )
    blocks = F.filter(F.transform(F.split(T.text(F.col("report")), "\n\n"), block), lambda b: (b != "") & ~b.rlike(r"^\d+\)\s+[^\n]*$"))
    return _answer_rows(spark, sf_dir).select("request_id", F.array_join(blocks, "\n\n").alias("answer"))


_PARAGRAPHS = f"list_filter(list_transform(string_split(coalesce(report, ''), chr(10) || chr(10)), lambda p: {sql_strip('p')}), lambda p: p <> '')"
_LINES = rf"list_transform(regexp_split_to_array(p, '\r\n|\n|\r'), lambda x: {sql_strip('x')})"
_SAID = rf"list_filter({_LINES}, lambda x: x <> '' AND NOT starts_with(lower(x), 'citations:') AND NOT regexp_full_match(x, '\d+\)\s*.*'))"
_BARE = r"regexp_replace(x, '^[-*]\s+', '')"
_STATEMENTS = f"list_transform(list_filter(list_transform({_SAID}, lambda x: {sql_strip(_BARE)}), lambda x: x <> ''), lambda x: left(x, 300))"
_CITED_IN = r"list_transform(regexp_extract_all(p || CASE WHEN starts_with(lower(nxt), 'citations:') THEN chr(10) || nxt ELSE '' END, 'chunk_id=([^\]\s]+)', 1), lambda x: x)"


def sql_claims(answers: str) -> str:
    """Claims of the reports of a table or query with request_id and report."""
    return f"""(SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY para, place) - 1 AS ordinal, claim, cited FROM (
      SELECT request_id, para, unnest(said) AS claim, generate_subscripts(said, 1) AS place, cited FROM (
        SELECT request_id, para, CASE WHEN len(said) > 0 THEN said ELSE [left(p, 300)] END AS said, cited FROM (
          SELECT request_id, para, p, {_STATEMENTS} AS said, {_CITED_IN} AS cited FROM (
            SELECT request_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS para, unnest(list_append(ps[2:], '')) AS nxt FROM (SELECT request_id, {_PARAGRAPHS} AS ps FROM {answers}))
          WHERE NOT starts_with(lower(p), 'citations:')))))"""


def claims(answers):
    """Claims of each answer as (request_id, ordinal, claim, cited).

    A paragraph's claims are its lines without list signs, numbered lines and citation lists, or all of it if none is
    left, cut to 300 characters; ``cited`` are the chunks that it, or a citation list right below it, names.
    """
    listed = lambda x: F.lower(x).startswith("citations:")
    paragraphs = F.filter(F.transform(F.split(T.text(F.col("report")), "\n\n"), T.strip), lambda x: x != "")

    def statements(paragraph):
        lines = F.filter(F.transform(F.split(paragraph, I.LINE_END), T.strip), lambda x: (x != "") & ~listed(x) & ~x.rlike(r"^\d+\)\s*.*$"))
        bare = F.filter(F.transform(lines, lambda x: T.strip(F.regexp_replace(x, r"^[-*]\s+", ""))), lambda x: x != "")
        return T.bind(bare, lambda said: F.transform(F.when(F.size(said) > 0, said).otherwise(F.array(paragraph)), lambda x: F.substring(x, 1, 300)))

    rows = answers.select("request_id", paragraphs.alias("ps"))
    following = F.concat(F.slice("ps", 2, F.greatest(F.size("ps"), F.lit(1))), F.array(F.lit("")))
    rows = rows.select("request_id", F.posexplode(F.arrays_zip(F.col("ps").alias("p"), following.alias("nxt"))).alias("at", "b")).where(~listed(F.col("b.p")))
    cited = F.regexp_extract_all(F.concat(F.col("b.p"), F.when(listed(F.col("b.nxt")), F.concat(F.lit("\n"), "b.nxt")).otherwise("")), F.lit(r"chunk_id=([^\]\s]+)"), F.lit(1))
    made = rows.select("request_id", "at", cited.alias("cited"), F.posexplode(statements(F.col("b.p"))).alias("place", "claim"))
    # an answer's claims are few
    ordinal = F.row_number().over(Window.partitionBy("request_id").orderBy("at", "place")) - 1
    return made.select("request_id", ordinal.cast("bigint").alias("ordinal"), "claim", "cited")


CLAIMS = sql_claims(ANSWERS)
#: Some reports with text around their claims: lists, blocks of nothing but numbers, and citations of chunks by name.
_MARKED = """(SELECT request_id, CASE length(request_id || coalesce(report, '')) % 4 WHEN 0 THEN coalesce(report, '') || chr(10) || chr(10) || 'Citations:' || chr(10) || '[source=a chunk_id=' || coalesce({chunk}, 'none') || ']'
    WHEN 1 THEN '1) a numbered line' || chr(10) || '2) another' || chr(10) || chr(10) || '- ' || coalesce(report, '') || ' [source=b chunk_id=' || coalesce({chunk}, 'none') || ']'
    WHEN 2 THEN coalesce(report, '') || chr(10) || chr(10) || 'Citations: none' || chr(10) || chr(10) || '* The limit holds.' ELSE report END AS report FROM {table})"""
MARKED = _MARKED.format(chunk="citations[1].chunk_id", table=ANSWERS)


def marked(answers):
    answers.select("request_id", "report", "citations").createOrReplaceTempView("marked_answers")
    return answers.sparkSession.sql(_MARKED.format(chunk="try_element_at(citations, 1).chunk_id", table="marked_answers").replace("chr(10)", "char(10)")[1:-1])


@register("prj22_claims", f"SELECT request_id, ordinal, claim FROM {CLAIMS}")
def prj22(spark, sf_dir):
    return claims(_answers(spark, sf_dir)).drop("cited")


@register("prj22_marked_claims", f"SELECT request_id, ordinal, claim, array_to_string(cited, ' ') AS cited FROM {sql_claims(MARKED)}")
def prj22_marked(spark, sf_dir):
    """Claims of reports with lists, numbered blocks and citations by name, which the table hardly has."""
    return claims(marked(_answers(spark, sf_dir))).select("request_id", "ordinal", "claim", F.array_join("cited", " ").alias("cited"))


@register("flt1_min_length", f"SELECT chunk_id FROM {CHUNKS} WHERE length({sql_strip("coalesce(page_content, '')")}) >= 80", once=True)
def flt1(spark, sf_dir):
    return _chunk_rows(spark, sf_dir).where(P.long_enough(F.col("page_content"), 80)).select("chunk_id")


_STRIPPED = sql_strip("coalesce(page_content, '')")
SQL_JUNK = rf"""(t = '' OR regexp_matches(t, '(?i)^({P.NAVIGATION})\b') OR coalesce(list_sum(list_transform(regexp_extract_all(t, '{P.CITATION_NOISE}'), lambda m: length(m))), 0) / greatest(length(t), 1) > 0.15
    OR starts_with(t, '^') OR (len(regexp_extract_all(t, '[A-Za-z]{{3,}}')) > 0 AND len(regexp_extract_all(regexp_replace(t, '\p{{L}}', 'x', 'g'), '\b\d{{4}}\b')) / greatest(len(regexp_extract_all(t, '[A-Za-z]{{3,}}')), 1) > 0.25))"""


@register("flt2_junk", f"SELECT chunk_id, {SQL_JUNK} AS junk FROM (SELECT chunk_id, {_STRIPPED} AS t FROM {CHUNKS})", once=True)
def flt2(spark, sf_dir):
    return _chunk_rows(spark, sf_dir).select("chunk_id", P.is_junk(F.col("page_content")).alias("junk"))


SQL_QUALITY = r"""(length(t) >= 80 AND length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) >= greatest(10, floor(length(t) * 0.15)) AND NOT contains(lower(t), 'table of contents') AND NOT (contains(lower(t), 'business portal') AND contains(lower(t), 'wikipedia')))"""


@register("flt3_quality", f"SELECT chunk_id, {SQL_QUALITY} AS passes FROM (SELECT chunk_id, {_STRIPPED} AS t FROM {CHUNKS})", once=True)
def flt3(spark, sf_dir):
    return _chunk_rows(spark, sf_dir).select("chunk_id", P.passes_quality(F.col("page_content")).alias("passes"))


@register("flt4_lookup", f"SELECT chunk_id, source, section_path FROM {CHUNKS} WHERE contains(lower(coalesce(source, '')), 'desk') AND contains(lower(coalesce(section_path, '')), 'limits') ORDER BY chunk_id LIMIT 20")
def flt4(spark, sf_dir):
    """A top-20 report by design."""
    return P.structured_lookup(_chunks(spark, sf_dir), "Desk", "Limits").select("chunk_id", "source", "section_path")


def _any(expression: str, parts) -> str:
    return "(" + " OR ".join(f"contains({expression}, '{p}')" for p in parts) + ")"


SQL_COMPLEXITY = rf"""SELECT id, CASE WHEN s THEN 'simple' WHEN h THEN 'complex' ELSE 'moderate' END AS level, NOT s AS needs_retrieval, NOT s AND h AS needs_fanout, CASE WHEN s THEN 0.8 WHEN h THEN 0.75 ELSE 0.6 END AS confidence FROM (
        SELECT id, h, length(q) < 15 AND NOT h AND NOT regexp_matches(q, '(?i)\b({P.FINANCE_TERMS})\b') AS s FROM (
        SELECT id, q, {_any('lower(q)', P.COMPARE + P.NUMERIC + P.MULTIHOP)} OR len(regexp_extract_all(q, '\?')) > 1 AS h FROM (SELECT id, {sql_strip("coalesce(question, '')")} AS q FROM {ITEMS})))"""


@register("flt5_complexity", SQL_COMPLEXITY, once=True)
def flt5(spark, sf_dir):
    return _item_rows(spark, sf_dir).select("id", P.complexity(F.col("question")).alias("c")).select("id", "c.level", "c.needs_retrieval", "c.needs_fanout", "c.confidence")


SQL_ROUTE = r"""CASE WHEN regexp_matches({0}, '\b(vs|compare|difference)\b') OR contains({0}, '区别') OR contains({0}, '对比') THEN 'compare'
    WHEN regexp_matches({0}, '\b(overview|background|define|definition)\b') OR contains({0}, '是什么') OR contains({0}, '介绍') THEN 'background'
    WHEN regexp_matches({0}, '\b(compute|calculation|calculate|formula)\b') OR contains({0}, '怎么算') OR contains({0}, '公式') THEN 'procedure' ELSE 'default' END"""


@register("flt6_route", f"SELECT id, {SQL_ROUTE.format("lower(question)")} AS route FROM {ITEMS}", once=True)
def flt6(spark, sf_dir):
    return _item_rows(spark, sf_dir).select("id", P.route(F.col("question")).alias("route"))


SQL_TYPE = f"CASE WHEN {_any('{0}', P.TYPE_NUMERIC)} THEN 'numeric' WHEN {_any('{0}', P.TYPE_COMPARE)} THEN 'compare' WHEN {_any('{0}', P.TYPE_PROCEDURE)} THEN 'procedure' WHEN {_any('{0}', P.TYPE_DEFINITION)} THEN 'definition' ELSE 'default' END"


@register("flt7_question_type", f"SELECT id, {SQL_TYPE.format("lower(question)")} AS kind FROM {ITEMS}", once=True)
def flt7(spark, sf_dir):
    return _item_rows(spark, sf_dir).select("id", P.question_type(F.col("question")).alias("kind"))


@register(
    "flt8_sufficiency_tier",
    """SELECT retrieval_id, CASE WHEN coarse_score < 0.1 AND rrf_score < 0.15 THEN 'irrelevant' WHEN coarse_score >= 0.2 AND rrf_score >= 0.3 THEN 'sufficient' ELSE 'insufficient' END AS tier FROM (SELECT DISTINCT retrieval_id, coarse_score, rrf_score FROM retrieved_docs)""",
)
def flt8(spark, sf_dir):
    rows = table(spark, sf_dir, "retrieved_docs").select("retrieval_id", "coarse_score", "rrf_score").distinct()
    return rows.select("retrieval_id", P.sufficiency_tier(F.col("coarse_score"), F.col("rrf_score")).alias("tier"))


@register(
    "flt9_number_context",
    rf"""SELECT request_id, number, CASE WHEN pos = 0 THEN 'unknown' WHEN {_any('around', P.CALCULATION_WORDS)} THEN 'calculated' ELSE 'stated' END AS kind FROM (
        SELECT request_id, number, pos, substr(low, greatest(pos - 50, 1), pos - greatest(pos - 50, 1) + 50) AS around FROM (
        SELECT request_id, number, low, instr(low, CAST(number AS VARCHAR)) AS pos FROM (
        SELECT request_id, lower(report) AS low, unnest(list_distinct(list_transform(regexp_extract_all(report, '\d+'), lambda x: try_cast(x AS BIGINT)))) AS number FROM {ANSWERS} WHERE report IS NOT NULL) WHERE number IS NOT NULL))""",
)
def flt9(spark, sf_dir):
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.col("report"), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("bigint")))
    rows = _answers(spark, sf_dir).where("report is not null").select("request_id", "report", F.explode(found).alias("number")).where("number is not null")
    return rows.select("request_id", "number", P.number_context(F.col("report"), F.col("number")).alias("kind"))


@register(
    "flt10_anchors",
    f"""SELECT chunk_id, trim(coalesce(source, '')) <> '' AND trim(chunk_id) <> '' AND {_STRIPPED} <> '' AND coalesce(coalesce(start_index, start_line, page) >= 0, false) AS complete FROM {CHUNKS}""",
    once=True,
)
def flt10(spark, sf_dir):
    place = [F.col(c).cast("bigint") for c in ("start_index", "start_line", "page")]
    return _chunk_rows(spark, sf_dir).select("chunk_id", P.anchor_complete(F.col("source"), F.col("chunk_id"), F.col("page_content"), *place).alias("complete"))


@register(
    "flt11_valid_citations",
    f"""SELECT request_id, c.chunk_id AS chunk_id, coalesce(c.source, '') <> '' AND coalesce(c.chunk_id, '') <> '' AND contains('/' || regexp_replace(replace(coalesce(c.source, ''), chr(92), '/'), '^/+|/+$', '', 'g') || '/', '/corpus/') AS valid
        FROM (SELECT request_id, unnest(citations) AS c FROM {ANSWERS})""",
)
def flt11(spark, sf_dir):
    rows = _answers(spark, sf_dir).select("request_id", F.explode("citations").alias("c"))
    return rows.select("request_id", "c.chunk_id", P.valid_citation(F.col("c.source"), F.col("c.chunk_id")).alias("valid"))


@register("flt12_refusals", f"SELECT request_id, coalesce(len(citations), 0) = 0 AND {_any('lower(coalesce(report, chr(32)))', P.REFUSAL_WORDS)} AS refused FROM {ANSWERS}", once=True)
def flt12(spark, sf_dir):
    return _answer_rows(spark, sf_dir).select("request_id", P.is_refusal(F.col("report"), F.col("citations")).alias("refused"))


def _expand_sql() -> str:
    values = ", ".join(f"('{a}', {b}, {c}, {d}, {e}, {f})" for a, b, c, d, e, f in P.EXPAND)
    return f"""WITH policy(route, docs, chars, signal, gap, short) AS (VALUES {values}),
      r AS (SELECT d.retrieval_id, d.chunk_id, d.request_id, {SQL_ROUTE.format('lower(a.query)')} AS route, d.coarse_score AS score FROM (SELECT DISTINCT retrieval_id, request_id, chunk_id, coarse_score FROM retrieved_docs WHERE coarse_score IS NOT NULL) d JOIN {ANSWERS} a USING (request_id)),
      k AS (SELECT r.*, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, retrieval_id) - 1 AS rank, max(score) OVER (PARTITION BY request_id) - score AS gap_to FROM r),
      j AS (SELECT k.*, length(coalesce(c.page_content, '')) AS n, CASE WHEN p.signal > 0 THEN k.score >= p.signal ELSE k.score > 0 END AS strong, k.gap_to <= p.gap AS near, length(coalesce(c.page_content, '')) <= p.short AS short, p.docs FROM k JOIN {CHUNKS} c USING (chunk_id) JOIN policy p ON p.route = k.route)
      SELECT retrieval_id, route, CASE WHEN rank >= docs THEN '' WHEN route IN ('compare', 'background', 'procedure') THEN CASE WHEN strong THEN 'parent_signal' WHEN near THEN 'near_top' WHEN short THEN 'short_chunk' ELSE '' END
        WHEN route = 'numeric' THEN CASE WHEN strong AND near AND short THEN 'numeric_backing' ELSE '' END WHEN strong AND near THEN 'default_signal' WHEN near AND short THEN 'default_short_chunk' ELSE '' END AS reason FROM j"""


@register("flt13_expand_policy", _expand_sql())
def flt13(spark, sf_dir):


    docs = table(spark, sf_dir, "retrieved_docs").where("coarse_score is not null").select("retrieval_id", "request_id", "chunk_id", F.col("coarse_score").alias("score")).distinct()
    rows = docs.join(_answers(spark, sf_dir).select("request_id", P.route(F.col("query")).alias("route")), "request_id")
    own = Window.partitionBy("request_id").orderBy(F.desc("score"), "retrieval_id")
    ranked = rows.withColumn("rank", F.row_number().over(own) - 1).withColumn("gap", F.first("score").over(own) - F.col("score"))
    sized = ranked.join(_chunks(spark, sf_dir).select("chunk_id", F.length(T.text(F.col("page_content"))).alias("n")), "chunk_id")
    return sized.select("retrieval_id", "route", P.expand_reason(F.col("route"), F.col("rank"), F.col("n"), F.col("score"), F.col("gap")).alias("reason"))


@register("flt14_include_paths", f"SELECT chunk_id FROM {CHUNKS} WHERE source IN (SELECT source FROM parents WHERE file_type = 'pdf')")
def flt14(spark, sf_dir):
    wanted = table(spark, sf_dir, "parents").where("file_type = 'pdf'").select("source").distinct()
    return _chunks(spark, sf_dir).join(wanted, "source", "left_semi").select("chunk_id")


@register("flt15_subset", f"SELECT request_id FROM {ANSWERS} WHERE item_id IN (SELECT id FROM questions WHERE list_contains(tags, 'compare'))")
def flt15(spark, sf_dir):
    wanted = _items(spark, sf_dir).where(F.array_contains("tags", "compare")).select(F.col("id").alias("item_id"))
    return _answers(spark, sf_dir).join(wanted, "item_id", "left_semi").select("request_id")


# questions of the table name no desk with a limit, so each is also asked with both, in turn written in every way
_ASKED = """SELECT id, 'as is' AS form, coalesce(question, '') AS q FROM {0} UNION ALL
  SELECT id, 'composed', coalesce(question, '') || CASE length(coalesce(question, '')) % 5 WHEN 0 THEN ' Is desk rates/eu-1 over its abs delta limit of 1,250,000.5 on 2024-03-07?'
    WHEN 1 THEN ' Desk FX_spot, limit = 40' WHEN 2 THEN ' delta limit: 7,5 for the credit desk' WHEN 3 THEN ' What is the limit of 5 million?' ELSE ' breach at DESK  Equity limit is 12.75 as of 1999-01-31' END FROM {0}"""


_REQUESTS = rf"""SELECT id, form, CASE WHEN ok THEN desk END AS desk, CASE WHEN ok THEN lim END AS abs_limit, CASE WHEN ok THEN coalesce(nullif(regexp_extract(q, '\b(20\d{{2}}-\d{{2}}-\d{{2}})\b', 1), ''), '2024-01-31') END AS as_of
        FROM (SELECT *, desk IS NOT NULL AND lim IS NOT NULL AND {_any('lower(q)', ('desk', 'delta', 'exposure', 'limit', 'breach'))} AS ok FROM (
          SELECT id, form, q, upper(nullif(regexp_extract(q, '\bdesk\s+([A-Za-z][A-Za-z0-9_\-/]*)', 1, 'i'), '')) AS desk,
            try_cast(replace(nullif(regexp_extract(q, '(?:abs\s+delta\s+limit|delta\s+limit|limit)\s*(?:=|is|of|:)?\s*([0-9][0-9,]*(?:\.\d+)?)', 1, 'i'), ''), ',', '') AS DOUBLE) AS lim
          FROM ({_ASKED.format(ITEMS)})))"""


def _asked_rows(spark, sf_dir):
    _items(spark, sf_dir).select("id", "question").createOrReplaceTempView("asked_items")
    return spark.sql(_ASKED.format("asked_items"))


@register("flt16_exposure_requests", _REQUESTS)
def flt16(spark, sf_dir):
    made = P.exposure_request(F.col("q"), F.lit("2024-01-31"))
    return _asked_rows(spark, sf_dir).select("id", "form", *(c.alias(n) for n, c in made.items()))


@register(
    "udf3_exposure_tool",
    f"""SELECT id, form, 'tool:{X.TOOL}:' || desk || ':' || as_of AS chunk_id, total_delta, abs(total_delta) > abs_limit AS breach, NULL::VARCHAR AS failure,
        'Tool result for desk ' || desk || ' as of ' || as_of || '. Total delta is ' || printf('%.2f', total_delta) || '. Absolute delta limit is ' || printf('%.2f', abs_limit) || '. Limit breach is ' || CASE WHEN abs(total_delta) > abs_limit THEN 'yes' ELSE 'no' END || '.' AS document
        FROM (SELECT *, CASE WHEN seed % 2 = 0 THEN 1 ELSE -1 END * CAST(seed % 900000 + 50000 AS DOUBLE) AS total_delta FROM (SELECT *, CAST('0x' || left(sha1(desk || '|' || as_of || '|' || CAST(abs_limit AS VARCHAR)), 8) AS BIGINT) AS seed FROM ({_REQUESTS}) WHERE desk IS NOT NULL))""",
)
def udf3(spark, sf_dir):
    """The tool's results for all questions that ask for one, as documents."""
    found = X.exposure_tool(_asked_rows(spark, sf_dir), "q", F.lit("2024-01-31"))
    return found.select("id", "form", "chunk_id", "total_delta", "breach", "failure", "document")
