"""Queries of the scalar functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.evaluation import exact_quantiles
from corvane.operators.tools import mock_exposure
from corvane.plans.catalog import register
from corvane.session import spread, table

SQL_A = r"list_transform(regexp_extract_all(coalesce({0}, ''), '[A-Za-z0-9\x{{4e00}}-\x{{9fff}}]+'), lambda x: lower(x))"
SQL_B = r"regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+|[\x{{4e00}}-\x{{9fff}}]+')"


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def sql_strip(expression: str) -> str:
    return rf"regexp_replace({expression}, '^\s+|\s+$', '', 'g')"


def sql_squeeze(expression: str) -> str:
    stripped = sql_strip(f"coalesce({expression}, '')")
    return rf"lower(regexp_replace({stripped}, '\s+', ' ', 'g'))"


def sql_singular(token: str) -> str:
    return (
        f"CASE WHEN length({token}) > 4 AND {token} LIKE '%ies' THEN left({token}, -3) || 'y' "
        f"WHEN length({token}) > 3 AND {token} LIKE '%s' AND {token} NOT LIKE '%ss' THEN left({token}, -1) ELSE {token} END"
    )


def sql_relevancy(expression: str) -> str:
    tokens = f"list_transform({SQL_B.format(expression)}, lambda y: {sql_singular('y')})"
    return f"list_distinct(list_filter({tokens}, lambda z: NOT list_contains({sql_list(T.RELEVANCY_STOPWORDS)}, z)))"


def sql_support(expression: str) -> str:
    return (
        f"list_distinct(list_filter({SQL_B.format(expression)}, lambda z: NOT list_contains({sql_list(T.SUPPORT_STOPWORDS)}, z) "
        r"AND (length(z) > 1 OR regexp_matches(z, '^[\x{4e00}-\x{9fff}]'))))"
    )


def _item_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions as they come, some repeated."""
    return spread(table(spark, sf_dir, "questions"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions, each once."""
    return table(spark, sf_dir, "questions").dropDuplicates(["id"])


def _chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as they come, without the load time."""
    return spread(table(spark, sf_dir, "chunks").drop("indexed_at"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, each once."""
    return table(spark, sf_dir, "chunks").drop("indexed_at").dropDuplicates(["chunk_id"])


def _answer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answered requests as they come, without the load time."""
    return spread(table(spark, sf_dir, "structured_payload").drop("loaded_at"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answered requests, each once."""
    return table(spark, sf_dir, "structured_payload").drop("loaded_at").dropDuplicates(["request_id"])


ITEMS = "(SELECT * FROM questions QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at) = 1)"
CHUNKS = "(SELECT * EXCLUDE (indexed_at) FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at) = 1)"
ANSWERS = "(SELECT * FROM structured_payload QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY loaded_at) = 1)"


@register("str1_tokens_mixed", f"SELECT chunk_id, len(t) AS n, array_to_string(t, ' ') AS tokens FROM (SELECT chunk_id, {SQL_A.format('page_content')} AS t FROM {CHUNKS})", once=True)
def str1(spark, sf_dir):
    t = T.tokens_a(F.col("page_content"))
    return _chunk_rows(spark, sf_dir).select("chunk_id", F.size(t).cast("bigint").alias("n"), F.array_join(t, " ").alias("tokens"))


@register("str2_tokens_split", f"SELECT id, len(t) AS n, array_to_string(t, ' ') AS tokens FROM (SELECT id, {SQL_B.format('reference_answer')} AS t FROM {ITEMS})", once=True)
def str2(spark, sf_dir):
    t = T.tokens_b(F.col("reference_answer"))
    return _item_rows(spark, sf_dir).select("id", F.size(t).cast("bigint").alias("n"), F.array_join(t, " ").alias("tokens"))


@register(
    "str3_stopwords",
    " UNION ALL ".join(
        f"SELECT '{name}' AS list_name, id, array_to_string(list_filter({SQL_B.format('question')}, lambda x: NOT list_contains({sql_list(stop)}, x)), ' ') AS kept FROM {ITEMS}"
        for name, stop in T.STOPWORD_LISTS.items()
    ),
    once=True,
)
def str3(spark, sf_dir):
    kept = F.array(
        *(
            F.struct(F.lit(name).alias("list_name"), F.array_join(T.without_stopwords(T.tokens_b(F.col("question")), name), " ").alias("kept"))
            for name in T.STOPWORD_LISTS
        )
    )
    return _item_rows(spark, sf_dir).select("id", F.explode(kept).alias("k")).select("k.list_name", "id", "k.kept")


@register("str4_stemmed", f"SELECT id, array_to_string(list_sort({sql_relevancy('reference_answer')}), ' ') AS stems FROM {ITEMS}", once=True)
def str4(spark, sf_dir):
    return _item_rows(spark, sf_dir).select("id", F.array_join(F.array_sort(T.relevancy_tokens(F.col("reference_answer"))), " ").alias("stems"))


@register(
    "str5_normalised",
    rf"""SELECT retrieval_id, {sql_squeeze('section_path')} AS section,
      '/' || regexp_replace(replace(coalesce(source, ''), chr(92), '/'), '^/+|/+$', '', 'g') || '/' AS path,
      regexp_replace(regexp_replace(lower({sql_strip("coalesce(section_path, '')")}), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS label
      FROM (SELECT DISTINCT retrieval_id, section_path, source FROM retrieved_docs)""",
)
def str5(spark, sf_dir):
    rows = table(spark, sf_dir, "retrieved_docs").select("retrieval_id", "section_path", "source").distinct()
    return rows.select(
        "retrieval_id", T.squeeze(F.col("section_path")).alias("section"), T.slashed_path(F.col("source")).alias("path"), T.label(F.col("section_path")).alias("label")
    )


_TAGGED = "report || ' ' || array_to_string(list_transform(citations, lambda c: '[source=' || coalesce(c.source, '') || ' chunk_id=' || coalesce(c.chunk_id, '') || ']'), ' ')"


def _with_tags(answers: DataFrame) -> DataFrame:
    tag = lambda c: F.concat(F.lit("[source="), T.text(c["source"]), F.lit(" chunk_id="), T.text(c["chunk_id"]), F.lit("]"))
    tags = F.array_join(F.transform("citations", tag), " ")
    return answers.withColumn("tagged", F.concat(T.text(F.col("report")), F.lit(" "), T.text(tags)))


@register(
    "str6_cited_chunks",
    rf"""SELECT request_id, unnest(list_distinct(regexp_extract_all(coalesce(report, '') || ' ' || coalesce({_TAGGED[len("report || ' ' || "):]}, ''), 'chunk_id=([^\]\s]+)', 1))) AS chunk_id FROM {ANSWERS}""",
)
def str6(spark, sf_dir):
    return _with_tags(_answers(spark, sf_dir)).select("request_id", F.explode(T.cited_chunk_ids(F.col("tagged"))).alias("chunk_id"))


@register(
    "str7_sentences",
    rf"""SELECT request_id, unnest(list_filter(list_transform(regexp_split_to_array(coalesce(report, ''), '[。！？!?.]+\s*|\n+'), lambda s: {sql_strip('s')}), lambda s: s <> '')) AS sentence FROM {ANSWERS}""",
)
def str7(spark, sf_dir):
    return _answers(spark, sf_dir).select("request_id", F.explode(T.sentences(F.col("report"))).alias("sentence"))


@register(
    "str8_overlap",
    f"""SELECT request_id, common, round(CASE WHEN asked > 0 THEN common / asked ELSE 0.0 END, 6) AS coverage FROM (
      SELECT request_id, len(list_intersect(q, r)) AS common, len(q) AS asked FROM (
        SELECT request_id, list_distinct({SQL_B.format('query')}) AS q, list_distinct({SQL_B.format('report')}) AS r FROM {ANSWERS}))""",
    once=True,
)
def str8(spark, sf_dir):
    q, r = T.token_set_b(F.col("query")), T.token_set_b(F.col("report"))
    rows = _answer_rows(spark, sf_dir).select("request_id", T.overlap(q, r).cast("bigint").alias("common"), F.size(q).alias("asked"))
    return rows.select("request_id", "common", F.round(T.share(F.col("common"), F.col("asked")), 6).alias("coverage"))


_PARSE = "list_filter(list_transform({0}, lambda m: CASE WHEN m LIKE '%\\%' ESCAPE '\\' THEN try_cast(regexp_replace(m, '[,%]', '', 'g') AS DOUBLE) / 100.0 ELSE try_cast(regexp_replace(m, '[,%]', '', 'g') AS DOUBLE) END), lambda v: v IS NOT NULL)"
_NO_TAG = r"regexp_replace({0}, '\[source=[^\]]*?chunk_id=[^\]]*?\]', ' ', 'gi')"
_NO_PLACE = r"regexp_replace({0}, '\b(page|doc|document|section|chapter)\s*#?\s*\d+(?:\.\d+)?', ' ', 'gi')"
_NO_DOMAIN_PLACE = r"regexp_replace({0}, '\b(page|doc|document|section|chapter|chunk)\s*#?\s*\d+(?:\.\d+)?', ' ', 'gi')"
# the stop after a list number belongs to the next match too, which takes a second pass without look-ahead
_NO_LIST = r"regexp_replace({0}, '(^|\n)\s*\d+(?:\.\d+)*[.)](\s)', ' \2', 'g')"


def _sql_gate(report: str) -> str:
    chunks = rf"regexp_replace({_NO_TAG.format(f"coalesce({report}, '')")}, '\bchunk[_:-]?\d+\b', ' ', 'gi')"
    return _PARSE.format(rf"regexp_extract_all({_NO_PLACE.format(chunks)}, '-?\d+(?:\.\d+)?%?')")


def _sql_domain(report: str) -> str:
    bare = _NO_TAG.format(_NO_DOMAIN_PLACE.format(f"coalesce({report}, '')"))
    bare = rf"regexp_replace({bare}, '\((page|doc)\s*#?\s*\d+(?:\.\d+)?\)', ' ', 'gi')"
    return _PARSE.format(rf"regexp_extract_all({_NO_LIST.format(_NO_LIST.format(bare))}, '-?\d+(?:,\d{{3}})*(?:\.\d+)?%?')")


class _Template:
    """SQL with a place for an expression, filled by ``format`` like a text."""

    def __init__(self, make):
        self.format = make


SQL_GATE_NUMBERS = _Template(_sql_gate)
SQL_DOMAIN_NUMBERS = _Template(_sql_domain)
_PROBES = [
    (1, "chunk:12 and section-3 and [source=x] 7"), (2, "50% of 3.5, see chunk_12 on page 3 [source=a chunk_id=b7]"), (3, "1. first 1,250\n2) second (page 4) -7\n3.1. third 12%"),
    (4, "chunk-9 chunk9 chunk 9 Doc #4.2 +5"), (5, ""), (6, None),
]
_PROBES_SQL = "(VALUES " + ", ".join(f"({i}, {'NULL' if t is None else chr(39) + t.replace(chr(39), chr(39) * 2) + chr(39)})" for i, t in _PROBES) + ") t(id, report)"


@register("num1_gate_numbers", f"SELECT request_id, unnest({SQL_GATE_NUMBERS.format('report')}) AS number FROM {ANSWERS}")
def num1(spark, sf_dir):
    return _answers(spark, sf_dir).select("request_id", F.explode(T.numbers_gate(F.col("report"))).alias("number"))


@register("num1_marked_numbers", f"SELECT id, unnest({SQL_GATE_NUMBERS.format('report')}) AS number FROM {_PROBES_SQL}")
def num1_marked(spark, sf_dir):
    """Numbers beside chunk names, places and source tags, which the tables hardly have."""
    return spark.createDataFrame(_PROBES, "id int, report string").select("id", F.explode(T.numbers_gate(F.col("report"))).alias("number"))


@register("num2_domain_numbers", f"SELECT request_id, unnest({SQL_DOMAIN_NUMBERS.format('report')}) AS number FROM {ANSWERS}")
def num2(spark, sf_dir):
    return _answers(spark, sf_dir).select("request_id", F.explode(T.numbers_domain(F.col("report"))).alias("number"))


@register("num2_marked_numbers", f"SELECT id, unnest({SQL_DOMAIN_NUMBERS.format('report')}) AS number FROM {_PROBES_SQL}")
def num2_marked(spark, sf_dir):
    return spark.createDataFrame(_PROBES, "id int, report string").select("id", F.explode(T.numbers_domain(F.col("report"))).alias("number"))


@register("num3_json_numbers", "SELECT event_id, try_cast(unnest(json_extract_string(props, '$.*')) AS DOUBLE) AS number FROM events WHERE props IS NOT NULL")
def num3(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("props is not null")
    values = F.map_values(F.from_json("props", "map<string,string>"))
    return rows.select("event_id", F.explode(values).alias("v")).select("event_id", F.col("v").try_cast("double").alias("number"))


@register(
    "num4_quantiles",
    """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99
       FROM events WHERE value IS NOT NULL GROUP BY event_type""",
)
def num4(spark, sf_dir):
    found = exact_quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return found.select("event_type", "p50", "p95", "p99")


@register(
    "num5_safe_cast",
    rf"""SELECT request_id, coalesce(try_cast(replace({sql_strip("m")}, ',', '') AS DOUBLE), 0.0) AS number
       FROM (SELECT request_id, regexp_extract(coalesce(report, ''), '([\d,.]+) (million|inputs|paths|reports)', 1) AS m FROM {ANSWERS})""",
    once=True,
)
def num5(spark, sf_dir):
    found = F.regexp_extract(T.text(F.col("report")), r"([\d,.]+) (million|inputs|paths|reports)", 1)
    return _answer_rows(spark, sf_dir).select("request_id", T.safe_number(found).alias("number"))


@register(
    "num6_mock_exposure",
    """SELECT s_name, CASE WHEN seed % 2 = 0 THEN 1 ELSE -1 END * CAST(seed % 900000 + 50000 AS DOUBLE) AS total_delta,
              seed % 900000 + 50000 > 600000 AS breach
       FROM (SELECT s_name, CAST('0x' || left(sha1(s_name || '|2024-01-31|600000.0'), 8) AS BIGINT) AS seed FROM supplier)""",
)
def num6(spark, sf_dir):
    made = mock_exposure(F.col("s_name"), F.lit("2024-01-31"), F.lit("600000.0"))
    return table(spark, sf_dir, "supplier").select("s_name", *(c.alias(n) for n, c in made.items()))


@register(
    "json1_tolerant",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE props IS NOT NULL AND json_valid(props) AND json_type(props) = 'OBJECT'""",
)
def json1(spark, sf_dir):
    # each object comes in one of the three wrappings a model may put around it
    wrapped = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(
        F.col("event_id") % 3 == 1, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    ).otherwise(F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" as asked.")))
    rows = table(spark, sf_dir, "events").where("props is not null").select("event_id", T.json_object(wrapped).alias("found"))
    return rows.where("found is not null").select("event_id", F.get_json_object("found", "$.k").try_cast("bigint").alias("k"))


@register("json2_nested_key", "SELECT event_id, try_cast(json_extract_string('{\"debug\": {\"inner\": ' || props || '}}', '$.debug.inner.k') AS BIGINT) AS k FROM events WHERE props IS NOT NULL")
def json2(spark, sf_dir):
    nested = F.concat(F.lit('{"debug": {"inner": '), F.col("props"), F.lit("}}"))
    return table(spark, sf_dir, "events").where("props is not null").select(
        "event_id", F.try_variant_get(F.parse_json(nested), "$.debug.inner.k", "bigint").alias("k")
    )


@register("hash1_digests", f"SELECT chunk_id, sha1(page_content) AS sha1, md5(page_content) AS md5, sha256(page_content) AS sha256 FROM {CHUNKS} WHERE page_content IS NOT NULL", once=True)
def hash1(spark, sf_dir):
    c = F.col("page_content").cast("binary")
    return _chunk_rows(spark, sf_dir).where("page_content is not null").select("chunk_id", F.sha1(c).alias("sha1"), F.md5(c).alias("md5"), F.sha2(c, 256).alias("sha256"))


@register(
    "date1_stamps",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp, epoch_us(ts) // 1000 AS ms FROM events""",
)
def date1(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"),
        F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("stamp"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
    )


@register(
    "arr1_ordered_distinct",
    f"""SELECT id, array_to_string(t, '|') AS merged, list_contains(t, 'theta') AS has_theta, len(t[1:3]) AS first_three FROM (
        SELECT id, list_transform(list_filter(list_zip(a, range(1, len(a) + 1)), lambda p: list_position(a, p[1]) = p[2]), lambda p: p[1]) AS t
        FROM (SELECT id, list_concat({SQL_A.format('question')}, {SQL_A.format('reference_answer')}) AS a FROM {ITEMS}))""",
    once=True,
)
def arr1(spark, sf_dir):
    merged = F.array_distinct(F.concat(T.tokens_a(F.col("question")), T.tokens_a(F.col("reference_answer"))))
    return _item_rows(spark, sf_dir).select(
        "id",
        F.array_join(merged, "|").alias("merged"),
        F.array_contains(merged, "theta").alias("has_theta"),
        F.size(F.slice(merged, 1, 3)).cast("bigint").alias("first_three"),
    )


@register("map1_skeleton", "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, coalesce(json_extract_string(props, '$.absent'), 'default') AS absent FROM events")
def map1(spark, sf_dir):
    given = F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>"))
    skeleton = F.create_map(F.lit("k"), F.lit("-1"), F.lit("absent"), F.lit("default"))
    merged = F.map_concat(F.map_filter(skeleton, lambda k, _: ~F.map_contains_key(given, k)), F.map_filter(given, lambda k, _: k.isin("k", "absent")))
    return table(spark, sf_dir, "events").select(
        "event_id", F.element_at(merged, "k").try_cast("bigint").alias("k"), F.element_at(merged, "absent").alias("absent")
    )
