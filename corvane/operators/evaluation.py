"""Relevance joins, grading, gates and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import filters as P
from corvane.session import materialize


def contains_either(a: Column, b: Column) -> Column:
    """Whether one of two non-empty texts holds the other."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def match_judgements(retrieved: DataFrame, judged: DataFrame, by: str) -> DataFrame:
    """Retrieved rows and the judgements they satisfy, in three tiers.

    ``retrieved`` has (by, position, chunk_id, source, section, content) and may have parent_id and expanded,
    ``judged`` (by, qrel_id, chunk_id, source, section, text, relevance) and may have parent_id.  First equal chunks.
    A judgement that names a source, section or parent asks for rows that agree in every one it names, and, if it names
    a chunk too, for one text in the other; it never falls back on text alone.  A judgement of neither chunk nor place
    asks for one text in the other.  Texts are squeezed.  The join is on ``by``; what it pairs is bounded by the lists of
    one request.
    """
    places = ["source", "section", "parent_id"]
    rows = retrieved.select(by, "position", *(_identifier(retrieved, c).alias(c) for c in ["chunk_id", *places]), "content", _identifier(retrieved, "expanded").alias("expanded"))
    q = judged.select(by, "qrel_id", "relevance", *(_identifier(judged, c).alias(f"q_{c}") for c in ["chunk_id", *places]), T.text(F.col("text")).alias("q_text"))
    either = contains_either(T.text(F.col("content")), F.col("q_text")) | contains_either(F.col("expanded"), F.col("q_text"))
    named = F.concat(*(F.col(f"q_{c}") for c in places)) != ""
    agree = F.lit(True)
    for c in places:
        agree = agree & ((F.col(f"q_{c}") == "") | (F.col(c) == F.col(f"q_{c}")))
    loose = F.col("q_chunk_id") == ""
    tier = (
        F.when(~loose & (F.col("chunk_id") == F.col("q_chunk_id")), "chunk")
        .when(named, F.when(agree & (loose | either), "place"))
        .when(loose & either, "text")
    )
    return rows.join(q, by).withColumn("tier", tier).where("tier is not null").select(by, "position", "qrel_id", "relevance", "tier")


def _identifier(df: DataFrame, column: str) -> Column:
    """A column without surrounding blanks, empty where null or absent."""
    return F.trim(T.text(F.col(column))) if column in df.columns else F.lit("")


def retrieval_metrics(retrieved: DataFrame, judged: DataFrame, matches: DataFrame, by: str, ks: tuple[int, ...]) -> DataFrame:
    """Recall, reciprocal rank and nDCG of each judged request; those without a match have zeros.

    Recall counts the judgements of relevance 2 and more, or all if there are
    none, by the position of their first match.  Each matched position adds the
    gain of its best judgement; the ideal takes each judgement once.  Whether dense
    and sparse search gave rows, whether both did and one matched, and by how many
    places the matching row that reranking likes best stands before the one fusion
    does, are told too.
    """
    totals = judged.groupBy(by).agg(
        F.count_if(F.col("relevance") >= 2).alias("primary"), F.count("*").alias("all"), F.array_sort(F.collect_list(-F.col("relevance"))).alias("ideal")
    )
    first = matches.groupBy(by, "qrel_id").agg(F.min("position").alias("position"), F.max("relevance").alias("relevance"))
    counted = first.join(totals.select(by, "primary"), by).where((F.col("primary") == 0) | (F.col("relevance") >= 2))
    hits = counted.groupBy(by).agg(*(F.count_if(F.col("position") <= k).alias(f"hits_{k}") for k in ks))
    gained = matches.groupBy(by, "position").agg(F.max("relevance").alias("relevance"))
    gain = (F.pow(F.lit(2.0), F.col("relevance")) - 1) / F.log2(F.col("position") + 1.0)
    gains = gained.groupBy(by).agg(F.min("position").alias("first"), *(F.sum(F.when(F.col("position") <= k, gain).otherwise(0.0)).alias(f"dcg_{k}") for k in ks))
    ideal = lambda k: F.aggregate(
        F.transform(F.slice("ideal", 1, k), lambda r, i: (F.pow(F.lit(2.0), -r) - 1) / F.log2(i + 2.0)), F.lit(0.0), lambda s, x: s + x
    )
    kinds = retrieved.groupBy(by).agg((F.count("dense_rank") > 0).alias("dense"), (F.count("sparse_rank") > 0).alias("sparse"))
    best = lambda score: F.max_by("position", F.struct(F.coalesce(score, F.lit(0.0)), -F.col("position")))
    lifts = retrieved.join(gained.select(by, "position"), [by, "position"], "left_semi").groupBy(by).agg((best("rrf_score") - best("rerank_score")).alias("uplift"))
    rows = totals.join(hits, by, "left").join(gains, by, "left").join(kinds, by, "left").join(lifts, by, "left")
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0)).cast("double")
    bottom = F.when(F.col("primary") > 0, F.col("primary")).otherwise(F.col("all"))
    return rows.select(
        by,
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        flag(F.col("dense")).alias("dense_hit_rate"),
        flag(F.col("sparse")).alias("sparse_hit_rate"),
        flag(F.col("dense") & F.col("sparse") & F.col("first").isNotNull()).alias("hybrid_gain_rate"),
        F.coalesce(F.col("uplift").cast("double"), F.lit(0.0)).alias("rerank_uplift"),
        *(F.coalesce(F.col(f"hits_{k}") / bottom, F.lit(0.0)).alias(f"recall_{k}") for k in ks),
        *(F.round(F.coalesce(F.col(f"dcg_{k}") / ideal(k), F.lit(0.0)), 6).alias(f"ndcg_{k}") for k in ks),
    )


def supported(sentence: Column, contexts: Column, recall: float = 0.5, literal: int = 12, least: int = 2) -> Column:
    """Whether a sentence has no tokens, stands in a context, or shares enough tokens with one."""
    tokens = T.support_tokens(sentence)
    own = F.size(tokens)
    holds = lambda c: ((F.length(sentence) >= literal) & F.contains(c, sentence)) | (
        (T.overlap(tokens, T.support_tokens(c)) >= least) & (T.overlap(tokens, T.support_tokens(c)) >= recall * own)
    )
    return (own == 0) | F.exists(F.filter(contexts, lambda c: T.text(c) != ""), holds)


def overlap_ratio(wanted: Column, given: Column) -> Column:
    return T.share(T.overlap(wanted, given), F.size(wanted))


def relevancy(question: Column, answer: Column, reference: Column) -> Column:
    """How much of the question, or of question and reference together, an answer takes up."""
    a = T.relevancy_tokens(answer)
    q = overlap_ratio(T.relevancy_tokens(question), a)
    r = overlap_ratio(T.relevancy_tokens(reference), a)
    return F.when(r > 0, F.greatest(q, 0.6 * q + 0.4 * r)).otherwise(q)


def numbers_supported(wanted: Column, given: Column, absolute: float = 1e-6, relative: float = 0.01) -> Column:
    """Whether each number has a counterpart within the tolerances; no numbers are supported."""
    return F.forall(wanted, lambda v: F.exists(given, lambda c: T.near(v, c, absolute, relative)))


# Terms and the words an answer must not use for them.
GLOSSARY = {"delta": ("差值", "difference between"), "gamma": ("射线", "ray"), "vega": ("star", "星星"), "theta": ("angle", "角度")}


def glossary_score(answer: Column) -> Column:
    """Share of the glossary terms in an answer that it doesn't confuse; 1 without a term."""
    low = F.lower(T.text(answer))
    used = sum((F.when(F.contains(low, F.lit(t)), 1).otherwise(0) for t in GLOSSARY), F.lit(0))
    wrong = sum((F.when(F.contains(low, F.lit(t)) & T.contains_any(low, words), 1).otherwise(0) for t, words in GLOSSARY.items()), F.lit(0))
    return F.when(used > 0, 1.0 - wrong / used).otherwise(1.0)


def numeric_score(numbers: Column, candidates: Column, tolerance: float) -> Column:
    """Share of the numbers of an answer that occur among the candidates; 1 without a number."""
    good = F.size(F.filter(numbers, lambda v: F.exists(candidates, lambda c: T.near(v, c, tolerance, tolerance))))
    return F.when(F.size(numbers) > 0, good / F.size(numbers)).otherwise(1.0)


# Words by which a refusal is known, and those by which it says what to do next.
REFUSAL_WORDS = ("不知道", "不清楚", "无法", "不足", "补充", "添加", "do not know", "not sure", "insufficient", "add more")
NEXT_WORDS = ("next", "建议", "可以", "please", "add", "rebuild", "provide", "补充", "添加")


def refusal_gate(docs: Column, evidence: Column, report: Column) -> Column:
    """What is wrong with a report without documents or evidence; null if nothing is."""
    low = F.lower(T.text(report))
    return F.when(
        (docs == 0) | (evidence == 0),
        F.when(F.length(low) < 20, "refusal_incomplete")
        .when(~T.contains_any(low, REFUSAL_WORDS), F.when(docs == 0, "retrieval_empty").otherwise("no_evidence"))
        .when(~T.contains_any(low, NEXT_WORDS), "refusal_unclear"),
    )


def link_claims(claims: DataFrame, evidence: DataFrame, by: str, most: int = 3) -> DataFrame:
    """Evidence of each claim, as (by, ordinal, evidence_id, common, ratio, numbers).

    ``claims`` (by, ordinal, claim, cited), ``evidence`` (by, evidence_id, chunk_id, snippet).  The evidence of the
    chunks a claim cites, else the ``most`` with the largest token overlap, else the first.  Tokens and numbers are
    read once a claim and once an evidence; ``common`` is the overlap, ``ratio`` its share of the claim's tokens,
    ``numbers`` whether the evidence has the claim's numbers.  Claims of a request without evidence keep one row with a
    null ``evidence_id``.  What is paired is bounded by the lists of one request.
    """
    own = claims.select(by, "ordinal", T.token_set_b(F.col("claim")).alias("toks"), T.numbers_gate(F.col("claim")).alias("nums"), "cited")
    given = evidence.select(by, "evidence_id", "chunk_id", T.token_set_b(F.col("snippet")).alias("seen"), T.numbers_gate(F.col("snippet")).alias("values"))
    # of several evidences of a chunk the last counts for its citation
    last = F.row_number().over(Window.partitionBy(by, "chunk_id").orderBy(F.desc("evidence_id"))) == 1
    met = own.join(given.withColumn("last", last), by, "left")
    scored = met.select(
        by, "ordinal", "evidence_id",
        F.when(F.col("evidence_id").isNotNull(), T.overlap(F.col("toks"), F.col("seen"))).alias("common"),
        F.size("toks").alias("size"),
        numbers_supported(F.col("nums"), F.coalesce("values", F.array().cast("array<double>"))).alias("numbers"),
        (F.col("last") & F.array_contains("cited", F.col("chunk_id"))).alias("named"),
    )
    group = Window.partitionBy(by, "ordinal")
    ranked = scored.withColumn("place", F.row_number().over(group.orderBy(F.desc("common"), "evidence_id"))).withColumn("any", F.max(F.coalesce("named", F.lit(False))).over(group))
    kept = F.when(F.col("any"), F.col("named")).otherwise((F.col("place") == 1) | ((F.col("common") > 0) & (F.col("place") <= most)))
    return ranked.where(kept).select(by, "ordinal", "evidence_id", "common", T.share(F.col("common"), F.col("size")).alias("ratio"), "numbers")


def evidence_gate(links: DataFrame, evidence: DataFrame, by: str) -> DataFrame:
    """The first failure of each request: (by, category); requests that pass are left out.

    ``links`` as of ``link_claims``, ``evidence`` (by, complete).  Incomplete
    evidence comes first, then the first failing claim in order: unlinked, not
    supported by any link, or with numbers no link supports.
    """
    incomplete = evidence.where(~F.col("complete")).select(by).distinct().select(by, F.lit(-1).cast("bigint").alias("ordinal"), F.lit("evidence_incomplete").alias("category"))
    judged = links.groupBy(by, "ordinal").agg(
        F.count("evidence_id").alias("links"), F.max("common").alias("common"), F.max("ratio").alias("ratio"), F.max("numbers").alias("numbers")
    )
    category = (
        F.when(F.col("links") == 0, "evidence_missing")
        .when((F.col("common") < 3) | (F.col("ratio") < 0.25), "evidence_not_supporting")
        .when(~F.col("numbers"), "evidence_numeric_mismatch")
    )
    failed = judged.select(by, "ordinal", category.alias("category")).where("category is not null").unionByName(incomplete)
    return failed.groupBy(by).agg(F.min_by("category", "ordinal").alias("category"))


def numeric_gate(report: Column, said: Column, tools: Column, evidence: Column) -> Column:
    """Category and unmatched numbers of a report, null if it passes.

    ``said`` are the numbers of its claims, ``tools`` those of the tool outputs (null if no tool ran), ``evidence`` the
    number of its evidences.  Without tools numbers need some evidence; with them every number that stands in a
    calculation must be among theirs, if they have any.  At most five unmatched numbers are told, the smallest first.
    """
    numbers = F.array_distinct(F.concat(T.numbers_gate(report), said))

    def unmatched(all_numbers: Column) -> Column:
        calculated = F.filter(all_numbers, lambda v: P.number_context(report, v) == "calculated")
        return F.array_sort(F.filter(calculated, lambda v: ~F.exists(tools, lambda c: T.near(v, c, 1e-6, 0.01))))

    def judge(all_numbers: Column) -> Column:
        none = F.array().cast("array<double>")
        open_ = F.when(tools.isNotNull() & (F.size(tools) > 0), unmatched(all_numbers)).otherwise(none)
        category = F.when(F.size(all_numbers) == 0, F.lit(None)).when(
            tools.isNull(), F.when(evidence == 0, "numeric_stated_without_evidence")
        ).when(F.size(open_) > 0, "numeric_calculated_mismatch")
        return F.struct(category.alias("category"), F.slice(open_, 1, 5).alias("unmatched"))

    return T.bind(numbers, judge)


# Metrics that are better when higher, and when lower.
HIGHER = ("citations_coverage", "citation_precision", "numeric_consistency_score", "glossary_consistency_score", "domain_consistency_score", "retrieval_mrr", "retrieval_dense_hit_rate", "retrieval_sparse_hit_rate", "retrieval_hybrid_gain_rate", "retrieval_rerank_uplift", "gate_block_benefit_rate", "reliability_success_rate", "ragas_faithfulness", "ragas_answer_relevancy", "ragas_context_relevancy", "ragas_context_precision_no_ref", "ragas_context_recall", "ragas_answer_correctness", "ragas_response_completeness")
LOWER = ("hallucination_rate_in_citations", "gate_false_kill_rate", "reliability_error_rate", "reliability_timeout_rate", "latency_p50_ms", "latency_p95_ms", "latency_p99_ms", "cost_estimated_usd", "ragas_contradiction_score")
#: Rates that are better when higher, which the suffix rule alone would turn round.
HIGHER_RATES = ("sentence_support_rate", "cache_hit_rate")


def lower_is_better(metric: Column, parity: bool = False) -> Column:
    """The polarity of a metric by name; ``parity`` keeps the suffix rule for all rates."""
    higher = HIGHER if parity else HIGHER + HIGHER_RATES
    return (
        F.when(metric.isin(*higher) | metric.startswith("retrieval_recall_at_") | metric.startswith("retrieval_ndcg_at_"), False)
        .otherwise(metric.isin(*LOWER) | metric.endswith("_rate"))
    )


def compare_metrics(current: DataFrame, baseline: DataFrame, tolerance: float, minimum: float, hallucination_maximum: float = 1.0) -> DataFrame:
    """(metric, current, baseline, delta, regression, failure) of the metrics both reports hold."""
    rows = current.select("metric", F.col("value").alias("current")).join(baseline.select("metric", F.col("value").alias("baseline")), "metric")
    lower = lower_is_better(F.col("metric"))
    delta = F.round(F.col("current") - F.col("baseline"), 9)
    worse = F.when(lower, delta > tolerance).otherwise(delta < -tolerance)
    failed = F.when(lower, (F.col("metric") == "hallucination_rate_in_citations") & (F.col("current") > hallucination_maximum)).otherwise(F.col("current") < minimum)
    return rows.select("metric", "current", "baseline", delta.alias("delta"), worse.alias("regression"), failed.alias("failure"))


def threshold_gate(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """(metric, reason) of the rules a report breaks.  A direction switches the opposite bound off."""
    rows = rules.join(metrics.select("metric", F.col("value").alias("current")), "metric", "left")
    slack = F.abs(F.coalesce("tolerance", F.lit(0.0)))
    low = (F.coalesce("direction", F.lit("")) != "lower_is_better") & (F.col("current") < F.col("minimum") - slack)
    high = (F.coalesce("direction", F.lit("")) != "higher_is_better") & (F.col("current") > F.col("maximum") + slack)
    reason = F.when(F.col("current").isNull(), "missing_metric").when(low, "below_minimum").when(high, "above_maximum")
    return rows.select("metric", reason.alias("reason")).where("reason is not null")


def ordered_first(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def exact_quantiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, float], digits: int = 6) -> DataFrame:
    """Interpolated quantiles of each group, exact, with its ``n``, ``low`` and ``high``.

    Equal values are counted first, which partial aggregation does where the rows are.  The distinct values are then
    range-partitioned, so that a group of any size is spread over many tasks; the counts of whole partitions, of which
    there are few, tell each task at which rank its values begin.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    # the number of its partition is only known of a stored row
    stored = materialize(counted.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()), "quantile-values")
    parts = stored.groupBy(*by, "_part").agg(F.sum("_n").alias("_here"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    parts = parts.select(
        *by, "_part", (F.sum("_here").over(group.orderBy("_part")) - F.col("_here")).alias("_before"), F.sum("_here").over(group).alias("_all")
    )
    matched = parts.withColumnsRenamed({c: f"_{c}" for c in by})
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = stored.join(matched.withColumnRenamed("_part", "_p"), same)
    ranked = joined.withColumn("_upto", F.col("_before") + F.sum("_n").over(Window.partitionBy("_part", *by).orderBy("_v")))
    place = lambda q: (F.col("_all") - 1) * F.lit(q)
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_v")))
    found = ranked.groupBy(*by).agg(
        F.sum("_n").alias("n"),
        F.min("_v").alias("low"),
        F.max("_v").alias("high"),
        *(c for name, q in wanted.items() for c in (at(F.floor(place(q))).alias(f"_{name}a"), at(F.ceil(place(q))).alias(f"_{name}b"))),
    )
    part = lambda q: (F.col("n") - 1) * F.lit(q) - F.floor((F.col("n") - 1) * F.lit(q))
    between = lambda name, q: F.col(f"_{name}a") + (F.col(f"_{name}b") - F.col(f"_{name}a")) * part(q)
    return found.select(*by, "n", "low", "high", *(F.round(between(name, q), digits).alias(name) for name, q in wanted.items()))


def reliability(samples: DataFrame, quantiles: dict[str, float], prices: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """One row of success, error, timeout and cache rates, latency quantiles, mean tokens and their price.

    ``samples`` (ok, timeout, cached, latency, prompt_chars, answer_chars); a token is four characters, ``prices`` are
    of a thousand tokens of prompts and of answers; negative and null latencies don't count.
    """
    n = F.greatest(F.count("*"), F.lit(1))
    rate = lambda c, name: F.round(F.count_if(c) / n, 6).alias(name)
    prompt, answer = F.coalesce(F.avg(F.col("prompt_chars") / 4.0), F.lit(0.0)), F.coalesce(F.avg(F.col("answer_chars") / 4.0), F.lit(0.0))
    rates = samples.agg(
        rate(F.col("ok"), "success_rate"),
        rate(~F.col("ok"), "error_rate"),
        rate(~F.col("ok") & F.col("timeout"), "timeout_rate"),
        rate(F.col("cached"), "cache_hit_rate"),
        F.round(prompt, 6).alias("prompt_tokens"),
        F.round(answer, 6).alias("completion_tokens"),
        F.round(prompt / 1000 * prices[0] + answer / 1000 * prices[1], 9).alias("usd"),
    )
    # a table without latencies has no row of quantiles
    found = exact_quantiles(samples.where("latency >= 0"), [], "latency", quantiles).select(*quantiles)
    return rates.join(found, F.lit(True), "left")


# Words that don't tell one text from another.
GOLD_STOPWORDS = ("the", "and", "for", "with", "that", "this", "from", "are", "was", "were", "will", "have", "has", "had", "not", "but", "its", "their", "than", "when", "what", "which", "who", "whom", "how", "why", "where", "into", "over", "under", "such", "also", "then", "them", "they", "there", "these", "those", "been", "being", "each", "other", "some", "any", "all", "more", "most", "less", "least", "very", "much", "many", "given", "including")


def gold_chunks(wanted: DataFrame, chunks: DataFrame, by: list[str], least: float = 0.4, extras: int = 2) -> DataFrame:
    """The chunk that holds each gold text: (by, gold, file, chunk_id, relevance, score).

    ``wanted`` has (by, gold, file), ``chunks`` (chunk_id, file, section, text).  A chunk of just that text, wherever it
    is, scores 1; else the best of the file by the share of the text in sentences the chunk holds, of which the first 80
    characters are looked for, or of its telling words, ``least`` at the least.  Up to ``extras`` other chunks of the same
    file and section follow with relevance 1.  A gold text is compared with the chunks of its file only.
    """
    own = [*by, "gold", "file"]
    same = chunks.select(T.strip(F.col("text")).alias("bare"), "chunk_id").groupBy("bare").agg(F.min("chunk_id").alias("chunk_id"))
    exact = wanted.withColumn("bare", T.strip(F.col("gold"))).join(same, "bare").select(*own, "chunk_id", F.lit(1.0).alias("score"))
    marked = F.regexp_replace("gold", r"([.!?。])\s+|\n+", "$1\u0001")
    parts = F.filter(F.transform(F.split(marked, "\u0001"), T.strip), lambda s: F.length(s) >= 12)
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower("gold"), F.lit("([a-z]{4,})"), F.lit(1))), lambda w: ~w.isin(*GOLD_STOPWORDS))
    rest = wanted.join(exact.select(*own), own, "left_anti").withColumn("parts", parts).withColumn("words", words)
    met = rest.join(chunks.select("file", "chunk_id", "text", F.lower("text").alias("low")), "file")
    held = F.aggregate(F.filter("parts", lambda s: F.contains(F.col("text"), F.substring(s, 1, 80))), F.lit(0), lambda n, s: n + F.length(s))
    told = T.share(F.size(F.filter("words", lambda w: F.contains(F.col("low"), w))), F.size("words"))
    score = F.round(F.greatest(held / F.length("gold"), told), 6)
    # the least of (-score, chunk) is kept where the pairs are, and each pair is scored once
    found = met.select(*own, F.struct((-score).alias("s"), "chunk_id").alias("c")).groupBy(*own).agg(F.min("c").alias("c"))
    scored = found.select(*own, F.col("c.chunk_id").alias("chunk_id"), (-F.col("c.s")).alias("score")).where(F.col("score") >= least)
    best = materialize(exact.unionByName(scored), "gold-best")
    placed = best.join(chunks.select("chunk_id", "section"), "chunk_id").where("section <> ''").select(*own, "section", F.col("chunk_id").alias("_best"))
    # ranked where the chunks of a section are, so that each place is looked up once
    near = chunks.where("section <> ''").select("file", "section", "chunk_id").withColumn("_n", F.row_number().over(Window.partitionBy("file", "section").orderBy("chunk_id"))).where(F.col("_n") <= extras + 1)
    others = placed.join(near, ["file", "section"]).where("chunk_id <> _best")
    others = others.withColumn("_k", F.row_number().over(Window.partitionBy(*own).orderBy("chunk_id"))).where(F.col("_k") <= extras)
    return best.select(*own, "chunk_id", F.lit(2).alias("relevance"), "score").unionByName(others.select(*own, "chunk_id", F.lit(1).alias("relevance"), F.lit(None).cast("double").alias("score")))
