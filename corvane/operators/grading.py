"""How well the documents of a request answer its question: relevance, coverage, diversity and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import filters as P

# Terms of the trade, words that weigh more by the kind of question, and words that speak for numbers.
CORE_TERMS = ("frtb", "cva", "xva", "dva", "fva", "kva", "mva", "colva", "delta", "gamma", "vega", "theta", "rho", "volga", "vanna", "charm", "var", "es", "expected", "shortfall", "initial", "margin", "variation", "wrong-way", "right-way", "netting", "csa", "collateral")
KIND_WEIGHTS = {
    "definition": {"is": 2.0, "stands": 2.0, "means": 2.0, "refers": 2.0, "definition": 3.0},
    "compare": {"difference": 3.0, "similarity": 3.0, "versus": 2.0, "compared": 2.0, "contrast": 2.0},
    "procedure": {"steps": 2.0, "process": 2.0, "workflow": 2.0, "first": 1.5, "then": 1.5, "finally": 1.5},
    "numeric": {"formula": 3.0, "calculate": 2.5, "equals": 2.0, "value": 1.5, "limit": 2.0, "threshold": 2.0},
}
NUMBER_TERMS = ("discount", "ead", "es", "lgd", "maturity", "notional", "percent", "probability", "shortfall", "var")
CORE, SMALL, PLAIN, LEAST_TOTAL = 2.5, 0.2, 1.0, 8.0


def weight(token: Column, kind: Column) -> Column:
    """What a token of a question of some kind counts."""
    base = F.when(token.isin(*CORE_TERMS), CORE).when((F.length(token) < 2) | token.isin(*T.FOCUS_STOPWORDS), SMALL).otherwise(PLAIN)
    raised = F.lit(0.0)
    for name, words in KIND_WEIGHTS.items():
        for word, value in words.items():
            raised = F.when((kind == name) & (token == word), value).otherwise(raised)
    return F.greatest(base, raised)


def weighed_questions(questions: DataFrame, by: str, question: str) -> DataFrame:
    """(by, kind, tokens, focus, total): the weighed tokens of each question, those that matter, and the sum of weights."""
    rows = questions.select(by, P.question_type(F.col(question)).alias("kind"), F.array_distinct(T.tokens_a(F.col(question))).alias("own"))
    focus = F.filter("own", lambda t: (F.length(t) >= 2) & ~t.isin(*T.FOCUS_STOPWORDS))
    # kinds differ in a few words only, so each token is weighed once where the question is
    tokens = F.transform("own", lambda t: F.struct(t.alias("token"), weight(t, F.col("kind")).alias("weight")))
    rows = rows.select(by, "kind", tokens.alias("tokens"), focus.alias("focus"))
    return rows.withColumn("total", F.round(_weights(F.col("tokens")), 6))


def _weights(tokens: Column) -> Column:
    return F.aggregate(tokens, F.lit(0.0), lambda s, t: s + t["weight"])


def grade_documents(questions: DataFrame, docs: DataFrame, by: str, question: str) -> DataFrame:
    """One verdict a request with documents.

    ``docs`` has (by, place, source, section, parent_id, content, expanded, gap): the place counts from 1, ``expanded``
    is the parent's text if it was attached, ``gap`` the distance to the best score.  A document's relevance is the
    weight of the question's tokens it holds over their total, of at least LEAST_TOTAL.  Returns relevance of the best
    and on average, documents that support and that are of use, coverage of the focus tokens and of all weights, sources
    and parents, whether there are numbers, the share the first document covers, the penalty for many chunks of a
    parent, and whether all that is sufficient, with the reason.
    """
    asked = weighed_questions(questions, by, question)
    given = docs.select(
        by, "place", F.nullif(F.trim(T.text(F.col("source"))), F.lit("")).alias("source"), F.nullif(F.trim(T.text(F.col("parent_id"))), F.lit("")).alias("parent_id"), "gap",
        F.lower(T.text(F.col("content"))).alias("content"), F.lower(T.text(F.col("expanded"))).alias("expanded"), F.lower(T.text(F.col("section"))).alias("section"),
    )
    given = given.withColumn("toks", F.array_distinct(T.tokens_a(F.when(F.col("expanded") != "", F.col("expanded")).otherwise(F.col("content")))))
    whole = F.concat_ws(" ", "expanded", "content", "section")
    given = given.withColumn("digits", whole.rlike(r"\p{Nd}")).withColumn("number_terms", F.arrays_overlap(T.tokens_a(whole), T.words(*NUMBER_TERMS)))
    met = given.join(asked, by)
    holds = lambda t: F.contains(F.col("expanded"), t) | F.contains(F.col("content"), t) | F.contains(F.col("section"), t)
    hit = F.round(_weights(F.filter("tokens", lambda t: F.array_contains("toks", t["token"]))), 6)
    first = F.filter("tokens", lambda t: F.contains(F.col("content"), t["token"]) | F.contains(F.col("section"), t["token"]))
    scored = met.select(
        by, "parent_id", "source", "kind", "total", "focus", "tokens", hit.alias("hit"), F.round(hit / F.greatest("total", F.lit(LEAST_TOTAL)), 9).alias("isrel"), "gap",
        F.array_intersect("focus", "toks").alias("seen"), F.filter("tokens", lambda t: holds(t["token"])).alias("covered"),
        (F.col("digits") | (F.arrays_overlap("focus", T.words(*NUMBER_TERMS)) & F.col("number_terms"))).alias("numeric"),
        F.when(F.col("place") == 1, _weights(first)).alias("top"),
    )
    useful = F.when(F.col("gap").isNotNull(), F.col("gap") <= 0.4).otherwise(F.col("isrel") >= 0.15)
    # chunks of a parent first, whose number is capped by the lists of a request
    parents = scored.groupBy(by, "parent_id").agg(
        F.count("*").alias("n"), F.max("isrel").alias("best"), F.sum("isrel").alias("sum"), F.count_if(F.col("hit") >= 2.0).alias("supporting"), F.count_if(useful).alias("useful"),
        F.collect_set("source").alias("sources"), F.flatten(F.collect_set("seen")).alias("seen"), F.flatten(F.collect_set("covered")).alias("covered"), F.max("numeric").alias("numeric"),
        F.max("top").alias("top"), *(F.first(c).alias(c) for c in ("kind", "total", "focus")),
    )
    surplus = F.when(F.col("parent_id").isNotNull() & (F.col("n") > 3), (F.col("n") - 3) * 0.05).otherwise(0.0)
    united = parents.groupBy(by).agg(
        F.sum("n").alias("documents"), F.max("best").alias("top_isrel"), F.round(F.sum("sum") / F.sum("n") + 1e-10, 6).alias("avg_isrel"), F.sum("supporting").alias("supporting"), F.sum("useful").alias("useful"),
        F.size(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"), F.count("parent_id").alias("parents"), F.max("numeric").alias("numeric_evidence"),
        F.array_distinct(F.flatten(F.collect_set("seen"))).alias("seen"), F.array_distinct(F.flatten(F.collect_set("covered"))).alias("covered"),
        F.max("top").alias("top"), F.round(F.least(F.sum(surplus), F.lit(0.3)), 6).alias("redundancy_penalty"), *(F.first(c).alias(c) for c in ("kind", "total", "focus")),
    )
    rows = united.select(
        by, "kind", "documents", "top_isrel", "avg_isrel", "supporting", "useful", "sources", "parents", "numeric_evidence", "redundancy_penalty",
        F.round(T.share(F.size("seen"), F.size("focus")), 9).alias("query_coverage"), F.round(T.share(_weights(F.col("covered")), F.col("total")), 9).alias("claim_coverage"),
        F.round(F.coalesce("top", F.lit(0.0)) / F.greatest("total", F.lit(1.0)), 9).alias("top_claim_score"),
    )
    return rows.withColumn("reason", verdict()).withColumn("sufficient", F.col("reason").startswith("ok")).withColumn("tier", P.sufficiency_tier(F.col("top_isrel"), F.col("claim_coverage")))


def verdict() -> Column:
    """Whether the documents suffice, by the kind of the question, as a reason."""
    query, claim, top = F.col("query_coverage"), F.col("claim_coverage"), F.col("top_isrel")
    varied = (F.col("sources") >= 2) | (F.col("parents") >= 2)
    rules = (
        ("compare", (query >= 0.3) & (claim >= 0.4) & varied & (top >= 0.35), "ok_compare", "compare_needs_broader_coverage"),
        ("numeric", (query >= 0.25) & (claim >= 0.3) & F.col("numeric_evidence"), "ok_numeric", "numeric_backing_weak"),
        ("procedure", (query >= 0.25) & (claim >= 0.3) & (F.col("parents") >= 1), "ok_procedure", "procedure_context_thin"),
        ("definition", (query >= 0.3) & (claim >= 0.4) & (F.col("top_claim_score") >= 0.5), "ok_definition", "definition_coverage_thin"),
    )
    out = F.when((query >= 0.25) & (claim >= 0.3) & (top >= 0.3), "ok").otherwise("coverage_thin")
    for kind, good, yes, no in rules:
        out = F.when(F.col("kind") == kind, F.when(good, yes).otherwise(no)).otherwise(out)
    return F.when((top < 0.2) | (F.col("supporting") == 0), "low_relevance").otherwise(out)
