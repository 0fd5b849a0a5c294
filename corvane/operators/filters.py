"""Predicates and routers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T

# Patterns, thresholds and word lists that results depend on.
CITATION_NOISE = r"\[\s*\d+\s*\]|\^\s*\[|\[\s*edit\s*\]|Archived\s+\d{4}|Wayback Machine|ISBN|registered trademark"
NAVIGATION = r"jump to|navigation|search|further information|see also|external links|references|sources|bibliography|log in|contents|move to sidebar|hide|print/export|download as pdf|printable version|in other projects|wikidata item|appearance|permanent link|page information|cite this page|get shortened link|upload file|special pages|about wikipedia|disclaimers|contact wikipedia|code of conduct|developers|statistics|cookie statement|privacy policy|terms of use"
FINANCE_TERMS = r"frtb|cva|dva|xva|kva|fva|mva|colva|delta|gamma|vega|volga|vanna|charm|var|es|margin|default|exposure|collateral|shortfall|isda|bcbs|basel"
COMPARE = ("compare", "difference", "vs", "versus", "between", "distinguish")
NUMERIC = ("calculate", "value", "limit", "threshold", "how much", "how many", "number")
MULTIHOP = ("because", "therefore", "then", "chain")
TYPE_NUMERIC = ("delta", "breach", "exposure", "limit")
TYPE_COMPARE = ("difference", "compare", "vs", "versus", "distinguish", "contrast", "between")
TYPE_PROCEDURE = ("how", "procedure", "process", "workflow", "steps")
TYPE_DEFINITION = ("what is", "define", "meaning of", "stands for")
REFUSAL_WORDS = ("could not find evidence in corpus", "do not know", "not sure", "insufficient", "无法", "不足", "不知道")
CALCULATION_WORDS = ("计算", "等于", "结果是", "得出", "总计", "sum", "total", "calculate", "equals", "results in", "derived", "computed", "approximately", "约")

NAVIGATION_PATTERN = rf"(?i)^({NAVIGATION})\b"
FINANCE_PATTERN = rf"(?i)\b({FINANCE_TERMS})\b"


def long_enough(c: Column, least: int) -> Column:
    return F.length(T.strip(T.text(c))) >= least


def is_junk(c: Column) -> Column:
    """Blank text, navigation, mostly citation marks, a footnote, or a list of years."""
    t = T.strip(T.text(c))
    noise = F.aggregate(F.regexp_extract_all(t, F.lit(f"({CITATION_NOISE})"), F.lit(1)), F.lit(0), lambda n, m: n + F.length(m))
    # a letter of any script next to four digits makes them part of a word
    years = F.regexp_count(F.regexp_replace(t, r"\p{L}", "x"), F.lit(r"\b\d{4}\b"))
    words = F.regexp_count(t, F.lit("[A-Za-z]{3,}"))
    return (
        (t == "")
        | t.rlike(NAVIGATION_PATTERN)
        | (noise / F.greatest(F.length(t), F.lit(1)) > 0.15)
        | t.startswith("^")
        | ((words > 0) & (years / F.greatest(words, F.lit(1)) > 0.25))
    )


def passes_quality(c: Column, least: int = 80) -> Column:
    """Long enough, mostly letters and digits, and not a table of contents or portal page."""

    def passes(t: Column, low: Column) -> Column:
        alnum = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]+", ""))
        return (
            (F.length(t) >= least)
            & (alnum >= F.greatest(F.lit(10), F.floor(F.length(t) * 0.15)))
            & ~F.contains(low, F.lit("table of contents"))
            & ~(F.contains(low, F.lit("business portal")) & F.contains(low, F.lit("wikipedia")))
        )

    return T.bind(T.strip(T.text(c)), lambda t: T.bind(F.lower(t), lambda low: passes(t, low)))


def structured_lookup(df: DataFrame, source: str = "", section: str = "", order: str = "chunk_id", limit: int = 20) -> DataFrame:
    """The first ``limit`` rows, in corpus order, whose source and section hold the given parts; none without a part."""
    if not source and not section:
        return df.limit(0)
    both = F.contains(F.lower(T.text(F.col("source"))), F.lit(source.lower())) & F.contains(
        F.lower(T.text(F.col("section_path"))), F.lit(section.lower())
    )
    return df.where(both).orderBy(order).limit(limit)


def complexity(question: Column) -> Column:
    """How much retrieval a question needs: STRUCT<level, needs_retrieval, needs_fanout, confidence>."""
    q = T.strip(T.text(question))
    low = F.lower(q)
    hard = T.contains_any(low, COMPARE) | T.contains_any(low, NUMERIC) | T.contains_any(low, MULTIHOP) | (F.regexp_count(q, F.lit(r"\?")) > 1)
    simple = (F.length(q) < 15) & ~hard & ~q.rlike(FINANCE_PATTERN)
    level = F.when(simple, "simple").when(hard, "complex").otherwise("moderate")
    confidence = F.when(simple, 0.8).when(hard, 0.75).otherwise(0.6)
    return F.struct(level.alias("level"), (~simple).alias("needs_retrieval"), (~simple & hard).alias("needs_fanout"), confidence.alias("confidence"))


def route(question: Column) -> Column:
    low = F.lower(T.text(question))
    return (
        F.when(low.rlike(r"\b(vs|compare|difference)\b") | T.contains_any(low, ("区别", "对比")), "compare")
        .when(low.rlike(r"\b(overview|background|define|definition)\b") | T.contains_any(low, ("是什么", "介绍")), "background")
        .when(low.rlike(r"\b(compute|calculation|calculate|formula)\b") | T.contains_any(low, ("怎么算", "公式")), "procedure")
        .otherwise("default")
    )


def question_type(question: Column) -> Column:
    low = F.lower(T.text(question))
    return (
        F.when(T.contains_any(low, TYPE_NUMERIC), "numeric")
        .when(T.contains_any(low, TYPE_COMPARE), "compare")
        .when(T.contains_any(low, TYPE_PROCEDURE), "procedure")
        .when(T.contains_any(low, TYPE_DEFINITION), "definition")
        .otherwise("default")
    )


def sufficiency_tier(top: Column, coverage: Column) -> Column:
    return (
        F.when((top < 0.1) & (coverage < 0.15), "irrelevant")
        .when((top >= 0.2) & (coverage >= 0.3), "sufficient")
        .otherwise("insufficient")
    )


def number_context(text: Column, number: Column) -> Column:
    """Whether the first occurrence of a number stands in a calculation, is stated, or isn't found."""
    low = F.lower(T.text(text))
    shown = F.when(number == F.floor(number), number.cast("bigint").cast("string")).otherwise(number.cast("string"))
    at = F.instr(low, shown)
    begin = F.greatest(at - 50, F.lit(1))
    around = F.substring(low, begin, at - begin + 50)
    return F.when(at == 0, "unknown").when(T.contains_any(around, CALCULATION_WORDS), "calculated").otherwise("stated")


def anchor_complete(source: Column, chunk: Column, snippet: Column, *places: Column) -> Column:
    """Source, chunk and snippet given, and the first given place not negative; no place at all is incomplete."""
    given = (T.strip(T.text(source)) != "") & (T.strip(T.text(chunk)) != "") & (T.strip(T.text(snippet)) != "")
    return given & F.coalesce(F.coalesce(*places) >= 0, F.lit(False))


def valid_citation(source: Column, chunk: Column, folder: str = "corpus") -> Column:
    return (T.text(source) != "") & (T.text(chunk) != "") & F.contains(T.slashed_path(source), F.lit(f"/{folder}/"))


def is_refusal(answer: Column, citations: Column) -> Column:
    return (F.coalesce(F.size(citations), F.lit(0)) == 0) & T.contains_any(F.lower(T.text(answer)), REFUSAL_WORDS)


#: How far a parent may be attached, by route.
EXPAND = (
    ("compare", 3, 1800, 0.0, 0.45, 520),
    ("background", 2, 1600, 0.0, 0.35, 420),
    ("procedure", 2, 1400, 0.0, 0.30, 360),
    ("numeric", 1, 700, 0.30, 0.12, 260),
    ("default", 1, 900, 0.20, 0.15, 260),
)


def expand_chars(route_: Column) -> Column:
    """How much of a parent is attached at most."""
    out = F.lit(900)
    for row in EXPAND:
        out = F.when(route_ == row[0], F.lit(row[2])).otherwise(out)
    return out


def expand_reason(route_: Column, rank: Column, chars: Column, signal: Column, gap: Column) -> Column:
    """Why a chunk's parent is attached, or an empty text; ``rank`` counts from 0."""

    def pick(slot: int) -> Column:
        out = F.lit(None)
        for row in EXPAND:
            out = F.when(route_ == row[0], F.lit(row[slot])).otherwise(out)
        return out

    strong = F.when(pick(3) > 0, signal >= pick(3)).otherwise(signal > 0)
    near, short = gap <= pick(4), chars <= pick(5)
    wide = F.when(strong, "parent_signal").when(near, "near_top").when(short, "short_chunk").otherwise("")
    plain = F.when(strong & near, "default_signal").when(near & short, "default_short_chunk").otherwise("")
    return (
        F.when(rank >= pick(1), "")
        .when(route_.isin("compare", "background", "procedure"), wide)
        .when(route_ == "numeric", F.when(strong & near & short, "numeric_backing").otherwise(""))
        .otherwise(plain)
    )


# The words and patterns of a request for an exposure.
REQUEST_WORDS = ("desk", "delta", "exposure", "limit", "breach")
REQUEST_DESK = r"(?i)\bdesk\s+([A-Za-z][A-Za-z0-9_\-/]*)"
REQUEST_LIMIT = r"(?i)(?:abs\s+delta\s+limit|delta\s+limit|limit)\s*(?:=|is|of|:)?\s*([0-9][0-9,]*(?:\.\d+)?)"
REQUEST_DATE = r"\b(20\d{2}-\d{2}-\d{2})\b"


def exposure_request(question: Column, today: Column | None = None) -> dict[str, Column]:
    """Desk, absolute limit and date of an exposure question; all null unless desk and limit are both named.

    The date is ``today`` (the current one by default) where the question has none.
    """
    q = T.text(question)
    found = lambda pattern: F.nullif(F.regexp_extract(q, pattern, 1), F.lit(""))
    desk = F.upper(found(REQUEST_DESK))
    limit = F.regexp_replace(found(REQUEST_LIMIT), ",", "").try_cast("double")
    asked = F.coalesce(found(REQUEST_DATE), today if today is not None else F.date_format(F.current_date(), "yyyy-MM-dd"))
    whole = T.contains_any(F.lower(q), REQUEST_WORDS) & desk.isNotNull() & limit.isNotNull()
    return {"desk": F.when(whole, desk), "abs_limit": F.when(whole, limit), "as_of": F.when(whole, asked)}
