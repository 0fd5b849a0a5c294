"""Column builders for text: tokenizers, normalisers, sentences, numbers.  All stay JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token classes and word lists that results depend on.
TOKEN_A = r"[A-Za-z0-9一-鿿]+"
TOKEN_B = r"[a-z0-9]+|[一-鿿]+"
QUERY_STOPWORDS = ("what", "why", "how", "when", "where", "who", "which", "explain", "define", "介绍", "解释", "是什么", "怎么", "如何", "为什么", "请问", "帮我")
FOCUS_STOPWORDS = ("a", "an", "and", "are", "as", "at", "between", "compare", "difference", "does", "explain", "for", "how", "in", "is", "of", "or", "the", "to", "vs", "versus", "what", "why")
SUFFICIENCY_STOPWORDS = ("the", "a", "an", "and", "or", "to", "of", "in", "on", "for", "with", "is", "are", "was", "were", "what", "why", "how", "when", "where", "who", "explain", "define", "give", "list")
SUPPORT_STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with", "we", "you", "i", "they", "he", "she", "them", "us", "our", "your", "的", "了", "在", "是", "和", "与", "及", "或", "也", "都", "就", "而", "对", "把", "将")
RELEVANCY_STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with", "what", "how", "why", "explain", "describe", "context", "meaning", "的", "了", "在", "是")
STOPWORD_LISTS = {
    "query": QUERY_STOPWORDS,
    "focus": FOCUS_STOPWORDS,
    "sufficiency": SUFFICIENCY_STOPWORDS,
    "support": SUPPORT_STOPWORDS,
    "relevancy": RELEVANCY_STOPWORDS,
}
# What is taken out of a text before its numbers are read, and the numbers.
SOURCE_TAG = r"(?i)\[source=[^\]]*?chunk_id=[^\]]*?\]"
GATE_CHUNKS = r"(?i)\bchunk[_:-]?\d+\b"
GATE_PLACES = r"(?i)\b(page|doc|document|section|chapter)\s*#?\s*\d+(?:\.\d+)?"
GATE_NUMBER = r"(-?\d+(?:\.\d+)?%?)"
DOMAIN_PLACES = r"(?i)\b(page|doc|document|section|chapter|chunk)\s*#?\s*\d+(?:\.\d+)?"
DOMAIN_PARENTHESES = r"(?i)\((?:page|doc)\s*#?\s*\d+(?:\.\d+)?\)"
LIST_NUMBER = r"(^|\n)\s*\d+(?:\.\d+)*[.)](?=\s)"
DOMAIN_NUMBER = r"(-?\d+(?:,\d{3})*(?:\.\d+)?%?)"
ABBREVIATIONS = {
    "frtb": "fundamental review of the trading book",
    "cva": "credit valuation adjustment",
    "xva": "valuation adjustment",
    "var": "value at risk",
    "es": "expected shortfall",
}


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where a lambda refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def text(c: Column) -> Column:
    """The text, empty where null."""
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without surrounding white space."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def words(*values: str) -> Column:
    return F.array(*(F.lit(v) for v in values))


def tokens_a(c: Column) -> Column:
    """Lower-cased runs of Latin letters, digits and Chinese characters; a mixed run is one token."""
    return F.transform(F.regexp_extract_all(text(c), F.lit(f"({TOKEN_A})"), F.lit(1)), F.lower)


def tokens_b(c: Column) -> Column:
    """Runs of lower-case Latin letters and digits, and runs of Chinese characters, apart."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit(f"({TOKEN_B})"), F.lit(1))


def token_set_b(c: Column) -> Column:
    return F.array_distinct(tokens_b(c))


def without_stopwords(tokens: Column, name: str) -> Column:
    stop = words(*STOPWORD_LISTS[name])
    return F.filter(tokens, lambda t: ~F.array_contains(stop, t))


def singular(token: Column) -> Column:
    """``ies`` becomes ``y`` in words of over four letters; else a final s goes in words of over three, unless doubled."""
    return (
        F.when((F.length(token) > 4) & token.endswith("ies"), F.regexp_replace(token, "ies$", "y"))
        .when((F.length(token) > 3) & token.endswith("s") & ~token.endswith("ss"), F.regexp_replace(token, "s$", ""))
        .otherwise(token)
    )


def relevancy_tokens(c: Column) -> Column:
    return F.array_distinct(without_stopwords(F.transform(tokens_b(c), singular), "relevancy"))


def support_tokens(c: Column) -> Column:
    """Tokens of the sentence support rule: no stopwords, no single Latin characters."""
    kept = without_stopwords(tokens_b(c), "support")
    return F.array_distinct(F.filter(kept, lambda t: (F.length(t) > 1) | t.rlike(r"^[一-鿿]")))


def squeeze(c: Column) -> Column:
    """Lower case, single blanks, stripped."""
    return F.lower(F.regexp_replace(strip(text(c)), r"\s+", " "))


def slashed_path(c: Column) -> Column:
    """A path between slashes, with forward slashes only."""
    return F.concat(F.lit("/"), F.regexp_replace(F.translate(text(c), "\\", "/"), r"^/+|/+$", ""), F.lit("/"))


def label(c: Column) -> Column:
    """Lower-case letters, digits, ``-`` and ``_``; anything else becomes ``-``."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(text(c))), r"[^a-z0-9_-]+", "-"), r"^-+|-+$", "")


def sentences(c: Column) -> Column:
    """Parts between sentence ends and line feeds, stripped, blank ones left out."""
    return F.filter(F.transform(F.split(text(c), r"[。！？!?.]+\s*|\n+"), strip), lambda s: s != "")


def sentences_kept_stop(c: Column, least: int = 12) -> Column:
    """Sentences with their stops, of at least ``least`` characters."""
    marked = F.regexp_replace(text(c), r"([.!?。！？])\s*", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "[\u0001\n]"), strip), lambda s: F.length(s) >= least)


def overlap(a: Column, b: Column) -> Column:
    """Number of common elements of two sets."""
    return F.size(F.array_intersect(a, b))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _without(c: Column, *patterns: str) -> Column:
    for pattern in patterns:
        c = F.regexp_replace(c, pattern, " ")
    return c


def numbers_gate(c: Column) -> Column:
    """Numbers of a text for the gates: source tags, chunk names and places go first, per cent is a hundredth."""
    return _parsed(F.regexp_extract_all(_without(text(c), SOURCE_TAG, GATE_CHUNKS, GATE_PLACES), F.lit(GATE_NUMBER), F.lit(1)))


def numbers_domain(c: Column) -> Column:
    """Numbers of an answer: places, source tags and list numbers go first, thousands separators are read."""
    bare = _without(text(c), DOMAIN_PLACES, SOURCE_TAG, DOMAIN_PARENTHESES, LIST_NUMBER)
    return _parsed(F.regexp_extract_all(bare, F.lit(DOMAIN_NUMBER), F.lit(1)))


def _parsed(found: Column) -> Column:
    def value(m: Column) -> Column:
        bare = F.regexp_replace(m, "[,%]", "").try_cast("double")
        return F.when(m.endswith("%"), bare / 100.0).otherwise(bare)

    return F.filter(F.transform(found, value), lambda v: v.isNotNull())


def near(value: Column, other: Column, absolute: float, relative: float) -> Column:
    """Whether two numbers agree within an absolute or a relative tolerance."""
    return (F.abs(value - other) <= absolute) | ((F.abs(other) > 1e-9) & (F.abs(value - other) <= relative * F.abs(other)))


def safe_number(c: Column, default: float = 0.0) -> Column:
    """A number with thousands separators, or the default."""
    return F.coalesce(F.regexp_replace(strip(text(c)), ",", "").try_cast("double"), F.lit(default))


def short_sha1(*parts: Column, length: int = 12) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", *(text(p.cast("string")) for p in parts)).cast("binary")), 1, length)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def cited_chunk_ids(c: Column) -> Column:
    """Chunk identifiers named as ``chunk_id=...`` in a text, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text(c), F.lit(r"chunk_id=([^\]\s]+)"), F.lit(1)))


def contains_any(c: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(c, F.lit(part))
    return found


def json_object(c: Column) -> Column:
    """The JSON object in a text: the text itself, a fenced block, or from the first brace to the last."""
    fenced = F.regexp_extract(text(c), r"(?s)```(?:json)?\s*(.*?)```", 1)
    braced = F.regexp_extract(text(c), r"(?s)(\{.*\})", 1)
    candidates = [strip(text(c)), strip(fenced), braced]
    return F.coalesce(*(F.when(F.json_object_keys(x).isNotNull(), x) for x in candidates))
