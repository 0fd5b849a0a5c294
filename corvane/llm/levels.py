"""Reading level of texts: a model of sentences, fitted to graded examples.

Each sentence is described by length, lexical diversity, word rarity,
connectives and clause depth.  Word rarity is measured in the whole corpus and
between neighbouring levels: the shares of a sentence's words and word pairs that
are rarer in writing of the one level than of the next, and the reverse.  A
regularised ordinal regression (one weight vector, one threshold between any two
neighbouring levels) turns the description into a level, and the level at which
most sentences of a text are written is the text's.

Example texts hold some sentences of other levels than their own.  In a few
rounds the regression therefore regrades their sentences, near the level of their
text, and is fitted again.  The rarity of words that the examples lack comes from
the corpus, whose sentences take the level of the other sentences of their text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import xxhash

from corvane.llm.pairs import CJK, INVISIBLE, STOPWORDS, language_votes
from corvane.llm.shingles import ODD, mix

LANGUAGES = ("en", "de", "es", "zh")
CONNECTIVES = {
    "en": frozenset("although because since unless whereas whereby while when if so that provided insofar notwithstanding irrespective conditional subject once before after where which yet but and".split()),
    "de": frozenset("obwohl weil da sofern soweit während wenn dass damit vorbehaltlich ungeachtet daher wodurch nachdem bevor bis welche dessen deren jedoch aber und dann".split()),
    "es": frozenset("aunque porque ya salvo mientras cuando si que siempre perjuicio independencia conforme tras antes después cuya cuyo pero y entonces".split()),
    "zh": frozenset("虽 因 若 则 除 否 且 而 惟 须 之 将 后 前 即 亦".split()),
}
STOP = re.compile(r"(?<=[.!?])[\"”’')\]]*\s+|(?<=[。！？；])|[;\n]+")
#: Where sentences may be joined; only very long ones are taken apart.
JOINT = re.compile(
    r",?\s+(?:and then|but|so|and)\s+(?=\S+\s+\S+\s+\S+\s+\S+)|,?\s+(?:und dann|aber|daher|so|und)\s+(?=\S+\s+\S+\s+\S+\s+\S+)"
    r"|,?\s+(?:y entonces|así que|pero|y)\s+(?=\S+\s+\S+\s+\S+\s+\S+)|，?(?:然后|而且|所以|但是|但|并且)(?=.{6})",
    re.I,
)
JOINED_WORDS, JOINED_CHINESE = 24, 48
WORD = re.compile(r"[㐀-鿿]|[^\W\d_㐀-鿿]+(?:['’-][^\W\d_㐀-鿿]+)*")
PAUSE = re.compile(r"[,，、;:]")
SPECIAL = re.compile(r"<\|\w+\|>")
LIST = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)])\s+")


def text_language(text: str, given: str | None = None, words: list[str] | None = None) -> str:
    """The language by votes; without a clear one the given label, else English."""
    votes = language_votes(text, words)
    ranked = sorted(((k, votes[k]) for k in LANGUAGES), key=lambda v: -v[1])
    if ranked[0][1] >= 1 and ranked[0][1] > ranked[1][1]:
        return ranked[0][0]
    label = (given or "").strip().lower()[:2]
    return label if label in LANGUAGES else "en"


@dataclass
class Unit:
    words: list[str]
    part: bool  # possibly less than a sentence
    commas: int


def units(text: str) -> list[Unit]:
    """Sentences and list items of a text, without headings and table rows where there is running text."""
    text = text if text.isascii() else INVISIBLE.sub(" ", text)
    running, other = [], []
    for line in text.split("\n"):
        line = line.strip()
        if not line:
            continue
        listed = bool(LIST.match(line))
        bare = LIST.sub("", line)
        heading = line.startswith("#") or (line.startswith("**") and line.endswith("**"))
        if heading or ("|" in bare and SPECIAL.sub("", bare).count("|") >= 2):
            kept = other
            bare = bare.strip("#* ")
        else:
            kept = running
        for part in STOP.split(bare):
            if not part:
                continue
            words = WORD.findall(part.lower())
            if len(words) >= JOINED_WORDS and len(words) >= (JOINED_CHINESE if CJK.search(part) else JOINED_WORDS):
                clauses = [(c, WORD.findall(c.lower())) for c in JOINT.split(part)]
            else:
                clauses = [(part, words)]
            for clause, words in clauses:
                if words:
                    kept.append(Unit(words, listed or len(clauses) > 1, len(PAUSE.findall(clause))))
    # a line of a few words without a stop is a heading, unless there is nothing else
    full = [u for u in running if len(u.words) > 4 or u.part]
    return full or running or other


LEVELS = (1, 2, 3, 4)
SHRINK = 4.0
EXTRA = 4.0
#: A term is rarer at a level than at the next if the logarithms of its shares differ by this much.
STEP = 0.3
#: Rounds in which sentences of the examples are graded anew.
ROUNDS = 6


@lru_cache(200_000)
def word_key(word: str) -> int:
    """A number for a word; negative ones too, as columns hold signed numbers."""
    key = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
    return key - (1 << 64) if key >> 63 else key


def distinct(values: np.ndarray) -> np.ndarray:
    """The different ones of some numbers, in order; by sorting, which is faster here than hashing them."""
    ordered = np.sort(values)
    return ordered[np.append(True, ordered[1:] != ordered[:-1])] if len(ordered) else ordered


@dataclass
class TermShares:
    """Of a language in the corpus: sentences of each level, and of those that hold a term."""

    weight: np.ndarray
    keys: np.ndarray  # of the terms, in order
    shares: np.ndarray


@dataclass
class Lookup:
    """Values by key; unknown keys have the last one."""

    keys: np.ndarray
    values: np.ndarray

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.repeat(self.values[-1:], len(wanted), axis=0)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return self.values[np.where(self.keys[at] == wanted, at, len(self.keys))]


@dataclass
class LanguageModel:
    steps: Lookup = field(default_factory=lambda: Lookup(np.zeros(0, np.int64), np.zeros((1, 2 * len(LEVELS) - 2))))
    rarity: Lookup = field(default_factory=lambda: Lookup(np.zeros(0, np.int64), np.zeros(1)))
    sentence_words: np.ndarray = field(default_factory=lambda: np.full(4, 12.0))
    center: np.ndarray | None = None
    spread: np.ndarray | None = None
    weights: np.ndarray | None = None
    thresholds: np.ndarray | None = None


@dataclass
class Sentences:
    """Sentences of one language as arrays: what their description needs, and the numbers of their words in order."""

    sizes: np.ndarray  # words of each
    part: np.ndarray  # possibly less than a sentence
    commas: np.ndarray
    chars: np.ndarray  # of its words
    linking: np.ndarray  # connectives
    small: np.ndarray  # stopwords
    words: np.ndarray  # of all, one after the other

    @staticmethod
    def of(found: list[Unit], lang: str) -> Sentences:
        sizes = np.array([len(u.words) for u in found], dtype=np.int64)
        known: dict[str, int] = {}
        ids = np.array([known.setdefault(w, len(known)) for u in found for w in u.words], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        each = lambda values, kind=np.int64: np.add.reduceat(np.array(values, dtype=kind)[ids], starts) if len(found) else np.zeros(0, np.int64)
        return Sentences(
            sizes, np.array([u.part for u in found], dtype=bool), np.array([u.commas for u in found], dtype=np.int64), each([len(w) for w in known]),
            each([w in CONNECTIVES[lang] for w in known]), each([w in STOPWORDS.get(lang, ()) for w in known]), np.array([word_key(w) for w in known], dtype=np.int64)[ids],
        )


class Terms:
    """The words and neighbouring words of many sentences, as numbers.

    ``unit`` and ``term`` say which sentence holds which term, repetitions
    included; ``keys`` are the terms' numbers, which mean the same everywhere.  The
    terms of Chinese are two and three characters in a row, those of other
    languages words and pairs of words.
    """

    def __init__(self, sentences: Sentences, lang: str):
        self.count = len(sentences.sizes)
        self.owner = np.repeat(np.arange(self.count), sentences.sizes)
        self.starts = np.cumsum(sentences.sizes) - sentences.sizes
        self.word_keys, self.ids = np.unique(sentences.words, return_inverse=True)
        hashes = sentences.words.view(np.uint64)
        follows = self.owner[1:] == self.owner[:-1]
        pairs = mix(hashes[:-1] * ODD + hashes[1:])
        units, codes = [self.owner[:-1][follows]], [pairs[follows]]
        if lang == "zh":
            three = follows[:-1] & follows[1:]
            units.append(self.owner[:-2][three])
            codes.append(mix(pairs[:-1] * ODD + hashes[2:])[three])
        else:
            units.append(self.owner)
            codes.append(hashes)
        self.unit = np.concatenate(units)
        self.keys, self.term = np.unique(np.concatenate(codes).view(np.int64), return_inverse=True)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value of each word over the sentences."""
        return np.add.reduceat(values[self.ids], self.starts) if self.count else np.zeros(0)

    def spread_by(self, weights: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(rows, weights[:, k], minlength=size) for k in range(weights.shape[1])], axis=1)


def rarer(terms: Terms, shares: np.ndarray, corpus: TermShares | None = None) -> Lookup:
    """For each term, between which neighbouring levels it gets rarer, and between which less rare."""
    size = len(terms.keys)
    held = distinct(terms.unit * size + terms.term)
    keys, counts = terms.keys, terms.spread_by(shares[held // max(1, size)], held % max(1, size), size)
    if corpus is not None and corpus.weight.min() > 0:
        # the corpus counts for as much as the examples at every level, times EXTRA
        scale = EXTRA * shares.sum(axis=0) / corpus.weight
        both = np.concatenate([keys, corpus.keys])
        keys, row = np.unique(both, return_inverse=True)
        counts = terms.spread_by(np.concatenate([counts, corpus.shares * scale]), row, len(keys))
        shares = shares * (1 + EXTRA)
    # rare terms are drawn to the average: the name of a subject is no sign of a level
    weight = np.maximum(shares.sum(axis=0), 1e-9)  # a level may be missing from the examples
    mean = weight / weight.sum()
    common = np.log((counts + SHRINK * mean) / (weight + SHRINK * len(LEVELS) * mean))
    change = np.diff(common, axis=1)
    return Lookup(keys, np.vstack([np.column_stack([change > STEP, change < -STEP]), np.zeros((1, 2 * len(LEVELS) - 2))]).astype(float))


def features(sentences: Sentences, terms: Terms, model: LanguageModel) -> np.ndarray:
    """The description of each sentence, one row each."""
    count = sentences.sizes.astype(float)
    words = max(1, len(terms.word_keys))
    different = np.bincount(distinct(terms.owner * words + terms.ids) // words, minlength=terms.count)
    # of each sentence's terms the sums of what each of the steps says, by the few that say anything
    steps = model.steps(terms.keys)
    telling = np.flatnonzero(steps.any(axis=1)[terms.term])
    sums = terms.spread_by(steps[terms.term[telling]], terms.unit[telling], terms.count)
    return np.column_stack(
        [
            np.log1p(count),
            sentences.chars / count,
            different / count,
            terms.sums(model.rarity(terms.word_keys)) / count,
            sentences.linking / count,
            np.log1p(sentences.commas + sentences.linking),
            sentences.small / count,
            sums / np.maximum(np.bincount(terms.unit, minlength=terms.count), 1)[:, None],
        ]
    )


def fit_ordinal(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds: P(level > k) = logistic(w x - t_k), by damped Newton steps."""
    d = x.shape[1]
    cuts = len(LEVELS) - 1
    above = (y[:, None] > np.array(LEVELS[:-1])[None, :]).astype(float)
    w, t = np.zeros(d), np.zeros(cuts)
    penalty = np.concatenate([np.full(d, ridge), np.full(cuts, 1e-3)])
    for _ in range(rounds):
        z = np.clip((x @ w)[:, None] - t[None, :], -30, 30)
        p = 1 / (1 + np.exp(-z))
        r, h = p - above, np.maximum(p * (1 - p), 1e-6)
        gradient = np.concatenate([x.T @ r.sum(axis=1), -r.sum(axis=0)]) + penalty * np.concatenate([w, t])
        hessian = np.diag(penalty)
        hessian[:d, :d] += x.T @ (x * h.sum(axis=1)[:, None])
        hessian[:d, d:] -= x.T @ h
        hessian[d:, :d] = hessian[:d, d:].T
        hessian[d:, d:] += np.diag(h.sum(axis=0))
        step = np.linalg.solve(hessian, gradient)
        w, t = w - step[:d], t - step[d:]
        if np.abs(step).max() < 1e-6:
            break
    return w, np.sort(t)


@dataclass
class LevelModel:
    languages: dict[str, LanguageModel]


Parsed = tuple[str, list[Unit]]


def parse(text: str, label: str | None) -> Parsed:
    found = units(text)
    return text_language(text, label, [w for u in found for w in u.words]), found


def example_words(examples: list[tuple[str, str | None, int]]) -> dict[str, Counter[int]]:
    """By language the keys of the examples' words with their number: the words whose corpus counts the model needs."""
    counts: dict[str, Counter[int]] = {lang: Counter() for lang in LANGUAGES}
    for text, label, _ in examples:
        lang, found = parse(text, label)
        counts[lang].update(word_key(w) for u in found for w in u.words)
    return counts


def _probabilities(x: np.ndarray, model: LanguageModel) -> np.ndarray:
    """Probability of each level of each described sentence."""
    z = ((x - model.center) / model.spread) @ model.weights
    above = 1 / (1 + np.exp(np.clip(model.thresholds[None, :] - z[:, None], -30, 30)))
    edge = np.ones((len(z), 1))
    return -np.diff(np.concatenate([edge, above, 0 * edge], axis=1), axis=1)


def fit(
    examples: list[tuple[str, str | None, int]],
    counts: dict[str, dict[int, int]],
    totals: dict[str, int],
    corpus: dict[str, TermShares] | None = None,
) -> LevelModel:
    """Fit to (text, language label, level) examples, the corpus counts of their words and the corpus' term shares."""
    models = {}
    parsed = [(*parse(text, label), level) for text, label, level in examples]
    for lang in LANGUAGES:
        rows = [(u, level) for own, found, level in parsed if own == lang for u in found]
        model = models[lang] = LanguageModel()
        if not rows:
            continue
        known = sorted(counts.get(lang, {}).items())
        total = totals.get(lang, 0) + 1
        model.rarity = Lookup(np.array([k for k, _ in known], dtype=np.int64), np.log(total / np.array([*(n + 0.5 for _, n in known), 0.5])))
        sentences = Sentences.of([u for u, _ in rows], lang)
        labels = np.array([level for _, level in rows])
        terms = Terms(sentences, lang)
        # a sentence is mostly of its text's level, else nearer levels are likelier
        prior = np.array([[0.7 if b == a else 0.2 / abs(b - a) ** 2 for b in LEVELS] for a in LEVELS])
        prior /= prior.sum(axis=1, keepdims=True)
        shares = prior[labels - 1]
        for _ in range(ROUNDS):
            model.steps = rarer(terms, shares, (corpus or {}).get(lang))
            x = features(sentences, terms, model)
            model.center, model.spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
            own = shares.argmax(axis=1) + 1
            model.weights, model.thresholds = fit_ordinal((x - model.center) / model.spread, own)
            shares = prior[labels - 1] * _probabilities(x, model) ** 2
            shares /= shares.sum(axis=1, keepdims=True)
        for k in LEVELS:
            sizes = sentences.sizes[(own == k) & ~sentences.part]
            if len(sizes):
                model.sentence_words[k - 1] = float(np.median(sizes))
    return LevelModel(models)


def sentence_levels(sentences: Sentences, terms: Terms, own: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each level, and number of sentences, of each unit."""
    if own.weights is None:
        return np.tile([0.0, 1.0, 0.0, 0.0], (terms.count, 1)), np.ones(terms.count)
    p = _probabilities(features(sentences, terms, own), own)
    size = sentences.sizes / own.sentence_words[p.argmax(axis=1)]
    # a list item may be part of a sentence; a very long unit is several joined ones
    return p, np.where(sentences.part | (size > 1.7), size, 1.0)


@dataclass
class Company:
    """What some texts of one language add to the statistics of the corpus."""

    weight: np.ndarray  # sentences of each level
    texts: int
    terms: np.ndarray  # keys
    shares: np.ndarray  # sentences of each level that hold each term
    documents: np.ndarray  # texts that hold each term
    words: np.ndarray  # keys of the words
    times: np.ndarray  # how often each comes


def company(sentences: Sentences, text: np.ndarray, texts: int, lang: str, model: LanguageModel) -> Company:
    """What sentences add to the statistics; ``text`` has the number of each one's text, below ``texts``.

    A sentence is taken to be of the levels of the text's other sentences; its own
    words have no say, or a misjudged one would confirm itself.
    """
    terms = Terms(sentences, lang)
    p, size = sentence_levels(sentences, terms, model)
    votes = terms.spread_by(p * size[:, None], text, texts) + 0.05
    share = np.maximum(votes[text] - p * size[:, None], 0.01)
    share /= share.sum(axis=1, keepdims=True)
    share *= (np.bincount(text, minlength=texts)[text] > 1)[:, None]  # a lone sentence has no company
    names = len(terms.keys)
    # terms come unit by unit, so that those of a sentence are made distinct without their sentence's number
    held = distinct(terms.unit * names + terms.term)
    by_term = terms.spread_by(share[held // names], held % names, names)
    documents = np.bincount(distinct(text[held // names] * names + held % names) % names, minlength=names)
    return Company(share.sum(axis=0), len(distinct(text)), terms.keys, by_term, documents, terms.word_keys, np.bincount(terms.ids, minlength=len(terms.word_keys)))


def text_votes(sentences: Sentences, text: np.ndarray, texts: int, lang: str, model: LanguageModel) -> np.ndarray:
    """How many sentences of each text are of each level, one row a text."""
    terms = Terms(sentences, lang)
    p, size = sentence_levels(sentences, terms, model)
    return terms.spread_by(p * size[:, None], text, texts)


def most_voted(votes: np.ndarray) -> np.ndarray:
    """The level most sentences are written at; the lower one of equally frequent ones, the lowest of texts without words."""
    return np.array(LEVELS)[np.round(votes, 6).argmax(axis=1)]


def says_anything(text: str | None) -> bool:
    """Whether a text isn't null, empty, or only white or invisible characters."""
    return text is not None and bool(INVISIBLE.sub(" ", text).strip())
