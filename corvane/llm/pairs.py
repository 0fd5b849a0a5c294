"""Rules that tell how a response fails its prompt.

``classify`` looks at one pair; what it can't settle, whether a response without
a final stop breaks off, it hands over as the wording of the tail, which the
operator compares with how the same words end elsewhere in the corpus.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice
from operator import or_

import numpy as np
import xxhash

from corvane.llm.shingles import ODD, mix

INVISIBLE = re.compile(r"[­​-‏ - ⁠-⁤﻿ 　᠎]")
TAG = re.compile(r"<[^<>]{0,200}>")
SPACES = re.compile(r"\s+")
CJK = re.compile(r"[㐀-鿿]")
WORD = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+")

#: Words that say nothing when a response holds nothing else: labels and stand-ins for a missing value.
NOTHING = frozenset(
    """answer answers a ans response reply report output result text content final summary assistant bot
    antwort antworten bericht ergebnis respuesta respuestas informe resultado contestación réponse
    n na nan null none nil undefined empty blank missing tbd tba todo unknown placeholder pending void
    leer fehlt entfällt unbekannt ninguno ninguna vacío vacía pendiente nbsp br xxx xx""".split()
)
NOTHING_PHRASE = re.compile(
    r"\b(?:no (?:answer|data|value|response|content|text|entry)|not (?:available|applicable|provided|specified)|keine (?:angaben?|antwort|daten)|ohne (?:angabe|antwort)"
    r"|sin (?:respuesta|datos|contenido)|no (?:disponible|aplica)|(?:insert|your) (?:answer|text|response)(?: here)?|lorem ipsum)\b"
)
ANY_WORD = re.compile(r"[^\W_]+")
NOTHING_CJK = frozenset(["答", "答案", "回答", "答复", "回复", "无", "空", "暂无", "待定", "未知", "没有", "报告", "回应", "待补充", "无内容", "暂缺"])

MAYBE_NOTHING = NOTHING | NOTHING_CJK | frozenset(ANY_WORD.findall(NOTHING_PHRASE.pattern))


# ---- language by stopword votes -------------------------------------------------------------
STOPWORDS = {
    "en": frozenset(
        """the a an and or but of to in on at by for with from as is are was were be been it its this that these those which what who how
        why when where whether not no can cannot could will would shall should may might must do does did has have had there their they
        we you i he she his her if than then so because although before after about into over under between both each all any more most
        own other such only same too very here don't below above per set""".split()
    ),
    "de": frozenset(
        """der die das den dem des ein eine einen einem einer eines und oder aber von zu im in am an auf bei mit aus als ist sind war waren
        sein wird werden wurde es sie er wir ich ihr dies diese dieser dieses welche welcher was wer wie warum wann wo ob nicht kein keine
        kann können könnte soll sollte darf muss hat haben hatte durch für über unter zwischen nach vor um zum zur wenn weil obwohl dass
        sich auch nur noch schon sehr mehr also je vom beim gegenüber gibt dazu anhand leider mir""".split()
    ),
    "es": frozenset(
        """el la los las un una unos unas y o pero de del al a en por para con sin desde como es son era eran ser fue fueron está están se
        su sus lo le les esto esta este estos estas eso esa ese qué que quién cómo por porque cuándo cuando dónde donde si no puede pueden
        podría debe debería ha han había hay sobre entre hasta más menos muy también solo sólo ya aunque ante según cada todo toda todos
        cuál cuáles nos yo usted ustedes eso nada""".split()
    ),
    "fr": frozenset(
        """le la les un une des du de et ou mais à au aux en dans par pour avec sans sur sous est sont était étaient être ce cette ces cet
        qui que quoi dont où comment pourquoi quand si ne pas plus il elle ils elles nous vous je leur leurs son sa ses peut peuvent doit
        a ont avait entre chaque selon aussi très lorsque""".split()
    ),
    "it": frozenset(
        """il lo la i gli le un uno una di del della dei delle da dal in nel nella con su per tra fra e o ma è sono era essere che chi cosa
        come perché quando dove se non più si suo sua loro questo questa questi quelle può possono deve ha hanno anche ogni""".split()
    ),
    "pt": frozenset(
        """o a os as um uma de do da dos das em no na nos nas por para com sem e ou mas é são era ser que quem como porque quando onde se
        não mais seu sua este esta isto pode podem deve tem têm há também cada entre até muito""".split()
    ),
}


#: The languages each stopword speaks for.
SPEAKS_FOR = {w: [lang for lang, stop in STOPWORDS.items() if w in stop] for stop in STOPWORDS.values() for w in stop}


LATIN = re.compile(r"[a-zà-ÿœ']+")
KANA, CYRILLIC = re.compile(r"[぀-ヿ]"), re.compile(r"[Ѐ-ӿ]")
SPANISH_ENDING = re.compile(r"(?:ción|ciones|dad)\b")


def language_votes(text: str, words: list[str] | None = None) -> dict[str, float]:
    """How strongly a text speaks for each language: stopwords, Chinese characters, and telling letters."""
    votes = dict.fromkeys([*STOPWORDS, "zh"], 0.0)
    lowered = text.lower()
    for languages in filter(None, map(SPEAKS_FOR.get, LATIN.findall(lowered) if words is None else words)):
        for lang in languages:
            votes[lang] += 1.0
    if not text.isascii():
        votes["zh"] = len(CJK.findall(text)) / 2.5
        votes["de"] += sum(map(lowered.count, "ßäöü")) * 0.3
        votes["es"] += sum(map(lowered.count, "ñ¿¡")) * 0.5
        for name, letters, size in (("ja", KANA, 2), ("cyrillic", CYRILLIC, 3)):
            found = letters.findall(text)
            if found:
                votes[name] = len(found) / size
    if "ci" in lowered or "dad" in lowered:
        votes["es"] += len(SPANISH_ENDING.findall(lowered)) * 0.5
    return votes


def language(text: str, least: float = 1.0, margin: float = 1.5) -> str | None:
    """The language with a clear lead in the votes, if any."""
    votes = sorted(language_votes(text).items(), key=lambda v: -v[1])
    (first, most), (_, second) = votes[0], votes[1]
    return first if most >= least and most >= margin * second else None


QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]|«[^»]*»|「[^」]*」|『[^』]*』|“[^”]*$|(?m:^>.*$)")


def response_language(text: str) -> str | None:
    """The language most of a response is in, by its votes; quotations don't count."""
    # the votes of a text are the sum of those of its sentences
    ranked = sorted(language_votes(QUOTED.sub(" ", text)).items(), key=lambda v: -v[1])
    if len(ranked) < 2 or ranked[0][1] < 2 or ranked[0][1] < 1.6 * ranked[1][1]:
        return None
    return ranked[0][0]


# ---- sentences ------------------------------------------------------------------------------
SENTENCE = re.compile(r"(?<=[.!?])[\"”’)\]»]*\s+(?=[^\s])|(?<=[。！？])|\n+")


def sentences(text: str) -> list[str]:
    return [s.strip() for s in SENTENCE.split(text) if s and s.strip()]


# ---- copies of the prompt -------------------------------------------------------------------
class SuffixAutomaton:
    """All substrings of one text, as the minimal automaton of its suffixes."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        last = 0
        for c in text:
            current = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = current
                p = self.link[p]
            if p != -1:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[current] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p != -1 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = self.link[p]
                    self.link[q] = self.link[current] = clone
            last = current

    def covered(self, text: str, least: int) -> list[bool]:
        """Which characters of ``text`` lie in a substring of at least ``least`` characters of the own text."""
        marks = [0] * (len(text) + 1)
        state = length = 0
        for i, c in enumerate(text):
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                length += 1
            else:
                state = length = 0
            if length >= least:
                marks[i - length + 1] += 1
                marks[i + 1] -= 1
        out, depth = [], 0
        for m in marks[:-1]:
            depth += m
            out.append(depth > 0)
        return out


    def mostly_covers(self, text: str, least: int, share: float) -> bool:
        """Whether at least ``share`` of the letters are covered; given up as soon as too many aren't.

        A later match can't reach back beyond the current one, so what lies before it is final.
        """
        room = (1 - share) * (len(text) - text.count(" ")) + 1e-9
        state = length = settled = missing = 0
        for i, c in enumerate(text):
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                length += 1
            else:
                state = length = 0
            begin = i - length + 1
            if begin > settled:
                missing += begin - settled - text.count(" ", settled, begin)
                if missing > room:
                    return False
                settled = begin
            if length >= least:
                settled = i + 1
        return missing + len(text) - settled - text.count(" ", settled) <= room


#: Characters of a text that one automaton holds, which bounds its memory.
STRETCH = 50_000


class LongAutomaton:
    """Automata of the stretches of a text, of which neighbours share ``least - 1`` characters.

    A character lies in a common part of ``least`` characters or more just if it lies in one of
    ``least``, and that is whole in one of the stretches.
    """

    def __init__(self, text: str, stretch: int = STRETCH):
        self._text, self._stretch = text, stretch

    def covered(self, text: str, least: int) -> list[bool]:
        out = [False] * len(text)
        for begin in range(0, max(1, len(self._text) - least + 1), self._stretch):
            own = SuffixAutomaton(self._text[begin : begin + self._stretch + least - 1])
            out = list(map(or_, out, own.covered(text, least)))
        return out

    def mostly_covers(self, text: str, least: int, share: float) -> bool:
        letters = [hit for c, hit in zip(text, self.covered(text, least)) if c != " "]
        return sum(letters) >= share * len(letters) - 1e-9


_prompt_automaton = lru_cache(1024)(SuffixAutomaton)


def automaton(text: str) -> SuffixAutomaton | LongAutomaton:
    """The automaton of a prompt; those of short prompts, which many pairs share, are kept."""
    if len(text) > STRETCH:
        return LongAutomaton(text)
    return _prompt_automaton(text) if len(text) <= 400 else SuffixAutomaton(text)


def canonical(text: str) -> str:
    """Letters and digits in lower case, single blanks between words."""
    return " ".join(re.findall(r"[^\W_]+", INVISIBLE.sub(" ", text).lower()))


#: What may stand before a copied prompt without being an answer, in canonical form.
LEAD = re.compile(
    r"^(?:(?:question|prompt|query|q|frage|pregunta|问题|问|answer|antwort|respuesta|回答|答|sure|of course|certainly|gerne|natürlich|claro|por supuesto|好的|当然"
    r"|you asked(?: about)?|your question(?: is| was)?|the question (?:is|was)|the user (?:asks|asked)|you want to know|sie fragen|ihre frage(?: lautet)?"
    r"|die frage (?:ist|lautet)|usted pregunta|su pregunta es|la pregunta es|您问的是|这个问题是|您的提问是|你问的是|你的问题是|您的问题是|问题是)\s*)+"
)


def copies(prompt: str, response: str) -> bool:
    """Whether the response is only the prompt again, whole or nearly so."""
    if not prompt:
        return False
    own, said = canonical(prompt), canonical(response)
    if not own or not said:
        return False
    rest = LEAD.sub("", said) or said
    chinese = bool(CJK.search(own))
    least = 2 if chinese else min(6, len(own))
    # most of the prompt must come back too, or it is an answer in the prompt's words
    return automaton(own).mostly_covers(rest, least, 0.8) and automaton(rest).mostly_covers(own, least, 0.75)


# ---- refusals -------------------------------------------------------------------------------
#: Phrases of a sentence that declines or can't answer, in lower case; all are looked for in one pass.
REFUSALS = (
    # English
    "i can't help", "i cannot help", "i can not help", "can't help with", "cannot help with", "can't assist", "cannot assist", "unable to assist", "unable to help",
    "unable to comment", "unable to answer", "unable to provide", "unable to discuss", "unable to respond", "not able to answer", "not able to help", "not able to provide", "what i am able to do",
    "cannot be answered", "can't be answered", "cannot answer", "can't answer", "could not answer", "couldn't answer", "won't be able to", "will not answer", "won't answer", "must decline", "have to decline",
    "i decline", "no answer is possible", "no answer can be given", "no reply can be given", "cannot give an answer", "can't give an answer", "insufficient evidence", "not enough evidence", "not enough information",
    "could not find evidence", "couldn't find evidence", "could not find any", "couldn't find any", "found nothing", "find nothing", "found no evidence", "found no information", "holds nothing that would", "contains nothing that",
    "says nothing about", "i don't know", "i do not know", "don't have the information", "do not have the information", "no information on", "no information about", "i have no answer", "guidelines don't allow", "guidelines do not allow",
    "not allowed to", "not permitted to", "against my guidelines", "against my policy", "outside my scope", "beyond my scope", "out of scope", "go beyond the material", "i will stop here", "i cannot comment", "i can't comment", "i cannot discuss", "i can't discuss",
    "cannot provide", "can't provide", "there is no way to answer", "i'd rather not", "no reply is possible", "no response is possible", "isn't possible to", "is not possible to", "not possible to say", "not possible to answer", "cannot say anything", "can't say anything", "nothing reliable", "lets me respond", "lets me answer", "none of the passages", "none of the sources", "none of the documents", "nothing in the corpus", "nothing in the sources", "nothing in the context", "i cannot say", "i can't say", "prefer not to answer", "is not something i can", "isn't something i can", "no basis for an answer", "no basis to answer",
    # German
    "weiß ich nicht", "weiss ich nicht", "ich weiß es nicht", "dazu kann ich nichts", "kann ich nicht beantworten", "kann ich leider nicht", "nicht beantworten", "keine grundlage für eine antwort", "keine antwort möglich", "keine antwort geben",
    "kann ich nicht helfen", "nicht weiterhelfen", "keine auskunft", "darf ich nicht", "nicht genügend informationen", "keine informationen", "reichen nicht aus", "keine aussage möglich", "muss ich ablehnen", "nicht zu beantworten",
    # Spanish
    "no puedo ayudar", "no puedo responder", "no puedo contestar", "no puedo comentar", "no lo sé", "no se puede responder", "no es posible responder", "no es posible contestar", "no es posible dar una respuesta", "no hay información suficiente", "no hay evidencia suficiente",
    "no hay datos suficientes", "no dispongo de", "no tengo información", "no contienen nada", "no encuentro", "no he encontrado", "no permiten responder", "no permite responder", "sin base para", "no está permitido", "no se dispone de",
    "no hay base para", "no ofrecen base", "no hay fundamento", "no me es posible", "no consta",
    # Chinese
    "我不知道", "无法回答", "不能回答", "无法作答", "不便作答", "不便回答", "不能给出答案", "无法给出", "无法提供", "没有足够", "资料不足", "证据不足", "信息不足", "无可奉告", "不能提供", "恕难", "无法帮助", "不能帮助", "没有找到", "找不到", "无从回答", "无法答复", "不予回答",
)
#: Phrases that may also state a fact; they decline only where the sentence is about the answer itself.
AMBIGUOUS = frozenset(
    ["not allowed to", "not permitted to", "out of scope", "no information on", "no information about", "is not possible to", "isn't possible to", "not possible to say", "cannot provide", "can't provide", "found nothing", "find nothing", "reichen nicht aus", "no está permitido", "no consta"]
)
ITSELF = re.compile(
    r"\b(?:i|i'm|i've|we|me|my|us|our|you|your|this|that|these|those|it|here|there|question|request|topic|answer|reply|response|sources?|documents?|passages?|context|corpus|material|guidelines|policy|assistant|found|available"
    r"|frage|antwort|quellen|unterlagen|dokumente|angaben|informationen|kontext|auszüge|belege|stellen|material|pregunta|respuesta|fuentes?|documentos?|contexto|pasajes|datos|información|me|eso|esto|ello)\b",
    re.I,
)
#: Sentences around a refusal that don't answer either.
COURTESY = re.compile(
    r"(?:hello|hi|hey|hmm+|well|dear user|thank you|thanks|regrettably|unfortunately|sorry|i'?m sorry|i am sorry|my apologies|apologies|summary|answer|response|report|note|conclusion|result|please|is there anything|anything else"
    r"|next steps?|let me know|feel free|citations?|sources?|references?|i (?:have )?(?:checked|looked|searched|reviewed|read|went)|after (?:going|looking|reading|checking|searching|reviewing)|as an? (?:ai|assistant|language)|ask the|add more|try again|if you"
    r"|hallo|guten tag|danke|vielen dank|leider|entschuldigung|es tut mir leid|tut mir leid|bitte|nächster schritt|nächste schritte|quellen|zusammenfassung|gibt es sonst|kann ich sonst"
    r"|hola|gracias|lo siento|lamentablemente|por desgracia|disculpe|por favor|próximo paso|siguiente paso|fuentes|resumen|citas|hay algo más"
    r"|您好|你好|谢谢|感谢|抱歉|很抱歉|对不起|遗憾|请|下一步|来源|引用|摘要|总结|还有)",
    re.I,
)


@lru_cache(1)
def refusal_automaton():
    import ahocorasick

    words = ahocorasick.Automaton()
    for phrase in REFUSALS:
        words.add_word(phrase, phrase)
    words.make_automaton()
    return words


def _declining(part: str) -> bool:
    """Whether a sentence or clause declines or says that there is no answer."""
    phrases = {phrase for _, phrase in refusal_automaton().iter(part.lower())}
    return bool(phrases) and (not phrases <= AMBIGUOUS or bool(ITSELF.search(part)))


def refuses(response: str) -> bool:
    """Whether the response declines and says nothing else."""
    words = refusal_automaton()
    text = INVISIBLE.sub(" ", response).replace("’", "'")
    if next(words.iter(text.lower()), None) is None:
        return False
    found = False
    for part in sentences(text):
        part = re.sub(r"^(?:\W|\d+[.)])+", "", part)
        if not WORD.search(part):
            continue
        if _declining(part):
            # a list or a clause that goes on to answer isn't a refusal
            if re.search(r"\b(?:but|however|aber|jedoch|pero|sin embargo)\b.{25,}|(?:但|不过).{8,}", part) and not _declines(part):
                return False
            found = True
        elif COURTESY.match(part) or len(WORD.findall(part)) <= 1:
            continue
        else:
            return False
    return found


def _declines(part: str) -> bool:
    return _declining(re.split(r"\b(?:but|however|aber|jedoch|pero|sin embargo)\b|但|不过", part)[-1])


# ---- truncation -----------------------------------------------------------------------------
CITATION = re.compile(r"(?:\s*\[\d+(?:,\s*\d+)*\])+\s*$")
CITED = re.compile(r"\n\s*(?:citations?|sources?|references?|quellen|fuentes|citas|来源|引用)\s*[:：].*$", re.I | re.S)
SOURCE = re.compile(r"^\s*(?:\[\d+\]|[-*+•]|\d{1,2}[.)])")
STOP = re.compile(r"[.!?。！？][\"”’'»)\]）」』*_]*$")
MARKER = re.compile(r"^\s*(?:[-*+•]|\d{1,2}[.)])(?:\s+|$)")
OPEN, CLOSE = "([{（【「『", ")]}）】」』"
#: Intervals may end with another bracket than they begin with.
INTERVAL = re.compile(r"[\[(\]]\s*[^\s\[\](){},;]+\s*[,;]\s*[^\s\[\](){},;]+\s*[\])\[](?!\()")
DELIMITER = re.compile("[" + re.escape(OPEN + CLOSE) + "„“”«»\"]")
#: Quotation marks that open stand before a word, as some languages close with those that open in others.
OPENING = re.compile(r"(?<![^\s(\[{（【])[\"“«](?=\S)")


def open_delimiter(text: str) -> bool:
    """Whether a bracket, quotation or code fence is still open at the end, by a stack."""
    if text.count("```") % 2:
        return True
    opening = {m.start() for m in OPENING.finditer(text)}
    stack: list[str] = []
    for m in DELIMITER.finditer(INTERVAL.sub(lambda m: " " * len(m.group()), text)):
        c = m.group()
        if stack and c in stack[-1]:
            stack.pop()
        elif c == "„":
            stack.append("“”")
        elif c in "\"“«":
            if m.start() in opening:
                stack.append({'"': '"', "“": "”", "«": "»"}[c])
        elif c in OPEN:
            stack.append(CLOSE[OPEN.index(c)])
    return bool(stack)


def masked(text: str) -> str:
    """A wording without its figures and names, for counting."""
    text = re.sub(r"\d[\d.,:%-]*", "#", text)
    text = re.sub(r"(?<![A-Za-z])(?:[A-Z][a-z]+ )+(?:[A-Z][a-z]+|desk|book|office)(?: (?:book|desk|office))?(?![A-Za-z])", "N", text)
    text = re.sub(r"(?<![A-Za-z])(?:USD|EUR|GBP|CHF|SGD|JPY)(?![A-Za-z])", "C", text)
    return SPACES.sub(" ", text).strip().lower()


def _words(unit: str) -> list[str]:
    """The masked words of a sentence or list item, without its final stop."""
    return WORD.findall(masked(unit).replace("#", " 0 "))


def _keys(units: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers for the first words and for the pairs of neighbouring words of some units.

    Returns, for all words one after the other, the number of the words of the unit
    up to it, the number of it and the next word, the unit, and the place in it.
    """
    known: dict[str, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for u in units for w in u], dtype=np.int64)
    sizes = np.array([len(u) for u in units], dtype=np.int64)
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in known], dtype=np.uint64)[ids] if len(ids) else np.zeros(0, np.uint64)
    unit = np.repeat(np.arange(len(units)), sizes)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(ids)) - starts[unit]
    powers = np.multiply.accumulate(np.full(int(sizes.max(initial=0)) + 1, 0x5851F42D4C957F2D, np.uint64))
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[place])])
    first = mix(running[1:] - running[starts[unit]])
    pair = np.zeros(len(ids), np.uint64)
    pair[:-1] = mix(hashes[:-1] * ODD + hashes[1:])
    return first.view(np.int64), pair.view(np.int64), unit, place


def endings(responses: list[str], prompts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What the sentences and list items of different responses say about how wordings end.

    ``prompts`` has the number of prompts each response was given to.  Arrays key,
    x, y, z, one place a key.  For the first words of a unit x counts the units
    that are just these words, y those that start with them; for two words in a
    row x counts the units that end with them, y those that go on.  A last unit
    without a stop may break off, so it is no evidence that its words make up a
    unit, that its last two end one, or that its last word follows the others; z
    counts the prompts it was given to.
    """
    units, ends, given = [], [], []
    for response, n in zip(responses, prompts):
        found = [u for u in sentences(TAG.sub(" ", CITED.sub("", response))) if WORD.search(u)]
        for k, unit in enumerate(found):
            unit = CITATION.sub("", MARKER.sub("", unit)).strip()
            units.append(_words(unit))
            ends.append(k < len(found) - 1 or bool(STOP.search(unit)))
            given.append(n)
    first, pair, unit, place = _keys(units)
    sizes = np.array([len(u) for u in units], dtype=np.int64)
    left = sizes[unit] - place - 1 if len(unit) else place
    ended = np.array(ends, dtype=bool)[unit] if len(unit) else np.zeros(0, dtype=bool)
    times = np.array(given, dtype=np.int64)[unit] if len(unit) else place
    goes_on, stops = left > 1, (left == 1) & ended
    key = np.concatenate([first, pair[goes_on], pair[stops]])
    x = np.concatenate([(left == 0) & ended, np.zeros(goes_on.sum()), np.ones(stops.sum())])
    y = np.concatenate([ended | (left > 1), np.ones(goes_on.sum()), np.zeros(stops.sum())])
    z = np.concatenate([np.where((left == 0) & ~ended, times, 0), np.zeros(goes_on.sum() + stops.sum())])
    keys, where = np.unique(key, return_inverse=True)
    count = lambda v: np.bincount(where, v, minlength=len(keys)).astype(np.int64)
    return keys, count(x), count(y), count(z)


@dataclass(frozen=True)
class Verdict:
    defect: str | None
    #: Of an undecided tail the keys of all its words, of all but the last, and of the last two.
    keys: tuple[int, int, int] | None = None


def breaks_off(whole: int, starts: int, before: int, ends: int, goes_on: int, unstopped: int = 0) -> bool:
    """Whether an unstopped tail breaks off, from the counts of its three keys.

    ``whole`` units consist of its words, ``starts`` start with them, ``before``
    with all but the last; ``ends`` units end with its last two words and
    ``goes_on`` have them further up.  ``unstopped`` prompts got an answer that
    ends with it without a stop: as copies of a cut answer look the same, that
    speaks for it only if it is several prompts and the words hardly go on.
    """
    if unstopped >= 3 and unstopped >= 10 * (starts - whole) and unstopped + starts >= 0.15 * (unstopped + before):
        return False
    if starts >= 3:
        return whole < 0.5 * starts or starts < 0.15 * before
    if before >= 10:
        return True
    return not (ends >= 2 and ends >= 0.3 * (ends + goes_on))


def is_empty(response: str | None) -> bool:
    """No words, or only a label or a stand-in for a missing value."""
    if response is None:
        return True
    if "<" not in response and "&" not in response:
        # most responses say something with their first words
        for word in islice(ANY_WORD.finditer(response), 20):
            if word.group().lower() not in MAYBE_NOTHING:
                return False
    text = INVISIBLE.sub(" ", html.unescape(TAG.sub(" ", response)))
    words = re.findall(r"[^\W_]+", NOTHING_PHRASE.sub(" ", text.lower()))
    return all(w in NOTHING or w in NOTHING_CJK for w in words)


def _tail(response: str) -> Verdict:
    text = INVISIBLE.sub(" ", response).rstrip()
    cited = CITED.search(text)
    if cited and all(SOURCE.match(x) for x in cited.group().strip().split("\n")[1:] if x.strip()):
        # a list of sources that ends the response may break off itself, or follow an answer that does
        if open_delimiter(text) or re.search(r"(?:[,;:，；：(\[]|\.\.\.|…|\n\s*(?:[-*+•]|\d{1,2}[.)]))$", text):
            return Verdict("truncated")
        return _tail(text[: cited.start()])
    text = CITATION.sub("", text).rstrip()
    if re.search(r"(?:…|\.\.\.)[\"”’)\]]*$", text):
        return Verdict("truncated")
    if open_delimiter(text):
        return Verdict("truncated")
    last = text.rsplit("\n", 1)[-1].strip()
    if re.fullmatch(r"(?:[-*+•]|\d{1,2}[.)])", last):
        return Verdict("truncated")
    if last.startswith("|") or (last.count("|") >= 2 and "\n" in text):
        lines = [x for x in text.split("\n") if "|" in x]
        whole = last.endswith("|") and last.count("|") >= lines[0].strip().count("|")
        return Verdict(None if whole or not last.startswith("|") else "truncated")
    if text.endswith("```"):
        return Verdict(None)
    if STOP.search(text):
        return Verdict(None)
    if re.search(r"[,;:，、；：(\-–—/&=×*+]$", text):
        return Verdict("truncated")
    if re.search(r"=\s*[^=]*[\d)\]]$", last):
        return Verdict(None)
    units = sentences(last)
    if len(units) > 1 and STOP.search(units[-2]) and not MARKER.match(last):
        # sentences with stops lead up to one without
        return Verdict("truncated")
    before = [u for u in sentences(text) if WORD.search(u)][:-1]
    unit = MARKER.sub("", units[-1] if units else last)
    words = _words(unit)
    if before and not MARKER.match(last) and all(STOP.search(u) for u in before) and len(words) > 1:
        return Verdict("truncated")
    if not words:
        return Verdict(None)
    first, pair, _, _ = _keys([words])
    last = len(words) - 1
    return Verdict(None, (int(first[last]), int(first[max(0, last - 1)]), int(pair[max(0, last - 1)])))


def classify(prompt: str | None, response: str | None) -> Verdict:
    """The defect of one pair, or the tail that decides whether it breaks off."""
    if is_empty(response):
        return Verdict("empty")
    if prompt and copies(prompt, response):
        return Verdict("copies_question")
    if refuses(response):
        return Verdict("refusal")
    asked = language(prompt) if prompt else None
    if asked:
        said = response_language(response)
        if said and said != asked:
            return Verdict("other_language")
    return _tail(response)
