"""The lines of web pages that belong to their main body.

Each line gets a text-to-tag ratio from the events of a streaming parser.  The
density of a line is its ratio, weighted by how likely its wording is part of a
main body: lines that recur on the site and wordings that stand outside content
regions elsewhere in the corpus weigh little, the article's title weighs most.
The densities are smoothed with a Gaussian along the page and split by two-means
clustering; the dense stretch with the greatest mass is the content region.  It
takes in further dense stretches, and the lines at its ends, as long as their
wordings are likelier inside than outside; pointers and lists of contents within
it are taken out line by line.

What wordings stand inside or outside is counted over the whole corpus, from the
regions that ratios and recurrence alone give.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser
from itertools import islice

import numpy as np
import xxhash

SIGMA = 1.5
REACH = math.ceil(3 * SIGMA)
#: Lines up to this length recur often enough to be remembered.
REPEATED = 200
LONG = 80
#: A wording is described by its first words, and by all of it if it has no more.
OPENING = 12
#: Slots of the counts of words; those of whole wordings have two tables of as many.
SLOTS = 1 << 16

#: Wordings that count as seen outside before any page is: sign-up, sharing, page facts, footers, consent, lists of other pages.
PRIOR = re.compile(
    r"(?:subscribe|sign up|enter your e-?mail|(?:our |weekly |free )*newsletter|(?:share|print|save|e-?mail|bookmark|report) (?:this|on|via)\b"
    r"|(?:leave|post|add|write) a (?:reply|comment)|[\d.,]+ (?:comments?|shares|likes|views)$|(?:last )?(?:edited|updated|modified|reviewed|published|posted) on\b|\d+ min(?:ute)?s?(?: read)?$"
    r"|(?:©|\(c\)|copyright\b)|(?:all|some) rights reserved\.?$|back to (?:the )?top|(?:follow|contact|about) us$|(?:privacy|cookie|cookies)(?: notice| policy| settings)?$|terms (?:of|and) \w+$"
    r"|(?:accept|reject|decline|allow) (?:all|cookies)|(?:jump|skip) to\b|(?:related|recommended|you (?:may|might) (?:also )?(?:like|enjoy)|most (?:popular|read|viewed)|latest|popular|trending|further reading|read (?:next|more)|up next)\b[^.!?]{0,40}$)",
    re.I,
)
POINTER = re.compile(
    r"\W{0,3}(?:(?:read|see|watch|listen)(?: (?:also|more|next|now|on this site))*|(?:also|more) (?:read|see|on this site)|related|recommended|further reading|up next|in other news|don't miss"
    r"|advertisement|advert|ad|sponsored|promoted|tags?|topics?|categor(?:y|ies)|filed under|keywords|labels)\s?[:\-–—|]\s.+",
    re.I,
)
MESSAGE = re.compile(
    r"(?:page not found|error \d{3}\b.*|(?:please )?(?:log|sign) in to (?:continue|read|view).*|this content is for (?:members|subscribers).*|members only.*|loading\W*|access denied.*|not found|(?:please )?enable (?:javascript|cookies).*|just a moment.*"
    r"|something went wrong.*|(?:this )?page (?:has|was) (?:been )?(?:moved|removed|deleted).*|subscribe to (?:read|continue).*|under construction.*|coming soon.*|(?:please )?try again.*|service unavailable.*)",
    re.I,
)
LINK = re.compile(r"!?\[([^\]]*)\]\(([^)\s]*)[^)]*\)")
MARK = re.compile(r"^\s*(#{1,6}|>+|[-*+•·]|\d{1,3}[.)])\s+|[*_`]{1,3}(?=\S)|(?<=\S)[*_`]{1,3}|\s#+\s*$")
HASHES = re.compile(r"(#{1,6})\s")
MARKS = frozenset("#>-*+•·0123456789")
EMPHASIS = re.compile(r"[*_`]{1,3}(?=\S)|(?<=\S)[*_`]{1,3}")
NUMBER = re.compile(r"^(\d+(\.\d+)*[.)]?|[-*•])\s+")
DIGITS = re.compile(r"\d[\d.,:]*")
SPACES = re.compile(r"\s+")
WORD = re.compile(r"[^\W\d_]+|\d+")
KNOWN, ASIDE, LENGTHY, AWAY = 1, 2, 4, 8


@dataclass
class Line:
    number: int
    text: str  # what a reader sees, without markup and list signs
    plain: str  # the same with numbering
    tags: int  # characters of markup
    linked: int  # characters inside links
    heading: bool
    item: bool
    top: bool  # a heading of the first level
    key: int  # a number for the wording, whatever figures are in it
    words: tuple[int, ...]  # slots of the wording's words, of pairs of them, and of all of it
    flags: int
    density: float  # the ratio's logarithm, less for short lines

    @property
    def ratio(self) -> float:
        """Text-to-tag ratio: characters outside links for each character of markup."""
        return (len(self.text) - self.linked) / (1 + self.tags)


class _Events(HTMLParser):
    """Collects text, link text and markup of one line after the other."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.link = self.hidden = 0
        self.begin()

    def begin(self) -> None:
        self.parts: list[str] = []
        self.linked = self.shown = 0
        self.seen: set[str] = set()

    def handle_starttag(self, tag, attrs):
        self.seen.add(tag)
        if tag == "a":
            self.link += 1
        elif tag in ("script", "style"):
            self.hidden += 1

    def handle_endtag(self, tag):
        self.seen.add("/" + tag)
        if tag == "a":
            self.link = max(0, self.link - 1)
        elif tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)

    def handle_data(self, data):
        if self.hidden:
            return
        self.parts.append(data)
        if self.link:
            self.linked += len(data.strip())


class LineReader:
    """Reads pages line by line; what a line shows is remembered, as sites repeat their lines.

    A line of markup is only remembered if no link, script or style is open before
    or after it, for then it means the same on every page.
    """

    def __init__(self, keep: int = 40_000):
        self._keep = keep
        self._seen: dict[tuple[bool, str], tuple | None] = {}

    def read(self, content: str, markup: bool) -> list[Line]:
        """The lines of a page that show text; numbers count line feeds from 1."""
        events = _Events() if markup else None
        lines = []
        for number, raw in enumerate(content.split("\n"), 1):
            raw = raw.rstrip("\r")
            if not raw or raw.isspace():
                continue
            key = (markup, raw)
            closed = events is None or not (events.link or events.hidden or events.rawdata)
            if closed and key in self._seen:
                shown = self._seen[key]
            else:
                shown = self._shown(raw, events)
                if closed and (events is None or not (events.link or events.hidden or events.rawdata)) and len(raw) <= REPEATED:
                    if len(self._seen) >= self._keep:
                        self._seen.clear()
                    self._seen[key] = shown
            if shown is not None:
                lines.append(Line(number, *shown))
        return lines

    @staticmethod
    def _shown(raw: str, events: _Events | None) -> tuple | None:
        if events is not None:
            events.begin()
            events.feed(raw + "\n")
            shown = SPACES.sub(" ", "".join(events.parts)).strip()
            linked = events.linked
            heading = bool(events.seen & {"h1", "h2", "h3", "h4", "h5", "h6"})
            item, top = "li" in events.seen, "h1" in events.seen
        else:
            shown, linked, heading, item, top = raw.strip(), 0, False, False, False
        first = shown[:1]
        if first == "#":
            mark = HASHES.match(shown)
            heading, top = heading or mark is not None, top or (mark is not None and mark.end(1) == 1)
        elif first == "*" and shown.startswith("**") and shown.endswith("**") and len(shown) > 4:
            heading = True
        item = item or (first in "-*+•" and shown[1:2].isspace())
        if "](" in shown:
            linked += sum(len(t) for t, _ in LINK.findall(shown))
            shown = LINK.sub(r"\1", shown)
        plain = shown
        while plain[:1] in MARKS or "*" in plain or "_" in plain or "`" in plain or plain.endswith("#"):
            cleaned = MARK.sub("", plain) if not plain[:1].isdigit() else EMPHASIS.sub("", plain)
            if cleaned == plain:
                break
            plain = cleaned
        plain = plain.strip()
        if not any(c.isalnum() for c in plain):
            return None
        text = NUMBER.sub("", plain).strip() or plain
        tags, linked = len(raw) - len(plain), min(linked, len(plain))
        density = math.log1p(max(0.0, (len(text) - linked) / (1 + tags))) * min(1.0, len(text) / LONG)
        return text, plain, tags, linked, heading, item, top, *wording(text), density


def read_lines(content: str, markup: bool) -> list[Line]:
    return LineReader().read(content, markup)


@lru_cache(100_000)
def _word_hash(word: str) -> int:
    return xxhash.xxh32_intdigest("#" if word.isdigit() else word.encode("utf-8", "surrogatepass")) >> 2


def wording(text: str) -> tuple[int, tuple[int, ...], int]:
    """Key, slots and flags of a line.

    Slots below ``SLOTS`` count words: the first ones, and by themselves the first
    and the last of these.  A wording of few words has two more slots for all of
    it, by independent hashes, so that one that is shared by chance shows.
    """
    folded = " ".join(text.casefold().split())
    key = xxhash.xxh64_intdigest(DIGITS.sub("#", folded).encode("utf-8", "surrogatepass"))
    words = [_word_hash(m.group()) for m in islice(WORD.finditer(folded), OPENING + 1)]
    whole = 0 < len(words) <= OPENING
    del words[OPENING:]
    slots = {h & (SLOTS - 1) for h in words}
    if words:
        slots.add((words[0] * 31 + 7) & (SLOTS - 1))
        slots.add((words[-1] * 37 + 11) & (SLOTS - 1))
    found = (*slots, SLOTS + (key & (SLOTS - 1)), 2 * SLOTS + (key >> 40 & (SLOTS - 1))) if whole else tuple(slots)
    away = MESSAGE.fullmatch(text) is not None
    flags = KNOWN * (PRIOR.match(text) is not None) | ASIDE * (away or POINTER.fullmatch(text) is not None) | LENGTHY * (len(text) >= 2 * LONG) | AWAY * away
    return key - (1 << 64) if key >> 63 else key, found, flags


def _slug(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", text.casefold()).strip("-")


def title_line(lines: list[Line], title: str | None, url: str | None) -> int | None:
    """Index of the article's title, known by the given title, the address or, without a title, as the first top heading."""
    wanted = SPACES.sub(" ", title).strip().casefold() if title else ""
    if wanted:
        for i, line in enumerate(lines):
            if wanted in (line.text.casefold(), line.plain.casefold()):
                return i
    tail = re.sub(r"-\d+$", "", _slug((url or "").split("?")[0].rstrip("/").rsplit("/", 1)[-1]))
    if len(tail) >= 4:
        for i, line in enumerate(lines):
            if tail in (_slug(line.text), _slug(line.plain)):
                return i
    if not wanted and not any(x.flags & AWAY for x in lines):
        return next((i for i, line in enumerate(lines) if line.top), None)
    return None


def contents(lines: list[Line]) -> list[bool]:
    """Which lines are a list of contents: two or more that come again below in the same order, as heads of something, and the line above them."""
    last = {line.text.casefold(): i for i, line in enumerate(lines)}
    again = [last[line.text.casefold()] for line in lines]
    out = [False] * len(lines)
    i = 0
    while i < len(lines):
        j = i
        while j < len(lines) and again[j] > j:
            j += 1
        k = i
        while k < j and again[k] >= j and (k == i or again[k] > again[k - 1] + 1):
            k += 1
        if i and k - i >= 2:
            out[i - 1 : k] = [True] * (k - i + 1)
            i = k
        else:
            i += 1
    return out


def smooth(values, starts=(0,)) -> np.ndarray:
    """Gaussian smoothing along the lines of each page; beyond a page's ends there is nothing."""
    values = np.asarray(values, dtype=float)
    starts = np.asarray(starts, dtype=np.int64)
    weights = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
    sizes = np.diff(np.append(starts, len(values)))
    place = np.arange(len(values)) + REACH * (1 + np.repeat(np.arange(len(starts)), sizes))
    spaced, there = np.zeros((2, len(values) + REACH * (len(starts) + 1)))
    spaced[place], there[place] = values, 1.0
    return np.convolve(spaced, weights, "same")[place] / np.convolve(there, weights, "same")[place] if len(values) else values


def two_means(values, starts=(0,)) -> np.ndarray:
    """For each page, the threshold between the two clusters of its numbers."""
    values = np.asarray(values, dtype=float)
    starts = np.asarray(starts, dtype=np.int64)
    page = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(values))))
    low, high = np.minimum.reduceat(values, starts), np.maximum.reduceat(values, starts)
    flat = low == high
    count = lambda mask, v=None: np.bincount(page[mask], None if v is None else v[mask], minlength=len(starts))
    for _ in range(50):
        above = values > ((low + high) / 2)[page]
        n, m = count(~above), count(above)
        split = (n > 0) & (m > 0)
        new = np.where(split, count(~above, values) / np.maximum(n, 1), low), np.where(split, count(above, values) / np.maximum(m, 1), high)
        if np.array_equal(new[0], low) and np.array_equal(new[1], high):
            break
        low, high = new
    return np.where(flat, low - 1, (low + high) / 2)


@dataclass
class Pages:
    """The lines of several pages, one after the other."""

    starts: np.ndarray  # of each page that shows lines
    anchor: np.ndarray  # line of each page's title within the page, or -1
    density: np.ndarray
    flags: np.ndarray
    recurs: np.ndarray  # share of the site's other pages that have the line
    sizes: np.ndarray  # number of slots of each line
    slots: np.ndarray


@dataclass
class Wordings:
    """How often what fills a slot was inside and outside of content regions."""

    inside: np.ndarray = field(default_factory=lambda: np.zeros(3 * SLOTS))
    outside: np.ndarray = field(default_factory=lambda: np.zeros(3 * SLOTS))


#: Log odds of a line that recurs nowhere; limits of the odds; weight of words against a whole wording, and of a known one; odds of a line to be taken out of a region.
CLEAR, SURE, WEIGHT, SEEN, STRAY = 1.1, 4.0, 3.0, 6.0, -1.0


def odds(pages: Pages, wordings: Wordings | None) -> np.ndarray:
    """Log odds of each line's wording to be part of a main body."""
    known = (pages.flags & KNOWN) > 0
    found = np.log((1 - pages.recurs) / (pages.recurs + 0.1)) - np.log(10) + CLEAR
    if wordings is None:
        found = found - np.where(known, SURE + CLEAR, 0.0)
    else:
        line = np.repeat(np.arange(len(pages.sizes)), pages.sizes)
        inside, outside = wordings.inside[pages.slots], wordings.outside[pages.slots]
        word = pages.slots < SLOTS
        by_line = lambda mask, v: np.bincount(line[mask], v, minlength=len(pages.sizes))
        n = by_line(word, None)
        mean = by_line(word, np.log((inside[word] + 0.5) / (outside[word] + 0.5))) / np.maximum(n, 1)
        by_words = 1 / (1 + np.exp(-np.clip(1.5 * mean, -20, 20)))
        # of the two slots of a whole wording the one that fewer lines filled tells more
        first, second = np.flatnonzero((pages.slots >= SLOTS) & (pages.slots < 2 * SLOTS)), np.flatnonzero(pages.slots >= 2 * SLOTS)
        better = np.where(inside[first] + outside[first] <= inside[second] + outside[second], first, second)
        whole_in, whole_out = np.zeros((2, len(pages.sizes)))
        whole_in[line[first]], whole_out[line[first]] = inside[better], outside[better]
        whole_out += np.where(known, SEEN, 0.0)
        p = (whole_in + WEIGHT * by_words) / (whole_in + whole_out + WEIGHT)
        found = found + np.log((p + 1e-3) / (1 - p + 1e-3))
    return np.where(pages.flags & ASIDE, -3.0, np.clip(found, -SURE, SURE))


def main_body(pages: Pages, wordings: Wordings | None = None) -> np.ndarray:
    """Whether each line is part of the main body; without wordings only the densest stretch is."""
    total, starts = len(pages.density), pages.starts
    body = np.zeros(total, dtype=bool)
    if not total:
        return body
    ends = np.append(starts[1:], total)
    page = np.repeat(np.arange(len(starts)), ends - starts)
    likely = odds(pages, wordings)
    density = pages.density / (1 + np.exp(-likely))
    titled = pages.anchor >= 0
    title = (starts + pages.anchor)[titled]
    density[title] = np.maximum(np.maximum.reduceat(density, starts)[titled], 1.0)
    smoothed = smooth(density, starts)
    dense = smoothed > two_means(smoothed, starts)[page]
    likely[title] = SURE
    # stretches of dense lines, which end with their page, and their masses
    first = np.flatnonzero(dense & ~np.append(False, dense[:-1] & (page[1:] == page[:-1])))
    last = np.flatnonzero(dense & ~np.append(dense[1:] & (page[1:] == page[:-1]), False))
    mass = np.append(0.0, np.cumsum(smoothed))
    mass = mass[last + 1] - mass[first]
    away = np.bitwise_or.reduceat(pages.flags, starts) & AWAY
    lengthy = np.append(0, np.cumsum(((pages.flags & LENGTHY) > 0) & dense & (likely > STRAY)))
    held = np.searchsorted(page[first], np.arange(len(starts) + 1))
    for k in range(len(starts)):
        own = range(held[k], held[k + 1])
        if not own:
            continue
        best = max(own, key=lambda r: mass[r])
        a, b = int(first[best]), int(last[best])
        if titled[k]:
            at = int(starts[k] + pages.anchor[k])
            a = at if at <= b else a
            body[at] = True
        elif away[k] or lengthy[ends[k]] - lengthy[starts[k]] < 2:
            continue  # without a title only clearly dense text is an article; a message in its place isn't
        own_stretches = [(int(first[r]), int(last[r])) for r in own] if wordings is not None else []
        a, b = _grown(a, b, own_stretches, likely, pages.flags, int(starts[k]), int(ends[k]), bool(titled[k]))
        body[a : b + 1] |= likely[a : b + 1] > STRAY
    return body


def _grown(a: int, b: int, stretches: list[tuple[int, int]], likely: np.ndarray, flags: np.ndarray, start: int, end: int, titled: bool) -> tuple[int, int]:
    """A region without its unlikely tail, and with the other ``stretches`` and single lines beside it whose wordings are likelier inside."""
    counted = np.where(flags[start:end] & ASIDE, 0.0, likely[start:end])
    gain = np.append(0.0, np.cumsum(counted))
    for x, y in stretches:
        if x > b:
            if gain[x - start] - gain[b + 1 - start] < 0:
                break
            b = y
    if not titled:
        for x, y in reversed(stretches):
            if y < a:
                if gain[a - start] - gain[y + 1 - start] < 0:
                    break
                a = x
    # a tail of unlikely lines goes, though dense lines be among them, as teasers have sentences too
    inside = np.cumsum(counted[a - start : b + 1 - start])
    b = a + len(inside) - 1 - int(inside[::-1].argmax())
    if not stretches:
        return a, b
    after = np.cumsum(likely[b + 1 : end])
    if len(after) and after.max() > 0:
        b += 1 + int(after.argmax())
    if not titled:
        before = np.cumsum(likely[start:a][::-1])
        if len(before) and before.max() > 0:
            a -= 1 + int(before.argmax())
    return a, b
