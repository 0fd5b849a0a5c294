import random

import numpy as np
import pytest

from corvane.llm import levels as lv
from corvane.llm.boilerplate import page_furniture
from corvane.llm.bpe import Encoder, load_merges
from corvane.llm.mixing import fly, land, mix_sources
from corvane.llm.page_text import read_lines, smooth, two_means
from corvane.llm.reading_level import reading_levels
from corvane.llm.splitting import cut_places, split_oversized
from corvane.llm.tokenizing import TOKENIZERS, VOCABULARY, encode


def greedy(text, size, least, overlap):
    tests = (
        lambda b: text[b - 2 : b] == "\n\n" or text[b - 3 : b] == "\n\r\n",
        lambda b: text[b - 1] == "\n",
        lambda b: (text[b - 1] == " " and b > 1 and text[b - 2] in ".!?") or text[b - 1] in "。！？",
        lambda b: text[b - 1] == " ",
    )
    start, out = 0, []
    while len(text) - start > size:
        ends = range(start + size, start + least, -1)
        end = next((b for t in tests for b in ends if t(b)), start + size)
        out.append((start, end))
        start = end - overlap
    return [*out, (start, len(text))]


def test_splitting_matches_greedy():
    rng = random.Random(2)
    for _ in range(500):
        rare = rng.choice(["", "\n. ", "\n\r. ", "。 "])
        text = "".join(rng.choice("a" * 16 + "😀" + rare) for _ in range(rng.randint(0, 400)))
        starts, ends = cut_places(text, 40, 20, 5)
        assert list(zip(starts.tolist(), ends.tolist())) == greedy(text, 40, 20, 5)


def test_splitting_edges(spark):
    rows = [("a", "x" * 9000, 1), ("a", "x" * 9000, 2), ("b", None, 1), ("c", "short", 1), (None, "y " * 2500, 1)]
    df = spark.createDataFrame(rows, "parent_id string, page_content string, piece_no int")
    got = sorted((r for r in map(tuple, split_oversized(df, identifier="parent_id", text="page_content").collect())), key=str)
    assert [r for r in got if r[0] == "a"] == [("a", 1, 0, 4000), ("a", 2, 3800, 7800), ("a", 3, 7600, 9000)]
    assert {r[0] for r in got} == {"a", None}
    assert split_oversized(df.limit(0), identifier="parent_id", text="page_content").count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, identifier="parent_id", text="page_content", overlap=2500)


@pytest.fixture(scope="module")
def merges():
    return load_merges(f"{TOKENIZERS}/{VOCABULARY}")


def test_encoding_equals_the_library_and_round_trips(merges):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(f"{TOKENIZERS}/{VOCABULARY}")
    library.encode_special_tokens = True
    rng = random.Random(8)
    texts = ["".join(rng.choice("aaabbe <|endoftext|> \n\t's12é中文🙂½ﬁ‍") for _ in range(rng.randint(0, 80))) for _ in range(800)]
    texts += ["", "a" * 5000, "<|endoftext|>", "  \n\n x ", "　"]
    got = Encoder(merges, keep=50).encode_batch(texts)
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [library.decode(ids, skip_special_tokens=False) for ids in got] == texts


def test_encode_edges(spark):
    df = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (3, "Hello world", "t"), (3, "Hello world", "t")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, len(r.ids)) for r in encode(df.drop("ids"), "text", keep=["doc_id"]).collect())
    assert got == [(1, 0), (2, 0), (3, 2), (3, 2)]
    assert encode(df.limit(0), "text", keep=["doc_id"]).count() == 0


def test_cube_keeps_count_and_tokens():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 500, 400).astype(float)
    chances = np.full(400, 0.37)
    flown = fly(chances, sizes, 1)
    assert ((flown > 0) & (flown < 1)).sum() <= 2
    assert abs(flown.sum() - chances.sum()) < 1e-6 and abs(flown @ sizes - chances @ sizes) < 1e-3
    landed = land(flown, sizes, float(chances @ sizes))
    assert set(landed) <= {0.0, 1.0} and abs(landed @ sizes - chances @ sizes) <= 2


def test_mix_reaches_shares(spark):
    rng = random.Random(1)
    rows = [(i, s, " ".join(rng.choice(["risk", "limit", "desk"]) for _ in range(rng.randint(1, 60))), "x") for i, s in enumerate(["a"] * 900 + ["b"] * 300 + ["c"] * 40)]
    rows += [(5000, "a", None, "x"), (5001, "b", "", "x"), (5002, "zz", "unlisted text", "x"), (5003, None, "no source", "x"), rows[0]]
    rows += [(6000 + i, "b", rows[0][2], "x") for i in range(5)]  # one text under many identifiers
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string, tokens string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.25, 1), ("c", 0.15, 3), ("gone", 0.1, 9), (None, 0.1, 1), ("zz", None, 1), ("zz", 0.2, None)], "source string, target_share double, max_repeats int")
    for block in (50_000, 60):
        mix, shares = mix_sources(df, targets, identifier="doc_id", source="source", text="text", block=block)
        used = mix.collect()
        assert len({r.doc_id for r in used}) == len(used) and not {r.doc_id for r in used} & {5000, 5001, 5002, 5003, *range(6000, 6005)}
        limit = {"a": 2, "b": 1, "c": 3}
        assert all(r.repeats <= limit[r.source] for r in used)
        for r in shares.collect():
            assert abs(r.actual_share - (0 if r.source == "gone" else r.target_share / 0.9)) < 0.01
    mix, shares = mix_sources(df.limit(0), targets, identifier="doc_id", source="source", text="text")
    assert mix.count() == 0 and {r.actual_share for r in shares.collect()} == {0.0}


PAGE = """Jump to content
Home
Pricing

# How delta is hedged

Contents
1 Idea
2 Limits

## Idea

Delta is the change of a position's value when the underlying price moves by a small amount, as every trader knows well.

Read also: Vega, revisited

Menu pricing was withdrawn in 2012.

## Limits

- Gamma
- Theta

A limit keeps the exposure of a desk within what the bank can lose, and it is reviewed every month by risk control.

You may also like
Vega for busy desks
The carry offsets a part of the funding cost of the book, roughly half of it in a normal year for most desks.
© 2020 Example. All rights reserved."""
OUTSIDE = [1, 2, 3, 7, 8, 9, 15, 26, 27, 28, 29]


def test_page_body(spark):
    rows = [
        (1, "https://x.example/a/how-delta-is-hedged-1", "md", "How delta is hedged", PAGE, "k"),
        (1, "https://x.example/a/how-delta-is-hedged-1", "md", "How delta is hedged", PAGE, "k"),
        (2, None, None, None, PAGE.replace("\n", "\r\n"), "k"),
        (3, "https://x.example/x", "html", None, None, "k"),
        (4, "https://x.example/x", "md", None, "", "k"),
        (5, "https://x.example/a/gone-5", "html", None, "<body>\n<p>Page not found</p>\n<a href='/'>Home</a>\n</body>", "k"),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, source string, file_type string, title string, page_content string, keys string")
    names = {"identifier": "page_id", "url": "source", "kind": "file_type", "title": "title", "content": "page_content"}
    found = [tuple(r) for r in page_furniture(df, **names).collect()]
    assert len(found) == len(set(found))
    assert sorted(n for p, n in found if p == 1) == OUTSIDE
    assert {1, 2, 3, 26, 29} <= {n for p, n in found if p == 2} and 13 not in {n for p, n in found if p == 2}
    assert sorted(n for p, n in found if p == 5) == [2, 3]
    assert not [n for p, n in found if p in (3, 4)]
    assert page_furniture(df.limit(0), **names).count() == 0


def test_an_article_fetched_again_is_no_furniture(spark):
    body = "The {0} paragraph of this article is long enough to be taken for running text, " * 3 + "as it goes on about {0} things."
    article = "\n".join(["Home", *(body.format(w) for w in ("first", "second", "third")), "All rights reserved."])
    words = "zero one two three four five six seven eight nine".split()
    rows = [(k, "https://y.example/p", "md", None, article) for k in range(12)] + [(100 + k, "https://y.example/q", "md", None, "\n".join(["Home", body.format(w)])) for k, w in enumerate(words)]
    df = spark.createDataFrame(rows, "page_id bigint, source string, file_type string, title string, page_content string")
    found = {tuple(r) for r in page_furniture(df, identifier="page_id", url="source", kind="file_type", title="title", content="page_content").collect()}
    assert all({n for p, n in found if p == k} == {1, 5} for k in range(12))


def test_page_helpers():
    assert [x.number for x in read_lines("<p>a</p>\n<br/>\n\n<a href='/b'>link text</a>", True)] == [1, 4]
    assert read_lines("<a href='/b'>link text</a>", True)[0].linked == 9
    assert np.allclose(smooth([1.0, 1.0, 1.0]), 1.0)
    assert 1 < two_means([0.0, 0.1, 0.2, 5.0, 5.1]) < 5


EXAMPLES = {
    1: ["A bank keeps some money in a jar.", "Some days you win and some days you lose.", "It is a bit like an umbrella on a grey day."],
    2: ["The formula has three inputs which can be observed in the market.", "A student first adds the exposures together.", "When interest rates increase the value of a bond decreases."],
    3: ["Unexplained results stayed below two percent once stale marks had been resolved.", "Sensitivities are aggregated per netting set before the limit check.", "The desk ran the overnight batch again because of a booking mismatch."],
    4: ["Heteroskedastic residuals invalidate the asymptotic covariance on which the statistic rests.", "Pathwise differentiation introduces foresight bias unless the regression basis is orthogonalised.", "Notwithstanding the cessation provisions the eligibility of factors remains conditional upon proof."],
}


def test_levels(spark):
    rng = random.Random(6)
    graded = [(" ".join(rng.sample(s, 3)) if k % 2 else "\n".join("- " + x for x in s), "en", level) for level, s in EXAMPLES.items() for k in range(6)]
    examples = spark.createDataFrame(graded, "text string, lang string, level int")
    docs = [(level * 10 + k, " ".join(rng.choices(s, k=4) + rng.choices(EXAMPLES[min(4, level + 1)], k=1)), "en", "x") for level, s in EXAMPLES.items() for k in range(5)]
    docs += [(900, None, "en", "x"), (901, "", None, "x"), (902, " ​\n", "en", "x"), (903, "— 12 —", None, "x"), docs[0]]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, level string")
    got = [(r.doc_id, r.level) for r in reading_levels(df, examples, identifier="doc_id", text="text", language="lang").collect()]
    assert len(got) == len(set(got))
    found = dict(got)
    assert all(found[level * 10 + k] == level for level in EXAMPLES for k in range(5))
    assert not {900, 901, 902} & set(found) and found[903] == 1
    assert reading_levels(df.limit(0), examples, identifier="doc_id", text="text", language="lang").count() == 0


def test_examples_without_some_levels(spark):
    import warnings

    graded = [(" ".join(EXAMPLES[level]), "en", level) for level in (1, 4) for _ in range(3)]
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        own = lv.example_words(graded)
        model = lv.fit(graded, own, {lang: sum(n.values()) for lang, n in own.items()})
    sentences = lv.Sentences.of(lv.units(" ".join(EXAMPLES[1])), "en")
    votes = lv.text_votes(sentences, np.zeros(len(sentences.sizes), dtype=np.int64), 1, "en", model.languages["en"])
    assert lv.most_voted(votes).tolist() == [1]


def test_special_tokens_make_no_table_row():
    from corvane.llm.levels import units

    prose = "The desk reports the limit each day <|endoftext|> and the bank checks it. Every month it is reviewed by risk control."
    assert len(units(prose + "\nA short line that stands alone here.")) == 3
    assert len(units("| a | b |\nA short line that stands alone here.")) == 1


def test_ordinal_thresholds_increase():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    y = 1 + (x[:, 0][:, None] > np.array([-1, 0, 1])).sum(axis=1)
    w, t = lv.fit_ordinal(x, y)
    assert (np.diff(t) > 0).all() and abs(w[0]) > 5 * abs(w[1])
