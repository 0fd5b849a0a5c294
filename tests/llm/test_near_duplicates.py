import itertools
import random
import re

import numpy as np

from corvane.llm import shingles as sh
from corvane.llm.near_duplicates import near_duplicate_pairs

SETTINGS = {"identifier": "chunk_id", "text": "page_content", "threshold": 0.6, "width": 3, "least_words": 20}
WORD = re.compile(r"[一-鿿]|[^\W_一-鿿]+")


def brute(rows, threshold=0.6, width=3, least=20):
    sets = {}
    for key, text in rows:
        words = WORD.findall((text or "").lower())
        if key is not None and len(words) >= least:
            sets[key] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
    return {
        (a, b)
        for a, b in itertools.combinations(sorted(sets), 2)
        if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12
    }


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + list("风险价值保证金")
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(18, 90))]
        rows.append((f"c{i:03}a", " ".join(words)))
        for k in range(rng.randint(0, 3)):
            edited = list(words)
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(edited))
                edited[at : at + 1] = rng.choice([[], ["neu"], [edited[at], "plus"]])
                edited = edited or ["x"]
            rows.append((f"c{i:03}b{k}", "  ".join(edited).upper()))
    return rows


def test_words_and_sets_match_plain_python():
    texts = ["Größe 3,5 风险价值x9 _under_score ½ é", "", "a b c", "naïve—café İstanbul"]
    hashes, owner = sh.word_hashes(texts)
    assert np.bincount(owner, minlength=4).tolist() == [len(WORD.findall(t.lower())) for t in texts]
    one, two = sh.word_hashes(["Rate limit"])[0], sh.word_hashes(["x RATE"])[0]
    assert one[0] == two[1] and one[0] != one[1]


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    both = np.concatenate([np.sort(np.concatenate([common, a])), np.sort(np.concatenate([common, b]))])
    samples = sh.min_hashes(both, np.array([0, 900]), 200, 1)
    one, two = sh.odd_sketches(samples, 1024)
    apart = np.bitwise_count(one ^ two).sum()
    assert abs(sh.estimated_similarity(apart, 200, 1024) - 0.8) < 0.12


def test_pairs_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "chunk_id string, page_content string")
    got = {tuple(r) for r in near_duplicate_pairs(df, **SETTINGS).collect()}
    assert got == brute(rows)


def test_large_bands_are_paired_in_blocks(spark):
    rows = [r for r in corpus(5)] + [(f"h{i}", " ".join(f"q{k}" for k in range(40)) + f" z{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "chunk_id string, page_content string")
    got = [tuple(r) for r in near_duplicate_pairs(df, **SETTINGS, block=4).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_edges(spark):
    long = " ".join(f"v{i}" for i in range(30000))
    rows = [(None, long, "1"), ("a", None, "1"), ("b", "", "1"), ("c", "few words", "1"), ("d", long, "1"), ("e", long + " x", "1"), ("d", long, "2"), ("f", long, "1")]
    df = spark.createDataFrame(rows, "chunk_id string, page_content string, band string")
    assert {tuple(r) for r in near_duplicate_pairs(df, **SETTINGS).collect()} == {("d", "e"), ("d", "f"), ("e", "f")}
    assert near_duplicate_pairs(df.limit(0), **SETTINGS).count() == 0
