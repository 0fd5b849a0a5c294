"""Lexical search moves and keeps a few rows a question, not one for each pair of a question and a chunk."""

import datetime
import math
import random
from collections import Counter

import pytest

from corvane import session
from corvane.operators import retrieval as R
from corvane.plans import catalog

WORDS = ("market", "value", "risk", "margin", "limit", "hedge", "desk", "curve")


def moved(spark) -> int:
    """Rows written to shuffles so far."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    sc.listenerBus().waitUntilEmpty()
    none = gateway.jvm.java.util.ArrayList()
    return sum(s.shuffleWriteRecords() for s in gateway.jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc.statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """1,500 chunks of 150 parents that all share words with all 40 questions asked."""
    at, rng, now = tmp_path_factory.mktemp("search"), random.Random(5), datetime.datetime(2025, 1, 1)
    text = lambda n: " ".join((*WORDS, *rng.choices([*WORDS, "of", "the", "book", "trade"], k=n), *(f"x{rng.random()}"[:9] for _ in range(3))))
    chunks = [(f"c{i:05d}", i % 10, f"s{i % 90}.md", f"p{i // 10:04d}", f"part {i % 7}", text(20), now) for i in range(1500)]
    parents = [(f"p{i:04d}", f"s{i % 90}.md", "md", f"part {i % 7}", text(60), now) for i in range(150)]
    asked = [(f"q{50 * i:08d}", f"How do {' and '.join(rng.sample(WORDS, 4))} compare with item{i}?", now) for i in range(40)]
    for name, rows, kind in (
        ("chunks", chunks, "chunk_id string, chunk_index int, source string, parent_id string, section_path string, page_content string, indexed_at timestamp"),
        ("parents", parents, "parent_id string, source string, file_type string, section_path string, page_content string, indexed_at timestamp"),
        ("questions", asked, "id string, question string, updated_at timestamp"),
    ):
        spark.createDataFrame(rows, kind).write.parquet(f"{at}/{name}.parquet")
    return str(at)


#: Queries that search by words, and the rows they may move here; each question meets 1,500 chunks, so that the pairs are 60,000.
MOVED = {
    "ret13_multi_query": 40_000, "ret3_bm25_top": 40_000, "ret14_parent_rescoring": 40_000, "ret16_chunk_read": 40_000, "ret3_keyword_tool": 40_000,
    "flow_hybrid": 80_000, "ret21_expanded_chunks": 80_000, "ret21_expanded_round": 80_000,
}


@pytest.mark.parametrize("name", MOVED)
def test_pairs_are_not_moved(spark, folder, name):
    before = moved(spark)
    assert catalog.queries()[name](spark, folder).count() > 0
    assert moved(spark) - before < MOVED[name]


@pytest.mark.parametrize("repeat", [False, True])
def test_search_over_blocks_and_passes_equals_the_formula(spark, monkeypatch, repeat):
    monkeypatch.setattr(R, "SCORED_BLOCK", 7)
    monkeypatch.setattr(R, "QUESTIONS_AT_ONCE", 3)
    rng = random.Random(3)
    docs = [(f"d{i:03d}", " ".join(rng.choices("alpha beta gamma delta epsilon zeta rho".split(), k=rng.randint(0, 9)))) for i in range(120)]
    docs += [("d900", None), ("d901", "Alpha, beta!"), ("d902", "alpha beta")]
    asked = [(i, " ".join(rng.choices("alpha beta gamma delta rho none".split(), k=3))) for i in range(20)] + [(50, "beta alpha"), (51, "ALPHA beta"), (52, ""), (53, None), (54, "none")]
    cut = {key: (text or "").lower().replace(",", "").replace("!", "").split() for key, text in docs}
    df, n, mean = Counter(t for own in cut.values() for t in set(own)), len(docs), sum(map(len, cut.values())) / len(docs)
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    idf = {t: 0.25 * sum(raw.values()) / len(raw) if x < 0 else x for t, x in raw.items()}
    expected = set()
    for qid, text in asked:
        terms = (text or "").lower().split()
        terms = terms if repeat else list(dict.fromkeys(terms))
        scores = []
        for key, own in cut.items():
            tf = Counter(own)
            score = round(sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(own) / mean)) for t in terms if tf[t]), 6)
            scores += [(-score, key)] * (score > 0)
        expected |= {(qid, key, -score, rank) for rank, (score, key) in enumerate(sorted(scores)[:6], 1)}
    found = R.sparse_search(spark.createDataFrame(docs, "k string, t string").repartition(3), "k", "t", spark.createDataFrame(asked, "id int, q string"), "id", "q", 6, repeat)
    assert {(r.qid, r.key, r.score, r.rank) for r in found.collect()} == expected


def moved_bytes(spark) -> int:
    """Bytes written to shuffles so far."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    sc.listenerBus().waitUntilEmpty()
    none = gateway.jvm.java.util.ArrayList()
    return sum(s.shuffleWriteBytes() for s in gateway.jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc.statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)))


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """Chunks and parents of 6 MB of text out of 1,500 words, some of the rows repeated."""
    at, rng, now = tmp_path_factory.mktemp("long"), random.Random(11), datetime.datetime(2025, 1, 1)
    words = [*WORDS, *("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(1500))]
    text = lambda n: " ".join(rng.choices(words, k=n)) + ". "
    chunks = [(f"c{i:05d}", i % 10, f"s{i % 90}.md", f"p{i // 10:04d}", f"part {i % 7}", text(250), now) for i in range(1500)]
    parents = [(f"p{i:04d}", f"s{i % 90}.md", "md", f"part {i % 7}", "".join(text(40) for _ in range(60)), now) for i in range(150)]
    asked = [(f"q{50 * i:08d}", f"How do {' and '.join(rng.sample(words, 4))} compare?", now) for i in range(10)]
    for name, rows, kind in (
        ("chunks", chunks + chunks[:50], "chunk_id string, chunk_index int, source string, parent_id string, section_path string, page_content string, indexed_at timestamp"),
        ("parents", parents + parents[:5], "parent_id string, source string, file_type string, section_path string, page_content string, indexed_at timestamp"),
        ("questions", asked, "id string, question string, updated_at timestamp"),
    ):
        spark.createDataFrame(rows, kind).repartition(8).write.parquet(f"{at}/{name}.parquet")
    return str(at)


#: Queries that search by words, and the bytes they may move here.
MOVED_BYTES = {"ret3_bm25_top": 600_000, "ret14_parent_rescoring": 600_000, "ret16_chunk_read": 600_000, "ret3_keyword_tool": 600_000, "ret21_expanded_chunks": 6_000_000, "ret21_expanded_round": 6_000_000}


@pytest.mark.parametrize("name", MOVED_BYTES)
def test_texts_are_not_moved(spark, long_texts, name):
    before = moved_bytes(spark)
    assert catalog.queries()[name](spark, long_texts).count() > 0
    assert moved_bytes(spark) - before < MOVED_BYTES[name]


@pytest.mark.parametrize("held", [1_000_000, 0])
def test_index_takes_each_key_once(spark, monkeypatch, held):
    monkeypatch.setattr(session, "SURPLUS_HELD", held)
    docs = [("a", "risk limit"), ("a", "risk limit"), ("b", "risk"), ("b", "risk"), ("b", "risk"), ("c", "margin desk"), ("d", "curve"), (None, "hedge"), (None, "hedge")]
    index = R.lexicon(spark.createDataFrame(docs, "k string, t string").repartition(4), "k", "t")
    assert (index.documents, index.mean_length) == (5, 1.4)
    assert sorted((r.key or "", r.dl, r.tokens) for r in index.tokens.collect()) == [("", 1, "hedge"), ("a", 2, "risk limit"), ("b", 1, "risk"), ("c", 2, "margin desk"), ("d", 1, "curve")]
    assert {r.token: (r.documents, r.occurrences) for r in index.weights.collect()}["risk"] == (2, 2)


@pytest.fixture(scope="module")
def many_chunks(spark, tmp_path_factory):
    """20,000 short chunks, whose vectors of 64 values are larger than all else."""
    at, rng, now = tmp_path_factory.mktemp("many"), random.Random(13), datetime.datetime(2025, 1, 1)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(1500)]
    text = lambda n: " ".join(rng.choices(words, k=n)) + ". "
    chunks = [(f"c{i:05d}", i % 10, f"s{i % 90}.md", f"p{i // 100:04d}", f"part {i % 7}", text(12), now) for i in range(20_000)]
    parents = [(f"p{i:04d}", f"s{i % 90}.md", "md", f"part {i % 7}", text(60), now) for i in range(200)]
    asked = [(f"q{50 * i:08d}", f"How do {' and '.join(rng.sample(words, 4))} compare?", now) for i in range(4)]
    for name, rows, kind in (
        ("chunks", chunks, "chunk_id string, chunk_index int, source string, parent_id string, section_path string, page_content string, indexed_at timestamp"),
        ("parents", parents, "parent_id string, source string, file_type string, section_path string, page_content string, indexed_at timestamp"),
        ("questions", asked, "id string, question string, updated_at timestamp"),
    ):
        spark.createDataFrame(rows, kind).repartition(8).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_vectors_are_not_moved_and_stored_as_they_are_multiplied(spark, many_chunks, monkeypatch):
    before, stored, kept = moved_bytes(spark), {}, session.materialize

    def noted(df, label, **options):
        stored[label] = kept(df, label, **options)
        return stored[label]

    monkeypatch.setattr(session, "materialize", noted)  # what once() stores
    assert catalog.queries()["ret21_expanded_round"](spark, many_chunks).count() == 4
    assert dict(stored["chunk-vectors"].dtypes)["vector"] == "array<float>"
    assert moved_bytes(spark) - before < 3_500_000


def test_streamed_vectors_over_blocks_and_passes_equal_the_blocks(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(f"r{i:03d}", [rng.gauss(0, 1) + (i % 7) for _ in range(8)]) for i in range(500)] + [(f"t{i}", [1.0] * 8) for i in range(9)] + [("n", None), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "id string, v array<double>").repartition(5)
    asked = df.where("id like 'r%0' or id = 't3' or id is null or v is null")
    of = lambda found: {(r.qid, r.key, r.score, r.rank) for r in found.collect()}
    exact = of(R.nearest(df, "id", "v", asked, "id", "v", 6))
    monkeypatch.setattr(R, "VECTOR_BLOCK", 7)
    monkeypatch.setattr(R, "VALUES_AT_ONCE", 100)
    assert len(exact) == 6 * 51 and of(R.nearest_streamed(df, "id", "v", asked, "id", "v", 6)) == exact
    assert R.nearest_streamed(df, "id", "v", df.where("id = 'none'"), "id", "v", 6).count() == 0


@pytest.fixture(scope="module")
def any_numbers(spark, tmp_path_factory):
    """Questions of any number, four of them with one wording, one empty and one repeated, over 60 chunks."""
    at, rng, now = tmp_path_factory.mktemp("numbers"), random.Random(17), datetime.datetime(2025, 1, 1)
    text = lambda n: " ".join(rng.choices([*WORDS, "of", "the", "book", "trade"], k=n)) + ". "
    chunks = [(f"c{i:05d}", i % 10, f"s{i % 9}.md", f"p{i // 10:04d}", f"part {i % 7}", text(40), now) for i in range(60)]
    parents = [(f"p{i:04d}", f"s{i % 9}.md", "md", f"part {i % 7}", text(60), now) for i in range(6)]
    wordings = ["How do market and margin compare?", "How do market and margin compare?", "What is the hedge of a desk?", "what is the hedge of a desk?", None, "Which limit has the curve and why does risk matter?"]
    asked = [(f"q{i:08d}", wordings[i % 6], now) for i in (0, 1, 2, 3, 4, 5, 6, 49, 50)]
    for name, rows, kind in (
        ("chunks", chunks, "chunk_id string, chunk_index int, source string, parent_id string, section_path string, page_content string, indexed_at timestamp"),
        ("parents", parents, "parent_id string, source string, file_type string, section_path string, page_content string, indexed_at timestamp"),
        ("questions", asked + asked[:1], "id string, question string, updated_at timestamp"),
    ):
        spark.createDataFrame(rows, kind).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_rounds_give_every_question_its_chunks(spark, any_numbers):
    from corvane.operators import hybrid as H
    from corvane.plans import retrieval_queries as Q

    found = catalog.queries()["ret21_expanded_chunks"](spark, any_numbers).collect()
    asked = [r.id for r in spark.read.parquet(f"{any_numbers}/questions.parquet").select("id").distinct().collect()]
    assert {r.id for r in found} == set(asked)
    each = H.rounds(Q.corpus(spark, any_numbers), Q._items(spark, any_numbers).select("id", "question"))[0]  # each question on its own
    assert sorted(map(tuple, found)) == sorted(map(tuple, each.select("id", "round", "key", "place", "adv").collect()))


def test_rounds_give_every_question_its_state(spark, any_numbers):
    from corvane.operators import hybrid as H
    from corvane.plans import retrieval_queries as Q

    found = catalog.queries()["ret21_expanded_round"](spark, any_numbers).collect()
    each = H.rounds(Q.corpus(spark, any_numbers), Q._items(spark, any_numbers).select("id", "question"))[1]  # each question on its own
    assert len(found) == spark.read.parquet(f"{any_numbers}/questions.parquet").select("id").distinct().count()
    assert sorted(map(tuple, found)) == sorted(map(tuple, each.select("id", "round", "tier", "sufficient", "reason").collect()))
