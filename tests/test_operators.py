import io
import json
import math
import pathlib
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from corvane.config import DEFAULT
from corvane.functions import text as T
from corvane.operators import evaluation as E
from corvane.operators import filters as P
from corvane.operators import ingest as I
from corvane.operators import retrieval as R
from corvane.operators import tools as X
from corvane.operators import windows as W
from corvane.plans import catalog as queries
from corvane.plans.engine import Engine, build_chunks
from corvane.sources import files
from corvane.sources import manifest as M
from corvane.streaming import indexing, usage


def one(spark, column, schema, *values):
    return spark.createDataFrame([values], schema).select(column.alias("x")).first()[0]


def test_tokenizers_differ_on_mixed_runs(spark):
    assert one(spark, T.tokens_a(F.col("t")), "t string", "风险abc Größe") == ["风险abc", "gr", "e"]
    assert one(spark, T.tokens_b(F.col("t")), "t string", "风险abc") == ["风险", "abc"]
    assert one(spark, T.tokens_a(F.col("t")), "t string", None) == []


def test_numbers_leave_references_out(spark):
    assert one(spark, T.numbers_gate(F.col("t")), "t string", "50% of 3.5, see chunk_12 on page 3 [source=a chunk_id=b7]") == [0.5, 3.5]
    assert one(spark, T.numbers_domain(F.col("t")), "t string", "1) first\nwas 1,234 and 7%") == [1234.0, 0.07]


def test_stemmer(spark):
    words = spark.createDataFrame([(w,) for w in ("policies", "swaps", "loss", "gas", "ties")], "w string").select(T.singular(F.col("w")))
    assert [r[0] for r in words.collect()] == ["policy", "swap", "loss", "gas", "tie"]


def test_json_is_found_in_wrappings(spark):
    for text in ('{"a": 1}', 'so:\n```json\n{"a": 1}\n```', 'it is {"a": 1} indeed'):
        assert json.loads(one(spark, T.json_object(F.col("t")), "t string", text)) == {"a": 1}
    assert one(spark, T.json_object(F.col("t")), "t string", "none") is None


SECTIONS = "intro\n# A\ntext\n### A.1\nmore\n## B\n# C ##x\nend"


def test_sections_keep_the_heading_path(spark):
    rows = I.sections(spark.createDataFrame([(1, SECTIONS), (2, "plain"), (3, None)], "id int, t string"), "id", "t").orderBy("ordinal").collect()
    assert [(r.section_path, r.start_line, r.end_line) for r in rows] == [("", 0, 1), ("A", 1, 3), ("A / A.1", 3, 5), ("A / B", 5, 6), ("C ##x", 6, 8)]
    assert all(SECTIONS[r.start_char :].startswith(r.text) for r in rows)


def test_cutters_cover_the_text():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("ab ab ab. \n\n") for _ in range(rng.randint(1, 500)))
        spans = I.seek_cuts(text, 80, 10)
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        assert all(b[0] <= a[1] and b[1] > a[1] for a, b in zip(spans, spans[1:])) and all(e - s <= 92 for s, e in spans)
        cut = I.recursive_cuts(text, 80, 10)
        assert all(e - s <= 80 for s, e in cut)
        covered = set().union(*(range(s, e) for s, e in cut)) if cut else set()
        assert all(text[i].isspace() for i in range(len(text)) if i not in covered)


def test_junk_and_quality(spark):
    junk = lambda t: one(spark, P.is_junk(F.col("t")), "t string", t)
    assert junk(None) and junk("  ") and junk("Navigation menu of the site") and junk("^ a footnote") and junk("[1] [2] [3] ab")
    assert not junk("The desk keeps a limit on its exposure to each counterparty.")
    assert not one(spark, P.passes_quality(F.col("t")), "t string", "short")


def test_hash_vector_has_unit_length(spark):
    v = one(spark, I.hash_vector(F.col("t")), "t string", "Delta & Gamma 风险")
    assert len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-9 and v[:32] == v[32:]
    assert one(spark, I.hash_vector(F.col("t")), "t string", "") == one(spark, I.hash_vector(F.col("t")), "t string", None)


def test_bm25_matches_the_formula(spark):
    texts = {"a": "risk risk limit", "b": "limit desk", "c": "desk desk desk book", "d": ""}
    docs = spark.createDataFrame(list(texts.items()), "k string, t string")
    found = {r.key: r.score for r in R.sparse_search(docs, "k", "t", spark.createDataFrame([(1, "Risk limit")], "id int, q string"), "id", "q", 10).collect()}
    bags = {k: v.split() for k, v in texts.items()}
    mean = sum(map(len, bags.values())) / 4
    raw = {w: math.log(4 - n + 0.5) - math.log(n + 0.5) for w in {w for b in bags.values() for w in b} for n in [sum(w in b for b in bags.values())]}
    idf = {w: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, v in raw.items()}
    for k, bag in bags.items():
        want = sum(idf[w] * bag.count(w) * 2.5 / (bag.count(w) + 1.5 * (0.25 + 0.75 * len(bag) / mean)) for w in ("risk", "limit"))
        assert abs(found.get(k, 0.0) - max(0, want)) < 1e-5


def test_nearest_in_blocks_and_in_cells(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) + (i % 7) for _ in range(8)]) for i in range(700)]
    df = spark.createDataFrame(rows, "id bigint, v array<float>")
    asked = df.where("id % 50 = 0")
    exact = {(r.qid, r.key) for r in R.nearest(df, "id", "v", asked, "id", "v", 10, block=100).collect()}

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    want = {(q, k) for q, v in rows if q % 50 == 0 for k in [k for _, k in sorted((-round(cosine(v, w), 6), k) for k, w in rows)[:10]]}
    assert len(exact & want) >= 0.98 * len(want)
    cells = R.fit_cells(df, "v", 10)
    near = {(r.qid, r.key) for r in R.nearest_in_cells(df, "id", "v", asked, "id", "v", 10, cells, block=20).collect()}
    assert len(near & exact) >= 0.9 * len(exact)


def test_cells_reach_their_recall_on_the_given_vectors(spark):
    folder = pathlib.Path("/root/testdata/sf0.01")
    if not folder.exists():
        pytest.skip("no test tables here")
    found = [{(r.qid, r.key) for r in queries.queries()[name](spark, str(folder)).collect()} for name in ("ret1_dense_exact", "ret1_dense_cells")]
    assert len(found[0] & found[1]) >= 0.9 * len(found[0])


def test_nearest_with_text_keys_and_ties(spark):
    rows = [(k, [1.0, 0.0]) for k in "edcba"] + [("z", [0.0, 1.0]), ("n", None), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, v array<float>")
    got = [(r.key, r.rank) for r in R.nearest(df, "id", "v", df.where("id = 'z'"), "id", "v", 3, block=2).collect()]
    assert sorted(got, key=lambda x: x[1]) == [("z", 1), ("a", 2), ("b", 3)]


def test_hash_vectors_equal_the_expression(spark):
    df = spark.createDataFrame([("a", "Delta, 风险! delta"), ("b", ""), ("c", None)], "k string, t string")
    want = {r.k: r.v for r in df.select("k", I.hash_vector(F.col("t")).alias("v")).collect()}
    got = {r.key: r.vector for r in I.hash_vectors(df, "k", "t").collect()}
    assert all(max(abs(x - y) for x, y in zip(got[k], want[k])) < 1e-12 for k in want)


def test_diverse_respects_quotas_then_fills_up(spark):
    rows = [(1, i, f"k{i}", "s1" if i < 5 else f"s{i}", "sec" if i in (1, 2) else "") for i in range(1, 9)]
    df = spark.createDataFrame(rows, "q int, rank int, key string, source string, section string")
    got = [r.key for r in R.diverse(df, "q", 6).orderBy("place").collect()]
    assert got == ["k1", "k3", "k5", "k6", "k7", "k8"]
    assert [r.key for r in R.diverse(df, "q", 8).orderBy("place").collect()][6:] == ["k2", "k4"]


def test_evidence_budget_keeps_the_strictly_better(spark):
    def simulate(scores, capacity):
        kept = []
        for i, s in enumerate(scores):
            if len(kept) < capacity:
                kept.append((s, i))
            elif s > min(kept, key=lambda x: (x[0], -x[1]))[0]:
                kept.remove(min(kept, key=lambda x: (x[0], -x[1])))
                kept.append((s, i))
        return {i for _, i in kept}

    rng = random.Random(2)
    lists = {r: [rng.choice([0.1, 0.5, 0.8, rng.random()]) for _ in range(rng.randint(1, 12))] for r in range(20)}
    df = spark.createDataFrame([(r, i, s) for r, ss in lists.items() for i, s in enumerate(ss)], "r int, i int, s double")
    got = {(x.r, x.i) for x in R.evidence_budget(df, ["r"], "s", ["i"], 3).collect()}
    assert got == {(r, i) for r, ss in lists.items() for i in simulate(ss, 3)}


def test_config_expansion_never_shrinks():
    wide = DEFAULT.expanded()
    assert wide.final_k == 8 and wide.dense_k == 30 and wide.summary_k == 20 and DEFAULT.final_k == 4


JUDGEMENTS = [
    # (chunk, source, section, parent, content, expanded) against (chunk, source, section, parent, text)
    ("chunk wins over text", ("c1", "s", "p", "", "alpha", ""), ("c1", "s", "p", "", "omega"), "chunk"),
    ("a place without a chunk asks for no text", ("c1", "s", "p", "", "alpha", ""), (None, "s", "p", "", "omega"), "place"),
    ("no way back to text from a place", ("c1", "s", "other", "", "alpha", ""), (None, "s", "p", "", "alpha"), None),
    ("drifted chunk in its place", ("c1", "s", "p", "", "alpha beta", ""), ("c2", "s", "p", "", "alpha"), "place"),
    ("drifted chunk elsewhere", ("c1", "s", "p", "", "alpha", ""), ("c2", "s", "other", "", "alpha"), None),
    ("drifted chunk, other text", ("c1", "s", "p", "", "alpha", ""), ("c2", "s", "p", "", "omega"), None),
    ("text only", ("c1", "s", "p", "", "alpha beta", ""), (None, "", "", "", "beta"), "text"),
    ("expanded text", ("c1", "s", "p", "", "gamma", "alpha beta"), (None, "", None, None, "beta"), "text"),
    ("parent named", ("c1", "s", "p", "q1", "alpha", ""), (None, "", "", "q1", ""), "place"),
    ("other parent", ("c1", "s", "p", "q2", "alpha", ""), (None, "s", "p", "q1", "alpha"), None),
    ("lost chunk without a place", ("c1", "s", "p", "", "alpha", ""), ("c2", "", "", "", "alpha"), None),
    ("nothing named", ("c1", "s", "p", "", "alpha", ""), (None, None, None, None, None), None),
]


def test_judgement_tiers(spark):
    place = "chunk_id string, source string, section string, parent_id string"
    got = spark.createDataFrame([(r, 1, *g) for r, g, _, _ in JUDGEMENTS], f"request_id string, position int, {place}, content string, expanded string")
    want = spark.createDataFrame([(r, f"{r}q", *q, 1) for r, _, q, _ in JUDGEMENTS], f"request_id string, qrel_id string, {place}, text string, relevance int")
    tiers = {m.request_id: m.tier for m in E.match_judgements(got, want, "request_id").collect()}
    assert tiers == {r: t for r, _, _, t in JUDGEMENTS if t}


def test_exposure_request(spark):
    asked = lambda q: tuple(one(spark, F.struct(*P.exposure_request(F.col("t"), F.lit("2024-01-31")).values()), "t string", q))
    assert asked("Show exposure for desk Rates with limit 5,000 as of 2024-02-03") == ("RATES", 5000.0, "2024-02-03")
    assert asked("DESK fx/spot: abs delta limit=12.5") == ("FX/SPOT", 12.5, "2024-01-31")
    assert asked("What is the limit of 5 million?") == asked("desk Rates?") == asked(None) == (None, None, None)


def test_exposure_tool(spark):
    df = spark.createDataFrame([(1, "Show desk Rates with limit 5,000 as of 2024-02-03"), (2, "What is delta?"), (3, None)], "id int, q string")
    got = X.exposure_tool(df, "q").collect()
    assert [r.id for r in got] == [1] and got[0].chunk_id == "tool:monitor_desk_exposure:RATES:2024-02-03" and got[0].breach and "Limit breach is yes." in got[0].document
    failing = lambda rows: rows.withColumns({"total_delta": F.lit(None).cast("double"), "breach": F.lit(None).cast("boolean")})
    lost = X.exposure_tool(df, "q", tool=failing).first()
    assert lost.failure == "tool_error" and lost.document is None


def test_parents_of_every_kind(spark):
    rows = [
        ("a", "x/a.md", "md", 0, "# One\ntext\n\n## Two\n \n"), ("b", "x/b.md", None, 0, "no heading\n"), ("c", "x/c.pdf", "pdf", 7, " page "), ("d", "x/d.docx", "docx", None, None),
    ]
    df = spark.createDataFrame(rows, "doc string, source string, file_type string, page int, content string")
    got = {(r.doc, r.parent_type, r.section_path, r.start_line, r.end_line, r.page, r.text) for r in I.parents(df, "doc", "content", "source", "file_type", "page").collect()}
    assert got == {
        ("a", "md_section", "One", 1, 3, 0, "# One\ntext"), ("a", "md_section", "One / Two", 4, 6, 0, "## Two"),
        ("b", "md_file", "", 1, 2, 0, "no heading\n"), ("c", "pdf_page", "", 0, 0, 7, " page "), ("d", "doc", "", 0, 0, 0, ""),
    }


def test_metric_diff_and_thresholds(spark):
    schema = "metric string, value double"
    now = spark.createDataFrame([("retrieval_recall_at_5", 0.8), ("error_rate", 0.2), ("hallucination_rate_in_citations", 0.4), ("cache_hit_rate", 0.9)], schema)
    before = spark.createDataFrame([("retrieval_recall_at_5", 0.9), ("error_rate", 0.1), ("hallucination_rate_in_citations", 0.4), ("cache_hit_rate", 0.5)], schema)
    rows = {r.metric: (r.regression, r.failure) for r in E.compare_metrics(now, before, 0.01, 0.0, 0.35).collect()}
    assert rows == {"retrieval_recall_at_5": (True, False), "error_rate": (True, False), "hallucination_rate_in_citations": (False, True), "cache_hit_rate": (False, False)}
    rules = spark.createDataFrame([("error_rate", "lower_is_better", 0.5, 0.15, 0.0), ("gone", None, 0.0, 1.0, 0.0)], "metric string, direction string, minimum double, maximum double, tolerance double")
    assert {tuple(r) for r in E.threshold_gate(now, rules).collect()} == {("error_rate", "above_maximum"), ("gone", "missing_metric")}


def test_sentence_support(spark):
    ok = lambda s, c: one(spark, E.supported(F.col("s"), F.col("c")), "s string, c array<string>", s, c)
    assert ok("...", []) and ok("delta limits hold", ["the delta limits of the desk"]) and not ok("delta limits hold", [None, "nothing here"])


def test_sliding_sum_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), rng.randint(0, 20000), rng.randint(1, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k string, s bigint, v bigint").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: r.total for r in W.sliding_sum(df, "k", "ts", "v", 3600, "total").collect()}
    assert got == {i: sum(v for _, k2, s2, v in rows if k2 == k and s - 3600 <= s2 <= s) for i, k, s, _ in rows}


def test_token_bucket_batch_equals_stream(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, 1_700_000_000 + rng.randint(0, 3000), rng.randint(1, 3), "view", float(rng.choice([0, 5, 20, 50, 500])), "{}") for i in range(200)]
    df = spark.createDataFrame(rows, "event_id bigint, s bigint, user_id bigint, event_type string, value double, props string")
    df = df.withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    (tmp_path / "in").joinpath("x").mkdir()
    batch = {r.event_id: r.allowed for r in W.token_bucket(df.withColumn("n", F.floor("value")), "user_id", "ts", "event_id", "n", 100, 10).collect()}
    stream = usage.token_bucket(usage.read_events(spark, str(tmp_path / "in"), "part*.parquet"), 100, 10)
    assert {r.event_id: r.allowed for r in usage.run_to_table(stream, "append", "t").collect()} == batch
    assert not all(batch.values()) and all(not batch[r[0]] for r in rows if r[4] == 500)


def test_documents_are_scanned(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# A\nDelta is a number that every desk has to know about its book.")
    (tmp_path / "README.md").write_text("no")
    (tmp_path / "sub" / "b.html").write_text("<html><head><title> T </title></head><body><nav>menu</nav><h2>Two</h2><h1>One</h1><main><p>Body &amp; soul</p></main></body></html>")
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f'<w:document {ns}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Para</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "skip.bin").write_bytes(b"x")
    rows = {r.source.rsplit("/", 1)[-1]: r for r in files.scan_documents(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.md", "b.html", "c.docx", "bad.docx"}
    assert rows["b.html"].title == "T" and rows["b.html"].text == "# One\n## Two\n\nBody & soul"
    assert "## Head" in rows["c.docx"].text and "| x |" in rows["c.docx"].text
    assert rows["bad.docx"].error and rows["bad.docx"].text is None


def test_sheet_text_leaves_zeros_out():
    import pandas as pd

    text = files.sheet_text("S", pd.DataFrame({"a": [0, 2], "b": ["x", None]}))
    assert "b: x" in text and "a: 2" in text and "a: 0" not in text and "| 0 | x |" in text


def test_corpus_lines_round_trip_and_fail_fast(spark, tmp_path):
    df = spark.createDataFrame([("text\nline", {"source": "a"}), ("b", None)], "page_content string, metadata map<string,string>")
    files.write_corpus(df, str(tmp_path / "c"))
    assert {(r.page_content, str(r.metadata)) for r in files.read_corpus(spark, str(tmp_path / "c")).collect()} == {("text\nline", "{'source': 'a'}"), ("b", "{}")}
    (tmp_path / "bad.json").write_text('{"page_content": "a"}\n{oops\n')
    with pytest.raises(Exception):
        files.read_corpus(spark, str(tmp_path / "bad.json")).collect()


def test_manifest_and_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "source string, n int")
    new = spark.createDataFrame([("b", 2), ("d", 2)], "source string, n int")
    assert {tuple(r) for r in M.upsert(old, new, "source", spark.createDataFrame([("c",)], "source string")).collect()} == {("a", 1), ("b", 2), ("d", 2)}
    config = {"embeddings": {"dim": 64}, "query_time": 1}
    made = {"fingerprint": M.fingerprint(config), "sources": {"a": {}}}
    assert M.index_ready(made, config | {"query_time": 2}) == (True, "ok")
    assert M.index_ready(made, {"embeddings": {"dim": 32}}) == (False, "schema_mismatch")
    assert M.index_ready(None, config) == (False, "missing_index")
    assert files.read_manifest("{broken")["sources"] == {} and files.read_manifest('{"version": 5}')["version"] == 5


def test_files_are_indexed_once(spark, tmp_path):
    folder, table = tmp_path / "in", f"file://{tmp_path}/table"
    folder.mkdir()
    (folder / "a.md").write_text("one")
    read = lambda: spark.read.format("binaryFile").load(str(folder))
    assert indexing.index_batch(read(), table) == {"indexed": 1, "skipped": 0}
    assert indexing.index_batch(read(), table) == {"indexed": 0, "skipped": 1}
    (folder / "a.md").write_text("two")
    (folder / "b.md").write_text("three")
    assert indexing.index_batch(read(), table) == {"indexed": 2, "skipped": 0}
    assert {r.text for r in indexing.read_index(spark, table).collect()} == {"two", "three"}


def test_thresholds_and_reports():
    assert files.read_thresholds('{"metrics": {}}') == {"metrics": {}}
    with pytest.raises(ValueError):
        files.read_thresholds("[1]")
    assert files.report_name(" Base Line! ", "20240101T000000Z") == "rag_eval_base-line_20240101T000000Z.json"
    assert "| recall | 0.5000 |" in files.report_markdown("R", {"recall": 0.5})


def test_cache_hits_across_spans(spark):
    from collections import OrderedDict

    rng = random.Random(8)
    rows = [(2**60 + i, rng.choice(["hot"] * 4 + ["a", "b"]), rng.choice("abcdefghij"), rng.randint(0, 4000)) for i in range(600)] + [(1, None, "a", 5), (2, "a", None, 5)]
    want, caches = {}, {}
    for i, who, k, at in sorted((r for r in rows if r[1] and r[2]), key=lambda r: (r[3], r[0])):
        cache = caches.setdefault(who, OrderedDict())
        want[i] = k in cache
        cache[k] = None
        cache.move_to_end(k)
        if len(cache) > 4:
            cache.popitem(last=False)
    df = spark.createDataFrame(rows, "id bigint, who string, k string, s int").withColumn("ts", F.timestamp_seconds("s"))
    for seconds in (10, 300, 10_000):
        got = {r.id: r.hit for r in W.lru_hits(df, "who", "k", "ts", "id", 4, seconds).collect()}
        assert got == want
    assert W.lru_hits(df.limit(0), "who", "k", "ts", "id", 4).count() == 0


def test_buckets_by_priority_class(spark):
    rows = [(1, "u", 0, 50.0, None), (2, "u", 1, 50.0, "query"), (3, "u", 2, 50.0, "noncritical"), (4, "u", 3, 11.0, "default"), (5, "u", 4, 1e9, "vip"), (6, "u", 5, 0.0, "default")]
    df = spark.createDataFrame(rows, "id int, k string, s int, need double, p string").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: r.allowed for r in W.token_bucket(df, "k", "ts", "id", "need", 60, 0.06, "p", {"non_critical": (60, 0.06)}).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True, 6: True}


def test_engine_end_to_end(spark):
    docs = [(f"corpus/{n}.md", "md", f"# {n.title()}\n\n" + f"The {n} of a book tells how its value moves when the market moves. " * 4) for n in ("delta", "gamma", "vega")]
    docs += [(f"corpus/other{i}.md", "md", f"Settlement of trade number {i} follows two days later, unless holidays of either country come between them and delay it.") for i in range(9)]
    frame = spark.createDataFrame(docs, "source string, file_type string, text string")
    parents, chunks = build_chunks(frame)
    engine = Engine(spark, chunks, parents)
    questions = spark.createDataFrame([(1, "What does gamma tell about a book?"), (2, "hi")], "id int, question string")
    found = engine.ask(questions).orderBy("place").collect()
    assert {r.id for r in found} == {1} and found[0].key.startswith("gamma.md:")
    later = engine.update(frame.where("source <> 'corpus/vega.md'"))
    assert {r.source for r in later.status().collect()} == {"corpus/delta.md", "corpus/gamma.md", *(f"corpus/other{i}.md" for i in range(9))}


def test_scratch_is_dropped(spark):
    from corvane.session import drop_scratch, materialize

    stored = materialize(spark.range(10), "t")
    assert stored.count() == 10 and drop_scratch(spark) >= 1 and drop_scratch(spark) == 0


def test_datasets_traces_and_reports_are_read(spark, tmp_path):
    (tmp_path / "items.json").write_text(json.dumps([{"id": "q1", "question": "a", "reference_answer": "b", "ground_truth_contexts": ["c"], "tags": ["t"]}, {"id": "q2", "question": "d"}]))
    (tmp_path / "qrels.json").write_text(json.dumps([{"id": "q1", "qrels": [{"qrel_id": "x", "text": "t"}, {"qrel_id": "y", "chunk_id": "c1"}]}]))
    (tmp_path / "labels.json").write_text(json.dumps([{"id": "q2", "should_block": True}]))
    items = files.read_dataset(spark, *(str(tmp_path / f"{n}.json") for n in ("items", "qrels", "labels")))
    rows = {r.id: r for r in items.collect()}
    assert len(rows["q1"].qrels) == 2 and rows["q1"].should_block is None and rows["q2"].should_block is True
    none = spark.createDataFrame([], "id string, reason string")
    assert [tuple(r) for r in files.text_only_judgements(items, none).collect()] == [("q1", "x")]
    assert files.text_only_judgements(items, spark.createDataFrame([("q1", "known")], "id string, reason string")).count() == 0
    (tmp_path / "traces").mkdir()
    node = {"name": "n", "latency_ms": 5.0, "token_usage": {"prompt_tokens": 1, "completion_tokens": 2}}
    (tmp_path / "traces" / "a.json").write_text(json.dumps({"request_id": "r", "nodes": [node]}))
    (tmp_path / "traces" / "b.json").write_text("{broken")
    assert [r.request_id for r in files.read_traces(spark, str(tmp_path / "traces")).collect()] == ["r"]
    assert files.latest_file(spark, str(tmp_path), "items*.json").endswith("items.json")


def test_bundles_and_vectors_are_written(spark, tmp_path):
    files.write_bundles(spark.createDataFrame([("r1", "a"), ("r2", "b")], "request_id string, report string"), str(tmp_path / "b"))
    assert spark.read.json(str(tmp_path / "b")).where("request_id = 'r2'").first().report == "b"
    rows = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i)]) for i in range(40)], "id bigint, v array<double>")
    files.write_vectors(R.with_cells(rows, "v", R.fit_cells(rows, "v", 4).centers), str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    assert stored.count() == 40 and stored.select("cell").distinct().count() > 1


def test_exact_quantiles(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), rng.choice([1.0, 2.5, rng.random()])) for _ in range(101)] + [("c", 7.0), ("d", None)]
    got = {r.g: r for r in E.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"m": 0.5, "p": 0.95}).collect()}
    assert set(got) == {"a", "b", "c"}
    for g, r in got.items():
        xs = sorted(v for k, v in rows if k == g)
        for q, x in ((0.5, r.m), (0.95, r.p)):
            at = (len(xs) - 1) * q
            want = xs[math.floor(at)] + (xs[math.ceil(at)] - xs[math.floor(at)]) * (at - math.floor(at))
            assert abs(x - want) < 1e-6
        assert (r.n, r.low, r.high) == (len(xs), xs[0], xs[-1])
