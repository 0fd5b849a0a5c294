"""The engine with its models, an evaluation from answers to exit code, and what is stored on the way."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import ingest as I
from corvane.operators import models as M
from corvane.plans import evaluate as V
from corvane.plans.engine import Engine, build_chunks
from corvane.sources import store
from corvane.sources.manifest import fingerprint


@pytest.fixture(scope="module")
def engine(spark):
    docs = [(f"corpus/{n}.md", "md", f"# {n.title()}\n\n" + f"The {n} of a book tells how its value moves when the market moves. " * 4) for n in ("delta", "gamma", "vega")]
    docs += [(f"corpus/other{i}.md", "md", f"Settlement of trade number {i} follows two days later, unless holidays of either country come between them and delay it.") for i in range(9)]
    parents, chunks = build_chunks(spark.createDataFrame(docs, "source string, file_type string, text string"))
    return Engine(spark, chunks, parents)


def test_a_second_round_for_what_was_irrelevant(spark, engine):
    questions = spark.createDataFrame([(1, "What does gamma tell about a book?"), (2, "Where do penguins sleep in winter and why?")], "id int, question string")
    found = engine.ask(questions).select("id", "round", "tier").distinct().collect()
    assert {(r.id, r.round) for r in found} == {(1, 1), (2, 2)}
    assert engine.ask(questions.limit(0)).count() == 0


def test_evaluation_from_answers_to_exit_code(spark, engine, tmp_path):
    items = spark.createDataFrame(
        [("a", "What does gamma tell about a book?", "how its value moves", ["greeks"]), ("b", "What does vega tell about a book?", None, None)],
        "id string, question string, reference_answer string, tags array<string>",
    )
    judged = spark.createDataFrame([("a", "q1", None, "corpus/gamma.md", "", "", 2)], "id string, qrel_id string, chunk_id string, source string, section string, text string, relevance int")
    rules = {"metrics": {"retrieval_mrr": {"min": 0.1, "direction": "higher_is_better"}, "faithfulness": {"min": 1.5}}}
    code, path, report = V.run_evaluation(engine, items, judged, f"file://{tmp_path}", "2024-01-02T03:04:05Z", "Nightly run", rules)
    assert code == 2 and report["failures"] == {"faithfulness": "below_minimum"}
    assert report["metrics"]["retrieval_mrr"] == 0.5 and report["slices"]["greeks"]["retrieval_mrr"] == 1.0
    assert report["metrics"]["reliability_success_rate"] == 1.0 and report["metrics"]["citations_coverage"] == 1.0
    assert path.endswith("rag_eval_nightly-run_20240102T030405Z.json") and store.latest_report(spark, f"file://{tmp_path}")["samples"] == 2
    with pytest.raises(ValueError):
        V.evaluate(items, profile="none")


def test_calls_are_governed_cached_and_tried_again():
    now = [0.0]
    said = []

    class Flaky:
        def complete(self, prompt):
            said.append(prompt)
            if len(said) == 1:
                raise RuntimeError("connection reset")
            return "no object" if len(said) < 4 else '```json\n{"a": 1}\n```'

    waits = []
    caller = M.Caller(Flaky(), M.Governor({"non_critical": 60.0}, clock=lambda: now[0]), sleep=waits.append)
    assert caller.text("x") == "no object" and waits == [0.5] and caller.text("x") == "no object" and caller.usage["cached"] == 1
    assert caller.object("y") == {"a": 1}
    assert caller.text("z" * 200, "Query") and pytest.raises(M.Refused, caller.text, "w" * 200, "noncritical")
    now[0] = 120.0
    assert caller.text("w" * 200, "non-critical")

    class Broken:
        def complete(self, prompt):
            raise ValueError("bad key")

    with pytest.raises(ValueError):
        M.Caller(Broken()).text("x")


def test_steps_fall_back_where_a_model_fails(spark):
    class Broken:
        def complete(self, prompt):
            raise ValueError("bad key")

    broken = lambda: M.Caller(Broken())
    rows = spark.createDataFrame([(1, "What is delta?", "Delta is a change.")], "id int, question string, context string")
    assert M.write_step(rows, broken).first().answer.startswith("I do not know")
    assert M.write_step(rows, lambda: M.Caller(M.Echo())).first().answer == "What is delta?"
    assert "delta" in M.rewrite_step(broken)(rows).first().question
    failures = spark.createDataFrame([("no_evidence", "r"), (None, "r")], "category string, report string")
    assert [r.upheld for r in M.appeal_step(failures, broken).collect()] == [True, False]

    class Overturn:
        def complete(self, prompt):
            return '{"overturn": true}'

    assert [r.upheld for r in M.appeal_step(failures, lambda: M.Caller(Overturn()), enabled=True).collect()] == [False, False]


def test_a_models_cuts_are_of_the_whole_text(spark):
    class Cutter:
        def complete(self, prompt):
            return '{"starts": [0, 5000, 900, 99999, -3]}'

    text = "".join(f"{i:05d} " for i in range(1200))
    df = spark.createDataFrame([("a", text), ("b", "short")], "k string, t string")
    got = sorted((r.k, r.chunk_index, r.start_index, len(r.text)) for r in M.cut_by_model(lambda: M.Caller(Cutter()))(df, "k", "t").collect())
    assert got == [("a", 0, 0, 900), ("a", 1, 900, 4100), ("a", 2, 5000, 2200), ("b", 0, 0, 5)]

    class Mute:
        def complete(self, prompt):
            return "?"

    want = {(r.chunk_index, r.start_index) for r in I.seeking_chunks(df.where("k = 'a'"), "k", "t").collect()}
    assert {(r.chunk_index, r.start_index) for r in M.cut_by_model(lambda: M.Caller(Mute()))(df, "k", "t").where("k = 'a'").collect()} == want


def test_tools_are_called_at_most_so_often_and_never_twice():
    tools = {"add": lambda a, b: str(a + b)}
    plan = lambda q, calls: {"answer": str(len(calls))} if calls and calls[-1].get("final") else {"tool": "add", "arguments": {"a": len(calls), "b": 1}}
    answer, calls = M.run_tools("?", plan, tools, most=3)
    assert answer == "4" and [c["output"] for c in calls] == ["1", "2", "3"]
    again = lambda q, calls: {"answer": "x"} if calls and calls[-1].get("final") else {"tool": "add", "arguments": {"a": 1, "b": 1}}
    assert len(M.run_tools("?", again, tools)[1]) == 1


def test_tools_of_an_engine(spark, engine):
    tools = engine.tools(most=2)
    first = json.loads(tools["semantic_search"](query="What does gamma tell about a book?"))[0]
    assert first["source"] == "corpus/gamma.md" and json.loads(tools["keyword_search"](query="gamma"))[0]["key"] == first["key"]
    assert [r["source"] for r in json.loads(tools["structured_lookup"](source="VEGA"))] == ["corpus/vega.md"]
    assert json.loads(tools["chunk_read"](chunk_id=first["key"]))[0]["chunk_id"] == first["key"]
    plan = lambda q, calls: {"answer": calls[0]["output"]} if calls else {"tool": "keyword_search", "arguments": {"query": q}}
    assert first["key"] in M.run_tools("gamma", plan, tools)[0]


def test_judged_metrics_need_a_judge(spark):
    samples = spark.createDataFrame([("a",), ("b",)], "id string")
    assert M.judged_metrics(samples, {"faithfulness": lambda s: s.select("id", F.lit(0.5).alias("value"))}) == {"ragas_faithfulness": 0.5}
    with pytest.raises(ValueError):
        M.judged_metrics(samples, {"beauty": None})


def test_tables_artifacts_traces_and_reset(spark, tmp_path):
    store.ensure_table(spark, "vectors_t")
    store.ensure_table(spark, "vectors_t")
    store.insert_rows(spark.createDataFrame([("c1", "s", [1.0, 0.0], 3)], "chunk_id string, source string, vector array<float>, cell int"), "vectors_t")
    assert spark.table("vectors_t").where("cell = 3").first().chunk_id == "c1"
    folder = f"file://{tmp_path}"
    store.save_artifact(spark, folder, "r1", "2024-01-01T00:00:00Z", {"request": {"q": 1}, "response": {"a": "é"}, "trace": None})
    path = store.save_artifact(spark, folder, "r2", "2024-01-02T00:00:00Z", {"request": {}, "response": {}})
    assert {p.path.rsplit("_", 1)[1] for p in store.list_files(spark, folder).collect()} == {"r1.json", "r2.json"}
    assert store.load_json(spark, path)["request_id"] == "r2" and store.load_json(spark, f"{folder}/none.json") is None
    assert json.loads((tmp_path / "20240101T000000Z_r1" / "response.json").read_text()) == {"a": "é"}
    (tmp_path / "bad.json").write_text("{")
    assert store.load_json(spark, f"{folder}/bad.json") is None and store.list_files(spark, f"{folder}/nowhere").count() == 0
    store.save_trace(spark, folder, {"request_id": "t1"}, "2024-01-01T00:00:00Z")
    day = 86_400_000
    modified = store.list_files(spark, f"{folder}/traces").first().modified
    assert store.clean_traces(spark, folder, modified + 6 * day) == 0 and store.clean_traces(spark, folder, modified + 8 * day) == 1
    config = {"schema_version": 4}
    store.write_manifest(spark, f"{folder}/manifest.json", config, {"s": "1"})
    manifest = store.load_json(spark, f"{folder}/manifest.json")
    assert manifest["fingerprint"] == fingerprint(config) and not store.reset_on_mismatch(spark, manifest, config, ["vectors_t"], [])
    assert store.reset_on_mismatch(spark, manifest, {"schema_version": 5}, ["vectors_t"], [f"{folder}/manifest.json"])
    assert not spark.catalog.tableExists("vectors_t") and store.load_json(spark, f"{folder}/manifest.json") is None


def test_comparison_report(spark):
    rows = spark.createDataFrame([("recall", 0.5, 0.7, -0.2, "regressed")], "metric string, current double, baseline double, delta double, verdict string")
    assert "| recall | 0.700 | 0.500 | -0.200 | regressed |" in store.comparison_markdown(rows)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    import io

    from corvane import __main__ as cli

    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "gamma.md").write_text("# Gamma\n\n" + "The gamma of a book tells how its delta moves when the market moves. " * 4)
    monkeypatch.setattr(cli, "build_session", lambda name: spark)
    assert cli.main([]) == 2 and cli.main(["ask", "x"]) == 2
    assert cli.main(["index", f"file://{folder}", str(tmp_path / "store")]) == 0 and "gamma.md" in capsys.readouterr().out
    assert cli.main(["ask", str(tmp_path / "store"), "What does gamma tell about a book?"]) == 0 and "gamma.md:" in capsys.readouterr().out
    monkeypatch.setattr("sys.stdin", io.StringIO("What does gamma tell?\n\nAnd its delta in a book?\n"))
    assert cli.main(["chat", str(tmp_path / "store")]) == 0 and capsys.readouterr().out.count("gamma.md:") == 2
    assert cli.main(["status", str(tmp_path / "store")]) == 0
