"""Running an evaluation: answered samples to metrics, gates and a report."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import evaluation as E
from corvane.operators import filters as P
from corvane.operators import models as M
from corvane.plans.engine import Engine
from corvane.session import materialize
from corvane.sources import store

QUANTILES = {"latency_p50_ms": 0.5, "latency_p95_ms": 0.95, "latency_p99_ms": 0.99}
PROFILES = {"all": ("retrieval", "gate", "reliability"), "retrieval": ("retrieval",), "gate": ("gate",), "reliability": ("reliability",)}


def samples_of(engine: Engine, items: DataFrame, make: Callable[[], M.Caller] = lambda: M.Caller(M.Echo()), most_rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """Answered samples of (id, question, reference_answer, tags) items, and their retrieved rows, all in batch plans."""
    found = materialize(engine.ask(items.select("id", "question"), most_rounds), "eval-found")
    texts = found.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("expanded", "text").alias("t")))), lambda x: x["t"]).alias("contexts"),
                                    F.collect_set(F.struct("source", F.col("key").alias("chunk_id"))).alias("citations"))
    rows = items.join(texts, "id", "left").withColumn("context", F.array_join(F.coalesce("contexts", F.array().cast("array<string>")), "\n"))
    said = M.write_step(rows, make)
    samples = said.withColumn("status", F.when(F.col("contexts").isNull(), "failed").otherwise("ok"))
    retrieved = found.select(
        "id", F.col("place").alias("position"), F.col("key").alias("chunk_id"), "source", "section", "parent_id", T.squeeze(F.col("text")).alias("content"), T.squeeze(F.col("expanded")).alias("expanded"),
        F.lit(None).cast("int").alias("dense_rank"), F.lit(None).cast("int").alias("sparse_rank"), F.col("score").alias("rrf_score"), F.col("adv").alias("rerank_score"),
    )
    return materialize(samples, "eval-samples"), materialize(retrieved, "eval-retrieved")


def evaluate(samples: DataFrame, retrieved: DataFrame | None = None, judged: DataFrame | None = None, profile: str = "all", ks: tuple[int, ...] = (1, 3, 5), prices: tuple[float, float] = (0.0, 0.0), judges: dict | None = None) -> dict[str, Any]:
    """The metrics of a run as a report.

    ``samples`` has (id, question, answer, reference_answer, contexts, citations, status) and may have tags, latency_ms,
    should_block, failure and cache_hit; ``retrieved`` and ``judged`` are rows as of ``match_judgements``.  The profile
    says which of retrieval, gate and reliability metrics are made; samples without judgements count as zeros.
    """
    if profile not in PROFILES:
        raise ValueError(f"the profile must be one of {sorted(PROFILES)}")
    rows = samples
    for name, kind in (("tags", "array<string>"), ("latency_ms", "double"), ("should_block", "boolean"), ("failure", "string"), ("cache_hit", "boolean")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    rows = materialize(rows, "eval-rows")
    n = max(1, rows.count())
    none = F.array().cast("array<string>")
    cited = F.exists(F.coalesce("citations", F.array().cast("array<struct<source:string,chunk_id:string>>")), lambda c: P.valid_citation(c["source"], c["chunk_id"]))
    contexts = F.coalesce("contexts", none)
    said = rows.select("id", "contexts", F.explode(T.sentences(F.col("answer"))).alias("sentence")).select("id", E.supported(F.col("sentence"), F.coalesce("contexts", none)).alias("ok"))
    support = said.groupBy("id").agg(F.avg(F.col("ok").cast("int")).alias("precision"), (F.count_if(~F.col("ok")) > 0).alias("hallucinated"))
    scored = rows.join(support, "id", "left").select(
        cited.cast("int").alias("covered"), F.coalesce("precision", F.lit(0.0)).alias("precision"), F.coalesce("hallucinated", F.lit(False)).cast("int").alias("hallucinated"),
        E.relevancy(F.col("question"), F.col("answer"), F.col("reference_answer")).alias("relevancy"),
        E.numeric_score(T.numbers_domain(F.col("answer")), T.numbers_domain(F.array_join(contexts, " ")), 0.01).alias("numeric"), E.glossary_score(F.col("answer")).alias("glossary"),
    )
    mean = scored.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in scored.columns), F.sum("covered").alias("passed")).first()
    metrics: dict[str, float] = {
        "citations_total": float(n), "citations_passed": float(mean["passed"] or 0), "citations_coverage": mean["covered"], "citation_coverage": mean["covered"], "faithfulness": mean["precision"],
        "sentence_support_rate": mean["precision"], "hallucination_rate_in_citations": mean["hallucinated"], "answer_relevancy": mean["relevancy"], "numeric_consistency_score": mean["numeric"],
        "glossary_consistency_score": mean["glossary"], "domain_consistency_score": (mean["numeric"] + mean["glossary"]) / 2,
    }
    report: dict[str, Any] = {"profile": profile, "samples": n, "retrieval_ks": list(ks), "metrics": metrics}
    parts = PROFILES[profile]
    if "retrieval" in parts and retrieved is not None and judged is not None:
        matches = materialize(E.match_judgements(retrieved, judged, "id"), "eval-matches")
        per = rows.select("id", "tags").join(E.retrieval_metrics(retrieved, judged, matches, "id", ks), "id", "left").fillna(0.0)
        names = [c for c in per.columns if c not in ("id", "tags")]
        marks = F.concat(F.array(F.lit("")), F.array_distinct(F.array_compact(F.coalesce("tags", none))))
        sliced = per.withColumn("tag", F.explode(marks)).groupBy("tag").agg(*(F.avg(c).alias(c) for c in names)).collect()
        full = lambda name: "retrieval_" + name.replace("recall_", "recall_at_").replace("ndcg_", "ndcg_at_")
        slices = {r.tag: {full(c): r[c] for c in names} for r in sliced}
        metrics.update(slices.pop("", {}))
        report["slices"] = slices
    if "gate" in parts:
        blocked, labelled = F.col("status") != "ok", F.col("should_block").isNotNull()
        bottom = F.greatest(F.count_if(labelled), F.lit(1))
        gate = rows.agg(
            (F.count_if(blocked) / n).alias("gate_block_rate"), (F.count_if(labelled & blocked & F.col("should_block")) / bottom).alias("gate_block_benefit_rate"),
            (F.count_if(labelled & blocked & ~F.col("should_block")) / bottom).alias("gate_false_kill_rate"), (F.count_if(labelled & ~blocked & F.col("should_block")) / bottom).alias("gate_miss_rate"),
        ).first()
        metrics.update({k: float(v) for k, v in gate.asDict().items()})
    if "reliability" in parts:
        chars = F.length(T.text(F.col("question"))) + F.length(F.array_join(contexts, "\n"))
        flat = rows.select((F.col("status") == "ok").alias("ok"), F.coalesce(F.lower("failure").rlike("timeout|timed out"), F.lit(False)).alias("timeout"), F.coalesce("cache_hit", F.lit(False)).alias("cached"),
                           F.col("latency_ms").alias("latency"), chars.alias("prompt_chars"), F.length(T.text(F.col("answer"))).alias("answer_chars"))
        r = E.reliability(flat, QUANTILES, prices).first().asDict()
        named = {"success_rate": "reliability_success_rate", "error_rate": "reliability_error_rate", "timeout_rate": "reliability_timeout_rate", "usd": "cost_estimated_usd", "prompt_tokens": "cost_estimated_prompt_tokens", "completion_tokens": "cost_estimated_completion_tokens"}
        metrics.update({named.get(k, k): float(v or 0.0) for k, v in r.items()})
    if judges:
        metrics.update(M.judged_metrics(rows, judges))
    return report


def gate_report(spark: SparkSession, report: dict[str, Any], rules: dict[str, Any], baseline: dict[str, Any] | None = None, tolerance: float = 0.01) -> tuple[int, DataFrame]:
    """Exit code, 2 if a rule is broken or a metric got worse than a baseline's, and the (metric, reason) rows."""
    flat = lambda m: spark.createDataFrame([(k, float(v)) for k, v in m.items()], "metric string, value double")
    table = spark.createDataFrame(
        [(k, r.get("direction"), r.get("min"), r.get("max"), r.get("tolerance", 0.0)) for k, r in rules.get("metrics", {}).items()], "metric string, direction string, minimum double, maximum double, tolerance double"
    )
    broken = E.threshold_gate(flat(report["metrics"]), table)
    if baseline:
        worse = E.compare_metrics(flat(report["metrics"]), flat(baseline["metrics"]), tolerance, float("-inf")).where("regression").select("metric", F.lit("regression").alias("reason"))
        broken = broken.unionByName(worse)
    broken = materialize(broken, "eval-broken")
    return (2 if broken.count() else 0), broken


def run_evaluation(engine: Engine, items: DataFrame, judged: DataFrame | None, folder: str, stamp: str, label: str | None = None, rules: dict[str, Any] | None = None, **options: Any) -> tuple[int, str, dict[str, Any]]:
    """Answer, measure, store the report and hold it against the rules: exit code, path and report."""
    samples, retrieved = samples_of(engine, items)
    report = evaluate(samples, retrieved, judged, **options) | {"generated_at": stamp}
    code, broken = gate_report(engine.spark, report, rules or {})
    report["failures"] = {r.metric: r.reason for r in broken.collect()}
    return code, store.write_report(engine.spark, report, folder, stamp, label), report
