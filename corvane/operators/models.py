"""Where models come in: a client with governance, cache and retries, and the steps that may use one.

No model is needed: each step has a rule that stands in, and a failing call falls back on it.  Columns of a table are
answered in batches on the executors; the client is made once a task by ``make``.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import ingest as I
from corvane.operators import retrieval as R
from corvane.operators.windows import PRIORITY_ALIASES, bucket_step

# Words of errors that may pass.
TRANSIENT = ("timeout", "timed out", "connection", "rate limit", "429", "500", "502", "503", "504")


class ModelClient(Protocol):
    def complete(self, prompt: str) -> str: ...


@dataclass
class Echo:
    """The client that stands in: the prompt's last line."""

    def complete(self, prompt: str) -> str:
        return prompt.strip().rsplit("\n", 1)[-1]


@dataclass
class Governor:
    """A budget of tokens a minute for each priority class; a class without one is free."""

    per_minute: dict[str, float]
    burst: dict[str, float] = field(default_factory=dict)
    clock: Callable[[], float] = time.monotonic
    _state: dict[str, tuple[float, float]] = field(default_factory=dict)

    def allow(self, priority: str, tokens: int) -> tuple[bool, float]:
        """Whether a call may go, and else after how many seconds."""
        name = (priority or "default").strip().lower()
        name = PRIORITY_ALIASES.get(name, name)
        rate = self.per_minute.get(name, 0.0)
        if rate <= 0:
            return True, 0.0
        capacity, now = self.burst.get(name) or rate, self.clock()
        level, last = self._state.get(name, (capacity, now))
        ok, level, wait = bucket_step(level, last, now, float(max(0, tokens)), capacity, rate / 60)
        self._state[name] = level, now
        return ok, wait


class Refused(RuntimeError):
    """A call over budget."""


@dataclass
class Caller:
    """Calls of a client: budget, then cache, then up to ``tries`` calls with a growing pause after errors that may pass."""

    client: ModelClient
    governor: Governor | None = None
    capacity: int = 1_000
    tries: int = 3
    pause: float = 0.5
    sleep: Callable[[float], None] = time.sleep
    usage: dict[str, int] = field(default_factory=lambda: {"calls": 0, "cached": 0, "prompt_tokens": 0, "completion_tokens": 0})
    _cache: OrderedDict[str, str] = field(default_factory=OrderedDict)

    def text(self, prompt: str, priority: str = "default") -> str:
        if self.governor is not None:
            ok, wait = self.governor.allow(priority, len(prompt) // 4)
            if not ok:
                raise Refused(f"over budget, try again in {wait:.1f} s")
        key = hashlib.sha256(prompt.encode("utf-8", "surrogatepass")).hexdigest()
        if key in self._cache:
            self._cache.move_to_end(key)
            self.usage["cached"] += 1
            return self._cache[key]
        for attempt in range(1, self.tries + 1):
            try:
                answer = self.client.complete(prompt)
                break
            except Exception as problem:  # a client may raise anything
                if attempt == self.tries or not any(w in str(problem).lower() for w in TRANSIENT):
                    raise
                self.sleep(self.pause * attempt)
        self.usage["calls"] += 1
        self.usage["prompt_tokens"] += len(prompt) // 4
        self.usage["completion_tokens"] += len(answer) // 4
        self._cache[key] = answer
        if len(self._cache) > self.capacity:
            self._cache.popitem(last=False)
        return answer

    def object(self, prompt: str, priority: str = "default") -> dict[str, Any] | None:
        """The JSON object in the answer; asked once more for a repaired one, else nothing."""
        for again in ("", "\nAnswer with one JSON object and nothing else."):
            found = parse_object(self.text(prompt + again, priority))
            if found is not None:
                return found
        return None


def parse_object(answer: str) -> dict[str, Any] | None:
    """A JSON object: the whole text, a fenced block, or from the first brace to the last."""
    fence = answer.split("```")
    for part in (answer, fence[1].removeprefix("json") if len(fence) > 2 else "", answer[answer.find("{") : answer.rfind("}") + 1]):
        try:
            found = json.loads(part.strip() or "null")
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


def answered(df: DataFrame, prompt: Column, name: str, make: Callable[[], Caller], fallback: Column | None = None) -> DataFrame:
    """``df`` with the model's answer to each row's prompt; the fallback, or null, where a call fails."""

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        caller = make()

        def one(p: str | None) -> str | None:
            try:
                return caller.text(p) if p else None
            except Exception:  # the fallback answers
                return None

        for batch in batches:
            yield batch.map(one)

    said = ask(prompt)
    return df.withColumn(name, said if fallback is None else F.coalesce(said, fallback))


# ---- steps ----------------------------------------------------------------------------------
def rewrite_step(make: Callable[[], Caller]) -> Callable[[DataFrame], DataFrame]:
    """Questions in other words, as (id, question); the key words where a call fails."""

    def run(questions: DataFrame) -> DataFrame:
        prompt = F.concat(F.lit("Rewrite the question so that a search finds more, in one line.\n"), F.col("question"))
        keywords = F.element_at(R.query_variants(F.concat(F.lit("definition "), F.col("question")), 2), -1)
        return answered(questions, prompt, "said", make, keywords).select("id", F.col("said").alias("question"))

    return run


def write_step(rows: DataFrame, make: Callable[[], Caller], context: str = "context", question: str = "question") -> DataFrame:
    """An answer to each (question, context); a refusal that says what to do next without context or where a call fails."""
    refusal = F.concat(F.lit("I do not know: the corpus holds no evidence on \""), T.text(F.col(question)), F.lit("\". Please add documents on it or ask more precisely."))
    prompt = F.when(T.strip(T.text(F.col(context))) != "", F.concat(F.lit("Answer from the context only and cite it.\n"), F.col(context), F.lit("\n"), F.col(question)))
    return answered(rows, prompt, "answer", make, refusal)


def appeal_step(failures: DataFrame, make: Callable[[], Caller], enabled: bool = False) -> DataFrame:
    """Gate failures (category, report) with ``upheld``: a model may find a block wrong; off unless enabled."""
    if not enabled:
        return failures.withColumn("upheld", F.col("category").isNotNull())
    prompt = F.when(F.col("category").isNotNull(), F.concat(F.lit("Is this block wrong? Answer {\"overturn\": true} or {\"overturn\": false}.\n"), F.col("category"), F.lit("\n"), T.text(F.col("report"))))
    rows = answered(failures, prompt, "_said", make)
    overturned = F.coalesce(F.get_json_object(T.json_object(F.col("_said")), "$.overturn") == "true", F.lit(False))
    return rows.withColumn("upheld", F.col("category").isNotNull() & ~overturned).drop("_said")


def cut_by_model(make: Callable[[], Caller], least: int = 800) -> Callable[[DataFrame, str, str], DataFrame]:
    """A chunker whose cuts a model names as JSON offsets of the whole text; the seeking chunker where that fails."""

    def run(df: DataFrame, identifier: str, content: str) -> DataFrame:
        prompt = F.when(F.length(content) > least, F.concat(F.lit("Where does each topic begin? Answer {\"starts\": [offsets]}.\n"), F.col(content)))
        asked = answered(df.select(identifier, content), prompt, "_said", make)
        length = F.length(content)
        named = F.from_json(F.get_json_object(T.json_object(F.col("_said")), "$.starts"), "array<int>")
        starts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), F.filter(named, lambda x: (x > 0) & (x < length)))))
        known = asked.withColumn("_starts", F.when(length <= least, F.array(F.lit(0))).otherwise(starts))
        ends = F.concat(F.slice("_starts", 2, F.greatest(F.size("_starts"), F.lit(1))), F.array(length))
        cut = known.where("_starts is not null").withColumn("_ends", ends).select(identifier, content, "_ends", F.posexplode("_starts").alias("chunk_index", "start_index")).select(
            identifier, F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("start_index").cast("bigint").alias("start_index"),
            F.substring(F.col(content), F.col("start_index") + 1, F.element_at("_ends", F.col("chunk_index") + 1) - F.col("start_index")).alias("text"),
        )
        return cut.unionByName(I.seeking_chunks(known.where("_starts is null").select(identifier, content), identifier, content))

    return run


#: A tool: from its arguments to a text.
Tool = Callable[..., str]


def run_tools(question: str, plan: Callable[[str, list[dict[str, Any]]], dict[str, Any]], tools: dict[str, Tool], most: int = 5) -> tuple[str, list[dict[str, Any]]]:
    """Let ``plan`` choose tools for a question until it answers, at most ``most`` calls, no call twice.

    ``plan`` gets the question and the calls so far and returns {"tool": name, "arguments": {}} or {"answer": text}.
    """
    calls: list[dict[str, Any]] = []
    seen: set[str] = set()
    while len(calls) < most:
        step = plan(question, calls)
        if "answer" in step:
            return str(step["answer"]), calls
        key = json.dumps([step.get("tool"), step.get("arguments", {})], sort_keys=True)
        if step.get("tool") not in tools or key in seen:
            break
        seen.add(key)
        calls.append({**step, "output": tools[step["tool"]](**step.get("arguments", {}))})
    return str(plan(question, [*calls, {"final": True}]).get("answer", "")), calls


#: Metrics a judging model could give, by name; a function from samples to (id, value) fills a slot.
JUDGED: dict[str, Callable[[DataFrame], DataFrame] | None] = dict.fromkeys(
    ("faithfulness", "answer_relevancy", "context_precision", "context_recall", "answer_correctness", "answer_similarity", "factual_correctness", "context_relevancy", "noise_sensitivity", "response_completeness", "context_precision_no_ref", "contradiction_score")
)


def judged_metrics(samples: DataFrame, judges: dict[str, Callable[[DataFrame], DataFrame]]) -> dict[str, float]:
    """The mean of each judged metric that has a judge."""
    unknown = set(judges) - set(JUDGED)
    if unknown:
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    return {f"ragas_{name}": float(judge(samples).agg(F.avg("value")).first()[0] or 0.0) for name, judge in judges.items()}
