import math
import random

from pyspark.sql import functions as F

from corvane.llm.contributor_cap import cap_contributors, contributor_name
from corvane.llm.top_items import read_top, top_n_per_group, _cluster


def capped(rows, cap, part_cap):
    """rows: (id, who, part, score); the rule, step by step."""
    by = {}
    for i, who, part, score in set(rows):
        if who is not None and i is not None:
            by.setdefault(who, []).append((i, part, score))
    kept = set()
    for items in by.values():
        if len(items) <= cap:
            continue
        missing = lambda s: s is None or math.isnan(s)
        items.sort(key=lambda x: (missing(x[2]), 0 if missing(x[2]) else -x[2], x[0]))
        parts, left = {}, []
        for i, part, _ in items:
            if part:
                parts[part] = parts.get(part, 0) + 1
                if parts[part] > part_cap:
                    continue
            left.append(i)
        kept.update(left[:cap])
    return kept


def cap(df, cap, part_cap):
    found = cap_contributors(
        df, identifier="id", contributor=F.col("who"), part=F.col("part"), score="score", cap=cap, part_cap=part_cap
    )
    return [r[0] for r in found.collect()]


def test_cap_matches_the_rule(spark):
    rng = random.Random(4)
    scores = [None, float("nan"), 0.0, -0.0, -1.5, 1e300, 0.25, 0.5, 0.5, math.inf, -math.inf]
    rows = [
        (rng.randint(-500, 500) * 2**40 + i, rng.choice("AAAAAABCD"), rng.choice([None, "", "p", "q", "r"]), rng.choice([*scores, rng.random()]))
        for i in range(600)
    ]
    rows += rows[:40] + [(None, "A", "p", 1.0), (7, None, "p", 1.0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id bigint, who string, part string, score double, key string, cutoff int")
    got = cap(df, 25, 6)
    assert len(got) == len(set(got)) and set(got) == capped(rows, 25, 6)
    assert cap(df.limit(0), 25, 6) == []


def test_cap_with_all_scores_tied(spark):
    rows = [(i, "A", None, 0.5) for i in range(1000)]
    df = spark.createDataFrame(rows, "id bigint, who string, part string, score double")
    assert set(cap(df, 300, 4)) == set(range(300))


def test_contributor_name(spark):
    rows = [(r" .\Corpus\Desk.md ",), ("./a",), (None,), ("A/./b",)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(contributor_name(F.col("s"))).collect()]
    assert got == ["corpus/desk.md", "a", None, "a/./b"]


def top(rows, n):
    by = {}
    for g, i, s in set(rows):
        if g is not None and i is not None and s is not None and not math.isnan(s):
            by.setdefault(g, set()).add((-s, i))
    return {(g, i) for g, items in by.items() for _, i in sorted(items)[:n]}


def test_top_items_match_the_rule(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot"] * 6 + list("abcdefgh")), rng.randint(0, 4000), rng.choice([0.1, 0.2, 0.9, -1.0, rng.random()])) for _ in range(3000)]
    rows = list({(g, i): (g, i, s) for g, i, s in rows}.values())
    rows += rows[:50] + [(None, 1, 1.0), ("a", None, 1.0), ("a", 5, None), ("a", 6, float("nan")), ("one", 1, -0.0)]
    df = spark.createDataFrame([(*r, "g") for r in rows], "grp string, item bigint, score double, g string")
    got = [(r.grp, r.item) for r in top_n_per_group(df, group="grp", item="item", score="score", n=7, row_group_bytes=2048, rows_per_file=400).collect()]
    assert len(got) == len(set(got)) and set(got) == top(rows, 7)
    assert top_n_per_group(df.limit(0), group="grp", item="item", score="score", n=7).count() == 0


def test_row_groups_are_skipped(spark):
    df = spark.range(60000).select(F.lit("g").alias("g"), F.col("id").alias("item"), (F.col("id") % 1000 / 7.0).alias("score"))
    seen = {}
    for uri in _cluster(df, 4096, 10**6):
        read_top(uri, 5, seen)
    assert seen["skipped"] > 5 * seen["read"] / 4 and seen["read"] >= 1


def test_row_groups_of_many_groups_are_skipped(spark):
    rng = random.Random(3)
    rows = [(f"g{k % 1500}", k, rng.random() * (1 if k % 3 else 0.03)) for k in range(90000)]
    df = spark.createDataFrame(rows, "g string, item bigint, score double")
    seen, got = {}, set()
    for uri in _cluster(df, 2**20, 10**6):
        found = read_top(uri, 5, seen)
        got |= set(zip(found["g"], found["item"]))
    assert got == top(rows, 5) and seen["skipped"] > seen["read"]


def test_scores_without_bounds_and_ties(spark):
    rows = [("a", k, s) for k, s in enumerate([math.inf, -math.inf, 0.0, -0.0, 1e308, -1e308, 5e-324] * 3)] + [("b", k, 1.0) for k in range(20)]
    df = spark.createDataFrame(rows, "g string, item bigint, score double")
    got = {(r.g, r.item) for r in top_n_per_group(df, group="g", item="item", score="score", n=6).collect()}
    assert got == top(rows, 6)
