import pytest

from corvane.llm.broken_pairs import defective_pairs
from corvane.llm.pairs import LongAutomaton, SuffixAutomaton, breaks_off, classify, copies, is_empty, open_delimiter, refuses


@pytest.mark.parametrize("text", [None, "", " \n\t", "n/a", "[TODO]", "<p>&nbsp;</p>", "**Answer:** ", "…", "​", "A:", "{}", "答案："])
def test_empty(text):
    assert is_empty(text)


@pytest.mark.parametrize("text", ["Yes.", "No", "7", "是", "Delta"])
def test_short_answers_are_not_empty(text):
    assert not is_empty(text)


def test_suffix_automaton_coverage_matches_brute_force():
    own, other, least = "abracadabra", "xxabracxcadabrayyra", 3
    subs = {own[i:j] for i in range(len(own)) for j in range(i + least, len(own) + 1)}
    want = [any(i <= k < i + n and other[i : i + n] in subs for i in range(len(other)) for n in range(least, 12) if i + n <= len(other)) for k in range(len(other))]
    assert SuffixAutomaton(own).covered(other, least) == want
    assert all(LongAutomaton(own, stretch).covered(other, least) == want for stretch in (1, 2, 4, 20))


def test_giving_up_early_changes_nothing():
    import random

    rng = random.Random(4)
    for _ in range(400):
        own, text = ("".join(rng.choice("abc ") for _ in range(rng.randint(1, 40))) for _ in range(2))
        least, share = rng.randint(1, 4), rng.choice([0.2, 0.5, 0.8, 1.0])
        hit = [h for c, h in zip(text, SuffixAutomaton(own).covered(text, least)) if c != " "]
        want = sum(hit) >= share * len(hit) - 1e-9
        assert SuffixAutomaton(own).mostly_covers(text, least, share) == want == LongAutomaton(own, 7).mostly_covers(text, least, share)


def test_copies():
    prompt = "How is the recovery rate measured in practice?"
    assert copies(prompt, "how is the recovery rate measured in practice")
    assert copies(prompt, "Sure! How is the recovery rte measured in practice?")
    assert copies(prompt, f"> {prompt}\n")
    assert not copies(prompt, "You asked how the recovery rate is measured. It is estimated from past defaults of similar bonds.")
    assert copies("什么是变动保证金？", "问题是：什么是变动保证金")
    assert not copies("什么是变动保证金？", "变动保证金是每天交换的担保。")


def test_very_long_texts():
    prompt = "What is the limit of desk number " + " ".join(map(str, range(60_000))) + "?"
    assert copies(prompt, prompt.upper()) and not copies(prompt, "It is five million. " * 20_000)
    assert classify("What is it?", "word " * 200_000 + "end.").defect is None


def test_refusal_needs_to_be_all_there_is():
    assert refuses("Hello! I'm sorry, but I can't help with that. Is there anything else?")
    assert refuses("Das weiß ich nicht.")
    assert not refuses("I am not sure about the 2019 number; the rest is documented. The limit is set monthly.")
    assert not refuses("I cannot answer for all desks. The desk in Bern uses a limit of 5 million.")


def test_delimiters_and_tails():
    assert open_delimiter("two things (the first being")
    assert open_delimiter("see\n```\nx = 1")
    assert not open_delimiter("a (b) [c] 3) d")
    assert classify("What is it?", "The limit is reviewed monthly. It depends on").defect == "truncated"
    assert classify("What is it?", "It has two inputs:\n1. the rate\n2.").defect == "truncated"
    assert classify("What is it?", "The limit is reviewed monthly.").defect is None
    assert breaks_off(whole=0, starts=0, before=40, ends=0, goes_on=0)
    assert not breaks_off(whole=9, starts=10, before=12, ends=0, goes_on=5)


def test_other_language_ignores_quotations():
    assert classify("What is the limit for the desk?", "Sure! Die Grenze ist für das ganze Buch und nicht für den Tag.").defect == "other_language"
    assert classify("What is the limit for the desk?", 'The contract says "die Grenze ist für das ganze Buch" and so it is for all of it.').defect is None


def test_operator_edges(spark):
    schema = "record_table string, record_id string, prompt string, response string, defect int, keys string"
    rows = [
        ("q", "1", "What is a limit?", None, 1, "x"),
        ("q", "1", "What is a limit?", None, 2, "y"),  # repeated, other columns with clashing names
        ("q", "2", None, "I do not know.", 1, None),
        ("q", None, "What is a limit?", "", 1, None),
        ("q", "3", "What is a limit?", "A limit is a bound. " * 5000, 1, None),
        ("q", "4", "What is a limit?", "A limit is a bound that", 1, None),
    ]
    rows += [("q", f"n{i}", "What is a limit?", "A limit is a bound that a desk keeps.", 0, None) for i in range(20)]
    got = {tuple(r) for r in defective_pairs(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("q", "1", "empty"), ("q", "2", "refusal"), ("q", None, "empty"), ("q", "4", "truncated")}
    assert defective_pairs(spark.createDataFrame([], schema)).count() == 0


def test_copies_of_a_truncated_response_do_not_vouch_for_it(spark):
    full = [("q", f"n{i}", f"What is limit {i}?", f"A limit is a bound that desk {i} keeps.") for i in range(5)]
    cut = [("q", f"c{i}", f"What is a bound {i % 4}?", "A limit is a bound that") for i in range(12)]
    alone = [("q", f"a{i}", "What is a hedge?", "Hedges offset the") for i in range(9)]  # one pair under many identifiers
    short = [("q", f"s{i}", f"What is exposure {i}?", "Price sensitivity times position size") for i in range(9)]  # an answer to many prompts
    got = {tuple(r) for r in defective_pairs(spark.createDataFrame(full + cut + alone + short, "record_table string, record_id string, prompt string, response string")).collect()}
    assert got == {("q", i, "truncated") for _, i, *_ in cut + alone}


def test_only_a_source_list_that_ends_the_response_is_exempt():
    whole = "The limit is reviewed monthly.\n\nSources: [1] a.md, [2] b.md"
    assert classify("What is it?", whole).defect is None
    assert classify("What is it?", whole + ", [3] c (part").defect == "truncated"
    assert classify("What is it?", whole + "\n\nIt has two parts. The first one (a").defect == "truncated"
    assert classify("What is it?", whole.replace("monthly.", "monthly. It depends on")).defect == "truncated"


@pytest.mark.parametrize("text", ["Delta of a call lies in [0, 1).", "The half-open interval (0, 1] is used.", "It is in ]0; 1[ for all „calls“ and «puts».", 'The "limit" is 5" wide (see "a").'])
def test_closed_delimiters(text):
    assert not open_delimiter(text) and classify("What is it?", text).defect is None


def test_quotation_marks_of_other_languages():
    assert not open_delimiter("Das ist »die Grenze« und “so” weiter, wie „hier“.")


@pytest.mark.parametrize("text", ["It is called „limit", "The desk says «the limit is", 'The policy reads "the limit is', "It says “the (limit) is"])
def test_open_quotations(text):
    assert open_delimiter(text)


@pytest.mark.parametrize("text", ["Equity swaps are out of scope.", "Crypto is not allowed to be traded.", "No information on volatility surfaces is published."])
def test_facts_are_no_refusals(text):
    assert not refuses(text)


@pytest.mark.parametrize("text", ["That is out of scope for me.", "I am not allowed to say.", "No information on this was found in the sources."])
def test_ambiguous_phrases_about_the_answer_decline(text):
    assert refuses(text)
