import math
import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from strandline.llm import mixing
from strandline.llm.mixing import entropy, mix_sources, mixture, solve_exponent


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10**9), min_size=1, max_size=30), st.floats(1.0, 10.0))
def test_exponent_meets_the_repetition_limit(tokens, limit):
    budget = sum(tokens)
    a = solve_exponent(tokens, budget, max_repeats=limit)
    weights = mixture([t / budget for t in tokens], a)
    assert math.isclose(sum(weights), 1.0, rel_tol=1e-9)
    assert all(w * budget <= limit * t * (1 + 1e-6) for w, t in zip(weights, tokens))


def test_exponent_meets_a_target_entropy():
    tokens = [900, 90, 10]
    a = solve_exponent(tokens, 1000, target_entropy=0.8)
    assert abs(entropy(mixture([0.9, 0.09, 0.01], a)) - 0.8) < 1e-9
    assert solve_exponent(tokens, 1000, target_entropy=9.0) == 0.0
    assert solve_exponent([], 0) == 1.0


def flattest(tokens, limit):
    """The flattest mixture by a plain scan of exponents, finer and finer around the first that fits."""
    total = sum(tokens)

    def weights(a):
        powered = [(t / total) ** a for t in tokens]
        return [p / sum(powered) for p in powered]

    low, high = 0.0, 1.0
    for _ in range(8):
        steps = [low + (high - low) * k / 20 for k in range(21)]
        first = next((k for k, a in enumerate(steps) if all(w * total <= limit * t * (1 + 1e-12) for w, t in zip(weights(a), tokens))), 20)
        low, high = steps[max(0, first - 1)], steps[first]
    return weights(high)


def docs(spark, data):
    return spark.createDataFrame([(i, t, s, 1, 2, 3) for i, t, s in data], "doc_id long, text string, source string, full long, mix_epoch long, block int")


def check_quotas(df, data, limit):
    out = mix_sources(df, max_repeats=limit).collect()
    tokens, emitted, longest = defaultdict(int), defaultdict(int), 0
    for _, t, s in data:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        tokens[s] += n
        longest = max(longest, n)
    turns = defaultdict(set)
    for r in out:
        emitted[r.source] += len(r.text.split())
        turns[r.source, r.doc_id, r.text].add(r.mix_epoch)
    total = sum(tokens.values())
    weights = dict(zip(tokens, flattest([tokens[s] for s in tokens], limit)))
    for s in tokens:
        assert -2 <= emitted[s] - weights[s] * total < 2 * longest + 2
        # Only the last epoch of a source is partial.
        full = int((weights[s] * total + 1) // tokens[s])
        assert all(len(e) in (full, full + 1) and e == set(range(len(e))) for (source, _, _), e in turns.items() if source == s) or abs(weights[s] * total % tokens[s]) < 2
    return out


def test_quotas_and_edges(spark):
    data = [(i, "w " * (1 + i % 7), "big") for i in range(400)] + [(1000 + i, "v " * (1 + i % 5), "small") for i in range(30)] + [(2000 + i, "u u", None) for i in range(20)]
    data += [(5000, None, "big"), (5001, " \n", "big"), (None, "w w w", "big"), (5002, "x", "tiny"), (5002, "x", "tiny")]
    out = check_quotas(docs(spark, data), data, 3.0)
    assert {"doc_id", "text", "source", "full", "block", "mix_weight", "mix_epoch", "mix_place", "mix_key"} == set(out[0].asDict())
    assert out[0].full == 1 and out[0].block == 3


def test_ties_and_very_long_texts(spark):
    data = [(7, "a b", "x")] * 5 + [(8, "c " * 200_000, "y"), (9, "d e", "x"), (10, "d e", "x")]
    out = mix_sources(docs(spark, data), max_repeats=2.0).collect()
    assert sum(r.doc_id == 8 for r in out) in (1, 2)
    assert sum(r.doc_id == 7 for r in out) % 5 == 0


def test_sources_added_up_by_spark(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FEW", 1)
    data = [(100 * k + i, "w " * (1 + i % 7), f"s{k}") for k in range(3) for i in range(5 + 20 * k * k)]
    check_quotas(docs(spark, data), data, 2.0)


def test_empty_table(spark):
    assert mix_sources(docs(spark, [])).count() == 0
