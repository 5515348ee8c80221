import math
import random

from tarnlight.llm import mixing as M

DOC = "doc_id long, source string, text_key string, n_tokens long, copies int"
TARGET = "mix_name string, source string, target_share double, max_repeats int"


def run(spark, docs, targets, **k):
    s, r = M.mix(spark.createDataFrame(docs, DOC), spark.createDataFrame(targets, TARGET), **k)
    return s.collect(), {(x.mix_name, x.source): x for x in r.collect()}


def test_shares_repeats_and_copies(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_DOCS", 50)
    rnd = random.Random(1)
    docs = [(i, rnd.choice("aaaaabbc"), f"k{i}", rnd.randrange(20, 400), 0) for i in range(3000)]
    docs += [(10_000 + i, docs[i][1], docs[i][2], docs[i][3], 0) for i in range(300)]  # copies under another id
    targets = [("m", "a", 0.5, 1), ("m", "b", 0.3, 4), ("m", "c", 0.2, 3), ("n", "a", 0.1, 2), ("n", "b", 0.9, 2)]
    sel, rep = run(spark, docs, targets)
    for (mix, s), r in rep.items():
        assert abs(r.actual_share - r.target_share) < 0.005, r
    cap = {(m, s): k for m, s, _, k in targets}
    key = {d: k for d, _, k, _, _ in docs}
    used = {}
    for r in sel:
        used[r.mix_name, key[r.doc_id]] = used.get((r.mix_name, key[r.doc_id]), 0) + r.copies
        assert 1 <= r.copies <= cap[r.mix_name, r.source] and r.doc_id < 10_000
    assert all(n <= 4 for n in used.values())
    # the budget is the largest: some source stands at its cap
    assert any(r.tokens >= 0.99 * cap[k] * sum(n for d, s, _, n, _ in docs if s == k[1] and d < 10_000) for k, r in rep.items())
    assert {tuple(r) for r in run(spark, docs, targets)[0]} == {tuple(r) for r in sel}


def test_odd_rows(spark):
    docs = [(1, None, "x", 5, 0), (2, "a", "y", 0, 0), (3, "a", "z", None, 0), (4, "a", "w", 7, 0), (4, "a", "w", 7, 0), (5, "unwanted", "v", 9, 0)]
    targets = [("m", "a", 0.5, 2), ("m", "empty", 0.5, 2), ("z", "empty", 1.0, 1), ("m", "a", 0.5, 1), ("q", "a", None, None)]
    sel, rep = run(spark, docs, targets)
    assert [(r.mix_name, r.doc_id, r.copies) for r in sel] == [("m", 4, 2)]
    assert rep["m", "a"].actual_share == 1.0 and rep["m", "empty"].tokens == 0 and rep["z", "empty"].tokens == 0
    assert run(spark, [], targets)[0] == []


def test_budget_beyond_the_caps_bends_the_shares():
    tokens, targets = {"a": 1000, "b": 100}, {"a": (0.2, 2), "b": (0.8, 2)}
    q, exponent, budget = M.plan_mix(tokens, targets)
    assert exponent == 1 and math.isclose(q["b"], 200) and math.isclose(budget, 250)
    q, exponent, budget = M.plan_mix(tokens, targets, budget=1500)
    assert exponent < 1 and math.isclose(sum(q.values()), 1500, rel_tol=1e-6) and q["a"] <= 2000.001 and q["b"] <= 200.001
    q, exponent, budget = M.plan_mix(tokens, targets, budget=100)
    assert exponent == 1 and math.isclose(q["b"], 80)


def test_temperature_meets_the_entropy():
    tokens = {"a": 900, "b": 90, "c": 10}
    h = lambda w: -sum(p * math.log(p) for p in w.values())
    for want in (0.2, 0.5, 1.0, math.log(3)):
        w, a = M.temperature_weights(tokens, want)
        assert abs(h(w) - want) < 1e-6
    assert math.isclose(M.temperature_weights(tokens, exponent=1.0)[0]["a"], 0.9)
    assert M.temperature_weights({}) == ({}, 1.0) and M.temperature_weights({"a": 0, "b": 3}, 0.0)[0] == {"b": 1.0}


def test_copy_without_source_is_no_loss(spark):
    docs = [(1, None, "t", 5, 0), (2, "a", "t", 5, 0), (3, "a", "u", 5, 0)]
    sel, rep = run(spark, docs, [("m", "a", 1.0, 1)])
    assert {r.doc_id for r in sel} == {2, 3} and rep["m", "a"].tokens == 10


def test_limit_on_repeats_bends_towards_natural_shares():
    tokens = {"a": 9000, "b": 900, "c": 100}
    w, a = M.limited_weights(tokens, 2.0, 10_000)
    assert 0 < a < 1 and math.isclose(max(10_000 * w[k] / tokens[k] for k in tokens), 2.0, rel_tol=1e-6)
    assert M.limited_weights(tokens, 1e9, 10_000)[1] < 1e-9  # as even as can be
    assert math.isclose(M.limited_weights(tokens, 0.5, 10_000)[1], 1.0)
    assert M.limited_weights({}, 1.0, 5) == ({}, 1.0)


def test_temperature_mixes_are_realised(spark):
    rnd = random.Random(5)
    docs = [(i, rnd.choice("aaaaaaabbc"), f"k{i}", rnd.randrange(20, 400), 0) for i in range(3000)]
    s, r = M.temperature_mix(spark.createDataFrame(docs, DOC), entropy=0.9, max_repeats=2.0)
    sel, rep = s.collect(), {(x.mix_name, x.source): x for x in r.collect()}
    assert len(rep) == 6 and all(abs(x.actual_share - x.target_share) < 0.005 and x.most_copies <= 2 for x in rep.values())
    h = -sum(x.actual_share * math.log(x.actual_share) for (m, _), x in rep.items() if m == "entropy")
    assert abs(h - 0.9 * math.log(3)) < 0.01
    assert abs(sum(x.tokens for (m, _), x in rep.items() if m == "repeats") / sum(d[3] for d in docs) - 1) < 0.01
    assert sum(x.n_tokens * x.copies for x in sel) == sum(x.tokens for x in rep.values())
    assert all(0 < x.exponent < 1 for x in rep.values())
    assert M.temperature_mix(spark.createDataFrame([], DOC))[1].count() == 0
