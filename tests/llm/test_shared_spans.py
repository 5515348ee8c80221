import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnlight.llm import shared_spans as S

DOC = "doc_id long, text string, k string"


def noise(rnd, n, alphabet="abcdefgh ijkl.\n字é"):
    return "".join(rnd.choice(alphabet) for _ in range(n))


def grams(t):
    return {t[i : i + S.SPAN] for i in range(len(t) - S.SPAN + 1)} if t else set()


def brute_pairs(rows):
    g = [(d, grams(t)) for d, t, _ in rows]
    return {(min(a, b), max(a, b)) for i, (a, x) in enumerate(g) for b, y in g[i + 1 :] if a != b and x & y}


def brute_amount(rows):
    out = {}
    for i, (d, t, _) in enumerate(rows):
        others = set().union(*(grams(u) for j, (_, u, _) in enumerate(rows) if j != i)) if len(rows) > 1 else set()
        cov = set()
        for p in range(len(t or "") - S.SPAN + 1):
            if t[p : p + S.SPAN] in others:
                cov.update(range(p, p + S.SPAN))
        out[d] = len(cov)
    return out


def corpus(seed):
    rnd = random.Random(seed)
    rows = []
    passages = [noise(rnd, n) for n in (239, 240, 241, 300, 700)]
    for d in range(60):
        t = noise(rnd, rnd.randrange(0, 900))
        for p in rnd.sample(passages, rnd.randrange(0, 3)):
            cut = rnd.choice([p, p, p[: S.SPAN - 1], p[1:]])
            at = rnd.randrange(len(t) + 1)
            t = t[:at] + cut + t[at:]
        rows.append((d, t, "clash"))
    rows += [(100, rows[3][1] + noise(rnd, 5), ""), (101, rows[4][1], ""), (102, None, ""), (103, "", ""), (104, "z" * 5000, ""), (105, "z" * 260, ""), (106, "ab" * 400, ""), (107, "ba" * 200, "")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_and_amounts_equal_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, DOC)
    got = [(r.doc_id_a, r.doc_id_b) for r in S.shared_span_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows)
    amount = {r.doc_id: r.shared_chars for r in S.shared_amount(df).collect()}
    assert amount == brute_amount(rows)


@pytest.mark.parametrize("seed", [1, 4])
def test_passages_hold_every_pair_in_few_rows(spark, seed):
    rows = corpus(seed)
    got = S.passages(spark.createDataFrame(rows, DOC)).collect()
    member = {}
    for r in got:
        member.setdefault(r.passage, set()).add(r.doc_id)
    pairs = {(a, b) for m in member.values() for a in m for b in m if a < b}
    assert pairs == brute_pairs(rows) and len(got) == sum(map(len, member.values()))
    text = {d: t for d, t, _ in rows}
    assert all(r.n_texts == len({text[d] for d in member[r.passage]}) for r in got)


def test_one_passage_in_very_many_texts_is_linear(spark):
    rnd = random.Random(11)
    passage = noise(rnd, 300, "abcdefgh ijkl.")
    n = 100_000
    df = spark.range(n).selectExpr("id as doc_id", f"concat('{passage.replace(chr(39), '')}', repeat(char(65 + cast(id % 26 as int)), 1), cast(id as string)) as text", "'' as k")
    got = S.passages(df)
    got = got.groupBy("passage").count().cache()  # texts whose numbers begin alike share a little more: classes of their own
    assert got.agg({"count": "max"}).first()[0] == n and got.agg({"count": "sum"}).first()[0] < 6 * n


@pytest.mark.parametrize("least", [8, 40, 100])
def test_other_lengths(spark, least):
    rnd = random.Random(12)
    body = [noise(rnd, least + x) for x in (-1, 0, 1, 30)]
    rows = [(d, noise(rnd, rnd.randrange(0, 200)) + chr(0x4E00 + d) + rnd.choice(body) + chr(0x5E00 + d) + noise(rnd, 20), "") for d in range(40)]
    g = [(d, {t[i : i + least] for i in range(len(t) - least + 1)}) for d, t, _ in rows]
    want = {(a, b) for i, (a, x) in enumerate(g) for b, y in g[i + 1 :] if x & y}
    df = spark.createDataFrame(rows, DOC)
    assert {(r.doc_id_a, r.doc_id_b) for r in S.shared_span_pairs(df, min_chars=least).collect()} == want


def test_blocks_of_long_texts(spark, monkeypatch):
    rnd = random.Random(5)
    shared = noise(rnd, 400)
    n = S.BLOCK
    long = noise(rnd, n - 700, "abc") + shared + noise(rnd, n // 4, "abc")  # across the border of two blocks
    rows = [(1, long, ""), (2, "x" + shared + "y", "")]
    assert [(r.doc_id_a, r.doc_id_b) for r in S.shared_span_pairs(spark.createDataFrame(rows, DOC)).collect()] == [(1, 2)]


def test_phrase_in_a_third_of_all_texts_makes_no_pairs(spark):
    rnd = random.Random(6)
    phrase = noise(rnd, 200)
    rows = [(i, noise(rnd, 300) + (phrase if i % 3 == 0 else "") + noise(rnd, 300), "") for i in range(300)]
    assert S.shared_span_pairs(spark.createDataFrame(rows, DOC)).count() == 0


@pytest.mark.parametrize("few", [0, 3])
def test_pairs_of_frequent_runs_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(S, "FEW", few, raising=False)
    rows = corpus(3)
    got = [(r.doc_id_a, r.doc_id_b) for r in S.shared_span_pairs(spark.createDataFrame(rows, DOC)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows)


def test_phrase_just_under_the_span_makes_no_pairs_on_the_way(spark, monkeypatch):
    """239 characters in a third of all texts; two of them share 240."""
    rnd = random.Random(8)
    phrase = noise(rnd, 239, "abcdefgh ijkl.")
    ends = {0: "Q", 3: "Q"}
    rows = [(i, noise(rnd, 300) + chr(0x5E00 + i) + (phrase + ends.get(i, chr(0x4E00 + i)) if i % 3 == 0 else "") + noise(rnd, 300), "") for i in range(300)]
    kept = []
    cut = S.cut_lineage
    monkeypatch.setattr(S, "cut_lineage", lambda df: kept.append(cut(df)) or kept[-1])
    assert [(r.doc_id_a, r.doc_id_b) for r in S.shared_span_pairs(spark.createDataFrame(rows, DOC)).collect()] == [(0, 3)]
    groups = kept[-1].groupBy(*[c for c in ("g", "half") if c in kept[-1].columns]).count()
    assert groups.where("count > 2").count() == 0  # what is joined with itself


def test_empty_and_repeated_rows(spark):
    none = spark.createDataFrame([], DOC)
    assert S.shared_span_pairs(none).count() == 0 and S.passages(none).count() == 0 and S.shared_amount(none).count() == 0 and S.sentence_spans(none).count() == 0
    t = noise(random.Random(7), 400)
    df = spark.createDataFrame([(1, t, ""), (1, t, "")], DOC)
    assert S.shared_span_pairs(df).count() == 0


@given(st.lists(st.integers(0, 2**64 - 1), min_size=5, max_size=60), st.integers(1, 5))
@settings(max_examples=80, deadline=None)
def test_sliding_minimum(x, w):
    a = np.array(x, dtype=np.uint64)
    assert S._sliding_min(a, w).tolist() == [min(x[i : i + w]) for i in range(len(x) - w + 1)]


def test_sentence_runs_stay_where_they_stand_first(spark):
    body = ["One is here.", "Two is here!", "Three is here?", "Four is here.", "Five。"]
    rows = [(1, " ".join(body[:4]), ""), (2, "Own start. " + " ".join(body[:3]) + " Own end.", ""), (3, "Short. Text.", ""), (4, None, ""), (5, " ".join(body[:3] * 2), "")]
    got = {r.doc_id: r for r in S.sentence_spans(spark.createDataFrame(rows, DOC)).collect()}
    assert got[1].n_removed == 0 and got[2].kept_text == "Own start.\nOwn end." and got[2].removed_chars == sum(map(len, body[:3]))
    assert got[3].n_removed == 0 and (got[4].n_sentences, got[4].kept_text) == (0, None) and got[5].n_removed == 6
