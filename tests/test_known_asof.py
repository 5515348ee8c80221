import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnlight.operators.known_asof import PersistentTree, _search, entity_key, known_asof

FACTS, EVENTS = "ent string, valid long, known long, fact_id long", "ent string, t long, event_id long"


def brute(facts, events):
    out = set()
    for ent, t, e in events:
        if None in (ent, t, e):
            continue
        ok = [(v, k, -i) for n, v, k, i in facts if None not in (n, v, k, i) and n == ent and v <= t and k <= t]
        if ok:
            out.add((e, -max(ok)[2]))
    return out


@given(st.lists(st.integers(0, 30), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_tree_keeps_every_version(ranks):
    n = max(ranks) + 1
    tree = PersistentTree(np.array(ranks), n)
    q = [(v, x) for v in range(-1, len(ranks)) for x in range(-1, n)]
    got = tree.predecessor(np.array([v for v, _ in q]), np.array([x for _, x in q]))
    for (v, x), g in zip(q, got):
        seen = [(r, i) for i, r in enumerate(ranks[: v + 1]) if r <= x]
        assert g == (max(seen)[1] if seen else -1)


@given(st.integers(0, 10**6))
@settings(max_examples=40, deadline=None)
def test_kernel_equals_brute_force(seed):
    rnd = random.Random(seed)
    facts = list({(rnd.choice("ab"), rnd.randrange(20), rnd.randrange(20)): None for _ in range(rnd.randrange(30))})
    facts = [(e, v, k, i) for i, (e, v, k) in enumerate(facts)]
    events = [(rnd.choice("abc"), rnd.randrange(25), i) for i in range(rnd.randrange(20))]
    rows = [(e, max(v, k), False, v, k, i) for e, v, k, i in facts] + [(e, t, True, None, None, i) for e, t, i in events]
    pdf = pd.DataFrame(rows, columns=["ent", "t", "is_event", "valid", "known", "row_id"])
    pdf["is_event"] = pdf["is_event"].astype(bool)
    got = _search(pdf)
    assert set(zip(got.event_id, got.fact_id)) == brute(facts, events)


@pytest.mark.parametrize("shard_rows", [3, 40, 100000])
def test_cut_and_salted_shards(spark, shard_rows):
    rnd = random.Random(5)
    hour = 3_600_000_000
    facts = [(rnd.choice(["x", "x", "x", "y", None]), rnd.randrange(200) * hour // 4, rnd.randrange(300) * hour // 4, i) for i in range(300)]
    facts += [("x", 0, None, 900), ("x", None, 5, 901)] + facts[:5]
    events = [(rnd.choice(["x", "x", "y", "z", None]), rnd.randrange(320) * hour // 4, i) for i in range(200)]
    got = known_asof(spark.createDataFrame(facts, FACTS), spark.createDataFrame(events, EVENTS), shard_rows)
    assert {tuple(r) for r in got.collect()} == brute(facts, events)


def test_later_knowledge_never_reaches_an_event(spark):
    events = spark.createDataFrame([("x", 100, 1)], EVENTS)
    base = [("x", 50, 60, 1)]
    for extra in ([], [("x", 90, 101, 2)], [("x", 101, 10, 3)], [("x", 50, 150, 4)]):
        assert known_asof(spark.createDataFrame(base + extra, FACTS), events).collect()[0].fact_id == 1


def test_empty_tables_and_blank_keys(spark):
    none = spark.createDataFrame([], FACTS)
    assert known_asof(none, spark.createDataFrame([("x", 1, 1)], EVENTS)).count() == 0
    assert known_asof(none, spark.createDataFrame([], EVENTS)).count() == 0
    df = spark.createDataFrame([(" Wti ",), (None,)], "s string")
    assert [r[0] for r in df.select(entity_key("s")).collect()] == ["wti", None]


def test_bulk_release_of_one_entity_is_one_fact(spark):
    """A third of a million facts under one time stamp meet in no task: only their best one is sharded."""
    from tarnlight.operators import known_asof as K

    facts = spark.range(30_000).selectExpr("'hot' as ent", "id % 977 as valid", "5000L as known", "id as fact_id").unionByName(spark.createDataFrame([("hot", 9000, 9000, 77), ("cold", 1, 1, 5)], "ent string, valid long, known long, fact_id long"))
    events = spark.createDataFrame([("hot", 4999, 1), ("hot", 5000, 2), ("hot", 9001, 3), ("cold", 7, 4)], "ent string, t long, event_id long")
    got = {tuple(r) for r in K.known_asof(facts, events, shard_rows=10).collect()}
    assert got == {(2, 976), (3, 77), (4, 5)}
