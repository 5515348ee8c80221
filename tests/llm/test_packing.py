import random

import numpy as np
import pytest

from tarnlight.llm import packing as P
from tarnlight.llm.tokens import token_counts

ITEM = "doc_id long, n_tokens long, box string"


def check(rows, packed, capacity):
    fill, parts = {}, {}
    for r in packed:
        if r.container_id is not None:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.part_size
        parts.setdefault(r.doc_id, []).append(r)
    assert max(fill.values(), default=0) <= capacity
    for d in {d for d, *_ in rows}:
        sizes = [n or 0 for e, n, _ in rows if e == d]
        mine = parts[d]
        assert sum(r.part_size for r in mine if r.part_size > 0) == sum(max(0, n) for n in sizes)
        if max(sizes) <= capacity:
            assert len(mine) == len(sizes)
    return fill


@pytest.mark.parametrize("shard", [20_000, 150])
def test_nothing_is_lost_or_split_and_little_is_empty(spark, shard):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([rnd.randrange(1, 300), rnd.randrange(1, 60), rnd.randrange(400, 2000)]), "x") for i in range(1500)]
    fill = check(rows, P.pack(spark.createDataFrame(rows, ITEM), 512, shard_items=shard).collect(), 512)
    assert sum(fill.values()) / (len(fill) * 512) > 0.97


@pytest.mark.parametrize("smallest", [600, 30])
def test_no_round_gathers_what_cannot_merge(spark, smallest):
    """All items but one above half of the capacity: no shard of any round gets more than twice its share."""
    items = spark.range(8000).selectExpr("id as doc_id", "600L as n_tokens", "'' as box").unionByName(spark.createDataFrame([(-1, smallest, "")], ITEM))
    rounds = []
    got = P.pack(items, 1000, shard_items=500, rounds=rounds)
    assert got.select("container_id").distinct().count() == 8000 + (smallest > 400) and got.count() == 8001
    assert all(left <= shards * 500 for left, shards in rounds) and len(rounds) <= 2
    spread = items.selectExpr("pmod(xxhash64(doc_id), 16) as s").groupBy("s").count().agg({"count": "max"}).first()[0]
    assert spread <= 1000


def test_rounds_shrink(spark):
    items = spark.range(6000).selectExpr("id as doc_id", "1 + pmod(xxhash64(id), 700) as n_tokens", "'' as box")
    rounds = []
    packed = P.pack(items, 1000, shard_items=300, rounds=rounds)
    report = P.fill_report(packed, 1000).first()
    assert report.fill > 0.98 and report.tokens == items.agg({"n_tokens": "sum"}).first()[0]
    assert [a for a, _ in rounds] == sorted((a for a, _ in rounds), reverse=True) and len(rounds) >= 2
    assert all(left <= shards * 300 for left, shards in rounds)


def test_odd_sizes_and_repeats(spark):
    rows = [(1, None, ""), (2, 0, ""), (3, -5, ""), (4, 512, ""), (5, 1024, ""), (6, 1025, ""), (7, 1, ""), (7, 1, ""), (8, 511, "")]
    got = P.pack(spark.createDataFrame(rows, ITEM), 512).collect()
    check(rows, got, 512)
    assert {r.doc_id for r in got if r.container_id is None} == {1, 2, 3}
    assert sorted(r.part_size for r in got if r.doc_id == 6) == [1, 512, 512]
    assert P.pack(spark.createDataFrame([], ITEM), 512).count() == 0
    assert P.fill_report(P.pack(spark.createDataFrame([], ITEM), 512), 512).collect()[0].containers == 0


def test_rule_minimises_squares():
    rnd = random.Random(2)
    sizes = np.array([rnd.randrange(1, 21) for _ in range(300)])
    got = P.sum_of_squares(sizes, 20)
    level, n = {}, [0] * 21
    for w, c in zip(sizes.tolist(), got.tolist()):
        def cost(h):
            m = n[:]
            if h:
                m[h] -= 1
            if h + w < 20:
                m[h + w] += 1
            return sum(x * x for x in m)

        best = min(cost(h) for h in range(21 - w) if h == 0 or n[h])
        h = level.get(c, 0)
        assert cost(h) == best
        if h:
            n[h] -= 1
        if h + w < 20:
            n[h + w] += 1
        level[c] = h + w


def test_token_counts(spark):
    rows = [(1, "Hello world"), (2, ""), (3, None), (4, "字" * 3000), (5, "<|endoftext|>"), (6, "a" * 50_000)]
    got = {r.doc_id: r.n_tokens for r in token_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] >= 3000 and got[5] > 1 and got[6] > 1000
