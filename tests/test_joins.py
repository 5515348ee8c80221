import collections

from tarnlight.operators import joins as J


def test_skewed_join_is_an_inner_join(spark):
    rows = [("hot" if i % 3 else f"k{i % 50}", i % 2, i) for i in range(6000)] + [(None, 0, -1)]
    keys = [("hot", 0, 9, 2000), ("hot", 1, 8, 2000), *((f"k{i}", i % 2, i, 40) for i in range(0, 60)), ("none", 0, 1, 1)]
    left = spark.createDataFrame(rows, "a string, b int, v int")
    right = spark.createDataFrame(keys, "a string, b int, w int, n long")
    got = collections.Counter(tuple(r) for r in J.skewed_join(left, right, ["a", "b"], "n").select("a", "b", "v", "w").collect())
    table = {(a, b): w for a, b, w, _ in keys}
    assert got == collections.Counter((a, b, v, table[a, b]) for a, b, v in rows if (a, b) in table)
    assert J.skewed_join(left, right.limit(0), ["a", "b"], "n").count() == 0
    assert J.skewed_join(left.limit(0), right, ["a", "b"], "n").count() == 0


def test_few_keys_are_broadcast_whatever_their_weight(spark):
    right = spark.range(20_000).selectExpr("id as k", "1L as n").unionByName(spark.createDataFrame([(-1, 10**9)], "k long, n long"))
    left = spark.range(100).selectExpr("if(id < 50, -1L, id) as k")
    plan = J.skewed_join(left, right, ["k"], "n")
    assert plan.count() == 100
