import datetime as dt
import math
import random

from pyspark.sql import functions as F

from tarnlight.operators import joins as J
from tarnlight.operators import scoring as G
from tarnlight.operators import series as R


def make(spark, n=140, seed=2, symbols=("a", "b")):
    rnd = random.Random(seed)
    rows = []
    for s in symbols:
        c = 100.0
        for i in range(n):
            c *= 1 + rnd.uniform(-0.03, 0.03)
            rows.append((s, dt.date(2024, 1, 1) + dt.timedelta(days=i), c, c * 1.01, c * 0.98, c, float(i % 7 + 1)))
    return spark.createDataFrame(rows, "symbol string, d date, open double, high double, low double, close double, volume double"), rows


def test_recursive_indicators_equal_plain_loops(spark):
    df, rows = make(spark)
    got = {(r.symbol, r.d): r for r in R.recursive_indicators(df).collect()}
    for s in "ab":
        x = [r for r in rows if r[0] == s]
        u = v = a = pdm = mdm = adx = None
        fast = slow = x[0][5]
        sig = 0.0
        ema = lambda old, new, k=1 / 14: new if old is None else old + k * (new - old)
        for i, (_, d, _, h, low, c, _) in enumerate(x):
            before = x[i - 1] if i else None
            a = ema(a, max(h - low, abs(h - before[5]), abs(low - before[5])) if i else h - low)
            r = got[s, d]
            assert math.isclose(r.atr, a, rel_tol=1e-9)
            if not i:
                assert r.rsi is None and r.adx == 0
                continue
            ch, up, dn = c - before[5], h - before[3], before[4] - low
            u, v = ema(u, max(ch, 0)), ema(v, max(-ch, 0))
            pdm, mdm = ema(pdm, up if up > dn and up > 0 else 0.0), ema(mdm, dn if dn > up and dn > 0 else 0.0)
            assert math.isclose(r.rsi, 100 * u / (u + v), rel_tol=1e-9)
            if pdm + mdm:
                adx = ema(adx, 100 * abs(pdm - mdm) / (pdm + mdm))
                assert math.isclose(r.adx, adx, rel_tol=1e-8)
            fast, slow = fast + (c - fast) * 2 / 13, slow + (c - slow) * 2 / 27
            sig += (fast - slow - sig) / 5
            assert math.isclose(r.macd_hist, fast - slow - sig, rel_tol=1e-7, abs_tol=1e-9)


def test_rise_without_a_fall_saturates(spark):
    rows = [("a", dt.date(2024, 1, 1) + dt.timedelta(days=i), 1.0 + i, 1.0 + i, 1.0 + i, 1.0 + i, 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "symbol string, d date, open double, high double, low double, close double, volume double")
    assert {r.rsi for r in R.recursive_indicators(df).collect()} == {None, 100.0}


def test_regime_invariants(spark):
    df, _ = make(spark, 160)
    for r in R.regimes(df).collect():
        assert r.primary in r.tags and not (r.trend_up and r.trend_down) and (("range" in r.tags) == (not r.trend_up and not r.trend_down))
        assert r.streak >= 1
    strict = R.regimes(df, strict=True).where("slope is null and trend_down").count()
    assert strict == 0


def test_equity_product_equals_loop(spark):
    df, rows = make(spark, 60, symbols=("a",))
    got = df.withColumn("e", R.compounded(1 + F.coalesce(F.col("close") / F.lag("close").over(R.over()) - 1, F.lit(0.0)))).orderBy("d").collect()
    e = 1.0
    for i, r in enumerate(got):
        e *= rows[i][5] / rows[i - 1][5] if i else 1.0
        assert math.isclose(r.e, e, rel_tol=1e-9)


def test_streak_with_nulls(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([None, None, "x", "x", None, "x"])], "symbol string, d int, v string")
    assert [r.streak for r in R.streak(df, "v").orderBy("d").collect()] == [1, 2, 1, 2, 1, 1]


def test_asof_ties_nulls_and_empty(spark):
    left = spark.createDataFrame([("k", 5), ("k", 0), (None, 5), ("z", 5)], "k string, t int")
    right = spark.createDataFrame([("k", 5, 1.0), ("k", 5, 2.0), ("k", 3, 9.0), ("k", 6, 7.0)], "k string, rt int, v double")
    got = {(r.k, r.t): r.v for r in J.asof(left, right, "k", "t", "rt", ["v"]).collect()}
    assert got == {("k", 5): 2.0, ("k", 0): None, (None, 5): None, ("z", 5): None}
    assert J.asof(left.limit(0), right, "k", "t", "rt", ["v"]).count() == 0


def test_seasonal_peers_equal_brute_force(spark):
    rnd = random.Random(3)
    rows = [("s", dt.date(2018, 1, 1) + dt.timedelta(days=3 * i), rnd.random()) for i in range(700)]
    df = spark.createDataFrame(rows, "symbol string, d date, close double")
    got = {r.d: (r.z, r.n) for r in J.seasonal_z(df).collect()}
    for _, d, v in rows:
        gap = lambda e: min(abs(d.timetuple().tm_yday - e.timetuple().tm_yday), 365 - abs(d.timetuple().tm_yday - e.timetuple().tm_yday))
        peers = [w for _, e, w in rows if e < d and (d - e).days <= 1855 and gap(e) <= 7]
        if len(peers) < 3:
            assert d not in got
            continue
        m = sum(peers) / len(peers)
        sd = (sum((p - m) ** 2 for p in peers) / len(peers)) ** 0.5
        assert got[d][1] == len(peers) and math.isclose(got[d][0], (v - m) / sd, rel_tol=1e-9)


EVENT = "score_date date, commodity string, topic string, source_key string, source_bucket string, direction string, verification_status string, horizon string, credibility double, novelty double, confidence double, rumor_flag boolean, cost_level string"


def event(day, direction="bullish", topic="opec_policy", source="s", **k):
    base = dict(score_date=dt.date(2024, 1, 1) + dt.timedelta(days=day), commodity="c", topic=topic, source_key=source, source_bucket="official_data", direction=direction, verification_status="unverified", horizon="swing", credibility=0.5, novelty=0.5, confidence=None, rumor_flag=False, cost_level=None)
    return tuple({**base, **k}.values())


def test_persistence_skips_gaps_and_stops_at_the_other_side(spark):
    rows = [event(0), event(1, "bearish"), event(2), event(5), event(6), event(30)]
    got = {r.score_date.day: r.persistence for r in G.daily_scores(spark.createDataFrame(rows, EVENT)).collect()}
    assert got[1] == 0 and got[2] == 0 and got[3] == 0
    assert math.isclose(got[6], math.exp(-3 / 5) / 2)
    assert math.isclose(got[7], (math.exp(-1 / 5) + math.exp(-4 / 5)) / 2)
    assert got[31] == 0


def test_scores_turn_with_the_directions(spark):
    rnd = random.Random(4)
    rows = [event(rnd.randrange(9), rnd.choice(["bullish", "bearish"]), rnd.choice(["a", "b"]), str(rnd.randrange(9))) for _ in range(40)]
    swap = {"bullish": "bearish", "bearish": "bullish"}
    turned = [r[:5] + (swap[r[5]],) + r[6:] for r in rows]
    cfg = G.ScoringConfig(crowd_step=0.0)
    get = lambda x: {(r.score_date, r.topic): r.narrative_score for r in G.daily_scores(spark.createDataFrame(x, EVENT), cfg).collect()}
    a, b = get(rows), get(turned)
    assert all(math.isclose(a[k], -b[k], abs_tol=1e-9) for k in a)


def test_zero_counts_as_missing(spark):
    df = spark.createDataFrame([event(0, credibility=0.0, novelty=None, confidence=0.0)], EVENT)
    assert df.select(G.event_strength()).collect()[0][0] == round(0.6 * 0.5, 6)
