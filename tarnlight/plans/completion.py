"""Survey queries: ledger, factors, the board of detectors, rule extraction in full."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tarnlight.functions import text as X
from tarnlight.operators import curves as C
from tarnlight.operators import joins as J
from tarnlight.operators import ledger as L
from tarnlight.operators import scoring as G
from tarnlight.operators import series as R
from tarnlight.plans.analytic import _CFG, _FWD, _POINTS, _STREAK, DAILY, _hits, _study
from tarnlight.plans.registry import BARS, Registry, Tables, bars, day, events, r4

q = Registry()

# ---- scans and ledger


@q("S28_quarter_ranges", "WITH b AS (SELECT date_trunc('quarter', min(CAST(price_time AS DATE)))::DATE AS a, max(CAST(price_time AS DATE)) AS z FROM market_prices) SELECT CAST(s::DATE AS VARCHAR) AS start, CAST((s + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS VARCHAR) AS stop FROM (SELECT unnest(generate_series(a::TIMESTAMP, z::TIMESTAMP, INTERVAL 3 MONTH)) AS s FROM b)")
def s28(spark, d):
    b = Tables(spark, d).market_prices.agg(F.to_date(F.date_trunc("quarter", F.min("price_time"))).alias("a"), F.max(F.to_date("price_time")).alias("z")).where("a is not null")
    x = b.select(F.explode(F.sequence("a", "z", F.expr("interval 3 months"))).alias("s"))
    return x.select(day("s").alias("start"), day(F.date_sub(F.add_months("s", 3), 1)).alias("stop"))


@q("P18_settled_only", "SELECT symbol, price_id FROM (SELECT upper(trim(symbol)) AS symbol, price_id, row_number() OVER (PARTITION BY upper(trim(symbol)) ORDER BY price_time DESC, released_at DESC, price_id) AS k FROM market_prices WHERE close IS NOT NULL AND released_at <= TIMESTAMP '2025-06-30 12:00:00' AND price_time < TIMESTAMP '2025-06-30 00:00:00') WHERE k = 1")
def p18(spark, d):
    x = Tables(spark, d).market_prices.where((F.col("released_at") <= F.lit("2025-06-30 12:00:00").cast("timestamp_ntz")) & (F.col("price_time") < F.lit("2025-06-30").cast("timestamp_ntz")) & F.col("close").isNotNull())
    order = F.struct("price_time", "released_at", -F.col("price_id"))
    return x.groupBy(F.upper(F.trim("symbol")).alias("symbol")).agg(F.max_by("price_id", order).alias("price_id"))


_EXITS = """t AS (SELECT *, CAST(plan_date AS DATE) AS d FROM paper_trades),
x AS (SELECT t.*, (SELECT min(u.d) FROM t u WHERE u.symbol = t.symbol AND u.d > t.d AND ((t.direction = 'LONG' AND u.direction = 'SHORT') OR (t.direction = 'SHORT' AND u.direction = 'LONG'))) AS exit_date FROM t)"""


def _exits(t: Tables):
    return L.with_exits(t.paper_trades.withColumn("d", F.to_date("plan_date")))


@q("P20_open_positions", f"WITH {_EXITS} SELECT trade_id, symbol, CAST(d AS VARCHAR) AS plan_date, CAST(row_number() OVER (ORDER BY d NULLS LAST, trade_id) AS INTEGER) AS place FROM x WHERE exit_date IS NULL AND symbol = 'WTI'")
def p20_open(spark, d):
    """Open trades of one symbol, oldest first."""
    x = _exits(Tables(spark, d)).where("exit_date is null and symbol = 'WTI'")
    return x.select("trade_id", "symbol", day("d").alias("plan_date"), F.row_number().over(W.partitionBy("symbol").orderBy(F.asc_nulls_last("d"), "trade_id")).alias("place"))


@q("P20_newest_trades", "SELECT trade_id, symbol, plan_date, notes IS NOT NULL AS noted FROM paper_trades ORDER BY plan_date DESC NULLS LAST, trade_id DESC LIMIT 30")
def p20_all(spark, d):
    """All trades, newest first, the limit being the feature."""
    x = Tables(spark, d).paper_trades.orderBy(F.desc_nulls_last("plan_date"), F.desc("trade_id")).limit(30)
    return x.select("trade_id", "symbol", "plan_date", F.col("notes").isNotNull().alias("noted"))


_LAST = "m AS (SELECT upper(trim(symbol)) AS symbol, arg_max(close, (price_time, released_at, -price_id)) AS close FROM market_prices WHERE close IS NOT NULL AND released_at IS NOT NULL AND price_time IS NOT NULL GROUP BY 1)"


def _latest_close(t: Tables):
    x = t.market_prices.where("close is not null and released_at is not null and price_time is not null")
    return x.groupBy(F.upper(F.trim("symbol")).alias("symbol")).agg(F.max_by("close", F.struct("price_time", "released_at", -F.col("price_id"))).alias("close"))


@q("F27_mark_to_market", f"WITH {_EXITS}, {_LAST} SELECT x.trade_id, round(CASE WHEN x.entry_close <> 0 AND m.close <> 0 THEN (m.close / x.entry_close - 1) * x.target_position END, 4) AS mtm FROM x LEFT JOIN m ON m.symbol = upper(trim(x.symbol)) WHERE x.exit_date IS NULL")
def f27(spark, d):
    t = Tables(spark, d)
    x = _exits(t).where("exit_date is null").withColumn("s", F.upper(F.trim("symbol")))
    x = x.join(_latest_close(t).withColumnRenamed("symbol", "s"), "s", "left")
    return x.select("trade_id", r4(L.mark_to_market(F.col("entry_close"), F.col("close"), F.col("target_position"))).alias("mtm"))


_CLOSED = f"""{_EXITS}, {_LAST}, e AS (SELECT symbol, d, arg_min(entry_close, trade_id) AS price FROM t WHERE entry_close IS NOT NULL GROUP BY 1, 2),
r AS (SELECT x.symbol, x.exit_date IS NULL AS open, CASE WHEN x.exit_date IS NULL THEN CASE WHEN x.entry_close <> 0 AND m.close <> 0 THEN (m.close / x.entry_close - 1) * x.target_position END ELSE CASE WHEN x.entry_close <> 0 AND e.price <> 0 THEN (e.price / x.entry_close - 1) * x.target_position END END AS made
 FROM x LEFT JOIN m ON m.symbol = upper(trim(x.symbol)) LEFT JOIN e ON e.symbol = x.symbol AND e.d = x.exit_date)"""


@q("A27_paper_stats", f"WITH {_CLOSED} SELECT symbol, CAST(count_if(open) AS BIGINT) AS open, round(sum(made) FILTER (open), 4) AS open_mtm, CAST(count_if(NOT open) AS BIGINT) AS closed, CAST(count_if(NOT open AND made > 0) AS BIGINT) AS wins, round(count_if(NOT open AND made > 0) / nullif(count_if(NOT open AND made <> 0), 0), 4) AS win_rate, round(sum(made) FILTER (NOT open), 4) AS cumulative FROM r GROUP BY 1")
def a27_stats(spark, d):
    t = Tables(spark, d)
    x = _exits(t)
    prices = x.where("entry_close is not null").groupBy(F.col("symbol").alias("ps"), F.col("d").alias("pd")).agg(F.min_by("entry_close", "trade_id").alias("price"))
    x = x.join(_latest_close(t).withColumnRenamed("symbol", "s"), F.upper(F.trim(x["symbol"])) == F.col("s"), "left").join(prices, (F.col("symbol") == F.col("ps")) & (F.col("exit_date") == F.col("pd")), "left")
    is_open = F.col("exit_date").isNull()
    made = L.mark_to_market(F.col("entry_close"), F.when(is_open, F.col("close")).otherwise(F.col("price")), F.col("target_position"))
    x = x.select("symbol", is_open.alias("o"), made.alias("made"))
    wins, decided = F.count_if(~F.col("o") & (F.col("made") > 0)), F.count_if(~F.col("o") & (F.col("made") != 0))
    return x.groupBy("symbol").agg(
        F.count_if("o").alias("open"), r4(F.sum(F.when(F.col("o"), F.col("made")))).alias("open_mtm"), F.count_if(~F.col("o")).alias("closed"), wins.alias("wins"), r4(F.try_divide(wins, decided)).alias("win_rate"), r4(F.sum(F.when(~F.col("o"), F.col("made")))).alias("cumulative")
    )


@q("F26_pnl_methods", f"WITH {BARS}, g AS (SELECT symbol, d, close, lag(close) OVER w AS before, lag(sign(close - open)) OVER w AS held FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d)) SELECT symbol, CAST(d AS VARCHAR) AS d, round(CASE WHEN before = 0 THEN 0 ELSE 1000 * held * (close / before - 1) END, 4) AS percent, round(held * (close - before) * 10, 4) AS points FROM g WHERE before IS NOT NULL")
def f26(spark, d):
    w = R.over()
    x = bars(Tables(spark, d)).withColumns({"before": F.lag("close").over(w), "held": F.lag(F.signum(F.col("close") - F.col("open"))).over(w)}).where("before is not null")
    a = L.percent_pnl(F.lit(1000.0), F.col("held"), F.col("close"), F.col("before"))
    b = L.point_pnl(F.col("held"), F.col("close"), F.col("before"), F.lit(10.0))
    return x.select("symbol", day("d").alias("d"), r4(a).alias("percent"), r4(b).alias("points"))


@q("F32_instrument_series", f"WITH {BARS} SELECT 'urgent' AS name, CAST(d AS VARCHAR) AS d, round(close, 4) AS value FROM bars WHERE symbol = '1-URGENT' UNION ALL SELECT 'urgent_high', CAST(a.d AS VARCHAR), round(a.close - b.close, 4) FROM bars a JOIN bars b USING (d) WHERE a.symbol = '1-URGENT' AND b.symbol = '2-HIGH' UNION ALL SELECT 'low_medium', CAST(a.d AS VARCHAR), round(a.close - b.close, 4) FROM bars a JOIN bars b USING (d) WHERE a.symbol = '5-LOW' AND b.symbol = '3-MEDIUM'")
def f32(spark, d):
    x = L.closes_of(bars(Tables(spark, d)), {"urgent": ("1-URGENT", None), "urgent_high": ("1-URGENT", "2-HIGH"), "low_medium": ("5-LOW", "3-MEDIUM")})
    return x.select("name", day("d").alias("d"), r4("value").alias("value"))


# ---- studies and factors


@q("A12_regime_distribution", f"WITH {_STREAK} SELECT bucket AS regime, CAST(count(DISTINCT d) FILTER (streak >= 2) AS BIGINT) AS dates, CAST(count_if(streak < 2) AS BIGINT) AS short_streaks FROM sk GROUP BY 1")
def a12_distribution(spark, d):
    x = R.streak(_study(Tables(spark, d)), "bucket")
    return x.groupBy(F.col("bucket").alias("regime")).agg(F.count_distinct(F.when(F.col("streak") >= 2, F.col("d"))).alias("dates"), F.count_if(F.col("streak") < 2).alias("short_streaks"))


_SIGNALS = f"""{_FWD}, z AS (SELECT *, (close - avg(close) OVER v) / nullif(stddev_samp(close) OVER v, 0) AS baseline, (volume - avg(volume) OVER v) / nullif(stddev_samp(volume) OVER v, 0) AS activity, count(*) OVER v AS n
 FROM f WINDOW v AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
s AS (SELECT bucket AS regime, r1, r5, baseline, 0.6 * coalesce(baseline, 0) + 0.4 * coalesce(activity, 0) AS composite FROM z WHERE n >= 5),
u AS (SELECT regime, 1 AS horizon, 'composite' AS signal, composite AS score, r1 AS r FROM s UNION ALL SELECT regime, 5, 'composite', composite, r5 FROM s UNION ALL SELECT regime, 1, 'baseline', baseline, r1 FROM s UNION ALL SELECT regime, 5, 'baseline', baseline, r5 FROM s),
h AS (SELECT *, CASE WHEN abs(score) > 0.2 AND r IS NOT NULL THEN (score > 0) = (r > 0) END AS hit FROM u)"""


@q("A19_hit_rates", f"WITH {_SIGNALS} SELECT coalesce(regime, 'overall') AS scope, horizon, signal, CAST(count(hit) AS BIGINT) AS n_trades, round(avg(hit::INT), 4) AS hit_rate, round(count(hit) / count(*), 4) AS coverage FROM h GROUP BY GROUPING SETS ((horizon, signal), (regime, horizon, signal))")
def a19(spark, d):
    """Hit rate and coverage of a composite score and of its baseline, overall and by regime."""
    n = F.count("close").over(R.over().rowsBetween(-30, -1))
    x = _study(Tables(spark, d)).withColumns({"baseline": R.rolling_z("close"), "activity": R.rolling_z("volume"), "n": n}).where("n >= 5")
    x = x.withColumn("composite", 0.6 * F.coalesce("baseline", F.lit(0.0)) + 0.4 * F.coalesce("activity", F.lit(0.0)))
    x = x.selectExpr("bucket as regime", "stack(4, 1, 'composite', composite, r1, 5, 'composite', composite, r5, 1, 'baseline', baseline, r1, 5, 'baseline', baseline, r5) as (horizon, signal, score, r)")
    x = x.withColumn("hit", L.hit(F.col("score"), F.col("r"), 0.2).cast("int")).withColumn("scope", F.explode(F.array(F.lit("overall"), "regime")))
    return x.groupBy("scope", "horizon", "signal").agg(F.count("hit").alias("n_trades"), r4(F.avg("hit")).alias("hit_rate"), r4(F.count("hit") / F.count("*")).alias("coverage"))


@q("A24_net_narrative", f"WITH {DAILY} SELECT CAST(score_date AS VARCHAR) AS score_date, commodity, round(sum(narrative_score), 4) AS net FROM daily GROUP BY 1, 2")
def a24(spark, d):
    x = G.daily_scores(events(Tables(spark, d)))
    return x.groupBy("score_date", "commodity").agg(r4(F.sum("narrative_score")).alias("net")).withColumn("score_date", day("score_date"))


@q("A26_day_summary", f"WITH {DAILY}, b AS (SELECT score_date, sum(narrative_score) AS net, arg_max(topic, (narrative_score, topic)) AS topic FROM daily GROUP BY 1), c AS (SELECT score_date, round(avg(confidence), 6) AS confidence FROM ev GROUP BY 1), n AS (SELECT score_date, source_name, row_number() OVER (PARTITION BY score_date ORDER BY count(*) DESC, source_name) AS k FROM ev WHERE source_name IS NOT NULL GROUP BY 1, 2) SELECT CAST(b.score_date AS VARCHAR) AS score_date, b.topic, round(b.net, 4) AS net, c.confidence, (SELECT string_agg(source_name, ', ' ORDER BY k) FROM n WHERE n.score_date = b.score_date AND k <= 3) AS sources FROM b JOIN c USING (score_date)")
def a26_day(spark, d):
    """Per day: leading topic, net score (its sign is the bias), mean confidence, three most frequent sources."""
    e = events(Tables(spark, d))
    b = G.daily_scores(e).groupBy("score_date").agg(F.sum("narrative_score").alias("net"), F.max_by("topic", F.struct("narrative_score", "topic")).alias("topic"))
    c = e.groupBy("score_date").agg(F.round(F.avg("confidence"), 6).alias("confidence"))
    n = J.latest(e.where("source_name is not null").groupBy("score_date", "source_name").agg(F.count("*").alias("n")), ["score_date"], [F.desc("n"), F.asc("source_name")], 3)
    n = n.groupBy("score_date").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "source_name"))), lambda x: x["source_name"]), ", ").alias("sources"))
    return b.join(c, "score_date").join(n, "score_date", "left").select(day("score_date").alias("score_date"), "topic", r4("net").alias("net"), "confidence", "sources")


@q("A29_inventory_factor", """WITH s AS (SELECT o_orderstatus AS symbol, CAST(o_orderdate AS DATE) AS d, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1, 2),
p AS (SELECT a.symbol, a.d, a.v, count(*) AS n, avg(b.v) AS m, stddev_pop(b.v) AS sd FROM s a JOIN s b ON a.symbol = b.symbol AND b.d < a.d AND b.d >= a.d - 1855 AND least(abs(dayofyear(a.d) - dayofyear(b.d)), 365 - abs(dayofyear(a.d) - dayofyear(b.d))) <= 7 GROUP BY ALL)
SELECT CAST(d AS VARCHAR) AS d, round(-avg((v - m) / sd), 4) AS factor, CAST(count(*) AS BIGINT) AS series FROM p WHERE n >= 3 AND sd > 0 GROUP BY 1""")
def a29(spark, d):
    """Equal-weight mean of the seasonal z of several series, high stocks counting as negative."""
    s = Tables(spark, d).orders.groupBy(F.col("o_orderstatus").alias("symbol"), F.to_date("o_orderdate").alias("d")).agg(F.count("*").cast("double").alias("close"))
    return J.seasonal_z(s).groupBy(day("d").alias("d")).agg(r4(-F.avg("z")).alias("factor"), F.count("*").alias("series"))


@q("A30_positioning_factor", f"WITH {BARS}, w AS (SELECT symbol, d, close, count(*) OVER w AS n, avg(close) OVER w AS m, stddev_pop(close) OVER w AS sd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW)), z AS (SELECT *, CASE WHEN sd > 0 THEN (close - m) / sd ELSE 0 END AS z FROM w WHERE n >= 30) SELECT symbol, CAST(d AS VARCHAR) AS d, round(CASE WHEN abs(z) <= 1 THEN 0 ELSE -sign(z) * (abs(z) - 1) END, 4) AS factor FROM z")
def a30_factor(spark, d):
    """Contrarian beyond a deadband: nothing within one deviation, against the extreme by what is beyond it."""
    b = bars(Tables(spark, d))
    z = F.col("z")
    x = b.withColumn("z", J.trailing_z(b, 90, 30)).where("z is not null")
    return x.select("symbol", day("d").alias("d"), r4(F.when(F.abs(z) <= 1, 0.0).otherwise(-F.signum(z) * (F.abs(z) - 1))).alias("factor"))


_SPREAD_Z = f"{BARS}, sp AS (SELECT a.d, a.close - b.close AS v FROM bars a JOIN bars b USING (d) WHERE a.symbol = '1-URGENT' AND b.symbol = '2-HIGH'), w AS (SELECT d, v, count(*) OVER w AS n, avg(v) OVER w AS m, stddev_pop(v) OVER w AS sd FROM sp WINDOW w AS (ORDER BY d RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW))"


@q("A31_term_structure_factor", f"WITH {_SPREAD_Z} SELECT CAST(d AS VARCHAR) AS d, round(CASE WHEN sd > 0 THEN (v - m) / sd ELSE 0 END, 4) AS z FROM w WHERE n >= 30")
def a31(spark, d):
    """Trailing z of the spread of two series."""
    s = L.closes_of(bars(Tables(spark, d)), {"spread": ("1-URGENT", "2-HIGH")})
    return s.withColumn("z", J.trailing_z(s, 90, 30, by="name", value="value")).where("z is not null").select(day("d").alias("d"), r4("z").alias("z"))


@q("A32_composite_breakdown", f"WITH {BARS}, z AS (SELECT symbol, d, coalesce((close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0), 0) AS level, coalesce((volume - avg(volume) OVER w) / nullif(stddev_samp(volume) OVER w, 0), 0) AS activity, count(*) OVER w AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)), c AS (SELECT *, CASE symbol WHEN '1-URGENT' THEN 0.6 WHEN '2-HIGH' THEN 0.5 ELSE 0.7 END::DOUBLE AS wl, CASE symbol WHEN '1-URGENT' THEN 0.4 WHEN '2-HIGH' THEN 0.5 ELSE 0.3 END::DOUBLE AS wa FROM z WHERE n >= 5) SELECT symbol, CAST(d AS VARCHAR) AS d, round(wl * level + wa * activity, 4) AS composite, round(wl * level, 4) AS level_part, round(wa * activity, 4) AS activity_part FROM c")
def a32_breakdown(spark, d):
    """Weights by symbol, with a default set for symbols without their own, and what each factor contributes."""
    rows = [("1-URGENT", "level", 0.6), ("1-URGENT", "activity", 0.4), ("2-HIGH", "level", 0.5), ("2-HIGH", "activity", 0.5)]
    own = F.broadcast(spark.createDataFrame(rows, "symbol string, factor string, own double"))  # a table of weights, fixed
    x = bars(Tables(spark, d)).withColumns({"level": R.rolling_z("close"), "activity": R.rolling_z("volume"), "n": F.count("close").over(R.over().rowsBetween(-30, -1))}).where("n >= 5")
    y = x.selectExpr("symbol", "d", "stack(2, 'level', level, 0.7D, 'activity', activity, 0.3D) AS (factor, value, fallback)").join(own, ["symbol", "factor"], "left")
    part = F.coalesce("own", "fallback") * F.coalesce("value", F.lit(0.0))
    g = y.withColumn("part", part).groupBy("symbol", "d").agg(F.sum("part").alias("composite"), F.map_from_entries(F.collect_list(F.struct("factor", "part"))).alias("parts"))
    return g.select("symbol", day("d").alias("d"), r4("composite").alias("composite"), r4(F.col("parts")["level"]).alias("level_part"), r4(F.col("parts")["activity"]).alias("activity_part"))


@q("W15_tail_z_at_date", f"WITH {BARS}, t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS k FROM bars WHERE d <= DATE '1997-06-30') SELECT symbol, CAST(max(d) AS VARCHAR) AS d, CAST(count(*) AS BIGINT) AS n, round((max(close) FILTER (k = 1) - avg(close) FILTER (k > 1)) / nullif(stddev_samp(close) FILTER (k > 1), 0), 4) AS z FROM t WHERE k <= 31 GROUP BY 1 HAVING count(*) >= 6")
def w15(spark, d):
    """z of the last reading at or before a date against the 30 before it."""
    t = J.latest(bars(Tables(spark, d)).where("d <= date'1997-06-30'"), ["symbol"], [F.desc("d")], 31)
    prior = F.when(F.col("k") > 1, F.col("close"))
    z = F.try_divide(F.max(F.when(F.col("k") == 1, F.col("close"))) - F.avg(prior), F.nullif(F.stddev_samp(prior), F.lit(0.0)))
    return t.groupBy("symbol").agg(day(F.max("d")).alias("d"), F.count("*").alias("n"), r4(z).alias("z")).where("n >= 6")


# ---- the board

_PROV = f"{_POINTS}, h AS (SELECT *, count(*) OVER w AS seen, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, row_number() OVER (PARTITION BY source, spread, n ORDER BY obs_date DESC) AS k FROM pt WINDOW w AS (PARTITION BY source, spread, n ORDER BY obs_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), pz AS (SELECT obs_date, source, spread, n, (value - m) / sd AS z FROM h WHERE k = 1 AND seen >= 7 AND sd >= 1e-6 AND abs((value - m) / sd) >= 1)"


@q("W23_provisional_z", f"WITH {_PROV} SELECT obs_date, source, spread, n, round(z, 3) AS z FROM pz")
def w23(spark, d):
    return C.provisional_z(C.curve(Tables(spark, d).rv_quotes)).select("obs_date", "source", "spread", "n", F.round("z", 3).alias("z"))


@q("A33_board_by_severity", f"""WITH {_PROV}, l AS (SELECT max(obs_date) AS o FROM pt), v AS (SELECT obs_date, spread, contract, source, arg_max(value, quote_id) AS value FROM rv_quotes WHERE value IS NOT NULL AND contract IS NOT NULL GROUP BY 1, 2, 3, 4),
d AS (SELECT 'butterfly' AS angle, a.obs_date, a.source, a.spread, abs(b.value - 2 * a.value + c.value) AS severity FROM pt a JOIN pt b ON b.obs_date = a.obs_date AND b.source = a.source AND b.spread = a.spread AND b.n = a.n - 1 JOIN pt c ON c.obs_date = a.obs_date AND c.source = a.source AND c.spread = a.spread AND c.n = a.n + 1 WHERE a.n >= 3 AND abs(b.value - 2 * a.value + c.value) >= 0.3
 UNION ALL SELECT 'gap', o.obs_date, o.source, o.spread, abs(p.value - o.value) FROM v o JOIN v p USING (obs_date, spread, contract) WHERE p.source = 'PVM' AND o.source <> 'PVM' AND abs(p.value - o.value) >= 0.2
 UNION ALL SELECT 'rich_cheap', obs_date, source, spread, abs(z) FROM pz
 UNION ALL SELECT 'shape', obs_date, source, spread, abs(arg_max(value, n) - arg_min(value, n)) FROM pt GROUP BY 2, 3, 4 HAVING count(*) >= 2)
SELECT angle, obs_date, source, spread, round(severity, 4) AS severity, CAST(rank() OVER (PARTITION BY angle ORDER BY round(severity, 4) DESC) AS INTEGER) AS place FROM d WHERE obs_date = (SELECT o FROM l)""")
def a33_full(spark, d):
    """All four detectors at the latest date of the curves, each by severity."""
    x = C.board(Tables(spark, d).rv_quotes, "PVM").withColumn("severity", r4("severity"))
    return x.withColumn("place", F.rank().over(W.partitionBy("angle").orderBy(F.desc("severity"))))


# ---- rule extraction in full

_RUMOR, _CONFIRM, _MEDIUM = ("unconfirmed", "rumor", "sources say"), ("official statement", "ministry", "announced"), ("next year", "quarters", "long term", "turnaround")
_REGIONS = {"north_sea": ("brent", "north sea"), "middle_east": ("dubai", "murban", "gulf"), "us": ("wti", "cushing"), "singapore": ("380cst", "singapore")}
_ENTITIES = ("WTI", "Brent", "Dubai", "Murban", "gasoil", "naphtha", "jet", "fuel oil", "OPEC", "EIA", "IEA", "Cushing", "Rotterdam", "Singapore")
_ANY = lambda ws: f"({_hits(ws)}) > 0"
_RULED = f"""r AS (SELECT d.doc_id, d.source, d.text, s.source_name, coalesce(d.source = 'social_private_manual', false) OR {_ANY(_RUMOR)} AS rumor FROM documents d LEFT JOIN sources s USING (source_id) WHERE d.text IS NOT NULL),
v AS (SELECT *, CASE WHEN source IN ('official_data', 'official_reports') OR {_ANY(_CONFIRM)} THEN 'officially_confirmed' WHEN rumor THEN 'unverified' ELSE 'partially_confirmed' END AS verification, CASE WHEN {_ANY(_MEDIUM)} THEN 'medium_term' ELSE 'swing' END AS horizon,
 CASE source WHEN 'official_data' THEN 0.95 WHEN 'official_reports' THEN 0.92 WHEN 'institutional_public' THEN 0.84 WHEN 'sellside_private' THEN 0.80 WHEN 'authoritative_news' THEN 0.72 WHEN 'social_open' THEN 0.45 WHEN 'social_private_manual' THEN 0.30 ELSE 0.50 END::DOUBLE - CASE WHEN rumor THEN 0.12 ELSE 0 END::DOUBLE AS base FROM r)"""


def _ruled(t: Tables):
    s = F.broadcast(t.sources.select("source_id", "source_name"))  # 60 rows, fixed
    return t.documents.where("text is not null").select("doc_id", "source", "source_id", "text").join(s, "source_id", "left")


@q("F10_F12_verification_credibility", f"WITH {_RULED} SELECT doc_id, rumor, verification, horizon, round(greatest(0.05, least(1.0, CASE WHEN lower(source_name) IN ('eia', 'opec', 'ofac') THEN greatest(base, 0.93) ELSE base END)), 4)::DOUBLE AS credibility FROM v")
def f10_full(spark, d):
    x, t = _ruled(Tables(spark, d)), F.col("text")
    rumor = X.is_rumor(t, F.col("source"), _RUMOR)
    x = x.withColumn("rumor", rumor)
    return x.select("doc_id", "rumor", X.verification(t, F.col("source"), F.col("rumor"), _CONFIRM).alias("verification"), X.horizon(t, _MEDIUM).alias("horizon"), r4(X.credibility(F.col("source"), F.col("source_name"), F.col("rumor"))).alias("credibility"))


@q("F11_regions_entities", "SELECT doc_id, coalesce(nullif(array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_ANY(ws)} THEN '{r}' END" for r, ws in _REGIONS.items()) + "], lambda x: x IS NOT NULL), ','), ''), 'global') AS regions, array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{e.lower()}') THEN '{e}' END" for e in _ENTITIES) + "], lambda x: x IS NOT NULL)[1:12], ',') AS entities FROM documents WHERE text IS NOT NULL")
def f11_full(spark, d):
    t = F.col("text")
    return Tables(spark, d).documents.where("text is not null").select("doc_id", F.array_join(X.regions(t, _REGIONS), ",").alias("regions"), F.array_join(X.present(t, _ENTITIES, 12), ",").alias("entities"))


QUERIES, SQL = q.queries, q.sql
