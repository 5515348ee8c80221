"""Survey queries: aggregations, windows, scalar functions, curves."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tarnlight.functions import dates as D
from tarnlight.functions import text as X
from tarnlight.operators import curves as C
from tarnlight.operators import joins as J
from tarnlight.operators import scoring as G
from tarnlight.operators import series as R
from tarnlight.plans.registry import BARS, EVENTS, Registry, Tables, bars, day, events, r4

q = Registry()


def _case(c: str, table: dict, default) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)"
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in table.items()) + f" ELSE {lit(default)} END"


_CFG = G.ScoringConfig()
_CRED, _NOV = "coalesce(nullif(credibility, 0), 0.5)", "coalesce(nullif(novelty, 0), 0.5)"
_QUALITY = f"(CAST(0.45 AS DOUBLE) * {_CRED} + CAST(0.35 AS DOUBLE) * {_NOV} + CAST(0.20 AS DOUBLE) * coalesce(nullif(confidence, 0), ({_CRED} + {_NOV}) / 2))"
STRENGTH = f"""{EVENTS}, st AS (SELECT *, {_case("direction", _CFG.sign, 0.0)} AS sgn,
 round({_case("direction", _CFG.sign, 0.0)} * {_case("source_bucket", _CFG.bucket, 0.5)} * {_case("verification_status", _CFG.verification, 0.7)} * {_case("horizon", _CFG.horizon, 1.0)} * {_QUALITY}
 * CASE WHEN rumor_flag THEN CAST(0.82 AS DOUBLE) ELSE 1 END * CASE WHEN verification_status = 'officially_confirmed' THEN CAST(1.12 AS DOUBLE) ELSE 1 END * CASE WHEN cost_level = 'free' THEN CAST(1.05 AS DOUBLE) ELSE 1 END, 6) AS strength FROM ev)"""
_INF = "source_bucket IN ('institutional_public', 'sellside_private', 'social_open', 'social_private_manual')"
DAILY = f"""{STRENGTH}, cell AS (SELECT score_date, commodity, topic, count(*) AS event_count, sum(strength) AS raw_score, sign(sum(sgn)) AS net_sign,
 least(1.0::DOUBLE, count(DISTINCT source_key) / 5.0::DOUBLE) AS breadth,
 coalesce(abs(avg(sgn) FILTER (source_bucket IN ('official_data', 'official_reports')) - avg(sgn) FILTER ({_INF})) / 2, 0) AS source_divergence,
 avg(coalesce(verification_status = 'officially_confirmed', false)::INT) AS confirmed_ratio, avg(coalesce(source_bucket = 'authoritative_news', false)::INT) AS news_ratio,
 avg(coalesce(source_bucket LIKE 'social%', false)::INT) AS chatter_ratio FROM st GROUP BY 1, 2, 3),
pr AS (SELECT a.score_date, a.commodity, a.topic, a.score_date - b.score_date AS off, b.net_sign * a.net_sign AS same FROM cell a JOIN cell b ON a.commodity IS NOT DISTINCT FROM b.commodity AND a.topic IS NOT DISTINCT FROM b.topic AND b.score_date < a.score_date AND b.score_date >= a.score_date - 20),
sp AS (SELECT *, min(CASE WHEN same <= 0 THEN off END) OVER (PARTITION BY score_date, commodity, topic) AS stop FROM pr),
ps AS (SELECT score_date, commodity, topic, least(1.0::DOUBLE, coalesce(sum(exp(-off / 5.0::DOUBLE)) FILTER (off < coalesce(stop, 21)), 0) / 2) AS p FROM sp GROUP BY 1, 2, 3),
daily AS (SELECT c.*, CASE WHEN c.net_sign = 0 THEN 0 ELSE coalesce(ps.p, 0) END AS persistence, raw_score * (1 + 0.25::DOUBLE * CASE WHEN c.net_sign = 0 THEN 0 ELSE coalesce(ps.p, 0) END) * (1 + 0.40::DOUBLE * breadth) - greatest(0, event_count - 4) * 0.04::DOUBLE AS narrative_score
 FROM cell c LEFT JOIN ps USING (score_date, commodity, topic))"""


@q("A01_event_strength", f"WITH {STRENGTH} SELECT event_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS at, round(strength, 4) AS strength FROM st")
def a01(spark, d):
    return events(Tables(spark, d)).select("event_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("at"), r4(G.event_strength()).alias("strength"))


_DAILY_OUT = "CAST(score_date AS VARCHAR) AS score_date, commodity, topic, CAST(event_count AS BIGINT) AS event_count"


@q("A02_A07_daily_topic_score", f"WITH {DAILY} SELECT {_DAILY_OUT}, round(raw_score, 4) AS raw_score, round(narrative_score, 4) AS narrative_score, round(breadth, 4) AS breadth FROM daily")
def a02(spark, d):
    x = G.daily_scores(events(Tables(spark, d)))
    return x.select(day("score_date").alias("score_date"), "commodity", "topic", "event_count", *[r4(c).alias(c) for c in ("raw_score", "narrative_score", "breadth")])


@q("A04_J10_persistence", f"WITH {DAILY} SELECT {_DAILY_OUT}, round(persistence, 4) AS persistence FROM daily")
def a04(spark, d):
    return G.daily_scores(events(Tables(spark, d))).select(day("score_date").alias("score_date"), "commodity", "topic", "event_count", r4("persistence").alias("persistence"))


@q("A05_A06_divergence_shares", f"WITH {DAILY} SELECT {_DAILY_OUT}, round(source_divergence, 4) AS source_divergence, round(confirmed_ratio, 4) AS confirmed_ratio, round(news_ratio, 4) AS news_ratio, round(chatter_ratio, 4) AS chatter_ratio FROM daily")
def a05(spark, d):
    x = G.daily_scores(events(Tables(spark, d)))
    return x.select(day("score_date").alias("score_date"), "commodity", "topic", "event_count", *[r4(c).alias(c) for c in ("source_divergence", "confirmed_ratio", "news_ratio", "chatter_ratio")])


_THEME = _case("topic", {t: k for k, ts in G.THEMES.items() for t in ts}, "other")


@q("A08_theme_rollup", f"WITH {DAILY} SELECT CAST(score_date AS VARCHAR) AS score_date, commodity, {_THEME} AS theme, round(sum(narrative_score), 4) AS narrative_score, CAST(sum(event_count) AS BIGINT) AS event_count, CAST(count(*) AS BIGINT) AS subtheme_count, round(sum(persistence * event_count) / sum(event_count), 4) AS persistence, round(sum(breadth * event_count) / sum(event_count), 4) AS breadth FROM daily GROUP BY 1, 2, 3")
def a08(spark, d):
    x = G.theme_rollup(G.daily_scores(events(Tables(spark, d))))
    return x.select(day("score_date").alias("score_date"), "commodity", "theme", r4("narrative_score").alias("narrative_score"), "event_count", "subtheme_count", r4("persistence").alias("persistence"), r4("breadth").alias("breadth"))


@q("A09_top_subthemes", f"WITH {DAILY} SELECT CAST(score_date AS VARCHAR) AS score_date, {_THEME} AS theme, array_to_string((list(topic ORDER BY abs(round(narrative_score, 6)) DESC, topic))[1:5], ',') AS topics FROM daily WHERE commodity = 'crude_oil' GROUP BY 1, 2")
def a09(spark, d):
    x = G.daily_scores(events(Tables(spark, d))).where("commodity = 'crude_oil'").withColumn("narrative_score", F.round("narrative_score", 6))
    return G.theme_rollup(x).select(day("score_date").alias("score_date"), "theme", F.array_join(F.transform("top_subthemes", lambda y: y["topic"]), ",").alias("topics"))


@q("A10_weighted_sum_breakdown", f"WITH {DAILY} SELECT CAST(score_date AS VARCHAR) AS score_date, round(sum(narrative_score * {_case(_THEME, {'supply': 1.0, 'demand': 1.0, 'inventories': 0.8, 'macro': 0.6, 'geopolitics': 1.2}, 1.0)}), 4) AS total, CAST(count(DISTINCT {_THEME}) AS BIGINT) AS themes FROM daily GROUP BY 1")
def a10(spark, d):
    x = G.theme_rollup(G.daily_scores(events(Tables(spark, d))))
    w = G.lookup(F.col("theme"), {"supply": 1.0, "demand": 1.0, "inventories": 0.8, "macro": 0.6, "geopolitics": 1.2}, 1.0)
    g = x.groupBy("score_date").agg(r4(F.sum(F.col("narrative_score") * w)).alias("total"), F.count_distinct("theme").alias("themes"))
    return g.select(day("score_date").alias("score_date"), "total", "themes")


_FWD = f"""{BARS}, f AS (SELECT *, lead(close, 1) OVER w / close - 1 AS r1, lead(close, 5) OVER w / close - 1 AS r5, ntile_b AS bucket FROM (SELECT *, CASE WHEN close >= high THEN 'at_high' WHEN close <= low THEN 'at_low' ELSE 'inside' END AS ntile_b FROM bars) WINDOW w AS (PARTITION BY symbol ORDER BY d))"""


def _study(t: Tables):
    b = bars(t).withColumns({"r1": R.forward_return(1), "r5": R.forward_return(5)})
    return b.withColumn("bucket", F.when(F.col("close") >= F.col("high"), "at_high").when(F.col("close") <= F.col("low"), "at_low").otherwise("inside"))


@q("A11_bucket_study", f"WITH {_FWD} SELECT bucket, h AS horizon, CAST(count(r) AS BIGINT) AS n, round(avg(r), 4) AS mean_return, round(avg((r > 0)::INT), 4) AS hit_rate FROM (SELECT bucket, 1 AS h, r1 AS r FROM f UNION ALL SELECT bucket, 5, r5 FROM f) WHERE r IS NOT NULL GROUP BY 1, 2")
def a11(spark, d):
    x = _study(Tables(spark, d)).selectExpr("bucket", "stack(2, 1, r1, 5, r5) AS (horizon, r)").where("r is not null")
    return x.groupBy("bucket", "horizon").agg(F.count("r").alias("n"), r4(F.avg("r")).alias("mean_return"), r4(F.avg((F.col("r") > 0).cast("int"))).alias("hit_rate"))


_STREAK = f"""{_FWD}, ch AS (SELECT *, CASE WHEN lag(bucket) OVER w = bucket THEN 0 ELSE 1 END AS nw FROM f WINDOW w AS (PARTITION BY symbol ORDER BY d)), isl AS (SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY d) AS island FROM ch), sk AS (SELECT *, row_number() OVER (PARTITION BY symbol, island ORDER BY d) AS streak FROM isl)"""


@q("A12_conditional_study", f"WITH {_STREAK} SELECT symbol, bucket, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT d) AS BIGINT) AS dates, round(avg(r5), 4) AS mean_r5 FROM sk WHERE streak >= 2 AND r5 IS NOT NULL GROUP BY 1, 2")
def a12(spark, d):
    x = R.streak(_study(Tables(spark, d)), "bucket").where("streak >= 2 and r5 is not null")
    return x.groupBy("symbol", "bucket").agg(F.count("*").alias("n"), F.count_distinct("d").alias("dates"), r4(F.avg("r5")).alias("mean_r5"))


@q("A13_Y05_hypotheses", f"WITH {_FWD} SELECT 'closes_high' AS name, CAST(count(*) AS BIGINT) AS n, round(avg(r5), 4) AS mean_return FROM (SELECT DISTINCT symbol, d, r5 FROM f WHERE close = high AND volume >= 2 AND r5 IS NOT NULL) UNION ALL SELECT 'quiet', CAST(count(*) AS BIGINT), round(avg(r5), 4) FROM (SELECT DISTINCT symbol, d, r5 FROM f WHERE high = low AND r5 IS NOT NULL)")
def a13(spark, d):
    x = _study(Tables(spark, d)).where("r5 is not null")
    rules = {"closes_high": (F.col("close") == F.col("high")) & (F.col("volume") >= 2), "quiet": F.col("high") == F.col("low")}
    named = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()])))
    y = x.select("symbol", "d", "r5", named.alias("name")).distinct()
    return y.groupBy("name").agg(F.count("*").alias("n"), r4(F.avg("r5")).alias("mean_return"))


@q("A14_peer_agreement", f"WITH {_FWD} SELECT symbol, CAST(d AS VARCHAR) AS d, round((count(*) OVER (PARTITION BY d, bucket) - 1) / (count(*) OVER (PARTITION BY d) - 1)::DOUBLE, 4) AS agreement FROM (SELECT *, count(*) OVER (PARTITION BY d) AS m FROM f) WHERE m >= 2")
def a14(spark, d):
    x = _study(Tables(spark, d))
    m, same = F.count("*").over(W.partitionBy("d")), F.count("*").over(W.partitionBy("d", "bucket"))
    x = x.withColumns({"m": m, "same": same}).where("m >= 2")
    return x.select("symbol", day("d").alias("d"), r4((F.col("same") - 1) / (F.col("m") - 1)).alias("agreement"))


_EQ = f"""{BARS}, p AS (SELECT symbol, d, close, CASE WHEN close > open THEN 1.0 WHEN close < open THEN -1.0 ELSE 0.0 END::DOUBLE AS pos FROM bars),
g AS (SELECT *, coalesce(lag(pos) OVER w, 0) AS before, coalesce(close / lag(close) OVER w - 1, 0) AS ret FROM p WINDOW w AS (PARTITION BY symbol ORDER BY d)),
e AS (SELECT *, abs(pos - before) AS turn, before * ret * 0.01 - abs(pos - before) * 0.0005 AS pnl FROM g),
c AS (SELECT *, 100 + 100 * sum(pnl) OVER (PARTITION BY symbol ORDER BY d) AS additive, product(1 + pnl) OVER (PARTITION BY symbol ORDER BY d) AS grown FROM e)"""


def _equity(t: Tables):
    pos = F.when(F.col("close") > F.col("open"), 1.0).when(F.col("close") < F.col("open"), -1.0).otherwise(0.0)
    x = bars(t).withColumn("pos", pos)
    w = R.over()
    x = x.withColumns({"before": F.coalesce(F.lag("pos").over(w), F.lit(0.0)), "ret": F.coalesce(F.try_divide(F.col("close"), F.lag("close").over(w)) - 1, F.lit(0.0)), "turn": R.turnover("pos")})
    x = x.withColumn("pnl", F.col("before") * F.col("ret") * 0.01 - F.col("turn") * 0.0005)
    return x.withColumns({"additive": 100 + 100 * R.running_sum(F.col("pnl")), "grown": R.compounded(1 + F.col("pnl"))})


@q("W16_W17_W20_equity", f"WITH {_EQ} SELECT symbol, CAST(d AS VARCHAR) AS d, round(turn, 4) AS turn, round(additive, 4) AS additive, round(grown, 4) AS grown FROM c")
def w16(spark, d):
    return _equity(Tables(spark, d)).select("symbol", day("d").alias("d"), r4("turn").alias("turn"), r4("additive").alias("additive"), r4("grown").alias("grown"))


@q("A15_portfolio_curve", f"WITH {_EQ} SELECT CAST(d AS VARCHAR) AS d, round(sum(additive), 4) AS equity, CAST(count(*) AS BIGINT) AS books FROM c GROUP BY 1")
def a15(spark, d):
    return _equity(Tables(spark, d)).groupBy(day("d").alias("d")).agg(r4(F.sum("additive")).alias("equity"), F.count("*").alias("books"))


@q("A16_A17_curve_summary", f"WITH {_EQ}, dd AS (SELECT *, grown / max(grown) OVER (PARTITION BY symbol ORDER BY d) - 1 AS down FROM c) SELECT symbol, CAST(count(*) AS BIGINT) AS days, CAST(sum((turn > 0)::INT) AS BIGINT) AS trades, round(avg((pnl > 0)::INT), 4) AS positive_days, round(min(down), 4) AS worst, round(avg(pnl) / stddev_pop(pnl) * sqrt(252), 4) AS sharpe FROM dd GROUP BY 1")
def a16(spark, d):
    x = _equity(Tables(spark, d)).withColumn("down", R.drawdown("grown"))
    sharpe = F.try_divide(F.avg("pnl"), F.nullif(F.stddev_pop("pnl"), F.lit(0.0))) * F.sqrt(F.lit(252.0))
    return x.groupBy("symbol").agg(F.count("*").alias("days"), F.sum((F.col("turn") > 0).cast("int")).alias("trades"), r4(F.avg((F.col("pnl") > 0).cast("int"))).alias("positive_days"), r4(F.min("down")).alias("worst"), r4(sharpe).alias("sharpe"))


@q("W19_drawdown", f"WITH {_EQ} SELECT symbol, CAST(d AS VARCHAR) AS d, round(grown / max(grown) OVER (PARTITION BY symbol ORDER BY d) - 1, 4) AS down FROM c")
def w19(spark, d):
    return _equity(Tables(spark, d)).select("symbol", day("d").alias("d"), r4(R.drawdown("grown")).alias("down"))


@q("A18_grouped_trade_stats", "SELECT regime, CAST(count(*) AS BIGINT) AS n, CAST(sum((direction = 'LONG')::INT) AS BIGINT) AS longs, round(avg(composite_score), 4) AS mean_score FROM paper_trades GROUP BY 1")
def a18(spark, d):
    return Tables(spark, d).paper_trades.groupBy("regime").agg(F.count("*").alias("n"), F.sum((F.col("direction") == "LONG").cast("int")).alias("longs"), r4(F.avg("composite_score")).alias("mean_score"))


@q("A20_recent_themes", f"WITH {STRENGTH} SELECT topic, round(sum(strength), 4) AS net, CAST(count(*) AS BIGINT) AS n FROM st WHERE score_date >= DATE '2025-01-01' GROUP BY 1 ORDER BY abs(sum(strength)) DESC, 1 LIMIT 8")
def a20(spark, d):
    e = events(Tables(spark, d)).where("score_date >= date'2025-01-01'").withColumn("s", G.event_strength())
    g = e.groupBy("topic").agg(F.sum("s").alias("net"), F.count("*").alias("n"))
    return g.orderBy(F.abs("net").desc(), "topic").limit(8).select("topic", r4("net").alias("net"), "n")


@q("A21_calendar_coverage", "WITH c AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-03-31', INTERVAL 1 DAY))::DATE AS d), n AS (SELECT CAST(ingested_at AS DATE) AS d, count(*) AS n FROM documents GROUP BY 1) SELECT CAST(c.d AS VARCHAR) AS d, coalesce(n.n, 0) AS n, CASE WHEN coalesce(n.n, 0) = 0 THEN 'EMPTY' WHEN n.n < 2 THEN 'THIN' ELSE 'OK' END AS state FROM c LEFT JOIN n USING (d)")
def a21(spark, d):
    c = spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-03-31").cast("date"))).alias("d"))
    n = Tables(spark, d).documents.groupBy(F.to_date("ingested_at").alias("d")).agg(F.count("*").alias("n"))
    x = c.join(n, "d", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return x.select(day("d").alias("d"), "n", F.when(F.col("n") == 0, "EMPTY").when(F.col("n") < 2, "THIN").otherwise("OK").alias("state"))


@q("A22_bucket_counts", "SELECT source, strftime(ingested_at, '%Y-%m-%d') AS d, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1, 2")
def a22(spark, d):
    return Tables(spark, d).documents.groupBy("source", day("ingested_at").alias("d")).agg(F.count("*").alias("n"))


@q("A23_counts", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT obs_date) AS BIGINT) AS dates, max(obs_date) AS latest, bool_or(source = 'PVM') AS has_pvm FROM rv_quotes")
def a23(spark, d):
    return Tables(spark, d).rv_quotes.agg(F.count("*").alias("n"), F.count_distinct("obs_date").alias("dates"), F.max("obs_date").alias("latest"), F.bool_or(F.col("source") == "PVM").alias("has_pvm"))


@q("A25_bucket_contribution", f"WITH {STRENGTH} SELECT {_THEME} AS theme, source_bucket, round(sum(sgn * confidence), 6) AS contribution FROM st GROUP BY 1, 2")
def a25(spark, d):
    e = events(Tables(spark, d))
    return e.groupBy(G.theme_of(F.col("topic")).alias("theme"), "source_bucket").agg(F.round(F.sum(G.lookup(F.col("direction"), _CFG.sign, 0.0) * F.col("confidence")), 6).alias("contribution"))


@q("A26_top_sources", "SELECT topic, source_name, CAST(k AS INTEGER) AS k, CAST(n AS BIGINT) AS n FROM (SELECT topic, source_name, count(*) AS n, row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, source_name) AS k FROM narrative_events GROUP BY 1, 2) WHERE k <= 3")
def a26(spark, d):
    g = Tables(spark, d).narrative_events.groupBy("topic", "source_name").agg(F.count("*").alias("n"))
    return J.latest(g, ["topic"], [F.desc("n"), F.asc_nulls_last("source_name")], 3).select("topic", "source_name", "k", "n")


@q("A27_ledger_stats", "SELECT symbol, CAST(count(*) AS BIGINT) AS n, CAST(sum((target_position <> 0)::INT) AS BIGINT) AS active, round(sum(target_position), 4) AS net, round(avg(entry_close), 4) AS mean_entry FROM paper_trades GROUP BY 1")
def a27(spark, d):
    return Tables(spark, d).paper_trades.groupBy("symbol").agg(F.count("*").alias("n"), F.sum((F.col("target_position") != 0).cast("int")).alias("active"), r4(F.sum("target_position")).alias("net"), r4(F.avg("entry_close")).alias("mean_entry"))


@q("A28_value_counts", "SELECT topic, verification_status, CAST(count(*) AS BIGINT) AS n FROM narrative_events GROUP BY 1, 2")
def a28(spark, d):
    return Tables(spark, d).narrative_events.groupBy("topic", "verification_status").agg(F.count("*").alias("n"))


@q("A30_trailing_z", f"WITH {BARS}, w AS (SELECT symbol, d, close, count(*) OVER w AS n, avg(close) OVER w AS m, stddev_pop(close) OVER w AS sd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW)) SELECT symbol, CAST(d AS VARCHAR) AS d, round(CASE WHEN sd > 0 THEN (close - m) / sd ELSE 0 END, 4) AS z FROM w WHERE n >= 30")
def a30(spark, d):
    b = bars(Tables(spark, d))
    return b.withColumn("z", J.trailing_z(b, 90, 30)).where("z is not null").select("symbol", day("d").alias("d"), r4("z").alias("z"))


@q("A32_weighted_factors", f"WITH {BARS}, z AS (SELECT symbol, d, (close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0) AS level, (volume - avg(volume) OVER w) / nullif(stddev_samp(volume) OVER w, 0) AS activity, count(*) OVER w AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) SELECT symbol, CAST(d AS VARCHAR) AS d, round(0.6 * coalesce(level, 0) + 0.4 * coalesce(activity, 0), 4) AS composite FROM z WHERE n >= 5")
def a32(spark, d):
    x = bars(Tables(spark, d)).withColumns({"level": R.rolling_z("close"), "activity": R.rolling_z("volume"), "n": F.count("close").over(R.over().rowsBetween(-30, -1))}).where("n >= 5")
    y = x.selectExpr("symbol", "d", "stack(2, 'level', level, 0.6D, 'activity', activity, 0.4D) AS (factor, value, weight)")
    return y.groupBy("symbol", "d").agg(r4(F.sum(F.col("weight") * F.coalesce("value", F.lit(0.0)))).alias("composite")).withColumn("d", day("d"))


# ---- windows (W)


@q("W04_percent_b", f"WITH {BARS} SELECT symbol, CAST(d AS VARCHAR) AS d, round(CASE WHEN count(*) OVER w >= 20 AND stddev_pop(close) OVER w > 0 THEN (close - avg(close) OVER w + 2 * stddev_pop(close) OVER w) / (4 * stddev_pop(close) OVER w) ELSE 0.5 END, 4) AS pctb FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def w04(spark, d):
    return bars(Tables(spark, d)).select("symbol", day("d").alias("d"), r4(R.percent_b()).alias("pctb"))


@q("W05_W06_average_slope", f"WITH {BARS}, s AS (SELECT *, CASE WHEN count(*) OVER w >= 50 THEN avg(close) OVER w END AS sma FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) SELECT symbol, CAST(d AS VARCHAR) AS d, round(sma, 4) AS sma, round((sma - lag(sma, 5) OVER v) / lag(sma, 5) OVER v * 100, 4) AS slope FROM s WINDOW v AS (PARTITION BY symbol ORDER BY d)")
def w05(spark, d):
    x = bars(Tables(spark, d)).withColumn("sma", R.rolling_mean("close", 50)).withColumn("slope", R.slope_percent("sma"))
    return x.select("symbol", day("d").alias("d"), r4("sma").alias("sma"), r4("slope").alias("slope"))


@q("W08_volume_ratio", f"WITH {BARS} SELECT symbol, CAST(d AS VARCHAR) AS d, round(CASE WHEN count(*) OVER w >= 5 THEN volume / avg(volume) OVER w ELSE 1 END, 4) AS ratio FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def w08(spark, d):
    return bars(Tables(spark, d)).select("symbol", day("d").alias("d"), r4(R.volume_ratio()).alias("ratio"))


@q("W11_streak", f"WITH {_STREAK} SELECT symbol, CAST(d AS VARCHAR) AS d, bucket, CAST(streak AS INTEGER) AS streak FROM sk")
def w11(spark, d):
    return R.streak(_study(Tables(spark, d)), "bucket").select("symbol", day("d").alias("d"), "bucket", "streak")


@q("W12_W13_forward_return", f"WITH {_FWD} SELECT symbol, CAST(d AS VARCHAR) AS d, round(r1, 4) AS r1, round(r5, 4) AS r5 FROM f")
def w12(spark, d):
    return _study(Tables(spark, d)).select("symbol", day("d").alias("d"), r4("r1").alias("r1"), r4("r5").alias("r5"))


@q("W14_rolling_z", f"WITH {BARS} SELECT symbol, CAST(d AS VARCHAR) AS d, round(CASE WHEN count(*) OVER w >= 5 THEN (close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0) END, 4) AS z FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)")
def w14(spark, d):
    return bars(Tables(spark, d)).select("symbol", day("d").alias("d"), r4(R.rolling_z("close")).alias("z"))


_WILDER = f"""{BARS}, r AS (SELECT symbol, d, close, row_number() OVER w AS i, close - lag(close) OVER w AS ch FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d)),
x AS (SELECT *, greatest(ch, 0) AS up, greatest(-ch, 0) AS dn FROM r)"""


@q("W01_rsi", f"WITH RECURSIVE {_WILDER}, s AS (SELECT symbol, i, d, up AS u, dn AS v FROM x WHERE i = 2 UNION ALL SELECT x.symbol, x.i, x.d, s.u * 13 / 14 + x.up / 14, s.v * 13 / 14 + x.dn / 14 FROM s JOIN x ON x.symbol = s.symbol AND x.i = s.i + 1) SELECT symbol, CAST(d AS VARCHAR) AS d, round(100 * u / (u + v), 3) AS rsi FROM s")
def w01(spark, d):
    return R.recursive_indicators(bars(Tables(spark, d))).where("rsi is not null").select("symbol", day("d").alias("d"), F.round("rsi", 3).alias("rsi"))


@q("W02_atr", f"WITH RECURSIVE {BARS}, r AS (SELECT symbol, d, row_number() OVER w AS i, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d)), s AS (SELECT symbol, i, d, tr AS a FROM r WHERE i = 1 UNION ALL SELECT r.symbol, r.i, r.d, s.a * 13 / 14 + r.tr / 14 FROM s JOIN r ON r.symbol = s.symbol AND r.i = s.i + 1) SELECT symbol, CAST(d AS VARCHAR) AS d, round(a, 2) AS atr FROM s")
def w02(spark, d):
    return R.recursive_indicators(bars(Tables(spark, d))).select("symbol", day("d").alias("d"), F.round("atr", 2).alias("atr"))


_IND = f"""{BARS}, r AS (SELECT *, row_number() OVER w AS i, greatest(close - lag(close) OVER w, 0) AS gain, greatest(lag(close) OVER w - close, 0) AS loss,
 greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr, high - lag(high) OVER w AS up, lag(low) OVER w - low AS dn FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d)),
m AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS mm FROM r),
ind AS (SELECT symbol, i, d, tr AS atr, NULL::DOUBLE AS u, NULL::DOUBLE AS v, NULL::DOUBLE AS p, NULL::DOUBLE AS q, NULL::DOUBLE AS adx FROM m WHERE i = 1
 UNION ALL SELECT symbol, i, d, atr, u, v, p, q, coalesce(adx * 13 / 14 + dx / 14, dx, adx) FROM (SELECT m.symbol, m.i, m.d, s.atr * 13 / 14 + m.tr / 14 AS atr, coalesce(s.u * 13 / 14 + m.gain / 14, m.gain) AS u, coalesce(s.v * 13 / 14 + m.loss / 14, m.loss) AS v,
 coalesce(s.p * 13 / 14 + m.pm / 14, m.pm) AS p, coalesce(s.q * 13 / 14 + m.mm / 14, m.mm) AS q, s.adx,
 100 * abs(coalesce(s.p * 13 / 14 + m.pm / 14, m.pm) - coalesce(s.q * 13 / 14 + m.mm / 14, m.mm)) / nullif(coalesce(s.p * 13 / 14 + m.pm / 14, m.pm) + coalesce(s.q * 13 / 14 + m.mm / 14, m.mm), 0) AS dx
 FROM ind s JOIN m ON m.symbol = s.symbol AND m.i = s.i + 1))"""


@q("W03_adx", f"WITH RECURSIVE {_IND} SELECT symbol, CAST(d AS VARCHAR) AS d, round(coalesce(adx, 0), 3) AS adx FROM ind")
def w03(spark, d):
    return R.recursive_indicators(bars(Tables(spark, d))).select("symbol", day("d").alias("d"), F.round("adx", 3).alias("adx"))


@q("W07_macd", f"WITH RECURSIVE {BARS}, r AS (SELECT symbol, d, close, row_number() OVER (PARTITION BY symbol ORDER BY d) AS i FROM bars), s AS (SELECT symbol, i, d, close AS f, close AS g, CAST(0 AS DOUBLE) AS sig FROM r WHERE i = 1 UNION ALL SELECT r.symbol, r.i, r.d, s.f + (r.close - s.f) * 2 / 13, s.g + (r.close - s.g) * 2 / 27, s.sig * 0.8 + 0.2 * ((s.f + (r.close - s.f) * 2 / 13) - (s.g + (r.close - s.g) * 2 / 27)) FROM s JOIN r ON r.symbol = s.symbol AND r.i = s.i + 1) SELECT symbol, CAST(d AS VARCHAR) AS d, round(f - g, 2) AS macd, round(f - g - sig, 2) AS macd_hist FROM s")
def w07(spark, d):
    return R.recursive_indicators(bars(Tables(spark, d))).select("symbol", day("d").alias("d"), F.round("macd", 2).alias("macd"), F.round("macd_hist", 2).alias("macd_hist"))


_REG = f"""{_IND}, a AS (SELECT b.symbol, b.d, b.close, ind.adx, ind.atr, 100 * u / (u + v) AS rsi, CASE WHEN count(*) OVER w50 >= 50 THEN avg(close) OVER w50 END AS sma,
 CASE WHEN count(*) OVER w20 >= 20 AND stddev_pop(close) OVER w20 > 0 THEN (close - avg(close) OVER w20 + 2 * stddev_pop(close) OVER w20) / (4 * stddev_pop(close) OVER w20) ELSE 0.5 END AS pctb,
 CASE WHEN count(*) OVER w60 >= 20 THEN ind.atr / nullif(avg(ind.atr) OVER w60, 0) END AS atr_ratio FROM bars b JOIN ind ON ind.symbol = b.symbol AND ind.d = b.d
 WINDOW w50 AS (PARTITION BY b.symbol ORDER BY b.d ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), w20 AS (PARTITION BY b.symbol ORDER BY b.d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), w60 AS (PARTITION BY b.symbol ORDER BY b.d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
t AS (SELECT *, coalesce(sma - lag(sma, 5) OVER (PARTITION BY symbol ORDER BY d) >= 0, false) AS rising, coalesce(close > sma, false) AS above, coalesce(adx, 0) >= 20 AS trend FROM a),
g AS (SELECT *, list_filter([CASE WHEN atr_ratio > 1.5 THEN 'shock' END, CASE WHEN rsi > 75 OR pctb > 1 THEN 'stretched_up' END, CASE WHEN rsi < 25 OR pctb < 0 THEN 'stretched_down' END, CASE WHEN trend AND above AND rising THEN 'trend_up' END,
 CASE WHEN trend AND NOT above AND NOT rising THEN 'trend_down' END, CASE WHEN NOT (trend AND above AND rising) AND NOT (trend AND NOT above AND NOT rising) THEN 'range' END], lambda x: x IS NOT NULL) AS tags FROM t),
h AS (SELECT *, CASE WHEN lag(tags[1]) OVER (PARTITION BY symbol ORDER BY d) = tags[1] THEN 0 ELSE 1 END AS nw FROM g), k AS (SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY d) AS island FROM h)"""


@q("W09_W10_regimes", f"WITH RECURSIVE {_REG} SELECT symbol, CAST(d AS VARCHAR) AS d, array_to_string(tags, ',') AS tags, tags[1] AS primary, CAST(row_number() OVER (PARTITION BY symbol, island ORDER BY d) AS INTEGER) AS streak, round(atr_ratio, 4) AS atr_ratio FROM k")
def w10(spark, d):
    x = R.regimes(bars(Tables(spark, d)))
    return x.select("symbol", day("d").alias("d"), F.array_join("tags", ",").alias("tags"), "primary", "streak", r4("atr_ratio").alias("atr_ratio"))


@q("W18_trade_exits", f"WITH {_EQ}, tr AS (SELECT symbol, d, close, pos FROM e WHERE turn > 0), l AS (SELECT symbol, max(d) AS d, arg_max(close, d) AS c FROM bars GROUP BY 1) SELECT t.symbol, CAST(t.d AS VARCHAR) AS entry, CAST(coalesce(lead(t.d) OVER w, l.d) AS VARCHAR) AS exit, round(coalesce(lead(t.close) OVER w, l.c) / t.close - 1, 4) AS move FROM tr t JOIN l USING (symbol) WINDOW w AS (PARTITION BY t.symbol ORDER BY t.d)")
def w18(spark, d):
    x = _equity(Tables(spark, d))
    last = x.groupBy("symbol").agg(F.max("d").alias("ld"), F.max_by("close", "d").alias("lc"))
    t = x.where("turn > 0").select("symbol", "d", "close").join(last, "symbol")
    w = R.over()
    return t.select("symbol", day("d").alias("entry"), day(F.coalesce(F.lead("d").over(w), "ld")).alias("exit"), r4(F.coalesce(F.lead("close").over(w), "lc") / F.col("close") - 1).alias("move"))


@q("W25_delta", f"WITH {BARS} SELECT symbol, CAST(d AS VARCHAR) AS d, round(close - lag(close) OVER (PARTITION BY symbol ORDER BY d), 4) AS delta FROM bars")
def w25(spark, d):
    return bars(Tables(spark, d)).select("symbol", day("d").alias("d"), r4(F.col("close") - F.lag("close").over(R.over())).alias("delta"))


# ---- curves

_POINTS = """pt AS (SELECT obs_date, source, spread, CAST(substr(tenor, 2) AS INTEGER) AS n, arg_max(value, quote_id) AS value FROM rv_quotes WHERE regexp_full_match(tenor, 'M[0-9]+') AND value IS NOT NULL GROUP BY 1, 2, 3, 4)"""


@q("W21_F16_butterflies", f"WITH {_POINTS} SELECT a.obs_date, a.source, a.spread, a.n, round(b.value - 2 * a.value + c.value, 4) AS fly FROM pt a JOIN pt b ON b.obs_date = a.obs_date AND b.source = a.source AND b.spread = a.spread AND b.n = a.n - 1 JOIN pt c ON c.obs_date = a.obs_date AND c.source = a.source AND c.spread = a.spread AND c.n = a.n + 1 WHERE a.n >= 3 AND abs(b.value - 2 * a.value + c.value) >= 0.3")
def w21(spark, d):
    return C.butterflies(C.curve(Tables(spark, d).rv_quotes)).withColumn("fly", r4("fly"))


@q("W22_curve_shape", f"WITH {_POINTS} SELECT obs_date, source, spread, CAST(count(*) AS BIGINT) AS points, round(arg_max(value, n) - arg_min(value, n), 4) AS slope FROM pt GROUP BY 1, 2, 3 HAVING count(*) >= 2")
def w22(spark, d):
    return C.curve_shape(C.curve(Tables(spark, d).rv_quotes)).select("obs_date", "source", "spread", "points", r4("slope").alias("slope"))


@q("W23_history_z", f"WITH {_POINTS}, h AS (SELECT *, count(*) OVER w AS seen, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM pt WINDOW w AS (PARTITION BY source, spread, n ORDER BY obs_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT obs_date, source, spread, n, CAST(seen AS BIGINT) AS seen, round((value - m) / sd, 3) AS z FROM h WHERE seen >= 7 AND sd >= 1e-6")
def w23(spark, d):
    return C.history_z(C.curve(Tables(spark, d).rv_quotes)).select("obs_date", "source", "spread", "n", "seen", F.round("z", 3).alias("z"))


@q("J13_source_gaps", "WITH v AS (SELECT obs_date, spread, contract, source, arg_max(value, quote_id) AS value FROM rv_quotes WHERE value IS NOT NULL AND contract IS NOT NULL GROUP BY 1, 2, 3, 4) SELECT o.obs_date, o.spread, o.contract, o.source, round(p.value - o.value, 4) AS gap FROM v o JOIN v p USING (obs_date, spread, contract) WHERE p.source = 'PVM' AND o.source <> 'PVM' AND abs(p.value - o.value) >= 0.2")
def j13(spark, d):
    return C.source_gaps(Tables(spark, d).rv_quotes, "PVM").select("obs_date", "spread", "contract", "source", r4("gap").alias("gap"))


_MON = "CASE upper(substr(contract, 1, 3)) " + " ".join(f"WHEN '{m}' THEN {i + 1}" for i, m in enumerate(D.MONTHS)) + " END"
_CM = f"make_date(2000 + CAST(right(contract, 2) AS INTEGER), {_MON}, 1)"


@q("F15_contract_dates", f"SELECT DISTINCT contract, CAST({_CM} AS VARCHAR) AS month, CAST(last_day({_CM} - INTERVAL 2 MONTH) AS VARCHAR) AS expiry, strftime({_CM}, '%b-%y') AS label FROM rv_quotes WHERE regexp_full_match(contract, '[A-Za-z]{{3}}[-'' ][0-9]{{2}}')")
def f15(spark, d):
    c = Tables(spark, d).rv_quotes.select("contract").distinct().withColumn("m", D.contract_month(F.col("contract"))).where("m is not null")
    return c.select("contract", day("m").alias("month"), day(D.contract_expiry(F.col("m"))).alias("expiry"), D.contract_label(F.col("m")).alias("label"))


_WIDE = f"""w AS (SELECT obs_date, {_CM} AS m, arg_max(value, quote_id) FILTER (spread = 'Brent') AS brent, arg_max(value, quote_id) FILTER (spread = 'Dubai') AS dubai FROM rv_quotes WHERE value IS NOT NULL AND regexp_full_match(contract, '[A-Za-z]{{3}}[-'' ][0-9]{{2}}') AND spread IN ('Brent', 'Dubai') GROUP BY 1, 2)"""


def _wide(t: Tables):
    x = t.rv_quotes.where(F.col("value").isNotNull() & F.col("spread").isin("Brent", "Dubai")).withColumn("m", D.contract_month(F.col("contract"))).where("m is not null")
    p = x.groupBy("obs_date", "m").pivot("spread", ["Brent", "Dubai"]).agg(F.max_by("value", "quote_id"))
    return p.withColumnsRenamed({"Brent": "brent", "Dubai": "dubai"})


@q("F29_F30_W24_pivot_time_spread", f"WITH {_WIDE} SELECT obs_date, CAST(m AS VARCHAR) AS m, round(brent - dubai, 4) AS box, round(dubai - lead(dubai) OVER (PARTITION BY obs_date ORDER BY m), 4) AS time_spread, last_day(m - INTERVAL 2 MONTH) >= CAST(obs_date AS DATE) AS live FROM w")
def f30(spark, d):
    x = _wide(Tables(spark, d))
    ts = F.col("dubai") - F.lead("dubai").over(W.partitionBy("obs_date").orderBy("m"))
    return x.select("obs_date", day("m").alias("m"), r4(F.col("brent") - F.col("dubai")).alias("box"), r4(ts).alias("time_spread"), (D.contract_expiry(F.col("m")) >= F.to_date("obs_date")).alias("live"))


@q("J14_prior_snapshot", f"WITH {_WIDE}, o AS (SELECT obs_date, lag(obs_date) OVER (ORDER BY obs_date) AS before FROM (SELECT DISTINCT obs_date FROM w)) SELECT a.obs_date, CAST(a.m AS VARCHAR) AS m, round(a.brent - b.brent, 4) AS change FROM w a JOIN o USING (obs_date) JOIN w b ON b.obs_date = o.before AND b.m = a.m")
def j14(spark, d):
    x = _wide(Tables(spark, d))
    o = x.select("obs_date").distinct().withColumn("before", F.lag("obs_date").over(W.orderBy("obs_date")))  # calendar-bounded
    b = x.select(F.col("obs_date").alias("before"), "m", F.col("brent").alias("was"))
    return x.join(o, "obs_date").join(b, ["before", "m"]).select("obs_date", day("m").alias("m"), r4(F.col("brent") - F.col("was")).alias("change"))


@q("F29_melt", "SELECT doc_id, k AS field, v AS value FROM (SELECT doc_id, unnest(['lang', 'language', 'region']) AS k, unnest([lang, language, region]) AS v FROM documents) WHERE v IS NOT NULL")
def f29(spark, d):
    x = Tables(spark, d).documents.select("doc_id", "lang", "language", "region").unpivot("doc_id", ["lang", "language", "region"], "field", "value")
    return x.where("value is not null")


@q("A33_board", f"WITH {_POINTS} SELECT 'shape' AS angle, spread, CAST(count(*) AS BIGINT) AS n FROM (SELECT spread, obs_date, source FROM pt GROUP BY ALL HAVING count(*) >= 2) GROUP BY 2 UNION ALL SELECT 'fly', a.spread, CAST(count(*) AS BIGINT) FROM pt a JOIN pt b ON b.obs_date = a.obs_date AND b.source = a.source AND b.spread = a.spread AND b.n = a.n - 1 JOIN pt c ON c.obs_date = a.obs_date AND c.source = a.source AND c.spread = a.spread AND c.n = a.n + 1 WHERE a.n >= 3 AND abs(b.value - 2 * a.value + c.value) >= 0.3 GROUP BY 2")
def a33(spark, d):
    p = C.curve(Tables(spark, d).rv_quotes)
    every = C.curve_shape(p).select(F.lit("shape").alias("angle"), "spread").unionByName(C.butterflies(p).select(F.lit("fly").alias("angle"), "spread"))
    return every.groupBy("angle", "spread").agg(F.count("*").alias("n"))


# ---- text functions (F)


@q("F01_clean_text", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(replace(raw_text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), ' ' || chr(9) || chr(10))) AS cleaned FROM documents WHERE raw_text IS NOT NULL")
def f01(spark, d):
    return Tables(spark, d).documents.where("raw_text is not null").select("doc_id", F.md5(X.clean_text(F.col("raw_text"))).alias("cleaned"))


_WS = "' ' || chr(9) || chr(10) || chr(13)"


@q("F02_F03_chunks", f"WITH s AS (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 1800) / 1550.0)) AS BIGINT) + 1)) AS i FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, i, trim(substr(text, i * 1550 + 1, 1800), {_WS}) AS t FROM s) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, md5(t) AS body, CAST(greatest(1, length(t) // 4) AS BIGINT) AS token_estimate FROM p WHERE t <> ''")
def f02(spark, d):
    return X.chunks(Tables(spark, d).documents.select("doc_id", "text")).select("doc_id", "chunk_index", F.md5(F.col("chunk_text")).alias("body"), "token_estimate")


@q("F04_slug", "SELECT doc_id, trim(substr(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), 1, 80), '_') AS slug FROM documents WHERE title IS NOT NULL")
def f04(spark, d):
    return Tables(spark, d).documents.where("title is not null").select("doc_id", X.slug(F.col("title")).alias("slug"))


@q("F06_ids", "SELECT chunk_id, 'chk_' || replace(document_id, 'doc_', '') || '_' || lpad(CAST(chunk_index AS VARCHAR), 4, '0') AS made, 'evt_' || document_id || '_' || split_part(chunk_id, '_', -1) || '_opec_policy' AS event_id FROM chunks WHERE chunk_index IS NOT NULL")
def f06(spark, d):
    x = Tables(spark, d).chunks.where("chunk_index is not null")
    return x.select("chunk_id", X.chunk_id(F.col("document_id"), F.col("chunk_index")).alias("made"), X.event_id(F.col("document_id"), F.col("chunk_id"), F.lit("OPEC_Policy!")).alias("event_id"))


#: A small test lexicon over words of the test texts; users bring their own.
LEXICON = {
    "inventory_draw": (("inventories held by", "stocks", "draw being"), "bullish"),
    "shipping_disruption": (("vessel chartered", "has waited", "fog at the loading berth"), "bullish"),
    "demand_reacceleration": (("refinery runs", "buyers waited", "asked for"), "mixed"),
    "supply_disruption": (("pipeline leak", "coker outage", "storm watch"), "bullish"),
}
UP, DOWN = ("premium", "tight", "firm", "raised", "up "), ("fell", "below", "weaker", "cut", "thin")
_hits = lambda words, t="lower(text)": " + ".join(f"contains({t}, '{w}')::INT" for w in words)


@q("F07_F08_topic_match", "WITH h AS (" + " UNION ALL ".join(f"SELECT chunk_id, {i} AS i, '{t}' AS topic, {_hits(ws)} AS hits FROM (SELECT DISTINCT chunk_id, text FROM chunks)" for i, (t, (ws, _)) in enumerate(LEXICON.items())) + ") SELECT chunk_id, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY least(1.0, 0.45 + 0.12 * hits) DESC, i) - 1 AS INTEGER) AS topic_rank, topic, CAST(hits AS INTEGER) AS hits, round(least(1.0, 0.45 + 0.12 * hits), 4)::DOUBLE AS novelty FROM h WHERE hits > 0")
def f08(spark, d):
    x = X.topic_matches(Tables(spark, d).chunks.select("chunk_id", "text").distinct(), LEXICON)
    return x.select("chunk_id", "topic_rank", "topic", "hits", r4("novelty").alias("novelty"))


@q("F09_direction", f"SELECT doc_id, CASE WHEN u > w THEN 'bullish' WHEN w > u THEN 'bearish' WHEN u > 0 THEN 'mixed' ELSE 'neutral' END AS direction FROM (SELECT doc_id, {_hits(UP)} AS u, {_hits(DOWN)} AS w FROM documents WHERE text IS NOT NULL)")
def f09(spark, d):
    t = F.col("text")
    return Tables(spark, d).documents.where("text is not null").select("doc_id", X.lean(X.terms_present(t, UP), X.terms_present(t, DOWN), F.lit("neutral")).alias("direction"))


@q("F10_rumor_flag", f"SELECT doc_id, source = 'social_private_manual' OR ({_hits(('unconfirmed', 'rumor'))}) > 0 AS rumor, round(greatest(0.05, least(1.0, CASE source WHEN 'official_data' THEN 0.95 WHEN 'official_reports' THEN 0.92 WHEN 'authoritative_news' THEN 0.72 ELSE 0.5 END - CASE WHEN source = 'social_private_manual' OR ({_hits(('unconfirmed', 'rumor'))}) > 0 THEN 0.12 ELSE 0 END)), 4)::DOUBLE AS credibility FROM documents WHERE text IS NOT NULL")
def f10(spark, d):
    rumor = (F.col("source") == "social_private_manual") | (X.terms_present(F.col("text"), ("unconfirmed", "rumor")) > 0)
    base = G.lookup(F.col("source"), {"official_data": 0.95, "official_reports": 0.92, "authoritative_news": 0.72}, 0.5)
    c = F.greatest(F.lit(0.05), F.least(F.lit(1.0), base - F.when(rumor, 0.12).otherwise(0.0)))
    return Tables(spark, d).documents.where("text is not null").select("doc_id", rumor.alias("rumor"), r4(c).alias("credibility"))


_ENT = ("WTI", "Brent", "Dubai", "gasoil", "naphtha", "jet")


@q("F11_entities", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{e.lower()}') THEN '{e}' END" for e in _ENT) + "], lambda x: x IS NOT NULL)[1:3], ',') AS entities FROM documents WHERE text IS NOT NULL")
def f11(spark, d):
    return Tables(spark, d).documents.where("text is not null").select("doc_id", F.array_join(X.present(F.col("text"), _ENT, 3), ",").alias("entities"))


_OCC = lambda ws: " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)}" for w in ws)
DE, RE = ("reopen", "restored", "withdraw", "relief"), ("resolved", "fail", "leak")


@q("F13_F14_flip", f"SELECT doc_id, CAST(de AS INTEGER) AS de, CAST(re AS INTEGER) AS re, CASE WHEN de > 0 AND de > re THEN 'bearish' ELSE 'bullish' END AS direction FROM (SELECT doc_id, {_OCC(DE)} AS de, {_OCC(RE)} AS re FROM documents WHERE text IS NOT NULL)")
def f13(spark, d):
    x = Tables(spark, d).documents.where("text is not null").select("doc_id", X.occurrences(F.col("text"), DE).alias("de"), X.occurrences(F.col("text"), RE).alias("re"))
    return x.withColumn("direction", F.when((F.col("de") > 0) & (F.col("de") > F.col("re")), "bearish").otherwise("bullish"))


@q("F17_F19_calendar", "SELECT o_orderkey, CAST(least(abs(dayofyear(o_orderdate) - 355), 365 - abs(dayofyear(o_orderdate) - 355)) AS INTEGER) AS season_gap, CAST(CAST(o_orderdate AS DATE) - CASE isodow(o_orderdate) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END AS VARCHAR) AS previous, CAST(year(o_orderdate) * 12 + month(o_orderdate) + CASE WHEN day(o_orderdate) > 20 THEN 1 ELSE 0 END AS INTEGER) AS front FROM orders")
def f17(spark, d):
    c = F.to_date("o_orderdate")
    return Tables(spark, d).orders.select("o_orderkey", D.circular_days(F.dayofyear(c), F.lit(355)).alias("season_gap"), day(D.previous_business_day(c)).alias("previous"), D.front_month_index(c).alias("front"))


@q("F20_headline", r"WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL), p AS (SELECT *, " + ", ".join(f"CASE WHEN strpos(substr(t, 31), '{s}') > 0 THEN strpos(substr(t, 31), '{s}') + 30 END AS a{i}" for i, s in enumerate((". ", "! ", "? ", "; ", " - "))) + " FROM f) SELECT doc_id, substr(t, 1, least(coalesce(a0, 161), coalesce(a1, 161), coalesce(a2, 161), coalesce(a3, 161), coalesce(a4, 161), 161) - 1) AS headline FROM p")
def f20(spark, d):
    return Tables(spark, d).documents.where("text is not null").select("doc_id", X.headline(F.col("text")).alias("headline"))


@q("F21_json_object", "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
def f21(spark, d):
    wrapped = F.concat(F.lit("Sure, here it is: "), F.col("props"), F.lit(" - done"))
    return Tables(spark, d).events.select("event_id", X.json_object(wrapped, "k bigint")["k"].alias("k"))


@q("F28_math", "SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt(l_extendedprice) * exp(-l_discount) + pow(l_tax, 2), 4) AS v, round(greatest(l_quantity, 10) - least(l_quantity, 40), 4) AS spread FROM lineitem")
def f28(spark, d):
    x = Tables(spark, d).lineitem
    v = F.sqrt("l_extendedprice") * F.exp(-F.col("l_discount")) + F.pow("l_tax", F.lit(2.0))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", r4(v).alias("v"), r4(F.greatest("l_quantity", F.lit(10.0)) - F.least("l_quantity", F.lit(40.0))).alias("spread"))


@q("Y04_extract_events", f"WITH h AS (" + " UNION ALL ".join(f"SELECT chunk_id, document_id, text, '{t}' AS topic, {_hits(ws)} AS hits FROM (SELECT DISTINCT chunk_id, document_id, text FROM chunks)" for t, (ws, _) in LEXICON.items()) + f") SELECT 'evt_' || document_id || '_' || split_part(chunk_id, '_', -1) || '_' || topic AS event_id, topic, CASE WHEN ({_hits(UP)}) > ({_hits(DOWN)}) THEN 'bullish' WHEN ({_hits(DOWN)}) > ({_hits(UP)}) THEN 'bearish' WHEN ({_hits(UP)}) > 0 THEN 'mixed' ELSE 'neutral' END AS direction FROM h WHERE hits > 0 AND length(text) >= 80")
def y04(spark, d):
    c = Tables(spark, d).chunks.where(F.length("text") >= 80).select("chunk_id", "document_id", "text").distinct()
    x = X.topic_matches(c, LEXICON)
    t = F.col("text")
    return x.select(X.event_id(F.col("document_id"), F.col("chunk_id"), F.col("topic")).alias("event_id"), "topic", X.lean(X.terms_present(t, UP), X.terms_present(t, DOWN), F.lit("neutral")).alias("direction"))


QUERIES, SQL = q.queries, q.sql
