"""Survey queries: projections, predicates, joins, aggregations, top-k, set operations, sinks as relations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tarnlight.functions import dates as D
from tarnlight.functions import text as X
from tarnlight.operators import joins as J
from tarnlight.plans.registry import BARS, EVENTS, Registry, Tables, bars, day, events, r4
from tarnlight.sources import sinks as K

q = Registry()

# ---- scans and reshaping of feeds (S)


@q("S16_curve_leg_spread", f"WITH {BARS} SELECT CAST(a.d AS VARCHAR) AS d, round(a.close - b.close, 4) AS spread FROM bars a JOIN bars b USING (d) WHERE a.symbol = '1-URGENT' AND b.symbol = '2-HIGH'")
def s16(spark, d):
    legs = bars(Tables(spark, d)).where(F.col("symbol").isin("1-URGENT", "2-HIGH"))
    p = legs.groupBy("d").pivot("symbol", ["1-URGENT", "2-HIGH"]).agg(F.first("close")).dropna()
    return p.select(day("d").alias("d"), r4(F.col("1-URGENT") - F.col("2-HIGH")).alias("spread"))


@q("S17_net_share", "SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS d, round(100.0 * (sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) - sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END)) / sum(l_quantity), 4) AS net_pct FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 0")
def s17(spark, d):
    side = lambda f: F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")).otherwise(0))
    g = Tables(spark, d).lineitem.groupBy(day(F.to_date("l_shipdate")).alias("d")).agg(side("R").alias("long"), side("A").alias("short"), F.sum("l_quantity").alias("oi"))
    return g.where("oi > 0").select("d", r4(100.0 * (F.col("long") - F.col("short")) / F.col("oi")).alias("net_pct"))


@q("S18_series_projection", "SELECT price_id, upper(trim(symbol)) AS symbol, asset_type, round(close, 4) AS close FROM market_prices WHERE asset_type = 'inventory' AND close IS NOT NULL")
def s18(spark, d):
    m = Tables(spark, d).market_prices.where("asset_type = 'inventory' and close is not null")
    return m.select("price_id", F.upper(F.trim("symbol")).alias("symbol"), "asset_type", r4("close").alias("close"))


@q("S19_monthly_basket", "SELECT strftime(o_orderdate, '%Y-%m') || '-01' AS month, round(sum(CAST(o_totalprice AS DECIMAL(18, 2))), 2)::DOUBLE AS total FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F' AND o_totalprice > 0 GROUP BY 1")
def s19(spark, d):
    o = Tables(spark, d).orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 0))
    return o.groupBy(day(F.trunc("o_orderdate", "month")).alias("month")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


_NUM = r"(-?[0-9]+[.,][0-9]+)"


@q("S20_settle_from_text", rf"""WITH p AS (SELECT spread, contract, ingested_at, quote_id, nullif(regexp_extract(quote_text, '{_NUM}', 1), '') AS x FROM rv_quotes WHERE quote_text IS NOT NULL AND contract IS NOT NULL)
SELECT spread, contract, x AS written, round(CAST(replace(x, ',', '.') AS DOUBLE), 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY spread, contract ORDER BY ingested_at DESC, quote_id DESC) AS k FROM p WHERE x IS NOT NULL AND ingested_at IS NOT NULL) WHERE k = 1""")
def s20(spark, d):
    x = F.nullif(F.regexp_extract("quote_text", _NUM, 1), F.lit(""))
    p = Tables(spark, d).rv_quotes.where("contract is not null and ingested_at is not null").withColumn("x", x).where("x is not null")
    g = p.groupBy("spread", "contract").agg(F.max_by("x", F.struct("ingested_at", "quote_id")).alias("written"))
    return g.select("spread", "contract", "written", r4(F.replace("written", F.lit(","), F.lit(".")).cast("double")).alias("value"))


@q("S21_daily_bundle", "SELECT source_id, strftime(ingested_at, '%Y-%m-%d') AS d, CAST(count(*) AS BIGINT) AS posts, string_agg(document_id, '|' ORDER BY ingested_at, document_id) AS bundle FROM documents WHERE ingested_at IS NOT NULL AND source_id IS NOT NULL GROUP BY 1, 2")
def s21(spark, d):
    g = Tables(spark, d).documents.where("ingested_at is not null and source_id is not null").groupBy("source_id", day("ingested_at").alias("d"))
    x = g.agg(F.count("*").alias("posts"), F.array_sort(F.collect_list(F.struct("ingested_at", "document_id"))).alias("b"))
    return x.select("source_id", "d", "posts", F.array_join(F.transform("b", lambda y: y["document_id"]), "|").alias("bundle"))


@q("S22_post_filter", "SELECT document_id FROM documents WHERE text IS NOT NULL AND length(text) >= 400 AND NOT rumor_flag AND ingested_at >= TIMESTAMP '2024-01-01' AND ingested_at < TIMESTAMP '2025-01-01'")
def s22(spark, d):
    x = Tables(spark, d).documents.where((F.length("text") >= 400) & ~F.col("rumor_flag") & (F.col("ingested_at") >= "2024-01-01") & (F.col("ingested_at") < "2025-01-01"))
    return x.select("document_id")


@q("S26_collapse_whitespace", r"SELECT doc_id, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) AS flat FROM documents WHERE text IS NOT NULL AND contains(lower(coalesce(title, '')), 'wti')")
def s26(spark, d):
    x = Tables(spark, d).documents.where(F.lower("title").contains("wti") & F.col("text").isNotNull())
    return x.select("doc_id", F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " ")).alias("flat"))


@q("S28_month_ranges", "SELECT strftime(m, '%Y-%m-%d') AS first_day, strftime(last_day(m), '%Y-%m-%d') AS last_day FROM (SELECT unnest(generate_series(DATE '2023-11-01', DATE '2024-06-01', INTERVAL 1 MONTH)) AS m)")
def s28(spark, d):
    m = spark.range(1).select(F.explode(F.sequence(F.lit("2023-11-01").cast("date"), F.lit("2024-06-01").cast("date"), F.expr("interval 1 month"))).alias("m"))
    return m.select(day("m").alias("first_day"), day(F.last_day("m")).alias("last_day"))


@q("S29_table_scan", "SELECT source_id, source_name, source_bucket, home_zone FROM sources WHERE source_bucket = 'official_data'")
def s29(spark, d):
    Tables(spark, d).sources.createOrReplaceTempView("tl_sources")
    return spark.sql("SELECT source_id, source_name, source_bucket, home_zone FROM tl_sources WHERE source_bucket = :bucket", args={"bucket": "official_data"})


# ---- sinks as relations (K)


@q("K01_upsert", "SELECT document_id, topic, event_id, round(credibility, 4) AS credibility FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY created_at DESC, credibility DESC, novelty DESC) AS k FROM narrative_events) WHERE k = 1")
def k01(spark, d):
    e = Tables(spark, d).narrative_events
    return K.last_write(e, ["event_id"], [F.desc("created_at"), F.desc("credibility"), F.desc("novelty")]).select("document_id", "topic", "event_id", r4("credibility").alias("credibility"))


@q("K02_insert_if_absent", "SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM narrative_events WHERE chunk_id IS NOT NULL)")
def k02(spark, d):
    t = Tables(spark, d)
    return K.absent(t.chunks.select("chunk_id").distinct(), t.narrative_events.select("chunk_id"), ["chunk_id"])


@q("K03_targeted_update", "SELECT t.trade_id, coalesce(c.close, t.entry_close) AS entry_close FROM (SELECT trade_id, round(entry_close, 4) AS entry_close FROM paper_trades) t LEFT JOIN (SELECT trade_id, round(entry_close * 2, 4) AS close FROM paper_trades WHERE notes = 'rerun') c USING (trade_id)")
def k03(spark, d):
    t = Tables(spark, d).paper_trades.select("trade_id", r4("entry_close").alias("entry_close"), "notes")
    fix = t.where("notes = 'rerun'").select("trade_id", r4(F.col("entry_close") * 2).alias("entry_close"))
    return K.corrected(t.drop("notes"), fix, ["trade_id"], ["entry_close"])


@q("K04_redate_cascade", "SELECT n.event_id, strftime(coalesce(d.ingested_at, n.created_at), '%Y-%m-%d') AS dated FROM (SELECT DISTINCT event_id, document_id, created_at FROM narrative_events) n LEFT JOIN (SELECT document_id, ingested_at FROM documents WHERE quality_tier = 1) d USING (document_id)")
def k04(spark, d):
    t = Tables(spark, d)
    e = t.narrative_events.select("event_id", "document_id", F.col("created_at").alias("at")).distinct()
    fix = t.documents.where("quality_tier = 1").select("document_id", F.col("ingested_at").alias("at"))
    return K.corrected(e, fix, ["document_id"], ["at"]).select("event_id", day("at").alias("dated"))


@q("K11_duplicate_plan", "SELECT doc_id, CAST(k AS BIGINT) AS copy_no FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY quality_tier NULLS LAST, ingested_at NULLS LAST, doc_id) AS k FROM documents WHERE text IS NOT NULL) WHERE k > 1")
def k11(spark, d):
    x = Tables(spark, d).documents.where("text is not null").select("doc_id", "quality_tier", "ingested_at", F.md5(F.col("text")).alias("key"))
    w = W.partitionBy("key").orderBy(F.asc_nulls_last("quality_tier"), F.asc_nulls_last("ingested_at"), "doc_id")
    return x.withColumn("copy_no", F.row_number().over(w).cast("long")).where("copy_no > 1").select("doc_id", "copy_no")


# ---- projections and predicates (P)


@q("P01_projection", "SELECT chunk_id AS id, document_id AS parent, chunk_index AS position, length(text) AS chars FROM chunks")
def p01(spark, d):
    return Tables(spark, d).chunks.select(F.col("chunk_id").alias("id"), F.col("document_id").alias("parent"), F.col("chunk_index").alias("position"), F.length("text").cast("long").alias("chars"))


@q("P02_bound_predicates", "SELECT price_id, round(close, 4) AS close FROM market_prices WHERE symbol = 'WTI' AND price_time >= TIMESTAMP '2024-01-01' AND close > 70")
def p02(spark, d):
    Tables(spark, d).market_prices.createOrReplaceTempView("tl_prices")
    return spark.sql("SELECT price_id, round(close, 4) AS close FROM tl_prices WHERE symbol = :s AND price_time >= to_timestamp_ntz(:since) AND close > :low", args={"s": "WTI", "since": "2024-01-01 00:00:00", "low": 70})


@q("P03_in_lists", "SELECT event_id, topic FROM narrative_events WHERE direction IN ('bullish', 'bearish') AND source_bucket NOT IN ('social_open', 'social_private_manual')")
def p03(spark, d):
    x = Tables(spark, d).narrative_events
    return x.where(F.col("direction").isin("bullish", "bearish") & ~F.col("source_bucket").isin("social_open", "social_private_manual")).select("event_id", "topic")


@q("P04_not_in_subquery", "SELECT document_id FROM documents WHERE document_id NOT IN (SELECT document_id FROM narrative_events WHERE document_id IS NOT NULL)")
def p04(spark, d):
    t = Tables(spark, d)
    return t.documents.select("document_id").join(t.narrative_events.select("document_id"), "document_id", "left_anti")


@q("P05_like_any", "SELECT doc_id FROM documents WHERE lower(text) LIKE '%brent%' OR lower(text) LIKE '%naphtha%' OR lower(title) LIKE '%wti%'")
def p05(spark, d):
    low = F.lower("text")
    return Tables(spark, d).documents.where(low.contains("brent") | low.contains("naphtha") | F.lower("title").contains("wti")).select("doc_id")


@q("P06_between_dates", "SELECT event_id, strftime(created_at, '%Y-%m-%d') AS d FROM narrative_events WHERE CAST(created_at AS DATE) BETWEEN DATE '2024-02-01' AND DATE '2024-08-31'")
def p06(spark, d):
    return Tables(spark, d).narrative_events.where(F.to_date("created_at").between("2024-02-01", "2024-08-31")).select("event_id", day("created_at").alias("d"))


@q("P07_nulls", "SELECT doc_id, coalesce(title, lang, 'untitled') AS label FROM documents WHERE region IS NULL OR quality_tier IS NULL")
def p07(spark, d):
    return Tables(spark, d).documents.where("region is null or quality_tier is null").select("doc_id", F.coalesce("title", "lang", F.lit("untitled")).alias("label"))


@q("P08_library_search", "SELECT doc_id, title FROM documents WHERE source = 'authoritative_news' AND ingested_at BETWEEN TIMESTAMP '2023-06-01' AND TIMESTAMP '2025-06-01' AND (contains(lower(coalesce(title, '')), 'brent') OR contains(lower(coalesce(text, '')), 'brent'))")
def p08(spark, d):
    has = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains("brent")
    x = Tables(spark, d).documents.where((F.col("source") == "authoritative_news") & F.col("ingested_at").between("2023-06-01", "2025-06-01"))
    return x.where(has("title") | has("text")).select("doc_id", "title")


@q("P09_score_date", f"WITH {EVENTS} SELECT event_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS at, CAST(score_date AS VARCHAR) AS score_date FROM ev")
def p09(spark, d):
    return events(Tables(spark, d)).select("event_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("at"), day("score_date").alias("score_date"))


_LAG = "CASE " + " ".join(f"WHEN starts_with(lower(symbol), '{p.lower()}') THEN {n}" for p, n in D.RELEASE_LAGS) + " ELSE 0 END"


@q("P10_release_lag", f"SELECT DISTINCT symbol, CAST({_LAG} AS INTEGER) AS lag_days FROM market_prices WHERE symbol IS NOT NULL")
def p10(spark, d):
    return Tables(spark, d).market_prices.where("symbol is not null").select("symbol", D.release_lag(F.col("symbol")).alias("lag_days")).distinct()


@q("P11_released_on", f"SELECT price_id, CAST(CAST(price_time AS DATE) + {_LAG} AS VARCHAR) AS released FROM market_prices")
def p11(spark, d):
    return Tables(spark, d).market_prices.select("price_id", day(D.released_on(F.col("symbol"), F.col("price_time"))).alias("released"))


@q("P12_label_lookup", "SELECT event_id, (CASE direction WHEN 'bullish' THEN 1.0 WHEN 'bearish' THEN -1.0 WHEN 'mixed' THEN 0.25 ELSE 0.0 END)::DOUBLE AS sign FROM narrative_events")
def p12(spark, d):
    from tarnlight.operators.scoring import ScoringConfig, lookup

    return Tables(spark, d).narrative_events.select("event_id", lookup(F.col("direction"), ScoringConfig().sign, 0.0).alias("sign"))


@q("P13_bucketed_score", "SELECT trade_id, CASE WHEN composite_score >= 0.6 THEN 'strong_up' WHEN composite_score >= 0.2 THEN 'up' WHEN composite_score <= -0.6 THEN 'strong_down' WHEN composite_score <= -0.2 THEN 'down' ELSE 'flat' END AS bucket FROM paper_trades WHERE composite_score IS NOT NULL")
def p13(spark, d):
    s = F.col("composite_score")
    b = F.when(s >= 0.6, "strong_up").when(s >= 0.2, "up").when(s <= -0.6, "strong_down").when(s <= -0.2, "down").otherwise("flat")
    return Tables(spark, d).paper_trades.where("composite_score is not null").select("trade_id", b.alias("bucket"))


@q("P17_latest_weekday", "SELECT upper(trim(symbol)) AS symbol, CAST(max(CAST(price_time AS DATE)) AS VARCHAR) AS d FROM market_prices WHERE isodow(price_time) <= 5 AND close IS NOT NULL GROUP BY 1")
def p17(spark, d):
    x = Tables(spark, d).market_prices.where((F.weekday("price_time") < 5) & F.col("close").isNotNull())
    return x.groupBy(F.upper(F.trim("symbol")).alias("symbol")).agg(day(F.max(F.to_date("price_time"))).alias("d"))


@q("P19_freshness", "SELECT upper(trim(symbol)) AS symbol, CAST(min(date_diff('day', CAST(price_time AS DATE), DATE '2025-12-31')) AS BIGINT) AS age, min(date_diff('day', CAST(price_time AS DATE), DATE '2025-12-31')) <= 6 AS fresh FROM market_prices WHERE price_time <= TIMESTAMP '2025-12-31' GROUP BY 1")
def p19(spark, d):
    x = Tables(spark, d).market_prices.where(F.col("price_time") <= "2025-12-31")
    g = x.groupBy(F.upper(F.trim("symbol")).alias("symbol")).agg(F.min(F.datediff(F.lit("2025-12-31"), F.to_date("price_time"))).cast("long").alias("age"))
    return g.withColumn("fresh", F.col("age") <= 6)


@q("F21_json_fields", "SELECT chunk_id, json_extract_string(metadata_json, '$.chunker') AS chunker, json_extract_string(metadata_json, '$.lang') AS lang FROM chunks WHERE metadata_json IS NOT NULL")
def p20(spark, d):
    x = Tables(spark, d).chunks.where("metadata_json is not null")
    return x.select("chunk_id", F.get_json_object("metadata_json", "$.chunker").alias("chunker"), F.get_json_object("metadata_json", "$.lang").alias("lang"))


@q("P21_recent_or_latest", "SELECT doc_id FROM (SELECT doc_id, ingested_at >= TIMESTAMP '2025-11-01' AS recent, count(*) FILTER (ingested_at >= TIMESTAMP '2025-11-01') OVER () AS n, row_number() OVER (ORDER BY ingested_at DESC, doc_id) AS k FROM documents WHERE ingested_at IS NOT NULL) WHERE (n > 0 AND recent) OR (n = 0 AND k <= 20)")
def p21(spark, d):
    x = Tables(spark, d).documents.where("ingested_at is not null").select("doc_id", "ingested_at")
    recent = x.where(F.col("ingested_at") >= "2025-11-01")
    any_recent = F.broadcast(recent.limit(1).select(F.lit(1).alias("one")))  # one row
    latest = x.orderBy(F.desc("ingested_at"), "doc_id").limit(20).withColumn("one", F.lit(1)).join(any_recent, "one", "left_anti")
    return recent.select("doc_id").unionByName(latest.select("doc_id"))


@q("P22_source_preference", "SELECT spread, contract, arg_min(source, (CASE source WHEN 'PVM' THEN 0 ELSE 1 END, source, -quote_id)) AS source FROM rv_quotes WHERE value IS NOT NULL AND contract IS NOT NULL GROUP BY 1, 2")
def p22(spark, d):
    order = F.struct(F.when(F.col("source") == "PVM", 0).otherwise(1), F.col("source"), -F.col("quote_id"))
    return Tables(spark, d).rv_quotes.where("value is not null and contract is not null").groupBy("spread", "contract").agg(F.min_by("source", order).alias("source"))


# ---- joins (J)


@q("J01_inner", "SELECT c.chunk_id, d.source_id, d.lang FROM chunks c JOIN documents d USING (document_id)")
def j01(spark, d):
    t = Tables(spark, d)
    return t.chunks.select("chunk_id", "document_id").join(t.documents.select("document_id", "source_id", "lang"), "document_id").select("chunk_id", "source_id", "lang")


@q("J02_two_left", "SELECT n.event_id, d.title, s.cost_level FROM narrative_events n LEFT JOIN documents d USING (document_id) LEFT JOIN sources s ON s.source_id = d.source_id")
def j02(spark, d):
    t = Tables(spark, d)
    x = t.narrative_events.select("event_id", "document_id").join(t.documents.select("document_id", "title", "source_id"), "document_id", "left")
    return x.join(F.broadcast(t.sources.select("source_id", "cost_level")), "source_id", "left").select("event_id", "title", "cost_level")


@q("J03_left_on_aggregates", "SELECT d.doc_id, coalesce(c.n, 0) AS n_chunks, coalesce(e.n, 0) AS n_events FROM documents d LEFT JOIN (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1) c USING (document_id) LEFT JOIN (SELECT document_id, count(*) AS n FROM narrative_events GROUP BY 1) e USING (document_id)")
def j03(spark, d):
    t = Tables(spark, d)
    c = t.chunks.groupBy("document_id").agg(F.count("*").alias("nc"))
    e = t.narrative_events.groupBy("document_id").agg(F.count("*").alias("ne"))
    x = t.documents.select("doc_id", "document_id").join(c, "document_id", "left").join(e, "document_id", "left")
    return x.select("doc_id", F.coalesce("nc", F.lit(0)).alias("n_chunks"), F.coalesce("ne", F.lit(0)).alias("n_events"))


@q("J05_equi_with_constant", f"WITH {BARS}, {EVENTS} SELECT e.event_id, round(b.close, 4) AS close FROM ev e JOIN bars b ON b.d = e.score_date - INTERVAL 9125 DAY AND b.symbol = '1-URGENT'")
def j05(spark, d):
    t = Tables(spark, d)
    b = bars(t).where("symbol = '1-URGENT'").select(F.date_add("d", 9125).alias("score_date"), "close")
    return events(t).join(b, "score_date").select("event_id", r4("close").alias("close"))


@q("J06_ranked_headlines", "SELECT d.document_id, max(d.title) AS title, CAST(count(*) AS BIGINT) AS n, round(max(n.credibility), 4) AS best FROM documents d JOIN narrative_events n USING (document_id) WHERE n.direction <> 'neutral' GROUP BY 1 ORDER BY n DESC, best DESC, 1 LIMIT 15")
def j06(spark, d):
    t = Tables(spark, d)
    e = t.narrative_events.where("direction <> 'neutral'").groupBy("document_id").agg(F.count("*").alias("n"), r4(F.max("credibility")).alias("best"))
    x = e.join(t.documents.select("document_id", "title"), "document_id")
    return x.orderBy(F.desc("n"), F.desc("best"), "document_id").limit(15).select("document_id", "title", "n", "best")


@q("J07_asof", f"WITH {BARS}, l AS (SELECT DISTINCT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) + 3 AS t FROM orders WHERE o_orderstatus = 'P') SELECT l.symbol, CAST(l.t AS VARCHAR) AS t, CAST(b.d AS VARCHAR) AS d, round(b.close, 4) AS close FROM l ASOF LEFT JOIN bars b ON l.symbol = b.symbol AND b.d <= l.t")
def j07(spark, d):
    t = Tables(spark, d)
    left = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderpriority").alias("symbol"), F.date_add(F.to_date("o_orderdate"), 3).alias("t")).distinct()
    right = bars(t).select("symbol", F.col("d").alias("rt"), "d", "close")
    return J.asof(left, right, "symbol", "t", "rt", ["d", "close"]).select("symbol", day("t").alias("t"), day("d").alias("d"), r4("close").alias("close"))


@q("J08_latest_two", f"WITH {BARS} SELECT symbol, CAST(k AS INTEGER) AS k, CAST(d AS VARCHAR) AS d, round(close, 4) AS close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS k FROM bars WHERE d <= DATE '2000-06-30') WHERE k <= 2")
def j08(spark, d):
    x = J.latest(bars(Tables(spark, d)).where("d <= date'2000-06-30'"), ["symbol"], [F.desc("d")], 2)
    return x.select("symbol", "k", day("d").alias("d"), r4("close").alias("close"))


@q("J09_date_intersection", f"WITH {BARS} SELECT CAST(a.d AS VARCHAR) AS d, round(2 * a.close - b.close - c.close, 4) AS crack FROM bars a JOIN bars b USING (d) JOIN bars c USING (d) WHERE a.symbol = '1-URGENT' AND b.symbol = '3-MEDIUM' AND c.symbol = '5-LOW'")
def j09(spark, d):
    legs = {"1-URGENT": 2, "3-MEDIUM": -1, "5-LOW": -1}
    x = bars(Tables(spark, d)).where(F.col("symbol").isin(*legs)).groupBy("d").pivot("symbol", list(legs)).agg(F.first("close")).dropna()
    return x.select(day("d").alias("d"), r4(sum((F.col(f"`{s}`") * w for s, w in legs.items()), F.lit(0.0))).alias("crack"))


@q("J11_seasonal_peers", """WITH s AS (SELECT o_orderstatus AS symbol, CAST(o_orderdate AS DATE) AS d, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1, 2),
p AS (SELECT a.symbol, a.d, a.v, count(*) AS n, avg(b.v) AS m, stddev_pop(b.v) AS sd FROM s a JOIN s b ON a.symbol = b.symbol AND b.d < a.d AND b.d >= a.d - 1855 AND least(abs(dayofyear(a.d) - dayofyear(b.d)), 365 - abs(dayofyear(a.d) - dayofyear(b.d))) <= 7 GROUP BY ALL)
SELECT symbol, CAST(d AS VARCHAR) AS d, round((v - m) / sd, 4) AS z, CAST(n AS BIGINT) AS n FROM p WHERE n >= 3 AND sd > 0""")
def j11(spark, d):
    s = Tables(spark, d).orders.groupBy(F.col("o_orderstatus").alias("symbol"), F.to_date("o_orderdate").alias("d")).agg(F.count("*").cast("double").alias("close"))
    return J.seasonal_z(s).select("symbol", day("d").alias("d"), r4("z").alias("z"), "n")


@q("J12_first_later_reversal", "WITH t AS (SELECT trade_id, symbol, CAST(plan_date AS DATE) AS d, direction, composite_score AS s FROM paper_trades WHERE direction = 'LONG' AND try_cast(plan_date AS DATE) IS NOT NULL AND symbol IS NOT NULL), r AS (SELECT symbol, CAST(plan_date AS DATE) AS rd FROM paper_trades WHERE composite_score <= -0.5) SELECT t.trade_id, CAST(min(r.rd) AS VARCHAR) AS closed FROM t LEFT JOIN r ON t.symbol = r.symbol AND r.rd > t.d GROUP BY t.trade_id")
def j12(spark, d):
    p = Tables(spark, d).paper_trades.withColumn("d", F.to_date("plan_date"))
    t = p.where("direction = 'LONG' and d is not null and symbol is not null").select("trade_id", "symbol", "d")
    r = p.where("composite_score <= -0.5").select("symbol", F.col("d").alias("rd")).distinct()
    return J.first_later(t, r, "symbol", "d", "rd", "closed").select("trade_id", day("closed").alias("closed"))


@q("J15_lookup_by_date", f"WITH {BARS} SELECT CAST(a.d AS VARCHAR) AS d, round(a.close, 4) AS close, CAST(b.volume AS BIGINT) AS peers FROM bars a LEFT JOIN bars b ON a.d = b.d AND b.symbol = '5-LOW' WHERE a.symbol = '1-URGENT'")
def j15(spark, d):
    b = bars(Tables(spark, d))
    low = b.where("symbol = '5-LOW'").select("d", F.col("volume").cast("long").alias("peers"))
    return b.where("symbol = '1-URGENT'").join(low, "d", "left").select(day("d").alias("d"), r4("close").alias("close"), "peers")


@q("J16_cross_check", "WITH m AS (SELECT upper(trim(symbol)) AS s, CAST(price_time AS DATE) AS d, max(close) AS c FROM market_prices WHERE close IS NOT NULL GROUP BY 1, 2) SELECT CAST(a.d AS VARCHAR) AS d, round(a.c, 4) AS wti, round(b.c, 4) AS brent, round(a.c - b.c, 4) AS gap FROM m a LEFT JOIN m b ON a.d = b.d AND b.s = 'BRENT' WHERE a.s = 'WTI'")
def j16(spark, d):
    m = Tables(spark, d).market_prices.where("close is not null").groupBy(F.upper(F.trim("symbol")).alias("s"), F.to_date("price_time").alias("d")).agg(F.max("close").alias("c"))
    x = m.where("s = 'WTI'").select("d", F.col("c").alias("wti")).join(m.where("s = 'BRENT'").select("d", F.col("c").alias("brent")), "d", "left")
    return x.select(day("d").alias("d"), r4("wti").alias("wti"), r4("brent").alias("brent"), r4(F.col("wti") - F.col("brent")).alias("gap"))


@q("J17_left_coalesce", "SELECT DISTINCT n.event_id, coalesce(c.t, n.evidence_text) AS passage FROM narrative_events n LEFT JOIN (SELECT chunk_id, min(text) AS t FROM chunks WHERE length(text) > 1000 GROUP BY 1) c USING (chunk_id)")
def j17(spark, d):
    t = Tables(spark, d)
    c = t.chunks.where(F.length("text") > 1000).groupBy("chunk_id").agg(F.min("text").alias("t"))
    return t.narrative_events.select("event_id", "chunk_id", "evidence_text").join(c, "chunk_id", "left").select("event_id", F.coalesce("t", "evidence_text").alias("passage")).distinct()


@q("J18_semi", "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM narrative_events n WHERE n.document_id = d.document_id AND n.direction = 'bullish')")
def j18(spark, d):
    t = Tables(spark, d)
    return t.documents.select("doc_id", "document_id").join(t.narrative_events.where("direction = 'bullish'").select("document_id"), "document_id", "left_semi").select("doc_id")


# ---- top-k (T) and sets (U)


@q("T01_multi_key_order", "SELECT trade_id, round(composite_score, 4) AS s FROM paper_trades WHERE composite_score IS NOT NULL ORDER BY abs(composite_score) DESC, trade_id LIMIT 25")
def t01(spark, d):
    return Tables(spark, d).paper_trades.where("composite_score is not null").orderBy(F.abs("composite_score").desc(), "trade_id").limit(25).select("trade_id", r4("composite_score").alias("s"))


@q("T02_nulls_last", "SELECT doc_id, quality_tier FROM documents ORDER BY quality_tier DESC NULLS LAST, doc_id LIMIT 40")
def t02(spark, d):
    return Tables(spark, d).documents.orderBy(F.desc_nulls_last("quality_tier"), "doc_id").limit(40).select("doc_id", "quality_tier")


@q("T05_longest_first", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL ORDER BY n DESC, doc_id LIMIT 12")
def t05(spark, d):
    x = Tables(spark, d).documents.where("text is not null").select("doc_id", F.length("text").cast("long").alias("n"))
    return x.orderBy(F.desc("n"), "doc_id").limit(12)


@q("T04_T06_per_group_head", "SELECT topic, event_id, CAST(k AS INTEGER) AS k FROM (SELECT topic, event_id, row_number() OVER (PARTITION BY topic ORDER BY credibility DESC, event_id, created_at) AS k FROM narrative_events) WHERE k <= 3")
def t06(spark, d):
    return J.latest(Tables(spark, d).narrative_events, ["topic"], [F.desc("credibility"), F.col("event_id"), F.col("created_at")], 3).select("topic", "event_id", "k")


@q("T09_custom_order", "SELECT spread, string_agg(source, ',' ORDER BY CASE source WHEN 'PVM' THEN 0 ELSE 1 END, source) AS sources FROM (SELECT DISTINCT spread, source FROM rv_quotes) GROUP BY 1")
def t09(spark, d):
    x = Tables(spark, d).rv_quotes.select("spread", "source").distinct().groupBy("spread").agg(F.array_sort(F.collect_list(F.struct((F.col("source") != "PVM").alias("o"), "source"))).alias("s"))
    return x.select("spread", F.array_join(F.transform("s", lambda y: y["source"]), ",").alias("sources"))


@q("U02_union_all", "SELECT document_id AS id, 'document' AS kind FROM documents UNION ALL SELECT chunk_id, 'chunk' FROM chunks")
def u02(spark, d):
    t = Tables(spark, d)
    return t.documents.select(F.col("document_id").alias("id"), F.lit("document").alias("kind")).unionByName(t.chunks.select(F.col("chunk_id").alias("id"), F.lit("chunk").alias("kind")))


@q("U03_date_intersection", f"WITH {BARS} SELECT CAST(d AS VARCHAR) AS d FROM (SELECT d FROM bars WHERE symbol = '1-URGENT' INTERSECT SELECT d FROM bars WHERE symbol = '2-HIGH')")
def u03(spark, d):
    b = bars(Tables(spark, d))
    return b.where("symbol = '1-URGENT'").select("d").intersect(b.where("symbol = '2-HIGH'").select("d")).select(day("d").alias("d"))


@q("U04_distinct", "SELECT DISTINCT spread, tenor FROM rv_quotes")
def u04(spark, d):
    return Tables(spark, d).rv_quotes.select("spread", "tenor").distinct()


@q("U05_first_per_date", "SELECT obs_date, spread, min(quote_id) AS quote_id FROM rv_quotes GROUP BY 1, 2")
def u05(spark, d):
    return Tables(spark, d).rv_quotes.groupBy("obs_date", "spread").agg(F.min("quote_id").alias("quote_id"))


@q("U07_content_dedupe", "SELECT min(doc_id) AS doc_id, 'doc_' || substr(sha256(text), 1, 16) AS content_id, CAST(count(*) AS BIGINT) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 2")
def u07(spark, d):
    x = Tables(spark, d).documents.where("text is not null").select("doc_id", X.content_id(F.col("text")).alias("content_id"))
    return x.groupBy("content_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


QUERIES, SQL = q.queries, q.sql
