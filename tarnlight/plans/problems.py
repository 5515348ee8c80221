"""Queries of the general problems 1, 4 and 5 over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.operators.known_asof import entity_key, known_asof, micros
from tarnlight.operators.timestamps import FIXED_OFFSETS, MONTHS, with_utc_micros
from tarnlight.operators.units import resolve_units
from tarnlight.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = table(spark, sf_dir, "market_prices").where("close is not null and released_at is not null")
    trades = table(spark, sf_dir, "paper_trades")
    facts = prices.select(entity_key("symbol").alias("ent"), micros("price_time").alias("valid"), micros("released_at").alias("known"), F.col("price_id").alias("fact_id"))
    events = trades.select(entity_key("factor_symbol").alias("ent"), micros("created_at").alias("t"), F.col("trade_id").alias("event_id"))
    return known_asof(facts, events).select(F.col("event_id").alias("trade_id"), F.col("fact_id").alias("price_id")).distinct()


def p1_trade_factor_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trade with the factor reading it could know and the reading's age in seconds."""
    prices = table(spark, sf_dir, "market_prices").select("price_id", "price_time", "released_at", F.col("close").alias("factor_close"))
    trades = table(spark, sf_dir, "paper_trades").select("trade_id", "factor_symbol", "created_at")
    found = p1_found(spark, sf_dir).join(prices, "price_id")
    age = (micros("created_at") - micros("price_time")) / 1_000_000
    return trades.join(found, "trade_id", "left").select("trade_id", "factor_symbol", "price_id", "factor_close", F.floor(age).alias("age_s"))


def p4_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_units(table(spark, sf_dir, "rv_quotes"), table(spark, sf_dir, "product_factors"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_resolved(spark, sf_dir).where("value is not null and unit_code <> 'USD/BBL'").select("quote_id", "unit_code").distinct()


def p4_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the label and the line of text name, and what the number really stands in."""
    return p4_resolved(spark, sf_dir).where("value is not null").select("quote_id", "label_unit", "text_unit", "unit_code").distinct()


def p5_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "sources")
    by_id = F.broadcast(sources.groupBy("source_id").agg(F.max("home_zone").alias("home_zone")))  # 60 rows, fixed
    by_name = F.broadcast(sources.groupBy("source_name").agg(F.max("home_zone").alias("home_zone")))
    docs = table(spark, sf_dir, "documents").select("source_id", F.lit("documents").alias("record_table"), F.col("doc_id").cast("string").alias("record_id"), F.col("published_at").alias("written"))
    events = table(spark, sf_dir, "narrative_events").select("source_name", F.lit("narrative_events").alias("record_table"), F.col("event_id").alias("record_id"), F.col("event_time").alias("written"))
    cols = ("record_table", "record_id", "written", "home_zone")
    both = docs.join(by_id, "source_id", "left").select(*cols).unionByName(events.join(by_name, "source_name", "left").select(*cols))
    return with_utc_micros(both, "written", "home_zone", "utc_us")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_instants(spark, sf_dir).where("utc_us is not null").select("record_table", "record_id", "utc_us").distinct()


QUERIES = {"p1_found": p1_found, "p1_trade_factor_value": p1_trade_factor_value, "p4_found": p4_found, "p4_resolved": p4_resolved, "p4_units": p4_units, "p5_found": p5_found, "p5_instants": p5_instants}

_MONEY = r"(us\s*)?(\$|dlrs?|dollars?|usd|us\$)\s*(/|per\s+|p)\s*"
_CENTS = r"(us\s*)?(cents?|cts?|¢|c)\s*(/|per\s+)\s*"
_EDGE = "(^|[^a-z])"


def _unit_sql(c: str) -> str:
    has = lambda rx: f"regexp_matches(lower({c}), '{_EDGE}{rx}')"
    bbl, gal = r"(bbls?|barrels?|b)\b", r"(gallons?|gal|usg)\b"
    return f"""CASE WHEN {has(r'cpg' + chr(92) + 'b')} THEN 'USC/GAL' WHEN {has(_CENTS + bbl)} THEN 'USC/BBL' WHEN {has(_CENTS + gal)} THEN 'USC/GAL' WHEN {has(_MONEY + bbl)} THEN 'USD/BBL'
 WHEN {has(_MONEY + gal)} THEN 'USD/GAL' WHEN {has(_MONEY + '(cubic met|m3|m³|cbm)')} THEN 'USD/M3' WHEN {has(_MONEY + '(metric ton|tonnes?|tons?|mt|t' + chr(92) + 'b)')} THEN 'USD/MT' END"""


#: The same rule with exact medians: which unit brings the number nearest to the level of its series.
_P4 = f"""WITH q AS (SELECT *, {_unit_sql('unit')} AS a, {_unit_sql('quote_text')} AS b, category LIKE '%outright' AS o, CASE WHEN category LIKE '%outright' THEN '' ELSE coalesce(tenor, '') END AS s FROM rv_quotes WHERE value IS NOT NULL),
u AS (SELECT quote_id, x.* FROM (SELECT quote_id, unnest([{{'r': 0, 'u': 'USD/BBL', 'f': 1.0::DOUBLE}}, {{'r': 1, 'u': 'USC/BBL', 'f': 0.01}}, {{'r': 2, 'u': 'USD/MT', 'f': 1 / bbl_per_mt}}, {{'r': 3, 'u': 'USC/GAL', 'f': gal_per_bbl / 100}}, {{'r': 4, 'u': 'USD/GAL', 'f': gal_per_bbl}}, {{'r': 5, 'u': 'USD/M3', 'f': 1 / bbl_per_m3}}]) AS x FROM q JOIN product_factors USING (spread))),
t AS (SELECT spread, s, obs_date, value * f AS usd FROM q JOIN u USING (quote_id) WHERE u = coalesce(a, b) AND (a IS NULL OR b IS NULL OR a = b)),
dl AS (SELECT spread, s, obs_date, median(usd) AS m, count(*) AS n FROM t GROUP BY 1, 2, 3), al AS (SELECT spread, s, median(usd) AS m FROM t GROUP BY 1, 2),
c AS (SELECT q.quote_id, u.u, u.r, abs(ln(abs(q.value * u.f / CASE WHEN dl.n >= 5 THEN dl.m ELSE al.m END))) + CASE WHEN (a IS NOT NULL OR b IS NOT NULL) AND u.u IS DISTINCT FROM a AND u.u IS DISTINCT FROM b THEN 0.35 ELSE 0 END AS cost
 FROM q JOIN u USING (quote_id) LEFT JOIN dl ON dl.spread = q.spread AND dl.s = q.s AND dl.obs_date = q.obs_date LEFT JOIN al ON al.spread = q.spread AND al.s = q.s
 WHERE CASE WHEN o THEN a IS NOT NULL OR b IS NOT NULL OR u.u NOT IN ('USD/MT', 'USD/M3') WHEN a IS NOT NULL OR b IS NOT NULL THEN u.u IN (a, b) ELSE u.u IN ('USD/BBL', 'USC/BBL') END), best AS (SELECT quote_id, arg_min(u, (cost, r)) AS unit_code FROM c GROUP BY 1)"""

_TM = r"(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:[.,](\d+))?)?"
_ZN = r"\s*(Z|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Z]{2,4}|北京时间)?"
_MN = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
_FORMS = (
    (rf"(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})(?:[T ]{_TM}{_ZN})?", "y mo d h mi s f z"),
    (rf"(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}}){_ZN}", "y mo d h mi s z"),
    (rf"(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}) {_TM} ([AP])M", "mo d y h mi s f ap"),
    (rf"(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}) {_TM}", "d mo y h mi s f"),
    (rf"(?:[A-Z][a-z]{{2}}, )?(\d{{1,2}}) {_MN} (\d{{4}}),? {_TM}{_ZN}", "d mon y h mi s f z"),
    (rf"{_MN} (\d{{1,2}}), (\d{{4}}) {_TM} ([AP])M{_ZN}", "mon d y h mi s f ap z"),
    (rf"(\d{{4}})年(\d{{1,2}})月(\d{{1,2}})日 {_TM}", "y mo d h mi s f"),
)


def _p5_sql() -> str:
    fields = "y mo mon d h mi s f ap z".split()
    some = " UNION ALL ".join(
        f"SELECT t, i, z0, " + ", ".join(f"nullif(regexp_extract(v, '^{rx}$', {names.split().index(k) + 1}), '') AS {k}" if k in names.split() else f"NULL AS {k}" for k in fields) + f" FROM r WHERE regexp_full_match(v, '{rx}')"
        for rx, names in _FORMS
    )
    fixed = " ".join(f"WHEN '{k}' THEN {v}" for k, v in FIXED_OFFSETS.items())
    months = " ".join(f"WHEN '{m.capitalize()}' THEN {i + 1}" for i, m in enumerate(MONTHS))
    return rf"""WITH r AS (SELECT 'documents' AS t, CAST(doc_id AS VARCHAR) AS i, trim(published_at) AS v, published_at AS w, home_zone AS z0 FROM documents LEFT JOIN sources USING (source_id)
 UNION ALL SELECT 'narrative_events', event_id, trim(event_time), event_time, home_zone FROM narrative_events LEFT JOIN sources USING (source_name)),
e AS (SELECT t, i, TRY_CAST(substr(v, 1, 10) AS BIGINT) * 1000000 + TRY_CAST(rpad(replace(substr(v, 11), '.', ''), 6, '0') AS BIGINT) AS us FROM r WHERE regexp_full_match(v, '\d{{10}}(\.\d{{1,6}}|\d{{3}})?')),
p AS ({some}),
n AS (SELECT t, i, z, z0, TRY_CAST(y || '-' || lpad(CAST(coalesce(CAST(mo AS INTEGER), CASE mon {months} END) AS VARCHAR), 2, '0') || '-' || lpad(d, 2, '0') AS DATE) AS day, CAST(coalesce(h, '0') AS INTEGER) % CASE WHEN ap IS NULL THEN 99 ELSE 12 END + CASE WHEN ap = 'P' THEN 12 ELSE 0 END AS h, CAST(coalesce(mi, '0') AS INTEGER) AS mi, CAST(coalesce(s, '0') AS INTEGER) AS s, CAST(substr(rpad(coalesce(f, '0'), 6, '0'), 1, 6) AS BIGINT) AS f FROM p),
l AS (SELECT *, CAST(day AS TIMESTAMP) + to_hours(h) + to_minutes(mi) + to_seconds(s) AS ts FROM n WHERE day IS NOT NULL AND h < 24 AND mi < 60 AND s < 60),
o AS (SELECT t, i, ts, f, CASE WHEN z ~ '^[+-]' THEN (CASE WHEN z LIKE '-%' THEN -1 ELSE 1 END) * (CAST(substr(z, 2, 2) AS INTEGER) * 60 + CAST(coalesce(nullif(right(replace(substr(z, 4), ':', ''), 2), ''), '0') AS INTEGER)) ELSE CASE z {fixed} END END AS off, CASE WHEN z IS NULL THEN z0 WHEN z = 'ET' THEN 'America/New_York' END AS place FROM l),
w AS (SELECT *, ts AT TIME ZONE place AS inst FROM o),
g AS (SELECT t, i, CASE WHEN place IS NULL THEN epoch_us(ts) - CAST(off AS BIGINT) * 60000000 WHEN (inst - INTERVAL 1 HOUR) AT TIME ZONE place = ts THEN epoch_us(inst) - 3600000000 ELSE epoch_us(inst) END + f AS us FROM w),
found AS (SELECT DISTINCT t AS record_table, i AS record_id, us AS utc_us FROM (SELECT * FROM e UNION ALL SELECT * FROM g) WHERE us IS NOT NULL)"""


_P1 = """
SELECT t.trade_id, p.price_id, p.close, p.price_time,
       row_number() OVER (PARTITION BY t.trade_id ORDER BY p.price_time DESC, p.released_at DESC, p.price_id) AS k
FROM paper_trades t JOIN market_prices p ON lower(trim(p.symbol)) = lower(trim(t.factor_symbol))
 AND p.close IS NOT NULL AND p.released_at <= t.created_at AND p.price_time <= t.created_at
"""
SQL = {
    "p1_found": f"SELECT trade_id, price_id FROM ({_P1}) WHERE k = 1",
    "p1_trade_factor_value": f"""SELECT t.trade_id, t.factor_symbol, x.price_id, x.close AS factor_close,
 CAST(floor((epoch_us(t.created_at) - epoch_us(x.price_time)) / 1000000.0) AS BIGINT) AS age_s
 FROM paper_trades t LEFT JOIN ({_P1}) x ON x.trade_id = t.trade_id AND x.k = 1""",
    "p4_found": f"{_P4} SELECT quote_id, unit_code FROM best WHERE unit_code <> 'USD/BBL'",
    "p4_units": f"{_P4} SELECT DISTINCT q.quote_id, a AS label_unit, b AS text_unit, unit_code FROM q LEFT JOIN best USING (quote_id)",
    "p5_found": f"{_p5_sql()} SELECT record_table, record_id, utc_us FROM found",
    "p5_instants": f"{_p5_sql()} SELECT r.t AS record_table, r.i AS record_id, r.w AS written, r.z0 AS home_zone, found.utc_us FROM r LEFT JOIN found ON found.record_table = r.t AND found.record_id = r.i",
}
