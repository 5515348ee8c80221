"""Quantities recorded in different units: find the unit each number really stands in.

The unit columns and the line of text are parsed into a currency scale and a physical base. Physical
identities tie the candidates together (a price per tonne is the price per barrel times barrels per
tonne, that is mass = density x volume; 42 gallons a barrel; 100 cents a dollar), so every candidate
turns the number into dollars per barrel. The candidate with the least log residual against the
level of the same series on the same day wins; a unit that a label names is believed unless
another fits clearly better. Levels come from a quantile sketch per series and day, so no group is
gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = ("USD/BBL", "USC/BBL", "USD/MT", "USC/GAL", "USD/GAL", "USD/M3")
#: Log distance that another unit must gain on the labelled one, and distance under which two fits count as equal.
LABEL_BELIEF, AMBIGUOUS = 0.35, 0.10

_MONEY_CENTS = r"(?:us\s*)?(?:cents?|cts?|¢|c)"
_MONEY_USD = r"(?:us\s*)?(?:\$|dlrs?|dollars?|usd|us\$)"
_PER = r"\s*(?:/|per\s+|p(?=mt\b))\s*"
_BBL, _MT, _GAL, _M3 = r"(?:bbls?|barrels?|b)\b", r"(?:metric\s+tons?|metric\s+tonnes?|tonnes?|tons?|mt|t)\b", r"(?:gallons?|gal|usg)\b", r"(?:cubic\s+met(?:re|er)s?|m3\b|m³|cbm)"


def unit_of(text: Column) -> Column:
    """The unit that a spelling or a line of text names, or null."""
    t = F.lower(text)
    edge = r"(?:^|[^a-z])"
    out = F.when(t.rlike(rf"{edge}cpg\b"), "USC/GAL")
    for money, base, code in (
        (_MONEY_CENTS, _BBL, "USC/BBL"), (_MONEY_CENTS, _GAL, "USC/GAL"), (_MONEY_USD, _BBL, "USD/BBL"),
        (_MONEY_USD, _GAL, "USD/GAL"), (_MONEY_USD, _M3, "USD/M3"), (_MONEY_USD, _MT, "USD/MT"),
    ):
        out = out.when(t.rlike(rf"{edge}{money}{_PER}{base}"), code)
    return out


def factor(unit: str) -> Column:
    """What turns a number in unit into dollars per barrel, by the row's product factors."""
    return {
        "USD/BBL": F.lit(1.0), "USC/BBL": F.lit(0.01), "USD/MT": 1 / F.col("bbl_per_mt"), "USC/GAL": F.col("gal_per_bbl") / 100,
        "USD/GAL": F.col("gal_per_bbl"), "USD/M3": 1 / F.col("bbl_per_m3"),
    }[unit]


def resolve_units(quotes: DataFrame, factors: DataFrame) -> DataFrame:
    """quotes(quote_id, obs_date, spread, tenor, value, unit, quote_text, ...) ->
    (quote_id, spread, tenor, value, unit_code, label_unit, text_unit, usd_per_bbl, residual, unique_fit).

    Outright prices: any unit may be right; without any label never a tonne or cubic metre. Differentials:
    a lone or agreed label holds; the size decides between disagreeing ones, and between dollars and cents
    per barrel if there is none. Null or NaN values and repeated sheets come out as they are (unit_code null
    for a null value). A spread without factors is per barrel; a series without any trusted quote keeps its label.
    """
    q = quotes.select("quote_id", "obs_date", "category", "spread", "tenor", "value", "unit", "quote_text")
    q = q.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    q = q.withColumn("label_unit", unit_of(F.col("unit"))).withColumn("text_unit", unit_of(F.col("quote_text")))
    f = factors.groupBy("spread").agg(*(F.max(c).alias(c) for c in ("bbl_per_mt", "bbl_per_m3", "gal_per_bbl")))
    q = q.join(F.broadcast(f), "spread", "left")  # 20 rows, fixed
    outright = F.coalesce(F.col("category").endswith("outright"), F.lit(False))
    q = q.withColumn("outright", outright)
    stated = F.coalesce("label_unit", "text_unit")
    in_usd = F.coalesce(*(F.when(stated == u, F.col("value") * factor(u)) for u in UNITS))
    series = F.when(F.col("outright"), F.lit("")).otherwise(F.coalesce("tenor", F.lit("")))
    q = q.withColumn("series", series).withColumn("stated_usd", F.when(F.col("label_unit").isNull() | F.col("text_unit").isNull() | (F.col("label_unit") == F.col("text_unit")), in_usd))
    level = lambda *by: q.where("stated_usd is not null").groupBy(*by).agg(F.percentile_approx("stated_usd", 0.5, 1000).alias("m"), F.count("*").alias("n"))
    day = level("spread", "series", "obs_date").withColumnsRenamed({"m": "day_level", "n": "day_n"})
    whole = level("spread", "series").select("spread", "series", F.col("m").alias("all_level"))
    q = q.join(day, ["spread", "series", "obs_date"], "left").join(whole, ["spread", "series"], "left")
    ref = F.when(F.col("day_n") >= 5, F.col("day_level")).otherwise(F.col("all_level"))
    q = q.withColumn("ref", F.nullif(ref, F.lit(0.0)))
    labelled = F.col("label_unit").isNotNull() | F.col("text_unit").isNotNull()
    options = []
    for rank, u in enumerate(UNITS):
        named = F.coalesce(F.col("label_unit") == u, F.lit(False)) | F.coalesce(F.col("text_unit") == u, F.lit(False))
        allowed = F.when(F.col("outright"), labelled | F.lit(u not in ("USD/MT", "USD/M3"))).when(labelled, named).otherwise(F.lit(u in ("USD/BBL", "USC/BBL")))
        usd = F.col("value") * F.coalesce(factor(u), F.lit(None).cast("double"))
        fit = F.abs(F.ln(F.abs(F.nullif(usd, F.lit(0.0)) / F.col("ref"))))
        fit = F.coalesce(fit, F.lit(50.0 if u != "USD/BBL" else 49.0))  # nothing to judge by: label, then dollars per barrel
        cost = fit + F.when(labelled & ~named, LABEL_BELIEF).otherwise(0.0)
        options.append(F.when(allowed & usd.isNotNull(), F.struct(cost.alias("cost"), F.lit(rank).alias("rank"), F.lit(u).alias("unit"), usd.alias("usd"), fit.alias("fit"))))
    ranked = F.array_sort(F.array_compact(F.array(*options)))
    q = q.withColumn("o", ranked).withColumn("best", F.get("o", F.lit(0))).withColumn("second", F.get("o", F.lit(1)))
    return q.select(
        "quote_id", "obs_date", "spread", "tenor", "value", F.col("best.unit").alias("unit_code"), "label_unit", "text_unit",
        F.col("best.usd").alias("usd_per_bbl"), F.when(F.col("best.fit") < 49, F.col("best.fit")).alias("residual"),
        F.coalesce(F.col("second.cost") - F.col("best.cost") > AMBIGUOUS, F.col("best").isNotNull()).alias("unique_fit"),
    )
