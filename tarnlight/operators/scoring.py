"""Event strength, daily topic scores and theme rollup."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScoringConfig:
    """Fixed values of the published configuration; any of them can be given."""

    bucket: dict = field(default_factory=lambda: {"official_data": 1.0, "official_reports": 0.95, "institutional_public": 0.85, "sellside_private": 0.82, "authoritative_news": 0.72, "social_open": 0.45, "social_private_manual": 0.3})
    verification: dict = field(default_factory=lambda: {"officially_confirmed": 1.0, "partially_confirmed": 0.85, "unverified": 0.6, "refuted": 0.2})
    horizon: dict = field(default_factory=lambda: {"intraday": 0.85, "swing": 1.0, "medium_term": 1.1})
    sign: dict = field(default_factory=lambda: {"bullish": 1.0, "bearish": -1.0, "mixed": 0.25, "neutral": 0.0})
    rumor_penalty: float = 0.18
    crowd_from: int = 4
    crowd_step: float = 0.04
    official_bonus: float = 0.12
    free_bonus: float = 0.05
    persistence_days: int = 20
    persistence_decay: float = 5.0


THEMES = {
    "supply": ("supply_disruption", "opec_policy", "production_restart", "weather_risk", "shipping_disruption"),
    "demand": ("demand_reacceleration", "refining_margin_shift"),
    "inventories": ("inventory_draw", "inventory_build"),
    "macro": ("usd_rates_pressure", "macro_growth_fear"),
    "geopolitics": ("geopolitical_risk", "sanctions_risk"),
    "refining": ("refinery_turnaround", "crack_spread_signal"),
    "positioning": ("speculator_buildup", "cta_flow"),
    "freight": ("floating_storage", "tanker_rates"),
}


def lookup(c: Column, table: dict, default) -> Column:
    """Literal map with a default; the optimizer folds the map."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), F.lit(default))


def theme_of(topic: Column, themes: dict = THEMES, fallback: str = "other") -> Column:
    return lookup(topic, {t: k for k, ts in themes.items() for t in ts}, fallback)


def event_strength(cfg: ScoringConfig = ScoringConfig()) -> Column:
    """Signed strength of an event row; 0 counts as missing for credibility, novelty (then 0.5) and confidence (then their mean)."""
    cred, nov = (F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(0.5)) for c in ("credibility", "novelty"))
    conf = F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), (cred + nov) / 2)
    quality = 0.45 * cred + 0.35 * nov + 0.20 * conf
    s = lookup(F.col("direction"), cfg.sign, 0.0) * lookup(F.col("source_bucket"), cfg.bucket, 0.5) * lookup(F.col("verification_status"), cfg.verification, 0.7) * lookup(F.col("horizon"), cfg.horizon, 1.0) * quality
    s = s * F.when(F.col("rumor_flag"), 1 - cfg.rumor_penalty).otherwise(1.0) * F.when(F.col("verification_status") == "officially_confirmed", 1 + cfg.official_bonus).otherwise(1.0)
    return F.round(s * F.when(F.col("cost_level") == "free", 1 + cfg.free_bonus).otherwise(1.0), 6)


def persistence(cells: DataFrame, key: list[str], date: str, sign: str, days: int = 20, decay: float = 5.0) -> DataFrame:
    """cells with persistence: e^(-offset/decay) summed over earlier dates of the same sign within ``days``, walking back over
    absent dates and ending at the first date of another sign; halved and at most 1.

    The range join is an equi-join: dates fall into bins of ``days``, and an earlier date is offered to its own bin and the next.
    """
    bin_of = lambda c: F.expr(f"unix_date({c}) div {days}")
    prior = cells.select(*[F.col(k).alias(f"_{k}") for k in key], F.col(date).alias("_d"), F.col(sign).alias("_s"), F.explode(F.array(bin_of(date), bin_of(date) + 1)).alias("_b"))
    mine = cells.select(*key, date, sign, bin_of(date).alias("_bin"))
    cond = (mine["_bin"] == prior["_b"]) & (prior["_d"] < mine[date]) & (prior["_d"] >= F.date_sub(mine[date], days))
    for k in key:
        cond = cond & mine[k].eqNullSafe(prior[f"_{k}"])
    pairs = mine.join(prior, cond).select(*key, date, sign, F.datediff(date, "_d").alias("off"), (F.col("_s") * F.col(sign)).alias("same"))
    stop = pairs.groupBy(*key, date).agg(F.min(F.when(F.col("same") <= 0, F.col("off"))).alias("stop"), F.collect_list(F.struct("off", "same")).alias("p"))
    total = F.aggregate(F.filter("p", lambda x: x["off"] < F.coalesce(F.col("stop"), F.lit(days + 1))), F.lit(0.0), lambda a, x: a + F.exp(-x["off"] / decay))
    got = stop.select(*key, date, F.least(F.lit(1.0), total / 2).alias("_p"))
    got = got.withColumnsRenamed({c: f"_{c}" for c in [*key, date]})
    same_cell = cells[date] == got[f"_{date}"]
    for k in key:
        same_cell = same_cell & cells[k].eqNullSafe(got[f"_{k}"])
    out = cells.join(got, same_cell, "left").select(*[cells[c] for c in cells.columns], "_p")
    return out.withColumn("persistence", F.when(F.col(sign) == 0, 0.0).otherwise(F.coalesce("_p", F.lit(0.0)))).drop("_p")


def daily_scores(events: DataFrame, cfg: ScoringConfig = ScoringConfig()) -> DataFrame:
    """events(score_date, commodity, topic, source_key, direction, source_bucket, ...) -> one row per (score_date, commodity,
    topic). Null sources don't count towards breadth; rows without a date are left out."""
    e = events.where("score_date is not null").withColumns({"strength": event_strength(cfg), "sgn": lookup(F.col("direction"), cfg.sign, 0.0)})
    official = F.col("source_bucket").isin("official_data", "official_reports")
    informal = F.col("source_bucket").isin("institutional_public", "sellside_private", "social_open", "social_private_manual")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    cells = e.groupBy("score_date", "commodity", "topic").agg(
        F.count("*").alias("event_count"), F.sum("strength").alias("raw_score"), F.signum(F.sum("sgn")).alias("net_sign"),
        F.least(F.lit(1.0), F.count_distinct("source_key") / 5).alias("breadth"),
        F.coalesce(F.abs(F.avg(F.when(official, F.col("sgn"))) - F.avg(F.when(informal, F.col("sgn")))) / 2, F.lit(0.0)).alias("source_divergence"),
        share(F.col("verification_status") == "officially_confirmed").alias("confirmed_ratio"), share(F.col("source_bucket") == "authoritative_news").alias("news_ratio"),
        share(F.col("source_bucket").startswith("social")).alias("chatter_ratio"),
    )
    cells = persistence(cells, ["commodity", "topic"], "score_date", "net_sign", cfg.persistence_days, cfg.persistence_decay)
    crowd = F.greatest(F.lit(0), F.col("event_count") - cfg.crowd_from) * cfg.crowd_step
    return cells.withColumn("narrative_score", F.col("raw_score") * (1 + 0.25 * F.col("persistence")) * (1 + 0.40 * F.col("breadth")) - crowd)


def theme_rollup(daily: DataFrame, themes: dict = THEMES, top: int = 5) -> DataFrame:
    """Topic scores to (score_date, commodity, theme): sums, event-weighted means, the ``top`` subthemes by size."""
    w = F.coalesce(F.nullif(F.col("event_count"), F.lit(0)), F.lit(1))
    mean = lambda c: F.try_divide(F.sum(F.col(c) * w), F.sum(w))
    ranked = F.array_sort(F.collect_list(F.struct((-F.abs("narrative_score")).alias("neg"), F.col("topic"), F.col("narrative_score"))))
    out = daily.withColumn("theme", theme_of(F.col("topic"), themes)).groupBy("score_date", "commodity", "theme").agg(
        F.sum("narrative_score").alias("narrative_score"), F.sum("raw_score").alias("raw_score"), F.sum("event_count").alias("event_count"),
        F.count("*").alias("subtheme_count"), mean("persistence").alias("persistence"), mean("breadth").alias("breadth"), ranked.alias("_r"),
    )
    return out.withColumn("top_subthemes", F.transform(F.slice("_r", 1, top), lambda x: F.struct(x["topic"].alias("topic"), x["narrative_score"].alias("score")))).drop("_r")
