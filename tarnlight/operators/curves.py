"""Detectors over quoted curves: butterflies, gaps between sources, curve shape, z against short history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tarnlight.functions.dates import tenor_number


def curve(quotes: DataFrame) -> DataFrame:
    """(obs_date, source, spread, n, value): monthly tenors only; of several quotes the one of the largest quote_id."""
    q = quotes.withColumn("n", tenor_number(F.col("tenor"))).where("n is not null and value is not null")
    return q.groupBy("obs_date", "source", "spread", "n").agg(F.max_by("value", "quote_id").alias("value"))


def butterflies(points: DataFrame, least: float = 0.30, from_n: int = 3) -> DataFrame:
    """v(n-1) - 2 v(n) + v(n+1) where both neighbours are quoted."""
    w = W.partitionBy("obs_date", "source", "spread").orderBy("n")
    fly = F.lag("value").over(w) - 2 * F.col("value") + F.lead("value").over(w)
    x = points.withColumns({"fly": fly, "near": (F.lag("n").over(w) == F.col("n") - 1) & (F.lead("n").over(w) == F.col("n") + 1)})
    return x.where(F.col("near") & (F.col("n") >= from_n) & (F.abs("fly") >= least)).select("obs_date", "source", "spread", "n", "fly")


def source_gaps(quotes: DataFrame, primary: str, least: float = 0.20) -> DataFrame:
    """Primary minus other source per (obs_date, spread, contract)."""
    v = quotes.where("value is not null and contract is not null").groupBy("obs_date", "spread", "contract", "source").agg(F.max_by("value", "quote_id").alias("value"))
    p = v.where(F.col("source") == primary).select("obs_date", "spread", "contract", F.col("value").alias("ref"))
    o = v.where(F.col("source") != primary)
    return o.join(p, ["obs_date", "spread", "contract"]).withColumn("gap", F.col("ref") - F.col("value")).where(F.abs("gap") >= least)


def curve_shape(points: DataFrame) -> DataFrame:
    """Last minus first tenor, curves of two points or more."""
    g = points.groupBy("obs_date", "source", "spread").agg(F.count("*").alias("points"), F.min_by("value", "n").alias("front"), F.max_by("value", "n").alias("back"))
    return g.where("points >= 2").withColumn("slope", F.col("back") - F.col("front"))


def history_z(points: DataFrame, least: int = 8) -> DataFrame:
    """z of each value against all earlier dates of its series, population deviation."""
    w = W.partitionBy("source", "spread", "n").orderBy("obs_date").rowsBetween(W.unboundedPreceding, -1)
    x = points.withColumns({"seen": F.count("value").over(w), "m": F.avg("value").over(w), "sd": F.stddev_pop("value").over(w)})
    return x.where((F.col("seen") >= least - 1) & (F.col("sd") >= 1e-6)).withColumn("z", (F.col("value") - F.col("m")) / F.col("sd")).drop("m", "sd")


def provisional_z(points: DataFrame, least: int = 8, beyond: float = 1.0) -> DataFrame:
    """(obs_date, source, spread, n, z) of the latest value of each series against all before it, where it has at least ``least``
    values and lies at least ``beyond`` deviations off."""
    last = W.partitionBy("source", "spread", "n")
    x = points.withColumn("last", F.max("obs_date").over(last))
    return history_z(x, least).where((F.col("obs_date") == F.col("last")) & (F.abs("z") >= beyond)).select("obs_date", "source", "spread", "n", "z")


def board(quotes: DataFrame, primary: str) -> DataFrame:
    """(angle, obs_date, source, spread, severity): what the four detectors find at the latest date of the curves."""
    p = curve(quotes)
    found = [
        ("butterfly", butterflies(p).withColumn("severity", F.abs("fly"))),
        ("gap", source_gaps(quotes, primary).withColumn("severity", F.abs("gap"))),
        ("rich_cheap", provisional_z(p).withColumn("severity", F.abs("z"))),
        ("shape", curve_shape(p).withColumn("severity", F.abs("slope"))),
    ]
    every = None
    for angle, x in found:
        x = x.select(F.lit(angle).alias("angle"), "obs_date", "source", "spread", "severity")
        every = x if every is None else every.unionByName(x)
    return every.join(p.agg(F.max("obs_date").alias("obs_date")), "obs_date").select("angle", "obs_date", "source", "spread", "severity")
