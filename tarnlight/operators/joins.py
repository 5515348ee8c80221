"""Join kinds that SQL engines spell by hand: as-of, latest k, bounded range, seasonal peers, first later event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def asof(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """left with the values of the latest right row of the same key at or before left_time (null if none; of equal times
    the largest values).

    The distinct times of both sides are united and swept once per key, then left takes its answers by an equi-join: no pairs
    are made, and a window holds a key's distinct times, however many left rows share them. ``known_asof`` is the operator for keys
    of any size and two times. Columns named _asof* are taken.
    """
    r = right.groupBy(F.col(by).alias("_asof_k"), F.col(right_time).alias("_asof_t")).agg(F.max(F.struct(*values)).alias("_asof_v"))
    asked = left.select(F.col(by).alias("_asof_k"), F.col(left_time).alias("_asof_t")).distinct()
    u = asked.withColumns({"_asof_l": F.lit(1), "_asof_v": F.lit(None).cast(dict(r.dtypes)["_asof_v"])}).unionByName(r.withColumn("_asof_l", F.lit(0)))
    w = W.partitionBy("_asof_k").orderBy("_asof_t", "_asof_l").rowsBetween(W.unboundedPreceding, 0)
    found = u.withColumn("_asof_v", F.last("_asof_v", ignorenulls=True).over(w)).where("_asof_l = 1").drop("_asof_l")
    out = left.join(found, (left[by] == found["_asof_k"]) & (left[left_time] == found["_asof_t"]), "left")
    return out.select(*[left[c] for c in left.columns], *[F.col(f"_asof_v.{v}").alias(v) for v in values])


#: Keys that skewed_join broadcasts at most.
HOT_KEYS = 4096


def skewed_join(rows: DataFrame, keys: DataFrame, on: list[str], weight: str) -> DataFrame:
    """rows joined with keys (one row a key) on columns of the same names, without a hot key in one task.

    weight tells how many rows a key has (roughly). A key with more than a HOT_KEYS-th part of all weight is broadcast, and there
    can be no more than HOT_KEYS such keys, whatever the data; the rest, whose keys are bounded in their turn, meet in a shuffle that
    the rows of hot keys don't enter. Null keys match nothing. Both inputs are read more than once: pass cheap or stored ones.
    """
    total = keys.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) > F.lit(float(total) / HOT_KEYS)
    heavy, light = keys.where(hot).drop(weight), keys.where(~hot).drop(weight)
    rest = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(heavy), on).unionByName(rest.join(light, on))


def latest(df: DataFrame, by: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The k first rows of each key in the order given, with their rank ``k``; for k = 1 prefer max_by."""
    return df.withColumn("k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("k") <= k)


def first_later(left: DataFrame, right: DataFrame, by: str, left_date: str, right_date: str, to: str) -> DataFrame:
    """left with the earliest right date of the same key strictly after left_date, null if none. Swept like ``asof``, backwards."""
    r = right.select(F.col(by).alias("_k"), F.col(right_date).alias("_t")).distinct()
    asked = left.select(F.col(by).alias("_k"), F.col(left_date).alias("_t")).distinct()
    u = asked.withColumns({"_l": F.lit(1), "_v": F.lit(None).cast(dict(r.dtypes)["_t"])}).unionByName(r.withColumns({"_l": F.lit(0), "_v": F.col("_t")}))
    w = W.partitionBy("_k").orderBy(F.desc("_t"), F.desc("_l")).rowsBetween(W.unboundedPreceding, 0)
    found = u.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_l = 1").drop("_l")
    out = left.join(found, (left[by] == found["_k"]) & (left[left_date] == found["_t"]), "left")
    return out.select(*[left[c] for c in left.columns], F.col("_v").alias(to))


def trailing_z(series: DataFrame, days: int, least: int, by: str = "symbol", date: str = "d", value: str = "close") -> Column:
    """z of a row against all rows of the last ``days`` calendar days (itself included), population deviation; 0 without
    spread, null for fewer than ``least`` rows."""
    w = W.partitionBy(by).orderBy(F.unix_date(date)).rangeBetween(-days, 0)
    sd = F.stddev_pop(value).over(w)
    return F.when(F.count(value).over(w) >= least, F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd).otherwise(0.0))


def seasonal_z(series: DataFrame, by: str = "symbol", date: str = "d", value: str = "close", near: int = 7, back_days: int = 5 * 365 + 30, least: int = 3) -> DataFrame:
    """(by, date, z): each reading against the earlier ones of the same season (circular distance of the day of the year up to
    ``near``) in the look-back. The join is on the season bucket and its neighbours, so it is an equi-join."""
    width = near + 1
    n_buckets = 366 // width + 1
    s = series.where(F.col(value).isNotNull()).select(F.col(by).alias("by"), F.col(date).alias("d"), F.col(value).alias("v"), F.dayofyear(date).alias("doy"))
    a = s.withColumn("b", F.explode(F.array_distinct(F.array(*[F.pmod((F.pmod(F.col("doy") + o - 1, F.lit(365)) / width).cast("int"), F.lit(n_buckets)) for o in sorted({*range(-near, near + 1, max(1, near // 2)), near})]))))
    p = s.select(F.col("by").alias("pby"), F.col("d").alias("pd"), F.col("v").alias("pv"), F.col("doy").alias("pdoy"), F.pmod((F.pmod(F.col("doy") - 1, F.lit(365)) / width).cast("int"), F.lit(n_buckets)).alias("pb"))
    gap = F.abs(F.col("doy") - F.col("pdoy"))
    on = (F.col("by") == F.col("pby")) & (F.col("b") == F.col("pb")) & (F.col("pd") < F.col("d")) & (F.col("pd") >= F.date_sub("d", back_days)) & (F.least(gap, 365 - gap) <= near)
    g = a.join(p, on).groupBy("by", "d", "v").agg(F.count("*").alias("n"), F.avg("pv").alias("m"), F.stddev_pop("pv").alias("sd"))
    return g.where((F.col("n") >= least) & (F.col("sd") > 0)).select(F.col("by").alias(by), F.col("d").alias(date), ((F.col("v") - F.col("m")) / F.col("sd")).alias("z"), "n")
