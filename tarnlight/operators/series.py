"""Windows over series, one row per (symbol, date): rolling statistics, recursive smoothing, streaks, equity.

A series is bounded by the calendar (finer data goes through ``daily_bars`` first), so a window partition is a
series, never a share of the table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def over(key: str = "symbol", date: str = "d"):
    return W.partitionBy(key).orderBy(date)


def daily_bars(ticks: DataFrame, symbol: Column, day: Column, price: str, order: str) -> DataFrame:
    """(symbol, d, open, high, low, close, volume) from finer rows; open and close by ``order``."""
    return ticks.groupBy(symbol.alias("symbol"), day.alias("d")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count("*").cast("double").alias("volume")
    )


def gated(agg: Column, c: str, w, least: int) -> Column:
    """A window aggregate that needs at least so many values, else null."""
    return F.when(F.count(c).over(w) >= least, agg.over(w))


def rolling_mean(c: str, n: int, least: int | None = None, w=None) -> Column:
    w = (w or over()).rowsBetween(-(n - 1), 0)
    return gated(F.avg(c), c, w, least or n)


def rolling_z(c: str, n: int = 30, least: int = 5, w=None) -> Column:
    """Against the n rows before, sample deviation; null for fewer than ``least`` or no spread."""
    w = (w or over()).rowsBetween(-n, -1)
    return F.try_divide(F.col(c) - gated(F.avg(c), c, w, least), F.nullif(gated(F.stddev_samp(c), c, w, least), F.lit(0.0)))


def percent_b(c: str = "close", n: int = 20, width: float = 2.0, w=None) -> Column:
    """Position in the band mean +- width * population deviation; 0.5 in the warm-up and on flat stretches."""
    w = (w or over()).rowsBetween(-(n - 1), 0)
    mid, dev = gated(F.avg(c), c, w, n), gated(F.stddev_pop(c), c, w, n)
    return F.coalesce(F.try_divide(F.col(c) - (mid - width * dev), F.nullif(2 * width * dev, F.lit(0.0))), F.lit(0.5))


def slope_percent(c: str, back: int = 5, w=None) -> Column:
    before = F.lag(c, back).over(w or over())
    return F.try_divide(F.col(c) - before, before) * 100


def volume_ratio(c: str = "volume", n: int = 20, least: int = 5, w=None) -> Column:
    w = (w or over()).rowsBetween(-(n - 1), 0)
    return F.coalesce(F.try_divide(F.col(c), F.nullif(gated(F.avg(c), c, w, least), F.lit(0.0))), F.lit(1.0))


def forward_return(h: int, c: str = "close", w=None) -> Column:
    return F.try_divide(F.lead(c, h).over(w or over()), F.nullif(F.col(c), F.lit(0.0))) - 1


def streak(df: DataFrame, c: str, key: str = "symbol", date: str = "d", to: str = "streak") -> DataFrame:
    """How many rows in a row the value has held (gaps and islands)."""
    w = over(key, date)
    new = F.coalesce((~F.col(c).eqNullSafe(F.lag(c).over(w))).cast("int"), F.lit(1))
    first = F.when(F.row_number().over(w) == 1, 1).otherwise(new)
    x = df.withColumn("_new", first).withColumn("_island", F.sum("_new").over(w))
    return x.withColumn(to, F.row_number().over(W.partitionBy(key, "_island").orderBy(date))).drop("_new", "_island")


def drawdown(c: str, w=None) -> Column:
    return F.try_divide(F.col(c), F.max(c).over((w or over()).rowsBetween(W.unboundedPreceding, 0))) - 1


def compounded(growth: Column, w=None) -> Column:
    """Running product of growth factors."""
    return F.product(growth).over((w or over()).rowsBetween(W.unboundedPreceding, 0))


def running_sum(c: Column, w=None) -> Column:
    return F.sum(c).over((w or over()).rowsBetween(W.unboundedPreceding, 0))


def turnover(position: str, w=None) -> Column:
    return F.abs(F.col(position) - F.coalesce(F.lag(position).over(w or over()), F.lit(0.0)))


def _smooth(x: pd.Series, alpha: float) -> pd.Series:
    return x.ewm(alpha=alpha, adjust=False).mean()


def _true_range(p: pd.DataFrame) -> pd.Series:
    before = p["close"].shift()
    return np.fmax(p["high"] - p["low"], np.fmax((p["high"] - before).abs(), (p["low"] - before).abs()))


def _recursive(p: pd.DataFrame, n: int) -> pd.DataFrame:
    p = p.sort_values("d")
    a = 1.0 / n
    change = p["close"].diff()
    gain, loss = _smooth(change.clip(lower=0), a), _smooth((-change).clip(lower=0), a)
    span = _smooth(_true_range(p), a)
    up, down = p["high"].diff(), -p["low"].diff()
    directed = []
    for mine, other in ((up, down), (down, up)):
        move = mine.where((mine > other) & (mine > 0), 0.0)
        move[mine.isna()] = np.nan
        directed.append(100 * _smooth(move, a) / span.where(span != 0))
    both = directed[0] + directed[1]
    adx = _smooth(100 * (directed[0] - directed[1]).abs() / both.where(both != 0), a).fillna(0.0)
    ema = lambda x, s: _smooth(x, 2.0 / (s + 1))
    line = ema(p["close"], 12) - ema(p["close"], 26)
    signal = ema(line, 9)
    out = pd.DataFrame({"symbol": p["symbol"], "d": p["d"], "rsi": 100 * gain / (gain + loss), "atr": span, "adx": adx, "macd": line, "macd_signal": signal, "macd_hist": line - signal})
    return out


def recursive_indicators(bars: DataFrame, n: int = 14) -> DataFrame:
    """RSI, ATR and ADX with Wilder smoothing and MACD 12/26/9 per (symbol, d). The recursion runs per series in pandas; NaN
    becomes null."""
    schema = f"symbol string, d {dict(bars.dtypes)['d']}, rsi double, atr double, adx double, macd double, macd_signal double, macd_hist double"
    out = bars.select("symbol", "d", "high", "low", "close").groupBy("symbol").applyInPandas(lambda p: _recursive(p, n), schema)
    return out.select("symbol", "d", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in out.columns[2:]])


REGIMES = ("shock", "stretched_up", "stretched_down", "trend_up", "trend_down", "range")


def regimes(bars: DataFrame, adx_trend: float = 20.0, rsi_high: float = 75.0, rsi_low: float = 25.0, band_high: float = 1.0, band_low: float = 0.0, shock_ratio: float = 1.5, strict: bool = False) -> DataFrame:
    """Tags, primary tag (in the order of REGIMES) and streak per (symbol, d). While the moving average warms up, a strong trend counts
    as down unless strict, which leaves it without direction."""
    x = bars.join(recursive_indicators(bars), ["symbol", "d"])
    w = over()
    x = x.withColumns({"sma50": rolling_mean("close", 50), "pctb": percent_b()}).withColumn("slope", slope_percent("sma50"))
    x = x.withColumn("atr_ratio", F.try_divide(F.col("atr"), F.nullif(gated(F.avg("atr"), "atr", w.rowsBetween(-59, 0), 20), F.lit(0.0))))
    false = F.lit(False)
    above, rising = F.coalesce(F.col("close") > F.col("sma50"), false), F.coalesce(F.col("slope") >= 0, false)
    known = F.col("slope").isNotNull() if strict else F.lit(True)
    trend = F.coalesce(F.col("adx") >= adx_trend, false)
    flags = {
        "shock": F.coalesce(F.col("atr_ratio") > shock_ratio, false),
        "stretched_up": F.coalesce(F.col("rsi") > rsi_high, false) | (F.col("pctb") > band_high),
        "stretched_down": F.coalesce(F.col("rsi") < rsi_low, false) | (F.col("pctb") < band_low),
        "trend_up": trend & above & rising,
        "trend_down": trend & ~above & ~rising & known,
    }
    x = x.withColumns(flags).withColumn("range", ~(F.col("trend_up") | F.col("trend_down")))
    tags = F.array_compact(F.array(*[F.when(F.col(r), F.lit(r)) for r in REGIMES]))
    x = x.withColumn("tags", tags).withColumn("primary", F.get("tags", F.lit(0)))
    return streak(x.withColumn("primary", F.coalesce("primary", F.lit("range"))), "primary")
