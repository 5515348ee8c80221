"""A trading ledger as a relation: what is open, what each closed trade made, how signals compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlight.operators import joins as J


def with_exits(trades: DataFrame) -> DataFrame:
    """trades(trade_id, symbol, d, direction, ...) with exit_date, the first later date on which the same symbol is traded the
    other way (LONG, SHORT); null while the trade is open, for other directions and for null keys."""
    other = F.when(F.col("direction") == "LONG", "SHORT").when(F.col("direction") == "SHORT", "LONG")
    t = trades.withColumn("side", F.concat_ws("|", "symbol", other))
    turns = trades.where("symbol is not null and direction in ('LONG', 'SHORT') and d is not null").select(F.concat_ws("|", "symbol", "direction").alias("side"), F.col("d").alias("turn")).distinct()
    return J.first_later(t, turns, "side", "d", "turn", "exit_date").drop("side")


def mark_to_market(entry: Column, current: Column, position: Column) -> Column:
    """Unrealised return of a position; null where a price is missing or zero."""
    return F.when((entry != 0) & (current != 0), (current / entry - 1) * position)


def percent_pnl(capital: Column, position: Column, price: Column, before: Column) -> Column:
    """Capital times the return of the position held before; 0 where the price before is 0."""
    return F.when(before == 0, F.lit(0.0)).otherwise(capital * position * (price / before - 1))


def point_pnl(position: Column, price: Column, before: Column, point_value: Column) -> Column:
    """Points gained by the position held before, each worth point_value."""
    return position * (price - before) * point_value


def hit(score: Column, forward: Column, flat: float) -> Column:
    """Whether score and forward return agree in sign; null for a flat score or a missing value."""
    return F.when(F.abs(score) > flat, (score > 0) == (forward > 0))


def closes_of(bars: DataFrame, instruments: dict[str, tuple[str, str | None]]) -> DataFrame:
    """(name, d, value) of instruments: name -> (symbol, None) is an outright, name -> (long, short) a spread or crack, on dates
    that both legs have."""
    out = None
    for name, (long, short) in instruments.items():
        x = bars.where(F.col("symbol") == long).select("d", F.col("close").alias("value"))
        if short is not None:
            y = bars.where(F.col("symbol") == short).select("d", F.col("close").alias("other"))
            x = x.join(y, "d").select("d", (F.col("value") - F.col("other")).alias("value"))
        x = x.select(F.lit(name).alias("name"), "d", "value")
        out = x if out is None else out.unionByName(x)
    return out
