"""Registration of queries with their SQL, and adapters that present the test tables as the engine's relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.functions.dates import score_date
from tarnlight.operators.series import daily_bars
from tarnlight.session import table


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return add


class Tables:
    """Tables of one directory; attribute access reads the parquet."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)


def bars(t: Tables) -> DataFrame:
    """Daily bars: priority as symbol, order totals as ticks."""
    return daily_bars(t.orders, F.col("o_orderpriority"), F.to_date("o_orderdate"), "o_totalprice", "o_orderkey")


def events(t: Tables) -> DataFrame:
    """Narrative events with source and document attributes; the event time is created_at."""
    s = F.broadcast(t.sources.select("source_name", "cost_level"))  # 60 rows, fixed
    d = t.documents.select("document_id", "source_id", "title")
    e = t.narrative_events.join(d, "document_id", "left").join(s, "source_name", "left")
    return e.withColumns({"score_date": score_date(F.col("created_at").cast("timestamp")), "source_key": F.coalesce("source_id", "source_name")})


def day(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def r4(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 4)


BARS = """bars AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS d, arg_min(o_totalprice, o_orderkey) AS open,
 max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1, 2)"""
LOCAL = "((n.created_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')"
EVENTS = f"""ev0 AS (SELECT n.*, s.cost_level, d.source_id, d.title, CAST({LOCAL} AS DATE) + CASE WHEN hour({LOCAL}) >= 16 THEN 1 ELSE 0 END AS b
 FROM narrative_events n LEFT JOIN documents d USING (document_id) LEFT JOIN sources s ON s.source_name = n.source_name),
ev AS (SELECT *, b + CASE WHEN isodow(b) = 6 THEN 2 WHEN isodow(b) = 7 THEN 1 ELSE 0 END AS score_date, coalesce(source_id, source_name) AS source_key FROM ev0)"""
