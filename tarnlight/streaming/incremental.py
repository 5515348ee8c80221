"""The scheduled pipeline as Structured Streaming: file arrival, processed-set, bundling, late data, position state.

Every job runs with ``availableNow``, so a scheduler starts it, it takes what has arrived since its checkpoint and ends;
a missed tick is caught up by the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarnlight.sources.files import read_files

LATE = "14 days"


def drain(writer, checkpoint: str) -> None:
    """Runs a stream over all that is there and waits for its end."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest_files(spark: SparkSession, inbox: str, store: str, checkpoint: str) -> None:
    """New files into the store, content seen before left out: against the store and within the batch. The checkpoint is
    the processed-set; a batch that fails is taken again."""

    def write(batch: DataFrame, epoch: int) -> None:
        fresh = batch.where("error is null").dropDuplicates(["checksum"])
        try:
            fresh = fresh.join(spark.read.parquet(store).select("checksum"), "checksum", "left_anti")
        except Exception as e:  # the first run has no store
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        fresh.select("path", "modified", "checksum", "text").write.mode("append").parquet(store)

    drain(read_files(spark, inbox, streaming=True).writeStream.foreachBatch(write), checkpoint)


def process_new(stream: DataFrame, store: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], key: list[str]) -> None:
    """transform over what is new; its rows are appended unless their key is stored already (insert-if-absent), so that a batch
    taken twice leaves no copies."""

    def write(batch: DataFrame, epoch: int) -> None:
        out = transform(batch).dropDuplicates(key)
        try:
            out = out.join(batch.sparkSession.read.parquet(store).select(*key), key, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        out.write.mode("append").parquet(store)

    drain(stream.writeStream.foreachBatch(write), checkpoint)


def daily_bundles(posts: DataFrame, time: str = "created_at", source: str = "source_id") -> DataFrame:
    """Posts per source and tumbling day, copies of a post within the lateness dropped; a day is final when the watermark
    (14 days) has passed it. Works on streams and on tables."""
    x = posts.withColumn(time, F.col(time).cast("timestamp"))
    if posts.isStreaming:
        x = x.withWatermark(time, LATE).dropDuplicatesWithinWatermark(["post_id"])
    else:
        x = x.dropDuplicates(["post_id"])
    return x.groupBy(F.window(time, "1 day"), source).agg(F.count("*").alias("posts"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(time, "post_id"))), lambda y: y["post_id"]), "|").alias("bundle"))


def touched_days(new: DataFrame, date: str, shadow: int = 20) -> DataFrame:
    """Dates to score again when rows of these dates arrive late: each and the days its persistence reaches."""
    return new.select(F.explode(F.sequence(F.col(date), F.date_add(date, shadow))).alias(date)).distinct()


LEDGER_ROW = "symbol string, opened string, direction string, closed string"
LEDGER_STATE = "opened array<string>, direction array<string>, last string"


def ledger_step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Positions of one symbol, a signal a day (symbol, d, signal): a day's signal first closes all open positions of the other
    side, then opens its own. A day seen before changes nothing. Closed positions are emitted."""
    opened, direction, last = state.get if state.exists else ([], [], "")
    opened, direction = list(opened), list(direction)
    days = pd.concat(list(batches)).sort_values("d")
    out = []
    for d, signal in zip(days["d"], days["signal"]):
        if d <= last:
            continue
        last = d
        if signal == "FLAT":
            continue
        keep = [i for i, x in enumerate(direction) if x == signal]
        out += [(key[0], opened[i], direction[i], d) for i in range(len(opened)) if i not in keep]
        opened, direction = [opened[i] for i in keep] + [d], [direction[i] for i in keep] + [signal]
    state.update((opened, direction, last))
    yield pd.DataFrame(out, columns=["symbol", "opened", "direction", "closed"])


def ledger(signals: DataFrame) -> DataFrame:
    """Closed positions from a stream of signals; the state holds what is open per symbol."""
    return signals.groupBy("symbol").applyInPandasWithState(ledger_step, LEDGER_ROW, LEDGER_STATE, "append", GroupStateTimeout.NoTimeout)


def ledger_batch(signals: DataFrame) -> DataFrame:
    """The same from a table: each position closes on the first later day of the other side."""
    s = signals.where("signal <> 'FLAT'").dropDuplicates(["symbol", "d"])
    # the next day of the other side: the next change of side
    from pyspark.sql.window import Window as W

    w = W.partitionBy("symbol").orderBy("d")
    change = F.when(F.lead("signal").over(w) != F.col("signal"), F.lead("d").over(w))
    closed = F.first(change, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    return s.withColumn("closed", closed).where("closed is not null").select("symbol", F.col("d").alias("opened"), F.col("signal").alias("direction"), "closed")
