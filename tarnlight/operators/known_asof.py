"""Attributes as known at event time: a bitemporal as-of join.

A fact has a valid time (the period it describes) and a known time (when it became public). An
event at time T may use, of its entity's facts with both times at or before T, the one with the
latest valid time, then the latest known time, then the smallest id.

Per shard the kernel builds a path-copied persistent search tree: facts enter in the order of
their known times, each insertion makes a new root and copies the nodes on one path; an event picks
the root of its own time and searches the valid-time key. A tree over n facts is log2(n) arrays of
n sibling pointers, built level by level with numpy, so there is no loop over rows.

Sharding. A fact is usable from u = max(valid, known) on. Of the facts of one entity and one u only the best can ever be the answer, so
a bulk release under one time stamp is one fact, aggregated before any shuffle. Entities with few rows are hashed together
into shards; an entity with more than ``shard_rows`` rows is cut along u at row-count quantiles taken
from a histogram of minutes. The best fact of all earlier shards is carried into each later one, so an event is
searched in one shard only. A shard with very many events is salted, its facts being repeated.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tarnlight.session import cut_lineage

BIN_US = 60_000_000


def micros(c: Column | str) -> Column:
    """Timestamp (with or without zone) to microseconds since 1970; without zone counts as UTC
    in a UTC session."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def entity_key(c: Column | str) -> Column:
    """Letter case and outer blanks don't distinguish entities."""
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


class PersistentTree:
    """Versions 0..n-1 of a search tree over ranks; version v holds the ranks r[0..v]."""

    def __init__(self, r: np.ndarray, n_ranks: int) -> None:
        self.r = r.astype(np.int64)
        self.depth = max(1, int(n_ranks - 1).bit_length())
        n = len(r)
        v = np.arange(n, dtype=np.int64)
        self.sibling: list[np.ndarray] = []
        for level in range(self.depth):
            child = self.r >> (self.depth - level - 1)
            seen = np.sort(child * n + v)
            want = (child ^ 1) * n + v
            at = np.searchsorted(seen, want) - 1
            hit = (at >= 0) & (seen[np.maximum(at, 0)] // n == child ^ 1)
            self.sibling.append(np.where(hit, seen[np.maximum(at, 0)] % n, -1).astype(np.int32))

    def _child(self, level: int, node: np.ndarray, bit: np.ndarray | int) -> np.ndarray:
        own = (self.r[node] >> (self.depth - level - 1)) & 1
        return np.where(own == bit, node, self.sibling[level][node])

    def predecessor(self, root: np.ndarray, x: np.ndarray) -> np.ndarray:
        """For each query the version that last wrote the largest rank <= x under root, or -1."""
        out = np.full(len(root), -1, dtype=np.int64)
        ask = np.flatnonzero((root >= 0) & (x >= 0))
        node, x = root[ask].astype(np.int64), x[ask].astype(np.int64)
        alive = np.ones(len(ask), dtype=bool)
        back, back_level = np.full(len(ask), -1, dtype=np.int64), np.zeros(len(ask), dtype=np.int64)
        for level in range(self.depth):
            bit = (x >> (self.depth - level - 1)) & 1
            i = np.flatnonzero(alive & (bit == 1))
            left = self._child(level, node[i], 0)
            j = i[left >= 0]
            back[j], back_level[j] = left[left >= 0], level + 1
            i = np.flatnonzero(alive)
            nxt = self._child(level, node[i], bit[i])
            alive[i[nxt < 0]] = False
            node[i[nxt >= 0]] = nxt[nxt >= 0]
        found = np.where(alive, node, -1)
        fall = ~alive & (back >= 0)
        cur = back.copy()
        for level in range(self.depth):
            i = np.flatnonzero(fall & (back_level <= level))
            right = self._child(level, cur[i], 1)
            cur[i] = np.where(right >= 0, right, self._child(level, cur[i], 0))
        out[ask] = np.where(fall, cur, found)
        return out


def _search(pdf: pd.DataFrame) -> pd.DataFrame:
    """All events of one shard against the shard's tree."""
    code = pd.factorize(pdf["ent"])[0]
    t, is_event = pdf["t"].to_numpy(), pdf["is_event"].to_numpy()
    row_id = pdf["row_id"].to_numpy()
    fact, event = np.flatnonzero(~is_event), np.flatnonzero(is_event)
    empty = pd.DataFrame({"event_id": np.array([], "int64"), "fact_id": np.array([], "int64")})
    if not len(fact) or not len(event):
        return empty
    valid = pdf["valid"].iloc[fact].astype("int64").to_numpy()
    known = pdf["known"].iloc[fact].astype("int64").to_numpy()
    order = np.lexsort((-row_id[fact], known))  # of equal times the smallest id is the last version
    fact, valid, known = fact[order], valid[order], known[order]
    # rank of (entity, valid time); an event's bound is the number of keys at or before (entity, T)
    keys = np.unique(np.stack([code[fact], valid], axis=1), axis=0)
    every = np.concatenate([keys, np.stack([code[event], t[event]], axis=1), np.stack([code[event], np.full(len(event), np.iinfo(np.int64).min)], axis=1), np.stack([code[fact], valid], axis=1)])
    k, e = len(keys), len(event)
    kind = np.concatenate([np.zeros(k, np.int8), np.ones(2 * e + len(fact), np.int8)])
    by = np.lexsort((kind, every[:, 1], every[:, 0]))
    upto = np.empty(len(every), dtype=np.int64)
    upto[by] = np.cumsum(kind[by] == 0)
    bound, low, rank = upto[k : k + e] - 1, upto[k + e : k + 2 * e], upto[k + 2 * e :] - 1
    tree = PersistentTree(rank, k)
    root = np.searchsorted(known, t[event], side="right") - 1
    got = tree.predecessor(root, bound)
    ok = (got >= 0) & (rank[np.maximum(got, 0)] >= low)
    return pd.DataFrame({"event_id": row_id[event][ok], "fact_id": row_id[fact][got[ok]]})


def known_asof(facts: DataFrame, events: DataFrame, shard_rows: int = 200_000) -> DataFrame:
    """facts(ent, valid, known, fact_id) and events(ent, t, event_id), times in microseconds, ids long
    -> (event_id, fact_id).

    Rows with a null entity, time or id match nothing. Equal (ent, valid, known) keep the smallest id.
    Events without a usable fact give no row; repeated event rows give one row each.
    """
    times = lambda df, *c: df.select("ent", *[F.col(x).cast("long").alias(x) for x in c]).dropna()
    facts, events = times(facts, "valid", "known", "fact_id"), times(events, "t", "event_id")
    best = F.max(F.struct("valid", "known", (-F.col("fact_id")).alias("neg"))).alias("b")
    facts = cut_lineage(facts.groupBy("ent", F.greatest("valid", "known").alias("t")).agg(best).select("ent", "t", "b.valid", "b.known", (-F.col("b.neg")).alias("row_id")))
    usable = facts.select("ent", "t", F.lit(0).alias("ev")).unionByName(events.select("ent", "t", F.lit(1).alias("ev")))
    # Entities above shard_rows, and for them alone a histogram of minutes. Both are pre-aggregated before they are shuffled.
    hot = usable.groupBy("ent").agg(F.count("*").alias("n")).where(F.col("n") > shard_rows).select("ent")
    bins = usable.join(hot, "ent", "left_semi").groupBy("ent", F.expr(f"t div {BIN_US}").alias("bin")).agg(F.count("*").alias("n"), F.sum("ev").alias("n_ev"))
    bins = bins.withColumn("shard", F.expr(f"(sum(n) OVER (PARTITION BY ent ORDER BY bin) - n) div {shard_rows} + 1"))
    bins = bins.withColumn("salts", F.expr(f"greatest(1, (sum(n_ev) OVER (PARTITION BY ent, shard)) div {4 * shard_rows} + 1)")).select("ent", "bin", "shard", "salts")
    f = facts.select("ent", "t", F.lit(False).alias("is_event"), "valid", "known", "row_id")
    none = F.lit(None).cast("long")
    e = events.select("ent", "t", F.lit(True).alias("is_event"), none.alias("valid"), none.alias("known"), F.col("event_id").alias("row_id"))
    placed = f.unionByName(e).withColumn("bin", F.expr(f"t div {BIN_US}")).join(bins, ["ent", "bin"], "left").drop("bin").fillna({"shard": 0, "salts": 1})
    placed = cut_lineage(placed)
    # What each later shard of a cut entity inherits: the best fact of all earlier ones.
    best = placed.where("shard > 0").groupBy("ent", "shard").agg(
        F.max(F.when(~F.col("is_event"), F.struct("valid", "known", (-F.col("row_id")).alias("neg")))).alias("b"), F.max("salts").alias("salts")
    )
    best = best.withColumn("b", F.max("b").over(W.partitionBy("ent").orderBy("shard").rowsBetween(W.unboundedPreceding, -1))).where("b is not null")
    carried = best.select("ent", F.greatest("b.valid", "b.known").alias("t"), F.lit(False).alias("is_event"), "b.valid", "b.known", (-F.col("b.neg")).alias("row_id"), "shard", "salts")
    every = placed.unionByName(carried)
    every = every.withColumn("salt", F.explode(F.when(F.col("is_event"), F.array(F.pmod(F.xxhash64("row_id"), F.col("salts")))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1))))
    cold = max(1, -(-4 * placed.count() // shard_rows))
    group = F.when(F.col("shard") > 0, F.xxhash64("ent", "shard", "salt")).otherwise(F.pmod(F.xxhash64("ent"), F.lit(cold)))
    return (
        every.select(group.alias("grp"), "ent", "t", "is_event", "valid", "known", "row_id")
        .groupBy("grp")
        .applyInPandas(_search, "event_id long, fact_id long")
    )
