"""Fill containers of fixed capacity with whole items, by sum-of-squares online packing.

Each item goes to the fill level (or a new container) that minimises the sum over levels of the squared number of
containers standing partly filled at that level; the levels are one array. Items are dealt to shards by hash, each
shard packs its own; the items of containers that aren't nearly full are dealt anew and packed again. Each round counts
what is left and takes as many shards as that needs, so none holds more than shard_items items on average, whatever was settled.
The rounds end with the one that has a single shard, or that settles less than SETTLED of its items: those are kept as they stand.
Only an item above the capacity is divided: into full containers and a remainder that is packed like any item.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.session import cut_lineage

SHARD_ITEMS, OPEN_BELOW = 20_000, 0.98
#: Part of its items that a round has to settle for another one to follow.
SETTLED = 0.1


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item, in the order given; sizes from 1 to capacity."""
    at_level = np.zeros(capacity + 1, dtype=np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), dtype=np.int64)
    made = 0
    far = np.iinfo(np.int64).max // 4
    for i, w in enumerate(sizes.tolist()):
        top = capacity - w + 1
        here = at_level[:top]
        cost = np.where(here > 0, 1 - 2 * here, far)
        cost[0] = 0
        there = 2 * at_level[w : capacity + 1] + 1
        there[-1] = 0  # a full container stands at no level
        cost += there
        h = top - 1 - int(np.argmin(cost[::-1]))  # of equal costs the fullest
        if h == 0:
            c, made = made, made + 1
        else:
            c = open_[h].pop()
            at_level[h] -= 1
        if h + w < capacity:
            open_[h + w].append(c)
            at_level[h + w] += 1
        out[i] = c
    return out


def pack(items: DataFrame, capacity: int, item_id: str = "doc_id", size: str = "n_tokens", shard_items: int = SHARD_ITEMS, rounds: list[tuple[int, int]] | None = None) -> DataFrame:
    """items(item_id, size) -> (container_id, item_id, part_no, n_parts, part_size), the sizes of a container adding up
    to at most capacity.

    An item above the capacity comes in parts, numbered from 0, all but the last filling a container of their own. Items
    of size 0, null or less need no room: container_id null. Repeated rows are items of their own. Nothing is dropped.
    Into rounds, if given, goes what each round had: (items, shards).
    """

    def pack_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "key"], kind="stable").reset_index(drop=True)
        w = pdf["w"].to_numpy()
        c = sum_of_squares(w, capacity)
        fill = np.bincount(c, weights=w).astype(np.int64)
        name = f"{pdf['level'].iloc[0]}.{pdf['shard'].iloc[0]}."
        return pd.DataFrame({"key": pdf["key"], "w": w, "box": [f"{name}{x}" for x in c], "fill": fill[c]})

    rows = items.select(F.col(item_id).alias("id"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("n"))
    n_parts = F.greatest(F.lit(1), F.ceil(F.col("n") / capacity)).cast("long")
    parts = rows.select("id", "n", n_parts.alias("n_parts"), F.explode(F.sequence(F.lit(0).cast("long"), n_parts - 1)).alias("part_no"))
    parts = parts.withColumn("w", F.when(F.col("part_no") < F.col("n_parts") - 1, capacity).otherwise(F.col("n") - (F.col("n_parts") - 1) * capacity))
    parts = parts.withColumn("key", F.concat_ws(":", F.lit("i"), F.col("id").cast("string"), "part_no", F.monotonically_increasing_id()))
    parts = cut_lineage(parts)
    loose = parts.where((F.col("w") > 0) & (F.col("w") < capacity)).select("key", "w")
    left, level, boxes = loose.count(), 0, None
    while True:
        shards = max(1, -(-left // shard_items))
        if rounds is not None:
            rounds.append((left, shards))
        dealt = loose.select("key", "w", F.lit(level).alias("level"), F.pmod(F.xxhash64("key", F.lit(level)), F.lit(shards)).alias("shard"), F.xxhash64("key", F.lit(-1)).alias("order"))
        done = cut_lineage(dealt.groupBy("shard").applyInPandas(pack_shard, "key string, w long, box string, fill long"))
        is_open = F.col("fill") <= OPEN_BELOW * capacity
        again = done.where(is_open).count() if shards > 1 else 0
        last = shards == 1 or again > (1 - SETTLED) * left
        settled = (done if last else done.where(~is_open)).select("key", "box")
        boxes = settled if boxes is None else boxes.unionByName(settled)
        if last:
            break
        loose, left, level = done.where(is_open).select("key", "w"), again, level + 1
    out = parts.join(boxes, "key", "left")
    box = F.when(F.col("w") == capacity, F.concat(F.lit("full."), "key")).otherwise(F.col("box"))
    return out.select(box.alias("container_id"), F.col("id").alias(item_id), F.col("part_no").cast("int").alias("part_no"), F.col("n_parts").cast("int").alias("n_parts"), F.col("w").alias("part_size"))


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """(capacity, containers, tokens, fullest, fill, divided_items) of a packing, one row."""
    boxes = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("part_size").alias("fill"), F.count_if((F.col("n_parts") > 1) & (F.col("part_no") == 0)).alias("divided"))
    total = boxes.agg(F.count("*").alias("containers"), F.coalesce(F.sum("fill"), F.lit(0)).alias("tokens"), F.max("fill").alias("fullest"), F.coalesce(F.sum("divided"), F.lit(0)).alias("divided_items"))
    return total.select(F.lit(capacity).alias("capacity"), "containers", "tokens", "fullest", F.try_divide(F.col("tokens"), F.col("containers") * capacity).alias("fill"), "divided_items")
