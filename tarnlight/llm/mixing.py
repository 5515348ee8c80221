"""Mix sources to target weights with a cap on repetition.

Temperature mixing (``temperature_mix``): natural token shares raised to an exponent, which is bisected to meet a target entropy
(``temperature_weights``) or a repetition limit for a wanted budget (``limited_weights``). A power of the natural shares can't
meet explicit target shares, so with those (``mix``, ``plan_mix``) the exponent tilts target shares towards natural ones, and only as far as a wanted
budget needs under the repetition limits; without a budget the largest one that needs no
tilt is taken and the targets are met. The weights become whole passes over a source and the beginning of one more pass in
a permuted order: blocks by hash, block totals summed up, and only the block on the border looked into.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tarnlight.session import cut_lineage

BLOCK_DOCS = 20_000


def temperature_weights(tokens: dict[str, int], entropy: float | None = None, exponent: float | None = None) -> tuple[dict[str, float], float]:
    """(weights, exponent): natural shares to a power, which is given or bisected so that the weights have the entropy (nats)."""
    total = sum(tokens.values())
    shares = {k: v / total for k, v in tokens.items() if v > 0}
    if not shares:
        return {}, 1.0 if exponent is None else exponent

    def at(a: float) -> dict[str, float]:
        top = max(math.log(p) for p in shares.values())
        raw = {k: math.exp(a * (math.log(p) - top)) for k, p in shares.items()}
        z = sum(raw.values())
        return {k: v / z for k, v in raw.items()}

    if exponent is None:
        h = lambda a: -sum(p * math.log(p) for p in at(a).values() if p > 0)
        low, high = 0.0, 64.0  # entropy falls as the exponent grows
        want = min(max(entropy if entropy is not None else h(1.0), 0.0), math.log(len(shares)))
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if h(mid) > want else (low, mid)
        exponent = (low + high) / 2
    return at(exponent), exponent


def limited_weights(tokens: dict[str, int], max_repeats: float, budget: float) -> tuple[dict[str, float], float]:
    """(weights, exponent) of the evenest mix (smallest exponent of at least 0) for which a budget of tokens repeats no source more
    than max_repeats times; natural shares (1) where even those would."""
    live = {k: v for k, v in tokens.items() if v > 0}
    if not live:
        return {}, 1.0

    def passes(a: float) -> float:
        w, _ = temperature_weights(live, exponent=a)
        return max(budget * w[k] / live[k] for k in live)

    low, high = 0.0, 1.0  # passes of the most repeated source fall as the exponent grows to 1
    if passes(low) <= max_repeats:
        high = low
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if passes(mid) > max_repeats else (low, mid)
    return temperature_weights(live, exponent=high)


def plan_mix(tokens: dict[str, int], targets: dict[str, tuple[float, int]], budget: float | None = None) -> tuple[dict[str, float], float, float]:
    """(token quota by source, exponent, budget). tokens: size by source; targets: (share, max repeats) by source.

    A source without tokens or share gets nothing and the other shares are scaled up. exponent 1: the targets are met.
    """
    live = {s: (t, m) for s, (t, m) in targets.items() if t and t > 0 and m and m > 0 and tokens.get(s, 0) > 0}
    if not live:
        return {}, 1.0, 0.0
    total = sum(tokens[s] for s in live)

    def weights(a: float) -> dict[str, float]:
        raw = {s: t**a * (tokens[s] / total) ** (1 - a) for s, (t, _) in live.items()}
        z = sum(raw.values())
        return {s: v / z for s, v in raw.items()}

    room = lambda a: min(live[s][1] * tokens[s] / w for s, w in weights(a).items())
    exponent = 1.0
    if budget is None:
        budget = room(1.0)
    elif room(1.0) < budget:
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if room(mid) >= budget else (low, mid)
        exponent = low
        budget = min(budget, room(exponent))
    return {s: w * budget for s, w in weights(exponent).items()}, exponent, budget


def mix(docs: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, source, text_key, n_tokens), targets(mix_name, source, target_share, max_repeats) -> (selection, report).

    selection(mix_name, doc_id, source, n_tokens, copies): one row per chosen text. report(mix_name, source, target_share,
    actual_share, tokens, n_texts, most_copies, exponent). Equal texts (text_key) are one text, the one of the smallest
    doc_id, so none is used more often than max_repeats under any id. Texts without tokens or source are never chosen. targets is small and
    fixed (it is collected); duplicate target rows of a mix and source are merged by their largest values.
    """
    texts = distinct_texts(docs)
    size = source_sizes(texts.join(F.broadcast(targets.select("source").distinct()), "source"))
    wanted: dict[str, dict[str, tuple[float, int]]] = {}
    for r in targets.groupBy("mix_name", "source").agg(F.max("target_share").alias("s"), F.max("max_repeats").alias("m")).collect():
        wanted.setdefault(r["mix_name"], {})[r["source"]] = (r["s"], r["m"])
    plan = []
    for name, t in sorted(wanted.items()):
        quota, exponent, _ = plan_mix({s: v[0] for s, v in size.items()}, t, budget)
        plan += [(name, s, float(share or 0), quota.get(s, 0.0), exponent) for s, (share, _) in sorted(t.items())]
    return realise(texts, plan, size, seed)


def temperature_mix(docs: DataFrame, entropy: float = 0.95, max_repeats: float = 2.0, budget: float = 1.0, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, source, text_key, n_tokens) -> (selection, report) as from ``mix``, of two mixes by temperature.

    "entropy": the weights have ``entropy`` times the largest entropy; as many tokens as repeat no source more than max_repeats times.
    "repeats": as many tokens as ``budget`` times all texts have, as even as that limit allows. target_share is the weight.
    """
    texts = distinct_texts(docs)
    size = source_sizes(texts)
    tokens = {s: t for s, (t, _) in size.items()}
    even, a = temperature_weights(tokens, entropy * math.log(max(1, len(tokens))))
    total = min((max_repeats * tokens[s] / w for s, w in even.items()), default=0.0)
    plan = [("entropy", s, w, w * total, a) for s, w in sorted(even.items())]
    limited, a = limited_weights(tokens, max_repeats, budget * sum(tokens.values()))
    plan += [("repeats", s, w, w * budget * sum(tokens.values()), a) for s, w in sorted(limited.items())]
    return realise(texts, plan, size, seed)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens), a row for each text that has tokens and, in at least one copy, a source."""
    some = docs.where((F.col("n_tokens") > 0) & F.col("source").isNotNull())
    return cut_lineage(some.groupBy("text_key").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("d")).select("d.*"))


def source_sizes(texts: DataFrame) -> dict[str, tuple[int, int]]:
    """(tokens, texts) by source; as many as there are sources to be mixed, a few."""
    return {r["source"]: (r["t"], r["n"]) for r in texts.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}


def realise(texts: DataFrame, plan: list[tuple[str, str, float, float, float]], size: dict[str, tuple[int, int]], seed: int) -> tuple[DataFrame, DataFrame]:
    """(selection, report) for plan rows (mix_name, source, target share, token quota, exponent)."""
    rows = []
    for name, s, share, q, exponent in plan:
        total, n = size.get(s, (0, 0))
        whole = int(q / total + 1e-9) if total else 0
        rows.append((name, s, share, whole, float(max(0.0, q - whole * total)), max(1, -(-n // BLOCK_DOCS)), float(exponent)))
    spark = texts.sparkSession
    todo = spark.createDataFrame(rows, "mix_name string, source string, target_share double, whole int, rest double, blocks int, exponent double")
    x = texts.join(F.broadcast(todo), "source")
    x = x.withColumn("order", F.xxhash64(F.lit(seed), "mix_name", "doc_id")).withColumn("block", F.pmod("order", F.col("blocks")))
    by_block = x.groupBy("mix_name", "source", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    upto = W.partitionBy("mix_name", "source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    by_block = by_block.withColumn("before", F.coalesce(F.sum("block_tokens").over(upto), F.lit(0)))
    x = x.join(by_block, ["mix_name", "source", "block"])
    inside = x.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("block_tokens") > F.col("rest")))
    run = F.sum("n_tokens").over(W.partitionBy("mix_name", "source", "block").orderBy("order", "doc_id"))
    # on the border a text is taken if that brings the total nearer to the quota
    border = inside.withColumn("run", F.col("before") + run).withColumn("extra", (F.col("run") - F.col("n_tokens") / 2 <= F.col("rest")).cast("int")).drop("run")
    rest = x.where(~((F.col("before") < F.col("rest")) & (F.col("before") + F.col("block_tokens") > F.col("rest")))).withColumn("extra", (F.col("before") + F.col("block_tokens") <= F.col("rest")).cast("int"))
    chosen = rest.unionByName(border).withColumn("copies", F.col("whole") + F.col("extra")).where("copies > 0")
    selection = cut_lineage(chosen.select("mix_name", "doc_id", "source", "n_tokens", "copies"))
    used = selection.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("n_texts"), F.max("copies").alias("most_copies"))
    report = todo.select("mix_name", "source", "target_share", "exponent").join(used, ["mix_name", "source"], "left")
    total = F.sum("tokens").over(W.partitionBy("mix_name"))
    report = report.select("mix_name", "source", "target_share", F.coalesce(F.try_divide(F.col("tokens"), total), F.lit(0.0)).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "exponent")
    return selection, report
