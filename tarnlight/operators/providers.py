"""Pluggable extraction providers: any function from texts to JSON replies, run in batches on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlight.functions import text as X
from tarnlight.session import cut_lineage

#: What a provider must reply, one JSON object per text; bounds are checked afterwards.
REPLY = (
    "should_extract boolean, topic string, direction string, credibility double, novelty double, breadth double, persistence double, crowding double, price_confirmation double, "
    "verification_status string, horizon string, rumor_flag boolean, confidence double, entities array<string>, regions array<string>, asset_candidates array<string>, "
    "evidence_text string, evidence_spans array<string>, notes string"
)
Provider = Callable[[list[str]], list[str]]


def stub(texts: list[str]) -> list[str]:
    """A deterministic provider for tests: counts a few words."""
    import json

    out = []
    for t in texts:
        low = (t or "").lower()
        up, down = low.count("tight"), low.count("fell")
        out.append("reply: " + json.dumps({"should_extract": len(low) >= 80, "topic": "inventory_draw" if "stocks" in low else "other", "direction": "bullish" if up > down else "bearish" if down > up else "neutral", "credibility": 0.5, "novelty": min(1.0, 0.3 + 0.1 * up), "verification_status": "unverified", "horizon": "swing", "rumor_flag": False, "evidence_text": (t or "")[:60]}))
    return out


def extract(chunks: DataFrame, provider: Provider, text: str = "text") -> DataFrame:
    """chunks with the reply's fields in struct column ``reply`` and ``reply_error``. A reply without a readable object, without
    its required fields or out of bounds is an error, not a lost row. provider must be picklable."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                replies = provider(b[text].tolist())
            except Exception as e:
                replies = [f"error: {e}"] * len(b)
            yield b.assign(_reply=replies)

    schema = T.StructType([*chunks.schema.fields, T.StructField("_reply", T.StringType())])
    out = chunks.mapInPandas(run, schema).withColumn("reply", X.json_object(F.col("_reply"), REPLY)).drop("_reply")
    unit = lambda c: F.col(f"reply.{c}").isNull() | F.col(f"reply.{c}").between(0, 1)
    bounded = unit("credibility") & unit("novelty") & unit("breadth") & unit("persistence") & unit("crowding") & unit("price_confirmation") & unit("confidence")
    needed = F.col("reply.topic").isNotNull() & F.col("reply.direction").isNotNull() & F.col("reply.credibility").isNotNull() & F.col("reply.novelty").isNotNull()
    return out.withColumn("reply_error", F.when(F.col("reply").isNull(), "no object").when(~needed, "missing field").when(~bounded, "out of bounds"))


def reply_events(extracted: DataFrame) -> DataFrame:
    """Events from good replies that ask to be extracted, in the columns of the rule path."""
    x = extracted.where(F.col("reply_error").isNull() & F.coalesce("reply.should_extract", F.lit(True)))
    return x.select(X.event_id(F.col("document_id"), F.col("chunk_id"), F.col("reply.topic")).alias("event_id"), "document_id", "chunk_id", *[F.col(f"reply.{c}").alias(c) for c in ("topic", "direction", "credibility", "novelty", "verification_status", "horizon", "rumor_flag", "confidence", "evidence_text")])


def extract_events(chunks: DataFrame, rules: Callable[[DataFrame], DataFrame], provider: Provider | None = None, mode: str = "auto") -> DataFrame:
    """Events of chunks. mode "rule": by rules (chunks -> events); "llm": by the provider, chunks with a bad reply give none; "auto":
    by the provider, and by rules where its reply is bad or there is no provider. The provider is asked once."""
    if mode not in ("rule", "llm", "auto"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "rule" or (mode == "auto" and provider is None):
        return rules(chunks)
    if provider is None:
        raise ValueError("mode llm needs a provider")
    asked = cut_lineage(extract(chunks, provider))
    if mode == "llm":
        return reply_events(asked)
    failed = asked.where("reply_error is not null").select(*chunks.columns)
    return reply_events(asked).unionByName(rules(failed), allowMissingColumns=True)


def adjudicate(events: DataFrame, provider: Provider, done: DataFrame, cap: int) -> DataFrame:
    """(chunk_id, direction): the provider's direction for the next ``cap`` chunks that aren't in done (a capped, resumable job: each
    run takes the next ones in order of chunk_id)."""
    todo = events.select("chunk_id", "evidence_text").dropDuplicates(["chunk_id"]).join(done.select("chunk_id"), "chunk_id", "left_anti").orderBy("chunk_id").limit(cap)
    return extract(todo.withColumnRenamed("evidence_text", "text"), provider).where("reply_error is null").select("chunk_id", "reply.direction")
