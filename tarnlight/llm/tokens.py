"""Token counts by a public tokenizer's vocabulary file (read where it lies, never copied)."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_made: dict[str, object] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    """tiktoken encoding from a rank file, one per worker."""
    if path not in _made:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _made[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _made[path]


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens); null and empty texts have 0 tokens."""
    path = str(tokenizer or default_tokenizer())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "n_tokens": [len(x) for x in enc.encode_ordinary_batch(b["t"].tolist(), num_threads=1)]})

    kind = dict(docs.dtypes)[doc_id]
    some = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return some.mapInPandas(run, f"id {kind}, n_tokens long").withColumnRenamed("id", doc_id)
