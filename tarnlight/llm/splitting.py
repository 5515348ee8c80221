"""Cut oversized items at natural boundaries, by pointer doubling.

Every boundary of a text (paragraph, sentence and word ends) gets its farthest legal successor: the cut that
ends the piece which starts, with the overlap, before that boundary. Squaring the successor table again and
again gives the 2^k-th successors, and with them all greedy cuts of the text in log2(cuts) vector steps. Each text is
a row of its own, so cutting needs no shuffle; only the oversized texts are shuffled once before, to drop rows stored twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4
HARD, WORD, SENTENCE, PARAGRAPH, END = "hard", "word", "sentence", "paragraph", "end"
_KINDS = (
    (PARAGRAPH, re.compile(r"(?:\r?\n)+")),
    (SENTENCE, re.compile(r"[.!?…]+[\"'”’)\]]*\s+|[。！？；]+[”’」』）]*\s*")),
    (WORD, re.compile(r"\s+")),
)


def token_estimate(n_chars: int) -> int:
    return max(1, n_chars // CHARS_PER_TOKEN)


def cut_points(text: str, limit_tokens: int, overlap_tokens: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of the end) of the pieces of text in order.

    No piece has more than limit_tokens; consecutive ones share overlap_tokens (a few characters more where that lets
    the later one start with a word). A piece ends at the last paragraph end in the second half of its room, else
    the last sentence end there, else the last word end, else the same in the first half, else it is cut hard.
    """
    n, room = len(text), limit_tokens * CHARS_PER_TOKEN + CHARS_PER_TOKEN - 1
    if n <= room:
        return [(0, n, END)]
    if not 0 <= overlap_tokens < limit_tokens:
        raise ValueError("the overlap must be smaller than the limit")
    lap = overlap_tokens * CHARS_PER_TOKEN
    slack = CHARS_PER_TOKEN - 1 if lap else 0
    by_kind = [np.unique(np.array([0, *(m.end() for m in p.finditer(text)), n], dtype=np.int64)) for _, p in _KINDS]
    stops = np.unique(np.concatenate(by_kind))
    # Stretches without any boundary: only these hard cuts can be reached inside them.
    stride = room - lap - slack
    gap = np.flatnonzero(np.diff(stops) > stride)
    hard = [np.arange(stops[i] + stride, stops[i + 1], stride) for i in gap]
    nodes = np.unique(np.concatenate([stops, *hard])) if hard else stops
    words = by_kind[-1]
    # Where the piece after a cut starts: a word start within the slack before cut - lap, else exactly there.
    start = np.maximum(nodes - lap, 0)
    w = words[np.searchsorted(words, start, side="right") - 1]
    start = np.where((start - w <= slack) & (w > 0), w, start)
    start[nodes == 0] = 0
    end = np.full(len(nodes), -1, dtype=np.int64)
    kind = np.full(len(nodes), len(_KINDS), dtype=np.int8)
    for low in (start + room // 2, nodes):
        for k, at in enumerate(by_kind):
            last = at[np.searchsorted(at, np.minimum(start + room, n), side="right") - 1]
            take = (end < 0) & (last > np.maximum(low, nodes)) & (last < n)
            end[take], kind[take] = last[take], k
    missing = end < 0
    at = nodes[np.searchsorted(nodes, np.minimum(start + room, n), side="right") - 1]
    end[missing] = at[missing]
    done = start + room >= n
    end[done] = n
    follow = np.searchsorted(nodes, end)
    reach, table = np.array([0], dtype=np.int64), follow
    while nodes[reach[-1]] < n:
        reach = np.concatenate([reach, table[reach]])
        table = table[table]
    cuts = nodes[reach]
    count = int(np.searchsorted(cuts, n, side="left"))
    names = [*(k for k, _ in _KINDS), HARD]
    return [(int(start[reach[i]]), int(cuts[i + 1]), END if cuts[i + 1] == n else names[kind[reach[i]]]) for i in range(count)]


def split_oversized(items: DataFrame, limit_tokens: int, overlap_tokens: int, item_id: str = "chunk_id", text: str = "text") -> DataFrame:
    """-> (item_id, piece_no from 0, n_pieces, start, end, piece, tokens, ended_at) for each item whose text has more than
    limit_tokens, a text's tokens being max(1, floor(characters / 4)).

    Items within the limit, null and empty texts give nothing (they stay whole); any stored estimate is ignored.
    A repeated row is split once. Extra columns are left aside.
    """
    big = items.select(F.col(item_id).alias("id"), F.col(text).alias("t")).where(F.greatest(F.lit(1), F.floor(F.length("t") / CHARS_PER_TOKEN)) > limit_tokens).distinct()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b["id"], b["t"]):
                pieces = cut_points(t, limit_tokens, overlap_tokens)
                out += [(i, k, len(pieces), s, e, t[s:e], token_estimate(e - s), kind) for k, (s, e, kind) in enumerate(pieces)]
            yield pd.DataFrame(out, columns=["id", "piece_no", "n_pieces", "start", "end", "piece", "tokens", "ended_at"])

    kind = dict(items.dtypes)[item_id]
    out = big.mapInPandas(cut, f"id {kind}, piece_no int, n_pieces int, start long, end long, piece string, tokens int, ended_at string")
    return out.withColumnRenamed("id", item_id)
