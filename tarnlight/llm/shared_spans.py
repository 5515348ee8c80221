"""Long exact spans shared between records.

Spans are found by hashing sliding runs and joining them globally. Runs of whole sentences, cut at punctuation, are the
plain form (``sentence_spans``) and serve for removal; but a shared passage may start and end inside sentences
and hold no whole run of them, so for the exact task the places of the runs are chosen by content:
of every window of 240 characters the run of 128 characters with the least hash is an anchor (winnowing), so any
two texts with a common span of 240 characters have an anchor in common, wherever the span begins.

1. anchors (hash, text key) of all texts; kept where two different texts hold the hash (min and max of the key per
   hash, no group is gathered);
2. only for texts with such anchors: hashes of the five runs of 212 characters around each, kept where two texts hold one;
3. pairs of texts that agree in a run that at most FEW rows hold, checked on the 28 characters beside it;
4. for runs of more rows, before any pair is made: hashes of every full span of 240 characters around their anchors, kept where
   two texts hold it, so that shorter agreement (stock phrases, even in a third of all texts) drops out; of the spans
   that the same texts hold one, and the pairs of these texts, each of which is a result.

Runs are compared by a 64-bit hash, spans by 128 bits: a hash of the span and one of its first half. The lengths above are those of spans of
240 characters, the default of ``min_chars``; others follow in proportion (``Shape``).

Equal texts are one key throughout; copies are expanded at the end only. A key is a 64-bit hash of the text of which no two different
texts have the same (checked by 128 more bits; another seed is taken if they do). ``passages`` gives classes instead of
pairs, one row for each passage and document, so that it grows with the documents only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnlight.session import cut_lineage

SPAN = 240


@dataclass(frozen=True)
class Shape:
    """Lengths that belong to a span: of the runs that anchors hash, of the steps between wide runs, of wide runs, of a span's choice of runs."""

    span: int = SPAN

    @property
    def run(self) -> int:
        return max(1, self.span * 8 // 15)

    @property
    def step(self) -> int:
        return max(1, self.span * 7 // 60)

    @property
    def wide(self) -> int:
        return max(self.run, self.span - self.step)

    @property
    def window(self) -> int:
        return self.span - self.run + 1


#: Rows of a wide run up to which its pairs are made and checked one by one.
FEW = 16
BLOCK = 1 << 20  # characters hashed at once
_POS = np.uint64(BLOCK * 2 - 1)
_B = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        n = 2 * BLOCK + 1
        for name, base in (("up", _B), ("down", pow(_B, -1, 1 << 64))):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"], _powers["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class RunHashes:
    """Hashes of any runs of a block of characters."""

    def __init__(self, codes: np.ndarray) -> None:
        up, self.down = _tables()
        c = _mix((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
        self.sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(c * up[: len(codes)], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        return _mix((self.sums[length:] - self.sums[:-length]) * self.down[: len(self.sums) - length])

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        return _mix((self.sums[starts + length] - self.sums[starts]) * self.down[starts])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for every i, by prefix and suffix minima of blocks of w."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def _anchors(hashes: RunHashes, ends: np.ndarray, s: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a block; ends: for each character the end of its text."""
    run = hashes.every(s.run)
    ranked = (run & ~_POS) | np.arange(len(run), dtype=np.uint64)
    least = _sliding_min(ranked, s.window)
    first = np.arange(len(least))
    least = least[first + s.span <= ends[: len(least)]] & _POS
    if not len(least):
        return np.array([], dtype=np.int64), np.array([], dtype=np.uint64)
    at = least[np.concatenate([[True], least[1:] != least[:-1]])].astype(np.int64)
    return at, run[at]


def _blocks(texts: list[str], s: Shape) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(index of text, offset in it, characters, end of its part) over blocks of bounded size; the parts of a text longer
    than a block overlap by what a span needs."""
    part: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def flush():
        lens = np.array([len(c) for _, _, c in part])
        starts = np.cumsum(lens) - lens
        owner = np.repeat(np.arange(len(part)), lens)
        return np.array([i for i, _, _ in part]), np.array([o for _, o, _ in part]) - starts, np.concatenate([c for _, _, c in part]), owner, np.repeat(starts + lens, lens)

    for i, t in enumerate(texts):
        c = _codes(t)
        for o in range(0, max(1, len(c) - s.span + 1), BLOCK - 2 * s.span):
            piece = c[o : o + BLOCK]
            if size + len(piece) > BLOCK and part:
                yield flush()
                part, size = [], 0
            part.append((i, o, piece))
            size += len(piece)
    if part:
        yield flush()


def text_anchors(texts: list[str], s: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of text, hash), each once, of texts of at least a span's characters."""
    who, what = [np.array([], dtype=np.int64)], [np.array([], dtype=np.uint64)]
    for index, _, codes, owner, ends in _blocks(texts, s):
        at, h = _anchors(RunHashes(codes), ends, s)
        who.append(index[owner[at]])
        what.append(h)
    w, h = np.concatenate(who), np.concatenate(what)
    order = np.lexsort((h, w))
    w, h = w[order], h[order]
    keep = np.concatenate([[True], (w[1:] != w[:-1]) | (h[1:] != h[:-1])]) if len(w) else np.array([], dtype=bool)
    return w[keep], h[keep]


def _anchor_rows(batches: Iterator[pd.DataFrame], s: Shape) -> Iterator[pd.DataFrame]:
    for b in batches:
        w, h = text_anchors(b["text"].tolist(), s)
        yield pd.DataFrame({"h": h.view(np.int64), "k": b["k"].to_numpy()[w]})


def _held_anchors(b: pd.DataFrame, s: Shape) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, RunHashes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of the texts with the places of the anchors in hs: (index of text, offset, owner, hashes, ends, places, their hashes, characters)."""
    wanted = b["hs"].tolist()
    for index, shift, codes, owner, ends in _blocks(b["text"].tolist(), s):
        hashes = RunHashes(codes)
        at, h = _anchors(hashes, ends, s)
        own = owner[at]
        ok = np.zeros(len(at), dtype=bool)
        for o in np.unique(own):
            i = own == o
            ok[i] = np.isin(h[i].view(np.int64), wanted[index[o]])
        yield index, shift, owner, hashes, ends, at[ok], h[ok], codes


def _wide_rows(batches: Iterator[pd.DataFrame], s: Shape) -> Iterator[pd.DataFrame]:
    """Around each anchor that another text holds too: the wide runs and what stands beside them."""
    for b in batches:
        keys = b["k"].to_numpy()
        for index, _, owner, hashes, ends, at, h, codes in _held_anchors(b, s):
            starts = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
            own = owner[at]
            for j in range(0, s.window, s.step):
                p = at - j
                fit = (p >= starts[own]) & (p + s.wide <= ends[at])
                p, o = p[fit], own[fit]
                if not len(p):
                    continue
                left = [codes[max(starts[x], i - s.step) : i].tobytes().decode("utf-32-le", "surrogatepass") for i, x in zip(p, o)]
                right = [codes[i + s.wide : min(ends[i], i + s.span)].tobytes().decode("utf-32-le", "surrogatepass") for i in p]
                yield pd.DataFrame({"g": hashes.at(p, s.wide).view(np.int64), "k": keys[index[o]], "h": h[fit].view(np.int64), "l": left, "r": right}).drop_duplicates()


def _common_suffix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(reversed(a), reversed(b)):
        if x != y:
            break
        n += 1
    return n


def _common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _check(batches: Iterator[pd.DataFrame], s: Shape) -> Iterator[pd.DataFrame]:
    for b in batches:
        ok = [_common_suffix(la, lb) + _common_prefix(ra, rb) >= s.span - s.wide for la, lb, ra, rb in zip(b["la"], b["lb"], b["ra"], b["rb"])]
        yield b.loc[ok, ["ka", "kb"]].drop_duplicates()


def _keyed(docs: DataFrame, doc_id: str, text: str, s: Shape) -> DataFrame:
    """(id, text, k) of texts long enough for a span, k naming the text."""
    long = docs.where(F.length(text) >= s.span).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    for seed in range(8):
        keyed = long.withColumn("k", F.xxhash64("text", F.lit(seed)))
        named = keyed.groupBy("k").agg(F.min(F.md5("text")).alias("lo"), F.max(F.md5("text")).alias("hi"))
        if named.where("lo <> hi").isEmpty():
            return keyed
    raise ValueError("no seed names the texts")


class Candidates:
    """The texts, and their wide runs around anchors that another text holds too."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, s: Shape) -> None:
        self.shape = s
        self.keyed = _keyed(docs, doc_id, text, s)
        anchors = cut_lineage(self.keyed.select("k", "text").mapInPandas(lambda x: _anchor_rows(x, s), "h long, k long"))
        shared = anchors.groupBy("h").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo < hi").select("h")
        self.classes = self.keyed.groupBy("k").agg(F.min("id").alias("id"), F.count("*").alias("n"))
        runs = self.with_text(anchors.join(shared, "h")).mapInPandas(lambda x: _wide_rows(x, s), "g long, k long, h long, l string, r string")
        self.wide = cut_lineage(runs.distinct())
        self.agree = self.wide.groupBy("g").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("g", "n")

    def with_text(self, anchors: DataFrame) -> DataFrame:
        """(k, text, hs): one text of each key with the anchors of (k, h)."""
        hits = anchors.groupBy("k").agg(F.collect_set("h").alias("hs"))
        return self.keyed.join(hits.join(self.classes, "k").select("id", "hs"), "id").select("k", "text", "hs")

    def held_spans(self, more_than: int) -> DataFrame:
        """(g, half, k): texts that share a whole span around a wide run of more than so many rows; of the spans that the same
        texts hold only one."""
        s = self.shape
        many = self.wide.select("g", "k", "h").join(self.agree.where(F.col("n") > more_than).select("g"), "g")
        spans = cut_lineage(self.with_text(many).mapInPandas(lambda x: _span_rows(x, s), "g long, half long, k long").distinct())
        held = spans.groupBy("g", "half").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("k")).alias("x"), F.bit_xor(F.xxhash64("k", F.lit(1))).alias("y")).where("lo < hi")
        one = held.groupBy("lo", "hi", "n", "x", "y").agg(F.min(F.struct("g", "half")).alias("one")).select("one.g", "one.half")
        return spans.join(one, ["g", "half"])


def span_keys(found: Candidates) -> DataFrame:
    """(ka, kb), ka < kb: keys of different texts with a common span."""
    s = found.shape
    few = found.wide.join(found.agree.where(F.col("n") <= FEW).select("g"), "g")
    a = few.select("g", F.col("k").alias("ka"), F.col("l").alias("la"), F.col("r").alias("ra"))
    b = few.select("g", F.col("k").alias("kb"), F.col("l").alias("lb"), F.col("r").alias("rb"))
    near = a.join(b, (a["g"] == b["g"]) & (a["ka"] < b["kb"])).select("ka", "kb", "la", "lb", "ra", "rb")
    checked = near.mapInPandas(lambda x: _check(x, s), "ka long, kb long")
    some = found.held_spans(FEW)
    proven = some.select("g", "half", F.col("k").alias("ka")).join(some.select("g", "half", F.col("k").alias("kb")), ["g", "half"]).where("ka < kb").select("ka", "kb")
    return checked.unionByName(proven).distinct()


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = SPAN) -> DataFrame:
    """-> (passage, doc_id, n_texts): classes of documents whose texts hold one passage of at least min_chars characters, one row for
    each member. Any two documents that share such a passage, and differ in text, are in a class together; equal texts are in a class of their own
    (n_texts 1) and all in the classes of their text. A document is in as many classes as it shares passages with different sets of texts."""
    found = Candidates(docs, doc_id, text, Shape(min_chars))
    held = found.held_spans(0).withColumn("passage", F.concat_ws(":", F.hex("g"), F.hex("half"))).select("passage", "k")
    held = held.join(held.groupBy("passage").agg(F.count("*").alias("n_texts")), "passage")
    equal = found.classes.where("n > 1").select(F.concat(F.lit("="), F.hex("k")).alias("passage"), "k", F.lit(1).cast("long").alias("n_texts"))
    return held.unionByName(equal).join(found.keyed.select("id", "k"), "k").select("passage", F.col("id").alias(doc_id), "n_texts").distinct()


def shared_span_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = SPAN) -> DataFrame:
    """-> (doc_id_a, doc_id_b), a < b: each pair of documents with a common span of at least min_chars characters.

    Characters are Unicode characters, blanks and case significant. Null and shorter texts are in no pair; equal texts of
    min_chars characters or more are pairs as well.
    """
    found = Candidates(docs, doc_id, text, Shape(min_chars))
    keys, ids = span_keys(found), found.keyed.select("id", "k")
    a = keys.join(ids.withColumnsRenamed({"id": "ia", "k": "ka"}), "ka").join(ids.withColumnsRenamed({"id": "ib", "k": "kb"}), "kb").select("ia", "ib")
    same = ids.join(found.classes.where("n > 1").select("k"), "k")
    b = same.select("k", F.col("id").alias("ia")).join(same.select("k", F.col("id").alias("ib")), "k").where("ia < ib").select("ia", "ib")
    return a.unionByName(b).where("ia <> ib").select(F.least("ia", "ib").alias("doc_id_a"), F.greatest("ia", "ib").alias("doc_id_b")).distinct()


def _spans(b: pd.DataFrame, s: Shape) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, RunHashes]]:
    """Every full span around the anchors in hs: (row of its text, its place in the text, its place in the block, hashes)."""
    for index, shift, owner, hashes, ends, at, _, _ in _held_anchors(b, s):
        p = np.unique((at[:, None] - np.arange(s.window)[None, :]).ravel())
        p = p[p >= 0]
        p = p[p + s.span <= ends[p]]
        o = owner[p]
        yield index[o], p + shift[o], p, hashes


def _gram_rows(batches: Iterator[pd.DataFrame], s: Shape) -> Iterator[pd.DataFrame]:
    for b in batches:
        keys = b["k"].to_numpy()
        for row, pos, p, hashes in _spans(b, s):
            yield pd.DataFrame({"g": hashes.at(p, s.span).view(np.int64), "k": keys[row], "pos": pos})


def _span_rows(batches: Iterator[pd.DataFrame], s: Shape) -> Iterator[pd.DataFrame]:
    for b in batches:
        keys = b["k"].to_numpy()
        for row, _, p, hashes in _spans(b, s):
            yield pd.DataFrame({"g": hashes.at(p, s.span).view(np.int64), "half": hashes.at(p, s.span // 2).view(np.int64), "k": keys[row]}).drop_duplicates()


def shared_amount(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = SPAN) -> DataFrame:
    """-> (doc_id, n_chars, shared_chars): for each document how many of its characters lie in a span of at least min_chars
    characters that another document holds as well. Null and short texts share nothing; a text with an equal one shares all."""
    s = Shape(min_chars)
    found = Candidates(docs, doc_id, text, s)
    some = found.wide.select("g", "k", "h").join(found.agree.select("g"), "g").select("k", "h")
    grams = cut_lineage(found.with_text(some).mapInPandas(lambda x: _gram_rows(x, s), "g long, k long, pos long"))
    both = grams.groupBy("g").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo < hi").select("g")
    held = grams.join(both, "g").select("k", "pos").distinct()
    following = F.lead("pos").over(Window.partitionBy("k").orderBy("pos"))
    covered = held.withColumn("c", F.least(F.lit(s.span), F.coalesce(following - F.col("pos"), F.lit(s.span)))).groupBy("k").agg(F.sum("c").alias("covered"))
    per_text = found.classes.join(covered, "k", "left").select("k", "n", F.coalesce("covered", F.lit(0)).alias("covered"))
    amounts = found.keyed.select("id", "k").join(per_text, "k").groupBy("id").agg(F.max("n").alias("n"), F.max("covered").alias("covered"))
    out = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars")).join(amounts, "id", "left")
    amount = F.when(F.col("n_chars") < s.span, F.lit(0)).when(F.col("n") > 1, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0)))
    return out.select(F.col("id").alias(doc_id), "n_chars", amount.cast("long").alias("shared_chars"))


#: Where a sentence ends: after its mark and blanks, or at the end of the line.
SENTENCE_END = r"(?<=[.!?…])\s+|(?<=[。！？；])|\n+"


def sentence_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = 3) -> DataFrame:
    """-> (doc_id, n_sentences, n_removed, removed_chars, kept_text): sentences covered by a repeated run of ``run``
    consecutive sentences are removed, except where the run stands first (smallest doc_id, then position).

    Runs are hashed and joined globally; texts of fewer sentences keep all. Null texts come out null with 0 sentences.
    """
    sentences = F.filter(F.split(F.col(text), SENTENCE_END, -1), lambda s: F.trim(s) != "")
    some = docs.select(F.col(doc_id).alias("id"), sentences.alias("s"))
    last = F.size("s") - run
    runs = some.where(F.size("s") >= run).select("id", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.array_join(F.slice("s", i + 1, run), "\x1f")))).alias("pos", "h"))
    first = runs.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("id", "pos")).alias("first")).where("n > 1")
    again = runs.join(first, "h").where((F.col("id") != F.col("first.id")) | (F.col("pos") != F.col("first.pos")))
    gone = again.select("id", F.explode(F.sequence(F.col("pos"), F.col("pos") + run - 1)).alias("at")).groupBy("id").agg(F.collect_set("at").alias("gone"))
    x = some.join(gone, "id", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    kept = F.filter("s", lambda s, i: ~F.array_contains("gone", i))
    removed = F.aggregate(F.filter("s", lambda s, i: F.array_contains("gone", i)), F.lit(0), lambda a, s: a + F.length(s))
    return x.select(F.col("id").alias(doc_id), F.coalesce(F.size("s"), F.lit(0)).alias("n_sentences"), F.size("gone").alias("n_removed"), F.coalesce(removed, F.lit(0)).alias("removed_chars"), F.array_join(kept, "\n").alias("kept_text"))
