"""Text functions as Column expressions: cleaning, chunking, ids, lexicon matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_text(c: Column) -> Column:
    """Line ends unified, three or more line feeds to two, runs of blanks and tabs to one blank, outer white space off."""
    c = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    c = F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " ")
    return F.regexp_replace(c, r"^[\s 　]+|[\s 　]+$", "")


def estimate_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def chunks(df: DataFrame, text: str = "text", chars: int = 1800, overlap: int = 250) -> DataFrame:
    """df with one row per chunk: chunk_index, chunk_text, token_estimate. Sliding windows of ``chars`` that overlap; each is
    trimmed, and blank ones are skipped without taking an index. Null and blank texts give no row."""
    n = F.length(text)
    step = chars - overlap
    last = F.greatest(F.lit(0), F.ceil((n - chars) / step)).cast("int")
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: trim(F.substring(F.col(text), i * step + 1, F.lit(chars))))
    pieces = F.filter(pieces, lambda x: x != "")
    out = df.where(F.col(text).isNotNull()).select("*", F.posexplode(pieces).alias("chunk_index", "chunk_text"))
    return out.withColumn("token_estimate", estimate_tokens(F.col("chunk_text")))


def slug(c: Column, length: int = 80) -> Column:
    return F.btrim(F.substring(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), 1, length), F.lit("_"))


def content_id(c: Column, prefix: str = "doc_") -> Column:
    """prefix + the first 16 hex digits of the SHA-256 of the content."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(c, 256), 1, 16))


def chunk_id(document_id: Column, index: Column) -> Column:
    return F.concat(F.lit("chk_"), F.regexp_replace(document_id, "^doc_", ""), F.lit("_"), F.lpad(index.cast("string"), 4, "0"))


def event_id(document_id: Column, chunk: Column, topic: Column) -> Column:
    return F.concat_ws("_", F.lit("evt"), document_id, F.substring_index(chunk, "_", -1), F.regexp_replace(F.lower(topic), "[^a-z0-9_]+", ""))


def terms_present(text: Column, terms: Sequence[str]) -> Column:
    """How many of the terms occur in the text, letter case aside (each counts once)."""
    low = F.lower(text)
    return sum((low.contains(t.lower()).cast("int") for t in terms), F.lit(0))


def occurrences(text: Column, terms: Sequence[str]) -> Column:
    """Non-overlapping occurrences of each term, summed up; overlapping terms count more than once."""
    low = F.lower(text)
    return sum(((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t) for t in terms), F.lit(0.0)).cast("int")


def present(text: Column, terms: Sequence[str], most: int | None = None) -> Column:
    """The terms that occur, in the order given, at most ``most``."""
    low = F.lower(text)
    hits = F.filter(F.array(*map(F.lit, terms)), lambda t: low.contains(F.lower(t)))
    return hits if most is None else F.slice(hits, 1, most)


def topic_matches(df: DataFrame, lexicon: dict[str, tuple[Sequence[str], str]], text: str = "text", base: float = 0.45, step: float = 0.12) -> DataFrame:
    """One row per matched topic: topic, hits, novelty = min(1, base + step * hits), default_direction, topic_rank
    (by novelty, ties in lexicon order). The lexicon is a parameter: topic -> (keywords, direction)."""
    rows = [
        F.struct(F.lit(t).alias("topic"), terms_present(F.col(text), words).alias("hits"), F.lit(direction).alias("default_direction"), F.lit(i).alias("i"))
        for i, (t, (words, direction)) in enumerate(lexicon.items())
    ]
    found = F.filter(F.array(*rows), lambda x: x["hits"] > 0)
    scored = F.transform(found, lambda x: F.struct((-F.least(F.lit(1.0), F.lit(base) + F.lit(step) * x["hits"])).alias("neg"), x["i"].alias("i"), x["topic"].alias("topic"), x["hits"].alias("hits"), x["default_direction"].alias("default_direction")))
    out = df.select("*", F.posexplode(F.array_sort(scored)).alias("topic_rank", "_m"))
    return out.select(*df.columns, "topic_rank", F.col("_m.topic"), F.col("_m.hits"), (-F.col("_m.neg")).alias("novelty"), F.col("_m.default_direction"))


def lean(up: Column, down: Column, default: Column) -> Column:
    """bullish or bearish by the larger count; equal counts above 0 are mixed, no hits at all give the default."""
    return F.when(up > down, "bullish").when(down > up, "bearish").when(up > 0, "mixed").otherwise(default)


def is_rumor(text: Column, bucket: Column, words: Sequence[str]) -> Column:
    """A private social source, or a word of rumor."""
    return F.coalesce(bucket == "social_private_manual", F.lit(False)) | (terms_present(text, words) > 0)


def verification(text: Column, bucket: Column, rumor: Column, confirming: Sequence[str]) -> Column:
    """Confirmed by an official bucket or a confirming word, else unverified for a rumor, else partially confirmed."""
    official = F.coalesce(bucket.isin("official_data", "official_reports"), F.lit(False))
    return F.when(official | (terms_present(text, confirming) > 0), "officially_confirmed").when(rumor, "unverified").otherwise("partially_confirmed")


def horizon(text: Column, medium: Sequence[str]) -> Column:
    return F.when(terms_present(text, medium) > 0, "medium_term").otherwise("swing")


def regions(text: Column, keys: dict[str, Sequence[str]]) -> Column:
    """The regions of which a key occurs, in the order given; global if none."""
    hits = F.array_compact(F.array(*[F.when(terms_present(text, words) > 0, F.lit(r)) for r, words in keys.items()]))
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit("global")))


#: Credibility by bucket of the source, what a rumor costs, the sources that have the floor.
BUCKET_CREDIBILITY = {
    "official_data": 0.95, "official_reports": 0.92, "institutional_public": 0.84, "sellside_private": 0.80,
    "authoritative_news": 0.72, "social_open": 0.45, "social_private_manual": 0.30,
}
OTHER_CREDIBILITY, RUMOR_COST, TRUSTED, TRUSTED_FLOOR = 0.50, 0.12, ("eia", "opec", "ofac"), 0.93


def credibility(bucket: Column, source_name: Column, rumor: Column) -> Column:
    """By bucket, less for a rumor, not under the floor of trusted sources, between 0.05 and 1."""
    table = F.create_map(*[F.lit(x) for pair in BUCKET_CREDIBILITY.items() for x in pair])
    base = F.coalesce(F.try_element_at(table, bucket), F.lit(OTHER_CREDIBILITY)) - F.when(rumor, RUMOR_COST).otherwise(0.0)
    base = F.when(F.coalesce(F.lower(source_name).isin(*TRUSTED), F.lit(False)), F.greatest(base, F.lit(TRUSTED_FLOOR))).otherwise(base)
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), base))


def strip_markup(c: Column, drop: Sequence[str] = ("script", "style", "nav", "header", "footer", "aside", "form")) -> Column:
    """Plain text of simple HTML: whole elements dropped, tags to line ends, common entities read, blank lines off. For
    large or broken pages the boilerplate operator is the tool."""
    for tag in drop:
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "\n")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", "\n")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(lines, "\n")


def headline(c: Column, after: int = 30, most: int = 160, separators: Sequence[str] = (". ", "! ", "? ", "; ", " - ")) -> Column:
    """Text up to the first separator that stands behind position ``after``, white space collapsed, at most ``most`` characters."""
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    at = [F.nullif(F.locate(s, flat, after + 1), F.lit(0)) for s in separators]
    end = F.least(*at, F.lit(most + 1))
    return F.substring(flat, F.lit(1), end - 1)


def json_object(c: Column, schema: str) -> Column:
    """The JSON object between the first { and the last } of a reply, null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit("")), schema)
