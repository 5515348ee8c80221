"""Language of documents and of mixed-language segments, by compression.

A text is compressed once per language with a zstandard raw-content dictionary of that language; the language whose
dictionary leaves the fewest bytes wins. A narrow margin is rejected: such a line takes the language of the rest of
its document, and where all lines are narrow, of their text as a whole; where that is narrow too, there is no language (null, confidence 0).
Confidence is 1 - best / second-best size. Lines of under MIN_LETTERS letters are judged too, but by
their document unless the margin is wide. All languages are compressed alike; only for a line without their script one isn't tried. A document without an article is judged by its whole page, then by its text,
its title and at last its label, with less confidence.

The dictionaries are fitted on a bounded sample of labelled rows (``PER_LANGUAGE`` documents a language, chosen by
hash), cleaned by cross-fitting: each half's lines stay only where the other half's dictionaries agree with the
label, because labelled texts quote passages in other languages. Everything else covers all rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tarnlight.llm.boilerplate import ARTICLE, flagged_pages, page_kinds

PER_LANGUAGE, SAMPLE_CHARS, DICTIONARY_BYTES, LEVEL = 96, 4000, 48 * 1024, 3
MIN_LETTERS = 60
#: Margin (share of the best size) under which a line is rejected, and under which it may not contradict its document.
NARROW, CONTRADICT = 0.02, 0.08
#: The same for a line of under MIN_LETTERS letters.
CONTRADICT_SHORT = 0.3
#: What a document is judged by, best first, and the weight of the confidence that comes from it.
BASIS = {"article": 1.0, "page": 0.5, "text": 0.25, "title": 0.25, "label": 0.0}

#: Names of the languages (ISO 639-1, 639-2, English, own language), in lower case.
NAMES = {
    "en": ("en", "eng", "english"),
    "zh": ("zh", "zho", "chi", "chinese", "中文", "汉语", "漢語", "普通话", "zhongwen"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
}

_letters = re.compile(r"[^\W\d_]")
_han, _latin = re.compile(r"[㐀-鿿]"), re.compile(r"[A-Za-zÀ-ɏ]")


def named_language(label: Column) -> Column:
    """The language that a label names, region and script left aside; null if none of ours."""
    tag = F.regexp_replace(F.lower(F.trim(label)), r"^([^\s_-]+)[_-](?:[a-z]{4}[_-])?(?:[a-z]{2}|[0-9]{3}|[a-z]{4})$", "$1")
    pairs = [F.lit(x) for code, names in NAMES.items() for n in names for x in (n, code)]
    return F.element_at(F.create_map(*pairs), tag)


class Classifier:
    """Compressors, one a language; made anew in each worker from the dictionaries."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.codes = sorted(dictionaries)
        self.compress = []
        for code in self.codes:
            d = zstandard.ZstdCompressionDict(dictionaries[code], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def sizes(self, text: str) -> dict[str, int]:
        """Size by language; a language whose script the text hasn't is left out."""
        raw = text.encode("utf-8", "surrogatepass")
        han = not text.isascii() and bool(_han.search(text))
        latin = not han or bool(_latin.search(text))
        return {code: len(compress(raw)) for code, compress in zip(self.codes, self.compress) if (han if code == "zh" else latin)}

    def line(self, text: str) -> tuple[str | None, float]:
        """(language, margin) of the least size; no language gives None."""
        return decide(self.sizes(text))


def decide(sizes: dict[str, int]) -> tuple[str | None, float]:
    """(language, margin): the margin is the share of the least size by which the next is larger, 1 without a next."""
    if not sizes:
        return None, 0.0
    order = sorted(sizes.values())
    code = min(sizes, key=lambda c: (sizes[c], c))
    return code, (order[1] - order[0]) / order[0] if len(order) > 1 else 1.0


_made: dict[int, Classifier] = {}


def _classifier(dictionaries: dict[str, bytes]) -> Classifier:
    key = hash(tuple(sorted(dictionaries.items())))
    if key not in _made:
        _made[key] = Classifier(dictionaries)
    return _made[key]


def fit_dictionaries(docs: DataFrame, text: str = "text", label: str = "lang", doc_id: str = "doc_id", title: str = "title") -> dict[str, bytes]:
    """One raw-content dictionary a language from at most PER_LANGUAGE labelled texts of 300 to SAMPLE_CHARS characters each,
    with their titles."""
    fits = F.length(text).between(300, SAMPLE_CHARS)
    named = docs.where(fits).select(doc_id, named_language(F.col(label)).alias("code")).where("code is not null")
    order = W.partitionBy("code").orderBy(F.xxhash64(doc_id), doc_id)
    ids = [r[0] for r in named.withColumn("k", F.row_number().over(order)).where(F.col("k") <= PER_LANGUAGE).select(doc_id).collect()]
    rows = docs.where(F.col(doc_id).isin(ids) & fits).select(named_language(F.col(label)).alias("code"), F.col(text).alias("t"), F.coalesce(F.col(title), F.lit("")).alias("h")).where("code is not null").collect()
    return dictionaries_of([(r.code, r.t, r.h) for r in rows])


def dictionaries_of(rows: list[tuple[str, str, str]]) -> dict[str, bytes]:
    """Dictionaries from (language, text, title), cleaned by cross-fitting; titles go last, where references are cheapest."""
    texts: list[dict[str, list[str]]] = [{}, {}]
    titles: list[dict[str, list[str]]] = [{}, {}]
    for i, (code, t, h) in enumerate(sorted(rows)):
        texts[i % 2].setdefault(code, []).extend(x.strip() for x in t.split("\n") if len(_letters.findall(x)) >= 40)
        titles[i % 2].setdefault(code, []).append(h.strip())

    def packed(t: dict[str, list[str]], h: dict[str, list[str]]) -> dict[str, bytes]:
        out = {}
        for c, x in t.items():
            tail = "\n".join(dict.fromkeys(h.get(c, []))).encode()[-DICTIONARY_BYTES // 3 :]
            body = "\n".join(dict.fromkeys(x)).encode()[-(DICTIONARY_BYTES - len(tail)) :]
            if body or tail:
                out[c] = body + b"\n" + tail
        return out

    kept: list[dict[str, list[str]]] = [{}, {}]
    for mine, other in ((0, 1), (1, 0)):
        judge = Classifier(packed(texts[other], {}))
        for which, pool in enumerate((texts[mine], titles[mine])):
            for code, lines in pool.items():
                for x in dict.fromkeys(lines):
                    got, margin = judge.line(x)
                    if x and got == code and margin >= 0.05:
                        kept[which].setdefault(code, []).append(x)
    return packed(*kept) or packed(texts[0], titles[0])


def classify_lines(lines: list[str], judge: Classifier, long: list[bool] | None = None) -> tuple[list[tuple[str | None, float]], str | None, float]:
    """(language, confidence) of each line, then the document's language and confidence.

    The document's language is the one of the most bytes in long lines that weren't rejected as narrow, its confidence their share times
    their mean confidence; without such a line it is the one of all lines as one text, if its margin isn't narrow, else None. Rejected lines
    take it; a line contradicts it only where the document's language takes clearly more bytes. long tells which lines are long; all if None.
    """
    if not lines:
        return [], None, 0.0
    per_line = [judge.sizes(x) for x in lines]
    best = [decide(x) for x in per_line]
    long = long or [True] * len(lines)
    weight: Counter = Counter()
    for (code, margin), sizes, enough in zip(best, per_line, long):
        if enough and margin >= NARROW:
            weight[code] += sizes[code]
    whole = 0.0
    if weight:
        main = max(sorted(weight), key=weight.__getitem__)
    else:
        main, whole = judge.line("\n".join(lines))
        if whole < NARROW:
            main, whole = None, 0.0
    out, sure = [], []
    for (code, margin), sizes, enough in zip(best, per_line, long):
        if code != main:
            if main is None:
                keep = margin >= (CONTRADICT if enough else CONTRADICT_SHORT)
            else:
                keep = code is not None and (main not in sizes or sizes[main] - sizes[code] >= (CONTRADICT if enough else CONTRADICT_SHORT) * sizes[code])
            if not keep:
                code, margin = main, 0.0
        out.append((code, margin / (1 + margin)))
        if enough and code == main:
            sure.append(margin / (1 + margin))
    if not weight:
        return out, main, whole / (1 + whole)
    share = weight[main] / max(1, sum(weight.values()))
    return out, main, share * sum(sure) / max(1, len(sure))


def line_languages(docs: DataFrame, dictionaries: dict[str, bytes], doc_id: str = "doc_id", source: str = "source_id", text: str = "raw_text", title: str = "title", label: str = "language", copy: str = "text", long_only: bool = False) -> DataFrame:
    """-> (doc_id, line_no, lang, confidence, doc_lang, doc_confidence, label_lang, n_langs, basis) for each line with a letter
    of what the document is judged by (basis): its article, found by the boilerplate operator; without one its whole page;
    without a letter on the page its copy, then its title, whose lines are numbered likewise. A document without a letter in
    any gives nothing. label_lang is what the label names.

    long_only: article lines of at least MIN_LETTERS letters only, and no other basis.
    """
    pages = flagged_pages(docs.select(doc_id, source, text, title, label), doc_id, source, text, title)
    pages = pages.select("doc", "t", "h", "flags", named_language(F.col(label)).alias("label_lang"), F.lit("article").alias("basis"))
    if not long_only:
        lettered = lambda c: F.coalesce(F.col(c).rlike(r"\p{L}"), F.lit(False))
        basis = F.when(lettered(copy), "text").when(lettered(title), "title")
        rest = docs.where(~lettered(text)).withColumn("basis", basis).where("basis is not null")
        body = F.when(F.col("basis") == "text", F.col(copy)).otherwise(F.col(title))
        pages = pages.unionByName(rest.select(F.col(doc_id).alias("doc"), body.alias("t"), F.col(title).alias("h"), F.lit(None).cast("array<int>").alias("flags"), named_language(F.col(label)).alias("label_lang"), "basis"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = _classifier(dictionaries)
        names = ["doc", "line_no", "lang", "confidence", "doc_lang", "doc_confidence", "label_lang", "n_langs", "basis"]
        least = MIN_LETTERS if long_only else 1
        for b in batches:
            out = []
            for d, t, h, f, label_lang, basis in zip(b["doc"], b["t"], b["h"], b["flags"], b["label_lang"], b["basis"]):
                raw = t.split("\n")
                letters = {}
                if basis == "article":
                    letters = {i: len(_letters.findall(raw[i])) for i, k in enumerate(page_kinds(t, f, h)) if k in ARTICLE}
                    if not long_only and not any(letters.values()):
                        basis = "page"
                if basis != "article":
                    letters = {i: len(_letters.findall(x)) for i, x in enumerate(raw)}
                pick = [i for i, k in letters.items() if k >= least]
                got, main, sure = classify_lines([raw[i].strip() for i in pick], judge, [letters[i] >= MIN_LETTERS for i in pick])
                n = len({c for c, _ in got if c})
                w = BASIS[basis]
                out += [(d, i, c, s * w, main, sure * w, label_lang, n, basis) for i, (c, s) in zip(pick, got)]
            yield pd.DataFrame(out, columns=names)

    schema = f"doc {dict(docs.dtypes)[doc_id]}, line_no int, lang string, confidence double, doc_lang string, doc_confidence double, label_lang string, n_langs int, basis string"
    return pages.mapInPandas(run, schema).withColumnRenamed("doc", doc_id)


def document_languages(docs: DataFrame, lines: DataFrame, doc_id: str = "doc_id", label: str = "language") -> DataFrame:
    """-> (doc_id, lang, confidence, n_langs, label_lang, basis), one row for each document; a document without a letter, or whose
    lines are all rejected, has the language of its label, null if it names none, and confidence 0."""
    judged = lines.groupBy(doc_id).agg(*(F.max(c).alias(c) for c in ("doc_lang", "doc_confidence", "n_langs", "basis")))  # the same in all lines
    x = docs.select(doc_id, named_language(F.col(label)).alias("label_lang")).join(judged, doc_id, "left")
    named = F.col("doc_lang").isNull() & F.col("label_lang").isNotNull()
    lang = F.coalesce("doc_lang", "label_lang")
    basis = F.when(named, "label").otherwise(F.col("basis"))
    confidence = F.coalesce("doc_confidence", F.lit(0.0))
    return x.select(doc_id, lang.alias("lang"), confidence.alias("confidence"), F.coalesce("n_langs", lang.isNotNull().cast("int")).alias("n_langs"), "label_lang", basis.alias("basis"))


def segments(lines: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Consecutive lines of one language: (doc_id, segment_no, lang, basis, first_line, last_line, n_lines, confidence)."""
    w = W.partitionBy(doc_id).orderBy("line_no")
    x = lines.withColumn("new", F.when(F.row_number().over(w) == 1, 1).otherwise((~F.lag("lang").over(w).eqNullSafe(F.col("lang"))).cast("int"))).withColumn("segment_no", F.sum("new").over(w) - 1)
    return x.groupBy(doc_id, "segment_no", "lang", "basis").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count("*").alias("n_lines"), F.avg("confidence").alias("confidence"))
