"""Main content of web pages: keep the article's own lines, name everything else furniture.

Composite text density over an implied tree, the pages arriving as text without markup: body - runs of lines - lines. A line is a
leaf; its tags are its own and its separators. What part of a leaf is link text isn't marked up, so it is estimated:

* by shape: a label, a headline or an abridged teaser is anchor text throughout, running text isn't, and a single short sentence
  is as much as its neighbours are;
* by recurrence: a line that stands on k different pages is text only with a share of k ** -RECURRENCE, and so is one that begins with such a
  line and a colon. Short lines are counted over all sources, long ones within their own. Copies of an article count as one page,
  whatever furniture they were sent with. No number of pages is needed: k = 1 simply says nothing.

Every leaf and the body get their composite density (link-adjusted characters per tag, with the body's share of links).
The threshold comes from the least density on the path from the body to the densest leaf; leaves below it are no text. The subtree is the run of
lines with the largest sum of densities, each further leaf of a gap inside it costing that path's density once more than the one before. Headline, byline, rows of
tables and wrapped paragraph ends have little density of their own and are taken by their place in the run.

Shuffles: hashes of lines, pre-aggregated to counts per content; hashes of the long lines, to find copies; hashes of lines again, for
the join with the few repeated ones (hot contents are broadcast, at most HOT_KEYS of them); page texts once, to meet their flags.
No group of a source is ever gathered.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnlight.operators.joins import skewed_join
from tarnlight.session import cut_lineage

#: Letters from which on a line is counted within its source only, and taken for a paragraph when looking for copies.
LONG_LETTERS = 80
#: What any page has around its text at least, furniture or not: so a bare page has a body density too.
FRAME_TAGS, FRAME_CHARS = 10, 200
#: Part of the least density on the path that a leaf needs: the body's own density is high where there is little furniture.
PATH_PART = 0.5
#: A line on k pages is text with a share of k ** -RECURRENCE: one of all the pages it may have been written for.
RECURRENCE = 1.0
#: Density under which nothing is text, whatever its page: 60 characters, half of them link text.
LEAST_DENSITY = 60.0
#: A copy shares more than this part of its new long lines with the first page that has them: under the same title, another one.
COPY_SHARE, COPY_SHARE_RETITLED = 2 / 3, 0.8
#: Long lines that a copy shares at least: under the same title, where a title is missing, under another title.
COPY_LINES, COPY_LINES_UNTITLED, COPY_LINES_RETITLED = 2, 3, 5
#: Weight (characters, wide ones counting for more) from which on a line may be a sentence, and is running text whatever its ending.
SENTENCE, LONG_LINE = 60, 110
#: Share of a content's pages on which it follows the headline, from which on it is a byline.
BYLINE_SHARE = 0.6

HEADLINE, BYLINE, PARAGRAPH, ROW, FURNITURE, BLANK = "headline", "byline", "paragraph", "row", "furniture", "blank"
ARTICLE = (HEADLINE, BYLINE, PARAGRAPH, ROW)

_NUMBER = r"[+-]?\d[\d.,]*"
_numbers = re.compile(_NUMBER)
_terminal = re.compile(r"[.。!！?？;；:][\"'”’」』）)\]]*$")
_inner_stop = re.compile(r"[.!?]\s+\S|[。！？]\S")
_wide = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_separators = re.compile(r"\s[|·>/•»]\s|^[*•|>\-]\s")
_edge = re.compile(r"^[\s*•|>»·\-]+|[\s|>»·:]+$")
_letter = re.compile(r"[^\W\d_]")


_not_letters = re.compile(r"[\W\d_]+")
_ASCII_LETTERS = {i: None for i in range(128) if not chr(i).isalpha()}
_not_content = re.compile(r"[\W_]+")
NO_KEY, LONG, AFTER, BODY, TITLED = 0, 1, 2, 4, 8
ROW_CHARS = 200
#: Flags of a line: no << 10 | pages << 2 | below headlines << 1 | lead; so many pages at most.
MOST_PAGES = 255


def line_marks(text: str, title: str | None) -> tuple[list[int], list[int], list[int]]:
    """Per line of a page the hash of its key (what identifies furniture: letters only, but short rows of three or more
    numbers keep their digits), the hash of the key of its part before a colon, and LONG + AFTER + BODY + TITLED bits: many letters;
    follows the title; as long as a paragraph, wide letters counted by their width; on a page with a title."""
    head = title.strip().lower() if title else None
    hs, leads, bits = [], [], []
    above = ""
    for line in text.lower().split("\n"):
        bare = line.strip()
        if not bare:
            hs.append(NO_KEY)
            leads.append(NO_KEY)
            bits.append(0)
            continue
        key = _letters_only(line)
        body = len(key) >= LONG_LETTERS or (not key.isascii() and len(key) + 1.5 * len(_wide.findall(key)) >= LONG_LETTERS)
        if len(line) <= ROW_CHARS and len(_numbers.findall(line)) >= 3:
            key = _not_content.sub("", line)
            body = False
        lead = NO_KEY
        at = line.find(":", 0, 62)
        if at < 0 and not line.isascii():
            at = line.find("：", 0, 62)
        if 3 <= at <= 60 and len(line) > at + 8:
            part = _letters_only(line[:at])
            lead = _hash(part) if part else NO_KEY
        hs.append(_hash(key) if key else NO_KEY)
        leads.append(lead)
        bits.append((LONG if len(key) >= LONG_LETTERS else 0) + (AFTER if head and above == head else 0) + (BODY if body else 0) + (TITLED if head else 0))
        above = bare
    return hs, leads, bits


def _letters_only(x: str) -> str:
    return x.translate(_ASCII_LETTERS) if x.isascii() else _not_letters.sub("", x)


def _hash(x: str) -> int:
    h = xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _mark_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        marks = [line_marks(t, h) for t, h in zip(b["t"], b["h"])]
        titles = [_hash(_not_content.sub("", h.lower())) if h and h.strip() else None for h in b["h"]]
        yield pd.DataFrame({"doc": b["doc"], "src": b["src"], "title": pd.array(titles, dtype="Int64"), "hs": [m[0] for m in marks], "leads": [m[1] for m in marks], "bits": [m[2] for m in marks]})


def furniture_flags(docs: DataFrame, doc_id: str, source: str, text: str, title: str) -> DataFrame:
    """(doc, flags): for each line of a document that stands on more than one page, or whose part before a colon is such a
    line, on how many pages, and whether it follows the headline on most of them. Only different pages count: those of
    the same lines once, and those that copy_groups finds to carry one article once."""
    kind = dict(docs.dtypes)[doc_id]
    some = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.xxhash64(F.coalesce(F.col(source), F.lit(""))).alias("src"), F.col(text).alias("t"), F.col(title).alias("h"))
    marked = cut_lineage(some.mapInPandas(_mark_rows, f"doc {kind}, src long, title long, hs array<long>, leads array<long>, bits array<int>"))
    first = marked.groupBy("src", F.xxhash64("hs").alias("page")).agg(F.min("doc").alias("doc")).select("doc")
    pages = cut_lineage(marked.join(first, "doc", "left_semi"))
    lines = pages.join(copy_groups(pages), "doc", "left").select("src", "page", F.explode(F.array_distinct(F.arrays_zip("hs", "bits"))).alias("x")).select("src", "page", F.col("x.hs").alias("h"), F.col("x.bits").alias("bits")).where(F.col("h") != NO_KEY)
    lines = lines.withColumn("h", _scoped("h", F.col("bits")))
    copied = lines.where("page is not null").groupBy("src", "page", "h").agg(F.bit_or("bits").alias("bits"))
    once = lines.where("page is null").unionByName(copied)
    having = lambda bit: F.count_if(F.col("bits").bitwiseAND(bit) > 0)
    counts = once.groupBy("h").agg(F.count("*").alias("k"), having(AFTER).alias("k_after"), having(TITLED).alias("k_titled")).where("k > 1")
    often = cut_lineage(counts.select("h", "k", ((F.col("k_after") > 0) & (F.col("k_after") >= BYLINE_SHARE * F.col("k_titled"))).alias("below")))
    own = marked.select("doc", "src", F.posexplode(F.arrays_zip("hs", "bits")).alias("no", "x")).where(F.col("x.hs") != NO_KEY).select("doc", _scoped("x.hs", F.col("x.bits")).alias("h"), F.col("no").alias("at"))
    leads = marked.select("doc", F.posexplode("leads").alias("no", "h")).where(F.col("h") != NO_KEY).select("doc", "h", (-F.col("no") - 1).alias("at"))
    hit = skewed_join(own.unionByName(leads), often.withColumn("weight", F.col("k")), ["h"], "weight")
    no, lead = F.greatest(F.col("at"), -F.col("at") - 1).cast("long"), (F.col("at") < 0).cast("long")
    flag = no * 1024 + F.least("k", F.lit(MOST_PAGES)) * 4 + F.col("below").cast("long") * 2 + lead
    return hit.groupBy("doc").agg(F.collect_set(flag).alias("flags"))


def _scoped(h: str, bits: Column) -> Column:
    """The key of a long line holds within its source only."""
    return F.when(bits.bitwiseAND(LONG) > 0, F.xxhash64("src", h)).otherwise(F.col(h))


def copy_groups(pages: DataFrame) -> DataFrame:
    """(doc, page): for pages that carry an article of an earlier page of their source, and for that page, its doc.

    Each long line is led by the first page that has it. What a page shares with a leader is weighed against the long
    lines that stand there for the first time, so that lines of the site, led by other pages, don't matter; and the leader must have at
    least half of its long lines in common with it.
    """
    body = F.array_distinct(F.transform(F.filter(F.arrays_zip("hs", "bits"), lambda x: x["bits"].bitwiseAND(BODY) > 0), lambda x: x["hs"]))
    held = pages.select("doc", "src", "title", body.alias("body")).withColumn("total", F.size("body"))
    held = held.select("doc", "src", "title", "total", F.explode("body").alias("h"))
    led = cut_lineage(held.groupBy("src", "h").agg(F.min(F.struct("doc", "title", "total")).alias("lead"), F.count("*").alias("k")).where("k > 1"))
    shared = skewed_join(held, led, ["src", "h"], "k").where(F.col("lead.doc") != F.col("doc"))
    pairs = shared.groupBy("doc", "title", "total", "lead").agg(F.count("*").alias("n"))
    new = F.col("n") + F.col("total") - F.sum("n").over(Window.partitionBy("doc"))
    same = F.col("title") == F.col("lead.title")
    least = F.when(same, COPY_LINES).when(same.isNull(), COPY_LINES_UNTITLED).otherwise(COPY_LINES_RETITLED)
    share = F.when(same, COPY_SHARE).when(same.isNull(), COPY_SHARE).otherwise(COPY_SHARE_RETITLED)
    copies = pairs.withColumn("new", new).where((F.col("n") >= least) & (F.col("n") > share * F.col("new")) & (2 * F.col("n") >= F.col("lead.total")))
    copies = cut_lineage(copies.groupBy("doc").agg(F.min("lead.doc").alias("page")))
    return copies.unionByName(copies.select(F.col("page").alias("doc"), "page")).groupBy("doc").agg(F.min("page").alias("page"))


class Line:
    """A leaf of the page's tree."""

    __slots__ = ("no", "text", "chars", "tags", "numbers", "row", "stop", "link", "density", "recurs", "below", "pages", "lead")

    def __init__(self, no: int, raw: str, pages: int, below: bool | None, lead: int) -> None:
        """pages: on how many it stands; below: follows headlines (None: unknown); lead: pages of its part before a colon."""
        self.no, self.pages, self.below, self.lead = no, pages, below, lead
        self.recurs = pages * (1 + lead) > 2  # more link than text by that alone
        self.density = 0.0
        text = _edge.sub("", raw)
        if "  " in text or not text.isprintable():
            text = " ".join(text.split())
        self.text = text
        self.chars = len(text) if text.isascii() else len(text) + 1.5 * len(_wide.findall(text))
        if self.recurs and 2 * self.chars * -math.log1p(-((pages * (1 + lead)) ** -RECURRENCE)) < LEAST_DENSITY:
            # its density can't reach the least one, whatever its shape
            self.tags, self.numbers, self.row, self.stop, self.link = 1, 0, False, False, 1.0
            return
        self.tags = 1 + len(_separators.findall(raw.strip()))
        self.numbers = len(_numbers.findall(text)) if self.chars < 90 else 0
        letters = len(_letter.findall(text)) if self.numbers >= 3 else self.chars
        self.row = self.numbers >= 3 and letters <= 24 and text.count("%") < 2
        self.stop = bool(_terminal.search(text))
        if text.rstrip(". ").endswith("…") or text.endswith("..."):
            self.link = 1.0
        elif self.chars >= LONG_LINE or (self.chars >= SENTENCE and _inner_stop.search(text)):
            self.link = 0.0
        else:
            self.link = SINGLE if self.stop and self.chars >= SENTENCE else 1.0

    def weigh(self, above: float, under: float) -> None:
        """Settle the link share: that of a single sentence by its neighbours, that of any line by its recurrence."""
        shape = (above + under) / 2 if self.link == SINGLE else self.link
        self.link = 1 - (1 - shape) * (self.pages * (1 + self.lead)) ** -RECURRENCE


#: Link share of a single short sentence before its neighbours are known.
SINGLE = 0.5


def composite_density(chars: float, tags: float, link_chars: float, link_tags: float, body_links: float) -> float:
    """Characters per tag times the logarithm of the proportions of characters and tags to those in links, to a base that grows with the
    link characters and with the body's share of them. All in links gives 0."""
    if chars <= 0:
        return 0.0
    lc, lt = max(link_chars, 1.0), max(link_tags, 1.0)
    base = math.log(chars * lc / max(chars - lc, 1.0) + body_links * chars + math.e)
    return chars / tags * math.log(max(chars / lc * tags / lt, 1.0)) / math.log(base)


def path_density(lines: list[Line]) -> float:
    """Sets the density of every leaf; the least density on the path from the body to the densest leaf, and LEAST_DENSITY at least."""
    c, t = FRAME_CHARS + sum(x.chars for x in lines), FRAME_TAGS + sum(x.tags for x in lines)
    lc, lt = FRAME_CHARS + sum(x.chars * x.link for x in lines), FRAME_TAGS + sum(x.tags * x.link for x in lines)
    for x in lines:
        if x.link < 1:
            x.density = composite_density(x.chars, x.tags, x.chars * x.link, x.tags * x.link, lc / c)
    return max(LEAST_DENSITY, min(composite_density(c, t, lc, lt, lc / c), max(x.density for x in lines)))


def main_run(lines: list[Line], floor: float, gap_cost: float) -> tuple[int, int]:
    """First and last leaf of text (density of at least floor) of the run with the largest sum of densities; (0, -1) without any."""
    best = total = 0.0
    begin = gap = 0
    found = (0, -1)
    for i, x in enumerate(lines):
        if x.density >= floor:
            total, gap = total + x.density, 0
            if total > best:
                best, found = total, (begin, i)
        elif not x.row:  # rows neither feed nor end a run
            gap += 1
            total -= gap_cost * gap
            if total <= 0:
                total, begin, gap = 0.0, i + 1, 0
    first, last = found
    while first < last and lines[first].density < floor:
        first += 1
    return first, last


def classify(text: str, pages: dict[int, tuple[int, bool]], leads: dict[int, int], title: str | None) -> list[str]:
    """The kind of each line of a page. pages: by line number on how many pages the line stands and whether below headlines;
    leads: on how many its part before a colon stands."""
    raw = text.split("\n")
    kinds = [FURNITURE if x.strip() else BLANK for x in raw]
    lines = [Line(i, x, *pages.get(i, (1, None)), leads.get(i, 0)) for i, x in enumerate(raw) if x.strip()]
    if not lines:
        return kinds
    shapes = [1.0, *(x.link for x in lines), 1.0]
    for i, x in enumerate(lines):
        x.weigh(shapes[i], shapes[i + 2])
    path = path_density(lines)
    floor = max(LEAST_DENSITY, PATH_PART * path)
    first, end = main_run(lines, floor, path)
    if end < 0:
        return kinds
    head = _headline(lines, first, title)
    if head is not None and head > end:
        head = None
    if head is not None:
        kinds[lines[head].no] = HEADLINE
        first = head + 1  # above the headline nothing belongs to the article, below it all text does
    start = first
    open_end = False
    for i in range(start, len(lines)):
        x = lines[i]
        near = i == start or (i == start + 1 and lines[start].recurs)
        if x.density >= floor and i <= end:
            kinds[x.no] = PARAGRAPH
            open_end = not x.stop
        elif near and (x.below or (x.below is None and head is not None and i == start and x.link == 1 and not x.lead and x.chars < SENTENCE and x.numbers < 3 and not x.stop)):
            kinds[x.no] = BYLINE
        elif x.recurs or x.below:
            continue
        elif x.row:
            kinds[x.no] = ROW
        elif open_end and (x.text[:1].islower() or _inner_stop.search(x.text) or (x.stop and i > start and kinds[lines[i - 1].no] == PARAGRAPH)):
            # the rest of a wrapped paragraph
            kinds[x.no] = PARAGRAPH
            open_end = not x.stop
        elif i > end:
            break
    return kinds


def _headline(lines: list[Line], first: int, title: str | None) -> int | None:
    """The page's title as given, nearest above the first paragraph; else the nearest plain line there, or the one on it where
    the nearest is so much shorter that it is the byline."""
    want = " ".join(_edge.sub("", title).split()).casefold() if title else ""
    at = [i for i, x in enumerate(lines) if want and _same(x.text, want)]
    if at:
        above = [i for i in at if i <= first]
        return above[-1] if above else at[0]
    plain = lambda i: i >= 0 and not lines[i].recurs and not lines[i].row and lines[i].chars >= 15 and lines[i].numbers < 3
    i = first - 1
    while i >= 0 and (lines[i].below or lines[i].row):
        i -= 1
    if not plain(i):
        return None
    return i - 1 if i == first - 1 and plain(i - 1) and lines[i].chars < min(SENTENCE, 0.75 * lines[i - 1].chars) else i


def _same(a: str, b: str) -> bool:
    return len(a) < 2 * len(b) and a.casefold() == b


def page_kinds(text: str, flags: list[int] | None, title: str | None) -> list[str]:
    pages: dict[int, tuple[int, bool]] = {}
    leads: dict[int, int] = {}
    for f in flags if flags is not None else ():
        no, rest = divmod(int(f), 1024)
        if rest & 1:
            leads[no] = rest >> 2
        else:
            pages[no] = rest >> 2, bool(rest & 2)
    return classify(text, pages, leads, title)


def flagged_pages(docs: DataFrame, doc_id: str, source: str, text: str, title: str) -> DataFrame:
    """(doc, t, h, flags, ...): the pages with the flags of their lines and all other columns of docs that don't clash."""
    flags = furniture_flags(docs, doc_id, source, text, title)
    pages = docs.where(F.col(text).isNotNull()).withColumns({"doc": F.col(doc_id), "t": F.col(text), "h": F.col(title)})
    return pages.join(flags, "doc", "left")


def line_kinds(docs: DataFrame, doc_id: str = "doc_id", source: str = "source_id", text: str = "raw_text", title: str = "title") -> DataFrame:
    """-> (doc_id, line_no, kind): the kind of each line of each page, blank lines left out.

    Lines are numbered from 0 with blank ones counted. Null pages give nothing; a page without an article is
    furniture throughout; a null source is one source; a repeated document row gives its lines again.
    """
    pages = flagged_pages(docs, doc_id, source, text, title)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            doc, no, kind = [], [], []
            for d, t, h, f in zip(b["doc"], b["t"], b["h"], b["flags"]):
                for i, k in enumerate(page_kinds(t, f, h)):
                    if k != BLANK:
                        doc.append(d)
                        no.append(i)
                        kind.append(k)
            yield pd.DataFrame({"doc": doc, "line_no": no, "kind": kind})

    kind = dict(docs.dtypes)[doc_id]
    return pages.select("doc", "t", "h", "flags").mapInPandas(run, f"doc {kind}, line_no int, kind string").withColumnRenamed("doc", doc_id)
