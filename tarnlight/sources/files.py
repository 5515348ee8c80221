"""Binary and text files to rows: text, DOCX, PDF and XLSX content, inbox layout, price and manifest tables, registries.

Office files are read with the standard library (they are zipped XML). The PDF reader takes text operators from plain and
deflated streams; a page it can't read is empty. Files are read on the executors, a bad file is a row with its error.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUPPORTED = ("txt", "md", "docx", "pdf", "xlsx", "xls")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def docx_text(raw: bytes) -> str:
    """Paragraphs that aren't blank, a line each."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in root.iter(f"{_W}p"))
    return "\n".join(x for x in lines if x.strip())


def pdf_text(raw: bytes) -> str:
    """Strings shown by the text operators of each content stream, streams apart by a blank line."""
    pages = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", raw, re.S):
        data = m.group(1)
        try:
            data = zlib.decompress(data)
        except zlib.error:
            pass
        if b"BT" not in data:
            continue
        words = []
        for block in re.findall(rb"BT(.*?)ET", data, re.S):
            line = b"".join(re.sub(rb"\\([()\\])", rb"\1", s) for s in re.findall(rb"\(((?:\\.|[^\\()])*)\)", block))
            words.append(line.decode("latin-1"))
        pages.append("\n".join(words))
    return "\n\n".join(pages)


def xlsx_sheets(raw: bytes) -> dict[str, list[list]]:
    """Sheet name -> grid of cells: str, float, datetime.date or None."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        dated: list[bool] = []
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(z.read("xl/styles.xml"))
            custom = {f.get("numFmtId"): f.get("formatCode", "") for f in styles.iter(f"{_S}numFmt")}
            for xf in styles.findall(f"{_S}cellXfs/{_S}xf"):
                code = xf.get("numFmtId", "0")
                dated.append(14 <= int(code) <= 22 or bool(re.search(r"[ymd]", re.sub(r'"[^"]*"|\[[^]]*\]', "", custom.get(code, "")).lower())))
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for sheet in book.iter(f"{_S}sheet"):
            target = rels[sheet.get(f"{_R}id")].lstrip("/")
            grid: list[list] = []
            for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_S}row"):
                cells: list = []
                for c in row.iter(f"{_S}c"):
                    ref = re.match(r"[A-Z]+", c.get("r", "") or "")
                    at = len(cells)
                    if ref:
                        at = 0
                        for ch in ref.group():
                            at = at * 26 + ord(ch) - 64
                        at -= 1
                    cells += [None] * (at + 1 - len(cells))
                    v, kind = c.find(f"{_S}v"), c.get("t", "n")
                    if kind == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    elif v is None or v.text is None:
                        cells[at] = None
                    elif kind == "s":
                        cells[at] = shared[int(v.text)]
                    elif kind in ("str", "e"):
                        cells[at] = v.text
                    elif int(c.get("s", 0)) < len(dated) and dated[int(c.get("s", 0))]:
                        cells[at] = dt.date(1899, 12, 30) + dt.timedelta(days=int(float(v.text)))
                    else:
                        cells[at] = float(v.text)
                number = int(row.get("r", len(grid) + 1))
                grid += [[] for _ in range(number - 1 - len(grid))]
                grid.append(cells)
            out[sheet.get("name")] = grid
    return out


def xlsx_text(raw: bytes) -> str:
    """Every sheet under its heading, rows as tab-separated lines."""
    show = lambda v: "" if v is None else f"{v:g}" if isinstance(v, float) else str(v)
    parts = []
    for name, grid in xlsx_sheets(raw).items():
        if any(grid):
            parts += [f"## Sheet: {name}", *("\t".join(map(show, row)) for row in grid), ""]
    return "\n".join(parts)


def file_text(name: str, raw: bytes) -> str:
    """Text of a file by its extension; an unknown one raises."""
    kind = name.rpartition(".")[2].lower()
    if kind in ("txt", "md"):
        return raw.decode("utf-8", "ignore")
    reader = {"docx": docx_text, "pdf": pdf_text, "xlsx": xlsx_text, "xls": xlsx_text}.get(kind)
    if reader is None:
        raise ValueError(f"unsupported file type: {kind}")
    return reader(raw)


def read_files(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """(path, modified, checksum, text, error) of all files below path."""
    reader = (spark.readStream if streaming else spark.read).format("binaryFile").option("recursiveFileLookup", "true")
    if streaming:
        reader = reader.schema("path string, modificationTime timestamp, length long, content binary")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, errors = [], []
            for p, c in zip(b["path"], b["content"]):
                try:
                    texts.append(file_text(p, c))
                    errors.append(None)
                except Exception as e:  # one bad file must not end the batch
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            yield pd.DataFrame({"path": b["path"], "modified": b["modified"], "checksum": b["checksum"], "text": texts, "error": errors})

    raw = reader.load(path).select("path", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("checksum"), "content")
    return raw.mapInPandas(run, "path string, modified timestamp, checksum string, text string, error string")


def inbox(files: DataFrame, sources: DataFrame, root: str) -> DataFrame:
    """files(path, ...) laid out as <root>/<bucket>/<source_id>/<YYYY-MM-DD_title.ext>: adds bucket, source_id, published_on,
    title, extension and reject, the first reason that applies (layout, type, source, bucket, date, read), null if accepted."""
    rel = F.split(F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^.*?" + re.escape(root.rstrip("/")) + "/", ""), "/")
    stem = F.regexp_replace(F.element_at(rel, -1), r"\.[^.]*$", "")
    x = files.withColumns({
        "bucket": F.get(rel, F.lit(0)), "source_id": F.get(rel, F.lit(1)), "depth": F.size(rel), "extension": F.lower(F.regexp_extract(F.element_at(rel, -1), r"\.([^.]*)$", 1)),
        "published_on": F.try_to_date(F.nullif(F.regexp_extract(stem, r"^(\d{4}-\d{2}-\d{2})[_\-\s].+$", 1), F.lit("")), "yyyy-MM-dd"),
        "title": F.regexp_extract(stem, r"^\d{4}-\d{2}-\d{2}[_\-\s](.+)$", 1),
    })
    known = sources.groupBy("source_id").agg(F.max("source_bucket").alias("registered"))
    x = x.join(known, "source_id", "left")
    error = F.col("error").isNotNull() if "error" in files.columns else F.lit(False)
    reject = (
        F.when(F.col("depth") < 3, "layout").when(~F.col("extension").isin(*SUPPORTED), "type").when(F.col("registered").isNull(), "source")
        .when(F.col("registered") != F.col("bucket"), "bucket").when(F.col("published_on").isNull(), "date").when(error, "read")
    )
    return x.withColumn("reject", reject).drop("depth", "registered")


PRICES = "price_time date, symbol string, asset_type string, open double, high double, low double, close double, volume double"


def price_csv(spark: SparkSession, path: str) -> DataFrame:
    """Price table with a header; a byte order mark is skipped, an empty cell is null."""
    df = spark.read.option("header", "true").option("nullValue", "").csv(path)
    names = [c.lstrip("﻿").strip() for c in df.columns]
    df = df.toDF(*names)
    return df.select(*[F.col(n).try_cast(t).alias(n) for n, t in (x.split() for x in PRICES.split(", ")) if n in names])


def manifest_csv(spark: SparkSession, path: str, files: DataFrame, file_path: Column | None = None) -> DataFrame:
    """Manifest rows joined to the files they name (by the end of the path); missing files have a null text."""
    m = spark.read.option("header", "true").option("nullValue", "").csv(path)
    m = m.withColumns({"quality_tier": F.col("quality_tier").try_cast("int"), "rumor_flag": F.lower("rumor_flag").isin("true", "1", "yes")})
    base = lambda c: F.substring_index(c, "/", -1)
    f = files.select(base(F.col("path")).alias("_name"), F.col("path").alias("_path"), "text")
    return m.join(f, (base(file_path if file_path is not None else F.col("file_path")) == F.col("_name")) & F.col("_path").endswith(F.col("file_path")), "left").drop("_name", "_path")


def registry_yaml(spark: SparkSession, path: str, key: str = "sources") -> DataFrame:
    """A registry of publishers from YAML (a small file, read on the driver)."""
    import yaml

    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f)
    rows = data[key] if isinstance(data, dict) else data
    names = sorted({k for r in rows for k in r})
    return spark.createDataFrame([tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names))


def settings_json(path: str) -> dict:
    import json

    with open(path, encoding="utf-8") as f:
        return json.load(f)


def listing_links(pages: DataFrame, html: str, contains: str, title_chars: tuple[int, int] = (15, 200)) -> DataFrame:
    """Links of listing pages: (url, title, dated), one row per url, newest first. dated is the first ISO date in url or title."""
    pattern = r"""(?is)<a\b[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""
    hits = F.arrays_zip(F.regexp_extract_all(F.col(html), F.lit(pattern), 1).alias("u"), F.regexp_extract_all(F.col(html), F.lit(pattern), 2).alias("t"))
    x = pages.select(F.explode(hits).alias("x")).select(F.col("x.u").alias("url"), F.trim(F.regexp_replace(F.regexp_replace("x.t", r"<[^>]*>", " "), r"\s+", " ")).alias("title"))
    x = x.where(F.col("url").contains(contains) & F.length("title").between(*title_chars))
    date = F.try_to_date(F.regexp_extract(F.concat_ws(" ", "url", "title"), r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    return x.groupBy("url").agg(F.min("title").alias("title")).withColumn("dated", date).orderBy(F.desc_nulls_last("dated"), "url")
