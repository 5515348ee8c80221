"""Broker sheets to quotes. A layout says where values stand; the reader is one for all layouts.

Three ways of finding columns: blocks under anchor labels with column names, fixed positions held against a label row,
and plain positions. Rows are months (a date or MON'YY, numbered M1, M2, ... in order) or strips (a label of their own).
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.sources.files import xlsx_sheets

QUOTES = "obs_date string, source string, category string, spread string, tenor string, contract string, value double, unit string"
_MONTH_TEXT = re.compile(r"^[A-Z]{3}'\d{2}$")


@dataclass(frozen=True)
class Series:
    """What a column holds; ``at`` is its position, ``label`` what the label row must contain."""

    spread: str
    category: str
    unit: str = "$/bbl"
    at: int | None = None
    label: str | None = None


@dataclass(frozen=True)
class Layout:
    source: str
    needle: str
    sheet: str
    columns: tuple[Series, ...] = ()
    blocks: dict[str, dict[str, Series]] = field(default_factory=dict)
    label_row: int | None = None
    strips: str | None = None
    contract_at: int | None = None


def _row_tenor(cell, count: int, layout: Layout) -> tuple[str, str, int] | None:
    """(tenor, contract, months so far) of a data row, None for other rows."""
    if isinstance(cell, dt.date):
        return f"M{count + 1}", cell.strftime("%b-%y"), count + 1
    text = str(cell).strip()
    if not layout.strips and _MONTH_TEXT.match(text):
        return f"M{count + 1}", text, count + 1
    if layout.strips and re.fullmatch(layout.strips, text, re.I):
        return text, text, count
    return None


def _number(cell) -> float | None:
    try:
        return round(float(cell), 4) if cell is not None else None
    except (TypeError, ValueError):
        return None


def grid_quotes(grid: list[list], layout: Layout, obs_date: str) -> list[tuple]:
    """Rows of QUOTES from the cells of a sheet."""
    cell = lambda r, c: grid[r][c] if r < len(grid) and c < len(grid[r]) else None
    parts: list[tuple[int, int, list[tuple[int, Series]]]] = []
    if layout.blocks:
        anchors = [(r, str(cell(r, 0)).strip().lower()) for r in range(len(grid)) if str(cell(r, 0)).strip().lower() in layout.blocks]
        for (r, name), stop in zip(anchors, [a for a, _ in anchors[1:]] + [len(grid)]):
            want = layout.blocks[name]
            parts.append((r + 1, stop, [(c, want[str(v).strip()]) for c, v in enumerate(grid[r]) if c and v is not None and str(v).strip() in want]))
    else:
        cols = [(s.at, s) for s in layout.columns]
        if layout.label_row is not None:
            held = [(c, s) for c, s in cols if s.label and s.label.lower() in str(cell(layout.label_row, c) or "").lower()]
            cols = held or cols
        parts.append((0, len(grid), cols))
    out = []
    for begin, stop, cols in parts:
        months = 0
        for r in range(begin, stop):
            first = cell(r, 0)
            got = None if first is None else _row_tenor(first, months, layout)
            if got is None:
                continue
            tenor, contract, months = got
            if layout.contract_at is not None and (other := cell(r, layout.contract_at)) is not None:
                contract = other.strftime("%b-%y") if isinstance(other, dt.date) else str(other).strip()
            for c, s in cols:
                v = _number(cell(r, c))
                if v is not None:
                    out.append((obs_date, layout.source, s.category, s.spread, tenor, contract, v, s.unit))
    return out


def _crude(names: tuple[str, ...], category: str, suffix: str = "") -> dict[str, Series]:
    return {n: Series(n + suffix, category) for n in names}


_OUTRIGHTS, _DIFFS = ("Brent", "Dubai", "Dated Brent", "WTI"), ("Brent-Dubai", "Dated Dubai", "WTI-Brent", "WTI-Dubai")
#: Where the three known sheets keep their series.
LAYOUTS = (
    Layout("SC", "sc_price_indication", "Price Indication", strips=r"[1-4]Q\d{2}", blocks={
        "flat price": _crude(_OUTRIGHTS, "crude_outright"), "arb-cracks": _crude(_DIFFS, "crude_diff"), "time spreads": _crude(_OUTRIGHTS, "crude_timespread", " cal"),
    }),
    Layout("PVM", "pvmpricesheet", "Sheet1", label_row=5, contract_at=20, columns=(
        Series("WTI", "crude_outright", at=2, label="WTI"), Series("Brent", "crude_outright", at=6, label="BRENT"), Series("Dated Brent", "crude_outright", at=8, label="DTD"),
        Series("Dubai", "crude_outright", at=13, label="DUBAI"), Series("WTI-Brent", "crude_diff", at=3, label="WTI/BRENT"), Series("WTI-Dubai", "crude_diff", at=4, label="WTI/DUB"),
        Series("Dated-Dubai", "crude_diff", at=11, label="Dtd/Dub"), Series("Brent-Dubai(EFS)", "crude_diff", at=12, label="EFS"), Series("Brent DFL", "crude_struct", at=9, label="DFL"),
    )),
    Layout("MITSUI", "mitsui_asia_prices", "Indications", strips=r"Q[1-4]-\d{2}|\d{4}", columns=(
        Series("WTI", "crude_outright", at=1), Series("Brent", "crude_outright", at=3), Series("Dubai", "crude_outright", at=5), Series("JCC", "crude_outright", at=17),
        Series("Sing Kero", "product_outright", at=7), Series("Sing Gasoil", "product_outright", at=13), Series("Sing Naphtha", "product_outright", at=15),
        Series("Sing 380cst", "product_outright", "$/mt", at=9), Series("Sing 180cst", "product_outright", "$/mt", at=11),
    )),
)


def sheet_quotes(files: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """files(path, content) -> quotes; the layout goes by the file's name, which begins with the date. Other files and
    sheets that can't be read give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, raw in zip(b["path"], b["content"]):
                name = path.rsplit("/", 1)[-1]
                layout = next((x for x in layouts if x.needle in name.lower()), None)
                if layout is None or not re.match(r"\d{4}-\d{2}-\d{2}", name):
                    continue
                try:
                    rows += grid_quotes(xlsx_sheets(raw)[layout.sheet], layout, name[:10])
                except Exception:  # a broken sheet is skipped, as any single failure
                    continue
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in QUOTES.split(", ")])

    return files.select(F.col("path"), F.col("content")).mapInPandas(run, QUOTES)
