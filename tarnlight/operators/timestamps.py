"""Strings of many notations, precisions and zones to one UTC instant.

An ordered cascade of anchored patterns turns a string into canonical fields
(year|month|day|hour|minute|second|fraction|am-pm|zone); the first pattern that matches the whole string
decides. Parsing is strict: a field out of range or an impossible date gives null. A string without a
zone is local time at its source. All of it is built-in functions, so a scan needs no Python and no
shuffle beside the lookup of the source's zone.

Policy for local times: one that occurs twice is the first of the two; one that is skipped keeps the
offset from before the change.
"""

from __future__ import annotations

from collections.abc import Callable
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZONE = r"(Z|z|UTC|GMT|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Z]{2,5}|北京时间)"
TIME = rf"(\d{{1,2}})[:.](\d{{2}})(?:[:.](\d{{2}})(?:[.,](\d{{1,9}}))?)?(?:\s*([AaPp])\.?[Mm]\.?)?(?:\s*{ZONE})?"
MONTH = r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?"
DAY_NAME = r"(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,?\s+)?"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

#: (name, pattern, canonical form). Year-first forms come before the ambiguous ones; slashes are month
#: first unless the year leads, dots are day first.
CASCADE: tuple[tuple[str, str, str], ...] = (
    ("epoch", r"^(\d{10})(?:[.](\d{1,9}))?$", "E|$1|$2"),
    ("epoch_ms", r"^(\d{10})(\d{3})$", "E|$1|$2"),
    ("epoch_us", r"^(\d{10})(\d{6})$", "E|$1|$2"),
    ("iso", rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:(?:[Tt]|\s+){TIME})?$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("compact", rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d{{1,9}}))?)?()(?:\s*{ZONE})?)?$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("year_slash", rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})(?:\s+{TIME})?$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("month_slash", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,?\s+{TIME})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    ("day_dot", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:,?\s+{TIME})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("day_month", rf"^{DAY_NAME}(\d{{1,2}})\s+{MONTH}\s+(\d{{4}})(?:,?\s+{TIME})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("month_day", rf"^{DAY_NAME}{MONTH}\s+(\d{{1,2}}),?\s+(\d{{4}})(?:,?\s+{TIME})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    ("cjk", rf"^(\d{{4}})年(\d{{1,2}})月(\d{{1,2}})日(?:\s*{TIME})?$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
)

#: Zone abbreviations with a fixed offset, in minutes.
FIXED_OFFSETS = {
    "Z": 0, "UTC": 0, "GMT": 0, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "BST": 60, "CET": 60, "CEST": 120, "GST": 240, "SGT": 480, "HKT": 480, "JST": 540, "北京时间": 480,
}
#: Abbreviations that follow a place's wall clock.
WALL_CLOCKS = {"ET": "America/New_York", "CT": "America/Chicago", "PT": "America/Los_Angeles"}


def canonical(text: Column) -> Column:
    """The cascade itself: canonical fields of the first pattern that matches, else null."""
    v = F.regexp_replace(text, r"^\s+|\s+$", "")
    out: Column | None = None
    for _, pattern, form in CASCADE:
        hit = F.regexp_replace(v, pattern, form)
        out = F.when(v.rlike(pattern), hit) if out is None else out.when(v.rlike(pattern), hit)
    return out


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value in the expression once, however often then uses it. Chained projections don't do: a
    filter on the result is pushed through them and multiplies the expression."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _fields(part: Column, home_zone: Column, default_zone: str) -> Column:
    """The canonical fields as numbers; zone stays text."""
    at = lambda i: F.nullif(F.get(part, F.lit(i)), F.lit(""))
    frac = lambda c: F.coalesce(F.rpad(c, 6, "0").try_cast("long"), F.lit(0))
    whole = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))
    month = F.coalesce(at(1).try_cast("int"), F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(at(1))).cast("int"), F.lit(0)))
    date = F.try_to_date(F.concat_ws("-", F.lpad(at(0), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(at(2), 2, "0")), "yyyy-MM-dd")
    return F.struct(
        F.when(at(0) == "E", at(1).try_cast("long") * 1_000_000 + frac(at(2))).alias("epoch"), F.unix_date(date).cast("long").alias("day"),
        whole(at(3)).alias("h"), whole(at(4)).alias("m"), whole(at(5)).alias("s"), frac(at(6)).alias("us"), F.lower(at(7)).alias("half"), F.upper(at(8)).alias("zone"),
        F.when(home_zone.isin(*sorted(available_timezones())), home_zone).otherwise(F.lit(default_zone)).alias("home"),
    )


def _instant(f: Column) -> Column:
    half, hour, zone = f["half"], f["h"], f["zone"]
    hour24 = F.when(half.isNull(), F.when(hour <= 23, hour)).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    clock = F.when((f["m"] <= 59) & (f["s"] <= 59), hour24 * 3600 + f["m"] * 60 + f["s"])
    local = f["day"] * 86_400_000_000 + clock.cast("long") * 1_000_000 + f["us"]
    digits = F.regexp_replace(zone, "[^0-9]", "")
    off_h, off_m = F.substring(digits, 1, 2).try_cast("int"), F.coalesce(F.nullif(F.substring(digits, 3, 2), F.lit("")).try_cast("int"), F.lit(0))
    lookup = lambda m: F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), zone)
    written = F.when((off_h <= 18) & (off_m <= 59), F.when(zone.startswith("-"), -1).otherwise(1) * (off_h * 60 + off_m))
    offset = F.when(zone.rlike(r"^[+-]"), written).otherwise(lookup(FIXED_OFFSETS))
    place = F.when(zone.isNull(), f["home"]).otherwise(lookup(WALL_CLOCKS))

    def settle(g: Column) -> Column:
        zoned = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(g["local"]), g["place"]))
        return F.when(g["place"].isNotNull(), zoned).otherwise(g["local"] - g["offset"].cast("long") * 60_000_000)

    return F.coalesce(f["epoch"], _let(F.struct(local.alias("local"), offset.alias("offset"), place.alias("place")), settle))


def with_utc_micros(df: DataFrame, text: str, home_zone: str, to: str, default_zone: str = "UTC") -> DataFrame:
    """Adds column ``to``: microseconds since 1970 UTC of the date string in column ``text``, cut to what
    is written; null if it denotes nothing (null, empty, words, impossible dates, unlisted abbreviations).

    Column home_zone is the zone of strings without one; where it is null or no known zone, default_zone. A
    bare date is its local midnight. Other columns stay as they are.
    """
    home = F.col(home_zone)
    return df.withColumn(to, _let(F.split(canonical(F.col(text)), r"\|", -1), lambda p: _let(_fields(p, home, default_zone), _instant)))
