"""Plain reading of the date notations, by strptime and zoneinfo, to hold the operator against."""

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

UTC = timezone.utc
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
ABBR = {"UTC": 0, "GMT": 0, "Z": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "BST": 1, "CET": 1, "CEST": 2, "GST": 4, "SGT": 8, "JST": 9, "北京时间": 8}
FORMATS = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%Y/%m/%d %H:%M", "%Y%m%dT%H%M%S", "%d.%m.%Y %H:%M", "%m/%d/%Y %I:%M %p", "%d %b %Y, %H.%M", "%d %B %Y, %H.%M", "%d %b %Y %H:%M:%S", "%d %B %Y %H:%M:%S", "%b %d, %Y %I:%M %p", "%B %d, %Y %I:%M %p", "%Y年%m月%d日 %H:%M", "%a, %d %b %Y %H:%M:%S", "%a, %d %B %Y %H:%M:%S"]


def brute_micros(s, home):
    if s is None:
        return None
    s = s.strip()
    if re.fullmatch(r"\d{13}", s):
        return int(s) * 1000
    if re.fullmatch(r"\d{10}(\.\d+)?", s):
        whole, _, frac = s.partition(".")
        return int(whole) * 10**6 + int((frac + "000000")[:6])
    off = wall = None
    if m := re.search(r"(?<=\d)\s*([+-])(\d\d):?(\d\d)?$", s):
        if re.search(r":\d\d", s) or "T" in s:
            off, s = (1 if m[1] == "+" else -1) * (int(m[2]) * 60 + int(m[3] or 0)), s[: m.start()]
    if off is None:
        for a in sorted(ABBR, key=len, reverse=True):
            if s.endswith(a) and s[: -len(a)].strip()[-1:].isdigit():
                off, s = ABBR[a] * 60, s[: -len(a)].strip()
                break
        else:
            if s.endswith(" ET"):
                wall, s = "America/New_York", s[:-3]
    us = 0
    if m := re.search(r"(:\d\d)\.(\d+)$", s):
        us, s = int((m[2] + "000000")[:6]), s[: m.start(2) - 1]
    for f in FORMATS:
        try:
            d = datetime.strptime(s, f)
            break
        except ValueError:
            continue
    else:
        return None
    if off is not None:
        u = d.replace(tzinfo=UTC) - timedelta(minutes=off)
    else:
        u = d.replace(tzinfo=ZoneInfo(wall or home), fold=0).astimezone(UTC)
    return (u - EPOCH) // timedelta(seconds=1) * 10**6 + us
