import datetime as dt
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnlight.functions import dates as D
from tarnlight.functions import text as X


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).collect()[0][0]


def plain_clean(t):
    t = t.replace("\r\n", "\n").replace("\r", "\n")
    t = re.sub(r"\n{3,}", "\n\n", t)
    return re.sub(r"[ \t]{2,}", " ", t).strip(" \n\t\r\x0b\x0c")


def plain_chunks(t, size, lap):
    out, start = [], 0
    while t.strip():
        piece = t[start : start + size].strip()
        if piece:
            out.append(piece)
        if start + size >= len(t):
            break
        start += size - lap
    return out


@given(st.lists(st.text(alphabet="ab \t\r\n.", max_size=80), min_size=20, max_size=20))
@settings(max_examples=4, deadline=None)
def test_clean_and_chunks_equal_plain_code(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.c for r in df.select("i", X.clean_text(F.col("text")).alias("c")).collect()}
    assert got == {i: plain_clean(t) for i, t in enumerate(texts)}
    parts = {}
    for r in X.chunks(df, "text", 20, 5).orderBy("i", "chunk_index").collect():
        parts.setdefault(r.i, []).append(r.chunk_text)
        assert r.chunk_index == len(parts[r.i]) - 1 and r.token_estimate == max(1, len(r.chunk_text) // 4)
    assert parts == {i: plain_chunks(t, 20, 5) for i, t in enumerate(texts) if plain_chunks(t, 20, 5)}


def test_chunks_of_null_empty_and_long(spark):
    rnd = random.Random(1)
    long = "".join(rnd.choice("ab c\n") for _ in range(300_000))
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (4, long)], "i int, text string")
    got = X.chunks(df).collect()
    assert {r.i for r in got} == {4} and len(got) == len(plain_chunks(long, 1800, 250))


def test_markup(spark):
    html = "<html><head><style>x{}</style></head><nav>Menu</nav><p>A &amp; B&nbsp;</p><script>var a = '<p>no</p>'</script><div> C </div><footer>f</footer>"
    assert one(spark, html, X.strip_markup) == "A & B\nC"
    assert one(spark, "", X.strip_markup) == "" and one(spark, None, X.strip_markup) is None


def test_headline_json_and_ids(spark):
    t = "Short. " + "This first sentence is long enough to pass the mark. And more; follows here."
    assert one(spark, t, X.headline) == "Short. This first sentence is long enough to pass the mark"
    assert one(spark, "x" * 400, X.headline) == "x" * 160
    assert one(spark, 'sure {"a": {"b": 3}} ok', lambda c: X.json_object(c, "a struct<b: int>")["a"]["b"]) == 3
    assert one(spark, "none", lambda c: X.json_object(c, "a int")) is None
    assert one(spark, "abc", X.content_id) == "doc_ba7816bf8f01cfea"
    assert one(spark, "A  Fancy: Title!", X.slug) == "a_fancy_title"


def test_lexicon(spark):
    lex = {"first": (("x", "y"), "bullish"), "second": (("x",), "bearish"), "third": (("zz",), "mixed")}
    df = spark.createDataFrame([(1, "X and y"), (2, "one x"), (3, "nothing"), (4, None)], "i int, text string")
    got = [(r.i, r.topic_rank, r.topic, r.hits, round(r.novelty, 2)) for r in X.topic_matches(df, lex).orderBy("i", "topic_rank").collect()]
    assert got == [(1, 0, "first", 2, 0.69), (1, 1, "second", 1, 0.57), (2, 0, "first", 1, 0.57), (2, 1, "second", 1, 0.57)]
    assert one(spark, "reopened reopen", lambda c: X.occurrences(c, ("reopen", "reopened"))) == 3
    lean = lambda u, d: one(spark, 1, lambda c: X.lean(F.lit(u), F.lit(d), F.lit("neutral")), "int")
    assert [lean(2, 1), lean(1, 2), lean(1, 1), lean(0, 0)] == ["bullish", "bearish", "mixed", "neutral"]


def test_calendar(spark):
    utc = lambda s: dt.datetime.fromisoformat(s)
    cases = {"2024-01-05T20:59:00": "2024-01-05", "2024-01-05T21:00:00": "2024-01-08", "2024-07-01T20:00:00": "2024-07-02", "2024-07-01T19:59:59": "2024-07-01", "2024-07-06T12:00:00": "2024-07-08", "2024-07-07T21:00:00": "2024-07-08"}
    for at, want in cases.items():
        assert str(one(spark, utc(at), D.score_date, "timestamp")) == want, at
    assert str(one(spark, "Jun-26", D.contract_month)) == "2026-06-01" and str(one(spark, "AUG'26", D.contract_month)) == "2026-08-01" and one(spark, "Q4-26", D.contract_month) is None
    assert str(one(spark, "Jan-26", lambda c: D.contract_expiry(D.contract_month(c)))) == "2025-11-30"
    assert one(spark, "MAR'27", lambda c: D.contract_label(D.contract_month(c))) == "Mar-27"
    assert [one(spark, s, D.release_lag) for s in ("eia_crude_stocks_1", "JODI_X", "Brent_COT_NET", "WTI", "none")] == [5, 50, 3, 0, 0]
    assert [str(one(spark, dt.date(2024, 1, d), D.previous_business_day, "date")) for d in (1, 2, 6, 7)] == ["2023-12-29", "2024-01-01", "2024-01-05", "2024-01-05"]
    assert one(spark, "M12", D.tenor_number) == 12 and one(spark, "Q3", D.tenor_number) is None
