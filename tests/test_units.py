import random

from tarnlight.operators.units import resolve_units, unit_of

COLS = "quote_id long, obs_date string, category string, spread string, tenor string, value double, unit string, quote_text string, extra string"
FACTORS = [("WTI", "crude_outright", 7.6, 6.2898, 42.0), ("WTI-Brent", "crude_diff", 7.56, 6.2898, 42.0)]
TO_USD = {"USD/BBL": 1.0, "USC/BBL": 0.01, "USD/MT": 1 / 7.6, "USC/GAL": 0.42, "USD/GAL": 42.0, "USD/M3": 1 / 6.2898}
NAMES = {"USD/BBL": "$/bbl", "USC/BBL": "US cents per barrel", "USD/MT": "usd pmt", "USC/GAL": "cpg", "USD/GAL": "USD/USG", "USD/M3": "$/cbm"}


def run(spark, rows):
    f = spark.createDataFrame(FACTORS, "spread string, category string, bbl_per_mt double, bbl_per_m3 double, gal_per_bbl double")
    return {r.quote_id: r for r in resolve_units(spark.createDataFrame(rows, COLS), f).collect()}


def trusted(n=20, spread="WTI", cat="crude_outright", level=75.0):
    rnd = random.Random(1)
    return [(i, "2025-01-02", cat, spread, "M1", level * rnd.uniform(0.98, 1.02), "$/bbl", None, "x") for i in range(n)]


def test_every_unit_by_size_label_or_text(spark):
    rows, want = trusted(), {}
    for k, u in enumerate(TO_USD):
        v = 76.0 / TO_USD[u]
        for j, (unit, text) in enumerate([(NAMES[u], None), ("see text", f"WTI Jan-25 mid {v:.2f} {NAMES[u]}, no size"), ("$/bbl", f"WTI/Jan-25 last {v:.2f} in {NAMES[u]}"), ("$/bbl", None), (None, None)]):
            i = 100 + 10 * k + j
            rows.append((i, "2025-01-02", "crude_outright", "WTI", "M2", v, unit, text, None))
            want[i] = u
    got = run(spark, rows)
    for i, u in want.items():
        if i % 10 == 4 and u in ("USD/MT", "USD/M3"):
            assert got[i].unit_code not in ("USD/MT", "USD/M3")
        else:
            assert got[i].unit_code == u, (i, u, got[i])
            assert abs(got[i].usd_per_bbl - 76) < 0.01


def test_differentials_trust_their_label(spark):
    rows = trusted(20, "WTI-Brent", "crude_diff", -3.9) + [
        (100, "2025-01-02", "crude_diff", "WTI-Brent", "M1", -0.4, "c/bbl", None, None), (101, "2025-01-02", "crude_diff", "WTI-Brent", "M1", -390.0, None, None, None),
        (102, "2025-01-02", "crude_diff", "WTI-Brent", "M1", -390.0, "$/bbl", "WTI-Brent Jan-25: -390 (cts/bbl)", None), (103, "2025-01-02", "crude_diff", "WTI-Brent", "M1", -3.7, None, None, None),
    ]
    got = run(spark, rows)
    assert [got[i].unit_code for i in (100, 101, 102, 103)] == ["USC/BBL", "USC/BBL", "USC/BBL", "USD/BBL"]


def test_nulls_ties_repeats_and_unknown_series(spark):
    rows = trusted(6) + [(50, "2025-01-02", "crude_outright", "WTI", "M1", None, "$/bbl", None, None), (51, None, None, "Unheard", None, 5.0, None, None, None), (52, "2025-01-02", "crude_outright", "WTI", None, 0.0, "$/bbl", None, None), (53, "2025-01-02", "crude_outright", "WTI", "M1", float("nan"), None, None, None)]
    got = run(spark, rows + [rows[0]])
    assert got[50].unit_code is None and got[53].unit_code is None and got[51].unit_code == "USD/BBL" and got[52].unit_code == "USD/BBL"
    assert run(spark, []) == {}


def test_spellings(spark):
    words = {"$ / BBL": "USD/BBL", "US$/b": "USD/BBL", "dlrs/bbl": "USD/BBL", "usd per barrel": "USD/BBL", "¢/bbl": "USC/BBL", "cts/bbl": "USC/BBL", "C/BBL": "USC/BBL", "US¢/gal": "USC/GAL", "cents/gallon": "USC/GAL", "c/gal": "USC/GAL", "$/gal": "USD/GAL", "usd per gallon": "USD/GAL", "USD/m³": "USD/M3", "usd per cubic metre": "USD/M3", "$/m3": "USD/M3", "$ per metric ton": "USD/MT", "USD/t": "USD/MT", "$/tonne": "USD/MT", "usd pmt": "USD/MT", "-": None, "see text": None, "": None, "Sing 380cst/Jun-26": None}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    from pyspark.sql import functions as F

    assert {r.w: r.u for r in df.select("w", unit_of(F.col("w")).alias("u")).collect()} == words
