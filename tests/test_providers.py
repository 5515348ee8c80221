import pytest

from tarnlight.operators import providers as P

CHUNK = "chunk_id string, document_id string, text string"


def half_broken():
    """A provider by value, as the workers can't import this file."""
    return lambda texts: ["no object here" if "bad" in (t or "") else P.stub([t])[0] for t in texts]


def rules(chunks):
    return chunks.selectExpr("concat('rule_', chunk_id) as event_id", "document_id", "chunk_id", "'ruled' as topic")


@pytest.mark.parametrize("mode, want", [("rule", {"a": "ruled", "b": "ruled", "c": "ruled"}), ("llm", {"a": "inventory_draw"}), ("auto", {"a": "inventory_draw", "b": "ruled"})])
def test_modes_and_fallback(spark, mode, want):
    rows = [("a", "d", "stocks tight " * 10), ("b", "d", "bad stocks " * 10), ("c", "d", "short")]
    got = P.extract_events(spark.createDataFrame(rows, CHUNK), rules, half_broken(), mode).collect()
    assert {r.chunk_id: r.topic for r in got} == want and len(got) == len(want)


def test_without_a_provider(spark):
    df = spark.createDataFrame([("a", "d", None)], CHUNK)
    assert [r.topic for r in P.extract_events(df, rules).collect()] == ["ruled"]
    for bad in ({"mode": "llm"}, {"mode": "other"}):
        with pytest.raises(ValueError):
            P.extract_events(df, rules, **bad)
    assert P.extract_events(df.limit(0), rules, half_broken()).count() == 0
