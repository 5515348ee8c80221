import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnlight.llm import splitting as S


def check(text, limit, lap):
    got = S.cut_points(text, limit, lap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (s, e, _), nxt in zip(got, got[1:] + [None]):
        assert (s < e or not text) and S.token_estimate(e - s) <= limit
        if nxt:
            assert lap * 4 <= e - nxt[0] <= lap * 4 + 3 and nxt[1] > e
    return got


def greedy(text, limit, lap):
    """The same cuts, one after the other, from the definition."""
    room, kinds = limit * 4 + 3, [sorted({m.end() for m in p.finditer(text)} - {0, len(text)}) for _, p in S._KINDS]
    words, out, start, cut = sorted({0, len(text)} | set(kinds[2])), [], 0, 0
    while start + room < len(text):
        end = None
        for low in (max(start + room // 2, cut), cut):
            for at in kinds:
                ok = [x for x in at if low < x <= start + room]
                if end is None and ok:
                    end = ok[-1]
        if end is None:
            return None  # hard cuts go by the grid of the stretch
        out.append((start, end))
        cut = end
        start = end - lap * 4
        w = max(x for x in words if x <= start)
        start = w if lap and start - w <= 3 and w > 0 else start
    return out + [(start, len(text))]


@given(st.text(alphabet="ab .\n。", max_size=600), st.integers(6, 40))
@settings(max_examples=150, deadline=None)
def test_properties_and_greedy(text, limit):
    lap = limit // 4
    got = check(text, limit, lap)
    want = greedy(text, limit, lap)
    if want is not None:
        assert [(s, e) for s, e, _ in got] == want


@pytest.mark.parametrize("text", ["x" * 10_000, "x" * 1803, "x" * 1804, "字" * 5000, ("word " * 3000), "A sentence here. " * 500, "p\n\n" * 3000, "\n" * 4000, "y" * 2500 + " tail " * 400])
def test_limits_overlaps_and_hard_cuts(text):
    got = check(text, 450, 60)
    assert (len(got) == 1) == (len(text) <= 1803)


def test_prefers_paragraph_then_sentence_then_word():
    para = ("Alpha beta gamma. " * 60).strip()
    kinds = [k for *_, k in S.cut_points("\n\n".join([para] * 5), 450, 60)]
    assert set(kinds[:-1]) == {S.PARAGRAPH}
    assert set(k for *_, k in S.cut_points("Alpha beta gamma. " * 400, 450, 60)[:-1]) == {S.SENTENCE}
    assert set(k for *_, k in S.cut_points("alpha beta gamma " * 400, 450, 60)[:-1]) == {S.WORD}


def test_many_cuts_need_few_squarings():
    text = "".join(random.Random(1).choice(["word ", "end. ", "\n"]) for _ in range(200_000))
    assert len(check(text, 450, 60)) > 400


def test_operator(spark):
    long = "A word, " * 1000
    rows = [("a", long, 9, "x"), ("a", long, 9, "y"), ("b", "short", 9999, ""), ("c", None, None, ""), ("d", "", 1, ""), (None, long, 1, "")]
    df = spark.createDataFrame(rows, "chunk_id string, text string, token_estimate int, piece string")
    got = S.split_oversized(df, 450, 60).orderBy("chunk_id", "piece_no").collect()
    assert {r.chunk_id for r in got} == {"a", None} and [r.piece_no for r in got if r.chunk_id] == list(range(got[-1].n_pieces))
    rebuilt = ""
    for r in (r for r in got if r.chunk_id):
        rebuilt += r.piece[len(rebuilt) - r.start :]
    assert rebuilt == long
    assert S.split_oversized(df.limit(0), 450, 60).count() == 0
    with pytest.raises(ValueError):
        S.cut_points("x" * 100, 5, 5)
