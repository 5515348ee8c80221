import random

import pytest

from tarnlight.llm import boilerplate as B
from tarnlight.llm.repeated_lines import without_lines

PAGE = "doc_id long, source_id string, title string, raw_text string, doc string"
WORDS = "market tanker crude stocks refinery cargo brent prices traders winter output export storage demand supply margin freight analysts".split()


def sentence(rnd, n=14):
    return " ".join(rnd.choice(WORDS) for _ in range(n)).capitalize() + f" {rnd.randrange(10**6)}."


def site(rnd, doc, blank=False, article=True):
    """(lines, labels) of one page of a made-up site."""
    out = [("Accept all cookies", 0), ("Home | Markets | Contact", 0), (f"WTI {rnd.random() * 90:.2f} -1.2%  Brent {rnd.random() * 90:.2f} +0.3%", 0)]
    title = f"{rnd.choice(WORDS).capitalize()} {rnd.choice(WORDS)} hits {rnd.choice(WORDS)} near Port {rnd.randrange(999)}"
    if article:
        out += [(title, 1), ("By the Example desk", 1)]
        for i in range(rnd.randrange(2, 6)):
            if blank:
                out.append(("", None))
            out.append((" ".join(sentence(rnd) for _ in range(rnd.randrange(2, 5))), 1))
            if rnd.random() < 0.3:
                out.append((f"* Gasoil M{i} {rnd.random() * 99:.2f} +0.12 {rnd.randrange(9999)}", 1))
            if rnd.random() < 0.4:
                out.append((rnd.choice(["Share this story", "Advertisement", f"Page {i} / ex-{doc}"]), 0))
    out += [("Related stories", 0)] + [(f"{rnd.choice(WORDS).capitalize()} {rnd.choice(WORDS)} waits for Port {rnd.randrange(999)} - {rnd.randrange(9)} h ago", 0) for _ in range(3)]
    out += [("Related stories: Tanker leaves Port " + str(rnd.randrange(999)), 0), ("The views here are those of Example News and no offer or recommendation to trade any instrument whatever it may be.", 0), ("Copyright 2024 Example", 0)]
    return title, out


def test_labelled_site(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    for d in range(60):
        title, lines = site(rnd, d, blank=d % 3 == 0, article=d % 10 != 9)
        rows.append((d, "s", None if d % 7 == 0 else title, "\n".join(x + ("\r" if d % 4 == 0 else "") for x, _ in lines), "clash"))
        want |= {(d, i): lab for i, (x, lab) in enumerate(lines) if x}
    for d in range(60, 90):  # a third of all rows are copies of one page
        rows.append((d, *rows[1][1:]))
        want |= {(d, i): lab for (e, i), lab in want.items() if e == 1}
    got = {(r.doc_id, r.line_no): r.kind in B.ARTICLE for r in B.line_kinds(spark.createDataFrame(rows, PAGE)).collect()}
    assert got.keys() == want.keys()
    wrong = [k for k in want if got[k] != bool(want[k])]
    assert len(wrong) <= 0.01 * len(want), [(k, rows[k[0]][3].split("\n")[k[1]]) for k in wrong][:10]


def test_defined_results_for_odd_pages(spark):
    long = ". ".join(["a word or two"] * 200_000)
    rows = [(1, "s", None, None, ""), (2, None, None, "", ""), (3, "s", "T", " \n\r\n", ""), (4, "s", None, long, ""), (5, "s", "x", "only a menu", ""), (5, "s", "x", "only a menu", "")]
    got = [tuple(r) for r in B.line_kinds(spark.createDataFrame(rows, PAGE)).orderBy("doc_id").collect()]
    assert got == [(4, 0, B.PARAGRAPH), (5, 0, B.FURNITURE), (5, 0, B.FURNITURE)]
    assert B.line_kinds(spark.createDataFrame([], PAGE)).count() == 0


def test_hot_source_and_main_text(spark):
    rnd = random.Random(1)
    rows = []
    for d in range(400):
        title, lines = site(rnd, d)
        rows.append((d, "hot" if d % 3 else f"s{d}", title, "\n".join(x for x, _ in lines), ""))
    df = spark.createDataFrame(rows, PAGE)
    drop = B.line_kinds(df).where("kind = 'furniture'")
    text = {r.doc_id: r.raw_text for r in without_lines(df, drop).collect()}
    assert len(text) == 400 and all("Share this story" not in text[d] and rows[d][2] in text[d] for d in range(400) if d % 3)


@pytest.mark.parametrize("text", ["", "\n", "…", "a", "|" * 50, "1 2 3 4", "\u0000\n ", "x" * 100_000])
def test_kernel_never_fails(text):
    kinds = B.classify(text, {}, {}, "t")
    assert len(kinds) == len(text.split("\n"))
    assert all(len(x) == len(kinds) for x in B.line_marks(text, None))


@pytest.mark.parametrize("titles", ["same", "missing", "other"])
def test_copies_under_other_furniture(spark, titles):
    """An article sent 40 times with another strip and other teasers is no furniture, but what surrounds it is."""
    rnd = random.Random(9)
    pages = [site(rnd, d) for d in range(30)]
    title = "Tanker rates climb as cargo demand grows"
    story = [(title, 1), ("By the Example desk", 1)] + [(" ".join(sentence(rnd) for _ in range(3)), 1) for _ in range(6)]
    for d in range(30, 70):
        top, rest = site(rnd, d, article=False)[1][:3], site(rnd, d, article=False)[1][3:]
        head = {"same": title, "missing": None, "other": f"Update {d}: {title}"}[titles]
        pages.append((head, top + story + rest))
    rows = [(d, "s", t, "\n".join(x for x, _ in lines), "") for d, (t, lines) in enumerate(pages)]
    want = {(d, i): bool(lab) for d, (_, lines) in enumerate(pages) for i, (_, lab) in enumerate(lines)}
    got = {(r.doc_id, r.line_no): r.kind in B.ARTICLE for r in B.line_kinds(spark.createDataFrame(rows, PAGE)).collect()}
    assert got.keys() == want.keys()
    wrong = [k for k in want if got[k] != want[k]]
    assert len(wrong) <= 0.01 * len(want), [(k, rows[k[0]][3].split("\n")[k[1]]) for k in wrong][:10]


def test_short_notes_with_long_notices_are_no_copies(spark):
    """Pages that have only the long lines of their site in common keep them as furniture."""
    rnd = random.Random(4)
    notice = [" ".join(WORDS[i:] + WORDS[:i]).capitalize() + "." for i in range(3)]
    rows = []
    for d in range(30):
        title = f"Note {rnd.choice(WORDS)} {rnd.choice(WORDS)} to port {d}"
        rows.append((d, "s", title, "\n".join([title, sentence(rnd, 24), *notice]), ""))
    got = B.line_kinds(spark.createDataFrame(rows, PAGE)).collect()
    assert {r.line_no for r in got if r.kind == B.FURNITURE} == {2, 3, 4} and len(got) == 150


def test_density_values_decide(spark):
    """Rows change if every density above 0 is the same, so the values do the work, not only which lines have any."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("raw_text is not null")
    pages = B.flagged_pages(docs, "doc_id", "source_id", "raw_text", "title").select("t", "flags", "h").collect()
    right = [B.page_kinds(*p) for p in pages]
    value = B.composite_density
    try:
        B.composite_density = lambda *a: 1000.0 if value(*a) > 0 else 0.0
        flat = [B.page_kinds(*p) for p in pages]
    finally:
        B.composite_density = value
    assert sum(a != b for x, y in zip(right, flat) for a, b in zip(x, y)) > 100


def test_density_of_a_leaf():
    plain, half, most, all_ = (B.composite_density(200, 1, 200 * x, x, 0.3) for x in (0, 0.5, 0.9, 1))
    assert plain > half > most > all_ == 0
    assert B.composite_density(400, 1, 0, 0, 0.3) > plain > B.composite_density(200, 4, 0, 0, 0.3)
    assert B.composite_density(0, 0, 0, 0, 0) == 0


@pytest.mark.parametrize("pages", [2, 7])
def test_any_number_of_pages(spark, pages):
    """With few pages a source the same lines come out as with all of them."""
    path = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(path).where("raw_text is not null")
    few = docs.selectExpr("*", "row_number() over (partition by source_id order by doc_id) as n").where(f"n <= {pages}").drop("n").cache()
    out = lambda d: {(r.doc_id, r.line_no) for r in B.line_kinds(d).where("kind = 'furniture'").collect()}
    ids = {r.doc_id for r in few.select("doc_id").collect()}
    want, got = {x for x in out(docs) if x[0] in ids}, out(few)
    assert len(want & got) >= 0.98 * len(want) and len(want & got) >= 0.98 * len(got)


def test_documents_may_have_names(spark):
    rows = [("a", "s", "Title of it all", "Title of it all\n" + sentence(random.Random(2), 40), ""), ("b", "s", None, "Home", "")]
    got = B.line_kinds(spark.createDataFrame(rows, PAGE.replace("doc_id long", "doc_id string"))).orderBy("doc_id", "line_no").collect()
    assert [tuple(r) for r in got] == [("a", 0, B.HEADLINE), ("a", 1, B.PARAGRAPH), ("b", 0, B.FURNITURE)]
