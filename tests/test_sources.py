import datetime as dt
import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tarnlight.operators import providers as P
from tarnlight.sources import files as S
from tarnlight.sources import sinks as K
from tarnlight.sources import sheets as H

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def docx(paragraphs):
    body = "".join(f'<w:p><w:r><w:t>{p}</w:t></w:r></w:p>' for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def letter(i):
    return chr(65 + i) if i < 26 else letter(i // 26 - 1) + letter(i % 26)


def xlsx(sheets):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = list(sheets)
        z.writestr("xl/workbook.xml", f"<workbook {NS}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i + 1}" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names))) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><numFmts><numFmt numFmtId="170" formatCode="mmm\\-yy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        for i, n in enumerate(names):
            rows = []
            for r, row in enumerate(sheets[n]):
                cells = []
                for c, v in enumerate(row):
                    ref = f"{letter(c)}{r + 1}"
                    if isinstance(v, dt.date):
                        cells.append(f'<c r="{ref}" s="1"><v>{(v - dt.date(1899, 12, 30)).days}</v></c>')
                    elif isinstance(v, (int, float)):
                        cells.append(f'<c r="{ref}"><v>{v}</v></c>')
                    elif v is not None:
                        cells.append(f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>')
                rows.append(f'<row r="{r + 1}">{"".join(cells)}</row>')
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f"<worksheet {NS}><sheetData>{''.join(rows)}</sheetData></worksheet>")
    return out.getvalue()


def pdf(pages):
    out = b"%PDF-1.4\n"
    for i, p in enumerate(pages):
        data = b"BT /F1 12 Tf (" + p.encode() + b") Tj ET"
        if i % 2:
            data = zlib.compress(data)
        out += b"1 0 obj << >> stream\n" + data + b"\nendstream endobj\n"
    return out


def test_office_files():
    assert S.docx_text(docx(["One", " ", "Two"])) == "One\nTwo"
    assert S.pdf_text(pdf(["First page", r"Second \(page\)"])) == "First page\n\nSecond (page)"
    grid = S.xlsx_sheets(xlsx({"A": [["x", 1.5, None, dt.date(2026, 6, 30)], [], [None, 2]]}))["A"]
    assert grid == [["x", 1.5, None, dt.date(2026, 6, 30)][: len(grid[0])], [], [None, 2.0]]
    assert S.xlsx_text(xlsx({"A": [["x", 1.5]], "B": []})) == "## Sheet: A\nx\t1.5\n"
    with pytest.raises(ValueError):
        S.file_text("a.exe", b"")


def test_inbox_gives_each_reject_its_reason(spark, tmp_path):
    def put(path, raw=b"body"):
        p = tmp_path / "inbox" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(raw)

    put("news/s1/2024-05-06_good title.txt", "Ünï text".encode())
    put("news/s1/2024-05-07_note.docx", docx(["para"]))
    put("news/s1/2024-13-07_bad.txt")
    put("news/nobody/2024-05-06_x.txt")
    put("social/s1/2024-05-06_x.txt")
    put("loose.txt")
    put("news/s1/2024-05-06_x.exe")
    put("news/s1/2024-05-06_broken.docx", b"no zip")
    sources = spark.createDataFrame([("s1", "news")], "source_id string, source_bucket string")
    root = str(tmp_path / "inbox")
    got = {r.path.split("/inbox/")[1]: r for r in S.inbox(S.read_files(spark, root), sources, root).collect()}
    reasons = {k: r.reject for k, r in got.items()}
    assert reasons == {"news/s1/2024-05-06_good title.txt": None, "news/s1/2024-05-07_note.docx": None, "news/s1/2024-13-07_bad.txt": "date", "news/nobody/2024-05-06_x.txt": "source", "social/s1/2024-05-06_x.txt": "bucket", "loose.txt": "layout", "news/s1/2024-05-06_x.exe": "type", "news/s1/2024-05-06_broken.docx": "read"}
    good = got["news/s1/2024-05-06_good title.txt"]
    assert (good.text, good.title, good.published_on) == ("Ünï text", "good title", dt.date(2024, 5, 6))


def test_price_and_manifest_tables(spark, tmp_path):
    (tmp_path / "p.csv").write_text("﻿price_time,symbol,asset_type,open,high,low,close,volume\n2026-04-15,WTI,commodity,79.1,,78.9,79.4,1000\n", encoding="utf-8")
    r = S.price_csv(spark, str(tmp_path / "p.csv")).collect()[0]
    assert (r.price_time, r.symbol, r.high, r.close) == (dt.date(2026, 4, 15), "WTI", None, 79.4)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello")
    (tmp_path / "m.csv").write_text("file_path,source_id,quality_tier,rumor_flag,title\nin/a.txt,s,2,TRUE,T\nin/none.txt,s,x,false,U\n")
    got = {r.title: r for r in S.manifest_csv(spark, str(tmp_path / "m.csv"), S.read_files(spark, str(tmp_path / "in"))).collect()}
    assert got["T"].text == "hello" and got["T"].rumor_flag and got["U"].text is None and got["U"].quality_tier is None
    (tmp_path / "r.yaml").write_text("sources:\n- {source_id: a, tier: 1}\n- {source_id: b}\n")
    assert {r.source_id: r.tier for r in S.registry_yaml(spark, str(tmp_path / "r.yaml")).collect()} == {"a": "1", "b": None}


def test_listing_links(spark):
    html = '<a href="/news/2024-01-02-x">A headline of some length</a><a href="/other/y">Another headline here</a><a href="/news/z">A <b>second</b> headline, dated 2024-03-04</a><a href="/news/2024-01-02-x">A headline of some length</a>'
    got = [(r.url, r.title, str(r.dated)) for r in S.listing_links(spark.createDataFrame([(html,)], "html string"), "html", "/news/").collect()]
    assert got == [("/news/z", "A second headline, dated 2024-03-04", "2024-03-04"), ("/news/2024-01-02-x", "A headline of some length", "2024-01-02")]


def test_broker_sheets(spark, tmp_path):
    sc = [["Flat Price", "Brent", "Odd", "WTI"], [dt.date(2026, 6, 30), 80.12345, 1, 75], ["3Q26", 81, 1, "n/a"], ["Arb-Cracks", "WTI-Brent"], [dt.date(2026, 6, 30), -4.5]]
    pvm = [[]] * 5 + [[None, None, "WTI swap", "wti/brent"], ["JUN'26", 0, 75.5, -4.5], ["note"], ["JUL'26", 0, 75.0, None]]
    mitsui = [["x"], [dt.date(2026, 7, 31), 74.0, 0, 79.0], ["Q4-26", 73.0], ["2027", None, 0, 77.0], ["Q9-26", 1]]
    for name, sheet, grid in (("2026-06-16_SC_Price_Indication.xlsx", "Price Indication", sc), ("2026-06-16_PVMpricesheet.xlsx", "Sheet1", pvm), ("2026-06-16_mitsui_asia_prices.xlsx", "Indications", mitsui)):
        (tmp_path / name).write_bytes(xlsx({sheet: grid}))
    (tmp_path / "2026-06-16_pvmpricesheet_broken.xlsx").write_bytes(b"no")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {(r.source, r.spread, r.tenor, r.contract): r.value for r in H.sheet_quotes(files).collect()}
    assert got == {("SC", "Brent", "M1", "Jun-26"): 80.1235, ("SC", "WTI", "M1", "Jun-26"): 75.0, ("SC", "Brent", "3Q26", "3Q26"): 81.0, ("SC", "WTI-Brent", "M1", "Jun-26"): -4.5, ("PVM", "WTI", "M1", "JUN'26"): 75.5, ("PVM", "WTI-Brent", "M1", "JUN'26"): -4.5, ("PVM", "WTI", "M2", "JUL'26"): 75.0, ("MITSUI", "WTI", "M1", "Jul-26"): 74.0, ("MITSUI", "Brent", "M1", "Jul-26"): 79.0, ("MITSUI", "WTI", "Q4-26", "Q4-26"): 73.0, ("MITSUI", "Brent", "2027", "2027"): 77.0}


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (None, "e")], "k int, v string")
    assert {tuple(r) for r in K.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d"), (None, "e")}
    assert {r.v for r in K.absent(new, old, ["k"]).collect()} == {"d", "e"}
    path = str(tmp_path / "t")
    K.overwrite_partitions(old, path, ["k"])
    K.overwrite_partitions(new.where("k = 2"), path, ["k"])
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}
    K.append_csv(old, str(tmp_path / "h"))
    K.append_csv(old, str(tmp_path / "h"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "h")).count() == 4
    K.write_json(old, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    r = K.report_lines(old, F.concat(F.lit("- "), F.col("v")), [-F.col("k")], "Digest").collect()[0][0]
    assert r == "# Digest\n\n- b\n- a"


def test_providers(spark):
    def broken(texts):
        raise RuntimeError("offline")

    def odd(texts):
        return ["no json", '{"topic": "t"}', '{"topic": "t", "direction": "bullish", "credibility": 2, "novelty": 0.5}', 'x {"topic": "t", "direction": "bullish", "credibility": 0.2, "novelty": 0.5} y'][: len(texts)]

    c = spark.createDataFrame([(f"chk_a_{i:04d}", "doc_a", "the tight market and its stocks " * 4) for i in range(4)], "chunk_id string, document_id string, text string").coalesce(1)
    e = P.reply_events(P.extract(c, P.stub)).orderBy("event_id").collect()
    assert [x.event_id for x in e] == [f"evt_doc_a_{i:04d}_inventory_draw" for i in range(4)] and e[0].direction == "bullish"
    assert {r.reply_error for r in P.extract(c, broken).collect()} == {"no object"}
    assert sorted(str(r.reply_error) for r in P.extract(c, odd).collect()) == ["None", "missing field", "no object", "out of bounds"]
    done = c.limit(1).select("chunk_id")
    assert P.adjudicate(c.withColumnRenamed("text", "evidence_text"), P.stub, done, 2).count() == 2


def test_jdbc_copy(spark):
    url, driver = "jdbc:derby:memory:tl;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    K.copy_jdbc(df, url, "copied", driver=driver)
    got = spark.read.format("jdbc").options(url=url, dbtable="copied", driver=driver).load()
    assert {tuple(r) for r in got.collect()} == {(1, "a"), (2, None)}
