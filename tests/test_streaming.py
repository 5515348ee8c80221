import random

from tarnlight.streaming import incremental as I


def test_files_are_ingested_once(spark, tmp_path):
    inbox, store, ck = (str(tmp_path / x) for x in ("in", "store", "ck"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one")
    (tmp_path / "in" / "b.txt").write_text("one")
    I.ingest_files(spark, inbox, store, ck)
    assert [r.text for r in spark.read.parquet(store).collect()] == ["one"]
    (tmp_path / "in" / "c.txt").write_text("one")
    (tmp_path / "in" / "d.txt").write_text("two")
    (tmp_path / "in" / "e.exe").write_text("bad")
    for _ in range(2):
        I.ingest_files(spark, inbox, store, ck)
    assert sorted(r.text for r in spark.read.parquet(store).collect()) == ["one", "two"]


def test_new_rows_are_processed_once(spark, tmp_path):
    src, store, ck = (str(tmp_path / x) for x in ("src", "store", "ck"))
    df = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "id int, t string")
    df.write.parquet(src)
    go = lambda: I.process_new(spark.readStream.schema(df.schema).parquet(src), store, ck, lambda b: b.selectExpr("id", "upper(t) AS u"), ["id"])
    go()
    df.union(spark.createDataFrame([(9, "z")], df.schema)).write.mode("append").parquet(src)
    go()
    assert sorted((r.id, r.u) for r in spark.read.parquet(store).collect()) == [(i, f"T{i}") for i in range(5)] + [(9, "Z")]


def test_bundles_equal_batch(spark, tmp_path):
    rows = [(f"p{i}", "s", f"2024-01-{1 + i % 3:02d} {i:02d}:00:00") for i in range(12)] + [("p1", "s", "2024-01-02 01:00:00"), ("end", "s", "2024-03-01 00:00:00")]
    df = spark.createDataFrame(rows, "post_id string, source_id string, created_at string").selectExpr("post_id", "source_id", "CAST(created_at AS TIMESTAMP) AS created_at")
    df.coalesce(1).write.parquet(str(tmp_path / "src"))
    stream = I.daily_bundles(spark.readStream.schema(df.schema).parquet(str(tmp_path / "src")))
    I.drain(stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "ck"))
    got = {(r.window.start, r.posts, r.bundle) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.window.start, r.posts, r.bundle) for r in I.daily_bundles(df).collect() if "end" not in r.bundle}
    assert got == want and len(got) == 3


def test_ledger_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(s, f"2024-01-{d:02d}", rnd.choice(["LONG", "SHORT", "FLAT"])) for s in "ab" for d in range(1, 29)]
    df = spark.createDataFrame(rows, "symbol string, d string, signal string")
    src = str(tmp_path / "src")
    read = lambda: I.ledger(spark.readStream.schema(df.schema).parquet(src))
    for part in (df.where("d < '2024-01-15'"), df.where("d >= '2024-01-10'")):  # some days come twice
        part.coalesce(1).write.mode("append").parquet(src)
        I.drain(read().writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "ck"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in I.ledger_batch(df).collect()} and len(got) > 20


def test_late_rows_touch_their_shadow(spark):
    df = spark.sql("SELECT DATE '2024-01-01' AS d UNION ALL SELECT DATE '2024-01-02'")
    assert I.touched_days(df, "d").count() == 22
