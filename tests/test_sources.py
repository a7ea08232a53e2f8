import json

import pytest
from pyspark.sql import functions as F

from rulewake.sources import files, sinks
from rulewake.streaming import jobs


def test_messy_csv(spark, tmp_path):
    (tmp_path / "ENV_2015_full.csv").write_text('Document ID,Comment,Posted Date,Comment on Document ID\nd1,"line one\nline ""two""",2015-01-02,x1\nd2,see attached,not a date,\nd3\n', encoding="utf-8")
    listed = files.listed(spark, str(tmp_path)).first()
    assert (listed.agency, listed.year, listed.name) == ("ENV", 2015, "ENV_2015_full.csv")
    raw = files.csv(spark, str(tmp_path / "ENV_2015_full.csv"))
    q = files.csv_quality(raw).first()
    assert q.n_records == 3 and q.n_broken == 1
    schema = files.union_schema([["Document ID", "Comment"], ["Posted Date", "Comment on Document ID", "Title"]])
    rows = {r.document_id: r for r in files.ingested(raw.filter(F.col(files.BROKEN).isNull()), schema, F.lit("ENV"), F.lit(2015)).collect()}
    assert rows["d1"].comment == 'line one\nline "two"' and rows["d1"].row_kind == "comment" and rows["d1"].posted_date.year == 2015
    assert rows["d2"].is_attachment_only and rows["d2"].posted_date is None and rows["d2"].row_kind == "document" and rows["d2"].title is None


def test_encoding():
    assert files.encoding_of("é".encode()) == "utf-8" and files.encoding_of("é".encode("latin-1") + b" abcd") == "latin-1" and files.encoding_of("é".encode()[:1]) == "utf-8"


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"plain \xe9 text")
    (tmp_path / "b.html").write_text("<html><body><p>Hi&amp;</p></body></html>")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "d.pdf").write_bytes(b"%PDF bad")
    empty = spark.createDataFrame([("x/e.bin", bytearray())], "path string, content binary")  # Spark's reader skips empty files
    df = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content").unionByName(empty)

    def pdf(content):
        if b"bad" in content:
            raise ValueError("broken")
        return "from pdf"

    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.text, r.status) for r in files.extracted(df, {"pdf": pdf}).collect()}
    assert got["a.txt"] == ("text", "plain é text", "ok") and got["b.html"][1] == "Hi&" and got["c.pdf"][1:] == ("from pdf", "ok") and got["d.pdf"][2] == "failed" and got["e.bin"][2] == "empty"


def test_pages_requests_attachments(spark):
    pages = spark.createDataFrame([(1, 2, bytearray(b"two")), (1, 1, bytearray(b"one")), (1, 3, bytearray(b"\xff"))], "doc_id int, page int, image binary")
    r = files.recognised(pages, lambda b: b.decode()).first()
    assert r.text == "one\n\ntwo" and r.n_failed == 1
    got = {x.url: x.status for x in files.fetched(spark.createDataFrame([("a",), ("gone",), ("err",)], "url string"), lambda u: {"a": "body", "gone": None}[u]).collect()}
    assert got == {"a": "ok", "gone": "missing", "err": "failed"}
    body = json.dumps({"included": [{"id": "x", "attributes": {"title": "t", "fileFormats": [{"fileUrl": "http://u/1.pdf", "format": "pdf", "size": 3}, {"fileUrl": "http://u/1.doc", "format": "doc", "size": 4}]}}]})
    rows = files.attachments(spark.createDataFrame([("d", body), ("e", "{}")], "document_id string, body string")).collect()
    assert len(rows) == 3 and sum(r.url is None for r in rows) == 1
    url, status = files.chosen_url(F.col("u"))
    d = spark.createDataFrame([("http://x/a.doc, http://x/b.PDF",), ("ftp://x",), (None,)], "u string").select(url.alias("url"), status.alias("s")).collect()
    assert [(r.url, r.s) for r in d] == [("http://x/b.PDF", "ok"), (None, "no_http"), (None, "no_urls")]
    source, recovered = files.text_source(F.col("a"), F.col("e"), F.col("o"), F.col("v"))
    t = spark.createDataFrame([(False, None, None, None), (True, " ", "ocr", None), (True, None, None, "")], "a boolean, e string, o string, v string").select(source.alias("s"), recovered.alias("r")).collect()
    assert [(r.s, r.r) for r in t] == [("inform", None), ("attachment_pytesseract", "ocr"), ("attachment_failed", None)]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    assert sinks.append_new(df, path, ["k"]) == 2 and sinks.append_new(df, path, ["k"]) == 0 and spark.read.parquet(path).count() == 2
    sinks.table(df, str(tmp_path / "p"), ["v"])
    assert spark.read.parquet(str(tmp_path / "p")).filter("v = 'b'").count() == 2
    sinks.csv(df, str(tmp_path / "c"), compressed=True)
    assert files.csv(spark, str(tmp_path / "c")).count() == 3
    assert "| 1 | a |" in sinks.markdown(df) and sinks.release(df, ["v"]).count() == 2
    index = spark.createDataFrame([("d", "missing"), ("e", "ok")], "k string, s string")
    found = spark.createDataFrame([("d", "found"), ("e", "other")], "k string, s string")
    assert {(r.k, r.s) for r in sinks.recovered(index, found, ["k"], F.col("s") == "missing").collect()} == {("d", "found"), ("e", "ok")}
    assert files.schema_from_json(files.schema_to_json(df.schema)) == df.schema


def test_truncated_pairs_are_found_once(spark):
    m = spark.createDataFrame([("c1", "D__final__1_0", True), ("c2", "D__final__2_0", False), ("c3", "D__proposed__1_0", True)], "comment_id string, obligation_id string, uncertainty_truncated boolean")
    again = sinks.truncated_pairs(m)
    assert {(r.comment_id, r.rule_type) for r in again.collect()} == {("c1", "final"), ("c3", "proposed")}
    rerun = m.filter("uncertainty_truncated")
    assert sinks.truncated_pairs(sinks.merged(m, rerun, ["comment_id", "obligation_id"], 5000)).count() == 0


def test_labelling_stream_is_exactly_once(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, p string").write.parquet(source)
    read = lambda: spark.readStream.schema("k int, p string").parquet(source)
    jobs.labelling(read(), "p", lambda ps: [p.upper() for p in ps], out, state, ["k"]).awaitTermination(120)
    spark.createDataFrame([(2, "b"), (3, "c")], "k int, p string").write.mode("append").parquet(source)
    jobs.labelling(read(), "p", lambda ps: [p.upper() for p in ps], out, state, ["k"]).awaitTermination(120)
    assert sorted((r.k, r.answer) for r in spark.read.parquet(out).collect()) == [(1, "A"), (2, "B"), (3, "C")]


def test_window_counts_and_new_contents(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a", t), (1, "a", t + dt.timedelta(hours=1)), (1, "b", t + dt.timedelta(hours=2)), (2, "a", t)], "k int, x string, at timestamp").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("k int, x string, at timestamp").parquet(source)
    q = jobs.new_contents(stream, "k", "x", "at").writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("fresh").count() == 3
    q = jobs.counted(stream, "k", "at").writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.k, r.n) for r in spark.table("windows").collect()} == {(1, 3), (2, 1)}


def test_checkpoint_folder(spark):
    from rulewake.session import checkpoint, shared_dir

    assert shared_dir(spark)
    assert checkpoint(spark.range(5)).count() == 5


def test_stored_tables_can_be_forgotten(spark):
    from rulewake import session

    session.forget(spark)
    assert session.stored(spark.range(3), "x").count() == 3 and session.stored(spark.range(0), "y").count() == 0
    assert session.forget(spark) == 2 and session.forget(spark) == 0


@pytest.mark.parametrize("columns", [["k"], ["k", "zz"]])
def test_projected_tables(spark, tmp_path, columns):
    spark.createDataFrame([(1, "a")], "k int, v string").write.parquet(str(tmp_path / "x"))
    assert files.tables(spark, str(tmp_path / "x"), columns).columns == ["k"]


def test_kinds_by_first_bytes(spark):
    rows = [("a.docx", b"PK\x03\x04..word/document.xml"), ("b", b"PK\x03\x04..xl/workbook.xml"), ("c.zip", b"PK\x03\x04.."), ("d.doc", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"), ("e.pdf", b"%PDF-1.4"), ("f", b"  <HTML><p>"), ("g", "é".encode()), ("h", b"\xff\x00\x01\x00"), ("i", b"")]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {r.path: r.k for r in df.select("path", files.kind_of(F.col("content"), F.col("path")).alias("k")).collect()}
    assert got == {"a.docx": "docx", "b": "xlsx", "c.zip": "zip", "d.doc": "doc", "e.pdf": "pdf", "f": "html", "g": "text", "h": "unknown", "i": "unknown"}
