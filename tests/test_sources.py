import datetime as dt
import hashlib
import io
import json
import shutil
import time
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from kinfold.plans import source_queries
from kinfold.sources import activity, content, listing, paged
from kinfold.streaming import sessions as stream


def test_listing(spark, tmp_path):
    records = [
        {"id": "1", "name": "a" * 240, "mimeType": "image/png", "size": "7", "fullFileExtension": "PNG", "parents": ["p"], "modifiedTime": "2016-01-01T00:00:01.5Z", "permissions": [{"emailAddress": "x@e", "role": "owner"}, {"emailAddress": "y@e", "role": "reader"}, {"role": "reader"}]},
        {"id": "1", "name": "new", "mimeType": "image/png", "modifiedTime": "2016-01-02T00:00:00Z"},
        {"id": "2", "name": "dir", "mimeType": listing.FOLDER_TYPE},
        {"id": "3", "name": "gone", "trashed": True, "mimeType": "text/plain"},
        {"name": "no id"},
    ]
    for n in range(2):
        (tmp_path / f"page-{n}.json").write_text(json.dumps({"files": records[n * 3 : n * 3 + 3], "nextPageToken": "t"}))
    (tmp_path / "other.json").write_text("no answer")
    pages = paged.saved_pages(spark, str(tmp_path))
    assert {(r["page"]) for r in pages.collect()} == {"page-0.json", "page-1.json"}
    lines = pages.select(F.lit("u").alias("user_id"), "value")
    parsed = listing.parse(lines.unionByName(spark.createDataFrame([("u", "no json")], "user_id string, value string")))
    files, folders = listing.split(parsed)
    assert [(r["id"], r["name"], r["parent_id"], r["size"], r["last_modified"]) for r in files.collect()] == [("1", "new", "root", None, 1451692800)]
    assert [r["id"] for r in folders.collect()] == ["2"]
    assert [tuple(r) for r in listing.shares(parsed).collect()] == [("u", "1", "y@e")]


def test_activity(spark):
    item = lambda name, **kind: {"driveItem": {"name": f"items/{name}", **kind}}
    records = [
        {"primaryActionDetail": {"move": {"addedParents": [item("new", driveFolder={})], "removedParents": [item("old")]}}, "timestamp": "2016-01-01T00:00:01Z", "targets": [item("f1", driveFile={}), item("d1", driveFolder={"type": "X"}), item("q")]},
        {"primaryActionDetail": {"create": {"copy": {"originalObject": item("orig")}}}, "timeRange": {"endTime": "2016-01-01T00:01:00Z"}, "targets": [item("f2", driveFile={})]},
        {"primaryActionDetail": {"rename": {"oldTitle": "a", "newTitle": "b"}}, "targets": [item("x", driveFolder={"type": activity.ROOT_TYPE})]},
        {"primaryActionDetail": {"comment": {"post": {"subtype": "ADDED"}}}, "targets": []},
    ]
    lines = spark.createDataFrame([("u", json.dumps(r)) for r in records] + [("u", "{"), ("u", "")], "user_id string, value string")
    actions = activity.parse(lines)
    found = sorted((r["cmd"], r["subtype"] or "", r["is_copy"], r["time"] or 0, r["old_name"] or "") for r in actions.collect())
    assert found == [("comment", "post", False, 0, ""), ("create", "copy", True, 1451606460, ""), ("move", "", False, 1451606401, ""), ("rename", "", False, 0, "a")]
    items = sorted((r["role"], r["file_id"] or "", r["folder_id"] or "", r["old_parent_id"] or "") for r in activity.items(actions).collect())
    assert items == sorted([("target", "f1", "", "old"), ("target", "", "d1", "old"), ("target", "q", "q", "old"), ("destination", "", "new", ""), ("target", "f2", "", ""), ("original", "orig", "", ""), ("target", "", "root", "")])


def _zip(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def test_content(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    t = 'xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
    d = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    for name, raw in {
        "a.docx": _zip(word__document_xml=f"<x {w}><w:p><w:t>one</w:t></w:p><w:p><w:t>two</w:t></w:p></x>"), "b.odt": _zip(content_xml=f"<x {t}><text:p>odd <text:p>in</text:p></text:p></x>"),
        "c.pptx": _zip(ppt__slides__slide1_xml=f"<x {d}><a:p><a:t>slide</a:t></a:p></x>"), "d.html": b"<b>bold</b><script>no</script> text", "e.md": b"# Head\n[link](u) *it*", "f.csv": b"a,b", "g.rtf": b"x", "h.bin": b"x",
        "i.docx": b"broken", "j.txt": b" ", "k.TXT": "ä".encode(),
    }.items():
        (tmp_path / name).write_bytes(raw)
    rows = {r["path"].rsplit("/", 1)[1]: (r["text"], r["error"] is not None) for r in content.texts(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert rows["a.docx"] == ("one\n\ntwo", False) and rows["c.pptx"] == ("slide", False) and rows["d.html"] == ("bold text", False)
    assert rows["e.md"] == ("Head\nlink it", False) and rows["f.csv"] == ("a b", False) and rows["g.rtf"] == ("", False) and rows["h.bin"] == (None, False)
    assert rows["i.docx"] == (None, True) and rows["j.txt"] == (" ", False) and rows["k.TXT"] == ("ä", False) and rows["b.odt"][0].startswith("odd  in")


def test_header_row(spark):
    df = spark.createDataFrame([("\n,,\nName, Size (kb)\n1,2",), ("a,,\n1,2,3",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(content.header_row(F.col("c"))).collect()] == [["name", "sizekb"], [], [], []]


def test_stream_functions(spark, tmp_path):
    rows = spark.createDataFrame([("k", "2024-01-01 00:00:00", 1), ("k", "2024-01-01 00:00:00", 1), ("k", "2024-01-01 00:01:00", 2), ("k", "2024-01-01 01:00:00", 3)], "key string, ts string, v int")
    rows.select("key", F.col("ts").cast("timestamp").alias("ts"), "v").coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("key string, ts timestamp, v int").parquet(str(tmp_path / "in"))

    def out(df, mode, name):
        query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name).collect()

    assert sorted(r["n"] for r in out(stream.windows(read(), "2 minutes", "1 minute"), "complete", "w")) == [1, 3]
    assert len(out(stream.once(read(), ["key", "ts"], "ts", "1 hour"), "append", "o")) == 3
    assert [r["v"] for r in out(stream.latest(read(), ["key"], "ts", ["v"]), "complete", "l")] == [3]


def test_streams_read_tables_of_one_file_and_of_several(spark, tmp_path):
    at = lambda d: dt.datetime(2024, 1, d)
    files = spark.createDataFrame([("u", "a", at(1), "old", 1), ("u", "a", at(3), "new", 2), ("v", "b", at(2), "b", None), (None, "a", at(1), "x", 1)], "user_id string, id string, ingested_at timestamp_ntz, name string, size long")
    log = spark.createDataFrame([("u", "c", at(1)), ("u", "c", at(2)), ("v", "d", at(1)), ("v", "e", None)], "user_id string, rand_id string, ingested_at timestamp_ntz")
    for name, rows in (("files", files), ("command_history", log)):
        rows.repartition(4, "ingested_at").write.parquet(str(tmp_path / f"folders/{name}.parquet"))
        rows.coalesce(1).write.parquet(str(tmp_path / "one"))
        (tmp_path / "single").mkdir(exist_ok=True)
        next((tmp_path / "one").glob("part-*")).rename(tmp_path / f"single/{name}.parquet")
        shutil.rmtree(tmp_path / "one")
    for folder in ("folders", "single"):
        assert {tuple(r) for r in source_queries.stream_latest(spark, str(tmp_path / folder)).collect()} == {("u", "a", "new", 2), ("v", "b", "b", None)}
        assert sorted(tuple(r) for r in source_queries.stream_once(spark, str(tmp_path / folder)).collect()) == [("u", "c"), ("v", "d")]


PAGES = {None: (['{"id": "1"}', '{"id": "2"}'], "b"), "b": ([], "c"), "c": (['{"id": "3"}'], None)}


def fetch(token):
    """A service of three pages."""
    return PAGES[token]


def test_a_busy_service_is_asked_again():
    answers, waits = [paged.ServiceError(429), paged.ServiceError(403), (["x"], None)], []

    def busy(token):
        answer = answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    assert paged.asked(busy, None, 2, 7, waits.append) == (["x"], None) and waits == [7, 7]
    answers[:] = [paged.ServiceError(429)] * 2
    with pytest.raises(paged.ServiceError):
        paged.asked(busy, None, 1, 7, waits.append)
    answers[:] = [paged.ServiceError(500)]
    with pytest.raises(paged.ServiceError):
        paged.asked(busy, None, 5, 7, waits.append)
    assert not answers


def test_paged_service(spark, scratch):
    spark.dataSource.register(paged.PagedService)
    read = spark.read.format("paged_service").option("fetch", "tests.test_sources:fetch").load()
    assert sorted(tuple(r) for r in read.collect()) == [(0, '{"id": "1"}'), (0, '{"id": "2"}'), (2, '{"id": "3"}')]
    stream = spark.readStream.format("paged_service").option("fetch", "tests.test_sources:fetch").load()
    out = f"{scratch.path}/out"
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{scratch.path}/cp").trigger(processingTime="100 milliseconds").start(out)
    try:
        end = time.time() + 90
        while time.time() < end and (not query.lastProgress or query.lastProgress["sources"][0]["endOffset"] is None or '"end": true' not in json.dumps(query.lastProgress["sources"][0]["endOffset"]).replace("\\", "")):
            time.sleep(0.3)
            query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [(0, '{"id": "1"}'), (0, '{"id": "2"}'), (2, '{"id": "3"}')]


def _workbook():
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    shared = f"<sst {m}><si><t>First Name</t></si><si><r><t>A</t></r><r><t>ge</t></r></si><si><t>Anna</t></si></sst>"
    sheet = f'<worksheet {m}><sheetData><row><c t="inlineStr"><is><t></t></is></c></row><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row><c t="s"><v>2</v></c><c><v>7</v></c></row></sheetData></worksheet>'
    return _zip(xl__sharedStrings_xml=shared, xl__worksheets__sheet1_xml=sheet)


def _document():
    shown = zlib.compress(b"BT /F1 12 Tf (Hel) Tj [(lo) -20 ( w\\(or\\)ld)] TJ ET BT (next) Tj ET")
    return b"%PDF-1.4\n1 0 obj << /Length 9 >>\nstream\n" + shown + b"\nendstream endobj\n5 0 obj << /Title (A \\(b\\)) /Author (Ann) /Producer (\xff) >> endobj\ntrailer << /Info 5 0 R >>"


def test_workbooks_documents_and_folders(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, raw in {"a.xlsx": _workbook(), "in/b.pdf": _document(), "in/c.XLSX": b"broken", "d": b"x", "e.pdf": b"%PDF"}.items():
        (tmp_path / name).write_bytes(raw)
    files = content.binary_files(spark, str(tmp_path))
    texts = {r["path"].rsplit("/", 1)[1]: (r["text"], r["error"] is not None) for r in content.texts(files).collect()}
    assert texts == {"a.xlsx": (" First Name Age Anna", False), "b.pdf": ("Hello w(or)ld\nnext", False), "c.XLSX": (None, True), "d": (None, False), "e.pdf": ("", False)}
    found = {r["path"].rsplit("/", 1)[1]: (r["metadata"], r["header"]) for r in content.described(files).collect()}
    assert found["a.xlsx"] == (None, ["firstname", "age"]) and found["c.XLSX"] == (None, None) and json.loads(found["e.pdf"][0]) == {}
    assert json.loads(found["b.pdf"][0]) == {"Title": "A (b)", "Author": hashlib.sha256(b"Ann").hexdigest(), "Producer": ""}
    walked = {r["id"]: (r["name"], r["parent_id"], r["file_extension"], r["size"]) for r in content.walk(spark, str(tmp_path), "u").collect()}
    assert walked["in/b.pdf"] == ("b.pdf", "in", "pdf", len(_document())) and walked["d"] == ("d", "root", "", 1) and len(walked) == 5
    assert content.binary_files(spark, str(tmp_path), limit=1).count() == 1
