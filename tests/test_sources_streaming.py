import io
import json
import os
import random
import struct
import tempfile
import time
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafmark.functions import answers as A
from leafmark.plans import conversations as CV
from leafmark.sources import files, glyphs, numbers, workbook
from leafmark.sources.store import Library
from leafmark.streaming import events, imports


def workbook_bytes(sheets):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f"<workbook {ns} {rel}><sheets>{names}</sheets></workbook>")
        links = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            body = ""
            for r, row in enumerate(rows, 1):
                cells = "".join(
                    f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in enumerate(row) if v is not None
                )
                body += f'<row r="{r}">{cells}</row>'
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="leafmark-test-")


def put(folder, name, content):
    with open(os.path.join(folder, name), "wb") as f:
        f.write(content)


# nested nodes: position among the siblings at each depth, title, page
OUTLINE_NODES = [([1], "B", 4), ([0], " A ", 1), ([0, 1], "A2", 3), ([0, 0, 0], "A1a", 2), ([0, 0], " ", 2), ([0, 2], "lost", None), ([10], "K", 9)]


def test_files_become_pages(spark, folder):
    def pdf_reader(batches):
        for batch in batches:
            rows = []
            for path in batch["path"]:
                if "broken" in path:
                    rows.append((path, None, None, None, None, None, None, None, "not a pdf"))
                    continue
                runs = [("Flash", 5.0, 700.0), ("manual", 40.0, 700.02), ("第 1 页", 5.0, 600.0)]
                rows += [(path, 1, n, *run, 595.0, 842.0, None) for n, run in enumerate(runs)]
            yield pd.DataFrame(rows, columns=["path", "page_number", "run_no", "str", "x", "y", "width", "height", "error"])

    def pdf_outline(batches):
        for batch in batches:
            rows = [(path, place, title, page) for path in batch["path"] for place, title, page in OUTLINE_NODES]
            yield pd.DataFrame(rows, columns=["path", "place", "title", "page_number"])

    put(folder, "pins.xlsx", workbook_bytes({"PB9": [["引脚", "功能"], [None, None], ["PA9", None, "USART1_TX"]], "空": []}))
    put(folder, "shot.png", b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 640, 480) + b"rest")
    put(folder, "flash.pdf", b"%PDF")
    put(folder, "notes.txt", b"x")
    put(folder, "broken.pdf", b"not a valid pdf")
    put(folder, "broken.xlsx", b"not a zip")
    put(folder, "old.xls", b"\xd0\xcf\x11\xe0")
    scanned = files.scan(spark, folder)
    got = files.extract(scanned, pdf_reader, pdf_outline)
    pages = {os.path.basename(r.document_id): r for r in got.pages.collect()}
    assert pages["shot.png"].text == "shot.png"
    assert pages["flash.pdf"].text == "Flash manual\n第 1 页" and pages["flash.pdf"].printed_page == "1"
    info = files.image_info(scanned).first()
    assert (info.width, info.height, info.mime_type) == (640, 480, "image/png")
    docs = {r.original_filename: r for r in got.documents.collect()}
    assert docs["notes.txt"].error_message.endswith(".txt") and docs["pins.xlsx"].kind == "xlsx"
    assert (pages["flash.pdf"].width, pages["flash.pdf"].height, pages["shot.png"].width) == (595, 842, 640)
    assert {os.path.basename(r.document_id) for r in got.documents.where("error_message is not null").collect()} == {"notes.txt", "broken.pdf", "broken.xlsx", "old.xls"}
    assert sorted(r.title for r in got.outline.where("document_id not like '%.pdf'").collect()) == sorted(["PB9", "shot.png", "空"])
    nodes = got.outline.where("document_id like '%flash.pdf'").orderBy("seq").collect()
    assert [(r.seq, r.title, r.level, r.page_number) for r in nodes] == [(0, "A", 1, 1), (2, "A1a", 3, 2), (3, "A2", 2, 3), (5, "B", 1, 4), (6, "K", 1, 9)]
    assert sorted((r.page_number, r.text) for r in got.pages.where("document_id like '%pins.xlsx'").collect()) == [(1, "引脚\t功能\nPA9\t\tUSART1_TX"), (2, "")]
    without = files.extract(scanned)
    assert without.documents.where("error_message is not null").count() == 5 and without.pages.where("document_id like '%.pdf'").isEmpty()


def test_manifest(spark, folder):
    put(folder, "m.json", json.dumps([{"title": "a", "sourcePath": "x.pdf", "kind": "pdf"}]).encode())
    row = files.read_manifest(spark, f"{folder}/m.json").first()
    assert row.source_path == f"{folder}/x.pdf"
    put(folder, "m.local.json", json.dumps([{"title": "a", "sourcePath": "/x.pdf", "kind": "zip"}]).encode())
    with pytest.raises(Exception):
        files.read_manifest(spark, f"{folder}/m.json").collect()
    with pytest.raises(ValueError):
        files.asset_path(spark, folder, "../etc/passwd")
    with pytest.raises(ValueError):
        files.asset_path(spark, folder, f"{folder}x/m.json")
    assert files.read_asset(spark, folder, "./a/../m.json").first().content.startswith(b"[")


DOCS = "document_id string, sha256 string, original_filename string, title string, kind string"
PAGES = "document_id string, page_number long, printed_page string, text string"
TOC = "document_id string, seq long, title string, level int, page_number long"


def test_library_lifecycle(spark, folder):
    lib = Library(spark, f"{folder}/lib")
    assert lib.is_empty()
    docs = spark.createDataFrame([("a", "h1", "a.pdf", "A", "pdf"), ("b", "h1", "b.pdf", "B", "pdf"), ("c", "h2", "c.pdf", "C", "pdf")], DOCS)
    pages = spark.createDataFrame([(d, p, str(p), f"{d} page {p} USART1_TX 低功耗模式") for d in "abc" for p in (1, 2)], PAGES)
    toc = spark.createDataFrame([("a", 0, "Intro", 1, 1), ("c", 0, "Start", 1, 2)], TOC)
    status = {r.document_id: (r.status, r.duplicate_of) for r in lib.import_documents(docs, pages, toc).collect()}
    assert status == {"a": ("imported", None), "b": ("duplicate", "a"), "c": ("imported", None)}
    again = lib.import_documents(docs.where("document_id = 'b'"), pages, toc).collect()
    assert [(r.status, r.duplicate_of) for r in again] == [("duplicate", "a")]
    assert lib.table("documents").count() == 2 and lib.table("chunks").count() == 4
    assert lib.table("chunks").where("heading = 'Intro'").count() == 2

    @F.pandas_udf("array<float>")
    def embed(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [float(len(t)), 1.0])

    @F.pandas_udf("array<float>")
    def broken(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [] if "page 2" in t else [1.0])

    assert lib.rebuild_vectors("m", embed)["complete"]
    with pytest.raises(ValueError):
        lib.rebuild_vectors("other", broken)
    assert lib.embedding_status("m")["complete"] and lib.vectors().count() == 4
    lib.remove("a")
    assert {r.document_id for r in lib.table("chunks").select("document_id").distinct().collect()} == {"c"}
    assert lib.vectors().count() == 2 and lib.table("pages").count() == 2
    assert not lib.ensure_search_index()
    lib._set_meta("search_index_version", "1")
    assert lib.ensure_search_index() and lib.table("chunks").count() == 2
    assert lib.index().total == 2
    with pytest.raises(KeyError):
        lib.remove("nobody")


def one(spark, name, sha, text, title="T"):
    docs = spark.createDataFrame([(name, sha, f"{name}.pdf", title, "pdf")], DOCS)
    return docs, spark.createDataFrame([(name, 1, "1", text)], PAGES), spark.createDataFrame([], TOC)


def test_compaction_keeps_everything_in_few_files(spark, folder):
    lib = Library(spark, f"{folder}/lib")
    for n in range(5):
        lib.import_documents(*one(spark, f"d{n}", f"h{n}", f"text {n} USART1_TX"), import_id=f"i{n}")
    lib.remove("d0")
    names = ("documents", "pages", "toc_nodes", "chunks", "postings")
    state = lambda of: {n: sorted(map(str, of.table(n).collect())) for n in names}
    before, progress = state(lib), sorted(map(str, lib.progress().collect()))
    other = Library(spark, f"{folder}/lib")
    assert state(other) == before
    lib.compact()
    for reader in (lib, other, Library(spark, f"{folder}/lib")):
        assert state(reader) == before and sorted(map(str, reader.progress().collect())) == progress
    for name in (*names, "imports", "progress", "stages"):
        files_ = [f for f in os.listdir(f"{folder}/lib/{lib._folder(name)}") if f.endswith(".parquet")]
        assert len(files_) <= 1, name
    assert lib.import_documents(*one(spark, "d1", "h1", "text 1"), import_id="i1").count() == 0
    assert [r.status for r in other.import_documents(*one(spark, "d0", "h0", "text 0 USART1_TX"), import_id="i9").collect()] == ["imported"]
    assert lib.table("documents").count() == 5 and lib.index().total == 5


def test_removed_file_can_come_back(spark, folder):
    lib = Library(spark, f"{folder}/lib")
    lib.import_documents(*one(spark, "a", "h1", "first text"))
    lib.remove("a")
    assert lib.is_empty() and lib.index().total == 0
    assert [r.status for r in lib.import_documents(*one(spark, "a", "h1", "first text")).collect()] == ["imported"]
    assert lib.table("chunks").count() == 1 and lib.index().total == 1
    assert [(r.status, r.duplicate_of) for r in lib.import_documents(*one(spark, "a", "h1", "first text")).collect()] == [("duplicate", "a")]


def test_changed_file_replaces_its_document(spark, folder):
    lib = Library(spark, f"{folder}/lib")
    lib.import_documents(*one(spark, "b", "h1", "old text"))
    lib.import_documents(*one(spark, "b", "h2", "new text USART1_TX"))
    assert [r.text for r in lib.table("pages").collect()] == ["new text USART1_TX"]
    index = lib.index()
    assert index.total == 1 and index.postings.where("term = 'OLD'").isEmpty() and not index.postings.where("term = 'NEW'").isEmpty()


def test_crash_and_retry_and_replay(spark, folder, monkeypatch):
    lib = Library(spark, f"{folder}/lib")
    append = Library._append

    def failing(self, name, df, where=None):
        if name == "documents":
            raise RuntimeError("lost")
        append(self, name, df, where)

    monkeypatch.setattr(Library, "_append", failing)
    with pytest.raises(RuntimeError):
        lib.import_documents(*one(spark, "a", "h1", "some text"), import_id="batch#1")
    assert lib.table("chunks").count() == 0 and lib.index().total == 0
    monkeypatch.undo()
    for want in (1, 0):  # the retry, then a replay of the committed batch
        assert lib.import_documents(*one(spark, "a", "h1", "some text"), import_id="batch#1").count() == want
        assert lib.table("chunks").count() == 1 and lib.table("documents").count() == 1 and lib.index().total == 1
    assert [(r.import_id, r.stage) for r in lib.progress().collect()] == [("batch#1", "imported")]


def test_import_with_vectors(spark, folder):
    @F.pandas_udf("array<float>")
    def broken(text: pd.Series) -> pd.Series:
        raise ValueError("model is down")

    @F.pandas_udf("array<float>")
    def fine(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [float(len(t)), 1.0])

    lib = Library(spark, f"{folder}/lib")
    rows = lib.import_documents(*one(spark, "a", "h1", "some text"), embed=("m", broken)).collect()
    assert [r.status for r in rows] == ["imported", "warning"] and lib.table("documents").count() == 1
    lib.import_documents(*one(spark, "b", "h2", "more text"), embed=("m", fine))
    assert lib.embedding_status("m")["complete"] and lib.vectors("other").isEmpty()
    lib.import_documents(*one(spark, "b", "h3", "other text"))
    assert lib.embedding_status("m")["indexed"] == 1  # the old version's vector isn't the new one's


def frame(text):
    return "data: " + json.dumps({"choices": [{"delta": {"content": text}}]}, ensure_ascii=False) + "\n\n"


WIRE = frame("US") + "event: x\r\ndata: {bad\n\n" + frame("ART1") + "data: [DONE]\n\n" + frame("late")


def cut(text, size):
    return [text[i : i + size] for i in range(0, len(text), size)]


def test_frames_in_batch_and_stream(spark, folder):
    rows = [("s", i, p) for i, p in enumerate(cut(WIRE, 7))]
    rows += [("open", i, p) for i, p in enumerate(cut(frame("A") + frame("B").rstrip("\n"), 11))]
    pieces = spark.createDataFrame(rows, "stream_id string, seq long, piece string")
    found = sorted(events.parse_frames(pieces).collect(), key=lambda r: (r.stream_id, r.frame_no))
    assert [(r.stream_id, r.delta) for r in found] == [("open", "A"), ("open", "B"), ("s", "US"), ("s", "ART1")]
    one = spark.createDataFrame([("s", 0, WIRE)], "stream_id string, seq long, piece string")
    assert sorted(r.delta for r in events.parse_frames(one).collect()) == ["ART1", "US", "late"]

    for half, part in enumerate((rows[:9], rows[9:])):
        spark.createDataFrame(part, "stream_id string, seq long, piece string").coalesce(1).write.mode("append").json(f"{folder}/in")
        q = imports.follow_answers(spark, f"{folder}/in", f"{folder}/out", f"{folder}/ck")
        q.awaitTermination(120)
    out = spark.read.parquet(f"{folder}/out").where("stream_id = 's'").orderBy("frame_no").collect()
    assert [r.delta for r in out] == ["US", "ART1"]


PIECES = "stream_id string, seq long, piece string"


def plain_frames(pieces):
    """All frames of a stream by pushing one piece after the other."""
    state, out = {"buffer": "", "done": False, "next_seq": 0, "frame_no": 0}, []
    for piece in pieces:
        events.Frames._push(state, piece, out)
    events.Frames._flush(state, out)
    return out


def all_splits():
    texts = {"w": frame("US") + "event: x\r\ndata: {bad\n\n\n\n\n" + frame("ART1") + "data: [DONE]\n\n" + frame("late") + "\n"}
    texts["o"] = frame("A") + "\n" + frame("B").rstrip("\n")
    return {f"{name}{size}": cut(text, size) for name, text in texts.items() for size in range(1, 12)}


def test_frames_of_any_split_and_order(spark, folder):
    streams = all_splits()
    want = sorted((s, *r) for s, pieces in streams.items() for r in plain_frames(pieces))
    rows = [(s, i, p) for s, pieces in streams.items() for i, p in enumerate(pieces)]
    assert sorted(tuple(r) for r in events.parse_frames(spark.createDataFrame(rows, PIECES)).collect()) == want
    rows += [(s, len(pieces), None) for s, pieces in streams.items()]
    random.Random(4).shuffle(rows)
    for n in range(3):
        spark.createDataFrame(rows[n::3], PIECES).coalesce(1).write.mode("append").json(f"{folder}/in", ignoreNullFields=False)
    imports.follow_answers(spark, f"{folder}/in", f"{folder}/out", f"{folder}/ck", files_per_batch=1).awaitTermination(200)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()) == want


def test_quiet_streams_are_flushed(spark, folder):
    rows = [("o", i, p) for i, p in enumerate(cut(frame("A") + frame("B").rstrip("\n"), 9)) if i != 2]
    spark.createDataFrame(rows, PIECES).coalesce(1).write.json(f"{folder}/in")
    query = imports.follow_answers(spark, f"{folder}/in", f"{folder}/out", f"{folder}/ck", quiet_ms=1000)
    want = [("o", *r) for r in plain_frames([p for _, _, p in rows])]
    found, until = [], time.time() + 90
    while found != want and time.time() < until:
        time.sleep(1)
        if os.path.isdir(f"{folder}/out/_spark_metadata"):
            found = [tuple(r) for r in spark.read.schema(events.FRAME_OUT).parquet(f"{folder}/out").collect()]
    query.stop()
    assert want and found == want


def test_a_long_stream_takes_seconds(spark):
    one = spark.range(100_000).select(F.lit("s").alias("stream_id"), F.col("id").alias("seq"), F.expr("if(id % 5 = 4, concat(id, '\"}}]}\n\n'), if(id % 5 = 0, 'data: {\"choices\":[{\"delta\":{\"content\":\"', 'x'))").alias("piece"))
    start = time.time()
    assert events.parse_frames(one).agg(F.count("*"), F.max("frame_no")).first()[:] == (20_000, 19_999)
    assert time.time() - start < 60


def test_messages_of_any_order(spark, folder):
    rng, rows = random.Random(9), []
    for m in range(15):
        for seq in range(rng.randrange(1, 9)):
            kind = rng.choice(["delta", "delta", "delta", "replace", "sources", "complete", "error"])
            cited = f"S{seq}" if kind in ("sources", "complete") else None
            rows.append((f"m{m}", seq, kind, f"d{seq}" if kind == "delta" else None, f"R{seq}" if kind == "replace" else None, cited, rng.choice([None, "boom"]) if kind == "error" else None))
    want = sorted((tuple(r) for r in events.fold_events(spark.createDataFrame(rows, events.EVENT_IN)).collect()), key=str)
    rng.shuffle(rows)
    for n in range(4):
        spark.createDataFrame(rows[n::4], events.EVENT_IN).coalesce(1).write.mode("append").json(f"{folder}/in")
    imports.follow_messages(spark, f"{folder}/in", f"{folder}/out", f"{folder}/ck", 1).awaitTermination(200)
    assert sorted((tuple(r) for r in imports.latest_messages(spark, f"{folder}/out").collect()), key=str) == want


def test_streamed_import(spark, folder):
    feed = [("a", "A", "pdf", "h1", 1, "1", "first text", None), ("b", "B", "pdf", "h1", 1, "1", "first text", None)]
    schema = imports.PAGE_FEED
    spark.createDataFrame(feed, schema).write.json(f"{folder}/in")
    lib = Library(spark, f"{folder}/lib")
    imports.follow_pages(spark, f"{folder}/in", lib, f"{folder}/ck").awaitTermination(120)
    spark.createDataFrame([("c", "C", "pdf", "h1", 1, "1", "first text", 1), ("d", "D", "pdf", "h9", 1, "1", "other", 1)], schema).write.mode("append").json(f"{folder}/in")
    imports.follow_pages(spark, f"{folder}/in", lib, f"{folder}/ck").awaitTermination(120)
    assert {r.document_id for r in lib.table("documents").collect()} == {"a", "d"}


def test_documents_are_assembled_over_micro_batches(spark, folder):
    def page(document, sha, number, of):
        return (document, document.upper(), "pdf", sha, number, str(number), f"{document} page {number}", of)

    files_ = [
        [page("a", "h1", 1, 3), page("b", "h2", 1, None), page("c", "h3", 1, 2)],
        [page("a", "h1", 3, 3), page("b", "h2", 2, None), page("a", "h1", 1, 3)],
        [page("a", "h1", 2, 3), page("d", "h1", 1, 1)],
    ]
    lib, log = Library(spark, f"{folder}/lib"), imports.Progress()
    spark.streams.addListener(log)
    seen = []
    for rows in files_:
        spark.createDataFrame(rows, imports.PAGE_FEED).coalesce(1).write.mode("append").json(f"{folder}/in")
        imports.follow_pages(spark, f"{folder}/in", lib, f"{folder}/ck").awaitTermination(200)
        found = lib.table("pages").groupBy("document_id").agg(F.sort_array(F.collect_list("page_number")).alias("p")).collect()
        seen.append({r.document_id: r.p for r in found})
    assert seen == [{"b": [1]}, {"b": [1, 2]}, {"a": [1, 2, 3], "b": [1, 2]}]
    assembly = imports.Assembly(lib, f"{folder}/ck")
    assert [(r.document_id, r.page_number) for r in assembly.waiting(2).collect()] == [("c", 1)]
    for _ in range(2):  # a batch that is run again changes nothing
        assembly.take(spark.createDataFrame(files_[2], imports.PAGE_FEED), 2)
        assert lib.table("pages").count() == 5 and lib.table("documents").where("document_id = 'd'").isEmpty()
    assembly.take(spark.createDataFrame([], imports.PAGE_FEED), 3, force=True)
    assert lib.table("pages").where("document_id = 'c'").count() == 1 and assembly.waiting(3).isEmpty()
    until = time.time() + 20
    while [r[3] for r in log.rows].count("ended") < 3 and time.time() < until:
        time.sleep(0.5)
    spark.streams.removeListener(log)
    events_ = [r.event for r in log.table(spark).collect()]
    assert events_.count("started") == 3 and events_.count("ended") == 3
    assert sum(r.input_rows for r in log.table(spark).collect()) >= 8


def test_vectors_in_batches_are_resumed_and_reported(spark, folder):
    lib = Library(spark, f"{folder}/lib")
    docs = spark.createDataFrame([(f"d{i}", f"h{i}", "x.pdf", "T", "pdf") for i in range(12)], DOCS)
    pages = spark.createDataFrame([(f"d{i}", 1, "1", f"text {i}") for i in range(12)], PAGES)
    lib.import_documents(docs, pages, spark.createDataFrame([], TOC), import_id="one")
    assert {r.stage: r.documents for r in lib.stages().collect()} == {"hashed": 12, "extracted": 12, "chunked": 12, "indexed": 12}

    @F.pandas_udf("array<float>")
    def broken(text: pd.Series) -> pd.Series:
        if text.str.contains("text 7").any():
            raise ValueError("model is down")
        return text.map(lambda t: [1.0, 2.0])

    @F.pandas_udf("array<float>")
    def fine(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [3.0, 4.0])

    with pytest.raises(Exception):
        lib.rebuild_vectors("m", broken, batches=4)
    kept = lib.embedding_progress().collect()
    assert lib.vectors("m").isEmpty() and len(kept) < 4
    assert lib.rebuild_vectors("m", fine, batches=4)["complete"]
    rows = lib.embedding_progress().orderBy("at").collect()
    assert rows[-1].indexed == rows[-1].total == 12 and len({r.build for r in rows}) == 1
    assert lib.vectors("m").where("vector[0] = 1").count() == sum(r.embedded for r in kept)


def test_workbook_cells_are_shown_as_formatted(spark, folder):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    plain = workbook_bytes({"S": [["x"]]})
    cells = [("1", "0.5"), ("2", "1234567.891"), ("3", "0.256"), ("4", "44197.75"), ("5", "-5"), ("6", "7"), (None, "3.10")]
    sheet = "".join(f'<c r="{chr(65 + i)}1"' + (f' s="{s}"' if s else "") + f"><v>{v}</v></c>" for i, (s, v) in enumerate(cells))
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(plain)) as old, zipfile.ZipFile(out, "w") as z:
        for name in old.namelist():
            z.writestr(name, old.read(name) if "sheet1" not in name else f"<worksheet {ns}><sheetData><row r='1'>{sheet}</row></sheetData></worksheet>")
        own = '<numFmts><numFmt numFmtId="164" formatCode="yyyy-mm-dd hh:mm"/><numFmt numFmtId="165" formatCode="0.0;(0.0)"/></numFmts>'
        xfs = "".join(f'<xf numFmtId="{n}"/>' for n in (0, 12, 4, 9, 164, 165, 49))
        z.writestr("xl/styles.xml", f"<styleSheet {ns}>{own}<cellXfs>{xfs}</cellXfs></styleSheet>")
    put(folder, "f.xlsx", out.getvalue())
    row = workbook.read_cells(files.scan(spark, folder)).where("row_no is not null").first()
    assert row.cells == [" 1/2", "1,234,567.89", "26%", "2021-01-01 18:00", "(5.0)", "7", "3.1"]


SHOWN = [
    (1234.5, "General", "1234.5"), (0.1 + 0.2, None, "0.3"), (1e12, "General", "1E+12"), (1234567, "#,##0", "1,234,567"), (-1234.567, "#,##0.00", "-1,234.57"),
    (0.2567, "0.00%", "25.67%"), (44197.75, "m/d/yy h:mm", "1/1/21 18:00"), (44197.75, "h:mm AM/PM", "6:00 PM"), (1.5, "[h]:mm:ss", "36:00:00"),
    (-5, "#,##0 ;(#,##0)", "(5)"), (0, '0;-0;"zero"', "zero"), (12345, "0.00E+00", "1.23E+04"), (12345, "##0.0E+0", "12.3E+3"), (1.25, "# ??/??", "1  1/4 "),
    (3, "000", "003"), (1234567, '0.0,,"M"', "1.2M"), (1.5, "[$€-407] 0.0", "€ 1.5"), (44197, "dddd, d mmmm yyyy", "Friday, 1 January 2021"),
    (0.0423611, "mm:ss", "01:00"), (44197.5, "yyyy年m月d日", "2021年1月1日"), (150, '[>100]"big";"small"', "big"), (50, '[>100]"big";"small"', "small"),
    (0.5, "#.##", ".5"), (2, "0.0#", "2.0"), (59, "d-mmm", "28-Feb"), (61, "d-mmm", "1-Mar"), (-0.001, "0.00", "0.00"), (7, "@", "7"), (float("nan"), "0", None),
]


@pytest.mark.parametrize("value,code,text", SHOWN)
def test_format_codes(value, code, text):
    assert numbers.shown(value, code) == text


def test_event_fold(spark):
    rows = [
        ("m1", 1, "delta", "a", None, None, None), ("m1", 2, "replace", None, "R", None, None),
        ("m1", 3, "delta", "b", None, None, None), ("m1", 4, "complete", None, None, "S1", None),
        ("m2", 1, "delta", "x", None, None, None), ("m2", 2, "error", None, None, None, "boom"), ("m3", 1, "delta", "y", None, None, None),
    ]
    df = spark.createDataFrame(rows, "message_id string, seq long, type string, delta string, content string, citations string, error string")
    found = {r.message_id: (r.content, r.status) for r in events.fold_events(df, 2).collect()}
    assert found == {"m1": ("Rb", "complete"), "m2": ("x\n\n[回答中断：boom]", "error"), "m3": ("y", "streaming")}


def test_citations_and_conversations(spark):
    sources = spark.createDataFrame([(1, f"S{i}", i) for i in range(1, 7)], "query_id long, source_id string, source_no int")
    answers = spark.createDataFrame([("a", 1, "A [S1] B [S1] C [S9]"), ("b", 1, "none"), ("c", 2, "x")], "answer_id string, query_id long, answer string")
    parsed = A.parse_citations(answers, sources).collect()
    assert [(r.answer_id, r.source_id) for r in parsed] == [("a", "S1")]
    done = {r.answer_id: r for r in A.cite(answers, sources).collect()}
    assert done["a"].labels == ["S1"] and not done["a"].fallback
    assert done["b"].fallback and done["b"].answer.endswith("参考资料：[S1] [S2] [S3] [S4]")
    assert done["c"].labels == [] and not done["c"].fallback
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", " Q  one "), (2, 0, "assistant", "x")], "conv_id long, turn long, role string, text string")
    conversations, messages = CV.from_turns(turns)
    listed = CV.list_conversations(conversations, messages).collect()
    assert [(r.conversation_id, r.title, r.message_count) for r in listed] == [(1, "Q one", 2), (2, "新对话", 1)]
    left, rest = CV.delete(conversations, messages, 1)
    assert left.count() == 1 and rest.count() == 1


def test_runs_touch_only_between_latin_words(spark):
    rows = [(1, i, s, float(i), 10.0) for i, s in enumerate(["(USART1", ")", "TX", "低", "功", "mode", "x"])]
    df = spark.createDataFrame(rows, "page long, run_no int, str string, x double, y double")
    assert glyphs.lines(df, ["page"]).first().line == "(USART1) TX低功mode x"
