"""PDF text layers, routing, fallbacks of spelling, exports and evaluation outputs."""

import json
import zlib

import pytest
from pyspark.sql import functions as F

from folium.functions import metadata, text as T, toc
from folium.operators import spelling
from folium.plans import process, summary
from folium.sinks import export
from folium.sources.files import extract_one
from folium.sources.pdf import PdfError, read_pdf


def pdf_file(pages, packed=False, unicode_map=False):
    """A small PDF: one content stream per page, Flate or plain, with or without an object stream."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}
    kids = " ".join(f"{10 + i} 0 R" for i in range(len(pages)))
    objects[2] = f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} /Resources << /Font << /F1 3 0 R >> >> >>".encode()
    objects[3] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica " + (b"/ToUnicode 4 0 R " if unicode_map else b"") + b">>"
    streams = {}
    if unicode_map:
        streams[4] = b"begincmap 1 beginbfrange <41> <5A> <0061> endbfrange 1 beginbfchar <2E> <00E9> endbfchar endcmap"
    for i, content in enumerate(pages):
        objects[10 + i] = f"<< /Type /Page /Parent 2 0 R /Contents {50 + i} 0 R >>".encode()
        streams[50 + i] = content
    out = b"%PDF-1.5\n"
    if packed:
        heads, body = [], b""
        for n, o in objects.items():
            heads.append(f"{n} {len(body)}")
            body += o + b" "
        first = " ".join(heads).encode() + b" "
        raw = zlib.compress(first + body)
        out += f"90 0 obj << /Type /ObjStm /N {len(objects)} /First {len(first)} /Filter /FlateDecode /Length {len(raw)} >>\nstream\n".encode() + raw + b"\nendstream endobj\n"
    else:
        for n, o in objects.items():
            out += f"{n} 0 obj ".encode() + o + b" endobj\n"
    for n, content in streams.items():
        raw = zlib.compress(content)
        out += f"{n} 0 obj << /Length {len(raw)} /Filter /FlateDecode >>\nstream\n".encode() + raw + b"\nendstream endobj\n"
    return out + b"trailer << /Root 1 0 R >>"


def test_pdf_text_layer():
    one = rb"BT /F1 12 Tf 72 700 Td (First \(line\) \101) Tj 0 -14 Td [(Sec) -20 (ond) -300 (line)] TJ T* <54686972642E> Tj ET"
    for packed in (False, True):
        assert read_pdf(pdf_file([one, b"BT (Page two) Tj ET"], packed)) == ["First (line) A\nSecond line\nThird.", "Page two"]
    assert read_pdf(pdf_file([b"BT /F1 9 Tf (CAF.) Tj ET"], unicode_map=True)) == ["café"]
    row = extract_one(pdf_file([one]), ".pdf", None, None)
    assert row["success"] and row["pages"][0]["has_text"] and row["text"].startswith("First (line) A")
    scanned = pdf_file([b"q 1 0 0 1 0 0 cm /Im1 Do Q"])
    assert not extract_one(scanned, ".pdf", None, None)["success"]
    assert extract_one(scanned, ".pdf", None, lambda b: ["read by eye"])["extraction_method"] == "pdf_ocr"
    for bad in (b"", b"no pdf", b"%PDF-1.4 trailer << /Encrypt 5 0 R >>"):
        with pytest.raises(PdfError):
            read_pdf(bad)


def test_technical_documents_are_chunked_by_their_own_settings(spark):
    segments = [{"pos": i, "type": "paragraph", "text": "word " * 60, "level": None, "section": None, "title": None, "length": 300, "is_toc": False} for i in range(12)]
    schema = "doc_id long, segments array<struct<pos:int,type:string,text:string,level:int,section:string,title:string,length:int,is_toc:boolean>>"
    segmented = spark.createDataFrame([(1, segments), (2, segments), (3, segments)], schema)
    classes = spark.createDataFrame([(1, "technical"), (2, "legal"), (3, None)], "doc_id long, category string")
    n = {r["doc_id"]: r["count"] for r in process.chunk_routed(segmented, classes).groupBy("doc_id").count().collect()}
    assert n[1] < n[2] == n[3]
    plain = process.chunk_routed(segmented, classes, process.Options(route=False)).groupBy("doc_id").count().collect()
    assert {r["count"] for r in plain} == {n[2]}


def test_spelling_falls_through(spark, monkeypatch):
    words = spark.createDataFrame([("hause",), ("house",)], "word string")
    dictionary = spark.createDataFrame([("house", 100)], "term string, frequency long")

    def broken(words, dictionary, **o):
        raise ImportError("no such library")

    monkeypatch.setitem(spelling.BACKENDS, "broken", broken)
    plain = spelling.BACKENDS["standard"](words, dictionary).collect()
    with pytest.warns(UserWarning):
        got = spelling.corrected_words(words, dictionary, "broken", "standard").collect()
    assert sorted(r["word"] for r in got) == sorted(r["word"] for r in plain)
    with pytest.warns(UserWarning):
        assert spelling.corrected_words(words, words, "broken").count() == 0


def test_exports(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 1, "one"), (1, 0, "zero"), (2, 0, "x")], "doc_id long, chunk_no int, text string")
    told = spark.createDataFrame([(1, "A Title", "Ann"), (2, None, None), (3, "Empty", None)], "doc_id long, title string, author string")
    texts = export.document_texts(chunks, told)
    paths = export.export(texts, str(tmp_path), ["markdown", "json", "text"])
    assert set(paths) == {"markdown", "json", "text"}
    markdown, plain = (export.one_document(spark, paths[f], "A_Title") for f in ("markdown", "text"))
    assert "zero" in markdown and markdown.index("zero") < markdown.index("one") and plain.startswith("A TITLE\n=======")
    assert json.loads(export.one_document(spark, paths["json"], "A_Title"))["chunks"] == ["zero", "one"]
    long = spark.createDataFrame([([("x" * 100_001,)],)], "pages array<struct<text:string>>")
    assert sum(len(p) for p in long.select(export.corrected_pages(F.col("pages")).alias("p")).first()["p"]) == 100_001


def test_appended_vectors_go_on(spark):
    old = spark.createDataFrame([(0, "a", "1"), (4, "b", "1")], "vec_id long, document_id string, chunk_id string")
    new = spark.createDataFrame([(f"d{i:02}", f"{j}") for i in range(20) for j in range(3)], "document_id string, chunk_id string").repartition(5)
    got = export.append_vectors(old, new).where("vec_id > 4").orderBy("vec_id").collect()
    assert [r["vec_id"] for r in got] == list(range(5, 65))
    assert [(r["document_id"], r["chunk_id"]) for r in got] == [(f"d{i:02}", f"{j}") for i in range(20) for j in range(3)]


def test_evaluation_outputs_and_averages(spark, tmp_path):
    results = spark.createDataFrame([("p1", True), ("p1", False), ("p2", True)], "prompt string, passed boolean")
    out = export.save_evaluation(results, str(tmp_path), ["prompt"])
    assert spark.read.json(out["summary"]).first()["pass_rate"] == 66.67
    assert {r["prompt"]: r["failed"] for r in spark.read.json(out["groups"]).collect()} == {"p1": 1, "p2": 0}
    assert summary.evaluation_summary(results.limit(0)).first()["pass_rate"] == 0.0
    d = spark.createDataFrame([(1, [("abc",), (None,)]), (2, [])], "doc_id long, pages array<struct<text:string>>")
    got = {r["doc_id"]: (r["total_chars"], r["chars_per_page"]) for r in summary.page_averages(d).collect()}
    assert got == {1: (3, 1.5), 2: (0, 0.0)}
    assert summary.toc_success(d, d.where("doc_id = 1")).first()["success_rate"] == 50.0


def test_toc_entry_forms(spark):
    lines = ["Intro ..... 4", "Plan ---- 5", "Ends ____ 6", "1.2 Scope 7", "IV. Results 8", "[3] Notes 9", "Глава страница 10", "• Bullet 11", "Plain title 12"]
    want = [("Intro", 4), ("Plan", 5), ("Ends", 6), ("Scope", 7), ("Results", 8), ("Notes", 9), ("Глава", 10), ("Bullet", 11), ("Plain title", 12)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, l string").select("i", toc.entry_parts(F.col("l")).alias("p")).orderBy("i").collect()
    assert [(r["p"]["title"], r["p"]["page"]) for r in got] == want


def test_isbn_is_the_first_run(spark):
    d = spark.createDataFrame([("tel 0123456789 ISBN 978-3-16-148410-0",), ("ISBN-13: 978-3-16-148410-0",), ("none",), (None,)], "t string")
    assert [r[0] for r in d.select(metadata.isbn("t")).collect()] == ["0123456789", "13:9783161484100", None, None]  # the label's own number stays, as inventoried
    assert d.select(metadata.isbn("t", labelled_first=True)).first()[0] == "9783161484100"


def test_many_duplicate_paragraphs(spark):
    text = "\n\n".join(f"a paragraph of number {i % 700}" if i % 3 else "short" for i in range(4000))
    seen, want = set(), []
    for p in text.split("\n\n"):
        if len(p) < 15 or p not in seen:
            want.append(p)
            seen.add(p)
    assert spark.createDataFrame([(text,)], "t string").select(T.drop_duplicate_paragraphs("t")).first()[0] == "\n\n".join(want)
