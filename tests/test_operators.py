import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from folium.functions import toc, vectors as V
from folium.operators import retrieval as R, spelling
from folium.plans import process, rag, summary
from folium.sinks import export
from folium.sources import files, processed


def test_toc(spark):
    rows = spark.createDataFrame(
        [(1, "Contents\n\nIntro .... 1\n\nMethods .... 2\n\nResults .... 9"), (2, "nothing here"), (3, None), (4, "Index\n\n1 One 1\n\n1.1.1 Deep 3\n\n2 Two 9")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toc.detect(rows).collect()}
    assert set(got) == {1, 4} and [e["page"] for e in got[1]["entries"]] == [1, 2, 9] and got[1]["title"] == "Contents"
    assert [e["level"] for e in got[4]["entries"]] == [0, 1, 0]
    assert toc.fix_levels([("1", 0), ("1.1", 0), ("1.1.1", 0), ("2", 0), ("1.1.1", 0)]) == [0, 1, 2, 0, 1]


def test_spelling(spark):
    words = ["AI", "jazz", "Rome", "x1", "recieve", "RECIEVE"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", spelling.eligible("w").alias("ok"))
    assert [r["w"] for r in rows.collect() if r["ok"]] == ["recieve", "RECIEVE"]
    dictionary = spark.createDataFrame([("receive", 10), ("relieve", 3), ("house", 50)], "term string, frequency long")
    docs = spark.createDataFrame([(1, "They recieve, RECIEVE the hous."), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in spelling.correct_documents(docs, dictionary).collect()}
    assert got[1]["text"] == "They receive, RECEIVE the house." and got[2]["text"] is None and got[3]["text"] == ""
    d = spark.range(1).select(spelling.difference(F.lit("abcd"), F.lit("abxd")).alias("d")).first()["d"]
    assert (d["count"], d["percent"]) == (1, 25.0)
    c = spark.range(1).select(spelling.scan_candidates(F.lit("moon")).alias("c")).first()["c"]
    assert "rnoon" in c and "Moon" in c
    words = spark.createDataFrame([("hous",), ("receive",)], "word string")
    assert {tuple(r) for r in spelling.backend("none", "closest")(words, dictionary).collect()} == {("hous", "house")}
    assert {tuple(r) for r in spelling.apply_provider(words, lambda w: w + "e" if w == "hous" else w).collect()} == {("hous", "house")}
    near = spelling.frequent_candidates(spark.createDataFrame([("hoase",)], "word string"), dictionary)
    assert near.count() == 0


def test_vectors_and_knn(spark):
    v = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(np.eye(4))] + [(9, [0.0] * 4)], "vec_id long, embedding array<float>")
    assert spark.range(1).select(V.l2_score(F.lit(0.0)).alias("a"), V.l2_score(F.lit(4.0)).alias("b")).first() == (1.0, -1.0)
    hits = R.knn(v, v.where("vec_id = 2").withColumn("query_id", F.col("vec_id")), 2).orderBy("rank").collect()
    assert hits[0]["vec_id"] == 2 and hits[0]["score"] == 1.0
    zero = v.where("vec_id = 9").select(V.cosine("embedding", "embedding").alias("c")).first()["c"]
    assert zero is None
    assert R.knn(v.limit(0), v.withColumn("query_id", F.col("vec_id")), 2).count() == 0


def test_rerank(spark):
    hits = spark.createDataFrame([(0, 1, 0.80, 0.3), (0, 2, 0.70, 0.9), (0, 3, 0.95, 0.5), (0, 4, 0.60, None)], "query_id int, rank int, score double, similarity double")
    got = R.rerank(hits, partition=["query_id"]).orderBy("new_rank").collect()
    assert [(r["rank"], round(r["score"], 6)) for r in got] == [(3, 1.0), (2, 0.88), (4, 0.6)]


def docx(texts):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in texts) + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def xlsx():
    s, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{s}"><si><t>x</t></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{s}"><sheetData><row><c t="s"><v>0</v></c><c><v>7</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Plain text, é.", "utf-8")
    (tmp_path / "b.html").write_text("<html><head><title>T</title><meta name='k' content='v'><script>x()</script></head><body><p>One</p><p> Two </p></body></html>")
    (tmp_path / "c.rtf").write_text(r"{\rtf1 Hello \b bold\b0 }")
    (tmp_path / "technical_manual.docx").write_bytes(docx(["First", "Second"]))
    (tmp_path / "e.xlsx").write_bytes(xlsx())
    (tmp_path / "f.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "g.xyz").write_text("no")
    listed = files.list_files(spark, str(tmp_path))
    got = {r["filename"]: r for r in files.extract(listed).collect()}
    assert set(got) == {"a.txt", "b.html", "c.rtf", "technical_manual.docx", "e.xlsx", "f.pdf"}
    assert got["a.txt"]["text"] == "Plain text, é." and got["b.html"]["text"] == "T\nOne\nTwo" and got["b.html"]["meta"]["k"] == "v"
    assert "Hello" in got["c.rtf"]["text"] and "\\" not in got["c.rtf"]["text"]
    assert got["technical_manual.docx"]["text"] == "First\n\nSecond\n\na | b" and got["technical_manual.docx"]["format_hints"] == ["technical"]
    assert got["e.xlsx"]["text"] == "Sheet: One\nx | 7" and got["f.pdf"]["success"] is False
    with_pdf = files.extract(listed.where("extension = '.pdf'"), pdf=lambda b: ["page one", "page two"]).first()
    assert with_pdf["text"] == "page one\n\npage two" and len(with_pdf["pages"]) == 2
    out = process.process_directory(spark, str(tmp_path))
    assert out["documents"].count() == 5 and out["chunks"].count() >= 5


def test_config_and_prompts(spark, tmp_path):
    (tmp_path / "c.toml").write_text('[rag]\ntop_k = 9\n[segmentation]\nname = "k${rag.top_k}"\n')
    c = processed.load_config(str(tmp_path / "c.toml"))
    assert c["rag"]["top_k"] == 9 and c["rag"]["summary_weight"] == 0.3 and c["segmentation"]["name"] == "k9"
    (tmp_path / "p.json").write_text('{"prompts": ["q one"], "tests": [{"description": "d", "assert": [{"type": "contains-any", "value": ["a"]}]}]}')
    prompts, assertions = processed.read_prompts(spark, str(tmp_path / "p.json"))
    assert prompts.count() == 1 and assertions.first()["value"] == ["a"]
    assert processed.check_prompt_set({"variants": [{"name": "v", "config": {"model": "x"}}]}) == ["v: no chunking_strategy", "v: model is not a variant's setting"]


def test_index_roundtrip_and_rag(spark, tmp_path):
    chunks = spark.createDataFrame(
        [("d1", "chunk_1", "Parquet files are columnar. Readers skip columns.", "Parquet is columnar.", "D1"), ("d2", "chunk_1", "Cats sleep all day long.", None, "D2")],
        "document_id string, chunk_id string, text string, summary string, title string")
    export.save_index(rag.build_index(chunks), str(tmp_path / "i"))
    index = export.load_index(spark, str(tmp_path / "i"), "hashing-384")
    with pytest.raises(ValueError):
        export.load_index(spark, str(tmp_path / "i"), "other")
    asked = spark.createDataFrame([(1, "are parquet files columnar"), (2, " ")], "query_id long, query string")
    got = {r["query_id"]: r for r in rag.answer(index, asked).collect()}
    assert "Parquet files are columnar." in got[1]["response"] and got[2]["response"] == R.REFUSAL and got[2]["success"] is False
    assert index.join(export.upsert_vectors(index, index.limit(1), ["document_id", "chunk_id"]), "vec_id").count() == 2


def test_streaming_ingest(spark, tmp_path):
    from folium.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("first")
    for n, name in ((1, "b.txt"), (2, "c.txt")):
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "t")).count() == n
        (tmp_path / "in" / name).write_text("second")
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2  # the same content twice is one document


def test_summary(spark):
    events = spark.createDataFrame([("a", "success", 1), ("a", "failed", 2), ("b", "success", 1)], "path string, status string, t int").withColumn("timestamp", F.col("t").cast("timestamp"))
    final = {r["path"]: r["status"] for r in summary.final_events(events).collect()}
    assert final == {"a": "failed", "b": "success"}
    none = spark.createDataFrame([], "success boolean")
    assert summary.directory_summary(none).first()["success_rate"] == 0.0
    some = spark.createDataFrame([(True,)] * 22 + [(False,)] * 2, "success boolean")
    assert summary.directory_summary(some).first()["success_rate"] == 91.67


def test_documents_are_corrected_two_edits_away(spark, tmp_path):
    """Both spelling queries over whole documents, against all pairs of words."""
    from folium import queries

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    common = ["garden", "window", "mountain", "harbour"]
    odd = ["gardne", "wndw", "muontain", "harb", "grdn", "mountains", "zebra", "garden"]
    texts = [" ".join(common)] * 40 + [f"the {w} and {w.upper()}; then" for w in odd] + [" ".join(odd) + " window" * 3, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    frequency = {w: sum((t or "").lower().split().count(w) for t in texts) for w in common}

    def best(w):
        near = [(-frequency[c], edits(w, c), c) for c in common if edits(w, c) <= 2]
        return w if w in common or not near else min(near)[2]

    want = {i: t and " ".join(best(x) for x in t.split()) for i, t in enumerate(texts) if i < 40 or i >= 48}
    want |= {40 + i: f"the {best(w)} and {best(w).upper()}; then" for i, w in enumerate(odd)}
    assert {r["doc_id"]: r["text"] for r in queries.corrected_documents(spark, str(tmp_path)).collect()} == want
    pairs = {tuple(r) for r in queries.document_corrections(spark, str(tmp_path)).collect()}
    assert pairs == {(w, best(w)) for w in odd if best(w) != w}


def test_every_assertion_is_checked(spark):
    from folium.plans import rag

    answers = spark.createDataFrame([(1, "the answer")], "query_id long, response string")
    tests = spark.range(10_001).select(F.lit("contains-any").alias("type"), F.array(F.lit("answer")).alias("value"))
    assert rag.evaluate(answers, tests).where("passed").count() == 10_001
