"""Files as rows: listing, support, hashes, types, and text extraction by type."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folium.functions import fixed
from folium.functions.classify import format_hints, size_class
from folium.sources.pdf import read_pdf

FORMATS = {"pdf": [".pdf"], "word": [".docx", ".doc", ".rtf"], "spreadsheet": [".xlsx", ".xls"], "text": [".txt", ".html", ".htm"],
           "image": [".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp"]}
PAGE = "struct<page_num:int,sheet_name:string,text:string,has_text:boolean>"
EXTRACTED = f"text string, pages array<{PAGE}>, meta map<string,string>, extraction_method string, has_text_layer boolean, success boolean, error string"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def document_type(ext: Column) -> Column:
    out = F.lit("unknown")
    for name, exts in FORMATS.items():
        out = F.when(ext.isin(*exts), name).otherwise(out)
    return out


def list_files(spark: SparkSession, path: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """Supported files below a path (or one file): path, content and what is known of them.

    The content column is read only where it is used.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return describe(reader.load(path)).where("supported")


def describe(files: DataFrame) -> DataFrame:
    """File metadata and type information; an extension that lies is overruled by the content's first bytes."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    ext = extension(F.col("path"))
    magic = F.hex(F.substring("content", 1, 4))
    types = F.create_map(*[F.lit(x) for pair in fixed.EXTENSIONS.items() for x in pair])
    sniffed = (
        F.when(F.startswith(magic, F.lit("25504446")), "application/pdf").when(F.startswith(magic, F.lit("89504E47")), "image/png")
        .when(F.startswith(magic, F.lit("FFD8FF")), "image/jpeg").when(F.startswith(magic, F.lit("7B5C7274")), "application/rtf")
    )
    mime = F.coalesce(sniffed, F.try_element_at(types, ext))
    return files.select(
        "path", name.alias("filename"), ext.alias("extension"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"),
        F.sha2("content", 256).alias("hash"), mime.alias("mime_type"), document_type(ext).alias("document_type"), format_hints(name).alias("format_hints"),
        size_class(F.col("length")).alias("size_class"), (ext.isin(*fixed.EXTENSIONS) | sniffed.isNotNull()).alias("supported"), "content",
    )


# --- text of one file ---------------------------------------------------------------------------


class _Text(HTMLParser):
    """Text nodes, meta tags and the title of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.meta: dict[str, str] = {}
        self.skip = 0
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        self.in_title = tag == "title"
        a = dict(attrs)
        name = a.get("name") or a.get("property")
        if tag == "meta" and name and a.get("content"):
            self.meta[name] = a["content"]

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in ("script", "style")))
        self.in_title = False if tag == "title" else self.in_title

    def handle_data(self, data):
        if self.in_title:
            self.meta["title"] = self.meta.get("title", "") + data
        if not self.skip:
            self.parts.append(data)


def html_text(source: str | None) -> tuple[str, dict[str, str]]:
    """Lines of text between tags, blank ones dropped, and the page's meta tags."""
    parser = _Text()
    parser.feed(source or "")
    parser.close()
    lines = (line.strip() for line in "\n".join(parser.parts).split("\n"))
    return "\n".join(line for line in lines if line), parser.meta


def decode(content: bytes) -> tuple[str, str]:
    """Text and the encoding that fits: a byte-order mark, UTF-8, else Windows-1252 with replacements."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return content.decode(name, "replace"), name
    try:
        return content.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        return content.decode("cp1252", "replace"), "cp1252"


def rtf_text(source: str) -> str:
    """RTF without control words: ``\\word``, ``\\'hh`` and ``\\x`` go."""
    return re.sub(r"\\(?:[^\W\d_]+|'.{0,2}|.|$)", "", source, flags=re.S)


def strip_rtf(source: Column) -> Column:
    return F.regexp_replace(source, r"(?s)\\(?:\p{L}+|'.{0,2}|.|$)", "")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def docx_text(content: bytes) -> tuple[str, dict[str, str]]:
    """Paragraphs, then table rows joined by bars; core properties as metadata."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        say = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
        parts = [t for p in body.findall(f"{_W}p") if (t := say(p)).strip()]
        for row in body.iter(f"{_W}tr"):
            cells = [say(c).strip() for c in row.findall(f"{_W}tc")]
            if any(cells):
                parts.append(" | ".join(cells))
        meta = {}
        if "docProps/core.xml" in z.namelist():
            for e in ElementTree.fromstring(z.read("docProps/core.xml")):
                if e.text:
                    meta[e.tag.rpartition("}")[2]] = e.text
    return "\n\n".join(parts), meta


def xlsx_sheets(content: bytes) -> list[tuple[str, str]]:
    """(name, rows joined by bars) of every sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            target = links[sheet.get(f"{_R}id")].lstrip("/")
            rows = []
            for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_S}row"):
                cells = []
                for c in row.findall(f"{_S}c"):
                    v = c.find(f"{_S}v")
                    inline = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    cells.append(shared[int(v.text)] if v is not None and c.get("t") == "s" else (v.text or "") if v is not None else inline)
                if any(cells):
                    rows.append(" | ".join(cells))
            out.append((sheet.get("name"), "\n".join(rows)))
    return out


Provider = Callable[[bytes], list[str]]


def extract_one(content: bytes, ext: str, pdf: Provider | None, ocr: Provider | None) -> dict:
    """The extraction row of one file; what fails is told in ``error``, never raised."""
    row = {"text": "", "pages": None, "meta": {}, "extraction_method": None, "has_text_layer": True, "success": True, "error": None}
    try:
        if ext in (".html", ".htm"):
            source, encoding = decode(content)
            text, meta = html_text(source)
            return row | {"text": text, "meta": meta | {"encoding": encoding}, "extraction_method": "html"}
        if ext == ".txt":
            text, encoding = decode(content)
            return row | {"text": text, "meta": {"encoding": encoding}, "extraction_method": "text"}
        if ext == ".rtf":
            return row | {"text": rtf_text(decode(content)[0]), "extraction_method": "rtf"}
        if ext == ".docx":
            text, meta = docx_text(content)
            return row | {"text": text, "meta": meta, "extraction_method": "docx"}
        if ext == ".xlsx":
            sheets = xlsx_sheets(content)
            pages = [{"page_num": i + 1, "sheet_name": n, "text": t, "has_text": bool(t)} for i, (n, t) in enumerate(sheets)]
            return row | {"text": "\n\n".join(f"Sheet: {n}\n{t}" for n, t in sheets), "pages": pages, "extraction_method": "excel"}
        if ext == ".pdf":
            texts = (pdf or read_pdf)(content)
            method, layer = "pdf", any(t.strip() for t in texts)
            if not layer and ocr:
                texts, method = ocr(content), "pdf_ocr"
            if not any(t.strip() for t in texts):
                return row | {"success": False, "has_text_layer": False, "extraction_method": "pdf", "error": "no text layer, and no OCR provider gave text"}
            pages = [{"page_num": i + 1, "sheet_name": None, "text": t, "has_text": bool(t.strip())} for i, t in enumerate(texts)]
            return row | {"text": "\n\n".join(texts), "pages": pages, "extraction_method": method, "has_text_layer": layer}
        if ext in FORMATS["image"]:
            if not ocr:
                return row | {"success": False, "has_text_layer": False, "extraction_method": "image_ocr", "error": "no OCR provider"}
            return row | {"text": "\n\n".join(ocr(content)), "has_text_layer": False, "extraction_method": "image_ocr"}
        return row | {"success": False, "error": f"unsupported type {ext or 'none'}"}
    except Exception as e:  # a bad file is a row of its own
        return row | {"success": False, "error": f"{type(e).__name__}: {e}"[:500]}


def extract(files: DataFrame, pdf: Provider | None = None, ocr: Provider | None = None) -> DataFrame:
    """Described files -> documents: one row per file, with ``success`` and ``error``.

    ``pdf`` and ``ocr`` are providers from bytes to texts by page.  Without ``pdf`` the text layer is read by
    ``sources.pdf``; without ``ocr`` images and scanned PDF files are error rows.
    """
    kept = [c for c in files.columns if c != "content"]
    kinds = dict(files.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [extract_one(bytes(c), e, pdf, ocr) for c, e in zip(batch["content"], batch["extension"], strict=True)]
            got = pd.DataFrame(rows, columns=["text", "pages", "meta", "extraction_method", "has_text_layer", "success", "error"], index=batch.index)
            for c in ("text", "extraction_method", "error"):
                got[c] = got[c].astype(object)
            yield pd.concat([batch[kept], got], axis=1)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", " + EXTRACTED
    return files.mapInPandas(run, schema)


def page_filter(pages: Column, every: int = 1, most: int | None = None) -> Column:
    """Every n-th page of the first ``most``."""
    bound = lambda p: (p["page_num"] <= most) if most else F.lit(True)
    return F.filter(pages, lambda p: ((p["page_num"] - 1) % every == 0) & bound(p))
