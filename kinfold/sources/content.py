"""Text of files by their extension, in Arrow batches; formats whose libraries are absent give null."""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: names of the elements that hold text
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_ODF = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
TEXT_LIMIT, BYTES_LIMIT = 90_000_000, 100_000_000
# fixed values: the share of filled cells of a header, rows of a sheet that may be one, entries of a document that name people
FILLED, HEADER_ROWS, HASHED = 0.9, 10, ("author", "creator")
# fixed values: what native documents are exported as
EXPORTS = {
    "application/vnd.google-apps.document": "txt", "application/vnd.google-apps.spreadsheet": "xlsx", "application/vnd.google-apps.presentation": "pptx",
}


def _docx(b: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(b)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in root.iter(f"{_WORD}p"))
    return "\n\n".join(p for p in paragraphs if p)


def _odf(b: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(b)) as z:
        root = ElementTree.fromstring(z.read("content.xml"))
    # the text nodes right below a paragraph, those of elements inside it left out
    nodes = (t for p in root.iter(f"{_ODF}p") for t in (p.text, *(c.tail for c in p)) if t)
    return " ".join(nodes)


def _sheets(b: bytes) -> list[list[list[tuple[str, bool]]]]:
    """The rows of every sheet of a workbook as (value, whether it is text) by cell."""
    with zipfile.ZipFile(io.BytesIO(b)) as z:
        names = z.namelist()
        shared = ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in names else []
        strings = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in shared]
        out = []
        for name in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0])):
            rows = []
            for row in ElementTree.fromstring(z.read(name)).iter(f"{_SHEET}row"):
                cells = []
                for c in row.iter(f"{_SHEET}c"):
                    value, kind = c.findtext(f"{_SHEET}v") or "", c.get("t")
                    if kind == "s" and value:
                        cells.append((strings[int(value)], True))
                    elif kind == "inlineStr":
                        cells.append(("".join(t.text or "" for t in c.iter(f"{_SHEET}t")), True))
                    else:
                        cells.append((value, kind == "str"))
                rows.append(cells)
            out.append(rows)
    return out


def _xlsx(b: bytes) -> str:
    return " ".join(" ".join(v for v, is_text in row if is_text) for sheet in _sheets(b) for row in sheet)


def _filled(rows: list[list[str]]) -> list[str]:
    """The filled cells of the first row that has any, if more than FILLED of its cells are."""
    for row in rows:
        full = [v for v in row if v != ""]
        if full:
            return full if len(full) > FILLED * len(row) else []
    return []


def workbook_header(b: bytes) -> list[str]:
    """Header cells of all sheets of a workbook, each looked for in its first HEADER_ROWS rows, cleaned."""
    cells = [v for sheet in _sheets(b) for v in _filled([[v for v, _ in row] for row in sheet[:HEADER_ROWS]])]
    return [c for c in (re.sub(r"[\W_]+", "", v).lower() for v in cells) if c]


_PDF_STRING = re.compile(rb"\((?:\\.|[^\\()])*\)", re.S)


def _pdf_string(raw: bytes) -> bytes:
    """The bytes of a literal string, its escapes resolved."""
    named = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}

    def one(m: re.Match) -> bytes:
        c = m.group(1)
        return bytes([int(c, 8) & 255]) if c.isdigit() else named.get(c, c)

    return re.sub(rb"\\([0-7]{1,3}|.)", one, raw[1:-1], flags=re.S)


def _pdf(b: bytes) -> str:
    """The literal strings that a PDF's plain or deflated content streams show, a line for each text object."""
    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", b, re.S):
        raw = m.group(1)
        try:
            raw = zlib.decompress(raw)
        except zlib.error:
            pass
        for block in re.findall(rb"\bBT\b(.*?)\bET\b", raw, re.S):
            shown = re.findall(rb"(\[(?:\\.|[^\]])*\]|\((?:\\.|[^\\()])*\))\s*(?:TJ|Tj|'|\")", block, re.S)
            out.append("".join(_pdf_string(x).decode("latin-1") for s in shown for x in _PDF_STRING.findall(s)))
    return "\n".join(x for x in out if x)


def pdf_metadata(b: bytes) -> dict[str, str]:
    """The entries of a PDF's information dictionary that are literal strings; names of people only as their SHA-256."""
    ref = re.search(rb"/Info\s+(\d+)\s+(\d+)\s+R", b)
    found = ref and re.search(rb"(?<!\d)%s\s+%s\s+obj\s*<<(.*?)>>\s*endobj" % (ref[1], ref[2]), b, re.S)
    out = {}
    for key, raw in re.findall(rb"/(\w+)\s*(\((?:\\.|[^\\()])*\))", found[1], re.S) if found else ():
        name, value = key.decode("latin-1"), _pdf_string(raw)
        try:
            out[name] = hashlib.sha256(value).hexdigest() if name.lower() in HASHED else value.decode("utf-8")
        except UnicodeDecodeError:
            out[name] = ""
    return out


def _pptx(b: bytes) -> str:
    out = []
    with zipfile.ZipFile(io.BytesIO(b)) as z:
        slides = [n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)]
        for name in sorted(slides, key=lambda n: int(re.search(r"\d+", n)[0])):
            root = ElementTree.fromstring(z.read(name))
            out += ["".join(t.text or "" for t in p.iter(f"{_DRAW}t")) for p in root.iter(f"{_DRAW}p")]
    return "\n".join(x for x in out if x)


class _Bare(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def _html(b: bytes) -> str:
    bare = _Bare()
    bare.feed(b.decode("utf-8", "replace"))
    return re.sub(r"\s+", " ", " ".join(bare.out)).strip()


def _plain(b: bytes) -> str:
    return b.decode("utf-8", "replace")


def _markdown(b: bytes) -> str:
    bare = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", _plain(b))
    return re.sub(r"(?m)^\s{0,3}(#{1,6}\s+|>\s?|[-*+]\s+)|[*_`]{1,3}", "", bare).strip()


READERS: dict[str, Callable[[bytes], str]] = {
    "txt": _plain, "tex": _plain, "csv": lambda b: _plain(b).replace(",", " "), "tsv": lambda b: _plain(b).replace("\t", " "), "docx": _docx, "odt": _odf, "ods": _odf,
    "odp": _odf, "xlsx": _xlsx, "pdf": _pdf, "pptx": _pptx, "html": _html, "htm": _html, "xhtml": _html, "md": _markdown, "rtf": lambda b: "", "json": lambda b: "",
}


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def one(ext: str | None, content: bytes | None) -> tuple[str | None, str | None]:
        reader = READERS.get((ext or "").lower())
        if reader is None or content is None or len(content) > BYTES_LIMIT:
            return None, None
        try:
            return reader(bytes(content))[:TEXT_LIMIT], None
        except (KeyError, IndexError, ValueError, zipfile.BadZipFile, ElementTree.ParseError) as e:
            return None, f"{type(e).__name__}: {e}"[:200]

    for pdf in batches:
        found = [one(e, c) for e, c in zip(pdf["ext"], pdf["content"])]
        yield pd.DataFrame({"path": pdf["path"], "ext": pdf["ext"], "text": [t for t, _ in found], "error": [e for _, e in found]})


def texts(files: DataFrame) -> DataFrame:
    """(path, ext, text, error) of binary files (path, content): text is null for formats that aren't read or files that are
    too long or broken; the latter have an error."""
    rows = files.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"), "content")
    return rows.mapInPandas(_extract, "path string, ext string, text string, error string")


def binary_files(spark: SparkSession, folder: str, limit: int = BYTES_LIMIT) -> DataFrame:
    """(path, content) of all files below a folder up to a size; larger ones aren't opened."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.col("length") <= limit).select("path", "content")


def walk(spark: SparkSession, folder: str, scope: str = "") -> DataFrame:
    """(user_id, id, name, parent_id, file_extension, size, last_modified): the files below a folder as a listing; none is opened.

    id and parent_id are paths below the folder; those right below it lie in 'root'.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    root = folder.rstrip("/").removeprefix("file://").removeprefix("file:")
    below = F.expr(f"substring(path, instr(path, '{root}/') + {len(root) + 1})")
    parts = F.split(below, "/")
    parent = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    name = F.element_at(parts, -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return found.select(
        F.lit(scope).alias("user_id"), below.alias("id"), name.alias("name"), F.when(parent == "", "root").otherwise(parent).alias("parent_id"), ext.alias("file_extension"), F.col("length").alias("size"),
        F.unix_seconds("modificationTime").alias("last_modified"),
    )


def _described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        kinds = pdf["path"].str.extract(r"\.([^./]+)$", expand=False).str.lower()
        meta = [json.dumps(pdf_metadata(bytes(c)), sort_keys=True) if k == "pdf" and c is not None else None for k, c in zip(kinds, pdf["content"])]
        heads = []
        for k, c in zip(kinds, pdf["content"]):
            try:
                heads.append(workbook_header(bytes(c)) if k == "xlsx" and c is not None else None)
            except (KeyError, IndexError, ValueError, zipfile.BadZipFile, ElementTree.ParseError):
                heads.append(None)
        yield pd.DataFrame({"path": pdf["path"], "metadata": meta, "header": heads})


def described(files: DataFrame) -> DataFrame:
    """(path, metadata, header) of binary files (path, content): a PDF's information as JSON, a workbook's header cells; null for
    other files and broken workbooks."""
    return files.select("path", "content").mapInPandas(_described, "path string, metadata string, header array<string>")


def header_row(content: Column, delimiter: str = ",") -> Column:
    """Cells of the first line that isn't blank, cleaned, if more than nine tenths of them are filled; else none."""
    lines = F.filter(F.split(content, r"\r?\n"), lambda x: F.trim(F.replace(x, F.lit(delimiter), F.lit(""))) != "")
    cells = F.split(F.get(lines, F.lit(0)), re.escape(delimiter))
    clean = F.filter(F.transform(cells, lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))), lambda c: c != "")
    return F.when(F.size(clean) > 0.9 * F.size(cells), clean).otherwise(F.array().cast("array<string>"))
