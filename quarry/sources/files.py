"""Document files: DOCX and PDF bytes to segments, corpus folders, gold sets."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import assembled, assembled_text
from quarry.sources.work import python_ready

SEGMENTS = "array<struct<text:string,char_start:int,page_number:int,section_title:string,metadata:map<string,string>>>"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class UnsupportedFile(ValueError):
    """A file of a kind that is not read here."""


class UnreadableFile(ValueError):
    """A file that is damaged, locked or empty."""


def _segment(text: str, page: int | None = None, section: str | None = None, **metadata) -> dict:
    return {"text": text, "char_start": 0, "page_number": page, "section_title": section, "metadata": {k: str(v) for k, v in metadata.items()}}


def _clean(text: str) -> str:
    return " ".join(text.split())


def read_docx(data: bytes) -> tuple[str | None, list[dict], dict[str, str]]:
    """(title, segments, metadata): a heading begins a section; paragraphs and tables follow it in order."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
            core = ElementTree.fromstring(archive.read("docProps/core.xml")) if "docProps/core.xml" in archive.namelist() else None
            styles = ElementTree.fromstring(archive.read("word/styles.xml")) if "word/styles.xml" in archive.namelist() else None
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as bad:
        raise UnreadableFile("the DOCX file is damaged") from bad
    names = {s.get(f"{_W}styleId"): s.find(f"{_W}name").get(f"{_W}val", "") for s in (styles.iter(f"{_W}style") if styles is not None else ()) if s.find(f"{_W}name") is not None}
    words = lambda node: _clean("".join({f"{_W}t": x.text or "", f"{_W}tab": " ", f"{_W}br": " "}.get(x.tag, "") for x in node.iter()))
    sections, held, title, first, tables = [], [], None, 0, 0

    def close(last: int) -> None:
        if held:
            sections.append(_segment("\n\n".join(held), section=title, block_start=first, block_end=last))

    blocks = [x for x in (body if body is not None else ()) if x.tag in (f"{_W}p", f"{_W}tbl")]
    for i, block in enumerate(blocks):
        if block.tag == f"{_W}tbl":
            tables += 1
            rows = [[words(c) for c in row.iter(f"{_W}tc")] for row in block.iter(f"{_W}tr")]
            if text := "\n".join(" | ".join(r) for r in rows if any(r)):
                held.append(text)
            continue
        style = block.find(f"{_W}pPr/{_W}pStyle")
        style_id = style.get(f"{_W}val", "") if style is not None else ""
        text = words(block)
        if not text:
            continue
        if names.get(style_id, style_id).lower().startswith("heading"):
            close(i - 1)
            held, title, first = [text], text, i
        else:
            held.append(text)
    close(len(blocks) - 1)
    named = next((x.text for x in core.iter() if x.tag.endswith("}title") and x.text), None) if core is not None else None
    return named, sections, {"table_count": str(tables), "section_count": str(len(sections))}


_STRING = re.compile(rb"\(((?:\\.|[^\\()])*)\)|<([0-9A-Fa-f\s]*)>")
# a string or an array, perhaps shown, or numbers and an operator that moves
_STEP = re.compile(rb"(\[(?:\\.|\((?:\\.|[^\\()])*\)|[^\]])*\]|\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)(?:\s*(TJ|Tj|'|\"))?|((?:[-+]?[\d.]+\s+){0,6})(T\*|(?:BT|ET|Tm|Td|TD|TL|cm|q|Q)(?![\w*]))")
_UNMOVED = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
#: Texts whose heights differ by less are on one line.
SAME_LINE = 2.0
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}


def _literal(found: re.Match) -> str:
    if found[2] is not None:
        digits = re.sub(rb"\s", b"", found[2])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], m[1]), found[1], flags=re.S)
    return raw.decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


def _after(m: tuple[float, ...], n: tuple[float, ...]) -> tuple[float, ...]:
    """The matrix that does m, then n."""
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def _placed(content: bytes) -> list[tuple[float, float, str]]:
    """(height, distance from the left, text) of what a page's content shows between moves."""
    page, line, leading, kept, out, moved = _UNMOVED, _UNMOVED, 0.0, [], [], True
    for m in _STEP.finditer(content):
        if m[1]:
            if not m[2]:
                continue  # an operand of something else
            if m[2] in b"'\"":
                line, moved = _after((*_UNMOVED[:4], 0.0, -leading), line), True
            said = "".join(_literal(x) for x in _STRING.finditer(m[1]))
            if moved:
                *_, x, y = _after(line, page)
                out.append((y, x, said))
            else:
                out[-1] = (*out[-1][:2], out[-1][2] + said)
            moved = False
            continue
        name = m[4]
        try:
            told = [float(x) for x in m[3].split()]
        except ValueError:
            continue
        if name == b"q":
            kept.append(page)
        elif name == b"Q":
            page = kept.pop() if kept else page
        elif name == b"TL":
            leading = told[-1] if told else leading
        elif name in (b"Tm", b"cm") and len(told) == 6:
            line, page = (tuple(told), page) if name == b"Tm" else (line, _after(tuple(told), page))
        elif name in (b"Td", b"TD") and len(told) >= 2:
            leading = -told[-1] if name == b"TD" else leading
            line = _after((*_UNMOVED[:4], *told[-2:]), line)
        elif name == b"T*":
            line = _after((*_UNMOVED[:4], 0.0, -leading), line)
        elif name == b"BT":
            line = _UNMOVED
        moved = moved or name not in (b"q", b"Q", b"TL")
    return [x for x in out if x[2].strip()]


def reading_order(content: bytes) -> str:
    """A page's text from top to bottom, each line from left to right; what stands at one place is a line each, as written."""
    lines: list[list[tuple[float, float, str]]] = []
    for piece in sorted(_placed(content), key=lambda p: -p[0]):
        if lines and lines[-1][0][0] - piece[0] < SAME_LINE and all(piece[1] != p[1] for p in lines[-1]):
            lines[-1].append(piece)
        else:
            lines.append([piece])
    return "\n".join(" ".join(p[2].strip() for p in sorted(line, key=lambda p: p[1])) if len(line) > 1 else line[0][2] for line in lines)


def read_pdf(data: bytes) -> tuple[str | None, list[dict], dict[str, str]]:
    """(title, one segment a page, metadata) of a simple PDF: text operators of its content streams, in reading order.

    Fonts with encodings of their own need a full parser, which `register_reader` can add.
    """
    if not data.startswith(b"%PDF-"):
        raise UnreadableFile("the PDF file is damaged")
    if re.search(rb"/Encrypt\s*(?:\d+\s+\d+\s+R|<<)", re.sub(rb"\bstream\r?\n.*?\bendstream|\((?:\\.|[^\\()])*\)", b"", data, flags=re.S)):
        raise UnreadableFile("the PDF file is protected by a password")
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data, re.S)}

    def stream(body: bytes) -> bytes:
        found = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
        if not found:
            return b""
        try:
            return zlib.decompress(found[1]) if b"/FlateDecode" in body else found[1]
        except zlib.error as bad:
            raise UnreadableFile("the PDF file is damaged") from bad

    for body in [b for b in objects.values() if b"/ObjStm" in b]:
        packed = stream(body)
        count, start = int(re.search(rb"/N\s+(\d+)", body)[1]), int(re.search(rb"/First\s+(\d+)", body)[1])
        heads = [int(x) for x in packed[:start].split()][: 2 * count]
        ends = [*heads[3::2], len(packed) - start]
        for number, at, end in zip(heads[::2], heads[1::2], ends, strict=True):
            objects.setdefault(number, packed[start + at : start + end])

    def pages(number: int, seen: frozenset[int] = frozenset()) -> list[bytes]:
        body = objects.get(number, b"")
        if number in seen:
            return []
        if kids := re.search(rb"/Kids\s*\[(.*?)\]", body, re.S):
            return [p for k in re.findall(rb"(\d+)\s+\d+\s+R", kids[1]) for p in pages(int(k), seen | {number})]
        return [body] if re.search(rb"/Type\s*/Page\b", body) else []

    root = next((int(m[1]) for b in objects.values() if re.search(rb"/Type\s*/Catalog\b", b) and (m := re.search(rb"/Pages\s+(\d+)", b))), None)
    if root is None:
        raise UnreadableFile("the PDF file is damaged")
    segments = []
    for i, page in enumerate(pages(root)):
        found = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.S)
        parts = re.findall(rb"(\d+)\s+\d+\s+R", found[1]) if found else ()
        segments.append(_segment(reading_order(b"\n".join(stream(objects.get(int(n), b"")) for n in parts)), page=i + 1, page_index=i))
    told = {k: _literal(_STRING.match(m[1])) for k in ("Title", "Author", "Subject", "Keywords") if (m := re.search(rb"/" + k.encode() + rb"\s*(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)", data, re.S))}
    return told.get("Title"), segments, {"page_count": str(len(segments))} | {k.lower(): v for k, v in told.items() if k != "Title"}


_readers = {".docx": read_docx, ".pdf": read_pdf}


def register_reader(suffix: str, read) -> None:
    """Replace the reader of a suffix, for example by a full PDF parser."""
    _readers[suffix.lower()] = read


def read_document(name: str, data: bytes) -> dict:
    """Title, format, segments and metadata of a file; the suffix decides, whatever its case."""
    path = PurePosixPath(name)
    suffix = path.suffix.lower()
    if suffix not in _readers:
        raise UnsupportedFile("Unsupported file type. Only PDF and DOCX are allowed.")
    title, segments, metadata = _readers[suffix](data)
    return {"title": _clean(title or "") or path.stem or "Untitled document", "source_format": suffix[1:], "segments": segments, "metadata": metadata}


def read_files(spark: SparkSession, path: str, most_bytes: int | None = None) -> DataFrame:
    """One row per file below path: name, sha256 of the bytes, and what it holds or why not.

    Texts are normalised, empty segments dropped, and character offsets counted here.
    """
    python_ready(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    @F.pandas_udf(f"title string, source_format string, segments {SEGMENTS}, metadata map<string,string>, error string")
    def run(names: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = []
        for name, data in zip(names, contents, strict=True):
            try:
                got = read_document(name, bytes(data))
                rows.append((got["title"], got["source_format"], got["segments"], got["metadata"], None))
            except ValueError as bad:
                rows.append((None, None, None, None, str(bad)))
        return pd.DataFrame(rows, columns=["title", "source_format", "segments", "metadata", "error"])

    small = F.lit(True) if most_bytes is None else F.col("length") <= most_bytes
    name = F.element_at(F.split("path", "/"), -1)
    got = files.filter(small).withColumn("got", run(name, "content"))
    kept = got.withColumn("segments", assembled(F.coalesce("got.segments", F.array().cast(SEGMENTS))))
    text = assembled_text(F.col("segments"))
    read = kept.select(name.alias("original_filename"), F.col("length").alias("file_size_bytes"), F.sha2("content", 256).alias("sha256"), "got.title", "got.source_format", "segments", text.alias("text"), "got.metadata", F.coalesce("got.error", F.when(F.length(text) == 0, "the document has no text")).alias("error"))
    if most_bytes is None:
        return read
    large = files.filter(~small).select(name.alias("original_filename"), F.col("length").alias("file_size_bytes"), F.lit("the file is too large").alias("error"))
    return read.unionByName(large, allowMissingColumns=True)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id (the file name), text: a folder of .txt files, stripped; an empty one is an error."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt")
    rows = rows.select(F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1).alias("chunk_id"), F.regexp_replace("value", r"^(?U)\s+|(?U)\s+$", "").alias("text"))
    return rows.withColumn("text", F.when(F.length("text") > 0, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("empty corpus file "), F.col("chunk_id")))))


def read_gold(spark: SparkSession, path: str, least: int = 8) -> tuple[DataFrame, DataFrame]:
    """(query_id, text, note) and (query_id, document_id) of a JSON list of queries with their relevant files."""
    rows = spark.read.schema("query string, relevant_files array<string>, note string").json(path, multiLine=True)
    rows = rows.withColumn("query_id", F.sha2("query", 256).substr(1, 16))
    if (n := rows.count()) < least:
        raise ValueError(f"a gold set needs {least} queries, this has {n}")
    return rows.select("query_id", F.col("query").alias("text"), "note"), rows.select("query_id", F.explode("relevant_files").alias("document_id"))
