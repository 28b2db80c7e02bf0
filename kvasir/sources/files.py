"""Reading files into rows, and writing rows in batches, by key and at once."""

from __future__ import annotations

import io
import os
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("md", "txt", "csv", "docx", "xlsx", "pdf")
MAGIC = {"pdf": b"%PDF-", "docx": b"PK\x03\x04", "xlsx": b"PK\x03\x04"}
MOST_BYTES = 100 * 1024 * 1024
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.DOTALL)
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)\s*(?:Tj|')|\[(?:[^\]\\]|\\.)*\]\s*TJ|T\*|-?[\d.]+\s+-?[\d.]+\s+T[dD]", re.DOTALL)
_PIECE = re.compile(rb"\(((?:\\.|[^\\()])*)\)", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def kind_of(name: str, head: bytes) -> str | None:
    """The kind of a file by its extension, None if it isn't a known one or its first bytes are another kind's."""
    kind = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    return kind if kind in KINDS and head.startswith(MAGIC.get(kind, b"")) else None


def docx_elements(raw: bytes) -> Iterator[tuple[str, str]]:
    """The paragraphs and tables of a DOCX file in order, as kind and text; tables as Markdown."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    for e in body if body is not None else []:
        if e.tag == f"{_W}p" and text(e):
            style = e.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val", "") if style is not None else ""
            yield ("header" if name.lower().startswith(("heading", "title")) else "text"), text(e)
        elif e.tag == f"{_W}tbl":
            rows = [[text(c).replace("|", "\\|") for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")]
            if rows:
                yield "table", _markdown(rows)


def xlsx_elements(raw: bytes) -> Iterator[tuple[str, str]]:
    """The sheets of an XLSX file as Markdown tables."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
    for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
        rows = []
        for r in ElementTree.fromstring(z.read(name)).iter(f"{_S}row"):
            cells: dict[int, str] = {}
            for at, c in enumerate(r.iter(f"{_S}c")):
                letters = re.match(r"[A-Z]+", c.get("r", ""))
                col = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1 if letters else at
                value = c.findtext(f"{_S}v") or "".join(t.text or "" for t in c.iter(f"{_S}t"))
                cells[col] = shared[int(value)] if c.get("t") == "s" and value else value
            if any(cells.values()):
                rows.append([cells.get(i, "").replace("|", "\\|") for i in range(max(cells) + 1)])
        if rows:
            yield "table", _markdown(rows)


def pdf_elements(raw: bytes) -> Iterator[tuple[str, str]]:
    """The text layer of a PDF file, one element a content stream; only deflated or plain streams with one-byte text are read."""
    for m in _STREAM.finditer(raw):
        try:
            content = zlib.decompress(m[1])
        except zlib.error:
            content = m[1]
        if b"BT" not in content:
            continue
        out = []
        for shown in _SHOWN.findall(content):
            if shown.rstrip().endswith((b"Td", b"TD", b"T*")):
                out.append("\n")
            for piece in _PIECE.findall(shown):
                plain = re.sub(rb"\\([0-7]{1,3}|.)", lambda x: bytes([int(x[1], 8) & 255]) if x[1][:1].isdigit() else _ESCAPES.get(x[1], x[1]), piece)
                out.append(plain.decode("cp1252", "replace"))
        text = re.sub(r"\n+", "\n", "".join(out)).strip()
        if text:
            yield "text", text


def markdown_elements(text: str) -> Iterator[tuple[str, str]]:
    """The headings, tables, fenced and other blocks of a Markdown text, in order."""
    block: list[str] = []
    kind = "text"

    def flush() -> Iterator[tuple[str, str]]:
        if any(x.strip() for x in block):
            yield kind, "\n".join(block).strip()
        block.clear()

    for line in text.split("\n"):
        fence = line.lstrip().startswith("```")
        if kind == "code":
            block.append(line)
            if fence:
                yield from flush()
                kind = "text"
            continue
        own = "code" if fence else "header" if re.match(r"#{1,6}\s+\S", line) else "table" if re.match(r"\s*\|.*\|\s*$", line) else "list" if re.match(r"\s*(?:[-*•]|\d+[.)])\s+\S", line) else "text"
        if own != kind or own == "header" or not line.strip():
            yield from flush()
            kind = own
        block.append(line)
    yield from flush()


def _markdown(rows: list[list[str]]) -> str:
    wide = max(map(len, rows))
    body = ["| " + " | ".join(r + [""] * (wide - len(r))) + " |" for r in rows]
    return "\n".join([body[0], "|" + " --- |" * wide, *body[1:]])


def elements_of(name: str, raw: bytes) -> list[tuple[str, str]]:
    """The elements of a file of a known kind; none for another or a broken one."""
    kind = kind_of(name, raw[:8])
    try:
        if kind == "docx":
            return list(docx_elements(raw))
        if kind == "xlsx":
            return list(xlsx_elements(raw))
        if kind == "pdf":
            return list(pdf_elements(raw))
        if kind in ("md", "txt", "csv"):
            text = raw.decode("utf-8-sig", "replace").replace("\r\n", "\n")
            return list(markdown_elements(text)) if kind == "md" else [("text", text)] if text.strip() else []
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError):
        return []
    return []


def read_files(spark: SparkSession, path: str, *, most: int = MOST_BYTES) -> DataFrame:
    """``path, name, kind, status, no, element, content``: the elements of all files under a folder, one row each.

    ``status`` is ``ok``, ``unknown`` for a file of another kind or whose first bytes don't fit its extension, ``large``
    above ``most`` bytes (it is not read), ``empty`` for one without elements; then there is one row without an element.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", F.when(F.col("length") <= most, F.col("content")).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path_, name, _, raw in zip(*(c.to_pylist() for c in b.columns)):
                kind = kind_of(name, raw[:8]) if raw is not None else None
                found = elements_of(name, raw) if kind else []
                status = "large" if raw is None else "ok" if found else "empty" if kind else "unknown"
                rows = found or [(None, None)]
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path_] * n), pa.array([name] * n), pa.array([kind] * n, pa.string()), pa.array([status] * n), pa.array(range(n), pa.int32()),
                        pa.array([k for k, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.string()),
                    ],
                    ["path", "name", "kind", "status", "no", "element", "content"],
                )

    return files.mapInArrow(run, "path string, name string, kind string, status string, no int, element string, content string")


def append_batches(df: DataFrame, path: str, rows: int = 100_000) -> None:
    """Append ``df`` to a Parquet folder, in files of at most ``rows`` rows."""
    df.write.mode("append").option("maxRecordsPerFile", rows).parquet(path)


def replace_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Write ``df`` so that it replaces all rows of its values of ``keys``, by which the folder is partitioned, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def save_setting(path: str, text: str) -> None:
    """Write a settings file at once: a reader sees the old text or the new one, never a part."""
    part = f"{path}.{os.getpid()}.part"
    with open(part, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)
