"""Uploaded files to text: a row each from Spark's binaryFile source, parsed in Arrow batches.

Formats: text and Markdown as they are, HTML, DOCX, PPTX, EPUB, RTF, and PDF as
far as its text streams are plain. A file that can't be parsed gets an error,
not an exception.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import FILE_DROPS, text_of
from ..functions.text import preview

#: PDFs with less text than this would need character recognition, which there is none of.
LEAST_PDF_CHARS = 40


def _zip_texts(content: bytes, folder: str, suffixes: tuple[str, ...]) -> Iterator[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for name in sorted(archive.namelist()):
            if name.startswith(folder) and name.lower().endswith(suffixes):
                yield archive.read(name).decode("utf-8", "replace")


def _xml_text(markup: str) -> str:
    try:
        return " ".join(t for t in ElementTree.fromstring(markup).itertext() if t.strip())
    except ElementTree.ParseError:
        return re.sub("<[^>]+>", " ", markup)


def _office(folder: str):
    return lambda content: " ".join(_xml_text(x) for x in _zip_texts(content, folder, (".xml",)))


def _epub(content: bytes) -> str:
    return " ".join(text_of(x, FILE_DROPS) for x in _zip_texts(content, "", (".xhtml", ".html", ".htm")))


def _rtf(content: bytes) -> str:
    text = content.decode("latin-1")
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), text)
    text = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", " ", text)
    return re.sub(r"[{}]", " ", re.sub(r"\\[a-zA-Z]+-?\d* ?", " ", text))


_pdf_escapes = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def _pdf_string(raw: str) -> str:
    def escape(m: re.Match) -> str:
        c = m[1]
        return chr(int(c, 8) & 255) if c[0].isdigit() else _pdf_escapes.get(c, c)

    return re.sub(r"\\([0-7]{1,3}|.)", escape, raw)


def _pdf(content: bytes) -> str:
    streams = []
    for m in re.finditer(rb"stream\r?\n(.*?)endstream", content, re.S):
        try:
            streams.append(zlib.decompressobj().decompress(m[1]))
        except zlib.error:
            streams.append(m[1])
    literal = r"\(((?:\\.|[^\\()])*)\)"
    found = []
    for stream in streams or [content]:
        text = stream.decode("latin-1")
        for m in re.finditer(rf"\[((?:[^\[\]\\]|\\.)*)\]\s*TJ|{literal}\s*(?:Tj|'|\")", text):
            parts = re.findall(literal, m[1]) if m[1] is not None else [m[2]]
            found.append("".join(map(_pdf_string, parts)))
    text = " ".join(found)
    readable = sum(c.isprintable() or c.isspace() for c in text)
    return text if text and readable >= 0.95 * len(text) else ""


_plain = lambda content: content.decode("utf-8", "replace")
_html = lambda content: text_of(_plain(content), FILE_DROPS)
PARSERS = {
    "txt": _plain, "md": _plain, "html": _html, "htm": _html, "docx": _office("word/"), "pptx": _office("ppt/slides/"),
    "epub": _epub, "rtf": _rtf, "pdf": _pdf,
}


def parse(name: str, content: bytes) -> tuple[str | None, str | None]:
    """(text, error) of a file."""
    kind = name.rpartition(".")[2].lower()
    if kind not in PARSERS:
        return None, f"unsupported file type: {kind}"
    try:
        text = PARSERS[kind](content or b"")
    except (zipfile.BadZipFile, zlib.error, KeyError, ValueError) as e:
        return None, str(e)
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ", text)
    return (text if kind in ("txt", "md") else " ".join(text.split())).strip(), None


def read(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path``: path, name, bytes, hash of the raw file, text, content_hash, status, preview and error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1))

    @F.pandas_udf("text string, error string")
    def parsed(names: pd.Series, contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(n, c) for n, c in zip(names, contents, strict=True)], columns=["text", "error"])

    rows = named.withColumn("_p", parsed("name", "content"))
    text = F.col("_p.text")
    is_scan = F.lower("name").endswith(".pdf") & (F.char_length(text) < LEAST_PDF_CHARS)
    status = (
        F.when(F.col("_p.error").isNotNull(), "failed")
        .when(is_scan, "ocr_not_available")
        .when(F.trim(text) == "", "empty_content")
        .otherwise("parsed")
    )
    return rows.select(
        "path", "name", F.col("length").alias("bytes"), F.sha2("content", 256).alias("raw_hash"), text.alias("text"),
        F.sha2(text, 256).alias("content_hash"), status.alias("status"),
        preview(text, F.col("name"), "-", 360).alias("preview"), F.col("_p.error").alias("error"),
    )


def read_manifests(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Document manifests under ``path``, one a file or (``lines``) one a line; malformed ones are left out."""
    reader = spark.read.schema(f"{schema}, _corrupt string").option("recursiveFileLookup", "true")
    raw = reader.option("multiLine", not lines).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return raw.where("_corrupt is null").drop("_corrupt")


def snapshot(tables: dict[str, DataFrame], root: str, set_id: str) -> None:
    """Write every table under ``root/set_id``; an id is letters, digits and underscores."""
    if not re.fullmatch(r"[a-zA-Z0-9_]+", set_id):
        raise ValueError(f"not a snapshot id: {set_id}")
    for name, df in tables.items():
        df.write.mode("error").parquet(f"{root}/{set_id}/{name}")


def restore(spark: SparkSession, root: str, set_id: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{root}/{set_id}/{name}") for name in names}
