"""Word documents: texts out of files, and Markdown into files, with the standard library alone."""

from __future__ import annotations

import io
import os
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_TYPES = (
    '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
)
_RELS = (
    '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
)
_NOT_XML = re.compile(f"[^\t\n\r {chr(0x20)}-{chr(0xD7FF)}{chr(0xE000)}-{chr(0xFFFD)}{chr(0x10000)}-{chr(0x10FFFF)}]")


def text_of(content: bytes) -> str:
    """All text nodes of a Word document, joined with blanks."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return " ".join(n.text for n in root.iter(f"{{{_W}}}t") if n.text)


def _runs(text: str, bold: bool = False) -> str:
    parts = re.split(r"\*\*(.+?)\*\*", _NOT_XML.sub("", text))
    style = lambda on: "<w:rPr><w:b/></w:rPr>" if on else ""
    return "".join(f'<w:r>{style(bold or i % 2)}<w:t xml:space="preserve">{escape(p)}</w:t></w:r>' for i, p in enumerate(parts) if p)


def _paragraph(text: str, style: str = "", bold: bool = False) -> str:
    named = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{named}{_runs(text, bold)}</w:p>"


def _table(lines: list[str]) -> str:
    rows = [[c.strip() for c in x.strip().strip("|").split("|")] for x in lines if not re.fullmatch(r"[\s|:-]+", x)]
    width = max(map(len, rows), default=0)
    cells = ["".join(f"<w:tc>{_paragraph(c, bold=not i)}</w:tc>" for c in r + [""] * (width - len(r))) for i, r in enumerate(rows)]
    return f"<w:tbl>{''.join(f'<w:tr>{c}</w:tr>' for c in cells)}</w:tbl><w:p/>" if cells else ""


def bytes_of(markdown: str) -> bytes:
    """A Word document of headings, quoted callouts, bullets, tables and paragraphs."""
    out, table = [], []
    for line in [*(markdown or "").split("\n"), ""]:
        if line.lstrip().startswith("|"):
            table.append(line)
            continue
        if table:
            out.append(_table(table))
            table = []
        text = line.strip()
        if head := re.match(r"(#{1,6})\s+(.*)", text):
            out.append(_paragraph(head[2], f"Heading{len(head[1])}", True))
        elif quote := re.match(r">\s?(?:\[!([A-Z]+)\]\s*)?(.*)", text):
            out.append(_paragraph(": ".join(filter(None, quote.groups())), "Quote", bool(quote[1])))
        elif item := re.match(r"[-*•]\s+(.*)", text):
            out.append(_paragraph(f"• {item[1]}", "ListBullet"))
        elif text and not re.fullmatch(r"-{3,}", text):
            out.append(_paragraph(text))
    body = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W}"><w:body>{"".join(out)}</w:body></w:document>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS), ("word/document.xml", body)):
            z.writestr(zipfile.ZipInfo(name), part)  # a fixed date: equal texts give equal files
    return buffer.getvalue()


def read_docx(spark: SparkSession, root: str) -> DataFrame:
    """(path, text, error) of Word documents below root; a file that can't be read has no text."""

    def run(batches):
        for b in batches:
            found = []
            for content in b.column(1).to_pylist():
                try:
                    found.append((text_of(content), None))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    found.append((None, type(e).__name__))
            texts, failed = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(failed, pa.string())], ["path", "text", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.docx").load(root)
    return files.select("path", "content").mapInArrow(run, "path string, text string, error string")


def write_docx(docs: DataFrame, folder: str, name_col: str = "name", text_col: str = "text") -> None:
    """Each row's text as <folder>/<name>.docx; the folder is shared by all executors."""

    def save(rows):
        for name, text in rows:
            path = os.path.join(folder, f"{os.path.basename(name)}.docx")
            with open(f"{path}.{os.getpid()}", "wb") as out:
                out.write(bytes_of(text))
            os.replace(out.name, path)  # a task that runs twice writes the same file

    os.makedirs(folder, exist_ok=True)
    docs.select(F.col(name_col).cast("string"), F.col(text_col)).foreachPartition(save)
