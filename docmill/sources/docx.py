"""Text of DOCX files: the one place where Python has to read what Spark cannot.

A DOCX file is a ZIP of XML; the body's paragraphs and tables are read in order with the standard library.  Files
come as binary rows and are read in Arrow batches, after known ones have been dropped, so no file is parsed twice.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# Styles that are headings, English and Korean, by level.
HEADINGS = [("Heading 1", "제목 1", "# "), ("Heading 2", "제목 2", "## "), ("Heading 3", "제목 3", "### "), ("Heading 4", "제목 4", "#### ")]
TITLE = ("Title", "# ")
#: Files, and letters of their texts, that a task holds at a time when it reads.
READ_ROWS, READ_LETTERS = 256, 1 << 22


def _text(paragraph: ElementTree.Element) -> str:
    out = []
    for node in paragraph.iter():
        if node.tag == f"{W}t":
            out.append(node.text or "")
        elif node.tag in (f"{W}br", f"{W}cr"):
            out.append("\n")
        elif node.tag == f"{W}tab" and node.get(f"{W}val") is None:
            out.append("\t")
    return "".join(out)


def _cells(row: ElementTree.Element) -> list[str]:
    return ["\n".join(_text(p) for p in cell.iter(f"{W}p")).strip() for cell in row.findall(f"{W}tc")]


def _styles(z: zipfile.ZipFile) -> dict[str, str]:
    """Names of styles by their ids."""
    if "word/styles.xml" not in z.namelist():
        return {}
    root = ElementTree.fromstring(z.read("word/styles.xml"))
    names = {s.get(f"{W}styleId"): s.find(f"{W}name") for s in root.iter(f"{W}style")}
    # built-in names are kept in lower case
    fix = lambda n: n.replace("heading ", "Heading ") if n.startswith("heading ") else n
    return {i: fix(n.get(f"{W}val", "")) for i, n in names.items() if n is not None}


def _prefix(style: str) -> str:
    for english, korean, mark in HEADINGS:
        if english in style or korean in style:
            return mark
    return TITLE[1] if TITLE[0] in style else ""


def read(content: bytes) -> tuple[str, str]:
    """Markdown in body order, and plain text with all paragraphs before all tables."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
        styles = _styles(z)
    md: list[str] = []
    paragraphs: list[str] = []
    tables: list[str] = []
    for node in [] if body is None else body:
        if node.tag == f"{W}p":
            raw = _text(node)
            paragraphs.append(raw)
            style = node.find(f"{W}pPr/{W}pStyle")
            name = "" if style is None else styles.get(style.get(f"{W}val"), style.get(f"{W}val") or "")
            text = raw.strip()
            md.append(_prefix(name) + text if text else "")
        elif node.tag == f"{W}tbl":
            rows = [_cells(r) for r in node.findall(f"{W}tr")]
            tables += ("\t".join(r) for r in rows)
            if rows:
                piped = ["| " + " | ".join(c.replace("\n", " ") for c in r) + " |" for r in rows]
                md += [piped[0], "| " + " | ".join(["---"] * len(rows[0])) + " |", *piped[1:], ""]
    return "\n".join(md), "\n".join(paragraphs + tables)


def read_batch(batch: pa.RecordBatch, content: str, kept: list[str], kind: pa.Schema, rows: int = READ_ROWS, letters: int = READ_LETTERS) -> Iterator[pa.RecordBatch]:
    """The texts of a batch of files in batches of at most ``rows`` files, which end with the file that reaches ``letters``
    letters: a file may hold many times its size, and only so many texts are held at a time."""
    start, size, out = 0, 0, {"md": [], "plain": [], "error": []}
    for at in range(batch.num_rows):
        try:
            row = (*read(batch.column(content)[at].as_py() or b""), None)
        except Exception as e:  # a broken file is a row with a reason, it does not end the run
            row = (None, None, f"{type(e).__name__}: {e}")
        for k, v in zip(out, row, strict=True):
            out[k].append(v)
        size += sum(len(v or "") for v in row)
        if at + 1 - start >= rows or size >= letters or at + 1 == batch.num_rows:
            piece = batch.slice(start, at + 1 - start)
            yield pa.RecordBatch.from_arrays([piece.column(c).cast(kind.field(c).type) for c in kept] + [pa.array(v, pa.string()) for v in out.values()], schema=kind)
            start, size, out = at + 1, 0, {"md": [], "plain": [], "error": []}


def extract(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` without content, with ``md``, ``plain`` and ``error`` (of a file that cannot be read)."""
    kept = [c for c in files.columns if c != content]
    schema = ", ".join(f"`{c}` {t}" for c, t in files.dtypes if c != content)
    schema = f"{schema}{', ' if schema else ''}md string, plain string, error string"

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from read_batch(batch, content, kept, kind)

    return files.mapInArrow(run, schema)


def build(paragraphs: list[tuple[str, str]], tables: list[list[list[str]]] | None = None) -> bytes:
    """A small DOCX of (style, text) paragraphs and tables at the end, for tests and exports."""
    from xml.sax.saxutils import escape

    def run_of(text: str) -> str:
        return "<w:br/>".join(f'<w:t xml:space="preserve">{escape(t)}</w:t>' for t in text.split("\n"))

    p = lambda style, text: f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{escape(style)}{chr(34)}/></w:pPr>' if style else ''}<w:r>{run_of(text)}</w:r></w:p>"
    body = "".join(p(*x) for x in paragraphs)
    for t in tables or []:
        body += "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p('', c)}</w:tc>" for c in r) + "</w:tr>" for r in t) + "</w:tbl>"
    head, office = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', "http://schemas.openxmlformats.org"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{office}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{office}/package/2006/relationships"><Relationship Id="rId1" Type="{office}/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'{head}<w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def written(docs: DataFrame, text: str = "text", name: str = "content") -> DataFrame:
    """``docs`` with a DOCX file of each text, a paragraph for a line; characters that XML forbids become U+FFFD."""
    from docmill.operators.tasks import map_rows
    from docmill.sources.redline import spelled

    return map_rows(docs, lambda row: build([("", line) for line in spelled(row[text] or "").split("\n")]), name, "binary", limit=64)


def report_files(reports: DataFrame, title: str = "Review report", report: str = "report", name: str = "content") -> DataFrame:
    """``reports`` (see ``review.report``) with a DOCX file of each: counts by risk, scopes, and the gravest clauses."""
    import json

    from docmill.functions import fixed
    from docmill.operators.tasks import map_rows

    def work(row: dict) -> bytes | None:
        if row[report] is None:
            return None
        own = json.loads(row[report])
        lines = [("Title", title), ("Heading 1", "Summary"), ("", f"Clauses: {own['clauses']}"), *(("", f"{r}: {own[f'n_{r}']}") for r in fixed.RISKS)]
        lines += [("", f"Redlines: {own['redlines']}, comments: {own['comments']}"), ("Heading 1", "Key issues")]
        issues = own.get("key_issues") or []
        return build(lines + [("", f"{x['clause_id']}: {x.get('risk_level', '')}") for x in issues])

    return map_rows(reports, work, name, "binary", limit=64)
