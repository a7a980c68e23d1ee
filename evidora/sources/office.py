"""Office files made from rows: a document of paragraphs and a workbook of one sheet."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_SHEET = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _packed(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def document(text: str) -> bytes:
    """A docx file with a paragraph for each line."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
    return _packed({"word/document.xml": f"<w:document {_WORD}><w:body>{body}</w:body></w:document>"})


def workbook(sheet: str, rows: list[list[str]]) -> bytes:
    """An xlsx file with one sheet of texts, at most 26 columns wide."""
    lines = "".join(f'<row r="{r}">' + "".join(f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
    return _packed({"xl/workbook.xml": f'<workbook {_SHEET}><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>',
                    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
                    "xl/worksheets/sheet1.xml": f"<worksheet {_SHEET}><sheetData>{lines}</sheetData></worksheet>"})


def documents(rows: DataFrame) -> DataFrame:
    """Rows (path, text) as docx files (path, content); a null text is empty."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([document(t or "") for t in b.column("text").to_pylist()], pa.binary())], ["path", "content"])

    return rows.select("path", "text").mapInArrow(run, "path string, content binary")


def workbooks(rows: DataFrame, sheet: str) -> DataFrame:
    """Rows (path, lines: array of arrays of texts) as xlsx files (path, content)."""

    def run(batches):
        for b in batches:
            made = [workbook(sheet, [[c or "" for c in line] for line in lines]) for lines in b.column("lines").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(made, pa.binary())], ["path", "content"])

    return rows.select("path", F.coalesce("lines", F.array().cast("array<array<string>>")).alias("lines")).mapInArrow(run, "path string, content binary")
