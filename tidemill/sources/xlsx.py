"""Spreadsheets: a Python data source that reads the first sheet of .xlsx files, and a template writer. Standard library only.

Each file is one partition, read on an executor through binaryFile, so paths of any store that Spark reads will do.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold_header

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def first_sheet(content: bytes) -> list[list[str]]:
    """Rows of text cells of the first sheet; missing cells and rows in between are empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        if not sheets:
            return []
        root = ElementTree.fromstring(z.read(sheets[0]))
    rows: list[list[str]] = []
    for r in root.iter(f"{_MAIN}row"):
        at = int(r.get("r", len(rows) + 1))
        while len(rows) < at - 1:
            rows.append([])
        cells: list[str] = []
        for c in r.iter(f"{_MAIN}c"):
            col = 0
            for ch in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                col = col * 26 + ord(ch) - 64
            while col and len(cells) < col - 1:
                cells.append("")
            v = c.find(f"{_MAIN}v")
            if c.get("t") == "inlineStr":
                cells.append("".join(t.text or "" for t in c.iter(f"{_MAIN}t")))
            elif v is None:
                cells.append("")
            else:
                cells.append(shared[int(v.text)] if c.get("t") == "s" else v.text or "")
        rows.append(cells)
    return rows


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """path, row (from 1) and cells of every row of the first sheets; a file that can't be read gives one row with `error`."""
    schema = pa.schema([("path", pa.string()), ("row", pa.int64()), ("cells", pa.list_(pa.string())), ("error", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                try:
                    got = [(p, i, r, None) for i, r in enumerate(first_sheet(content), 1)]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError) as e:
                    got = [(p, None, None, str(e))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True) if got else ([],) * 4, schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, "path string, row long, cells array<string>, error string")


def material_rows(cells: DataFrame) -> DataFrame:
    """row, materialNo, description, gtipNo: columns found by the folded header, or the first three; the header row is left out."""
    head = cells.where("row = 1").select("path", F.transform("cells", fold_header).alias("h"))

    def last(test) -> F.Column:  # the last header that fits
        hits = F.array_compact(F.transform("h", lambda x, i: F.when(test(x), i)))
        return F.element_at(F.when(F.size(hits) > 0, hits), -1)

    has = lambda x, w: F.contains(x, F.lit(w))
    no = last(lambda x: has(x, "malzeme") & has(x, "no"))
    name = last(lambda x: has(x, "malzeme") & has(x, "tanim") & ~has(x, "no"))
    code = last(lambda x: has(x, "gtip") & ~(has(x, "malzeme") & (has(x, "no") | has(x, "tanim"))))
    found = head.select("path", no.alias("a"), name.alias("b"), code.alias("c"))
    whole = F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("c").isNotNull()
    found = found.select("path", *(F.when(whole, F.col(n)).otherwise(i).cast("int").alias(n) for i, n in enumerate("abc")))
    return cells.where("row > 1").join(found, "path").select("path", "row", F.get("cells", F.col("a")).alias("materialNo"), F.get("cells", F.col("b")).alias("description"), F.get("cells", F.col("c")).alias("gtipNo"))


def template_bytes(rows: list[list[str]] | None = None) -> bytes:
    """A workbook with one sheet of text cells: by default the import template with two samples."""
    rows = rows or [["Malzeme No", "Malzeme Tanımı", "GTİP"], ["MLZ-001", "Örnek malzeme", "847130000000"], ["MLZ-002", "Örnek parça", "848210900000"]]
    body = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()
