"""Excel workbooks (S2): a folder of ``.xlsx`` files, one task per file.

``binaryFile`` lists the workbooks; ``mapInPandas`` parses the first
worksheet of each with the standard library (zip + XML), first row as
header, and the text is cast to the caller's explicit schema by Spark
(``try_cast``: an unparsable cell becomes NULL).  Legacy binary ``.xls``
is not supported.
"""

from __future__ import annotations

import io
import os
import re
import uuid
import zipfile
from itertools import chain, islice
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "p": "http://schemas.openxmlformats.org/package/2006/relationships"}

BOOK_ROWS = 100_000   # rows of a workbook (a worksheet can hold 1,048,576)
BATCH_ROWS = 10_000   # rows that are parsed at once


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def parse_first_sheet(data: bytes) -> list[list[str | None]]:
    return list(iter_first_sheet(data))


def iter_first_sheet(data: bytes):
    """The rows of the first worksheet, one at a time; no more of its XML is held."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            root = ET.fromstring(z.read("xl/sharedStrings.xml"))
            for si in root.findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        wb = ET.fromstring(z.read("xl/workbook.xml"))
        first = wb.find("m:sheets/m:sheet", _NS)
        rid = first.get(f"{{{_NS['r']}}}id")
        target = "worksheets/sheet1.xml"
        if "xl/_rels/workbook.xml.rels" in names:
            rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
            for rel in rels.findall("p:Relationship", _NS):
                if rel.get("Id") == rid:
                    target = rel.get("Target").lstrip("/").removeprefix("xl/")
        tag, path = f"{{{_NS['m']}}}row", []
        with z.open(f"xl/{target}") as sheet:
            for event, element in ET.iterparse(sheet, ("start", "end")):
                if event == "start":
                    path.append(element)
                    continue
                path.pop()
                if element.tag == tag:
                    yield _row_values(element, shared)
                    if path:
                        path[-1].remove(element)


def _row_values(row, shared: list[str]) -> list[str | None]:
    vals: dict[int, str | None] = {}
    nxt = 0
    for c in row.findall("m:c", _NS):
        t = c.get("t", "n")
        v = c.find("m:v", _NS)
        if t == "s":
            val = shared[int(v.text)] if v is not None else None
        elif t == "inlineStr":
            val = "".join(x.text or "" for x in c.iter(f"{{{_NS['m']}}}t"))
        elif t == "b":
            val = "true" if v is not None and v.text == "1" else "false"
        else:
            val = v.text if v is not None else None
        # the cell reference is optional: without it a cell follows the previous one
        idx = _col_index(c.get("r")) if c.get("r") else nxt
        vals[idx] = val
        nxt = idx + 1
    width = max(vals) + 1 if vals else 0
    return [vals.get(i) for i in range(width)]


def read_xlsx(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    names = [f.name for f in schema.fields]
    text_schema = T.StructType([T.StructField(n, T.StringType()) for n in names])

    def parse(batches):
        for pdf in batches:
            for content in pdf["content"]:
                sheet = iter_first_sheet(bytes(content))
                pos = {h: i for i, h in enumerate(next(sheet, []))}
                while rows := list(islice(sheet, BATCH_ROWS)):
                    out = {n: [r[pos[n]] if n in pos and pos[n] < len(r) else None for r in rows] for n in names}
                    yield pd.DataFrame(out, columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(folder)
    text = files.select("content").mapInPandas(parse, text_schema)
    return text.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def _sheet_xml(header: list[str], rows):
    """The worksheet's XML, piece by piece."""
    def cell(v):
        if v is None or (isinstance(v, float) and v != v):
            return "<c/>"
        if isinstance(v, (bool,)):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c><v>{repr(v)}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
    yield '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="' + _NS["m"] + '"><sheetData>'
    yield "<row>" + "".join(cell(h) for h in header) + "</row>"
    for r in rows:
        yield "<row>" + "".join(cell(v) for v in r) + "</row>"
    yield "</sheetData></worksheet>"


def write_workbook(path: str, header: list[str], rows) -> None:
    ct = ('<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/'
          'content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships'
          '+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" '
          'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override '
          'PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.'
          'spreadsheetml.worksheet+xml"/></Types>')
    rels = ('<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="' + _NS["p"] + '"><Relationship Id="rId1" '
            'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" '
            'Target="xl/workbook.xml"/></Relationships>')
    wb = ('<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="' + _NS["m"] + '" xmlns:r="' + _NS["r"] + '">'
          '<sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
    wbrels = ('<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="' + _NS["p"] + '"><Relationship '
              'Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" '
              'Target="worksheets/sheet1.xml"/></Relationships>')
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", ct)
        z.writestr("_rels/.rels", rels)
        z.writestr("xl/workbook.xml", wb)
        z.writestr("xl/_rels/workbook.xml.rels", wbrels)
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
            for piece in _sheet_xml(header, rows):
                sheet.write(piece.encode("utf-8"))


def write_xlsx(df: DataFrame, folder: str) -> int:
    """Workbooks of at most BOOK_ROWS rows, at least one per partition with
    rows, written by the tasks themselves into a folder every executor
    mounts (a local or network file system path)."""
    cols = df.columns
    text = df.select(*[F.col(c).cast("string") if isinstance(df.schema[c].dataType,
                                                             (T.TimestampType, T.TimestampNTZType, T.DateType))
                       else F.col(c) for c in cols])

    def write(batches):
        total = 0

        def rows():
            nonlocal total
            for pdf in batches:
                total += len(pdf)
                yield from pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None)

        every = rows()
        for row in every:
            os.makedirs(folder, exist_ok=True)
            write_workbook(os.path.join(folder, f"part-{uuid.uuid4().hex}.xlsx"), cols, chain([row], islice(every, BOOK_ROWS - 1)))
        if total:
            yield pd.DataFrame({"rows": [total]})

    return text.mapInPandas(write, "rows long").agg(F.sum("rows")).collect()[0][0] or 0
