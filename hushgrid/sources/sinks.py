"""Writers of protected tables."""

from __future__ import annotations

import json
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from .office import zipped


def safe(df: DataFrame) -> DataFrame:
    """Text cells that a spreadsheet would compute, neutralised."""
    return df.select(*[V.neutralize_formula(F.col(c)).alias(c) if k == "string" else F.col(c) for c, k in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    safe(df).write.option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines with keys in order, at the top level."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def long_rows(cells: DataFrame) -> DataFrame:
    """Cells of a nested file as record, field, json_pointer, value rows."""
    return cells.select("record", F.col("header").alias("field"), F.col("pointer").alias("json_pointer"), "value")


def xlsx(sheets: dict[str, tuple[list[str], list[list]]]) -> bytes:
    """An XLSX of small sheets (name -> header, rows) with inline strings and fixed times."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"

    def ref(k: int) -> str:
        out = ""
        k += 1
        while k:
            k, r = divmod(k - 1, 26)
            out = chr(65 + r) + out
        return out

    def cell(r: int, c: int, v) -> str:
        at = f'r="{ref(c)}{r + 1}"'
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c {at} t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c {at}><v>{v}</v></c>"
        text = "'" + v if v[:1] in "=+-@" and v else v
        return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1)) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)[:31]}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>",
    }
    for k, (names, rows) in enumerate(sheets.values(), 1):
        body = "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate([names, *rows]))
        parts[f"xl/worksheets/sheet{k}.xml"] = f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>'
    return zipped({name: (head + xml).encode() for name, xml in parts.items()})


def pretty(value) -> str:
    return json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False)
