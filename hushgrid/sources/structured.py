"""CSV, JSON and XLSX files as cells: doc_id, sheet, record, column, header, pointer, value, kind.

A file is read in one Arrow stage (its parts cannot be read apart), a corpus of files in parallel. Large CSV and JSON
lines should go through Spark's own readers and ``cells_of`` instead.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lines import decode

CELLS = "doc_id bigint, sheet int, record int, column int, header string, pointer string, value string, kind string, error string"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("sheet", pa.int32()), ("record", pa.int32()), ("column", pa.int32()), ("header", pa.string()), ("pointer", pa.string()), ("value", pa.string()), ("kind", pa.string()), ("error", pa.string())])
# Bounds on what a zip may hold.
ZIP_MEMBERS, ZIP_BYTES = 2_000, 64 << 20


def headers(names: list[str]) -> list[str]:
    """Clean names; empty ones are numbered, repeated ones (in any case) get #2, #3 ..."""
    seen: dict[str, int] = {}
    out = []
    for k, raw in enumerate(names):
        name = re.sub(r"\s+", " ", str(raw or "").strip())[:160] or f"column_{k + 1}"
        n = seen[name.casefold()] = seen.get(name.casefold(), 0) + 1
        out.append(name if n == 1 else f"{name}#{n}")
    return out


def csv_cells(data: bytes) -> Iterator[tuple]:
    text = decode(data)
    try:
        dialect = csv.Sniffer().sniff(text[:8192], delimiters=",;\t|") if text.strip() else csv.excel
    except csv.Error:
        dialect = csv.excel
    rows = list(csv.reader(io.StringIO(text, newline=""), dialect))
    if not rows:
        raise ValueError("no rows")
    names = headers(rows[0])
    for r, row in enumerate(rows[1:]):
        for c, name in enumerate(names):  # short rows are filled, long ones cut to the header
            yield 0, r, c, name, f"/{r}/{c}", row[c] if c < len(row) else "", "string"


def once(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key occurs twice")
    return out


def kind_of(value) -> str:
    return "null" if value is None else "boolean" if isinstance(value, bool) else "bigint" if isinstance(value, int) else "double" if isinstance(value, float) else "string"


def shown(value) -> str | None:
    """Text of a value: null is null, booleans lower-case, whole floats without a point."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return str(value).lower()
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def leaves(value, path: tuple = ()) -> Iterator[tuple[tuple, object]]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield from leaves(v, (*path, k))
    elif isinstance(value, list):
        for k, v in enumerate(value):
            yield from leaves(v, (*path, k))
    else:
        yield path, value


def pointer(path: tuple) -> str:
    return "".join("/" + str(p).replace("~", "~0").replace("/", "~1") for p in path)


def leaf_header(path: tuple) -> str:
    return ".".join([p for p in path if isinstance(p, str)][-4:])


def json_cells(data: bytes) -> Iterator[tuple]:
    root = json.loads(decode(data), object_pairs_hook=once)
    if not isinstance(root, (dict, list)):
        raise ValueError("the root is no object or list")
    found = False
    for at, (path, value) in enumerate(leaves(root)):
        found = True
        record = next((p for p in path if isinstance(p, int)), 0)
        yield 0, record, at, leaf_header(path), pointer(path), shown(value), kind_of(value)
    if not found:
        raise ValueError("no values")


def column_number(ref: str) -> int:
    return reduce(lambda n, c: n * 26 + ord(c) - 64, re.match("[A-Z]+", ref)[0], 0) - 1


def guarded(data: bytes) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(data))
    infos = z.infolist()
    if len(infos) > ZIP_MEMBERS or sum(i.file_size for i in infos) > ZIP_BYTES or any(i.flag_bits & 1 or i.filename.startswith("/") or ".." in i.filename.split("/") for i in infos):
        raise ValueError("zip beyond its bounds")
    return z


def xlsx_cells(data: bytes) -> Iterator[tuple]:
    with guarded(data) as z:
        local = lambda e: e.tag.rpartition("}")[2]
        strings = ["".join(t.text or "" for t in si.iter() if local(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [e for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if local(e) == "sheet"]
        n = 0
        for sheet in sheets:
            target = targets[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
            root = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
            rows = []
            for row in (e for e in root.iter() if local(e) == "row"):
                got: dict[int, object] = {}
                for c in row:
                    if any(local(x) == "f" for x in c):
                        raise ValueError("a cell holds a formula")
                    v = next((x.text for x in c if local(x) == "v"), None)
                    t = c.get("t")
                    value: object = "".join(x.text or "" for x in c.iter() if local(x) == "t") if t == "inlineStr" else v
                    if v is not None and t == "s":
                        value = strings[int(v)]
                    elif v is not None and t == "b":
                        value = v == "1"
                    elif v is not None and t in (None, "n"):
                        value = float(v) if re.search("[.eE]", v) else int(v)
                    if value is not None:
                        got[column_number(c.get("r"))] = value
                if got:
                    rows.append(got)
            if not rows:
                continue  # blank sheets do not count
            width = max(max(r) for r in rows) + 1
            names = headers([shown(rows[0].get(k)) or "" for k in range(width)])
            for r, row in enumerate(rows[1:]):
                for c, name in enumerate(names):
                    yield n, r, c, name, f"/{n}/{r}/{c}", shown(row.get(c)), kind_of(row.get(c))
            n += 1


def format_of(name: str, data: bytes) -> str:
    ext = name.rpartition(".")[2].lower()
    if ext in ("csv", "json", "xlsx"):
        return ext
    head = data.lstrip()[:4]
    return "xlsx" if data.startswith(b"PK\x03\x04") else "json" if head[:1] in (b"{", b"[") else "csv"


PARSERS: dict[str, Callable[[bytes], Iterator[tuple]]] = {"csv": csv_cells, "json": json_cells, "xlsx": xlsx_cells}


def cells(files: DataFrame) -> DataFrame:
    """Cells of files (doc_id, name, content); a file that cannot be read gives one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, name, data in zip(*(b.column(c).to_pylist() for c in ("doc_id", "name", "content"))):
                try:
                    rows = [(doc, *r, None) for r in PARSERS[format_of(name or "", data)](data)]
                except Exception as e:  # any malformed file is a row, not a failed job
                    rows = [(doc, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                for k in range(0, len(rows), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows[k : k + 50_000]), _SCHEMA)], schema=_SCHEMA)

    return files.select("doc_id", "name", "content").mapInArrow(run, CELLS)


def cells_of(table: DataFrame, key: str) -> DataFrame:
    """A table's rows unpivoted to cells (key, header, value), without a shuffle."""
    rest = [c for c in table.columns if c != key]
    return table.select(key, F.explode(F.array(*[F.struct(F.lit(k).alias("column"), F.lit(c).alias("header"), F.col(c).cast("string").alias("value")) for k, c in enumerate(rest)])).alias("c")).select(key, "c.*")


def virtual_lines(table: DataFrame, key: str) -> DataFrame:
    """Cells as ``header: value`` lines of their record, with running character offsets of lines and values."""
    made = cells_of(table, key).withColumn("value", F.coalesce("value", F.lit(""))).withColumn("text", F.concat("header", F.lit(": "), "value"))
    before = Window.partitionBy(key).orderBy("column").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long")
    made = made.withColumn("line_start", start).withColumn("char_start", start + F.length("header") + 2)
    return made.withColumn("char_end", F.col("char_start") + F.length("value"))


def summary(cell_rows: DataFrame) -> DataFrame:
    """Sheets, records, fields and a hash of the sorted headers of each file."""
    names = F.array_sort(F.collect_set("header"))
    return cell_rows.filter("error is null").groupBy("doc_id").agg(F.count_distinct("sheet").alias("sheets"), F.count_distinct("sheet", "record").alias("records"), F.count_distinct("sheet", "header").alias("fields"), F.sha2(F.to_json(names), 256).alias("schema_sha256"))


def dedupe_headers(columns: DataFrame, sheet: str, order: str, name: str) -> DataFrame:
    """``columns`` with ``header``: names that a sheet repeats, in any case, get #2, #3 ... in order; as ``headers`` does for one list."""
    n = F.row_number().over(Window.partitionBy(sheet, F.lower(name)).orderBy(order))
    return columns.withColumn("header", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("#"), n.cast("string"))))
