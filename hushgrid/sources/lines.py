"""Documents to lines with character offsets, the working table of the detectors."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_LINES = 44


def lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, page_index, line_no, char_start, text of the non-empty lines; empty ones count for numbers and offsets.

    One shuffle, on doc_id, which later work on the document can use again.
    """
    split = docs.select("doc_id", F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "text"))
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long")
    out = split.withColumn("char_start", start).filter(F.trim("text") != "")
    return out.select("doc_id", F.floor(F.col("line_no") / PAGE_LINES).cast("int").alias("page_index"), "line_no", "char_start", "text")


def decode(data: bytes) -> str:
    """Text of a file: byte order marks, else UTF-8, else Windows-1252; line ends as \\n; not text with NUL or 3 % control characters."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            text = data.decode(name)
            break
    else:
        try:
            text = data.decode("utf-8")
        except UnicodeDecodeError:
            text = data.decode("cp1252", errors="replace")
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "\0" in text:
        raise ValueError("NUL in text")
    if text and sum(c.isprintable() or c in "\n\t" for c in text) / len(text) < 0.97:
        raise ValueError("too many control characters")
    return text


def decoded(content: Column) -> Column:
    """struct(text, error) of binary files: a file that is no text gives a null text and the reason."""

    @F.arrow_udf("text string, error string")
    def run(files: pa.Array) -> pa.Array:
        texts, errors = [], []
        for data in files.to_pylist():
            try:
                texts.append(None if data is None else decode(data))
                errors.append(None)
            except (ValueError, UnicodeError) as e:
                texts.append(None)
                errors.append(str(e))
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["text", "error"])

    return run(content)


def sniff(content: Column, name: Column) -> Column:
    """File type by its first bytes and its name; null where they do not agree or nothing is known."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    head = F.hex(F.substring(content, 1, 8))
    pdf, zipped = head.startswith("25504446"), head.startswith("504B0304")
    return (
        F.when(F.length(content) == 0, F.lit(None))
        .when(pdf | (ext == "pdf"), F.when(pdf & (ext == "pdf"), "PDF"))
        .when(ext.isin("txt", "md", "rtf", "log"), "TEXT")
        .when(ext == "docx", F.when(zipped, "DOCX"))
        .when(ext == "xlsx", F.when(zipped, "DATASET"))
        .when(ext.isin("csv", "json"), "DATASET")
        .when(ext.isin("mp4", "mov"), F.when(F.substring(head, 9, 8) == "66747970", "VIDEO"))
        .when(head.startswith("89504E47") | head.startswith("FFD8FF"), "IMAGE")
    )


def files(spark, path: str, max_bytes: int | None = None) -> DataFrame:
    """path, name, file_type, media sha256 and content of files; ``max_bytes`` marks larger ones as not valid."""
    raw = spark.read.format("binaryFile").load(path)
    name = F.substring_index("path", "/", -1)
    kind = sniff(F.col("content"), name)
    ok = kind.isNotNull() & (F.col("length") > 0)
    return raw.select("path", name.alias("name"), kind.alias("file_type"), F.sha2("content", 256).alias("sha256"), (ok & (F.col("length") <= max_bytes) if max_bytes else ok).alias("valid"), "content")
