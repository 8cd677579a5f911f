"""RTF and DOCX to text, and the writers of both."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .structured import guarded

# Groups of an RTF file that show nothing, and words that stand for characters.
SILENT = set("fonttbl colortbl datastore themedata stylesheet info pict object filetbl listtable listoverridetable generator xmlnstbl rsidtbl protusertbl mmathpr latentstyles".split())
SIGNS = {"par": "\n", "line": "\n", "tab": "\t", "emdash": "\u2014", "endash": "\u2013", "bullet": "\u2022", "lquote": "\u2018", "rquote": "\u2019", "ldblquote": "\u201c", "rdblquote": "\u201d"}


class Rtf:
    """Reads control words, bytes, groups and text one after the other."""

    def __init__(self, source: str):
        self.source, self.at = source, 0
        self.out: list[str] = []
        self.silent, self.fallback, self.skip = False, 1, 0
        self.groups: list[tuple[bool, int]] = []

    def put(self, text: str) -> None:
        """Text that is shown, less the stand-ins of a character just written."""
        if self.silent:
            return
        cut = min(self.skip, len(text))
        self.skip -= cut
        self.out.append(text[cut:])

    def word(self, name: str, number: int | None) -> None:
        if name in SILENT:
            self.silent = True
        elif name == "uc" and number is not None:
            self.fallback = max(0, number)
        elif name == "u" and number is not None:
            if not self.silent:
                self.out.append(chr(number % 65_536))
            self.skip = self.fallback
        elif name in SIGNS and not self.silent:
            self.out.append(SIGNS[name])

    def read(self) -> str:
        s = self.source
        plain = re.compile(r"[^\\{}]+")
        word = re.compile(r"([a-zA-Z]+)(-?\d+)? ?")
        while self.at < len(s):
            c = s[self.at]
            if c == "{":
                self.groups.append((self.silent, self.fallback))
                self.at += 1
            elif c == "}":
                if self.groups:
                    self.silent, self.fallback = self.groups.pop()
                self.skip = 0
                self.at += 1
            elif c != "\\":
                m = plain.match(s, self.at)
                self.put(m[0].replace("\r", "").replace("\n", ""))
                self.at = m.end()
            elif m := word.match(s, self.at + 1):
                self.word(m[1].lower(), int(m[2]) if m[2] else None)
                self.at = m.end()
            elif s[self.at + 1 : self.at + 2] == "'":
                self.put(bytes.fromhex(s[self.at + 2 : self.at + 4] or "3f").decode("cp1252", errors="replace"))
                self.at += 4
            else:
                mark = s[self.at + 1 : self.at + 2]
                if mark == "*":
                    self.silent = True
                elif mark in ("{", "}", "\\"):
                    self.put(mark)
                elif mark in ("~", "_") and not self.silent:
                    self.out.append(" " if mark == "~" else "\u2011")
                self.at += 2
        text = "".join(self.out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # code units to characters
        return re.sub(r"\n{3,}", "\n\n", text).strip("\n")


def rtf_text(data: bytes) -> str:
    source = data.decode("latin-1")
    if not re.match(r"\s*\{\\rtf\d", source):
        raise ValueError("not RTF")
    return Rtf(source).read()


def to_rtf(text: str) -> bytes:
    """A plain RTF of a text: no metadata, other characters as code units with one stand-in."""

    def code(c: str) -> str:
        if c in "\\{}":
            return "\\" + c
        if c == "\n":
            return "\\par\n"
        if c == "\t":
            return "\\tab "
        if ord(c) < 128:
            return c
        units = c.encode("utf-16-le")
        return "".join(f"\\u{int.from_bytes(units[k : k + 2], 'little', signed=True)}?" for k in range(0, len(units), 2))

    return ("{\\rtf1\\ansi\\uc1 " + "".join(map(code, text)) + "}").encode("ascii")


W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PART = re.compile(r"word/(?:document|header\d*|footer\d*|footnotes|endnotes)\.xml$")


def docx_paragraphs(data: bytes) -> Iterator[tuple[str, int, str, bool]]:
    """(part, number, text, hidden) of the paragraphs of all text parts; active content is refused."""
    with guarded(data) as z:
        names = z.namelist()
        if any(n.endswith(("vbaProject.bin", ".exe")) or n.startswith(("word/embeddings/", "word/activeX/")) for n in names):
            raise ValueError("active content")
        for name in sorted(filter(PART.match, names)):
            for k, p in enumerate(ElementTree.fromstring(z.read(name)).iter(f"{W}p")):
                shown, unseen = [], []
                for run in p.iter(f"{W}r"):
                    props = run.find(f"{W}rPr")
                    to = unseen if props is not None and props.find(f"{W}vanish") is not None else shown
                    for e in run:
                        to.append(e.text or "" if e.tag == f"{W}t" else "\t" if e.tag == f"{W}tab" else "\n" if e.tag in (f"{W}br", f"{W}cr") else "")
                if "".join(shown).strip():
                    yield name, k, "".join(shown), False
                if "".join(unseen).strip():
                    yield name, k, "".join(unseen), True


def docx_text(data: bytes) -> str:
    return "\n".join(text for _, _, text, hidden in docx_paragraphs(data) if not hidden)


def to_docx(text: str) -> bytes:
    """A DOCX of a text: one paragraph a line, no metadata, fixed times."""
    from xml.sax.saxutils import escape

    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f"<w:document {ns}><w:body>{body}</w:body></w:document>",
    }
    return zipped({k: ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + v).encode() for k, v in parts.items()})


def zipped(parts: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def replace_docx(data: bytes, values: list[tuple[str, str]]) -> bytes:
    """Values replaced across the runs of each paragraph; hidden runs, comments and properties go."""
    out: dict[str, bytes] = {}
    with guarded(data) as z:
        for name in z.namelist():
            if name.startswith(("docProps/", "word/comments", "customXml/")):
                continue
            raw = z.read(name)
            if PART.match(name):
                root = ElementTree.fromstring(raw)
                for p in root.iter(f"{W}p"):
                    for run in list(p.iter(f"{W}r")):
                        props = run.find(f"{W}rPr")
                        if props is not None and props.find(f"{W}vanish") is not None:
                            for e in list(run):
                                run.remove(e)
                    texts = list(p.iter(f"{W}t"))
                    whole = new = "".join(t.text or "" for t in texts)
                    for old, put in sorted(values, key=lambda v: -len(v[0])):
                        new = new.replace(old, put)
                    if new != whole:  # the changed paragraph's text goes to its first run
                        for k, t in enumerate(texts):
                            t.text = new if k == 0 else ""
                raw = ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)
            elif name == "_rels/.rels" or name == "[Content_Types].xml":
                raw = re.sub(rb'<(?:Relationship|Override)[^>]*(?:docProps|comments)[^>]*/>', b"", raw)
            out[name] = raw
    return zipped(out)


def texts(files: DataFrame) -> DataFrame:
    """doc_id, text, error of RTF and DOCX files (doc_id, name, content)."""

    @F.arrow_udf("text string, error string")
    def run(names: pa.Array, contents: pa.Array) -> pa.Array:
        got = []
        for name, data in zip(names.to_pylist(), contents.to_pylist()):
            try:
                got.append(((docx_text if (name or "").lower().endswith(".docx") else rtf_text)(data), None))
            except Exception as e:  # any malformed file is a row, not a failed job
                got.append((None, f"{type(e).__name__}: {e}"))
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=["text", "error"])

    return files.select("doc_id", run("name", "content").alias("r")).select("doc_id", "r.*")


def rtf_column(text: Column) -> Column:
    @F.arrow_udf("binary")
    def run(t: pa.Array) -> pa.Array:
        return pa.array([None if x is None else to_rtf(x) for x in t.to_pylist()], pa.binary())

    return run(text)
