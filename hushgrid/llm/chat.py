"""Chat formatting: schema fingerprints choose declarative mappings to canonical turns.

A record's fingerprint is the hash of its sorted nested field paths. It selects the mappings that say where the
turns, roles and texts are; an unknown fingerprint gets the mapping with the most fields that the record has, and
besides it those that share no field with the ones before, so that no turn of a mixed record is lost. Turns are written with marks, control strings inside texts are escaped reversibly, and the loss mask covers the
assistant texts. One output row holds one turn, so a conversation of any length never has to fit a row.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BEGIN, END = "<|turn|>", "<|end|>\n"
CONTROL = r"<\|[A-Za-z0-9_]+\|>|</?s>|\[/?INST\]|<</?SYS>>"
_CONTROL = re.compile(CONTROL, re.IGNORECASE)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_PIECE = re.compile(r"<\|turn\|>((?:[^\\\n]|\\.)*)\n(.*)<\|end\|>\n", re.DOTALL)

ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
#: Where each layout keeps its turns: ``turns`` a list with role and text fields, or ``fields`` of one role each.
MAPPINGS = {
    "turn": {"paths": ("role", "text"), "optional": ("turn",), "role": "role", "text": "text"},
    "messages": {"paths": ("messages[].role", "messages[].content"), "turns": "messages", "role": "role", "text": "content"},
    "dialogue": {"paths": ("conversations[].from", "conversations[].value"), "turns": "conversations", "role": "from", "text": "value", "roles": ROLES},
    "instruction": {"paths": ("instruction", "output"), "optional": ("input", "system"), "fields": (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))},
    "completion": {"paths": ("prompt", "completion"), "optional": ("system",), "fields": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))},
    "response": {"paths": ("prompt", "response"), "optional": ("system",), "fields": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))},
    "question": {"paths": ("question", "answer"), "optional": ("context",), "fields": (("user", ("context", "question")), ("assistant", ("answer",)))},
}
UNKNOWN = "unknown"


def paths(value, at: str = "") -> set[str]:
    """Nested field paths; list items are ``[]``. An empty list or object is a path itself."""
    if isinstance(value, dict) and value:
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(paths(v, at + "[]") for v in value))
    return {at}


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode("utf-8")).hexdigest()[:16]


def registry() -> dict[str, str]:
    """Fingerprint -> name of the mapping, for each mapping with every choice of its optional fields."""
    out = {}
    for name, m in MAPPINGS.items():
        extra = m.get("optional", ())
        for bits in range(1 << len(extra)):
            out[fingerprint({*m["paths"], *(p for k, p in enumerate(extra) if bits >> k & 1)})] = name
    return out


def said(value) -> str:
    """Text of a field: null is empty, a list of parts is the parts' texts end to end, anything else that is no string is its JSON."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, list) and value and all(isinstance(p, str) or isinstance(p, dict) and isinstance(p.get("text"), str) for p in value):
        return "".join(p if isinstance(p, str) else p["text"] for p in value)
    return json.dumps(value, ensure_ascii=False)


class Mapper:
    def __init__(self) -> None:
        self.known = {key: (name,) for key, name in registry().items()}

    def layouts(self, record) -> tuple[str, ...]:
        """Names of the mappings that hold for a record, none for a layout that no mapping fits."""
        found = paths(record)
        key = fingerprint(found)
        if key not in self.known:
            # a field holds whatever lies below it
            have = {p[:k] for p in found for k in range(1, len(p) + 1) if k == len(p) or p[k] in ".["}
            names, used = [], set()
            for name, m in sorted(MAPPINGS.items(), key=lambda m: (-len(set(m[1]["paths"]) & have), m[0])):
                if set(m["paths"]) <= have and set(m["paths"]) - used:
                    names.append(name)
                    used |= {*m["paths"], *m.get("optional", ())}
            if len(self.known) > 10_000:
                self.__init__()
            self.known[key] = tuple(names)
        return self.known[key]

    def turns(self, text: str | None) -> tuple[str, list[tuple[str, str]]]:
        """Layout and (role, text) turns of a JSON record; unknown layouts and broken JSON have none.

        An item of a list of turns that is no object is a turn without a role. A record that several mappings fit has
        the turns of each, in the order of their names in the layout.
        """
        try:
            record = json.loads(text or "")
        except ValueError:
            return UNKNOWN, []
        names, used, out = self.layouts(record), set(), []
        for name in names:
            out += self.turns_of(record, MAPPINGS[name], used)
            used |= {*MAPPINGS[name]["paths"], *MAPPINGS[name].get("optional", ())}
        return "+".join(names) or UNKNOWN, out

    def turns_of(self, record: dict, m: dict, used: set[str]) -> Iterator[tuple[str, str]]:
        """Turns of one mapping, without the fields that a mapping before has taken."""
        if "fields" in m:
            for role, fields in m["fields"]:
                fields = [n for n in fields if n not in used]
                if not fields:
                    continue
                parts = [said(record[n]) for n in fields if record.get(n) not in (None, "")]
                if parts or role != "system":
                    yield role, "\n\n".join(parts)
            return
        for r in record[m["turns"]] if "turns" in m else [record]:
            if isinstance(r, dict):
                role = said(r.get(m["role"]))
                yield m.get("roles", {}).get(role, role), said(r.get(m["text"]))
            else:
                yield "", said(r)


def escape(text: str) -> str:
    """Backslashes doubled, and one set after the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def piece(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and the span of its text."""
    head = f"{BEGIN}{escape(role).replace(chr(10), chr(92) + chr(10))}\n"
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    m = _PIECE.fullmatch(formatted)
    if m is None:
        raise ValueError(f"not a formatted turn: {formatted[:80]!r}")
    return unescape(m[1]), unescape(m[2])


def format_chats(records: DataFrame) -> DataFrame:
    """One row a turn: conv_id, ord, k, tie, layout, piece, loss_start, loss_end (code points in the piece; null: no loss).

    ``records`` has conv_id, ord (place of the record in its conversation) and record (JSON). Null texts and
    roles count as empty. A record of an unknown layout, or that is no JSON, gives one row with that layout and
    a null piece. Repeated rows are all kept; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapper = Mapper()
        kind = pa.schema([("conv_id", pa.int64()), ("ord", pa.int64()), ("k", pa.int32()), ("tie", pa.string()), ("layout", pa.string()), ("piece", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
        for b in (part for whole in batches for part in common.parts(whole, whole.column("record"))):
            rows = []
            for conv, at, record in zip(*(b.column(c).to_pylist() for c in ("conv_id", "ord", "record"))):
                layout, turns = mapper.turns(record)
                if layout == UNKNOWN:
                    rows.append((conv, at, -1, None, layout, None, None, None))
                for k, (role, text) in enumerate(turns):
                    out, start, end = piece(role, text)
                    rows.append((conv, at, k, hashlib.sha256(f"{role}\n{text}".encode()).hexdigest()[:16], layout, out, *((start, end) if role == "assistant" else (None, None))))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(kind), kind)], schema=kind)

    kept = records.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("ord").cast("long").alias("ord"), "record")
    return kept.mapInArrow(run, "conv_id bigint, ord bigint, k int, tie string, layout string, piece string, loss_start bigint, loss_end bigint")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_unmapped, parsed from the formatted turns.

    Turns of a conversation stream by in order; a task holds hash states, not the conversation. Records that no
    mapping fits are counted (``n_unmapped``) and have no turns. Turns of equal place follow each other by ``tie``, a digest of role and text.
    """
    spark = formatted.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = formatted.repartition(n, "conv_id").sortWithinPartitions("conv_id", "ord", "k", "tie", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_unmapped", pa.int64())])
        none = object()
        key, state, done = none, None, []
        close = lambda: done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))
        for b in batches:
            for conv, text, start, end in zip(*(b.column(c).to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_end"))):
                if key is none or conv != key:
                    if key is not none:
                        close()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                if text is None:
                    state[5] += 1
                    continue
                role, said = parse(text)
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
                if start is not None:
                    masked = unescape(text[start:end])
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*done), kind)], schema=kind)
                done.clear()
        if key is not none:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*done), kind)], schema=kind)

    return ordered.select("conv_id", "piece", "loss_start", "loss_end").mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_unmapped bigint")


def op2_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations")
    record = F.to_json(F.struct("role", "text", "turn"), {"ignoreNullFields": "false"})
    records = rows.select("conv_id", F.col("turn").alias("ord"), record.alias("record"))
    said = "</s>[INST] ok [/INST]"
    own = json.dumps({"messages": [{"role": "user", "content": said}, {"role": "assistant", "content": said}]})
    formatted = format_chats(records.union(spark.range(1).select(F.lit(-1).cast("long"), F.lit(0).cast("long"), F.lit(own))))
    path = common.scratch(spark, "chats")
    formatted.write.option("compression", "zstd").parquet(path)
    return read_back(spark.read.parquet(path))


_ADDED = f"len(regexp_extract_all({{0}}, '{CONTROL}', 0, 'i')) + length({{0}}) - length(replace({{0}}, '\\', ''))"
OP2_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), u AS (
  SELECT *, {len(BEGIN) + 1 + len(END)} + length(role) + {_ADDED.format("role")} + length(role) - length(replace(role, chr(10), ''))
    + length(text) + {_ADDED.format("text")} AS n FROM t
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, substr(sha256(role || chr(10) || text), 1, 16), role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, substr(sha256(role || chr(10) || text), 1, 16), role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_unmapped
FROM u GROUP BY conv_id
"""
