"""Instructions, rewriting of texts and tables, and synthetic twins."""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import taxonomy as T
from ..functions import values as V
from . import entities as E
from . import graph as G


def instructions(mentions: DataFrame, entities: DataFrame, level: int, audience: str) -> DataFrame:
    """What to write over each mention: those kept as they are or ignored by the reviewer have none."""
    aliased = E.alias_ordinals(entities).select("doc_id", "entity_type", "normalized", "entity_id", "alias")
    norm = mentions.withColumn("normalized", V.normalize(F.col("entity_type"), F.col("plaintext")))
    joined = norm.join(aliased, ["doc_id", "entity_type", "normalized"]).filter("review_status <> 'IGNORE'")
    acted = G.with_actions(joined, level, audience).filter("action <> 'RETAIN'")
    return acted.select("doc_id", "entity_id", "entity_type", "char_start", "char_end", "plaintext", "action", V.replacement(F.col("entity_type"), F.col("plaintext"), F.col("action"), F.col("alias")).alias("replacement"))


def open_reviews(mentions: DataFrame) -> DataFrame:
    """Documents that may not be transformed yet, with the number of mentions that wait."""
    return mentions.filter("review_status = 'PENDING'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("pending"))


def settle(spans: list[tuple[int, int, str]]) -> list[bool]:
    """Which of the spans (start, end, type) stay: the longest first, then the first, then the one of the lesser type; a
    span falls only to one that stays and overlaps it. Empty spans stay nowhere."""
    starts: list[int] = []
    ends: list[int] = []
    kept = [False] * len(spans)
    for k in sorted(range(len(spans)), key=lambda k: (spans[k][0] - spans[k][1], *spans[k])):
        a, b, _ = spans[k]
        at = bisect_right(starts, a)
        if a < b and (at == 0 or ends[at - 1] <= a) and (at == len(starts) or b <= starts[at]):
            starts.insert(at, a)
            ends.insert(at, b)
            kept[k] = True
    return kept


def resolve(spans: DataFrame) -> DataFrame:
    """Spans with ``kept``: of overlapping ones the longest, then the first, then the one of the lesser type (``settle``).

    The rule is the one that ``sanitize`` writes by. A document's spans make one row. Of equal spans one stays.
    """
    numbered = spans.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in spans.columns]))
    lists = numbered.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("char_start").cast("long").alias("a"), F.col("char_end").cast("long").alias("b"), "entity_type", F.col("_row").alias("row")))).alias("all"))

    @F.arrow_udf("array<boolean>")
    def run(all_: pa.Array) -> pa.Array:
        return pa.array([settle([(x["a"], x["b"], x["entity_type"] or "") for x in own]) for own in all_.to_pylist()], type=pa.list_(pa.bool_()))

    places = F.transform("all", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["entity_type"].alias("entity_type")))
    out = lists.withColumn("kept", run(places)).select(F.explode(F.arrays_zip("all", "kept")).alias("z"))
    return out.select("z.all.row.*", F.col("z.kept").alias("kept"))


def splice(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Documents with their spans replaced, in one grouping on doc_id; spans must not overlap."""
    pieces = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("char_start").cast("int").alias("start"), F.col("char_end").cast("int").alias("end"), "replacement"))).alias("spans"))
    return docs.join(pieces.hint("merge"), "doc_id", "left").withColumn("protected", F.when(F.col("spans").isNull(), F.col("text")).otherwise(V.splice(F.col("text"), F.col("spans")))).drop("spans")


# Ends of company names that a short form leaves out.
LEGAL = re.compile(r"\s*[,.-]?\s*(?:pvt\.?\s*lt[d.]?|private\s+limited|llp|llc|ltd\.?|limited|inc\.?|incorporated|corp\.?|corporation|co\.?|company)\s*$", re.I)


def variants(entity_type: str, value: str) -> list[str]:
    """Forms under which a value is looked for elsewhere, longest first."""
    whole = re.sub(r"\s+", " ", value).strip()
    out = [whole] if len(re.sub(r"[^0-9A-Za-z]", "", whole)) >= 5 else []
    short = LEGAL.sub("", whole).strip(" ,.-") if entity_type == "EMPLOYER" else whole.split(",")[0].strip() if entity_type in ("LOCALITY", "STREET_ADDRESS") else ""
    if len(short) >= 5 and re.search("[A-Za-z]", short) and short.casefold() != whole.casefold():
        out.append(short)
    return sorted(out, key=len, reverse=True)


def literal(value: str) -> re.Pattern[str]:
    """A value as written with any white space, not inside a word."""
    body = r"\s+".join(map(re.escape, value.split()))
    return re.compile((r"(?<![\w@])" if value[0].isalnum() else "") + body + (r"(?![\w@])" if value[-1].isalnum() else ""), re.I)


def rewrite(text: str, spans: list[tuple[int, int, str, str]]) -> tuple[str, int, int]:
    """(protected text, spans written, occurrences found besides) for (start, end, type, replacement) spans.

    Overlapping spans are settled, the longest first. Then further occurrences of each value and its short forms are
    replaced too where they are free, longest first.
    """
    starts: list[int] = []
    taken: list[tuple[int, int, str]] = []

    def take(a: int, b: int, new: str) -> bool:
        """Write over [a, b) if nothing is written there yet; what is written stays in order."""
        at = bisect_right(starts, a)
        if at and taken[at - 1][1] > a or at < len(taken) and taken[at][0] < b:
            return False
        starts.insert(at, a)
        taken.insert(at, (a, b, new))
        return True

    inside = [s for s in spans if 0 <= s[0] < s[1] <= len(text)]
    own = sum(take(a, b, new) for a, b, _, new in sorted(inside, key=lambda s: (s[0] - s[1], s[0], s[1], s[2])))
    found = []
    for kind, new, value in {(k, n, text[a:b]) for a, b, k, n in inside}:
        for form in variants(kind, value):
            found += [(len(form), *m.span(), new) for m in literal(form).finditer(text)]
    for _, a, b, new in sorted(found, key=lambda f: (-f[0], f[1], f[2], f[3])):
        take(a, b, new)
    out, at = [], 0
    for a, b, new in taken:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), own, len(taken) - own


def sanitize(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, text, protected, written, propagated: spans replaced and their values looked for elsewhere in the text."""
    listed = spans.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("char_start").cast("int").alias("a"), F.col("char_end").cast("int").alias("b"), "entity_type", "replacement")).alias("spans"))

    @F.arrow_udf("protected string, written int, propagated int")
    def run(texts: pa.Array, all_spans: pa.Array) -> pa.Array:
        made = [(t, 0, 0) if t is None or not s else rewrite(t, [(x["a"], x["b"], x["entity_type"], x["replacement"]) for x in s]) for t, s in zip(texts.to_pylist(), all_spans.to_pylist())]
        kinds = (pa.string(), pa.int32(), pa.int32())
        return pa.StructArray.from_arrays([pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)], names=["protected", "written", "propagated"])

    return docs.select("doc_id", "text").join(listed.hint("merge"), "doc_id", "left").withColumn("r", run("text", "spans")).select("doc_id", "text", "r.*")


def _in_cell() -> Column:
    """Whether a span s lies in a cell c of its record."""
    inside = (F.col("s.char_start") >= F.col("c.char_start")) & (F.col("s.char_end") <= F.col("c.char_end"))
    return (F.col("s.doc_id") == F.col("c.doc_id")) & (F.col("s.record") == F.col("c.record")) & inside


def spans_in_cells(cells: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, record, column, char_start, char_end of each span and the cell that it lies in."""
    hits = spans.alias("s").join(cells.alias("c"), _in_cell())
    return hits.select("s.doc_id", "s.record", "c.column", "s.char_start", "s.char_end")


def unmatched_spans(cells: DataFrame, spans: DataFrame) -> DataFrame:
    """The spans that ``sanitize_cells`` does not write, with ``hits``: in how many cells each lies (0, or more than one)."""
    key = ["doc_id", "record", "char_start", "char_end"]
    n = spans_in_cells(cells, spans).groupBy(*key).agg(F.count(F.lit(1)).alias("hits"))
    return spans.join(n, key, "left").withColumn("hits", F.coalesce("hits", F.lit(0))).filter("hits <> 1")


def annotations(mentions: DataFrame, instructions: DataFrame) -> DataFrame:
    """A row of evidence for each mention: what was found, where, and what became of it.

    mentions: doc_id, char_start, char_end, entity_type, plaintext, confidence, review_status, context_label. A mention
    without an instruction was kept as it is. Plain values are not part of the rows; their length is.
    """
    acted = instructions.select("doc_id", "char_start", "char_end", "entity_type", "action", "replacement").dropDuplicates(["doc_id", "char_start", "char_end", "entity_type"])
    out = mentions.join(acted, ["doc_id", "char_start", "char_end", "entity_type"], "left")
    return out.select("doc_id", "char_start", "char_end", "entity_type", F.length("plaintext").alias("n_chars"), "confidence", "review_status", "context_label", F.coalesce("action", F.lit("RETAIN")).alias("action"), "replacement", F.col("action").isNotNull().alias("transformed"))


def sanitize_cells(cells: DataFrame, spans: DataFrame) -> DataFrame:
    """Cells (doc_id, record, column, value, char_start, char_end) with the spans that lie in exactly one of them replaced.

    Spans that hit no cell, or more than one, are not written; ``unmatched_spans`` returns them.
    """
    hits = spans.alias("s").join(cells.alias("c"), _in_cell())
    once = hits.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("s.doc_id", "s.char_start", "s.char_end", "s.record"))).filter("n = 1")
    local = once.select(F.col("c.doc_id").alias("doc_id"), F.col("c.record").alias("record"), F.col("c.column").alias("column"), F.struct((F.col("s.char_start") - F.col("c.char_start")).cast("int").alias("start"), (F.col("s.char_end") - F.col("c.char_start")).cast("int").alias("end"), F.col("s.replacement").alias("replacement")).alias("span"))
    spans_of = local.groupBy("doc_id", "record", "column").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    return cells.join(spans_of, ["doc_id", "record", "column"], "left").withColumn("value", F.when(F.col("spans").isNull(), F.col("value")).otherwise(V.splice(F.col("value"), F.col("spans")))).drop("spans")


def anchor_rects(frames: DataFrame, anchors: DataFrame, hold: int) -> DataFrame:
    """Rectangle of a track in each frame: between two anchors interpolated, outside them held for ``hold`` frames.

    frames: track, frame. anchors: track, frame, x0, y0, x1, y1. One shuffle on the track; windows look both ways.
    """
    box = F.struct("frame", "x0", "y0", "x1", "y1")
    marked = frames.select("track", "frame").join(anchors.withColumn("box", box).select("track", "frame", "box"), ["track", "frame"], "left")
    back = Window.partitionBy("track").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("track").orderBy("frame").rowsBetween(0, Window.unboundedFollowing)
    marked = marked.withColumn("l", F.last("box", ignorenulls=True).over(back)).withColumn("r", F.first("box", ignorenulls=True).over(ahead))
    gap = F.col("r.frame") - F.col("l.frame")
    t = F.when(gap == 0, F.lit(0.0)).otherwise((F.col("frame") - F.col("l.frame")) / gap)
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    near = F.when(both, True).when(F.col("l").isNotNull(), F.col("frame") - F.col("l.frame") <= hold).when(F.col("r").isNotNull(), F.col("r.frame") - F.col("frame") <= hold).otherwise(False)
    value = lambda c: F.when(both, F.col(f"l.{c}") + (F.col(f"r.{c}") - F.col(f"l.{c}")) * t).otherwise(F.coalesce(f"l.{c}", f"r.{c}")).cast("double")
    return marked.filter(near).select("track", "frame", *[value(c).alias(c) for c in ("x0", "y0", "x1", "y1")])


# --- synthetic twins -------------------------------------------------------------------------------------

# Words in a header that tell a column's role.
ROLES = (("EMAIL", r"e-?mail"), ("PHONE", r"phone|mobile|telephone"), ("DATE_OF_BIRTH", r"birth|dob"), ("AGE", r"(?:^|[ _])age(?:$|[ _])"), ("POSTCODE", r"post|zip|pin ?code"), ("CASE_REFERENCE", r"case|reference|ref$"), ("LOCALITY", r"city|locality|town|district"), ("EMPLOYER", r"employer|organi[sz]ation|company"), ("JOB_TITLE", r"job|designation|occupation|title"), ("STREET_ADDRESS", r"address|street"), ("PERSON_NAME", r"name|participant|patient|customer"))


def role(header: str) -> str | None:
    return next((kind for kind, p in ROLES if re.search(p, header, re.I)), None)


def unit(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) from a seed and a key; the same for the same input on every run."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / float(1 << 40)


def normal(seed: str, *keys: Column) -> Column:
    u = F.greatest(unit(seed + ":u", *keys), F.lit(1e-12))
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * F.lit(3.141592653589793) * unit(seed + ":v", *keys))


def twin_seed(df: DataFrame, name: str, salt: bytes) -> str:
    """A seed that only holders of the salt can compute: a keyed digest of the table's name and of all its rows, in any order."""
    own = F.xxhash64(F.to_json(F.struct(*df.columns)))
    r = df.agg(F.bit_xor(own).alias("x"), F.sum(own.cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).first()
    return hmac.new(salt, f"hushgrid-twin|{name}|{r['x']}|{r['s']}|{r['n']}".encode(), hashlib.sha256).hexdigest()


def drawn(seed: str, what: str, below: int) -> int:
    """A number in [0, below) that follows from the seed."""
    return int.from_bytes(hmac.new(seed.encode(), what.encode(), hashlib.sha256).digest()[:8], "big") % max(1, below)


def shifted(df: DataFrame, column: str, days: int) -> DataFrame:
    """``df`` with a date or timestamp column moved by the same days in every row, so that order and gaps stay."""
    k = dict(df.dtypes)[column]
    moved = F.date_add(column, days) if k == "date" else F.col(column) + F.make_dt_interval(F.lit(days))
    return df.withColumn(column, moved.cast(k))


def turned(df: DataFrame, key: str, column: str, by: int) -> DataFrame:
    """``df`` with a column's values moved ``by`` rows on in the order of ``key`` (unique): a rotation, so no row keeps its own unless ``by`` is a multiple of the rows.

    Rows are numbered inside ranges of the key and shifted by the sizes of the ranges before, so no task holds the table.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, key).withColumn("_part", F.spark_partition_id())
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sizes = dealt.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    row = F.col("_base") + F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    rows = dealt.join(F.broadcast(sizes), "_part").withColumn("_row", row).drop("_part", "_base")
    size = df.agg(F.count(F.lit(1)).alias("_n"))
    donors = rows.select(F.col("_row").alias("_from"), F.col(column).alias("_value"))
    out = rows.crossJoin(F.broadcast(size)).withColumn("_from", F.pmod(F.col("_row") + by, F.col("_n"))).join(donors, "_from")
    return out.withColumn(column, F.col("_value")).select(*df.columns)


def twin(df: DataFrame, key: str, salt: bytes, name: str = "table", overrides: DataFrame | None = None) -> DataFrame:
    """A table like ``df`` without its rows.

    All that is drawn follows from ``twin_seed``, so that nobody without the salt can undo it. Row numbers come from a
    hash of the key, and each row's donor is the row a seeded step further round: never itself. All numeric columns take
    the same donor, which keeps their correlations, plus 3.5 % of a deviation of noise; dates move by one step for each
    column; categories (at most 32 values, at most half distinct) turn one further in their order; columns of a person's
    data get made-up values; other text gets a numbered stand-in. ``overrides`` (the key's original value as ``key``,
    column, value) come last: the value that an entity has elsewhere. A table of one row has no donor and is refused; an
    empty one stays empty.
    """
    n = df.count()
    if n == 1:
        raise ValueError("a table of one row has no twin: every donor would be the row itself")
    seed = twin_seed(df, name, salt)
    numbered = number_rows(df, key, seed).withColumn("_own", F.col(key).cast("string"))
    step = 1 + drawn(seed, "step", n - 1)
    kinds = dict(df.dtypes)
    numeric = [c for c, k in kinds.items() if c != key and k in ("int", "bigint", "double", "float", "smallint")]
    donors = numbered.select(F.pmod(F.col("_row") - step, F.lit(max(1, n))).alias("_row"), *[F.col(c).alias(f"_{c}") for c in numeric])
    spreads = df.agg(F.lit(0).alias("_"), *[F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(c) for c in numeric]).first()
    texts = [c for c, k in kinds.items() if k == "string" and c != key and role(c) is None]
    distinct = {c: [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().limit(33).collect()] for c in texts}  # 33 tell that there are too many
    out = numbered.join(donors, "_row")
    for c, k in kinds.items():
        what = role(c)
        if c in numeric:
            if what == "AGE":
                jitter = F.floor(unit(f"{seed}:{c}", F.col("_row")) * 5) - 2
                out = out.withColumn(c, F.least(F.lit(99), F.greatest(F.lit(1), F.col(f"_{c}") + F.when(jitter == 0, 1).otherwise(jitter))).cast(k))
            else:
                noisy = F.col(f"_{c}") + normal(f"{seed}:{c}", F.col("_row")) * (0.035 * float(spreads[c]))
                out = out.withColumn(c, (F.bround(noisy, 0) if "int" in k else noisy).cast(k))
        elif k in ("date", "timestamp"):
            out = shifted(out, c, 181 + drawn(seed, f"days:{c}", 549))
        elif c == key:
            out = out.withColumn(c, (F.col("_row") + 1).cast(k) if k != "string" else F.concat(F.lit("S"), F.lpad((F.col("_row") + 1).cast("string"), 9, "0")))
        elif c in distinct and len(distinct[c]) <= 32 and len(distinct[c]) * 2 <= n:
            values = sorted(distinct[c])
            turn = {v: values[(j + 1) % len(values)] for j, v in enumerate(values)}
            out = out.withColumn(c, V.lookup(F.col(c), turn, F.lit(None).cast("string"))) if values else out
        elif k == "string":
            number = F.lpad((F.floor(unit(f"{seed}:{c}", F.col("_row")) * 90_000) + 10_000).cast("string"), 5, "0")
            made = {"EMAIL": F.concat(F.lit("person"), number, F.lit("@synthetic.example")), "PHONE": F.concat(F.lit("+00 55500 "), number), "PERSON_NAME": F.concat(F.lit("Synthetic Person "), number), "POSTCODE": F.concat(F.lit("9"), number)}.get(what, F.concat(F.lit(f"Synthetic {c} "), number))
            out = out.withColumn(c, F.when(F.col(c).isNotNull(), made))
    if overrides is not None:
        told = overrides.groupBy(F.col("key").cast("string").alias("_own")).agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("_told"))
        out = out.join(told, "_own", "left")
        for c, k in kinds.items():
            out = out.withColumn(c, F.coalesce(F.element_at("_told", F.lit(c)).cast(k), F.col(c)))
    return out.select(*df.columns)


def number_rows(df: DataFrame, key: str, seed: str) -> DataFrame:
    """Rows numbered 0 to n-1 in an order by hash: by bucket and place in it, so that no task holds all rows."""
    buckets = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    marked = df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key))).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    sizes = marked.groupBy("_b").count()
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    base = sizes.select("_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) - 1
    return marked.withColumn("_place", place).join(F.broadcast(base), "_b").withColumn("_row", F.col("_base") + F.col("_place")).drop("_h", "_b", "_base", "_place")
