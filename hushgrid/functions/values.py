"""Scalar rules on single values, as Column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import taxonomy as T

# Day and month formats, tried in this order.
DATE_FORMATS = ("d MMMM yyyy", "d MMM yyyy", "MMMM d yyyy", "MMM d yyyy", "d/M/yyyy", "d-M-yyyy", "yyyy-M-d", "d.M.yyyy")


def let(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def collapse(value: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def alphanumeric(value: Column) -> Column:
    return F.regexp_replace(F.upper(value), "[^A-Z0-9]", "")


def normalize(entity_type: Column, value: Column) -> Column:
    """The form in which two values are the same identity."""
    return (
        F.when(entity_type == "EMAIL", F.lower(F.regexp_replace(value, r"(?U)\s+", "")))
        .when(entity_type == "PAN_LIKE", F.upper(F.regexp_replace(value, r"(?U)\s+", "")))
        .when(entity_type.isin(*T.TEXTUAL), F.lower(collapse(value)))
        .when(entity_type.isin(*T.ALPHANUMERIC), alphanumeric(value))
        .otherwise(digits(value))
    )


def mask(entity_type: Column, value: Column) -> Column:
    """Level 1: what shows of a masked value."""
    return let(normalize(entity_type, value), lambda norm: _masked(entity_type, norm))


def _masked(entity_type: Column, norm: Column) -> Column:
    last4 = F.substring(norm, -4, 4)
    last4 = F.when(F.length(norm) <= 4, norm).otherwise(last4)
    at = F.instr(norm, "@")
    local = F.when(at > 0, F.substring_index(norm, "@", 1)).otherwise(norm)
    first = F.substring(local, 1, 1)
    domain = F.when(at > 0, norm.substr(at + 1, F.length(norm))).otherwise(F.lit(""))
    return (
        F.when(entity_type == "PHONE", F.concat(F.repeat(F.lit("X"), F.greatest(F.lit(0), F.length(norm) - 4)), last4))
        .when(entity_type == "AADHAAR_LIKE", F.concat(F.lit("XXXX XXXX "), last4))
        .when(entity_type == "PAN_LIKE", F.concat(F.lit("XXXXXX"), last4))
        .when(entity_type == "EMAIL", F.concat(F.when(first == "", "x").otherwise(first), F.lit("***@"), domain))
        .when(entity_type == "PERSON_NAME", "[NAME PROTECTED]")
        .when(entity_type == "CASE_REFERENCE", "[REFERENCE PROTECTED]")
        .when(entity_type == "PAYMENT_CARD_NUMBER", F.concat(F.lit("XXXX XXXX XXXX "), F.when(norm == "", "XXXX").otherwise(last4)))
        .when(entity_type.isin(*T.ALPHANUMERIC), F.when(norm == "", "[CREDENTIAL MASKED]").otherwise(F.concat(F.lit("[CREDENTIAL MASKED "), last4, F.lit("]"))))
        .otherwise("[PROTECTED]")
    )


def luhn(value: Column) -> Column:
    """13 to 19 digits, more than one of them distinct, with a valid check digit."""
    d = digits(value)
    return F.coalesce(F.length(d).between(13, 19) & ~d.rlike(r"^(\d)\1*$") & F.call_function("luhn_check", d), F.lit(False))


def parse_date(value: Column) -> Column:
    """First format that fits; a numeric d/m comes before m/d."""
    return let(collapse(F.regexp_replace(value, ",", "")), lambda text: F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS])).cast("date")


def year_of(value: Column) -> Column:
    found = F.regexp_extract(value, r"\b((?:19|20)\d{2})\b", 1)
    return F.coalesce(F.year(parse_date(value)), F.when(found != "", found).cast("int"))


def has_any(value: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | value.contains(w)
    return out


def band_of_birth(value: Column) -> Column:
    band = lambda start: F.concat(F.lit("Born "), start.cast("string"), F.lit("-"), (start + 4).cast("string"))
    return F.coalesce(let(let(year_of(value), lambda y: y - F.pmod(y, F.lit(5))), band), F.lit("Birth year band protected"))


def band_of_age(value: Column) -> Column:
    age = F.regexp_extract(value, r"[0-9]{1,3}", 0)
    n = F.when(age != "", age).cast("int")
    out = F.when(n.isNull(), "Age band protected")
    for low, high in ((0, 12), (13, 17), (18, 24), (25, 34), (35, 44), (45, 54), (55, 64)):  # fixed values
        out = out.when(n.between(low, high), f"Age {low}-{high}")
    return out.otherwise("Age 65+")


def coarse_place(value: Column) -> Column:
    low = F.lower(value)
    parts = F.size(F.filter(F.split(value, ","), lambda p: F.trim(p) != ""))
    return (
        F.when(has_any(low, ("bengaluru", "bangalore")), "Bengaluru metropolitan area")
        .when(low.contains("mumbai"), "Mumbai metropolitan area")
        .when(low.contains("delhi"), "Delhi metropolitan area")
        .when(low.rlike(r"\b(?:street|st|avenue|ave|road|rd|lane|ln|boulevard|blvd|drive|dr|way|court|ct)\b"), "Urban street area")
        .when(parts >= 2, "Regional urban area")
        .otherwise("City-level location")
    )


#: First family with a word in the value wins.
EMPLOYERS = ((("analytics", "data", "software", "tech"), "Private analytics organisation"), (("hospital", "clinic", "health"), "Healthcare organisation"), (("college", "university", "school"), "Education institution"), (("government", "ministry", "department"), "Public-sector organisation"))
JOBS = ((("junior", "trainee", "intern", "associate"), "Early-career professional"), (("analyst", "data", "research"), "Data and research professional"), (("engineer", "developer", "architect"), "Technical professional"), (("manager", "lead", "director"), "Management professional"))


def by_family(value: Column, families, rest: str) -> Column:
    low, out = F.lower(value), None
    for words, name in families:
        test = has_any(low, words)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(rest)


def generalize(entity_type: Column, value: Column) -> Column:
    d, year = digits(value), year_of(value)
    return (
        F.when(entity_type == "DATE_OF_BIRTH", band_of_birth(value))
        .when(entity_type == "AGE", band_of_age(value))
        .when(entity_type.isin("STREET_ADDRESS", "LOCALITY"), coarse_place(value))
        .when(entity_type == "POSTCODE", F.when(F.length(d) >= 3, F.concat(F.substring(d, 1, 3), F.lit("XXX"))).otherwise("Regional postcode"))
        .when(entity_type == "EMPLOYER", by_family(value, EMPLOYERS, "Private-sector organisation"))
        .when(entity_type == "JOB_TITLE", by_family(value, JOBS, "Professional role"))
        .when(entity_type == "PERSON_TITLE", "Personal title protected")
        .when(entity_type == "GENERIC_DATE", F.coalesce(F.concat(F.lit("Date in "), year.cast("string")), F.lit("Date generalized")))
        .when(entity_type == "BUILDING_NUMBER", "Building number generalized")
        .when(entity_type == "DEMOGRAPHIC_ATTRIBUTE", "Demographic category protected")
        .when(entity_type == "CASE_REFERENCE", "[REFERENCE PROTECTED]")
        .otherwise("[GENERALIZED]")
    )


def letter(ordinal: Column) -> Column:
    """A to Z, then A2 to Z2 and on."""
    char = F.char(F.lit(65) + F.pmod(ordinal, F.lit(26)))
    return F.when(ordinal < 26, char).otherwise(F.concat(char, (F.floor(ordinal / 26) + 1).cast("string")))


def lookup(key: Column, table: dict[str, str], rest: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), rest)


def replacement(entity_type: Column, value: Column, action: Column, ordinal: Column) -> Column:
    """What stands for a value after an action; ``ordinal`` counts the entities of its type from 0."""
    token = F.concat(F.lit("["), lookup(entity_type, T.TOKEN_PREFIX, entity_type), F.lit("_"), F.format_string("%03d", (ordinal + 1).cast("int")), F.lit("]"))
    return (
        F.when(action == "RETAIN", value)
        .when(action == "REMOVE", lookup(entity_type, T.REMOVED_TEXT, F.lit("[PROTECTED]")))
        .when(action == "PROTECT", token)
        .when(action == "MASK", F.when(entity_type.isin(*T.QUASI), "[CONTEXT PROTECTED]").otherwise(mask(entity_type, value)))
        .when(action == "SYNTHESIZE", "[SYNTHETIC TWIN VALUE]")
        .when(action == "PSEUDONYMIZE", F.concat(lookup(entity_type, T.ALIAS_PREFIX, F.lit("Pseudonym")), F.lit(" "), letter(ordinal)))
        .otherwise(generalize(entity_type, value))
    )


def band(score: Column) -> Column:
    return F.when(score >= 75, "critical").when(score >= 50, "high").when(score >= 25, "moderate").otherwise("low")


def relation(context: Column) -> Column:
    """Name of the relation that a label tells of."""
    low, out = F.lower(F.coalesce(context, F.lit(""))), None
    for w in T.RELATION_WORDS:
        name = "emergency contact person" if w == "emergency contact" else w
        out = F.when(low.contains(w), name) if out is None else out.when(low.contains(w), name)
    return out.otherwise("related person")


def is_related(context: Column) -> Column:
    return has_any(F.lower(F.coalesce(context, F.lit(""))), T.RELATION_WORDS)


def header_key(value: Column) -> Column:
    return F.lower(collapse(F.regexp_replace(F.translate(value, "_/-", "   "), r"[*`#:]+", " ")))


def pointer_escape(part: Column) -> Column:
    return F.replace(F.replace(part, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def leaf_header(path: Column) -> Column:
    """Last four names of a path, list places left out."""
    names = F.filter(path, lambda p: ~p.rlike(r"^\[?[0-9]+\]?$"))
    return F.array_join(F.when(F.size(names) > 4, F.slice(names, -4, 4)).otherwise(names), ".")


def neutralize_formula(cell: Column) -> Column:
    """A cell that a spreadsheet would compute gets a quote before it."""
    return F.when(cell.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def safe_filename(name: Column) -> Column:
    """Base name of safe characters, at most 120, its suffix kept."""
    base = F.regexp_extract(F.regexp_replace(name, r"\\", "/"), r"([^/]*)$", 1)
    clean = F.regexp_replace(F.regexp_replace(base, r"[\x00-\x1f\x7f]", ""), r"[^A-Za-z0-9._ ()\-]+", "_")
    clean = F.regexp_replace(F.regexp_replace(clean, r"\s+", " "), r"^[ .]+|[ .]+$", "")
    suffix = F.regexp_extract(clean, r"(\.[^.]*)$", 1)
    capped = F.when(F.length(clean) > 120, F.concat(clean.substr(F.lit(1), F.lit(120) - F.length(suffix)), suffix)).otherwise(clean)
    return F.coalesce(F.nullif(capped, F.lit("")), F.lit("input"))


def metric_path(path: Column) -> Column:
    """Ids in a request path replaced, 180 characters at most."""
    out = F.regexp_replace(path, r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "{id}")
    return F.substring(F.regexp_replace(out, r"(?i)\b[0-9a-f]{16,}\b", "{id}"), 1, 180)


def cell_text(value: Column, kind: Column) -> Column:
    """What a cell shows: null is empty, booleans lower-case, whole floats as integers."""
    whole = value.try_cast("double")
    return F.when(value.isNull(), "").when(kind == "boolean", F.lower(value)).when((kind == "double") & (whole == F.floor(whole)) & (F.abs(whole) < 1e15), whole.cast("long").cast("string")).otherwise(value)


def like_original(number: Column, original: Column) -> Column:
    """A number with the decimals (six at most) that the original has."""
    places = F.least(F.lit(6), F.length(F.regexp_extract(original, r"\.(\d+)$", 1)))
    return F.when(places == 0, F.bround(number, 0).cast("long").cast("string")).otherwise(F.format_string("%.6f", number).substr(F.lit(1), F.length(F.format_string("%.6f", number)) - 6 + places))


def normalized_row(cells: list[Column]) -> Column:
    return F.array(*[F.lower(collapse(F.coalesce(c.cast("string"), F.lit("")))) for c in cells])


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))


def iou(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Overlap of two character intervals over their union."""
    common = F.greatest(F.lit(0), F.least(a[1], b[1]) - F.greatest(a[0], b[0]))
    union = (a[1] - a[0]) + (b[1] - b[0]) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def containment(inner: tuple[Column, Column], outer: tuple[Column, Column]) -> Column:
    common = F.greatest(F.lit(0), F.least(inner[1], outer[1]) - F.greatest(inner[0], outer[0]))
    return F.when(inner[1] > inner[0], common / (inner[1] - inner[0])).otherwise(0.0)


def rect_iou(a: Column, b: Column) -> Column:
    """Overlap of two rectangles (struct x0, y0, x1, y1) over their union."""
    w = F.greatest(F.lit(0.0), F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0))
    h = F.greatest(F.lit(0.0), F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))
    union = (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def present(entity_type: Column, value: Column, text: Column) -> Column:
    """Whether a value can be read in a text, under the rule of its type; empty forms never can."""
    norm = normalize(entity_type, value)
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"(?U)\W+", " ")), F.lit(" "))
    needle = F.trim(F.regexp_replace(F.lower(value), r"(?U)\W+", " "))
    age = F.regexp_extract(value, r"[0-9]{1,3}", 0)
    # the age on its own: not part of a number, a range or a hyphenated code
    spaced = F.concat(F.lit(" "), F.regexp_replace(text, r"[^0-9\-]", " "), F.lit(" "))
    textual = [t for t in T.TEXTUAL if t != "AGE"]
    return F.coalesce(
        F.when(entity_type == "EMAIL", (norm != "") & F.regexp_replace(F.lower(text), r"(?U)\s+", "").contains(norm))
        .when(entity_type == "PAN_LIKE", (norm != "") & F.regexp_replace(F.upper(text), r"(?U)\s+", "").contains(norm))
        .when(entity_type == "AGE", (age != "") & spaced.contains(F.concat(F.lit(" "), age, F.lit(" "))))
        .when(entity_type.isin(*textual), (needle != "") & words.contains(F.concat(F.lit(" "), needle, F.lit(" "))))
        .when(entity_type.isin(*T.ALPHANUMERIC), (norm != "") & alphanumeric(text).contains(norm))
        .otherwise((norm != "") & digits(text).contains(norm)),
        F.lit(False),
    )


def splice(text: Column, spans: Column) -> Column:
    """``text`` with each span (struct start, end, replacement; ascending, apart, 0-based) replaced."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(
        spans,
        start,
        lambda acc, s: F.struct(F.concat(acc.out, text.substr(acc.at + 1, s.start - acc.at), s.replacement).alias("out"), s.end.cast("int").alias("at")),
        lambda acc: F.concat(acc.out, text.substr(acc.at + 1, F.length(text))),
    )
