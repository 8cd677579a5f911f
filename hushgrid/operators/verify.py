"""Gates over protected output. Each gate gives doc_id, name, status, detail; any failure blocks the release.

protected: doc_id, text (original), protected. known: doc_id, entity_id, entity_type, plaintext (what was transformed).
Gates are independent lazy DataFrames; ``run`` unions them and ``release`` makes one aggregation a document.
Documents, values and instructions all grow with the corpus, so joins on doc_id are merged at every size: a broadcast
would be built in the driver's memory, and a small file of documents is a large table there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V

# Severity of a gate, and its points.
CRITICAL = ("direct_identifier_rescan", "independent_extraction", "secondary_text_parser_rescan", "secondary_structured_parser_rescan", "docx_parser_rescan", "docx_hidden_channel_scan", "hidden_markup_payload_scan", "structured_hidden_channel_scan", "policy_coverage", "raw_object_stream_scan", "original_identifier_absence", "record_copy_attack")
MEDIUM = ("utility_anchor_preservation",)
POINTS = {"critical": 12, "high": 8, "medium": 4}
FRAGMENT = {"PHONE": 7, "AADHAAR_LIKE": 9, "PAN_LIKE": 7, "EMAIL": 6, "CASE_REFERENCE": 8, "NATIONAL_ID": 7, "PASSPORT_NUMBER": 7, "DRIVER_LICENSE_NUMBER": 7, "TAX_IDENTIFIER": 7, "SOCIAL_IDENTIFIER": 7, "PAYMENT_CARD_NUMBER": 7}
TEXT_SUITE = ("direct_identifier_rescan", "independent_extraction", "secondary_text_parser_rescan", "hidden_markup_payload_scan", "character_span_integrity", "metadata_and_embedded_content", "policy_coverage", "relationship_consistency", "raw_object_stream_scan", "direct_identifier_fragment_attack", "replacement_presence_attack", "utility_anchor_preservation")
SUITES = {
    "TEXT": TEXT_SUITE,
    "DATASET": tuple({"secondary_text_parser_rescan": "secondary_structured_parser_rescan", "hidden_markup_payload_scan": "structured_hidden_channel_scan", "character_span_integrity": "structured_cell_integrity", "utility_anchor_preservation": "structured_schema_preservation"}.get(g, g) for g in TEXT_SUITE),
    "DOCX": tuple({"secondary_text_parser_rescan": "docx_parser_rescan", "hidden_markup_payload_scan": "docx_hidden_channel_scan", "character_span_integrity": "docx_content_integrity", "utility_anchor_preservation": "docx_structure_preservation"}.get(g, g) for g in TEXT_SUITE),
}


def severity(name: Column) -> Column:
    return F.when(name.isin(*CRITICAL), "critical").when(name.isin(*MEDIUM), "medium").otherwise("high")


def gate(docs: DataFrame, failures: DataFrame | None, name: str) -> DataFrame:
    """A row for each document: FAIL with the number of findings where ``failures`` (doc_id) has some, else PASS."""
    if failures is None:
        return docs.select("doc_id", F.lit(name).alias("name"), F.lit("INCONCLUSIVE").alias("status"), F.lit("not run").alias("detail"))
    n = failures.groupBy("doc_id").agg(F.count(F.lit(1)).alias("findings"))
    found = F.coalesce("findings", F.lit(0))
    return docs.select("doc_id").join(n.hint("merge"), "doc_id", "left").select("doc_id", F.lit(name).alias("name"), F.when(found > 0, "FAIL").otherwise("PASS").alias("status"), F.concat(found.cast("string"), F.lit(" findings")).alias("detail"))


def leaks(known: DataFrame, texts: DataFrame, text_col: str = "protected", min_digits: int = 4) -> DataFrame:
    """Known values that can still be read in the document's text. A join on doc_id, never across documents.

    Values of fewer than ``min_digits`` digits that are compared as bare digits would match inside any number; these
    leak only where they stand alone, as a number of their own.
    """
    joined = known.join(texts.select("doc_id", F.col(text_col).alias("_text")).hint("merge"), "doc_id")
    bare = F.col("entity_type").isin("PHONE", "AADHAAR_LIKE", "POSTCODE", "BUILDING_NUMBER")
    long = ~bare | (F.length(V.digits(F.col("plaintext"))) >= min_digits)
    own = V.digits(F.col("plaintext"))
    alone = (own != "") & F.concat(F.lit(" "), F.regexp_replace("_text", "[^0-9]+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), own, F.lit(" ")))
    return joined.filter(F.when(long, V.present(F.col("entity_type"), F.col("plaintext"), F.col("_text"))).otherwise(F.coalesce(alone, F.lit(False)))).drop("_text")


def squeezed_leaks(known: DataFrame, texts: DataFrame, text_col: str = "protected") -> DataFrame:
    """Another reading of the output: letters and digits alone, white space and marks gone."""
    squeeze = lambda c: F.regexp_replace(F.lower(c), r"(?U)[\W_]+", "")
    joined = known.join(texts.select("doc_id", squeeze(F.col(text_col)).alias("_text")).hint("merge"), "doc_id")
    value = squeeze(F.col("plaintext"))
    return joined.filter((F.length(value) >= 6) & F.col("_text").contains(value)).drop("_text")


def fragments(known: DataFrame, lines: DataFrame) -> DataFrame:
    """Known values of which a long piece survives in a line of the output.

    lines: doc_id, line_no, text. Digits for phones and Aadhaar numbers, letters and digits for the rest; for mail only
    the names of addresses that are left; for people any word of five letters. A document's lines become one row of
    forms, which its values' pieces are looked up in: the corpus is shuffled once by doc_id, and its n-grams never.
    """
    digit = F.col("entity_type").isin("PHONE", "AADHAAR_LIKE")
    person = F.col("entity_type") == "PERSON_NAME"
    size = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FRAGMENT.items() for x in kv]), F.col("entity_type")), F.lit(0))
    mail = F.col("entity_type") == "EMAIL"
    form = F.when(digit, V.digits(F.col("plaintext"))).when(mail, V.alphanumeric(F.substring_index("plaintext", "@", 1))).otherwise(V.alphanumeric(F.col("plaintext")))
    pieces = F.expr("CASE WHEN n > 0 AND length(form) >= n THEN transform(sequence(1, length(form) - n + 1), i -> substring(form, i, n)) ELSE array() END")
    words = F.expr(r"regexp_extract_all(lower(plaintext), '\\p{L}{5,}', 0)")
    values = known.withColumn("form", form).withColumn("n", size).withColumn("pieces", F.when(person, words).otherwise(pieces)).filter(F.size("pieces") > 0)
    mails = F.transform(F.expr(r"regexp_extract_all(text, '[A-Za-z0-9._%+*-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}', 0)"), lambda m: F.regexp_replace(F.upper(F.substring_index(m, "@", 1)), "[^A-Z0-9]", ""))
    # lines and addresses are kept apart by a line break, which no piece has
    joined = lambda c: F.array_join(F.collect_list(c), "\n")
    own = lines.groupBy("doc_id").agg(joined(V.digits(F.col("text"))).alias("_digits"), joined(V.alphanumeric(F.col("text"))).alias("_alnum"), joined(F.array_join(mails, "\n")).alias("_mails"), joined(F.concat(F.lit(" "), F.regexp_replace(F.lower("text"), r"\P{L}+", " "), F.lit(" "))).alias("_words"))
    where = F.when(digit, F.col("_digits")).when(mail, F.col("_mails")).otherwise(F.col("_alnum"))
    hit = F.when(person, F.exists("pieces", lambda p: F.contains(F.col("_words"), F.concat(F.lit(" "), p, F.lit(" "))))).otherwise(F.exists("pieces", lambda p: F.contains(where, p)))
    return values.join(own.hint("merge"), "doc_id").filter(hit).select("doc_id", "entity_type", "plaintext").distinct()


def uncovered(expected: DataFrame, instructions: DataFrame) -> DataFrame:
    """Entities that should have been transformed and were not."""
    return expected.join(instructions.select("doc_id", "entity_id").hint("merge"), ["doc_id", "entity_id"], "left_anti")


def inconsistent(instructions: DataFrame, unique_aliases: bool = False) -> DataFrame:
    """Entities with more than one replacement; with ``unique_aliases`` also replacements that two entities share."""
    many = instructions.groupBy("doc_id", "entity_id").agg(F.count_distinct("replacement").alias("n")).filter("n > 1").select("doc_id", "entity_id")
    if not unique_aliases:
        return many
    shared = instructions.groupBy("doc_id", "replacement").agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("entity_id")).filter("n > 1")
    return many.unionByName(shared.select("doc_id", "entity_id")).distinct()


def missing_replacements(instructions: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct replacements that the output does not show."""
    wanted = instructions.select("doc_id", "replacement").distinct()
    return wanted.join(texts.select("doc_id", "protected").hint("merge"), "doc_id").filter(~F.col("protected").contains(F.col("replacement"))).select("doc_id", "replacement")


def anchors(texts: DataFrame, spans: DataFrame, least: float = 0.90) -> DataFrame:
    """doc_id, anchors, preserved, ok: words of four letters outside the spans, and how many of them the output keeps.

    Words count as often as they occur, at most as often as the output has them. Fewer than five pass.
    """
    outside = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("char_start").cast("int").alias("start"), F.col("char_end").cast("int").alias("end"), F.lit(" ").alias("replacement")))).alias("spans"))
    both = texts.join(outside.hint("merge"), "doc_id", "left")
    bare = F.when(F.col("spans").isNull(), F.col("text")).otherwise(V.splice(F.col("text"), F.col("spans")))
    words = lambda df, col: df.select("doc_id", F.explode(F.expr(f"regexp_extract_all(lower({col}), '[a-z]{{4,}}', 0)")).alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    before = words(both.select("doc_id", bare.alias("bare")), "bare")
    after = words(texts, "protected").withColumnRenamed("n", "m")
    out = before.join(after.hint("merge"), ["doc_id", "word"], "left").groupBy("doc_id").agg(F.sum("n").alias("anchors"), F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("preserved"))
    return out.withColumn("ok", (F.col("anchors") < 5) | (F.col("preserved") >= F.col("anchors") * least))


def changed_outside(texts: DataFrame, instructions: DataFrame) -> DataFrame:
    """Documents whose output is not the original with the instructed spans, and further places of their values, replaced: what ``sanitize`` makes."""
    from .transform import sanitize

    made = sanitize(texts.select("doc_id", "text"), instructions).select("doc_id", F.col("protected").alias("_made"))
    return texts.select("doc_id", "protected").join(made.hint("merge"), "doc_id").filter("_made <> protected").select("doc_id")


def changed_cells(before: DataFrame, after: DataFrame, targets: DataFrame, key: list[str]) -> DataFrame:
    """Cells that differ and were not to be touched."""
    both = before.select(*key, F.col("value").alias("old")).join(after.select(*key, F.col("value").alias("new")).hint("merge"), key, "full")
    return both.filter(~F.col("old").eqNullSafe(F.col("new"))).join(targets.select(*key).hint("merge"), key, "left_anti")


def formula_cells(cells: DataFrame) -> DataFrame:
    return cells.filter(F.col("value").rlike(r"^[=+@]|^-[^0-9]"))


def hidden_markup(known: DataFrame, raw: DataFrame) -> DataFrame:
    """Known values in the raw bytes of an output, as UTF-8 or UTF-16, or destinations of RTF that show nothing."""
    joined = known.join(raw.select("doc_id", F.hex("content").alias("_hex")).hint("merge"), "doc_id")
    utf16 = F.hex(F.encode("plaintext", "UTF-16LE"))
    found = F.col("_hex").contains(F.hex(F.encode("plaintext", "UTF-8"))) | F.col("_hex").contains(utf16)
    return joined.filter((F.length("plaintext") >= 4) & found).drop("_hex")


def metadata_markers(raw: DataFrame, text_col: str = "protected") -> DataFrame:
    """Outputs with embedded objects, scripts or producer metadata."""
    low = F.lower(F.col(text_col))
    return raw.filter(V.has_any(low, ("/javascript", "/embeddedfile", "/openaction", "/launch", "\\object", "\\objdata", "\\info{", "<script"))).select("doc_id")


def row_copies(synthetic: DataFrame, original: DataFrame, columns: list[str]) -> DataFrame:
    """Synthetic rows that the original has too, compared as collapsed lower-case text."""
    key = F.sha2(F.concat_ws("\u001f", V.normalized_row([F.col(c) for c in columns])), 256)
    return synthetic.withColumn("_key", key).join(original.select(key.alias("_key")).distinct(), "_key", "left_semi").drop("_key")


def schema_signature(df: DataFrame) -> str:
    import hashlib
    import json

    return hashlib.sha256(json.dumps(sorted(df.columns), separators=(",", ":")).encode()).hexdigest()


def score(gates: DataFrame) -> DataFrame:
    """doc_id, score (share of points won, rounded), critical_failures, releasable."""
    points = F.element_at(F.create_map(*[F.lit(x) for kv in POINTS.items() for x in kv]), severity(F.col("name")))
    won = F.sum(F.when(F.col("status") == "PASS", points).otherwise(0))
    out = gates.groupBy("doc_id").agg(F.bround(100 * won / F.sum(points), 0).cast("int").alias("score"), F.count_if((F.col("status") != "PASS") & (severity(F.col("name")) == "critical")).alias("critical_failures"), F.bool_and(F.col("status") == "PASS").alias("all_pass"))
    return out.select("doc_id", "score", "critical_failures", (F.col("all_pass") & (F.col("score") == 100) & (F.col("critical_failures") == 0)).alias("releasable"))


def run(texts: DataFrame, known: DataFrame, expected: DataFrame, instructions: DataFrame, level: int, rescan: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The twelve gates of text. ``rescan`` detects mentions (doc_id, entity_type, plaintext) in the output."""
    docs = texts.select("doc_id")
    again = None
    if rescan is not None:
        allowed = instructions.select("doc_id", F.lower("replacement").alias("_v")).distinct()
        again = rescan(texts).filter(F.col("entity_type").isin(*FRAGMENT)).withColumn("_v", F.lower("plaintext")).join(allowed.hint("merge"), ["doc_id", "_v"], "left_anti")
    # an approved replacement may hold a value, which is no leak
    blanked = without_phrases(texts, instructions.select("doc_id", "replacement"))
    bytes_ = blanked.select("doc_id", F.encode("protected", "UTF-8").alias("content"))
    lines = blanked.select("doc_id", F.posexplode(F.split("protected", "\n")).alias("line_no", "text"))
    found = {
        "direct_identifier_rescan": again,
        "independent_extraction": leaks(known, blanked),
        "secondary_text_parser_rescan": squeezed_leaks(known, blanked),
        "hidden_markup_payload_scan": texts.filter(F.col("protected").rlike(r"\\\*\\(?:datastore|themedata|objdata)")),
        "character_span_integrity": changed_outside(texts, instructions),
        "metadata_and_embedded_content": metadata_markers(texts),
        "policy_coverage": uncovered(expected, instructions),
        "relationship_consistency": inconsistent(instructions, unique_aliases=level == 4),
        "raw_object_stream_scan": hidden_markup(known, bytes_),
        "direct_identifier_fragment_attack": fragments(known, lines),
        "replacement_presence_attack": missing_replacements(instructions, texts),
        "utility_anchor_preservation": anchors(texts, instructions).filter("not ok"),
    }
    out = None
    for name in TEXT_SUITE:
        one = gate(docs, found[name], name)
        out = one if out is None else out.unionByName(one)
    return out.withColumn("severity", severity(F.col("name")))


def without_phrases(texts: DataFrame, approved: DataFrame, text_col: str = "protected") -> DataFrame:
    """``texts`` with each approved replacement blanked out, longest first: a value inside one of them is no leak.

    approved: doc_id, replacement. A document's replacements make one row; the blanks keep words apart.
    """
    phrases = approved.filter("replacement <> ''").groupBy("doc_id").agg(F.reverse(F.array_sort(F.collect_set(F.struct(F.length("replacement").alias("n"), F.col("replacement").alias("p"))))).alias("_phrases"))
    blank = F.aggregate("_phrases", F.col(text_col), lambda text, x: F.replace(text, x["p"], F.lit(" \u0000 ")))
    out = texts.join(phrases.hint("merge"), "doc_id", "left")
    return out.withColumn(text_col, F.when(F.col("_phrases").isNull(), F.col(text_col)).otherwise(blank)).drop("_phrases")


def shared_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys that both tables hold."""
    return left.select(key).intersect(right.select(key))


def absent(known: DataFrame, cells: DataFrame) -> DataFrame:
    """Original identifiers (entity_type, plaintext) that some cell (value) of a synthetic table equals, letter case and spaces apart."""
    form = lambda c: F.lower(V.collapse(F.col(c)))
    there = cells.select(form("value").alias("_form")).distinct()
    return known.withColumn("_form", form("plaintext")).filter("_form <> ''").join(there, "_form", "left_semi").drop("_form")


def commitment(rows: DataFrame, columns: list[str]) -> DataFrame:
    """commitment, rows: a digest of a table that does not depend on the order of its rows, and of which every row is a part."""
    own = F.sha2(F.to_json(F.struct(*columns)), 256)
    parts = [F.conv(F.substring(own, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(4)]
    sums = rows.agg(*[F.coalesce(F.sum(p), F.lit(0)).alias(f"s{k}") for k, p in enumerate(parts)], F.count(F.lit(1)).alias("rows"))
    return sums.select(F.sha2(F.concat_ws("|", *[F.col(f"s{k}").cast("string") for k in range(4)], F.col("rows").cast("string")), 256).alias("commitment"), "rows")


#: The gates of a synthetic table.
TWIN_SUITE = ("original_identifier_absence", "record_copy_attack", "utility_evidence", "output_commitment")


def run_twin(original: DataFrame, synthetic: DataFrame, columns: list[str], known: DataFrame, utility: int, committed: str | None, least_utility: int = 60) -> DataFrame:
    """name, status, detail, severity of the gates of a synthetic table.

    ``known`` are the original identifiers; ``utility`` is the score of ``evaluate.utility_report``; ``committed`` is the
    ``commitment`` taken when the table was made (none: inconclusive).
    """
    spark = original.sparkSession
    cells = synthetic.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("value"))
    left, copies = absent(known, cells).count(), row_copies(synthetic, original, columns).count()
    same = committed is not None and commitment(synthetic, columns).first()["commitment"] == committed
    found = {
        "original_identifier_absence": (left == 0, f"{left} findings"),
        "record_copy_attack": (copies == 0, f"{copies} findings"),
        "utility_evidence": (utility >= least_utility, f"utility {utility}"),
        "output_commitment": (None if committed is None else same, "commitment compared" if committed is not None else "not run"),
    }
    rows = [(name, "INCONCLUSIVE" if ok is None else "PASS" if ok else "FAIL", detail) for name, (ok, detail) in found.items()]
    return spark.createDataFrame(rows, "name string, status string, detail string").withColumn("severity", severity(F.col("name")))


def run_table(before: DataFrame, after: DataFrame, known: DataFrame, expected: DataFrame, instructions: DataFrame, level: int, rescan: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The gates of a table, by its cells: before and after have doc_id, record, header, value.

    known, expected, instructions: doc_id, entity_id, entity_type, plaintext (instructions also record, header,
    replacement). Texts of the gates that read texts are the cells, a line each.
    """
    as_text = lambda df, name: df.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("record", "header", "value"))), lambda c: F.coalesce(c["value"], F.lit(""))), "\n").alias(name))
    texts = as_text(before, "text").join(as_text(after, "protected").hint("merge"), "doc_id")
    docs = texts.select("doc_id")
    again = None
    if rescan is not None:
        allowed = instructions.select("doc_id", F.lower("replacement").alias("_v")).distinct()
        again = rescan(texts).filter(F.col("entity_type").isin(*FRAGMENT)).withColumn("_v", F.lower("plaintext")).join(allowed.hint("merge"), ["doc_id", "_v"], "left_anti")
    blanked = without_phrases(texts, instructions.select("doc_id", "replacement"))
    headers = lambda df: df.select("doc_id", "header").distinct()
    schema = headers(before).exceptAll(headers(after)).union(headers(after).exceptAll(headers(before)))
    found = {
        "direct_identifier_rescan": again,
        "independent_extraction": leaks(known, blanked),
        "secondary_structured_parser_rescan": squeezed_leaks(known, blanked),
        "structured_hidden_channel_scan": formula_cells(after),
        "structured_cell_integrity": changed_cells(before, after, instructions, ["doc_id", "record", "header"]),
        "metadata_and_embedded_content": metadata_markers(texts),
        "policy_coverage": uncovered(expected, instructions),
        "relationship_consistency": inconsistent(instructions, unique_aliases=level == 4),
        "raw_object_stream_scan": hidden_markup(known, blanked.select("doc_id", F.encode("protected", "UTF-8").alias("content"))),
        "direct_identifier_fragment_attack": fragments(known, blanked.select("doc_id", F.lit(0).alias("line_no"), F.col("protected").alias("text"))),
        "replacement_presence_attack": missing_replacements(instructions, texts),
        "structured_schema_preservation": schema,
    }
    out = None
    for name in SUITES["DATASET"]:
        one = gate(docs, found[name], name)
        out = one if out is None else out.unionByName(one)
    return out.withColumn("severity", severity(F.col("name")))


def to_check(mentions: DataFrame, actions: DataFrame) -> DataFrame:
    """Mentions that the gates must not find again: those whose action at the level keeps the value on purpose are left out.

    mentions: doc_id, entity_type, review_status, ...; actions: entity_type, action. Ignored mentions are kept on purpose too.
    """
    kept = actions.filter("action = 'RETAIN'").select("entity_type")
    return mentions.filter("review_status <> 'IGNORE'").join(F.broadcast(kept), "entity_type", "left_anti")
