"""Transformation, gates by sabotage, evaluation, ledgers, twins."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from hushgrid.operators import audit, detect, entities as E, evaluate as EV, transform as TR, verify as VG

TEXT = "Name: Asha Verma\nPhone: +91 98765 43210\nEmail: asha.verma@example.org\nThe meeting about garden walls was moved towards evening because weather stayed cloudy while visitors still gathered under large tents beside many tables.\nAsha Verma agreed."


def made(spark, level=2):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id bigint, text string")
    m = detect.mentions(docs).filter("entity_type in ('PERSON_NAME', 'PHONE', 'EMAIL')")
    ents = E.canonical(m, key=b"k")
    instr = TR.instructions(m, ents, level, "PUBLIC_RELEASE")
    return docs, m, ents, instr


def gates(texts, known, expected, instr, level=2):
    rescan = lambda t: detect.mentions(t.select("doc_id", F.col("protected").alias("text")), only=("direct",))
    return {r.name: r.status for r in VG.run(texts, known, expected, instr, level, rescan).collect()}


def test_release(spark):
    docs, m, ents, instr = made(spark)
    texts = TR.sanitize(docs, instr)
    row = texts.first()
    assert "Asha Verma" not in row.protected and "98765" not in row.protected and "[PERSON_001]" in row.protected
    known = instr.select("doc_id", "entity_id", "entity_type", "plaintext").distinct()
    every = instr.select("doc_id", "char_start", "char_end", "entity_type", "entity_id", "plaintext", "replacement")
    assert row.written == 4 or row.written + row.propagated == 4
    got = gates(texts, known, known, every)
    assert set(got.values()) == {"PASS"}
    scored = VG.score(VG.run(texts, known, known, every, 2, None)).first()
    assert not scored.releasable  # a gate that did not run blocks the release


def test_sabotage(spark):
    docs, m, ents, instr = made(spark)
    known = instr.select("doc_id", "entity_id", "entity_type", "plaintext").distinct()
    leak = docs.withColumn("protected", F.concat(F.lit("gone "), F.lit("mail asha . verma@example.org, 98765-43210, Verma")))
    got = gates(leak, known, known, instr)
    for name in ("independent_extraction", "replacement_presence_attack", "direct_identifier_fragment_attack", "utility_anchor_preservation", "character_span_integrity"):
        assert got[name] == "FAIL", name
    assert gates(docs.withColumn("protected", F.lit("x")), known, known, instr.filter("entity_type <> 'PHONE'"))["policy_coverage"] == "FAIL"


def test_propagation_and_overlap():
    out, own, more = TR.rewrite("Kestrel Labs Ltd met. Kestrel  labs won.", [(0, 16, "EMPLOYER", "[O]"), (0, 7, "PERSON_NAME", "[P]")])
    assert (out, own, more) == ("[O] met. [O] won.", 1, 1)


def test_review(spark):
    docs, m, *_ = made(spark)
    assert TR.open_reviews(m).count() == 1
    decisions = m.filter("review_status = 'PENDING'").select("doc_id", "char_start", "char_end", "entity_type", F.lit("PROTECT").alias("decision"))
    assert TR.open_reviews(E.review(m, decisions)).count() == 0


def test_matching(spark):
    schema = "case_id bigint, entity_type string, domain string, char_start bigint, char_end bigint"
    pred = spark.createDataFrame([(1, "EMAIL", "d", 0, 10), (1, "EMAIL", "d", 2, 10), (2, "PHONE", "d", 0, 4)], schema)
    gold = spark.createDataFrame([(1, "EMAIL", "d", 0, 9), (2, "PHONE", "d", 6, 9)], schema)
    got = EV.match(EV.candidate_pairs(pred, gold)).collect()
    assert [(r.case_id, r.p_start, r.g_start) for r in got] == [(1, 0, 0)]
    assert EV.merged_spans(pred).count() == 2


def test_ledger(spark):
    events = spark.createDataFrame([("j", k, "E", f"t{k}", "{}") for k in range(1, 6)], "job_id string, sequence bigint, event_type string, timestamp string, details string")
    chained = audit.chain(events)
    assert audit.verify(chained).first().valid
    bad = chained.withColumn("details", F.when(F.col("sequence") == 3, "x").otherwise(F.col("details")))
    r = audit.verify(bad).first()
    assert not r.valid and r.first_bad == 3
    assert audit.verify(chained.filter("sequence <> 2")).first().first_bad == 3


def test_crypto(spark, tmp_path):
    key, _ = audit.subkeys(b"secret")
    df = spark.createDataFrame([(bytearray(b"data"),)], "content binary").select(audit.encrypt(F.col("content"), F.lit(bytearray(key)), F.lit("j"), F.lit("d"), F.lit(bytearray(b"n" * 12))).alias("s"))
    back = df.select(audit.decrypt(F.col("s"), F.lit(bytearray(key)), F.lit("j"), F.lit("d")).alias("a"), audit.decrypt(F.col("s"), F.lit(bytearray(key)), F.lit("j"), F.lit("other")).alias("b")).first()
    assert bytes(back.a) == b"data" and back.b is None
    signer = audit.Signer(spark)
    cert = audit.certificate(signer, "j", [{"name": "g", "status": "PASS"}], "h", "o")
    assert signer.verify(cert["body"], bytes.fromhex(cert["signature"])) and not signer.verify({"x": 1}, bytes.fromhex(cert["signature"]))
    path = str(tmp_path / "b.zip")
    audit.bundle(path, {"a.txt": b"1"})
    assert audit.verify_bundle(path)


def test_twin(spark):
    rows = [(k, f"Person {k}", f"p{k}@x.org", 20 + k % 50, ["A", "B", "C"][k % 3], float(k), 2.0 * k + 1) for k in range(60)]
    df = spark.createDataFrame(rows, "id bigint, full_name string, email string, age int, cohort string, score double, income double")
    twin = TR.twin(df, "id", b"salt")
    assert twin.count() == 60 and twin.columns == df.columns
    assert VG.row_copies(twin, df, df.columns).count() == 0
    assert not {r.email for r in twin.collect()} & {r.email for r in df.collect()}
    assert EV.correlation_fidelity(df, twin, ["score", "income"]).first().fidelity > 0.95
    assert [tuple(r) for r in twin.orderBy("id").collect()] == [tuple(r) for r in TR.twin(df, "id", b"salt").orderBy("id").collect()]


def test_cells_spans(spark):
    cells = spark.createDataFrame([(1, 0, "a", "hello", 3, 8), (1, 0, "b", "world", 12, 17)], "doc_id bigint, record int, column string, value string, char_start bigint, char_end bigint")
    spans = spark.createDataFrame([(1, 0, 12, 17, "X"), (1, 0, 7, 13, "Y")], "doc_id bigint, record int, char_start bigint, char_end bigint, replacement string")
    assert {r.column: r.value for r in TR.sanitize_cells(cells, spans).collect()} == {"a": "hello", "b": "X"}


def test_registered_gates_all_run(spark):
    from pathlib import Path

    import pytest

    from hushgrid.plans import base, catalog

    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("no tables")
    base.importable(spark)
    got = {(r.name, r.status) for r in catalog.QUERIES["verification_gates"](spark, str(data)).collect()}
    assert not [g for g in got if g[1] == "INCONCLUSIVE"] and {s for n, s in got if n == "direct_identifier_rescan"} == {"PASS", "FAIL"}


def test_twin_needs_its_salt_and_a_donor(spark):
    rows = [(k, f"Person {k}", 20 + k, float(k * k)) for k in range(40)]
    df = spark.createDataFrame(rows, "id bigint, full_name string, visits int, score double")
    one, other = (TR.twin(df, "id", salt).orderBy("id").collect() for salt in (b"a", b"b"))
    assert one != other and TR.twin_seed(df, "t", b"a") != TR.twin_seed(df, "t", b"b")
    assert TR.twin_seed(df, "t", b"a") == TR.twin_seed(df.repartition(5), "t", b"a") != TR.twin_seed(df.limit(39), "t", b"a")
    with pytest.raises(ValueError):
        TR.twin(df.limit(1), "id", b"a")
    assert TR.twin(df.limit(0), "id", b"a").count() == 0
    told = spark.createDataFrame([("7", "full_name", "Synthetic Seven")], "key string, column string, value string")
    assert [r.full_name for r in TR.twin(df, "id", b"a", overrides=told).collect()].count("Synthetic Seven") == 1


def test_dates_of_a_twin_keep_their_order(spark):
    df = spark.sql("SELECT id, date_add(date'2020-01-01', cast(id * 3 as int)) AS visit_date FROM range(20)")
    got = [r.visit_date for r in TR.shifted(df, "visit_date", 200).orderBy("id").collect()]
    assert got == sorted(got) and len({(b - a).days for a, b in zip(got, got[1:])}) == 1
    turned = [r.id for r in TR.turned(df.withColumn("k", F.col("id")), "k", "id", 7).orderBy("k").collect()]
    assert turned == [(k + 7) % 20 for k in range(20)]


def plain_settle(spans):
    kept = []
    for k in sorted(range(len(spans)), key=lambda k: (spans[k][0] - spans[k][1], *spans[k])):
        a, b, _ = spans[k]
        if a < b and all(b <= spans[j][0] or a >= spans[j][1] for j in kept):
            kept.append(k)
    return [k in kept for k in range(len(spans))]


def test_spans_fall_only_to_what_stays(spark):
    assert TR.settle([(0, 5, "X"), (3, 10, "X"), (8, 12, "X")]) == [False, True, False]
    assert TR.settle([(0, 5, "X"), (3, 9, "X"), (10, 12, "X"), (10, 12, "X"), (4, 4, "X")]) == [False, True, True, False, False]
    r = random.Random(3)
    for _ in range(300):
        spans = [(a, a + r.randrange(0, 9), r.choice("XY")) for a in (r.randrange(30) for _ in range(r.randrange(12)))]
        assert TR.settle(spans) == plain_settle(spans)
    df = spark.createDataFrame([(1, "X", 0, 5), (1, "X", 3, 10), (1, "X", 8, 12), (2, "X", 8, 12)], "doc_id bigint, entity_type string, char_start bigint, char_end bigint")
    assert sorted((x.doc_id, x.char_start, x.kept) for x in TR.resolve(df).collect()) == [(1, 0, False), (1, 3, True), (1, 8, False), (2, 8, True)]


def test_spans_that_hit_no_cell_are_told(spark):
    cells = spark.createDataFrame([(1, 0, "a", "hello", 3, 8), (1, 0, "b", "world", 12, 17)], "doc_id bigint, record int, column string, value string, char_start bigint, char_end bigint")
    spans = spark.createDataFrame([(1, 0, 12, 17, "X"), (1, 0, 7, 13, "Y")], "doc_id bigint, record int, char_start bigint, char_end bigint, replacement string")
    assert [(x.replacement, x.hits) for x in TR.unmatched_spans(cells, spans).collect()] == [("Y", 0)]


def test_short_numbers_leak_where_they_stand_alone(spark):
    known = spark.createDataFrame([(1, "BUILDING_NUMBER", "12"), (2, "BUILDING_NUMBER", "12"), (3, "POSTCODE", "")], "doc_id bigint, entity_type string, plaintext string")
    texts = spark.createDataFrame([(1, "at 12 Mill Road"), (2, "in 2012 there"), (3, "x")], "doc_id bigint, protected string")
    assert [x.doc_id for x in VG.leaks(known, texts).collect()] == [1]


def test_gates_of_a_synthetic_table(spark):
    rows = [(k, f"p{k}@x.org", 20 + k % 50, float(k)) for k in range(60)]
    df = spark.createDataFrame(rows, "id bigint, email string, age int, score double")
    made, cols = TR.twin(df, "id", b"s"), ["id", "email", "age", "score"]
    known = df.select(F.lit("EMAIL").alias("entity_type"), F.col("email").alias("plaintext"))
    told = VG.commitment(made, cols).first()["commitment"]
    run = lambda t, c, utility=90: {r.name: r.status for r in VG.run_twin(df, t, cols, known, utility, c).collect()}
    assert set(run(made, told).values()) == {"PASS"}
    assert VG.commitment(made.repartition(7), cols).first()["commitment"] == told
    bad = run(made.limit(59).union(df.limit(1)), told, 10)
    assert set(bad.values()) == {"FAIL"} and run(made, None)["output_commitment"] == "INCONCLUSIVE"


def test_gates_of_a_table(spark):
    schema = "doc_id bigint, record int, header string, value string"
    before = spark.createDataFrame([(1, 0, "name", "Asha Verma"), (1, 0, "city", "Leeds"), (1, 1, "name", "Lena Hoff"), (1, 1, "city", "Leeds")], schema)
    instr = spark.createDataFrame([(1, "e1", "PERSON_NAME", "Asha Verma", 0, "name", "[PERSON_001]"), (1, "e2", "PERSON_NAME", "Lena Hoff", 1, "name", "[PERSON_002]")], "doc_id bigint, entity_id string, entity_type string, plaintext string, record int, header string, replacement string")
    known = instr.select("doc_id", "entity_id", "entity_type", "plaintext")
    after = before.join(instr.select("doc_id", "record", "header", "replacement"), ["doc_id", "record", "header"], "left").withColumn("value", F.coalesce("replacement", "value")).drop("replacement")
    rescan = lambda t: detect.mentions(t.select("doc_id", F.col("protected").alias("text")))
    run = lambda a: {r.name: r.status for r in VG.run_table(before, a, known, known, instr, 2, rescan).collect()}
    good = run(after)
    assert set(good) == set(VG.SUITES["DATASET"]) and set(good.values()) == {"PASS"}
    bad = run(after.withColumn("value", F.when(F.col("value") == "Leeds", "=Asha Verma").otherwise(F.col("value"))))
    assert {k for k, v in bad.items() if v == "FAIL"} >= {"independent_extraction", "structured_hidden_channel_scan", "structured_cell_integrity"}
    kept = VG.to_check(known.withColumn("review_status", F.lit("PROTECT")), spark.createDataFrame([("PERSON_NAME", "RETAIN")], "entity_type string, action string"))
    assert kept.count() == 0


def test_annotators_without_a_kind(spark):
    pred = spark.createDataFrame([(1, "a"), (1, "b")], "case_id bigint, value string")
    gold = spark.createDataFrame([(1, "x", "a", "DIRECT"), (1, "x", "c", "DIRECT"), (1, "x", "b", "NO_MASK")], "case_id bigint, annotator string, value string, need string")
    got = EV.annotator_scores(pred, gold).first()
    assert (got.tp, got.fp, got.fn, got.direct_recall, got.quasi_recall, got.no_mask_rate) == (1, 1, 1, 0.5, None, 1.0)
    got = EV.annotator_scores(pred, gold.filter("need = 'DIRECT'").withColumn("need", F.lit("QUASI"))).first()
    assert got.direct_recall is None and got.quasi_recall == 0.5 and got.no_mask_rate != got.no_mask_rate


def test_documents_are_never_broadcast(spark):
    """A broadcast is built in the driver's memory, and a small file of documents is a large table there."""
    docs = spark.createDataFrame([(1, TEXT, TEXT)], "doc_id bigint, text string, protected string")
    spans = spark.createDataFrame([(1, "e", "PERSON_NAME", "Asha Verma", "[P]", 6, 16)], "doc_id bigint, entity_id string, entity_type string, plaintext string, replacement string, char_start int, char_end int")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (VG.anchors(docs, spans), TR.splice(docs.select("doc_id", "text"), spans), VG.run(docs, spans, spans, spans, 2, lambda x: spans)):
        assert "SortMergeJoin" in plan(df) and "BroadcastHashJoin" not in plan(df)
