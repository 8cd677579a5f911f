"""Queries on gates, evaluation, fidelity, ledgers, time and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import audit, detect, entities as E, evaluate as EV, transform as TR, verify as VG
from ..streaming import flows
from . import base as B
from .base import duck, fixture, query, table

# --- leaks and gates over a small output made from customers -------------------------------------------------

#: Original and protected text of each customer, some values left in.
_TEXTS = """SELECT c_custkey AS doc_id, concat('Name: ', c_name, ' mail p', cast(c_custkey as string), '@example.org phone +91 98', lpad(cast(c_custkey as string), 8, '0'), ' lives near the old market square with family') AS text,
concat('Name: ', CASE WHEN c_custkey % 10 = 0 THEN c_name ELSE '[PERSON_001]' END, ' mail ', CASE WHEN c_custkey % 15 = 0 THEN concat('P', cast(c_custkey as string), '@Example.org') ELSE '[EMAIL_001]' END, ' phone ', CASE WHEN c_custkey % 20 = 0 THEN concat('+91-98', lpad(cast(c_custkey as string), 8, '0')) ELSE '[PHONE_001]' END, CASE WHEN c_custkey % 25 = 0 THEN ' lives near the' ELSE ' lives near the old market square with family' END) AS protected FROM {customer}"""
_KNOWN = """SELECT c_custkey AS doc_id, concat(cast(c_custkey as string), t.entity_type) AS entity_id, t.entity_type AS entity_type, CASE t.entity_type WHEN 'PERSON_NAME' THEN c_name WHEN 'EMAIL' THEN concat('p', cast(c_custkey as string), '@example.org') ELSE concat('+91 98', lpad(cast(c_custkey as string), 8, '0')) END AS plaintext,
CASE t.entity_type WHEN 'PERSON_NAME' THEN '[PERSON_001]' WHEN 'EMAIL' THEN '[EMAIL_001]' ELSE '[PHONE_001]' END AS replacement FROM {customer} CROSS JOIN (VALUES ('PERSON_NAME'), ('EMAIL'), ('PHONE')) AS t(entity_type)"""
_LEAKED = """CASE entity_type WHEN 'EMAIL' THEN contains(regexp_replace(lower(protected), '\\s+', '', 'g'), lower(plaintext)) WHEN 'PHONE' THEN contains(regexp_replace(protected, '[^0-9]', '', 'g'), regexp_replace(plaintext, '[^0-9]', '', 'g'))
ELSE contains(' ' || trim(regexp_replace(lower(protected), '[^a-z0-9_]+', ' ', 'g')) || ' ', ' ' || trim(regexp_replace(lower(plaintext), '[^a-z0-9_]+', ' ', 'g')) || ' ') END"""
_BOTH = f"({duck(_KNOWN)}) k JOIN ({duck(_TEXTS)}) t USING (doc_id)"


def texts(spark, d):
    return fixture(spark, d, _TEXTS)


def known(spark, d):
    return fixture(spark, d, _KNOWN)


@query("leak_scan", f"SELECT doc_id, entity_type, plaintext FROM {_BOTH} WHERE {_LEAKED}")
def leak_scan(spark, d):
    return VG.leaks(known(spark, d), texts(spark, d)).select("doc_id", "entity_type", "plaintext")


@query("squeezed_leak_scan", f"SELECT doc_id, entity_type FROM {_BOTH} WHERE length(regexp_replace(lower(plaintext), '[^a-z0-9]', '', 'g')) >= 6 AND contains(regexp_replace(lower(protected), '[^a-z0-9]', '', 'g'), regexp_replace(lower(plaintext), '[^a-z0-9]', '', 'g'))")
def squeezed_leak_scan(spark, d):
    return VG.squeezed_leaks(known(spark, d), texts(spark, d)).select("doc_id", "entity_type")


@query("policy_coverage_anti", f"SELECT doc_id, entity_id FROM ({duck(_KNOWN)}) WHERE doc_id % 4 = 0")
def policy_coverage_anti(spark, d):
    k = known(spark, d)
    return VG.uncovered(k, k.filter("doc_id % 4 <> 0")).select("doc_id", "entity_id")


_INSTR = """SELECT c_custkey % 50 AS doc_id, cast(c_custkey % 7 as string) AS entity_id, concat('Person ', CASE WHEN c_custkey % 50 = 3 THEN cast(c_custkey % 2 as string) WHEN c_custkey % 50 = 4 THEN 'X' ELSE cast(c_custkey % 7 as string) END) AS replacement FROM {customer}"""


@query("relationship_consistency", f"WITH i AS ({duck(_INSTR)}) SELECT doc_id, entity_id FROM i GROUP BY ALL HAVING count(DISTINCT replacement) > 1 UNION SELECT doc_id, min(entity_id) FROM i GROUP BY doc_id, replacement HAVING count(DISTINCT entity_id) > 1")
def relationship_consistency(spark, d):
    return VG.inconsistent(fixture(spark, d, _INSTR), unique_aliases=True)


@query("fragment_ngrams", f"""WITH k AS (SELECT doc_id, entity_type, plaintext, CASE entity_type WHEN 'PHONE' THEN regexp_replace(plaintext, '[^0-9]', '', 'g') ELSE regexp_replace(upper(split_part(plaintext, '@', 1)), '[^A-Z0-9]', '', 'g') END AS f, CASE entity_type WHEN 'PHONE' THEN 7 ELSE 6 END AS n FROM ({duck(_KNOWN)}) WHERE entity_type <> 'PERSON_NAME'),
g AS (SELECT doc_id, entity_type, plaintext, substr(f, CAST(i AS INTEGER), n) AS gram FROM (SELECT *, unnest(range(1, length(f) - n + 2)) AS i FROM k WHERE length(f) >= n)),
w AS (SELECT doc_id, entity_type, plaintext, unnest(regexp_extract_all(lower(plaintext), '[a-z]{{5,}}')) AS word FROM ({duck(_KNOWN)}) WHERE entity_type = 'PERSON_NAME')
SELECT DISTINCT doc_id, entity_type, plaintext FROM g JOIN ({duck(_TEXTS)}) t USING (doc_id) WHERE CASE entity_type WHEN 'PHONE' THEN contains(regexp_replace(protected, '[^0-9]', '', 'g'), gram) ELSE len(list_filter(regexp_extract_all(protected, '[A-Za-z0-9._%+*-]+@[A-Za-z0-9.-]+[.][A-Za-z]{{2,}}'), lambda m: contains(regexp_replace(upper(split_part(m, '@', 1)), '[^A-Z0-9]', '', 'g'), gram))) > 0 END
UNION SELECT DISTINCT doc_id, entity_type, plaintext FROM w JOIN ({duck(_TEXTS)}) t USING (doc_id) WHERE list_contains(string_split_regex(lower(protected), '[^a-z]+'), word)""")
def fragment_ngrams(spark, d):
    lines = texts(spark, d).select("doc_id", F.posexplode(F.split("protected", "\n")).alias("line_no", "text"))
    return VG.fragments(known(spark, d), lines)


@query("replacement_presence", f"SELECT doc_id, replacement FROM {_BOTH} WHERE NOT contains(protected, replacement)")
def replacement_presence(spark, d):
    return VG.missing_replacements(known(spark, d), texts(spark, d))


_SPAN = "strpos(text, plaintext) - 1 AS char_start, strpos(text, plaintext) - 1 + length(plaintext) AS char_end"


@query("utility_anchors", f"""WITH b AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(replace(replace(text, 'p' || doc_id || '@example.org', ' '), substr(text, 7, 18), ' ')), '[a-z]{{4,}}')) AS word FROM ({duck(_TEXTS)})) GROUP BY ALL),
a AS (SELECT doc_id, word, count(*) AS m FROM (SELECT doc_id, unnest(regexp_extract_all(lower(protected), '[a-z]{{4,}}')) AS word FROM ({duck(_TEXTS)})) GROUP BY ALL)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS anchors, CAST(sum(least(n, coalesce(m, 0))) AS BIGINT) AS preserved, sum(n) < 5 OR sum(least(n, coalesce(m, 0))) >= sum(n) * 0.9::DOUBLE AS ok FROM b LEFT JOIN a USING (doc_id, word) GROUP BY doc_id""")
def utility_anchors(spark, d):
    t = texts(spark, d)
    spans = known(spark, d).join(t.select("doc_id", "text").hint("merge"), "doc_id").withColumn("char_start", F.expr("locate(plaintext, text) - 1")).withColumn("char_end", F.col("char_start") + F.length("plaintext"))
    return VG.anchors(t, spans).select("doc_id", "anchors", "preserved", "ok")


@query("text_spliced", f"SELECT doc_id, replace(replace(replace(text, 'p' || doc_id || '@example.org', '[EMAIL_001]'), substr(text, 7, 18), '[PERSON_001]'), '+91 98' || lpad(CAST(doc_id AS VARCHAR), 8, '0'), '[PHONE_001]') AS protected FROM ({duck(_TEXTS)})")
def text_spliced(spark, d):
    t = texts(spark, d)
    spans = known(spark, d).join(t.select("doc_id", "text").hint("merge"), "doc_id").withColumn("char_start", F.expr("locate(plaintext, text) - 1")).withColumn("char_end", F.col("char_start") + F.length("plaintext"))
    return TR.splice(t.select("doc_id", "text"), spans).select("doc_id", "protected")


_GATES = f"(VALUES {', '.join(f'({chr(39)}{g}{chr(39)}, {k})' for k, g in enumerate(VG.TEXT_SUITE))}) AS g(name, k)"
_GATE_ROWS = f"SELECT c_custkey AS doc_id, g.name AS name, CASE WHEN (c_custkey * 7 + g.k) % 40 = 0 THEN 'FAIL' WHEN (c_custkey * 3 + g.k) % 97 = 0 THEN 'INCONCLUSIVE' ELSE 'PASS' END AS status FROM {{customer}} CROSS JOIN {_GATES}"
_SEV = f"CASE WHEN name IN ({B.names(VG.CRITICAL)}) THEN 12 WHEN name IN ({B.names(VG.MEDIUM)}) THEN 4 ELSE 8 END"


@query("release_decision", f"SELECT doc_id, CAST(round_even(100.0::DOUBLE * sum(CASE WHEN status = 'PASS' THEN {_SEV} ELSE 0 END) / sum({_SEV}), 0) AS BIGINT) AS score, CAST(count(*) FILTER (status <> 'PASS' AND {_SEV} = 12) AS BIGINT) AS critical_failures, bool_and(status = 'PASS') AS releasable FROM ({duck(_GATE_ROWS)}) GROUP BY doc_id")
def release_decision(spark, d):
    return VG.score(fixture(spark, d, _GATE_ROWS)).select("doc_id", F.col("score").cast("long").alias("score"), "critical_failures", "releasable")


@query("row_copy_semi", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 2 = 0")
def row_copy_semi(spark, d):
    o = table(spark, d, "orders").withColumn("status", F.concat(F.lit("  "), F.lower("o_orderstatus")))
    o = o.withColumn("status", F.when(F.col("o_custkey") % 2 == 0, F.col("status")).otherwise(F.lit("none")))
    original = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return VG.row_copies(o.filter("o_orderkey % 3 = 0").select("o_orderkey", "status"), original, ["o_orderkey", "status"]).select("o_orderkey")


@query("changed_cells", "SELECT c_custkey AS record, 'c_name' AS header FROM customer WHERE c_custkey % 6 = 0 AND c_custkey % 9 <> 0")
def changed_cells(spark, d):
    from ..sources.structured import cells_of

    c = table(spark, d, "customer").select(F.col("c_custkey").alias("record"), "c_name", "c_mktsegment")
    before = cells_of(c, "record")
    after = cells_of(c.withColumn("c_name", F.when(F.col("record") % 6 == 0, F.upper("c_name")).otherwise(F.col("c_name"))), "record")
    targets = before.filter("record % 9 = 0 and header = 'c_name'")
    return VG.changed_cells(before, after, targets, ["record", "header"]).select("record", "header")


@query("formula_neutralize", """SELECT c_custkey AS id, CASE WHEN regexp_matches(v, '^[=+\\-@]') THEN '''' || v ELSE v END AS cell FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '=' || c_name WHEN 1 THEN '+1' WHEN 2 THEN '@x' WHEN 3 THEN CAST(-c_custkey AS VARCHAR) ELSE c_name END AS v FROM customer)""")
def formula_neutralize(spark, d):
    k = F.col("c_custkey") % 5
    v = F.when(k == 0, F.concat(F.lit("="), "c_name")).when(k == 1, "+1").when(k == 2, "@x").when(k == 3, (-F.col("c_custkey")).cast("string")).otherwise(F.col("c_name"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), V.neutralize_formula(v).alias("cell"))


@query("safe_filenames", """SELECT page_id, CASE WHEN c = '' THEN 'input' ELSE c END AS name FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[^A-Za-z0-9._ ()\\-]+', '_', 'g'), '\\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g') AS c FROM pages)""")
def safe_filenames(spark, d):
    return table(spark, d, "pages").select("page_id", V.safe_filename(F.col("url")).alias("name"))


@query("metric_paths", """SELECT p AS path, CAST(count(*) AS BIGINT) AS n FROM (SELECT regexp_replace('/api/jobs/' || CASE WHEN c_custkey % 2 = 0 THEN left(sha256(c_name), 32) ELSE 'list' END || '/x', '\\b[0-9a-f]{16,}\\b', '{id}', 'gi') AS p FROM customer) GROUP BY p""")
def metric_paths(spark, d):
    p = F.concat(F.lit("/api/jobs/"), F.when(F.col("c_custkey") % 2 == 0, F.substring(F.sha2("c_name", 256), 1, 32)).otherwise("list"), F.lit("/x"))
    return table(spark, d, "customer").select(V.metric_path(p).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query("pointer_escape", "SELECT DISTINCT replace(replace(p_type || '~/' || p_brand, '~', '~0'), '/', '~1') AS pointer FROM part")
def pointer_escape(spark, d):
    return table(spark, d, "part").select(V.pointer_escape(F.concat("p_type", F.lit("~/"), "p_brand")).alias("pointer")).distinct()


@query("header_dedupe", "SELECT CAST(p_partkey AS BIGINT) AS id, CASE WHEN n = 1 THEN p_type ELSE p_type || '#' || n END AS header FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_partkey % 50, lower(p_type) ORDER BY p_partkey) AS n FROM part)")
def header_dedupe(spark, d):
    from ..sources import structured

    columns = table(spark, d, "part").withColumn("sheet", F.col("p_partkey") % 50)
    return structured.dedupe_headers(columns, "sheet", "p_partkey", "p_type").select(F.col("p_partkey").alias("id"), "header")


@query("header_keys", "SELECT p_partkey AS id, trim(lower(regexp_replace(regexp_replace(translate('**' || p_type || '_/-' || p_brand || ':', '_/-', '   '), '[*`#:]+', ' ', 'g'), '\\s+', ' ', 'g'))) AS key FROM part")
def header_keys(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), V.header_key(F.concat(F.lit("**"), "p_type", F.lit("_/-"), "p_brand", F.lit(":"))).alias("key"))


@query("virtual_cell_offsets", """WITH c AS (SELECT c_custkey AS k, 0 AS col, 'c_name' AS h, c_name AS v FROM customer UNION ALL SELECT c_custkey, 1, 'c_mktsegment', c_mktsegment FROM customer)
SELECT k AS c_custkey, h AS header, CAST(coalesce(sum(length(h || ': ' || v) + 1) OVER (PARTITION BY k ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(h) + 2 AS BIGINT) AS char_start, CAST(length(v) AS BIGINT) AS n FROM c""")
def virtual_cell_offsets(spark, d):
    from ..sources.structured import virtual_lines

    rows = virtual_lines(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")
    return rows.select("c_custkey", "header", "char_start", F.length("value").cast("long").alias("n"))


@query("spans_in_cells", """WITH c AS (SELECT c_custkey AS doc_id, 0 AS s, length(c_name) AS e, 'c_name' AS h FROM customer UNION ALL SELECT c_custkey, 20, 20 + length(c_mktsegment), 'c_mktsegment' FROM customer)
SELECT s.doc_id, h AS header FROM (SELECT c_custkey AS doc_id, (c_custkey % 4) * 9 AS a, (c_custkey % 4) * 9 + 5 AS b FROM customer) s JOIN c ON c.doc_id = s.doc_id AND s.a >= c.s AND s.b <= c.e""")
def spans_in_cells(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("record"), F.inline(F.array(F.struct(F.lit(0).alias("char_start"), F.length("c_name").alias("char_end"), F.lit("c_name").alias("column")), F.struct(F.lit(20).alias("char_start"), (F.length("c_mktsegment") + 20).alias("char_end"), F.lit("c_mktsegment").alias("column")))))
    a = (F.col("c_custkey") % 4) * 9
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("record"), a.alias("char_start"), (a + 5).alias("char_end"))
    return TR.spans_in_cells(c, s).select("doc_id", F.col("column").alias("header"))


# --- evaluation ------------------------------------------------------------------------------------------


@query("match_candidates", f"""SELECT p.case_id, p.entity_type, p.char_start AS p_start, g.char_start AS g_start FROM ({duck(B.PRED)}) p JOIN ({duck(B.GOLD)}) g ON p.case_id = g.case_id AND p.entity_type = g.entity_type AND p.char_start < g.char_end AND g.char_start < p.char_end
WHERE (least(p.char_end, g.char_end) - greatest(p.char_start, g.char_start)) / greatest(p.char_end - p.char_start, g.char_end - g.char_start)::DOUBLE >= 0.5""")
def match_candidates(spark, d):
    return EV.candidate_pairs(fixture(spark, d, B.PRED), fixture(spark, d, B.GOLD)).select("case_id", "entity_type", "p_start", "g_start")


def _prf_cols(tp: str, fp: str, fn: str) -> str:
    p, r = f"coalesce({tp} / nullif({tp} + {fp}, 0)::DOUBLE, 0)", f"coalesce({tp} / nullif({tp} + {fn}, 0)::DOUBLE, 0)"
    return f"round({p}, 6) AS precision, round({r}, 6) AS recall, round(coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0), 6) AS f1, round(coalesce(5 * {p} * {r} / nullif(4 * {p} + {r}, 0), 0), 6) AS f2"


_COUNTS = "SELECT CASE l_linenumber % 3 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'PHONE' ELSE 'PERSON_NAME' END AS entity_type, l_returnflag AS domain, 1 AS n_pred, cast(CASE WHEN l_quantity < 40 THEN 1 ELSE 0 END as int) AS n_gold, cast(CASE WHEN l_quantity < 30 THEN 1 ELSE 0 END as int) AS tp FROM {lineitem}"


@query("prf_grouping_sets", f"""SELECT scope, key, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, {_prf_cols("tp", "fp", "fn")} FROM (SELECT CASE grouping_id(entity_type, domain) WHEN 3 THEN 'overall' WHEN 1 THEN 'entity' ELSE 'domain' END AS scope, coalesce(entity_type, domain, '') AS key, sum(tp) AS tp, sum(n_pred) - sum(tp) AS fp, sum(n_gold) - sum(tp) AS fn
FROM ({duck(_COUNTS)}) GROUP BY GROUPING SETS ((), (entity_type), (domain)))""")
def prf_grouping_sets(spark, d):
    return EV.grouped_scores(fixture(spark, d, _COUNTS))


@query("merge_spans", f"""SELECT case_id, CAST(min(char_start) AS BIGINT) AS char_start, CAST(max(char_end) AS BIGINT) AS char_end FROM (SELECT *, sum(fresh) OVER (PARTITION BY case_id ORDER BY char_start, char_end ROWS UNBOUNDED PRECEDING) AS island FROM (
SELECT case_id, char_start, char_end, CASE WHEN char_start <= max(char_end) OVER (PARTITION BY case_id ORDER BY char_start, char_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM ({duck(B.GOLD).replace("* 40", "* 11")}))) GROUP BY case_id, island""")
def merge_spans(spark, d):
    return EV.merged_spans(fixture(spark, d, B.GOLD.replace("* 40", "* 11")))


def _islands(sql: str) -> str:
    return f"""SELECT case_id, min(char_start) AS a, max(char_end) AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY case_id ORDER BY char_start, char_end ROWS UNBOUNDED PRECEDING) AS island FROM (
SELECT case_id, char_start, char_end, CASE WHEN char_start <= max(char_end) OVER (PARTITION BY case_id ORDER BY char_start, char_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM ({sql}))) GROUP BY case_id, island"""


@query("char_level_prf", f"""WITH p AS ({_islands(duck(B.PRED))}), g AS ({_islands(duck(B.GOLD))}), s AS (SELECT (SELECT sum(least(p.b, g.b) - greatest(p.a, g.a)) FROM p JOIN g ON p.case_id = g.case_id AND p.a < g.b AND g.a < p.b) AS tp, (SELECT sum(b - a) FROM p) AS np, (SELECT sum(b - a) FROM g) AS ng, (SELECT sum(400) FROM orders) AS n)
SELECT CAST(tp AS BIGINT) AS tp, CAST(np - tp AS BIGINT) AS fp, CAST(ng - tp AS BIGINT) AS fn, CAST(n - ng AS BIGINT) AS non_pii, {_prf_cols("tp", "(np - tp)", "(ng - tp)")}, round((np - tp) / (n - ng)::DOUBLE, 6) AS fpr FROM s""")
def char_level_prf(spark, d):
    cases = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.lit(400).alias("n_chars"))
    return EV.char_scores(fixture(spark, d, B.PRED), fixture(spark, d, B.GOLD), cases)


_VAL = "SELECT l_orderkey % 500 AS case_id, l_returnflag AS entity_type, cast(l_partkey % 40 as string) AS value FROM {lineitem} WHERE l_quantity "


@query("value_multiset_prf", f"""WITH b AS (SELECT case_id, entity_type, value, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (SELECT case_id, entity_type, value, count(*) AS a FROM ({duck(_VAL)} > 20) GROUP BY ALL) FULL JOIN (SELECT case_id, entity_type, value, count(*) AS b FROM ({duck(_VAL)} < 35) GROUP BY ALL) USING (case_id, entity_type, value)),
s AS (SELECT entity_type, sum(least(a, b)) AS tp, sum(a) - sum(least(a, b)) AS fp, sum(b) - sum(least(a, b)) AS fn FROM b GROUP BY entity_type) SELECT entity_type, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, {_prf_cols("tp", "fp", "fn")} FROM s""")
def value_multiset_prf(spark, d):
    return EV.value_scores(fixture(spark, d, _VAL + "> 20"), fixture(spark, d, _VAL + "< 35"))


_U = "SELECT DISTINCT l_returnflag AS entity_type, cast(l_partkey as string) AS value FROM {lineitem} WHERE "


@query("unique_value_prf", f"""WITH p AS ({duck(_U)} l_quantity > 25), g AS ({duck(_U)} l_discount > 0.03), c AS ({duck(_U)} l_tax > 0.07), s AS (SELECT (SELECT count(*) FROM (SELECT * FROM p INTERSECT SELECT * FROM g)) AS tp, (SELECT count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM g)) AS fp, (SELECT count(*) FROM (SELECT * FROM g EXCEPT SELECT * FROM p)) AS fn, (SELECT count(*) FROM (SELECT * FROM p INTERSECT SELECT * FROM c)) AS h, (SELECT count(*) FROM c) AS n)
SELECT tp, fp, fn, h AS controls_hit, round(coalesce(h / nullif(n, 0)::DOUBLE, 0), 6) AS control_rate, {_prf_cols("tp", "fp", "fn")} FROM s""")
def unique_value_prf(spark, d):
    f = lambda where: fixture(spark, d, _U + where)
    return EV.unique_scores(f("l_quantity > 25"), f("l_discount > 0.03"), f("l_tax > 0.07"))


@query("negative_slot_fpr", """SELECT event_type AS tag, CAST(count(*) FILTER (g = 0) AS BIGINT) AS negative_slots, CAST(count(*) FILTER (g = 0 AND p > 0) AS BIGINT) AS false_hits FROM (
SELECT u.user_id, t.event_type, count(e.event_id) FILTER (e.value > 20) AS g, count(e.event_id) AS p FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) t LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = t.event_type GROUP BY ALL) GROUP BY event_type""")
def negative_slot_fpr(spark, d):
    return EV.negative_slots(table(spark, d, "events"), "user_id", "event_type", F.col("value") > 20)


@query("label_accounting", f"SELECT label, CAST(count(*) AS BIGINT) AS n, {B.d_map('replace(upper(label), chr(32), chr(0))', {w: t for t, words in EV.CORPUS_LABELS.items() for w in words.split()}, 'NULL')} AS entity_type FROM (SELECT CASE c_nationkey % 5 WHEN 0 THEN 'email' WHEN 1 THEN 'SSN' WHEN 2 THEN 'CITY' WHEN 3 THEN 'IBAN' ELSE 'Age' END AS label FROM customer) GROUP BY label")
def label_accounting(spark, d):
    k = F.col("c_nationkey") % 5
    labels = table(spark, d, "customer").select(F.when(k == 0, "email").when(k == 1, "SSN").when(k == 2, "CITY").when(k == 3, "IBAN").otherwise("Age").alias("label"))
    return EV.label_accounting(labels)


@query("latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_disc(value, 0.95), 6) AS p95_rank FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    return EV.latency(table(spark, d, "events"), "event_type", "value")


@query("route_metrics", "SELECT event_type AS route, status, CAST(count(*) AS BIGINT) AS n FROM (SELECT event_type, CASE WHEN value > 50 THEN 500 ELSE 200 END::BIGINT AS status FROM events) GROUP BY ALL ORDER BY n DESC, route, status LIMIT 20")
def route_metrics(spark, d):
    status = F.when(F.col("value") > 50, 500).otherwise(200).cast("long")
    return EV.route_counts(table(spark, d, "events").select(F.col("event_type").alias("route"), status.alias("status")))


# --- fidelity -------------------------------------------------------------------------------------------

_AFTER = "SELECT l_quantity * 1.05 AS l_quantity, l_extendedprice * 0.97 + l_partkey % 7 AS l_extendedprice, l_discount + 0.01 * (l_suppkey % 3) AS l_discount, l_returnflag, CASE l_returnflag WHEN 'A' THEN 'X' ELSE l_returnflag END AS flag2, l_orderkey FROM {lineitem}"
_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


def after(spark, d):
    """A stand-in for a synthetic table: the numeric columns shifted a little."""
    casts = [F.col(c).cast("double").alias(c) for c in _COLS]
    return fixture(spark, d, _AFTER).select(*casts, "l_returnflag", "flag2", "l_orderkey")


_D_AFTER = duck(_AFTER).replace("* 1.05", "* 1.05::DOUBLE").replace("* 0.97", "* 0.97::DOUBLE").replace("+ 0.01 *", "+ 0.01::DOUBLE *")


@query("numeric_fidelity", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(greatest(0, 1 - abs(a.m - b.m) / greatest(abs(b.m), b.s, 1)), 6) AS mean_fidelity, round(greatest(0, 1 - abs(a.s - b.s) / greatest(b.s, 1)), 6) AS std_fidelity FROM (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM lineitem) b, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM ({_D_AFTER})) a" for c in _COLS))
def numeric_fidelity(spark, d):
    return EV.numeric_fidelity(table(spark, d, "lineitem"), after(spark, d), _COLS)


@query("correlation_fidelity", " UNION ALL ".join(f"SELECT '{x}' AS left_column, '{y}' AS right_column, round(greatest(0, 1 - abs(b.r - a.r) / 2), 6) AS fidelity FROM (SELECT corr({x}, {y}) AS r FROM lineitem) b, (SELECT corr({x}, {y}) AS r FROM ({_D_AFTER})) a" for k, x in enumerate(_COLS) for y in _COLS[k + 1 :]))
def correlation_fidelity(spark, d):
    return EV.correlation_fidelity(table(spark, d, "lineitem"), after(spark, d), _COLS)


@query("categorical_tv", f"""WITH a AS (SELECT l_returnflag AS label, count(*) / sum(count(*)) OVER ()::DOUBLE AS p, row_number() OVER (ORDER BY count(*) DESC, l_returnflag) AS rank FROM lineitem GROUP BY 1), b AS (SELECT flag2 AS label, count(*) / sum(count(*)) OVER ()::DOUBLE AS p, row_number() OVER (ORDER BY count(*) DESC, flag2) AS rank FROM ({_D_AFTER}) GROUP BY 1)
SELECT round(1 - (SELECT 0.5::DOUBLE * sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))) FROM a FULL JOIN b USING (label)), 6) AS label_fidelity, round(1 - (SELECT 0.5::DOUBLE * sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))) FROM a FULL JOIN b USING (rank)), 6) AS shape_fidelity""")
def categorical_tv(spark, d):
    return EV.categorical_fidelity(table(spark, d, "lineitem").select("l_returnflag"), after(spark, d).select(F.col("flag2").alias("l_returnflag")), "l_returnflag")


@query("distinct_ratio", "SELECT CAST(count(p_type) AS BIGINT) AS n, CAST(count(DISTINCT p_type) AS BIGINT) AS \"distinct\", round(count(DISTINCT p_type) / count(p_type)::DOUBLE, 6) AS unique_ratio, count(DISTINCT p_type) <= 32 AND count(DISTINCT p_type) / count(p_type)::DOUBLE <= 0.5 AS categorical FROM part")
def distinct_ratio(spark, d):
    return EV.is_categorical(table(spark, d, "part"), "p_type")


@query("order_concordance", "WITH p AS (SELECT n_nationkey AS id, n_nationkey * 7 % 11 AS b, n_nationkey * 7 % 11 + n_regionkey AS a FROM nation) SELECT CAST(count(*) AS BIGINT) AS pairs, round(count(*) FILTER (sign(x.b - y.b) = sign(x.a - y.a)) / count(*)::DOUBLE, 6) AS fidelity, true AS exact FROM p x JOIN p y ON x.id < y.id")
def order_concordance(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_nationkey") * 7 % 11).alias("before"), (F.col("n_nationkey") * 7 % 11 + F.col("n_regionkey")).alias("after"))
    return EV.order_concordance(n)


@query("order_concordance_orders", "WITH p AS (SELECT o_orderkey AS id, o_custkey * 7 % 101 AS b, o_custkey * 7 % 101 + o_orderkey % 13 AS a FROM orders) SELECT CAST(count(*) AS BIGINT) AS pairs, round(count(*) FILTER (sign(x.b - y.b) = sign(x.a - y.a)) / count(*)::DOUBLE, 6) AS fidelity, true AS exact FROM p x JOIN p y ON x.id < y.id")
def order_concordance_orders(spark, d):
    """All pairs of orders, over their whole id range."""
    b = F.col("o_custkey") * 7 % 101
    return EV.order_concordance(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), b.alias("before"), (b + F.col("o_orderkey") % 13).alias("after")))


@query("date_shift", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 400 AS VARCHAR) AS shifted FROM orders")
def date_shift(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("shifted"))
    return TR.shifted(o, "shifted", 400).withColumn("shifted", F.col("shifted").cast("string"))


@query("cyclic_shift", "SELECT a.n_nationkey AS n_nationkey, b.n_name AS shifted FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + 3) % (SELECT count(*) FROM nation)")
def cyclic_shift(spark, d):
    return TR.turned(table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("shifted")), "n_nationkey", "shifted", 3)


@query("schema_keys_shared", "SELECT n_name AS key FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey % 2 = 0) INTERSECT SELECT n_name FROM nation WHERE n_nationkey % 2 = 0")
def schema_keys_shared(spark, d):
    n = table(spark, d, "nation").withColumn("key", F.col("n_name"))
    left = n.join(table(spark, d, "region").filter("r_regionkey % 2 = 0"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    return VG.shared_keys(left, n.filter("n_nationkey % 2 = 0"), "key")


# --- ledgers, retention, time ----------------------------------------------------------------------------

_EV = duck(B.LEDGER_EVENTS)
_HASH = """sha256('{"details":"' || e.details || '","event_type":"' || e.event_type || '","prev_hash":"' || prev_hash || '","sequence":' || e.sequence || ',"timestamp":"' || e."timestamp" || '"}')"""


@query("ledger_chain_verify", f"""WITH RECURSIVE e AS ({_EV}), c AS (SELECT job_id, sequence, {_HASH.replace("prev_hash || '", "repeat('0', 64) || '")} AS h FROM e WHERE sequence = 1
UNION ALL SELECT e.job_id, e.sequence, {_HASH.replace("prev_hash || '", "c.h || '")} FROM c JOIN e ON e.job_id = c.job_id AND e.sequence = c.sequence + 1)
SELECT job_id, NOT (job_id LIKE '%7' AND count(*) > 2) AS valid, CAST(count(*) AS BIGINT) AS event_count, arg_max(h, sequence) AS chain_head, CASE WHEN job_id LIKE '%7' AND count(*) > 2 THEN 2 ELSE 0 END::BIGINT AS first_bad FROM c GROUP BY job_id""")
def ledger_chain_verify(spark, d):
    """Chains of all users' events; where the job's name ends in 7 the second event's details are tampered with."""
    chained = audit.chain(fixture(spark, d, B.LEDGER_EVENTS))
    n = F.count(F.lit(1)).over(Window.partitionBy("job_id"))
    tampered = chained.withColumn("n", n).withColumn("details", F.when(F.col("job_id").endswith("7") & (F.col("sequence") == 2) & (F.col("n") > 2), "forged").otherwise(F.col("details"))).drop("n")
    return audit.verify(tampered).withColumn("first_bad", F.coalesce("first_bad", F.lit(0)))


@query("ledger_last_event", f"SELECT job_id, CAST(max(sequence) AS BIGINT) AS sequence, arg_max(event_type, sequence) AS event_type FROM ({_EV}) GROUP BY job_id")
def ledger_last_event(spark, d):
    return audit.last_events(fixture(spark, d, B.LEDGER_EVENTS))


@query("retention_expired", "SELECT user_id AS job_id, CAST(floor(epoch(min(ts))) AS BIGINT) + 3600 AS deadline FROM events GROUP BY user_id HAVING CAST(floor(epoch(min(ts))) AS BIGINT) + 3600 <= (SELECT CAST(floor(epoch(max(ts))) AS BIGINT) FROM events) - 86400")
def retention_expired(spark, d):
    return flows.expired(table(spark, d, "events"), "user_id", 3_600, 86_400)


@query("events_tumbling", "SELECT CAST(epoch(time_bucket(INTERVAL 5 MINUTE, ts)) AS BIGINT) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, d):
    return flows.tumbling(table(spark, d, "events")).select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("events_sliding", "SELECT CAST(s AS BIGINT) AS start, CAST(count(*) AS BIGINT) AS n, max(value) AS peak FROM (SELECT value, unnest([epoch(time_bucket(INTERVAL 5 MINUTE, ts)), epoch(time_bucket(INTERVAL 5 MINUTE, ts)) - 300]) AS s FROM events) GROUP BY s")
def events_sliding(spark, d):
    return flows.sliding(table(spark, d, "events")).select(F.unix_timestamp("start").alias("start"), "n", "peak")


@query("events_sessions", """SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def events_sessions(spark, d):
    return flows.sessions(table(spark, d, "events")).select("user_id", F.unix_timestamp("start").alias("start"), "n")


@query("asof_anchor_interp", """WITH f AS (SELECT c_nationkey AS track, c_custkey % 200 AS frame FROM customer GROUP BY ALL), a AS (SELECT * FROM f WHERE frame % 20 = 0), b AS (SELECT f.track, f.frame, (SELECT max(frame) FROM a WHERE a.track = f.track AND a.frame <= f.frame) AS l, (SELECT min(frame) FROM a WHERE a.track = f.track AND a.frame >= f.frame) AS r FROM f)
SELECT track, frame, round(CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN CASE WHEN l = r THEN l * 2.0 ELSE l * 2.0 + (r * 2.0 - l * 2.0) * ((frame - l) / (r - l)::DOUBLE) END ELSE coalesce(l, r) * 2.0 END::DOUBLE, 6) AS x0 FROM b WHERE (l IS NOT NULL AND r IS NOT NULL) OR (r IS NULL AND frame - l <= 5) OR (l IS NULL AND r - frame <= 5)""")
def asof_anchor_interp(spark, d):
    frames = table(spark, d, "customer").select(F.col("c_nationkey").alias("track"), (F.col("c_custkey") % 200).alias("frame")).distinct()
    at = (F.col("frame") * 2.0).cast("double")
    anchors = frames.filter("frame % 20 = 0").select("track", "frame", at.alias("x0"), at.alias("y0"), at.alias("x1"), at.alias("y1"))
    return TR.anchor_rects(frames, anchors, 5).select("track", "frame", F.round("x0", 6).alias("x0"))


@query("frame_sampling", "SELECT c_nationkey AS video_id, c_custkey AS frame_index FROM (SELECT *, max(c_custkey) OVER () + 1 AS n FROM customer) WHERE c_custkey % greatest(15, CAST(ceil(n / 119.0) AS BIGINT)) = 0 OR c_custkey = n - 1")
def frame_sampling(spark, d):
    c = table(spark, d, "customer")
    n = c.agg((F.max("c_custkey") + 1).cast("int").alias("n_frames"))
    frames = c.select(F.col("c_nationkey").alias("video_id"), F.col("c_custkey").alias("frame_index")).crossJoin(F.broadcast(n))
    return flows.sampled_frames(frames, fps=30).select("video_id", "frame_index")


@query("frame_novelty", "SELECT user_id, event_id FROM (SELECT *, abs(value - lag(value) OVER w) AS a, abs(value - lead(value) OVER w) AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE least(a, b) >= 40 AND a IS NOT NULL AND b IS NOT NULL")
def frame_novelty(spark, d):
    """Frames that differ from both neighbours by the least novelty."""
    return flows.novel_frames(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 40).select("user_id", "event_id")


@query("upsert_latest", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def upsert_latest(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return E.upsert(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id"], "event_id").select("user_id", "event_type")


@query("insert_or_ignore", "SELECT user_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def insert_or_ignore(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return E.upsert(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id"], "event_id", keep_first=True).select("user_id", "event_type")


@query("cascade_delete", """SELECT 'parents' AS name, CAST(count(*) AS BIGINT) AS deleted FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0)""")
def cascade_delete(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return E.cascade(c, c.filter("c_custkey % 10 = 0").select("c_custkey"), {"orders": (o, "o_custkey")}, "c_custkey")[1]


_CHAIN = """SELECT o_orderkey AS doc_id, t.k AS k, 'X' AS entity_type, cast(t.a as bigint) AS char_start, cast(t.b + CASE WHEN t.k = 2 THEN o_orderkey % 3 ELSE 0 END as bigint) AS char_end FROM {orders} CROSS JOIN (VALUES (1, 0, 5), (2, 3, 10), (3, 8, 12), (4, 20, 26), (5, 22, 25), (6, 26, 30)) AS t(k, a, b)"""


@query("overlapping_spans_resolved", f"SELECT doc_id, CAST(k AS BIGINT) AS k, CASE k WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 5 THEN false ELSE true END AS kept FROM ({duck(_CHAIN)})")
def overlapping_spans_resolved(spark, d):
    """A chain of three whose middle is the longest, one span inside another, and one that only touches."""
    return TR.resolve(fixture(spark, d, _CHAIN)).select("doc_id", F.col("k").cast("long").alias("k"), "kept")


@query("life_cycle_errors", """SELECT job_id, CAST(count(*) AS BIGINT) AS bad FROM (SELECT user_id AS job_id, event_id % 3 AS s, lag(event_id % 3) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS NOT NULL AND NOT (p = 0 AND s = 1 OR p = 1 AND s = 2) GROUP BY job_id""")
def life_cycle_errors(spark, d):
    k = F.col("event_id") % 3
    states = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("ts"), F.when(k == 0, "CREATED").when(k == 1, "UPLOADED").otherwise("ANALYSED").alias("state"))
    return flows.bad_transitions(states).groupBy("job_id").agg(F.count(F.lit(1)).alias("bad"))


@query("nearest_region", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) < 2000")
def nearest_region(spark, d):
    """Candidates within reach of each other in one region: an equi join with a range condition."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("region"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("place"))
    return EV.within_reach(s, "region", "id", "place", 2000.0)


@query("region_assignment", "SELECT CAST(s_nationkey AS BIGINT) AS scope, CAST(min(s_suppkey) AS BIGINT) AS l, CAST(1000000 + min(s_suppkey) AS BIGINT) AS r, CAST(1 AS DOUBLE) AS score FROM supplier GROUP BY s_nationkey")
def region_assignment(spark, d):
    """Decoded codes to reviewed regions, one to one: of the codes that claim a nation's one region, the best score gets it."""
    s = table(spark, d, "supplier").withColumn("first", F.min("s_suppkey").over(Window.partitionBy("s_nationkey")))
    pairs = s.select(F.col("s_nationkey").cast("long").alias("scope"), F.col("s_suppkey").alias("l"), (F.col("first") + 1_000_000).alias("r"), F.when(F.col("s_suppkey") == F.col("first"), 1.0).otherwise(0.5).alias("score"))
    return EV.assign(pairs, "l", "r", "score", "scope")


_SPANS = "SELECT DISTINCT l_orderkey AS case_id, 'X' AS entity_type, cast(l_linenumber * 40 as bigint) AS char_start, cast(l_linenumber * 40 + 10 as bigint) AS char_end, concat('v', cast(l_linenumber as string)) AS value FROM {lineitem}"


@query("relaxed_coverage", f"""WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 20), g AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0.03), b AS (SELECT count(*) AS n FROM p JOIN g USING (l_orderkey, l_linenumber))
SELECT n AS tp_pred, (SELECT count(*) FROM p) AS n_pred, n AS tp_gold, (SELECT count(*) FROM g) AS n_gold, round(n / (SELECT count(*) FROM p)::DOUBLE, 6) AS precision, round(n / (SELECT count(*) FROM g)::DOUBLE, 6) AS recall,
round(2 * (n / (SELECT count(*) FROM p)::DOUBLE) * (n / (SELECT count(*) FROM g)::DOUBLE) / (n / (SELECT count(*) FROM p)::DOUBLE + n / (SELECT count(*) FROM g)::DOUBLE), 6) AS f1 FROM b""")
def relaxed_coverage(spark, d):
    return EV.relaxed_coverage(fixture(spark, d, _SPANS + " WHERE l_quantity > 20"), fixture(spark, d, _SPANS + " WHERE l_discount > 0.03"))


_VALUE = "SELECT l_orderkey % 300 AS case_id, cast(l_partkey % 30 as string) AS value"
_NEEDS = _VALUE + ", concat('a', cast(l_suppkey % 2 as string)) AS annotator, CASE l_linenumber % 3 WHEN 0 THEN 'DIRECT' WHEN 1 THEN 'QUASI' ELSE 'NO_MASK' END AS need FROM {lineitem} WHERE l_quantity < 30"


@query("annotator_scores", f"""WITH p AS (SELECT case_id, value, count(*) AS a FROM ({duck(_VALUE + " FROM {lineitem} WHERE l_tax > 0.04")}) GROUP BY ALL), gold AS ({duck(_NEEDS)}), w AS (SELECT annotator, case_id, value, count(*) AS b, count(*) FILTER (need = 'DIRECT') > 0 AS direct FROM gold WHERE need <> 'NO_MASK' GROUP BY ALL),
t AS (SELECT w.*, least(b, coalesce(a, 0)) AS tp FROM w LEFT JOIN p USING (case_id, value)), s AS (SELECT sum(tp) AS tp, sum(b) AS ng, sum(tp) FILTER (direct) / (sum(b) FILTER (direct))::DOUBLE AS dr, sum(tp) FILTER (NOT direct) / (sum(b) FILTER (NOT direct))::DOUBLE AS qr, (SELECT sum(a) FROM (SELECT DISTINCT annotator, case_id FROM gold) JOIN p USING (case_id)) AS np FROM t),
f AS (SELECT count(a) / count(*)::DOUBLE AS r FROM (SELECT DISTINCT annotator, case_id, value FROM gold WHERE need = 'NO_MASK') LEFT JOIN p USING (case_id, value))
SELECT CAST(tp AS BIGINT) AS tp, CAST(np - tp AS BIGINT) AS fp, CAST(ng - tp AS BIGINT) AS fn, {_prf_cols("tp", "(np - tp)", "(ng - tp)")}, round(dr, 6) AS direct_recall, round(qr, 6) AS quasi_recall, round(r, 6) AS no_mask_rate FROM s, f""")
def annotator_scores(spark, d):
    return EV.annotator_scores(fixture(spark, d, _VALUE + " FROM {lineitem} WHERE l_tax > 0.04"), fixture(spark, d, _NEEDS))


@query("unit_breakdown", "SELECT source, lang AS kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(count(*) FILTER (trim(text) = '') AS BIGINT) AS empty FROM documents GROUP BY ALL")
def unit_breakdown(spark, d):
    return EV.unit_breakdown(table(spark, d, "documents").select("source", F.col("lang").alias("kind"), "text"))


_ANN = "SELECT c_custkey AS doc_id, cast(0 as bigint) AS char_start, cast(5 as bigint) AS char_end, 'AGE' AS entity_type, c_name AS plaintext, 0.9D AS confidence, 'NOT_REQUIRED' AS review_status, 'age' AS context_label FROM {customer}"


@query("annotation_rows", "SELECT c_custkey AS doc_id, CAST(length(c_name) AS BIGINT) AS n_chars, CASE WHEN c_custkey % 2 = 0 THEN 'MASK' ELSE 'RETAIN' END AS action, c_custkey % 2 = 0 AS transformed FROM customer")
def annotation_rows(spark, d):
    m = fixture(spark, d, _ANN)
    acted = m.filter("doc_id % 2 = 0").select("doc_id", "char_start", "char_end", "entity_type", F.lit("MASK").alias("action"), F.lit("x").alias("replacement"))
    return TR.annotations(m, acted).select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "action", "transformed")


@query("approved_phrases", "SELECT c_custkey AS doc_id, c_custkey % 2 = 0 AS leaked FROM customer")
def approved_phrases(spark, d):
    """A value inside an approved replacement is no leak; the same value elsewhere is one."""
    c = table(spark, d, "customer").withColumn("doc_id", F.col("c_custkey"))
    t = c.select("doc_id", F.concat(F.lit("office of "), "c_mktsegment", F.lit(" lane"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(", "), "c_mktsegment")).otherwise("")).alias("protected"))
    known_ = c.select("doc_id", F.lit("EMPLOYER").alias("entity_type"), F.col("c_mktsegment").alias("plaintext"))
    approved = c.select("doc_id", F.concat(F.lit("office of "), "c_mktsegment", F.lit(" lane")).alias("replacement"))
    hits = VG.leaks(known_, VG.without_phrases(t, approved)).select("doc_id").distinct().withColumn("leaked", F.lit(True))
    return c.select("doc_id").join(hits, "doc_id", "left").select("doc_id", F.coalesce("leaked", F.lit(False)).alias("leaked"))


@query("span_iou", f"SELECT case_id, char_start, round(greatest(0, least(char_end, char_start + 15) - greatest(char_start, char_start + 3)) / ((char_end - char_start) + 12 - greatest(0, least(char_end, char_start + 15) - greatest(char_start, char_start + 3)))::DOUBLE, 6) AS iou FROM ({duck(B.GOLD)})")
def span_iou(spark, d):
    a, b = F.col("char_start"), F.col("char_end")
    return fixture(spark, d, B.GOLD).select("case_id", "char_start", F.round(V.iou((a, b), (a + 3, a + 15)), 6).alias("iou"))


@query("ner_scores", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(1 / (1 + exp(-greatest(-30, least(30, 3 * l_discount * 10 - l_quantity / 10)))), 6) AS p FROM lineitem")
def ner_scores(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.round(V.sigmoid(3 * F.col("l_discount") * 10 - F.col("l_quantity") / 10), 6).alias("p"))


# --- files --------------------------------------------------------------------------------------------------


@query("rtf_round_trip", "SELECT doc_id, sha256(trim(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), chr(10))) AS text_sha256 FROM documents")
def rtf_round_trip(spark, d):
    """Every document written as RTF and read back."""
    from ..sources import office

    made = table(spark, d, "documents").select("doc_id", F.lit("a.rtf").alias("name"), office.rtf_column(F.col("text")).alias("content"))
    return office.texts(made).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@query("csv_file_cells", "SELECT c_nationkey::BIGINT AS doc_id, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::BIGINT AS record, unnest(['name', 'name#2', 'column_3']) AS header, unnest([c_name, c_mktsegment, 'a,\"b\"']) AS value FROM customer")
def csv_file_cells(spark, d):
    """A CSV file for each nation, with repeated and empty headers and quoted cells, read to cells."""
    from ..sources import structured

    line = F.concat_ws(",", "c_name", "c_mktsegment", F.lit('"a,""b"""'))
    rows = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))).alias("rows"))
    files = rows.select("doc_id", F.lit("a.csv").alias("name"), F.encode(F.concat(F.lit("name,name,\n"), F.array_join("rows.line", "\n")), "UTF-8").alias("content"))
    return structured.cells(files).select("doc_id", F.col("record").cast("long").alias("record"), "header", "value")


@query("json_file_leaves", """SELECT c_custkey AS doc_id, unnest(['/contact/a~1b/0', '/contact/a~1b/1', '/id']) AS pointer, unnest(['contact.a/b', 'contact.a/b', 'id']) AS header, unnest([c_name, c_mktsegment, c_custkey::VARCHAR]) AS value, unnest(['string', 'string', 'bigint']) AS kind FROM customer""")
def json_file_leaves(spark, d):
    """A nested JSON file for each customer, read to leaves with pointers."""
    from ..sources import structured

    body = F.to_json(F.struct(F.create_map(F.lit("a/b"), F.array("c_name", "c_mktsegment")).alias("contact"), F.col("c_custkey").alias("id")))
    files = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("a.json").alias("name"), F.encode(body, "UTF-8").alias("content"))
    return structured.cells(files).select("doc_id", "pointer", "header", "value", "kind")


# --- not expressible in SQL ---------------------------------------------------------------------------------


@query("matched_spans")
def matched_spans(spark, d):
    """One-to-one greedy matches of predictions and gold."""
    return EV.match(EV.candidate_pairs(fixture(spark, d, B.PRED), fixture(spark, d, B.GOLD)))


@query("synthetic_twin")
def synthetic_twin(spark, d):
    return TR.twin(table(spark, d, "customer"), "c_custkey", b"a salt for this query")


@query("sanitized_texts")
def sanitized_texts(spark, d):
    t = texts(spark, d)
    spans = known(spark, d).join(t.select("doc_id", "text").hint("merge"), "doc_id").withColumn("char_start", F.expr("locate(plaintext, text) - 1")).withColumn("char_end", F.col("char_start") + F.length("plaintext"))
    return TR.sanitize(t.select("doc_id", "text"), spans)


@query("verification_gates")
def verification_gates(spark, d):
    """All gates of text over a small output with planted faults."""
    k, t = known(spark, d), texts(spark, d)
    spans = k.join(t.select("doc_id", "text").hint("merge"), "doc_id").withColumn("char_start", F.expr("locate(plaintext, text) - 1")).withColumn("char_end", F.col("char_start") + F.length("plaintext")).drop("text")
    return VG.run(t, k, k, spans, level=2, rescan=lambda x: detect.mentions(x.select("doc_id", F.col("protected").alias("text"))))
