"""Queries on lines, native extraction, identity, policy and risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import taxonomy as T
from ..functions import values as V
from ..operators import detect, entities as E, graph as G
from ..sources.lines import lines
from . import base as B
from .base import duck, fixture, query, table


@query("lines_with_offsets", f"SELECT doc_id, CAST(line_no // 44 AS BIGINT) AS page_index, CAST(line_no AS BIGINT) AS line_no, char_start, CAST(length(text) AS BIGINT) AS n FROM ({B.LINES_SQL}) WHERE trim(text, ' ') <> ''")
def lines_with_offsets(spark, d):
    return lines(table(spark, d, "documents")).select("doc_id", F.col("page_index").cast("long").alias("page_index"), F.col("line_no").cast("long").alias("line_no"), "char_start", F.length("text").cast("long").alias("n"))


def emails(docs: DataFrame) -> DataFrame:
    """Strict mail addresses of documents; the cheap test on @ comes first and is pushed to the scan."""
    return docs.filter(F.col("text").contains("@")).select("doc_id", F.explode(F.expr(f"regexp_extract_all(text, r'{B.EMAIL}', 0)")).alias("plaintext"))


def numbers(docs: DataFrame) -> DataFrame:
    """Runs of 13 to 19 digits that stand alone, with whether they pass the check digit."""
    found = docs.filter(F.col("text").rlike("[0-9]{13}")).select("doc_id", F.explode(F.expr("regexp_extract_all(text, '[0-9]+', 0)")).alias("plaintext"))
    return found.filter(F.length("plaintext").between(13, 19)).withColumn("valid", V.luhn(F.col("plaintext")))


@query("email_mentions", f"SELECT doc_id, lower(v) AS normalized, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{B.EMAIL}')) AS v FROM documents) GROUP BY ALL")
def email_mentions(spark, d):
    return emails(table(spark, d, "documents")).groupBy("doc_id", F.lower("plaintext").alias("normalized")).agg(F.count(F.lit(1)).alias("n"))


NUMBERS_SQL = f"SELECT doc_id, d, ({B.D_LUHN}) AND NOT regexp_matches(d, '^(0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)$') AS valid FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS d FROM documents) WHERE length(d) BETWEEN 13 AND 19"


@query("card_luhn_mentions", f"SELECT doc_id, d AS digits, valid FROM ({NUMBERS_SQL})")
def card_luhn_mentions(spark, d):
    return numbers(table(spark, d, "documents")).select("doc_id", F.col("plaintext").alias("digits"), "valid")


IPV4 = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"


@query("ipv4_like_phone", f"SELECT doc_id, v AS plaintext, length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 10 AND 15 AS phone_like FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{IPV4}')) AS v FROM documents)")
def ipv4_like_phone(spark, d):
    found = table(spark, d, "documents").filter(F.col("text").rlike(IPV4)).select("doc_id", F.explode(F.expr(f"regexp_extract_all(text, r'{IPV4}', 0)")).alias("plaintext"))
    return found.select("doc_id", "plaintext", F.length(V.digits(F.col("plaintext"))).between(10, 15).alias("phone_like"))


@query("date_mentions", "SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%Y-%m-%d') AS plaintext FROM orders UNION ALL SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') FROM orders")
def date_mentions(spark, d):
    """The dates that the broad family finds in two forms of each order's date."""
    text = F.concat(F.lit("filed "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" and "), F.date_format("o_orderdate", "dd.MM.yyyy"))
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))
    return detect.mentions(docs, only=("broad",)).filter("entity_type = 'GENERIC_DATE'").select("doc_id", "plaintext")


def value_query(name: str, spark_expr, duck_expr: str) -> None:
    @query(name, f"SELECT doc_id, entity_type, {duck_expr} AS result FROM ({duck(B.VALUES)})")
    def run(spark, d):
        return fixture(spark, d, B.VALUES).select("doc_id", "entity_type", spark_expr(F.col("entity_type"), F.col("plaintext")).alias("result"))


value_query("normalize_identity", V.normalize, B.d_normalize("entity_type", "plaintext"))
value_query("mask_l1", V.mask, B.d_mask("entity_type", "plaintext"))
value_query("generalize_values", V.generalize, B.d_generalize("entity_type", "plaintext"))
value_query("age_bands", lambda t, v: F.when(t == "AGE", V.band_of_age(v)), f"CASE WHEN entity_type = 'AGE' THEN {B.d_age('plaintext')} END")
value_query("birth_years", lambda t, v: F.when(t == "DATE_OF_BIRTH", V.year_of(v)).otherwise(0).cast("long"), f"CASE WHEN entity_type = 'DATE_OF_BIRTH' THEN {B.d_year('plaintext')} ELSE 0 END")

_REPLACED = f"""WITH v AS (SELECT doc_id, entity_type, plaintext, doc_id % 60 AS i FROM ({duck(B.VALUES)}) WHERE doc_id <= 200)
SELECT v.doc_id, v.entity_type, CAST(p.level AS BIGINT) AS level, p.action, {B.d_replacement("v.entity_type", "v.plaintext", "p.action", "i")} AS replacement
FROM v JOIN {B.policy_values()} ON v.entity_type = p.entity_type AND p.audience = 'RESEARCH_PARTNER'"""


@query("policy_replacements", _REPLACED.replace(" WHERE doc_id <= 200", ""))
def policy_replacements(spark, d):
    v = G.with_actions(fixture(spark, d, B.VALUES), audience="RESEARCH_PARTNER")
    return v.select("doc_id", "entity_type", F.col("level").cast("long").alias("level"), "action", V.replacement(F.col("entity_type"), F.col("plaintext"), F.col("action"), F.col("doc_id") % 60).alias("replacement"))


@query("policy_matrix", f"SELECT entity_type, CAST(level AS BIGINT) AS level, audience, action, residual, CAST(loss AS BIGINT) AS loss, CAST(weight AS BIGINT) AS weight FROM {B.policy_values()}")
def policy_matrix(spark, d):
    return T.policy_table(spark).select("entity_type", F.col("level").cast("long").alias("level"), "audience", "action", "residual", F.col("loss").cast("long").alias("loss"), F.col("weight").cast("long").alias("weight"))


# --- entities of documents ------------------------------------------------------------------------------

_MADE = f"SELECT *, {B.d_normalize('entity_type', 'plaintext')} AS normalized FROM ({duck(B.MENTIONS)})"
ENTITIES_SQL = f"""SELECT *, row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY first_pos, normalized) AS ordinal FROM (
  SELECT doc_id, entity_type, normalized, count(*) AS mention_count, min(char_start) AS first_pos,
    string_agg(DISTINCT CASE WHEN review_status <> 'IGNORE' THEN context_label END, ' ') AS context, count(*) FILTER (review_status <> 'IGNORE') AS active,
    CASE WHEN bool_or(review_status = 'PENDING') THEN 'pending' WHEN bool_and(review_status = 'IGNORE') THEN 'ignored' WHEN bool_or(review_status = 'PROTECT') THEN 'reviewed-protect' ELSE 'automatic' END AS review_state
  FROM ({_MADE}) GROUP BY doc_id, entity_type, normalized)"""
_PLACE = "entity_type || '_' || lpad(CAST(ordinal AS VARCHAR), CAST(greatest(3, length(CAST(ordinal AS VARCHAR))) AS INTEGER), '0')"


def mentions_(spark, d):
    return fixture(spark, d, B.MENTIONS)


def entities_(spark, d) -> DataFrame:
    """Entities with what the graph needs: joined contexts, active mentions, review state."""
    m = mentions_(spark, d)
    norm = m.withColumn("normalized", V.normalize(F.col("entity_type"), F.col("plaintext")))
    active = F.col("review_status") != "IGNORE"
    extra = norm.groupBy("doc_id", "entity_type", "normalized").agg(F.concat_ws(" ", F.array_sort(F.collect_set(F.when(active, F.col("context_label"))))).alias("context"), F.count_if(active).alias("active"))
    state = E.review_state(norm, ["doc_id", "entity_type", "normalized"])
    key = ["doc_id", "entity_type", "normalized"]
    return E.canonical(m).join(extra, key).join(state, key)


@query("canonical_entities", f"SELECT doc_id, entity_type, normalized, CAST(mention_count AS BIGINT) AS mention_count, first_pos, {_PLACE} AS placeholder, sha256(entity_type || ':' || normalized) AS fingerprint FROM ({ENTITIES_SQL})")
def canonical_entities(spark, d):
    return E.canonical(mentions_(spark, d)).select("doc_id", "entity_type", "normalized", "mention_count", "first_pos", "placeholder", "fingerprint")


@query("placeholder_ordinals", f"SELECT doc_id, placeholder, CAST(row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY placeholder) - 1 AS BIGINT) AS alias FROM (SELECT *, {_PLACE} AS placeholder FROM ({ENTITIES_SQL}))")
def placeholder_ordinals(spark, d):
    return E.alias_ordinals(E.canonical(mentions_(spark, d))).select("doc_id", "placeholder", F.col("alias").cast("long").alias("alias"))


@query("mentions_with_entities", f"SELECT m.doc_id, m.char_start, m.plaintext, {_PLACE} AS placeholder FROM ({_MADE}) m JOIN ({ENTITIES_SQL}) e USING (doc_id, entity_type, normalized)")
def mentions_with_entities(spark, d):
    m = mentions_(spark, d)
    return E.with_entities(m, E.canonical(m)).select("doc_id", "char_start", "plaintext", "placeholder")


@query("entity_mention_counts", f"SELECT doc_id, {_PLACE} AS placeholder, CAST(coalesce(n, 0) AS BIGINT) AS n FROM ({ENTITIES_SQL}) LEFT JOIN (SELECT doc_id, entity_type, normalized, count(*) AS n FROM ({_MADE}) WHERE review_status = 'PENDING' GROUP BY ALL) USING (doc_id, entity_type, normalized)")
def entity_mention_counts(spark, d):
    m = mentions_(spark, d)
    ents = E.canonical(m)
    return E.mention_counts(ents, E.with_entities(m.filter("review_status = 'PENDING'"), ents)).select("doc_id", "placeholder", "n")


@query("category_counts", f"SELECT doc_id, CAST(count(*) FILTER (entity_type IN ({B.names(T.DIRECT)})) AS BIGINT) AS direct, CAST(count(*) FILTER (entity_type IN ({B.names(T.QUASI)})) AS BIGINT) AS quasi, CAST(count(*) FILTER (entity_type IN ({B.names(T.VISUAL)})) AS BIGINT) AS visual, CAST(count(*) FILTER (review_status = 'PENDING') AS BIGINT) AS pending FROM ({duck(B.MENTIONS)}) GROUP BY doc_id")
def category_counts(spark, d):
    return E.category_counts(mentions_(spark, d))


@query("review_states", f"SELECT doc_id, entity_type, normalized, review_state FROM ({ENTITIES_SQL})")
def review_states(spark, d):
    norm = mentions_(spark, d).withColumn("normalized", V.normalize(F.col("entity_type"), F.col("plaintext")))
    return E.review_state(norm, ["doc_id", "entity_type", "normalized"])


_HELD = "review_status = 'PENDING' AND entity_type = 'PERSON_NAME'"


@query("temporal_collapse", f"SELECT doc_id, char_start, CASE WHEN ({_HELD}) AND row_number() OVER (PARTITION BY doc_id, entity_type, normalized, ({_HELD}) ORDER BY char_start) > 1 THEN 'NOT_REQUIRED' ELSE review_status END AS review_status FROM ({_MADE})")
def temporal_collapse(spark, d):
    return E.collapse_pending(mentions_(spark, d), ["char_start"]).select("doc_id", "char_start", "review_status")


@query("dedupe_spans", f"SELECT doc_id, entity_type, char_start, char_end, max(confidence) AS confidence FROM (SELECT doc_id, entity_type, char_start % 512 AS char_start, char_start % 512 + 6 AS char_end, confidence + (char_start % 7) / 1000.0::DOUBLE AS confidence FROM ({duck(B.MENTIONS)})) GROUP BY ALL")
def dedupe_spans(spark, d):
    m = mentions_(spark, d)
    folded = m.select("doc_id", "entity_type", "plaintext", (F.col("char_start") % 512).alias("char_start"), (F.col("char_start") % 512 + 6).alias("char_end"), (F.col("confidence") + (F.col("char_start") % 7) / F.lit(1000.0)).alias("confidence"))
    return E.best_spans(folded).select("doc_id", "entity_type", "char_start", "char_end", "confidence")


# --- risk, graph, recommendation -------------------------------------------------------------------------


def risk_sql() -> str:
    """Components, totals and utility by document, level and audience."""
    def by(value) -> str:
        return "CASE " + " ".join(f"WHEN level = {level} AND audience = '{a}' THEN {float(value(level, a))}::DOUBLE" for level in T.LEVELS for a in T.AUDIENCES) + " ELSE 1.0::DOUBLE END"

    combos_b = " + ".join(f"CASE WHEN {' AND '.join(f'has_{t}' for t in types)} THEN {s}.0::DOUBLE ELSE 0 END" for types, s in T.COMBINATIONS)
    combos_a = " + ".join(f"CASE WHEN {' AND '.join(f'has_{t}' for t in types)} THEN {s} * ({by(lambda level, a, types=types: max(T.RESIDUAL[T.action(t, level, a)] for t in types))}) ELSE 0 END" for types, s in T.COMBINATIONS)
    relation = by(lambda level, a: T.RELATION_FACTOR.get(T.action("PERSON_NAME", level, a), 1.0))
    part = lambda x, cap: f"least({cap}, CAST(round_even(round_even({x}, 9), 0) AS INTEGER))"
    has = ", ".join(f"bool_or(e.entity_type = '{t}') AS has_{t}" for t in sorted({t for c, _ in T.COMBINATIONS for t in c}))
    quasi = f"e.entity_type IN ({B.names(T.QUASI)})"
    return f"""WITH s AS (SELECT e.doc_id, p.level, p.audience, count(*) AS n_entities,
    sum(CASE WHEN NOT {quasi} THEN p.weight * 1.0::DOUBLE ELSE 0 END) AS db, sum(CASE WHEN NOT {quasi} THEN p.weight * p.residual ELSE 0 END) AS da,
    sum(CASE WHEN {quasi} THEN p.weight * 1.0::DOUBLE ELSE 0 END) AS qb, sum(CASE WHEN {quasi} THEN p.weight * p.residual ELSE 0 END) AS qa,
    count(*) FILTER (e.entity_type = 'PERSON_NAME' AND {B.d_related("e.context")}) AS related, sum(p.loss) AS loss, {has}
    FROM (SELECT * FROM ({ENTITIES_SQL}) WHERE active > 0) e JOIN {B.policy_values()} ON e.entity_type = p.entity_type GROUP BY ALL),
  c AS (SELECT *, {part("db * 0.60", 50)} AS d1, {part("qb * 0.55", 34)} AS q1, {part("related * 14.0::DOUBLE", 14)} AS r1, {part(f"({combos_b}) * 0.70", 28)} AS c1,
    {part("da * 0.60", 50)} AS d2, {part("qa * 0.55", 34)} AS q2, {part(f"related * 14 * ({relation})", 14)} AS r2, {part(f"({combos_a}) * 0.70", 28)} AS c2 FROM s)
  SELECT doc_id, level, audience, n_entities, d1, q1, r1, c1, d2, q2, r2, c2, least(100, d1 + q1 + r1 + c1) AS before, least(100, d2 + q2 + r2 + c2) AS after, greatest(45, 100 - least(55, loss)) AS utility FROM c"""


_LONG = lambda *cols: ", ".join(f"CAST({c} AS BIGINT) AS {a}" for c, a in cols)


@query("exposure_components", f"SELECT {_LONG(('doc_id', 'doc_id'), ('level', 'level'), ('n_entities', 'n_entities'), ('d1', 'direct_before'), ('q1', 'quasi_before'), ('r1', 'relation_before'), ('c1', 'combo_before'), ('d2', 'direct_after'), ('q2', 'quasi_after'), ('r2', 'relation_after'), ('c2', 'combo_after'))}, audience FROM ({risk_sql()})")
def exposure_components(spark, d):
    r = G.risk(entities_(spark, d).filter("active > 0"))
    names = [f"{k}_{w}" for w in ("before", "after") for k in ("direct", "quasi", "relation", "combo")]
    return r.select("doc_id", F.col("level").cast("long").alias("level"), "audience", "n_entities", *[F.col(f"{n}_part").cast("long").alias(n) for n in names])


@query("exposure_by_level", f"SELECT {_LONG(('doc_id', 'doc_id'), ('level', 'level'), ('before', 'before'), ('after', 'after'), ('utility', 'utility'))}, audience, {B.d_band('before')} AS band_before, {B.d_band('after')} AS band_after FROM ({risk_sql()})")
def exposure_by_level(spark, d):
    r = G.risk(entities_(spark, d).filter("active > 0"))
    return r.select("doc_id", "audience", *[F.col(c).cast("long").alias(c) for c in ("level", "before", "after", "utility")], "band_before", "band_after")


_MARKED = f"""SELECT *, entity_type = 'PERSON_NAME' AND (told OR nth > 1) AS is_related, {_PLACE} AS placeholder FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, entity_type = 'PERSON_NAME', told ORDER BY first_pos, sha256(CAST(doc_id AS VARCHAR) || '|' || sha256(entity_type || ':' || normalized))) AS nth FROM (
    SELECT *, entity_type = 'PERSON_NAME' AND {B.d_related("context")} AS told FROM ({ENTITIES_SQL}) WHERE active > 0))"""
_WEIGHT = B.d_map("entity_type", {k: str(v) for k, v in T.WEIGHTS.items()}, "'0'")


@query("graph_nodes", f"""WITH m AS ({_MARKED}) SELECT doc_id, 'DOCUMENT' AS kind, CAST(NULL AS VARCHAR) AS label, CAST(sum(mention_count) AS BIGINT) AS mention_count, 'source' AS review_state FROM m GROUP BY doc_id
UNION ALL SELECT doc_id, 'SUBJECT', 'Reconstructable subject', 0, 'inferred' FROM m GROUP BY doc_id HAVING NOT bool_or(entity_type = 'PERSON_NAME' AND NOT is_related)
UNION ALL SELECT doc_id, CASE WHEN entity_type = 'PERSON_NAME' THEN CASE WHEN is_related THEN 'RELATED_PERSON' ELSE 'SUBJECT' END WHEN entity_type IN ({B.names(T.DIRECT)}) THEN 'DIRECT_IDENTIFIER' WHEN entity_type IN ({B.names(T.QUASI)}) THEN 'QUASI_IDENTIFIER' ELSE 'VISUAL_IDENTIFIER' END, placeholder, CAST(mention_count AS BIGINT), review_state FROM m""")
def graph_nodes(spark, d):
    return G.nodes(entities_(spark, d).filter("active > 0")).select("doc_id", "kind", "label", "mention_count", "review_state")


@query("graph_edges", f"""WITH m AS (SELECT *, CAST({_WEIGHT} AS BIGINT) AS w, max(CASE WHEN entity_type = 'PERSON_NAME' AND NOT is_related THEN placeholder END) OVER (PARTITION BY doc_id) AS subject FROM ({_MARKED})),
h AS (SELECT doc_id, entity_type FROM m GROUP BY ALL),
c(a, b, w, combo) AS (VALUES {", ".join(f"('{x}', '{y}', {s}, {k})" for k, (types, s) in enumerate(T.PATH_COMBINATIONS) for x, y in zip(types, types[1:]))}),
need(combo, t) AS (VALUES {", ".join(f"({k}, '{t}')" for k, (types, _) in enumerate(T.PATH_COMBINATIONS) for t in types)}),
ok AS (SELECT doc_id, combo FROM need JOIN h ON t = entity_type GROUP BY ALL HAVING count(*) = CASE combo {" ".join(f"WHEN {k} THEN {len(t)}" for k, (t, _) in enumerate(T.PATH_COMBINATIONS))} END),
e AS (SELECT DISTINCT doc_id, 'CONTAINS' AS edge_type, 10 AS weight FROM m
UNION ALL SELECT doc_id, 'CONTAINS', 4 FROM m WHERE subject IS NULL OR placeholder <> subject
UNION ALL SELECT doc_id, CASE WHEN is_related THEN 'RELATED_TO' WHEN entity_type IN ({B.names(T.QUASI)}) THEN 'DESCRIBES' ELSE 'IDENTIFIES' END, CASE WHEN is_related THEN 14 ELSE least(26, w) END FROM m WHERE subject IS NULL OR placeholder <> subject
UNION ALL SELECT doc_id, 'CO_OCCURS_WITH', w FROM ok JOIN c USING (combo))
SELECT doc_id, edge_type, CAST(weight AS BIGINT) AS weight, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY ALL""")
def graph_edges(spark, d):
    return G.edges(entities_(spark, d).filter("active > 0")).groupBy("doc_id", "edge_type", F.col("weight").cast("long").alias("weight")).agg(F.count(F.lit(1)).alias("n"))


@query("top_risk_paths", f"""WITH m AS (SELECT *, CAST({_WEIGHT} AS BIGINT) AS w FROM ({_MARKED})), h AS (SELECT doc_id, list(DISTINCT entity_type) AS have FROM m GROUP BY doc_id),
p AS (SELECT doc_id, 14 AS score, 'related ' || CASE {" ".join(f"WHEN contains(lower(context), '{x}') THEN '{x + ' person' if x == 'emergency contact' else x}'" for x in T.RELATION_WORDS)} ELSE 'related person' END AS reason, first_pos AS place FROM m WHERE is_related
UNION ALL SELECT doc_id, least(26, w), entity_type, first_pos FROM m WHERE w >= 17 AND entity_type <> 'PERSON_NAME'
{" ".join(f"UNION ALL SELECT doc_id, {s}, '{'+'.join(t)}', 1099511627776 FROM h WHERE {' AND '.join(f'list_contains(have, {chr(39)}{x}{chr(39)})' for x in t)}" for t, s in T.PATH_COMBINATIONS)})
SELECT doc_id, CAST(rank AS BIGINT) AS rank, CAST(score AS BIGINT) AS score, reason FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place, reason) AS rank FROM p) WHERE rank <= 8""")
def top_risk_paths(spark, d):
    return G.paths(entities_(spark, d).filter("active > 0")).select("doc_id", F.col("rank").cast("long").alias("rank"), F.col("score").cast("long").alias("score"), "reason")


@query("same_record_combos", """SELECT c_mktsegment AS segment, CAST(count(*) AS BIGINT) AS records, CAST(count(*) FILTER (age AND place AND job) AS BIGINT) AS linked, bool_or(age AND place AND job) AS linkable FROM (
SELECT c_mktsegment, c_custkey % 2 = 0 AS age, n_regionkey < 3 AS place, c_acctbal > 0 AS job FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY c_mktsegment""")
def same_record_combos(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    flags = rows.select(F.col("c_mktsegment").alias("segment"), (F.col("c_custkey") % 2 == 0).alias("age"), (F.col("n_regionkey") < 3).alias("place"), (F.col("c_acctbal") > 0).alias("job"))
    return G.same_record_combos(flags, "segment", ["age", "place", "job"])


@query("risk_by_source", f"""WITH m AS (SELECT doc_id, 'EMAIL' AS t, lower(v) AS v FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{B.EMAIL}')) AS v FROM documents)
UNION SELECT doc_id, 'PAYMENT_CARD_NUMBER', d FROM ({NUMBERS_SQL}) WHERE valid), s AS (SELECT doc_id, least(50, CAST(round_even(round_even(sum(CASE t WHEN 'EMAIL' THEN 18 ELSE 25 END) * 0.6, 9), 0) AS INTEGER)) AS score FROM m GROUP BY doc_id)
SELECT source, CAST(count(*) AS BIGINT) AS docs, CAST(count(score) AS BIGINT) AS exposed, CAST(coalesce(max(score), 0) AS BIGINT) AS worst, CAST(coalesce(sum(score), 0) AS BIGINT) AS total FROM documents LEFT JOIN s USING (doc_id) GROUP BY source""")
def risk_by_source(spark, d):
    docs = table(spark, d, "documents")
    s = exposure(docs).select("doc_id", "direct_score")
    return docs.select("doc_id", "source").join(s, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count("direct_score").alias("exposed"), F.coalesce(F.max("direct_score"), F.lit(0)).cast("long").alias("worst"), F.coalesce(F.sum("direct_score"), F.lit(0)).alias("total"))


def exposure(docs: DataFrame) -> DataFrame:
    """Mail addresses and valid card numbers of documents to entities and a score, without a Python stage."""
    m = emails(docs).withColumn("entity_type", F.lit("EMAIL")).unionByName(numbers(docs).filter("valid").drop("valid").withColumn("entity_type", F.lit("PAYMENT_CARD_NUMBER")))
    ents = m.groupBy("doc_id", "entity_type", V.normalize(F.col("entity_type"), F.col("plaintext")).alias("normalized")).agg(F.min("plaintext").alias("plaintext"))
    raw = F.sum(G.weight(F.col("entity_type"))) * 0.6
    out = ents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_entities"), F.least(F.lit(50), F.bround(F.bround(raw, 9), 0).cast("int")).alias("direct_score"), F.min(V.mask(F.col("entity_type"), F.col("plaintext"))).alias("masked_sample"))
    return out.withColumn("band", V.band(F.col("direct_score")))


@query("pii_exposure_by_document", f"""WITH m AS (SELECT doc_id, 'EMAIL' AS t, lower(v) AS v FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{B.EMAIL}')) AS v FROM documents)
UNION SELECT doc_id, 'PAYMENT_CARD_NUMBER', d FROM ({NUMBERS_SQL}) WHERE valid), s AS (SELECT doc_id, count(*) AS n, least(50, CAST(round_even(round_even(sum(CASE t WHEN 'EMAIL' THEN 18 ELSE 25 END) * 0.6, 9), 0) AS INTEGER)) AS score, min({B.d_mask("t", "v")}) AS masked FROM m GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_entities, CAST(score AS BIGINT) AS direct_score, masked AS masked_sample, {B.d_band("score")} AS band FROM s""")
def pii_exposure_by_document(spark, d):
    return exposure(table(spark, d, "documents")).select("doc_id", "n_entities", F.col("direct_score").cast("long").alias("direct_score"), "masked_sample", "band")


_REQ = """SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN 'Synthetic data' WHEN 1 THEN 'Republic archive' WHEN 2 THEN 'Cohort study' WHEN 3 THEN 'record linkage' WHEN 4 THEN 'Audit' WHEN 5 THEN 'share' ELSE '' END AS purpose,
CASE c_custkey % 3 WHEN 0 THEN 'ward team' WHEN 1 THEN 'Vendor' ELSE 'office' END AS recipient, CASE c_custkey % 3 WHEN 0 THEN 'PUBLIC_RELEASE' WHEN 1 THEN 'RESEARCH_PARTNER' ELSE 'INTERNAL_OPERATIONS' END AS audience,
CASE WHEN c_custkey % 2 = 0 THEN 'DATASET' ELSE 'TEXT' END AS file_type, cast(c_custkey % 101 as int) AS risk_before, c_custkey % 5 = 0 AS risky FROM {customer}"""


def _recommend_sql() -> str:
    term = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(x, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in G.TERMS) + " ELSE 'none' END"
    level = "greatest(CASE audience WHEN 'PUBLIC_RELEASE' THEN 4 WHEN 'RESEARCH_PARTNER' THEN 3 ELSE 1 END, CASE term WHEN 'synthetic' THEN CASE WHEN file_type = 'DATASET' THEN 5 ELSE 4 END WHEN 'public' THEN 4 WHEN 'analytics' THEN 3 WHEN 'linkage' THEN 2 ELSE 1 END, CASE WHEN risky THEN CASE WHEN audience = 'INTERNAL_OPERATIONS' THEN 2 ELSE 4 END ELSE 1 END)"
    return f"""SELECT id, CAST(CASE WHEN risk_before >= 75 AND l < 4 AND audience <> 'INTERNAL_OPERATIONS' THEN 4 ELSE l END AS BIGINT) AS recommended_level,
CAST(CASE WHEN term = 'synthetic' AND file_type = 'DATASET' THEN 5 ELSE CASE audience WHEN 'PUBLIC_RELEASE' THEN 4 WHEN 'RESEARCH_PARTNER' THEN 2 ELSE 1 END END AS BIGINT) AS minimum_level, file_type = 'DATASET' AS l5_supported
FROM (SELECT *, {level} AS l FROM (SELECT *, {term} AS term FROM (SELECT *, lower(trim(purpose || ' ' || recipient)) AS x FROM ({duck(_REQ)}))))"""


@query("recommendation_matrix", _recommend_sql())
def recommendation_matrix(spark, d):
    requests = fixture(spark, d, _REQ).withColumn("entity_types", F.when(F.col("risky"), F.array(F.lit("PAN_LIKE"), F.lit("AGE"))).otherwise(F.array(F.lit("AGE"))))
    return G.recommend(requests).select("id", F.col("recommended_level").cast("long").alias("recommended_level"), F.col("minimum_level").cast("long").alias("minimum_level"), "l5_supported")


@query("policy_rules", f"SELECT e.doc_id, CAST(p.level AS BIGINT) AS level, p.audience, e.entity_type, p.action FROM (SELECT DISTINCT doc_id, entity_type FROM ({duck(B.MENTIONS)})) e JOIN {B.policy_values()} ON e.entity_type = p.entity_type")
def policy_rules(spark, d):
    return G.descriptor(mentions_(spark, d)).select("doc_id", F.col("level").cast("long").alias("level"), "audience", F.explode("rules").alias("r")).select("doc_id", "level", "audience", "r.entity_type", "r.action")


# --- the full detector ------------------------------------------------------------------------------------


@query("detect_mentions")
def detect_mentions(spark, d):
    """All detector families and fusion over the corpus; not expressible in SQL."""
    return detect.mentions(table(spark, d, "documents").select("doc_id", "text"))
