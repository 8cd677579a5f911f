"""Exposure graph, risk score, policy and recommendation over entity tables of any number of documents.

entities: doc_id, entity_id, entity_type, placeholder, first_pos, context (labels of its mentions, joined),
mention_count, review_state. Only active entities belong in it (not all of their mentions ignored).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import taxonomy as T
from ..functions import values as V


def policy(spark: SparkSession) -> DataFrame:
    return F.broadcast(T.policy_table(spark))  # 390 rows


def with_actions(entities: DataFrame, level: int | None = None, audience: str | None = None) -> DataFrame:
    """Entities with action, residual and loss; for all levels and audiences where none is named."""
    p = T.policy_table(entities.sparkSession)
    if level is not None:
        p = p.filter(F.col("level") == level)
    if audience is not None:
        p = p.filter(F.col("audience") == audience)
    return entities.join(F.broadcast(p.drop("family", "weight")), "entity_type")


def weight(entity_type: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in T.WEIGHTS.items() for x in kv]), entity_type)


def primary(entities: DataFrame) -> DataFrame:
    """Entities with is_related: names but the first that is not another's relation; no name is the subject of a table."""
    person = F.col("entity_type") == "PERSON_NAME"
    told = person & V.is_related(F.col("context"))
    n = F.row_number().over(Window.partitionBy("doc_id", person, told).orderBy("first_pos", "entity_id"))
    return entities.withColumn("is_related", person & (told | (n > 1)))


def risk(entities: DataFrame) -> DataFrame:
    """Score before and after, by document, level and audience, with its four components and the utility.

    One aggregation on (doc_id, level, audience); sums and flags combine before the shuffle.
    """
    acted = with_actions(entities).withColumn("weight", weight(F.col("entity_type")))
    kind = F.when(F.col("entity_type").isin(*T.QUASI), "QUASI").otherwise("DIRECT")  # visual ones weigh with the direct
    related = (F.col("entity_type") == "PERSON_NAME") & V.is_related(F.col("context"))
    sums = [F.sum(F.when(kind == k, F.col("weight") * f).otherwise(0.0)).alias(f"{k.lower()}_{name}") for k in ("DIRECT", "QUASI") for name, f in (("before", F.lit(1.0)), ("after", F.col("residual")))]
    has = [F.bool_or(F.col("entity_type") == t).alias(f"has_{t}") for t in sorted({t for combo, _ in T.COMBINATIONS for t in combo})]
    out = acted.groupBy("doc_id", "level", "audience").agg(*sums, *has, F.count_if(related).alias("related"), F.sum("loss").alias("loss"), F.count(F.lit(1)).alias("n_entities"))
    table = {(t, level, audience): T.action(t, level, audience) for t in T.ENTITY_TYPES for level in T.LEVELS for audience in T.AUDIENCES}

    def at(level: int, audience: str) -> Column:
        return (F.col("level") == level) & (F.col("audience") == audience)

    def by_policy(value) -> Column:
        """A number that depends on level and audience alone."""
        return reduce(lambda acc, la: F.when(at(*la), F.lit(float(value(*la)))).otherwise(acc), [(level, a) for level in T.LEVELS for a in T.AUDIENCES], F.lit(1.0))

    relation = by_policy(lambda level, a: T.RELATION_FACTOR.get(table["PERSON_NAME", level, a], 1.0))
    combo_before, combo_after = F.lit(0.0), F.lit(0.0)
    for types, score in T.COMBINATIONS:
        present = reduce(lambda x, y: x & y, [F.col(f"has_{t}") for t in types])
        factor = by_policy(lambda level, a, types=types: max(T.RESIDUAL[table[t, level, a]] for t in types))
        combo_before = combo_before + F.when(present, float(score)).otherwise(0.0)
        combo_after = combo_after + F.when(present, factor * score).otherwise(0.0)

    def part(x: Column, scale: float, cap: int) -> Column:
        return F.least(F.lit(cap), F.bround(F.bround(x * scale, 9), 0).cast("int"))

    parts = {}
    for when, rel, combo in (("before", F.lit(1.0), combo_before), ("after", relation, combo_after)):
        parts |= {f"direct_{when}_part": part(F.col(f"direct_{when}"), 0.60, 50), f"quasi_{when}_part": part(F.col(f"quasi_{when}"), 0.55, 34), f"relation_{when}_part": part(F.col("related") * 14 * rel, 1.0, 14), f"combo_{when}_part": part(combo, 0.70, 28)}
    out = out.withColumns(parts)
    total = {when: F.least(F.lit(100), sum((F.col(f"{k}_{when}_part") for k in ("quasi", "relation", "combo")), F.col(f"direct_{when}_part"))) for when in ("before", "after")}
    out = out.select("doc_id", "level", "audience", "n_entities", *parts, total["before"].alias("before"), total["after"].alias("after"), F.greatest(F.lit(45), 100 - F.least(F.lit(55), F.col("loss"))).cast("int").alias("utility"))
    return out.withColumns({"reduction": F.greatest(F.lit(0), F.col("before") - F.col("after")), "band_before": V.band(F.col("before")), "band_after": V.band(F.col("after"))})


def nodes(entities: DataFrame, dataset: bool = False) -> DataFrame:
    """doc_id, node_id, kind, label, entity_type, mention_count, review_state: the document, its subject, its entities."""
    marked = primary(entities)
    docs = entities.groupBy("doc_id").agg(F.sum("mention_count").alias("mention_count"), F.bool_or(F.col("entity_type") == "PERSON_NAME").alias("any_person"))
    subjects = marked.groupBy("doc_id").agg(F.bool_or((F.col("entity_type") == "PERSON_NAME") & ~F.col("is_related")).alias("named"))
    document = docs.select("doc_id", F.concat(F.lit("document:"), F.col("doc_id").cast("string")).alias("node_id"), F.lit("DOCUMENT").alias("kind"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("entity_type"), "mention_count", F.lit("source").alias("review_state"))
    inferred = subjects.filter(F.lit(dataset) | ~F.col("named")).select("doc_id", F.lit("subject:dataset-records" if dataset else "subject:reconstructable").alias("node_id"), F.lit("SUBJECT").alias("kind"), F.lit("Dataset record population" if dataset else "Reconstructable subject").alias("label"), F.lit(None).cast("string").alias("entity_type"), F.lit(0).cast("long").alias("mention_count"), F.lit("inferred").alias("review_state"))
    e = F.col("entity_type")
    kind = F.when(e == "PERSON_NAME", F.lit("DIRECT_IDENTIFIER") if dataset else F.when(F.col("is_related"), "RELATED_PERSON").otherwise("SUBJECT")).when(e.isin(*T.DIRECT), "DIRECT_IDENTIFIER").when(e.isin(*T.QUASI), "QUASI_IDENTIFIER").otherwise("VISUAL_IDENTIFIER")
    own = marked.select("doc_id", F.concat(F.lit("entity:"), "entity_id").alias("node_id"), kind.alias("kind"), F.col("placeholder").alias("label"), "entity_type", F.col("mention_count").cast("long").alias("mention_count"), "review_state")
    return document.unionByName(inferred).unionByName(own)


def edges(entities: DataFrame, dataset: bool = False) -> DataFrame:
    """doc_id, source, target, edge_type, weight."""
    marked = primary(entities).withColumn("node_id", F.concat(F.lit("entity:"), "entity_id")).withColumn("weight", weight(F.col("entity_type")))
    person = F.col("entity_type") == "PERSON_NAME"
    subject = F.lit("subject:dataset-records") if dataset else F.coalesce(F.max(F.when(person & ~F.col("is_related"), F.col("node_id"))).over(Window.partitionBy("doc_id")), F.lit("subject:reconstructable"))
    marked = marked.withColumn("subject", subject).withColumn("document", F.concat(F.lit("document:"), F.col("doc_id").cast("string")))
    contains = marked.select("doc_id", F.col("document").alias("source"), F.col("subject").alias("target"), F.lit("CONTAINS").alias("edge_type"), F.lit(10).alias("weight")).distinct()
    rest = marked.filter(F.col("node_id") != F.col("subject"))
    holds = rest.select("doc_id", F.col("document").alias("source"), F.col("node_id").alias("target"), F.lit("CONTAINS").alias("edge_type"), F.lit(4).alias("weight"))
    related = F.col("is_related") if not dataset else F.lit(False)
    kind = F.when(related, "RELATED_TO").when(F.col("entity_type").isin(*T.QUASI), "DESCRIBES").otherwise("IDENTIFIES")
    tells = rest.select("doc_id", F.col("subject").alias("source"), F.col("node_id").alias("target"), kind.alias("edge_type"), F.when(related, 14).otherwise(F.least(F.lit(26), "weight")).alias("weight"))
    first = marked.groupBy("doc_id", "entity_type").agg(F.min_by("node_id", "first_pos").alias("node_id"))
    pairs = [(a, b, score, types) for types, score in T.PATH_COMBINATIONS for a, b in zip(types, types[1:])]
    table = entities.sparkSession.createDataFrame([(a, b, s, list(types)) for a, b, s, types in pairs], "a string, b string, weight int, types array<string>")
    have = first.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("entity_type", "node_id"))).alias("at"))  # a map of 26 types at most
    together = have.join(F.broadcast(table), F.size(F.array_except("types", F.map_keys("at"))) == 0)
    co = together.select("doc_id", F.element_at("at", F.col("a")).alias("source"), F.element_at("at", F.col("b")).alias("target"), F.lit("CO_OCCURS_WITH").alias("edge_type"), "weight")
    return contains.unionByName(holds).unionByName(tells).unionByName(co)


def paths(entities: DataFrame, top: int = 8, dataset_records: DataFrame | None = None) -> DataFrame:
    """doc_id, rank, score, reason: the ``top`` paths to the subject by score; equal scores in order of first place.

    With ``dataset_records`` (doc_id, record, entity_type) a combination also has to occur in one record.
    """
    marked = primary(entities).withColumn("weight", weight(F.col("entity_type")))
    rel = marked.filter("is_related").select("doc_id", F.lit(14).alias("score"), F.concat(F.lit("related "), V.relation(F.col("context"))).alias("reason"), F.col("first_pos").alias("place"))
    single = marked.filter((F.col("weight") >= 17) & ~F.col("is_related") & (F.col("entity_type") != "PERSON_NAME")).select("doc_id", F.least(F.lit(26), "weight").alias("score"), F.col("entity_type").alias("reason"), F.col("first_pos").alias("place"))
    table = entities.sparkSession.createDataFrame([(list(t), s, "+".join(t)) for t, s in T.PATH_COMBINATIONS], "types array<string>, score int, reason string")
    have = entities.groupBy("doc_id").agg(F.collect_set("entity_type").alias("have"))
    if dataset_records is not None:
        have = dataset_records.groupBy("doc_id", "record").agg(F.collect_set("entity_type").alias("have"))
    combos = have.join(F.broadcast(table), F.size(F.array_except("types", "have")) == 0).select("doc_id", "score", "reason", F.lit(1 << 40).cast("long").alias("place")).distinct()
    every = rel.unionByName(single).unionByName(combos)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "place", "reason"))
    return every.withColumn("rank", rank).filter(F.col("rank") <= top).drop("place")


def graph_hash(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """SHA-256 of each document's nodes and edges in order, fields by name."""
    n = node_rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.to_json(F.struct("kind", "mention_count", "node_id", "review_state")))).alias("nodes"))
    e = edge_rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.to_json(F.struct("edge_type", "source", "target", "weight")))).alias("edges"))
    return n.join(e, "doc_id", "left").select("doc_id", F.sha2(F.to_json(F.struct("edges", "nodes")), 256).alias("graph_sha256"))


# Terms that tell the purpose; the first family found decides.
TERMS = (
    ("synthetic", ("synthetic", "new dataset", "shareable dataset", "ml training", "model training", "machine learning training", "test dataset", "testing dataset", "training dataset")),
    ("public", ("public", "publish", "publication", "open portal", "external release", "press release", "external", "vendor", "third party", "third-party", "partner", "outside")),
    ("analytics", ("analytics", "analysis", "research", "statistics", "statistical", "cohort", "study")),
    ("linkage", ("anonymous record", "pseudonym", "link records", "record linkage", "same person", "longitudinal")),
    ("internal", ("internal", "operations", "audit", "case handling", "service delivery", "same team")),
)


def recommend(requests: DataFrame) -> DataFrame:
    """recommended and minimum level and reasons, of purpose, recipient, audience, file_type, risk_before, entity_types."""
    text = F.lower(F.trim(F.concat_ws(" ", "purpose", "recipient")))
    term = F.lit("none")
    for name, words in reversed(TERMS):
        term = F.when(V.has_any(text, words), name).otherwise(term)
    a, table = F.col("audience"), F.col("file_type") == "DATASET"
    base = F.when(a == "PUBLIC_RELEASE", 4).when(a == "RESEARCH_PARTNER", 3).otherwise(1)
    least = F.when(a == "PUBLIC_RELEASE", 4).when(a == "RESEARCH_PARTNER", 2).otherwise(1)
    out = requests.withColumn("term", term).withColumn("base", base)
    t = F.col("term")
    floor = F.when(t == "synthetic", F.when(table, 5).otherwise(4)).when(t == "public", 4).when(t == "analytics", 3).when(t == "linkage", 2).otherwise(1)
    risky = F.arrays_overlap("entity_types", F.array(*map(F.lit, T.HIGH_RISK)))
    inside = a == "INTERNAL_OPERATIONS"
    level = F.greatest("base", floor, F.when(risky, F.when(inside, 2).otherwise(4)).otherwise(1))
    raised = (F.col("risk_before") >= 75) & (level < 4) & ~inside
    reasons = F.array_compact(F.array(F.concat(F.lit("audience:"), a), F.when(t != "none", F.concat(F.lit("purpose:"), t)), F.when(risky, "high-risk credential"), F.when(F.col("risk_before") >= 75, F.when(raised, "exposure raised the level").otherwise("exposure is high"))))
    return out.withColumns({"recommended_level": F.when(raised, 4).otherwise(level).cast("int"), "minimum_level": F.when((t == "synthetic") & table, 5).otherwise(least).cast("int"), "reasons": F.array_distinct(reasons), "l5_supported": table}).drop("term", "base")


def below_floor(recommended: DataFrame, level: Column) -> DataFrame:
    """Requests for a level under their minimum; a deployment that enforces floors refuses these."""
    return recommended.filter(level < F.col("minimum_level"))


def descriptor(present: DataFrame) -> DataFrame:
    """The rules of each document for every level and audience: array of (entity_type, action), by type."""
    acted = with_actions(present.select("doc_id", "entity_type").distinct())
    return acted.groupBy("doc_id", "level", "audience").agg(F.array_sort(F.collect_list(F.struct("entity_type", "action"))).alias("rules"))


def same_record_combos(records: DataFrame, group: str, flags: list[str]) -> DataFrame:
    """group, records, linked, linkable: how many records of a data set hold all of ``flags`` (booleans) at once.

    A combination is evidence only if one record has all its parts; two columns that never meet in a row are none.
    """
    every = F.lit(True)
    for flag in flags:
        every = every & F.coalesce(F.col(flag), F.lit(False))
    return records.groupBy(group).agg(F.count(F.lit(1)).alias("records"), F.count_if(every).alias("linked"), F.bool_or(every).alias("linkable"))
