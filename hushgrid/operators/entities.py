"""Mentions to entities: identity, placeholders, review, and the joins between the two."""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import taxonomy as T
from ..functions import values as V


def fingerprint(key: bytes, entity_type: Column, normalized: Column) -> Column:
    """HMAC-SHA256 of the compatibility-composed, case-folded, collapsed ``TYPE:value`` (hex)."""

    @F.arrow_udf("string")
    def run(types: pa.Array, texts: pa.Array) -> pa.Array:
        made = []
        for t, v in zip(types.to_pylist(), texts.to_pylist()):
            text = unicodedata.normalize("NFKC", f"{t}:{v or ''}").strip().casefold()
            made.append(hmac.new(key, re.sub(r"\s+", " ", text).encode(), hashlib.sha256).hexdigest())
        return pa.array(made)

    return run(entity_type, normalized)


def canonical(mentions: DataFrame, key: bytes | None = None) -> DataFrame:
    """One row for each identity of a document, with its count, first place, ordinal and placeholder.

    mentions: doc_id, entity_type, plaintext, char_start. Ordinals count a type's entities by first place. Without a
    key, the fingerprint is a plain SHA-256, for comparison with SQL.
    """
    norm = mentions.withColumn("normalized", V.normalize(F.col("entity_type"), F.col("plaintext")))
    grouped = norm.groupBy("doc_id", "entity_type", "normalized").agg(F.count(F.lit(1)).alias("mention_count"), F.min("char_start").cast("long").alias("first_pos"), F.min_by("plaintext", "char_start").alias("plaintext"))
    by = Window.partitionBy("doc_id", "entity_type").orderBy("first_pos", "normalized")
    out = grouped.withColumn("ordinal", F.row_number().over(by))
    mark = fingerprint(key, F.col("entity_type"), F.col("normalized")) if key else F.sha2(F.concat_ws(":", "entity_type", "normalized"), 256)
    out = out.withColumn("fingerprint", mark).withColumn("placeholder", F.concat("entity_type", F.lit("_"), F.format_string("%03d", F.col("ordinal"))))
    return out.withColumn("entity_id", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "fingerprint"), 256))


def alias_ordinals(entities: DataFrame) -> DataFrame:
    """0-based place of each entity among its type, placeholders sorted as text."""
    return entities.withColumn("alias", F.row_number().over(Window.partitionBy("doc_id", "entity_type").orderBy("placeholder")) - 1)


def with_entities(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Mentions joined with the entity that they are of."""
    norm = mentions.withColumn("normalized", V.normalize(F.col("entity_type"), F.col("plaintext")))
    return norm.join(entities.select("doc_id", "entity_type", "normalized", "entity_id", "placeholder"), ["doc_id", "entity_type", "normalized"])


def mention_counts(entities: DataFrame, linked: DataFrame) -> DataFrame:
    """All entities with the number of their mentions, 0 included."""
    return entities.select("doc_id", "entity_id", "placeholder").join(linked.select("entity_id", F.lit(1).alias("_one")), "entity_id", "left").groupBy("doc_id", "entity_id", "placeholder").agg(F.count("_one").alias("n"))


def family(entity_type: Column) -> Column:
    return F.when(entity_type.isin(*T.DIRECT), "DIRECT").when(entity_type.isin(*T.QUASI), "QUASI").otherwise("VISUAL")


def category_counts(mentions: DataFrame) -> DataFrame:
    """Direct, quasi, visual and pending mentions of each document."""
    kind = family(F.col("entity_type"))
    return mentions.groupBy("doc_id").agg(F.count_if(kind == "DIRECT").alias("direct"), F.count_if(kind == "QUASI").alias("quasi"), F.count_if(kind == "VISUAL").alias("visual"), F.count_if(F.col("review_status") == "PENDING").alias("pending"))


def review(mentions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Mentions with the decisions of a reviewer (keyed by doc_id, char_start, char_end, entity_type) in place of their state."""
    key = ["doc_id", "char_start", "char_end", "entity_type"]
    made = mentions.join(decisions.select(*key, F.col("decision")), key, "left")
    return made.withColumn("review_status", F.coalesce("decision", "review_status")).drop("decision")


def review_state(mentions: DataFrame, key: list[str]) -> DataFrame:
    """State of each entity: pending before all ignored before protected before automatic."""
    s = F.col("review_status")
    state = F.when(F.bool_or(s == "PENDING"), "pending").when(F.bool_and(s == "IGNORE"), "ignored").when(F.bool_or(s == "PROTECT"), "reviewed-protect").otherwise("automatic")
    return mentions.groupBy(*key).agg(state.alias("review_state"))


def collapse_pending(mentions: DataFrame, order: list[str]) -> DataFrame:
    """Of equal pending names of a document only the first stays pending."""
    norm = V.normalize(F.col("entity_type"), F.col("plaintext"))
    held = (F.col("review_status") == "PENDING") & (F.col("entity_type") == "PERSON_NAME")
    n = F.row_number().over(Window.partitionBy("doc_id", "entity_type", norm, held).orderBy(*order))
    return mentions.withColumn("review_status", F.when(held & (n > 1), "NOT_REQUIRED").otherwise(F.col("review_status")))


def best_spans(spans: DataFrame) -> DataFrame:
    """Of equal spans of a type the most confident."""
    by = Window.partitionBy("doc_id", "entity_type", "char_start", "char_end").orderBy(F.desc("confidence"), "plaintext")
    return spans.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def decoded_visuals(mentions: DataFrame) -> DataFrame:
    """Mentions without QR codes of which only the outline was found."""
    return mentions.filter(~((F.col("entity_type") == "QR_CODE") & (F.coalesce(F.trim("plaintext"), F.lit("")) == "")))


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str, keep_first: bool = False) -> DataFrame:
    """Union by key: the row with the greatest ``order``, or with ``keep_first`` the least."""
    both = old.unionByName(new)
    by = Window.partitionBy(*key).orderBy(F.col(order).asc() if keep_first else F.col(order).desc())
    return both.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def cascade(parents: DataFrame, gone: DataFrame, children: dict[str, tuple[DataFrame, str]], key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Children left when ``gone`` parents go, and how many rows of each table went."""
    left, counts = {"parents": parents.join(gone, key, "left_anti")}, None
    for name, (df, fk) in {"parents": (parents, key), **children}.items():
        hit = gone.select(F.col(key).alias(fk))
        left[name] = df.join(hit, fk, "left_anti")
        n = df.join(hit, fk, "left_semi").agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(name).alias("name"), "deleted")
        counts = n if counts is None else counts.unionByName(n)
    return left, counts
