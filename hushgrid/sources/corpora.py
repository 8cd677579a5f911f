"""Annotated corpora as cases (case_id, domain, text) and gold spans (case_id, entity_type, value, char_start, char_end)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import corpus_type


def masked_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cases, gold and unmapped label counts of JSON lines in either layout: privacy_mask objects, or span_labels triples."""
    schema = "source_text string, unmasked_text string, language string, lang string, privacy_mask array<struct<label:string,start:int,end:int,value:string>>, span_labels string, _corrupt_record string"
    raw = spark.read.schema(schema).json(path).filter("_corrupt_record is null")
    raw = raw.withColumn("text", F.coalesce("source_text", "unmasked_text")).withColumn("domain", F.coalesce("language", "lang", F.lit("unknown"))).filter("text is not null")
    raw = raw.withColumn("case_id", F.sha2(F.concat_ws("|", "domain", "text"), 256))
    triples = F.from_json("span_labels", "array<array<string>>")
    old = F.transform(F.coalesce(triples, F.array()), lambda t: F.struct(F.get(t, F.lit(2)).alias("label"), F.get(t, F.lit(0)).cast("int").alias("start"), F.get(t, F.lit(1)).cast("int").alias("end")))
    new = F.transform(F.coalesce("privacy_mask", F.array()), lambda m: F.struct(m.label.alias("label"), m.start.alias("start"), m.end.alias("end")))
    spans = raw.select("case_id", "domain", "text", F.explode(F.concat(new, old)).alias("s")).select("case_id", "domain", "text", "s.*").withColumn("entity_type", corpus_type(F.col("label")))
    gold = spans.filter("entity_type is not null and label <> 'O'").select("case_id", "domain", "entity_type", F.expr("substring(text, start + 1, end - start)").alias("value"), F.col("start").alias("char_start"), F.col("end").alias("char_end"))
    unmapped = spans.filter("entity_type is null and label <> 'O'").groupBy("label").count()
    return raw.select("case_id", "domain", "text").distinct(), gold, unmapped


def task_jsonl(spark: SparkSession, path: str, task: str | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of a task (text, task_name, language, entities), and counts of valid and invalid lines. ``limit`` is by text order."""
    schema = "text string, task_name string, language string, entities array<struct<start:int,end:int,label:string>>, _corrupt_record string"
    raw = spark.read.schema(schema).json(path)
    good = F.col("_corrupt_record").isNull() & F.col("text").isNotNull() & F.col("entities").isNotNull()
    counts = raw.select(good.alias("good")).groupBy("good").count()
    rows = raw.filter(good & (F.col("task_name") == task if task else F.lit(True))).drop("_corrupt_record")
    return (rows.orderBy("text").limit(limit) if limit is not None else rows), counts


def curated(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Cases and gold of a curated file, whose entities are [type, value] or [type, value, n-th occurrence]."""
    raw = spark.read.option("multiLine", True).schema("cases array<struct<id:string,domain:string,text:string,entities:array<array<string>>>>").json(path)
    cases = raw.select(F.explode("cases").alias("c")).select(F.col("c.id").alias("case_id"), "c.domain", "c.text", "c.entities")
    e = cases.select("case_id", "domain", "text", F.explode("entities").alias("e")).select("case_id", "domain", "text", F.get("e", F.lit(0)).alias("entity_type"), F.get("e", F.lit(1)).alias("value"), F.coalesce(F.get("e", F.lit(2)).cast("int"), F.lit(1)).alias("nth"))
    # place of the n-th occurrence: what stands before it, piece by piece
    start = F.expr("length(substring_index(text, value, nth))")
    gold = e.filter(F.expr("size(split(text, concat('\\\\Q', value, '\\\\E'))) > nth")).select("case_id", "domain", "entity_type", "value", start.cast("int").alias("char_start"), (start + F.length("value")).cast("int").alias("char_end"))
    return cases.drop("entities"), gold
