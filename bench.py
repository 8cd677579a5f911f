"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from hushgrid.plans import catalog

#: Reported one by one; the better of two runs counts.
HEADLINE = ["detect_mentions", "pii_exposure_by_document", "lines_with_offsets", "card_luhn_mentions", "canonical_entities", "exposure_components", "graph_edges", "policy_replacements", "leak_scan", "fragment_ngrams", "char_level_prf", "prf_grouping_sets", "ledger_chain_verify", "events_sessions", "correlation_fidelity"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # small files of heavy rows: as many splits as there are cores
        .config("spark.sql.files.maxPartitionBytes", "2m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries: dict[str, float] = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):
            began = time.time()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.time() - began
            best = took if best is None or took < best else best
        queries[name] = round(best, 3)
    chars = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(length(text)) AS n").first()["n"]
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries, "sf": float(sf[1]) if sf else sf_dir, "cores": int(cpus), "detect_chars_per_s": round(chars / queries["detect_mentions"])}))
    spark.stop()


if __name__ == "__main__":
    main()
