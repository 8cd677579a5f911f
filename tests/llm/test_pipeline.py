"""The pipeline against a plain version of its stages."""

from __future__ import annotations

import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline
from hushgrid.llm import decontaminate as DC
from hushgrid.llm import common, language_id, quality, simhash, token_counts
from hushgrid.llm.common import tokenizer_path
from tests.llm.test_near import plain_components
from tests.llm.test_text_models import sentence


def test_pipeline(spark, tmp_path):
    r = random.Random(3)
    item = "What is the name of the old river near the northern stone market. It is the Wend."
    good = [(k, sentence(lang, k, 60).capitalize() + ".") for k, lang in enumerate(["en", "de", "fr"] * 20)]
    bad = [(500 + k, " ".join(w.upper() + "!!" for w in sentence("en", k, 40).split())) for k in range(30)]
    more = [(300, good[0][1]), (301, good[1][1] + " " + item), (302, None), (303, "12 34"), (304, good[2][1]), (304, good[2][1])]
    texts = good + bad + more
    langs = {k: ["en", "de", "fr"][k % 3] for k, _ in good}
    spark.createDataFrame([(k, t, langs.get(k), f"s{r.randrange(3)}", len(t or "")) for k, t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1) for k, _ in good] + [(k, 0) for k, _ in bad], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = str(tmp_path)
    got = corpus_pipeline.run(spark, d).collect()

    # the same decisions one document at a time
    q = quality.fitted(spark, d)
    lid = language_id.train(language_id.learnable(spark.read.parquet(f"{d}/documents.parquet")))
    left = [(k, t) for k, t in texts if q.score([quality.features(t)])[0] >= 0.5]
    left = [(k, t) for k, t in left if lid.predict(t)[0] != "und" and lid.predict(t)[1] >= 0.5]
    fps = [simhash.fingerprint(t) for _, t in left]
    comp = plain_components(fps, [k for k, _ in left])
    left = sorted({kt for kt, c in zip(left, comp) if kt[0] == c})
    index = DC.Index([(1, item)], 0.5)
    left = [(k, t) for k, t in left if not DC.leaks([index], [t], 0.8)[0]]
    n = token_counts.count_tokens([t for _, t in left], tokenizer_path("byte_bpe_50k.json"))
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((k, m) for (k, _), m in zip(left, n))
    kept = {r.doc_id for r in got}
    assert not kept & {k for k, _ in bad} and 300 not in kept and 301 not in kept and 303 not in kept
    assert {k for k, _ in good[3:]} <= kept | {k for (k, _), c in zip(left, comp) if k != c}


def test_row_groups_between_stages_are_bounded(spark, tmp_path, monkeypatch):
    """A task of the next stage holds a whole row group, so its size must not follow that of the file."""
    hexes = F.concat(*[F.sha2(F.concat_ws("-", "id", F.lit(k)), 512) for k in range(32)])
    spark.range(0, 12_000, 1, 1).select(F.col("id").alias("doc_id"), hexes.alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    same = lambda s, docs, d: docs.coalesce(1)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", same), ("second", same)])
    out = corpus_pipeline.run(spark, str(tmp_path))
    (file,) = out.inputFiles()
    found = pq.ParquetFile(file.removeprefix("file://")).metadata
    sizes = [found.row_group(k).total_byte_size for k in range(found.num_row_groups)]
    assert found.num_rows == 12_000 and sum(sizes) > 2 * common.GROUP_BYTES and max(sizes) < 1.5 * common.GROUP_BYTES
