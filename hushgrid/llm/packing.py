"""Packing into length buckets whose boundaries minimise padding over the whole corpus.

The global histogram of lengths goes to a dynamic programme that picks at most ``n_buckets`` boundaries;
inside each bucket, documents form batches of a padded token budget.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, token_orc

#: Documents a numbering group holds, about.
GROUP_ROWS = 5_000


def boundaries(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """Boundaries (each one of ``lengths``) with the least total padding; ``lengths`` ascending and distinct.

    best[j] after k rounds is the least padding of the first j lengths in k buckets. The least last boundary of j
    never falls as j grows, so each round goes by halves: the middle j of each stretch, all stretches at once, over
    the boundaries between those of its neighbours. Among equal paddings the earlier split is taken.
    """
    n = len(lengths)
    if not n:
        return []
    mass = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    total = np.concatenate([[0], np.cumsum(counts * lengths, dtype=np.int64)])
    best = np.concatenate([[0], lengths * mass[1:] - total[1:]]).astype(np.int64)
    cuts = [np.zeros(n + 1, dtype=np.int32)]
    for _ in range(min(n_buckets, n) - 1):
        new, cut = best.copy(), np.zeros(n + 1, dtype=np.int32)
        left, right, low, high = (np.array([x]) for x in (1, n, 0, n - 1))
        while len(left):
            j = (left + right) // 2
            size = np.minimum(high, j - 1) - low + 1
            begin = np.concatenate([[0], np.cumsum(size)[:-1]])
            at = np.repeat(low - begin, size) + np.arange(size.sum())
            cost = best[at] + np.repeat(lengths[j - 1], size) * (np.repeat(mass[j], size) - mass[at]) - (np.repeat(total[j], size) - total[at])
            new[j] = np.minimum.reduceat(cost, begin)
            least = np.flatnonzero(cost == np.repeat(new[j], size))
            cut[j] = at[least[np.searchsorted(least, begin)]]
            left, right, low, high = (np.concatenate(x) for x in ((left, j + 1), (j - 1, right), (low, cut[j]), (cut[j], high)))
            some = left <= right
            left, right, low, high = left[some], right[some], low[some], high[some]
        best = new
        cuts.append(cut)
    out, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(cut[j])
    return out[::-1]


def histogram(lengths: DataFrame, col: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct lengths, ascending, and their counts, over all rows.

    All of them go to the driver: d distinct lengths need documents of d * d / 2 tokens together, so 10 ** 12 tokens
    have 1.5 million at most.
    """
    rows = lengths.groupBy(F.col(col).cast("long").alias("length")).count().toPandas().sort_values("length")
    return rows["length"].to_numpy(dtype=np.int64), rows["count"].to_numpy(dtype=np.int64)


def pack(docs: DataFrame, length_col: str = "n_tokens", id_col: str = "doc_id", budget: int = 65_536, n_buckets: int = 16) -> DataFrame:
    """doc_id, n_tokens, bucket, boundary, batch, slot for each row of ``docs``.

    ``boundary`` is the padded length of the bucket; a batch holds budget // boundary rows (one at least).
    Rows are numbered inside (bucket, group of ids) and shifted by the sizes of the groups before, so no task
    holds a bucket. A null length counts as 0. Equal ids are all placed. An empty table gives no rows.
    ``docs`` is read several times: pass a stored table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(length_col), F.lit(0)).cast("long").alias("n_tokens"))
    lengths, counts = histogram(rows, "n_tokens")
    edges = boundaries(lengths, counts, n_buckets)
    n_rows = int(counts.sum()) if len(counts) else 0
    groups = max(1, -(-n_rows // GROUP_ROWS))
    bucket = F.lit(len(edges) - 1)
    for k in range(len(edges) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= edges[k], F.lit(k)).otherwise(bucket)
    boundary = F.element_at(F.array(*map(F.lit, edges or [0])), F.col("bucket") + 1).cast("long")
    rows = rows.withColumn("bucket", bucket.cast("int")).withColumn("part", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(groups)).cast("int"))
    sizes = rows.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("size"))  # buckets x groups rows
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("bucket", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("bucket", "part").orderBy("n_tokens", "doc_id")
    rows = rows.withColumn("own", F.row_number().over(own) - 1).join(sizes, ["bucket", "part"])
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("boundary"), F.lit(1)))).cast("long")
    rows = rows.withColumn("boundary", boundary).withColumn("rank", F.col("base") + F.col("own")).withColumn("per", per)
    return rows.select("doc_id", "n_tokens", "bucket", "boundary", F.floor(F.col("rank") / F.col("per")).cast("long").alias("batch"), F.pmod("rank", "per").cast("long").alias("slot"))


def pack_texts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", **options) -> DataFrame:
    """Count the tokens of ``docs`` (doc_id, text), store the counts in the shared folder, and pack by them."""
    spark = docs.sparkSession
    kept = common.scratch(spark, "lengths")
    docs.select("doc_id", token_orc.token_lengths(F.col("text"), vocabulary).alias("n_tokens")).write.parquet(kept)
    return pack(spark.read.parquet(kept), **options)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack_texts(common.table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing plan of the documents that the stages before have kept."""
    return pack_texts(docs)
