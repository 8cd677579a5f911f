"""Groups that links join: connected components, and the least document of each.

Nodes and links grow with the corpus, so all joins are merged at every size: a small file of them is a large table in the
driver's memory, which a broadcast is built in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Links that a file of a round holds, about, and the fewest files: rounds of few links are not spread over many small files.
FILE_LINKS, FEWEST = 50_000, 6
#: Parts that the rows of one hub or group are split into, wherever they are joined with the one row that it has.
SALTS = 8


def join_split(many: DataFrame, one: DataFrame, key: str, by: str) -> DataFrame:
    """``many`` joined with ``one`` (a row for each ``key``): rows of one key are dealt by ``by`` to ``SALTS`` tasks."""
    many = many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    one = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.join(one.hint("merge"), [key, "_salt"]).drop("_salt")


def components(spark: SparkSession, links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): for each node of ``links`` (a, b), the least node that it reaches; roots themselves are left out.

    Alternates joining every node's larger neighbours to its least one and its smaller neighbours to the
    least; the number of rounds grows with the logarithm of the longest path. Each round is stored in the shared
    folder. A hub's neighbours are split among tasks.
    """
    edges = common.stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    files = max(FEWEST, -(-edges.count() // FILE_LINKS))
    for _ in range(rounds):
        # large star: each node's larger neighbours go to the least of the node and its neighbours
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")).toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = join_split(both.filter("v > u"), least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: each node's smaller neighbours and itself go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = join_split(large, low, "u", "v")
        small = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.toDF("u", "v")).filter("u <> v").distinct()
        edges = common.stored(small.coalesce(files), "edges")
        # at the end every node has one edge, to its root, and no root has one
        if not edges.groupBy("u").count().filter("count > 1").limit(1).count() and not edges.select(F.col("v").alias("u")).join(edges.hint("merge"), "u", "left_semi").limit(1).count():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components not settled after {rounds} rounds")


def least_of_groups(prints: DataFrame, reached: DataFrame) -> DataFrame:
    """(fp, component_id): for each of ``prints`` (fp, first) the least ``first`` of its group; ``reached`` (node, root) tells groups.

    Only those that a link joins are grouped, and the rows of a group are split among tasks.
    """
    members = reached.select(F.col("node").alias("fp"), "root").union(reached.select(F.col("root").alias("fp"), "root").distinct())
    linked = prints.join(members.hint("merge"), "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = join_split(linked, least, "root", "fp").select("fp", "component_id")
    return prints.join(labels.hint("merge"), "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
