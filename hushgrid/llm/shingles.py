"""Near-duplicates by exact Jaccard similarity of word 5-shingles.

Every set's shingles are put in one order for all, those that are frequent in a sample last. Two sets of Jaccard
similarity s or more have a shingle in common among the first |x| - ceil(s |x|) + 1 of each (prefix filter), and
at the first such one enough shingles are left to reach s (position filter). Sets that meet there are candidates.
What two sets share below the last shingle of the lesser prefix they share within their prefixes, so the prefixes
alone bound the overlap; candidates that the bound leaves are verified on the whole sets, made again from the texts.
The sample decides about cost only, never about results.

Groups are what links join, so candidates come in rounds: neighbours at each shingle first, then, where a shingle has
many sets, neighbours of other groups in wider and wider windows, and at last all the others that are not in one group
by then. Each shingle and round has an order of its own, so a set meets others at each. A large group of near copies
thus costs about its size. The first round also takes what fingerprints of the texts bring together, if they are given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .groups import components, join_split, least_of_groups

WORDS = 5
SIMILARITY = Fraction(4, 5)
#: Share of the documents in the sample for the order, and how many at least; and the most shingles of which a task gets the sample's counts.
SHARE, SAMPLE, FREQUENT = 0.1, 5_000, 200_000
#: Neighbours of a set at a shingle that are candidates in the first round; and in the rounds after it, at shingles of more than ``MANY`` sets.
NEAR, WIDER, MANY = 2, (8, 64), 64
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """Ascending distinct hashes of the lower-cased text's word 5-shingles; of fewer words the whole sequence, of none nothing."""
    words = (text or "").lower().split()
    n = min(WORDS, len(words))
    if not n:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    one = np.fromiter((digest(w.encode("utf-8", "surrogatepass")) for w in words), dtype=np.uint64, count=len(words))
    out = one[: len(one) - n + 1] + np.uint64(n)
    for k in range(1, n):
        out = out * _MIX + one[k : len(one) - n + 1 + k]
    return np.unique(out)


def prefix(own: np.ndarray, frequent: np.ndarray, counts: np.ndarray, least: Fraction) -> tuple[np.ndarray, int]:
    """The shingles of a set at which it meets all sets of similarity ``least`` or more, in order, and the sample's count of the last."""
    n = len(own)
    if not n:
        return own, 0
    count = np.zeros(n, dtype=np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
        count = np.where(frequent[at] == own, counts[at], 0)
    reach = n - -(-n * least.numerator // least.denominator) + 1
    first = np.lexsort((own, count))[:reach]
    return own[first], int(count[first[-1]])


def frequent_shingles(docs: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of more than one document of a sample, ascending, and in how many."""
    rate = min(1.0, max(SHARE if sample else 0.0, sample / max(1, docs.count())))
    chosen = docs.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(rate * 1_000_000)).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in common.parts(whole, whole.column(0))):
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t).view(np.int64))], names=["token"])

    seen = chosen.distinct().mapInArrow(run, "token bigint").groupBy("token").count().filter("count > 1")
    got = seen.orderBy(F.desc("count"), "token").limit(FREQUENT).toPandas()
    token = got["token"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], got["count"].to_numpy(dtype=np.int64)[order]


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches, cut so that rows of one token (the first column) stay together."""
    left: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        change = np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1
        begins = not left or left[-1][0][-1] != cols[0][0]
        if not begins and not len(change):
            left.append(cols)
            continue
        cut = int(change[-1]) if len(change) else 0
        whole = [*left, [c[:cut] for c in cols]] if cut else left
        if whole:
            yield [np.concatenate(c) for c in zip(*whole)]
        left = [[c[cut:] for c in cols]]
    if left:
        yield [np.concatenate(c) for c in zip(*left)]


def enough(size_a: np.ndarray, size_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, least: Fraction) -> np.ndarray:
    """Whether sets that first meet at these places can reach ``least``."""
    most = 1 + np.minimum(size_a - at_a, size_b - at_b) - 1
    return most * (least.numerator + least.denominator) >= least.numerator * (size_a + size_b)


def meet(least: Fraction, near: int):
    """First round over (token, size, fp, at) by token: pairs of ``near`` neighbours (token null), and the members of longer runs.

    ``other`` of a member is how many sets its run has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, size, fp, at in runs(batches):
            size, at = size.astype(np.int64), at.astype(np.int64)
            i = np.arange(len(token))
            a, b = [], []
            for k in range(1, near + 1):
                i = i[i + k < len(token)]
                i = i[token[i] == token[i + k]]
                ok = i[enough(size[i], size[i + k], at[i], at[i + k], least)]
                a.append(fp[ok])
                b.append(fp[ok + k])
            i = i[i + near + 1 < len(token)]
            i = i[token[i] == token[i + near + 1]]  # runs of more than near + 1
            more = np.flatnonzero(np.isin(token, np.unique(token[i])))
            _, run_of, length = np.unique(token[more], return_inverse=True, return_counts=True)
            pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
            n, m = len(pairs), len(more)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.zeros(n, dtype=np.int64), token[more]]), mask=np.arange(n + m) < n),
                    pa.array(np.concatenate([np.zeros(n, dtype=np.int64), size[more]])),
                    pa.array(np.concatenate([pairs[:, 0], fp[more]])),
                    pa.array(np.concatenate([np.zeros(n, dtype=np.int64), at[more]])),
                    pa.array(np.concatenate([pairs[:, 1], length[run_of]])),
                ],
                names=["token", "size", "fp", "at", "other"],
            )

    return run


def beside(least: Fraction, near: int):
    """A round between over (token, size, fp, at, root) by token: pairs of ``near`` neighbours of different roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, size, fp, at, root in runs(batches):
            for k in range(1, min(near, len(token) - 1) + 1):
                i = np.flatnonzero((token[:-k] == token[k:]) & (root[:-k] != root[k:]))
                i = i[enough(size[i], size[i + k], at[i], at[i + k], least)]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[i + k])], names=["a", "b"])

    return run


def meet_again(least: Fraction):
    """Last round over (token, size, fp, at, root) by token and size: all pairs of different roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, *cols in runs(batches):
            cut = np.flatnonzero(token[1:] != token[:-1]) + 1
            for x, y in zip([0, *cut.tolist()], [*cut.tolist(), len(token)]):
                size, fp, at, root = (c[x:y] for c in cols)
                if (root == root[0]).all():
                    continue
                for k in range(y - x - 1):
                    # sizes ascend, so those in reach are the next ones
                    stop = int(np.searchsorted(size, size[k] * least.denominator // least.numerator, "right"))
                    ok = np.flatnonzero((root[k + 1 : stop] != root[k]) & enough(size[k], size[k + 1 : stop], at[k], at[k + 1 : stop], least)) + k + 1
                    if len(ok):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ok), fp[k])), pa.array(fp[ok])], names=["a", "b"])

    return run


def may_reach(x: str, y: str, least: Fraction) -> Column:
    """Whether two sets (structs size, last, prefix) can have an overlap that reaches ``least``, from their prefixes alone."""
    get = lambda side, name: F.col(f"{side}.{name}")
    in_order = lambda side: F.struct(get(side, "last"), F.element_at(get(side, "prefix"), -1).bitwiseXOR(F.lit(-(1 << 63))))  # noqa: E731  shingles as unsigned numbers
    shared = F.size(F.array_intersect(get(x, "prefix"), get(y, "prefix")))
    # behind its prefix the set that ends first has that many more; the other has no more than all but the shared ones
    beyond = lambda a, b: F.least(get(a, "size") - F.size(get(a, "prefix")), get(b, "size") - shared)
    most = shared + F.when(in_order(x) <= in_order(y), beyond(x, y)).otherwise(beyond(y, x))
    return most * (least.numerator + least.denominator) >= least.numerator * (get(x, "size") + get(y, "size"))


def verified(docs: DataFrame, stands: DataFrame, pairs: DataFrame, least: Fraction) -> DataFrame:
    """(a, b): the pairs of sets whose whole shingles reach ``least``. ``stands``: a row for each set with its prefix."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # merged at every size: the sets to compare grow with the corpus
    own = lambda key, name: stands.select(F.col("fp").alias(key), F.struct("size", "last", "prefix").alias(name)).hint("merge")
    left = pairs.join(own("a", "x"), "a").join(own("b", "y"), "b").filter(may_reach("x", "y", least))
    pairs = common.stored(left.select("a", "b"), "shingle-pairs")
    wanted = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    places = stands.join(wanted.hint("merge"), "fp").select("fp", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    texts = docs.withColumn("_h", F.xxhash64("text")).join(places.hint("merge"), (F.col("_h") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for all_ in batches for part in common.parts(all_, all_.column(1))):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t).view(np.int64) for t in b.column(1).to_pylist()], type=pa.list_(pa.int64()))], names=["fp", "own"])

    # rows of one id and text stand for the same set: one text of each
    once = texts.groupBy("fp").agg(F.first("text").alias("text"))
    sets = common.stored(once.mapInArrow(whole, "fp bigint, own array<bigint>"), "shingle-sets")
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("own").alias("x")).hint("merge"), "a").join(sets.select(F.col("fp").alias("b"), F.col("own").alias("y")).hint("merge"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(shared * (least.numerator + least.denominator) >= least.numerator * (F.size("x") + F.size("y"))).select("a", "b")


def dealt(k: int) -> list[Column]:
    """An order of a shingle's sets for round ``k``: those of like size lie together, in an order that no other shingle or round has."""
    return [F.floor(F.log2("size") * 3 + 0.5 * k), F.xxhash64("fp", "token", F.lit(k)), F.col("fp")]


def alike(stands: DataFrame, close: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b): sets of one fingerprint (column print), and of fingerprints (column fp) that ``close`` links; each by the least set that has it."""
    prints = common.stored(stands.groupBy("print").agg(F.min("fp").alias("rep")), "shingle-prints")
    own = lambda key, name: prints.select(F.col("print").alias(key), F.col("rep").alias(name))
    same = join_split(stands.select("fp", "print"), prints, "print", "fp").filter("fp <> rep").select(F.col("fp").alias("a"), F.col("rep").alias("b"))
    links = common.stored(close(prints.select(F.col("print").alias("fp"))), "print-links")
    other = join_split(join_split(links, own("a", "x"), "a", "b"), own("b", "y"), "b", "a").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return same.union(other)


def near_duplicates(docs: DataFrame, similarity: Fraction = SIMILARITY, sample: int = SAMPLE, near: int = NEAR, wider: tuple[int, ...] = WIDER, many: int = MANY, sketch: Callable[[str], int] | None = None, close: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, component_id (least doc_id reachable by links of ``similarity`` or more) for each row of docs (doc_id, text).

    Texts without a word are copies of one another. Rows with equal ids are all returned; a null id is the least of
    none but a group of null ids alone, where component_id is null. An empty table gives no rows.
    ``sketch`` gives a text's 64-bit fingerprint and ``close`` links those that are near (a, b): candidates of the first
    round, verified like any other, so they never decide about results.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    frequent, counts = frequent_shingles(docs, sample)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in common.parts(whole, whole.column(2))):
            texts = b.column(2).to_pylist()
            own = [shingles(t) for t in texts]
            fp = [xxhash.xxh64_intdigest(s.tobytes()) for s in own]
            first = [prefix(s, frequent, counts, similarity) for s in own]
            begin = pa.array([p.view(np.int64) for p, _ in first], type=pa.list_(pa.int64()))
            last = pa.array([n for _, n in first], type=pa.int64())
            prints = pa.array(np.array([sketch(t) if sketch else 0 for t in texts], dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(fp, dtype=np.uint64).view(np.int64)), prints, pa.array(list(map(len, own)), type=pa.int64()), last, begin], names=["doc_id", "text_hash", "fp", "print", "size", "last", "prefix"])

    made = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(sets, "doc_id bigint, text_hash bigint, fp bigint, print bigint, size bigint, last bigint, prefix array<bigint>")
    rows = common.stored(made, "shingle-prefixes")
    # copies hang on the row that stands for their set; rows of one set have one prefix, and any print of them will do
    one = [F.first(c).alias(c) for c in ("size", "last", "prefix")]
    stands = common.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "text_hash")).alias("row"), F.min("print").alias("print"), *one).select("fp", "first", "row.*", "print", "size", "last", "prefix"), "standing-prefixes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = stands.select("size", "fp", F.posexplode("prefix").alias("at", "token")).select("token", "size", "fp", "at")
    meetings = common.stored(places.repartition(parts, "token").sortWithinPartitions("token", *dealt(0)).mapInArrow(meet(similarity, near), "token bigint, size bigint, fp bigint, at bigint, other bigint"), "shingle-meetings")
    pairs = meetings.filter("token is null and fp <> other").select(F.col("fp").alias("a"), F.col("other").alias("b"))
    links = verified(docs, stands, pairs.union(alike(stands, close)) if close else pairs, similarity)
    reached = components(spark, links)
    members = meetings.filter("token is not null").select("token", "size", "fp", "at", F.col("other").alias("sets"))

    def rooted(some: DataFrame) -> DataFrame:
        return some.join(reached.hint("merge"), some.fp == reached.node, "left").select("token", "size", "fp", "at", F.coalesce("root", "fp").alias("root"))

    for k, window in enumerate(wider, 1):
        pairs = rooted(members.filter(F.col("sets") > many)).repartition(parts, "token").sortWithinPartitions("token", *dealt(k)).mapInArrow(beside(similarity, window), "a bigint, b bigint")
        pairs = common.stored(pairs.distinct(), "shingle-windows")
        if not pairs.limit(1).count():
            break
        links = verified(docs, stands, pairs, similarity)
        reached = components(spark, reached.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))
    again = rooted(members).repartition(parts, "token").sortWithinPartitions("token", "size", "fp").mapInArrow(meet_again(similarity), "a bigint, b bigint")
    # groups of the rounds before stand as they are, so their links to the root are enough
    more = verified(docs, stands, again.filter("a <> b"), similarity)
    reached = components(spark, reached.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    return rows.select("doc_id", "fp").join(least_of_groups(stands.select("fp", "first"), reached).hint("merge"), "fp").select("doc_id", "component_id")
