"""SimHash near-duplicates by anchor points of a covering code.

A 64-bit fingerprint is cut into two halves. Fingerprints at ``threshold`` or fewer differing bits have at
most t = threshold // 2 of them in one half. The anchors of a half are the code words of the [31,26] Hamming
code over its first 31 bits, a perfect code of covering radius R = 1. Every fingerprint is replicated to
every anchor within R + ceil(t / 2): of two fingerprints at distance t a middle point lies within ceil(t / 2)
of both, and some anchor within R of it. So each close pair meets at an anchor, where it is compared exactly.
Only distinct fingerprints are replicated; copies hang on theirs.

At an anchor, links are found by spreading through the fingerprints not yet reached, so a dense group costs
about its size, and only a spanning forest of the links leaves the task. Anchors above ``TILE`` fingerprints
are cut into tiles, and every pair of tiles is one task: exact, with bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, shingles
from .groups import components, least_of_groups

SEED, WORDS, BITS = 42, 4, 64
#: Fingerprints of one anchor that a task compares at once.
TILE = 4_000


def fingerprint(text: str | None) -> int:
    """SimHash over the XXH64 of the word 4-shingles of the text, A-Z lower-cased; 0 without words."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: ASCII case and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= WORDS:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - WORDS].tolist(), ends[WORDS - 1 :].tolist())]
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 65_536):
        ones += np.unpackbits(np.array(hashes[k : k + 65_536], dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def simhash(text: Column) -> Column:
    """The fingerprint as a signed 64-bit number."""

    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        return common.by_parts(lambda part: pa.array(np.array([fingerprint(t) for t in part.to_pylist()], dtype=np.uint64).view(np.int64)))(texts)

    return run(text)


def hamming_syndromes() -> np.ndarray:
    """Syndrome of every 16-bit part of a 31-bit word, low part first: bit k has syndrome k + 1."""
    low = np.zeros((2, 1 << 16), dtype=np.uint8)
    for k in range(31):
        part, bit = divmod(k, 16)
        at = np.arange(1 << 16)
        low[part] ^= np.where(at >> bit & 1, k + 1, 0).astype(np.uint8)
    return low


def anchors(half: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): all code words of the [31,26] Hamming code within ``radius`` of the 31-bit words.

    The words at distance w from a code word are those whose w flipped bits have the syndrome as their sum, so
    the flips follow from the syndrome: for each set of radius - 1 flips or fewer, the last one is determined.
    """
    table = hamming_syndromes()
    half = half.astype(np.int64) & 0x7FFFFFFF
    syndrome = (table[0][half & 0xFFFF] ^ table[1][half >> 16]).astype(np.int64)
    rows, words = [np.flatnonzero(syndrome == 0)], [half[syndrome == 0]]
    for w in range(1, radius + 1):
        for flips in combinations(range(31), w - 1):  # the last flip is above the others, so each set comes once
            rest = syndrome.copy()
            mask = 0
            for f in flips:
                rest ^= f + 1
                mask |= 1 << f
            last = rest - 1
            ok = np.flatnonzero((rest > 0) & (last > (flips[-1] if flips else -1)))
            rows.append(ok)
            words.append(half[ok] ^ mask ^ (np.int64(1) << last[ok]))
    return np.concatenate(rows), np.concatenate(words)


def replicate(prints: DataFrame, threshold: int) -> DataFrame:
    """(anchor, fp) for each distinct fingerprint and anchor in reach; anchors of the second half are marked in bit 31."""
    reach = 1 + -(-(threshold // 2) // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            bits = fp.view(np.uint64)
            for side, half in ((0, bits >> np.uint64(32)), (1, bits & np.uint64(0xFFFFFFFF))):
                row, word = anchors(half.astype(np.int64), reach)
                yield pa.RecordBatch.from_arrays([pa.array(word | side << 31), pa.array(fp[row])], names=["anchor", "fp"])

    return prints.select("fp").mapInArrow(run, "anchor bigint, fp bigint")


def forest(prints: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Spanning links of the fingerprints that are close, found by spreading from each through those not yet reached."""
    links: list[tuple[int, int]] = []
    todo = np.unique(prints)
    while len(todo) > 1:
        front, todo = [todo[-1]], todo[:-1]
        while front and len(todo):
            at = front.pop()
            near = np.bitwise_count(todo ^ at) <= threshold
            if near.any():
                found = todo[near]
                todo = todo[~near]
                links += [(int(at), int(x)) for x in found]
                front += list(found)
    return links


def near_links(prints: DataFrame, threshold: int = 4, tile: int = TILE) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that join the same groups as all close pairs do."""
    spark = prints.sparkSession
    spread = replicate(prints, threshold)
    # anchors that a single fingerprint reaches need no comparing; the count also tells the crowded ones
    sizes = spread.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    placed = spread.join(sizes.hint("merge"), "anchor")
    parts = F.ceil(F.col("n") / tile).cast("int")
    mine = F.pmod(F.xxhash64("fp"), parts.cast("long")).cast("int")
    others = F.when(parts > 1, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))
    placed = placed.select("anchor", "fp", mine.alias("mine"), F.explode(others).alias("other"))
    placed = placed.select("anchor", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if key is not None:
                links = forest(np.concatenate(own).view(np.uint64), threshold)
                if links:
                    pairs = np.array(links, dtype=np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["a", "b"])

        for b in batches:
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            fp = b.column(3).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
            edges = [0, *cut.tolist(), len(fp)]
            for x, y in zip(edges, edges[1:]):
                this = (int(cols[0][x]), int(cols[1][x]), int(cols[2][x])) if y > x else key
                if this != key:
                    yield from done()
                    key, own = this, []
                own.append(fp[x:y])
        yield from done()

    # each run of equal keys is one comparison; sorting keeps memory at one tile pair
    links = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "anchor", "i", "j").sortWithinPartitions("anchor", "i", "j").mapInArrow(compare, "a bigint, b bigint")
    return links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable by links) for each row.

    A null text counts as empty: fingerprint zero, linked like any other. Rows with equal ids are all
    returned. A null id is returned with its component; it is the least of none but a group of null ids alone,
    where component_id is null. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = common.stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), simhash(F.col(text_col)).alias("fp")), "fingerprints")
    prints = common.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    # components over fingerprints; their order does not matter, so each gets the least document id afterwards
    labels = least_of_groups(prints, components(spark, near_links(prints, threshold)))
    out = rows.join(labels.hint("merge"), "fp")  # a row for each fingerprint: never broadcast
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, similarity: Fraction = shingles.SIMILARITY) -> DataFrame:
    """Keep one document of each group that 5-word shingles of Jaccard ``similarity`` join: the one with the least doc_id.

    Links of fingerprints are the first candidates; the exact check of shingles follows, and their prefixes bring what the bits miss.
    Of rows with equal ids the one with the least text stays. Rows without an id stay only where the whole
    group has none, one of them.
    """
    found = shingles.near_duplicates(docs, similarity, sketch=fingerprint, close=near_links)
    kept = common.stored(found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "components")
    d = docs.alias("d")
    same = lambda right: F.col("d.doc_id").eqNullSafe(F.col(f"{right}.doc_id"))
    # merged at every size: the ids that stay, and those given more than once, grow with the corpus, so they are never broadcast
    out = d.join(kept.alias("k").hint("merge"), same("k"), "left_semi")
    again = kept.filter("n > 1").select("doc_id")
    if again.limit(1).count():
        # rows of one id: the whole row's hash settles equal texts, so columns of any type may follow
        names = [F.col(f"`{c}`") for c in docs.columns]
        whole = F.struct(F.col("text"), F.xxhash64(F.to_json(F.struct(*names))).alias("h"))
        once = out.alias("d").join(again.alias("a").hint("merge"), same("a"), "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*names), whole).alias("row")).select("row.*")
        out = out.alias("d").join(again.alias("a").hint("merge"), same("a"), "left_anti").unionByName(once)
    return out


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
