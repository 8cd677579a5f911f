"""Token ids as ORC: integer run-length encoded lists, row indexes, and Bloom filters on document ids.

Files lie in ascending doc_id order (one range of ids a file, sorted inside), so stripe and row-group
statistics prune by id, the Bloom filters settle point lookups, and readers take stripes in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, token_counts


#: Bytes of the longest piece that stays cached.
LONGEST = 1 << 16


class Pieces(dict):
    """Piece (bytes) -> its number. A new one gets the next number and waits in ``fresh`` to be encoded."""

    fresh: list[bytes]

    def __missing__(self, piece: bytes) -> int:
        self[piece] = number = len(self)
        self.fresh.append(piece)
        return number


class Encoder:
    """Ids as the tokenizers library gives them, each distinct piece encoded once while it stays cached.

    Encoding a text is encoding its pre-tokenizer pieces one after the other. Texts that hold a special
    string go to the library whole. Ids of all cached pieces lie end to end in one pool. The cache is emptied
    beyond ``max_cached`` pieces or ``max_bytes`` of them, and pieces of more than ``LONGEST`` bytes are not kept in it.
    """

    def __init__(self, path: str, max_cached: int = 800_000, max_bytes: int = 32 << 20):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        self.single = Tokenizer.from_file(path)  # for what is one piece already: bytes to characters, no splitting
        self.single.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.max_cached, self.max_bytes = max_cached, max_bytes
        self.reset()

    def reset(self) -> None:
        self.numbers = Pieces()
        self.numbers.fresh = []
        self.bytes, self.long = 0, False
        self.pool = np.empty(1 << 16, dtype=np.int32)
        self.first = np.zeros(1, dtype=np.int64)  # where each piece's ids begin in the pool; one more than pieces

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int32)

    def learn(self) -> None:
        """Encode the fresh pieces, many in a call as words of one input, and lay their ids in the pool."""
        fresh, self.numbers.fresh = self.numbers.fresh, []
        ids, sizes = [], []
        for k in range(0, len(fresh), 4096):
            part = [p.decode("utf-8") for p in fresh[k : k + 4096]]
            got = self.single.encode_batch([part], is_pretokenized=True, add_special_tokens=False)[0]
            ids.append(np.asarray(got.ids, dtype=np.int32))
            sizes.append(np.bincount(np.asarray(got.word_ids, dtype=np.int64), minlength=len(part)))
        if fresh:
            sizes_ = list(map(len, fresh))
            self.bytes += sum(sizes_)
            self.long = self.long or max(sizes_) > LONGEST
            new = np.concatenate(ids)
            begin = int(self.first[-1])
            while begin + len(new) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
            self.pool[begin : begin + len(new)] = new
            self.first = np.concatenate([self.first, begin + np.cumsum(np.concatenate(sizes))])

    def pieces(self, texts: list[str]) -> tuple[dict[int, str], np.ndarray, np.ndarray]:
        """The texts that hold a special string, by place; and for each piece of the others its number and its text's place."""
        odd = {k: t for k, t in enumerate(texts) if any(s in t for s in self.specials)}
        plain = ["" if k in odd else t for k, t in enumerate(texts)]
        where, byte, owner = token_counts.piece_starts(plain)
        lengths = np.fromiter(map(len, plain), dtype=np.int64, count=len(plain))
        first = np.cumsum(lengths + 1) - lengths - 1
        real = where != (first + lengths)[owner]
        # pieces lie end to end, so they are an Arrow column without a copy; only distinct ones become Python objects
        joined = ("\0".join(plain) + "\0").encode("utf-8")
        offsets = np.append(byte, len(joined)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(byte), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
        if len(self.numbers) > self.max_cached or self.bytes > self.max_bytes or self.long:
            self.reset()
        numbers = np.fromiter(map(self.numbers.__getitem__, pieces.dictionary.to_pylist()), dtype=np.int64, count=len(pieces.dictionary))
        index = numbers[pieces.indices.to_numpy()[real]]
        self.learn()
        return odd, index, owner[real]

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text, without an end id."""
        odd, index, owner = self.pieces(texts)
        counts = np.bincount(owner, weights=np.diff(self.first)[index], minlength=len(texts)).astype(np.int64)
        for k, text in odd.items():
            counts[k] = len(self.whole(text))
        return counts

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, each text's followed by ``end_id``, and the number for each text."""
        odd, index, owner = self.pieces(texts)
        begin, sizes = self.first[index], self.first[index + 1] - self.first[index]
        counts = np.bincount(owner, weights=sizes, minlength=len(texts)).astype(np.int64)
        at = np.cumsum(sizes) - sizes
        ids = self.pool[np.repeat(begin - at, sizes) + np.arange(int(sizes.sum()))]
        if odd:
            parts, at = [], 0
            for k, n in enumerate(counts.tolist()):
                own = self.whole(odd[k]) if k in odd else ids[at : at + n]
                at += n
                counts[k] = len(own)
                parts.append(own)
            ids = np.concatenate(parts)
        ids = np.insert(ids, np.cumsum(counts), np.int32(end_id))
        return ids, counts + 1


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def token_lengths(text: Column, vocabulary: str = "byte_bpe_50k.json", folder: str | None = None) -> Column:
    """Number of ids of a text column (null: 0), each distinct piece encoded once while it stays cached."""

    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        e = encoder(common.tokenizer_path(vocabulary, folder))
        return common.by_parts(lambda part: pa.array(e.count([t or "" for t in part.to_pylist()]), type=pa.int64()))(texts)

    return run(text)


def write(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, folder: str | None = None, bloom_fpp: float = 0.01, stripe_mb: int = 16) -> str:
    """Write ``docs`` (doc_id, text) to ORC files under ``path``; returns it.

    Columns: doc_id, part and row (number of the id range, and of the row in it), tokens. Null texts count
    as empty and hold the end id alone; rows with equal ids are all kept, ordered by text. A null id sorts
    first. An empty table gives no rows.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    ordered = docs.select("doc_id", text.alias("text")).repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(common.tokenizer_path(vocabulary, folder))
        part, row = TaskContext.get().partitionId(), 0
        for b in (part for whole in batches for part in common.parts(whole, whole.column("text"), 1024)):
            ids, counts = e.encode(b.column("text").to_pylist(), end_id)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            k = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.full(k, part, dtype=np.int32)), pa.array(np.arange(row, row + k)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=["doc_id", "part", "row", "tokens"]
            )
            row += k

    out = ordered.mapInArrow(encode, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part int, row bigint, tokens array<int>")
    options = {"orc.compress": "ZSTD", "orc.stripe.size": str(stripe_mb << 20), "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": str(bloom_fpp)}
    out.write.options(**options).orc(path)
    return path


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The stored rows; with ``doc_ids`` only those, found by statistics and Bloom filters."""
    rows = spark.read.orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each stored document, from the stored ids.

    ``start`` is made of two sums: of whole ranges before (one row for each) and of rows before in the range.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("tokens")
            values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
            at = lists.offsets.to_numpy()
            crc = [zlib.crc32(values[i:j].data) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("row"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, type=pa.int64())], names=["doc_id", "part", "row", "n_tokens", "ids_crc32"])

    kept = common.scratch(spark, "token-digests")
    stored = read(spark, path)
    stored.mapInArrow(digest, f"doc_id {stored.schema['doc_id'].dataType.simpleString()}, part int, row bigint, n_tokens bigint, ids_crc32 bigint").write.parquet(kept)
    rows = spark.read.parquet(kept)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("all"))  # a row for each file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_orc(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return manifest(spark, write(docs, common.scratch(spark, "token-ids")))
