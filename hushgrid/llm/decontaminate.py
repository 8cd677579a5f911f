"""Benchmark leaks: a BM25 inverted index of the test items, queried with every training passage by block-max WAND.

The index holds the items (long ones in parts) in ascending order of the score they need; this document order is
that of all postings. For each term it knows the largest contribution of all and of each block of documents. A
passage is a window of words. Block maxima of all its terms first tell the blocks that can hold an item of enough
score; where there are any, WAND runs: cursors of the terms stand in document order, the pivot is the first
document at which the maxima of the terms before it reach what that document needs (documents before need no
less than they can get, as needs ascend), blocks whose maxima do not
reach it are left by a jump, and only pivots
that pass are scored. Bounds never cut an item that would pass.

Retrieved items are verified around the passages that retrieved them: the shares of the question's and of the
answer's word 5-grams found there.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from . import common

TOKEN = re.compile(r"\w+")
_BREAK = re.compile(r"\W")
K1, B = 1.2, 0.75
#: Words of a passage and of its step; a part of an item is no longer than the step, so one passage holds it whole.
WINDOW, STEP = 128, 64
#: Documents of a block at least, and numbers in the table of block maxima at most: larger indexes get longer blocks.
#: Passages share common words with all items, so bounds tell only in short blocks: of 16 documents, 77 % of the passages
#: of sf0.1 have a live block, of 2 documents 2 %.
BLOCK, MAXIMA = 2, 4_000_000
#: Characters of a text that are cut into words at once, words of a text that are looked up at once, and numbers in the bounds of passages.
CHARS, WORDS, BOUNDS = 65_536, 128 * STEP, 4_000_000
NGRAM = 5
#: Words of items in one index, about; and indexes that one pass over the texts takes along.
MAX_POSTINGS, AT_ONCE = 500_000, 4


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def ngrams(words: list[str]) -> list[tuple[str, ...]]:
    """Word 5-grams; of fewer words the whole sequence."""
    if not words:
        return []
    return [tuple(words[k : k + NGRAM]) for k in range(max(1, len(words) - NGRAM + 1))]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence or line is the answer, all before it the question; one sentence alone is both."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text) if TOKEN.search(p)]
    if len(parts) < 2:
        return tokens(text), tokens(text)
    return tokens(" ".join(parts[:-1])), tokens(parts[-1])


class Index:
    """Inverted index with block maxima over the distinct items (item_id, text); those without a word are left out.

    Items of one id, or without an id, are each found by their own text; inside, an item is its place in ``ids``.
    """

    def __init__(self, items: list[tuple[object, str | None]], share: float):
        distinct = [(i, t) for i, t in dict.fromkeys(items) if tokens(t)]
        self.ids = [i for i, _ in distinct]
        self.items = {k: t for k, (_, t) in enumerate(distinct)}
        parts = [(i, w[k : k + STEP]) for i, t in self.items.items() for w in [tokens(t)] for k in range(0, len(w), STEP)]
        n = len(parts)
        df = Counter(t for _, w in parts for t in set(w))
        mean = sum(len(w) for _, w in parts) / max(1, n)
        self.terms = {t: k for k, t in enumerate(sorted(df))}
        weight = []
        for _, w in parts:
            size = K1 * (1 - B + B * len(w) / mean)
            weight.append({self.terms[t]: float(np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + size)) for t, tf in Counter(w).items()})
        needed = [share * sum(x.values()) for x in weight]
        order = sorted(range(n), key=lambda k: (needed[k], parts[k][0], k))
        self.owner = [parts[k][0] for k in order]
        self.needed = [needed[k] for k in order]
        self.block = max(BLOCK, -(-n * (len(self.terms) + 1) // MAXIMA))
        self.n_blocks = -(-n // self.block)
        self.least = np.array([self.needed[b * self.block] for b in range(self.n_blocks)])  # needs ascend
        self.peak = np.zeros((len(self.terms) + 1, max(1, self.n_blocks)), dtype=np.float32)
        postings: list[list[tuple[int, float]]] = [[] for _ in range(len(self.terms) + 1)]
        for at, k in enumerate(order):
            for t, s in weight[k].items():
                postings[t].append((at, s))
                self.peak[t, at // self.block] = max(self.peak[t, at // self.block], s)
        self.peak *= np.float32(1 + 1e-5)  # bounds stay bounds after rounding
        self.top = self.peak.max(axis=1).tolist()
        self.first = np.concatenate([[0], np.cumsum([len(p) for p in postings])]).tolist()
        self.part = [a for p in postings for a, _ in p]
        self.gain = [s for p in postings for _, s in p]
        self.checks = {i: tuple(map(ngrams, question_and_answer(t))) + (ngrams(tokens(t)),) for i, t in self.items.items()}
        self.size = {i: len(tokens(t)) for i, t in self.items.items()}

    def search(self, terms: list[int], live: np.ndarray) -> list[tuple[int, float]]:
        """(document, score) of all documents that get what they need from these terms; none of them lies outside the ``live`` blocks."""
        part, first, top, needed, size = self.part, self.first, self.top, self.needed, self.block
        starts = (np.flatnonzero(live) * size).tolist()  # of live blocks
        cursors, out = [], []
        for t in terms if starts else ():
            if (at := bisect_left(part, starts[0], first[t], first[t + 1])) < first[t + 1]:
                cursors.append([part[at], t, at, first[t + 1]])
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += top[c[1]]
                if bound >= needed[c[0]]:
                    pivot = k
                    break
            if pivot < 0:
                break
            doc = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == doc:
                pivot += 1
            block = doc // size
            reached = cursors[: pivot + 1]
            if not live[block]:
                k = bisect_left(starts, doc)
                go = starts[k] if k < len(starts) else len(needed)
            elif sum(float(self.peak[c[1], block]) for c in reached) < needed[doc]:
                # the terms of the cursors passed cannot lift a document of this block, up to where the next term comes in
                go = min((block + 1) * size, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else len(needed))
            elif cursors[0][0] == doc:
                score = sum(self.gain[c[2]] for c in sorted(reached, key=lambda c: c[1]))
                if score >= needed[doc] * (1 - 1e-9):
                    out.append((doc, score))
                go = doc + 1
            else:
                go = doc
            for c in reached:
                if c[0] < go:
                    c[2] = bisect_left(part, go, c[2], c[3])
                    c[0] = part[c[2]] if c[2] < c[3] else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return out

    def retrieve(self, words: list[list[str]], n_passages: list[int]) -> Iterator[tuple[int, int, int, float]]:
        """(list, passage, item, score): for each list of words and each of its first passages, the items that it retrieves."""
        if not self.n_blocks:
            return
        get = self.terms.get
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ids = np.fromiter((get(w, -1) for own in words for w in own), dtype=np.int64, count=int(lengths.sum()))
        base = np.concatenate([[0], np.cumsum(n_passages)])
        owner = np.repeat(np.arange(len(words)), lengths)
        place = (np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)) // STEP
        known = np.flatnonzero(ids >= 0)
        ids, owner, place = ids[known], owner[known], place[known]
        most = np.asarray(n_passages)[owner]
        # a word at place p lies in the passages p // STEP and the one before
        here, back = place < most, (place > 0) & (place <= most)
        n_terms = len(self.terms)
        pairs = np.unique(np.concatenate([(base[owner[here]] + place[here]) * n_terms + ids[here], (base[owner[back]] + place[back] - 1) * n_terms + ids[back]]))
        passage, term = pairs // n_terms, pairs % n_terms
        begin = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]])) if len(pairs) else np.zeros(0, dtype=np.int64)
        ends = np.append(begin[1:], len(pairs))
        k = 0
        while k < len(begin):  # passages whose bounds fit
            stop = max(k + 1, int(np.searchsorted(ends, begin[k] + BOUNDS // self.n_blocks, "right")))
            reach = np.add.reduceat(self.peak[term[begin[k] : ends[stop - 1]]], begin[k:stop] - begin[k], axis=0)
            live = reach >= self.least  # blocks that may hold a document of enough score
            for j in np.flatnonzero(live.any(axis=1)).tolist():
                at = int(passage[begin[k + j]])
                text = int(np.searchsorted(base, at, "right")) - 1
                for doc, score in self.search(term[begin[k + j] : ends[k + j]].tolist(), live[j]):
                    yield text, at - int(base[text]), self.owner[doc], score
            k = stop


class Text:
    """A lower-cased text that is cut into words piece by piece; of the words seen only where they stand is kept."""

    def __init__(self, text: str | None):
        self.text = (text or "").lower()
        self.marks = [(0, 0)]  # words and characters before each piece

    def pieces(self) -> Iterator[tuple[int, list[str], int]]:
        """(number of the first passage, words, passages that are whole): the passages of the text, each once."""
        words: list[str] = []
        done, at = 0, 0
        while at < len(self.text):
            found = _BREAK.search(self.text, at + CHARS) if at + CHARS < len(self.text) else None
            end = found.start() if found else len(self.text)
            words += TOKEN.findall(self.text, at, end)
            at = end
            self.marks.append((done * STEP + len(words), at))
            while len(words) > WORDS:
                yield done, words[:WORDS], WORDS // STEP - 1
                words = words[WORDS - STEP :]
                done += WORDS // STEP - 1
        if words:
            yield done, words, -(-len(words) // STEP)

    def stretch(self, a: int, b: int) -> list[str]:
        """Words a to b of the text."""
        k = max(0, bisect_left(self.marks, (a + 1,)) - 1)
        n, at = self.marks[k]
        j = bisect_left(self.marks, (b,))
        end = self.marks[j][1] if j < len(self.marks) else len(self.text)
        return TOKEN.findall(self.text, at, end)[max(0, a - n) : max(0, b - n)]


def verified(index: Index, text: Text, hits: dict[int, list[tuple[int, float]]], overlap: float) -> list[dict]:
    """The retrieved items of a text (item -> passages and scores) that the text around those passages bears out, by id."""
    out = []
    grams_of: dict[tuple[int, int, int], set] = {}

    def grams(a: int, b: int, n: int) -> set:
        if (a, b, n) not in grams_of:
            words = text.stretch(a, b)
            grams_of[a, b, n] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
        return grams_of[a, b, n]

    for item in sorted(hits, key=lambda k: (index.ids[k] is not None, index.ids[k] if index.ids[k] is not None else 0, k)):
        passages = sorted(hits[item])
        far = -(-index.size[item] // STEP) * STEP  # parts that no passage retrieved lie no farther
        spans: list[list[int]] = []
        for p, _ in passages:
            a, b = max(0, p * STEP - far), p * STEP + WINDOW + far
            if spans and a <= spans[-1][1]:
                spans[-1][1] = b
            else:
                spans.append([a, b])
        shares = []
        for wanted in index.checks[item]:
            n = len(wanted[0])
            shares.append(sum(any(g in grams(a, b, n) for a, b in spans) for g in wanted) / len(wanted))
        q, a, whole = shares
        if whole >= overlap and q >= overlap and a >= 0.5:
            out.append({"item_id": index.ids[item], "score": round(max(s for _, s in passages), 6), "question_overlap": q, "answer_overlap": a, "overlap": whole, "passages": len(passages)})
    return out


def leaks(indexes: list[Index], texts: list[str | None], overlap: float) -> list[list[dict]]:
    """For each text, its verified items; words of many texts are looked up together."""
    all_ = [Text(t) for t in texts]
    hits: list[list[dict[int, list[tuple[int, float]]]]] = [[{} for _ in indexes] for _ in texts]
    held: list[tuple[int, int, list[str], int]] = []

    def look_up() -> None:
        for k, index in enumerate(indexes):
            for at, passage, item, score in index.retrieve([w for _, _, w, _ in held], [n for *_, n in held]):
                text, first, _, _ = held[at]
                hits[text][k].setdefault(item, []).append((first + passage, score))
        held.clear()

    size = 0
    for number, text in enumerate(all_):
        for first, words, n in text.pieces():
            held.append((number, first, words, n))
            size += len(words)
            if size >= 4 * WORDS:
                look_up()
                size = 0
    look_up()
    return [[x for k, index in enumerate(indexes) if own[k] for x in verified(index, text, own[k], overlap)] for text, own in zip(all_, hits)]


def find_leaks(indexes: list[Index], text: Column, overlap: float, item_type: DataType) -> Column:
    shared = indexes
    kind = pa.list_(pa.struct([("item_id", to_arrow_type(item_type)), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("overlap", pa.float64()), ("passages", pa.int32())]))

    @F.arrow_udf(f"array<struct<item_id:{item_type.simpleString()},score:double,question_overlap:double,answer_overlap:double,overlap:double,passages:int>>")
    def run(texts: pa.Array) -> pa.Array:
        return common.by_parts(lambda part: pa.array(leaks(shared, part.to_pylist(), overlap), type=kind))(texts)

    return run(text)


def indexes(benchmark: DataFrame, share: float, max_postings: int = MAX_POSTINGS) -> Iterator[list[Index]]:
    """Indexes of about ``max_postings`` words of items each (one item is never divided), ``AT_ONCE`` together for one pass.

    What a task and the driver hold at once has that bound, and a benchmark of any size is served by more passes.
    """
    rows = benchmark.select("item_id", "text").filter("text is not null")
    words = rows.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first()["n"] or 0
    shards = max(1, -(-words // max_postings))
    by = rows.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    for k in range(0, shards, AT_ONCE):
        got: dict[int, list] = {}
        for r in by.filter(F.col("shard").between(k, k + AT_ONCE - 1)).orderBy("shard", "item_id", "text").collect():
            got.setdefault(r["shard"], []).append((r["item_id"], r["text"]))
        yield [Index(items, share) for items in got.values()]


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.5, overlap: float = 0.8, max_postings: int = MAX_POSTINGS) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap, overlap, passages: each verified leak.

    An item is retrieved by a passage whose BM25 score reaches ``share`` of the item's own (of its part's, for items
    of more than ``STEP`` words), and verified if ``overlap`` of its and of its question's 5-grams, and half of its
    answer's, are in the text around those passages. The answer is the item's last sentence or line, as the tables
    do not mark it. Null and empty texts and items leak nothing; rows with equal ids are all searched, equal items
    (id and text) reported once a row; empty tables give no rows. Ids may be of any type that can be ordered.
    """
    item = benchmark.schema["item_id"].dataType
    out = None
    for some in indexes(benchmark, share, max_postings):
        got = docs.select("doc_id", F.explode(find_leaks(some, F.col("text"), overlap, item)).alias("leak")).select("doc_id", "leak.*")
        out = got if out is None else out.unionByName(got)
    return out


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def stage(spark, docs: DataFrame, sf_dir: str, share: float = 0.5, overlap: float = 0.8, max_postings: int = MAX_POSTINGS) -> DataFrame:
    """Keep the documents without a verified leak."""
    benchmark = common.table(spark, sf_dir, "benchmark")
    for some in indexes(benchmark, share, max_postings):
        docs = docs.filter(F.size(find_leaks(some, F.col("text"), overlap, benchmark.schema["item_id"].dataType)) == 0)
    return docs
