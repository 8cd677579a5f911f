"""Text quality by nearest-neighbour voting in a latent-semantic space.

A text becomes a bag of terms: its words, hashed into ``WORD_TERMS`` columns, and what the words look like, in
``FORM_TERMS`` more: their shapes (case, digits, marks), and how often words, lines and sentences repeat. TF-IDF
weights and a truncated singular value decomposition of the labelled rows give the latent space. Labelled vectors
are broadcast (their number is bounded by a parameter); every document's cosines with all of them are computed
exactly, block by block, and the ``k`` nearest vote with their similarity as weight.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORD_TERMS, FORM_TERMS = 8192, 1024
TERMS = WORD_TERMS + FORM_TERMS
RANK = 64
NEIGHBOURS = 25
#: Documents of one product with the labelled vectors.
BLOCK = 256
#: Words of which a worker remembers the columns, and characters of the longest of them.
CACHED, LONGEST = 30_000, 40

_RUN = re.compile(r"(.)\1+")
_SENTENCE = re.compile(r"[.!?]\s+")
#: word -> its column, that of its shape, whether it ends in a mark, is upper case, has no letter or digit
_KNOWN: dict[str, tuple[int, int, bool, bool, bool]] = {}

Terms = tuple[np.ndarray, np.ndarray]


def word_column(word: str) -> int:
    return zlib.crc32(word.lower().encode("utf-8")) % WORD_TERMS


def form_column(term: str) -> int:
    return WORD_TERMS + zlib.crc32(term.encode("utf-8")) % FORM_TERMS


def shape(word: str) -> str:
    """The word with letters and digits replaced by their kind, runs shortened: ``Hello,`` is ``Xx,``."""
    kinds = "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return _RUN.sub(r"\1", kinds)[:12]


def facts(word: str) -> tuple[int, int, bool, bool, bool]:
    if (got := _KNOWN.get(word)) is None:
        marked = not word[-1].isalnum() and word[-1] not in ".,;:!?)\"'"
        got = word_column(word), form_column("s:" + shape(word)), marked, len(word) > 1 and word.isupper(), not any(map(str.isalnum, word))
        if len(word) <= LONGEST:
            if len(_KNOWN) >= CACHED:
                _KNOWN.clear()
            _KNOWN[word] = got
    return got


def features(text: str | None) -> Terms:
    """Columns, ascending, and term frequencies of a text, as square roots of shares; nothing for a text without a word."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32)
    n = len(words)
    seen = Counter(words)
    out: dict[int, float] = {}
    marks = upper = odd = 0
    for w, k in seen.items():
        word, form, is_marked, is_upper, is_odd = facts(w)
        out[word] = out.get(word, 0) + k
        out[form] = out.get(form, 0) + k
        marks += k * is_marked
        upper += k * is_upper
        odd += k * is_odd
    out = {c: k / n for c, k in out.items()}
    lines = [line for line in text.split("\n") if line.strip()]
    sentences = [s for s in _SENTENCE.split(text) if s]
    shares = {
        "again": sum(a == b for a, b in zip(words, words[1:])) / n,
        "second": sum(a == b for a, b in zip(words, words[2:])) / n,
        "types": 1 - len(seen) / n if n >= 20 else 0.0,
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
        "sentences": 1 - len(set(sentences)) / max(1, len(sentences)),
        "marks": marks / n,
        "upper": upper / n,
        "odd": odd / n,
    }
    for name, share in shares.items():  # each share as a term, and as the step it lies in
        for term, value in ((f"r:{name}", share), (f"r:{name}:{min(9, int(share * 10))}", 0.05)):
            if value:
                c = form_column(term)
                out[c] = out.get(c, 0) + value
    c = form_column(f"n:{min(12, n.bit_length())}")
    out[c] = out.get(c, 0) + 0.02
    columns = np.array(sorted(out), dtype=np.int32)
    return columns, np.sqrt([out[c] for c in columns.tolist()]).astype(np.float32)


def vote(cosine: np.ndarray, labels: np.ndarray, k: int, prior: float) -> np.ndarray:
    """Share of label 1 among the ``k`` nearest of each row, weighted by squared similarity; ``prior`` where none is similar.

    Of neighbours equally near, those first in the fitted order count.
    """
    k = min(k, len(labels))
    least = np.partition(cosine, len(labels) - k, axis=1)[:, len(labels) - k, None]
    above, ties = cosine > least, cosine == least
    near = above | ties
    crowded = np.flatnonzero(near.sum(axis=1) > k)
    near[crowded] = above[crowded] | ties[crowded] & (np.cumsum(ties[crowded], axis=1) <= k - above[crowded].sum(axis=1, keepdims=True))
    weight = np.where(near, np.clip(cosine, 0, None).astype(float) ** 2, 0)
    total = weight.sum(axis=1)
    return np.clip(np.divide(weight @ labels, total, out=np.full(len(cosine), prior), where=total > 1e-9), 0, 1)


class Model:
    """Weights, projection, and the labelled vectors with their labels."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray, vectors: np.ndarray, labels: np.ndarray, k: int):
        self.weighted = np.ascontiguousarray(idf[:, None] * basis, dtype=np.float32)
        self.vectors, self.labels, self.k = vectors, labels, k
        self.prior = float(labels.mean()) if len(labels) else 0.5

    def embed(self, rows: list[Terms]) -> np.ndarray:
        """Unit latent vectors; zero where there is nothing to weigh."""
        latent = np.zeros((len(rows), self.weighted.shape[1]), dtype=np.float32)
        for k, (columns, values) in enumerate(rows):
            if len(columns):
                latent[k] = values @ self.weighted[columns]
        size = np.linalg.norm(latent, axis=1, keepdims=True)
        return np.divide(latent, size, out=np.zeros_like(latent), where=size > 0)

    def score(self, rows: list[Terms]) -> np.ndarray:
        """Similarity-weighted share of label 1 among the k nearest.

        Cosines are taken to five decimals, so that no rounding of a product tells equals apart.
        """
        out = np.full(len(rows), self.prior)
        if not len(self.labels):
            return out
        for at in range(0, len(rows), BLOCK):
            cosine = np.round(self.embed(rows[at : at + BLOCK]) @ self.vectors.T, 5)
            out[at : at + BLOCK] = vote(cosine, self.labels, self.k, self.prior)
        return out


def decompose(rows: list[Terms], rank: int, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(idf, basis): TF-IDF weights of the terms, and the leading right singular vectors of the weighted rows.

    Subspace iteration from a fixed start; ``rounds`` of it settle the leading vectors.
    """
    matrix = np.zeros((len(rows), TERMS), dtype=np.float32)
    for k, (columns, values) in enumerate(rows):
        matrix[k, columns] = values
    idf = np.log((1 + len(rows)) / (1 + (matrix > 0).sum(axis=0))).astype(np.float32) + np.float32(0.5)
    matrix *= idf
    wide = min(rank + 16, min(matrix.shape))
    q = np.linalg.qr(matrix @ np.random.default_rng(0).normal(size=(TERMS, wide)).astype(np.float32))[0]
    for _ in range(rounds):
        q = np.linalg.qr(matrix @ np.linalg.qr(matrix.T @ q)[0])[0]
    return idf, np.linalg.svd(q.T @ matrix, full_matrices=False)[2][: min(rank, wide)].T


def blank(k: int) -> Model:
    return Model(np.ones(TERMS), np.zeros((TERMS, 1)), np.zeros((0, 1), dtype=np.float32), np.zeros(0), k)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_labelled: int = 4_000, rank: int = RANK, k: int = NEIGHBOURS) -> Model:
    """Fit on at most ``max_labelled`` labelled rows: of each label, the ``max_labelled`` / 2 with the least hash of the id.

    Rows with a null label are not learned from; a null text counts as empty; a document of both labels counts for
    each, one of several rows with one id as often as it has rows, within the bound. The driver holds that sample's
    terms and no more. Without a labelled row every score is 0.5.
    """
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).filter("doc_id is not null").distinct()
    place = F.xxhash64("doc_id")
    chosen = None
    for label in (0, 1):
        some = known.filter(F.col("label") == label).orderBy(place, "doc_id").limit(max_labelled // 2)
        chosen = some if chosen is None else chosen.unionByName(some)
    # at most max_labelled ids and labels are broadcast, so that the texts stay where they are
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in common.parts(b, b.column("text")):
                texts = part.column("text").to_pylist()
                got = [features(t) for t in texts]
                columns = [
                    part.column("label"),
                    pa.array([zlib.crc32(t.encode("utf-8")) for t in texts], type=pa.int64()),
                    pa.array([c.tobytes() for c, _ in got], type=pa.binary()),
                    pa.array([v.tobytes() for _, v in got], type=pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["label", "place", "terms", "shares"])

    found = sample.select("text", "label").mapInArrow(run, "label int, place bigint, terms binary, shares binary")
    got = found.orderBy("place", "label", "terms", "shares").limit(max_labelled).toPandas()
    if not len(got):
        return blank(k)
    rows = [(np.frombuffer(c, dtype=np.int32), np.frombuffer(v, dtype=np.float32)) for c, v in zip(got["terms"], got["shares"])]
    idf, basis = decompose(rows, rank)
    model = Model(idf, basis, np.zeros((0, 1), dtype=np.float32), got["label"].to_numpy(dtype=float), k)
    model.vectors = np.ascontiguousarray(model.embed(rows))
    return model


def quality_score(model: Model, text: Column) -> Column:
    shared = model

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return common.by_parts(lambda part: pa.array(shared.score([features(t) for t in part.to_pylist()]), type=pa.float64()))(texts)

    return run(text)


def classify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on); columns of these names are replaced.

    Null and empty texts have no neighbour and get the share of label 1 in the sample. Repeated rows each get
    the same score; an empty table stays empty.
    """
    out = docs.withColumn("score", quality_score(model, F.col(text_col)))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def fitted(spark, sf_dir: str) -> Model:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    return train(docs.filter(common.crc_fold(F.col("doc_id")) != 1), labels.filter(common.crc_fold(F.col("doc_id")) != 1))


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held = (common.crc_fold(F.col("doc_id")) == 1).alias("held_out")
    return classify(docs, fitted(spark, sf_dir)).select("doc_id", held, "score", "predicted")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier does not call low quality; columns of any name stay as they are."""
    return docs.filter(quality_score(fitted(spark, sf_dir), F.col("text")) >= 0.5)
