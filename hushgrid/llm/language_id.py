"""Language identification by words first, backing off to shorter and shorter character n-grams.

A known word scores by its log frequency in each language. A word that was not seen is read from left to
right: at each place the longest known n-gram scores, from ``MAX_GRAM`` characters (word ends marked) down to
one. Word scores are weighted by their count in the text and give a posterior over the languages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

MAX_GRAM = 5
WORD = re.compile(r"[^\W\d_]+")
#: Result for a text without a letter.
NONE = "und"


def words_of(text: str) -> Counter:
    """Lower-cased words with a letter, counted."""
    found = Counter(WORD.findall(text.lower()))
    return found if text.isascii() else Counter({w: n for w, n in found.items() if any(map(str.isalpha, w))})


def grams_of(word: str) -> Iterator[str]:
    marked = f" {word} "
    for n in range(1, MAX_GRAM + 1):
        for k in range(len(marked) - n + 1):
            yield marked[k : k + n]


class Model:
    """Log frequencies of words and n-grams: each key's row in a matrix with a column for each language."""

    def __init__(self, langs: list[str], priors: list[float], words: tuple[dict[str, int], np.ndarray], grams: tuple[dict[str, int], np.ndarray], max_cached: int = 100_000):
        self.langs, self.priors = langs, np.asarray(priors)
        self.words, self.word_rows = words
        self.grams, self.gram_rows = grams
        self.max_cached = max_cached
        self.forget(0)

    def forget(self, room: int) -> None:
        """Empty the cache of unseen words, whose rows follow those of the words; at least ``room`` of them fit."""
        self.unseen: dict[str, int] = {}
        size = len(self.words) + max(self.max_cached, room)
        if getattr(self, "rows", None) is None or len(self.rows) < size:
            self.rows = np.zeros((size, max(1, len(self.langs))))
            if len(self.words):
                self.rows[: len(self.words)] = self.word_rows

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("unseen", "rows")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget(0)

    def back_off(self, word: str) -> np.ndarray | None:
        """Score of a word that was not seen; None if not one character of it is known."""
        marked, k, rows = f" {word} ", 0, []
        while k < len(marked):
            for n in range(min(MAX_GRAM, len(marked) - k), 0, -1):
                got = self.grams.get(marked[k : k + n])
                if got is not None:
                    if marked[k : k + n] != " ":  # the mark alone says nothing
                        rows.append(got)
                    k += n
                    break
            else:
                k += 1
        return self.gram_rows[rows].sum(axis=0) if rows else None

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its posterior; ``und`` and 0 for null or a text without a letter. Ties go to the first name."""
        found = words_of(text or "")
        if not found or not self.langs:
            return NONE, 0.0
        if len(self.unseen) + len(found) > self.max_cached:
            self.forget(len(found))
        at = []
        for w in found:
            row = self.words.get(w)
            if row is None and (row := self.unseen.get(w)) is None:
                row = self.unseen[w] = len(self.words) + len(self.unseen)
                score = self.back_off(w)
                self.rows[row] = 0 if score is None else score
            at.append(row)
        total = self.priors + np.fromiter(found.values(), dtype=float, count=len(found)) @ self.rows[at]
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_docs_per_lang: int = 1_000, max_words: int = 50_000, max_grams: int = 60_000, max_langs: int = 500) -> Model:
    """Fit on a bounded sample of labelled rows: of each language, at most ``max_docs_per_lang`` distinct texts, by a hash of the text.

    Rows with a null text or language are not learned from; of more than ``max_langs`` languages, those with the most
    rows are. Counting is done on the executors; the driver gets the ``max_words`` most frequent words and the
    ``max_grams`` / ``MAX_GRAM`` most frequent n-grams of each length (of equal counts the first in order), never more.
    Without a labelled row the model knows no language and says ``und``.
    """
    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], [], ({}, np.zeros((0, 0))), ({}, np.zeros((0, 0))))
    rate = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 2 * max_docs_per_lang / n))])
    place = F.pmod(F.xxhash64("text"), F.lit(1_000_000))
    some = labelled.filter(place < F.coalesce(F.element_at(rate, F.col("lang")), F.lit(0.0)) * 1_000_000)
    # copies count once; about twice the bound is left, of which the first by hash are taken
    once = some.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1_000_000)), "h"))
    sample = once.withColumn("n", first).filter(F.col("n") <= max_docs_per_lang).select("lang", "text").repartition(64, F.xxhash64("text"))
    kinds = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("key", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.parts(whole, whole.column("text")):
                found: dict[tuple[str, int], Counter] = {}
                for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                    for w, n in words_of(text).items():
                        found.setdefault((lang, 0), Counter())[w] += n
                        for g in grams_of(w):
                            found.setdefault((lang, len(g)), Counter())[g] += n
                for (lang, size), c in found.items():  # size 0: whole words
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array([size] * len(c), pa.int32()), pa.array(list(c)), pa.array(list(c.values()), pa.int64())], schema=kinds)

    counts = sample.mapInArrow(count, "lang string, size int, key string, n bigint").groupBy("size", "key", "lang").agg(F.sum("n").alias("n"))
    per_lang = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{k}") for k, lang in enumerate(langs)]
    keys = common.stored(counts.groupBy("size", "key").agg(F.sum("n").alias("n"), *per_lang), "language-counts")
    tables = {}
    for size in range(MAX_GRAM + 1):
        most = max_grams // MAX_GRAM if size else max_words
        rows = keys.filter(F.col("size") == size).orderBy(F.desc("n"), "key").limit(most).toPandas().sort_values("key")
        matrix = rows[[f"n{k}" for k in range(len(langs))]].to_numpy(dtype=float)
        tables[size] = (rows["key"].tolist(), np.log((matrix + 0.5) / (matrix.sum(axis=0) + 0.5 * max(1, len(matrix)))))
    grams = [k for size in range(1, MAX_GRAM + 1) for k in tables[size][0]]
    total = sum(sizes.values())
    priors = [float(np.log(sizes[lang] / total)) for lang in langs]
    return Model(langs, priors, ({k: n for n, k in enumerate(tables[0][0])}, tables[0][1]), ({k: n for n, k in enumerate(grams)}, np.concatenate([tables[s][1] for s in range(1, MAX_GRAM + 1)])))


def identify(model: Model, text: Column) -> Column:
    """struct(lang_pred, score) of a text column."""
    shared = model

    @F.arrow_udf("lang_pred string, score double")
    def run(texts: pa.Array) -> pa.Array:
        return common.by_parts(one)(texts)

    def one(part: pa.Array) -> pa.Array:
        got = [shared.predict(t) for t in part.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], type=pa.string()), pa.array([g[1] for g in got], type=pa.float64())], names=["lang_pred", "score"])

    return run(text)


def predict_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (columns of these names are replaced).

    Null, empty and letterless texts give ``und`` with score 0. Ties go to the language first by name.
    Repeated rows each get the same answer; an empty table stays empty.
    """
    found = identify(model, F.col(text_col))
    return docs.withColumns({"lang_pred": found["lang_pred"], "score": found["score"]})


def learnable(docs: DataFrame) -> DataFrame:
    return docs.filter(common.crc_fold(F.col("doc_id")) != 1)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = train(learnable(docs))
    held = (common.crc_fold(F.col("doc_id")) == 1).alias("held_out")
    return predict_language(docs.select("doc_id", "text"), model).select("doc_id", held, "lang_pred", "score")


def stage(spark, docs: DataFrame, sf_dir: str, min_score: float = 0.5) -> DataFrame:
    """Keep the documents whose language is known: those of ``und`` or a posterior under ``min_score`` go; columns of any name stay as they are."""
    model = train(learnable(common.table(spark, sf_dir, "documents")))
    found = identify(model, F.col("text"))
    return docs.filter((found["lang_pred"] != NONE) & (found["score"] >= min_score))
