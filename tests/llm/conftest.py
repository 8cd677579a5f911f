"""Small tables with every awkward row: nulls, empty and very long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

import pytest

WORDS = "the of and river stone market evening garden walls towards weather cloudy table letter window harbour winter summer field road".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    out = [(k, prose(k, 30 + k % 50), "en", f"s{k % 3}", 0) for k in range(40)]
    out += [(100, None, None, None, None), (101, "", "en", "s", 0), (102, " \n\t ", "en", "s", 3), (103, "123 !!", "en", "s", 6), (104, prose(3, 33), "en", "s", 0), (104, prose(3, 33), "en", "s", 0), (None, "lone words here", "en", "s", 0)]
    out += [(105, prose(9, 30_000), "en", "s", 0), (106, "x" * 5_000, "en", "s", 0), (107, "caf\u00e9 \U0001f600 \u65e5\u672c\u8a9e it's we'll <|endoftext|> end", "fr", "s", 0)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, score string").repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
