"""Groups by shingle similarity against all pairs."""

from __future__ import annotations

import random

import pytest

from hushgrid.llm import shingles, simhash
from tests.llm.conftest import WORDS


def plain_sets(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain_groups(texts):
    sets = [plain_sets(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(k) for k in range(len(texts))]


def corpus():
    r = random.Random(11)
    out = []
    for n in (7, 25, 60, 200, 800):
        for _ in range(6):
            base = [r.choice(WORDS) + str(r.randrange(50)) for _ in range(n)]
            out.append(" ".join(base))
            for k in range(8):  # near copies on both sides of the bound
                other = list(base)
                for _ in range(max(1, n * k // 200)):
                    other[r.randrange(n)] = r.choice(WORDS)
                out.append(" ".join(other[: n - r.randrange(0, max(1, n // 6))]).title())
    hub = [r.choice(WORDS) for _ in range(100)]
    out += [" ".join(hub[:k] + ["w%d" % k] + hub[k + 1 :]) for k in range(0, 100, 2)]  # a large group of near copies
    out += [None, "", " \n", "one", "One", "one two three four", "a b c d e"]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("sample, near", [(5_000, 2), (0, 1)])
def test_groups_equal_all_pairs(spark, sample, near):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in shingles.near_duplicates(df, sample=sample, near=near).collect()}
    assert [got[k] for k in range(len(texts))] == plain_groups(texts)


def test_stage_drops_near_copies_beyond_four_bits(spark):
    for seed in range(100):  # five words in 300 changed: similarity 0.84
        r = random.Random(seed)
        base = [r.choice(WORDS) + str(r.randrange(99)) for _ in range(300)]
        texts = [" ".join(base), " ".join("changed" if k % 60 == 30 else w for k, w in enumerate(base))]
        if (simhash.fingerprint(texts[0]) ^ simhash.fingerprint(texts[1])).bit_count() > 4:
            break
    else:
        raise AssertionError("no such pair")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [x.doc_id for x in simhash.stage(spark, df, "").collect()] == [0]


def test_a_large_group_has_few_candidates(spark, monkeypatch):
    """Near copies of one text, many of them beyond the bound from one another, cost about their number."""
    r = random.Random(5)
    base = [r.choice(WORDS) + str(r.randrange(50)) for _ in range(80)]
    texts = [" ".join(f"new{k}" if j in at else w for j, w in enumerate(base)) for k in range(400) for at in [{r.randrange(80) for _ in range(2)}]]
    rounds = []
    verified = shingles.verified
    monkeypatch.setattr(shingles, "verified", lambda docs, stands, pairs, least: rounds.append(pairs.select("a", "b").distinct().count()) or verified(docs, stands, pairs, least))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x.doc_id: x.component_id for x in shingles.near_duplicates(df).collect()}
    assert [got[k] for k in range(len(texts))] == plain_groups(texts)
    assert sum(rounds) < 50 * len(texts), rounds


def test_stage_goes_by_fingerprints_first(spark, monkeypatch):
    texts = [t for t in corpus() if t]
    seen, brought, first = [], [], []
    near_links, alike, verified = simhash.near_links, shingles.alike, shingles.verified
    monkeypatch.setattr(simhash, "near_links", lambda prints: seen.append({x.fp for x in prints.collect()}) or near_links(prints))
    monkeypatch.setattr(shingles, "alike", lambda *a: brought.append(alike(*a)) or brought[0])
    monkeypatch.setattr(shingles, "verified", lambda docs, stands, pairs, least: first.append({frozenset(x) for x in pairs.collect()}) or verified(docs, stands, pairs, least))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    groups = plain_groups(texts)
    assert sorted(x.doc_id for x in simhash.stage(spark, df, "").collect()) == sorted(set(groups))
    signed = {f - (1 << 64) if f >> 63 else f for f in map(simhash.fingerprint, texts)}
    assert len(seen) == 1 and seen[0] <= signed and len(seen[0]) > len(set(groups))
    pairs = {frozenset(x) for x in brought[0].collect()}
    assert pairs and pairs <= first[0]
