"""SimHash groups against all pairs, and anchors against the code's definition."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from hushgrid.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def plain_components(fps, ids, threshold=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= threshold:
                root[find(i)] = find(j)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            r = find(k)
            least[r] = min(least.get(r, i), i)
    return [least.get(find(k)) for k in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", "a", "a b c d", "A b\tc\u00a0d e", "x y " * 300])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_anchors_are_all_code_words_in_reach():
    r = random.Random(1)
    words = np.array([r.getrandbits(31) for _ in range(20)], dtype=np.int64)

    def syndrome(w):
        s = 0
        for b in range(31):
            if w >> b & 1:
                s ^= b + 1
        return s

    for radius in (1, 2, 3):
        rows, anchors = simhash.anchors(words, radius)
        pairs = set(zip(rows.tolist(), anchors.tolist()))
        assert len(pairs) == len(rows)
        assert all(syndrome(a) == 0 and (int(words[k]) ^ a).bit_count() <= radius for k, a in pairs)
        want = 0
        for k, w in enumerate(words.tolist()):
            near = {w} | {w ^ 1 << i for i in range(31)}
            for _ in range(radius - 1):
                near |= {x ^ 1 << i for x in near for i in range(31)}
            want += sum(syndrome(x) == 0 for x in near)
        assert want == len(pairs)


@pytest.mark.parametrize("tile", [4_000, 5])
def test_links_join_all_close_pairs(spark, tile):
    r = random.Random(7)
    fps = {r.getrandbits(64) for _ in range(40)}
    for base in list(fps)[:6]:
        x = base
        for _ in range(12):  # chains and dense groups
            x ^= 1 << r.randrange(64) | 1 << r.randrange(64)
            fps.add(x)
            fps.add(base ^ 1 << r.randrange(64))
    fps = sorted(fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), 4, tile)
    got = {r.node: r.root for r in simhash.components(spark, links).collect()}
    want = plain_components(fps, signed)
    groups = {}
    for s, w in zip(signed, want):
        groups.setdefault(w, set()).add(got.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_long_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)], "a bigint, b bigint")
    got = simhash.components(spark, links).collect()
    assert len(got) == 200 and {r.root for r in got} == {0}


def test_near_duplicates_frame(docs, rows, nothing):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    want = sorted((str(i), f"{f:016x}", str(c)) for (i, *_), f, c in zip(rows, fps, plain_components(fps, [r[0] for r in rows])))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert simhash.near_duplicates(nothing).count() == 0


def test_stage_keeps_one_of_each_group(spark, docs, rows):
    kept = simhash.stage(spark, docs, "").collect()
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    want = {c for c in plain_components(fps, [r[0] for r in rows]) if c is not None}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(want)
    assert set(kept[0].asDict()) == set(docs.columns)


def test_nothing_that_grows_is_broadcast(spark, monkeypatch):
    """A broadcast is built in the driver's memory, and small files may hold large tables of fingerprints."""
    plans = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    stored = simhash.common.stored
    monkeypatch.setattr(simhash.common, "stored", lambda df, name: plans.append(plan(df)) or stored(df, name))
    df = spark.createDataFrame([(k, f"a b c d e f g h {k % 7}") for k in range(40)], "doc_id bigint, text string")
    plans.append(plan(simhash.near_duplicates(df)))
    assert len(plans) > 3 and any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "BroadcastHashJoin" in p]


def test_ids_given_more_than_once_are_not_broadcast(spark):
    rows = [(k // 2, f"{k} a b c d e f g h {k * k}") for k in range(8)]
    out = simhash.stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    assert sorted(r.doc_id for r in out.collect()) == [0, 1, 2, 3]
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
