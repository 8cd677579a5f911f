"""Token counts, ORC round trip and packing against the library and brute force."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hushgrid.llm import common, packing, token_counts, token_orc

tokenizers = pytest.importorskip("tokenizers")
PATH = common.tokenizer_path("byte_bpe_50k.json")
LIBRARY = tokenizers.Tokenizer.from_file(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" '\n\tstmdrevl0\u00b2\u0301\u00a0\u2028"))))
def test_counts_any_text(text):
    assert token_counts.count_tokens([text], PATH) == [len(ids(text))]


def test_counts_survive_a_small_table():
    m = token_counts.Merger(PATH, max_states=400)
    texts = [t.encode() for t in ["thndou", " reading", "xxxxxxxxxxxxxxxx", "nationality", "qzjv", " therewith"]]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    got = m.counts(data, ends - [len(t) for t in texts], ends)
    assert got.tolist() == [len(ids(t.decode())) for t in texts]


def test_marks_do_not_depend_on_chunks():
    codes = token_counts.classes()[np.frombuffer("it's  we'll\n\n x 'rex ''s".encode("utf-32-le"), dtype=np.uint32)]
    want = token_counts.marks(codes, 4096).tolist()
    assert all(token_counts.marks(codes, c).tolist() == want for c in (1, 2, 3, 7, 16))


def test_token_counts_frame(docs, rows, nothing):
    got = token_counts.token_counts(docs).select("doc_id", "text", "n_bytes", "n_tokens", "over_limit").collect()
    assert len(got) == len(rows)
    assert all(r.n_tokens == len(ids(r.text)) and r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts.token_counts(nothing).count() == 0


def test_orc_round_trip(spark, docs, rows, nothing, tmp_path):
    path = token_orc.write(docs, f"file://{tmp_path}/ids")
    got = token_orc.manifest(spark, path).collect()
    assert len(got) == len(rows)
    by_id = {}
    for doc, text, *_ in rows:
        own = np.array([*ids(text), 2], dtype="<u4")
        by_id.setdefault(doc, []).append((len(own), zlib.crc32(own.tobytes())))
    assert all((r.n_tokens, r.ids_crc32) in by_id[r.doc_id] for r in got)
    at = 0
    for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.start)):
        assert r.start == at
        at += r.n_tokens
    assert token_orc.read(spark, path, [107]).first().tokens == [*ids(rows[-1][1]), 2]
    assert token_orc.manifest(spark, token_orc.write(nothing, f"file://{tmp_path}/none")).count() == 0


def test_boundaries_are_optimal():
    lengths, counts = np.array([1, 2, 5, 6, 9, 14]), np.array([3, 1, 4, 1, 5, 2])

    def cost(edges):
        return sum(c * (min(e for e in edges if e >= n) - n) for n, c in zip(lengths.tolist(), counts.tolist()))

    for k in range(1, 7):
        best = min(cost((*c, 14)) for c in itertools.combinations(lengths[:-1].tolist(), k - 1))
        got = packing.boundaries(lengths, counts, k)
        assert cost(got) == best and len(got) <= k and got[-1] == 14
    assert packing.boundaries(np.array([], dtype=int), np.array([], dtype=int), 4) == []


def test_packing(spark, docs, rows, nothing):
    got = packing.pack_texts(docs, budget=400, n_buckets=4).collect()
    assert len(got) == len(rows)
    assert sorted(r.n_tokens for r in got) == sorted(len(ids(t)) for _, t, *_ in rows)
    batches = {}
    for r in got:
        assert r.n_tokens <= r.boundary
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for rs in batches.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
        assert len(rs) == 1 or len(rs) * rs[0].boundary <= 400
    assert packing.pack_texts(nothing).count() == 0
    nulls = spark.createDataFrame([(1, None), (1, None)], "doc_id bigint, n_tokens int")
    assert [r.n_tokens for r in packing.pack(nulls).collect()] == [0, 0]


def test_one_long_document_does_not_move_the_other_boundaries(spark):
    lengths = [(k, 10 + k % 90) for k in range(900)]
    want = {r.doc_id: r.boundary for r in packing.pack(spark.createDataFrame(lengths, "doc_id bigint, n_tokens bigint"), n_buckets=7).collect()}
    got = {r.doc_id: r.boundary for r in packing.pack(spark.createDataFrame([*lengths, (-1, 4_000_000)], "doc_id bigint, n_tokens bigint"), n_buckets=8).collect()}
    assert got.pop(-1) == 4_000_000 and got == want


def test_boundaries_by_halves_equal_every_split():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 60):
        lengths, counts = np.sort(rng.choice(400, n, replace=False)) + 1, rng.integers(1, 9, n)
        for k in (1, 2, 5, 16):
            best = [0] + [int((counts[:j] * (lengths[j - 1] - lengths[:j])).sum()) for j in range(1, n + 1)]
            for _ in range(k - 1):
                best = [0] + [min(best[i] + int((counts[i:j] * (lengths[j - 1] - lengths[i:j])).sum()) for i in range(j)) for j in range(1, n + 1)]
            edges = packing.boundaries(lengths, counts, k)
            assert sum(int(c) * (min(e for e in edges if e >= x) - int(x)) for x, c in zip(lengths.tolist(), counts.tolist())) == best[n]


def test_lengths_encode_a_piece_once(monkeypatch):
    texts = ["", "The old market, the old market's 1234 doors", "Größe \U0001f600 naïve\n\n  x", "before<|endoftext|> after", "a" * 700 + " qzjv"]
    texts += [LIBRARY.get_added_tokens_decoder()[k].content + " behind" for k in list(LIBRARY.get_added_tokens_decoder())[:2]]
    e = token_orc.Encoder(PATH)
    want = [len(ids(t)) for t in texts]
    assert e.count(texts).tolist() == want
    monkeypatch.setattr(e, "single", None)  # all pieces are known by now
    assert e.count(texts).tolist() == want
    assert token_orc.Encoder(PATH, max_cached=3).count(texts[:3]).tolist() == want[:3]


@pytest.mark.parametrize("text", ["'" * 700, "'r" * 350, "x" * 700, "!" * 300 + "'" * 300 + "ll", "it's " * 90 + "'" * 200 + "ve 1"])
def test_marks_of_chunks_whose_states_do_not_meet(text):
    codes = token_counts.classes()[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)]
    assert token_counts.marks(codes, 32).tolist() == token_counts.marks(codes, 10_000).tolist()
    assert token_orc.encoder(PATH).count([text]).tolist() == [len(ids(text))]
