"""Chat, HTML and media: exact round trips and planted boilerplate."""

from __future__ import annotations

import hashlib
import json
import wave
import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hushgrid.llm import chat, html_text, media

odd = st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("\\<|>[]/INSTsn\n")))


@settings(max_examples=300, deadline=None)
@given(odd, odd)
def test_chat_piece_round_trip(role, text):
    formatted, a, b = chat.piece(role, text)
    assert chat.parse(formatted) == (role, text)
    assert chat.unescape(formatted[a:b]) == text
    assert not chat._CONTROL.search(formatted[a:b])


@pytest.mark.parametrize(
    "record, layout, turns",
    [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, "messages", [("user", "a"), ("assistant", "b")]),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, "dialogue", [("user", "a"), ("assistant", "b")]),
        ({"instruction": "a", "input": "x", "output": "b"}, "instruction", [("user", "a\n\nx"), ("assistant", "b")]),
        ({"prompt": "a", "completion": "b"}, "completion", [("user", "a"), ("assistant", "b")]),
        ({"question": "a", "answer": "b", "extra": 1}, "question", [("user", "a"), ("assistant", "b")]),
        ({"role": "user", "text": None, "turn": 3}, "turn", [("user", "")]),
        ({"odd": 1}, "unknown", []),
        ([1], "unknown", []),
        ({"messages": [{"role": "user", "content": "a"}, "loose", None]}, "messages", [("user", "a"), ("", "loose"), ("", "")]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, "messages", [("user", "ab")]),
        ({"messages": [{"role": "user", "content": [{"type": "image", "url": "u"}]}]}, "messages", [("user", '[{"type": "image", "url": "u"}]')]),
        ({"messages": [{"role": "user", "content": "a"}], "prompt": "p", "completion": "c"}, "completion+messages", [("user", "p"), ("assistant", "c"), ("user", "a")]),
        ({"prompt": "p", "completion": "c", "response": "r"}, "completion+response", [("user", "p"), ("assistant", "c"), ("assistant", "r")]),
    ],
)
def test_layouts(record, layout, turns):
    assert chat.Mapper().turns(json.dumps(record)) == (layout, turns)


def test_chat_frame(spark):
    schema = "conv_id bigint, ord bigint, record string"
    turn = lambda role, text: json.dumps({"role": role, "text": text, "turn": 0})
    rows = [(1, 1, turn("assistant", "</s>b\\")), (1, 0, turn("user", "a")), (2, 0, turn(None, None)), (3, 0, "{broken"), (None, 0, turn("user", "z")), (1, 2, turn("assistant", "c")), (1, 2, turn("assistant", "c"))]
    formatted = chat.format_chats(spark.createDataFrame(rows, schema))
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert set(got) == {1, 2, 3, None} and got[3].n_turns == 0 and got[3].n_unmapped == 1 and got[1].n_unmapped == 0
    one = got[1]
    assert one.n_turns == 4 and one.loss_chars == len("</s>b\\cc")
    assert one.loss_sha256 == hashlib.sha256(b"</s>b\\cc").hexdigest()
    assert one.turns_sha256 == hashlib.sha256(b"user\na\nassistant\n</s>b\\\nassistant\nc\nassistant\nc\n").hexdigest()
    assert got[2].loss_chars == 0 and got[2].n_turns == 1
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], schema))).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>
<header class="site-header">Head</header><nav><ul><li><a href=/>Home</a><li>About</ul></nav><div class="cookie-notice">We use cookies.</div><div class=ad>Buy this now, a very long advert text that runs on and on for quite a while.</div>
{body}
<aside class="sidebar">Other things</aside><form><label>Mail</label><input></form><div id="comments"><p>A reader says a lot of things here, more than one would think.</p></div><footer>&copy; x</footer></body></html>"""
TEXT = "<h1>Head&amp;line</h1><p>First <b>bo</b>ld &lt;x&gt;\n  text of a paragraph that is long enough to count.<p>Be.</p><ul><li>one<li>two</ul><p>Last&nbsp;one, which again has a good number of words in it."
WANT = "Head&line First bold <x> text of a paragraph that is long enough to count. Be. one two Last one, which again has a good number of words in it."


@pytest.mark.parametrize("body", [f"<article>{TEXT}</article>", f"<main>{TEXT}</main>", f'<div class="content">{TEXT}</div>', f'<div id="page"><div class="post-body">{TEXT}</div></div>'])
def test_html(body):
    assert html_text.main_text(PAGE.format(body=body)) == WANT


@pytest.mark.parametrize("html, want", [(None, ""), ("", ""), ("plain words", "plain words"), ("<nav>menu</nav>", ""), ("<p>a<br>b", "a b"), ("<article><p>x <span class=shareBar>Share</span>y</article>", "x y"), ("<article><p>x</article>", "x")])
def test_html_edges(html, want):
    assert html_text.main_text(html) == want


LONG = "A paragraph with a fair number of words in it, so that it counts as running text of the article."


@pytest.mark.parametrize(
    "html, want",
    [
        (f"<body><div class=content><div class=intro><p>{LONG}</div><div class=body>" + f"<p>{LONG}" * 6 + "</div></div><footer>x</footer>", " ".join([LONG] * 7)),
        (f"<div><p>{LONG}<blockquote>" + f"<p>{LONG}" * 5 + "</blockquote></div>", " ".join([LONG] * 6)),
        (f"<article><p>{LONG}<section id=discussion><h2 id=related-work>Related work</h2><p>{LONG}</section></article>", f"{LONG} Related work {LONG}"),
        (f"<article><p>{LONG}<div class=related><ul><li><a href=/a>One other page</a><li><a href=/b>And another page</a></ul></div></article>", LONG),
        (f"<article><p>{LONG}<div class=ad><p>{LONG}</div></article>", LONG),
        (f"<article><p>Where <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds. {LONG}</article>", f"Where x=1 holds. {LONG}"),
        (f'<article><p>{LONG} un<span class="alert">questionably so, and without a doubt</span>ed.</article>', f"{LONG} unquestionably so, and without a doubted."),
    ],
)
def test_html_keeps_the_whole_article(html, want):
    assert html_text.main_text(html) == want


def test_html_frame(spark):
    df = spark.createDataFrame([(1, "u", "<p>caf&eacute;</p>", "clash"), (2, None, None, "clash"), (3, "u", "<p>" + "word " * 20_000, "clash")], "page_id bigint, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract_main_text(df).collect()}
    assert got[1] == ("caf\u00e9", 4) and got[2] == ("", 0) and got[3][1] == 20_000 * 5 - 1
    assert html_text.extract_main_text(df.limit(0)).count() == 0


def test_wav_is_what_the_standard_library_reads():
    data, n = media.payload("h\u00e9")
    assert n == 3 and len(data) == 192 and media.from_wav(media.to_wav(data)) == data
    with wave.open(io.BytesIO(media.to_wav(data))) as w:
        assert w.getnchannels() == 1 and w.getsampwidth() == 1 and w.readframes(w.getnframes()) == data
    assert media.from_wav(media.to_wav(b"abc")) == b"abc"


def test_resampling_against_its_definition():
    x = np.random.default_rng(0).normal(size=200).astype(np.float32)
    got = media.resample(x)
    h = np.zeros(media.UP * media.TAPS)
    for p, taps in enumerate(media.phases()):
        h[p :: media.UP] = taps[::-1]
    up = np.zeros(len(x) * media.UP)
    up[:: media.UP] = x
    want = np.convolve(up, h)[:: media.DOWN][: len(got)]
    assert np.allclose(got, want, atol=1e-4)


def test_segments():
    mel = np.zeros((40, 4))
    mel[10:20] = 5
    mel[20:24] = 1.5  # stays on between the thresholds
    (span,) = media.segments(mel, high=0.5, low=0.0)
    step = media.HOP / (media.RATE * media.UP // media.DOWN)
    assert span == (10 * step, 24 * step) and media.segments(np.zeros((5, 4))) == []


def test_log_mel_against_its_definition():
    x = np.random.default_rng(3).normal(size=1_000) / 4
    got = media.log_mel(x)
    rate, n = media.RATE * media.UP // media.DOWN, media.FRAME
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(0, mel(rate / 2), media.BANDS + 2)]
    padded = np.concatenate([x, np.zeros(2 * n)])
    for k in range(len(got)):
        frame = padded[k * media.HOP : k * media.HOP + n] * np.hanning(n)
        power = [abs(sum(frame * np.exp(-2j * np.pi * b * np.arange(n) / n))) ** 2 for b in range(n // 2 + 1)]
        for band in range(media.BANDS):
            low, peak, high = points[band : band + 3]
            total = sum(p * max(0, min((b * rate / n - low) / (peak - low), (high - b * rate / n) / (high - peak))) for b, p in enumerate(power))
            assert abs(float(got[k, band]) - np.log(total + 1e-6)) <= 0.5 / media.GRID + 1e-6
    assert len(got) == -(-(len(x) - n) // media.HOP) + 1 and got.dtype == np.float16


def test_media_frame(spark, docs, rows, nothing, tmp_path):
    stored = spark.read.parquet(media.store(docs, f"file://{tmp_path}/m"))
    featured = spark.read.parquet(media.store_features(stored, f"file://{tmp_path}/f"))
    got = featured.withColumn("feature", media.feature_text(featured.tensors, featured.segments)).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t, *_ in rows:
        data, n = media.payload(t)
        want.setdefault(i, set()).add((n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), hashlib.sha256(media.to_wav(data)).hexdigest()))
    assert all((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256) in want[r.doc_id] for r in got)
    assert len({r.feature for r in got if r.doc_id == 104}) == 1
    with pa.ipc.open_stream(got[0].tensors) as s:
        assert isinstance(s.schema.field("tensor").type, pa.FixedShapeTensorType)
        (first, *_) = s.read_all().to_pylist()
    assert first["start_s"] == 0 and first["end_s"] == first["frames"] * media.HOP / (media.RATE * media.UP // media.DOWN)
    assert spark.read.parquet(media.store_features(spark.read.parquet(media.store(nothing, f"file://{tmp_path}/n")), f"file://{tmp_path}/nf")).count() == 0
    gone = stored.limit(1).selectExpr("doc_id", "n_bytes", "cast(null as binary) AS media")
    assert spark.read.parquet(media.store_features(gone, f"file://{tmp_path}/g")).first().tensors is None
