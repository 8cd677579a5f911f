"""Token counts by finite-state transducers compiled from a byte-level BPE vocabulary.

Two deterministic transducers, one above the other:

* The *splitter* reads character classes and marks where the pre-tokenizer starts a piece. It has ten
  states. Texts are cut into chunks of equal length; each chunk's map (start state -> end state) is
  computed for all start states at once, the maps are composed by a parallel prefix scan, and a second
  pass with the known start states emits the marks.
* The *merger* reads the bytes of one piece; every transition is annotated with the change in the number
  of tokens. Its state holds, for each place at which a later token could still begin, the last token and
  the token count up to there, so it is finite; states are determinised when first met and kept in a
  hash table that is emptied when it is full. Each piece starts in the start state, so a chunk's map is
  constant there and composition is addition.

Exact: equal to the tokenizers library's count, which the tests hold it against. Special strings inside
a text count one token each, as the library does by default.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# character classes
LETTER, C1, CR, CV, CL, CE, NUMBER, SPACE, WHITE, APOS, OTHER, STOP = range(12)
# splitter states
START, IN_L, IN_N, IN_O, IN_SP, IN_WS, AP, AP_R, AP_V, AP_L = range(10)
#: marks: bit 0 a piece starts at this character, bit 1 one starts at the character before
HERE, BEFORE = 1, 2
#: in place of a rank: no such merge; in place of a token: none can begin here
NEVER, GONE = 1 << 30, -2
#: so many longer tokens are tried when a place is tested for use; a bound on work that leaves counts as they are
LOOK = 16


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks for each (state, class)."""
    nxt = np.zeros((10, 12), dtype=np.uint8)
    out = np.zeros((10, 12), dtype=np.uint8)
    letters = (LETTER, C1, CR, CV, CL, CE)
    kind = {**{c: IN_L for c in letters}, NUMBER: IN_N, SPACE: IN_SP, WHITE: IN_WS, APOS: IN_O, OTHER: IN_O}
    for state in range(10):
        for cls in range(12):
            if cls == STOP:  # between texts: any piece ends
                nxt[state, cls] = START
                out[state, cls] = HERE | (BEFORE if state in (AP_R, AP_V, AP_L) else 0)
                continue
            to, mark = kind[cls], HERE
            if state == IN_L and to == IN_L or state == IN_N and to == IN_N or state == IN_O and to == IN_O:
                mark = 0
            elif state in (IN_SP, IN_WS):
                if to in (IN_SP, IN_WS):
                    mark = 0
                else:  # the last white-space character leaves its run; a plain space joins what follows
                    mark = BEFORE | (HERE if state == IN_WS else 0)
            elif state == AP:
                if to == IN_O:
                    mark = 0
                elif cls == C1:
                    to, mark = START, 0
                elif cls in (CR, CV, CL):
                    to, mark = {CR: AP_R, CV: AP_V, CL: AP_L}[cls], 0
            elif state in (AP_R, AP_V, AP_L):
                if cls == (CL if state == AP_L else CE):
                    to, mark = START, 0
                else:  # no contraction: the letter begins a piece of its own
                    mark = BEFORE | (0 if to == IN_L else HERE)
            if cls == APOS and mark & HERE and not (state == IN_SP):
                to = AP
            nxt[state, cls], out[state, cls] = to, mark
    return nxt, out


#: Steps after which chunks whose start states have met are told from the others.
LEAD = 16

#: White_Space code points of Unicode; fixed values.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point."""
    cls = np.full(0x110000, OTHER, dtype=np.uint8)
    for cp in range(0x110000):
        cat = unicodedata.category(chr(cp))[0]
        if cat == "L":
            cls[cp] = LETTER
        elif cat == "N":
            cls[cp] = NUMBER
    cls[WHITE_SPACE] = WHITE
    cls[32], cls[39] = SPACE, APOS
    for text, k in (("stmd", C1), ("r", CR), ("v", CV), ("l", CL), ("e", CE)):
        cls[[ord(c) for c in text]] = k
    return cls


def marks(codes: np.ndarray, chunk: int = 128) -> np.ndarray:
    """Marks of piece starts, by chunk state maps and a prefix scan over them. Ends with one STOP."""
    nxt, out = splitter()
    n = len(codes)
    k = max(1, -(-n // chunk))
    grid = np.full(k * chunk, STOP, dtype=np.uint8)
    grid[:n] = codes
    grid = np.ascontiguousarray(grid.reshape(k, chunk).T)  # one row for each step
    flat = nxt.reshape(-1)
    state = np.repeat(np.arange(10, dtype=np.uint8)[:, None], k, axis=1)  # all start states of all chunks
    for step in grid[:LEAD]:
        state = flat[state * np.uint8(12) + step]
    # most chunks have one state by now, whatever they began in; the others go on with all of them
    met = (state == state[0]).all(axis=0)
    some, rest = np.flatnonzero(~met), np.flatnonzero(met)
    several, single = state[:, some], state[0, rest]
    for step in grid[LEAD:]:
        several = flat[several * np.uint8(12) + step[some]]
        single = flat[single * np.uint8(12) + step[rest]]
    state[:, some], state[:, rest] = several, single
    # inclusive scan: composed[s, i] is where state s at the very start has gone by the end of chunk i
    composed, reach = state, 1
    while reach < k:
        after = composed.copy()
        after[:, reach:] = np.take_along_axis(composed[:, reach:], composed[:, :-reach], axis=0)
        composed, reach = after, reach * 2
    begin = np.empty(k, dtype=np.uint8)
    begin[0] = START
    begin[1:] = composed[START, :-1]
    got = np.empty((chunk, k), dtype=np.uint8)
    emit = out.reshape(-1)
    for i, step in enumerate(grid):
        key = begin * np.uint8(12) + step
        got[i] = emit[key]
        begin = flat[key]
    return got.T.reshape(-1)[:n]


class Merger:
    """The byte transducer of a BPE vocabulary, determinised as it is used.

    ``max_states`` bounds the table (a few hundred bytes a state). When it is full, it is emptied and filled
    anew; counts do not depend on that.
    """

    def __init__(self, path: str, max_states: int = 160_000):
        model = json.load(open(path, encoding="utf-8"))
        alphabet = byte_alphabet()
        vocab = {bytes(alphabet[c] for c in t): i for t, i in model["model"]["vocab"].items() if all(c in alphabet for c in t)}
        self.ids, self.texts = vocab, {i: t for t, i in vocab.items()}
        self.ranks: dict[tuple[int, int], int] = {}
        self.made, self.halves = dict.fromkeys(self.texts, -1), {}
        for r, m in enumerate(model["model"]["merges"]):
            a, b = (bytes(alphabet[c] for c in x) for x in (m.split(" ") if isinstance(m, str) else m))
            self.ranks[vocab[a], vocab[b]] = r
            if self.made[to := vocab[a + b]] < 0:
                self.made[to], self.halves[to] = r, (vocab[a], vocab[b])
        self.sorted = sorted(vocab)
        self.prefixes = {t[:k] for t in vocab for k in range(1, len(t))}
        #: tokens that merging their own bytes gives: both halves are, and nothing merges across them earlier
        self.reachable = {i for i in self.texts if self.made[i] < 0}
        for i in sorted(self.halves, key=self.made.get):
            a, b = self.halves[i]
            if a in self.reachable and b in self.reachable and self.apart_until(a, b, self.made[i]):
                self.reachable.add(i)
        self.specials = [t["content"] for t in model["added_tokens"]]
        self.max_states = max_states
        self.fits: dict[int, bool] = {}
        self.open: dict[tuple[int, bytes], bool] = {}
        self.reset()

    def apart_until(self, left: int, right: int, rank: int) -> bool:
        """Whether ``left`` and ``right`` form and first meet in the merge of that rank."""
        limit = NEVER
        while True:
            if self.ranks.get((left, right), NEVER) < min(limit, rank):
                return False
            made_left, made_right = self.made[left], self.made[right]
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:
                limit, left = made_left, self.halves[left][1]
            else:
                limit, right = made_right + 1, self.halves[right][0]

    def reset(self) -> None:
        self.keys: list[tuple] = [(b"", ((-1, 0),))]
        self.index = {self.keys[0]: 0}
        self.used = 0
        self.grow(16)

    def grow(self, bits: int) -> None:
        """A hash table of 2**bits places from (state, byte) to (target, change of the count)."""
        old = None if bits == 16 else (self.where, self.what)
        self.bits = bits
        self.where = np.full(1 << bits, -1, dtype=np.int64)
        self.what = np.full(1 << bits, -1, dtype=np.int32)
        if old is not None:
            keys, values = old[0][old[0] >= 0], old[1][old[0] >= 0]
            at = self.slots(keys)
            while len(keys):
                free = self.where[at] < 0
                first = np.unique(np.where(free, at, -1), return_index=True)[1]
                first = first[free[first]]
                self.where[at[first]], self.what[at[first]] = keys[first], values[first]
                left = np.ones(len(keys), dtype=bool)
                left[first] = False
                keys, values, at = keys[left], values[left], at[left]
                at = np.where(self.where[at] >= 0, (at + 1) & ((1 << bits) - 1), at)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Packed target and change for each key; -1 where not yet known."""
        at = self.slots(keys)
        there = self.where[at]
        got = self.what[at]
        off = np.flatnonzero((there != keys) & (there >= 0))
        while len(off):
            at[off] = (at[off] + 1) & ((1 << self.bits) - 1)
            there = self.where[at[off]]
            got[off] = self.what[at[off]]
            off = off[(there != keys[off]) & (there >= 0)]
        return got

    def put(self, key: int, value: int) -> None:
        mask = (1 << self.bits) - 1
        at = ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while self.where[at] >= 0:
            at = (at + 1) & mask
        self.where[at], self.what[at] = key, value
        self.used += 1
        if self.used * 2 > 1 << self.bits:
            self.grow(self.bits + 1)

    def follows(self, last: int, token: int) -> bool:
        """Whether merging leaves ``last`` and ``token`` side by side as they are (last -1: the piece's start).

        Merges are undone from the border outwards, the latest first. The two stay apart unless the tokens
        then at the border merge before the merge just undone; of equal merges the left one comes first.
        """
        if last < 0:
            return token in self.reachable
        key = (last << 20) | token
        if (found := self.fits.get(key)) is None:
            left, right, limit, found = last, token, NEVER, True
            while True:
                if self.ranks.get((left, right), NEVER) < limit:
                    found = False
                    break
                made_left, made_right = self.made[left], self.made[right]
                if made_left < 0 and made_right < 0:
                    break
                if made_left > made_right:
                    limit, left = made_left, self.halves[left][1]
                else:
                    limit, right = made_right + 1, self.halves[right][0]
            found = found and token in self.reachable
            if len(self.fits) > 200_000:
                self.fits.clear()
            self.fits[key] = found
        return found

    def alive(self, last: int, text: bytes) -> bool:
        """Whether some longer token that begins with ``text`` may follow ``last``; true where that is long to tell."""
        key = (last, text)
        if (found := self.open.get(key)) is None:
            k = bisect_right(self.sorted, text)
            found = self.sorted[min(k + LOOK, len(self.sorted) - 1)].startswith(text)
            while not found and k < len(self.sorted) and self.sorted[k].startswith(text):
                if self.follows(last, self.ids[self.sorted[k]]):
                    found = True
                k += 1
            if len(self.open) > 100_000:
                self.open.clear()
            self.open[key] = found
        return found

    def step(self, state: int, byte: int) -> bool:
        """Determinise one transition; false if the table is full."""
        window, past = self.keys[state]
        text = window + bytes([byte])
        n = len(text)
        last = count = None
        for k in range(n):  # the longest token first
            token = self.ids.get(text[k:])
            if token is not None and past[k][0] != GONE and self.follows(past[k][0], token):
                last, count = token, past[k][1] + 1
                break
        entries, keep = [], n
        for k, (t, c) in enumerate(past):  # only places from which a later token can still begin
            if t != GONE and text[k:] in self.prefixes and self.alive(t, text[k:]):
                entries.append((t, c - count))
                keep = min(keep, k)
            else:
                entries.append((GONE, 0))
        key = (text[keep:], (*entries[keep:], (last, 0)))
        if (to := self.index.get(key)) is None:
            if len(self.keys) >= self.max_states:
                return False
            to = self.index[key] = len(self.keys)
            self.keys.append(key)
        self.put(state << 8 | byte, to << 8 | count + 128)
        return True

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each piece data[start:end], all pieces in step."""
        total = np.zeros(len(starts), dtype=np.int64)
        order = np.argsort(starts - ends, kind="stable")  # longest first: the live pieces are a prefix
        at, stop = starts[order].astype(np.int64), ends[order]
        length = stop - at
        live = len(order)
        state = np.zeros(live, dtype=np.int64)
        k = 0
        sums = np.zeros(live, dtype=np.int64)
        while live:
            live = int(np.searchsorted(-length, -k, side="left"))  # pieces longer than k
            if not live:
                break
            key = state[:live] * 256 + data[at[:live] + k]
            got = self.find(key)
            if (got < 0).any():
                for miss in np.unique(key[got < 0]).tolist():
                    if not self.step(miss >> 8, miss & 255):
                        kept = [self.keys[s] for s in np.unique(state[:live]).tolist()]
                        if len(kept) + 257 > self.max_states:  # more live states than a table holds: halve the pieces
                            half = len(starts) // 2
                            return np.concatenate([self.counts(data, starts[:half], ends[:half]), self.counts(data, starts[half:], ends[half:])])
                        old = np.unique(state[:live])
                        self.reset()
                        renamed = np.zeros(int(old.max()) + 1, dtype=np.int64)
                        for o, key_ in zip(old.tolist(), kept):
                            if (new := self.index.get(key_)) is None:
                                new = self.index[key_] = len(self.keys)
                                self.keys.append(key_)
                            renamed[o] = new
                        state[:live] = renamed[state[:live]]
                        break
                continue
            sums[:live] += (got & 255) - 128
            state[:live] = got >> 8
            k += 1
        total[order] = sums
        return total


@lru_cache(maxsize=1)
def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


def piece_starts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece starts over all texts in order: code-point offset, byte offset, number of the text.

    Offsets are into the texts laid end to end with one NUL between; the NULs' own entries are left out.
    """
    joined = "\0".join(texts) + "\0"
    code = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    stops = np.cumsum(lengths + 1) - 1
    cls = classes()[code]
    cls[stops] = STOP
    got = marks(cls)
    starts = (got & HERE) > 0
    starts[:-1] |= (got[1:] & BEFORE) > 0
    wide = 1 + (code >= 0x80).astype(np.int8) + (code >= 0x800) + (code >= 0x10000)
    offset = np.cumsum(wide, dtype=np.int64) - wide
    where = np.flatnonzero(starts)
    owner = np.searchsorted(stops, where, side="left")
    return where, offset[where], owner


def count_tokens(texts: list[str | None], path: str, group_chars: int = 1_000_000) -> list[int]:
    """Tokens of each text; null counts as empty. Texts are taken in groups so that memory stays bounded."""
    m = merger(path)
    out = np.zeros(len(texts), dtype=np.int64)
    special = re.compile("|".join(map(re.escape, m.specials))) if m.specials else None
    pieces: list[str] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if pieces:
            joined = np.frombuffer(("\0".join(pieces) + "\0").encode("utf-8"), dtype=np.uint8)
            where, byte, owner = piece_starts(pieces)
            end = np.append(byte[1:], len(joined))
            ends_text = np.cumsum([len(p) + 1 for p in pieces]) - 1
            real = where != ends_text[owner]  # not the NUL that ends a text
            n = m.counts(joined, byte[real], end[real])
            np.add.at(out, np.asarray(owners)[owner[real]], n)
        pieces.clear()
        owners.clear()
        size = 0

    for k, text in enumerate(texts):
        if not text:
            continue
        parts = [text]
        if special and special.search(text):
            out[k] += len(special.findall(text))
            parts = special.split(text)
        for part in parts:
            if part:
                pieces.append(part)
                owners.append(k)
                size += len(part)
        if size >= group_chars:
            flush()
    flush()
    return out.tolist()


def token_count(text: Column, vocabulary: str = "byte_bpe_50k.json", folder: str | None = None) -> Column:
    """Number of tokens of a text column (null: 0), as the library for that vocabulary counts them."""

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        return common.by_parts(lambda part: pa.array(count_tokens(part.to_pylist(), common.tokenizer_path(vocabulary, folder)), type=pa.int64()))(texts)

    return count(text)


def token_counts(docs: DataFrame, text_col: str = "text", limit: int = 1024, **where) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (n_tokens > limit); a column of such a name is replaced.

    Null texts count as empty: 0 bytes, 0 tokens. An empty table gives an empty table. Repeated rows are
    counted each.
    """
    n = token_count(F.col(text_col), **where)
    out = docs.withColumns({"n_bytes": F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long"), "n_tokens": n})
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")
