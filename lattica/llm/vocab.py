"""Exact tokenizer ids with a bounded cache of pre-token groups.

A text is cut only where the vocabulary's own pre-tokenizer cuts, so the ids of
a text are those of its pieces in order, and each distinct piece is encoded by
the tokenizer only once while it stays in the cache.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from itertools import chain

import numpy as np

from .textblocks import prefix_sums, span_hash

#: White space as the tokenizers' own patterns see it.
SPACE = " \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_KEEPING = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
_DROPPING = re.compile(f"[^{SPACE}]+").findall
#: Letters of which every neighbour in an "ordinary" text is known to be a letter or not.
_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_UNUSUAL = re.compile(f"[^\\x00-\\x1b\\x20-\\x7f{_LETTER}]").search
_KEEPING_FINE = re.compile(f"[{SPACE}]*(?:[{_LETTER}]+|[^{SPACE}{_LETTER}]+(?:(?<=')[{_LETTER}]+)?)|[{SPACE}]+").findall
_DROPPING_FINE = re.compile(f"[{_LETTER}]+|[^{SPACE}{_LETTER}]+(?:(?<=')[{_LETTER}]+)?").findall
_PLAIN = re.compile("[a-z\xdf-\xf6\xf8-\xff]+").fullmatch
#: Pieces of one generation; two generations are held.
CACHE_PIECES = 300_000
#: Pieces of the table by hash (some 30 bytes each).
TABLE_PIECES = 3_000_000


def keeping(text: str) -> list[str]:
    """Pieces for byte-level vocabularies: a run of letters or of other signs, with the space before it.

    Between a letter and another sign there is always a cut of the vocabulary's
    own pattern, except after an apostrophe (contractions), which therefore
    keeps its letters. Texts with characters beyond Latin-1 letters are only
    cut before white space.
    """
    return (_KEEPING if _UNUSUAL(text) else _KEEPING_FINE)(text)


def dropping(text: str) -> list[str]:
    """Pieces for vocabularies that lower-case and drop white space."""
    return _DROPPING(text) if _UNUSUAL(text) else _DROPPING_FINE(text.lower())


class Encoder:
    """Ids of whole texts by the ``tokenizers`` library.

    ``drops_space`` says whether the vocabulary ignores white space (as those
    with word-end marks do) or keeps it in the tokens (byte-level ones).
    """

    def __init__(self, path: str, drops_space: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.pieces = dropping if drops_space else keeping
        #: For pieces of lower-case letters alone: the same model without the steps that leave them as they are.
        self.lean = Tokenizer.from_file(path) if drops_space else None
        if self.lean:
            self.lean.normalizer = normalizers.Sequence([])
            self.lean.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: Pieces met lately, and those met before; pieces move to the first when met again.
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._reset()

    def _learn(self, missing: list[str]) -> None:
        new = []
        for piece in missing:
            if (got := self.older.get(piece)) is None:
                new.append(piece)
            else:
                self.cache[piece] = got
        plain = [p for p in new if _PLAIN(p)] if self.lean else []
        self._encode_new(self.lean, plain)
        self._encode_new(self.tokenizer, [p for p in new if not _PLAIN(p)] if self.lean else new)

    def _encode_new(self, tokenizer, new: list[str]) -> None:
        for i in range(0, len(new), 10_000):
            part = new[i : i + 10_000]
            for got, piece in zip(tokenizer.encode_batch_fast(part, add_special_tokens=False), part):
                self.cache[piece] = array("I", got.ids).tobytes()

    def encode_cut(self, texts: list[str]) -> list[bytes]:
        """Ids of each text (little-endian, 32 bit), by way of the dictionary of pieces."""
        pieces = [self.pieces(t) for t in texts]
        known = set().union(*pieces)
        if len(self.cache) > CACHE_PIECES:
            self.older, self.cache = self.cache, {}
        self._learn(list(known.difference(self.cache)))
        get = self.cache.__getitem__
        return [b"".join(map(get, p)) for p in pieces]


    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text.

        Texts of ASCII and Latin-1 letters are cut and looked up all at once:
        pieces are hashed (64 bit, with their length) in one array, and only
        pieces that the table has not seen are encoded.
        """
        raw = [t.encode() for t in texts]
        data = b"\0".join(raw) + b"\0"
        buf = np.frombuffer(data, np.uint8)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(sizes + 1) - 1
        first = ends - sizes
        odd = _odd_bytes(buf, ends)
        other = np.unique(np.searchsorted(ends, np.flatnonzero(odd)))
        if len(other):
            slow = dict(zip(other.tolist(), self.encode_cut([texts[i] for i in other.tolist()])))
            usual = [i for i in range(len(texts)) if i not in slow]
            for i, got in zip(usual, self.encode([texts[i] for i in usual]) if usual else []):
                slow[i] = got
            return [slow[i] for i in range(len(texts))]
        start, end, buf = _cut(buf, ends, self.lean is not None)
        h = span_hash(prefix_sums(buf), start, end)
        kinds, at, which = np.unique(h, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, kinds), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[place] != kinds) if len(self.keys) else np.arange(len(kinds))
        if len(new):
            if len(self.keys) + len(new) > TABLE_PIECES:
                self._reset()
                new = np.arange(len(kinds))
            view = buf.tobytes()
            missing = [view[a:b].decode() for a, b in zip(start[at[new]].tolist(), end[at[new]].tolist())]
            self._insert(kinds[new], self._ids_of(missing))
            place = np.searchsorted(self.keys, kinds)
        count = self.counts[place][which]
        total = np.cumsum(count)
        begin = total - count
        ids = self.flat[np.repeat(self.offsets[place][which] - begin, count) + np.arange(total[-1] if len(total) else 0)]
        bounds = np.append(0, total)[np.searchsorted(start, np.append(first, len(buf)))].tolist()
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]

    def _reset(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.counts, self.offsets, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u4")

    def _ids_of(self, pieces: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(pieces)
        plain = [i for i, p in enumerate(pieces) if self.lean and _PLAIN(p)]
        rest = [i for i, p in enumerate(pieces) if not (self.lean and _PLAIN(p))]
        for tokenizer, own in ((self.lean, plain), (self.tokenizer, rest)):
            for k in range(0, len(own), 20_000):
                part = own[k : k + 20_000]
                for i, got in zip(part, tokenizer.encode_batch_fast([pieces[i] for i in part], add_special_tokens=False)):
                    out[i] = got.ids
        return out

    def _insert(self, keys: np.ndarray, ids: list[list[int]]) -> None:
        """Add pieces to the sorted table."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        offsets = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), "<u4", int(sizes.sum()))])
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.counts = np.insert(self.counts, where, sizes)
        self.offsets = np.insert(self.offsets, where, offsets)


_KIND = np.full(256, 2, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[65:91] = _KIND[97:123] = 1
_KIND[0xC3] = 1
_ODD = np.zeros(256, bool)
_ODD[0x1C:0x20] = _ODD[0x80:] = True
_ODD[0] = True


def _odd_bytes(buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bytes other than ASCII and the two of a Latin-1 letter. ``ends`` are the places of the marks between texts."""
    odd = _ODD[buf]
    odd[ends] = False
    lead = np.flatnonzero(buf == 0xC3)
    if len(lead):
        second = buf[lead + 1]
        good = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
        odd[lead[good]] = False
        odd[lead[good] + 1] = False
    return odd


def _cut(buf: np.ndarray, ends: np.ndarray, drops_space: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces, as ``keeping`` or ``dropping`` cut them, and the (lower-cased) text."""
    kind = _KIND[buf]
    lead = np.flatnonzero(buf == 0xC3)
    kind[lead + 1] = 1
    kind[ends] = 3
    if drops_space:
        low = buf.copy()
        upper = (low >= 65) & (low <= 90)
        low[upper] += 32
        second = low[lead + 1]
        low[lead[second <= 0x9E] + 1] += 0x20
        buf = low
    before = np.append(np.uint8(3), kind[:-1])
    solid = (kind == 1) | (kind == 2)
    turns = solid & ((before == 1) | (before == 2)) & (before != kind)
    turns[1:] &= ~((kind[1:] == 1) & (buf[:-1] == 39))
    if drops_space:
        begins = turns | (solid & ((before == 0) | (before == 3)))
        inside = solid
    else:
        inside = kind != 3
        begins = turns | ((kind == 0) & (before != 0)) | (inside & (before == 3))
    start = np.flatnonzero(begins)
    after = np.append(begins[1:], True) | np.append(~inside[1:], True)
    return start, np.flatnonzero(inside & after) + 1, buf


_encoders: dict[tuple[str, bool], Encoder] = {}


if array("I").itemsize != 4 or sys.byteorder != "little":
    raise ImportError("ids are kept as little-endian 32-bit integers")


def encoder(path: str, drops_space: bool = False) -> Encoder:
    """One encoder for each vocabulary and worker process."""
    if (path, drops_space) not in _encoders:
        _encoders[path, drops_space] = Encoder(path, drops_space)
    return _encoders[path, drops_space]


def groups(texts: list[str], limit: int = 1 << 20) -> list[list[str]]:
    """Consecutive texts of about ``limit`` characters together."""
    out: list[list[str]] = []
    held = limit
    for t in texts:
        if held >= limit:
            out.append([])
            held = 0
        out[-1].append(t)
        held += len(t)
    return out
