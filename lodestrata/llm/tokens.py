"""Token ids of many texts, by the ``tokenizers`` library, with each distinct piece encoded once.

A byte-level BPE with the usual pre-tokenisation pattern splits a text into
pieces and encodes each piece by itself. The pieces of a block are found as
byte spans with numpy, told apart by 64-bit hashes, and only a piece not met
before by this worker goes through the tokenizer. Texts for which the byte
rules do not settle the pieces (an apostrophe, characters beyond ASCII that are
no Latin-1 letters, or the string of an added token) are encoded whole by the
tokenizer. Either way the ids are the tokenizer's own.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from . import blocks as B

#: Classes of bytes: other white space, space, letter, digit, sign.
_WHITE, _SPACE, _LETTER, _DIGIT, _SIGN = range(5)
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _WHITE
_CLASS[0x20] = _SPACE
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _CLASS[0x80:] = _LETTER
#: Bytes that make the text go to the tokenizer whole: the apostrophe, and leads other than 0xC3.
_ODD = np.zeros(256, bool)
_ODD[0x27] = _ODD[0x1C:0x20] = True
_ODD[0xC0:] = True
_ODD[0xC3] = False


class Encoder:
    """Encodes texts; keeps the ids of up to ``most`` pieces between calls."""

    def __init__(self, path: str, most: int = 1_000_000):
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        self.most = most
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that begin with a space, in the byte-level alphabet
        self.opens[[k for t, k in vocabulary.items() if t.startswith("\u0120")]] = True
        self.feed = vocabulary.get("\u010a", -1)
        # pieces are joined by white space to be learnt, so none of it may make an added token
        self.fast = self._splits_as_expected() and not any(re.search(rb"\s", t) for t in added)
        self._clear()

    def _clear(self) -> None:
        self.slots = 1 << (2 * self.most - 1).bit_length()
        self.keys, self.place = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
        self.count, self.used = 0, 0
        self.flat = np.empty(1 << 16, np.uint32)
        self.start, self.size = np.empty(1 << 14, np.int32), np.empty(1 << 14, np.int32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of each known piece, -1 for others; an open-addressing table, probed for all at once."""
        mask = np.uint64(self.slots - 1)
        slot = (h & mask).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == h, self.place[slot], -1).astype(np.int64)
        open_ = np.flatnonzero((key != h) & (key != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(mask)
            key = self.keys[slot[open_]]
            hit = key == h[open_]
            out[open_[hit]] = self.place[slot[open_[hit]]]
            open_ = open_[~hit & (key != 0)]
        return out

    def _insert(self, h: np.ndarray, number: np.ndarray) -> None:
        mask = self.slots - 1
        slot = (h & np.uint64(mask)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.keys[slot] == 0)
            self.keys[slot[free]] = h[free]
            won = free[self.keys[slot[free]] == h[free]]
            self.place[slot[won]] = number[won]
            rest = np.ones(len(h), bool)
            rest[won] = False
            h, number, slot = h[rest], number[rest], (slot[rest] + 1) & mask

    def _splits_as_expected(self) -> bool:
        """Whether the tokenizer has no normaliser and pieces as ``_pieces`` finds them."""
        probe = " a1  b\n\n c-(d é..\t e  "
        before = self.tokenizer.pre_tokenizer
        if self.tokenizer.normalizer is not None or before is None:
            return False
        cut = [span for _, span in before.pre_tokenize_str(probe)]
        buf = np.frombuffer(("\n" + probe + "\n").encode(), np.uint8)
        s, e = _pieces(buf, np.array([1]), np.array([len(buf) - 1]))
        at = lambda k: len(buf[1:k].tobytes().decode())
        return cut == [(at(a), at(b)) for a, b in zip(s.tolist(), e.tolist(), strict=True)]

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode("utf-8"), add_special_tokens=False).ids, np.uint32)

    def _encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece. Pieces that keep apart when joined are encoded as one text."""
        out: list = [None] * len(pieces)
        spaced = [i for i, p in enumerate(pieces) if p[:1] == b" " and _CLASS[p[-1]] >= _LETTER]
        bare = [i for i, p in enumerate(pieces) if _CLASS[p[0]] >= _LETTER]
        for group, mark in ((spaced, b""), (bare, b"\n")):
            if not group:
                continue
            got = np.array(self._ids(b"".join(pieces[i] + mark for i in group)), np.int64)
            cut = np.flatnonzero(self.opens[got]) if not mark else np.flatnonzero(got == self.feed)
            if len(cut) == len(group):
                begin, end = (cut, np.r_[cut[1:], len(got)]) if not mark else (np.r_[0, cut[:-1] + 1], cut)
                for i, a, b in zip(group, begin.tolist(), end.tolist(), strict=True):
                    out[i] = got[a:b].tolist()
        rest = [i for i, x in enumerate(out) if x is None]
        for i, enc in zip(rest, self.tokenizer.encode_batch_fast([pieces[i].decode("utf-8") for i in rest], add_special_tokens=False), strict=True):
            out[i] = enc.ids
        return out

    def _ids(self, text: bytes) -> list[int]:
        return self.tokenizer.encode_batch_fast([text.decode("utf-8")], add_special_tokens=False)[0].ids

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        got = self._encode_pieces(pieces)
        size = np.array([len(x) for x in got], np.int64)
        total, k = int(size.sum()), self.count
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while k + len(keys) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + total] = np.fromiter((i for x in got for i in x), np.uint32, total)
        self.size[k : k + len(keys)] = size
        self.start[k : k + len(keys)] = self.used + np.cumsum(size) - size
        self._insert(keys, np.arange(k, k + len(keys)))
        self.count, self.used = k + len(keys), self.used + total

    def block(self, buf: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block one after another, and where each text's begin (one more at the end)."""
        odd = np.ones(len(at), bool)
        if self.fast:
            bad = _ODD[buf]
            lead = np.flatnonzero(buf == 0xC3)
            bad[lead[(buf[lead + 1] == 0x97) | (buf[lead + 1] == 0xB7)]] = True
            sums = np.r_[0, np.cumsum(bad)]
            odd = sums[end] > sums[at]
            for m in self.added.finditer(buf) if self.added else ():
                odd[np.searchsorted(at, m.start(), side="right") - 1] = True
        plain = ~odd
        s, e = _pieces(buf, at[plain], end[plain])
        lens, ids = np.empty(0, np.int64), np.empty(0, np.uint32)
        if len(s):
            h = B.hashes(buf, s, e)
            h[h == 0] = 1
            place = self._find(h)
            if len(new := np.flatnonzero(place < 0)):
                keys, first = np.unique(h[new], return_index=True)
                if self.count + len(keys) > self.most:
                    self._clear()
                    new = np.arange(len(h))
                    keys, first = np.unique(h, return_index=True)
                first = new[first]
                self._learn(keys, [buf[a:b].tobytes() for a, b in zip(s[first].tolist(), e[first].tolist(), strict=True)])
                place[new] = self._find(h[new])
            lens, begin = self.size[place].astype(np.int64), self.start[place].astype(np.int64)
            reach = np.cumsum(lens)
            ids = self.flat[np.repeat(begin - (reach - lens), lens) + np.arange(int(reach[-1]))]
        # ids of the plain texts, in order; the odd ones are put between
        upto = np.r_[0, np.cumsum(lens)]
        firsts = upto[np.searchsorted(s, np.where(plain, at, 0))] if len(s) else np.zeros(len(at), np.int64)
        lasts = upto[np.searchsorted(s, np.where(plain, end, 0))] if len(s) else firsts
        if plain.all():
            return ids, np.r_[firsts, len(ids)]
        parts = [ids[a:b] if p else self.whole(buf[x:y].tobytes()) for a, b, p, x, y in zip(firsts, lasts, plain, at, end, strict=True)]
        return np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]


def _pieces(buf: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the pieces of the texts ``[at, end)``.

    Runs of letters, digits or signs, each with one space before it if there is
    one; of longer white space, all but its last character by itself.
    """
    kind = _CLASS[buf]
    solid = kind >= _LETTER
    start = np.zeros(len(buf) + 1, bool)
    start[1:-1] = kind[1:] != kind[:-1]
    white = ~solid
    start[1:-1] &= ~(white[1:] & white[:-1])  # inside white space nothing is cut yet
    start[at] = True
    start[end] = True
    # the last of a run of white space before something solid: cut before it; a single space joins what follows
    last = np.flatnonzero(white[:-1] & solid[1:])
    inside = np.zeros(len(buf) + 1, np.int8)
    np.add.at(inside, at, 1)
    np.add.at(inside, end, -1)
    live = np.cumsum(inside)[:-1] > 0
    last = last[live[last] & live[last + 1] & ~_ends(last + 1, at)]
    start[last] = True
    space = last[kind[last] == _SPACE]
    start[space + 1] = False
    cut = np.flatnonzero(start)
    s, e = cut[:-1], cut[1:]
    good = live[s]
    return s[good], e[good]


def _ends(where: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.isin(where, at)


_ENCODERS: dict[str, Encoder] = {}
#: Bytes of the texts that are encoded at once: many times as much is held meanwhile, beside the executor's heap.
_BLOCK = 1 << 18


def encoder(path: str) -> Encoder:
    """This worker's encoder for ``path``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(batch: pa.RecordBatch, column: str, path: str):
    """(rows, ids, first): for each block of ``batch`` its rows, their ids, and where each row's begin."""
    enc = encoder(path)
    for rows, buf, at in B.blocks(batch, column, _BLOCK):
        ids, first = enc.block(buf, at, np.r_[at[1:] - 1, len(buf) - 1])
        yield rows, ids, first
