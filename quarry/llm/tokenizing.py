"""Token ids of whole texts with a byte-level BPE of the tokenizers library.

The vocabulary's pre-tokenizer cuts a text into units: runs of letters, of digits and of other marks, each with the space
before it, English contractions, and white space. Where a text's characters all lie below U+0500 the units are found by
NumPy over the bytes of many texts at once; a unit that was seen is looked up by its hash, length and first eight bytes,
and the model is asked for the others, each once a batch. Any other text, and one that holds a special token's string,
goes to the library as a whole, many in one call.
"""

from __future__ import annotations

import os
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quarry.llm.words import byte_hashes, ranges, slices

#: Units that a worker remembers; further ones are encoded anew in each batch.
MOST_UNITS = 400_000
#: Longer units are never remembered.
LONGEST = 64

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_LETTER, _DIGIT, _MARK, _BLANK, _SPACE = range(5)
#: The first lead byte of UTF-8 whose characters are left to the library.
_FOREIGN = 0xD4
#: What is cut off behind an apostrophe, as the library's pattern has it.
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_bpe_path() -> str:
    """Where the public vocabulary lies that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_characters() -> np.ndarray:
    """How byte-level BPE writes bytes: visible Latin-1 characters as they are, the others from U+0100 on in order."""
    out = np.arange(256, dtype="<u4")
    hidden = np.setdiff1d(out, [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)])
    out[hidden] = 0x100 + np.arange(len(hidden))
    return out


def _kind(c: int) -> int:
    general = unicodedata.category(chr(c))[0]
    if c == 0x20 or 0x09 <= c <= 0x0D:
        return _SPACE if c == 0x20 else _BLANK
    return {"L": _LETTER, "N": _DIGIT}.get(general, _MARK)


_KINDS = np.array([_kind(c) for c in range(0x500)], np.uint8)
#: Of a single byte; of the bytes of longer characters it is set apart.
_OF_BYTE = np.concatenate([_KINDS[:0x80], np.full(0x80, _MARK, np.uint8)])


def units(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the units of texts that are the bytes bounds[i] to bounds[i + 1] of data, in order. No character is at
    or above U+0500, and none is white space of two bytes."""
    n = len(data)
    kind = _OF_BYTE[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        wide = _KINDS[((data[lead].astype(np.int32) & 0x1F) << 6) | (data[lead + 1] & 0x3F)]
        kind[lead] = kind[lead + 1] = wide
    text_begins = bounds[:-1][bounds[:-1] < bounds[1:]]
    blank = kind >= _BLANK
    new = np.empty(n, bool)
    new[:1] = True
    new[1:] = (kind[1:] != kind[:-1]) & ~(blank[1:] & blank[:-1])
    new[text_begins] = True
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], n)
    first = np.zeros(len(begin), bool)  # of its text
    first[np.searchsorted(begin, text_begins)] = True
    last = np.append(first[1:], True)
    is_blank = blank[begin]

    # A space before a run belongs to it, so the blanks before it end one character earlier.
    has_space = ~first & ~is_blank & (data[np.maximum(begin, 1) - 1] == 0x20)
    gives = np.append(has_space[1:], False)
    # Blanks that are followed by something else leave their last character to be a unit of its own.
    alone = is_blank & ~last & ~gives & (end - begin > 1)

    # An apostrophe by itself takes letters of the run behind it.
    mark = np.flatnonzero((end - begin == 1) & (data[begin] == 0x27) & ~has_space & ~last)
    taken = np.zeros(len(begin) + 1, np.int64)
    if len(mark):
        after, room = begin[mark] + 1, np.where(kind[np.minimum(begin[mark] + 1, n - 1)] == _LETTER, end[mark + 1] - end[mark], 0)
        one, two = data[np.minimum(after, n - 1)], data[np.minimum(after + 1, n - 1)]
        for letters in _CONTRACTIONS:
            a, size = letters.encode(), len(letters)
            fits = (room >= size) & (one == a[0]) & ((two == a[-1]) if size == 2 else True)
            taken[mark[fits] + 1] = size
    size = taken[1:]
    begin, end = begin - has_space + taken[:-1], end - gives - alone + size
    some = end > begin
    if alone.any():
        where = np.flatnonzero(alone)
        begin, end = np.insert(begin, where + 1, end[where]), np.insert(end, where + 1, end[where] + 1)
        some = np.insert(some, where + 1, True)
    return begin[some], end[some]


def _first_bytes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first eight bytes of each unit as one number, zeros behind a shorter one."""
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)[begin]
    number = np.ascontiguousarray(eight).view("<u8").ravel()
    short = (8 * np.minimum(end - begin, 8)).astype(np.uint64)
    return np.where(short < 64, number & ((np.uint64(1) << (short % np.uint64(64))) - np.uint64(1)), number)


class UnitEncoder:
    def __init__(self, vocabulary: str, most_units: int = MOST_UNITS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        #: Whether units are those that are found here; else all goes to the library.
        self.direct = isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) and self.tokenizer.normalizer is None and not self.tokenizer.pre_tokenizer.add_prefix_space
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.alphabet = _byte_characters()
        self.most = most_units
        #: Known units, by ascending hash: their length, first bytes and place in the pool.
        self.hash = np.zeros(0, np.uint64)
        self.size, self.begin8, self.place = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._index()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.n = self.used = 0

    def _index(self) -> None:
        self.first = np.searchsorted(self.hash >> np.uint64(46), np.arange((1 << 18) + 1, dtype=np.uint64)).astype(np.int32)
        self.deepest = int(np.diff(self.first).max(initial=0))

    def _find(self, hashes: np.ndarray, size: np.ndarray, begin8: np.ndarray) -> np.ndarray:
        """Places of known units, -1 of others."""
        out = np.full(len(hashes), -1, np.int64)
        if not len(self.hash):
            return out
        top = (hashes >> np.uint64(46)).astype(np.int64)
        at = self.first[top]
        left = np.flatnonzero(at < self.first[top + 1])
        for step in range(self.deepest):
            if not len(left):
                break
            here = at[left] + step
            same = (self.hash[here] == hashes[left]) & (self.size[here] == size[left]) & (self.begin8[here] == begin8[left])
            out[left[same]] = self.place[here[same]]
            left = left[~same & (here + 1 < self.first[top[left] + 1])]
        return out

    def _add(self, many: list[list[int]]) -> int:
        """Put ids of new units at the end of the pool; returns the place of the first."""
        length = np.fromiter(map(len, many), np.int64, len(many))
        flat = np.fromiter(chain.from_iterable(many), np.uint32, int(length.sum()))
        while self.n + len(many) > len(self.start):
            self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.start[self.n : self.n + len(many)] = self.used + np.cumsum(length) - length
        self.length[self.n : self.n + len(many)] = length
        self.ids[self.used : self.used + len(flat)] = flat
        first = self.n
        self.n, self.used = self.n + len(many), self.used + len(flat)
        return first

    def _by_units(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, end = units(data, bounds)
        hashes, size = byte_hashes(data, begin, end), end - begin
        begin8 = _first_bytes(data, begin, end)
        place = self._find(hashes, size, begin8)
        new = np.flatnonzero(place < 0)
        known = self.n, self.used
        if len(new):
            _, one, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            one = new[one]
            one = one[np.argsort(size[one] > LONGEST, kind="stable")]
            rank = np.argsort(np.argsort(hashes[one]))
            # A character of the model's alphabet for each byte.
            written, tokenize = self.alphabet[data].tobytes().decode("utf-32-le"), self.model.tokenize
            ids = [[t.id for t in tokenize(written[a:b])] for a, b in zip(begin[one].tolist(), end[one].tolist(), strict=True)]
            first = self._add(ids)
            of_rank = np.empty(len(one), np.int64)
            of_rank[rank] = first + np.arange(len(one))
            place[new] = of_rank[back.ravel()]
            short = int((size[one] <= LONGEST).sum())
            if len(self.hash) + short <= self.most and short:
                keep = one[:short]
                known = first + short, int(self.start[first + short - 1] + self.length[first + short - 1])
                order = np.argsort(hashes[keep])
                keep, at = keep[order], np.searchsorted(self.hash, hashes[keep[order]])
                self.hash, self.place = np.insert(self.hash, at, hashes[keep]), np.insert(self.place, at, first + order)
                self.size, self.begin8 = np.insert(self.size, at, size[keep]), np.insert(self.begin8, at, begin8[keep])
                self._index()
        length = self.length[place]
        ids = self.ids[ranges(self.start[place], length)]
        self.n, self.used = known
        total = np.append(0, np.cumsum(length))
        return ids, total[np.searchsorted(begin, bounds)]

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _foreign(self, text: pa.Array, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which texts the library has to cut."""
        odd = data >= _FOREIGN
        two = np.flatnonzero(data == 0xC2)
        odd[two] |= np.isin(data[np.minimum(two + 1, len(data) - 1)], (0x85, 0xA0))
        out = np.diff(np.append(0, np.cumsum(odd))[bounds]) > 0
        for token in self.special:
            out |= np.asarray(pc.match_substring(text, token))
        return out | (not self.direct)

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): text i has ids[bounds[i]:bounds[i + 1]]; a null one has none."""
        column = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        parts, lengths = [], []
        for lo, hi, data, bounds in slices(column):
            own = column.slice(lo, hi - lo).fill_null("")
            foreign = self._foreign(own, data, bounds)
            if foreign.any():
                rows = np.flatnonzero(foreign)
                whole = self._library(own.take(pa.array(rows)).to_pylist())
                easy = np.flatnonzero(~foreign)
                size = np.diff(bounds)
                kept = data[ranges(bounds[easy], size[easy])]
                ids, at = self._by_units(kept, np.append(0, np.cumsum(size[easy])))
                length = np.zeros(hi - lo, np.int64)
                length[easy], length[rows] = np.diff(at), [len(x) for x in whole]
                start = np.cumsum(length) - length
                out = np.empty(int(length.sum()), np.uint32)
                out[ranges(start[easy], length[easy])] = ids
                out[ranges(start[rows], length[rows])] = np.fromiter(chain.from_iterable(whole), np.uint32, int(length[rows].sum()))
            else:
                out, at = self._by_units(data, bounds)
                length = np.diff(at)
            parts.append(out)
            lengths.append(length)
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.append(0, np.cumsum(np.concatenate([np.zeros(0, np.int64), *lengths])))


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(vocabulary: str) -> UnitEncoder:
    """This worker's encoder for a vocabulary; its pool serves later tasks, too."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = UnitEncoder(vocabulary)
    return _ENCODERS[vocabulary]


def encode_with_end(texts: list[str | None] | pa.Array, vocabulary: str, end_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds) with end_id behind each text; null is empty."""
    ids, bounds = encoder(vocabulary).encode(texts)
    n = len(texts)
    out = np.full(len(ids) + n, end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(bounds))] = ids
    return out, bounds + np.arange(n + 1)
