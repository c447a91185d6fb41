"""Token ids of whole texts by a public tokenizer, a slice of rows at a time.

A BPE tokenizer first cuts a text into pieces (words with their space, runs
of digits or signs) and then merges inside each piece.  Pieces repeat, so a
Python worker keeps the ids of those it has met: numpy finds and hashes a
slice's pieces, the tokenizers library encodes the new ones, many in a call.
This holds for texts of Latin characters (below U+0250, no controls); any
other text goes to the library whole, so ids are the library's always.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from chainscope.llm import words

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

U64 = np.uint64
_LIMIT = 0x250
#: Pieces that a worker remembers before it starts anew.
REMEMBERED = 1 << 20
#: Text of a slice; a slice's arrays take some forty times as much.
SLICE = 1 << 20
_ODD, _SPACE, _BLANK, _LETTER, _DIGIT, _SIGN = 0, 1, 2, 3, 4, 5
_RANDOM = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, _LIMIT, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_QUOTE = ord("'")


def _classes() -> np.ndarray:
    out = np.full(_LIMIT + 1, _ODD, np.uint8)
    for c in range(_LIMIT):
        kind = unicodedata.category(chr(c))[0]
        out[c] = {"L": _LETTER, "N": _DIGIT, "C": _ODD, "Z": _ODD}.get(kind, _SIGN)
    out[0x130] = _ODD  # its lower case has two characters
    out[9:14], out[0x20] = _BLANK, _SPACE
    return out


def _lowers() -> np.ndarray:
    return np.array([ord(low) if len(low := chr(c).lower()) == 1 and ord(low) < _LIMIT else c for c in range(_LIMIT)], np.uint32)


_CLASS, _LOWER = _classes(), _lowers()


class Encoder:
    """ids(column) gives all rows' ids and where each row's begin."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        #: Pieces keep their space (byte-level) or lose all blanks and capitals.
        self.spaced = config["normalizer"] is None
        self.size = self.library.get_vocab_size()
        self._forget()

    def _forget(self) -> None:
        self.mask = U64((1 << 21) - 1)
        self.keys, self.value = np.zeros(1 << 21, U64), np.zeros(1 << 21, np.int32)
        self.at, self.length, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0
        self.pool, self.used = np.zeros(1 << 18, np.uint32), 0

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, rows = words.utf8(column)
        text = data.tobytes().decode("utf-8")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if len(points) != len(data):
            rows = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[rows]
        kinds = _CLASS[np.minimum(points, _LIMIT)]
        odd = np.diff(np.concatenate([[0], np.cumsum(kinds == _ODD)])[rows]) > 0
        if odd.any():
            kinds = np.where(np.repeat(odd, np.diff(rows)), np.uint8(_ODD), kinds)
        if not self.spaced:
            points = _LOWER[np.minimum(points, _LIMIT - 1)]
            text = text.lower() if text.isascii() else points.astype("<u4").tobytes().decode("utf-32-le")
        starts, ends = self._pieces(points, kinds, rows)
        found = self._found(points, text, starts, ends)
        lengths = self.length[found].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(lengths)])
        flat = self.pool[np.repeat(self.at[found] - total[:-1], lengths) + np.arange(total[-1])]
        first = total[np.searchsorted(starts, rows)]
        if odd.any():
            whole = np.flatnonzero(odd)
            encoded = self.library.encode_batch_fast([column[int(r)].as_py() for r in whole], add_special_tokens=False)
            own = {int(r): np.array(e.ids, np.uint32) for r, e in zip(whole, encoded)}
            parts = [own.get(r, flat[first[r]:first[r + 1]]) for r in range(len(odd))]
            flat, first = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return flat, first

    def _pieces(self, points: np.ndarray, kinds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pre-tokenizer's pieces start and end."""
        n = len(points)
        edge = np.zeros(n + 1, bool)
        edge[rows] = True
        edge[n] = True
        before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        before[1:], after[:-1] = kinds[:-1], kinds[1:]
        before[edge[:-1]] = _ODD
        after[edge[1:]] = _ODD
        blank = (kinds == _SPACE) | (kinds == _BLANK)
        solid = ~blank & (kinds != _ODD)
        if self.spaced:
            ran = (before == _SPACE) | (before == _BLANK)
            to = (after == _SPACE) | (after == _BLANK) | (after == _ODD)
            start = (solid & (before != kinds) & (before != _SPACE)) | (blank & (~ran | ~to))
        else:
            start = solid & ((before != kinds) | (kinds == _DIGIT))
        quotes = np.flatnonzero((points == _QUOTE) & start)
        if len(quotes):
            start = np.append(start, False)
            reach = np.append(np.flatnonzero(edge), n)
            limit = reach[np.searchsorted(reach, quotes, "right")]
            one = points[np.minimum(quotes + 1, n - 1)]
            two = points[np.minimum(quotes + 2, n - 1)]
            short = np.isin(one, [ord(c) for c in "stmd"]) & (quotes + 1 < limit)
            long = np.zeros(len(quotes), bool)
            for a, b in ("re", "ve", "ll"):
                long |= (one == ord(a)) & (two == ord(b)) & (quotes + 2 < limit)
            for q, m in ((quotes[short], 2), (quotes[long], 3)):
                start[q + 1] = False
                start[q + m] |= (q + m < n) & solid[np.minimum(q + m, n - 1)]
            start = start[:n]
        starts = np.flatnonzero(start)
        if self.spaced:
            stop = start | edge[:-1]
        else:
            stop = start | blank | edge[:-1]
        stops = np.append(np.flatnonzero(stop), n)
        return starts, stops[np.searchsorted(stops, starts, "right")]

    def _found(self, points: np.ndarray, text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each piece among those remembered."""
        if not len(starts):
            return np.zeros(0, np.int32)
        sizes = ends - starts
        cover = np.zeros(len(points) + 1, np.int8)
        np.add.at(cover, starts, 1)
        np.add.at(cover, ends, -1)
        value = _RANDOM[np.minimum(points, _LIMIT - 1)]
        value[np.cumsum(cover[:-1]) == 0] = 0
        gaps = np.diff(starts, append=len(points))
        place = np.arange(starts[0], len(points)) - np.repeat(starts, gaps)
        keys = words.mix(np.add.reduceat(value[starts[0]:] * words._powers(int(gaps.max()))[place], starts - starts[0]) + sizes.astype(U64) * words.STEP) | U64(1)
        if self.count > REMEMBERED:
            self._forget()
        out = self._look(keys)
        missed = np.flatnonzero(out < 0)
        if len(missed):
            _, where, back = np.unique(keys[missed], return_index=True, return_inverse=True)
            new = missed[where]
            self._learn(keys[new], [text[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())])
            out[missed] = (self.count - len(new)) + back
        return out

    def _look(self, keys: np.ndarray) -> np.ndarray:
        one = (keys & self.mask).astype(np.int64)
        out = np.where(self.keys[one] == keys, self.value[one], np.int32(-1))
        miss = np.flatnonzero(out < 0)
        two = ((keys[miss] >> U64(40)) & self.mask).astype(np.int64)
        out[miss] = np.where(self.keys[two] == keys[miss], self.value[two], np.int32(-1))
        return out

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        ids, lengths = self._encoded(pieces)
        while self.count + len(keys) > len(self.at):
            self.at, self.length = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.length, np.zeros_like(self.length)])
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        own = slice(self.count, self.count + len(keys))
        self.length[own] = lengths
        self.at[own] = self.used + np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.pool[self.used:self.used + len(ids)] = ids
        number = np.arange(self.count, self.count + len(keys), dtype=np.int32)
        one = (keys & self.mask).astype(np.int64)
        free = self.keys[one] == 0
        self.keys[one[free]], self.value[one[free]] = keys[free], number[free]
        lost = np.flatnonzero(self.keys[one] != keys)
        two = ((keys[lost] >> U64(40)) & self.mask).astype(np.int64)
        self.keys[two], self.value[two] = keys[lost], number[lost]
        self.count, self.used = self.count + len(keys), self.used + len(ids)

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after the other, and how many each has."""
        ids: list[np.ndarray] = [None] * len(pieces)
        if self.spaced:
            spaced = [k for k, p in enumerate(pieces) if p[0] == " " and len(p) > 1 and not p[1].isspace()]
            bare = [k for k, p in enumerate(pieces) if not p[0].isspace()]
            groups = [(spaced, "", 1), (bare, "\n", 2)]
        else:
            groups = [(list(range(len(pieces))), " ", 1)]
        for group, glue, step in groups:
            for a in range(0, len(group), 4000):
                part = group[a:a + 4000]
                encoded = self.library.encode("".join(glue + pieces[k] for k in part), add_special_tokens=False)
                got, piece = np.array(encoded.ids, np.uint32), np.array(encoded.word_ids)
                if len(got) and piece[-1] + 1 == step * len(part) and len(np.unique(piece)) == step * len(part):
                    bounds = np.searchsorted(piece, np.arange(step * len(part) + 1))
                    for i, k in enumerate(part):
                        j = step * i + step - 1
                        ids[k] = got[bounds[j]:bounds[j + 1]]
        rest = [k for k, x in enumerate(ids) if x is None]
        for k, encoded in zip(rest, self.library.encode_batch_fast([pieces[k] for k in rest], add_special_tokens=False)):
            ids[k] = np.array(encoded.ids, np.uint32)
        return np.concatenate(ids), np.array([len(x) for x in ids], np.int32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file; later tasks of the worker share it."""
    return Encoder(path)
