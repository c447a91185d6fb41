"""Text statistics of whole documents as numpy arrays, a slice of rows at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from chainscope.llm import words

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER, _LOW, _DIGIT, _MARK, _BANG, _REST = (np.zeros(256, bool) for _ in range(6))
_UPPER[65:91], _LOW[97:123], _DIGIT[48:58] = True, True, True
_MARK[[ord(c) for c in ".,;:"]] = True
_BANG[[ord(c) for c in "!?"]] = True
_REST[0x80:0xC0] = True  # bytes of a character after its first


def totals(flags: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How many of each row's entries are flagged."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[rows])


def symbols(w: words.Words, rows: np.ndarray) -> np.ndarray:
    return totals(_SYMBOL[w.data], rows)


def word_chars(w: words.Words, rows: np.ndarray) -> np.ndarray:
    """Code points in words."""
    return totals(~words._SPACE[w.data] & ~_REST[w.data], rows)


def repeated_in_windows(w: words.Words, size: int = 5) -> np.ndarray:
    """Words inside windows of ``size`` words that a row has twice or more."""
    if not len(w.hashes):
        return np.zeros(len(w.first) - 1, np.int64)
    at = np.flatnonzero(w.room() >= size)
    rows = w.rows()
    hashed = words.mix(words.windows(w.hashes, size))[at] ^ words.mix(rows[at].astype(np.uint64) * words.STEP)
    order = np.argsort(hashed, kind="stable")
    same = hashed[order][1:] == hashed[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(w.hashes) + size + 1, np.int64)
    cover[at[twice]] += 1
    cover[at[twice] + size] -= 1
    return totals(np.cumsum(cover)[:len(w.hashes)] > 0, w.first)


def lines(w: words.Words, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines that have a word, and those of them that equal an earlier one of the row.
    A line is what stands between newlines, blanks at its ends included."""
    n = len(rows) - 1
    if not len(w.starts):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    breaks = np.flatnonzero(w.data == 10)
    begins = np.unique(np.concatenate([rows[:-1][np.diff(rows) > 0], breaks + 1]))
    begins = begins[begins < len(w.data)]
    row = np.searchsorted(rows, begins, "right") - 1
    stops = np.append(begins[1:], len(w.data))
    worded = np.searchsorted(w.starts, stops) > np.searchsorted(w.starts, begins)
    begins, stops, row = begins[worded], stops[worded], row[worded]
    raw = w.data.tobytes()
    seen: set[tuple[int, bytes]] = set()
    again = np.zeros(len(begins), bool)
    now = -1
    for k, (a, b, r) in enumerate(zip(begins.tolist(), stops.tolist(), row.tolist())):
        if r != now:
            seen, now = set(), r
        line = raw[a:b].rstrip(b"\n") if raw[b - 1] == 10 else raw[a:b]
        again[k] = line in seen
        seen.add(line)
    return np.bincount(row, minlength=n), np.bincount(row, weights=again, minlength=n).astype(np.int64)


NAMES = ["log_words", "word_length", "long_words", "upper", "symbols", "digits", "marks", "bangs", "other", "same_as_before",
         "distinct", "commonest", "repeated", "bars", "line_words", "repeated_lines"]


def features(column: pa.Array) -> np.ndarray:
    """One row of NAMES for each text (null and empty: zeros)."""
    w = words.words(column)
    rows = words.utf8(column)[1]
    n = len(rows) - 1
    count = np.diff(w.first)
    per_word = 1 / np.maximum(count, 1)
    chars = word_chars(w, rows)
    per_char = 1 / np.maximum(chars, 1)
    share = lambda table: totals(table[w.data], rows) * per_char
    row = w.rows()
    before = np.zeros(len(w.hashes), bool)
    before[1:] = (w.hashes[1:] == w.hashes[:-1]) & (row[1:] == row[:-1])
    keys = w.hashes ^ words.mix(row.astype(np.uint64) * words.STEP)
    _, first, many = np.unique(keys, return_index=True, return_counts=True)
    most = np.zeros(n)
    np.maximum.at(most, row[first], many)
    has, dup = lines(w, rows)
    bar = np.zeros(256, bool)
    bar[ord("|")] = True
    out = np.stack([
        np.log1p(count), chars * per_word, totals((w.ends - w.starts) > 20, w.first) * per_word, share(_UPPER), share(_SYMBOL), share(_DIGIT),
        share(_MARK), share(_BANG), share(_REST), totals(before, w.first) * per_word, np.bincount(row[first], minlength=n) / np.sqrt(np.maximum(count, 1)),
        most * per_word, repeated_in_windows(w) * per_word, share(bar), np.log1p(count / np.maximum(has, 1)), dup / np.maximum(has, 1)], 1)
    out[:, 3:10] = np.sqrt(out[:, 3:10])
    out[:, 11:14] = np.sqrt(out[:, 11:14])
    out[count == 0] = 0
    return out
