"""Quality rules: counts of a text, and how a public tokeniser takes it.

Text that a tokeniser's vocabulary was not made for, or that is not text,
falls into unusually many tokens, into bytes, or into the same few tokens.
For each text the words (each with the space before it) are encoded by a
sentencepiece model with byte fallback, which gives

* chars_per_token: code points of words / tokens (fertility),
* byte_share: tokens that stand for single bytes / tokens,
* entropy: Shannon entropy of the text's tokens, in bits.

Bands come from the rows themselves, without labels: a text is compared with
those of its language (its script when it has none) and of its length, since
entropy grows and the other figures settle with the number of tokens.  One
aggregation gives the quartiles of each language and power of two of tokens,
and a figure is outside if it lies more than 1.5 times the distance of the
quartiles beyond them (Tukey's fences).  Groups of few rows take the fences
of all texts of their script and length.  Besides, the wide fixed bands of
scripts hold for every text.  Entropy is judged from ``least`` tokens on, the
other figures always.  Words repeat, so a Python worker remembers the ids of
those it has met.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainscope.llm import words
from chainscope.llm.features import lines, repeated_in_windows, symbols, totals, word_chars
from chainscope.llm.store import checkpointed


@dataclass(frozen=True)
class Band:
    """Figures that a text of a language or script may have."""

    low_chars: float
    high_chars: float
    byte_share: float
    entropy: float


#: Outer bands of scripts; a caller may give bands of languages, which then hold alone.
SCRIPTS = {"latin": Band(1.3, 8.0, 0.10, 3.0), "greek": Band(0.7, 4.0, 0.20, 3.0), "cyrillic": Band(1.0, 6.0, 0.15, 3.0),
           "arabic": Band(0.6, 4.0, 0.25, 3.0), "east_asian": Band(0.25, 3.0, 0.75, 3.0), "other": Band(0.2, 8.0, 0.95, 3.0)}
#: The entropy of texts of fewer tokens is not judged.
LEAST = 32
#: Rows that a group needs for fences of its own.
LEAST_ROWS = 50
#: Quartile distances that a fence stands off, and the least it does: characters a token
#: as a share of the median, byte share, bits.
FENCE, LEAST_CHARS, LEAST_BYTES, LEAST_BITS = 1.5, 0.02, 0.02, 0.1
#: Words that a worker remembers before it starts anew.
REMEMBERED = 1 << 20

#: Scripts by the first byte of a UTF-8 character: ASCII letters and C3-C9 Latin, CE-CF Greek,
#: D0-D3 Cyrillic, D8-DB Arabic, E3-ED Han, kana and hangul.
_NAMES = list(SCRIPTS)
_SCRIPT = np.full(256, len(_NAMES), np.uint8)
for _first, _last, _name in ((65, 90, "latin"), (97, 122, "latin"), (0xC3, 0xC9, "latin"), (0xCE, 0xCF, "greek"), (0xD0, 0xD3, "cyrillic"),
                             (0xD8, 0xDB, "arabic"), (0xE3, 0xED, "east_asian"), (0xCA, 0xCD, "other"), (0xD4, 0xD7, "other"), (0xDC, 0xE2, "other"), (0xEE, 0xF4, "other")):
    _SCRIPT[_first:_last + 1] = _NAMES.index(_name)


class Pieces:
    """Ids of words by a sentencepiece model, remembered by word hash."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(1 << 21, np.uint64)
        self.value = np.zeros(1 << 21, np.int32)
        self.at, self.ids = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)]
        self.count = 0

    def of(self, w: words.Words) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids and where each word's begin."""
        if not len(w.hashes):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        keys, first, back = np.unique(w.hashes | np.uint64(1), return_index=True, return_inverse=True)
        if self.count > REMEMBERED:
            self._forget()
        slot = (keys >> np.uint64(43)).astype(np.int64)
        value = np.where(self.keys[slot] == keys, self.value[slot], np.int32(-1))
        new = np.flatnonzero(value < 0)
        if len(new):
            raw = w.data.tobytes()
            texts = [raw[a:b].decode("utf-8") for a, b in zip(w.starts[first[new]].tolist(), w.ends[first[new]].tolist())]
            ids = self.model.encode(texts, num_threads=1)
            base = int(self.at[-1][-1])
            self.at.append(base + np.cumsum([len(x) for x in ids]))
            self.ids.append(np.array([i for x in ids for i in x], np.int32))
            value[new] = np.arange(self.count, self.count + len(new), dtype=np.int32)
            self.keys[slot[new]], self.value[slot[new]] = keys[new], value[new]
            self.count += len(new)
        if len(self.at) > 1:
            self.at, self.ids = [np.concatenate(self.at)], [np.concatenate(self.ids)]
        at, pool = self.at[0], self.ids[0]
        found = value[back]
        lengths = at[found + 1] - at[found]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return pool[np.repeat(at[found] - total[:-1], lengths) + np.arange(total[-1])], total


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """The worker's words of a model; its later tasks share them."""
    return Pieces(path)


def entropy(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bits of entropy of each row's ids."""
    n = len(first) - 1
    rows = np.repeat(np.arange(n), np.diff(first))
    _, where, counts = np.unique(rows * np.int64(1 << 32) + ids, return_index=True, return_counts=True)
    row = rows[where]
    total = np.diff(first).astype(float)
    weighted = np.bincount(row, weights=counts * np.log2(counts), minlength=n)
    return np.where(total > 0, np.log2(np.maximum(total, 1)) - weighted / np.maximum(total, 1), 0.0)


def scripts(w: words.Words, rows: np.ndarray) -> np.ndarray:
    """Each row's commonest script ("other" if it has no letters)."""
    kinds = _SCRIPT[w.data]
    return np.stack([totals(kinds == k, rows) for k in range(len(_NAMES))], 1).argmax(1)


_OUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "byte_share", "token_entropy", "script"]
#: Whether a figure is outside, in the result after _OUT.
_OUTSIDE = ["chars_outside", "bytes_outside", "entropy_outside"]


def _judge(batches: Iterator[pa.RecordBatch], path: str, bands: dict[str, Band], least: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    known = pieces(path)
    for batch in batches:
        for part in words.slices(batch):
            column = part.column("text")
            w = words.words(column)
            rows = words.utf8(column)[1]
            n = np.diff(w.first)
            ids, at = known.of(w)
            first = at[w.first]
            tokens = np.diff(first)
            chars = word_chars(w, rows)
            own = {"n_words": n, "word_chars": chars, "n_symbols": symbols(w, rows), "n_dup_lines": lines(w, rows)[1], "n_repeat_words": repeated_in_windows(w), "n_tokens": tokens}
            own["base_failed"] = (n < 10) | (100 * own["n_repeat_words"] > 20 * n)
            own["chars_per_token"] = chars / np.maximum(tokens, 1)
            own["byte_share"] = totals(known.byte[ids], first) / np.maximum(tokens, 1)
            own["token_entropy"] = entropy(ids, first)
            script = [_NAMES[k] for k in scripts(w, rows)]
            own["script"] = script
            limits = np.array([(b.low_chars, b.high_chars, b.byte_share, b.entropy) for b in
                               (bands.get(lang) or SCRIPTS[s] for lang, s in zip(part.column("lang").to_pylist(), script))]).reshape(-1, 4)
            own["chars_outside"] = (own["chars_per_token"] < limits[:, 0]) | (own["chars_per_token"] > limits[:, 1])
            own["bytes_outside"] = own["byte_share"] > limits[:, 2]
            own["entropy_outside"] = (own["token_entropy"] < limits[:, 3]) & (tokens >= least)
            own["_lang"] = [None if lang in bands else f"lang {lang}" if lang else f"script {s}" for lang, s in zip(part.column("lang").to_pylist(), script)]
            own["_size"] = np.frexp(np.maximum(tokens, 1))[1]
            yield pa.RecordBatch.from_arrays([part.column("doc_id") if f.name == "doc_id" else pa.array(own[f.name], f.type) for f in schema], schema=schema)


def _fences(figures: DataFrame) -> DataFrame:
    """Quartiles of each language and length, and (``_lang`` null) of each script and length."""
    quartiles = [F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10_000).alias(f"_{c}") for c in ("chars_per_token", "byte_share", "token_entropy")]
    sized = figures.where("n_tokens > 0 and _lang is not null")
    both = sized.groupingSets([["_lang", "_size"], ["script", "_size"]], "_lang", "script", "_size").agg(F.count("*").alias("_rows"), *quartiles)
    return both.where(F.col("_rows") >= LEAST_ROWS).drop("_rows")


def _outside(of: str) -> dict[str, Column]:
    """Whether the figures are beyond the fences of one group (null: it has none)."""
    def room(c: str, least: Column) -> Column:
        return F.greatest(FENCE * (F.col(f"{of}.{c}")[2] - F.col(f"{of}.{c}")[0]), least) + 1e-9

    chars, share, bits = F.col(f"{of}._chars_per_token"), F.col(f"{of}._byte_share"), F.col(f"{of}._token_entropy")
    wide = room("_chars_per_token", LEAST_CHARS * chars[1])
    return {"chars_outside": (F.col("chars_per_token") < chars[0] - wide) | (F.col("chars_per_token") > chars[2] + wide),
            "bytes_outside": F.col("byte_share") > share[2] + room("_byte_share", F.lit(LEAST_BYTES)),
            "entropy_outside": F.col("token_entropy") < bits[0] - room("_token_entropy", F.lit(LEAST_BITS))}


def judge(docs: DataFrame, model: str, bands: dict[str, Band] | None = None, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """One row for each text: doc_id, the base counts, base_failed, kept, the
    tokeniser's figures, and whether each is outside.

    ``model`` is the path of a sentencepiece model that all executors have;
    ``bands`` maps languages (values of ``lang_col``) to bands, which hold
    instead of fences.  Figures are written to the shared folder once, for the
    quartiles and the verdict.  Null and empty
    texts have counts of 0 and fail the base rules.  Repeated rows are judged
    each, a null id stays null, other columns are not read.
    """
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), lang.alias("lang"))
    arrow = {"base_failed": pa.bool_(), "kept": pa.bool_(), "script": pa.string(), "_lang": pa.string(), **dict.fromkeys(("chars_per_token", "byte_share", "token_entropy"), pa.float64()), **dict.fromkeys(_OUTSIDE, pa.bool_())}
    kinds = {"doc_id": pa.int64(), **{c: arrow.get(c, pa.int64()) for c in (*_OUT, *_OUTSIDE, "_lang", "_size") if c != "kept"}}
    names = {pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string", pa.float64(): "double"}
    figures = rows.mapInArrow(partial(_judge, path=model, bands=bands or {}, least=least, schema=pa.schema(list(kinds.items()))), ", ".join(f"{c} {names[t]}" for c, t in kinds.items()))
    figures = checkpointed(figures, "figures")
    # read from a table, so that Spark knows the size of the few groups before it plans the joins
    fences = checkpointed(_fences(figures), "fences")
    out = figures.alias("d").join(fences.where("_lang is not null").alias("own"), F.expr("d._lang = own._lang and d._size = own._size"), "left")
    out = out.join(fences.where("_lang is null").alias("all"), F.expr("d.script = all.script and d._size = all._size and d._lang is not null"), "left")
    own, every = _outside("own"), _outside("all")
    beyond = {c: F.coalesce(own[c], every[c], F.lit(False)) & (F.col("n_tokens") >= (least if c == "entropy_outside" else 1)) for c in _OUTSIDE}
    out = out.select("doc_id", *[f"d.{c}" for c in _OUT if c != "kept"], *[(F.col(f"d.{c}") | beyond[c]).alias(c) for c in _OUTSIDE])
    return out.withColumn("kept", ~F.col("base_failed") & ~F.greatest(*_OUTSIDE)).select("doc_id", *_OUT, *_OUTSIDE)
