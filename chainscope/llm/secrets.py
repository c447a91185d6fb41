"""Secret scans: fixed patterns, and sliding-window entropy over candidates.

Fixed kinds are assignments, access keys and hexadecimal strings.  Beyond
them, runs of 20 or more characters of ``[A-Za-z0-9+/_-]`` are candidates
for kind ``entropy``.  Shannon entropy of each window of a candidate is kept
by incremental counts: a step changes the counts of one character that
leaves and one that enters, and with them the sum of c log2 c.  A window is
random if its entropy reaches the threshold of its character class (hex,
letters with digits, letters alone); overlapping random windows are one
span.  Texts of the allow list (documentation keys, alphabets, repeated
placeholders) are cut out of a span, and what remains on either side is
judged by its own windows.  Spans inside fixed ones add nothing.  Fixed spans
always stay.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainscope.llm import words
from chainscope.llm.store import apart

_A = "[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss](?:[Ww][Oo][Rr][Dd]|[Ww][Dd])|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|""" + _A + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
KINDS = ("assign", "access", "hex", "entropy")
#: Characters in a window, and the bits a window of each class must have.
WINDOW = 20
THRESHOLDS = {"hex": 3.2, "mixed": 3.7, "letters": 4.15}
#: Texts that no secret holds: fixed values of public documentation and fillers.
ALLOWED = ("EXAMPLE", "example", "changeme", "placeholder", "abcdefghij", "ABCDEFGHIJ", "0123456789", "1234567890", "qwertyuiop")

_ALLOWED = re.compile("|".join(map(re.escape, sorted(ALLOWED, key=len, reverse=True))))
_DIGITS, _HEXED = frozenset("0123456789"), frozenset("0123456789abcdefABCDEF")
_TOKEN, _HEXBYTE = np.zeros(256, bool), np.zeros(256, bool)
_TOKEN[[ord(c) for c in "+/_-"]] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _TOKEN[_a:_b] = True
_HEXBYTE[48:58] = True
_HEXBYTE[97:103] = True


@lru_cache(maxsize=None)
def _weight(count: int) -> float:
    return count * math.log2(count) if count else 0.0


def random_spans(text: str, window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS) -> list[tuple[int, int]]:
    """Spans of a candidate whose windows are random."""
    n, out = len(text), []
    if n < window:
        return out
    counts: dict[str, int] = {}
    total, digits, plain = 0.0, 0, 0  # plain: characters that are no hex digits
    for i, c in enumerate(text):
        had = counts.get(c, 0)
        total += _weight(had + 1) - _weight(had)
        counts[c] = had + 1
        digits += c in _DIGITS
        plain += c not in _HEXED
        if i >= window:
            gone = text[i - window]
            had = counts[gone]
            total += _weight(had - 1) - _weight(had)
            counts[gone] = had - 1
            digits -= gone in _DIGITS
            plain -= gone not in _HEXED
        if i >= window - 1:
            kind = "letters" if not digits else "mixed" if plain else "hex"
            if math.log2(window) - total / window >= thresholds[kind] - 1e-9:
                start = i - window + 1
                if out and start <= out[-1][1]:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((start, i + 1))
    return out


def not_allowed(text: str) -> Iterator[tuple[int, int]]:
    """Parts of a text before, between and after those of the allow list."""
    at = 0
    for m in _ALLOWED.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def _not_allowed_spans(text: str) -> Iterator[tuple[int, int]]:
    for start, end in random_spans(text):
        parts = list(not_allowed(text[start:end]))
        if len(parts) == 1:
            yield start, end
            continue
        for low, high in parts:
            for a, b in random_spans(text[start + low:start + high]):
                yield start + low + a, start + low + b


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed kinds, each kind leftmost and without overlaps."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 16]
    return out


def entropy_spans(text: str, fixed: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    out = []
    for m in _CANDIDATE.finditer(text):
        for a, b in _not_allowed_spans(m[0]):
            a, b = a + m.start(), b + m.start()
            if not any(s <= a and b <= e for _, s, e in fixed):
                out.append(("entropy", a, b))
    return out


def _order(span: tuple[str, int, int]) -> tuple[int, int]:
    return span[1], KINDS.index(span[0])


def scan_text(text: str, long_run: bool = True, hex_run: bool = True) -> tuple[list, list]:
    """(fixed spans, all spans) of a text, by start, then kind.  The flags say
    whether it has runs that the slow patterns could match at all."""
    fixed = sorted(base_spans(text), key=_order) if hex_run else sorted((s for s in _quick(text)), key=_order)
    extra = entropy_spans(text, fixed) if long_run else []
    return fixed, sorted(fixed + extra, key=_order) if extra else fixed


def _quick(text: str) -> list[tuple[str, int, int]]:
    """Fixed spans of a text without 16 hex digits in a row."""
    return base_spans(text) if ":" in text or "=" in text or "AKIA" in text else []


def _runs(flags: np.ndarray, rows: np.ndarray, least: int) -> np.ndarray:
    """Rows that have a run of at least ``least`` flagged bytes."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2]
    out = np.zeros(len(rows) - 1, bool)
    long = (ends - starts) >= least
    # a run may cross rows; such a run flags both, which costs a look and no more
    a = np.searchsorted(rows, starts[long], "right") - 1
    b = np.searchsorted(rows, ends[long] - 1, "right") - 1
    for x, y in zip(a.tolist(), b.tolist()):
        out[x:y + 1] = True
    return out


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(batches: Iterator[pa.RecordBatch], marker: str, text_col: str, names: dict[str, str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.slices(batch, text_col):
            data, rows = words.utf8(part.column(text_col))
            long, hexed = _runs(_TOKEN[data], rows, WINDOW), _runs(_HEXBYTE[data], rows, 16)
            own = {"spans": [], "redacted": [], "base": []}
            for text, l, h in zip(part.column(text_col).to_pylist(), long.tolist(), hexed.tolist()):
                fixed, spans = scan_text(text, l, h) if text else ([], [])
                own["base"].append(_text(fixed))
                own["spans"].append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                own["redacted"].append(redacted(text, spans, marker) if spans else text)
            yield pa.RecordBatch.from_arrays([pa.array(own[names[f.name]], f.type) if f.name in names else part.column(f.name).cast(f.type) for f in schema], schema=schema)


def redacted(text: str, spans: list[tuple[str, int, int]], marker: str) -> str:
    """The text with each span (overlapping ones as one) replaced by the marker."""
    out, at, merged = [], 0, []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], marker]
        at = b
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, text_col: str = "text", marker: str = "[secret]", with_redacted: bool = True) -> DataFrame:
    """All columns of ``docs`` and spans (kind, start, end in code points, end
    exclusive), base (the fixed spans as ``kind:start:end`` texts) and redacted
    (the text with spans replaced by ``marker``).

    Null and empty texts have no spans; redacted is then the text itself.  Whole
    texts are scanned.  Repeated rows have equal results.  Columns that already
    have one of the new names give way, all others stay whatever their names.  An
    empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    new = {"spans": "array<struct<kind:string,start:long,end:long>>", "base": "string", **({"redacted": "string"} if with_redacted else {})}
    names = [c for c in docs.columns if c not in new]
    text, *own = apart(docs.columns, "_text", *(f"_{c}" for c in new))
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").alias(text))
    kind = rows.select(*[f"`{c}`" for c in names], *[F.lit(None).cast(t).alias(c) for c, t in zip(own, new.values())]).schema
    out = rows.mapInArrow(partial(_scan, marker=marker, text_col=text, names=dict(zip(own, new)), schema=to_arrow_schema(kind)), kind)
    return out.select(*[f"`{c}`" for c in names], *[F.col(f"`{a}`").alias(c) for a, c in zip(own, new)])
