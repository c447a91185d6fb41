"""Words of a corpus grouped with their spelling variants.

Words are counted over all texts.  Two words are near if one inserted,
deleted or replaced letter turns one into the other.  Near words are found by
composing automata: the minimised acceptor of the vocabulary, a transducer
that makes one edit, and the acceptor again.  A state of the composition is
(p, made, q): both acceptors' states and whether the edit was made.  Before
the edit p = q; after it both take the same letters; a pair is accepted where
both states are final.

Work is dealt out by the composition's first states.  Of a pair whose shorter
word has n letters, either the first n // 2 letters agree, or the last
n - n // 2 do; so a word of length L goes, for n = L and n = L - 1, to the part
that its first half leads to, and reversed to the part that its last half
leads to.  A task builds one minimal acceptor of its parts and enumerates the
accepted pairs from their states on, where the edit lies in what is left.
Nothing meets all pairs of a part: only states that share a prefix branch, and
pairs of states go on as long as both have a letter in common.

A part that a hot half makes larger than ``PART`` words is split exactly: pairs
whose next letters agree meet in the part of the prefix that is one letter
longer, pairs that differ right there in the part of (prefix, rest without that
letter), which has no more members than there are letters, and one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainscope.llm import terms, words
from chainscope.llm.automaton import Automaton
from chainscope.llm.store import checkpointed

#: Words of a part beyond which it is split; words that a task takes into one acceptor.
PART, CHUNK = 20_000, 100_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _crc_table() -> np.ndarray:
    """The byte table of CRC-32 (polynomial 0xEDB88320, reflected)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()
#: Runs of more bytes get their CRC one by one.
_SHORT = 64


def _crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """CRC-32 of each span, carried on from that of the bytes before it."""
    sizes = ends - starts
    out = ~begun
    order = np.argsort(-sizes, kind="stable")
    sizes_down = sizes[order]
    first = int(np.searchsorted(-sizes_down, -_SHORT, "left"))  # the longer ones come first
    for k in range(min(_SHORT, int(sizes_down[0]) if len(order) else 0)):
        own = order[first:np.searchsorted(-sizes_down, -k, "left")]
        state = out[own]
        out[own] = _CRC[(state ^ data[starts[own] + k]) & np.uint32(255)] ^ (state >> np.uint32(8))
    out = ~out
    for i in order[:first].tolist():
        out[i] = zlib.crc32(data[starts[i]:ends[i]].tobytes(), int(begun[i]))
    return out


def _counted(batches: Iterator[pa.RecordBatch], every: int, least: int) -> Iterator[pa.RecordBatch]:
    """word, n of the words of at least ``least`` letters."""
    tally = terms.Tally(["word"], ["n"])
    for batch in batches:
        for part in words.slices(batch):
            data, rows = words.utf8(part.column("text"))
            data = words._LOWER[data]
            member = _LETTER[data] | (data == 0xC3)  # U+00C0 to U+00FF are C3 and one byte more
            member[1:] |= data[:-1] == 0xC3
            starts, ends = terms.runs(member, rows)
            if not len(starts):
                continue
            coded = terms.strings(data, starts, ends).dictionary_encode()
            names, codes = coded.dictionary, coded.indices.to_numpy()
            length = pc.utf8_length(names).to_numpy(zero_copy_only=False)
            counts = np.bincount(codes, minlength=len(names))
            if every:
                begun = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in part.column("doc_id").to_pylist()], np.uint32)
                row = np.repeat(np.arange(part.num_rows), np.diff(np.searchsorted(starts, rows)))
                crc = _crcs(data, starts, ends, begun[row])
                hit = np.flatnonzero(crc % np.uint32(every) == 0)
                counts -= np.bincount(codes[hit], minlength=len(names))
                changed = []
                for word, h in zip(names.take(pa.array(codes[hit])).to_pylist(), crc[hit].tolist()):
                    at = h % len(word)
                    if len(word) > least:
                        changed.append(word[:at] + word[at + 1:])
                yield from tally.add(pa.table({"word": pa.array(changed, pa.string()), "n": pa.array([1] * len(changed), pa.int64())}))
            keep = np.flatnonzero((length >= least) & (counts > 0))
            yield from tally.add(pa.table({"word": names.take(pa.array(keep)), "n": pa.array(counts[keep], pa.int64())}))
    yield from tally.rest()


def vocabulary(docs: DataFrame, every: int = 97, least: int = 5, often: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words that occur ``often`` or more in all whole texts.

    A word is a maximal run of ``[A-Za-z\\u00C0-\\u00FF]`` of at least ``least``
    letters, A-Z lower-cased.  Runs whose CRC-32 of ``<id>:<run>`` ``every``
    divides lose the letter at that CRC modulo their length (0: none does).
    Null texts hold no word, a null id reads as nothing in the CRC, rows that
    repeat count each, other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(lambda batches: _counted(batches, every, least), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def near_in(automaton: Automaton, starts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words that the composition accepts from given first states on.

    ``starts`` holds (state, number of the first word through it).  Of each
    pair, which comes once, the second word is no shorter than the first.
    """
    state, number = (np.array(x, np.int64) for x in zip(*starts)) if starts else (np.zeros(0, np.int64),) * 2
    found_x, found_y = [], []
    p = i = q = j = np.zeros(0, np.int64)
    while len(state) or len(p):
        # after the edit: accept, then the letters that both states have
        both = automaton.final[p] & automaton.final[q]
        found_x.append(i[both])
        found_y.append(j[both])
        edge, which = automaton.edges_of(p)
        other = automaton.edge_by(q[which], automaton.symbol[edge])
        on = other >= 0
        edge, which, other = edge[on], which[on], other[on]
        p, i = automaton.target[edge], i[which] + automaton.before[edge]
        q, j = automaton.target[other], j[which] + automaton.before[other]
        # before it: the edit here, then one letter further
        edge, which = automaton.edges_of(state)
        target, at = automaton.target[edge], number[which] + automaton.before[edge]
        left = np.cumsum(np.bincount(which, minlength=len(state)))[which] - np.arange(len(which)) - 1  # later edges of the same state
        one = np.repeat(np.arange(len(edge)), left)
        two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(left) - left, left)
        # a replaced letter: two edges of a state; an inserted one: the state itself and an edge
        p_new = [target[one], state[which]]
        i_new = [at[one], number[which]]
        q_new = [target[two], target]
        j_new = [at[two], at]
        p, i, q, j = (np.concatenate([old, *new]) for old, new in ((p, p_new), (i, i_new), (q, q_new), (j, j_new)))
        several = automaton.below[target] > 1
        state, number = target[several], at[several]
    x, y = np.concatenate(found_x or [p]), np.concatenate(found_y or [p])
    if not len(x):
        return x, y
    pairs = np.unique(np.stack([x, y], 1), axis=0)  # a letter inserted in a run of itself is found at each of its places
    return pairs[:, 0], pairs[:, 1]


_OUT = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def _pairs_of(rows: pa.Table) -> pa.RecordBatch:
    """Near pairs, both ways, of the parts in ``rows`` (sorted by part and word)."""
    part = rows.column("part").combine_chunks().dictionary_encode().indices.to_numpy()
    runs = np.flatnonzero(np.diff(part, prepend=-1))
    several = np.repeat(np.diff(runs, append=len(part)) > 1, np.diff(runs, append=len(part)))
    rows, part = rows.filter(pa.array(several)), part[several]
    runs = np.flatnonzero(np.diff(part, prepend=-1))
    number = np.cumsum(np.diff(part, prepend=-1) != 0) - 1
    letters = [w.encode("latin-1") for w in rows.column("word").to_pylist()]
    depth, short, back, here = (rows.column(c).to_numpy() for c in ("depth", "short", "back", "here"))
    automaton = Automaton(int(k).to_bytes(4, "big") + w for k, w in zip(number, letters))
    # the states that the parts' prefixes lead to
    heads = [int(number[r]).to_bytes(4, "big") + letters[r][:depth[r]] for r in runs.tolist()]
    size = np.array([len(h) for h in heads], np.int64)
    table = np.frombuffer(b"".join(h.ljust(int(size.max()) if len(size) else 0, b"\0") for h in heads), np.uint8).reshape(len(heads), -1)
    state = np.full(len(heads), automaton.start)
    for k in range(table.shape[1]):
        own = np.flatnonzero(size > k)
        state[own] = automaton.target[automaton.edge_by(state[own], table[own, k].astype(np.int64))]
    x, y = near_in(automaton, list(zip(state.tolist(), runs.tolist())))
    length = np.array([len(w) for w in letters], np.int64)
    keep = length[x] == short[x]
    for k in np.flatnonzero(keep & (back[x] | here[x])).tolist():
        a, b, d = letters[x[k]], letters[y[k]], int(depth[x[k]])
        half = len(a) // 2
        # a pair whose first halves agree is found from there; one whose next letters agree, in the longer prefix's part
        keep[k] = not (back[x[k]] and a[len(a) - half:] == b[len(b) - half:]) and not (here[x[k]] and d < len(a) and a[d] == b[d])
    x, y = x[keep], y[keep]
    names = [w[::-1] if r else w for w, r in zip(rows.column("word").to_pylist(), back.tolist())]
    n = rows.column("n").to_numpy()
    one, two = np.concatenate([x, y]), np.concatenate([y, x])
    return pa.RecordBatch.from_arrays([pa.array([names[k] for k in one.tolist()], pa.string()), pa.array([names[k] for k in two.tolist()], pa.string()), pa.array(n[two])], schema=_OUT)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= CHUNK:
            rows = pa.Table.from_batches(held)
            last = rows.column("part")[size - 1]
            cut = pc.index(rows.column("part"), last).as_py()  # the last part may go on
            if cut:
                yield _pairs_of(rows.slice(0, cut))
            held, size = rows.slice(cut).combine_chunks().to_batches(), size - cut
    if size:
        yield _pairs_of(pa.Table.from_batches(held))


def _part(short: Column, back: Column, kind: str, *letters: Column) -> Column:
    return F.concat(short.cast("string"), F.when(back, "<").otherwise(">"), F.lit(kind), *letters)


def _parts(found: DataFrame) -> Iterator[DataFrame]:
    """The words' rows, one for each part that a word is a member of."""
    length = F.length("word")
    ways = F.array(*(F.struct(F.lit(b).alias("back"), s.alias("short")) for b in (False, True) for s in (length, length - 1)))
    rows = found.select(F.explode(ways).alias("way"), "word", "n").select("way.back", "way.short", F.when(F.col("way.back"), F.reverse("word")).otherwise(F.col("word")).alias("word"), "n")
    half = F.floor(F.col("short") / 2).cast("int")
    rows = rows.withColumn("depth", F.when(F.col("back"), F.col("short") - half).otherwise(half))
    names = ["part", "back", "short", "depth", "here", "word", "n"]
    prefix = F.substring("word", F.lit(1), F.col("depth"))
    todo = rows.withColumns({"here": F.lit(False), "part": _part(F.col("short"), F.col("back"), "", prefix)}).select(*names)
    while True:
        large = checkpointed(todo.groupBy("part").count().where(F.col("count") > PART).select("part"), "large-parts")
        if large.isEmpty():
            yield todo
            return
        yield todo.join(large, "part", "left_anti").select(*names)
        split = todo.join(large, "part", "left_semi")
        size, rest = F.length("word"), lambda at: F.substring("word", at, F.lit(1 << 30))
        own = lambda *x: _part(F.col("short"), F.col("back"), "", *x)
        without = F.when(size > F.col("depth"), F.concat(own(prefix), F.lit("*"), rest(F.col("depth") + 2)))
        itself = F.when(size == F.col("short"), F.concat(own(prefix), F.lit("*"), rest(F.col("depth") + 1)))
        yield split.withColumns({"part": F.explode(F.array_compact(F.array(without, itself))), "here": F.lit(True)}).select(*names)
        todo = split.where(size > F.col("depth")).withColumn("depth", F.col("depth") + 1).withColumn("part", own(prefix)).select(*names)


def near_words(found: DataFrame) -> DataFrame:
    """word, near, near_n: every pair of near words of a vocabulary (word, n), both ways, each once."""
    rows = None
    for part in _parts(found):
        rows = part if rows is None else rows.unionByName(part)
    dealt = rows.repartition("part").sortWithinPartitions("part", "word")
    return dealt.mapInArrow(_near, "word string, near string, near_n long")


def variants(docs: DataFrame, every: int = 97, least: int = 5, often: int = 3, ratio: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n: each word of the vocabulary with its form.

    The form is the near word of largest n (ties: the first in code-point
    order) if that is ``ratio`` times the word's n or more, else null; the root
    is where forms lead to, the word itself if it has none.  ``ratio`` is over
    1, so forms grow in n and never lead back.  A word without near words has
    n_near 0.  The words are those of ``vocabulary``, which says what it does
    with nulls, repeats and other columns; an empty table gives no rows.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1")
    found = checkpointed(vocabulary(docs, every, least, often, id_col, text_col), "vocabulary")
    best = near_words(found).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = found.join(best, "word", "left")
    has = -F.col("best.less") >= F.col("n") * ratio
    named = checkpointed(joined.select("word", F.when(has, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                       F.when(has, -F.col("best.less")).alias("form_n")), "forms")
    # forms lead on by pointer jumping: each round doubles the steps taken
    links = named.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = checkpointed(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        links = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            break
    return named.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
