"""Exact self-join of documents by the Jaccard similarity of word shingles.

Universe-partition pigeonhole.  Sets are put into bands by size, so that two
similar sets lie in the same band or in neighbouring ones.  In a band two
similar sets differ in at most H shingles.  The shingle universe is hashed
into segments; a set's part in a segment is indexed with weight 1 (only as
it is) or 2 (as it is and with each single shingle left out, its
one-deletion neighbourhood).  When the weights of the segments that say
something about a set add up to H + 1 or more, each similar set agrees with
it in one of them: to fail, it would have to differ H + 1 times.

How many segments a band gets, and of which weight, is chosen by cost
(``plan``): signatures sent, plus those of the second plan for the sets that
the first does not cover because too many of their segments are empty.  The
second plan gives all segments weight 2; sets that even this leaves
uncovered (a few, tiny or odd) meet under their band alone.  Each step is
exact, no candidate is dropped.

Shingles of many documents (a common line's) would make small segments
agree everywhere.  They are left out at first: two sets differ no more
without them than with them, so the pigeonhole still holds for the rest,
and sets that the rest does not cover go through the plans with all their
shingles.  Which shingles are left out changes the cost alone, never the
result, so a bounded list of the commonest will do (``POPULAR``).

Sets that share a signature are joined into families over the signatures'
least members, without pairs.  Families chain: a set may share a passage
with one set and another passage with the next.  So a family is first cut by
sketches, a set's shingles hashed to about as many bits, each the parity of
its shingles.  Two sets' sketches differ in no more bits than the sets in
shingles, so pairs whose sketches differ in more cannot be similar, and the
remaining pairs' components are the families whose texts are compared.
Sketches meet in their size bands, in blocks of bounded size.

Each set's text then goes to its family, which is cut into blocks of bounded
size; blocks verify exactly, by counts of common shingles, and give out a
spanning forest of the links.  Copies of a set are one class throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainscope.llm import blobs, words
from chainscope.llm.components import components
from chainscope.llm.store import checkpointed

U64 = np.uint64
_SIG, _EDGE, _SETS = 0, 1, 2
#: Sets and shingles in a block; two blocks meet in a task.
BLOCK_SETS, BLOCK_SHINGLES = 1000, 600_000
#: Sets and 64-bit words in a block of sketches; sketches compared at once.
BLOCK_SKETCHES, BLOCK_WORDS, TILE = 2000, 1 << 21, 64
#: Shingles of more sets of a block are counted by a matrix product, others pair by pair.
DENSE = 32
#: Cost of an uncovered set, as a multiple of its signatures in the second plan.
UNCOVERED = 4
#: How much more a plan may cost that compares larger parts.
DEARER = 1.15
#: Shingles of at least this share of the documents are popular; at most so many are.
POPULAR_SHARE, POPULAR = 1 / 500, 1 << 18
_SET = np.dtype([("doc", "<i8"), ("h1", "<i8"), ("h2", "<i8"), ("n", "<i8")])


@dataclass(frozen=True)
class Plan:
    """Segments of a band; the first ``double`` of them have weight 2.  A segment
    counts only if the set has ``least`` shingles there (one more for weight 2):
    smaller parts agree too easily."""

    segments: int
    double: int
    need: int  # H + 1
    least: int = 1


def distance(hi: int, num: int, den: int) -> int:
    """Most shingles in which two similar sets of at most ``hi`` shingles differ."""
    return 2 * hi * (den - num) // (den + num)


def _poisson(mean: float, k: int) -> float:
    """The chance of at most k."""
    term = total = math.exp(-mean)
    for i in range(1, k + 1):
        term *= mean / i
        total += term
    return min(1.0, total)


@lru_cache(maxsize=None)
def plan(lo: int, hi: int, num: int, den: int) -> Plan:
    """The first plan of a band of sizes lo..hi: of the plans that cost at most
    ``DEARER`` times the cheapest, the cheapest of those with the largest parts."""
    need = distance(hi, num, den) + 1
    if need == 1:
        return Plan(1, 0, 1)
    tries = sorted({*range((need + 1) // 2, 2 * need + 8 + 2 * math.isqrt(need)), need})
    tries = sorted({*tries[:: max(1, len(tries) // 64)], *tries[-1:], need})
    best: dict[int, tuple[float, Plan]] = {}
    for least in (1, 2, 3, 4):
        for m in tries:
            size = lo / m
            idle, half = _poisson(size, least - 1), _poisson(size, least)
            for double in range(max(0, need - m), max(0, need - m) + 3):
                if double > m:
                    continue
                slack = m + double - need
                mean = (m - double) * idle + 2 * double * half
                spread = math.sqrt((m - double) * idle * (1 - idle) + 4 * double * half * (1 - half)) + 1e-9
                bare = 1 - _poisson(mean, slack) if mean < 5 else 0.5 * math.erfc((slack + 0.5 - mean) / spread / math.sqrt(2))
                cost = (m - double) * (1 - idle) + double * (size + 1) + UNCOVERED * max(0.0, bare) * (lo + need)
                if least not in best or cost < best[least][0]:
                    best[least] = cost, Plan(m, double, need, least)
    limit = DEARER * min(c for c, _ in best.values())
    return next(best[least][1] for least in (4, 3, 2, 1) if best[least][0] <= limit)


def second(hi: int, num: int, den: int) -> Plan:
    need = distance(hi, num, den) + 1
    m = (need + 1) // 2
    return Plan(m, m, need)


class Bands:
    """Size bands: a set's partners lie in its own band or a neighbouring one."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den, self.hi = num, den, [0]

    def of(self, n: int) -> int:
        while self.hi[-1] < n:
            lo = self.hi[-1] + 1
            self.hi.append(max(lo, lo * self.den // self.num))
        return int(np.searchsorted(self.hi, n))

    def range(self, k: int) -> tuple[int, int]:
        self.of(self.hi[-1] + 1) if k >= len(self.hi) else None
        return self.hi[k - 1] + 1, self.hi[k]


def _signed(band: int, which: int, p: Plan, shingles: np.ndarray) -> tuple[np.ndarray, bool]:
    """A set's signatures under a plan, and whether the plan covers it."""
    salt = words.mix(np.array([band * 4 + which], U64))[0]
    segment = (words.mix(shingles ^ salt) % U64(p.segments)).astype(np.int64)
    value = words.mix(shingles + salt)
    sums, counts = np.zeros(p.segments, U64), np.bincount(segment, minlength=p.segments)
    np.add.at(sums, segment, value)
    tag = np.arange(p.segments, dtype=U64) * words.STEP + salt
    has = counts >= p.least
    weight = int(has[p.double:].sum()) + 2 * int((counts[:p.double] > p.least).sum())
    out = [(sums + counts.astype(U64) + words.mix(tag))[has]]
    if p.double:
        left = (segment < p.double) & (counts[segment] > p.least)
        s = segment[left]
        out.append(sums[s] - value[left] + (counts[s] - 1).astype(U64) + words.mix(tag)[s])
    return words.mix(np.concatenate(out)), weight >= p.need


def signatures(shingles: np.ndarray, bands: Bands, popular: np.ndarray) -> np.ndarray:
    """All signatures of a set of distinct shingle hashes; ``popular`` is sorted."""
    n, out = len(shingles), []
    own = bands.of(n)
    rest = shingles
    if len(popular):
        rest = shingles[popular[np.minimum(np.searchsorted(popular, shingles), len(popular) - 1)] != shingles]
    for band in (own, own + 1):
        lo, hi = bands.range(band)
        if band > own and bands.den * n < bands.num * lo:
            continue
        first = plan(lo, hi, bands.num, bands.den)
        for which, (p, part) in enumerate(((first, rest), (first, shingles), (second(hi, bands.num, bands.den), shingles))):
            signed, covered = _signed(band, which, p, part)
            out.append(signed)
            if covered:
                break
        else:
            out.append(words.mix(np.array([band], U64) * words.STEP + U64(7)))
    return np.concatenate(out)


def shingle_sets(w: words.Words, size: int) -> Iterator[np.ndarray]:
    """Each row's distinct shingle hashes, sorted; a text with fewer words than
    ``size`` has its whole sequence as one shingle."""
    hashed = words.mix(words.windows(w.hashes, size))
    for a, b in zip(w.first.tolist(), w.first[1:].tolist()):
        if b - a >= size:
            yield np.unique(hashed[a:b - size + 1])
        elif b > a:
            yield words.mix(words.windows(w.hashes[a:b], b - a)[:1] + U64(b - a))
        else:
            yield hashed[:0]


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    one, two = words.mix(shingles), words.mix(shingles ^ words.STEP)
    n = U64(len(shingles))
    return tuple(words.mix(np.array([one.sum() + n, two.sum() ^ n], U64)).view(np.int64).tolist())


class _Sent:
    """Signatures on their way to the buckets, combined flush by flush."""

    def __init__(self, n: int) -> None:
        self.n, self.rows = n, blobs.Rows()
        self.signatures, self.nodes, self.sets, self.size = [], [], [], 0

    def add(self, signed: np.ndarray, doc: int | None, h1: int, h2: int, n: int) -> None:
        self.sets.append((doc or 0, h1, h2, 2 * n + (doc is None)))
        if len(signed):
            self.signatures.append(signed)
            self.nodes.append(np.full(len(signed), h1))
        self.size += len(signed) + 4

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.sets:
            sets = np.array(self.sets, _SET)
            # by document, not by set: many may hold the same one
            place = words.mix(sets["doc"].astype(U64) + np.arange(len(sets), dtype=U64) * words.STEP)
            self.rows.put(_SETS, (place % U64(self.n)).astype(np.int64), self.n, sets)
        if self.signatures:
            signed, nodes, edges = _stars(np.concatenate(self.signatures), np.concatenate(self.nodes))
            order, at = blobs.split((signed % U64(self.n)).astype(np.int64), self.n)
            for k in np.flatnonzero(np.diff(at)):
                own = order[at[k]:at[k + 1]]
                table, number = np.unique(nodes[own], return_inverse=True)
                self.rows.cells.append((int(k), _SIG, signed[own].tobytes(), table.tobytes(), number.astype(_number(len(table))).tobytes()))
            self.rows.put(_EDGE, np.mod(edges[:, 1], self.n), self.n, edges)
        self.signatures, self.nodes, self.sets, self.size = [], [], [], 0
        yield from self.rows.take()


def _number(n: int) -> type:
    """The type that numbers n nodes."""
    return np.uint16 if n <= 1 << 16 else np.uint32


def _nodes(table: bytes, number: bytes) -> np.ndarray:
    table = np.frombuffer(table, np.int64)
    return table[np.frombuffer(number, _number(len(table)))]


def _stars(signed: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One (signature, least node) for each signature, and edges from that node
    to the signature's others."""
    order = np.lexsort((nodes, signed))
    signed, nodes = signed[order], nodes[order]
    new = np.ones(len(signed), bool)
    new[1:] = signed[1:] != signed[:-1]
    centre = nodes[new][np.cumsum(new) - 1]
    apart = centre != nodes
    edges = np.unique(np.stack([centre[apart], nodes[apart]], 1), axis=0) if apart.any() else np.zeros((0, 2), np.int64)
    return signed[new], nodes[new], edges


_COUNTED = pa.schema([("h", pa.int64()), ("c", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch], size: int, lower: bool) -> Iterator[pa.RecordBatch]:
    """Shingles that a flush has in many documents, and (under null) its documents."""
    held, docs, many = [], 0, 0

    def flush() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, U64), np.zeros(0, np.int64))
        often = counts >= max(4, docs // 250)
        return pa.RecordBatch.from_arrays([pa.array([*values[often].view(np.int64).tolist(), None], pa.int64()), pa.array([*counts[often].tolist(), docs], pa.int64())], schema=_COUNTED)

    for batch in batches:
        for part in words.slices(batch):
            sets = list(shingle_sets(words.words(part.column("text"), lower), size))
            held += sets
            docs += len(sets)
            many += sum(map(len, sets))
            if many >= blobs.FLUSH:
                yield flush()
                held, docs, many = [], 0, 0
    if docs:
        yield flush()


def popular_shingles(rows: DataFrame, size: int, lower: bool) -> np.ndarray:
    """The hashes of the commonest shingles, sorted, POPULAR at most."""
    counts = rows.mapInArrow(partial(_counted, size=size, lower=lower), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    counts = checkpointed(counts, "popular")
    docs = counts.where("h is null").first()
    if docs is None:
        return np.zeros(0, U64)
    most = counts.where((F.col("h").isNotNull()) & (F.col("c") >= docs["c"] * POPULAR_SHARE)).orderBy(F.desc("c"), "h").limit(POPULAR).select("h").toPandas()
    return np.sort(most.h.to_numpy(np.int64).view(U64))


def _send(batches: Iterator[pa.RecordBatch], size: int, num: int, den: int, lower: bool, n: int, popular) -> Iterator[pa.RecordBatch]:
    out, bands = _Sent(n), Bands(num, den)
    for batch in batches:
        for part in words.slices(batch):
            ids = part.column("doc_id").to_pylist()
            for doc, shingles in zip(ids, shingle_sets(words.words(part.column("text"), lower), size)):
                if len(shingles):
                    out.add(signatures(shingles, bands, popular.value), doc, *_digest(shingles), len(shingles))
                else:
                    out.add(shingles, doc, 0, 0, 0)
                if out.size >= blobs.FLUSH:
                    yield from out.flush()
    yield from out.flush()


_GATHERED = pa.schema([("kind", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("z", pa.int64()), ("n", pa.int64())])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a bucket's signatures, and the sets that came along."""
    made: list[pa.RecordBatch] = []

    def fold(_bucket: int, rows: list[tuple], _out: blobs.Rows) -> None:
        signed = [r for r in rows if r[0] == _SIG]
        edges = [blobs.joined([r[1] for r in rows if r[0] == _EDGE], np.int64).reshape(-1, 2)]
        if signed:
            edges.append(_stars(blobs.joined([r[1] for r in signed], U64), np.concatenate([_nodes(r[2], r[3]) for r in signed]))[2])
        pairs = np.unique(np.concatenate(edges), axis=0)
        sets = blobs.joined([r[1] for r in rows if r[0] == _SETS], _SET)
        none = np.zeros(len(pairs), np.int64)
        for kind, cells in ((_EDGE, (pairs[:, 0], pairs[:, 1], none, none)), (_SETS, tuple(np.ascontiguousarray(sets[c]) for c in ("doc", "h1", "h2", "n")))):
            if len(cells[0]):
                made.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(cells[0]), kind, np.int32)), *map(pa.array, cells)], schema=_GATHERED))

    for _ in blobs.folded(batches, fold):
        pass
    yield from made


def _links(sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of sets are similar (pairs of one side are left out when there are two)."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(place, kind="stable")
    owner, first = owner[order], np.concatenate([[0], np.cumsum(counts)[:-1]])
    common = np.zeros((len(sets), len(sets)), np.int32)
    for k in range(2, min(DENSE, int(counts.max())) + 1):
        own = owner[first[counts == k][:, None] + np.arange(k)]
        for i in range(k):
            for j in range(i + 1, k):
                np.add.at(common, (own[:, i], own[:, j]), 1)
    common += common.T
    many = np.flatnonzero(counts > DENSE)
    for a in range(0, len(many), 4096):
        part = np.zeros((len(sets), 4096), np.float32)
        for c, k in enumerate(many[a:a + 4096].tolist()):
            part[owner[first[k]:first[k] + counts[k]], c] = 1
        common += (part @ part.T).astype(np.int32)
    linked = den * common >= num * (sizes[:, None] + sizes[None, :] - common)
    if side.any():
        linked &= side[:, None] != side[None, :]
    np.fill_diagonal(linked, False)
    return linked


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what all links join."""
    edges, left = [], linked.any(1)
    while left.any():
        reach = np.flatnonzero(left)[:1]
        left[reach] = False
        while len(reach):
            near = linked[reach] & left
            new = np.flatnonzero(near.any(0))
            edges += zip(reach[near[:, new].argmax(0)].tolist(), new.tolist())
            left[new] = False
            reach = new
    return edges


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the shingles hashed to the power of two of bits from their number on."""
    bits = 1 << max(6, (len(shingles) - 1).bit_length())
    place = (words.mix(shingles + words.STEP) & U64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(bool), bitorder="little").view(U64)


def _narrowed(bits: np.ndarray, width: int) -> np.ndarray:
    """The sketch of the same set in ``width`` words."""
    while len(bits) > width:
        bits = bits[:len(bits) // 2] ^ bits[len(bits) // 2:]
    return bits


def _near(sketches: list[np.ndarray], sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of sets are similar as far as their sketches tell."""
    order = np.argsort(sizes, kind="stable")
    n = sizes[order]
    width = np.array([len(sketches[k]) for k in order])
    near = np.zeros((len(n), len(n)), bool)
    for w in np.unique(width).tolist():
        a, b = np.searchsorted(width, [w, w + 1]).tolist()
        end = int(np.searchsorted(n, n[b - 1] * den // num, "right"))
        table = np.stack([_narrowed(sketches[k], w) for k in order[a:end]], axis=1)
        for i in range(a, b, TILE):
            j = min(b, i + TILE)
            stop = int(np.searchsorted(n, n[j - 1] * den // num, "right"))
            differ = np.zeros((j - i, stop - i), np.int64)
            for word in table:
                differ += np.bitwise_count(word[i - a:j - a, None] ^ word[None, i - a:stop - a])
            near[i:j, i:stop] = differ * (den + num) <= (n[i:j, None] + n[None, i:stop]) * (den - num)
    near |= near.T
    back = np.argsort(order)
    return near[np.ix_(back, back)]


def _sketched(batches: Iterator[pa.RecordBatch], size: int, num: int, den: int, lower: bool) -> Iterator[pa.RecordBatch]:
    """Each set's sketch, its band, and whether a similar set may lie in the next one."""
    bands = Bands(num, den)
    for batch in batches:
        for part in words.slices(batch):
            rows = []
            for doc, shingles in zip(part.column("doc_id").to_pylist(), shingle_sets(words.words(part.column("text"), lower), size)):
                if doc is not None and len(shingles):
                    own = bands.of(len(shingles))
                    rows.append((doc, *_digest(shingles), own, den * len(shingles) >= num * bands.range(own + 1)[0], sketch(shingles).tobytes()))
            if rows:
                kinds = pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["class_id", "h1", "h2", "band", "up", "bits"])


def _sift(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs that join what all pairs of near sketches join, for each (family, band,
    block, block) of a task's sorted rows.  Guests from the band below meet hosts alone."""
    now, held = None, []

    def done() -> pa.RecordBatch:
        ids, sizes, sides, guests = (np.array([r[k] for r in held]) for k in range(4))
        near = _near([np.frombuffer(r[4], U64) for r in held], sizes.astype(np.int64), num, den)
        if now[2] != now[3]:
            near &= sides[:, None] != sides[None, :]
        near &= ~(guests[:, None] & guests[None, :])
        np.fill_diagonal(near, False)
        pairs = _forest(near)
        return pa.RecordBatch.from_pydict({"a": pa.array([int(ids[a]) for a, _ in pairs], pa.int64()), "b": pa.array([int(ids[b]) for _, b in pairs], pa.int64())})

    for batch in batches:
        cells = [batch.column(c).to_pylist() for c in ("fam", "g", "bi", "bj", "class_id", "n_shingles", "own", "guest", "bits")]
        for fam, g, bi, bj, *row in zip(*cells):
            if (fam, g, bi, bj) != now:
                if len(held) > 1:
                    yield done()
                now, held = (fam, g, bi, bj), []
            held.append(row)
    if len(held) > 1:
        yield done()


def _met(placed: DataFrame, keys: list[str], per: int, weight: str, most: int, *more) -> DataFrame:
    """Members of each group in blocks of bounded size, once for each pair of blocks."""
    room = F.greatest(F.ceil(F.count("*") / per), F.ceil(F.sum(weight) / most)).cast("int")
    blocks = checkpointed(placed.groupBy(*keys).agg(room.alias("nb"), F.count("*").alias("c"), *more).where("c > 1"), "blocks")
    placed = placed.join(blocks, keys).withColumn("own", F.pmod(F.xxhash64("class_id"), F.col("nb")).cast("int"))
    met = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    return met.withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other"))


def _verify(batches: Iterator[pa.RecordBatch], size: int, num: int, den: int, lower: bool) -> Iterator[pa.RecordBatch]:
    """Links inside each (family, block, block) of a task's sorted rows."""
    now, ids, sides, sets = None, [], [], []

    def done() -> pa.RecordBatch:
        linked = _links(sets, np.array(sides), num, den)
        pairs = [(ids[a], ids[b]) for a, b in _forest(linked)]
        return pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    for batch in batches:
        for part in words.slices(batch):
            cells = [part.column(c).to_pylist() for c in ("fam", "bi", "bj", "doc_id", "own", "h1", "h2")]
            for fam, bi, bj, doc, own, h1, h2, shingles in zip(*cells, shingle_sets(words.words(part.column("text"), lower), size)):
                if (fam, bi, bj) != now:
                    if len(ids) > 1:
                        yield done()
                    now, ids, sides, sets = (fam, bi, bj), [], [], []
                if len(shingles) and _digest(shingles) == (h1, h2):
                    ids.append(doc), sides.append(bi != bj and own == bj), sets.append(shingles)
    if len(ids) > 1:
        yield done()


def jaccard_components(docs: DataFrame, shingle: int = 3, num: int = 90, den: int = 100, lower: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and class_id for each row.

    Two documents link when ``den`` * common >= ``num`` * united shingles; a
    component is what links reach, named by its least doc_id.  class_id names
    the documents of equal sets likewise.  Null and empty texts, and texts of
    separators alone, have 0 shingles, link with nothing and are their own
    component, equal texts among them too.  Repeated rows and copies have equal
    sets and link.  A row without id keeps a null doc_id; its component is named
    by the rows with an id that have the same set, else null.  Columns beside
    id and text are not read.  An empty table gives an empty result.
    """
    spark, n = docs.sparkSession, blobs.bucket_count(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    popular = spark.sparkContext.broadcast(popular_shingles(rows, shingle, lower))  # POPULAR numbers at most
    sent = rows.mapInArrow(partial(_send, size=shingle, num=num, den=den, lower=lower, n=n, popular=popular), blobs.SCHEMA)
    gathered = checkpointed(blobs.by_bucket(sent).mapInArrow(_gather, "kind int, x long, y long, z long, n long"), "gathered")

    sets = gathered.where(F.col("kind") == _SETS).select(
        F.when(F.col("n") % 2 == 0, F.col("x")).alias("doc_id"), F.col("y").alias("h1"), F.col("z").alias("h2"), F.floor(F.col("n") / 2).alias("n_shingles"))
    classes = checkpointed(sets.where("n_shingles > 0").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("class_id")), "classes")

    families = components(gathered.where(F.col("kind") == _EDGE).select(F.col("x").alias("a"), F.col("y").alias("b")))
    members = classes.where("class_id is not null").join(families.select(F.col("node").alias("h1"), F.col("root").alias("fam")), "h1")
    p = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sketches = rows.mapInArrow(partial(_sketched, size=shingle, num=num, den=den, lower=lower), "class_id long, h1 long, h2 long, band int, up boolean, bits binary")
    placed = checkpointed(members.join(sketches, ["class_id", "h1", "h2"]), "sketches")
    placed = placed.withColumn("g", F.explode(F.when(F.col("up"), F.array("band", F.col("band") + 1)).otherwise(F.array("band"))))
    placed = placed.withColumn("guest", F.col("g") != F.col("band")).withColumn("words", F.octet_length("bits") / 8)
    met = _met(placed, ["fam", "g"], BLOCK_SKETCHES, "words", BLOCK_WORDS, F.bool_and("guest").alias("idle")).where("not idle")
    met = met.select("fam", "g", "bi", "bj", "class_id", "n_shingles", "own", "guest", "bits")
    near = met.repartition(p, "fam", "g", "bi", "bj").sortWithinPartitions("fam", "g", "bi", "bj").mapInArrow(partial(_sift, num=num, den=den), "a long, b long")
    sifted = components(near)

    members = checkpointed(classes.join(sifted.select(F.col("node").alias("class_id"), F.col("root").alias("fam")), "class_id"), "members")
    met = _met(members, ["fam"], BLOCK_SETS, "n_shingles", BLOCK_SHINGLES)
    met = met.select("fam", "bi", "bj", F.col("class_id").alias("doc_id"), "own", "h1", "h2")
    texts = met.join(rows.where("doc_id is not null"), "doc_id")
    linked = texts.repartition(p, "fam", "bi", "bj").sortWithinPartitions("fam", "bi", "bj").mapInArrow(
        partial(_verify, size=shingle, num=num, den=den, lower=lower), "a long, b long")
    roots = checkpointed(components(linked), "roots")

    named = checkpointed(classes.join(roots.select(F.col("node").alias("class_id"), "root"), "class_id", "left")
                         .select("h1", "h2", "class_id", F.coalesce("root", "class_id").alias("component")), "named")
    out = sets.join(named, ["h1", "h2"], "left")
    alone = F.col("n_shingles") == 0
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
                      F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))
