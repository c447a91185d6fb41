"""How the sources of a language differ in the words they use.

A term is a run of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]`` (letters A-Z and all
characters beyond ASCII; A-Z are lower-cased).  A language keeps the V terms
that occur in enough of its documents.  A (language, source) group gives each
of them the price p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N being the
group's occurrences of kept terms.  Two prices differ by
floor((p - q)^2 / (p + q)).

Differences of two sources, summed over all kept terms, come from one-hot
level products.  A group's price depends on its count of the term alone, so
the terms of a block make a matrix of indicator columns, one for each (group,
count level); that matrix's transpose times itself holds, for all pairs of
groups at once, how many terms have which two levels.  Each of these joint
tables is priced once for a pair of levels, not once for a term.  Products
run over blocks of columns in float32, which counts below 2^24 leave exact.

Blocks hold terms of like frequency, since rare terms share few levels.  They
are keyed by (language, band of frequency, part, group blocks), so the terms of
a hot language spread over as many tasks as it has blocks, and a language of
many sources is cut into blocks of groups.  All prices and sums are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainscope.llm import terms, words
from chainscope.llm.store import checkpointed

#: Terms of a block, groups of a group block, columns of a product.
TERMS, GROUPS, COLUMNS = 256, 32, 2048
SCALE = 1_000_000_000

_TERM = np.zeros(256, bool)
_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n (occurrences), docs (documents that hold it)."""
    tally = terms.Tally(["lang", "source", "term"], ["n", "docs"])
    for batch in batches:
        for part in words.slices(batch):
            data, rows = words.utf8(part.column("text"))
            member = _TERM[data]
            starts, ends = terms.runs(member, rows)
            if not len(starts):
                continue
            coded = terms.strings(words._LOWER[data], starts, ends).dictionary_encode()
            codes, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            row = np.repeat(np.arange(part.num_rows), np.diff(np.searchsorted(starts, rows)))
            pair, n = np.unique(row * size + codes, return_counts=True)
            lang, source = (part.column(x).dictionary_encode() for x in ("lang", "source"))
            number = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            key = number[pair // size] * size + pair % size
            order = np.argsort(key, kind="stable")
            key = key[order]
            at = np.flatnonzero(np.diff(key, prepend=-1))
            group, code = key[at] // size, key[at] % size
            yield from tally.add(pa.table({
                "lang": lang.dictionary.take(pa.array(group // len(source.dictionary))), "source": source.dictionary.take(pa.array(group % len(source.dictionary))),
                "term": coded.dictionary.take(pa.array(code)), "n": np.add.reduceat(n[order], at), "docs": np.diff(at, append=len(key))}))
    yield from tally.rest()


def _price(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)); decimals, since 10^9 times a count may pass 2^63."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * whole(count + 2), whole(total + 2 * kept)) + 1


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _onehot(levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indicator columns of a (terms, groups) matrix of levels, and each column's group and level."""
    found = [np.unique(levels[:, g], return_inverse=True) for g in range(levels.shape[1])]
    width = [len(values) for values, _ in found]
    out = np.zeros((len(levels), sum(width)), np.float32)
    for at, (_, which) in zip(np.cumsum([0, *width]), found):
        out[np.arange(len(levels)), at + which] = 1
    return out, np.repeat(np.arange(len(width)), width), np.concatenate([values for values, _ in found])


def pair_sums(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Summed differences of all groups of ``left`` and of ``right``, matrices of
    prices with a row for each term and a column for each group."""
    out = np.zeros((left.shape[1], right.shape[1]), np.int64)
    if not len(left):
        return out
    x, x_group, x_price = _onehot(left)
    y, y_group, y_price = (x, x_group, x_price) if left is right else _onehot(right)
    for a in range(0, x.shape[1], COLUMNS):
        for b in range(a if left is right else 0, y.shape[1], COLUMNS):
            joint = x[:, a:a + COLUMNS].T @ y[:, b:b + COLUMNS]
            i, j = np.nonzero(joint)
            p, q = x_price[a + i], y_price[b + j]
            worth = joint[i, j].astype(np.int64) * ((p - q) ** 2 // (p + q))
            np.add.at(out, (x_group[a + i], y_group[b + j]), worth)
    return out


_PAIRS = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])


def _block(key: tuple, entries: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of one block of terms for the pairs of two blocks of groups."""
    one, two = key[3].as_py(), key[4].as_py()
    term = entries.column("term").combine_chunks().dictionary_encode()
    term = term.combine_chunks() if isinstance(term, pa.ChunkedArray) else term
    matrices, names = [], []
    for side in (one, two):
        own = groups.filter(pc.equal(groups.column("gb"), side)).sort_by("source")
        source = own.column("source").combine_chunks()
        prices = np.tile(own.column("p0").to_numpy(), (len(term.dictionary), 1))
        place = pc.index_in(entries.column("source").combine_chunks(), value_set=source)
        here = place.is_valid().to_numpy(zero_copy_only=False)
        prices[term.indices.to_numpy()[here], place.drop_null().to_numpy()] = entries.column("p").to_numpy()[here]
        matrices.append(prices)
        names.append(source)
        if one == two:
            matrices, names = matrices * 2, names * 2
            break
    sums = pair_sums(matrices[0], matrices[1])
    i, j = np.nonzero(np.triu(np.ones(sums.shape, bool), 1) if one == two else np.ones(sums.shape, bool))
    return pa.table([pa.array([key[0].as_py()] * len(i), pa.string()), names[0].take(pa.array(i)), names[1].take(pa.array(j)), pa.array(sums[i, j])], schema=_PAIRS)


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, value: each pair of a language's sources once."""
    band = F.length(F.bin("total"))
    parts = kept.where("first").groupBy("lang", band.alias("band")).agg(F.ceil(F.count("*") / TERMS).alias("parts"))
    cut = groups.groupBy("lang").agg(F.ceil(F.count("*") / GROUPS).cast("int").alias("cuts"))
    groups = groups.join(cut, "lang").withColumn("gb", F.pmod(F.hash("source"), "cuts")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    groups = groups.withColumns({"one": F.least("gb", "other"), "two": F.greatest("gb", "other")})
    entries = (kept.withColumn("band", band).join(parts, ["lang", "band"]).withColumn("part", F.pmod(F.hash("term"), "parts"))
               .join(groups.select("lang", "source", "in_group", "n_kept", "one", "two"), ["lang", "source"])
               .select("lang", "band", "part", "one", "two", "term", "source", _price(F.col("n"), F.col("in_group"), F.col("n_kept")).alias("p")))
    # the blocks of a language, and one without terms: its pairs are there with value 0 even if no term is kept
    blocks = parts.select("lang", "band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    blocks = blocks.unionByName(groups.select("lang", F.lit(0).alias("band"), F.lit(0).cast("long").alias("part")).distinct())
    free = F.when(F.col("n_kept") > 0, _price(F.lit(0), F.col("in_group"), F.when(F.col("n_kept") > 0, F.col("n_kept")).otherwise(1))).otherwise(1)
    members = groups.join(blocks, "lang").select("lang", "band", "part", "one", "two", "source", "gb", free.alias("p0"))
    key = ["lang", "band", "part", "one", "two"]
    entries = entries.select(*(F.col(c).alias(c) for c in key), "term", "source", "p")  # names of its own, apart from those of members
    both = entries.groupBy(*key).cogroup(members.groupBy(*key))
    return both.applyInArrow(_block, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least_docs: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: how each source of a language differs.

    Part ``pair``: item is another source of the language, value the summed
    difference over all kept terms; all ranks.  Part ``term``: item is a kept
    term that the source uses more than the language does, value its
    difference; the first ``top`` ranks.  Equal values rank by item in UTF-8.

    Null texts, languages and sources count as empty.  Rows that repeat count
    each.  A group without terms has its pairs, a language that keeps no term
    has pairs of value 0, a source alone in its language has none.  Columns
    beside the three are not read.  An empty table gives no rows.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    counts = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    term = Window.partitionBy("lang", "term")
    kept = (counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
            .select("lang", "term", "source", "n", F.sum("n").over(term).alias("total"), F.sum("docs").over(term).alias("docs"),
                    (F.row_number().over(term.orderBy("source")) == 1).alias("first"))
            .where(F.col("docs") >= least_docs).drop("docs"))
    kept = checkpointed(kept, "kept-terms")
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("in_group"))
    of_lang = kept.where("first").groupBy("lang").agg(F.sum("total").alias("in_lang"), F.count("*").alias("n_kept"))
    groups = rows.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = checkpointed(groups.fillna(0, ["in_group", "in_lang", "n_kept"]), "term-groups")

    pairs = _pairs(kept, groups)
    pairs = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    order = lambda: Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(order()))

    priced = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", _price(F.col("n"), F.col("in_group"), F.col("n_kept")).alias("p"), _price(F.col("total"), F.col("in_lang"), F.col("n_kept")).alias("q"))
    more = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    more = more.withColumn("rank", F.row_number().over(order())).where(F.col("rank") <= top)
    return pairs.unionByName(more)


#: The same rows in DuckDB's SQL (table documents).
SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text, row_number() OVER () AS id FROM documents),
w AS (SELECT lang, source, id, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING sum(docs) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(total) AS l FROM k GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS n FROM c JOIN k USING (lang, term) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
      (1 + (1000000000::HUGEINT * (coalesce(c.n, 0)::HUGEINT + 2)) // (coalesce(s.n, 0)::HUGEINT + 2 * v.v)) AS p,
      (1 + (1000000000::HUGEINT * (k.total::HUGEINT + 2)) // (v.l::HUGEINT + 2 * v.v)) AS q
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
tops AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM tops))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""
