"""Automata and the operators on words: source divergence, the lexicon's BPE, spelling variants."""

import collections
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chainscope.llm import lexicon_bpe, queries, source_divergence, spelling
from chainscope.llm.automaton import Automaton

SF = "/root/testdata/sf0.001"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(max_size=5).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=40))
def test_automaton_is_minimal_and_numbers_its_words(held):
    held = sorted(held)
    a = Automaton(held)
    found, endings = [], {}

    def walk(state, word, number):
        if a.final[state]:
            found.append((word, number))
        for e in range(a.first[state], a.first[state + 1]):
            walk(a.target[e], word + bytes([a.symbol[e]]), number + a.before[e])

    def language(state):
        out = {b""} if a.final[state] else set()
        for e in range(a.first[state], a.first[state + 1]):
            out |= {bytes([a.symbol[e]]) + w for w in language(a.target[e])}
        return out

    walk(a.start, b"", 0)
    assert found == [(w, k) for k, w in enumerate(held)]
    for state in range(len(a.final)):
        own = frozenset(language(state))
        assert own not in endings and a.below[state] == len(own)  # no two states accept the same endings
        endings[own] = state


# ---------------------------------------------------------------- source divergence

ROWS = [(k, f"Alpha beta gamma{k % 3} Été x_y {'delta ' * (k % 5)}", ["en", "de", None][k % 3], f"s{k % 4}") for k in range(60)]
ROWS += [(61, None, "en", None), (62, "", "fr", "only"), (63, "solo words", "fr", "two"), (63, "solo words", "fr", "two"), (None, " \x00~[`{ ", "xx", "a"), (64, "beta " * 5000, "en", "s0")]


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, lang string, source string, term string, n int")


def _by_sql(rows):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", rows) if rows else None
    return sorted(con.sql(source_divergence.SQL).fetchall())


@pytest.mark.parametrize("groups,held,columns", [(32, 256, 2048), (2, 3, 4)])
def test_source_divergence(spark, monkeypatch, groups, held, columns):
    monkeypatch.setattr(source_divergence, "GROUPS", groups)
    monkeypatch.setattr(source_divergence, "TERMS", held)
    monkeypatch.setattr(source_divergence, "COLUMNS", columns)
    got = sorted(tuple(r) for r in source_divergence.divergence(_frame(spark, ROWS)).collect())
    want = _by_sql(ROWS)
    assert got == want and {r[2] for r in got} == {"pair", "term"}
    assert ("fr", "only", "pair", "two", 0, 1) in got  # a language that keeps no term


def test_source_divergence_of_nothing(spark):
    assert source_divergence.divergence(_frame(spark, [])).collect() == []


def test_joint_tables_price_like_single_terms():
    rng = np.random.default_rng(3)
    left, right = rng.integers(1, 9, (50, 4)) ** 9, rng.integers(1, 9, (50, 3)) ** 9
    for y in (left, right):
        got = source_divergence.pair_sums(left, left if y is left else y)
        want = [[sum((int(p) - int(q)) ** 2 // (int(p) + int(q)) for p, q in zip(left[:, a], y[:, b])) for b in range(y.shape[1])] for a in range(4)]
        keep = np.triu(np.ones(got.shape, bool)) if y is left else np.ones(got.shape, bool)
        assert (got[keep] == np.array(want)[keep]).all()


def test_price_beyond_long(spark):
    row = spark.range(1).select(source_divergence._price(F.lit(9 * 10**15), F.lit(10**16), F.lit(10**6)).alias("p")).first()
    assert row.p == 1 + 10**9 * (9 * 10**15 + 2) // (10**16 + 2 * 10**6)


# ---------------------------------------------------------------- BPE

TEXTS = [None, "", " \n ", "É中İ 'tis it's x<|endoftext|>the <|startoftext|>end<|endoftext|>", "a" * 3000 + " " + "abcdefgh" * 90, "ΣΑΣ x​ é été !'s '' 'S 'LL 12345 ½ ǅ",
         "'s's'll'd d'accord l'éé\tñ\u0085b", "<|endoftext|>", "Straße ŉ ß ƀ \x00 x", "the same", "the same", "w" * 40 + " é" * 50]


def _library():
    t = Tokenizer.from_file(WORD_BPE)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("size", [0, 3, 1 << 16])
def test_encode_and_decode(spark, size):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-k if k != 3 else None, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")).withColumns({"ids": F.lit("x"), "decoded": F.lit(1)})
    rows = collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in lexicon_bpe.decode(lexicon_bpe.encode(docs, WORD_BPE, size), WORD_BPE).collect())
    t = _library()
    want = collections.Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, tuple(ids), t.decode(ids, skip_special_tokens=False)] += 1
    assert rows == want


def test_encode_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lexicon_bpe.decode(lexicon_bpe.encode(docs, WORD_BPE), WORD_BPE).collect() == []


def test_decode_of_unknown_ids(spark):
    rows = spark.createDataFrame([(1, [320, 10**9, -4, 320]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in lexicon_bpe.decode(rows, WORD_BPE).collect()}
    one = _library().decode([320, 320])
    assert got == {1: one, 2: "", 3: ""}


def test_lexicon_holds_what_it_was_given():
    known = lexicon_bpe.vocabulary(WORD_BPE)
    held = sorted([b"the", b"then", b"them", b"anthem", "été".encode(), b"x" * 70, bytes(range(1, 255))])
    ids, at = known.merge(held)
    lexicon = lexicon_bpe.Lexicon(lexicon_bpe.compiled(held, ids, at))
    asked = [*held, b"th", b"thee", b"t", b"\xff", b"xx"]
    data = np.frombuffer(b"".join(asked), np.uint8)
    ends = np.cumsum([len(w) for w in asked])
    number = lexicon.find(data, ends - [len(w) for w in asked], ends)
    assert number.tolist() == [*range(len(held)), *[-1] * 5]
    assert (lexicon.ids == ids).all() and (lexicon.at == at).all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abehint'", min_size=1, max_size=80), min_size=1, max_size=9))
def test_merging_is_the_librarys(found):
    ids, at = lexicon_bpe.vocabulary(WORD_BPE).merge([p.encode() for p in found])
    model = _library().model
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [[x.id for x in model.tokenize(p)] for p in found]


# ---------------------------------------------------------------- spelling variants

def brute_variants(rows, every=97):
    up, counts = {i: i + 32 for i in range(65, 91)}, collections.Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(up)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) - len(short) == 1 and any(long[:k] + long[k + 1:] == short for k in range(len(long)))

    out, form = {}, {}
    for w in n:
        own = [x for x in n if near(w, x)]
        best = min(own, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
        out[w] = len(own)

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], out[w], n[form[w]] if form[w] else None) for w in n)


def _key(r):
    return tuple("" if x is None else str(x) for x in r)


@pytest.mark.parametrize("part,chunk", [(20_000, 100_000), (4, 50)])
def test_variants(spark, monkeypatch, part, chunk):
    monkeypatch.setattr(spelling, "PART", part)
    monkeypatch.setattr(spelling, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("aabé"), rng.integers(4, 8))) for _ in range(90)] + ["straÿe", "STRAßE", "z" * 300, "z" * 301, "aaaaa", "aaaaaa", "aaaaaaa"]
    rows = [(None if k == 7 else k, " ".join(rng.choice(vocabulary, 300) if k % 3 else rng.choice(vocabulary[:30], 300))) for k in range(25)] + [(90, None), (91, ""), (92, "-- 12"), (92, "aaaaa aaaaa aaaaa")]
    docs = spark.createDataFrame([(*r, "q", 3) for r in rows], "doc_id long, text string, word string, n int")
    for every in (97, 3):
        got = [tuple(r) for r in spelling.variants(docs, every=every).select("word", "form", "root", "n", "n_near", "form_n").collect()]
        assert sorted(got, key=_key) == sorted(brute_variants(rows, every), key=_key)


def test_variants_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_crcs_carry_on():
    texts = [b"a", b"abcdefgh", b"x" * 500, b"", bytes(range(200))]
    ends = np.cumsum([len(t) for t in texts])
    begun = np.array([zlib.crc32(b"%d:" % k) for k in range(len(texts))], np.uint32)
    got = spelling._crcs(np.frombuffer(b"".join(texts), np.uint8), ends - [len(t) for t in texts], ends, begun)
    assert got.tolist() == [zlib.crc32(b"%d:" % k + t) for k, t in enumerate(texts)]


# ---------------------------------------------------------------- queries

def test_queries_on_whole_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert queries.op12_bpe_lexicon(spark, SF).count() == len(rows)
    got = [tuple(r) for r in queries.op13_spelling_variants(spark, SF).select("word", "n").collect()]
    assert sorted(got) == sorted((r[0], r[3]) for r in _counts_only(rows))


def _counts_only(rows):
    up, counts = {i: i + 32 for i in range(65, 91)}, collections.Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(up)
            h = zlib.crc32(f"{i}:{w}".encode())
            counts[w[:h % len(w)] + w[h % len(w) + 1:] if h % 97 == 0 else w] += 1
    return [(w, None, None, c) for w, c in counts.items() if len(w) >= 5 and c >= 3]
