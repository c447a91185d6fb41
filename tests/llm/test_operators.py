"""The training-data operators against brute force, round trips and odd input."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chainscope.llm import jaccard_join, quality_classifier, queries, secrets, token_files, tokens, words
from chainscope.llm.decontaminate import contamination
from chainscope.llm.html_text import extract_text, render
from chainscope.llm.packing import Packer, pack
from chainscope.llm.quality_rules import judge
from chainscope.llm.secrets import scan_secrets
from chainscope.llm.store import shared_folder
from chainscope.llm.substring_dedup import remove_repeats
from chainscope.llm.warc import archive

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i * i % 9973}" for i in range(40_000))
NEAR = " ".join(f"n{i}" for i in range(100))
ODD = [(1, "plain words here", "en"), (2, None, None), (3, "", "en"), (4, " \n\t ", "xx"), (5, LONG, "en"), (6, LONG + " end", "en"), (7, "plain words here", "en"),
       (7, "plain words here", "en"), (None, "no id at all", "en"), (8, NEAR, "de"), (9, NEAR.replace("n50", "m50"), "de"), (10, "É中İ 'tis it's x", "fr"), (11, "one", "en")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, g, "x", 0, "y") for i, t, g in ODD], "doc_id long, text string, lang string, hits string, score int, kind string")


def brute_components(rows, size, num, lower=True):
    upper = {i: i + 32 for i in range(65, 91)}
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(upper) if lower else t or "")
        sets.append((i, frozenset(tuple(w[k:k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)]) if w else frozenset()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= num * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((str(i), len(s), str(least.get(find(k), i) if s else i)) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("size,num,block", [(3, 90, 1000), (5, 80, 1000), (5, 80, 4)])
def test_jaccard_join(spark, odd, monkeypatch, size, num, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_SKETCHES", block)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    extra = [(100 + k, " ".join(f"v{j if (j * 7 + k) % 45 else k}" for j in range(60))) for k in range(30)]
    df = odd.select("doc_id", "text", "kind").unionByName(spark.createDataFrame([(*r, "z") for r in extra], "doc_id long, text string, kind string"))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.jaccard_components(df, size, num).collect())
    assert got == brute_components(rows + extra, size, num)


def test_plans_cover_what_they_promise():
    bands = jaccard_join.Bands(80, 100)
    rng = np.random.default_rng(1)
    none = np.zeros(0, np.uint64)
    for n in (1, 4, 9, 25, 80, 400):
        for _ in range(15):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            for drop in range(int(n * 0.11) + 1):
                b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, drop).astype(np.uint64)]))
                if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
                    popular = np.sort(a[: n // 3])
                    for p in (none, popular):
                        assert len(np.intersect1d(jaccard_join.signatures(a, bands, p), jaccard_join.signatures(b, bands, p)))


def test_sketches_keep_similar_pairs():
    rng = np.random.default_rng(2)
    for num in (80, 90):
        sets = []
        for n in (1, 3, 10, 60, 70, 130, 300, 1100):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            for drop in (0, n // 20, n // 9, n // 5, n // 2):
                sets += [np.unique(a[drop:]), np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, drop).astype(np.uint64)]))]
        near = jaccard_join._near([jaccard_join.sketch(s) for s in sets], np.array([len(s) for s in sets]), num, 100)
        pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j]
        similar = [100 * len(np.intersect1d(sets[i], sets[j])) >= num * len(np.union1d(sets[i], sets[j])) for i, j in pairs]
        assert all(near[i, j] for (i, j), s in zip(pairs, similar) if s)
        assert sum(near[i, j] for i, j in pairs) < 1.5 * sum(similar)


def brute_repeats(rows, window):
    texts = [WORD.findall(t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[k:k + window]) for w in texts for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, texts):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k:k + window])] > 1:
                gone[k:k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((str(i), len(w), sum(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window", [5, 35, 70])
def test_substring_dedup(spark, odd, window):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(50, "a b " * 60), (51, "x " + NEAR[:200] + "  " + NEAR[100:] + "\nq")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text, r.kept_sha256) for r in remove_repeats(df, window).collect())
    assert got == brute_repeats(rows, window)


def test_warc_round_trip(spark):
    nested = "<p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:9>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n junk"
    pages = [None, "", "a", nested, nested, "a", "é中", "\r\n\r\nWARC/", "y" * 300_000, "end\r\n\r\n"] + [f"p{k % 7}" for k in range(40)]
    rows = [(i, f"http://a/{i}\r\nX: y", h, "z") for i, h in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    best = {}
    for i, _, h, _ in rows:
        best[h or ""] = max(i, best.get(h or "", i))
    want = sorted((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if best[h or ""] == i else "revisit", -1 if best[h or ""] == i else best[h or ""]) for i, _, h, _ in rows)
    for parts in (1, 3):
        got = archive(df.repartition(parts), shared_folder(spark, "warc")).fillna(-1, ["refers_to"]).collect()
        assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
        assert all(r.digest_ok in (True, None) for r in got)
    assert archive(df.limit(0), shared_folder(spark, "warc")).count() == 0


def test_decontamination(spark, odd):
    item = " ".join(f"b{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (None, item), (4, "one two three four five six seven eight nine")], "item_id long, text string")
    swapped = item.replace("b4 ", "q ").replace("b9 ", "q ").replace("b15 ", "q ")
    rows = [(60, f"x y {item.upper()} z"), (61, f"x {swapped} z"), (62, " ".join(f"b{i}" for i in range(0, 20, 2))), (63, "one two three four FIVE six seven eight nine"), (64, "b0 b1 b2 b3 b4 b5 b6")]
    df = odd.select("doc_id", "text", "hits").unionByName(spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, hits string"))
    got = {r.doc_id: [(h.item_id, h.start) for h in r.hits] for r in contamination(df, bench).collect()}
    assert {k: v for k, v in got.items() if v} == {60: [(None, 2), (1, 2)], 61: [(None, 1), (1, 1)], 63: [(4, 0)]}
    assert len(got) == len({i for i, _, _ in ODD}) + len(rows)
    assert contamination(df, bench.limit(0)).where(F.size("hits") > 0).count() == 0


def test_quality_rules(spark, odd):
    got = {r.doc_id: r for r in judge(odd, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    for i, t, _ in ODD:
        w = WORD.findall(t or "")
        seen, repeated = collections.Counter(zip(*(w[k:] for k in range(5)))), set()
        for k in range(len(w) - 4):
            if seen[tuple(w[k:k + 5])] > 1:
                repeated.update(range(k, k + 5))
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (len(w), sum(map(len, w)), len(repeated))
        assert got[i].base_failed == (len(w) < 10 or 100 * len(repeated) > 20 * len(w))
    lines = spark.createDataFrame([(1, "a b\n a b\na b\n\n \na b|# <x>", "en"), (2, "q r s t u " * 3, "en"), (3, "\U0001F98A\U0001F98B " * 40, "zz")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in judge(lines, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert (got[1].n_symbols, got[1].n_dup_lines, got[2].n_repeat_words, got[2].base_failed) == (4, 1, 15, True)
    assert got[3].byte_share > 0.5 and not got[3].kept


def test_quality_fences(spark):
    """The method rejects junk that the base rules pass, short texts too, and little else."""
    out = queries.op5_quality_rules(spark, "/root/testdata/sf0.01").where("not base_failed").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    shares = {r.quality: r.rejected for r in out.groupBy("quality").agg(F.avg((~F.col("kept")).cast("double")).alias("rejected")).collect()}
    assert shares[0] > 0.5 and shares[1] < 0.05
    plain = "the people of this town have been here for a long time and they {} it"
    rows = [(k, plain.format(v), "en" if k % 2 else None) for k, v in enumerate(("like", "love", "know", "want", "need") * 30)]
    junk = [(900, "qxzj vkwq zzxk jqvx wkzq xjqk vzwx qkjz xwvq zkxj", "en"), (901, "the people of this town \U0001F98A have \U0001F98B been here for a long time", "en")]
    got = {r.doc_id: r for r in judge(spark.createDataFrame(rows + junk, "doc_id long, text string, lang string"), public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert len(got) == len(rows) + 2 and all(got[k].kept for k, _, _ in rows)
    assert got[900].chars_outside and got[901].bytes_outside and got[901].n_tokens < 32 and not got[900].kept and not got[901].kept and not got[901].base_failed


def test_classifier_held_out(spark, odd):
    out = queries.op6_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out")
    right = out.select(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.95
    empty = quality_classifier.train(odd, odd.select("doc_id", F.lit(1).alias("quality")))
    got = quality_classifier.score(odd, empty).collect()
    assert len(got) == len(ODD) and all(r.score == pytest.approx(0.5) for r in got)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library(name):
    import random

    import pyarrow as pa

    known, rng = tokens.Encoder(public_tokenizers.path(name)), random.Random(5)
    texts = ["".join(rng.choice("abstrevlmd'' '  \n\t.,!?12é Ñß-中İK$") for _ in range(rng.randint(0, 50))) for _ in range(1500)] + [None, "", "<|endoftext|>", "it's we'll"]
    flat, first = known.ids(pa.array(texts, pa.string()))
    want = known.library.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [flat[a:b].tolist() for a, b in zip(first, first[1:])] == [x.ids for x in want]


def test_packing(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    ids = collections.Counter()
    for i, t, _ in ODD:
        ids[str(i)] += len(plain.encode(t or "", add_special_tokens=False).ids) + 1
    rows = pack(odd, path, end=1, length=256, with_ids=True).collect()
    total, sequences = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        total[str(r.doc_id)] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    assert total == ids
    for parts in sequences.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0
        size = sum(n for _, n in parts)
        assert size == 256 or size & (size - 1) == 0
    assert pack(odd.limit(0), path, end=1).count() == 0


def test_sum_of_squares_choice():
    rng = np.random.default_rng(3)
    packer = Packer(32)
    for k in range(400):
        size = int(rng.integers(1, 32))
        before = packer.count.copy()
        options = {}
        for h in range(0, 33 - size):
            if h and not before[h]:
                continue
            after = before.copy()
            if h:
                after[h] -= 1
            if h + size < 32:
                after[h + size] += 1
            options[h] = int((after[1:32] ** 2).sum())
        packer.place((k, 0, np.zeros(size, np.uint32), size))
        assert int((packer.count[1:32] ** 2).sum()) == min(options.values())


@pytest.mark.parametrize("bits", [1, 7, 8, 16, 17])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000).astype(np.uint32)
    block = token_files.packed(ids, bits)
    assert len(block) == -(-1000 * bits // 8)
    assert (token_files.unpacked(block, bits, 0, 1000) == ids).all() and (token_files.unpacked(block, bits, 123, 456) == ids[123:579]).all()


def test_token_files(spark, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = token_files.token_files(odd, shared_folder(spark, "tokens"), path, end=2, with_ids=True).collect()
    want = collections.Counter((str(i), tuple(plain.encode(t or "", add_special_tokens=False).ids) + (2,)) for i, t, _ in ODD)
    assert collections.Counter((str(r.doc_id), tuple(r.ids)) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert (r.start, r.ids_crc32) == (at, zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += r.n_tokens
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    assert token_files.token_files(odd.limit(0), shared_folder(spark, "tokens"), path, end=2).count() == 0


def test_secrets(spark, odd):
    key, random = "AKIA" + "B3" * 9, "q7Zt2LxV9bKe4RmW8sYd1HcN"
    text = f"my Password = \"hunter2hunter2\" token: secret: abcdefghijklmnop {key} deadbeefdeadbeef0 {random} abcdefghijklmnopqrstuvwxyz0123456789 AKIAshort"
    df = odd.select("doc_id", "text", "score").unionByName(spark.createDataFrame([(90, text, 0)], "doc_id long, text string, score int"))
    got = {r.doc_id: r for r in scan_secrets(df).collect()}
    spans = [(s.kind, text[s.start:s.end]) for s in got[90].spans]
    assert spans == [("assign", "Password = \"hunter2hunter2"), ("access", key), ("hex", "deadbeefdeadbeef0"), ("entropy", random)]
    assert random not in got[90].redacted and "hunter2" not in got[90].redacted and got[90].redacted.startswith("my [secret]")
    assert got[5].redacted == LONG and got[2].redacted is None and got[3].spans == []


@pytest.mark.parametrize("word", secrets.ALLOWED)
def test_secrets_next_to_allowed_words(word):
    key = "q7Zt2LxV9bKe4RmW8sYd1HcN"
    for text in (f"docs/{word}/{key}", f"{key}-{word}", f"{word}{key}{word}", f"{key}{word}{key}"):
        spans = secrets.scan_text(text)[1]
        assert key not in secrets.redacted(text, spans, "[secret]") and all(k == "entropy" for k, _, _ in spans)
        assert len(spans) == text.count(key) and all(word not in text[a:b] for _, a, b in spans)
    assert secrets.scan_text(f"{word}/{word}-{word}")[1] == []


def test_sliding_entropy_is_the_entropy():
    import math

    text = "aZ9kQ2mX7pL4vB8nC3tR6wY1sD5f" * 2
    spans = secrets.random_spans(text, 20, {"hex": 3.2, "mixed": 3.7, "letters": 4.15})
    want = []
    for k in range(len(text) - 19):
        part = text[k:k + 20]
        h = -sum(c / 20 * math.log2(c / 20) for c in collections.Counter(part).values())
        if h >= 3.7:
            want.append((k, k + 20))
    assert spans == [(want[0][0], want[-1][1])]


def test_html(spark):
    html = ("<title>x</title><h1>A &amp; b</h1><p>one<p>two\n <b>bold</b><ul><li>a<li>b<ul><li>c</ul></ul><ol start=3><li>x<li>y</ol><table><tr><td>aa<td>b<tr><td>c<td>dd</table>"
            "<div hidden>no</div><i style='display: none'>no</i><pre> x\n  y</pre>p<br>q<script>'<p>'</script><!-- c --> 1 < 2")
    assert render(html) == "A & b\n\none\n\ntwo bold\n\n- a\n- b\n  - c\n\n3. x\n4. y\n\naa | b\nc  | dd\n\n x\n  y\n\np\nq 1 < 2"
    df = spark.createDataFrame([(1, html, "z"), (2, None, "z"), (3, "", "z"), (4, "<div>" * 3000 + "deep", "z")], "page_id long, html string, text string")
    got = {r.page_id: r for r in extract_text(df).collect()}
    assert got[2].text is None and got[3].text == "" and got[4].text == "deep" and got[1].n_chars == len(render(html))


@pytest.mark.parametrize("tag", ["font", "span", "div", "b", "ul><li", "blockquote", "table><tr><td"])
def test_html_deep(tag):
    """Nothing hidden shows and nothing visible is lost below many unclosed tags."""
    many = f"<{tag}>" * 1500
    seen = render(f"{many}a<script>var x;</script><style>y</style><div hidden>no<i>no</i></div>b")
    assert "".join(seen.split()).replace("-", "").replace(">", "") == "ab"
    inner = "<div>" * 300 + "</div>" * 299
    assert render(f"x<div hidden>{inner}<div>no</div>{'</div>' * 2}y") == "xy"
    words = render("".join(f"<{tag}>w{k} " for k in range(1500)))
    assert {f"w{k}" for k in range(1500)} <= set(words.split())


def test_html_very_deep_is_linear():
    for tag in ("div", "span", "p><b", "li"):
        assert render(f"<{tag}>" * 100_000 + "deep").split()[-1] == "deep"


def test_html_malformed_tables():
    import random

    assert render("<table><tr><form><td>a</td><td>b</td></form></tr></table>") == "a | b"
    assert render("<table><tr><p>x</p></tr></table>") == "x"
    assert render("<table><tr><a>x</a><td>c<tr>text<td>d</table>") == "xtext\n\nc\nd"
    assert render("<table>text<tbody>more<tr><td>c</table>") == "textmore\n\nc"
    assert render("<table><colgroup><col>u<tr><td>c<td>d</table>") == "u\n\nc | d"
    assert render("<table hidden><tr>x<td>no</table>") == "x"
    assert render("<table><tr><td>a<template><tr>no<td>no</template>b</table>") == "ab"
    rng = random.Random(8)
    tags = "table tbody thead tr td th caption colgroup col form p a b div li center table tr td".split()
    for _ in range(3000):
        parts = [rng.choice((f"<{t}>", f"<{t}>", f"</{t}>", f" w{k}w ")) for k, t in enumerate(rng.choices(tags, k=rng.randint(1, 40)))]
        seen = sorted(re.findall(r"w[0-9]+w", render("".join(parts))))
        assert seen == sorted(x.strip() for x in parts if x[0] == " "), "".join(parts)


def test_words_are_the_pattern():
    import pyarrow as pa

    texts = ["a b c\x0bd", None, "", "É中 \r\n x", "  "]
    w = words.words(pa.array(texts))
    found = [bytes(w.data[a:b]).decode() for a, b in zip(w.starts, w.ends)]
    assert found == [x for t in texts for x in WORD.findall(t or "")] and np.diff(w.first).tolist() == [len(WORD.findall(t or "")) for t in texts]


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, SF).cache()
        if name != "packing":
            assert docs.columns == before.columns
        kept[name] = [r[0] for r in docs.select("doc_id").collect()]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.doc_id in set(kept["quality"])]
    first = {(i, c) for i, _, c in brute_components(rows, 5, 80)}
    assert sorted(kept["near_duplicates"]) == sorted(int(i) for i, c in first if i == c)
    assert set(kept["packing"]) == set(kept["secrets"]) == set(kept["decontaminate"])


def test_token_files_of_bounded_size_and_tied_ids(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 400)
    path = public_tokenizers.path("word_bpe_49k.json")
    same = "x" * 80 + " tail "
    rows = [(5, same + str(k)) for k in range(6)] + [(k, f"words of number {k} " * 5) for k in range(40)]
    out = {}
    for order in (rows, rows[::-1]):
        folder = shared_folder(spark, "tokens")
        got = token_files.token_files(spark.createDataFrame(order, "doc_id long, text string").repartition(3), folder, path, end=2).orderBy("start").collect()
        out[order[0]] = [tuple(r) for r in got]
        assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
        assert [r.doc_id for r in got] == sorted(r[0] for r in rows)
    a, b = out.values()
    assert a == b  # texts of one id that begin alike come in one order
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    assert files.where("length > 0").count() > 8 and files.agg(F.max("length")).first()[0] < 4000
