"""Decontamination against comparing every text with every item, and the stages' odd rows."""

import random
import re

import pytest

from chainscope.llm import decontaminate
from chainscope.llm.decontaminate import contamination
from chainscope.llm.quality_classifier import Model, score, train
from chainscope.llm.secrets import scan_secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, overlap=13, share=0.8, least=8):
    out = set()
    for i, text in docs:
        w = _words(text)
        for item, told in items:
            b = _words(told)
            if not b:
                continue
            if len(b) < least:
                places = range(len(w) - len(b) + 1) if len(b) >= 5 else [0] if len(w) == len(b) else []
                if first := [k for k in places if w[k:k + len(b)] == b][:1]:
                    out.add((i, item, first[0], len(b), len(b)))
                continue
            size = min(overlap, len(b))
            for shift in range(-len(b) + size, len(w) - size + 1):
                low, high = max(shift, 0), min(shift + len(b), len(w))
                same = [w[k] == b[k - shift] for k in range(low, high)]
                good = [k for k in range(len(same) - size + 1) if sum(same[k:k + size]) >= share * size]
                if good:
                    out.add((i, item, low + good[0], good[-1] + size - good[0], sum(same[good[0]:good[-1] + size])))
    return out


def _made(seed):
    rng = random.Random(seed)
    items = [(k, " ".join(rng.choices("abcdefghij", k=rng.choice([1, 2, 4, 5, 6, 7, 8, 10, 12, 13, 20, 40])))) for k in range(25)]
    items += [(None, "p q r s t u v w x y z"), (90, None), (91, " "), (92, "Q R S T U"), (93, "Q R S T U"), (94, "lone")]
    docs = [(100, None), (101, ""), (102, "lone"), (102, "lone"), (103, "not lone"), (104, "x q r s t u x"), (None, "q r s t u")]
    for k in range(60):
        text = rng.choices("abcdefghijklmnop", k=rng.randrange(1, 60))
        told = _words(items[rng.randrange(25)][1])
        for _ in range(rng.randrange(3)):
            if told:
                told[rng.randrange(len(told))] = "zz"
        at = rng.randrange(len(text) + 1)
        docs.append((k, " ".join(text[:at] + told + text[at:])))
    return docs, items


@pytest.mark.parametrize("seed,block,together", [(1, 500_000, 4), (2, 60, 2)])
def test_contamination_against_brute_force(spark, monkeypatch, seed, block, together):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontaminate, "TOGETHER", together)
    docs, items = _made(seed)
    df = spark.createDataFrame([(*d, "t", 1, "h") for d in docs], "doc_id long, text string, _text string, _hits int, hits string")
    out = contamination(df, spark.createDataFrame(items, "item_id long, text string"))
    assert out.columns == ["doc_id", "text", "_text", "_hits", "hits"]
    rows = out.collect()
    got = {(r.doc_id, h.item_id, h.start, h.length, h.agreeing) for r in rows for h in r.hits}
    assert got == brute(docs, items) and len(rows) == len(docs)
    assert {(102, 94), (104, 92), (104, 93)} <= {x[:2] for x in got} and (103, 94) not in {x[:2] for x in got}


def test_contamination_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string")
    assert contamination(none, bench).collect() == []


CLASH = "doc_id long, text string, _text string, _score int, _spans string, _Base int, _redacted string, quality string"


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(k, f"plain words number {k} here", "t", k, "s", 1, "r", "q") for k in range(6)] + [(None, None, None, None, None, None, None, None)], CLASH)
    labels = spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id long, quality int")
    scored = score(docs, train(docs, labels), score_col="_score")
    assert set(scored.columns) == set(docs.columns) and scored.where("_text = 't' and _redacted = 'r'").count() == 6
    assert scored.where("_score between 0 and 1").count() == 7
    found = scan_secrets(docs)
    assert found.columns == [*docs.columns, "spans", "base", "redacted"] and found.where("_spans = 's' and _Base = 1").count() == 6
    for out in (score(docs.limit(0), Model(*_flat())), scan_secrets(docs.limit(0))):
        assert out.collect() == []


def _flat():
    import numpy as np

    from chainscope.llm.features import NAMES

    n = len(NAMES)
    return np.zeros(n), np.ones(n), np.zeros(n), 0.0, 0.3
