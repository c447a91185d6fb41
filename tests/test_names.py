"""The name index against comparing every pair."""

import random

import duckdb
import pytest

from chainscope.operators import names


def _typo(rng, name):
    at, kind = rng.randrange(len(name)), rng.randrange(6)
    if kind == 0:
        return name[:at] + name[at + 1:]
    if kind == 1:
        return name[:at] + rng.choice("abcxyz-_") + name[at:]
    if kind == 2:
        return name[:at] + rng.choice("abcxyz") + name[at + 1:]
    if kind == 3 and len(name) > 1:
        at = min(at, len(name) - 2)
        return name[:at] + name[at + 1] + name[at] + name[at + 2:]
    return name if kind == 4 else _typo(rng, _typo(rng, name) or "a")


def _by_pairs(asked, known):
    con = duckdb.connect()
    con.execute("create table a (name varchar, base varchar)")
    con.executemany("insert into a values (?, ?)", [(n, n.split("/", 1)[1] if n.startswith("@") and "/" in n else n) for n in asked])
    con.execute("create table k as select * from (values " + ", ".join(f"({i}, '{w}')" for i, w in enumerate(known)) + ") t(i, known)")
    con.execute("create macro bare(x) as replace(replace(replace(x, '-', ''), '_', ''), '.', '')")
    return con.sql("""select distinct name, known from a, k where levenshtein(base, known) <= 2
                      or (bare(base) = bare(known) and abs(length(base) - length(known)) <= 2)""").fetchall()


@pytest.mark.parametrize("size,asked", [(400, 300), (100_000, 60)])
def test_index_finds_what_all_pairs_do(spark, size, asked):
    rng = random.Random(size)
    known = sorted({"".join(rng.choices("abcdelnorst-._", k=rng.choice([1, 2, 3, 5, 8, 11, 14]))) for _ in range(size * 2)})[:size]
    rng.shuffle(known)
    queries = sorted({_typo(rng, rng.choice(known)) or "a" for _ in range(asked)} | {"@sc/" + known[0], "a-b.c_d", "abc-_d", "zzzzzzzzzzzzzzzzzzzzzz"})
    frame = spark.createDataFrame([(n,) for n in [*queries, queries[0]]], "name string").distinct()
    pairs = names.pair_features(names.candidate_pairs(frame, names.known_frame(spark, known)))
    got = sorted((r.name, r.known) for r in pairs.collect())
    assert got == sorted(_by_pairs(queries, known))


def test_names_of_nothing(spark):
    none = spark.createDataFrame([], "name string")
    assert names.typosquat(none, names.known_frame(spark)).collect() == []
    odd = spark.createDataFrame([(None,), ("",), ("a",)], "name string")
    assert {r.name for r in names.typosquat(odd, names.known_frame(spark, ["ab", "abcdef"])).collect()} == {"", "a"}
