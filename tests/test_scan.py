"""Scan operator against a brute-force reading of the rules (Python re),
on the snippet pool: every rule, look-around rules included."""

import re

import pytest
from pyspark.sql import functions as F

from chainscope.operators import scan
from chainscope.sources.snippets import SNIPPETS


def brute(texts, rules, pattern_key, id_key, dedup):
    out = []
    for fid, text in texts:
        lines = text.split("\n")
        for r in rules:
            flags = re.I if "i" in r.get("flags", "") else 0
            seen = set()
            for m in re.finditer(r["pattern"], text, flags):
                before = text[:m.start()]
                line = before.count("\n") + 1
                col = m.start() - before.rfind("\n")
                snip = lines[line - 1].strip()
                snip = snip[:117] + "..." if len(snip) > 120 else snip
                if dedup and line in seen:
                    continue
                seen.add(line)
                out.append((fid, r[id_key], line, col, snip))
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    base = [(f"f{i}.js", s) for i, s in enumerate(SNIPPETS)]
    # shifted copies: text before, blank lines, two snippets in one file
    more = [(f"g{i}.js", "intro line\n\n" + s + "\n" + SNIPPETS[(i + 7) % len(SNIPPETS)]) for i, s in enumerate(SNIPPETS)]
    return base + more


@pytest.mark.parametrize("dedup", [False, True])
def test_source_rules_match_brute_force(spark, texts, dedup):
    rules = scan.source_rules()
    df = spark.createDataFrame([("p", f, t) for f, t in texts], "project_id string, path string, content string")
    got = scan.scan_source(df, rules, dedup=dedup).select("file", "rule_id", "line", "col", "snippet").collect()
    assert sorted(tuple(r) for r in got) == brute(texts, rules, "pattern", "rule_id", dedup)


def test_behavior_rules_match_brute_force(spark, texts):
    rules = scan.behavior_rules()
    df = spark.createDataFrame([("p", "pkg", "1", f, t) for f, t in texts],
                               "project_id string, package string, version string, path string, content string")
    got = scan.scan_behavior(df, rules).select("file", "rule", "line", "col", "snippet").collect()
    assert sorted(tuple(r) for r in got) == brute(texts, rules, "pattern", "rule", True)


def test_every_rule_fires(spark, texts):
    df = spark.createDataFrame([("p", f, t) for f, t in texts], "project_id string, path string, content string")
    fired = {r[0] for r in scan.scan_source(df).select("rule_id").distinct().collect()}
    assert fired == {r["rule_id"] for r in scan.source_rules()}


def test_newlines_shift_lines(spark):
    """Metamorphic: n leading newlines move every finding n lines down."""
    text = "\n".join(SNIPPETS[:20])
    df = spark.createDataFrame([("p", "a.js", text), ("p", "b.js", "\n\n\n" + text)],
                               "project_id string, path string, content string")
    rows = scan.scan_source(df).select("file", "rule_id", "line", "col").collect()
    a = sorted((r.rule_id, r.line, r.col) for r in rows if r.file == "a.js")
    b = sorted((r.rule_id, r.line - 3, r.col) for r in rows if r.file == "b.js")
    assert a == b and len(a) > 10


def test_unicode_word_boundary(spark):
    """JavaScript's \\b is ASCII: an accented letter before eval( is a boundary."""
    df = spark.createDataFrame([("p", "a.js", "éeval(x)")], "project_id string, path string, content string")
    got = scan.scan_behavior(df.withColumn("package", F.lit("x")).withColumn("version", F.lit("1")))
    assert [r.rule for r in got.collect()] == ["no-eval"]


def test_prefilters_are_necessary(texts):
    """Every match found in the snippet pool contains a literal of every
    prefilter group of its rule (lower-cased)."""
    from chainscope.operators import scan as S
    for r in S.source_rules() + S.behavior_rules():
        flags = re.I if "i" in r.get("flags", "") else 0
        for _, t in texts:
            for m in re.finditer(r["pattern"], t, flags):
                low = m.group(0).lower()
                for group in r["prefilter"] or []:
                    assert any(a in low for a in group), (r.get("rule_id") or r.get("rule"), m.group(0), group)


def test_file_cap_keeps_first_paths_per_project(spark):
    from chainscope.sources import files as S
    from chainscope.sources.fixtures import Workspace
    from tests.conftest import SF_SMALL
    src = Workspace.of(spark, SF_SMALL).table("src_files").repartition(7)
    allowed = S.collect_files(src, max_files=None).select("project_id", "path").collect()
    capped = S.collect_files(src, max_files=3).select("project_id", "path").collect()
    want = {}
    for p, path in sorted((r.project_id, r.path) for r in allowed):
        want.setdefault(p, [])
        if len(want[p]) < 3:
            want[p].append(path)
    got = {}
    for r in capped:
        got.setdefault(r.project_id, []).append(r.path)
    assert {k: sorted(v) for k, v in got.items()} == want


def test_running_sum(spark):
    import itertools

    from chainscope.functions.arrays import running_sum

    rows = [(0, []), (1, [5]), (2, [1, 2]), (3, list(range(17))), (4, [3] * 1000), (5, None)]
    df = spark.createDataFrame(rows, "k int, v array<int>")
    got = {r.k: r.s for r in df.select("k", running_sum(F.col("v")).alias("s")).collect()}
    assert got == {k: list(itertools.accumulate(v or [])) for k, v in rows}


@pytest.mark.parametrize("dedup", [False, True])
def test_many_matches_in_a_line_and_a_file(spark, dedup):
    """Positions of matches that share lines, next to the brute force."""
    rules = [r for r in scan.source_rules() if r["rule_id"] == "TS-any-abuse"]
    texts = [("one-line.js", " ".join("a: any;" for _ in range(700))), ("lines.js", "\n".join("a: any; b: any" + " " * (k % 7) for k in range(700))),
             ("long.js", "é" * 500 + "x: any;" + "☃" * 300 + "\ny: any"), ("marks.js", "\ufdd0x: any\ufdd1 y: any")]
    df = spark.createDataFrame([("p", f, t) for f, t in texts], "project_id string, path string, content string")
    got = scan.scan_source(df, rules, dedup=dedup).select("file", "rule_id", "line", "col", "snippet").collect()
    want = brute([(f, t.replace("\ufdd0", "\ufdd1")) for f, t in texts], rules, "pattern", "rule_id", dedup)
    assert rules and sorted(tuple(r) for r in got) == want


@pytest.mark.parametrize("glue,dedup", [("\n", True), ("\n", False), (" ", False)])
def test_work_grows_with_the_matches(spark, glue, dedup):
    import time

    rules, took = scan.source_rules(), {}
    for n in (10_000, 10_000, 20_000, 40_000):  # the first run warms up
        df = spark.createDataFrame([("p", "a.js", glue.join("a: any;" for _ in range(n)))], "project_id string, path string, content string")
        start = time.time()
        found = scan.scan_source(df, rules, dedup=dedup).groupBy("rule_id").count().collect()
        took[n] = time.time() - start
        assert max(r["count"] for r in found) == n
    # with work that grows by the square 40,000 matches took some fifty seconds
    assert took[40_000] < 4 * took[10_000] + 4, took
