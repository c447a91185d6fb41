"""Package hashes as digest trees, against a plain reading."""

import hashlib


from chainscope.operators import fingerprint as P

KEYS = ["package", "version"]


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _tree(files):
    level = {}
    for path, content in files:
        h = _sha(path)
        level.setdefault(h[:4], []).append(f"{h}:{_sha(content)}")
    for digits in (2, 0):
        nodes = {k: _sha("\n".join(sorted(v))) for k, v in level.items()}
        level = {}
        for k, node in nodes.items():
            level.setdefault(k[:digits], []).append(f"{k[digits:]}:{node}")
    return _sha("\n".join(sorted(level[""])))


def test_content_hash(spark):
    rows = [("p", "1", f"src/{k}.js", f"// {k % 50}\nrequire('m{k % 3}')") for k in range(3000)] + [("q", "1", "a.js", ""), ("q", "2", "a.js", "x"), ("r", "1", "a.js", "")]
    df = spark.createDataFrame(rows, "package string, version string, path string, content string")
    got = {(r.package, r.version): r for r in P.profile(df, KEYS).collect()}
    for key in {r[:2] for r in rows}:
        own = [r[2:] for r in rows if r[:2] == key]
        assert got[key].content_hash == _tree(own) and got[key].file_count == len(own)
        assert got[key].total_size == sum(len(c) for _, c in own)
    assert got["p", "1"].imports == 3 and got["q", "1"].imports == 0
    assert got["q", "1"].content_hash == got["r", "1"].content_hash != got["q", "2"].content_hash


def test_content_hash_tells_renames_from_copies(spark):
    def root(files):
        df = spark.createDataFrame([("p", "1", *f) for f in files], "package string, version string, path string, content string")
        return P.profile(df.repartition(5), KEYS).first().content_hash

    base = [("a.js", "one"), ("b.js", "two")]
    assert root(base) == root(base[::-1])
    others = [[("a.js", "two"), ("b.js", "one")], [("a.js", "one"), ("c.js", "two")], base[:1], [*base, ("c.js", "")]]
    assert len({root(base), *map(root, others)}) == 5


def test_diff_of_profiles(spark):
    schema = "package string, version string, path string, content string"
    old = spark.createDataFrame([("p", "1", "a.js", "require('x')"), ("p", "1", "b.js", "1"), ("q", "1", "a.js", "1")], schema)
    new = spark.createDataFrame([("p", "1", "a.js", "require('y')"), ("p", "1", "c.js", "1"), ("q", "1", "a.js", "1")], schema)
    diff = P.profile_diff(old, new, KEYS)
    assert sorted((r.kind, r.change, r.value) for r in diff.collect()) == [
        ("file", "added", "c.js"), ("file", "changed", "a.js"), ("file", "removed", "b.js"), ("import", "added", "y"), ("import", "removed", "x")]
    out = {r.package: r for r in P.diff_summary(diff, old.select(*KEYS), KEYS).collect()}
    assert out["p"].content_hash_changed and not out["q"].content_hash_changed
    assert out["q"].summary == "No behavioral changes detected"


def test_profile_of_nothing(spark):
    df = spark.createDataFrame([], "package string, version string, path string, content string")
    assert P.profile(df, KEYS).collect() == [] and P.profile_rows(df, KEYS).collect() == []
