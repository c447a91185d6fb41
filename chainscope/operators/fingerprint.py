"""Behaviour fingerprints of packages and their diff.

Per-file features are literal-regex projections (narrow).  Files and extracted
items are rows (package, kind, value), never collected into one array, and one
projection of the content gives both.

The package's content hash is the root of a digest tree over its files: each is
a leaf (path, sha-256 of the content) under the first hex digits of its path's
sha-256, inner nodes are the sha-256 of their children in order.  It changes
exactly when a file is added, removed, renamed or edited.  Leaves spread evenly
whatever the paths, so a package with millions of files needs no single task,
and a task holds the children of one node at a time: 256 at most, or a 65,536th
of the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FIXED VALUES — extraction patterns (JavaScript dialect, all Java-compatible)
REQUIRE_RE = r'''require\s*\(\s*['"`]([^'"`]+)['"`]\s*\)'''
IMPORT_RE = r'''(?:import|export)\s+.*?from\s+['"`]([^'"`]+)['"`]'''
DYN_IMPORT_RE = r'''import\s*\(\s*['"`]([^'"`]+)['"`]\s*\)'''
URL_RE = r'''['"`](https?:\/\/[^'"`\s]+)['"`]'''
HOST_RE = r'''(?:hostname|host)\s*[:=]\s*['"`]([^'"`]+)['"`]'''
FS_RE = (r'''(?:readFile|writeFile|readdir|unlink|stat|access|mkdir|rmdir|rename|copyFile|appendFile)\w*\s*\(\s*'''
         r'''['"`]([^'"`]+)['"`]''')
NODE_REQ_RE = r'''require\s*\(\s*['"`]([^'"`]*\.node)['"`]\s*\)'''
NATIVE_RE = r'''binding\.gyp|node-gyp|node-pre-gyp|prebuild-install|napi_'''

KINDS = {
    "import": [REQUIRE_RE, IMPORT_RE, DYN_IMPORT_RE],
    "endpoint": [URL_RE, HOST_RE],
    "fs_path": [FS_RE],
}


def _all(c: Column, patterns: list[str]) -> Column:
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in patterns])))


def imports(c: Column) -> Column:
    """Distinct require / import-from / dynamic import specifiers."""
    return _all(c, KINDS["import"])


def endpoints(c: Column) -> Column:
    """URL literals and host assignments."""
    return _all(c, KINDS["endpoint"])


def fs_paths(c: Column) -> Column:
    """Literal paths given to filesystem calls."""
    return _all(c, KINDS["fs_path"])


def native_bindings(c: Column) -> Column:
    """Required .node files, plus '<native-addon>' on build-tool words."""
    req = F.regexp_extract_all(c, F.lit(NODE_REQ_RE), F.lit(1))
    return F.array_distinct(F.when(c.rlike(NATIVE_RE), F.concat(req, F.array(F.lit("<native-addon>")))).otherwise(req))


def import_kind(spec: Column) -> Column:
    """relative ('./x', '../x', '/x') vs package/builtin specifiers."""
    return F.when(spec.rlike("^[./]"), "relative").otherwise("package")


def items(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, value): every distinct extracted item of every package."""
    return profile_rows(files, keys, with_files=False).select(*keys, "kind", "value")


def profile_rows(files: DataFrame, keys: list[str], with_files: bool = True) -> DataFrame:
    """A27 as rows (keys, kind, value, sha256, size): each source file (kind file,
    value its path) and each distinct item of every package, from one
    projection of the content."""
    c = F.col("content")

    def found(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("long").alias("size")))

    per = [found("import", imports(c)), found("endpoint", endpoints(c)), found("fs_path", fs_paths(c)), found("native", native_bindings(c))]
    if with_files:
        per.append(F.array(F.struct(F.lit("file").alias("kind"), F.col("path").alias("value"), F.sha2(c, 256).alias("sha256"), F.octet_length(c).cast("long").alias("size"))))
    x = files.select(*keys, F.explode_outer(F.flatten(F.array(*per))).alias("_x")).where(F.col("_x").isNotNull())
    return x.groupBy(*keys, "_x.kind", "_x.value").agg(F.max("_x.sha256").alias("sha256"), F.max("_x.size").alias("size"))


def file_hashes(files: DataFrame, keys: list[str]) -> DataFrame:
    return files.select(*keys, "path", F.sha2(F.col("content"), 256).alias("sha256"),
                        F.octet_length("content").cast("bigint").alias("size"))


def _digest(children: Column) -> Column:
    """sha-256 of the children's lines in order; null if there are none."""
    lines = F.array_sort(F.collect_list(children))
    return F.when(F.size(lines) > 0, F.sha2(F.array_join(lines, "\n"), 256))


def profile(files: DataFrame, keys: list[str]) -> DataFrame:
    """File count, byte size, content hash and distinct item counts per
    package, all aggregated along the digest tree."""
    kinds = ["import", "endpoint", "fs_path", "native"]
    place = F.sha2("value", 256)
    rows = profile_rows(files, keys).select(*keys, F.substring(place, 1, 2).alias("_one"), F.substring(place, 3, 2).alias("_two"), "kind", "size",
                                            F.when(F.col("kind") == "file", F.concat_ws(":", place, "sha256")).alias("_leaf"))
    sums = ["file_count", "total_size", *(k + "s" for k in kinds)]
    # dealt by the upper digits: two levels of the tree in one exchange
    low = rows.repartition(*keys, "_one").groupBy(*keys, "_one", "_two").agg(
        F.count("_leaf").alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"),
        *[F.count(F.when(F.col("kind") == k, 1)).alias(k + "s") for k in kinds], _digest(F.col("_leaf")).alias("_node"))
    add = [F.sum(c).cast("bigint").alias(c) for c in sums]
    up = lambda digits: _digest(F.concat(digits, F.lit(":"), "_node"))  # noqa: E731  a node without files is null and no child
    mid = low.groupBy(*keys, "_one").agg(*add, up("_two").alias("_node"))
    return mid.groupBy(*keys).agg(*add, up("_one").alias("content_hash"))


def profile_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, change, value) for files added/removed/
    changed and items added/removed between two snapshots."""
    o = profile_rows(old, keys).select(*keys, "kind", "value", F.coalesce("sha256", F.lit("")).alias("o"))
    n = profile_rows(new, keys).select(*keys, "kind", "value", F.coalesce("sha256", F.lit("")).alias("n"))
    change = (F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed")
              .when(F.col("o") != F.col("n"), "changed"))
    return (o.join(n, [*keys, "kind", "value"], "full_outer").withColumn("change", change)
            .where(F.col("change").isNotNull()).select(*keys, "kind", "change", "value"))


# FIXED VALUES — summary parts: (kind, change, text)
SUMMARY_PARTS = [("file", "added", "files added"), ("file", "removed", "files removed"),
                 ("file", "changed", "files changed"), ("import", "added", "new imports"),
                 ("import", "removed", "removed imports"), ("endpoint", "added", "new network endpoints"),
                 ("native", "added", "new native bindings")]


def diff_summary(diff: DataFrame, packages: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per package, whether its content hash changed, and the summary sentence."""
    cnt = diff.groupBy(*keys).agg(*[
        F.count(F.when((F.col("kind") == k) & (F.col("change") == c), 1)).cast("bigint").alias(f"{k}_{c}")
        for k, c, _ in SUMMARY_PARTS])
    out = packages.select(*keys).distinct().join(cnt, keys, "left").fillna(0)
    # the content hash is that of all (path, content): it changed where a file did
    out = out.withColumn("content_hash_changed", F.col("file_added") + F.col("file_removed") + F.col("file_changed") > 0)
    parts = F.concat_ws(", ", *[F.when(F.col(f"{k}_{c}") > 0, F.concat(F.col(f"{k}_{c}").cast("string"), F.lit(" " + t)))
                                for k, c, t in SUMMARY_PARTS])
    return out.withColumn("summary", F.when(parts == "", F.lit("No behavioral changes detected"))
                          .otherwise(F.concat(F.lit("Changes: "), parts)))
