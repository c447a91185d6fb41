"""File-tree sources: reading a corpus and choosing the files to scan.

A corpus is a table ``(project_id, path, content, ...)`` with paths
relative to the project root.  ``read_tree`` builds one from a folder of
projects with Spark's whole-text reader; ``collect_files`` and
``collect_package_files`` apply the listing rules (extensions, ignore
patterns with ancestor pruning, test paths, per-project file cap) as
column predicates, so Parquet corpora get them as pushed-down filters on
``path`` before ``content`` is touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainscope.functions import js

# FIXED VALUES — listing defaults of the source scan
DEFAULT_EXTENSIONS = [".js", ".mjs", ".cjs", ".ts", ".mts", ".cts", ".tsx", ".jsx", ".json", ".html", ".vue", ".svelte"]
DEFAULT_IGNORE = ["node_modules", ".git", "dist", "build", ".next", ".nuxt", ".svelte-kit",
                  "coverage", ".chainscope", ".cache", ".turbo", "vendor",
                  "*.min.js", "*.bundle.js", "*.map"]
TEST_DIRS = ["test", "tests", "__tests__", "__mocks__", "__snapshots__", "spec", "specs"]
TEST_FILE_RE = r"\.(test|spec|e2e)\.[jt]sx?$"

# FIXED VALUES — listing of package files (behaviour scan) and fingerprints
PACKAGE_EXTENSIONS = [".js", ".mjs", ".cjs", ".ts", ".mts", ".cts", ".json"]
PACKAGE_SKIP_DIRS = ["node_modules", ".git", "dist", "build", "coverage", ".chainscope"]
PROFILE_EXTENSIONS = [".js", ".mjs", ".cjs", ".ts", ".mts", ".cts"]
PROFILE_SKIP_DIRS = ["node_modules", ".git", "dist", "build", "test", "tests", "__tests__"]


def read_tree(spark, root: str, project_depth: int = 1) -> DataFrame:
    """Whole-file rows of a folder of projects: ``root/<project>/<path>``.

    Spark's whole-text reader lists the tree in parallel; the file path
    comes from the ``_metadata`` column and is made relative to ``root``.
    """
    import re as _re
    df = (spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
          .select(F.col("_metadata.file_path").alias("_abs"), F.col("value").alias("content")))
    anchor = _re.escape(root.rstrip("/").lstrip("/"))
    rel = F.regexp_extract(F.col("_abs"), rf"^(?:[a-z]+:)?/*{anchor}/(.*)$", 1)
    parts = F.split(rel, "/")
    return df.select(
        F.array_join(F.slice(parts, 1, project_depth), "/").alias("project_id"),
        F.array_join(F.slice(parts, project_depth + 1, 1 << 20), "/").alias("path"),
        "content",
    )


def extname(path: Column) -> Column:
    """Extension of the last path segment, node-style ('' for dotfiles)."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.regexp_extract(base, r"^.+(\.[^.]*)$", 1)


def ignored(path: Column, patterns: list[str]) -> Column:
    """True when the path or one of its ancestor folders matches a pattern.

    A pattern without '*' and '.' names a path segment; '*.x' matches a
    suffix; any pattern also matches as a plain suffix.  Ancestors count
    because ignored folders are pruned during the walk: some prefix of the
    path ends with the pattern iff ``pattern + '/'`` occurs in
    ``path + '/'``.
    """
    segs = F.split(path, "/")
    slashed = F.concat(path, F.lit("/"))
    conds = []
    for p in patterns:
        if "*" not in p and "." not in p:
            conds.append(F.array_contains(segs, p))
        if p.startswith("*."):
            conds.append(F.instr(slashed, p[1:] + "/") > 0)
        conds.append(F.instr(slashed, p + "/") > 0)
    out = F.lit(False)
    for c in conds:
        out = out | c
    return out


def ignored_by(path: Column, patterns: Column) -> Column:
    """``ignored`` for a per-row array of patterns (a project's ignore file)."""
    slashed = F.concat(path, F.lit("/"))
    segs = F.split(path, "/")
    return F.coalesce(F.exists(patterns, lambda p: (
        (~p.contains("*") & ~p.contains(".") & F.array_contains(segs, p))
        | (p.startswith("*.") & (F.instr(slashed, F.concat(F.substring(p, 2, 1 << 20), F.lit("/"))) > 0))
        | (F.instr(slashed, F.concat(p, F.lit("/"))) > 0))), F.lit(False))


def ignore_patterns(lines: DataFrame, project_col: str = "project_id", line_col: str = "line") -> DataFrame:
    """S2 loader: ignore-file lines per project -> (project, patterns);
    lines are trimmed, blanks and '#' comments dropped.  An ignore file is
    a small config file, so its patterns are one short array per project."""
    t = js.js_trim(F.col(line_col))
    return (lines.select(project_col, t.alias("_p")).where((F.col("_p") != "") & ~F.col("_p").startswith("#"))
            .groupBy(project_col).agg(F.array_sort(F.collect_set("_p")).alias("_patterns")))


def in_dirs(path: Column, dirs: list[str]) -> Column:
    """Some folder (not the file name) of the path is one of ``dirs``."""
    segs = F.split(path, "/")
    folders = F.slice(segs, 1, F.size(segs) - 1)
    return F.arrays_overlap(folders, F.array(*[F.lit(d) for d in dirs]))


def cap_per_project(files: DataFrame, max_files: int | None, project_col: str = "project_id",
                    path_col: str = "path") -> DataFrame:
    """First ``max_files`` files (path order) of each project.

    Files are counted per project first (a partial aggregation); only the
    projects over the cap are ranked, and only on (project, path), so
    content stays where it is.  The ranking is two-phase -- first
    ``max_files`` per (project, input partition), then per project -- so a
    huge project is spread over all partitions instead of one task.  The
    result is one cutoff path per over-cap project, joined back.
    """
    if max_files is None:
        return files
    over = (files.groupBy(project_col).agg(F.count("*").alias("_n"))
            .where(F.col("_n") > max_files).select(project_col))
    ids = files.select(project_col, path_col).join(over, [project_col], "left_semi")
    ids = ids.withColumn("_pid", F.spark_partition_id())
    local = (ids.withColumn("_r", F.row_number().over(Window.partitionBy(project_col, "_pid").orderBy(path_col)))
             .where(F.col("_r") <= max_files))
    w = Window.partitionBy(project_col).orderBy(path_col)
    cut = (local.withColumn("_rn", F.row_number().over(w))
           .where(F.col("_rn") == max_files)
           .select(project_col, F.col(path_col).alias("_cutoff")))
    joined = files.join(cut, [project_col], "left")
    return joined.where(F.col("_cutoff").isNull() | (F.col(path_col) <= F.col("_cutoff"))).drop("_cutoff")


def collect_files(files: DataFrame, extensions=None, ignore=None, include_tests: bool = False,
                  max_files: int | None = None, path_col: str = "path",
                  ignore_files: DataFrame | None = None) -> DataFrame:
    """Files of each project the source scan reads.

    ``ignore`` adds patterns for every project; ``ignore_files`` is a table
    (project_id, line) of per-project ignore files, joined as one pattern
    array per project.
    """
    extensions = DEFAULT_EXTENSIONS if extensions is None else extensions
    patterns = DEFAULT_IGNORE + list(ignore or [])
    p = F.col(path_col)
    keep = extname(p).isin(extensions) & ~ignored(p, patterns)
    if ignore_files is not None:
        files = files.join(ignore_patterns(ignore_files), ["project_id"], "left")
        keep = keep & ~ignored_by(p, F.coalesce(F.col("_patterns"), F.array().cast("array<string>")))
    if not include_tests:
        base = F.element_at(F.split(p, "/"), -1)
        keep = keep & ~in_dirs(p, TEST_DIRS) & ~base.rlike(TEST_FILE_RE)
    kept = files.where(keep)
    if ignore_files is not None:
        kept = kept.drop("_patterns")
    return cap_per_project(kept, max_files, path_col=path_col)


def collect_package_files(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Files of a package the behaviour scan reads."""
    p = F.col(path_col)
    return files.where(extname(p).isin(PACKAGE_EXTENSIONS) & ~in_dirs(p, PACKAGE_SKIP_DIRS))


def collect_profile_files(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Source files that make up a behaviour fingerprint."""
    p = F.col(path_col)
    return files.where(extname(p).isin(PROFILE_EXTENSIONS) & ~in_dirs(p, PROFILE_SKIP_DIRS))
