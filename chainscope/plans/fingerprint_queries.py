"""Fingerprint queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainscope.functions.regex import sql_str
from chainscope.functions.sizing import spread
from chainscope.operators import fingerprint as P
from chainscope.plans.registry import query, with_fixtures
from chainscope.plans.scan_queries import o_ext, o_in_dirs
from chainscope.sources import files as S

KEYS = ["project_id", "package"]


def prof_files(ws):
    return ws.memo("profile_files_src", lambda: spread(S.collect_profile_files(ws.table("src_files")),
                                                       KEYS + ["path"]))


def snap_files(ws, snap):
    pf = ws.table("profile_files")
    return ws.memo(f"profile_files_{snap}", lambda: spread(
        S.collect_profile_files(pf.where(F.col("snapshot") == snap)), KEYS + ["path"]))


def o_filter(src):
    exts = ", ".join(sql_str(e) for e in S.PROFILE_EXTENSIONS)
    return f"SELECT * FROM {src} WHERE {o_ext('path')} IN ({exts}) AND NOT {o_in_dirs('path', S.PROFILE_SKIP_DIRS)}"


def o_all(patterns):
    return "list_distinct(flatten([" + ", ".join(f"regexp_extract_all(content, {sql_str(p)}, 1)" for p in patterns) + "]))"


def o_native():
    req = f"regexp_extract_all(content, {sql_str(P.NODE_REQ_RE)}, 1)"
    return (f"list_distinct(CASE WHEN regexp_matches(content, {sql_str(P.NATIVE_RE)}) "
            f"THEN list_append({req}, '<native-addon>') ELSE {req} END)")


def o_items(src, name):
    return (name, f"""
SELECT DISTINCT project_id, package, kind, value FROM (
  SELECT project_id, package, 'import' AS kind, unnest({o_all(P.KINDS['import'])}) AS value FROM {src}
  UNION ALL SELECT project_id, package, 'endpoint', unnest({o_all(P.KINDS['endpoint'])}) FROM {src}
  UNION ALL SELECT project_id, package, 'fs_path', unnest({o_all(P.KINDS['fs_path'])}) FROM {src}
  UNION ALL SELECT project_id, package, 'native', unnest({o_native()}) FROM {src})""")


@query("extract_imports", lambda: with_fixtures(["src_files"], [("pf", o_filter("src_files"))], f"""
SELECT project_id, package, path, unnest({o_all(P.KINDS['import'])}) AS import FROM pf"""))
def q_extract_imports(ws):
    f = prof_files(ws)
    return f.select(*KEYS, "path", F.explode(P.imports(F.col("content"))).alias("import"))


@query("import_kinds", lambda: with_fixtures(["src_files"], [("pf", o_filter("src_files"))], f"""
SELECT DISTINCT project_id, package, import, CASE WHEN regexp_matches(import, '^[./]') THEN 'relative' ELSE 'package' END AS kind
FROM (SELECT project_id, package, unnest({o_all(P.KINDS['import'])}) AS import FROM pf)"""))
def q_import_kinds(ws):
    f = prof_files(ws).select(*KEYS, F.explode(P.imports(F.col("content"))).alias("import"))
    return f.select(*KEYS, "import", P.import_kind(F.col("import")).alias("kind")).distinct()


@query("extract_endpoints", lambda: with_fixtures(["src_files"], [("pf", o_filter("src_files"))], f"""
SELECT project_id, package, path, unnest({o_all(P.KINDS['endpoint'])}) AS endpoint FROM pf"""))
def q_extract_endpoints(ws):
    return prof_files(ws).select(*KEYS, "path", F.explode(P.endpoints(F.col("content"))).alias("endpoint"))


@query("extract_fs_paths", lambda: with_fixtures(["src_files"], [("pf", o_filter("src_files"))], f"""
SELECT project_id, package, path, unnest({o_all(P.KINDS['fs_path'])}) AS fs_path FROM pf"""))
def q_extract_fs_paths(ws):
    return prof_files(ws).select(*KEYS, "path", F.explode(P.fs_paths(F.col("content"))).alias("fs_path"))


@query("native_bindings", lambda: with_fixtures(["src_files"], [("pf", o_filter("src_files"))], f"""
SELECT DISTINCT project_id, package, unnest({o_native()}) AS binding FROM pf"""))
def q_native_bindings(ws):
    return prof_files(ws).select(*KEYS, F.explode(P.native_bindings(F.col("content"))).alias("binding")).distinct()


VERSIONED = ["project_id", "package", "version"]


def _o_profile():
    k = "project_id, package, version"
    it = o_items("pf", "it")[1].replace("project_id, package", k)
    return [("pf", o_filter("src_files")), ("it", it),
            ("leaf", f"SELECT {k}, sha256(path) AS h, sha256(path) || ':' || sha256(content) AS line, octet_length(encode(content)) AS size FROM pf"),
            ("low", f"SELECT {k}, substr(h, 1, 2) AS one, substr(h, 3, 2) AS two, sha256(string_agg(line, chr(10) ORDER BY line)) AS node FROM leaf GROUP BY ALL"),
            ("mid", f"SELECT {k}, one, sha256(string_agg(two || ':' || node, chr(10) ORDER BY two)) AS node FROM low GROUP BY ALL"),
            ("tree", f"SELECT {k}, sha256(string_agg(one || ':' || node, chr(10) ORDER BY one)) AS content_hash FROM mid GROUP BY ALL"),
            ("base", f"SELECT {k}, CAST(count(*) AS BIGINT) AS file_count, CAST(sum(size) AS BIGINT) AS total_size FROM leaf GROUP BY ALL"),
            ("cnt", f"""
SELECT {k}, CAST(count_if(kind = 'import') AS BIGINT) AS imports,
       CAST(count_if(kind = 'endpoint') AS BIGINT) AS endpoints, CAST(count_if(kind = 'fs_path') AS BIGINT) AS fs_paths,
       CAST(count_if(kind = 'native') AS BIGINT) AS natives
FROM it GROUP BY ALL""")]


@query("fingerprint_profile", lambda: with_fixtures(["src_files"], _o_profile(), """
SELECT b.*, content_hash, coalesce(imports, 0) AS imports, coalesce(endpoints, 0) AS endpoints, coalesce(fs_paths, 0) AS fs_paths,
       coalesce(natives, 0) AS natives
FROM base b JOIN tree USING (project_id, package, version) LEFT JOIN cnt USING (project_id, package, version)"""))
def q_fingerprint_profile(ws):
    return P.profile(prof_files(ws), VERSIONED)


@query("fingerprint_rows", lambda: with_fixtures(["src_files"], _o_profile()[:2], """
SELECT project_id, package, version, 'file' AS kind, path AS value, sha256(content) AS sha256,
       CAST(octet_length(encode(content)) AS BIGINT) AS size FROM pf
UNION ALL SELECT project_id, package, version, kind, value, NULL, NULL FROM it"""))
def q_fingerprint_rows(ws):
    """Every profile's file hashes and item lists, as rows."""
    return P.profile_rows(prof_files(ws), VERSIONED)


def _o_diff():
    return [("po", o_filter("(SELECT * FROM profile_files WHERE snapshot = 'old')")),
            ("pn", o_filter("(SELECT * FROM profile_files WHERE snapshot = 'new')")),
            o_items("po", "io"), o_items("pn", "inn"),
            ("pdiff", """
SELECT coalesce(o.project_id, n.project_id) AS project_id, coalesce(o.package, n.package) AS package, 'file' AS kind,
       CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change,
       coalesce(o.path, n.path) AS value
FROM (SELECT project_id, package, path, sha256(content) AS h FROM po) o
FULL OUTER JOIN (SELECT project_id, package, path, sha256(content) AS h FROM pn) n
  ON o.project_id = n.project_id AND o.package = n.package AND o.path = n.path
WHERE o.path IS NULL OR n.path IS NULL OR o.h <> n.h
UNION ALL
SELECT project_id, package, kind, 'added', value FROM (SELECT * FROM inn EXCEPT SELECT * FROM io)
UNION ALL
SELECT project_id, package, kind, 'removed', value FROM (SELECT * FROM io EXCEPT SELECT * FROM inn)""")]


@query("profile_diff", lambda: with_fixtures(["profile_files"], _o_diff(), "SELECT * FROM pdiff"))
def q_profile_diff(ws):
    return P.profile_diff(snap_files(ws, "old"), snap_files(ws, "new"), KEYS)


@query("profile_diff_summary", lambda: with_fixtures(["profile_files"], _o_diff() + [
    ("pk", "SELECT DISTINCT project_id, package FROM po UNION SELECT DISTINCT project_id, package FROM pn"),
    ("pc", "SELECT project_id, package, " + ", ".join(
        f"CAST(count_if(kind = '{k}' AND change = '{c}') AS BIGINT) AS {k}_{c}" for k, c, _ in P.SUMMARY_PARTS)
        + " FROM pdiff GROUP BY project_id, package"),
    ("ps", "SELECT pk.project_id, pk.package, " + ", ".join(
        f"coalesce({k}_{c}, 0) AS {k}_{c}" for k, c, _ in P.SUMMARY_PARTS)
        + " FROM pk LEFT JOIN pc USING (project_id, package)"),
], "SELECT *, file_added + file_removed + file_changed > 0 AS content_hash_changed, CASE WHEN " + " + ".join(f"{k}_{c}" for k, c, _ in P.SUMMARY_PARTS) + """ = 0
     THEN 'No behavioral changes detected' ELSE 'Changes: ' || concat_ws(', ', """ + ", ".join(
    f"CASE WHEN {k}_{c} > 0 THEN CAST({k}_{c} AS VARCHAR) || ' {t}' END" for k, c, t in P.SUMMARY_PARTS)
    + ") END AS summary FROM ps"))
def q_profile_diff_summary(ws):
    old, new = snap_files(ws, "old"), snap_files(ws, "new")
    return P.diff_summary(P.profile_diff(old, new, KEYS), old.select(*KEYS).unionByName(new.select(*KEYS)), KEYS)
