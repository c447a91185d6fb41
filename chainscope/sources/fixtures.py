"""Fixture views derived from the driver's tables in portable SQL.

Each fixture is one SELECT written in the subset of SQL that Spark and
DuckDB read the same way; ``{{name}}`` marks a table reference.  Spark
runs it through ``Workspace`` (temp views over the parquet files), the
oracle inlines it as a CTE.  Nothing here is a row cap or a sample: every
fixture grows with the driver tables it reads.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from chainscope.sources.snippets import SNIPPETS

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def sql_text(s: str) -> str:
    """String literal valid in both dialects: quotes doubled; newline,
    backslash and dollar spliced in with chr() (Spark would unescape a
    backslash and substitute ``${var}``)."""
    parts = re.split(r"(\n|\\|\$)", s)
    out = []
    for p in parts:
        if p == "\n":
            out.append("chr(10)")
        elif p == "\\":
            out.append("chr(92)")
        elif p == "$":
            out.append("chr(36)")
        elif p:
            out.append("'" + p.replace("'", "''") + "'")
    return " || ".join(out) if out else "''"


def values(cols: list[str], rows: list[tuple], alias: str) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return repr(v)
        return sql_text(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS {alias}({', '.join(cols)})"


# Directory and extension pools for file paths; moduli are coprime with the
# snippet count so every snippet lands in many path shapes.
PATH_DIRS = ["src", "lib", "src/routes", "node_modules/a", "dist", "__tests__", "a/.git", "mydist", "app/api"]
PATH_EXTS = [".js", ".ts", ".tsx", ".json", ".html", ".min.js", ".spec.ts", ".map", ".md", ".mjs", ".vue"]

# Package names of the corpus (37: coprime with the snippet count): known
# safe names, popular names, look-alikes and plain names.
PACKAGE_NAMES = ["typescript", "eslint", "react", "express", "axios", "lodash", "jest", "sharp", "d3", "pm2",
                 "nodemon", "bcrypt", "jsonwebtoken", "next", "webpack", "vite", "tsx", "prisma", "openai",
                 "left-pad", "acme-utils", "data-tools", "net-helper", "colorz", "expresss", "lodahs", "reqeust",
                 "chalk-cli", "request", "moment", "colors", "crypto-wrap", "env-loader", "build-tools",
                 "glob", "tiny-fetch", "shell-run"]

FIXTURES: dict[str, tuple[list[str], str]] = {}
# The same rows in a form that Spark plans better, for fixtures that need one.
SPARK_SQL: dict[str, str] = {}


def fixture(name: str, deps: list[str], sql: str) -> None:
    FIXTURES[name] = (deps, sql)


fixture("src_files", ["documents"], f"""
SELECT d.source AS project_id,
       pk.name AS package,
       '1.' || CAST(d.doc_id % 3 AS STRING) || '.0' AS version,
       dr.dir || '/' || CAST(d.doc_id AS STRING) || ex.ext AS path,
       d.text || chr(10) || sn.snippet AS content,
       d.doc_id
FROM {{{{documents}}}} d
JOIN {values(["k", "dir"], list(enumerate(PATH_DIRS)), "dr")} ON dr.k = d.doc_id % {len(PATH_DIRS)}
JOIN {values(["k", "ext"], list(enumerate(PATH_EXTS)), "ex")} ON ex.k = d.doc_id % {len(PATH_EXTS)}
JOIN {values(["k", "snippet"], list(enumerate(SNIPPETS)), "sn")} ON sn.k = d.doc_id % {len(SNIPPETS)}
JOIN {values(["k", "name"], list(enumerate(PACKAGE_NAMES)), "pk")} ON pk.k = d.doc_id % {len(PACKAGE_NAMES)}
""")


def render(sql: str, names: dict[str, str]) -> str:
    return re.sub(r"\{\{(\w+)\}\}", lambda m: names.get(m.group(1), m.group(1)), sql)


def fixture_order(names: list[str]) -> list[str]:
    """Fixtures needed by ``names`` in dependency order."""
    seen: list[str] = []

    def visit(n):
        if n in DRIVER_TABLES or n in seen:
            return
        for d in FIXTURES[n][0]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def oracle_ctes(names: list[str]) -> list[tuple[str, str]]:
    return [(n, render(FIXTURES[n][1], {})) for n in fixture_order(names)]


class Workspace:
    """Driver tables and fixtures of one data folder inside one session."""

    _cache: dict[tuple[int, str], "Workspace"] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self.tag = "cs_" + hashlib.md5(self.sf_dir.encode()).hexdigest()[:8]
        self._frames: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Workspace":
        key = (id(spark), sf_dir.rstrip("/"))
        if key not in cls._cache:
            cls._cache[key] = cls(spark, sf_dir)
        return cls._cache[key]

    def view(self, name: str) -> str:
        self.table(name)
        return f"{self.tag}_{name}"

    def table(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name in DRIVER_TABLES:
                df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                deps, sql = FIXTURES[name]
                df = self.spark.sql(render(SPARK_SQL.get(name, sql), {d: self.view(d) for d in deps}))
            df.createOrReplaceTempView(f"{self.tag}_{name}")
            self._frames[name] = df
        return self._frames[name]

    def lockfiles(self, snapshot: str) -> DataFrame:
        """The rows of lockfile_json of one snapshot, from packages and edges of that
        snapshot alone: Spark does not carry a filter on the documents over to the edges."""
        def build():
            views = {}
            for t in FIXTURES["lockfile_json"][0]:
                views[t] = f"{self.view(t)}_{snapshot}"
                self.table(t).where(f"snapshot = '{snapshot}'").createOrReplaceTempView(views[t])
            return self.spark.sql(render(FIXTURES["lockfile_json"][1], views))
        return self.memo(f"lockfile_json_{snapshot}", build)

    def memo(self, key: str, build) -> DataFrame:
        """A derived frame built once per workspace, so plans that use it
        twice share one subtree (and Spark can reuse its exchange)."""
        if key not in self._frames:
            self._frames[key] = build()
        return self._frames[key]

    def sql(self, sql: str) -> DataFrame:
        names = set(re.findall(r"\{\{(\w+)\}\}", sql))
        return self.spark.sql(render(sql, {n: self.view(n) for n in names}))


# ---------------------------------------------------------------- inventories

from chainscope.catalog.reference import POPULAR_PACKAGES  # noqa: E402
from chainscope.operators.lockdiff import NATIVE_PACKAGES, NETWORK_PACKAGES  # noqa: E402

# pkg_names: a popular name (by p_partkey / 8) altered by p_partkey % 8.
fixture("pkg_names", ["part"], f"""
SELECT p.p_partkey AS id,
       CASE p.p_partkey % 8
         WHEN 0 THEN b.base
         WHEN 1 THEN substr(b.base, 1, 1) || substr(b.base, 3, 1) || substr(b.base, 2, 1) || substr(b.base, 4)
         WHEN 2 THEN b.base || substr(b.base, length(b.base), 1)
         WHEN 3 THEN substr(b.base, 1, length(b.base) - 1)
         WHEN 4 THEN substr(b.base, 1, 2) || '-' || substr(b.base, 3)
         WHEN 5 THEN '@tyeps/' || b.base || '-' || CAST(p.p_partkey AS STRING)
         WHEN 6 THEN 'x' || substr(b.base, 2)
         ELSE replace(p.p_name, ' ', '-')
       END AS name
FROM {{{{part}}}} p
JOIN {values(["k", "base"], list(enumerate(POPULAR_PACKAGES)), "b")}
  ON b.k = CAST(floor(p.p_partkey / 8) AS BIGINT) % {len(POPULAR_PACKAGES)}
""")

# Lock entries: one package per (priority as project, customer key within
# the package universe) per snapshot (orders before 1998 = old).  The first ids get real names from
# the network / native lists so their delta flags fire.
LOCK_NAMES = NETWORK_PACKAGES + NATIVE_PACKAGES + ["express", "lodash", "react", "left-pad", "@acme/core"]
LICENSE_POOL = ["MIT", "mit", "Apache 2.0", "GPLv3", "AGPL-3.0", "(MIT OR GPL-3.0-only)", "(MIT AND ISC)",
                "MPL 2.0", "Public Domain", "SSPL-1.0", "Custom", "", "BSD-3-Clause", "ISC"]

# the package universe grows with the customer table: a quarter of its size
PKG_SPACE = "(SELECT CAST(floor(count(*) / 4) AS BIGINT) FROM {{customer}})"

fixture("lock_groups", ["orders", "customer"], f"""
SELECT o.o_orderpriority AS project_id,
       CASE WHEN CAST(o.o_orderdate AS DATE) < DATE '1998-01-01' THEN 'old' ELSE 'new' END AS snapshot,
       o.o_custkey % {PKG_SPACE} AS pkg_k, max(o.o_orderkey) AS k
FROM {{{{orders}}}} o
GROUP BY o.o_orderpriority, CASE WHEN CAST(o.o_orderdate AS DATE) < DATE '1998-01-01' THEN 'old' ELSE 'new' END,
         o.o_custkey % {PKG_SPACE}
""")

fixture("lock_packages", ["lock_groups"], f"""
SELECT g.project_id, g.snapshot, coalesce(sp.name, 'pkg-' || CAST(g.pkg_k AS STRING)) AS name,
       CAST(g.k % 4 AS STRING) || '.' || CAST(g.k % 10 AS STRING) || '.' || CAST(g.k % 7 AS STRING) AS version,
       CASE WHEN g.k % 3 = 0 THEN 'https://registry.example.org/' ELSE 'https://registry.npmjs.org/' END
         || coalesce(sp.name, 'pkg-' || CAST(g.pkg_k AS STRING)) || '/-/' || CAST(g.k AS STRING) || '.tgz' AS resolved,
       CASE WHEN g.k % 5 = 1 THEN NULL ELSE 'sha512-' || md5(CAST(g.k AS STRING)) END AS integrity,
       g.k % 5 = 0 AS dev, g.k % 23 = 0 AS optional, lic.license AS license,
       g.k % 11 = 0 AS has_install_script, g.k % 13 = 0 AS has_bin, g.k AS lock_key
FROM {{{{lock_groups}}}} g
LEFT JOIN {values(["k", "name"], list(enumerate(LOCK_NAMES)), "sp")} ON sp.k = g.pkg_k
LEFT JOIN {values(["k", "license"], list(enumerate(LICENSE_POOL)), "lic")} ON lic.k = g.k % {len(LICENSE_POOL)}
WHERE NOT (g.snapshot = 'old' AND g.k % 17 = 0) AND NOT (g.snapshot = 'new' AND g.k % 19 = 0)
""")

# Dependency keys of each lock entry, from lineitem (order -> part), per
# project of the order and snapshot by ship date.
fixture("lock_edges", ["lineitem", "orders", "customer"], f"""
SELECT DISTINCT e.project_id, e.snapshot, coalesce(a.name, 'pkg-' || CAST(e.pkg_k AS STRING)) AS name,
       coalesce(b.name, 'pkg-' || CAST(e.dep_k AS STRING)) AS dep
FROM (SELECT o.o_orderpriority AS project_id,
             CASE WHEN CAST(l.l_shipdate AS DATE) < DATE '1998-01-01' THEN 'old' ELSE 'new' END AS snapshot,
             o.o_custkey % {PKG_SPACE} AS pkg_k, l.l_partkey % {PKG_SPACE} AS dep_k
      FROM {{{{lineitem}}}} l JOIN {{{{orders}}}} o ON o.o_orderkey = l.l_orderkey) e
LEFT JOIN {values(["k", "name"], list(enumerate(LOCK_NAMES)), "a")} ON a.k = e.pkg_k
LEFT JOIN {values(["k", "name"], list(enumerate(LOCK_NAMES)), "b")} ON b.k = e.dep_k
WHERE e.pkg_k <> e.dep_k
""")

# Repeated edges go while they are two numbers; each number has a name of its own.
SPARK_SQL["lock_edges"] = f"""
SELECT e.project_id, e.snapshot, coalesce(a.name, 'pkg-' || CAST(e.pkg_k AS STRING)) AS name,
       coalesce(b.name, 'pkg-' || CAST(e.dep_k AS STRING)) AS dep
FROM (SELECT DISTINCT project_id, snapshot, pkg_k, dep_k
      FROM (SELECT o.o_orderpriority AS project_id,
                   CASE WHEN CAST(l.l_shipdate AS DATE) < DATE '1998-01-01' THEN 'old' ELSE 'new' END AS snapshot,
                   o.o_custkey % {PKG_SPACE} AS pkg_k, l.l_partkey % {PKG_SPACE} AS dep_k
            FROM {{{{lineitem}}}} l JOIN {{{{orders}}}} o ON o.o_orderkey = l.l_orderkey) x
      WHERE pkg_k <> dep_k) e
LEFT JOIN {values(["k", "name"], list(enumerate(LOCK_NAMES)), "a")} ON a.k = e.pkg_k
LEFT JOIN {values(["k", "name"], list(enumerate(LOCK_NAMES)), "b")} ON b.k = e.dep_k
"""


# ---------------------------------------------------------------- history

# observations: per (event type as project, user as package, day) the last
# event by (ts, event_id) gives the version and risk score seen that day.
fixture("observations", ["events"], """
SELECT project_id, name, ts, day, version, score FROM (
  SELECT e.event_type AS project_id, 'pkg-' || CAST(e.user_id AS STRING) AS name, e.ts,
         CAST(e.ts AS DATE) AS day,
         CAST(e.event_id % 3 AS STRING) || '.' || CAST(e.event_id % 5 AS STRING) || '.0' AS version,
         CAST(least(10.0, CAST(floor(e.value / 2 + 0.5) AS DOUBLE) / 10.0) AS DOUBLE) AS score,
         row_number() OVER (PARTITION BY e.event_type, e.user_id, CAST(e.ts AS DATE)
                            ORDER BY e.ts DESC, e.event_id DESC) AS rn
  FROM {{events}} e) x
WHERE rn = 1
""")

# metric_readings: what scans, license and policy checks and coverage counts
# reported of a project.  Each user's events feed one of seven metrics, reported
# once a week, each metric on a weekday of its own.
fixture("metric_readings", ["events"], """
SELECT project_id, day, metric, CAST(CASE WHEN k < 5 THEN n ELSE least(100, n * 3) END AS DOUBLE) AS value FROM (
  SELECT e.event_type AS project_id, CAST(date_trunc('week', e.ts) AS DATE) + CAST(e.user_id % 7 AS INT) AS day, e.user_id % 7 AS k,
         CASE e.user_id % 7 WHEN 0 THEN 'total_findings' WHEN 1 THEN 'critical_findings' WHEN 2 THEN 'high_findings'
              WHEN 3 THEN 'license_violations' WHEN 4 THEN 'policy_violations' WHEN 5 THEN 'provenance_coverage'
              ELSE 'manifest_coverage' END AS metric, count(*) AS n
  FROM {{events}} e
  GROUP BY e.event_type, CAST(date_trunc('week', e.ts) AS DATE) + CAST(e.user_id % 7 AS INT), e.user_id % 7) x
""")

# watched_files: the hash of each project's package.json at every check; its
# content follows the project's highest event id of the day, in steps.
fixture("watched_files", ["events"], """
SELECT e.event_type AS project_id, CAST(e.ts AS DATE) AS day, 'package.json' AS file,
       md5(CAST(CAST(floor(max(e.event_id) / 400) AS BIGINT) AS STRING)) AS hash
FROM {{events}} e GROUP BY e.event_type, CAST(e.ts AS DATE)
""")

# manifest: packages with a permission entry (every third user per project)
fixture("manifest", ["events"], """
SELECT DISTINCT e.event_type AS project_id, 'pkg-' || CAST(e.user_id AS STRING) AS name
FROM {{events}} e WHERE e.user_id % 3 = 0
""")


# package_meta: the package.json of every package of the new lock, as JSON
# text whose polymorphic fields take every shape by lock_key.
_DOM = "CASE p.lock_key % 4 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'example.org' WHEN 2 THEN 'outlook.com' ELSE 'corp.example' END"
fixture("package_json", ["lock_packages"], f"""
SELECT p.project_id, p.name, p.version, p.lock_key, p.integrity,
  '{{"name":"' || p.name || '","version":"' || p.version || '"'
  || CASE p.lock_key % 4 WHEN 0 THEN ',"license":"' || p.license || '"'
                         WHEN 1 THEN ',"license":{{"type":"' || p.license || '"}}'
                         WHEN 2 THEN ',"licenses":[{{"type":"' || p.license || '"}},{{"type":"ISC"}}]'
                         ELSE '' END
  || CASE p.lock_key % 3 WHEN 0 THEN ',"author":"Dev ' || CAST(p.lock_key % 50 AS STRING) || ' <dev@' || {_DOM} || '>"'
                         WHEN 1 THEN ',"author":{{"name":"Dev ' || CAST(p.lock_key % 50 AS STRING) || '","email":"dev@' || {_DOM} || '"}}'
                         ELSE '' END
  || CASE p.lock_key % 5 WHEN 0 THEN ',"maintainers":[]'
                         WHEN 1 THEN ',"maintainers":[{{"name":"Dev ' || CAST(p.lock_key % 50 AS STRING) || '","email":"m1@gmail.com"}}]'
                         WHEN 2 THEN ',"maintainers":[{{"name":"m1","email":"m1@example.org"}},"m2"]'
                         ELSE '' END
  || CASE p.lock_key % 6 WHEN 0 THEN ',"repository":"https://github.com/acme/' || p.name || '"'
                         WHEN 1 THEN ',"repository":{{"type":"git","url":"git+https://github.com/acme/' || p.name || '.git"}}'
                         WHEN 2 THEN ',"repository":{{"type":"git","url":"git+https://github.com/other/unrelated.git"}}'
                         WHEN 3 THEN ',"repository":""'
                         ELSE '' END
  || CASE WHEN p.lock_key % 7 <> 0 THEN ',"description":"A package"' ELSE '' END
  || CASE WHEN p.lock_key % 9 = 0 THEN ',"homepage":"https://example.org"' ELSE '' END
  || CASE WHEN p.lock_key % 2 = 0 THEN ',"keywords":["a","b"]' WHEN p.lock_key % 8 = 1 THEN ',"keywords":[]' ELSE '' END
  || CASE WHEN p.lock_key % 29 = 0 THEN ',"deprecated":"use something else"' ELSE '' END
  || ',"_resolved":"' || p.resolved || '"}}' AS meta
FROM {{{{lock_packages}}}} p WHERE p.snapshot = 'new'
""")

# package_meta: the same, cut off or absent in some packages
fixture("package_meta", ["package_json"], """
SELECT project_id, name, version, lock_key, integrity,
       CASE lock_key % 41 WHEN 0 THEN substr(meta, 1, 20) WHEN 1 THEN NULL WHEN 2 THEN 'null' ELSE meta END AS meta
FROM {{package_json}}
""")

# license_docs: two license files of each package, documents spread over the
# whole table by the package's lock key under two of the five names
_FILE = "CASE {} % 5 WHEN 0 THEN 'LICENSE' WHEN 1 THEN 'LICENSE.md' WHEN 2 THEN 'LICENSE.txt' WHEN 3 THEN 'LICENCE' ELSE 'COPYING' END"
fixture("license_docs", ["package_json", "documents"], "\nUNION ALL\n".join(f"""
SELECT m.project_id, m.name, {_FILE.format(f"(m.lock_key + {3 * turn})")} AS file, d.text
FROM {{{{package_json}}}} m
JOIN {{{{documents}}}} d ON d.doc_id = (m.lock_key + {17 * turn}) % (SELECT count(*) FROM {{{{documents}}}})""" for turn in (0, 1)))

# Spark sends a join's side out by its key without waiting for a subquery in that
# key ("Subquery has not finished"), so the key is a column before the join.
SPARK_SQL["license_docs"] = "\nUNION ALL\n".join(f"""
SELECT m.project_id, m.name, m.file, d.text
FROM (SELECT p.project_id, p.name, {_FILE.format(f"(p.lock_key + {3 * turn})")} AS file,
             (p.lock_key + {17 * turn}) % nullif((SELECT count(*) FROM {{{{documents}}}}), 0) AS doc_at
      FROM {{{{package_json}}}} p) m
JOIN {{{{documents}}}} d ON d.doc_id = m.doc_at""" for turn in (0, 1))


# profile_files: two snapshots of every package's files; in the new one
# files with doc_id % 11 = 0 are gone and files with doc_id % 7 = 0 carry
# the next snippet instead of their own.
fixture("profile_files", ["src_files", "documents"], f"""
SELECT f.project_id, f.package, 'old' AS snapshot, f.path, f.content FROM {{{{src_files}}}} f
UNION ALL
SELECT f.project_id, f.package, 'new' AS snapshot, f.path,
       CASE WHEN f.doc_id % 7 = 0 THEN d.text || chr(10) || sn.snippet ELSE f.content END AS content
FROM {{{{src_files}}}} f
JOIN {{{{documents}}}} d ON d.doc_id = f.doc_id
JOIN {values(["k", "snippet"], list(enumerate(SNIPPETS)), "sn")} ON sn.k = (f.doc_id + 1) % {len(SNIPPETS)}
WHERE f.doc_id % 11 <> 0
""")


# ---------------------------------------------------------------- governance

# pkg_context: the policy context of every package of the new lock; risk,
# downloads and finding counts are derived from its lock key.
fixture("pkg_context", ["lock_packages", "lock_edges"], """
SELECT n.project_id, n.name AS package_name, n.version, n.license AS license_raw,
       CAST(n.lock_key % 101 AS DOUBLE) / 10.0 AS risk_score,
       n.has_install_script AS has_install_scripts, n.has_bin AS has_native_modules,
       CAST(coalesce(e.deps, 0) AS INT) AS dependency_count,
       CAST((n.lock_key * 37) % 100000 AS BIGINT) AS weekly_downloads,
       '' AS last_published, CAST(n.lock_key % 4 AS INT) AS maintainer_count,
       o.name IS NULL AS is_new,
       CAST(n.lock_key % 30 AS INT) AS finding_count, CAST(n.lock_key % 3 AS INT) AS critical_findings,
       CAST(n.lock_key % 5 AS INT) AS high_findings
FROM {{lock_packages}} n
LEFT JOIN {{lock_packages}} o ON o.project_id = n.project_id AND o.name = n.name AND o.snapshot = 'old'
LEFT JOIN (SELECT project_id, name, count(*) AS deps FROM {{lock_edges}} WHERE snapshot = 'new'
           GROUP BY project_id, name) e
  ON e.project_id = n.project_id AND e.name = n.name
WHERE n.snapshot = 'new'
""")

# list_entries: every row of pkg_names goes on a list, half of each of its
# kinds of names on the allow list; some pin a version, some expire.
fixture("list_entries", ["pkg_names"], """
SELECT CASE WHEN (n.id + CAST(floor(n.id / 8) AS BIGINT)) % 2 = 0 THEN 'allow' ELSE 'deny' END AS list, n.name,
       CASE WHEN n.id % 3 = 0 THEN '1.' || CAST(n.id % 5 AS STRING) || '.0' END AS version,
       'reason ' || CAST(n.id AS STRING) AS reason, 'cli' AS added_by, n.id AS seq,
       CASE CAST(floor(n.id / 16) AS BIGINT) % 4 WHEN 0 THEN '2023-06-30' WHEN 2 THEN '2025-12-31' END AS expires_at
FROM {{pkg_names}} n
""")

# list_checks: (name, optional version) pairs to check against the lists
fixture("list_checks", ["pkg_names"], """
SELECT DISTINCT name, CASE WHEN id % 2 = 0 THEN '1.' || CAST(id % 5 AS STRING) || '.0' END AS version
FROM {{pkg_names}}
""")

# list_changes: purchase, view -> allow, error, click -> deny, signup ->
# remove, applied in (ts, event_id) order to a name of pkg_names by user and
# event; every event is a change.
fixture("list_changes", ["events", "pkg_names"], """
SELECT CASE WHEN e.event_type IN ('purchase', 'view') THEN 'allow' WHEN e.event_type IN ('error', 'click') THEN 'deny' ELSE 'remove' END AS op,
       n.name, e.ts, e.event_id, 'change ' || CAST(e.event_id AS STRING) AS reason,
       CASE WHEN e.event_id % 3 = 0 THEN '2.' || CAST(e.event_id % 4 AS STRING) || '.0' END AS version
FROM (SELECT *, (user_id * 10 + event_id % 10) % nullif((SELECT count(*) FROM {{pkg_names}}), 0) AS name_id FROM {{events}}) e
JOIN {{pkg_names}} n ON n.id = e.name_id
""")

# permissions: one manifest entry per manifest package; lists as
# comma-separated text ('' = empty list), blocked flags separate.
fixture("permissions", ["manifest"], """
SELECT m.project_id, m.name,
       CAST(substr(m.name, 5) AS INT) % 4 = 0 AS net_blocked,
       CASE CAST(substr(m.name, 5) AS INT) % 4 WHEN 2 THEN '*' WHEN 3 THEN 'api.example.com,*.npmjs.org' ELSE '' END AS net,
       CAST(substr(m.name, 5) AS INT) % 3 = 0 AS fs_blocked,
       CASE CAST(substr(m.name, 5) AS INT) % 3 WHEN 1 THEN '/srv/app,/tmp' ELSE '' END AS fs,
       CAST(substr(m.name, 5) AS INT) % 2 = 0 AS native,
       CAST(substr(m.name, 5) AS INT) % 5 = 0 AS exec,
       CASE CAST(substr(m.name, 5) AS INT) % 4 WHEN 0 THEN 'blocked' WHEN 1 THEN 'all' ELSE 'list' END AS env_mode,
       CASE CAST(substr(m.name, 5) AS INT) % 4 WHEN 2 THEN 'HOME,PATH' ELSE '' END AS env
FROM {{manifest}} m
""")

# access_requests: resource by event type, target by event id
fixture("access_requests", ["events"], """
SELECT e.event_type AS project_id, 'pkg-' || CAST(e.user_id AS STRING) AS package_name, e.event_id,
       CASE WHEN e.event_id % 97 = 0 THEN 'gpu'
            ELSE CASE e.event_type WHEN 'view' THEN 'net' WHEN 'click' THEN 'fs' WHEN 'error' THEN 'env'
                                   WHEN 'purchase' THEN 'exec' ELSE 'native' END END AS resource,
       CASE WHEN e.event_id % 4 = 0 THEN NULL
            WHEN e.event_type = 'view' THEN CASE e.event_id % 3 WHEN 0 THEN 'api.example.com'
                 WHEN 1 THEN 'CDN.npmjs.org' ELSE 'evil.example.net' END
            WHEN e.event_type = 'click' THEN CASE e.event_id % 3 WHEN 0 THEN '/srv/app/data'
                 WHEN 1 THEN CASE WHEN e.event_id % 2 = 0 THEN '/etc/passwd' ELSE '/srv/app/../../etc' END
                 ELSE '/tmp/./x/' END
            WHEN e.event_type = 'error' THEN CASE e.event_id % 3 WHEN 0 THEN 'HOME'
                 WHEN 1 THEN 'AWS_SECRET' ELSE 'PATH' END END AS target
FROM {{events}} e
""")


# ---------------------------------------------------------------- lockfile documents

# lockfile_json: package-lock documents, one per (project, snapshot, range of
# 256 lock keys, so their number grows and none does); every fourth uses the v1 "dependencies" layout, the
# others the v2/v3 "packages" layout with a root entry and nested entries.
fixture("lockfile_json", ["lock_packages", "lock_edges"], """
SELECT project_id, snapshot, chunk,
  CASE WHEN chunk % 4 = 3 THEN
    '{"lockfileVersion":1,"dependencies":{' || string_agg('"' || name || '":{"version":"' || version
      || '","resolved":"' || resolved || '"'
      || CASE WHEN integrity IS NOT NULL THEN ',"integrity":"' || integrity || '"' ELSE '' END
      || CASE WHEN dev THEN ',"dev":true' ELSE '' END
      || CASE WHEN has_install_script THEN ',"hasInstallScript":true' ELSE '' END
      || CASE WHEN has_bin THEN ',"hasBin":true' ELSE '' END
      || coalesce(',"dependencies":{' || deps || '}', '') || '}', ',') || '}}'
  ELSE
    '{"lockfileVersion":3,"packages":{"":{"name":"' || project_id || '","version":"1.0.0"},'
      || string_agg('"node_modules/' || name || '":{"version":"' || version || '","resolved":"' || resolved || '"'
      || CASE WHEN integrity IS NOT NULL THEN ',"integrity":"' || integrity || '"' ELSE '' END
      || CASE WHEN dev THEN ',"dev":true' ELSE '' END
      || CASE WHEN optional THEN ',"optional":true' ELSE '' END
      || CASE WHEN has_install_script THEN ',"hasInstallScript":true' ELSE '' END
      || CASE WHEN has_bin THEN ',"hasBin":true' ELSE '' END
      || coalesce(',"dependencies":{' || deps || '}', '')
      || ',"license":"' || license || '"}'
      || CASE WHEN lock_key % 9 = 0 THEN ',"node_modules/' || name || '/node_modules/inner-dep":{"version":"0.0.1"}'
         ELSE '' END, ',') || '}}'
  END AS content
FROM (SELECT l.*, CAST(floor(l.lock_key / 256) AS BIGINT) AS chunk, e.deps FROM {{lock_packages}} l
      LEFT JOIN (SELECT project_id, snapshot, name, string_agg('"' || dep || '":"*"', ',') AS deps
                 FROM {{lock_edges}} GROUP BY project_id, snapshot, name) e
        ON e.project_id = l.project_id AND e.snapshot = l.snapshot AND e.name = l.name) p
GROUP BY project_id, snapshot, chunk
UNION ALL
SELECT DISTINCT project_id, snapshot, -1 AS chunk, '{"lockfileVersion":3,"packages":{"node_modules/cut' AS content FROM {{lock_packages}}
""")

# attestations: provenance bundles for every package of the new lock, with
# missing parts on some
fixture("attestations", ["lock_packages"], """
SELECT project_id, name, CASE lock_key % 41 WHEN 3 THEN substr(bundle, 1, 30) WHEN 4 THEN '{"predicateType":"none"}' WHEN 5 THEN NULL ELSE bundle END AS bundle
FROM (SELECT project_id, name, lock_key,
  '{' || CASE WHEN lock_key % 3 = 0 THEN '' ELSE '"predicateType":"https://slsa.dev/provenance/v0.2",' END
  || '"predicate":{"buildType":"https://github.com/actions/workflow@v' || CAST(lock_key % 3 AS STRING) || '"'
  || CASE WHEN lock_key % 5 = 0 THEN '' ELSE ',"builder":{"id":"https://github.com/actions/runner"}' END
  || CASE WHEN lock_key % 7 = 0 THEN ''
          WHEN lock_key % 2 = 0 THEN ',"materials":[{"uri":"git+https://github.com/acme/' || name || '","digest":{"sha1":"'
                                      || substr(md5(name), 1, 20) || '"}}]'
          ELSE ',"materials":[{"uri":"git+https://github.com/acme/' || name || '","digest":{"sha256":"' || md5(name) || '"}}]'
     END
  || CASE WHEN lock_key % 11 = 0 THEN '' ELSE ',"invocation":{"configSource":{"entryPoint":".github/workflows/release.yml"}}' END
  || '}}' AS bundle
FROM {{lock_packages}} WHERE snapshot = 'new') x
""")

# project_manifest: the project's direct dependencies (every lock package);
# dev entries go to devDependencies, every ninth is in both.
fixture("project_manifest", ["lock_packages"], """
SELECT project_id, name, 'dependencies' AS section, '^' || version AS spec
FROM {{lock_packages}} WHERE snapshot = 'new' AND (NOT dev OR lock_key % 9 = 0)
UNION ALL
SELECT project_id, name, 'devDependencies' AS section, '~' || version AS spec
FROM {{lock_packages}} WHERE snapshot = 'new' AND (dev OR lock_key % 9 = 0)
""")


# ignore_files: the ignore-file lines of every project (with a comment
# and a blank line on some), chosen by the project's number
fixture("ignore_files", ["documents"], f"""
SELECT DISTINCT d.source AS project_id, p.line
FROM {{{{documents}}}} d
JOIN {values(["k", "line"], [(0, "routes"), (0, "*.mjs"), (1, "lib"), (1, "# generated code"), (2, "app/api"),
                              (2, "  "), (2, " src/1 ")], "p")}
  ON p.k = CAST(substr(d.source, 4) AS INT) % 3
""")
