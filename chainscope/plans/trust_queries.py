"""License, maintainer and provenance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainscope.functions.regex import sql_str
from chainscope.operators import license as L
from chainscope.operators import sbom as B
from chainscope.operators import trust as T
from chainscope.plans import sql as Q
from chainscope.plans.registry import query, with_fixtures

KEYS = ["project_id", "name"]


def _in(xs):
    return "(" + ", ".join(sql_str(x) for x in xs) + ")"


def o_normalize(x: str) -> str:
    cases = " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in L.ALIASES.items())
    return f"(CASE lower({Q.js_trim(x)}) {cases} ELSE {x} END)"


def o_simple(n: str) -> str:
    return (f"(CASE WHEN {n} IN {_in(L.PUBLIC_DOMAIN)} THEN 'public-domain' WHEN {n} IN {_in(L.PERMISSIVE)} "
            f"THEN 'permissive' WHEN {n} IN {_in(L.COPYLEFT)} THEN 'copyleft' "
            f"WHEN {n} IN {_in(L.WEAK_COPYLEFT)} THEN 'weak-copyleft' END)")


def o_classify(n: str) -> str:
    part = o_normalize(Q.js_trim("regexp_replace(p, '[()]', '', 'g')"))
    parts = (f"list_transform(string_split_regex({n}, '\\s+(?:OR|AND)\\s+'), "
             f"lambda p: coalesce({o_simple(part)}, 'unknown'))")
    return (f"coalesce({o_simple(n)}, CASE WHEN instr({n}, ' OR ') > 0 OR instr({n}, ' AND ') > 0 THEN "
            f"CASE WHEN list_bool_and(list_transform({parts}, lambda c: c IN ('permissive', 'public-domain'))) "
            f"THEN 'permissive' WHEN list_bool_or(list_transform({parts}, lambda c: c = 'copyleft')) THEN 'copyleft' "
            f"WHEN list_bool_or(list_transform({parts}, lambda c: c = 'weak-copyleft')) THEN 'weak-copyleft' END END, "
            f"'unknown')")


def o_from_text(text: str) -> str:
    whens = []
    for spdx, groups in L.TEXT_RULES:
        cond = " AND ".join("(" + " OR ".join(f"instr(upper({text}), {sql_str(a)}) > 0" for a in alts) + ")"
                            for alts in groups)
        whens.append(f"WHEN {cond} THEN {sql_str(spdx)}")
    return "(CASE " + " ".join(whens) + " END)"


def o_readable():
    """Metadata that is JSON; DuckDB's functions fail on any other text."""
    return ("readable", "SELECT * REPLACE (CASE WHEN json_valid(meta) THEN meta END AS meta) FROM package_meta")


def o_detect():
    decl = """CASE WHEN json_type(meta, '$.license') = 'VARCHAR' THEN json_extract_string(meta, '$.license')
      WHEN coalesce(json_extract_string(meta, '$.license.type'), '') <> '' THEN json_extract_string(meta, '$.license.type')
      WHEN json_type(meta, '$.licenses') = 'ARRAY' THEN array_to_string(list_filter(
           json_extract_string(meta, '$.licenses[*].type'), lambda s: s IS NOT NULL AND s <> ''), ' OR ')
      ELSE '' END"""
    return [
        o_readable(),
        ("lt", f"""
SELECT project_id, name, arg_min(file_lic, o) AS file_lic FROM (
  SELECT project_id, name, {o_from_text('text')} AS file_lic,
         CASE file WHEN 'LICENSE' THEN 1 WHEN 'LICENSE.md' THEN 2 WHEN 'LICENSE.txt' THEN 3 WHEN 'LICENCE' THEN 4 ELSE 5 END AS o
  FROM license_docs) WHERE file_lic IS NOT NULL GROUP BY project_id, name"""),
        ("ld0", f"""
SELECT d.project_id, d.name, coalesce(json_extract_string(meta, '$.version'), '0.0.0') AS version, coalesce({decl}, '') AS decl, lt.file_lic
FROM (SELECT DISTINCT project_id, name FROM project_manifest) d LEFT JOIN readable m USING (project_id, name)
LEFT JOIN lt ON lt.project_id = d.project_id AND lt.name = d.name"""),
        ("ld1", """
SELECT *, CASE WHEN decl <> '' THEN decl WHEN file_lic IS NOT NULL THEN file_lic ELSE 'UNKNOWN' END AS raw_lic,
       CASE WHEN decl <> '' THEN 'package.json' WHEN file_lic IS NOT NULL THEN 'LICENSE' ELSE 'inferred' END AS source
FROM ld0"""),
        ("ld2", f"SELECT project_id, name, version, source, {o_normalize('raw_lic')} AS license FROM ld1"),
        ("lic", f"SELECT *, {o_classify('license')} AS category FROM ld2"),
        ("viol", f"""
SELECT * FROM (
  SELECT project_id, name, version, license, category,
    CASE WHEN license IN {_in(L.DEFAULT_POLICY['denied'])} THEN 'denied-license'
         WHEN category = 'copyleft' THEN 'copyleft-in-proprietary'
         WHEN license = 'UNKNOWN' THEN 'no-license' WHEN category = 'unknown' THEN 'unknown-license' END AS violation_type,
    CASE WHEN license IN {_in(L.DEFAULT_POLICY['denied'])} THEN 'critical'
         WHEN category = 'copyleft' THEN 'critical'
         WHEN license = 'UNKNOWN' OR category = 'unknown' THEN 'medium' END AS severity,
    CASE WHEN license IN {_in(L.DEFAULT_POLICY['denied'])} THEN 'License "' || license || '" is on the denied list'
         WHEN category = 'copyleft' THEN 'Copyleft license "' || license || '" not allowed in proprietary projects'
         WHEN license = 'UNKNOWN' THEN 'Package has no declared license'
         WHEN category = 'unknown' THEN 'License "' || license || '" is not a recognized SPDX identifier' END AS message
  FROM lic) WHERE violation_type IS NOT NULL"""),
    ]


LIC_FIX = ["package_meta", "license_docs", "project_manifest"]


def licenses(ws):
    return L.detect_direct(B.direct_dependencies(ws.table("project_manifest")), ws.table("package_meta"), ws.table("license_docs"), KEYS)


@query("license_from_text", lambda: with_fixtures([], [], f"""
SELECT doc_id, {o_from_text('text')} AS license FROM documents WHERE {o_from_text('text')} IS NOT NULL"""))
def q_license_from_text(ws):
    d = ws.table("documents").select("doc_id", F.upper("text").alias("_up"))
    return d.select("doc_id", L.from_upper(F.col("_up")).alias("license")).where(F.col("license").isNotNull())


@query("license_normalize", lambda: with_fixtures(["lock_packages"], [], f"""
SELECT project_id, snapshot, name, license AS raw, {o_normalize('license')} AS normalized FROM lock_packages"""))
def q_license_normalize(ws):
    lp = ws.table("lock_packages")
    return lp.select("project_id", "snapshot", "name", F.col("license").alias("raw"),
                     L.normalize(F.col("license")).alias("normalized"))


@query("license_classify", lambda: with_fixtures(["lock_packages"], [], f"""
SELECT project_id, snapshot, name, license, {o_classify(o_normalize('license'))} AS category FROM lock_packages"""))
def q_license_classify(ws):
    lp = ws.table("lock_packages")
    return lp.select("project_id", "snapshot", "name", "license", L.classify(F.col("license")).alias("category"))


@query("detect_license", lambda: with_fixtures(LIC_FIX, o_detect(),
                                               "SELECT project_id, name, version, license, source, category FROM lic"))
def q_detect_license(ws):
    return licenses(ws).select("project_id", "name", "version", "license", "source", "category")


@query("license_list", lambda: with_fixtures(LIC_FIX, o_detect(), """
SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY name) AS BIGINT) AS rank, name, license FROM lic"""))
def q_license_list(ws):
    return L.listed(licenses(ws)).select("project_id", "rank", "name", "license")


@query("license_violations", lambda: with_fixtures(LIC_FIX, o_detect(), """
SELECT project_id, name, version, license, violation_type, severity, message FROM viol"""))
def q_license_violations(ws):
    return L.violations(licenses(ws)).select("project_id", "name", "version", "license", "violation_type",
                                             "severity", "message")


@query("license_summary", lambda: with_fixtures(LIC_FIX, o_detect(), """
SELECT l.project_id, CAST(count(*) AS BIGINT) AS total,
       CAST(count_if(category = 'permissive') AS BIGINT) AS permissive,
       CAST(count_if(category = 'copyleft') AS BIGINT) AS copyleft,
       CAST(count_if(category = 'weak-copyleft') AS BIGINT) AS weak_copyleft,
       CAST(count_if(category = 'public-domain') AS BIGINT) AS public_domain,
       CAST(count_if(category = 'proprietary') AS BIGINT) AS proprietary,
       CAST(count_if(category = 'unknown') AS BIGINT) AS unknown,
       CAST(coalesce(max(v.n), 0) AS BIGINT) AS violations
FROM lic l LEFT JOIN (SELECT project_id, count(*) AS n FROM viol GROUP BY project_id) v USING (project_id)
GROUP BY l.project_id"""))
def q_license_summary(ws):
    lic = licenses(ws)
    return L.summary(lic, L.violations(lic))


# ------------------------------------------------------------------ maintainers

def o_maint():
    person_s = "{'name': json_extract_string(x, '$'), 'email': ''}"
    person_o = "{'name': coalesce(json_extract_string(x, '$.name'), ''), 'email': coalesce(json_extract_string(x, '$.email'), '')}"
    ms = (f"list_filter(list_transform(coalesce(CAST(json_extract(meta, '$.maintainers[*]') AS JSON[]), []), "
          f"lambda x: CASE WHEN json_type(x) = 'VARCHAR' THEN {person_s} WHEN json_type(x) = 'OBJECT' "
          f"THEN {person_o} END), lambda x: x IS NOT NULL)")
    amatch = "regexp_extract(json_extract_string(meta, '$.author'), '^([^<(]+)', 1)"
    author = (f"CASE WHEN json_type(meta, '$.author') = 'VARCHAR' AND {amatch} <> '' "
              f"THEN {{'name': {Q.js_trim(amatch)}, 'email': ''}} "
              f"WHEN json_type(meta, '$.author') = 'OBJECT' AND coalesce(json_extract_string(meta, '$.author.name'), '') <> '' "
              f"THEN {{'name': json_extract_string(meta, '$.author.name'), "
              f"'email': coalesce(json_extract_string(meta, '$.author.email'), '')}} END")

    def truthy(path):
        return (f"(CASE WHEN json_type(meta, '{path}') IS NULL OR json_type(meta, '{path}') = 'NULL' THEN FALSE "
                f"WHEN json_type(meta, '{path}') = 'VARCHAR' THEN json_extract_string(meta, '{path}') <> '' "
                f"WHEN json_type(meta, '{path}') = 'BOOLEAN' THEN CAST(json_extract_string(meta, '{path}') AS BOOLEAN) "
                f"WHEN json_type(meta, '{path}') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(json_extract_string(meta, '{path}') AS DOUBLE) <> 0 "
                f"ELSE TRUE END)")
    free = " OR ".join(f"ends_with(m.email, '@{d}')" for d in T.FREEMAIL)
    res = "coalesce(json_extract_string(meta, '$._resolved'), '')"
    flags = {
        "single-maintainer": "n <= 1", "no-maintainers": "n = 0",
        "no-repository": f"NOT {truthy('$.repository')}",
        "freemail-single-maintainer": f"coalesce(list_bool_or(list_transform(ms, lambda m: {free})), FALSE) AND n <= 1",
        "minimal-metadata": f"NOT {truthy('$.homepage')} AND NOT {truthy('$.description')}",
        "deprecated": truthy("$.deprecated"),
        "non-standard-registry": f"{res} <> '' AND instr({res}, 'registry.npmjs.org') = 0",
        "no-license": f"NOT {truthy('$.license')}",
        "long-name": "length(name) > 40",
        "no-keywords": f"NOT {truthy('$.keywords')} OR (json_type(meta, '$.keywords') = 'ARRAY' AND json_array_length(meta, '$.keywords') = 0)",
    }
    fcols = ", ".join(f"coalesce({flags[f]}, FALSE) AS \"f_{f}\"" for f, _ in T.FACTORS)
    total = " + ".join(f"CASE WHEN \"f_{f}\" THEN {s} ELSE 0.0 END" for f, s in T.FACTORS)
    factors = ", ".join(f"CASE WHEN \"f_{f}\" THEN '{f}' END" for f, _ in T.FACTORS)
    return [
        o_readable(),
        ("mm0", f"SELECT project_id, name, version, meta, {ms} AS ms0, {author} AS au FROM readable"),
        ("mm", """
SELECT project_id, name, version, meta,
       CASE WHEN au IS NOT NULL AND NOT coalesce(list_bool_or(list_transform(ms0, lambda m: m.name = au.name)), FALSE)
            THEN list_append(ms0, au) ELSE ms0 END AS ms
FROM mm0"""),
        ("mf", f"SELECT *, {fcols} FROM (SELECT *, CAST(len(ms) AS INTEGER) AS n FROM mm)"),
        ("mr", f"""
SELECT *, CAST(least(10.0, {total}) AS DOUBLE) AS risk_score, concat_ws(',', {factors}) AS factors FROM mf"""),
        ("mread", """
SELECT project_id, name, version, n AS maintainer_count, risk_score,
       CASE WHEN risk_score >= 7 THEN 'critical' WHEN risk_score >= 4 THEN 'high' WHEN risk_score >= 2 THEN 'medium'
            ELSE 'low' END AS risk_level, factors,
       concat_ws('; ', CASE WHEN n <= 1 THEN 'Consider alternatives with multiple maintainers' END,
                 CASE WHEN "f_no-repository" THEN 'Verify package source manually' END,
                 CASE WHEN "f_deprecated" THEN 'Replace with maintained alternative' END,
                 CASE WHEN risk_score >= 4 THEN 'Pin exact version and monitor for changes' END) AS recommendations
FROM mr WHERE json_type(meta) <> 'NULL'"""),
        ("mrisk", """
SELECT * FROM mread UNION ALL
SELECT project_id, name, '0.0.0', 0, 5.0, 'high', 'unreadable', 'Verify package is properly installed'
FROM readable WHERE meta IS NULL OR json_type(meta) = 'NULL'"""),
    ]


def mrisk(ws):
    return T.maintainer_risk(ws.table("package_meta"))


@query("maintainers", lambda: with_fixtures(["package_meta"], o_maint(), """
SELECT project_id, name, m.name AS maintainer, m.email AS email FROM (SELECT project_id, name, unnest(ms) AS m FROM mm)"""))
def q_maintainers(ws):
    m = ws.table("package_meta").select("project_id", "name", F.explode(T.maintainers(F.col("meta"))).alias("m"))
    return m.select("project_id", "name", F.col("m.name").alias("maintainer"), F.col("m.email").alias("email"))


@query("maintainer_risk", lambda: with_fixtures(["package_meta"], o_maint(), "SELECT * FROM mrisk"))
def q_maintainer_risk(ws):
    return mrisk(ws).select("project_id", "name", "version", "maintainer_count", "risk_score", "risk_level",
                            "factors", "recommendations")


@query("maintainer_summary", lambda: with_fixtures(["package_meta"], o_maint(), f"""
SELECT project_id, CAST(count(*) AS BIGINT) AS total,
       CAST(count_if(risk_level = 'low') AS BIGINT) AS low, CAST(count_if(risk_level = 'medium') AS BIGINT) AS medium,
       CAST(count_if(risk_level = 'high') AS BIGINT) AS high, CAST(count_if(risk_level = 'critical') AS BIGINT) AS critical,
       {Q.round1('CAST(sum(CAST(risk_score AS DECIMAL(18,2))) AS DOUBLE) / count(*)')} AS average_score,
       CAST(count_if(maintainer_count <= 1) AS BIGINT) AS single_maintainer
FROM mrisk GROUP BY project_id"""))
def q_maintainer_summary(ws):
    return T.maintainer_summary(mrisk(ws))


# ------------------------------------------------------------------ provenance

def o_prov():
    url = "json_extract_string(meta, '$.repository.url')"
    repo = (f"CASE WHEN json_type(meta, '$.repository') = 'VARCHAR' THEN json_extract_string(meta, '$.repository') "
            f"WHEN coalesce({url}, '') <> '' THEN regexp_replace(regexp_replace({url}, '^git\\+', ''), '\\.git$', '') END")
    gh = "regexp_extract(source_repo, 'github\\.com[/:]([^/]+)/([^/]+)', 2)"
    base = "regexp_replace(name, '^@[^/]+/', '')"
    return [
        o_readable(),
        ("locked", "SELECT project_id, name, max(integrity) AS integrity FROM lock_packages WHERE snapshot = 'new' GROUP BY project_id, name"),
        ("proof", """
SELECT project_id, name FROM (SELECT project_id, name, CASE WHEN json_valid(bundle) THEN bundle END AS b FROM attestations)
WHERE json_type(b, '$.predicate') = 'OBJECT' GROUP BY project_id, name"""),
        ("pv0", f"""
SELECT project_id, name, coalesce(json_extract_string(meta, '$.version'), '0.0.0') AS version, l.integrity, {repo} AS source_repo,
       p.name IS NOT NULL AS attested
FROM readable m LEFT JOIN locked l USING (project_id, name) LEFT JOIN proof p USING (project_id, name)"""),
        ("pv1", f"""
SELECT *, coalesce(source_repo, '') <> '' AS has_repo, coalesce(integrity, '') <> '' AS has_int,
       coalesce(source_repo, '') <> '' AND contains(source_repo, 'github.com')
         AND regexp_matches(source_repo, 'github\\.com[/:]([^/]+)/([^/]+)')
         AND NOT contains(lower({gh}), lower({base})) AND NOT contains({base}, lower({gh})) AS mismatch,
       {gh} AS gh_repo
FROM pv0"""),
        ("prov", """
SELECT project_id, name, version, source_repo,
       attested, CASE WHEN attested OR has_int THEN 'unverified' ELSE 'missing' END AS status,
       CASE WHEN has_int THEN split_part(integrity, '-', 1) END AS integrity_algorithm,
       concat_ws('; ', CASE WHEN attested THEN 'Attestation present but not verified' END, CASE WHEN NOT has_repo THEN 'No source repository declared' END,
                 CASE WHEN NOT has_int THEN 'No integrity hash in lockfile' END,
                 CASE WHEN mismatch THEN 'Package name "' || name || '" doesn''t match repo "' || gh_repo || '"' END)
         AS risk_factors,
       CAST((CASE WHEN attested THEN 1 ELSE 0 END) + (CASE WHEN NOT has_repo THEN 1 ELSE 0 END) + (CASE WHEN NOT has_int THEN 1 ELSE 0 END)
            + (CASE WHEN mismatch THEN 1 ELSE 0 END) AS INTEGER) AS risk_factor_count
FROM pv1"""),
    ]


def prov(ws):
    lock = B.parse_lockfile(ws.table("lockfile_json")).where(F.col("snapshot") == "new")
    return T.provenance(ws.table("package_meta"), lock, B.attestation(ws.table("attestations")))


PROV_FIX = ["package_meta", "lock_packages", "attestations", "lockfile_json"]


@query("provenance", lambda: with_fixtures(PROV_FIX, o_prov(), "SELECT * FROM prov"))
def q_provenance(ws):
    return prov(ws).select("project_id", "name", "version", "source_repo", "attested", "status", "integrity_algorithm",
                           "risk_factors", "risk_factor_count")


@query("provenance_summary", lambda: with_fixtures(PROV_FIX, o_prov(), f"""
SELECT project_id, CAST(count(*) AS BIGINT) AS total, CAST(count_if(status = 'verified') AS BIGINT) AS verified,
       CAST(count_if(status = 'unverified') AS BIGINT) AS unverified,
       CAST(count_if(status = 'missing') AS BIGINT) AS missing, CAST(count_if(status = 'invalid') AS BIGINT) AS invalid, CAST(count_if(attested) AS BIGINT) AS attested,
       {Q.js_round('count_if(status = ' + "'verified'" + ') / count(*) * 100.0')} AS coverage
FROM prov GROUP BY project_id"""))
def q_provenance_summary(ws):
    return T.provenance_summary(prov(ws))
