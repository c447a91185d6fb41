"""Lockfile, metadata and bill-of-materials queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainscope.functions.regex import sql_str
from chainscope.operators import license as L
from chainscope.operators import sbom as B
from chainscope.plans import sql as Q
from chainscope.plans.registry import query, with_fixtures

LOCK_OUT = ["project_id", "snapshot", "name", "version", "resolved", "integrity", "dev", "optional",
            "has_install_script", "has_bin", "license", "dependencies"]


def entries(ws):
    return B.parse_lockfile(ws.table("lockfile_json"))


def comps(ws):
    new = B.parse_lockfile(ws.lockfiles("new")).drop("snapshot")
    return B.components(new, ws.table("package_meta"), ws.table("project_manifest"))


def o_purl(name, version):
    return (f"('pkg:npm/' || CASE WHEN starts_with({name}, '@') THEN url_encode(split_part({name}, '/', 1)) || '/' || "
            f"split_part({name}, '/', 2) ELSE {name} END || '@' || {version})")


def o_norm_sbom(x):
    cases = " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in L.SBOM_ALIASES.items())
    return f"(CASE lower({Q.js_trim(x)}) {cases} ELSE {x} END)"


def o_entries():
    st = ("STRUCT(version VARCHAR, resolved VARCHAR, integrity VARCHAR, dev BOOLEAN, optional BOOLEAN, "
          "hasInstallScript BOOLEAN, hasBin BOOLEAN, license VARCHAR, dependencies MAP(VARCHAR, VARCHAR))")
    spec = '{"packages": "MAP(VARCHAR, ' + st + ')", "dependencies": "MAP(VARCHAR, ' + st + ')"}'
    return [
        ("lj", f"SELECT project_id, snapshot, json_transform(content, {sql_str(spec)}) AS j FROM lockfile_json WHERE json_valid(content)"),
        ("le", """
SELECT project_id, snapshot, j.packages IS NOT NULL AS pk,
       unnest(map_entries(CASE WHEN j.packages IS NOT NULL THEN j.packages ELSE j.dependencies END)) AS e FROM lj"""),
        ("ents", """
SELECT project_id, snapshot, name, e.value.version AS version, e.value.resolved AS resolved,
       e.value.integrity AS integrity, coalesce(e.value.dev, FALSE) AS dev, coalesce(e.value.optional, FALSE) AS optional,
       coalesce(e.value.hasInstallScript, FALSE) AS has_install_script,
       coalesce(e.value.hasBin, FALSE) AS has_bin, e.value.license AS license,
       array_to_string(list_sort(map_keys(e.value.dependencies)), ',') AS dependencies
FROM (SELECT *, CASE WHEN pk THEN regexp_replace(e.key, '^node_modules/', '') ELSE e.key END AS name FROM le)
WHERE NOT pk OR (e.key <> '' AND NOT contains(name, 'node_modules/'))"""),
    ]


def o_meta():
    def kind(path):
        return (f"CASE json_type(meta, '{path}') WHEN 'VARCHAR' THEN 'string' WHEN 'OBJECT' THEN 'object' "
                f"WHEN 'ARRAY' THEN 'array' ELSE CASE WHEN json_type(meta, '{path}') IS NULL THEN 'missing' ELSE 'other' END END")
    return [("mf", f"""
SELECT project_id, name, version, {kind('$.license')} AS license_type,
       CASE json_type(meta, '$.license') WHEN 'VARCHAR' THEN json_extract_string(meta, '$.license')
            WHEN 'OBJECT' THEN json_extract_string(meta, '$.license.type') END AS license,
       {kind('$.author')} AS author_type,
       CASE WHEN json_type(meta, '$.author') = 'VARCHAR' THEN json_extract_string(meta, '$.author')
            ELSE coalesce(json_extract_string(meta, '$.author.name'), '') END AS author,
       CASE WHEN json_type(meta, '$.repository') = 'VARCHAR' THEN json_extract_string(meta, '$.repository')
            ELSE json_extract_string(meta, '$.repository.url') END AS repository,
       coalesce(json_extract_string(meta, '$.description'), '') AS description,
       json_extract_string(meta, '$.deprecated') AS deprecated,
       CAST(coalesce(json_array_length(meta, '$.keywords'), -1) AS INTEGER) AS keyword_count
FROM (SELECT * REPLACE (CASE WHEN json_valid(meta) THEN meta END AS meta) FROM package_meta)""")]


def o_comps():
    return o_entries() + o_meta() + [("comp", f"""
SELECT e.project_id, e.name, e.version, {o_purl('e.name', 'e.version')} AS purl,
       coalesce(m.license, e.license) AS license, {o_norm_sbom('coalesce(m.license, e.license)')} AS license_id,
       CASE WHEN e.dev THEN 'dev' WHEN e.optional THEN 'optional'
            WHEN EXISTS (SELECT 1 FROM project_manifest pm WHERE pm.project_id = e.project_id AND pm.name = e.name
                         AND pm.section = 'devDependencies') THEN 'dev' ELSE 'required' END AS scope,
       coalesce(m.description, '') AS description, coalesce(m.author, '') AS author,
       coalesce(e.integrity, '') AS integrity, coalesce(e.resolved, '') AS resolved
FROM (SELECT * FROM ents WHERE snapshot = 'new') e
LEFT JOIN mf m ON m.project_id = e.project_id AND m.name = e.name""")]


@query("parse_lockfile", lambda: with_fixtures(["lockfile_json"], o_entries(), f"SELECT {', '.join(LOCK_OUT)} FROM ents"))
def q_parse_lockfile(ws):
    return entries(ws).withColumn("dependencies", F.array_join(F.array_sort("dependencies"), ",")).select(*LOCK_OUT)


@query("package_meta", lambda: with_fixtures(["package_meta"], o_meta(), "SELECT * FROM mf"))
def q_package_meta(ws):
    return B.meta_fields(ws.table("package_meta"))


@query("direct_dependencies", lambda: with_fixtures(["project_manifest"], [], """
SELECT project_id, name, arg_max(section, CASE WHEN section = 'devDependencies' THEN 1 ELSE 0 END) AS section,
       arg_max(spec, CASE WHEN section = 'devDependencies' THEN 1 ELSE 0 END) AS spec, count(*) > 1 AS in_both
FROM project_manifest GROUP BY project_id, name"""))
def q_direct_dependencies(ws):
    return B.direct_dependencies(ws.table("project_manifest"))


COMP_OUT = ["project_id", "name", "version", "purl", "license", "license_id", "scope", "description", "author",
            "integrity", "resolved"]


@query("sbom_components", lambda: with_fixtures(["lockfile_json", "package_meta", "project_manifest"], o_comps(),
                                                f"SELECT {', '.join(COMP_OUT)} FROM comp"))
def q_sbom_components(ws):
    return comps(ws).select(*COMP_OUT)


@query("purl", lambda: with_fixtures(["lock_packages"], [], f"""
SELECT project_id, snapshot, name, version, {o_purl('name', 'version')} AS purl FROM lock_packages"""))
def q_purl(ws):
    lp = ws.table("lock_packages")
    return lp.select("project_id", "snapshot", "name", "version", B.purl(F.col("name"), F.col("version")).alias("purl"))


@query("spdx_relationships", lambda: with_fixtures(["lockfile_json", "package_meta", "project_manifest", "lock_edges"], o_comps() + [
    ("num", "SELECT project_id, name, version, CAST(row_number() OVER (PARTITION BY project_id ORDER BY name) AS BIGINT) AS n FROM comp")],
    f"""
SELECT n.project_id, 'SPDXRef-Package-' || CAST(n.n AS VARCHAR) AS spdx_element_id, 'DEPENDS_ON' AS relationship_type,
       {o_purl('e.dep', "coalesce(d.version, '0.0.0')")} AS related_spdx_element
FROM num n JOIN (SELECT DISTINCT project_id, name, dep FROM lock_edges WHERE snapshot = 'new') e
  ON e.project_id = n.project_id AND e.name = n.name
LEFT JOIN comp d ON d.project_id = n.project_id AND d.name = e.dep"""))
def q_spdx_relationships(ws):
    edges = ws.table("lock_edges").where(F.col("snapshot") == "new")
    return B.spdx_relationships(comps(ws), edges)


AS_OF = "2024-06-01T00:00:00.000Z"
SBOM_FIX = ["lockfile_json", "package_meta", "project_manifest", "lock_edges"]


def new_edges(ws):
    return ws.table("lock_edges").where(F.col("snapshot") == "new")


def o_json(**fields):
    """Text of a JSON object from SQL texts of its values; a NULL value's field is left out."""
    parts = ", ".join(f"'\"{k.replace('__', '-')}\":' || ({v})" for k, v in fields.items())
    return "'{' || concat_ws(',', " + parts + ") || '}'"


def o_str(x):
    return f"CAST(to_json({x}) AS VARCHAR)"


def _o_document(head, item, between, link):
    h = "sha256(project_id || '@" + AS_OF + "')"
    cuts = " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return o_comps() + [
        ("num", "SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY name) AS BIGINT) AS n FROM comp"),
        ("rel", f"""
SELECT e.project_id, e.name, {o_purl('e.dep', "coalesce(d.version, '0.0.0')")} AS related
FROM (SELECT DISTINCT project_id, name, dep FROM lock_edges WHERE snapshot = 'new') e
LEFT JOIN comp d ON d.project_id = e.project_id AND d.name = e.dep"""),
        ("rels", f"SELECT n.*, r.related FROM num n LEFT JOIN rel r USING (project_id, name)"),
        ("links", f"SELECT project_id, n, {link} AS text FROM rels GROUP BY project_id, n, purl"),
        ("subject", f"SELECT DISTINCT project_id, 'urn:uuid:' || {cuts} AS serial FROM comp"),
        ("doc", f"""
SELECT project_id, 0 AS section, 0 AS n, substr({head}, 1, length({head}) - 1) || {sql_str(between[0])} AS text FROM subject
UNION ALL SELECT project_id, 1, n, CASE WHEN n = 1 THEN '' ELSE ',' END || {item} FROM num
UNION ALL SELECT project_id, 2, 0, {sql_str(between[1])} FROM subject
UNION ALL SELECT project_id, 3, n, CASE WHEN n = min(n) OVER (PARTITION BY project_id) THEN '' ELSE ',' END || text FROM links WHERE text <> ''
UNION ALL SELECT project_id, 4, 0, ']}}' FROM subject""")]


def _o_checksums(a, b, alg, content):
    return (f"CASE WHEN integrity <> '' THEN '[' || " + o_json(**{alg: f"CASE WHEN starts_with(integrity, 'sha512') THEN '\"{a}\"' ELSE '\"{b}\"' END",
            content: o_str("CASE WHEN contains(integrity, '-') THEN split_part(integrity, '-', 2) ELSE integrity END")}) + " || ']' END")


def _o_cyclonedx():
    tool = o_json(vendor="'\"chainscope\"'", name="'\"chainscope\"'", version="'\"1.0.0\"'")
    subject = o_json(type="'\"application\"'", name=o_str("project_id"), version="'\"0.0.0\"'", bom__ref=o_str("'pkg:npm/' || project_id || '@0.0.0'"))
    head = o_json(bomFormat="'\"CycloneDX\"'", specVersion="'\"1.5\"'", serialNumber=o_str("serial"), version="'1'",
                  metadata=o_json(timestamp=f"'\"{AS_OF}\"'", tools=f"'[' || {tool} || ']'", component=subject))
    licenses = "CASE WHEN license <> '' THEN '[' || " + o_json(license=o_json(id=o_str("license_id"))) + " || ']' END"
    item = o_json(type="'\"library\"'", name=o_str("name"), version=o_str("version"), purl=o_str("purl"), bom__ref=o_str("purl"), scope=o_str("scope"),
                  licenses=licenses, description="CASE WHEN description <> '' THEN " + o_str("description") + " END",
                  author="CASE WHEN author <> '' THEN " + o_str("author") + " END", hashes=_o_checksums("SHA-512", "SHA-256", "alg", "content"),
                  externalReferences="CASE WHEN resolved <> '' THEN '[' || " + o_json(type="'\"distribution\"'", url=o_str("resolved")) + " || ']' ELSE '[]' END")
    listed = "'[' || coalesce(string_agg(" + o_str("related") + ", ',' ORDER BY related), '') || ']'"
    link = "'{\"ref\":' || " + o_str("purl") + " || ',\"dependsOn\":' || " + listed + " || '}'"
    return _o_document(head, item, (',"components":[', '],"dependencies":['), link)


def _o_spdx():
    head = o_json(spdxVersion="'\"SPDX-2.3\"'", dataLicense="'\"CC0-1.0\"'", SPDXID="'\"SPDXRef-DOCUMENT\"'", name=o_str("project_id || '-0.0.0'"),
                  documentNamespace=o_str("'https://chainscope.example/spdx/' || project_id || '/' || serial"),
                  creationInfo=o_json(created=f"'\"{AS_OF}\"'", creators="'[\"Tool: chainscope-1.0.0\"]'", licenseListVersion="'\"3.22\"'"))
    lic = "CASE WHEN license <> '' THEN " + o_str("license_id") + " ELSE '\"NOASSERTION\"' END"
    item = o_json(SPDXID="'\"SPDXRef-Package-' || n || '\"'", name=o_str("name"), versionInfo=o_str("version"),
                  downloadLocation="CASE WHEN resolved <> '' THEN " + o_str("resolved") + " ELSE '\"NOASSERTION\"' END", filesAnalyzed="'false'",
                  licenseConcluded=lic, licenseDeclared=lic, copyrightText="'\"NOASSERTION\"'",
                  externalRefs="'[' || " + o_json(referenceCategory="'\"PACKAGE-MANAGER\"'", referenceType="'\"purl\"'", referenceLocator=o_str("purl")) + " || ']'",
                  description="CASE WHEN description <> '' THEN " + o_str("description") + " END", checksums=_o_checksums("SHA512", "SHA256", "algorithm", "checksumValue"))
    one = o_json(spdxElementId="'\"SPDXRef-Package-' || n || '\"'", relationshipType="'\"DEPENDS_ON\"'", relatedSpdxElement=o_str("related"))
    link = f"coalesce(string_agg(CASE WHEN related IS NOT NULL THEN {one} END, ',' ORDER BY related), '')"
    return _o_document(head, item, (',"packages":[', '],"relationships":['), link)


@query("sbom_cyclonedx", lambda: with_fixtures(SBOM_FIX, _o_cyclonedx(), "SELECT project_id, section, CAST(n AS BIGINT) AS n, text FROM doc"))
def q_sbom_cyclonedx(ws):
    """Every project's CycloneDX document, as ordered rows of JSON text."""
    return B.cyclonedx_document(comps(ws), new_edges(ws), AS_OF)


@query("sbom_spdx", lambda: with_fixtures(SBOM_FIX, _o_spdx(), "SELECT project_id, section, CAST(n AS BIGINT) AS n, text FROM doc"))
def q_sbom_spdx(ws):
    """Every project's SPDX document, as ordered rows of JSON text."""
    return B.spdx_document(comps(ws), new_edges(ws), AS_OF)


@query("attestation_shred", lambda: with_fixtures(["attestations"], [], """
SELECT project_id, name,
       coalesce(json_extract_string(bundle, '$.predicateType'), 'https://slsa.dev/provenance/v1') AS predicate_type,
       coalesce(json_extract_string(bundle, '$.predicate.buildType'), 'unknown') AS build_type,
       coalesce(json_extract_string(bundle, '$.predicate.builder.id'), 'unknown') AS builder,
       coalesce(json_extract_string(bundle, '$.predicate.materials[0].uri'), 'unknown') AS source_uri,
       coalesce(json_extract_string(bundle, '$.predicate.materials[0].digest.sha1'),
                json_extract_string(bundle, '$.predicate.materials[0].digest.sha256'), 'unknown') AS source_digest,
       coalesce(json_extract_string(bundle, '$.predicate.invocation.configSource.entryPoint'), 'unknown') AS invocation_id,
       FALSE AS verified
FROM (SELECT * REPLACE (CASE WHEN json_valid(bundle) THEN bundle END AS bundle) FROM attestations) WHERE json_type(bundle, '$.predicate') = 'OBJECT'"""))
def q_attestation_shred(ws):
    return B.attestation(ws.table("attestations"))
