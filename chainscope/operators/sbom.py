"""Lockfile and metadata sources, bill of materials.

Lockfile documents are parsed with ``from_json`` into a map of entries and
exploded; package metadata and attestation bundles go through VARIANT.
SBOM documents are ordered rows (header, a row for each component, a row
for its dependencies, footer) -- a document is never assembled in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainscope.functions.ranking import group_rank
from chainscope.operators import license as L

ENTRY = ("struct<version:string,resolved:string,integrity:string,dev:boolean,optional:boolean,"
         "hasInstallScript:boolean,hasBin:boolean,license:string,dependencies:map<string,string>>")
LOCK_SCHEMA = f"struct<lockfileVersion:int,packages:map<string,{ENTRY}>,dependencies:map<string,{ENTRY}>>"


def parse_lockfile(docs: DataFrame, keys=("project_id", "snapshot"), content_col: str = "content") -> DataFrame:
    """Entries of v1 ('dependencies') and v2/v3 ('packages') lock
    documents; the root entry and nested node_modules entries are dropped
    and the 'node_modules/' prefix is stripped."""
    keys = list(keys)
    p = docs.select(*keys, F.from_json(F.col(content_col), LOCK_SCHEMA).alias("_l"))
    use_pk = F.col("_l.packages").isNotNull()
    m = F.when(use_pk, F.col("_l.packages")).otherwise(F.col("_l.dependencies"))
    e = p.select(*keys, use_pk.alias("_pk"), F.explode(m).alias("key", "e"))
    name = F.when(F.col("_pk"), F.regexp_replace("key", "^node_modules/", "")).otherwise(F.col("key"))
    e = e.withColumn("name", name)
    e = e.where(~F.col("_pk") | ((F.col("key") != "") & ~F.col("name").contains("node_modules/")))
    return e.select(*keys, "name", F.col("e.version").alias("version"), F.col("e.resolved").alias("resolved"),
                    F.col("e.integrity").alias("integrity"),
                    F.coalesce(F.col("e.dev"), F.lit(False)).alias("dev"),
                    F.coalesce(F.col("e.optional"), F.lit(False)).alias("optional"),
                    F.coalesce(F.col("e.hasInstallScript"), F.lit(False)).alias("has_install_script"),
                    F.coalesce(F.col("e.hasBin"), F.lit(False)).alias("has_bin"),
                    F.col("e.license").alias("license"),
                    F.map_keys(F.col("e.dependencies")).alias("dependencies"))


def lock_edges(entries: DataFrame, keys=("project_id", "snapshot")) -> DataFrame:
    """Dependency names of parsed lock entries, one distinct (*keys, name, dep) per row."""
    return entries.select(*keys, "name", F.explode("dependencies").alias("dep")).distinct()


def purl(name: Column, version: Column) -> Column:
    """Pkg:npm/<name>@<version>, the scope percent-encoded."""
    parts = F.split(name, "/")
    scoped = F.concat(F.url_encode(F.element_at(parts, 1)), F.lit("/"), F.try_element_at(parts, F.lit(2)))
    return F.concat(F.lit("pkg:npm/"), F.when(name.startswith("@"), scoped).otherwise(name), F.lit("@"), version)


def meta_fields(meta: DataFrame) -> DataFrame:
    """Typed view of the polymorphic package.json fields."""
    v = F.try_parse_json(F.col("meta"))

    def t(path):
        return F.schema_of_variant(F.variant_get(v, path, "variant"))

    def kind(path):
        x = t(path)
        return (F.when(x.isNull(), "missing").when(x == "STRING", "string").when(x.startswith("OBJECT"), "object")
                .when(x.startswith("ARRAY"), "array").otherwise("other"))
    author = (F.when(t("$.author") == "STRING", F.try_variant_get(v, "$.author", "string"))
              .otherwise(F.coalesce(F.try_variant_get(v, "$.author.name", "string"), F.lit(""))))
    lic = (F.when(t("$.license") == "STRING", F.try_variant_get(v, "$.license", "string"))
           .when(t("$.license").startswith("OBJECT"), F.try_variant_get(v, "$.license.type", "string")))
    repo = (F.when(t("$.repository") == "STRING", F.try_variant_get(v, "$.repository", "string"))
            .otherwise(F.try_variant_get(v, "$.repository.url", "string")))
    kw = F.try_variant_get(v, "$.keywords", "array<string>")
    return meta.select(
        "project_id", "name", "version",
        kind("$.license").alias("license_type"), lic.alias("license"),
        kind("$.author").alias("author_type"), author.alias("author"),
        repo.alias("repository"),
        F.coalesce(F.try_variant_get(v, "$.description", "string"), F.lit("")).alias("description"),
        F.try_variant_get(v, "$.deprecated", "string").alias("deprecated"),
        F.coalesce(F.size(kw), F.lit(-1)).alias("keyword_count"))


def direct_dependencies(manifest: DataFrame, keys=("project_id",)) -> DataFrame:
    """Union of dependencies and devDependencies, one row per name,
    the devDependencies spec winning when a name is in both."""
    keys = list(keys)
    pick = F.max_by(F.struct("section", "spec"), F.when(F.col("section") == "devDependencies", 1).otherwise(0))
    return (manifest.groupBy(*keys, "name").agg(pick.alias("_p"), F.count("*").cast("bigint").alias("sections"))
            .select(*keys, "name", F.col("_p.section").alias("section"), F.col("_p.spec").alias("spec"),
                    (F.col("sections") > 1).alias("in_both")))


def components(lock_entries: DataFrame, meta: DataFrame, manifest: DataFrame, keys=("project_id",)) -> DataFrame:
    """Lock entries with metadata: license (metadata, else lock),
    scope (dev flag > optional > listed in the project's devDependencies >
    required), description, author, purl."""
    keys = list(keys)
    m = meta_fields(meta).select(*keys, "name", F.col("license").alias("_ml"), "description", "author")
    dev = (manifest.where(F.col("section") == "devDependencies").select(*keys, "name").distinct()
           .withColumn("_in_dev", F.lit(True)))
    j = lock_entries.join(m, keys + ["name"], "left").join(dev, keys + ["name"], "left")
    lic = F.coalesce(F.col("_ml"), F.col("license"))
    scope = (F.when(F.col("dev"), "dev").when(F.col("optional"), "optional").when(F.col("_in_dev"), "dev")
             .otherwise("required"))
    return j.select(*keys, "name", "version", purl(F.col("name"), F.col("version")).alias("purl"),
                    lic.alias("license"), L.normalize_sbom(lic).alias("license_id"), scope.alias("scope"),
                    F.coalesce(F.col("description"), F.lit("")).alias("description"),
                    F.coalesce(F.col("author"), F.lit("")).alias("author"),
                    F.coalesce(F.col("integrity"), F.lit("")).alias("integrity"),
                    F.coalesce(F.col("resolved"), F.lit("")).alias("resolved"))


def numbered(comps: DataFrame, keys=("project_id",)) -> DataFrame:
    """Components with n, their place by name within the project."""
    keys = list(keys)
    return group_rank(comps, keys, [F.col("name")], name="n", lead=[(F.substring("name", 1, 8), False)])


def depends_on(comps: DataFrame, edges: DataFrame, keys=("project_id",)) -> DataFrame:
    """(keys, name, related): the package URL of each dependency of each component,
    version 0.0.0 where the lock has no entry for it."""
    keys = list(keys)
    versions = comps.select(*keys, F.col("name").alias("dep"), F.col("version").alias("dep_version"))
    return edges.select(*keys, "name", "dep").distinct().join(versions, keys + ["dep"], "left").select(
        *keys, "name", purl(F.col("dep"), F.coalesce(F.col("dep_version"), F.lit("0.0.0"))).alias("related"))


def spdx_relationships(comps: DataFrame, edges: DataFrame, keys=("project_id",)) -> DataFrame:
    """SPDXRef-Package-<n> DEPENDS_ON <dependency purl>; packages
    numbered by name within the project (one numbering for both lists)."""
    keys = list(keys)
    rel = numbered(comps.select(*keys, "name"), keys).join(depends_on(comps, edges, keys), keys + ["name"])
    return rel.select(*keys, F.concat(F.lit("SPDXRef-Package-"), F.col("n").cast("string")).alias("spdx_element_id"),
                      F.lit("DEPENDS_ON").alias("relationship_type"), F.col("related").alias("related_spdx_element"))


def _checksum(sha512: str, sha256: str) -> tuple[Column, Column]:
    alg = F.when(F.col("integrity").startswith("sha512"), sha512).otherwise(sha256)
    return alg, F.coalesce(F.try_element_at(F.split(F.col("integrity"), "-"), F.lit(2)), F.col("integrity"))


def cyclonedx_component() -> Column:
    """The CycloneDX 1.5 object of a component row, as JSON."""
    alg, digest = _checksum("SHA-512", "SHA-256")
    return F.to_json(F.struct(
        F.lit("library").alias("type"), F.col("name").alias("name"), F.col("version").alias("version"),
        F.col("purl").alias("purl"), F.col("purl").alias("bom-ref"), F.col("scope").alias("scope"),
        F.when(F.col("license").isNotNull() & (F.col("license") != ""),
               F.array(F.struct(F.struct(F.col("license_id").alias("id")).alias("license")))).alias("licenses"),
        F.when(F.col("description") != "", F.col("description")).alias("description"),
        F.when(F.col("author") != "", F.col("author")).alias("author"),
        F.when(F.col("integrity") != "", F.array(F.struct(alg.alias("alg"), digest.alias("content")))).alias("hashes"),
        F.when(F.col("resolved") != "", F.array(F.struct(F.lit("distribution").alias("type"),
                                                         F.col("resolved").alias("url"))))
        .otherwise(F.array().cast("array<struct<type:string,url:string>>")).alias("externalReferences")))


def spdx_package() -> Column:
    """The SPDX 2.3 object of a numbered component row, as JSON."""
    alg, digest = _checksum("SHA512", "SHA256")
    lic = F.when(F.col("license").isNotNull() & (F.col("license") != ""), F.col("license_id")).otherwise(F.lit("NOASSERTION"))
    return F.to_json(F.struct(
        F.concat(F.lit("SPDXRef-Package-"), F.col("n").cast("string")).alias("SPDXID"), F.col("name").alias("name"), F.col("version").alias("versionInfo"),
        F.when(F.col("resolved") != "", F.col("resolved")).otherwise("NOASSERTION").alias("downloadLocation"), F.lit(False).alias("filesAnalyzed"),
        lic.alias("licenseConcluded"), lic.alias("licenseDeclared"), F.lit("NOASSERTION").alias("copyrightText"),
        F.array(F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"), F.lit("purl").alias("referenceType"), F.col("purl").alias("referenceLocator"))).alias("externalRefs"),
        F.when(F.col("description") != "", F.col("description")).alias("description"),
        F.when(F.col("integrity") != "", F.array(F.struct(alg.alias("algorithm"), digest.alias("checksumValue")))).alias("checksums")))


TOOL = ("chainscope", "1.0.0")


def _serial(project: Column, timestamp: str) -> Column:
    """An identifier that the project and the time of the document give."""
    h = F.sha2(F.concat_ws("@", project, F.lit(timestamp)), 256)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]))


def _rows_of_document(comps: DataFrame, edges: DataFrame, head: Column, item: Column, between: str, link: Column, tail: str, keys: list[str]) -> DataFrame:
    """A document as rows (keys, section, n, text) that make JSON one after the
    other: head, components, what is between, links, tail.  ``link`` is a
    component's text from its sorted ``related``; an empty one needs no comma."""
    related = depends_on(comps, edges, keys).groupBy(*keys, "name").agg(F.array_sort(F.collect_list("related")).alias("related"))
    rows = numbered(comps, keys).join(related, [*keys, "name"], "left")
    rows = rows.withColumn("related", F.coalesce("related", F.array().cast("array<string>"))).select(*keys, "n", item.alias("_item"), link.alias("_link"))
    first = rows.groupBy(*keys).agg(F.min(F.when(F.col("_link") != "", F.col("n"))).alias("_first"))
    comma = lambda lead, text: F.concat(F.when(F.col("n") == lead, F.lit("")).otherwise(F.lit(",")), text)
    body = rows.join(first, keys).select(*keys, "n", F.explode(F.array(
        F.struct(F.lit(1).alias("section"), comma(1, F.col("_item")).alias("text")),
        F.struct(F.lit(3).alias("section"), F.when(F.col("_link") != "", comma(F.col("_first"), F.col("_link"))).alias("text")))).alias("_x"))
    frame = comps.select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("n"), F.explode(F.array(
        F.struct(F.lit(0).alias("section"), head.alias("text")), F.struct(F.lit(2).alias("section"), F.lit(between).alias("text")),
        F.struct(F.lit(4).alias("section"), F.lit(tail).alias("text")))).alias("_x"))
    out = [*keys, F.col("_x.section").alias("section"), "n", F.col("_x.text").alias("text")]
    return frame.select(*out).unionByName(body.where(F.col("_x.text").isNotNull()).select(*out))


def _opened(text: Column, field: str) -> Column:
    """A JSON object's text, left open after the first bracket of one more field."""
    return F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit(f',"{field}":['))


def cyclonedx_document(comps: DataFrame, edges: DataFrame, timestamp: str, version: str = "0.0.0", keys=("project_id",)) -> DataFrame:
    """Each project's CycloneDX 1.5 document as rows (project_id, section, n,
    text); the texts in order of section and n are the document, so none ever
    sits in one row or task.  ``stores.write_documents`` writes them so."""
    project = F.col(keys[0])
    head = F.to_json(F.struct(
        F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), _serial(project, timestamp).alias("serialNumber"), F.lit(1).alias("version"),
        F.struct(F.lit(timestamp).alias("timestamp"), F.array(F.struct(F.lit(TOOL[0]).alias("vendor"), F.lit(TOOL[0]).alias("name"), F.lit(TOOL[1]).alias("version"))).alias("tools"),
                 F.struct(F.lit("application").alias("type"), project.alias("name"), F.lit(version).alias("version"),
                          F.concat(F.lit("pkg:npm/"), project, F.lit("@" + version)).alias("bom-ref")).alias("component")).alias("metadata")))
    link = F.to_json(F.struct(F.col("purl").alias("ref"), F.col("related").alias("dependsOn")))
    return _rows_of_document(comps, edges, _opened(head, "components"), cyclonedx_component(), '],"dependencies":[', link, "]}", list(keys))


def spdx_document(comps: DataFrame, edges: DataFrame, timestamp: str, version: str = "0.0.0", keys=("project_id",)) -> DataFrame:
    """Each project's SPDX 2.3 document, in the same form."""
    project = F.col(keys[0])
    head = F.to_json(F.struct(
        F.lit("SPDX-2.3").alias("spdxVersion"), F.lit("CC0-1.0").alias("dataLicense"), F.lit("SPDXRef-DOCUMENT").alias("SPDXID"),
        F.concat(project, F.lit("-" + version)).alias("name"),
        F.concat(F.lit("https://chainscope.example/spdx/"), project, F.lit("/"), _serial(project, timestamp)).alias("documentNamespace"),
        F.struct(F.lit(timestamp).alias("created"), F.array(F.lit(f"Tool: {TOOL[0]}-{TOOL[1]}")).alias("creators"), F.lit("3.22").alias("licenseListVersion")).alias("creationInfo")))
    link = F.array_join(F.transform("related", lambda r: F.to_json(F.struct(
        F.concat(F.lit("SPDXRef-Package-"), F.col("n").cast("string")).alias("spdxElementId"), F.lit("DEPENDS_ON").alias("relationshipType"), r.alias("relatedSpdxElement")))), ",")
    return _rows_of_document(comps, edges, _opened(head, "packages"), spdx_package(), '],"relationships":[', link, "]}", list(keys))


def attestation(bundles: DataFrame, keys=("project_id", "name")) -> DataFrame:
    """Predicate fields of provenance bundles with 'unknown' defaults
    (sha1 digest preferred over sha256); no predicate -> no attestation."""
    keys = list(keys)
    v = F.try_parse_json(F.col("bundle"))

    def s(path):
        return F.try_variant_get(v, path, "string")
    has_pred = F.schema_of_variant(F.variant_get(v, "$.predicate", "variant")).startswith("OBJECT")
    return bundles.where(has_pred).select(
        *keys,
        F.coalesce(s("$.predicateType"), F.lit("https://slsa.dev/provenance/v1")).alias("predicate_type"),
        F.coalesce(s("$.predicate.buildType"), F.lit("unknown")).alias("build_type"),
        F.coalesce(s("$.predicate.builder.id"), F.lit("unknown")).alias("builder"),
        F.coalesce(s("$.predicate.materials[0].uri"), F.lit("unknown")).alias("source_uri"),
        F.coalesce(s("$.predicate.materials[0].digest.sha1"), s("$.predicate.materials[0].digest.sha256"),
                   F.lit("unknown")).alias("source_digest"),
        F.coalesce(s("$.predicate.invocation.configSource.entryPoint"), F.lit("unknown")).alias("invocation_id"),
        F.lit(False).alias("verified"))
