"""License normalisation, classification, detection and compliance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainscope.functions import js
from chainscope.functions.ranking import group_rank
from chainscope.functions.sizing import spread

# FIXED VALUES — license classes
PERMISSIVE = ["MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "0BSD", "Unlicense", "CC0-1.0",
              "WTFPL", "Zlib", "BSL-1.0", "Artistic-2.0", "Python-2.0", "BlueOak-1.0.0"]
COPYLEFT = ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "AGPL-3.0-only",
            "AGPL-3.0-or-later", "GPL-2.0", "GPL-3.0", "AGPL-3.0", "SSPL-1.0", "OSL-3.0"]
WEAK_COPYLEFT = ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MPL-2.0",
                 "EPL-1.0", "EPL-2.0", "CDDL-1.0", "LGPL-2.1", "LGPL-3.0", "CC-BY-SA-4.0"]
PUBLIC_DOMAIN = ["CC0-1.0", "Unlicense", "WTFPL", "0BSD"]

# FIXED VALUES — lower-case spelling -> SPDX id
ALIASES = {
    "mit": "MIT", "isc": "ISC", "bsd-2-clause": "BSD-2-Clause", "bsd-3-clause": "BSD-3-Clause",
    "apache-2.0": "Apache-2.0", "apache 2.0": "Apache-2.0", "apache2": "Apache-2.0",
    "apache license 2.0": "Apache-2.0", "gpl-2.0": "GPL-2.0-only", "gplv2": "GPL-2.0-only",
    "gpl-3.0": "GPL-3.0-only", "gplv3": "GPL-3.0-only", "lgpl-2.1": "LGPL-2.1-only",
    "lgpl-3.0": "LGPL-3.0-only", "mpl-2.0": "MPL-2.0", "mpl 2.0": "MPL-2.0", "unlicense": "Unlicense",
    "cc0-1.0": "CC0-1.0", "public domain": "Unlicense", "0bsd": "0BSD", "artistic-2.0": "Artistic-2.0",
    "bsl-1.0": "BSL-1.0", "wtfpl": "WTFPL", "agpl-3.0": "AGPL-3.0-only",
}

# FIXED VALUES — lower-case spelling -> SPDX id used in bills of materials
SBOM_ALIASES = {
    "mit": "MIT", "isc": "ISC", "bsd-2-clause": "BSD-2-Clause", "bsd-3-clause": "BSD-3-Clause",
    "apache-2.0": "Apache-2.0", "apache 2.0": "Apache-2.0", "gpl-2.0": "GPL-2.0-only", "gpl-3.0": "GPL-3.0-only",
    "lgpl-2.1": "LGPL-2.1-only", "lgpl-3.0": "LGPL-3.0-only", "mpl-2.0": "MPL-2.0", "unlicense": "Unlicense",
    "cc0-1.0": "CC0-1.0", "0bsd": "0BSD", "artistic-2.0": "Artistic-2.0", "bsl-1.0": "BSL-1.0", "wtfpl": "WTFPL",
}

# FIXED VALUES — license-file phrases, first match wins: (id, all of [any of phrases])
TEXT_RULES = [
    ("MIT", [["MIT LICENSE", "PERMISSION IS HEREBY GRANTED"]]),
    ("ISC", [["ISC LICENSE"]]),
    ("Apache-2.0", [["APACHE LICENSE"], ["VERSION 2.0"]]),
    ("BSD-2-Clause", [["BSD 2-CLAUSE"]]),
    ("BSD-3-Clause", [["BSD 3-CLAUSE"]]),
    ("GPL-3.0-only", [["GNU GENERAL PUBLIC LICENSE"], ["VERSION 3"]]),
    ("GPL-2.0-only", [["GNU GENERAL PUBLIC LICENSE"], ["VERSION 2"]]),
    ("LGPL-2.1-only", [["GNU LESSER GENERAL PUBLIC"]]),
    ("MPL-2.0", [["MOZILLA PUBLIC LICENSE"], ["2.0"]]),
    ("Unlicense", [["UNLICENSE", "THIS IS FREE AND UNENCUMBERED"]]),
]

# FIXED VALUES — default license policy
DEFAULT_POLICY = dict(allowed=[], denied=["AGPL-3.0-only", "AGPL-3.0-or-later", "SSPL-1.0"],
                      copyleft_allowed=False, require_license=True, exceptions=[])

def _alias_map() -> Column:
    return F.create_map(*[x for k, v in ALIASES.items() for x in (F.lit(k), F.lit(v))])


def normalize(raw: Column) -> Column:
    """Alias of the trimmed lower-case spelling, else the raw text."""
    return F.coalesce(F.try_element_at(_alias_map(), F.lower(js.js_trim(raw))), raw)


def normalize_sbom(raw: Column) -> Column:
    """R1 (bill-of-materials variant, smaller alias table)."""
    m = F.create_map(*[x for k, v in SBOM_ALIASES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, F.lower(js.js_trim(raw))), raw)


def _simple_class(n: Column) -> Column:
    return (F.when(n.isin(PUBLIC_DOMAIN), "public-domain").when(n.isin(PERMISSIVE), "permissive")
            .when(n.isin(COPYLEFT), "copyleft").when(n.isin(WEAK_COPYLEFT), "weak-copyleft"))


def classify(license: Column) -> Column:
    """R2: class of a license id or of an OR/AND expression."""
    n = normalize(license)
    parts = F.transform(F.split(n, r"\s+(?:OR|AND)\s+", -1),
                        lambda p: F.coalesce(_simple_class(normalize(js.js_trim(F.regexp_replace(p, "[()]", "")))),
                                             F.lit("unknown")))
    expr = (F.when(F.forall(parts, lambda c: c.isin("permissive", "public-domain")), "permissive")
            .when(F.exists(parts, lambda c: c == "copyleft"), "copyleft")
            .when(F.exists(parts, lambda c: c == "weak-copyleft"), "weak-copyleft"))
    compound = F.instr(n, " OR ") > 0
    compound = compound | (F.instr(n, " AND ") > 0)
    return F.coalesce(_simple_class(n), F.when(compound, expr), F.lit("unknown"))


def from_text(text: Column) -> Column:
    """License id from license-file text, first phrase rule wins.

    Callers with large texts should project ``upper(text)`` once and use
    ``from_upper``: inside a CASE every evaluated branch would upper-case
    the text again."""
    return from_upper(F.upper(text))


def from_upper(up: Column) -> Column:
    """P16 on already upper-cased text."""
    out = None
    for spdx, groups in TEXT_RULES:
        cond = None
        for alts in groups:
            g = None
            for a in alts:
                c = F.instr(up, a) > 0
                g = c if g is None else (g | c)
            cond = g if cond is None else (cond & g)
        out = F.when(cond, spdx) if out is None else out.when(cond, spdx)
    return out


def declared(meta: Column) -> Column:
    """R3 (metadata part): license string, ``{type}``, or ``licenses[].type``
    joined by ' OR '; '' when none.  Type dispatch on the VARIANT value."""
    v = F.try_parse_json(meta)
    t = F.schema_of_variant(F.variant_get(v, "$.license", "variant"))
    as_str = F.try_variant_get(v, "$.license", "string")
    obj_type = F.try_variant_get(v, "$.license.type", "string")
    arr = F.try_variant_get(v, "$.licenses", "array<struct<type:string>>")
    joined = F.array_join(F.filter(F.transform(arr, lambda x: x["type"]), lambda x: x.isNotNull() & (x != "")), " OR ")
    return (F.when(t == "STRING", as_str)
            .when(F.coalesce(obj_type, F.lit("")) != "", obj_type)
            .when(arr.isNotNull(), joined)
            .otherwise(F.lit("")))


# FIXED VALUES — license files in the order they are tried
LICENSE_FILES = ["LICENSE", "LICENSE.md", "LICENSE.txt", "LICENCE", "COPYING"]


def from_files(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _file): the license of the first file, in the order of
    LICENSE_FILES, whose text tells one.  Files of other names are not read."""
    order = F.array_position(F.array(*map(F.lit, LICENSE_FILES)), F.col("file"))
    known = (spread(texts, keys).where(F.col("file").isin(LICENSE_FILES)).select(*keys, order.alias("_o"), F.upper(F.col("text")).alias("_up"))
             .select(*keys, "_o", from_upper(F.col("_up")).alias("_l")).where(F.col("_l").isNotNull()))
    return known.groupBy(*keys).agg(F.min_by("_l", "_o").alias("_file"))


def detect(meta: DataFrame, texts: DataFrame | None, keys: list[str]) -> DataFrame:
    """License, SPDX id, class and source of each package; version 0.0.0
    where the metadata tells none."""
    d = meta.withColumns({"_decl": F.coalesce(declared(F.col("meta")), F.lit("")),
                          "version": F.coalesce(F.try_variant_get(F.try_parse_json("meta"), "$.version", "string"), F.lit("0.0.0"))})
    if texts is not None:
        d = d.join(from_files(texts, keys), keys, "left")
    else:
        d = d.withColumn("_file", F.lit(None).cast("string"))
    lic = (F.when(F.col("_decl") != "", F.col("_decl")).when(F.col("_file").isNotNull(), F.col("_file"))
           .otherwise(F.lit("UNKNOWN")))
    src = (F.when(F.col("_decl") != "", "package.json").when(F.col("_file").isNotNull(), "LICENSE")
           .otherwise("inferred"))
    return (d.withColumn("license", normalize(lic)).withColumn("source", src)
            .withColumn("category", classify(F.col("license"))).drop("_decl", "_file"))


def detect_direct(direct: DataFrame, meta: DataFrame, texts: DataFrame | None, keys: list[str]) -> DataFrame:
    """The same for a project's direct dependencies (one row a name, see
    ``sbom.direct_dependencies``), also those without metadata."""
    return detect(direct.select(*keys).join(meta.select(*keys, "meta"), keys, "left"), texts, keys)


def listed(lic: DataFrame, project_col: str = "project_id") -> DataFrame:
    """A project's packages numbered by name, the order of the license report."""
    return group_rank(lic, [project_col], [F.col("name")], lead=[(F.substring("name", 1, 8), False)])


def violations(lic: DataFrame, policy: dict | None = None) -> DataFrame:
    """First matching rule per package: exception, denied, not allowed,
    copyleft, missing/unknown."""
    p = {**DEFAULT_POLICY, **(policy or {})}
    spdx, cat = F.col("license"), F.col("category")
    rules = []
    if p["denied"]:
        rules.append((spdx.isin(p["denied"]), "denied-license", "critical",
                      F.concat(F.lit('License "'), spdx, F.lit('" is on the denied list'))))
    if p["allowed"]:
        rules.append((~spdx.isin(p["allowed"]) & (cat != "unknown"), "denied-license", "high",
                      F.concat(F.lit('License "'), spdx, F.lit('" is not on the allowed list'))))
    if not p["copyleft_allowed"]:
        rules.append((cat == "copyleft", "copyleft-in-proprietary", "critical",
                      F.concat(F.lit('Copyleft license "'), spdx, F.lit('" not allowed in proprietary projects'))))
    if p["require_license"]:
        unknown = spdx == "UNKNOWN"
        rules.append(((spdx == "UNKNOWN") | (cat == "unknown"),
                      F.when(unknown, "no-license").otherwise("unknown-license"), "medium",
                      F.when(unknown, F.lit("Package has no declared license")).otherwise(
                          F.concat(F.lit('License "'), spdx, F.lit('" is not a recognized SPDX identifier')))))
    typ = sev = msg = None
    for cond, t, s, m in rules:
        t = F.lit(t) if isinstance(t, str) else t
        typ = F.when(cond, t) if typ is None else typ.when(cond, t)
        sev = F.when(cond, F.lit(s)) if sev is None else sev.when(cond, F.lit(s))
        msg = F.when(cond, m) if msg is None else msg.when(cond, m)
    out = lic
    if p["exceptions"]:
        out = out.where(~F.col("name").isin(p["exceptions"]))
    return (out.withColumn("violation_type", typ).withColumn("severity", sev).withColumn("message", msg)
            .where(F.col("violation_type").isNotNull()))


def summary(lic: DataFrame, viol: DataFrame, project_col: str = "project_id") -> DataFrame:
    """Per project license class counts and violations."""
    def n_if(c):
        return F.count(F.when(F.col("category") == c, 1)).cast("bigint")
    s = lic.groupBy(project_col).agg(
        F.count("*").cast("bigint").alias("total"), n_if("permissive").alias("permissive"),
        n_if("copyleft").alias("copyleft"), n_if("weak-copyleft").alias("weak_copyleft"),
        n_if("public-domain").alias("public_domain"), n_if("proprietary").alias("proprietary"),
        n_if("unknown").alias("unknown"))
    v = viol.groupBy(project_col).agg(F.count("*").cast("bigint").alias("violations"))
    return s.join(v, project_col, "left").fillna(0, ["violations"])
