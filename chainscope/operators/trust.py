"""Maintainer and provenance risk from package metadata.

Metadata is the package.json text; fields are read through VARIANT
(``try_parse_json``), dispatching on the JSON type where the field is
polymorphic (author string or object, repository string or object,
maintainers of strings or objects).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainscope.functions import js

# FIXED VALUES — free mail domains
FREEMAIL = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "protonmail.com"]
GITHUB_REPO = r"github\.com[/:]([^/]+)/([^/]+)"


def _v(meta: Column) -> Column:
    return F.try_parse_json(meta)


def jtype(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.variant_get(v, path, "variant"))


def truthy(v: Column, path: str) -> Column:
    """JavaScript truthiness of a JSON field (missing/null/''/false/0 are falsy)."""
    t = jtype(v, path)
    return (F.when(t.isNull() | (t == "VOID"), False)
            .when(t == "STRING", F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")) != "")
            .when(t == "BOOLEAN", F.coalesce(F.try_variant_get(v, path, "boolean"), F.lit(False)))
            .when(t.isin("BIGINT", "DOUBLE", "DECIMAL") | t.startswith("DECIMAL"),
                  F.coalesce(F.try_variant_get(v, path, "double"), F.lit(0.0)) != 0)
            .otherwise(True))


def maintainers(meta: Column) -> Column:
    """array<struct<name,email>> from maintainers[] plus the author
    (string 'Name <mail>' or object), author added when its name is new."""
    v = _v(meta)
    items = F.coalesce(F.try_variant_get(v, "$.maintainers", "array<variant>"), F.array().cast("array<variant>"))
    listed = F.filter(F.transform(items, lambda x: F.when(
        F.schema_of_variant(x) == "STRING",
        F.struct(F.try_variant_get(x, "$", "string").alias("name"), F.lit("").alias("email"))).when(
        F.schema_of_variant(x).startswith("OBJECT"),
        F.struct(F.coalesce(F.try_variant_get(x, "$.name", "string"), F.lit("")).alias("name"),
                 F.coalesce(F.try_variant_get(x, "$.email", "string"), F.lit("")).alias("email")))),
        lambda x: x.isNotNull())
    at = jtype(v, "$.author")
    a_str = F.try_variant_get(v, "$.author", "string")
    a_match = F.regexp_extract(a_str, r"^([^<(]+)", 1)
    a_name_s = js.js_trim(a_match)
    a_name_o = F.try_variant_get(v, "$.author.name", "string")
    a_mail_o = F.coalesce(F.try_variant_get(v, "$.author.email", "string"), F.lit(""))
    author = (F.when((at == "STRING") & (a_match != ""), F.struct(a_name_s.alias("name"), F.lit("").alias("email")))
              .when(at.startswith("OBJECT") & (F.coalesce(a_name_o, F.lit("")) != ""),
                    F.struct(a_name_o.alias("name"), a_mail_o.alias("email"))))
    new_author = author.isNotNull() & ~F.exists(listed, lambda m: m["name"] == author["name"])
    return F.when(new_author, F.concat(listed, F.array(author))).otherwise(listed)


# FIXED VALUES — maintainer risk factors: (factor, score)
FACTORS = [("single-maintainer", 2.0), ("no-maintainers", 3.0), ("no-repository", 2.0),
           ("freemail-single-maintainer", 1.0), ("minimal-metadata", 1.0), ("deprecated", 3.0),
           ("non-standard-registry", 2.0), ("no-license", 2.0), ("long-name", 1.0), ("no-keywords", 0.5)]


def maintainer_risk(meta_df: DataFrame, name_col: str = "name") -> DataFrame:
    """Factors, score (capped at 10), level and recommendations.  Metadata
    that cannot be read is a risk of its own: 5, high."""
    v = _v(F.col("meta"))
    unreadable = v.isNull() | (F.schema_of_variant(v) == "VOID")
    d = meta_df.withColumn("_m", maintainers(F.col("meta")))
    n = F.size("_m")
    freemail = F.exists("_m", lambda m: F.exists(F.array(*[F.lit("@" + x) for x in FREEMAIL]),
                                                  lambda d_: m["email"].endswith(d_)))
    resolved = F.try_variant_get(v, "$._resolved", "string")
    kw_t = jtype(v, "$.keywords")
    kw_empty = (kw_t.startswith("ARRAY") & (F.size(F.try_variant_get(v, "$.keywords", "array<variant>")) == 0))
    flags = {
        "single-maintainer": n <= 1,
        "no-maintainers": n == 0,
        "no-repository": ~truthy(v, "$.repository"),
        "freemail-single-maintainer": freemail & (n <= 1),
        "minimal-metadata": ~truthy(v, "$.homepage") & ~truthy(v, "$.description"),
        "deprecated": truthy(v, "$.deprecated"),
        "non-standard-registry": F.coalesce(resolved, F.lit("")).__ne__("") & ~F.coalesce(
            resolved, F.lit("")).contains("registry.npmjs.org"),
        "no-license": ~truthy(v, "$.license"),
        "long-name": F.length(F.col(name_col)) > 40,
        "no-keywords": ~truthy(v, "$.keywords") | kw_empty,
    }
    for f, _ in FACTORS:
        d = d.withColumn("_f_" + f, F.coalesce(flags[f], F.lit(False)))
    total = sum((F.when(F.col("_f_" + f), F.lit(s)).otherwise(F.lit(0.0)) for f, s in FACTORS), F.lit(0.0))
    score = F.least(F.lit(10.0), total)
    level = (F.when(F.col("risk_score") >= 7, "critical").when(F.col("risk_score") >= 4, "high")
             .when(F.col("risk_score") >= 2, "medium").otherwise("low"))
    factors = F.concat_ws(",", *[F.when(F.col("_f_" + f), F.lit(f)) for f, _ in FACTORS])
    recs = F.concat_ws("; ",
                       F.when(n <= 1, F.lit("Consider alternatives with multiple maintainers")),
                       F.when(F.col("_f_no-repository"), F.lit("Verify package source manually")),
                       F.when(F.col("_f_deprecated"), F.lit("Replace with maintained alternative")),
                       F.when(F.col("risk_score") >= 4, F.lit("Pin exact version and monitor for changes")))
    plain = {"version": F.lit("0.0.0"), "maintainer_count": F.lit(0), "risk_score": F.lit(5.0), "risk_level": F.lit("high"),
             "factors": F.lit("unreadable"), "recommendations": F.lit("Verify package is properly installed")}
    out = (d.withColumn("maintainer_count", n).withColumn("risk_score", score)
           .withColumn("risk_level", level).withColumn("factors", factors).withColumn("recommendations", recs)
           .withColumn("_unread", F.coalesce(unreadable, F.lit(True))))
    out = out.withColumns({c: F.when(F.col("_unread"), x).otherwise(F.col(c)) for c, x in plain.items() if c in out.columns})
    return out.drop("_unread", *["_f_" + f for f, _ in FACTORS])


def maintainer_summary(risk: DataFrame, project_col: str = "project_id") -> DataFrame:
    """Level counts, mean score, single-maintainer packages."""
    def n_if(c):
        return F.count(F.when(F.col("risk_level") == c, 1)).cast("bigint")
    return risk.groupBy(project_col).agg(
        F.count("*").cast("bigint").alias("total"), n_if("low").alias("low"), n_if("medium").alias("medium"),
        n_if("high").alias("high"), n_if("critical").alias("critical"),
        js.round1(F.sum(F.col("risk_score").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("average_score"),
        F.count(F.when(F.col("maintainer_count") <= 1, 1)).cast("bigint").alias("single_maintainer"))


def provenance(meta_df: DataFrame, lock: DataFrame, attestations: DataFrame, name_col: str = "name", keys=("project_id", "name")) -> DataFrame:
    """Source repository, integrity, attestation and risk factors of each
    package.

    ``lock`` are parsed lock entries, whose integrity counts whatever the metadata
    says; ``attestations`` come from ``sbom.attestation``.  Status: verified or
    unverified with an attestation, unverified with an integrity hash alone,
    else missing.
    """
    keys = list(keys)
    v = _v(F.col("meta"))
    locked = lock.groupBy(*keys).agg(F.max("integrity").alias("integrity"))
    proof = attestations.groupBy(*keys).agg(F.max("verified").alias("_verified"), F.max("build_type").alias("build_workflow"), F.max("invocation_id").alias("build_trigger"))
    meta_df = meta_df.drop("integrity").join(locked, keys, "left").join(proof, keys, "left")
    meta_df = meta_df.withColumn("version", F.coalesce(F.try_variant_get(v, "$.version", "string"), F.lit("0.0.0")))
    rt = jtype(v, "$.repository")
    url = F.try_variant_get(v, "$.repository.url", "string")
    repo = (F.when(rt == "STRING", F.try_variant_get(v, "$.repository", "string"))
            .when(F.coalesce(url, F.lit("")) != "",
                  F.regexp_replace(F.regexp_replace(url, "^git\\+", ""), "\\.git$", "")))
    d = meta_df.withColumn("source_repo", repo)
    has_repo = F.coalesce(F.col("source_repo"), F.lit("")) != ""
    has_int = F.coalesce(F.col("integrity"), F.lit("")) != ""
    gh_repo = F.regexp_extract(F.col("source_repo"), GITHUB_REPO, 2)
    base = F.regexp_replace(F.col(name_col), "^@[^/]+/", "")
    mismatch = (has_repo & F.col("source_repo").contains("github.com") & F.col("source_repo").rlike(GITHUB_REPO)
                & ~F.lower(gh_repo).contains(F.lower(base)) & ~base.contains(F.lower(gh_repo)))
    factors = F.filter(F.array(
        F.when(~F.col("_verified"), F.lit("Attestation present but not verified")),
        F.when(~has_repo, F.lit("No source repository declared")),
        F.when(~has_int, F.lit("No integrity hash in lockfile")),
        F.when(mismatch, F.concat(F.lit('Package name "'), F.col(name_col), F.lit('" doesn\'t match repo "'),
                                  gh_repo, F.lit('"')))), lambda x: x.isNotNull())
    status = F.when(F.col("_verified"), "verified").when(F.col("_verified").isNotNull() | has_int, "unverified").otherwise("missing")
    return (d.withColumn("status", status)
            .withColumn("integrity_algorithm", F.when(has_int, F.split(F.col("integrity"), "-").getItem(0)))
            .withColumn("risk_factors", F.array_join(factors, "; "))
            .withColumn("risk_factor_count", F.size(factors)).withColumn("attested", F.col("_verified").isNotNull()).drop("_verified"))


def provenance_summary(prov: DataFrame, project_col: str = "project_id") -> DataFrame:
    """Status counts, attested packages and coverage (verified share, %)."""
    def n_if(c):
        return F.count(F.when(F.col("status") == c, 1)).cast("bigint")
    return (prov.groupBy(project_col).agg(F.count("*").cast("bigint").alias("total"), n_if("verified").alias("verified"),
                                          n_if("unverified").alias("unverified"), n_if("missing").alias("missing"),
                                          n_if("invalid").alias("invalid"), F.count(F.when(F.col("attested"), 1)).cast("bigint").alias("attested"))
            .withColumn("coverage", js.js_round(F.col("verified") / F.col("total") * 100.0)))
