"""Package risk from behaviour findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainscope.catalog.reference import KNOWN_SAFE
from chainscope.functions import js
from chainscope.functions.ranking import group_rank

PKG = ["project_id", "package", "version"]


def risk_label(score: Column) -> Column:
    """DANGEROUS >= 7, SUSPICIOUS >= 4, CAUTION >= 2, else LOW RISK."""
    return (F.when(score >= 7, "DANGEROUS").when(score >= 4, "SUSPICIOUS")
            .when(score >= 2, "CAUTION").otherwise("LOW RISK"))


def package_score(raw: Column, n: Column) -> Column:
    """A4: round1(10 * (1 - e^(-raw/8))), 0 without findings."""
    return F.when(n == 0, F.lit(0.0)).otherwise(js.round1(F.lit(10.0) * (F.lit(1.0) - F.exp(-raw / F.lit(8.0)))))


def package_risk(findings: DataFrame, files: DataFrame, keys: list[str] = PKG) -> DataFrame:
    """One row per package: score, counts, summary, files scanned.

    The raw score is rebuilt from integer counts (3c + 2h + m + 0.3l), so it
    does not depend on the order a floating-point sum visits rows.
    """
    def n_if(s):
        return F.count(F.when(F.col("severity") == s, 1)).cast("bigint")
    agg = findings.groupBy(*keys).agg(
        F.count("*").cast("bigint").alias("findings"),
        n_if("critical").alias("critical"), n_if("high").alias("high"),
        n_if("medium").alias("medium"), n_if("low").alias("low"))
    scanned = files.groupBy(*keys).agg(F.count("*").cast("bigint").alias("files_scanned"))
    out = scanned.join(agg, keys, "left").fillna(0, ["findings", "critical", "high", "medium", "low"])
    raw = F.col("critical") * 3.0 + F.col("high") * 2.0 + F.col("medium") * 1.0 + F.col("low") * 0.3
    out = out.withColumn("score", package_score(raw, F.col("findings")))
    parts = F.concat_ws(", ", *[F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(" " + s)))
                                for s in ["critical", "high", "medium", "low"]])
    summary = F.when(F.col("findings") == 0, F.lit("No suspicious patterns found.")).otherwise(
        F.concat(F.lit("Risk: "), risk_label(F.col("score")), F.lit(" ("), js.js_num(F.col("score")),
                 F.lit("/10) — "), F.col("findings").cast("string"), F.lit(" findings: "), parts))
    return out.withColumn("summary", summary)


def category_counts(findings: DataFrame, keys: list[str] = PKG) -> DataFrame:
    """A5: findings per package and category."""
    return findings.groupBy(*keys, "category").agg(F.count("*").cast("bigint").alias("count"))


def risk_bands(risk: DataFrame) -> DataFrame:
    """Label and band of every package score."""
    s = F.col("score")
    band = F.when(s >= 7, "high").when(s >= 4, "medium").otherwise("low")
    return risk.withColumn("label", risk_label(s)).withColumn("band", band).withColumn("attention", s >= 4)


def risk_ranking(risk: DataFrame, project_col: str = "project_id") -> DataFrame:
    """T4: packages by descending score per project (name, version break ties)."""
    return group_rank(risk, [project_col], [F.col("score").desc(), F.col("package"), F.col("version")],
                      lead=[(F.col("score"), True), (F.substring("package", 1, 12), False)])


def known_safe_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(n, float(m), c) for n, m, c in KNOWN_SAFE],
        "name string, max_allowed_score double, suppress_categories array<string>")


def apply_known_safe(risk: DataFrame, cat_counts: DataFrame, known: DataFrame, keys: list[str] = PKG) -> DataFrame:
    """Adjusted score after the known-safe list.

    Unknown package -> unchanged; no finding outside the suppressed
    categories -> 0; score <= allowed maximum -> 0; otherwise unchanged.
    Whether the known-safe table is broadcast is left to Spark.
    """
    k = known.withColumnRenamed("name", "package")
    per_cat = cat_counts.join(k.select("package", "suppress_categories"), "package", "inner")
    unsuppressed = (per_cat.where(~F.array_contains("suppress_categories", F.col("category")))
                    .groupBy(*keys).agg(F.sum("count").cast("bigint").alias("_unsuppressed")))
    out = (risk.join(k, "package", "left").join(unsuppressed, keys, "left")
           .withColumn("known_safe", F.col("max_allowed_score").isNotNull()))
    suppressed = F.col("known_safe") & (F.coalesce(F.col("_unsuppressed"), F.lit(0)) == 0) | (
        F.col("known_safe") & (F.col("score") <= F.col("max_allowed_score")))
    return (out.withColumn("suppressed", F.coalesce(suppressed, F.lit(False)))
            .withColumn("adjusted_score", F.when(F.col("suppressed"), F.lit(0.0)).otherwise(F.col("score")))
            .drop("_unsuppressed", "suppress_categories"))


def audit_summary(adjusted: DataFrame, declared: DataFrame, project_col: str = "project_id") -> DataFrame:
    """Per project, over its ``declared`` packages (rows of project, package,
    version): how many, the mean adjusted score (those not scanned count 0), the
    highest package (ties: name; none if all scores are 0), packages needing
    attention (>= 4) and high risk (>= 7)."""
    top = F.min(F.struct((-F.col("adjusted_score")).alias("s"), F.col("package").alias("p")))
    n = declared.groupBy(project_col).agg(F.count("*").cast("bigint").alias("packages"))
    scored = adjusted.groupBy(project_col).agg(
        F.count("*").cast("bigint").alias("scanned"), F.sum(F.col("adjusted_score").cast("decimal(18,6)")).alias("_sum"),
        F.max("adjusted_score").alias("max_score"), top.alias("_top"),
        F.count(F.when(F.col("adjusted_score") >= 4, 1)).cast("bigint").alias("attention"),
        F.count(F.when(F.col("adjusted_score") >= 7, 1)).cast("bigint").alias("high_risk"))
    out = n.join(scored, project_col, "left").fillna(0, ["scanned", "max_score", "attention", "high_risk"])
    return (out.withColumn("mean_score", js.round1(F.coalesce(F.col("_sum"), F.lit(0)).cast("double") / F.col("packages")))
            .withColumn("max_package", F.when(F.col("max_score") > 0, F.col("_top.p")).otherwise("")).drop("_top", "_sum"))
