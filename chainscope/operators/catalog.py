"""Rule-catalogue reports (S18, A6-A9, F11, J16): coverage per category,
CWE matrix, coverage score, gaps -- each joinable to scan findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainscope.catalog.scan_rules import CRITICAL_CWES, CWE_NAMES, OWASP_NAMES, SCAN_RULES

# FIXED VALUES — coverage level points and thresholds
LEVEL_POINTS = {"comprehensive": 100, "good": 75, "basic": 50, "minimal": 25, "none": 0}


def rules_table(spark: SparkSession) -> DataFrame:
    rows = [(i, r[0], r[1], r[2], r[3], r[4]) for i, r in enumerate(SCAN_RULES)]
    return spark.createDataFrame(rows, "rule_idx int, rule_id string, owasp string, cwe int, severity string, "
                                       "confidence string")


def categories_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(OWASP_NAMES.items())],
                                 "cat_idx int, owasp string, name string")


def cwe_names_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CWE_NAMES.items()), "cwe int, cwe_name string")


def level(n):
    return (F.when(n >= 8, "comprehensive").when(n >= 5, "good").when(n >= 3, "basic")
            .when(n >= 1, "minimal").otherwise("none"))


def coverage(spark: SparkSession) -> DataFrame:
    """Rules, distinct CWEs, severity histogram and level per category
    (categories without rules kept by the right join)."""
    r = rules_table(spark)
    agg = r.groupBy("owasp").agg(
        F.count("*").cast("bigint").alias("rule_count"), F.countDistinct("cwe").cast("bigint").alias("cwe_count"),
        *[F.count(F.when(F.col("severity") == s, 1)).cast("bigint").alias(s) for s in ["critical", "high", "medium", "low"]])
    out = categories_table(spark).join(agg, "owasp", "left").fillna(0, ["rule_count", "cwe_count", "critical", "high",
                                                                        "medium", "low"])
    return out.withColumn("coverage_level", level(F.col("rule_count")))


def cwe_matrix(spark: SparkSession) -> DataFrame:
    """A7+J16: rules and categories per CWE, with the CWE name."""
    r = rules_table(spark)
    m = r.groupBy("cwe").agg(F.count("*").cast("bigint").alias("rule_count"),
                             F.array_join(F.array_sort(F.collect_set("owasp")), ",").alias("categories"))
    return (m.join(F.broadcast(cwe_names_table(spark)), "cwe", "left")
            .withColumn("name", F.coalesce("cwe_name", F.concat(F.lit("CWE-"), F.col("cwe").cast("string"))))
            .drop("cwe_name"))


def coverage_score(cov: DataFrame) -> DataFrame:
    """Mean level points over the ten categories (EXTRA excluded)."""
    pts = F.create_map(*[x for k, v in LEVEL_POINTS.items() for x in (F.lit(k), F.lit(v))])
    s = (cov.where(F.col("owasp") != "EXTRA")
         .agg(F.floor(F.avg(pts[F.col("coverage_level")]) + 0.5).cast("bigint").alias("overall_score")))
    return s.withColumn("overall_level", F.when(F.col("overall_score") >= 80, "Strong")
                        .when(F.col("overall_score") >= 60, "Moderate")
                        .when(F.col("overall_score") >= 40, "Basic").otherwise("Weak"))


def with_score(cov: DataFrame) -> DataFrame:
    """Coverage rows with the catalogue score as a column (window over the
    fixed 11-row category table)."""
    pts = F.create_map(*[x for k, v in LEVEL_POINTS.items() for x in (F.lit(k), F.lit(v))])
    avg = F.avg(F.when(F.col("owasp") != "EXTRA", pts[F.col("coverage_level")])).over(Window.partitionBy())
    return cov.withColumn("overall_score", F.floor(avg + 0.5).cast("bigint"))


def gaps(spark: SparkSession, cov: DataFrame) -> DataFrame:
    """gap sentences per category, then uncovered critical CWEs."""
    c = cov.where(F.col("owasp") != "EXTRA")
    head = F.concat(F.col("owasp"), F.lit(" "), F.col("name"), F.lit(": "))
    level_gap = (F.when(F.col("coverage_level") == "none", F.concat(head, F.lit("No rules defined")))
                 .when(F.col("coverage_level") == "minimal",
                       F.concat(head, F.lit("Only "), F.col("rule_count").cast("string"),
                                F.lit(" rule(s) — minimal coverage"))))
    cwe_gap = F.when((F.col("cwe_count") < 2) & (F.col("rule_count") > 0),
                     F.concat(head, F.lit("Only "), F.col("cwe_count").cast("string"),
                              F.lit(" unique CWE(s) covered")))
    g = c.select("owasp", F.explode(F.filter(F.array(level_gap, cwe_gap), lambda x: x.isNotNull())).alias("gap"))
    covered = rules_table(spark).select("cwe").distinct()
    crit = spark.createDataFrame([(c_,) for c_ in CRITICAL_CWES], "cwe int")
    missing = (crit.join(covered, "cwe", "left_anti").join(F.broadcast(cwe_names_table(spark)), "cwe", "left")
               .select(F.lit(None).cast("string").alias("owasp"),
                       F.concat(F.lit("CWE-"), F.col("cwe").cast("string"), F.lit(" ("),
                                F.coalesce("cwe_name", F.lit("Unknown")), F.lit("): Not covered by any rule")).alias("gap")))
    return g.unionByName(missing)
