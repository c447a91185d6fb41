"""Remediation suggestions.

Suggestions are four kinds of rows unioned: replace (package has a known
alternative, broadcast lookup), one per finding category with an action
(equi-join to the 8-row action table), remove (very high score without an
alternative) and monitor (score >= 2).  ``seq`` keeps the order the
suggestions are produced in, so a stable priority sort is a plain
``order by (priority rank, seq)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainscope.functions import js
from chainscope.functions.ranking import top_k_per_group
from chainscope.operators.scan import severity_rank

# FIXED VALUES — known alternatives: package -> [(name, reason, migration complexity)] in order
ALTERNATIVES = {
    "request": [("node-fetch", "request is deprecated", "minor-changes"),
                ("axios", "Active maintenance, wide adoption", "minor-changes"),
                ("got", "Modern API, TypeScript support", "minor-changes")],
    "moment": [("dayjs", "moment is in maintenance mode, dayjs is API-compatible", "drop-in"),
               ("date-fns", "Tree-shakeable, immutable", "minor-changes"),
               ("luxon", "Modern successor to moment", "significant-refactor")],
    "underscore": [("lodash", "Superset of underscore, better performance", "drop-in")],
    "colors": [("chalk", "colors had a supply chain incident", "minor-changes"),
               ("picocolors", "Zero dependencies, fast", "minor-changes")],
    "event-stream": [("highland", "event-stream was compromised", "significant-refactor")],
    "node-uuid": [("uuid", "node-uuid is deprecated, renamed to uuid", "drop-in")],
    "querystring": [("qs", "Built-in querystring is legacy", "minor-changes"),
                    ("URLSearchParams", "No dependency needed", "minor-changes")],
    "rimraf": [("fs.rm", "Available since Node 14.14", "minor-changes")],
    "mkdirp": [("fs.mkdir", "Available since Node 10.12", "drop-in")],
    "glob": [("fast-glob", "Better performance, maintained", "minor-changes"),
             ("tinyglobby", "Minimal footprint", "minor-changes")],
}

# FIXED VALUES — category actions: category -> (title, description, action, type)
CATEGORY_ACTIONS = {
    "code-execution": ("Restrict dynamic code execution",
                       "Package uses eval(), Function(), or vm module which can execute arbitrary code",
                       "Add to permission manifest with exec:false. Review code for legitimate use cases.", "configure"),
    "network": ("Restrict network access", "Package makes network requests that could exfiltrate data",
                "Define allowed network destinations in the permission manifest.", "configure"),
    "filesystem": ("Restrict filesystem access", "Package accesses the filesystem, potentially reading sensitive files",
                   "Define allowed filesystem paths in permission manifest.", "configure"),
    "environment": ("Restrict environment access",
                    "Package reads environment variables, possibly harvesting credentials",
                    "Specify allowed env vars in permission manifest. Audit which vars are actually needed.",
                    "configure"),
    "process": ("Restrict process spawning", "Package can spawn child processes to execute system commands",
                "Set exec:false in permission manifest unless process spawning is required.", "configure"),
    "obfuscation": ("Investigate obfuscated code",
                    "Package contains obfuscated code patterns that may hide malicious behavior",
                    "Manually review the obfuscated code. Consider using an alternative package.", "monitor"),
    "prototype-pollution": ("Mitigate prototype pollution",
                            "Package contains patterns that could enable prototype pollution attacks",
                            "Use Object.freeze() on prototypes, or replace with a safer alternative.", "configure"),
    "install-script": ("Sandbox install scripts",
                       "Package has install scripts that run before you can review the code",
                       "Run install scripts in a sandbox before trusting them.", "configure"),
}

PRIORITY = {"critical": 0, "high": 1, "medium": 2, "low": 3}
EFFORT_HOURS = {"trivial": 0.25, "low": 1.0, "medium": 4.0, "high": 8.0}


def alternatives_frame(spark: SparkSession) -> DataFrame:
    rows = [(pkg, i, n, r, c) for pkg, alts in ALTERNATIVES.items() for i, (n, r, c) in enumerate(alts)]
    return spark.createDataFrame(rows, "package string, alt_idx int, alt string, reason string, complexity string")


def actions_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in CATEGORY_ACTIONS.items()],
                                 "category string, title string, description string, action string, type string")


OUT = ["project_id", "package", "version", "seq", "type", "priority", "title", "description", "action", "effort"]


def suggestions(risk: DataFrame, findings: DataFrame, spark: SparkSession,
                keys=("project_id", "package", "version")) -> DataFrame:
    """Every suggestion of every package."""
    keys = list(keys)
    alt = alternatives_frame(spark)
    first = F.broadcast(alt.where(F.col("alt_idx") == 0))
    score = F.col("score")
    rep = risk.select(*keys, "score").join(first, "package", "left")
    replace = rep.where(F.col("alt").isNotNull()).select(
        *keys, F.lit(0).cast("bigint").alias("seq"), F.lit("replace").alias("type"),
        F.when(score >= 7, "critical").otherwise("high").alias("priority"),
        F.concat(F.lit("Replace "), F.col("package"), F.lit(" with "), F.col("alt")).alias("title"),
        F.col("reason").alias("description"),
        F.concat(F.lit("npm uninstall "), F.col("package"), F.lit(" && npm install "), F.col("alt")).alias("action"),
        F.when(F.col("complexity") == "drop-in", "trivial").when(F.col("complexity") == "minor-changes", "low")
        .otherwise("medium").alias("effort"))
    order_key = F.struct(severity_rank().alias("s"), F.col("file").alias("f"), F.col("line").alias("l"),
                         F.col("rule_idx").alias("r"), F.col("col").alias("c"))
    cats = findings.groupBy(*keys, "category").agg(
        F.count("*").cast("bigint").alias("n"), F.min(order_key).alias("_first"),
        F.max(F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "high", 1).otherwise(0)).alias("_sev"))
    cats = cats.join(F.broadcast(actions_frame(spark)), "category")
    cat_seq = F.dense_rank().over(Window.partitionBy(*keys).orderBy("_first"))
    per_cat = cats.select(
        *keys, cat_seq.cast("bigint").alias("seq"), "type",
        F.when(F.col("_sev") == 2, "critical").when(F.col("_sev") == 1, "high").otherwise("medium").alias("priority"),
        "title",
        F.concat(F.col("description"), F.lit(" ("), F.col("n").cast("string"), F.lit(" finding"),
                 F.when(F.col("n") != 1, "s").otherwise(""), F.lit(")")).alias("description"),
        "action", F.lit("low").alias("effort"))
    remove = rep.where((score >= 8) & F.col("alt").isNull()).select(
        *keys, F.lit(1000).cast("bigint").alias("seq"), F.lit("remove").alias("type"), F.lit("critical").alias("priority"),
        F.concat(F.lit("Consider removing "), F.col("package")).alias("title"),
        F.concat(F.lit("Risk score "), js.js_num(score), F.lit("/10 is dangerously high with no known safe alternatives"))
        .alias("description"),
        F.concat(F.lit("npm uninstall "), F.col("package"),
                 F.lit(". Find a replacement or implement the functionality directly.")).alias("action"),
        F.lit("high").alias("effort"))
    monitor = rep.where(score >= 2).select(
        *keys, F.lit(1001).cast("bigint").alias("seq"), F.lit("monitor").alias("type"), F.lit("low").alias("priority"),
        F.concat(F.lit("Pin and monitor "), F.col("package")).alias("title"),
        F.lit("Pin exact version and monitor for behavioral changes").alias("description"),
        F.concat(F.lit('Use exact version in package.json: "'), F.col("package"), F.lit('": "'), F.col("version"),
                 F.lit('"')).alias("action"),
        F.lit("trivial").alias("effort"))
    return replace.unionByName(per_cat).unionByName(remove).unionByName(monitor)


def priority_rank(c: Column | str = "priority") -> Column:
    return js.rank_of(F.col(c) if isinstance(c, str) else c, PRIORITY)


def top_suggestions(sugg: DataFrame, k: int = 3, keys=("project_id", "package", "version")) -> DataFrame:
    """T5: first k suggestions per package by priority, then production order."""
    return top_k_per_group(sugg, list(keys), [priority_rank(), F.col("seq")], k)


def remediation_summary(risk: DataFrame, sugg: DataFrame, project_col: str = "project_id",
                        keys=("project_id", "package", "version")) -> DataFrame:
    """Packages with score >= 1 only; counts by priority, effort."""
    keep = risk.where(F.col("score") >= 1).select(*keys)
    s = sugg.join(keep, list(keys))
    hours = js.rank_of(F.col("effort"), {k: v for k, v in EFFORT_HOURS.items()})

    def n_if(p):
        return F.count(F.when(F.col("priority") == p, 1)).cast("bigint")
    out = s.groupBy(project_col).agg(F.count("*").cast("bigint").alias("total"),
                                     *[n_if(p).alias(p) for p in PRIORITY],
                                     F.sum(hours).alias("effort_hours"),
                                     F.countDistinct(*keys).cast("bigint").alias("packages"))
    h = F.col("effort_hours")
    label = (F.when(h < 1, F.lit("<1 hour"))
             .when(h < 8, F.concat(F.lit("~"), js.js_round(h).cast("string"), F.lit(" hours")))
             .otherwise(F.concat(F.lit("~"), js.js_round(h / 8).cast("string"), F.lit(" days"))))
    return out.withColumn("estimated_effort", label)
