"""Declarative governance as tables.

Policies are tables: packages' context fields are unpivoted to typed values and
joined with the rules on the field.  Lists, permissions and facts are
DataFrames joined on keys.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainscope.functions import js
from chainscope.functions.ranking import top_k_per_group
from chainscope.functions.regex import ASCII_BOUNDARY

# ---------------------------------------------------------------- policy

# FIXED VALUES — default package policy (id, name, description, field, operator, value, action, severity, enabled)
DEFAULT_POLICY = [
    ("max-risk-score", "Maximum Risk Score", "Block packages with risk score above threshold",
     "riskScore", "lte", 7, "block", "critical", True),
    ("no-install-scripts", "No Install Scripts", "Warn on packages with preinstall/postinstall scripts",
     "hasInstallScripts", "eq", False, "warn", "medium", True),
    ("no-critical-findings", "No Critical Findings", "Block packages with critical security findings",
     "criticalFindings", "eq", 0, "block", "critical", True),
    ("known-license", "Known License Required", "Warn on packages without a recognized license",
     "license", "neq", "UNKNOWN", "warn", "medium", True),
    ("no-copyleft", "No Copyleft Licenses", "Warn on packages with copyleft licenses",
     "license", "not-in", ["GPL-2.0-only", "GPL-3.0-only", "AGPL-3.0-only", "AGPL-3.0-or-later"], "warn", "high", False),
    ("max-findings", "Maximum Findings", "Warn when package has more than 20 findings",
     "findingCount", "lte", 20, "warn", "medium", True),
]

# FIXED VALUES — context fields: name -> (column, type, default)
CONTEXT_FIELDS = {
    "packageName": ("package_name", "string", None), "version": ("version", "string", "0.0.0"),
    "license": ("license", "string", "UNKNOWN"), "riskScore": ("risk_score", "number", 0.0),
    "hasInstallScripts": ("has_install_scripts", "boolean", False),
    "hasNativeModules": ("has_native_modules", "boolean", False),
    "dependencyCount": ("dependency_count", "number", 0), "weeklyDownloads": ("weekly_downloads", "number", 0),
    "lastPublished": ("last_published", "string", ""), "maintainerCount": ("maintainer_count", "number", 0),
    "isNew": ("is_new", "boolean", False), "categories": ("categories", "array", None),
    "findingCount": ("finding_count", "number", 0), "criticalFindings": ("critical_findings", "number", 0),
    "highFindings": ("high_findings", "number", 0),
}


def policy_context(df: DataFrame) -> DataFrame:
    """every context field present, defaults where missing/null."""
    out = df
    for _, (col, typ, default) in CONTEXT_FIELDS.items():
        if typ == "array":
            if col not in out.columns:
                out = out.withColumn(col, F.array().cast("array<string>"))
            continue
        if default is None:
            continue
        if col not in out.columns:
            out = out.withColumn(col, F.lit(default))
        else:
            out = out.withColumn(col, F.coalesce(F.col(col), F.lit(default)))
    return out


POLICY_SCHEMA = ("id string, name string, description string, field string, operator string, value string, "
                 "action string, severity string, enabled boolean")


def policy_frame(spark: SparkSession, rules: list[tuple] | None = None) -> DataFrame:
    """Rules as a table, their values as JSON text; the default policy unless given."""
    return spark.createDataFrame([(*r[:5], json.dumps(r[5]), *r[6:]) for r in (DEFAULT_POLICY if rules is None else rules)], POLICY_SCHEMA)


_NUMBERS = ["TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE"]


def _kind(v: Column) -> Column:
    """What ``typeof`` tells apart: number, string, boolean, array, object, null."""
    t = F.schema_of_variant(v)
    return (F.when(t.isin(_NUMBERS) | t.startswith("DECIMAL"), "number").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean")
            .when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object").otherwise("null"))


def _get(v: Column, typ: str) -> Column:
    return F.try_variant_get(v, "$", typ)


def _same(a: Column, kind: Column, b: Column) -> Column:
    """``a === b``, ``kind`` being a's; arrays are never the same one."""
    return (kind == _kind(b)) & F.coalesce(
        F.when(kind == "number", _get(a, "double") == _get(b, "double")).when(kind == "string", _get(a, "string") == _get(b, "string"))
        .when(kind == "boolean", _get(a, "boolean") == _get(b, "boolean")).otherwise(kind == "null"), F.lit(False))


def _text(v: Column) -> Column:
    """A value as a string, as JavaScript turns it into one."""
    def one(x: Column) -> Column:
        return F.when(_kind(x) == "number", js.js_num(_get(x, "double"))).otherwise(_get(x, "string"))

    joined = F.array_join(F.transform(_get(v, "array<variant>"), lambda x: F.coalesce(one(x), F.lit(""))), ",")
    return F.when(_kind(v) == "array", joined).when(_kind(v) == "null", "null").otherwise(one(v))


def _number(v: Column, kind: Column, text: Column) -> Column:
    """A value as a number, as JavaScript compares with it; null for NaN."""
    text = F.trim(text)
    return (F.when(kind == "number", _get(v, "double")).when(kind == "boolean", _get(v, "boolean").cast("double"))
            .when((kind == "null") | (text == ""), 0.0).otherwise(text.try_cast("double")))


def _stringified(v: Column, kind: Column) -> Column:
    """JSON.stringify of a value."""
    return F.when(kind == "number", js.js_num(_get(v, "double"))).when(kind == "null", "null").otherwise(F.to_json(v))


def _java_pattern(text: Column) -> Column:
    """A JavaScript pattern for Java's engine (see functions.regex); null where it is none."""
    pattern = F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)\\b", "$1" + ASCII_BOUNDARY.replace("$", r"\$"))
    return F.when(F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull(), pattern)


def _rules_read(rules: DataFrame) -> DataFrame:
    """The rule table with what its values mean, once a rule and not once a row."""
    v, kind, text = F.col("_expected"), F.col("_ek"), F.col("_et")
    read = rules.where("enabled").withColumn("_expected", F.try_parse_json("value"))
    read = read.withColumns({"_ek": _kind(v), "_et": _text(v)})
    return read.withColumns({"_en": _number(v, kind, text), "_es": _stringified(v, kind), "_list": _get(v, "array<variant>"),
                             "_re": F.when(F.col("operator") == "matches", _java_pattern(text))})


def _passed(op: Column) -> Column:
    """the ten operators.  An operator or type that does not fit fails, as
    does a pattern that is none; ``in`` and ``not-in`` need a list."""
    actual, kind, n, s = F.col("_actual"), F.col("_ak"), F.col("_an"), F.col("_as")
    expected, m, text = F.col("_expected"), F.col("_en"), F.col("_et")
    number, string, listed = kind == "number", kind == "string", F.col("_ek") == "array"
    same, inside = _same(actual, kind, expected), F.exists("_list", lambda x: _same(actual, kind, x))
    return F.coalesce(
        F.when(op == "gt", number & (n > m)).when(op == "gte", number & (n >= m)).when(op == "lt", number & (n < m)).when(op == "lte", number & (n <= m))
        .when(op == "eq", same).when(op == "neq", ~same).when(op == "in", listed & inside).when(op == "not-in", listed & ~inside)
        .when(op == "contains", string & F.contains(s, text))
        .when(op == "matches", F.when(string & F.col("_re").isNotNull(), F.rlike(s, F.col("_re")))), F.lit(False))


def policy_results(ctx: DataFrame, rules: DataFrame | None = None, keys=("project_id", "package_name")) -> DataFrame:
    """J13 + F1/F2: every enabled rule of a rule table against every package.

    The context is unpivoted to (field, VARIANT value) rows and joined with the
    rules on the field, so a rule meets its one field; a rule whose field the
    context lacks meets a null.  A context value that is null is null too.
    """
    spark = ctx.sparkSession
    fields = {f: (c, t) for f, (c, t, _) in CONTEXT_FIELDS.items() if c in ctx.columns}
    rules = _rules_read(policy_frame(spark) if rules is None else rules)
    rules = rules.withColumn("_field", F.when(F.col("field").isin(list(fields)), F.col("field")).otherwise(F.lit("")))
    typed = {"number": "double", "array": "array<string>"}
    values = [F.struct(F.lit(f).alias("_field"), F.col(c).cast(typed.get(t, t)).cast("variant").alias("_actual")) for f, (c, t) in fields.items()]
    values.append(F.struct(F.lit("").alias("_field"), F.lit(None).cast("variant").alias("_actual")))
    actual = F.col("_actual")
    rows = ctx.select(*keys, F.explode(F.array(*values)).alias("_v")).select(*keys, "_v.*")
    rows = rows.withColumns({"_ak": _kind(actual), "_an": _get(actual, "double"), "_as": _get(actual, "string")}).join(rules, "_field")
    rows = rows.withColumn("passed", _passed(F.col("operator")))
    told = F.concat(F.col("name"), F.lit(": "), F.col("description"), F.lit(" ("), F.col("field"), F.lit(" = "), _stringified(actual, F.col("_ak")),
                    F.lit(", expected "), F.col("operator"), F.lit(" "), F.col("_es"), F.lit(")"))
    return rows.select(*keys, F.col("id").alias("rule_id"), F.col("name").alias("rule_name"), "passed", "action", "severity",
                       F.when(F.col("passed"), F.concat("name", F.lit(": passed"))).otherwise(told).alias("message"))


def policy_evaluation(results: DataFrame, keys=("project_id", "package_name")) -> DataFrame:
    """A10: blocked (any failed block rule), warnings, passed, failed."""
    failed = ~F.col("passed")
    return results.groupBy(*keys).agg(
        F.max(F.when(failed & (F.col("action") == "block"), True).otherwise(False)).alias("blocked"),
        F.count(F.when(failed & (F.col("action") == "warn"), 1)).cast("bigint").alias("warnings"),
        F.count(F.when(F.col("passed"), 1)).cast("bigint").alias("passed"),
        F.count(F.when(failed, 1)).cast("bigint").alias("failed"))


# ---------------------------------------------------------------- lists

def list_check(checks: DataFrame, entries: DataFrame, as_of: str) -> DataFrame:
    """First valid deny entry, else first valid allow entry, else
    unlisted (allowed).  An entry is skipped when expired before ``as_of``
    or when both versions are given and differ."""
    e = entries.select(F.col("list").alias("_list"), "name", F.col("version").alias("_ev"), "reason", "seq",
                       "expires_at")
    j = checks.join(e, "name", "left")
    valid = (F.col("_list").isNotNull()
             & (F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(as_of)))
             & (F.col("_ev").isNull() | F.col("version").isNull() | (F.col("_ev") == F.col("version"))))
    pick = F.struct(F.when(F.col("_list") == "deny", 0).otherwise(1).alias("p"), F.col("seq").alias("s"),
                    F.col("_list").alias("list"), F.col("reason").alias("reason"))
    best = j.groupBy("name", "version").agg(F.min(F.when(valid, pick)).alias("_b"))
    name = F.concat(F.lit('"'), F.col("name"), F.lit('"'))
    lst = F.coalesce(F.col("_b.list"), F.lit("unlisted"))
    return best.select(
        "name", "version", (lst != "deny").alias("allowed"),
        F.when(lst == "deny", "denylist").when(lst == "allow", "allowlist").otherwise("unlisted").alias("list"),
        F.when(lst == "deny", F.concat(name, F.lit(" is on the deny list: "), F.col("_b.reason")))
        .when(lst == "allow", F.concat(name, F.lit(" is on the allow list: "), F.col("_b.reason")))
        .otherwise(F.concat(name, F.lit(" is not on any list (allowed by default)"))).alias("message"))


def list_stats(entries: DataFrame, as_of: str) -> DataFrame:
    """Entries per list and expired entries."""
    return entries.agg(F.count(F.when(F.col("list") == "allow", 1)).cast("bigint").alias("allowlist_count"),
                       F.count(F.when(F.col("list") == "deny", 1)).cast("bigint").alias("denylist_count"),
                       F.count(F.when(F.col("expires_at") < F.lit(as_of), 1)).cast("bigint").alias("expired_count"))


def list_mutations(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Lists after applying allow / deny / remove changes in order.

    Per name only the last change decides membership; the entry kept is
    the one added by the first change of the final run of equal changes
    (or the existing entry when every change equals it).  Three partial
    aggregations per name, no per-name collection.
    """
    ch = changes.withColumn("_seq", F.struct("ts", "event_id"))
    last = ch.groupBy("name").agg(F.max_by("op", "_seq").alias("last_op"))
    c2 = ch.join(last, "name")
    brk = c2.groupBy("name", "last_op").agg(F.max(F.when(F.col("op") != F.col("last_op"), F.col("_seq"))).alias("_brk"))
    c3 = c2.join(brk, ["name", "last_op"])
    run = (c3.where((F.col("op") == F.col("last_op")) & (F.col("_brk").isNull() | (F.col("_seq") > F.col("_brk"))))
           .groupBy("name", "last_op", "_brk")
           .agg(F.min_by(F.struct("version", "reason", "event_id"), "_seq").alias("_first")))
    # names without changes keep their entries
    untouched = entries.join(last.select("name"), "name", "left_anti").select(
        "list", "name", "version", "reason", F.col("seq").cast("bigint").alias("source_id"))
    kept_base = (entries.join(run.where(F.col("_brk").isNull()), "name")
                 .where(F.col("list") == F.col("last_op"))
                 .select("list", "name", "version", "reason", F.col("seq").cast("bigint").alias("source_id")))
    has_base = entries.select("list", "name").distinct().withColumnRenamed("list", "last_op").withColumn("_hb", F.lit(True))
    added = (run.where(F.col("last_op") != "remove").join(has_base, ["name", "last_op"], "left")
             .where(F.col("_brk").isNotNull() | F.col("_hb").isNull())
             .select(F.col("last_op").alias("list"), "name", F.col("_first.version").alias("version"),
                     F.col("_first.reason").alias("reason"), F.col("_first.event_id").cast("bigint").alias("source_id")))
    return untouched.unionByName(kept_base).unionByName(added)


# ---------------------------------------------------------------- permissions

def _list(c: Column) -> Column:
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))


def access_check(requests: DataFrame, perms: DataFrame) -> DataFrame:
    """Allowed / rule / details of each access request."""
    p = perms.select(F.col("project_id").alias("_pp"), F.col("name").alias("package_name"), "net_blocked",
                     _list(F.col("net")).alias("_net"), "fs_blocked", _list(F.col("fs")).alias("_fs"),
                     "native", "exec", "env_mode", _list(F.col("env")).alias("_env"), F.lit(True).alias("_has"))
    j = requests.join(p, (requests.project_id == p._pp) & (requests.package_name == p.package_name), "left") \
        .drop(p.package_name).drop("_pp")
    pkg, tgt, res = F.col("package_name"), F.col("target"), F.col("resource")
    q = F.concat(F.lit('"'), pkg, F.lit('"'))
    qt = F.concat(F.lit('"'), tgt, F.lit('"'))
    net_ok = F.exists("_net", lambda g: (g == "*") | F.rlike(tgt, F.concat(
        F.lit("(?i)^"), F.replace(F.replace(g, F.lit("."), F.lit("\\.")), F.lit("*"), F.lit(".*")), F.lit("$"))))
    fs_ok = F.exists("_fs", lambda pre: F.startswith(js.resolve_path(tgt), js.resolve_path(pre)))
    env_ok = F.array_contains("_env", tgt)
    allowed = (
        F.when(F.col("_has").isNull(), False)
        .when(res == "net", F.when(F.col("net_blocked"), False).when(tgt.isNull(), F.size("_net") > 0).otherwise(net_ok))
        .when(res == "fs", F.when(F.col("fs_blocked"), False).when(tgt.isNull(), F.size("_fs") > 0).otherwise(fs_ok))
        .when(res == "native", F.col("native"))
        .when(res == "exec", F.col("exec"))
        .when(res == "env", F.when(F.col("env_mode") == "blocked", False).when(F.col("env_mode") == "all", True)
              .when(tgt.isNull(), True).otherwise(env_ok))
        .otherwise(False))
    rule = (
        F.when(F.col("_has").isNull(), "no-manifest-entry")
        .when(res == "net", F.when(F.col("net_blocked"), "net-blocked").when(tgt.isNull(), "net-general")
              .when(net_ok, "net-allowed").otherwise("net-denied"))
        .when(res == "fs", F.when(F.col("fs_blocked"), "fs-blocked").when(tgt.isNull(), "fs-general")
              .when(fs_ok, "fs-allowed").otherwise("fs-denied"))
        .when(res == "native", F.when(F.col("native"), "native-allowed").otherwise("native-denied"))
        .when(res == "exec", F.when(F.col("exec"), "exec-allowed").otherwise("exec-denied"))
        .when(res == "env", F.when(F.col("env_mode") == "blocked", "env-blocked").when(F.col("env_mode") == "all", "env-allowed-all")
              .when(tgt.isNull(), "env-general").when(env_ok, "env-allowed").otherwise("env-denied"))
        .otherwise("unknown-resource"))
    details = (
        F.when(F.col("rule") == "no-manifest-entry", F.concat(F.lit("Package "), q, F.lit(" has no entry in the permission manifest")))
        .when(F.col("rule") == "net-blocked", F.concat(F.lit("Network access is blocked for "), q))
        .when(F.col("rule") == "net-general", F.concat(F.lit("Network allowed to: "), F.array_join("_net", ", ")))
        .when(F.col("rule") == "net-allowed", F.concat(qt, F.lit(" matches allowed network pattern")))
        .when(F.col("rule") == "net-denied", F.concat(qt, F.lit(" does not match any allowed network pattern for "), q))
        .when(F.col("rule") == "fs-blocked", F.concat(F.lit("Filesystem access is blocked for "), q))
        .when(F.col("rule") == "fs-general", F.concat(F.lit("FS allowed in: "), F.array_join("_fs", ", ")))
        .when(F.col("rule") == "fs-allowed", F.concat(qt, F.lit(" is within allowed filesystem paths")))
        .when(F.col("rule") == "fs-denied", F.concat(qt, F.lit(" is not within any allowed filesystem path for "), q))
        .when(F.col("rule") == "native-allowed", F.concat(F.lit("Native modules allowed for "), q))
        .when(F.col("rule") == "native-denied", F.concat(F.lit("Native modules blocked for "), q))
        .when(F.col("rule") == "exec-allowed", F.concat(F.lit("Process execution allowed for "), q))
        .when(F.col("rule") == "exec-denied", F.concat(F.lit("Process execution blocked for "), q))
        .when(F.col("rule") == "env-blocked", F.concat(F.lit("Environment variable access blocked for "), q))
        .when(F.col("rule") == "env-allowed-all", F.concat(F.lit("All environment variables allowed for "), q))
        .when(F.col("rule") == "env-general", F.concat(F.lit("Env access allowed for: "), F.array_join("_env", ", ")))
        .when(F.col("rule") == "env-allowed", F.concat(F.lit('Env var "'), tgt, F.lit('" is allowed for '), q))
        .when(F.col("rule") == "env-denied", F.concat(F.lit('Env var "'), tgt, F.lit('" is not allowed for '), q))
        .otherwise(F.concat(F.lit("Unknown resource type: "), res)))
    return (j.withColumn("allowed", F.coalesce(allowed, F.lit(False))).withColumn("rule", rule)
            .withColumn("details", details))


def manifest_coverage(installed: DataFrame, perms: DataFrame) -> DataFrame:
    """Each installed package covered by the manifest or not, with the
    restrictions of its entry (net/fs blocked or counts, native, exec)."""
    p = perms.select("project_id", "name", F.lit(True).alias("covered"), "net_blocked",
                     F.size(_list(F.col("net"))).alias("_n"), "fs_blocked", F.size(_list(F.col("fs"))).alias("_f"),
                     "native", "exec")
    j = installed.select("project_id", "name").distinct().join(p, ["project_id", "name"], "left")
    r = F.concat_ws(", ",
                    F.when(F.col("net_blocked"), F.lit("net:blocked")).otherwise(
                        F.concat(F.lit("net:"), F.col("_n").cast("string"), F.lit(" rules"))),
                    F.when(F.col("fs_blocked"), F.lit("fs:blocked")).otherwise(
                        F.concat(F.lit("fs:"), F.col("_f").cast("string"), F.lit(" paths"))),
                    F.when(F.col("native"), F.lit("native:yes")), F.when(F.col("exec"), F.lit("exec:yes")))
    return j.select("project_id", "name", F.coalesce(F.col("covered"), F.lit(False)).alias("covered"),
                    F.when(F.col("covered"), r).alias("restrictions"))


def manifest_generate(cat_counts: DataFrame, packages: DataFrame, keys=("project_id", "package")) -> DataFrame:
    """A default-deny permission entry per package of ``packages`` from the
    behaviour categories it uses (net/fs: [] when used else false; exec: false
    when process use; env: [] when environment use).  A package without
    findings gets net and fs false and nothing else."""
    keys = list(keys)
    used = cat_counts.groupBy(*keys).agg(*[
        F.max(F.when(F.col("category") == c, True).otherwise(False)).alias(c)
        for c in ["network", "filesystem", "process", "environment"]])
    every = packages.select(*keys).distinct()
    return every.join(used, keys, "left").select(*keys,
                       F.when(F.col("network"), "[]").otherwise("false").alias("net"),
                       F.when(F.col("filesystem"), "[]").otherwise("false").alias("fs"),
                       F.when(F.col("process"), F.lit("false")).alias("exec"),
                       F.when(F.col("environment"), F.lit("[]")).alias("env"))


# ---------------------------------------------------------------- gate

# FIXED VALUES — gate defaults
DEFAULT_GATE = dict(max_risk_score=7, max_critical=0, max_high=5, block_on_license=True, block_on_policy=True,
                    block_on_denied=True)


def gate_checks(reports: DataFrame, violations: DataFrame, evaluation: DataFrame, denied: DataFrame,
                gate: dict | None = None, project_col: str = "project_id") -> DataFrame:
    """One row per gate check and project.

    ``reports``: (project, package, score, critical, high); ``denied``:
    (project, name) of denied packages, of which the message names the first ten.
    """
    g = {**DEFAULT_GATE, **(gate or {})}
    top = F.min(F.struct((-F.col("score")).alias("s"), F.col("package").alias("p")))
    r = reports.groupBy(project_col).agg(
        F.max("score").alias("max_score"), top.alias("_top"),
        F.sum("critical").cast("bigint").alias("critical"), F.sum("high").cast("bigint").alias("high"))
    r = r.withColumn("max_score", F.greatest(F.col("max_score"), F.lit(0.0))).withColumn(
        "max_pkg", F.when(F.col("max_score") > 0, F.col("_top.p")).otherwise(F.lit("")))
    lv = violations.groupBy(project_col).agg(F.count("*").cast("bigint").alias("lic"))
    pb = evaluation.groupBy(project_col).agg(F.max(F.col("blocked").cast("int")).alias("_pb"))
    # a count and the first ten names; denied_packages has them all, as rows
    names = denied.select(project_col, "name").distinct()
    first = top_k_per_group(names, [project_col], [F.col("name")], 10).groupBy(project_col).agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("den_names"))
    dn = (denied.groupBy(project_col).agg(F.count("*").cast("bigint").alias("den")).join(names.groupBy(project_col).agg(F.count("*").alias("_all")), project_col)
          .join(first, project_col).withColumn("den_names", F.concat("den_names", F.when(F.col("_all") > 10, F.lit(", ...")).otherwise(""))).drop("_all"))
    base = (r.join(lv, project_col, "left").join(pb, project_col, "left").join(dn, project_col, "left")
            .fillna(0, ["lic", "_pb", "den"]))
    ms = F.format_string("%.1f", F.col("max_score"))
    lim = str(g["max_risk_score"])
    checks = [
        F.struct(F.lit("Max Risk Score").alias("check"), (F.col("max_score") <= g["max_risk_score"]).alias("passed"),
                 F.when(F.col("max_score") <= g["max_risk_score"],
                        F.concat(F.lit("Highest risk: "), ms, F.lit(f"/10 (threshold: {lim})")))
                 .otherwise(F.concat(F.lit('"'), F.col("max_pkg"), F.lit('" has risk score '), ms,
                                     F.lit(f"/10 (max allowed: {lim})"))).alias("message"),
                 F.lit("critical").alias("severity")),
        F.struct(F.lit("Critical Findings").alias("check"), (F.col("critical") <= g["max_critical"]).alias("passed"),
                 F.when(F.col("critical") <= g["max_critical"], F.concat(F.col("critical").cast("string"),
                                                                         F.lit(f" critical findings (max: {g['max_critical']})")))
                 .otherwise(F.concat(F.col("critical").cast("string"),
                                     F.lit(f" critical findings exceed limit of {g['max_critical']}"))).alias("message"),
                 F.lit("critical").alias("severity")),
        F.struct(F.lit("High Findings").alias("check"), (F.col("high") <= g["max_high"]).alias("passed"),
                 F.when(F.col("high") <= g["max_high"], F.concat(F.col("high").cast("string"),
                                                                 F.lit(f" high findings (max: {g['max_high']})")))
                 .otherwise(F.concat(F.col("high").cast("string"),
                                     F.lit(f" high findings exceed limit of {g['max_high']}"))).alias("message"),
                 F.lit("high").alias("severity")),
    ]
    if g["block_on_license"]:
        checks.append(F.struct(F.lit("License Compliance").alias("check"), (F.col("lic") == 0).alias("passed"),
                               F.when(F.col("lic") == 0, F.lit("No license violations"))
                               .otherwise(F.concat(F.col("lic").cast("string"), F.lit(" license violation(s)"))).alias("message"),
                               F.lit("high").alias("severity")))
    if g["block_on_policy"]:
        checks.append(F.struct(F.lit("Policy Compliance").alias("check"), (F.col("_pb") == 0).alias("passed"),
                               F.when(F.col("_pb") == 1, F.lit("Policy evaluation blocked one or more packages"))
                               .otherwise(F.lit("All packages pass policy")).alias("message"),
                               F.lit("critical").alias("severity")))
    if g["block_on_denied"]:
        checks.append(F.when(F.col("den") > 0, F.struct(
            F.lit("Denied Packages").alias("check"), F.lit(False).alias("passed"),
            F.concat(F.col("den").cast("string"), F.lit(" denied package(s): "), F.col("den_names")).alias("message"),
            F.lit("critical").alias("severity"))))
    out = base.select(project_col, F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("_c"))
    return out.select(project_col, "_c.*")


def pr_metrics(reports: DataFrame, violations: DataFrame, evaluation: DataFrame, project_col: str = "project_id"):
    """Packages, high/medium risk, findings, mean score, violations,
    policy failures and the status word."""
    s = F.col("score")
    r = reports.groupBy(project_col).agg(
        F.count("*").cast("bigint").alias("packages"),
        F.count(F.when(s >= 7, 1)).cast("bigint").alias("high_risk"),
        F.count(F.when((s >= 4) & (s < 7), 1)).cast("bigint").alias("medium_risk"),
        F.sum("findings").cast("bigint").alias("findings"),
        (F.sum(s.cast("decimal(18,2)")).cast("double") / F.count("*")).alias("_avg"))
    lv = violations.groupBy(project_col).agg(F.count("*").cast("bigint").alias("license_violations"))
    pf = evaluation.groupBy(project_col).agg(F.count(F.when(F.col("failed") > 0, 1)).cast("bigint").alias("policy_failures"))
    out = r.join(lv, project_col, "left").join(pf, project_col, "left").fillna(0, ["license_violations", "policy_failures"])
    status = (F.when((F.col("high_risk") > 0) | (F.col("license_violations") > 0), "failure")
              .when(F.col("medium_risk") > 0, "warning").otherwise("success"))
    return (out.withColumn("average_score", F.format_string("%.1f", F.col("_avg"))).drop("_avg")
            .withColumn("status", status))


# ---------------------------------------------------------------- compliance

# FIXED VALUES — frameworks and controls: (framework, control id, control name, status rule)
FRAMEWORK_NAMES = {"soc2": "SOC 2 Type II", "iso27001": "ISO/IEC 27001:2022", "pci-dss": "PCI DSS v4.0",
                   "eo14028": "Executive Order 14028", "nist-ssdf": "NIST SSDF v1.1"}
CONTROLS = [
    ("soc2", "CC6.1", "Logical Access Controls", "manifest"),
    ("soc2", "CC6.6", "System Boundary Protection", "high_risk"),
    ("soc2", "CC7.1", "Vulnerability Management", "met"),
    ("soc2", "CC7.2", "Change Detection & Monitoring", "lockfile"),
    ("soc2", "CC8.1", "Secure Software Development", "policy"),
    ("iso27001", "A.12.6.1", "Management of Technical Vulnerabilities", "met"),
    ("iso27001", "A.14.1.2", "Securing Application Services", "manifest"),
    ("iso27001", "A.14.2.1", "Secure Development Policy", "policy"),
    ("iso27001", "A.18.1.2", "Intellectual Property Rights", "license"),
    ("iso27001", "A.15.1.1", "Information Security in Supplier Relationships", "sbom"),
    ("pci-dss", "6.3.2", "Software Inventory", "sbom"),
    ("pci-dss", "6.2.4", "Software Engineering Techniques", "met"),
    ("pci-dss", "6.3.1", "Security Vulnerability Identification", "met"),
    ("eo14028", "EO-4e", "Software Bill of Materials", "sbom_strict"),
    ("eo14028", "EO-4e-tools", "Automated Security Tools", "met"),
    ("eo14028", "EO-4i", "Software Supply Chain Security", "manifest_and_policy"),
]
# the fifth framework is reported by the controls of the order, which it is closest to
CONTROLS += [("nist-ssdf", *c[1:]) for c in CONTROLS if c[0] == "eo14028"]

# What a control's status rests on, in words of our own: rule -> (kind, condition on the facts, text with facts in braces)
CONTROL_NOTES = {
    "met": [("evidence", "TRUE", "{total_packages} packages scanned by the source and behaviour rules"),
            ("recommendation", "high_risk_packages > 0", "Review the {high_risk_packages} packages of high risk")],
    "manifest": [("evidence", "has_manifest", "A permission manifest limits what each package may do"),
                 ("evidence", "TRUE", "{total_packages} packages scanned for access they should not have"),
                 ("gap", "NOT has_manifest", "No permission manifest: packages have unrestricted access"),
                 ("recommendation", "NOT has_manifest", "Generate a permission manifest")],
    "lockfile": [("evidence", "has_lockfile", "The lockfile pins all dependency versions"), ("evidence", "TRUE", "Lockfile and behaviour changes are compared"),
                 ("gap", "NOT has_lockfile", "No lockfile: dependency versions may drift"), ("recommendation", "NOT has_lockfile", "Commit the lockfile")],
    "policy": [("evidence", "has_policy", "A security policy is evaluated for every package"), ("evidence", "TRUE", "{total_packages} packages have a risk score"),
               ("gap", "NOT has_policy", "No security policy"), ("recommendation", "NOT has_policy", "Define a security policy")],
    "sbom": [("evidence", "has_sbom", "A bill of materials lists all components"), ("evidence", "TRUE", "{total_packages} third-party components inventoried"),
             ("gap", "NOT has_sbom", "No bill of materials"), ("recommendation", "NOT has_sbom", "Generate a bill of materials")],
    "sbom_strict": [("evidence", "has_sbom", "A bill of materials lists {total_packages} components"), ("gap", "NOT has_sbom", "No bill of materials, which the order requires"),
                    ("recommendation", "NOT has_sbom", "Generate a bill of materials")],
    "high_risk": [("evidence", "TRUE", "{total_packages} packages analysed, {high_risk_packages} of high risk"),
                  ("gap", "high_risk_packages > 0", "{high_risk_packages} packages of high risk need review"),
                  ("recommendation", "high_risk_packages > 0", "Review or replace packages of high risk")],
    "license": [("evidence", "TRUE", "Licenses of {total_packages} packages checked"), ("gap", "license_violations > 0", "{license_violations} license violations"),
                ("recommendation", "license_violations > 0", "Resolve license violations or replace the packages")],
    "manifest_and_policy": [("evidence", "has_manifest", "A permission manifest limits what each package may do"), ("evidence", "has_policy", "A security policy sets acceptable risk"),
                            ("gap", "NOT has_manifest", "No permission manifest"), ("gap", "NOT has_policy", "No security policy"),
                            ("recommendation", "NOT has_manifest", "Generate a permission manifest"), ("recommendation", "NOT has_policy", "Define a security policy")],
}
CONTROL_GOALS = {
    "CC6.1": "Access to systems is limited to those who need it", "CC6.6": "The system's boundary is guarded", "CC7.1": "Vulnerabilities are found and tracked",
    "CC7.2": "Changes that touch security are noticed", "CC8.1": "Software is developed and changed in a controlled way",
    "A.12.6.1": "Technical vulnerabilities are known and judged", "A.14.1.2": "Services and the data they handle are protected",
    "A.14.2.1": "Rules for secure development exist and are applied", "A.18.1.2": "Rights to the software used are respected",
    "A.15.1.1": "Risks from suppliers are managed", "6.3.2": "All software components are listed", "6.2.4": "Common attacks are prevented by the way software is built",
    "6.3.1": "Security vulnerabilities are identified and managed", "EO-4e": "A bill of materials comes with each product",
    "EO-4e-tools": "Automated tools guard the source supply chain", "EO-4i": "The integrity of open-source parts is ensured and attested",
}


def control_status(rule: str) -> Column:
    m, lk, sb, po = F.col("has_manifest"), F.col("has_lockfile"), F.col("has_sbom"), F.col("has_policy")
    hr, lv = F.col("high_risk_packages"), F.col("license_violations")
    return {
        "met": F.lit("met"),
        "manifest": F.when(m, "met").otherwise("partial"),
        "lockfile": F.when(lk, "met").otherwise("partial"),
        "policy": F.when(po, "met").otherwise("partial"),
        "sbom": F.when(sb, "met").otherwise("partial"),
        "sbom_strict": F.when(sb, "met").otherwise("not-met"),
        "high_risk": F.when(hr == 0, "met").when(hr <= 2, "partial").otherwise("not-met"),
        "license": F.when(lv == 0, "met").otherwise("not-met"),
        "manifest_and_policy": F.when(m & po, "met").otherwise("partial"),
    }[rule]


def compliance_controls(facts: DataFrame, project_col: str = "project_id") -> DataFrame:
    """Every control of every framework evaluated on the facts row
    of each project (literal control array, no join)."""
    arr = F.array(*[F.struct(F.lit(fw).alias("framework"), F.lit(cid).alias("control_id"),
                             F.lit(name).alias("control_name"), control_status(rule).alias("status"))
                    for fw, cid, name, rule in CONTROLS])
    return facts.select(project_col, F.explode(arr).alias("_c")).select(project_col, "_c.*")


def compliance_notes(facts: DataFrame, project_col: str = "project_id") -> DataFrame:
    """Evidence, gaps and recommendations of every control, as rows
    (project, framework, control_id, goal, kind, n, text); the facts are in the text."""
    def told(text: str) -> Column:
        return F.concat(*[F.col(t).cast("string") if k % 2 else F.lit(t) for k, t in enumerate(re.split(r"[{}]", text))])

    rows = [F.when(F.expr(cond), F.struct(F.lit(fw).alias("framework"), F.lit(cid).alias("control_id"), F.lit(CONTROL_GOALS[cid]).alias("goal"),
                                          F.lit(kind).alias("kind"), F.lit(n).alias("n"), told(text).alias("text")))
            for fw, cid, _, rule in CONTROLS for n, (kind, cond, text) in enumerate(CONTROL_NOTES[rule], 1)]
    return facts.select(project_col, F.explode(F.array_compact(F.array(*rows))).alias("_n")).select(project_col, "_n.*")


def compliance_summary(controls: DataFrame, project_col: str = "project_id") -> DataFrame:
    """Status counts and score round((met + partial/2) / (total - n/a) * 100)."""
    def n_if(s):
        return F.count(F.when(F.col("status") == s, 1)).cast("bigint")
    names = F.create_map(*[x for k, v in FRAMEWORK_NAMES.items() for x in (F.lit(k), F.lit(v))])
    out = controls.groupBy(project_col, "framework").agg(
        F.count("*").cast("bigint").alias("total"), n_if("met").alias("met"), n_if("partial").alias("partial"),
        n_if("not-met").alias("not_met"), n_if("not-applicable").alias("not_applicable"))
    score = js.js_round((F.col("met") + F.col("partial") * 0.5) / (F.col("total") - F.col("not_applicable")) * 100.0)
    return out.withColumn("framework_name", names[F.col("framework")]).withColumn("score", score)
