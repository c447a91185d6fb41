"""Regex scanning of file corpora against rule catalogues.

Plan shape (all narrow, no shuffle until the summaries):

1. one projection tests every rule as a literal pattern over the file
   content, guarded by the rule's necessary literals on the lower-cased
   content (``catalog.prefilters``), so most (file, rule) pairs never run a
   regex; only rules that match are exploded -> (file, rule);
2. the rule's matches are marked in the text: its pattern, a literal of the
   same plan, is replaced by a marker and itself, one file and rule at a time;
3. the marked text is split into lines and exploded with their numbers, and
   lines without a marker are filtered in the same generated code.  A line's
   number is its place, the column that of its first marker: no offsets are
   counted and the work is linear in text and matches;
4. with de-duplication a line gives one finding (its first match); without,
   one for each marker, its column the running sum of the parts before it;
5. the snippet is the trimmed line without markers, so findings carry no file
   content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainscope.catalog import prefilters
from chainscope.catalog.advice import ADVICE
from chainscope.catalog.behavior_rules import BEHAVIOR_RULES, SEVERITY_WEIGHT
from chainscope.catalog.scan_rules import CONFIDENCE_ORDER, OWASP_NAMES, SCAN_RULES, SEVERITY_ORDER
from chainscope.functions import js
from chainscope.functions.arrays import running_sum
from chainscope.functions.regex import to_java, to_re2
from chainscope.functions.sizing import spread

#: Stands before each match in a marked text: a noncharacter, which no text
#: interchange uses.  Where content holds it all the same, it is read as the next one.
MARK, UNMARK = "\ufdd0", "\ufdd1"


# ---------------------------------------------------------------- catalogues

def source_rules(severity_threshold: str = "low", confidence_threshold: str = "low") -> list[dict]:
    """The source-scan catalogue, threshold-filtered on the driver.

    Filtering here is predicate pushdown on the build side: rules below the
    threshold never enter the plan.
    """
    sev_max, conf_max = SEVERITY_ORDER[severity_threshold], CONFIDENCE_ORDER[confidence_threshold]
    out = []
    for idx, (rid, owasp, cwe, sev, conf, flags, pat, msg) in enumerate(SCAN_RULES):
        if SEVERITY_ORDER[sev] > sev_max or CONFIDENCE_ORDER[conf] > conf_max:
            continue
        out.append(dict(rule_idx=idx, rule_id=rid, owasp=owasp, owasp_name=OWASP_NAMES[owasp], cwe=cwe,
                        severity=sev, confidence=conf, message=msg, flags=flags, pattern=pat,
                        java=to_java(pat, flags), re2=to_re2(pat, flags), prefilter=prefilters.SOURCE.get(rid)))
    return out


def behavior_rules() -> list[dict]:
    out = []
    for idx, (rule, pat, sev, cat, msg) in enumerate(BEHAVIOR_RULES):
        out.append(dict(rule_idx=idx, rule=rule, severity=sev, category=cat, message=msg,
                        weight=SEVERITY_WEIGHT[sev], flags="g", pattern=pat,
                        java=to_java(pat, "g"), re2=to_re2(pat, "g"), prefilter=prefilters.BEHAVIOR.get(rule)))
    return out


def rules_frame(spark: SparkSession, rules: list[dict], columns: list[str]) -> DataFrame:
    """Catalogue rows as a small DataFrame (broadcast in joins)."""
    schema_types = {"rule_idx": "int", "cwe": "int", "weight": "double"}
    fields = ", ".join(f"`{c}` {schema_types.get(c, 'string')}" for c in columns)
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in rules], schema=fields)


# ---------------------------------------------------------------- matching

def find_matches(files: DataFrame, rules: list[dict], keep: list[str], rule_cols: list[str],
                 content_col: str = "content", dedup: bool = True) -> DataFrame:
    """Every non-overlapping match of every rule in every row of ``files``.

    Returns ``keep`` columns + ``rule_cols`` (from the catalogue) + line,
    col, snippet.  With ``dedup`` only the first match per (rule, row, line)
    is kept.
    """
    spark = files.sparkSession
    files = spread(files, [k for k in keep if k in files.columns])
    files = files.select(*keep, F.replace(content_col, F.lit(MARK), F.lit(UNMARK)).alias("_content")).withColumn("_lc", F.lower("_content"))
    c, lc = F.col("_content"), F.col("_lc")
    hit = [F.when(prefilter(lc, r.get("prefilter")) & c.rlike(r["java"]), F.lit(r["rule_idx"])) for r in rules]
    marked = F.lit(None).cast("string")
    for r in rules:  # the literal of the row's rule, so that no pattern is compiled per row
        one = F.regexp_replace(c, F.lit(r["java"]), F.lit(MARK + "$0"))
        marked = F.when(F.col("rule_idx") == r["rule_idx"], one) if r is rules[0] else marked.when(F.col("rule_idx") == r["rule_idx"], one)
    # explode_outer + a null filter on the generated column: an inner
    # explode (or a size filter) lets Catalyst infer a filter on the array
    # and push it below the projection -- evaluating every regex twice.
    hits = (files.select(*keep, "_content", F.array_compact(F.array(*hit)).alias("_hits"))
            .select(*keep, "_content", F.explode_outer("_hits").alias("rule_idx"))
            .where(F.col("rule_idx").isNotNull())
            .select(*keep, "rule_idx", F.split(marked, "\n", -1).alias("_lines")))
    lines = (hits.select(*keep, "rule_idx", F.posexplode_outer("_lines").alias("_n", "_line"))
             .where(F.contains("_line", F.lit(MARK))))
    cat = rules_frame(spark, rules, ["rule_idx"] + [x for x in rule_cols if x != "rule_idx"])
    found = lines.join(F.broadcast(cat), "rule_idx")
    line, text = (F.col("_n") + 1).alias("line"), js.snippet(F.replace("_line", F.lit(MARK), F.lit(""))).alias("snippet")
    if dedup:
        return found.select(*keep, *rule_cols, line, F.instr("_line", MARK).alias("col"), text)
    before = F.split("_line", MARK, -1)  # the parts before each match, and the rest of the line
    # lengths and snippet are taken once a line: what a lambda or an explode repeats is short
    placed = found.select(*keep, *rule_cols, line, text, F.transform(F.slice(before, F.lit(1), F.size(before) - 1), F.length).alias("_sizes"))
    return (placed.select(*keep, *rule_cols, "line", F.explode_outer(running_sum(F.col("_sizes"))).alias("_before"), "snippet")
            .select(*keep, *rule_cols, "line", (F.col("_before") + 1).alias("col"), "snippet"))


def prefilter(lc: Column, groups) -> Column:
    """Cheap necessary condition of a rule on the lower-cased text: every
    group has a literal that occurs (``catalog.prefilters``)."""
    if not groups:
        return F.lit(True)
    cond = None
    for alts in groups:
        g = None
        for a in alts:
            x = lc.contains(a)
            g = x if g is None else (g | x)
        cond = g if cond is None else (cond & g)
    return cond


SOURCE_FINDING_COLS = ["rule_idx", "rule_id", "owasp", "owasp_name", "cwe", "severity", "confidence", "message"]
BEHAVIOR_FINDING_COLS = ["rule_idx", "rule", "severity", "category", "message", "weight"]


def scan_source(files: DataFrame, rules: list[dict] | None = None, keep=("project_id", "path"),
                dedup: bool = True) -> DataFrame:
    """P1+P4+P5(+P6): source findings of a file table."""
    rules = rules if rules is not None else source_rules()
    out = find_matches(files, rules, list(keep), SOURCE_FINDING_COLS, dedup=dedup)
    return out.withColumnRenamed("path", "file") if "path" in keep else out


def scan_behavior(files: DataFrame, rules: list[dict] | None = None,
                  keep=("project_id", "package", "version", "path"), dedup: bool = True) -> DataFrame:
    """Behaviour findings of package files."""
    rules = rules if rules is not None else behavior_rules()
    out = find_matches(files, rules, list(keep), BEHAVIOR_FINDING_COLS, dedup=dedup)
    return out.withColumnRenamed("path", "file") if "path" in keep else out


def scan_column(df: DataFrame, column: str, keep: list[str], rules: list[dict] | None = None) -> DataFrame:
    """Behaviour scan of any string column, no de-duplication."""
    rules = rules if rules is not None else behavior_rules()
    return find_matches(df, rules, keep, BEHAVIOR_FINDING_COLS, content_col=column, dedup=False)


def with_details(findings: DataFrame) -> DataFrame:
    """Findings with description, fix, falsePositive (of their category, from
    the catalogue) and tags (the category, the CWE, the words of the rule's id)."""
    advice = F.create_map(*[x for k, v in ADVICE.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    of = F.element_at(advice, F.col("owasp"))
    words = F.split(F.lower(F.regexp_replace("rule_id", "^[A-Z0-9]+-", "")), "-")
    tags = F.array_distinct(F.concat(F.array(F.lower("owasp"), F.concat(F.lit("cwe-"), F.col("cwe").cast("string"))), words))
    return findings.withColumns({"description": of[0], "fix": of[1], "false_positive": of[2], "tags": F.array_join(tags, ",")})


# ---------------------------------------------------------------- ordering

def severity_rank(c: Column | str = "severity") -> Column:
    return js.rank_of(F.col(c) if isinstance(c, str) else c, SEVERITY_ORDER)


def confidence_rank(c: Column | str = "confidence") -> Column:
    return js.rank_of(F.col(c) if isinstance(c, str) else c, CONFIDENCE_ORDER)
