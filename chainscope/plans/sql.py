"""DuckDB-side building blocks of the oracle SQL (independent of Spark)."""

from __future__ import annotations

from chainscope.functions.regex import sql_str

RE2_SPACE = r"[\t\x{0B}\f \x{A0}\x{FEFF}\p{Zs}\n\r\x{2028}\x{2029}]"


def js_trim(x: str) -> str:
    return f"regexp_replace({x}, {sql_str('^' + RE2_SPACE + '+|' + RE2_SPACE + '+$')}, '', 'g')"


def snippet(line_text: str) -> str:
    t = js_trim(line_text)
    return f"(CASE WHEN length({t}) > 120 THEN substr({t}, 1, 117) || '...' ELSE {t} END)"


def values_cte(cols: list[str], rows: list[tuple]) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return repr(v)
        return sql_str(v)
    body = ",\n".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(cols)})"


def sev_rank(col: str) -> str:
    return (f"(CASE {col} WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 "
            f"WHEN 'low' THEN 3 ELSE 4 END)")


def js_round(x: str) -> str:
    return f"CAST(floor(({x}) + 0.5) AS BIGINT)"


def round1(x: str) -> str:
    return f"CAST(floor(({x}) * 10.0 + 0.5) / 10.0 AS DOUBLE)"


def js_num(x: str) -> str:
    return (f"(CASE WHEN ({x}) = CAST(CAST({x} AS BIGINT) AS DOUBLE) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) "
            f"ELSE CAST({x} AS VARCHAR) END)")


# Rules whose patterns look around or refer back, which DuckDB's RE2 cannot
# run: a pattern for the part up to that point (each start has one end), and
# the number of characters the match goes on behind it (NULL: no match).
# ``rest`` is the text behind that part, ``m`` the part itself.
BODY_WORD = "instr(lower(substr(rest, 1, 210)), {})"
_body = "least(200, " + ", ".join(
    f"CASE WHEN {BODY_WORD.format(sql_str(w))} = 0 THEN 200 ELSE {BODY_WORD.format(sql_str(w))} - 1 END"
    for w in ("log", "audit", "track", "record")) + ")"
_cand = f"substr(rest, 1, {_body} + 1)"
_name = r"regexp_extract(m, '\(\s*(\w+)', 1)"
SPLIT_RULES = {
    "A08-cdn-no-sri": (
        r"""(?i)<script\s+src\s*=\s*['"`]https?:\/\/(?:cdn|unpkg|cdnjs|jsdelivr)[^'"`]*['"`]""",
        "CASE WHEN NOT regexp_matches(rest, '(?i)^[^>]*integrity') THEN 0 END"),
    "TS-any-abuse": (
        r":\s*any\b",
        r"CASE WHEN NOT regexp_matches(rest, '^\s*\)') THEN 0 END"),
    "A09-error-info-leak": (
        r"catch\s*\(\s*\w+\s*\)\s*\{",
        r"nullif(length(regexp_extract(rest, '^[\s\S]{0,50}res\.(?:json|send)\s*\(\s*\{[\s\S]{0,50}' || "
        + _name + r" || '\.(?:message|stack)')), 0)"),
    "A09-missing-auth-logging": (
        r"(?i)(?:login|signin|authenticate)\s*(?:=|:)\s*(?:async\s+)?(?:function|\([^)]*\)\s*=>)\s*\{",
        f"CASE WHEN contains({_cand}, '}}') AND length({_cand}) - instr(reverse({_cand}), '}}') >= 30 "
        f"THEN length({_cand}) - instr(reverse({_cand}), '}}') + 1 END"),
}


def split_rule_pattern(rule_id: str, pat: str) -> str:
    return SPLIT_RULES[rule_id][0] if rule_id in SPLIT_RULES else pat


def match_ctes(files: str, rules_cte: str, rule_cols: list[str], keep: list[str], dedup: bool,
               prefix: str = "m", content: str = "content", split_rules: bool = False) -> list[tuple[str, str]]:
    """CTEs computing every match of every rule with line, col, snippet.

    ``{prefix}_out`` holds keep + rule_cols + line + col + snippet.
    """
    k = ", ".join(f"f.{c}" for c in keep)
    rc = ", ".join(f"r.{c}" for c in rule_cols)
    kk = ", ".join(keep)
    rr = ", ".join(rule_cols)
    out = [
        (f"{prefix}_hit", f"""
SELECT {k}, f.{content} AS content, {rc}, r.pat,
       regexp_extract_all(f.{content}, r.pat) AS ms,
       string_split_regex(f.{content}, r.pat) AS segs
FROM {files} f CROSS JOIN {rules_cte} r
WHERE regexp_matches(f.{content}, r.pat)"""),
        (f"{prefix}_idx", f"SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM {prefix}_hit"),
        (f"{prefix}_off", f"""
SELECT *, CAST(list_sum(list_transform(segs[1:i], lambda s: length(s)))
            + coalesce(list_sum(list_transform(ms[1:i-1], lambda s: length(s))), 0) AS BIGINT) AS off
FROM {prefix}_idx"""),
        (f"{prefix}_pos", f"""
SELECT {kk}, {rr}, off, content,
       CAST(1 + length(substr(content, 1, off)) - length(replace(substr(content, 1, off), chr(10), '')) AS INTEGER) AS line,
       CAST(CASE WHEN instr(reverse(substr(content, 1, off)), chr(10)) = 0 THEN off + 1
                 ELSE instr(reverse(substr(content, 1, off)), chr(10)) END AS INTEGER) AS col
FROM {prefix}_off"""),
    ]
    if split_rules:
        go_on = " ".join(f"WHEN {sql_str(rid)} THEN {cond}" for rid, (_, cond) in SPLIT_RULES.items())
        pos, off = out.pop(), out[2]
        # a match that starts inside an earlier one of its rule is none
        out += [
            (f"{prefix}_part", f"""
SELECT *, ms[i] AS m, CASE WHEN rule_id IN ({', '.join(map(sql_str, SPLIT_RULES))})
                           THEN substr(content, off + length(ms[i]) + 1) END AS rest
FROM {off[0]}"""),
            (f"{prefix}_end", f"""
SELECT * EXCLUDE (m, rest), off + length(m) + CASE rule_id {go_on} ELSE 0 END AS stop FROM {prefix}_part"""),
            (f"{prefix}_keep", f"""
SELECT * FROM (
  SELECT *, max(stop) OVER (PARTITION BY {kk}, rule_idx ORDER BY off
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM {prefix}_end WHERE stop IS NOT NULL)
WHERE before IS NULL OR off >= before"""),
            (pos[0], pos[1].replace(f"FROM {off[0]}", f"FROM {prefix}_keep"))]
    src = f"{prefix}_pos"
    if dedup:
        out.append((f"{prefix}_dd", f"""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY {kk}, {rule_cols[0]}, line ORDER BY off) AS rn FROM {prefix}_pos
) WHERE rn = 1"""))
        src = f"{prefix}_dd"
    out.append((f"{prefix}_out", f"""
SELECT {kk}, {rr}, line, col, {snippet("string_split(content, chr(10))[line]")} AS snippet
FROM {src}"""))
    return out
