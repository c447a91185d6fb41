"""Column expressions that reproduce JavaScript scalar semantics.

Each helper has a DuckDB twin in ``chainscope.plans.sql`` so oracle
queries compute the same thing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# JavaScript String.prototype.trim strips WhiteSpace and LineTerminator code
# points: TAB VT FF SP NBSP BOM, the Zs category, LF CR LS PS.
JS_SPACE_CLASS = r"[\t\x{0B}\f \x{A0}\x{FEFF}\p{Zs}\n\r\x{2028}\x{2029}]"
JS_TRIM_RE = f"^{JS_SPACE_CLASS}+|{JS_SPACE_CLASS}+$"


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(JS_TRIM_RE), F.lit(""))


def js_round(c: Column) -> Column:
    """Math.round: halves go toward +infinity."""
    return F.floor(c + F.lit(0.5)).cast("bigint")


def round1(c: Column) -> Column:
    """Math.round(x * 10) / 10."""
    return (F.floor(c * F.lit(10.0) + F.lit(0.5)) / F.lit(10.0)).cast("double")


def js_num(c: Column) -> Column:
    """Number -> string the way JavaScript prints it (3, 3.1, 0.5)."""
    as_long = c.cast("bigint")
    return F.when(c == as_long.cast("double"), as_long.cast("string")).otherwise(c.cast("string"))


def snippet(line_text: Column, width: int = 120) -> Column:
    """Trimmed source line, cut to width-3 chars plus '...' when longer."""
    t = js_trim(line_text)
    return F.when(F.length(t) > width, F.concat(F.substring(t, 1, width - 3), F.lit("..."))).otherwise(t)


def resolve_path(c: Column) -> Column:
    """An absolute POSIX path without empty, ``.`` and ``..`` parts or a final
    slash; a relative path counts from the root folder."""
    parts = F.filter(F.split(c, "/"), lambda x: (x != "") & (x != "."))
    path = F.aggregate(parts, F.lit(""), lambda acc, x: F.when(x == "..", F.regexp_replace(acc, "/[^/]+$", ""))
                       .otherwise(F.concat(acc, F.lit("/"), x)))
    return F.when(path == "", "/").otherwise(path)


def rank_of(c: Column, order: dict) -> Column:
    """Enum -> order rank via a literal map (no join)."""
    m = F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))])
    return m[c]
