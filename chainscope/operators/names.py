"""Look-alike package names.

Candidates come from a deletion-neighbourhood index: two names are within
``EDITS`` edits only if deleting that many characters or fewer from each can
give the same string.  Both sides are exploded to the hashes of what such
deletions leave and joined on them, the few pairs that meet are verified by
edit distance.  Names that differ in separators alone may be further apart and
are joined on the name without separators.  Nothing grows with the product of
the two tables, and the index is never broadcast.  The choice per name is one ``min(struct)``
aggregate (partial aggregation first, so a hot name does not end up whole in
one task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainscope.catalog.reference import KNOWN_SCOPES, POPULAR_PACKAGES

SCOPED = r"^(@[^/]+)/(.+)$"


def split_name(name: Column) -> tuple[Column, Column]:
    """(scope, base); scope '' when the name is not scoped."""
    scope = F.regexp_extract(name, SCOPED, 1)
    base = F.when(scope == "", name).otherwise(F.regexp_extract(name, SCOPED, 2))
    return scope, base


def separator_only(a: Column, b: Column) -> Column:
    """Equal once '-', '_' and '.' are removed, but not equal."""
    return (F.translate(a, "-_.", "") == F.translate(b, "-_.", "")) & (a != b)


def adjacent_swap(a: Column, b: Column) -> Column:
    """Same length, exactly two differing positions, adjacent and crossed."""
    n = F.length(a)
    diff = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                    lambda i: F.substring(a, i, 1) != F.substring(b, i, 1))
    p1, p2 = F.try_element_at(diff, F.lit(1)), F.try_element_at(diff, F.lit(2))
    return ((n == F.length(b)) & (n > 0) & (F.size(diff) == 2) & (p2 - p1 == 1)
            & (F.substring(a, p1, 1) == F.substring(b, p2, 1)) & (F.substring(a, p2, 1) == F.substring(b, p1, 1)))


def one_extra(a: Column, b: Column) -> Column:
    """``a`` is ``b`` with one character inserted."""
    return (F.length(a) == F.length(b) + 1) & F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))),
        lambda i: F.concat(F.substring(a, 1, i - 1), F.substring(a, i + 1, 1 << 30)) == b)


def known_frame(spark: SparkSession, known: list[str] | None = None) -> DataFrame:
    known = known if known is not None else POPULAR_PACKAGES
    return spark.createDataFrame([(i, k) for i, k in enumerate(known)], "known_idx int, known string")


def _neighbourhood(name: Column) -> Column:
    """Hashes of all strings that up to two deletions leave of a name."""
    def places(first: Column, last: Column) -> Column:
        return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    def without(text: Column, at: Column) -> Column:
        return F.concat(F.substring(text, 1, at - 1), F.substring(text, at + 1, 1 << 30))

    size = F.length(name)
    one = F.transform(places(F.lit(1), size), lambda i: without(name, i))
    two = F.flatten(F.transform(places(F.lit(1), size - 1), lambda i: F.transform(places(i, size - 1), lambda j: without(without(name, i), j))))
    return F.array_distinct(F.transform(F.concat(F.array(name), one, two), lambda v: F.xxhash64(v)))


def near_bases(bases: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct (base, kbase) within two edits or, with lengths two apart at most,
    equal but for separators."""
    b = known.select("kbase").distinct()
    # names whose length no known name is near have no neighbours to list
    lengths = b.select(F.explode(F.sequence(F.length("kbase") - 2, F.length("kbase") + 2)).alias("_size")).distinct()
    a = bases.select("base").distinct().join(lengths, F.length("base") == F.col("_size"), "left_semi")
    # merged, since Spark's estimate does not see how many rows an explode makes
    met = (a.select("base", F.explode(_neighbourhood(F.col("base"))).alias("_h")).hint("merge")
           .join(b.select("kbase", F.explode(_neighbourhood(F.col("kbase"))).alias("_h")), "_h")
           .where(F.levenshtein("base", "kbase", 2) >= 0).select("base", "kbase"))
    bare = (a.withColumn("_s", F.translate("base", "-_.", "")).join(b.withColumn("_s", F.translate("kbase", "-_.", "")), "_s")
            .where(F.abs(F.length("base") - F.length("kbase")) <= 2).select("base", "kbase"))
    return met.unionByName(bare).distinct()


def candidate_pairs(names: DataFrame, known: DataFrame, name_col: str = "name") -> DataFrame:
    """Every (name, known) pair that may look alike."""
    scope, base = split_name(F.col(name_col))
    n = names.select(F.col(name_col).alias("name"), scope.alias("scope"), base.alias("base"))
    k = known.select("known_idx", "known", split_name(F.col("known"))[1].alias("kbase"))
    return n.join(near_bases(n, k), "base").join(k, "kbase").select("name", "scope", "base", "known_idx", "known", "kbase")


def pair_features(pairs: DataFrame) -> DataFrame:
    a, b = F.col("base"), F.col("kbase")
    return (pairs.withColumn("separator", separator_only(a, b))
            .withColumn("swap", adjacent_swap(a, b))
            .withColumn("extra", one_extra(a, b))
            .withColumn("missing", one_extra(b, a))
            .withColumn("distance", F.levenshtein(a, b)))


def scope_hit(scope: Column, scopes: list[str] | None = None) -> Column:
    """First known scope (in order) that differs from ``scope`` and is
    within 2 edits; null when none.  A 5-entry literal array per row."""
    scopes = scopes if scopes is not None else KNOWN_SCOPES
    cand = F.array(*[F.lit(s) for s in scopes])
    return F.element_at(F.filter(cand, lambda c: (c != scope) & (F.levenshtein(scope, c) <= 2)), 1)


def scope_confusion(names: DataFrame, name_col: str = "name", scopes: list[str] | None = None) -> DataFrame:
    """Scoped names whose scope looks like a typo of a known scope."""
    scope, base = split_name(F.col(name_col))
    out = (names.select(F.col(name_col).alias("name"), scope.alias("scope"), base.alias("base"))
           .where(F.col("scope") != "").withColumn("_hit", scope_hit(F.col("scope"), scopes)))
    return (out.where(F.col("_hit").isNotNull())
            .select("name", F.concat(F.col("_hit"), F.lit("/"), F.col("base")).alias("similar_to"),
                    F.levenshtein(F.col("scope"), F.col("_hit")).alias("distance"),
                    F.lit("scope-confusion").alias("method")))


def typosquat(names: DataFrame, known: DataFrame, name_col: str = "name") -> DataFrame:
    """One verdict per suspicious name.

    Exact known names (full or scope-stripped) are not suspicious; scope
    confusion wins next; then the first known name (list order) with a
    separator / swap / extra / missing hit; otherwise the nearest name
    within 2 edits (earliest on ties).
    """
    d = names.select(F.col(name_col).alias("name")).distinct()
    _, base = split_name(F.col("name"))
    exact = known.select(F.col("known").alias("_known")).distinct()
    d = d.withColumn("_base", base).join(exact, F.col("name") == F.col("_known"), "left_anti")
    d = d.join(exact, F.col("_base") == F.col("_known"), "left_anti").drop("_base")
    scope, _ = split_name(F.col("name"))
    d = d.withColumn("_hit", F.when(scope != "", scope_hit(scope)))
    sc = scope_confusion(d.where(F.col("_hit").isNotNull()).drop("_hit"))
    rest = d.where(F.col("_hit").isNull()).drop("_hit")
    f = pair_features(candidate_pairs(rest, known))
    method = (F.when(F.col("separator"), "hyphen-underscore").when(F.col("swap"), "character-swap")
              .when(F.col("extra"), "repeated-character").when(F.col("missing"), "missing-character"))
    direct = method.isNotNull()
    f = f.withColumn("method", F.coalesce(method, F.lit("levenshtein")))
    f = f.withColumn("distance", F.when(F.col("method") == "hyphen-underscore", 0)
                     .when(direct, 1).otherwise(F.col("distance")))
    f = f.where(direct | (F.col("distance") <= 2))
    key = F.struct(F.when(direct, 0).otherwise(1).alias("a"),
                   F.when(direct, F.col("known_idx")).otherwise(F.col("distance")).alias("b"),
                   F.col("known_idx").alias("c"), F.col("known").alias("similar_to"),
                   F.col("distance").alias("distance"), F.col("method").alias("method"))
    best = f.groupBy("name").agg(F.min(key).alias("_b"))
    lev = best.select("name", "_b.similar_to", "_b.distance", "_b.method")
    return sc.unionByName(lev)
