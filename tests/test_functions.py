"""Skew-safe ranking and size-checked joins against their plain forms."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from chainscope.functions import js
from chainscope.functions.ranking import group_rank, top_k_per_group


def test_group_rank_matches_row_number_at_size(spark, tmp_path):
    # a hot group, a null group, a payload column, written out
    df = spark.range(0, 300_000).select(
        F.when(F.col("id") % 10 < 7, F.lit("hot")).when(F.col("id") % 10 == 8, F.concat(F.lit("g"), (F.col("id") % 13).cast("string"))).alias("g"),
        (F.col("id") % 97).alias("score"), "id", F.repeat(F.lit("x"), 20).alias("payload"))
    order = [F.col("score").desc(), F.col("id")]
    group_rank(df.repartition(9), ["g"], order, lead=[(F.col("score"), True), (F.floor(F.col("id") / 1000), False)]).write.parquet(str(tmp_path / "ranked"))
    got = spark.read.parquet(str(tmp_path / "ranked"))
    want = df.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("bigint"))
    assert got.count() == 300_000
    assert got.join(want.select("id", "want"), "id").where("rank <> want").count() == 0


def test_top_k(spark):
    df = spark.range(0, 1000).select((F.col("id") % 3).alias("g"), F.col("id"))
    got = top_k_per_group(df, ["g"], [F.col("id").desc()], 2).select("g", "id", "rank").collect()
    assert sorted(map(tuple, got)) == [(0, 996, 2), (0, 999, 1), (1, 994, 2), (1, 997, 1), (2, 995, 2), (2, 998, 1)]


def test_js_rounding_and_numbers(spark):
    row = spark.range(1).select(
        js.js_round(F.lit(-2.5)).alias("a"), js.js_round(F.lit(2.5)).alias("b"),
        js.round1(F.lit(3.05)).alias("c"), js.js_num(F.lit(10.0)).alias("d"), js.js_num(F.lit(3.5)).alias("e"),
        js.js_trim(F.lit("  x \t\r")).alias("f")).first()
    assert (row.a, row.b, row.d, row.e, row.f) == (-2, 3, "10", "3.5", "x")


def test_resolve_path(spark):
    cases = {"/srv/app/../../etc": "/etc", "/tmp/./x/": "/tmp/x", "/": "/", "/..": "/", "": "/", "a//b": "/a/b",
             "/a/b/..": "/a", "/a/...": "/a/..."}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "p string")
    got = {r.p: r.q for r in df.select("p", js.resolve_path(F.col("p")).alias("q")).collect()}
    assert {k: v for k, v in got.items() if k is not None} == cases
