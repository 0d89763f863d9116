from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantaint.operators.numbering import number_rows


def _rows(spark):
    return spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 50 != 1, F.col("id") % 40).alias("g"),
        F.xxhash64("id").alias("a"),
        F.col("id").alias("b"),
    )


def test_a_group_over_several_pieces_gets_the_numbers_of_a_window(spark):
    rows = _rows(spark)
    by_window = F.row_number().over(Window.partitionBy("g").orderBy("a", "b")).cast("bigint")
    numbered = number_rows(rows, ["g"], ["a", "b"], "n")
    assert {tuple(r) for r in numbered.collect()} == {tuple(r) for r in rows.withColumn("n", by_window).collect()}


def test_one_group_of_all_rows(spark):
    found = number_rows(_rows(spark), [], ["a"], "n").orderBy("n").collect()
    assert [r.n for r in found] == list(range(1, 5001))
    assert [r.a for r in found] == sorted(r.a for r in found)


def test_ties_get_distinct_numbers_and_no_rows_none(spark):
    rows = spark.range(100).select(F.lit("x").alias("g"), F.lit(1).alias("a"))
    assert sorted(r.n for r in number_rows(rows, ["g"], ["a"], "n").collect()) == list(range(1, 101))
    assert number_rows(rows.limit(0), ["g"], ["a"], "n").isEmpty()
