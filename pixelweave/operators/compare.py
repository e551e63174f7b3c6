"""Comparison of results: sizes, graded differences, overlap of labelings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: lower ends of the grades 0 to 3; grade 4 is the rest
GRADES = (0.1, 0.05, 0.01, 0.005)


def same_size(test: DataFrame, ref: DataFrame) -> DataFrame:
    """(n_test, n_ref, same)."""
    sides = test.select(F.lit(1).alias("t")).unionByName(ref.select(F.lit(0).alias("t")))
    return sides.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("n_test"), F.coalesce(F.sum(1 - F.col("t")), F.lit(0)).alias("n_ref")).withColumn("same", F.col("n_test") == F.col("n_ref"))


def grade(difference: Column) -> Column:
    """The first grade whose end is reached; not-a-number and null are the last."""
    out = F.lit(len(GRADES))
    for k in range(len(GRADES) - 1, -1, -1):
        out = F.when(difference >= GRADES[k], k).otherwise(out)
    return F.when(difference.isNull() | F.isnan(difference), len(GRADES)).otherwise(out)


def relative_difference(test: Column, ref: Column) -> Column:
    """abs(test - ref) / ref as floating point has it: 0/0 is not a number, x/0 infinite, below 0 negative."""
    gap = F.abs(test - ref)
    at_zero = F.when(gap > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return F.when(ref == 0, at_zero).otherwise(F.try_divide(gap, ref))


def _shares(graded: DataFrame) -> DataFrame:
    """(grade, cnt, share) with a row for every grade."""
    spark = graded.sparkSession
    names = spark.range(len(GRADES) + 1).select(F.col("id").cast("int").alias("grade"))
    counts = graded.groupBy("grade").agg(F.count("*").alias("cnt"))
    filled = names.join(F.broadcast(counts), "grade", "left").select("grade", F.coalesce("cnt", F.lit(0)).alias("cnt"))  # five rows
    total = graded.agg(F.count("*").alias("total"))
    return filled.join(F.broadcast(total)).select("grade", "cnt", F.when(F.col("total") > 0, F.col("cnt") / F.col("total")).otherwise(F.lit(0.0)).alias("share"))


def difference_grades(values: DataFrame) -> DataFrame:
    """Grades of ``(test, ref)`` pairs."""
    return _shares(values.select(grade(relative_difference(F.col("test").cast("double"), F.col("ref").cast("double"))).alias("grade")))


def contingency(pairs: DataFrame) -> DataFrame:
    """(ref, test, cnt) of label pairs; further columns of ``pairs`` group too."""
    by = [c for c in pairs.columns if c not in ("ref", "test")]
    return pairs.groupBy(*by, "ref", "test").agg(F.count("*").alias("cnt"))


def overlap_differences(table: DataFrame) -> DataFrame:
    """Per reference label, one minus the share of its largest overlap."""
    by = [c for c in table.columns if c not in ("ref", "test", "cnt")]
    return table.groupBy(*by, "ref").agg((1.0 - F.max("cnt") / F.sum("cnt")).alias("difference"))


def overlap_grades(table: DataFrame) -> DataFrame:
    """Grades of the reference labels' differences."""
    return _shares(overlap_differences(table).select(grade(F.col("difference")).alias("grade")))
