"""Comparing and reshaping predictions.

Long tables have (path, start_s, end_s, species, confidence), and a rank where
order matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INTERVAL = ["path", "start_s", "end_s"]


def close(a: Column, b: Column, decimals: int) -> Column:
    """Within 10**-decimals, or within the 1e-9 part of the larger."""
    a, b = a.cast("double"), b.cast("double")
    return F.abs(a - b) <= F.greatest(F.lit(10.0**-decimals), F.lit(1e-9) * F.greatest(F.abs(a), F.abs(b)))


def differences(left: DataFrame, right: DataFrame, *, decimals: int = 5, keys: list[str] | None = None) -> DataFrame:
    """Rows on one side only, and rows whose confidences are not close."""
    keys = keys or [*INTERVAL, "species"]
    both = left.select(*keys, F.col("confidence").alias("left_confidence"), F.lit(True).alias("in_left")).join(right.select(*keys, F.col("confidence").alias("right_confidence"), F.lit(True).alias("in_right")), keys, "full")
    same = F.coalesce(F.col("in_left") & F.col("in_right") & close(F.col("left_confidence"), F.col("right_confidence"), decimals), F.lit(False))
    return both.where(~same).select(*keys, "left_confidence", "right_confidence")


def equal(left: DataFrame, right: DataFrame, *, decimals: int = 5) -> bool:
    """Whether both tables hold the same predictions, each in order."""
    return differences(left, right, decimals=decimals).isEmpty() and misordered(left).isEmpty() and misordered(right).isEmpty()


def misordered(rows: DataFrame) -> DataFrame:
    """Predictions that rank behind one of lower confidence, or of the same
    confidence and a later name."""
    order = Window.partitionBy(*INTERVAL).orderBy("rank")
    seen = rows.where("species is not null").select("*", F.lag("confidence").over(order).alias("before"), F.lag("species").over(order).alias("name_before"))
    wrong = (F.col("before") < F.col("confidence")) | (F.col("before") == F.col("confidence")) & (F.col("name_before") > F.col("species"))
    return seen.where(wrong).drop("before", "name_before")


def misordered_intervals(rows: DataFrame, *, index: str = "chunk_idx") -> DataFrame:
    """Intervals that start no later than the one before them."""
    order = Window.partitionBy("path").orderBy(index)
    return rows.withColumn("before", F.lag("start_s").over(order)).where("before >= start_s").drop("before")


def occurring(rows: DataFrame) -> DataFrame:
    """Sorted species that occur."""
    return rows.where("species is not null").select("species").distinct().orderBy("species")


def matrix_long(rows: DataFrame, *, index: str = "chunk_idx", species: list[str]) -> DataFrame:
    """The same as rows of (species, index, confidence), for every interval that
    ``rows`` has, however many there are."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(s,) for s in species], "species string")
    every = rows.select(index).distinct().select(index, F.explode(F.array(*map(F.lit, species))).alias("species")) if species else rows.select(index, F.lit("").alias("species")).limit(0)
    first = rows.join(F.broadcast(names), "species").groupBy(index, "species").agg(F.max("confidence").alias("confidence"))
    return every.join(first, [index, "species"], "left").na.fill(0.0, ["confidence"])


def matrix(rows: DataFrame, columns: list, *, species: list[str] | None = None, index: str = "chunk_idx") -> DataFrame:
    """Species by interval, 0 where a species is absent.

    ``columns`` are the intervals' indices, in order: naming them spares the
    pass that would find them.  ``species`` fixes the rows and their order."""
    spark = rows.sparkSession
    wide = rows.where("species is not null").groupBy("species").pivot(index, columns).agg(F.first("confidence"))
    if species is not None:
        if not species:
            raise NotImplementedError("a matrix of no species")
        order = spark.createDataFrame(list(enumerate(species)), "place int, species string")
        wide = order.join(wide, "species", "left").orderBy("place").drop("place")
    else:
        wide = wide.orderBy("species")
    return wide.na.fill(0.0)


def distinct_in_order(rows: DataFrame, value: str, position: str) -> DataFrame:
    """First position of each value, by position."""
    return rows.groupBy(value).agg(F.min(position).alias(position)).orderBy(position)


def subset(values: Column, labels: list[str]) -> Column:
    """Whether all of an array's values are labels."""
    return F.size(F.array_except(values, F.array(*map(F.lit, labels)))) == 0


def unknown(wanted: DataFrame, labels: DataFrame, column: str = "species") -> DataFrame:
    """Wanted values that are no label."""
    return wanted.join(labels, column, "left_anti")


def nonzero(rows: DataFrame, column: str) -> DataFrame:
    """Number of values other than 0, and above 0."""
    return rows.agg(F.count_if(F.col(column) != 0).alias("nonzero"), F.count_if(F.col(column) > 0).alias("positive"))
