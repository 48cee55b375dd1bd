"""Exploratory statistics: coverage, cross tables, quantiles, outliers, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage(gold: DataFrame) -> DataFrame:
    """gold: dataset, field, status."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = gold.groupBy("dataset", "field").agg(F.count("*").alias("documents"), count("annotated"), count("unannotated"), count("ambiguous"))
    return out.withColumn("coverage", F.col("annotated") / F.col("documents"))


def crosstab(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """Counts with margins, from one rollup of both keys."""
    cube = df.cube(row, col).agg(F.count("*").alias("n"), F.grouping(row).alias("gr"), F.grouping(col).alias("gc"))
    named = cube.select(F.when(F.col("gr") == 1, "All").otherwise(F.col(row).cast("string")).alias(row), F.when(F.col("gc") == 1, "All").otherwise(F.col(col).cast("string")).alias("__c"), "n")
    return named.groupBy(row).pivot("__c", [*values, "All"]).agg(F.sum("n")).na.fill(0)


def describe(df: DataFrame, by: str, value: str) -> DataFrame:
    q = lambda p: F.percentile(value, F.lit(p))
    return df.groupBy(by).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"), F.max(value).alias("max"))


def iqr_outliers(df: DataFrame, by: str, value: str) -> DataFrame:
    """Values beyond one and a half quartile ranges: limits, count and share."""
    limits = df.groupBy(by).agg(F.percentile(value, F.lit(0.25)).alias("q1"), F.percentile(value, F.lit(0.75)).alias("q3"))
    limits = limits.select(by, (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("low"), (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("high"))
    joined = df.join(limits, by)
    out = (F.col(value) < F.col("low")) | (F.col(value) > F.col("high"))
    return joined.groupBy(by, "low", "high").agg(F.count_if(out).alias("outliers"), (F.avg(out.cast("double")) * 100).alias("pct"))


def average_rank(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> Column:
    """Rank with ties at their mean."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0


def spearman(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """Within each group: ranks are windows of a group, never of the whole table."""
    ranked = df.select(by, average_rank(df, x, (by,)).alias("rx"), average_rank(df, y, (by,)).alias("ry"))
    return ranked.groupBy(by).agg(F.corr("rx", "ry").alias("rho"), F.count("*").alias("n"))


def tercile(rank: Column, n: Column) -> Column:
    """Cuts at linear quantiles of 1..n, which ntile(3) gets wrong where n mod 3 is 2."""
    return F.when(rank <= 1 + (n - 1) / 3.0, 1).when(rank <= 1 + 2 * (n - 1) / 3.0, 2).otherwise(3)


def terciles(df: DataFrame, by: str, value: str, tie: str) -> DataFrame:
    w = Window.partitionBy(by)
    r = df.withColumn("r", F.row_number().over(w.orderBy(value, tie))).withColumn("n", F.count("*").over(w))
    return r.withColumn("tercil", tercile(F.col("r"), F.col("n"))).drop("r", "n")


def pattern_of(s: Column) -> Column:
    """Letters to A, digits to 9."""
    return F.regexp_replace(F.regexp_replace(s, "[A-Za-z]", "A"), "[0-9]", "9")


def top_per_group(df: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= k)


def histogram(df: DataFrame, by: str, value: Column, bins: int) -> DataFrame:
    return df.groupBy(by, F.least(F.lit(bins - 1), F.floor(value * bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def otsu(hist: DataFrame, by: str) -> DataFrame:
    """hist: by, bin, n. The bin that parts a histogram with the most variance between its sides; the first of equals."""
    w = Window.partitionBy(by).orderBy("bin")
    whole = Window.partitionBy(by)
    c = hist.withColumns({"w0": F.sum("n").over(w).cast("double"), "m0": F.sum(F.col("n") * F.col("bin")).over(w).cast("double"), "wt": F.sum("n").over(whole).cast("double"), "mt": F.sum(F.col("n") * F.col("bin")).over(whole).cast("double")})
    diff = F.try_divide(F.col("m0"), F.col("w0")) - F.try_divide(F.col("mt") - F.col("m0"), F.col("wt") - F.col("w0"))
    between = F.coalesce(F.col("w0") * (F.col("wt") - F.col("w0")) * diff * diff, F.lit(0.0))
    return c.withColumn("v", F.round(between / (F.col("wt") * F.col("wt")), 9)).groupBy(by).agg(F.min_by("bin", F.struct(-F.col("v"), "bin")).alias("threshold"))
