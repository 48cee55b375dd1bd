"""Splits, samples and leakage control by seeded hashes: the same whatever the partitioning.

Rows: id, dataset, source_split, sha256. A hash that repeats is a copy of the same image or text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1): the first 32 bits of SHA-256 of "seed:key"."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 8), 16, 10).cast("long") / 4294967296.0


def seeded_order(key: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)


def hash_split(rows: DataFrame, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds split and issues. Test stays test; the rest goes to validation or train by its hash. Copies of a test row,
    and all but the first of equal rows (test first, then by id), go to quarantine."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie between 0 and 1")
    is_test = F.col("source_split") == "test"
    same = Window.partitionBy("sha256")
    first = F.row_number().over(same.orderBy(~is_test, "id")) == 1
    marked = rows.withColumns({"__test_copy": F.bool_or(is_test).over(same) & F.col("sha256").isNotNull() & ~is_test, "__again": ~first & F.col("sha256").isNotNull()})
    part = F.when(is_test, "test").when(unit_hash(F.coalesce("sha256", "id"), seed) < fraction, "validation").otherwise("train")
    split = F.when(F.col("__test_copy") | F.col("__again"), "quarantine").otherwise(part)
    issues = F.array_compact(F.array(F.when(F.col("__test_copy"), "duplicate_in_official_test"), F.when(F.col("__again"), "duplicate_image_hash")))
    return marked.withColumn("split", split).withColumn("issues", issues).drop("__test_copy", "__again")


def first_of_copies(rows: DataFrame, *order: Column | str) -> DataFrame:
    """One row of each hash; rows without one are copies of nothing and all stay."""
    some = rows.where(F.col("sha256").isNotNull()).withColumn("__n", F.row_number().over(Window.partitionBy("sha256").orderBy(*order))).where("__n = 1").drop("__n")
    return some.unionByName(rows.where(F.col("sha256").isNull()))


def unseen_inventory(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """rows with split; seen: id, sha256 that were reviewed. Every test row with the first reason that rules it out."""
    test = rows.where("source_split = 'test'")
    ids = seen.select("id", F.lit(True).alias("__id")).distinct()
    hashes = seen.select("sha256", F.lit(True).alias("__hash")).distinct()
    dev = rows.where("source_split <> 'test'").select("sha256", F.lit(True).alias("__dev")).distinct()
    joined = test.join(ids, "id", "left").join(hashes, "sha256", "left").join(dev, "sha256", "left")
    reason = F.when(F.col("split") != "test", "not_eligible").when(F.col("__id"), "id_reviewed").when(F.col("__hash"), "image_reviewed").when(F.col("__dev"), "copy_of_development")
    known = joined.withColumn("reason", reason)
    again = F.row_number().over(Window.partitionBy("sha256", F.col("reason").isNull()).orderBy("dataset", "id")) > 1
    return known.withColumn("__again", again).select("id", "dataset", "sha256", F.when(F.col("reason").isNull() & F.col("__again"), "copy_within_test").otherwise(F.col("reason")).alias("reason"))


def seeded_sample(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n of each dataset, in the order of a seeded hash, no hash twice."""
    unique = first_of_copies(rows, seeded_order(F.col("id"), seed), "id")
    order = Window.partitionBy("dataset").orderBy(seeded_order(F.col("id"), seed), "id")
    return unique.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def disjoint_samples(rows: DataFrame, n_first: int, n_second: int, seed: int = 42) -> DataFrame:
    """Two samples that share nothing: an optimisation set and a control set of each dataset."""
    drawn = seeded_sample(rows, n_first + n_second, seed)
    return drawn.withColumn("part", F.when(F.col("place") <= n_first, "optimisation").otherwise("control"))


def leak_matrix(rows: DataFrame) -> DataFrame:
    """Hashes shared by each pair of splits."""
    a = rows.select("sha256", F.col("split").alias("a")).distinct()
    return a.join(a.withColumnRenamed("a", "b"), "sha256").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def sample_signature(rows: DataFrame) -> DataFrame:
    """SHA-256 over sorted (id, sha256): hashed in 4096 ranges first, so no task sorts the whole table."""
    part = F.conv(F.substring(F.sha2("id", 256), 1, 3), 16, 10).cast("int")
    parts = rows.groupBy(part.alias("part")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("id", "sha256"))), ""), 256).alias("h"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), ""), 256).alias("signature"))
