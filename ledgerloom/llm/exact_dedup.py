"""Exact duplicates by progressive refinement: length, then a prefix hash, then the full hash.

Only rows whose length occurs more than once get as far as the prefix hash, only rows that also share that reach the
full hash, and only those have their whole text read. What moves between tasks is a few numbers a row, never text.
Group sizes and the row that stays come from aggregates, which combine before the shuffle. Lengths and groups of more
than BIG rows, which are few, then meet their rows by a broadcast of checked size; the rows of smaller groups are
shuffled, so no group puts more than BIG rows into one task.

Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest id stays; of
rows that repeat id and text one stays, by place in the files. An empty table gives an empty result, and other
columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import ROW, ascii_lower, file_backed, materialise, with_row_key, without_rows

PREFIX_CHARS = 64
#: Rows of at most 8 longs, and as much again for the hash table, that may be broadcast: 64 MB. More are shuffled.
BROADCAST_ROWS = 500_000
#: Rows of a group that may meet in one task.
BIG = 1024


def _length(text: Column) -> Column:
    return F.octet_length(text).alias("len")


def _prefix(text: Column) -> Column:
    return F.xxhash64(ascii_lower(F.substring(text, 1, PREFIX_CHARS))).alias("pfx")


def content_hash(text: Column) -> Column:
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


def few(df: DataFrame) -> DataFrame:
    """``df`` materialised, and broadcast if its rows, counted, allow it."""
    df = materialise(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def alike(rows: DataFrame, keys: list[str], *found: Column) -> DataFrame:
    """Rows of groups of two and more, with what ``found`` aggregates of their group."""
    groups = materialise(rows.groupBy(*keys).agg(F.count("*").alias("size"), *found).where("size > 1"))
    big = few(groups.where(F.col("size") > BIG))
    marked = rows.join(big.withColumn("big", F.lit(True)), keys, "left")
    added = [c for c in groups.columns if c not in keys]
    small = marked.where("big is null").drop("big", *added).join(groups.where(F.col("size") <= BIG), keys)
    return marked.where("big").drop("big").select(*rows.columns, *added).unionByName(small.select(*rows.columns, *added))


def refine(keys: DataFrame, full: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of groups of two and more: ROW, id, keep (id, FILE_KEY, ROW_KEY of the row that stays) and size.

    keys: ROW, id, len, pfx. full: takes the surviving rows, adds their sha.
    """
    lengths = few(keys.groupBy("len").agg(F.count("*").alias("n")).where("n > 1").select("len"))
    same_prefix = alike(keys.join(lengths, "len", "left_semi"), ["len", "pfx"]).drop("size")
    hashed = materialise(full(same_prefix))
    return alike(hashed, ["len", "pfx", "sha"], F.max(F.struct("id", *ROW)).alias("keep")).select(*ROW, "id", "keep", "size")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the copies: all its columns, one row of each group of equal texts."""
    docs = file_backed(docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = materialise(with_row_key(docs, F.col(id_col).alias("id"), _length(text), _prefix(text)))

    def full(survivors: DataFrame) -> DataFrame:
        survivors = few(survivors)  # few enough: hash what survives, where it is read
        return with_row_key(docs, text.alias("text")).join(survivors, ROW).withColumn("sha", content_hash(F.col("text"))).drop("text")

    groups = refine(keys, full)
    return without_rows(docs, groups.where(~F.col("keep").eqNullSafe(F.struct("id", *ROW))).select(*ROW))


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Every row's full hash is asked for here, so it is taken in the one pass over the texts and kept beside the
    other two keys; the refinement reads it only for the rows that get that far.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    all_keys = materialise(with_row_key(docs, F.col(id_col).alias("id"), _length(text), _prefix(text), content_hash(text).alias("sha")))
    groups = refine(all_keys.drop("sha"), lambda survivors: survivors.join(all_keys.select(*ROW, "sha"), ROW))
    keep = F.col("keep")
    return all_keys.join(groups.select(*ROW, "keep", "size"), ROW, "left").select(
        F.col("id").alias("doc_id"),
        F.when(keep.isNull(), F.col("id")).otherwise(keep["id"]).alias("keep_id"),
        F.coalesce("size", F.lit(1)).alias("group_size"),
        (keep.isNull() | keep.eqNullSafe(F.struct("id", *ROW))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
