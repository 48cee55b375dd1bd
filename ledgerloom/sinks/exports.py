"""Sinks: results as CSV and JSON, a resumable append, a ledger that is replaced whole, small Markdown tables."""

from __future__ import annotations

import json
import math
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a table for people may have.
REPORT_ROWS = 1000


def write_json(path: str, data: object) -> None:
    """NaN and infinities are errors, as they aren't JSON."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(data, ensure_ascii=False, indent=2, allow_nan=False), encoding="utf-8")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def append_missing(work: DataFrame, path: str, key: str = "id") -> int:
    """Append the rows whose key is not there yet, and say how many: a restarted run goes on where it was."""
    spark = work.sparkSession
    try:
        done = spark.read.schema(work.schema).json(path).select(key)
        work = work.join(done, key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    before = 0 if not _exists(spark, path) else spark.read.schema(work.schema).json(path).count()
    work.write.mode("append").json(path)
    return spark.read.schema(work.schema).json(path).count() - before


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def page_rows(results: DataFrame) -> DataFrame:
    """results: file, page, fields (map), revision (array). One row a page, fields side by side, notes joined."""
    from ledgerloom.schema import FIELDS

    return results.select("file", "page", *(F.element_at("fields", f).alias(f) for f in FIELDS), F.array_join("revision", "; ").alias("revision"))


def public_fields(results: DataFrame) -> DataFrame:
    """One row a field, with its confidence and no text that was read."""
    return results.select("file", "page", F.explode("fields").alias("field", "value"), "confidence").select("file", "page", "field", "value", F.coalesce(F.element_at("confidence", F.col("field")), F.lit("sin_valor")).alias("confidence"))


def batch_rows(batch: DataFrame) -> DataFrame:
    """batch: file, error, pages (array of struct page, fields, confidence). Files that failed keep one row."""
    return batch.select("file", "error", F.explode_outer("pages").alias("p")).select("file", "error", "p.page", "p.fields", F.when(F.col("p").isNotNull(), F.size(F.filter(F.map_values("p.confidence"), lambda c: c.isin("media", "baja", "sin_valor")))).alias("to_review"))


def spanish_number(x: Column, decimals: int = 1) -> Column:
    """1.234,5"""
    return F.translate(F.format_number(x, decimals), ",.", ".,")


def duration(seconds: Column) -> Column:
    whole = F.round(seconds).cast("long")
    return F.when(seconds < 60, F.concat(F.translate(F.format_number(seconds, 1), ".", ","), F.lit(" s"))).otherwise(F.concat(F.floor(whole / 60).cast("string"), F.lit(" min "), (whole % 60).cast("string"), F.lit(" s")))


def markdown(df: DataFrame, decimals: int = 2) -> str:
    """A table for people: whole floats as whole numbers, a decimal comma, an empty cell for null."""
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError("too many rows for a report")

    def cell(x: object) -> str:
        if x is None or isinstance(x, float) and math.isnan(x):
            return ""
        if isinstance(x, float):
            return str(int(x)) if x == int(x) else f"{x:.{decimals}f}".replace(".", ",")
        return str(x).replace("|", "\\|")

    lines = [df.columns, ["---"] * len(df.columns), *([cell(x) for x in r] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"


def replace_ledger(path: str, entries: dict[str, str]) -> None:
    """One writer at a time; readers see the old file or the new one."""
    lock = f"{path}.lock"
    fd = os.open(lock, os.O_CREAT | os.O_EXCL)
    try:
        known = json.loads(Path(path).read_text()) if Path(path).exists() else {}
        Path(f"{path}.tmp").write_text(json.dumps(known | entries, sort_keys=True))
        os.replace(f"{path}.tmp", path)
    finally:
        os.close(fd)
        os.unlink(lock)


def archive_kind(names: DataFrame) -> DataFrame:
    """names: archive, name. What an archive of results holds, told by its file names, and where each file goes."""
    has = lambda n: F.bool_or(F.col("name").endswith(n))
    kinds = names.groupBy("archive").agg(F.when(has("seleccion.json"), "tuning").when(has("summary.json"), "evaluation").otherwise("unknown").alias("kind"))
    private = F.col("name").rlike(r"(^|/)(errors\.csv|predictions\.jsonl)$")
    route = F.when(F.col("name").endswith(".png"), "figures").when(F.col("name").rlike(r"\.(csv|json)$"), "metrics").when(F.col("name").endswith(".md"), "reports")
    return names.where(~private).join(kinds, "archive").select("archive", "kind", "name", route.alias("folder")).where("folder is not null")


def reviewed_csv(ids: DataFrame) -> DataFrame:
    """ids such as a/b/c as three columns, in order."""
    p = F.split("id", "/", 3)
    return ids.select(F.try_element_at(p, F.lit(1)).alias("dataset"), F.try_element_at(p, F.lit(2)).alias("split"), F.try_element_at(p, F.lit(3)).alias("name")).orderBy("dataset", "split", "name")
