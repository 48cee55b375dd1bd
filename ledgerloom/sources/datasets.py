"""Sources of documents, annotations and readings; every schema is declared, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.schema import FIELDS, MANIFEST, OCR_TSV, PREDICTION, STATUSES


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object a line; blank lines and a byte order mark are passed over, a broken line is an error."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, MANIFEST)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, PREDICTION)


def csv_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """With a header; a byte order mark before it is passed over."""
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=True)


def ocr_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A reading engine's word table: words only, boxes from sizes, a line id of page, block, paragraph and line."""
    t = spark.read.csv(path, schema=OCR_TSV, sep="\t", quote="", header=True, mode="FAILFAST", enforceSchema=False)
    words = t.where((F.col("level") == "5") & (F.trim("text") != ""))
    return words.select("text", F.array("left", "top", F.col("left") + F.col("width"), F.col("top") + F.col("height")).alias("box"), F.col("conf").alias("confidence"), F.concat_ws(":", "page_num", "block_num", "par_num", "line_num").alias("line_id"))


def box_lines(lines: DataFrame) -> DataFrame:
    """lines: id, line. Eight coordinates and a text that may hold commas; box is null where the line is malformed."""
    p = F.split("line", ",", 9)
    at = F.transform(F.slice(p, 1, 8), lambda x: F.trim(x).try_cast("double"))
    good = (F.size(p) == 9) & ~F.exists(at, lambda x: x.isNull())
    xs, ys = F.filter(at, lambda _, i: i % 2 == 0), F.filter(at, lambda _, i: i % 2 == 1)
    box = F.when(good, F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))
    return lines.where(F.trim("line") != "").select("id", box.alias("box"), F.when(good, F.element_at(p, 9)).alias("text"), F.when(~good, "invalid_box_line").alias("issue"))


def entities(files: DataFrame) -> DataFrame:
    """files: id, content. Date and total of an entity file; empty is unannotated, broken is an issue."""
    parsed = F.from_json("content", "date string, total string, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    e = files.select("id", parsed.alias("e"))
    state = lambda c: F.struct(F.when(F.trim(F.col(f"e.{c}")) != "", "annotated").otherwise("unannotated").alias("status"), F.nullif(F.trim(F.col(f"e.{c}")), F.lit("")).alias("value"))
    return e.select("id", state("date").alias("date"), state("total").alias("total"), F.when(F.col("e.broken").isNotNull(), "invalid_entities").alias("issue"))


def class_list(spark: SparkSession, path: str) -> DataFrame:
    """code and name, parted by the first run of spaces."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.element_at(F.split(F.trim("value"), r"\s+", 2), 1).cast("int").alias("code"), F.element_at(F.split(F.trim("value"), r"\s+", 2), 2).alias("name"))


PHOTO = "file_name string, width int, height int, annotations array<struct<box: array<double>, label: int, text: string>>"


def photo_regions(spark: SparkSession, root: str, split: str) -> DataFrame:
    """Annotated regions with class names; a class list without the four labels in use is an error."""
    classes = class_list(spark, f"{root}/class_list.txt")
    need = ["Date_value", "Subtotal_value", "Tax_value", "Total_value"]
    missing = set(need) - {r["name"] for r in classes.where(F.col("name").isin(need)).collect()}  # four rows at most
    if missing:
        raise ValueError(f"class list lacks {sorted(missing)}")
    facts = jsonl(spark, f"{root}/{split}.txt", PHOTO).select("file_name", F.posexplode("annotations").alias("n", "a"))
    return facts.select("file_name", "n", "a.box", "a.text", F.col("a.label").alias("code")).join(classes, "code", "left").drop("code")


def scan_pairs(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Both sides by split and stem; a side that is missing becomes an issue."""
    both = images.join(annotations, ["split", "stem"], "full_outer")
    return both.withColumn("issues", F.array_compact(F.array(F.when(F.col("image").isNull(), "missing_image"), F.when(F.col("entities").isNull(), "missing_entities"))))


_HIGH = "".join(map(chr, range(0x80, 0xA0)))
_CP1252 = "".join(bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0))


def decode_text(content: Column) -> Column:
    """UTF-8 where it is valid, else Windows-1252; issue tells which. ``content`` is binary."""
    utf = F.is_valid_utf8(content.cast("string"))
    return F.struct(F.when(utf, F.regexp_replace(content.cast("string"), "^﻿", "")).otherwise(F.translate(F.decode(content, "iso-8859-1"), _HIGH, _CP1252)).alias("text"), F.when(~utf, "encoding_fallback_cp1252").alias("issue"))


def under_root(path: Column, root: str) -> Column:
    """No way out of the root: relative, and no step up."""
    return ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")


def file_checks(files: DataFrame, kinds: tuple[str, ...] = ("jpg", "jpeg", "png", "pdf"), max_mb: float = 20) -> DataFrame:
    """files: path, length. The first thing that rules a file out, or null."""
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    reason = F.when(~ending.isin(*kinds), "format").when(F.col("length") == 0, "empty").when(F.col("length") > max_mb * 1024 * 1024, "too_large")
    return files.withColumn("reason", reason)


def external_test(rows: DataFrame) -> DataFrame:
    """Manifest rows from outside: what is wrong with each, as a list; a repeated id counts against all its rows."""
    from pyspark.sql import Window

    each = F.map_entries("gold")
    bad = F.array_compact(F.array(
        F.when(F.exists(each, lambda e: ~e["key"].isin(*FIELDS)), "unknown_field"),
        F.when(F.exists(each, lambda e: ~e["value"]["status"].isin(*(s for s in STATUSES if s != "ambiguous"))), "unknown_status"),
        F.when(F.exists(each, lambda e: (e["value"]["status"] == "annotated") & (F.coalesce(F.trim(e["value"]["value"]), F.lit("")) == "")), "empty_annotation"),
        F.when(F.exists(each, lambda e: (e["value"]["status"] == "absent") & e["value"]["value"].isNotNull()), "absent_with_value"),
        F.when(~F.exists(each, lambda e: e["value"]["status"] == "annotated"), "nothing_annotated"),
        F.when(F.count("*").over(Window.partitionBy("id")) > 1, "repeated_id"),
    ))
    return rows.withColumn("errors", bad)


def find_datasets(paths: DataFrame) -> DataFrame:
    """paths: path. Folders that hold a scan set or a photo set, told by what is in them."""
    scan = F.regexp_extract("path", r"^(.*)/train/(entities|img|box)/[^/]+$", 1)
    photo = F.regexp_extract("path", r"^(.*)/(class_list\.txt|train\.txt|test\.txt)$", 1)
    part = lambda rule, k: F.regexp_extract("path", rule, k)
    a = paths.where(scan != "").groupBy(scan.alias("root")).agg(F.collect_set(part(r"/train/(entities|img|box)/", 1)).alias("has")).where(F.size("has") == 3).select("root", F.lit("scan").alias("kind"))
    b = paths.where(photo != "").groupBy(photo.alias("root")).agg(F.collect_set(part(r"/([^/]+)$", 1)).alias("has")).where(F.size("has") == 3).select("root", F.lit("photo").alias("kind"))
    return a.unionByName(b)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of id to hash, one row each."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "sha256"))
