"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters. ``bytes.split()`` cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"

#: Input rows for one shuffle partition of slim rows; partition counts grow with the data by this.
ROWS_PER_PARTITION = 1 << 20

FILE_KEY, ROW_KEY, DOC = "__file_key", "__row_key", "__doc"
ROW = [FILE_KEY, ROW_KEY]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and all is local (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    there = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not there.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-"))
        there = spark.sparkContext._jsc.sc().getCheckpointDir()
    return there.get().rstrip("/")


_written: list[str] = []


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    Unlike a cached table this survives the loss of executors, and the next plan sees true sizes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget_materialised(spark: SparkSession) -> int:
    """Delete the tables that this process has materialised; call it once no DataFrame of theirs is needed."""
    n = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


#: Plans that keep one output row for each row of a file's scan, or drop some by a rule on the row alone.
_ROW_BY_ROW = ("Project", "Filter", "SubqueryAlias", "View", "ResolvedHint")


def _bare_scan(docs: DataFrame) -> bool:
    """Whether the rows come from one scan of files, each at most once, by steps that give the same rows every time."""
    plan = docs._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in _ROW_BY_ROW and plan.children().size() == 1:
        plan = plan.children().head()
    files = docs.inputFiles() if plan.children().isEmpty() else []
    return len(files) > 0 and len(set(files)) == len(files)


def file_backed(docs: DataFrame) -> DataFrame:
    """``docs`` itself if its rows come straight from files, else as written and read back once.

    An explode, join or union of a scan still offers the scan's metadata, but one file row may then stand in several.
    """
    if _bare_scan(docs):
        try:
            docs.select(docs.metadataColumn("_metadata")["row_index"]).schema  # noqa: B018  analysis happens here
            return docs
        except AnalysisException:  # text and JSON readers number no rows
            pass
    return materialise(docs)


def with_row_key(docs: DataFrame, *columns: Column) -> DataFrame:
    """FILE_KEY and ROW_KEY, which name a row of a file for good, and ``columns`` of ``docs``, or all of its own as one
    struct, DOC, so that no name of theirs can clash with any in use here.

    The keys come from the reader's metadata, so unlike monotonically_increasing_id they stay the same when a lost
    executor changes how files are split. To name the same rows twice, call this twice on one file_backed() frame.
    """
    docs = file_backed(docs)
    meta = docs.metadataColumn("_metadata")
    keys = [F.xxhash64(meta["file_path"]).alias(FILE_KEY), meta["row_index"].alias(ROW_KEY)]
    return docs.select(*keys, *(columns or [F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias(DOC)]))


#: Masks of 64 rows each that may be broadcast: 24 bytes and their place in a hash table, 100 MB at most.
BROADCAST_MASKS = 1 << 20


def row_masks(rows: DataFrame, *flags: Column) -> DataFrame:
    """rows: ROW. Rows of a file by 64: FILE_KEY, part, and for each flag a mask with the bits of its rows."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col(ROW_KEY), F.lit(64)).cast("int"))
    masks = [F.bit_or(F.when(f, bit).otherwise(F.lit(0).cast("long"))).alias(f"m{k}") for k, f in enumerate(flags)]
    return rows.groupBy(F.col(FILE_KEY).alias("mask_file"), F.expr(f"{ROW_KEY} div 64").alias("mask_part")).agg(*masks)


def with_masks(docs: DataFrame, masks: DataFrame) -> DataFrame:
    """DOC of every row of ``docs``, and for each mask f0, f1, ..: whether the row's bit is set.

    Whole rows do not move while the masks are few: a table a thousandth of the rows' size goes to the executors, if its
    counted rows allow. Beyond that both sides are shuffled.
    """
    masks = materialise(masks)
    side = F.broadcast(masks) if masks.count() <= BROADCAST_MASKS else masks
    named = with_row_key(docs)
    joined = named.join(side, (F.col(FILE_KEY) == F.col("mask_file")) & (F.expr(f"{ROW_KEY} div 64") == F.col("mask_part")), "left")
    place = F.pmod(F.col(ROW_KEY), F.lit(64)).cast("int")
    names = [c for c in masks.columns if c.startswith("m") and c[1:].isdigit()]
    test = lambda c: F.coalesce(F.call_function("shiftrightunsigned", F.col(c), place).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(False))
    return joined.select(DOC, *(test(c).alias(f"f{c[1:]}") for c in names))


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows that ``gone`` (ROW) names, with all its columns."""
    return with_masks(docs, row_masks(gone, F.lit(True))).where("not f0").select(f"{DOC}.*")


def ascii_lower(text: Column) -> Column:
    """A-Z only. ``lower`` would change other scripts too and is used where it changes the same letters."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_in(text: Column) -> Column:
    """How many words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hashed_sample(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """About ``n`` rows, all if there are no more: those whose hash lies below a cut that a count sets.

    An ordered limit would bring n rows of every task together; this brings n in all, however many tasks there are.
    Rows that agree in all of ``by`` share a hash; should they be very many, a limit of 2 n holds.
    """
    rows = df.count()
    if rows <= n:
        return df
    return df.where(F.pmod(F.xxhash64(*by), F.lit(1 << 40)) < int((1 << 40) * n / rows)).limit(2 * n)


def give_back() -> None:
    """Return freed memory of a Python worker to the machine: the worker outlives the task and other stages need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def keep_freed() -> None:
    """Keep freed memory of a Python worker for its next arrays, until give_back(): pages that go back to the machine after
    each array cost more than the work on them."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 256 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def parts_for(rows: int, per_part: int = ROWS_PER_PARTITION) -> int:
    return max(1, -(-rows // per_part))
