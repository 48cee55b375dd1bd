"""Reserves for experiments, what configurations cost, and which one wins.

Manifest rows: id, dataset, source_split, split, sha256. seen: id, sha256 of documents that were looked at before.
Draws are by seeded hashes, so the same rows come whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.sampling import first_of_copies, seeded_order, unseen_inventory

#: Issues that make a page's transcription useless as a reference.
NO_REFERENCE = ("invalid_box", "invalid_box_line", "invalid_annotation", "missing_transcription")


def _drawn(rows: DataFrame, n: int, seed: int) -> DataFrame:
    if n <= 0:
        raise ValueError("a sample needs a positive size")
    order = Window.partitionBy("dataset").orderBy(seeded_order(F.col("id"), seed), "id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def _flag(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).select(key, F.lit(True).alias(name)).distinct()


def not_reviewed(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Training rows with reason, the first rule that leaves a row out; null for those that may be drawn."""
    marked = rows.where("split = 'train'").join(_flag(seen, "id", "__id"), "id", "left").join(_flag(seen, "sha256", "__hash"), "sha256", "left")
    marked = marked.join(_flag(rows.where("split <> 'train'"), "sha256", "__other"), "sha256", "left")
    marked = marked.withColumn("reason", F.when(F.col("__id") | F.col("__hash"), "ya_revisado").when(F.col("__other"), "imagen_en_otra_particion"))
    first = marked.where("reason is null and sha256 is not null").groupBy("sha256").agg(F.min(F.struct("dataset", "id")).alias("__first"))
    again = F.col("reason").isNull() & (F.struct("dataset", "id") != F.col("__first"))
    return marked.join(first, "sha256", "left").select("id", "dataset", "sha256", F.when(again, "imagen_duplicada").otherwise(F.col("reason")).alias("reason"))


def random_unseen(rows: DataFrame, seen: DataFrame, n: int, seed: int) -> DataFrame:
    """n test rows of each dataset that nobody has seen, without replacement; append them to the ledger before use."""
    free = unseen_inventory(rows, seen).where("reason is null")
    return _drawn(free, n, seed)


def known_sample(rows: DataFrame, n: int, seed: int, previous: DataFrame | None = None) -> DataFrame:
    """n test rows of each dataset, seen before or not, one for each image and none that training has.

    ``previous``: ids of the last sample. Should the draw be just that, the next seeds are tried until it is another; a
    pool that the sample takes whole can give no other, which is an error.
    """
    train = _flag(rows.where("source_split <> 'test'"), "sha256", "__train").select("sha256")
    pool = first_of_copies(rows.where("source_split = 'test' and split = 'test'").join(train, "sha256", "left_anti"), "dataset", "id")
    chosen = _drawn(pool, n, seed)
    if previous is None:
        return chosen
    ids = lambda df: df.select("id").distinct()
    same = lambda df: ids(df).exceptAll(ids(previous)).isEmpty() and ids(previous).exceptAll(ids(df)).isEmpty()
    if not same(chosen):
        return chosen
    if pool.join(ids(chosen), "id", "left_anti").isEmpty():
        raise ValueError("the sample takes the whole pool: ask for fewer rows")
    while same(chosen):
        seed += 1
        chosen = _drawn(pool, n, seed)
    return chosen


def curve_subsamples(docs: DataFrame, fractions: tuple[float, ...], seeds: tuple[int, ...], least: int = 5) -> DataFrame:
    """docs: id. Rows (seed, fraction, id) of growing parts of the documents; parts of one seed hold one another."""
    each = docs.select("id", F.explode(F.array(*map(F.lit, seeds))).alias("seed"))
    order = F.sha2(F.concat(F.col("seed").cast("string"), F.lit(":"), "id"), 256)
    ranked = each.withColumn("place", F.row_number().over(Window.partitionBy("seed").orderBy(order, "id")))
    sized = ranked.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n"))))  # one row
    parts = sized.withColumn("fraction", F.explode(F.array(*map(F.lit, fractions))))
    return parts.where(F.col("place") <= F.greatest(F.lit(least), F.floor(F.col("fraction") * F.col("n")))).select("seed", "fraction", "id")


def view_times(timed: DataFrame) -> DataFrame:
    """timed: id, dataset, view, ms. Sum and median of each view by dataset."""
    return timed.groupBy("dataset", "view").agg(F.count("*").alias("n"), F.sum("ms").alias("ms"), F.percentile("ms", F.lit(0.5)).alias("mediana_ms"))


def configuration_cost(timed: DataFrame, configurations: dict[str, list[int]]) -> DataFrame:
    """Median over documents of what the views of each configuration take; documents with none of them cost nothing."""
    views = [F.struct(F.lit(k).alias("name"), F.array(*map(F.lit, v)).alias("views")) for k, v in configurations.items()]
    sums = [F.sum(F.when(F.array_contains(F.array(*map(F.lit, v)), F.col("view")), F.col("ms")).otherwise(0)).alias(f"c{k}") for k, v in enumerate(configurations.values())]
    wide = timed.groupBy("id").agg(*sums)
    long = wide.select(F.explode(F.array(*(F.struct(v["name"].alias("configuracion"), F.col(f"c{k}").alias("ms")) for k, v in enumerate(views)))).alias("c"))
    return long.groupBy(F.col("c.configuracion").alias("configuracion")).agg(F.percentile("c.ms", F.lit(0.5)).alias("mediana_ms"))


def recovered_accuracy(detail: DataFrame, alerts: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """alerts: id, alert as "field:...suffix". Accuracy of the fields that each kind of alert has touched."""
    kinds = F.filter(F.array(*map(F.lit, suffixes)), lambda s: F.endswith(F.col("alert"), s))
    touched = alerts.select("id", F.split_part("alert", F.lit(":"), F.lit(1)).alias("field"), F.explode(kinds).alias("sufijo")).distinct()
    return detail.join(touched, ["id", "field"]).groupBy("sufijo").agg(F.count("*").alias("campos"), F.sum("correct").alias("correctos"), (F.avg(F.col("correct").cast("double")) * 100).alias("exactitud"))


def amount_balance(receipts: DataFrame, tolerance: int = 2, low_pct: int = 2, high_pct: int = 30) -> DataFrame:
    """receipts: subtotal, tax, total in cents. Of those with all three, how many add up and have a likely tax."""
    s, t, g = (F.col(c) for c in ("subtotal", "tax", "total"))
    likely = (t * 100 >= s * low_pct) & (t * 100 <= s * high_pct)
    return receipts.where((s != 0) & (t != 0) & (g != 0)).agg(F.count("*").alias("recibos"), F.count_if(F.abs(s + t - g) <= tolerance).alias("cuadran"), F.count_if(likely).alias("razon_probable"))


def choose(runs: DataFrame, in_use: str, processed: float = 0.9) -> DataFrame:
    """runs: version, exactitud, min_field, procesamiento. The most exact of those that process enough, then the one with
    the best worst field, then the one in use, then by name; no row if none is eligible."""
    able = runs.where((F.col("procesamiento") >= processed) & (F.col("min_field") >= 0))
    return able.orderBy(F.desc("exactitud"), F.desc("min_field"), F.col("version") != in_use, "version").limit(1)


def cer_reference(regions: Column, issues: Column) -> Column:
    """regions: array of (y0, x0, label, text). Their texts from top to bottom, then left to right; null without regions
    or with an issue that spoils them."""
    kept = F.filter(F.array_sort(F.transform(regions, lambda r: F.struct(r["y0"].alias("y0"), r["x0"].alias("x0"), r["text"].alias("text"), r["label"].alias("label")))), lambda r: ~r["label"].eqNullSafe("Ignore"))
    spoilt = F.arrays_overlap(F.coalesce(issues, F.array().cast("array<string>")), F.array(*map(F.lit, NO_REFERENCE)))
    return F.when((F.coalesce(F.size(regions), F.lit(0)) > 0) & ~spoilt, F.array_join(F.transform(kept, lambda r: r["text"]), " "))
