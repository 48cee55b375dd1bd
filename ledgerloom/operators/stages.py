"""What follows the vote: label-associated amounts, accounting, consistency, agreement of focused readings, evidence.

Each stage takes tables keyed by document and returns proposals or changed fields; a document that a stage has nothing
to say on is simply not in its output. All groupings start with the document, so a vote's partitioning serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def semantic_amounts(found: DataFrame, current: DataFrame, margin: float = 0.75) -> DataFrame:
    """found: doc, field, view, norm, quality. current: doc, field, value. The value whose quality and number of views
    lead by the margin. One view alone counts only at quality 9, and only for an empty field or its own value."""
    votes = found.groupBy("doc", "field", "norm").agg(F.max("quality").alias("quality"), F.count_distinct("view").alias("views"))
    scored = votes.join(current, ["doc", "field"], "left").withColumn("score", F.round(F.col("quality") + 2 * F.log2(1.0 + F.col("views")), 9))
    alone = (F.col("quality") >= 9) & (F.col("value").isNull() | (F.col("value") == F.col("norm")))
    stands = scored.where((F.col("views") >= 2) | alone)
    w = Window.partitionBy("doc", "field").orderBy(F.desc("score"), "norm")
    first = stands.withColumn("k", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).where("k = 1")
    clear = F.col("next").isNull() | (F.col("score") - F.col("next") >= margin)
    return first.select("doc", "field", F.when(clear, F.col("norm")).alias("proposed"), "score", (~clear).alias("conflict"))


def observed_accounting(lines: DataFrame, fields: DataFrame, tolerance: int = 1, most_tax_pct: int = 40) -> DataFrame:
    """lines: doc, kind (subtotal, tax, total, discount, shipping, service, tip, rounding), view, cents. fields: doc,
    total. A sum that at least two views printed in full: subtotal + tax + adjustments = total. An adjustment that only
    one view saw stops the document; so does more than one total that fits."""
    votes = lines.groupBy("doc", "kind", "cents").agg(F.count_distinct("view").alias("views"))
    main = votes.where(F.col("kind").isin("subtotal", "tax", "total"))
    adjust = votes.where(~F.col("kind").isin("subtotal", "tax", "total"))
    sign = F.when(F.col("kind") == "discount", -F.col("cents")).otherwise(F.col("cents"))
    per_doc = adjust.groupBy("doc").agg(F.min("views").alias("least"), F.sum(sign).alias("adjust"))
    part = lambda k: main.where((F.col("kind") == k) & (F.col("views") >= 2)).select("doc", F.col("cents").alias(k))
    sums = part("subtotal").join(part("tax"), "doc").join(part("total"), "doc").join(per_doc, "doc", "left").where(F.col("least").isNull() | (F.col("least") >= 2))
    fits = sums.where((F.abs(F.col("subtotal") + F.col("tax") + F.coalesce("adjust", F.lit(0)) - F.col("total")) <= tolerance) & (F.col("tax") * 100 <= F.col("subtotal") * most_tax_pct))
    one = fits.groupBy("doc").agg(F.count_distinct("total").alias("n"), F.min("total").alias("proposed")).where("n = 1")
    return one.join(fields.select("doc", "total"), "doc").select("doc", "proposed", (~F.col("total").eqNullSafe(F.col("proposed"))).alias("changed"))


def third_amount(anchors: DataFrame, seen: DataFrame) -> DataFrame:
    """anchors: doc, field, cents, score, views. seen: doc, cents. Two sure fields give the third, if that was read."""
    sure = anchors.where((F.col("score") >= 7) & (F.col("views") >= 2)).groupBy("doc").pivot("field", ["subtotal", "tax", "total"]).agg(F.min("cents"))
    s, t, g = F.col("subtotal"), F.col("tax"), F.col("total")
    want = F.when(g.isNull(), F.struct(F.lit("total").alias("field"), (s + t).alias("cents"))).when(t.isNull(), F.struct(F.lit("tax").alias("field"), (g - s).alias("cents"))).when(s.isNull(), F.struct(F.lit("subtotal").alias("field"), (g - t).alias("cents")))
    missing = sure.withColumn("w", want).where("w is not null and w.cents is not null and w.cents > 0").select("doc", "w.field", "w.cents")
    return missing.join(seen.select("doc", "cents").distinct(), ["doc", "cents"], "left_semi")


def focused_agreement(readings: DataFrame, current: DataFrame, least_confidence: float = 35) -> DataFrame:
    """readings: doc, field, method, psm, norm, confidence. A value that two different methods read fills an empty field
    and only flags a full one."""
    votes = readings.where(F.col("confidence") >= least_confidence).groupBy("doc", "field", "norm").agg(F.count_distinct("method", "psm").alias("n")).where("n >= 2")
    w = Window.partitionBy("doc", "field")
    only = votes.withColumn("k", F.count("*").over(w)).where("k = 1")
    joined = only.join(current, ["doc", "field"], "left")
    return joined.select("doc", "field", F.coalesce("value", "norm").alias("value"), F.when(F.col("value").isNull(), "filled").when(F.col("value") == F.col("norm"), "confirmed").otherwise("disagrees").alias("outcome"))


def fill_nulls(base: DataFrame, rescue: DataFrame) -> DataFrame:
    """base: doc, field, value. rescue: doc, field, value, score, views of a second run; it may fill empty fields only."""
    ok = rescue.where((F.col("score") >= 6) & (F.col("views") >= 2)).select("doc", "field", F.col("value").alias("other"))
    joined = base.join(ok, ["doc", "field"], "left")
    return joined.select("doc", "field", F.coalesce("value", "other").alias("value"), (F.col("value").isNull() & F.col("other").isNotNull()).alias("rescued"))


def main_evidence(evidence: DataFrame, chosen: DataFrame) -> DataFrame:
    """evidence: doc, field, view, norm, score. The first view that has the chosen value."""
    hit = evidence.join(chosen.select("doc", "field", F.col("value").alias("norm")), ["doc", "field", "norm"])
    return hit.groupBy("doc", "field").agg(F.min("view").alias("view"), F.min_by("score", "view").alias("score"))


def review_notes(alerts: Column, ambiguous_date: Column, balance: Column, n_fields: Column) -> Column:
    """Alerts, and notes for what a reader should look at."""
    return F.array_compact(F.concat(alerts, F.array(F.when(ambiguous_date, "date:ambiguous_order"), F.when(balance == "inconsistent_review", "amounts:inconsistent"), F.when(n_fields == 0, "page:no_fields"))))


def explain_alerts(alerts: DataFrame, texts: DataFrame) -> DataFrame:
    """alerts: doc, alert as field:kind. texts: kind, text, one row a kind, any number. Unknown kinds get a general text."""
    parts = F.split("alert", ":")
    named = alerts.select("doc", F.element_at(parts, 1).alias("field"), F.element_at(parts, -1).alias("kind"))
    return named.join(texts, "kind", "left").select("doc", "field", "kind", F.coalesce("text", F.lit("check this value")).alias("text"))
