"""From the words of all views to the fields of a document: vote, corroboration, and the stages after it, in order.

Every step takes and gives tables keyed by document first. A stage proposes values that were read; it fills an empty
field, or takes the place of a value where its own evidence is stronger, and says so in an alert.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import phrases, repair_glyphs, text_key
from ledgerloom.lineage import cut
from ledgerloom.operators import consensus as C
from ledgerloom.operators import layout as L
from ledgerloom.operators import stages as S
from ledgerloom.schema import FIELDS, MONEY

# What adjusts a total on its way from subtotal and tax.
ADJUSTMENTS = {"discount": ("discount", "savings", "less"), "shipping": ("shipping", "delivery", "freight"), "service": ("service", "service charge"), "tip": ("tip", "gratuity"), "rounding": ("rounding", "rounding adj", "rounded")}


def cents_of(value: Column) -> Column:
    return F.regexp_replace(value, r"\.", "").try_cast("long")


def paid(rows: DataFrame) -> DataFrame:
    """doc, norm: amounts on payment rows."""
    return L.paid_amounts(rows).select(F.col("doc_id").alias("doc"), "norm").distinct()


def labelled_evidence(rows: DataFrame) -> DataFrame:
    """doc, field, view, norm, quality: amounts that belong to a label: 9 beside it, 7 below, 2 more for a strong total."""
    found = L.labelled_amounts(rows).join(rows.select("doc_id", "view", "row_no", "text"), ["doc_id", "view", "row_no"])
    strong = (F.col("field") == "total") & F.col("text").rlike(L.STRONG_TOTAL)
    quality = F.when(F.col("rule") == "beside_label", 9).otherwise(7) + F.when(strong, 2).otherwise(0)
    return found.select(F.col("doc_id").alias("doc"), "field", "view", "norm", quality.alias("quality"))


def accounting_lines(rows: DataFrame) -> DataFrame:
    """doc, kind, view, cents: the one amount of a row that names a part of the account."""
    text = repair_glyphs(F.col("text"))
    kinds = {k: phrases(*words) for k, words in ADJUSTMENTS.items()} | dict(L.LABELS)
    kind = F.coalesce(*(F.when(F.col("t").rlike(rule), F.lit(k)) for k, rule in kinds.items()))
    each = rows.select("doc_id", "view", text.alias("t")).withColumn("a", L.amounts(F.col("t"))).where(F.size("a") == 1).withColumn("kind", kind).where("kind is not null")
    return each.where(~F.col("t").rlike(L.PAYMENT)).select(F.col("doc_id").alias("doc"), "kind", "view", cents_of(F.col("a")[0]["value"]).alias("cents"))


def geometry_amounts(rows: DataFrame, words: DataFrame, empty: DataFrame, least_confidence: float = 30) -> DataFrame:
    """doc, field, value for empty fields: the number at a label's right that most of two views or more agree on."""
    fields = F.filter(F.array(*(F.struct(F.lit(f).alias("field"), F.col("text").rlike(rule).alias("hit")) for f, rule in L.LABELS.items())), lambda x: x["hit"])
    labels = rows.withColumn("f", F.explode(fields)).withColumn("w", F.filter("words", lambda w: w["key"].rlike("[a-z]")))
    labels = labels.where(F.size("w") > 0).select("doc_id", "view", "f.field", F.element_at(F.element_at("w", -1)["box"], 3).alias("x1"), "y0", "y1")
    labels = labels.join(empty.select(F.col("doc").alias("doc_id"), "field"), ["doc_id", "field"], "left_semi")
    amount = L.amounts(repair_glyphs(text_key(F.col("text"))))
    numbers = words.where(F.col("confidence") >= least_confidence).withColumn("a", amount).where(F.size("a") == 1)
    numbers = numbers.select("doc_id", "view", F.col("a")[0]["value"].alias("value"), "x0", ((F.col("y0") + F.col("y1")) / 2).alias("y"), "confidence")
    votes = L.nearest_number(labels, numbers).groupBy("doc_id", "field", "value").agg(F.count_distinct("view").alias("n"))
    all_views = F.sum("n").over(Window.partitionBy("doc_id", "field"))
    return votes.withColumn("all", all_views).where((F.col("n") >= 2) & (2 * F.col("n") > F.col("all"))).select(F.col("doc_id").alias("doc"), "field", "value")


def long_fields(won: DataFrame) -> DataFrame:
    """doc, field, value, alert for every field of every document, read or not."""
    every = won.select("doc").distinct().withColumn("field", F.explode(F.array(*map(F.lit, FIELDS))))
    return every.join(won.select("doc", "field", "value", "alert"), ["doc", "field"], "left")


def filled(fields: DataFrame, found: DataFrame, source: str) -> DataFrame:
    """fields with empty ones taken from found: doc, field, value."""
    joined = fields.join(found.select("doc", "field", F.col("value").alias("new")), ["doc", "field"], "left")
    took = F.col("value").isNull() & F.col("new").isNotNull()
    return joined.select("doc", "field", F.coalesce("value", "new").alias("value"), F.when(took, F.concat("field", F.lit(f":{source}"))).otherwise(F.col("alert")).alias("alert"))


def read_fields(words: DataFrame, candidates: DataFrame, cfg: C.VoteConfig) -> DataFrame:
    """doc, field, value, alert, n_views: one row for each field of each document with any candidate.

    words: schema.WORDS; candidates: what api.candidates proposes of them.
    """
    rows, candidates = cut(L.visual_rows(words)), cut(candidates)
    ranked = cut(C.corroborated(C.ranked_groups(candidates, cfg), candidates, paid(rows), cfg))
    won = cut(C.elect(ranked))
    fields = long_fields(won.withColumn("alert", F.when(F.col("ambiguous"), F.concat("field", F.lit(":ambiguous_consensus")))))
    if cfg.semantic:
        told = S.semantic_amounts(labelled_evidence(rows), fields)
        joined = fields.join(told.select("doc", "field", "proposed", "conflict"), ["doc", "field"], "left")
        # two sure readings of one label are no doubt that a vote can be settled with
        better = F.col("proposed").isNotNull() & F.col("value").isNull() & F.col("alert").isNull()
        fields = joined.select("doc", "field", F.when(better, F.col("proposed")).otherwise(F.col("value")).alias("value"), F.when(F.col("conflict") & F.col("alert").isNull() & F.col("value").isNull(), F.concat("field", F.lit(":label_conflict"))).otherwise(F.col("alert")).alias("alert"))
        fields = cut(fields)
    empty = lambda f: f.where(F.col("value").isNull() & F.col("field").isin(*MONEY) & F.col("alert").isNull())
    if cfg.geometry:
        fields = cut(filled(fields, geometry_amounts(rows, words, empty(fields)), "word_geometry"))
    if cfg.consistency:
        anchors = ranked.join(fields.select("doc", "field", F.col("value").alias("norm")), ["doc", "field", "norm"]).where(F.col("field").isin(*MONEY))
        anchors = anchors.select("doc", "field", cents_of(F.col("norm")).alias("cents"), "score", F.col("n_views").alias("views"))
        seen = rows.select(F.col("doc_id").alias("doc"), F.explode(L.amounts(repair_glyphs(F.col("text")))).alias("a")).select("doc", cents_of(F.col("a.value")).alias("cents"))
        third = S.third_amount(anchors, seen).select("doc", "field", money_of(F.col("cents")).alias("value"))
        fields = cut(filled(fields, third, "third_amount"))
    if cfg.accounting:
        totals = fields.where("field = 'total'").select("doc", cents_of(F.col("value")).alias("total"))
        account = S.observed_accounting(accounting_lines(rows), totals).where("changed").select("doc", F.lit("total").alias("field"), money_of(F.col("proposed")).alias("new"))
        joined = fields.join(account, ["doc", "field"], "left")
        fields = joined.select("doc", "field", F.coalesce("new", "value").alias("value"), F.when(F.col("new").isNotNull(), F.concat("field", F.lit(":observed_accounting"))).otherwise(F.col("alert")).alias("alert"))
    support = candidates.groupBy("doc", "field", F.col("norm").alias("value")).agg(F.count_distinct("view").alias("n_views"))
    return fields.join(support, ["doc", "field", "value"], "left").select("doc", "field", "value", "alert", F.coalesce("n_views", F.lit(0)).alias("n_views"))


def money_of(cents: Column) -> Column:
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def rescue(fields: DataFrame, words: DataFrame, candidates: DataFrame, cfg: C.VoteConfig) -> DataFrame:
    """A second vote, in which words count by their confidence, fills empty fields that two views read well."""
    keyed = words.select(F.col("doc_id").alias("doc"), "view", text_key(F.col("text")).alias("key"), "confidence")
    ranked = C.ranked_groups(candidates, cfg).join(C.confidence_votes(candidates, keyed, cfg), ["doc", "field", "norm"])
    again = C.elect(ranked.withColumn("rank", F.col("rank") + cfg.vote_weight * (F.col("sure") - F.col("votes"))))
    best = again.join(candidates.groupBy("doc", "field", F.col("norm").alias("value")).agg(F.max("score").alias("score")), ["doc", "field", "value"])
    usable = best.select("doc", "field", "value", "score", F.col("n_views").alias("views")).where(F.col("field").isin("date", *MONEY))
    return S.fill_nulls(fields, usable)
