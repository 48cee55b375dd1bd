"""Weighted multi-reading vote with explicit abstention.

One shuffle, on the document: best reading per view and value, vote groups, near values, balance and the final choice
are all keyed by the document first, so each later step finds its rows where they are. View sets are bit masks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import near_strings as near


@dataclass(frozen=True)
class VoteConfig:
    """Weights of the rank, and switches that turn a part off to measure what it adds."""

    primary_mask: int = 0
    primary_weight: float = 1.5
    vote_weight: float = 2.0
    fuzzy_weight: float = 0.5
    balance_bonus: float = 3.0
    dominant_score: int = 8
    printed_bonus: float = 3.0
    paid_bonus: float = 2.0
    fuzzy: bool = True
    dominance: bool = True
    balance: bool = True
    printed: bool = True
    paid: bool = True
    semantic: bool = True
    geometry: bool = True
    consistency: bool = True
    accounting: bool = True


def mask_weight(mask: Column, cfg: VoteConfig) -> Column:
    """Weight of a set of views: 1 each, more for primary ones."""
    return F.bit_count(mask) + (cfg.primary_weight - 1) * F.bit_count(mask.bitwiseAND(F.lit(cfg.primary_mask).cast("long")))


def primary_views(options: DataFrame, preprocess: str = "resize", psm: int = 6) -> int:
    """options: view, preprocess, psm, one row a view of the run. The mask of the views read in the primary way."""
    rows = options.where((F.col("preprocess") == preprocess) & (F.col("psm") == psm)).select("view").distinct().limit(MOST_VIEWS).collect()
    return sum(1 << r["view"] for r in rows)


#: A set of views is a mask in a long.
MOST_VIEWS = 63


def vote_groups(candidates: DataFrame) -> DataFrame:
    """candidates: doc, field, view, norm, cents, score. One row per doc, field and value: views (mask) and best score."""
    bit = F.when(F.col("view").between(0, MOST_VIEWS - 1), F.expr("shiftleft(cast(1 as bigint), view)")).otherwise(F.raise_error(F.concat(F.lit(f"view not in 0 to {MOST_VIEWS - 1}: "), F.col("view").cast("string"))).cast("long"))
    return candidates.groupBy("doc", "field", "norm").agg(F.max("score").alias("score"), F.max("cents").alias("cents"), F.bit_or(bit).alias("views"))


def confidence_votes(candidates: DataFrame, words: DataFrame, cfg: VoteConfig) -> DataFrame:
    """doc, field, norm, sure: votes weighted by half and the best confidence of a word of the view that says the value.

    candidates with raw; words: doc, view, key (folded text), confidence in percent.
    """
    told = candidates.select("doc", "field", "norm", "view", F.col("raw").alias("key")).distinct()
    best = told.join(words.select("doc", "view", "key", "confidence"), ["doc", "view", "key"], "left").groupBy("doc", "field", "norm", "view").agg(F.coalesce(F.max("confidence") / 100, F.lit(0.0)).alias("c"))
    weight = F.when(F.expr("shiftleft(cast(1 as bigint), view)").bitwiseAND(F.lit(cfg.primary_mask).cast("long")) != 0, cfg.primary_weight).otherwise(1.0)
    return best.groupBy("doc", "field", "norm").agg(F.sum(weight * (0.5 + F.col("c"))).alias("sure"))


def corroborated(ranked: DataFrame, candidates: DataFrame, paid: DataFrame, cfg: VoteConfig) -> DataFrame:
    """The rank of subtotals that stand beside their printed label, and of totals that were paid, goes up.

    candidates with rule; paid: doc, norm. Both tables come together by document, where the vote is already dealt out.
    """
    printed = candidates.where("field = 'subtotal' and rule = 'beside_label'").select("doc", "field", "norm", F.lit(cfg.printed_bonus if cfg.printed else 0.0).alias("bonus"))
    settled = paid.select("doc", F.lit("total").alias("field"), "norm", F.lit(cfg.paid_bonus if cfg.paid else 0.0).alias("bonus"))
    more = printed.unionByName(settled).groupBy("doc", "field", "norm").agg(F.max("bonus").alias("bonus"))
    return ranked.join(more, ["doc", "field", "norm"], "left").withColumn("rank", F.col("rank") + F.coalesce("bonus", F.lit(0.0))).drop("bonus")


def balanced_values(docs: DataFrame) -> Column:
    """Values of ``groups`` (array of a document's vote groups) in a subtotal + tax = total that was read."""
    of = lambda f: F.filter("groups", lambda g: g["field"] == f)
    pairs = F.flatten(F.transform(of("subtotal"), lambda s: F.transform(F.filter(of("tax"), lambda t: (t["cents"] > 0) & (s["cents"] >= t["cents"])), lambda t: F.struct(s["cents"].alias("s"), t["cents"].alias("t")))))
    totals = F.transform(of("total"), lambda g: g["cents"])
    return F.filter(pairs, lambda p: F.array_contains(totals, p["s"] + p["t"]))


def dominant(groups: str, cfg: VoteConfig) -> Column:
    """Where a total has a strong label, totals without one don't stand."""
    best = F.array_max(F.transform(F.filter(groups, lambda g: g["field"] == "total"), lambda g: g["score"]))
    return F.filter(groups, lambda g: (g["field"] != "total") | (best < cfg.dominant_score) | (g["score"] >= cfg.dominant_score))


def ranked_groups(candidates: DataFrame, cfg: VoteConfig) -> DataFrame:
    """doc, field, norm, score, votes, fuzzy, balanced, rank, weight: all groups that stand for election."""
    each = vote_groups(candidates).groupBy("doc").agg(F.collect_list(F.struct("field", "norm", "cents", "score", "views")).alias("groups"))
    docs = each.withColumn("sums", balanced_values(each)).withColumn("standing", dominant("groups", cfg) if cfg.dominance else F.col("groups"))
    rows = docs.select("doc", "standing", "sums", F.explode("standing").alias("g"))
    others = F.aggregate(F.filter("standing", lambda o: (o["field"] == F.col("g.field")) & near(o["norm"], F.col("g.norm"))), F.lit(0).cast("long"), lambda a, o: a.bitwiseOR(o["views"]))
    fuzzy = mask_weight(others.bitwiseAND(F.bitwise_not("g.views")), cfg) if cfg.fuzzy else F.lit(0.0)
    mine = lambda p: F.when(F.col("g.field") == "subtotal", p["s"]).when(F.col("g.field") == "tax", p["t"]).otherwise(p["s"] + p["t"])
    balanced = F.exists("sums", lambda p: mine(p) == F.col("g.cents")) if cfg.balance else F.lit(False)
    out = rows.select("doc", "g.field", "g.norm", "g.score", mask_weight(F.col("g.views"), cfg).alias("votes"), F.bit_count("g.views").cast("int").alias("n_views"), fuzzy.alias("fuzzy"), balanced.alias("balanced"), F.when(F.col("g.views").bitwiseAND(F.lit(cfg.primary_mask).cast("long")) != 0, cfg.primary_weight).otherwise(1.0).alias("weight"))
    rank = F.col("score") + cfg.vote_weight * (F.col("votes") - 1) + cfg.fuzzy_weight * F.col("fuzzy") + F.when(F.col("balanced"), cfg.balance_bonus).otherwise(0.0)
    return out.withColumn("rank", rank)


def elect(ranked: DataFrame, keys: tuple[str, ...] = ("doc", "field")) -> DataFrame:
    """The first by rank, score, weight and value; null where the first two tie in all but the value."""
    order = Window.partitionBy(*keys).orderBy(F.desc("rank"), F.desc("score"), F.desc("weight"), F.desc("norm"))
    key = F.struct("rank", "score", "weight")
    first = ranked.withColumn("__n", F.row_number().over(order)).withColumn("__tie", F.lead(key).over(order).eqNullSafe(key)).where("__n = 1")
    return first.select(*keys, F.when(~F.col("__tie"), F.col("norm")).alias("value"), F.col("__tie").alias("ambiguous"), "rank", "n_views")


def confidence(n_views: Column, total: int, alerted: Column, high: float = 0.6, medium: float = 0.3) -> Column:
    """Agreement of views as a level; an alert takes it one level down."""
    level = F.when(n_views / total >= high, 2).when(n_views / total >= medium, 1).otherwise(0)
    level = F.greatest(F.lit(0), level - alerted.cast("int"))
    return F.element_at(F.array(F.lit("baja"), F.lit("media"), F.lit("alta")), level + 1)


def total_from_subtotal(fields: DataFrame) -> DataFrame:
    """fields: one row per doc with subtotal, tax, total. A receipt with neither tax nor total has its subtotal as total."""
    alone = F.col("total").isNull() & F.col("tax").isNull() & F.col("subtotal").isNotNull()
    return fields.withColumn("from_subtotal", alone).withColumn("total", F.when(alone, F.col("subtotal")).otherwise(F.col("total")))


def withdraw_unconfirmed(fields: DataFrame, confirmed: DataFrame) -> DataFrame:
    """A total that is only the subtotal again goes, with an alert, unless a later stage (confirmed: doc, total) has it."""
    joined = fields.join(confirmed.select("doc", F.col("total").alias("seen")), "doc", "left")
    gone = F.col("from_subtotal") & ~F.col("total").eqNullSafe(F.col("seen"))
    return joined.withColumn("alert", F.when(gone, "total:subtotal_no_confirma_total")).withColumn("total", F.when(gone, None).otherwise(F.col("total"))).drop("seen")
