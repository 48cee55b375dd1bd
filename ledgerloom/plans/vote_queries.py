"""The vote over derived readings, and what is built on it."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import consensus as C
from ledgerloom.plans import fixtures as X

CONFIG = C.VoteConfig(primary_mask=X.PRIMARY_MASK)
#: (param_id, vote_weight, fuzzy_weight, balance_bonus)
GRID = [(0, 2.0, 0.5, 3.0), (1, 1.0, 0.5, 3.0), (2, 2.0, 0.25, 0.0), (3, 0.5, 1.0, 6.0)]


def vote_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ranked_groups(X.readings(spark, sf_dir), CONFIG)


def vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = C.elect(vote_ranked(spark, sf_dir))
    level = F.when(F.col("value").isNull(), "sin_valor").otherwise(C.confidence(F.col("n_views"), X.VIEWS, F.col("ambiguous")))
    return won.select("doc", "field", "value", "ambiguous", "rank", level.alias("confianza"))


def vote_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a document side by side, with the total from the subtotal where that is all there is."""
    wide = C.elect(vote_ranked(spark, sf_dir)).groupBy("doc").pivot("field", ["subtotal", "tax", "total"]).agg(F.first("value"))
    return C.total_from_subtotal(wide)


def vote_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact matches with each part of the vote turned off."""
    truth = X.gold(spark, sf_dir).select("doc", "field", X.money_text(F.col("cents")).alias("gold"))
    readings = X.readings(spark, sf_dir)
    out = []
    for name, cfg in (("base", CONFIG), ("fuzzy", replace(CONFIG, fuzzy=False)), ("dominance", replace(CONFIG, dominance=False)), ("balance", replace(CONFIG, balance=False))):
        won = C.elect(C.ranked_groups(readings, cfg)).join(truth, ["doc", "field"])
        out.append(won.agg(F.lit(name).alias("off"), F.count("*").alias("fields"), F.count_if(F.col("value") == F.col("gold")).alias("hits")))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def vote_param_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parameter sets in one pass: the groups don't depend on them, only the rank does."""
    ranked = vote_ranked(spark, sf_dir).drop("rank")
    params = F.array(*(F.struct(F.lit(k).alias("param_id"), F.lit(v).alias("vw"), F.lit(f).alias("fw"), F.lit(b).alias("bb")) for k, v, f, b in GRID))
    tried = ranked.withColumn("p", F.explode(params)).select("*", "p.*").drop("p")
    tried = tried.withColumn("rank", F.col("score") + F.col("vw") * (F.col("votes") - 1) + F.col("fw") * F.col("fuzzy") + F.when(F.col("balanced"), F.col("bb")).otherwise(0.0))
    won = C.elect(tried, ("doc", "field", "param_id"))
    truth = X.gold(spark, sf_dir).select("doc", "field", X.money_text(F.col("cents")).alias("gold"))
    scored = won.join(truth, ["doc", "field"]).groupBy("param_id", "field").agg(F.avg((F.col("value").eqNullSafe(F.col("gold"))).cast("double")).alias("acc"), F.count("*").alias("n"))
    objective = scored.groupBy("param_id").agg(F.avg("acc").alias("macro"), F.min("acc").alias("worst"), (F.sum(F.col("acc") * F.col("n")) / F.sum("n")).alias("global"))
    order = Window.orderBy(F.desc(F.round("macro", 9)), F.desc(F.round("worst", 9)), F.desc(F.round("global", 9)), "param_id")
    return objective.withColumn("place", F.row_number().over(order)).select("param_id", F.round("macro", 9).alias("macro"), F.round("worst", 9).alias("worst"), F.round("global", 9).alias("global"), "place")


def fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of values of a field of a document at edit distance one."""
    values = C.vote_groups(X.readings(spark, sf_dir)).select("doc", "field", "norm")
    pair = values.select("doc", "field", F.col("norm").alias("a")).join(values.withColumnRenamed("norm", "b"), ["doc", "field"])
    return pair.where((F.col("b") > F.col("a")) & C.near(F.col("a"), F.col("b")))


def three_way_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = C.vote_groups(X.readings(spark, sf_dir)).groupBy("doc").agg(F.collect_list(F.struct("field", "cents")).alias("groups"))
    return groups.select("doc", F.explode(F.array_distinct(C.balanced_values(groups))).alias("p")).select("doc", F.col("p.s").alias("subtotal"), F.col("p.t").alias("tax"), (F.col("p.s") + F.col("p.t")).alias("total"))


def alert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each kind of alert is raised, by field."""
    alerts = vote(spark, sf_dir).select("doc", F.explode(F.array_compact(F.array(F.when(F.col("ambiguous"), F.concat("field", F.lit(":ambiguous_consensus"))), F.when(F.col("confianza") == "baja", F.concat("field", F.lit(":low_agreement")))))).alias("alert"))
    return alerts.groupBy(F.element_at(F.split("alert", ":"), 1).alias("field"), F.element_at(F.split("alert", ":"), -1).alias("kind")).agg(F.count("*").alias("n"))


def view_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values, votes and the share of the first, by field: which summaries the views disagree on."""
    counts = X.readings(spark, sf_dir).groupBy("doc", "field", "norm").agg(F.count_distinct("view").alias("n"))
    per = counts.groupBy("doc", "field").agg(F.count("*").alias("vals"), F.sum("n").alias("votes"), F.max("n").alias("top"))
    bad = (F.col("vals") >= 2) & (F.col("votes") >= 4) & (F.col("top") / F.col("votes") < 0.75)
    return per.groupBy("field").agg(F.count("*").alias("docs"), F.count_if(bad).alias("disagree"))


def value_by_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of documents whose true value a view has, and that any view has."""
    truth = X.gold(spark, sf_dir).select("doc", "field", F.col("cents").alias("want"))
    joined = X.readings(spark, sf_dir).join(truth, ["doc", "field"])
    any_view = joined.groupBy("doc", "field").agg(F.bool_or(F.col("cents") == F.col("want")).alias("hit"))
    all_views = any_view.groupBy("field").agg(F.lit("any").alias("view"), F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    each = joined.groupBy("field", F.col("view").cast("string").alias("view")).agg(F.count("*").alias("n"), F.count_if(F.col("cents") == F.col("want")).alias("hits"))
    return each.unionByName(all_views)


RANKED_SQL = X.READINGS_SQL + f""",
grp0 AS (
  SELECT doc, field, norm, max(score) AS score, max(cents) AS cents, bit_or(1::BIGINT << view) AS views FROM readings GROUP BY ALL),
bal AS (
  SELECT DISTINCT s.doc, s.cents AS s, t.cents AS t FROM grp0 s JOIN grp0 t ON s.doc = t.doc AND s.field = 'subtotal' AND t.field = 'tax'
  JOIN grp0 g ON g.doc = s.doc AND g.field = 'total' AND g.cents = s.cents + t.cents WHERE t.cents > 0 AND s.cents >= t.cents),
balanced AS (
  SELECT doc, 'subtotal' AS field, s AS cents FROM bal UNION SELECT doc, 'tax', t FROM bal UNION SELECT doc, 'total', s + t FROM bal)"""
_W = f"(bit_count({{m}}) + 0.5 * bit_count({{m}} & {X.PRIMARY_MASK}))"


def ranked_sql(name: str = "ranked", dominance: bool = True, fuzzy: bool = True, balance: bool = True) -> str:
    keep = "field <> 'total' OR best < 8 OR score >= 8" if dominance else "true"
    return f""",
{name}_g AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY doc, field) AS best FROM grp0) WHERE {keep}),
{name}_f AS (
  SELECT a.doc, a.field, a.norm, bit_or(b.views) & ~any_value(a.views) AS m FROM {name}_g a JOIN {name}_g b
  ON a.doc = b.doc AND a.field = b.field AND levenshtein(a.norm, b.norm) = 1 GROUP BY ALL),
{name} AS (
  SELECT g.doc, g.field, g.norm, g.score, {_W.format(m='g.views')}::DOUBLE AS votes, bit_count(g.views)::INTEGER AS n_views,
    {'coalesce(' + _W.format(m='f.m') + ', 0)' if fuzzy else '0'}::DOUBLE AS fuzzy, {'b.cents IS NOT NULL' if balance else 'false'} AS balanced,
    CASE WHEN g.views & {X.PRIMARY_MASK} <> 0 THEN 1.5 ELSE 1.0 END::DOUBLE AS weight
  FROM {name}_g g LEFT JOIN {name}_f f USING (doc, field, norm) LEFT JOIN balanced b ON b.doc = g.doc AND b.field = g.field AND b.cents = g.cents)"""


_RANK = "score + 2 * (votes - 1) + 0.5 * fuzzy + CASE WHEN balanced THEN 3 ELSE 0 END"


def elected_sql(ranked: str = "ranked", name: str = "elected", rank: str = _RANK, keys: str = "doc, field") -> str:
    return f""",
{name}_r AS (SELECT *, ({rank})::DOUBLE AS rank FROM {ranked}),
{name}_o AS (
  SELECT *, row_number() OVER w AS n, lead((rank, score, weight)) OVER w IS NOT DISTINCT FROM (rank, score, weight) AS tie
  FROM {name}_r WINDOW w AS (PARTITION BY {keys} ORDER BY rank DESC, score DESC, weight DESC, norm DESC)),
{name} AS (SELECT {keys}, CASE WHEN NOT tie THEN norm END AS value, tie AS ambiguous, rank, n_views FROM {name}_o WHERE n = 1)"""


VOTE_SQL = "WITH " + RANKED_SQL + ranked_sql() + elected_sql() + """,
voted AS (
  SELECT doc, field, value, ambiguous, rank, CASE WHEN value IS NULL THEN 'sin_valor'
    ELSE ['baja', 'media', 'alta'][greatest(0, CASE WHEN n_views >= 6 THEN 2 WHEN n_views >= 3 THEN 1 ELSE 0 END - ambiguous::INTEGER) + 1] END AS confianza
  FROM elected)"""
_TRUTH = "(SELECT doc, field, (cents // 100)::VARCHAR || '.' || lpad((cents % 100)::VARCHAR, 2, '0') AS gold FROM gold)"

QUERIES = {f.__name__: f for f in (vote, vote_ranked, vote_wide, vote_ablation, vote_param_grid, fuzzy_pairs, three_way_balance, alert_counts, view_agreement, value_by_view)}
ORACLES = {
    "vote": VOTE_SQL + " SELECT * FROM voted",
    "vote_ranked": "WITH " + RANKED_SQL + ranked_sql() + f" SELECT *, ({_RANK})::DOUBLE AS rank FROM ranked",
    "vote_wide": VOTE_SQL + """,
w AS (SELECT doc, max(CASE WHEN field = 'subtotal' THEN value END) AS subtotal, max(CASE WHEN field = 'tax' THEN value END) AS tax, max(CASE WHEN field = 'total' THEN value END) AS total FROM voted GROUP BY doc)
SELECT doc, subtotal, tax, total IS NULL AND tax IS NULL AND subtotal IS NOT NULL AS from_subtotal,
  CASE WHEN total IS NULL AND tax IS NULL THEN subtotal ELSE total END AS total FROM w""",
    "vote_ablation": "WITH " + RANKED_SQL + "".join(ranked_sql(n, **o) + elected_sql(n, f"e_{n}") for n, o in (("base", {}), ("nf", {"fuzzy": False}), ("nd", {"dominance": False}), ("nb", {"balance": False}))) + " " + " UNION ALL ".join(f"SELECT '{off}' AS off, count(*) AS fields, count(*) FILTER (value = gold) AS hits FROM e_{n} JOIN {_TRUTH} USING (doc, field)" for off, n in (("base", "base"), ("fuzzy", "nf"), ("dominance", "nd"), ("balance", "nb"))),
    "vote_param_grid": "WITH " + RANKED_SQL + ranked_sql() + ",\ngrid AS (SELECT * FROM ranked, (VALUES " + ", ".join(map(str, GRID)) + ") AS p(param_id, vw, fw, bb))" + elected_sql("grid", "won", "score + vw * (votes - 1) + fw * fuzzy + CASE WHEN balanced THEN bb ELSE 0 END", "doc, field, param_id") + f""",
acc AS (SELECT param_id, field, avg((value IS NOT DISTINCT FROM gold)::INTEGER) AS acc, count(*) AS n FROM won JOIN {_TRUTH} USING (doc, field) GROUP BY ALL),
obj AS (SELECT param_id, round(avg(acc), 9) AS macro, round(min(acc), 9) AS worst, round(sum(acc * n) / sum(n), 9) AS "global" FROM acc GROUP BY ALL)
SELECT *, row_number() OVER (ORDER BY macro DESC, worst DESC, "global" DESC, param_id) AS place FROM obj""",
    "fuzzy_pairs": "WITH " + X.READINGS_SQL + """, g AS MATERIALIZED (SELECT DISTINCT doc, field, norm FROM readings),
p AS MATERIALIZED (SELECT a.doc, a.field, a.norm AS a, b.norm AS b FROM g a JOIN g b ON a.doc = b.doc AND a.field = b.field)
SELECT * FROM p WHERE a < b AND abs(length(a) - length(b)) <= 1 AND levenshtein(a, b) = 1""",
    "three_way_balance": "WITH " + RANKED_SQL + " SELECT doc, s AS subtotal, t AS tax, s + t AS total FROM bal",
    "alert_counts": VOTE_SQL + " SELECT field, 'ambiguous_consensus' AS kind, count(*) AS n FROM voted WHERE ambiguous GROUP BY field UNION ALL SELECT field, 'low_agreement', count(*) FROM voted WHERE confianza = 'baja' GROUP BY field",
    "view_agreement": "WITH " + X.READINGS_SQL + ", c AS (SELECT doc, field, norm, count(DISTINCT view) AS n FROM readings GROUP BY ALL), p AS (SELECT doc, field, count(*) AS vals, sum(n) AS votes, max(n) AS top FROM c GROUP BY ALL) SELECT field, count(*) AS docs, count(*) FILTER (vals >= 2 AND votes >= 4 AND top / votes < 0.75) AS disagree FROM p GROUP BY field",
    "value_by_view": "WITH " + X.READINGS_SQL + ", j AS (SELECT r.doc, r.field, r.view, r.cents = g.cents AS hit FROM readings r JOIN gold g USING (doc, field)) SELECT field, view::VARCHAR AS view, count(*) AS n, count(*) FILTER (hit) AS hits FROM j GROUP BY ALL UNION ALL SELECT field, 'any', count(*), count(*) FILTER (hit) FROM (SELECT doc, field, bool_or(hit) AS hit FROM j GROUP BY ALL) GROUP BY field",
}
