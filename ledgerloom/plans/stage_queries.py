"""Stages after the vote, page layout and learning, over derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import api
from ledgerloom.operators import consensus, layout, learning
from ledgerloom.operators import stages as S
from ledgerloom.plans import fixtures as X
from ledgerloom.plans import vote_queries as V


def semantic_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = X.readings(spark, sf_dir)
    current = r.where("view = 0").select("doc", "field", F.col("norm").alias("value"))
    return S.semantic_amounts(r.where("view < 3").select("doc", "field", "view", "norm", (F.col("score") + 2).alias("quality")), current)


def observed_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals less a discount for every fourth receipt, as three views print them."""
    r = X.receipts(spark, sf_dir)
    cut = F.when(F.col("doc") % 4 == 0, 500).otherwise(0)
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("cents")) for k, c in (("subtotal", F.col("subtotal")), ("tax", F.col("tax")), ("total", F.col("total") - cut), ("discount", F.when(F.col("doc") % 4 == 0, 500)))))
    lines = r.select("doc", F.explode(kinds).alias("k")).where("k.cents is not null").withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(2))))
    lines = lines.where(~((F.col("view") > 0) & (F.col("doc") % 8 == 0) & (F.col("k.kind") == "discount"))).select("doc", "k.kind", "view", "k.cents")
    return S.observed_accounting(lines, r.select("doc", F.when(F.col("doc") % 3 == 0, F.col("total")).otherwise(F.col("total") - cut).alias("total")))


def third_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = X.readings(spark, sf_dir)
    groups = r.groupBy("doc", "field", "cents").agg(F.max("score").alias("score"), F.count_distinct("view").alias("views"))
    sure = groups.where(~((F.col("field") == "total") & (F.col("doc") % 2 == 0)) & ~((F.col("field") == "tax") & (F.col("doc") % 2 == 1)) & (F.col("views") >= 5))
    return S.third_amount(sure, r.select("doc", "cents"))


def focused_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = X.readings(spark, sf_dir).where("view < 4")
    seen = r.select("doc", "field", (F.col("view") % 2).alias("method"), (F.col("view") + 6).alias("psm"), "norm", (F.col("score") * 9.0).alias("confidence"))
    current = X.gold(spark, sf_dir).select("doc", "field", F.when(F.col("doc") % 2 == 0, X.money_text(F.col("cents"))).alias("value"))
    return S.focused_agreement(seen, current, 50).groupBy("field", "outcome").agg(F.count("*").alias("n"))


def rescue_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = V.vote(spark, sf_dir).select("doc", "field", "value")
    groups = X.readings(spark, sf_dir).groupBy("doc", "field", "norm").agg(F.max("score").alias("score"), F.count_distinct("view").alias("views"))
    top = groups.groupBy("doc", "field").agg(F.min_by(F.struct("norm", "score", "views"), F.struct(-F.col("views"), "norm")).alias("t")).select("doc", "field", F.col("t.norm").alias("value"), "t.score", "t.views")
    return S.fill_nulls(won, top)


def main_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.main_evidence(X.readings(spark, sf_dir), V.vote(spark, sf_dir).select("doc", "field", "value"))


def nearest_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and numbers of order lines as boxes on a page: the number at a label's right, if one is clearly nearest."""
    l = X.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 3).alias("view"), "l_linenumber", "l_quantity", "l_extendedprice", "l_suppkey")
    labels = l.groupBy("doc_id", "view").agg(F.min("l_linenumber").alias("k")).select("doc_id", "view", F.lit("total").alias("field"), F.lit(100.0).alias("x1"), (F.col("k") * 10.0).alias("y0"), (F.col("k") * 10.0 + 12).alias("y1"))
    numbers = l.select("doc_id", "view", F.round(F.col("l_extendedprice") * 100).cast("long").alias("value"), (90 + F.col("l_quantity") * 10).alias("x0"), (F.col("l_linenumber") * 10.0 + 6).alias("y"), (F.col("l_suppkey") % 100).cast("double").alias("confidence"))
    return layout.nearest_number(labels, numbers)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every receipt as two printed pages of words."""
    r = X.receipts(spark, sf_dir).where("total > 0").withColumn("view", F.explode(F.array(F.lit(0), F.lit(1))))
    line = lambda k, *w: [F.struct(F.lit(k).alias("row"), F.lit(j).alias("at"), x.alias("text")) for j, x in enumerate(w)]
    m = {c: X.money_text(F.col(c)) for c in ("subtotal", "tax", "total")}
    words = [*line(0, F.lit("ACME"), F.lit("Store")), *line(1, F.lit("SUBTOTAL"), m["subtotal"]), *line(2, F.lit("Tax"), m["tax"]), *line(3, F.when(F.col("view") == 0, "Grand").otherwise("TOTAL"), F.when(F.col("view") == 0, "Total").otherwise(m["total"]), F.when(F.col("view") == 0, m["total"]))]
    each = r.select(F.col("doc").cast("string").alias("doc_id"), "view", F.posexplode(F.array(*words)).alias("word_no", "w")).where("w.text is not null")
    return each.select("doc_id", "view", "word_no", "w.text", (F.col("w.at") * 120.0).alias("x0"), (F.col("w.row") * 30.0).alias("y0"), (F.col("w.at") * 120.0 + 100).alias("x1"), (F.col("w.row") * 30.0 + 20).alias("y1"), F.lit(90.0).alias("confidence"))


def page_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.labelled_amounts(layout.visual_rows(_pages(spark, sf_dir))).select("doc_id", "view", "row_no", "field", "norm", "score", "rule")


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed pages through the whole reader: candidates, vote, corroboration, stages, validation."""
    docs = api.Reader().read(_pages(spark, sf_dir))
    return docs.select("doc", "subtotal", "tax", "total", F.col("state_amount_balance").alias("balance"))


def paid_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with two totals as often read, one of which was paid in cash: payment settles it."""
    r = X.receipts(spark, sf_dir).where("total > 1000")
    lines = F.array(F.concat(F.lit("TOTAL "), X.money_text(F.col("total"))), F.concat(F.lit("TOTAL "), X.money_text(F.col("total") + 777)), F.concat(F.lit("CASH "), X.money_text(F.col("total"))))
    found = api.extract(_words(r.select("doc", lines.alias("lines"))), api.Config(vote=consensus.VoteConfig(primary_mask=1)))
    return found.where("field = 'total'").select("doc", "value", "confidence")


def third_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that name subtotal and total and print the tax without its label: the third amount is found by arithmetic."""
    r = X.receipts(spark, sf_dir).where("tax > 1000")
    lines = F.array(F.concat(F.lit("SUBTOTAL "), X.money_text(F.col("subtotal"))), F.concat(F.lit("plus "), X.money_text(F.col("tax")), F.lit(" for the state and the county")), F.concat(F.lit("GRAND TOTAL "), X.money_text(F.col("total"))))
    found = api.extract(_words(r.select("doc", lines.alias("lines"))))
    return found.where("field in ('subtotal', 'tax', 'total')").select("doc", "field", "value", "alert")


def _words(pages: DataFrame) -> DataFrame:
    """doc, lines to the words of two equal views, ten pixels a letter and thirty a row."""
    each = pages.withColumn("view", F.explode(F.array(F.lit(0), F.lit(1)))).select("doc", "view", F.posexplode("lines").alias("row", "line"))
    word = each.select("doc", "view", "row", "line", F.posexplode(F.split("line", " ")).alias("k", "text"))
    x0 = 10.0 * F.length(F.array_join(F.slice(F.split("line", " "), 1, F.col("k")), " ")) + F.when(F.col("k") > 0, 10.0).otherwise(0.0)
    return word.select(F.col("doc").cast("string").alias("doc_id"), "view", (F.col("row") * 100 + F.col("k")).cast("int").alias("word_no"), "text", x0.alias("x0"), (F.col("row") * 30.0).alias("y0"), (x0 + 10.0 * F.length("text")).alias("x1"), (F.col("row") * 30.0 + 20).alias("y1"), F.lit(90.0).alias("confidence"), F.col("row").cast("string").alias("line_id"))


def reread_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.rescue_reasons(_pages(spark, sf_dir)).select("doc_id", F.array_join("reasons", ";").alias("reasons"))


def tfidf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.regexp_replace(F.lower("text"), "[^a-z0-9 ]", "").alias("text"))
    return learning.tfidf(c, 3000).select("id", "term", F.round("weight", 9).alias("weight"))


def line_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = X.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line_no"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("amount"))
    return learning.line_positions(l.dropDuplicates(["doc_id", "line_no"]).join(l.groupBy("doc_id", "line_no").agg(F.max("amount").alias("top")), ["doc_id", "line_no"]).select("doc_id", "line_no", F.col("top").alias("amount")))


def weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.readings(spark, sf_dir).select(F.col("doc").alias("doc_id"), "field", F.col("view").alias("line_no"), "norm")
    truth = X.gold(spark, sf_dir).select(F.col("doc").alias("doc_id"), "field", X.money_text(F.col("cents")).alias("truth"))
    return learning.weak_labels(found, truth).groupBy("field", "line_no").agg(F.count_if("positive").alias("hits"), F.count("*").alias("n"))


R = "WITH " + X.READINGS_SQL
QUERIES = {f.__name__: f for f in (read_pages, paid_totals, third_from_pages, semantic_amounts, observed_accounting, third_amount, focused_agreement, rescue_nulls, main_evidence, nearest_number, page_candidates, reread_reasons, tfidf_lines, line_positions, weak_labels)}
_M = "({0} // 100)::VARCHAR || '.' || lpad(({0} % 100)::VARCHAR, 2, '0')"
ORACLES = {
    "semantic_amounts": R + """, v AS (SELECT doc, field, norm, max(score + 2) AS quality, count(DISTINCT view) AS views FROM readings WHERE view < 3 GROUP BY ALL), c AS (SELECT doc, field, norm AS value FROM readings WHERE view = 0),
s AS (SELECT v.*, value, round(quality + 2 * log2(1.0 + views), 9)::DOUBLE AS score FROM v LEFT JOIN c USING (doc, field) WHERE views >= 2 OR (quality >= 9 AND (value IS NULL OR value = norm))),
f AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY doc, field ORDER BY score DESC, norm))
SELECT doc, field, CASE WHEN nxt IS NULL OR score - nxt >= 0.75 THEN norm END AS proposed, score, NOT (nxt IS NULL OR score - nxt >= 0.75) AS conflict FROM f WHERE k = 1""",
    "observed_accounting": "WITH " + X.RECEIPTS_SQL + """ SELECT doc, total - CASE WHEN doc % 4 = 0 THEN 500 ELSE 0 END AS proposed, doc % 12 = 0 AS changed FROM receipts WHERE doc % 8 <> 0 AND tax * 100 <= subtotal * 40""",
    "third_amount": R + """, g AS (SELECT doc, field, cents, max(score) AS score, count(DISTINCT view) AS views FROM readings GROUP BY ALL),
a AS (SELECT doc, min(cents) FILTER (field = 'subtotal') AS s, min(cents) FILTER (field = 'tax') AS t, min(cents) FILTER (field = 'total') AS g FROM g WHERE score >= 7 AND views >= 5 AND NOT (field = 'total' AND doc % 2 = 0) AND NOT (field = 'tax' AND doc % 2 = 1) GROUP BY doc),
w AS (SELECT doc, CASE WHEN g IS NULL THEN 'total' WHEN t IS NULL THEN 'tax' ELSE 'subtotal' END AS field, CASE WHEN g IS NULL THEN s + t WHEN t IS NULL THEN g - s ELSE g - t END AS cents FROM a)
SELECT doc, field, cents FROM w WHERE cents > 0 AND EXISTS (SELECT 1 FROM readings r WHERE r.doc = w.doc AND r.cents = w.cents)""",
    "focused_agreement": R + """, v AS (SELECT doc, field, norm, count(DISTINCT view) AS n FROM readings WHERE view < 4 AND score * 9.0 >= 50 GROUP BY ALL HAVING count(DISTINCT view) >= 2),
o AS (SELECT doc, field, any_value(norm) AS norm FROM v GROUP BY ALL HAVING count(*) = 1), j AS (SELECT o.*, CASE WHEN doc % 2 = 0 THEN (cents // 100)::VARCHAR || '.' || lpad((cents % 100)::VARCHAR, 2, '0') END AS value FROM o JOIN gold USING (doc, field))
SELECT field, CASE WHEN value IS NULL THEN 'filled' WHEN value = norm THEN 'confirmed' ELSE 'disagrees' END AS outcome, count(*) AS n FROM j GROUP BY ALL""",
    "rescue_nulls": V.VOTE_SQL + """, g AS (SELECT doc, field, norm, max(score) AS score, count(DISTINCT view) AS views FROM readings GROUP BY ALL), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, field ORDER BY views DESC, norm) AS k FROM g) WHERE k = 1 AND score >= 6 AND views >= 2)
SELECT doc, field, coalesce(value, norm) AS value, value IS NULL AND norm IS NOT NULL AS rescued FROM voted LEFT JOIN t USING (doc, field)""",
    "main_evidence": V.VOTE_SQL + " SELECT r.doc, r.field, min(view) AS view, arg_min(r.score, view) AS score FROM readings r JOIN voted v ON r.doc = v.doc AND r.field = v.field AND r.norm = v.value GROUP BY ALL",
    "nearest_number": """WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber % 3 AS view, l_linenumber AS k, round(l_extendedprice * 100)::BIGINT AS value, 90 + l_quantity * 10 AS x0, l_linenumber * 10.0::DOUBLE + 6 AS y, (l_suppkey % 100)::DOUBLE AS conf FROM lineitem),
b AS (SELECT doc_id, view, min(k) * 10.0::DOUBLE AS y0 FROM l GROUP BY ALL),
c AS (SELECT doc_id, view, value, abs(y - (y0 + 6)) / 12 + 0.002::DOUBLE * (x0 - 100) - 0.002::DOUBLE * conf AS cost FROM l JOIN b USING (doc_id, view) WHERE x0 >= 97 AND abs(y - (y0 + 6)) <= 14.4::DOUBLE),
n AS (SELECT *, row_number() OVER w AS k, lead(cost) OVER w AS nxt FROM c WINDOW w AS (PARTITION BY doc_id, view ORDER BY cost, value))
SELECT doc_id, view, 'total' AS field, value, round(cost, 6) AS cost FROM n WHERE k = 1 AND (nxt IS NULL OR nxt - cost > 0.3::DOUBLE)""",
    "read_pages": "WITH " + X.RECEIPTS_SQL + f""" SELECT doc::VARCHAR AS doc, {_M.format('subtotal')} AS subtotal, {_M.format('tax')} AS tax, {_M.format('total')} AS total, 'consistent' AS balance FROM receipts WHERE total > 0""",
    "paid_totals": "WITH " + X.RECEIPTS_SQL + f""" SELECT doc::VARCHAR AS doc, {_M.format('total')} AS value, 'alta' AS confidence FROM receipts WHERE total > 1000""",
    "third_from_pages": "WITH " + X.RECEIPTS_SQL + f""" SELECT doc::VARCHAR AS doc, unnest(['subtotal', 'tax', 'total']) AS field, unnest([{_M.format('subtotal')}, {_M.format('tax')}, {_M.format('total')}]) AS value, unnest([NULL, 'tax:third_amount', NULL]) AS alert FROM receipts WHERE tax > 1000""",
    "page_candidates": "WITH " + X.RECEIPTS_SQL + """, p AS (SELECT doc::VARCHAR AS doc_id, view, unnest([1, 2, 3])::INTEGER AS row_no, unnest(['subtotal', 'tax', 'total']) AS field, unnest([subtotal, tax, total]) AS cents, unnest([7, 7, CASE WHEN view = 0 THEN 8 ELSE 6 END]) AS score FROM receipts, (SELECT unnest([0, 1])::INTEGER AS view) WHERE total > 0)
SELECT doc_id, view, row_no, field, (cents // 100)::VARCHAR || '.' || lpad((cents % 100)::VARCHAR, 2, '0') AS norm, score, 'beside_label' AS rule FROM p""",
    "reread_reasons": "WITH " + X.RECEIPTS_SQL + " SELECT doc::VARCHAR AS doc_id, 'few_words' AS reasons FROM receipts WHERE total > 0",
    "tfidf_lines": """WITH t AS (SELECT item_id::VARCHAR AS id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g'), '[0-9]', '0', 'g') AS text FROM benchmark),
w AS (SELECT id, ' ' || unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) || ' ' AS w FROM t),
g AS (SELECT id, unnest(flatten([list_transform(range(1, greatest(2, length(w) + 2 - n)), lambda i: substr(w, i, n)) FOR n IN [2, 3, 4]])) AS term FROM w),
f AS (SELECT id, term, count(*) AS tf FROM g GROUP BY ALL), d AS (SELECT term, sum(tf) AS total, count(*) AS df FROM f GROUP BY ALL ORDER BY total DESC, term LIMIT 3000),
x AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM t)) / (1 + df)) + 1) AS w FROM f JOIN d USING (term))
SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 9) AS weight FROM x""",
    "line_positions": """WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS line_no, max(round(l_extendedprice * 100)::BIGINT) AS amount FROM lineitem GROUP BY ALL)
SELECT *, CASE WHEN count(*) OVER w > 1 THEN (row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1) / (count(*) OVER w - 1) ELSE 0.0 END::DOUBLE AS position, amount = max(amount) OVER w AS has_largest FROM l WINDOW w AS (PARTITION BY doc_id)""",
    "weak_labels": R + ", j AS (SELECT r.doc, r.field, r.view AS line_no, r.cents = g.cents AS positive FROM readings r JOIN gold g USING (doc, field)) SELECT field, line_no, count(*) FILTER (positive) AS hits, count(*) AS n FROM j GROUP BY ALL",
}
