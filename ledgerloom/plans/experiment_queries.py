"""Reserves, costs and choices of experiments over the fixture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import experiments as P
from ledgerloom.operators import sampling as S
from ledgerloom.plans import fixtures as X
from ledgerloom.plans import sampling_queries as Q


def _manifest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = S.hash_split(Q.manifest(spark, sf_dir))
    return m, m.where(F.col("id").cast("long") % 9 == 0).select("id", "sha256")


def not_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows that nobody has seen, and how many each rule leaves out."""
    rows = P.not_reviewed(*_manifest(spark, sf_dir))
    return rows.groupBy("dataset", F.coalesce("reason", F.lit("elegible")).alias("motivo")).agg(F.count("*").alias("n"))


def known_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, _ = _manifest(spark, sf_dir)
    return P.known_sample(m, 30, 11).select("id", "dataset", "place")


def random_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reserve draws from documents that the ledger does not have."""
    m, seen = _manifest(spark, sf_dir)
    return P.random_unseen(m, seen, 15, 5).select("id", "dataset", "place")


def curve_subsamples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"))
    drawn = P.curve_subsamples(docs, (0.1, 0.25, 0.5, 1.0), (1, 2))
    return drawn.groupBy("seed", "fraction").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of each view of each document, as the hash of the reading has it."""
    r = X.readings(spark, sf_dir).where("field = 'total'")
    ms = X.hex_int(X.noise(F.col("doc"), F.lit("s"), F.col("view")), 1, 4) % 5000
    return r.select(F.col("doc").alias("id"), F.when(F.col("doc") % 3 == 0, "scan").otherwise("photo").alias("dataset"), "view", ms.alias("ms"))


def view_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.view_times(_timed(spark, sf_dir))


def configuration_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three configurations: all views, half of them, the primary ones."""
    return P.configuration_cost(_timed(spark, sf_dir), {"todas": list(range(X.VIEWS)), "mitad": list(range(0, X.VIEWS, 2)), "principal": [1, 6]})


def recovered_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.detail(spark, sf_dir)
    touched = d.where("id % 4 = 1").select("id", F.concat("field", F.lit(":"), F.when(F.col("id") % 8 == 1, "rescued").otherwise("accounted")).alias("alert"))
    return P.recovered_accuracy(d, touched, ("rescued", "accounted"))


def amount_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts as view 0 read them: whether sums add up and the tax is a likely share."""
    r = X.readings(spark, sf_dir).where("view = 0").groupBy("doc").pivot("field", ["subtotal", "tax", "total"]).agg(F.max("cents"))
    return P.amount_balance(r)


def choose_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as versions; view 0 is the one in use."""
    d = X.gold(spark, sf_dir).select("doc", "field", F.col("cents").alias("want")).withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(X.VIEWS - 1))))
    seen = d.join(X.readings(spark, sf_dir).select("doc", "field", "view", "cents"), ["doc", "field", "view"], "left")
    by = seen.groupBy("view", "field").agg(F.count("*").alias("n"), F.count_if(F.col("cents") == F.col("want")).alias("ok"), F.count("cents").alias("read"))
    runs = by.groupBy(F.concat(F.lit("v"), F.col("view").cast("string")).alias("version")).agg((F.sum("ok") / F.sum("n")).alias("exactitud"), F.min(F.col("ok") / F.col("n")).alias("min_field"), (F.sum("read") / F.sum("n")).alias("procesamiento"))
    return P.choose(runs, "v0", 0.85)


def cer_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as regions of a page: place from the line, some to be ignored, some pages with an issue."""
    l = X.table(spark, sf_dir, "lineitem")
    regions = l.select(F.col("l_orderkey").alias("id"), F.struct((F.col("l_linenumber") % 3).cast("int").alias("y0"), F.col("l_partkey").cast("int").alias("x0"), F.when(F.col("l_linenumber") == 2, "Ignore").otherwise("text").alias("label"), F.col("l_returnflag").alias("text")).alias("r"))
    pages = regions.groupBy("id").agg(F.collect_list("r").alias("regions")).withColumn("issues", F.when(F.col("id") % 10 == 3, F.array(F.lit("invalid_box"))).otherwise(F.array().cast("array<string>")))
    return pages.select("id", P.cer_reference(F.col("regions"), F.col("issues")).alias("reference"))


S_ = Q.M
_TIMED = "WITH " + X.READINGS_SQL + ", tm AS (SELECT doc AS id, CASE WHEN doc % 3 = 0 THEN 'scan' ELSE 'photo' END AS dataset, view, ('0x' || substr(sha256(concat_ws(':', doc::VARCHAR, 's', view::VARCHAR)), 1, 4))::BIGINT % 5000 AS ms FROM readings WHERE field = 'total')"
_UNSEEN = """, r0 AS (SELECT id, dataset, sha256, split, CASE WHEN split <> 'test' THEN 'x' WHEN id IN (SELECT id FROM led) OR sha256 IN (SELECT sha256 FROM led) OR sha256 IN (SELECT sha256 FROM manifest WHERE source_split <> 'test') THEN 'x' END AS bad FROM split WHERE source_split = 'test')"""

QUERIES = {f.__name__: f for f in (not_reviewed, known_sample, random_unseen, curve_subsamples, view_times, configuration_cost, recovered_accuracy, amount_balance, choose_configuration, cer_references)}
ORACLES = {
    "not_reviewed": S_ + """, t AS (SELECT id, dataset, sha256, CASE WHEN id IN (SELECT id FROM led) OR sha256 IN (SELECT sha256 FROM led) THEN 'ya_revisado' WHEN sha256 IN (SELECT sha256 FROM split WHERE split <> 'train') THEN 'imagen_en_otra_particion' END AS m FROM split WHERE split = 'train'),
u AS (SELECT dataset, CASE WHEN m IS NULL AND row_number() OVER (PARTITION BY sha256, m ORDER BY dataset, id) > 1 THEN 'imagen_duplicada' ELSE coalesce(m, 'elegible') END AS motivo FROM t) SELECT dataset, motivo, count(*) AS n FROM u GROUP BY ALL""",
    "known_sample": S_ + """, p AS (SELECT * FROM split WHERE source_split = 'test' AND split = 'test' AND sha256 NOT IN (SELECT sha256 FROM manifest WHERE source_split <> 'test' AND sha256 IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY dataset, id) = 1)
SELECT id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY sha256('11:' || id), id) AS place FROM p QUALIFY place <= 30""",
    "random_unseen": S_ + _UNSEEN + """, p AS (SELECT * FROM r0 WHERE bad IS NULL QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY dataset, id) = 1)
SELECT id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY sha256('5:' || id), id) AS place FROM p QUALIFY place <= 15""",
    "curve_subsamples": """WITH d AS (SELECT doc_id::VARCHAR AS id, unnest([1, 2]) AS seed FROM documents), o AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY sha256(seed || ':' || id), id) AS place, count(*) OVER (PARTITION BY seed) AS n FROM d),
f AS (SELECT *, unnest([0.1::DOUBLE, 0.25, 0.5, 1.0]) AS fraction FROM o) SELECT seed, fraction, count(*) AS n, min(id) AS first_id FROM f WHERE place <= greatest(5, floor(fraction * n)) GROUP BY ALL""",
    "view_times": _TIMED + " SELECT dataset, view, count(*) AS n, sum(ms)::BIGINT AS ms, quantile_cont(ms, 0.5) AS mediana_ms FROM tm GROUP BY ALL",
    "configuration_cost": _TIMED + """, c AS (SELECT 'todas' AS configuracion, range(10) AS vs UNION ALL SELECT 'mitad', range(0, 10, 2) UNION ALL SELECT 'principal', [1, 6]),
p AS (SELECT configuracion, id, sum(CASE WHEN list_contains(vs, view) THEN ms ELSE 0 END) AS ms FROM tm, c GROUP BY ALL) SELECT configuracion, quantile_cont(ms, 0.5) AS mediana_ms FROM p GROUP BY ALL""",
    "recovered_accuracy": "WITH " + X.DETAIL_SQL + " SELECT CASE WHEN id % 8 = 1 THEN 'rescued' ELSE 'accounted' END AS sufijo, count(*) AS campos, sum(correct)::BIGINT AS correctos, avg(correct) * 100 AS exactitud FROM detail WHERE id % 4 = 1 GROUP BY ALL",
    "amount_balance": "WITH " + X.READINGS_SQL + """, w AS (SELECT doc, max(cents) FILTER (field = 'subtotal') AS s, max(cents) FILTER (field = 'tax') AS t, max(cents) FILTER (field = 'total') AS g FROM readings WHERE view = 0 GROUP BY doc)
SELECT count(*) AS recibos, count(*) FILTER (abs(s + t - g) <= 2) AS cuadran, count(*) FILTER (t * 100 >= s * 2 AND t * 100 <= s * 30 AND s <> 0) AS razon_probable FROM w WHERE s <> 0 AND t <> 0 AND g <> 0""",
    "choose_configuration": "WITH " + X.READINGS_SQL + f""", v AS (SELECT doc, field, cents AS want, unnest(range({X.VIEWS}))::INTEGER AS view FROM gold),
b AS (SELECT v.view, v.field, count(*) AS n, count(*) FILTER (r.cents = v.want) AS ok, count(r.cents) AS rd FROM v LEFT JOIN readings r ON r.doc = v.doc AND r.field = v.field AND r.view = v.view GROUP BY ALL),
e AS (SELECT 'v' || view AS version, sum(ok) / sum(n) AS exactitud, min(ok / n) AS min_field, sum(rd) / sum(n) AS procesamiento FROM b GROUP BY view)
SELECT * FROM e WHERE procesamiento >= 0.85 ORDER BY exactitud DESC, min_field DESC, version = 'v0' DESC, version LIMIT 1""",
    "cer_references": """WITH l AS (SELECT l_orderkey AS id, l_linenumber % 3 AS y, l_partkey AS x, CASE WHEN l_linenumber = 2 THEN 'Ignore' ELSE 'text' END AS label, l_returnflag AS t FROM lineitem)
SELECT id, CASE WHEN id % 10 <> 3 THEN coalesce(string_agg(t, ' ' ORDER BY y, x, t) FILTER (label <> 'Ignore'), '') END AS reference FROM l GROUP BY id""",
}
