"""Sampling, exploration, joins, windows and set operators over the fixture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import exploration as E
from ledgerloom.operators import sampling as S
from ledgerloom.plans.fixtures import table


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a manifest: a quarter are the official test, sources are two datasets, copies share a hash."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 2 == 0, "scan").otherwise("photo").alias("dataset"),
        F.when(F.col("doc_id") % 4 == 1, "test").otherwise("train").alias("source_split"), F.sha2("text", 256).alias("sha256"),
    )


def _ledger(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("id").cast("long") % 9 == 0).select("id", "sha256")


def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hash_split(manifest(spark, sf_dir)).select("id", "dataset", "split", F.array_join("issues", ";").alias("issues"))


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.hash_split(manifest(spark, sf_dir))
    return s.select("split", F.explode_outer("issues").alias("issue")).groupBy("split", "issue").agg(F.count("*").alias("n"))


def unseen_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = S.hash_split(manifest(spark, sf_dir))
    return S.unseen_inventory(m, _ledger(m)).select("id", "dataset", "reason")


def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.seeded_sample(manifest(spark, sf_dir), 25).select("id", "dataset", "place")


def disjoint_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.disjoint_samples(manifest(spark, sf_dir).where("source_split = 'train'"), 20, 15, 7).select("id", "dataset", "place", "part")


def leak_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir)
    return S.leak_matrix(m.select("sha256", F.concat_ws("-", "source_split", "dataset").alias("split")))


def sample_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sample_signature(manifest(spark, sf_dir))


def reviewed_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id or hash is in the ledger of reviewed ones, and those left without them."""
    m = manifest(spark, sf_dir)
    led = _ledger(m)
    hit = m.join(led.select("sha256").distinct(), "sha256", "left_semi")
    free = m.join(led.select("sha256").distinct(), "sha256", "left_anti")
    return hit.groupBy("dataset").agg(F.count("*").alias("n")).withColumn("kind", F.lit("repeated")).unionByName(free.groupBy("dataset").agg(F.count("*").alias("n")).withColumn("kind", F.lit("unseen")))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    long = d.select("lang", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.when(F.col(c).isNull(), "unannotated").otherwise("annotated").alias("status")) for c in ("quality", "toxic")))).alias("g"))
    return E.coverage(long.select(F.col("lang").alias("dataset"), "g.field", "g.status"))


def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.crosstab(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


def crosstab_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return by.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("o_orderpriority")))


def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.describe(table(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice")


def iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.iqr_outliers(table(spark, sf_dir, "documents"), "lang", "n_chars")


def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.spearman(table(spark, sf_dir, "part"), "p_size", "p_retailprice", "p_brand")


def terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = E.terciles(table(spark, sf_dir, "documents"), "source", "n_chars", "doc_id")
    return t.groupBy("source", "tercil").agg(F.count("*").alias("n"), F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))


def date_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest shapes of a printed date, with an example, and the share that may be read two ways."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderdate")
    printed = o.select("k", F.when(F.col("k") % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(F.col("k") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "MM-dd-yy")).alias("s"))
    a, b = F.regexp_extract("s", r"^(\d{1,2})[/-](\d{1,2})[/-]", 1), F.regexp_extract("s", r"^(\d{1,2})[/-](\d{1,2})[/-]", 2)
    either = (a != "") & (a != b) & (F.coalesce(a.try_cast("int"), F.lit(99)) <= 12) & (F.coalesce(b.try_cast("int"), F.lit(99)) <= 12)
    return printed.groupBy(E.pattern_of(F.col("s")).alias("patron")).agg(F.count("*").alias("n"), F.min("s").alias("ejemplo"), (F.avg(F.coalesce(either, F.lit(False)).cast("double")) * 100).alias("ambiguas_pct")).orderBy(F.desc("n"), "patron").limit(8)


def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return E.top_per_group(e, "event_type", [F.desc("value"), F.col("event_id")], 8).select("event_type", "place", "event_id", "value")


def extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(3).withColumn("end", F.lit("largest")).unionByName(o.orderBy("o_totalprice", "o_orderkey").limit(3).withColumn("end", F.lit("smallest")))


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.first_of_copies(manifest(spark, sf_dir), F.col("source_split") != "test", "id").select("id", "source_split")


def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of union, intersection and difference of the customers of two years."""
    o = table(spark, sf_dir, "orders")
    a, b = (o.where(F.year("o_orderdate") == y).select("o_custkey") for y in (1995, 1996))
    parts = {"union": a.unionByName(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "union_all": a.unionByName(b)}
    out = None
    for k, df in parts.items():
        one = df.agg(F.lit(k).alias("op"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a restarted run has still to do: orders without a finished line."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    todo = o.join(l.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")
    return todo.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


def prediction_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join with a default for what is missing: documents and the level of their label."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "alta").otherwise("baja").alias("nivel")), "doc_id", "left")
    return d.groupBy("lang", F.coalesce("nivel", F.lit("sin_valor")).alias("nivel")).agg(F.count("*").alias("n"))


def class_list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small dimension joined by its size, then a rollup over it."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("saldo"))


def payment_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals that occur among the payments of the same customer, and those that don't."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.round("o_totalprice").cast("long").alias("amount"))
    paid = o.where("o_orderkey % 2 = 0").select("o_custkey", (F.col("amount") - F.col("amount") % 1000).alias("bucket")).distinct()
    mine = o.withColumn("bucket", F.col("amount") - F.col("amount") % 1000).where("o_orderkey % 2 = 1")
    return mine.join(paid, ["o_custkey", "bucket"], "left_semi").groupBy("o_custkey").agg(F.count("*").alias("supported"), F.sum("amount").alias("amount"))


def running_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section a row is in: the last header before it, carried on."""
    e = table(spark, sf_dir, "events")
    header = F.when(F.col("event_id") % 17 == 0, F.col("event_type"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = e.withColumn("section", F.last_value(header, True).over(w))
    return s.groupBy("section", "event_type").agg(F.count("*").alias("n"))


def label_value_next_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value in one of the two rows below its label, within a gap: rows are a user's events in order of time."""
    e = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    near = lambda k: (F.lead("event_type", k).over(w) == "purchase") & (F.lead("t", k).over(w) - F.col("t") <= F.lit(6 * 3600 * 1_000_000))
    found = e.withColumn("v", F.when(near(1), F.lead("value", 1).over(w)).when(near(2), F.lead("value", 2).over(w)))
    return found.where("event_type = 'click' and v is not null").select("event_id", "v")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


def boolean_any_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("alguno"), F.bool_and(F.col("o_orderstatus") == "F").alias("todos"), F.count_distinct("o_orderpriority").alias("prioridades"))


def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest priority of a customer; the first by name of equals."""
    c = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    return c.groupBy("o_custkey").agg(F.min_by("o_orderpriority", F.struct(-F.col("n"), "o_orderpriority")).alias("modo"))


def document_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ok if all pages are, error if none is, else partial: pages are the lines of an order."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.col("l_linestatus") == "F").alias("lo"), F.max(F.col("l_linestatus") == "F").alias("hi"))
    return l.groupBy(F.when(F.col("lo"), "ok").when(~F.col("hi"), "error").otherwise("parcial").alias("estado")).agg(F.count("*").alias("n"))


def pivot_long_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return e.groupBy("day").pivot("event_type", ["click", "purchase", "view"]).agg(F.count("event_id")).na.fill(0)


def histogram_otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = E.histogram(table(spark, sf_dir, "orders"), "o_orderstatus", F.col("o_totalprice") / 600000.0, 256)
    return E.otsu(h, "o_orderstatus")


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON column with an explicit schema; what does not parse is null."""
    e = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k long", {"mode": "PERMISSIVE"})["k"])
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("s"), F.max("k").alias("m"))


M = """WITH manifest AS (SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 2 = 0 THEN 'scan' ELSE 'photo' END AS dataset, CASE WHEN doc_id % 4 = 1 THEN 'test' ELSE 'train' END AS source_split, sha256(text) AS sha256 FROM documents),
led AS (SELECT id, sha256 FROM manifest WHERE id::BIGINT % 9 = 0),
s0 AS (SELECT *, bool_or(source_split = 'test') OVER (PARTITION BY sha256) AND source_split <> 'test' AS tc, row_number() OVER (PARTITION BY sha256 ORDER BY source_split <> 'test', id) > 1 AS ag FROM manifest),
split AS (SELECT id, dataset, source_split, sha256, tc, ag, CASE WHEN tc OR ag THEN 'quarantine' WHEN source_split = 'test' THEN 'test'
  WHEN ('0x' || substr(sha256('42:' || sha256), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2 THEN 'validation' ELSE 'train' END AS split FROM s0)"""


def _sample(seed: int, n: int, where: str = "true") -> str:
    return f""",
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY sha256('{seed}:' || id), id) AS k FROM manifest WHERE {where}) WHERE k = 1),
smp AS (SELECT * FROM (SELECT id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY sha256('{seed}:' || id), id) AS place FROM u) WHERE place <= {n})"""


QUERIES = {f.__name__: f for f in (hash_split, split_counts, unseen_inventory, seeded_sample, disjoint_samples, leak_matrix, sample_signature, reviewed_overlap, coverage, crosstab, crosstab_normalised, describe, iqr_outliers, spearman, terciles, date_patterns, topk_per_group, extremes, dedup_first, set_ops, resume_antijoin, prediction_lookup, class_list_join, payment_semijoin, running_section, label_value_next_row, event_windows, boolean_any_all, modes, document_state, pivot_long_wide, histogram_otsu, json_fields)}
ORACLES = {
    "hash_split": M + " SELECT id, dataset, split, concat_ws(';', CASE WHEN tc THEN 'duplicate_in_official_test' END, CASE WHEN ag THEN 'duplicate_image_hash' END) AS issues FROM split",
    "split_counts": M + " SELECT split, issue, count(*) AS n FROM (SELECT split, unnest(CASE WHEN tc AND ag THEN ['duplicate_in_official_test', 'duplicate_image_hash'] WHEN tc THEN ['duplicate_in_official_test'] WHEN ag THEN ['duplicate_image_hash'] ELSE [NULL] END) AS issue FROM split) GROUP BY ALL",
    "unseen_inventory": M + """, r AS (SELECT id, dataset, sha256, CASE WHEN split <> 'test' THEN 'not_eligible' WHEN id IN (SELECT id FROM led) THEN 'id_reviewed' WHEN sha256 IN (SELECT sha256 FROM led) THEN 'image_reviewed' WHEN sha256 IN (SELECT sha256 FROM manifest WHERE source_split <> 'test') THEN 'copy_of_development' END AS reason FROM split WHERE source_split = 'test')
SELECT id, dataset, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY sha256, reason IS NULL ORDER BY dataset, id) > 1 THEN 'copy_within_test' ELSE reason END AS reason FROM r""",
    "seeded_sample": M + _sample(42, 25) + " SELECT * FROM smp",
    "disjoint_samples": M + _sample(7, 35, "source_split = 'train'") + " SELECT *, CASE WHEN place <= 20 THEN 'optimisation' ELSE 'control' END AS part FROM smp",
    "leak_matrix": M + ", a AS (SELECT DISTINCT sha256, source_split || '-' || dataset AS a FROM manifest) SELECT x.a, y.a AS b, count(*) AS shared FROM a x JOIN a y ON x.sha256 = y.sha256 AND x.a < y.a GROUP BY ALL",
    "sample_signature": M + ", p AS (SELECT ('0x' || substr(sha256(id), 1, 3))::INT AS part, sha256(string_agg(id || sha256, '' ORDER BY id || sha256)) AS h FROM manifest GROUP BY ALL) SELECT sha256(string_agg(h, '' ORDER BY part)) AS signature FROM p",
    "reviewed_overlap": M + " SELECT dataset, count(*) AS n, CASE WHEN sha256 IN (SELECT sha256 FROM led) THEN 'repeated' ELSE 'unseen' END AS kind FROM manifest GROUP BY ALL",
    "coverage": "WITH l AS (SELECT lang AS dataset, unnest(['quality', 'toxic']) AS field, unnest([quality, toxic]) AS v FROM documents LEFT JOIN labels USING (doc_id)) SELECT dataset, field, count(*) AS documents, count(v) AS annotated, count(*) - count(v) AS unannotated, 0::BIGINT AS ambiguous, count(v) / count(*) AS coverage FROM l GROUP BY ALL",
    "crosstab": "SELECT coalesce(o_orderpriority, 'All') AS o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\", count(*) AS \"All\" FROM orders GROUP BY ROLLUP (o_orderpriority)",
    "crosstab_normalised": "SELECT *, n / sum(n) OVER (PARTITION BY o_orderpriority) AS share FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)",
    "describe": "SELECT o_orderstatus, count(o_totalprice) AS count, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS std, min(o_totalprice) AS min, quantile_cont(o_totalprice, 0.25) AS p25, quantile_cont(o_totalprice, 0.5) AS p50, quantile_cont(o_totalprice, 0.75) AS p75, max(o_totalprice) AS max FROM orders GROUP BY ALL",
    "iqr_outliers": "WITH q AS (SELECT lang, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3 FROM documents GROUP BY lang), l AS (SELECT lang, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q) SELECT lang, low, high, count(*) FILTER (n_chars < low OR n_chars > high) AS outliers, avg((n_chars < low OR n_chars > high)::INT) * 100 AS pct FROM documents JOIN l USING (lang) GROUP BY ALL",
    "spearman": "WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 AS ry FROM part) SELECT p_brand, corr(rx, ry) AS rho, count(*) AS n FROM r GROUP BY ALL",
    "terciles": "WITH r AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents), t AS (SELECT *, CASE WHEN r <= 1 + (n - 1) / 3.0::DOUBLE THEN 1 WHEN r <= 1 + 2 * (n - 1) / 3.0::DOUBLE THEN 2 ELSE 3 END AS tercil FROM r) SELECT source, tercil, count(*) AS n, min(n_chars) AS lo, max(n_chars) AS hi FROM t GROUP BY ALL",
    "date_patterns": """WITH p AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%m-%d-%y') END AS s FROM orders),
x AS (SELECT s, regexp_replace(regexp_replace(s, '[A-Za-z]', 'A', 'g'), '[0-9]', '9', 'g') AS patron, regexp_extract(s, '^(\\d{1,2})[/-](\\d{1,2})[/-]', 1) AS a, regexp_extract(s, '^(\\d{1,2})[/-](\\d{1,2})[/-]', 2) AS b FROM p)
SELECT patron, count(*) AS n, min(s) AS ejemplo, avg((a <> '' AND a <> b AND coalesce(TRY_CAST(a AS INT), 99) <= 12 AND coalesce(TRY_CAST(b AS INT), 99) <= 12)::INT) * 100 AS ambiguas_pct FROM x GROUP BY patron ORDER BY n DESC, patron LIMIT 8""",
    "topk_per_group": "SELECT event_type, place, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS place FROM events) WHERE place <= 8",
    "extremes": "(SELECT o_orderkey, o_totalprice, 'largest' AS \"end\" FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3) UNION ALL (SELECT o_orderkey, o_totalprice, 'smallest' FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 3)",
    "dedup_first": M + " SELECT id, source_split FROM s0 WHERE NOT ag",
    "set_ops": "WITH a AS (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1995), b AS (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996) SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'union_all', count(*) FROM (SELECT * FROM a UNION ALL SELECT * FROM b)",
    "resume_antijoin": "SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS first_key FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F') GROUP BY ALL",
    "prediction_lookup": "SELECT lang, coalesce(CASE WHEN quality = 1 THEN 'alta' WHEN quality IS NOT NULL THEN 'baja' END, 'sin_valor') AS nivel, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL",
    "class_list_join": "SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS saldo FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "payment_semijoin": "WITH o AS (SELECT o_orderkey, o_custkey, round(o_totalprice)::BIGINT AS amount FROM orders) SELECT o_custkey, count(*) AS supported, sum(amount)::BIGINT AS amount FROM o WHERE o_orderkey % 2 = 1 AND EXISTS (SELECT 1 FROM o p WHERE p.o_orderkey % 2 = 0 AND p.o_custkey = o.o_custkey AND p.amount - p.amount % 1000 = o.amount - o.amount % 1000) GROUP BY ALL",
    "running_section": "WITH s AS (SELECT event_type, last_value(CASE WHEN event_id % 17 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events) SELECT section, event_type, count(*) AS n FROM s GROUP BY ALL",
    "label_value_next_row": """WITH t AS (SELECT *, epoch_us(ts) AS t FROM events), w AS (SELECT event_id, event_type, t, lead(event_type, 1) OVER w AS e1, lead(t, 1) OVER w AS t1, lead(value, 1) OVER w AS v1, lead(event_type, 2) OVER w AS e2, lead(t, 2) OVER w AS t2, lead(value, 2) OVER w AS v2 FROM t WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
f AS (SELECT event_id, event_type, CASE WHEN e1 = 'purchase' AND t1 - t <= 21600000000 THEN v1 WHEN e2 = 'purchase' AND t2 - t <= 21600000000 THEN v2 END AS v FROM w) SELECT event_id, v FROM f WHERE event_type = 'click' AND v IS NOT NULL""",
    "event_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    "boolean_any_all": "SELECT o_custkey, bool_or(o_orderstatus = 'F') AS alguno, bool_and(o_orderstatus = 'F') AS todos, count(DISTINCT o_orderpriority) AS prioridades FROM orders GROUP BY ALL",
    "modes": "SELECT o_custkey, arg_min(o_orderpriority, (-n, o_orderpriority)) AS modo FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY ALL",
    "document_state": "SELECT CASE WHEN lo THEN 'ok' WHEN NOT hi THEN 'error' ELSE 'parcial' END AS estado, count(*) AS n FROM (SELECT l_orderkey, bool_and(l_linestatus = 'F') AS lo, bool_or(l_linestatus = 'F') AS hi FROM lineitem GROUP BY ALL) GROUP BY ALL",
    "pivot_long_wide": "SELECT ts::DATE AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY ALL",
    "histogram_otsu": """WITH h AS (SELECT o_orderstatus, least(255, floor(o_totalprice / 600000.0::DOUBLE * 256))::INT AS bin, count(*) AS n FROM orders GROUP BY ALL),
c AS (SELECT o_orderstatus, bin, sum(n) OVER w AS w0, sum(n * bin) OVER w AS m0, sum(n) OVER p AS wt, sum(n * bin) OVER p AS mt FROM h WINDOW w AS (PARTITION BY o_orderstatus ORDER BY bin), p AS (PARTITION BY o_orderstatus)),
v AS (SELECT *, round(coalesce(w0::DOUBLE * (wt - w0) * (m0 / w0 - (mt - m0) / nullif(wt - w0, 0)) * (m0 / w0 - (mt - m0) / nullif(wt - w0, 0)), 0) / (wt::DOUBLE * wt), 9) AS v FROM c)
SELECT o_orderstatus, arg_min(bin, (-v, bin)) AS threshold FROM v GROUP BY ALL""",
    "json_fields": "WITH k AS (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_type, count(k) AS n, sum(k)::BIGINT AS s, max(k) AS m FROM k GROUP BY ALL",
}
