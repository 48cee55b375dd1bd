"""Receipts, gold values and readings derived from the order lines, as plans and as the same tables in SQL.

Money is whole cents, so sums are exact in both engines and cost a long. Noise comes from SHA-256 of names, so every
engine draws the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = 10
#: Views 1 and 6 are the primary reading and weigh more.
PRIMARY_MASK = (1 << 1) | (1 << 6)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _whole(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, subtotal, tax, total."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), _whole("l_extendedprice").alias("p"), _whole("l_discount").alias("d"), _whole("l_tax").alias("t"))
    net = F.col("p") * (100 - F.col("d"))
    sums = lines.groupBy("doc").agg(F.sum(net).alias("n"), F.sum(net * F.col("t")).alias("x"))
    cents = sums.select("doc", F.expr("(n + 50) div 100").alias("subtotal"), F.expr("(x + 5000) div 10000").alias("tax"))
    return cents.withColumn("total", F.col("subtotal") + F.col("tax"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, field, cents."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("cents")) for f in ("subtotal", "tax", "total")))
    return receipts(spark, sf_dir).select("doc", F.explode(pairs).alias("g")).select("doc", "g.field", "g.cents")


def hex_int(h: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(h, start, length), 16, 10).cast("long")


def money_text(cents: Column) -> Column:
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def noise(doc: Column, field: Column, view: Column) -> Column:
    return F.sha2(F.concat_ws(":", doc.cast("string"), field, view.cast("string")), 256)


def misread(cents: Column, h: Column) -> Column:
    """Of a hundred readings 12 are missing, 18 are ten cents off and 10 lost their decimal point."""
    draw = hex_int(h, 1, 8) % 100
    return F.when(draw < 12, None).when(draw < 30, cents + 10).when(draw < 40, cents * 10).otherwise(cents)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, field, view, cents, norm, score: what each view read."""
    seen = gold(spark, sf_dir).withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(VIEWS - 1)))).withColumn("h", noise(F.col("doc"), F.col("field"), F.col("view")))
    seen = seen.withColumn("cents", misread(F.col("cents"), F.col("h"))).where("cents is not null")
    return seen.select("doc", "field", "view", "cents", money_text(F.col("cents")).alias("norm"), (hex_int(F.col("h"), 9, 2) % 3 + F.when(F.col("field") == "total", 6).otherwise(5)).cast("int").alias("score"))


def detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and evaluable field, as an evaluation has them: what view 0 read against gold."""
    h = noise(F.col("doc"), F.col("field"), F.lit(0))
    rows = gold(spark, sf_dir).withColumn("h", h)
    rows = rows.select(
        F.col("doc").alias("id"), F.when(F.col("doc") % 3 == 0, "scan").otherwise("photo").alias("dataset"), "field",
        F.when((F.col("doc") % 11 == 0) & (F.col("field") == "tax"), None).otherwise(money_text(F.col("cents"))).alias("gold_normalized"),
        money_text(misread(F.col("cents"), F.col("h"))).alias("read"),
        (hex_int(F.sha2(F.concat(F.lit("run:"), F.col("doc").cast("string")), 256), 1, 4) % 100 >= 4).alias("execution_ok"),
        (hex_int(F.col("h"), 11, 2) % 3).cast("int").alias("lv"), F.col("cents"),
    ).where(~((F.col("id") % 7 == 0) & (F.col("field") == "subtotal")))
    predicted = F.when(F.col("execution_ok"), F.col("read"))
    truth = F.col("gold_normalized")
    rows = rows.withColumn("predicted_normalized", predicted)
    same = truth.eqNullSafe(F.col("predicted_normalized"))
    scored = rows.withColumns({
        "correct": (F.col("execution_ok") & same).cast("int"),
        "tp": F.coalesce(F.col("execution_ok") & (truth == F.col("predicted_normalized")), F.lit(False)).cast("int"),
        "fp": (F.col("predicted_normalized").isNotNull() & ~same).cast("int"),
        "fn": (truth.isNotNull() & ~same).cast("int"),
    })
    level = F.when(F.col("predicted_normalized").isNull(), "sin_valor").otherwise(F.element_at(F.array(F.lit("alta"), F.lit("media"), F.lit("baja")), F.col("lv") + 1))
    kind = F.when(F.col("correct") == 1, "correcto").when(F.col("predicted_normalized").isNull(), "omision").otherwise("equivocado")
    scored = scored.withColumn("confianza", level).withColumn("tipo", kind)
    return scored.withColumn("silencioso", (F.col("tipo") == "equivocado") & (F.col("confianza") == "alta")).drop("lv", "read", "cents")


def _noise_sql(view: str) -> str:
    return f"sha256(concat_ws(':', doc::VARCHAR, field, {view}::VARCHAR))"


_CENTS = "(cents // 100)::VARCHAR || '.' || lpad((cents % 100)::VARCHAR, 2, '0')"
_DRAW = "('0x' || substr(h, 1, 8))::BIGINT % 100"
_MISREAD = f"CASE WHEN {_DRAW} < 12 THEN NULL WHEN {_DRAW} < 30 THEN cents + 10 WHEN {_DRAW} < 40 THEN cents * 10 ELSE cents END"

RECEIPTS_SQL = """receipts AS (
  SELECT doc, (n + 50) // 100 AS subtotal, (x + 5000) // 10000 AS tax, (n + 50) // 100 + (x + 5000) // 10000 AS total FROM (
    SELECT l_orderkey AS doc, sum(p * (100 - d))::BIGINT AS n, sum(p * (100 - d) * t)::BIGINT AS x FROM (
      SELECT l_orderkey, round(l_extendedprice * 100)::BIGINT AS p, round(l_discount * 100)::BIGINT AS d, round(l_tax * 100)::BIGINT AS t FROM lineitem)
    GROUP BY l_orderkey))"""
GOLD_SQL = RECEIPTS_SQL + """,
gold AS (SELECT doc, unnest(['subtotal', 'tax', 'total']) AS field, unnest([subtotal, tax, total]) AS cents FROM receipts)"""
READINGS_SQL = GOLD_SQL + f""",
seen AS (SELECT doc, field, view, cents, {_noise_sql('view')} AS h FROM gold, (SELECT unnest(range({VIEWS}))::INTEGER AS view)),
mis AS (SELECT doc, field, view, h, {_MISREAD} AS cents FROM seen),
readings AS (
  SELECT doc, field, view, cents, {_CENTS} AS norm, (('0x' || substr(h, 9, 2))::BIGINT % 3 + CASE field WHEN 'total' THEN 6 ELSE 5 END)::INTEGER AS score
  FROM mis WHERE cents IS NOT NULL)"""
DETAIL_SQL = GOLD_SQL + f""",
d0 AS (SELECT doc, field, cents, {_noise_sql('0')} AS h FROM gold WHERE NOT (doc % 7 = 0 AND field = 'subtotal')),
dm AS (SELECT *, {_MISREAD} AS rc FROM d0),
d1 AS (
  SELECT doc AS id, CASE WHEN doc % 3 = 0 THEN 'scan' ELSE 'photo' END AS dataset, field,
    CASE WHEN doc % 11 = 0 AND field = 'tax' THEN NULL ELSE {_CENTS} END AS gold_normalized,
    {_CENTS.replace('cents', 'rc')} AS read,
    ('0x' || substr(sha256('run:' || doc::VARCHAR), 1, 4))::BIGINT % 100 >= 4 AS execution_ok,
    ('0x' || substr(h, 11, 2))::BIGINT % 3 AS lv FROM dm),
d2 AS (SELECT *, CASE WHEN execution_ok THEN read END AS predicted_normalized FROM d1),
d3 AS (
  SELECT *, (execution_ok AND gold_normalized IS NOT DISTINCT FROM predicted_normalized)::INTEGER AS correct,
    coalesce(execution_ok AND gold_normalized = predicted_normalized, false)::INTEGER AS tp,
    (predicted_normalized IS NOT NULL AND gold_normalized IS DISTINCT FROM predicted_normalized)::INTEGER AS fp,
    (gold_normalized IS NOT NULL AND gold_normalized IS DISTINCT FROM predicted_normalized)::INTEGER AS fn FROM d2),
d4 AS (
  SELECT *, CASE WHEN predicted_normalized IS NULL THEN 'sin_valor' ELSE ['alta', 'media', 'baja'][lv + 1] END AS confianza,
    CASE WHEN correct = 1 THEN 'correcto' WHEN predicted_normalized IS NULL THEN 'omision' ELSE 'equivocado' END AS tipo FROM d3),
detail AS (SELECT *, tipo = 'equivocado' AND confianza = 'alta' AS silencioso FROM d4)"""
