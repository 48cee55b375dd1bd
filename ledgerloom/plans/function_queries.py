"""Scalar functions over printed amounts, dates and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import dates, money, normalize, text
from ledgerloom.plans import fixtures as X


def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals printed six ways."""
    c = F.round(F.col("o_totalprice") * 100).cast("long")
    whole, cents, k = F.floor(c / 100), F.lpad((c % 100).cast("string"), 2, "0"), F.col("o_orderkey") % 6
    grouped = F.format_number(whole, 0)
    s = F.when(k == 0, F.concat(F.lit("$"), grouped, F.lit("."), cents)).when(k == 1, F.concat(F.translate(grouped, ",", "."), F.lit(","), cents, F.lit(" EUR"))).when(k == 2, whole.cast("string")).when(k == 3, F.concat(F.lit("("), whole.cast("string"), F.lit("."), cents, F.lit(")"))).when(k == 4, F.concat(whole.cast("string"), F.lit(".5%"))).otherwise(F.concat(F.lit("RM"), grouped))
    return X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), s.alias("printed"))


def normalize_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _amounts(spark, sf_dir).select("k", money.money(F.col("printed")).alias("value"))


def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates printed six ways."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    s = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd/MM/yyyy")).when(k == 2, F.concat(F.dayofmonth(d).cast("string"), F.lit(" Marzo "), F.year(d).cast("string"))).when(k == 3, F.concat(F.lit("AOÛT "), F.dayofmonth(d).cast("string"), F.lit(", "), F.year(d).cast("string"))).when(k == 4, F.concat(F.lit("31.02."), F.year(d).cast("string"))).otherwise(F.date_format(d, "'Fecha:' MM-dd-yy"))
    return X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), s.alias("printed"))


def normalize_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = dates.normalize_date(F.col("printed"))
    return _dates(spark, sf_dir).select("k", v.alias("value"), dates.year_of(v).alias("year"))


def normalize_dmy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates(spark, sf_dir).where("k % 6 in (1, 4)").select("k", dates.normalize_date(F.col("printed"), "dmy").alias("value"))


def normalize_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By field: an amount that can't be read is kept raw, identifiers lose their spaces."""
    rows = _amounts(spark, sf_dir).select("k", F.when(F.col("k") % 2 == 0, "total").otherwise("document_number").alias("field"), "printed")
    return rows.select("k", normalize.normalize(F.col("field"), F.col("printed")).alias("value"))


def validation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = X.receipts(spark, sf_dir).withColumn("total", F.when(F.col("doc") % 10 == 0, F.col("total") + 50).otherwise(F.col("total")))
    f = {m: X.money_text(F.col(m)) for m in ("subtotal", "tax", "total")} | {"date": F.when(F.col("doc") % 4 == 0, "03/04/2026").when(F.col("doc") % 4 == 1, "2026-01-31"), "tax_id": F.when(F.col("doc") % 3 == 0, "1234567890"), "document_number": F.when(F.col("doc") % 5 == 0, "A-1")}
    states = normalize.validate(f, tax_id_pattern=r"\d{10}")
    long = r.select("doc", F.explode(F.map_filter(F.create_map(*(x for k, v in states.items() for x in (F.lit(k), v))), lambda _, v: v.isNotNull())).alias("check", "state"))
    return long.groupBy("check", "state").agg(F.count("*").alias("n"))


def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "documents").select("doc_id", F.md5(text.text_key(F.col("text"))).alias("key_md5"))


def glyph_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled total lines, one per order."""
    c = F.floor(F.col("o_totalprice")).cast("string")
    line = F.concat(F.element_at(F.array(F.lit("TOTA| "), F.lit("Sub Tota! "), F.lit("TOTAI pm"), F.lit("FOOD & DRINK ")), (F.col("o_orderkey") % 4 + 1).cast("int")), c, F.lit(".o&"))
    return X.table(spark, sf_dir, "orders").select("o_orderkey", text.repair_glyphs(line).alias("line"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight-point polygons to boxes, back to the original image, and as percent of the page."""
    p = X.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 10.0).alias("x"), F.col("p_retailprice").alias("y"))
    box = text.bounding_box(F.array(F.col("x"), F.col("y"), F.col("x") + 50, F.col("y") - 5, F.col("x") + 60, F.col("y") + 20, F.col("x") - 3, F.col("y") + 18))
    p = p.withColumn("b", box).withColumn("o", text.original_box(F.col("b"), F.lit(2.0), F.lit(2.0), F.lit(20.0), F.lit(200.0), F.lit(900.0)))
    p = p.withColumn("pc", text.page_percent(F.col("b"), F.lit(600.0), F.lit(2200.0)))
    return p.select("p_partkey", *(F.element_at(c, k).alias(f"{c}{k}") for c in ("b", "o", "pc") for k in (1, 2, 3, 4)))


def names_and_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View names, file stems, id parts and the state of a reading by its fields."""
    o = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    fields = F.map_from_arrays(F.array(F.lit("date"), F.lit("subtotal"), F.lit("tax"), F.lit("total")), F.array(*(F.when(F.col("k") % m != 0, "x") for m in (2, 4, 6, 8))))
    name = F.concat(F.lit("scan/test/"), F.col("k").cast("string"), F.lit(".v1.jpg"))
    return o.select("k", text.extraction_status(fields).alias("status"), text.view_name(F.lit("resize"), F.col("k") % 3, F.lit("best"), F.col("k") % 7 == 0).alias("view"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.element_at(F.split(name, "/", 3), 3).alias("tail"), text.pattern_class(name).alias("pattern"))


A = """WITH a AS (SELECT o_orderkey AS k, round(o_totalprice * 100)::BIGINT AS c FROM orders), s AS (SELECT k, c, (c // 100)::VARCHAR AS w, lpad((c % 100)::VARCHAR, 2, '0') AS f FROM a)"""
_DT = "WITH d AS (SELECT o_orderkey AS k, o_orderdate AS d, day(o_orderdate) AS dd, month(o_orderdate) AS mm, year(o_orderdate) AS yy FROM orders)"
_AMB = """CASE WHEN dd > 12 THEN strftime(make_date({y}, mm, dd), '%Y-%m-%d') WHEN dd = mm THEN strftime(make_date({y}, mm, dd), '%Y-%m-%d') ELSE 'AMBIGUOUS:' || lpad({a}::VARCHAR, 2, '0') || '/' || lpad({b}::VARCHAR, 2, '0') || '/' || {y}::VARCHAR END"""
_DATE = f"""CASE k % 6 WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN {_AMB.format(y='yy', a='dd', b='mm')} WHEN 2 THEN yy || '-03-' || lpad(dd::VARCHAR, 2, '0') WHEN 3 THEN yy || '-08-' || lpad(dd::VARCHAR, 2, '0') WHEN 4 THEN NULL ELSE {_AMB.format(y='yy', a='mm', b='dd')} END"""
_MONEY = """CASE k % 6 WHEN 4 THEN NULL WHEN 2 THEN w || '.00' WHEN 5 THEN CASE WHEN c >= 100000 THEN NULL ELSE w || '.00' END WHEN 3 THEN CASE WHEN c = 0 THEN '' ELSE '-' END || w || '.' || f ELSE w || '.' || f END"""
QUERIES = {f.__name__: f for f in (normalize_money, normalize_dates, normalize_dmy, normalize_fields, validation_states, text_keys, glyph_repair, boxes, names_and_status)}
ORACLES = {
    "normalize_money": A + f" SELECT k, {_MONEY} AS value FROM s",
    "normalize_dates": _DT + f", v AS (SELECT k, {_DATE} AS value, yy FROM d) SELECT k, value, CASE WHEN value IS NOT NULL THEN yy::INTEGER END AS year FROM v",
    "normalize_dmy": _DT + " SELECT k, CASE k % 6 WHEN 1 THEN strftime(d, '%Y-%m-%d') END AS value FROM d WHERE k % 6 IN (1, 4)",
    "normalize_fields": A + """, g AS (SELECT *, format('{:,}', c // 100) AS g FROM s), p AS (SELECT k, c, w, f, CASE k % 6 WHEN 0 THEN '$' || g || '.' || f WHEN 1 THEN replace(g, ',', '.') || ',' || f || ' EUR' WHEN 2 THEN w WHEN 3 THEN '(' || w || '.' || f || ')' WHEN 4 THEN w || '.5%' ELSE 'RM' || g END AS printed FROM g)
SELECT k, CASE WHEN k % 2 = 0 THEN CASE k % 6 WHEN 4 THEN 'RAW:' || printed WHEN 2 THEN w || '.00' ELSE w || '.' || f END ELSE upper(replace(printed, ' ', '')) END AS value FROM p""",
    "validation_states": "WITH " + X.RECEIPTS_SQL + """, s AS (SELECT unnest(['subtotal', 'tax', 'total', 'date', 'document_number', 'tax_id', 'amount_balance']) AS "check",
unnest(['valid_format', 'valid_format', 'valid_format', CASE doc % 4 WHEN 0 THEN 'ambiguous_date_order' WHEN 1 THEN 'valid_format' ELSE 'missing' END, CASE WHEN doc % 5 <> 0 THEN 'missing' END, CASE WHEN doc % 3 = 0 THEN 'valid_structure' ELSE 'missing' END, CASE WHEN doc % 10 = 0 THEN 'inconsistent_review' ELSE 'consistent' END]) AS state FROM receipts)
SELECT "check", state, count(*) AS n FROM s WHERE state IS NOT NULL GROUP BY ALL""",
    "text_keys": "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^\\x00-\\x7F]', '', 'g'), '\\s+', ' ', 'g'))) AS key_md5 FROM documents",
    "glyph_repair": "SELECT o_orderkey, ['total ', 'subtotal ', 'total ', 'food & drink '][(o_orderkey % 4 + 1)::BIGINT] || floor(o_totalprice)::BIGINT::VARCHAR || '.08' AS line FROM orders",
    "boxes": """WITH b AS (SELECT p_partkey, p_size * 10.0::DOUBLE - 3 AS b1, p_retailprice - 5 AS b2, p_size * 10.0::DOUBLE + 60 AS b3, p_retailprice + 20 AS b4 FROM part),
m AS (SELECT *, greatest(0, b1 - 6) AS x0, greatest(0, b2 - 6) AS y0, least(600, b3 + 6) AS x1, least(2200, b4 + 6) AS y1 FROM b)
SELECT p_partkey, b1, b2, b3, b4, greatest(0, least(200, (b1 - 20) / 2)) AS o1, greatest(0, least(900, (b2 - 20) / 2)) AS o2, greatest(0, least(200, (b3 - 20) / 2)) AS o3, greatest(0, least(900, (b4 - 20) / 2)) AS o4,
100 * x0 / 600 AS pc1, 100 * y0 / 2200 AS pc2, 100 * (x1 - x0) / 600 AS pc3, 100 * (y1 - y0) / 2200 AS pc4 FROM m""",
    "names_and_status": """WITH o AS (SELECT o_orderkey AS k, (o_orderkey % 2 <> 0)::INT + (o_orderkey % 4 <> 0)::INT + (o_orderkey % 6 <> 0)::INT + (o_orderkey % 8 <> 0)::INT AS n FROM orders)
SELECT k, CASE n WHEN 0 THEN 'sin_campos' WHEN 4 THEN 'lectura_por_verificar' ELSE 'lectura_parcial' END AS status, 'resize·psm' || (k % 3)::VARCHAR || '·best' || CASE WHEN k % 7 = 0 THEN '·rescate' ELSE '' END AS view,
'scan/test/' || k::VARCHAR || '.v1' AS stem, k::VARCHAR || '.v1.jpg' AS tail, 'AAAA/AAAA/' || regexp_replace(k::VARCHAR, '[0-9]', '9', 'g') || '.A9.AAA' AS pattern FROM o""",
}
