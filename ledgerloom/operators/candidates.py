"""More candidates from visual rows: dates, identifiers, tables with headings, aligned and summed amounts, regions.

Rows come from layout.visual_rows: doc_id, view, row_no, x0, y0, x1, y1, words, text. Every generator returns doc_id,
view, row_no, field, raw, norm, score, rule, so they union into one table for the vote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.dates import MONTHS, normalize_date, year_of
from ledgerloom.functions.money import money
from ledgerloom.functions.text import phrases, repair_glyphs
from ledgerloom.operators.layout import LABELS, amounts

# Context that makes a date something else, garbled month names, years that a receipt may have.
EXPIRY = phrases("exp", "expires", "expiry", "expiration", "valid", "until", "thru", "use by", "best before", "due", "return", "returns") + r"[\s:.]*$"
MONTH_READINGS = {"3an": "jan", "ian": "jan", "0ct": "oct", "oc7": "oct", "5ep": "sep", "0ec": "dec", "de0": "dec", "fe6": "feb", "ju1": "jul", "au9": "aug"}
YEARS = (2000, 2035)
LENIENT = r"(?<![\d/.\-])\d{1,4}\s*[/.\-]\s*\d{1,2}\s*[/.\-]\s*\d{2,4}(?![\d/])"
COMPACT = r"(?<!\d)\d{8}(?!\d)"
_MONTH = rf"(?:{'|'.join(names[0] for names in MONTHS.values())})[a-z]*"
_GAP = r"[\s,./-]{1,3}"
NAMED = rf"\b(?:\d{{1,2}}{_GAP}{_MONTH}{_GAP}\d{{2,4}}|{_MONTH}{_GAP}\d{{1,2}}{_GAP}\d{{2,4}})\b"
IDENTIFIERS = {
    "tax_id": r"\b(?:ruc|rut|nit|rfc|tax\s*id|vat\s*(?:id|no))\b[\s:#.]*",
    "document_number": r"\b(?:invoice|receipt|factura|comprobante|ticket|folio)\s*(?:number|no\.?|nro\.?|num\.?|#|numero|:)[\s:#.]*",
}
HEADINGS = {"net": "subtotal", "netto": "subtotal", "gross": "total", "brutto": "total", "vat": "tax", "moms": "tax"}


def _shape(rows: DataFrame, field: Column, raw: Column, norm: Column, score: Column, rule: str) -> DataFrame:
    out = rows.select("doc_id", "view", "row_no", field.alias("field"), raw.alias("raw"), norm.alias("norm"), score.cast("int").alias("score"), F.lit(rule).alias("rule"))
    return out.where(F.col("norm").isNotNull())


def dates(rows: DataFrame, order: str = "auto") -> DataFrame:
    """Printed dates: labelled 7, with odd separators or a garbled month 5, without separators 2; expiry dates left out."""
    garbled = r"(?<=\d)\s*(" + "|".join(MONTH_READINGS) + r")\s*(?=\d)"
    fixed = F.col("text")
    for bad, good in MONTH_READINGS.items():
        fixed = F.regexp_replace(fixed, rf"(?<=\d)\s*{bad}\s*(?=\d)", f" {good} ")
    rows = rows.withColumn("fixed", F.when(F.col("text").rlike(garbled), fixed).otherwise(F.col("text")))
    found = F.concat(
        F.transform(F.regexp_extract_all("fixed", F.lit(LENIENT), F.lit(0)), lambda d: F.struct(d.alias("raw"), F.lit(5).alias("score"))),
        F.when(F.size(F.regexp_extract_all("fixed", F.lit(NAMED), F.lit(0))) == 1, F.transform(F.regexp_extract_all("fixed", F.lit(NAMED), F.lit(0)), lambda d: F.struct(d.alias("raw"), F.lit(5).alias("score")))).otherwise(F.array().cast("array<struct<raw:string,score:int>>")),
        F.transform(F.regexp_extract_all("fixed", F.lit(COMPACT), F.lit(0)), lambda d: F.struct(d.alias("raw"), F.lit(2).alias("score"))),
    )
    each = rows.withColumn("d", F.explode(found))
    before = F.expr("substring(fixed, greatest(1, instr(fixed, d.raw) - 16), least(16, instr(fixed, d.raw) - 1))")
    each = each.where(~before.rlike(EXPIRY))
    plain = F.regexp_replace(F.col("d.raw"), r"(?<=[\d/.\-])\s+(?=[\d/.\-])", "")
    whole = F.when(F.col("d.score") == 2, F.regexp_replace(plain, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")).otherwise(plain)
    each = each.withColumn("norm", normalize_date(whole, order)).where(year_of(F.col("norm")).between(*YEARS))
    score = F.when((F.col("d.score") == 5) & F.col("text").rlike(r"\b(?:date|fecha)\b"), 7).otherwise(F.col("d.score"))
    return _shape(each, F.lit("date"), F.col("d.raw"), F.col("norm"), score, "printed_date")


def identifiers(rows: DataFrame) -> DataFrame:
    """What follows a label of a tax number or a document number, if it has a digit."""
    found = F.array(*(F.struct(F.lit(f).alias("field"), F.regexp_extract("text", rule + r"([a-z0-9][a-z0-9.\-/]*)", 1).alias("raw")) for f, rule in IDENTIFIERS.items()))
    each = rows.withColumn("i", F.explode(F.filter(found, lambda x: x["raw"].rlike(r"\d"))))
    return _shape(each, F.col("i.field"), F.col("i.raw"), F.upper(F.regexp_replace("i.raw", r"\s", "")), F.lit(7), "labelled_identifier")


def table_columns(rows: DataFrame) -> DataFrame:
    """Under three headings or more of a tax table: in each of the next two rows the amount nearest to the heading's middle."""
    w = Window.partitionBy("doc_id", "view").orderBy("row_no")
    wide = rows
    for k in (1, 2):
        wide = wide.withColumn(f"n{k}", F.struct(F.lead("words", k).over(w).alias("words"), F.lead("y0", k).over(w).alias("y0"), F.lead("row_no", k).over(w).alias("row_no")))
    heads = F.filter("words", lambda x: x["key"].isin(*HEADINGS))
    wide = wide.withColumn("heads", heads).where((F.size("heads") >= 3) & F.exists("heads", lambda x: x["key"].isin("net", "netto")))
    under = wide.withColumn("u", F.explode(F.array("n1", "n2"))).where("u.words is not null and u.y0 - y1 <= 3 * greatest(1, y1 - y0)").withColumn("h", F.explode("heads"))
    middle = lambda b: (F.element_at(b, 1) + F.element_at(b, 3)) / 2
    tokens = F.filter(F.transform("u.words", lambda x: F.struct(F.abs(middle(x["box"]) - middle(F.col("h.box"))).alias("off"), x["at"].alias("at"), x["key"].alias("raw"), money(repair_glyphs(x["key"])).alias("norm"))), lambda t: t["norm"].isNotNull())
    best = under.withColumn("t", F.array_min(tokens)).where("t is not null")
    reach = F.greatest(2 * F.greatest(F.lit(1.0), F.col("y1") - F.col("y0")), F.element_at("h.box", 3) - F.element_at("h.box", 1))
    best = best.where(F.col("t.off") <= reach)
    field = F.element_at(F.create_map(*(F.lit(x) for kv in HEADINGS.items() for x in kv)), F.col("h.key"))
    return _shape(best, field, F.col("t.raw"), F.col("t.norm"), F.lit(7), "table_column")


def aligned_below(rows: DataFrame) -> DataFrame:
    """A label alone on its row, and an amount alone on the next one that overlaps it from above."""
    w = Window.partitionBy("doc_id", "view").orderBy("row_no")
    text = repair_glyphs(F.col("text"))
    pair = rows.select("doc_id", "view", "row_no", "x0", "x1", "y0", "y1", text.alias("text"), *(F.lead(c).over(w).alias(f"n_{c}") for c in ("x0", "x1", "y0")), F.lead(text).over(w).alias("n_text"))
    gap = (F.col("n_y0") - F.col("y1")) / F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))
    close = gap.between(-0.25, 2.5) & (F.col("n_x0") <= F.col("x1")) & (F.col("n_x1") >= F.col("x0"))
    fields = F.filter(F.array(*(F.struct(F.lit(f).alias("field"), F.regexp_replace("text", rule, "").alias("rest"), F.col("text").rlike(rule).alias("hit")) for f, rule in LABELS.items())), lambda x: x["hit"] & ~x["rest"].rlike(r"[a-z0-9]"))
    each = pair.where(close).withColumn("f", F.explode(fields))
    return _shape(each, F.col("f.field"), F.trim("n_text"), money(F.trim("n_text")), F.lit(7), "aligned_below")


def deposit_and_balance(rows: DataFrame) -> DataFrame:
    """A total that a deposit and a balance in the same view add up to."""
    text = repair_glyphs(F.col("text"))
    cents = rows.select("doc_id", "view", "row_no", text.alias("text"), F.explode(amounts(text)).alias("a")).withColumn("c", F.regexp_replace("a.value", r"\.", "").cast("long"))
    of = lambda rule, name: cents.where(F.col("text").rlike(rule)).select("doc_id", "view", F.col("c").alias(name), F.col("row_no").alias(f"{name}_row"), F.col("a.value").alias(f"{name}_v"))
    sums = of(r"\bdeposit\b", "d").join(of(r"\bbalance\b", "b"), ["doc_id", "view"]).join(of(r"\btotal\b", "t"), ["doc_id", "view"]).where("d + b = t and d > 0 and b > 0")
    return sums.groupBy("doc_id", "view").agg(F.min("t_row").alias("row_no"), F.min_by("t_v", "t_row").alias("norm")).select("doc_id", "view", "row_no", F.lit("total").alias("field"), F.col("norm").alias("raw"), "norm", F.lit(12).alias("score"), F.lit("deposit_and_balance").alias("rule"))


def field_regions(rows: DataFrame, page: tuple[float, float], limit: int = 8) -> DataFrame:
    """Strips at the right of labels, worth another look: one for each cell of a 24 by 16 grid, the first ``limit``."""
    text = repair_glyphs(F.col("text"))
    hit = F.filter(F.array(*(F.struct(F.lit(f).alias("field"), text.rlike(rule).alias("hit")) for f, rule in LABELS.items())), lambda x: x["hit"])
    each = rows.withColumn("f", F.explode(hit)).select("doc_id", "view", "row_no", "f.field", "x0", "y0", F.lit(page[0]).alias("x1"), "y1")
    cell = each.withColumn("cx", F.floor(F.col("x0") * 24 / page[0])).withColumn("cy", F.floor(F.col("y0") * 16 / page[1]))
    first = cell.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "field", "cx", "cy").orderBy("view", "row_no"))).where("k = 1")
    return first.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("y0", "x0", "field"))).where(F.col("k") <= limit).drop("cx", "cy", "k")


def summary_band(rows: DataFrame, height: float) -> DataFrame:
    """Where the amounts of a page stand: from three heights above its labels to four below; too thin or too tall is none."""
    text = repair_glyphs(F.col("text"))
    low = rows.where((F.col("y0") > 0.25 * height) & text.rlike("|".join(LABELS.values())))
    band = low.groupBy("doc_id").agg(F.min("y0").alias("a"), F.max("y1").alias("b"), F.median(F.col("y1") - F.col("y0")).alias("h"))
    band = band.select("doc_id", F.greatest(F.lit(0.0), F.col("a") - 3 * F.col("h")).alias("top"), F.least(F.lit(height), F.col("b") + 4 * F.col("h")).alias("bottom"))
    return band.where((F.col("bottom") - F.col("top")).between(20, 0.8 * height))
