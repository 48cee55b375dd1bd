import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, money, normalize, text

MONEY = [("1,234.56", "1234.56"), ("1.234,56", "1234.56"), ("1,234", None), ("12%", None), ("12,34.56", None), ("(12.00)", "-12.00"), ("USD$25.23", "25.23"), ("￡3.79", "3.79"), ("1.827.76", None), (".50", "0.50"), ("rm7", "7.00"), ("", None), (None, None)]
DATES = [("2026-09-27", "2026-09-27"), ("03/04/2026", "AMBIGUOUS:03/04/2026"), ("31/02/2026", None), ("13/04/26", "2026-04-13"), ("5 de enero", None), ("5 enero 2024", "2024-01-05"), ("Août 7, 1999", "1999-08-07"), ("Sept 3, 21", "2021-09-03"), ("04/04/1970", "1970-04-04"), (None, None)]
GLYPHS = [("NET TOTAL &.00", "net total 8.00"), ("TOTAL PM7.00", "total 7.00"), ("FOOD & DRINK", "food & drink"), ("TOTA LI 7.00", "total 7.00"), ("t0tal 1 . 50", "total 1.50")]


def one(spark, rows, column):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "k int, v string")
    return [r.x for r in df.select("k", column(F.col("v")).alias("x")).orderBy("k").collect()]


def test_money(spark):
    assert one(spark, [a for a, _ in MONEY], money.money) == [b for _, b in MONEY]
    assert one(spark, ["1.234", "1.235", "12,34"], lambda c: money.money(c, ".")) == ["1.23", "1.24", None]
    with pytest.raises(ValueError):
        money.money(F.lit("1"), ";")


def test_dates(spark):
    assert one(spark, [a for a, _ in DATES], dates.normalize_date) == [b for _, b in DATES]
    assert one(spark, ["03/04/2026"], lambda c: dates.normalize_date(c, "dmy")) == ["2026-04-03"]
    assert one(spark, ["03/04/2026"], lambda c: dates.normalize_date(c, "mdy")) == ["2026-03-04"]


def test_glyphs(spark):
    assert one(spark, [a for a, _ in GLYPHS], text.repair_glyphs) == [b for _, b in GLYPHS]


def test_text_key(spark):
    rows = ["  Café  CRÈME ", "ÀÉÎõü", "plain", None, "１２ ﬁ", ""]
    assert one(spark, rows[:4], text.text_key) == ["cafe creme", "aeiou", "plain", None]
    assert one(spark, rows, text.text_key_exact) == ["cafe creme", "aeiou", "plain", None, "12 fi", ""]


def test_near(spark):
    df = spark.createDataFrame([("758.70", "758.78"), ("65.50", "5.50"), ("9.49", "9.97"), ("1.00", "1.00"), ("RAW:1", "RAW:2")], "a string, b string")
    assert [r.x for r in df.select(text.near_strings(F.col("a"), F.col("b")).alias("x")).collect()] == [True, True, False, False, False]


def test_normalize(spark):
    df = spark.createDataFrame([("total", "1,234"), ("total", " "), ("date", "soon"), ("tax_id", " ab 12 "), ("tax", "5.5")], "f string, v string")
    assert [r.x for r in df.select(normalize.normalize(F.col("f"), F.col("v")).alias("x")).collect()] == ["RAW:1,234", None, "RAW:soon", "AB12", "5.50"]
    with pytest.raises(ValueError):
        normalize.normalize_field("colour", F.lit("x"))


@pytest.mark.parametrize(("total", "check", "state"), [("112", True, "consistent"), ("115", True, "inconsistent_review"), (None, True, "insufficient_data"), ("112", False, "not_applicable")])
def test_balance(spark, total, check, state):
    f = {k: F.lit(v).cast("string") for k, v in (("subtotal", "100"), ("tax", "12"), ("total", total), ("date", None), ("tax_id", None), ("document_number", None))}
    assert spark.range(1).select(normalize.validate(f, check_balance=check)["amount_balance"].alias("x")).first().x == state
