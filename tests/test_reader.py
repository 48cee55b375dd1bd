from pyspark.sql import functions as F

from ledgerloom import api
from ledgerloom.operators import candidates, layout, tuning

from test_layout import page


def test_receipt_end_to_end(spark):
    lines = ["ACME Store", "RUC: 1234567890", "Date: 27/09/2026", "Invoice No: 001-002-000123", "SUBTOTAL 100.00", "VAT 12.00", "TOTAL 112.00", "valid until 30/10/2026"]
    r = api.Reader(api.Config(tax_id_pattern=r"\d{10}")).read(page(spark, [lines, lines])).first()
    assert (r.tax_id, r.date, r.document_number, r.subtotal, r.tax, r.total) == ("1234567890", "2026-09-27", "001-002-000123", "100.00", "12.00", "112.00")
    assert (r.state_amount_balance, r.state_tax_id, r.state_date) == ("consistent", "valid_structure", "valid_format")
    levels = {x.field: x.confidence for x in api.extract(page(spark, [lines, lines[:6]])).collect()}
    assert levels["total"] == "media" and levels["tax"] == "alta"


def rows_of(spark, *lines):
    return layout.visual_rows(page(spark, [list(lines)]))


def test_dates(spark):
    got = {(r.norm, r.score) for r in candidates.dates(rows_of(spark, "fecha 5 / 13 - 2024", "on 12 3an 2023", "ref 20240131", "expires 01/02/2030", "12 jan 1980")).collect()}
    assert got == {("2024-05-13", 7), ("2023-01-12", 5), ("2024-01-31", 2)}


def test_tables_and_sums(spark):
    t = {(r.field, r.norm) for r in candidates.table_columns(rows_of(spark, "net vat gross", "010 001 00011")).collect()}
    assert t == {("subtotal", "10.00"), ("tax", "1.00"), ("total", "11.00")}
    d = candidates.deposit_and_balance(rows_of(spark, "deposit 30.00", "balance 70.00", "total 100.00")).collect()
    assert [(r.norm, r.score) for r in d] == [("100.00", 12)]
    a = candidates.aligned_below(rows_of(spark, "TOTAL :", "31.90")).collect()
    assert [(r.field, r.norm) for r in a] == [("total", "31.90")]


def test_regions(spark):
    rows = rows_of(spark, "shop", "x", "y", "z", "subtotal 5.00", "total 5.00")
    assert candidates.field_regions(rows, (600.0, 300.0)).count() >= 2
    band = candidates.summary_band(rows, 300.0).first()
    assert band.top == 60.0 and band.bottom == 250.0


def test_tuning(spark):
    sets = tuning.random_sets(spark, {"a": [0.0, 1.0, 2.0, 3.0], "b": [0.0, 1.0, 2.0]}, 11)
    assert sets.count() == 12 and sets.select("a", "b").distinct().count() == 12
    trials = sets.withColumn("m", 10 * F.col("a") + F.col("b"))
    effects = {r.parameter: r.effect for r in tuning.main_effects(trials, ["a", "b"], "m").collect()}
    assert effects["a"] > effects["b"]
    model, _ = tuning.surrogate(trials, ["a", "b"], "m", trees=10)
    pd = {r.a: r.mean_prediction for r in tuning.partial_dependence(model, trials, ["a", "b"], "a", [0.0, 3.0]).collect()}
    assert pd[3.0] > pd[0.0]
    imp = {r.parameter: r.importance for r in tuning.permutation_importance(model, trials, ["a", "b"], "m", 3).collect()}
    assert imp["a"] > imp["b"]


def read(spark, *views, **config):
    return {r.field: (r.value, r.alert) for r in api.extract(page(spark, list(views)), api.Config(**config)).collect()}


def test_payment_settles_rounding(spark):
    lines = ["total 27.28", "rounded total 27.30", "cash 50.00", "change 22.70"]
    assert read(spark, lines, lines)["total"][0] == "27.30"


def test_a_total_is_one_that_was_read(spark):
    lines = ["cash 200.00", "change 16.00", "total 190.00"]
    assert read(spark, lines, lines)["total"][0] == "190.00"


def test_three_amounts_in_a_row(spark):
    lines = ["1,39 11,61 13,00"]
    got = read(spark, lines, lines)
    assert (got["subtotal"][0], got["tax"][0], got["total"][0]) == ("11.61", "1.39", "13.00")
    assert read(spark, ["1,39 11,61 13,01", "total 5.00"])["tax"][0] is None


def test_two_totals_are_a_doubt(spark):
    assert read(spark, ["TOTAL 20.00", "TOTAL 30.00"])["total"] == (None, "total:ambiguous_consensus")


def test_rescue_counts_words_by_confidence(spark):
    words = page(spark, [["total 20.00"], ["total 20.00"], ["total 30.00"], ["total 30.00"]]).withColumn("confidence", F.when(F.col("view") < 2, 95.0).otherwise(40.0))
    assert api.extract(words).where("field = 'total'").first()["value"] is None
    got = api.rescued(words).where("field = 'total'").first()
    assert (got["value"], got["rescued"]) == ("20.00", True)


def test_views_beyond_a_mask_are_an_error(spark):
    import pytest

    from ledgerloom.operators import consensus

    rows = spark.createDataFrame([("d", "total", 64, "1.00", 100, 6)], "doc string, field string, view int, norm string, cents long, score int")
    with pytest.raises(Exception, match="view not in"):
        consensus.vote_groups(rows).collect()
    options = spark.createDataFrame([(0, "resize", 6), (1, "resize", 4), (5, "resize", 6)], "view int, preprocess string, psm int")
    assert consensus.primary_views(options) == (1 << 0) | (1 << 5)
