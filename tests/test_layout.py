from ledgerloom.operators import consensus, layout


def page(spark, views):
    """Words at ten pixels a letter, rows every 30 pixels."""
    rows = []
    for v, texts in enumerate(views):
        n = 0
        for k, line in enumerate(texts):
            x = 0.0
            for w in line.split():
                rows.append(("d", v, n, w, x, 30.0 * k, x + 10 * len(w), 30.0 * k + 20, 90.0, f"1:1:1:{k}"))
                x += 10 * len(w) + 10
                n += 1
    return spark.createDataFrame(rows, "doc_id string, view int, word_no int, text string, x0 double, y0 double, x1 double, y1 double, confidence double, line_id string")


def fields(spark, *views):
    won = consensus.elect(consensus.ranked_groups(layout.candidates(page(spark, views)), consensus.VoteConfig(primary_mask=1)))
    return {r.field: (r.value, r.ambiguous) for r in won.collect()}


def test_rows_follow_boxes_not_line_ids(spark):
    words = page(spark, [["Tótal 5.00", "cash 5.00"]])
    assert [r.text for r in layout.visual_rows(words).orderBy("row_no").collect()] == ["total 5.00", "cash 5.00"]
    assert layout.assign_rows([(0, 0, 10, 20), (50, 4, 60, 24), (0, 30, 10, 50)]) == [[0, 1], [2]]
    assert {r.text for r in layout.engine_lines(words).collect()} == {"Tótal 5.00", "cash 5.00"}


def test_labels(spark):
    got = fields(spark, ["SUBTOTAL 100.00", "TAX 12% 12.00", "TOTAL 112.00", "TOTAL ITEMS 2"])
    assert got == {"subtotal": ("100.00", False), "tax": ("12.00", False), "total": ("112.00", False)}


def test_two_totals_abstain(spark):
    assert fields(spark, ["TOTAL 20.00", "TOTAL 30.00"])["total"] == (None, True)


def test_value_below(spark):
    assert fields(spark, ["TOTAL", "31.90"])["total"] == ("31.90", False)


def test_arithmetic_row(spark):
    got = fields(spark, ["1,39 11,61 13,00"])
    assert got["subtotal"][0] == "11.61" and got["tax"][0] == "1.39" and got["total"][0] == "13.00"
    assert fields(spark, ["1,39 11,62 13,00"]) == {}


def test_cash_less_change_must_be_seen(spark):
    assert fields(spark, ["CASH 50.00", "CHANGE 22.70", "item 27.30"])["total"] == ("27.30", False)
    assert "total" not in fields(spark, ["CASH 50.00", "CHANGE 22.70"])


def test_views_outvote(spark):
    assert fields(spark, ["TOTAL 758.70"], ["TOTAL 758.70"], ["TOTAL 758.78"])["total"] == ("758.70", False)


def test_partitioning_does_not_matter(spark):
    words = page(spark, [["SUBTOTAL 10.00", "TOTAL 11.00"], ["TOTAL 11.00", "x 1"]])
    a, b = (sorted(map(tuple, layout.candidates(w).collect())) for w in (words, words.repartition(5)))
    assert a == b


def test_sections_and_identifiers(spark):
    rows = layout.visual_rows(page(spark, [["Issuer ACME", "ID 77", "Bill to Bob", "ID 88"]]))
    assert [r.section for r in layout.sections(rows).orderBy("row_no").collect()] == ["issuer", "issuer", "recipient", "recipient"]
    found = spark.createDataFrame([("d", 0, "tax_id", "A"), ("d", 1, "tax_id", "A"), ("d", 2, "tax_id", "B"), ("e", 0, "tax_id", "A"), ("e", 1, "tax_id", "B")], "doc_id string, view int, field string, norm string")
    assert {(r.doc_id, r.value, r.conflict) for r in layout.majority_identifiers(found).collect()} == {("d", "A", False), ("e", None, True)}
