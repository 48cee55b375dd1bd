import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import images, learning
from ledgerloom.sinks import exports
from ledgerloom.sources import datasets
from ledgerloom.streaming import incremental


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('﻿{"id": "x", "n": 1}\n\n{"id": "y", "n": 2}\n', encoding="utf-8")
    assert [(r.id, r.n) for r in datasets.jsonl(spark, str(tmp_path / "a.jsonl"), "id string, n int").orderBy("id").collect()] == [("x", 1), ("y", 2)]
    (tmp_path / "b.jsonl").write_text('{"id": \n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        datasets.jsonl(spark, str(tmp_path / "b.jsonl"), "id string").collect()


def test_tsv_and_boxes(spark, tmp_path):
    head = "level page_num block_num par_num line_num word_num left top width height conf text".replace(" ", "\t")
    (tmp_path / "t.tsv").write_text(f'{head}\n5\t1\t1\t1\t2\t1\t10\t20\t30\t5\t91.5\t"quoted\n4\t1\t1\t1\t2\t0\t0\t0\t9\t9\t-1\tline\n5\t1\t1\t1\t2\t2\t1\t1\t1\t1\t5\t \n')
    assert [tuple(r) for r in datasets.ocr_tsv(spark, str(tmp_path / "t.tsv")).collect()] == [('"quoted', [10.0, 20.0, 40.0, 25.0], 91.5, "1:1:1:2")]
    lines = spark.createDataFrame([("a", "1,2,9,2,9,8,1,8,TOTAL, RM 5"), ("a", "1,2,x,4"), ("a", " ")], "id string, line string")
    assert [(r.box, r.text, r.issue) for r in datasets.box_lines(lines).collect()] == [([1.0, 2.0, 9.0, 8.0], "TOTAL, RM 5", None), (None, None, "invalid_box_line")]


def test_entities_and_decode(spark):
    files = spark.createDataFrame([("a", '{"date": "1/2/2020", "total": " "}'), ("b", "{broken")], "id string, content string")
    a, b = datasets.entities(files).orderBy("id").collect()
    assert tuple(a.date) == ("annotated", "1/2/2020") and tuple(a.total) == ("unannotated", None) and a.issue is None and b.issue == "invalid_entities"
    raw = spark.createDataFrame([(bytearray("é".encode()),), (bytearray("é€".encode("cp1252")),)], "c binary")
    assert [tuple(r.d) for r in raw.select(datasets.decode_text(F.col("c")).alias("d")).collect()] == [("é", None), ("é€", "encoding_fallback_cp1252")]


def test_photo_set(spark, tmp_path):
    (tmp_path / "class_list.txt").write_text("1 Date_value\n2 Total_value\n3  Tax_value\n4 Subtotal_value\n5 Other key\n")
    (tmp_path / "train.txt").write_text('{"file_name": "i.jpg", "width": 9, "height": 9, "annotations": [{"box": [0,0,5,0,5,5,0,5], "label": 2, "text": "5.00"}, {"box": [], "label": 5, "text": "x"}]}\n')
    assert [(r.n, r.text, r.name) for r in datasets.photo_regions(spark, str(tmp_path), "train").orderBy("n").collect()] == [(0, "5.00", "Total_value"), (1, "x", "Other key")]
    (tmp_path / "class_list.txt").write_text("1 Date_value\n")
    with pytest.raises(ValueError, match="Total_value"):
        datasets.photo_regions(spark, str(tmp_path), "train")


def test_checks(spark):
    files = spark.createDataFrame([("a.JPG", 5), ("b.txt", 5), ("c.pdf", 0), ("d.png", 1 << 30)], "path string, length long")
    assert [r.reason for r in datasets.file_checks(files).orderBy("path").collect()] == [None, "format", "empty", "too_large"]
    g = lambda s, v: {"status": s, "value": v, "candidates": None}
    rows = spark.createDataFrame([("a", {"date": g("annotated", "x")}), ("b", {"colour": g("annotated", " ")}), ("b", {"tax": g("absent", "1")})], "id string, gold map<string,struct<status:string,value:string,candidates:array<string>>>")
    got = sorted((r.id, sorted(r.errors)) for r in datasets.external_test(rows).collect())
    assert got == [("a", []), ("b", ["absent_with_value", "nothing_annotated", "repeated_id"]), ("b", ["empty_annotation", "repeated_id", "unknown_field"])]
    paths = spark.createDataFrame([(p,) for p in ("d/s/train/img/1.jpg", "d/s/train/box/1.txt", "d/s/train/entities/1.txt", "d/w/class_list.txt", "d/w/train.txt", "d/w/test.txt", "d/x/train.txt")], "path string")
    assert {tuple(r) for r in datasets.find_datasets(paths).collect()} == {("d/s", "scan"), ("d/w", "photo")}


def test_resume(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    path = str(tmp_path / "out")
    assert exports.append_missing(df.where("id = 1"), path) == 1
    assert exports.append_missing(df, path) == 1
    assert spark.read.json(path).count() == 2


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 2.5), ("b|c", None, 3.0)], "k string, x double, y double")
    assert exports.markdown(df.orderBy("k")) == "| k | x | y |\n| --- | --- | --- |\n| a | 1 | 2,50 |\n| b\\|c |  | 3 |\n"
    with pytest.raises(ValueError):
        exports.write_json(str(tmp_path / "x.json"), {"a": float("nan")})
    exports.replace_ledger(str(tmp_path / "l.json"), {"a": "1"})
    exports.replace_ledger(str(tmp_path / "l.json"), {"b": "2"})
    assert {tuple(r) for r in datasets.ledger(spark, str(tmp_path / "l.json")).collect()} == {("a", "1"), ("b", "2")}
    assert spark.range(1).select(exports.spanish_number(F.lit(1234.56)).alias("a"), exports.duration(F.lit(75.2)).alias("b")).first()[:] == ("1.234,6", "1 min 15 s")
    batch = spark.createDataFrame([("f", None, [(1, {"total": "1"}, {"total": "baja"})]), ("g", "broken", None)], "file string, error string, pages array<struct<page:int,fields:map<string,string>,confidence:map<string,string>>>")
    assert [(r.file, r.error, r.page, r.to_review) for r in exports.batch_rows(batch).orderBy("file").collect()] == [("f", None, 1, 1), ("g", "broken", None, None)]


def test_stream_adds_each_hash_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    args = (spark, str(src), "sha256 string, n int", str(tmp_path / "t"), str(tmp_path / "c"))
    (src / "1.json").write_text('{"sha256": "a", "n": 1}\n{"sha256": "a", "n": 1}\n')
    incremental.stream_new(*args).awaitTermination()
    (src / "2.json").write_text('{"sha256": "a", "n": 1}\n{"sha256": "b", "n": 2}\n')
    incremental.stream_new(*args).awaitTermination()
    assert sorted(r.sha256 for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["a", "b"]


def test_images(spark):
    gray = np.full((60, 80), 200, np.uint8)
    gray[20:40, 30:50] = 20
    assert 20 <= images.otsu_threshold(gray) < 200
    assert images.local_binary(gray)[30, 30] == 0 and images.local_binary(gray)[0, 0] == 255
    assert (images.damage(gray, "noise", 12) == images.damage(gray, "noise", 12)).all() and images.damage(gray, "crop", 0.2).shape == (48, 80)
    assert images.even_light(images.damage(np.full((60, 80), 200, np.uint8), "shadow", 0.5)).std() < 12
    df = spark.createDataFrame([(bytearray(gray.tobytes()), 80)], "p binary, w int")
    r = df.select(images.otsu("p").alias("t"), images.sauvola("p", "w").alias("b")).first()
    assert r.t == images.otsu_threshold(gray) and bytes(r.b) == images.local_binary(gray).tobytes()


def test_learning(spark):
    lines = spark.createDataFrame([(1, "ab 12"), (2, "ab"), (3, "cd")], "id int, text string")
    rows = learning.tfidf(lines).collect()
    import math

    for k in (1, 2, 3):
        assert math.isclose(sum(r.weight**2 for r in rows if r.id == k), 1)
    assert {r.term for r in rows if r.id == 2} == {" a", "ab", "b ", " ab", "ab ", " ab "}
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    data = [("total", bool(k % 4 == 0), x[k].tolist(), int(x[k, 0] > 0)) for k in range(300)]
    history = learning.train_per_field(spark.createDataFrame(data, "field string, validation boolean, features array<double>, label int"), epochs=30, rate=0.01)
    h = history.orderBy("epoch").collect()
    assert h[-1].validation < 0.6 * h[0].validation
    assert learning.diagnose(history).first().verdict in ("sound", "overfit")
