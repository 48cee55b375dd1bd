"""Fixed names of the data model and explicit schemas of its sources."""

from __future__ import annotations

from pyspark.sql import types as T

FIELDS = ("tax_id", "date", "document_number", "subtotal", "tax", "total")
MONEY = ("subtotal", "tax", "total")
#: Gold statuses, and those that count in an evaluation.
STATUSES = ("annotated", "unannotated", "ambiguous", "absent")
EVALUABLE = ("annotated", "absent")
LEVELS = ("alta", "media", "baja", "sin_valor")

BOX = T.ArrayType(T.DoubleType())
GOLD = T.MapType(T.StringType(), T.StructType([T.StructField("status", T.StringType()), T.StructField("value", T.StringType()), T.StructField("candidates", T.ArrayType(T.StringType()))]))
REGIONS = T.ArrayType(T.StructType([T.StructField("box", BOX), T.StructField("text", T.StringType()), T.StructField("label", T.StringType())]))

MANIFEST = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("dataset", T.StringType()), T.StructField("source_split", T.StringType()),
    T.StructField("split", T.StringType()), T.StructField("image", T.StringType()), T.StructField("sha256", T.StringType()),
    T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("gold", GOLD),
    T.StructField("regions", REGIONS), T.StructField("issues", T.ArrayType(T.StringType())),
])
PREDICTION = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("dataset", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    T.StructField("alerts", T.ArrayType(T.StringType())), T.StructField("validation", T.MapType(T.StringType(), T.StringType())),
    T.StructField("text", T.StringType()), T.StructField("elapsed_seconds", T.DoubleType()), T.StructField("cache_hit", T.BooleanType()), T.StructField("error", T.StringType()),
])
WORDS = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("view", T.IntegerType()), T.StructField("word_no", T.IntegerType()), T.StructField("text", T.StringType()),
    *(T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1", "confidence")), T.StructField("line_id", T.StringType()),
])
OCR_TSV = T.StructType([T.StructField(c, T.StringType()) for c in ("level", "page_num", "block_num", "par_num", "line_num", "word_num")] + [T.StructField(c, T.DoubleType()) for c in ("left", "top", "width", "height", "conf")] + [T.StructField("text", T.StringType())])
