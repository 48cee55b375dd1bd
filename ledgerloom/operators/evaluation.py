"""Field scores, summaries, calibration, review time and bootstrap over a detail table.

detail: id, dataset, field, gold_normalized, predicted_normalized, correct, tp, fp, fn, execution_ok, confianza, tipo,
silencioso. A wrong value counts as a false positive and a false negative; a metric without support is null, not zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds a field takes to type, to check and to correct.
TYPE_S, CHECK_S, CORRECT_S = 9.0, 2.5, 9.0


def share(part: Column, whole: Column) -> Column:
    """part / whole; 0.0 where whole is 0. Callers turn it to null where there is no support."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def score_fields(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """gold: id, dataset, field, status, truth. predictions: id, status, field, predicted. A document without a
    prediction stays in, as missing_prediction; ids that gold lacks and repeated ids are errors."""
    evaluable = gold.where(F.col("status").isin("annotated", "absent")).drop("status")
    docs = predictions.select("id", F.col("status").alias("run_status")).distinct()
    docs = docs.withColumn("__n", F.count("*").over(Window.partitionBy("id"))).withColumn("run_status", F.when(F.col("__n") > 1, F.raise_error(F.lit("duplicate prediction ids"))).otherwise(F.col("run_status"))).drop("__n")
    joined = evaluable.join(docs, "id", "left").join(predictions.select("id", "field", "predicted"), ["id", "field"], "left")
    ok = F.coalesce(F.col("run_status"), F.lit("missing_prediction")) == "ok"
    predicted = F.when(ok, F.col("predicted"))
    same = F.col("truth").eqNullSafe(predicted)
    return joined.select(
        "id", "dataset", "field", F.col("truth").alias("gold_normalized"), predicted.alias("predicted_normalized"),
        (ok & same).cast("int").alias("correct"), F.coalesce(ok & (F.col("truth") == predicted), F.lit(False)).cast("int").alias("tp"),
        (predicted.isNotNull() & ~same).cast("int").alias("fp"), (F.col("truth").isNotNull() & ~same).cast("int").alias("fn"), ok.alias("execution_ok"),
    )


def foreign_predictions(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    return predictions.select("id").distinct().join(gold.select("id").distinct(), "id", "left_anti")


def field_metrics(detail: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """By dataset and field, and ALL datasets; every field comes, with nulls where it has no support."""
    sums = detail.groupingSets([["dataset", "field"], ["field"]], "dataset", "field").agg(*(F.sum(c).alias(c) for c in ("correct", "tp", "fp", "fn")), F.count("*").alias("support"))
    sums = sums.withColumn("dataset", F.coalesce("dataset", F.lit("ALL")))
    names = detail.select("dataset").distinct().unionByName(detail.sparkSession.createDataFrame([("ALL",)], "dataset string"))
    dense = names.withColumn("field", F.explode(F.array(*map(F.lit, fields))))
    m = dense.join(sums, ["dataset", "field"], "left").na.fill(0, ["correct", "tp", "fp", "fn", "support"])
    some = F.col("support") > 0
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return m.select(
        "dataset", "field", "support", F.when(some, share(F.col("correct"), F.col("support"))).alias("exact_match"), F.when(some, share(tp, tp + fp)).alias("precision"),
        F.when(some, share(tp, tp + fn)).alias("recall"), F.when(some, share(2 * tp, 2 * tp + fp + fn)).alias("f1"), "tp", "fp", "fn",
    )


def latency_summary(runs: DataFrame) -> DataFrame:
    """runs: ok, seconds, cache_hit. Median is interpolated, p95 is the nearest rank; cached runs don't count in either."""
    timed = F.when(F.col("ok") & ~F.col("cache_hit"), F.col("seconds"))
    return runs.agg(F.count("*").alias("documents"), F.count_if("ok").alias("successful"), F.avg(F.col("ok").cast("double")).alias("success_rate"), F.count(timed).alias("timed"), F.percentile(timed, F.lit(0.5)).alias("median_s"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY CASE WHEN ok AND NOT cache_hit THEN seconds END)").alias("p95_s"))


def composition() -> list[Column]:
    pct = lambda c: F.avg(c.cast("double")) * 100
    return [
        F.count("*").alias("campos"), pct(F.col("tipo") == "correcto").alias("exactitud"), pct(F.col("tipo") == "omision").alias("omisiones"),
        pct(F.col("tipo") == "equivocado").alias("equivocados"), pct(F.col("silencioso")).alias("silenciosos"),
    ]


def error_mix(detail: DataFrame) -> DataFrame:
    return detail.agg(*composition())


def subgroups(detail: DataFrame, factors: dict[str, Column]) -> DataFrame:
    """One row per factor and group of it, in one pass over the detail."""
    labels = F.array(*(F.struct(F.lit(k).alias("factor"), v.cast("string").alias("grupo")) for k, v in factors.items()))
    long = detail.withColumn("__g", F.explode(labels)).where("__g.grupo is not null")
    return long.groupBy(F.col("__g.factor").alias("factor"), F.col("__g.grupo").alias("grupo")).agg(F.count_distinct("id").alias("documentos"), *composition())


def calibration(detail: DataFrame) -> DataFrame:
    total = F.sum("campos").over(Window.partitionBy())
    pct = lambda c: F.avg(c.cast("double")) * 100
    by = detail.groupBy("confianza").agg(F.count("*").alias("campos"), pct(F.col("tipo") == "correcto").alias("exactitud"), pct(F.col("tipo") == "equivocado").alias("equivocados"), pct(F.col("tipo") == "omision").alias("omisiones"))
    return by.withColumn("porcentaje_de_campos", F.col("campos") * 100.0 / total)


def per_document(detail: DataFrame) -> DataFrame:
    """Documents right in all fields, and how many would be if fields failed on their own."""
    accuracy = F.avg(F.col("correct").cast("double")).over(Window.partitionBy("dataset", "field"))
    docs = detail.withColumn("p", accuracy).groupBy("id").agg(F.sum("correct").alias("ok"), F.count("*").alias("n"), F.min("p").alias("least"), F.sum(F.ln(F.nullif("p", F.lit(0.0)))).alias("lnp"))
    expected = F.when(F.col("least") == 0, 0.0).otherwise(F.exp("lnp"))
    return docs.agg(
        F.count("*").alias("documentos"), F.avg(F.col("n").cast("double")).alias("campos_por_documento"), (F.avg((F.col("ok") == F.col("n")).cast("double")) * 100).alias("todo_correcto"),
        (F.avg(expected) * 100).alias("esperado"), (F.avg((F.col("ok") < F.col("n")).cast("double")) * 100).alias("al_menos_un_error"),
    )


def review_time(detail: DataFrame, check_s: float = CHECK_S) -> DataFrame:
    """Seconds a document by hand, with every value checked, and with high-confidence values taken as they are."""
    low = F.col("confianza") != "alta"
    per = detail.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("tipo") == "omision").alias("om"), F.count_if(F.col("tipo") == "equivocado").alias("eq"), F.count_if(low).alias("low"), F.count_if(low & (F.col("tipo") != "correcto")).alias("fix"), F.count_if("silencioso").alias("sil"))
    m = per.agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in ("n", "om", "eq", "low", "fix", "sil")))
    manual = F.col("n") * TYPE_S
    ways = [("manual", manual, F.lit(0.0)), ("completa", F.col("n") * check_s + F.col("eq") * CORRECT_S + F.col("om") * TYPE_S, F.lit(0.0)), ("guiada", F.col("low") * check_s + F.col("fix") * CORRECT_S, F.col("sil") * 100)]
    rows = F.array(*(F.struct(F.lit(k).alias("forma"), s.alias("segundos"), e.alias("errores_100")) for k, s, e in ways))
    return m.select(manual.alias("m"), F.explode(rows).alias("r")).select("r.forma", "r.segundos", "r.errores_100", ((1 - F.col("r.segundos") / F.col("m")) * 100).alias("ahorro_pct"))


def time_sensitivity(detail: DataFrame, factors: tuple[float, ...] = (0.5, 1.0, 2.0)) -> DataFrame:
    out = None
    for f in factors:
        one = review_time(detail, CHECK_S * f).where("forma = 'completa'").select(F.lit(CHECK_S * f).alias("verificar_s"), "segundos", "ahorro_pct")
        out = one if out is None else out.unionByName(one)
    return out


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs' detail side by side, one to one; a repeated key is an error."""
    keys = ["id", "dataset", "field"]
    once = lambda df, c: df.groupBy(*keys).agg(F.count("*").alias("__n"), F.first("correct").alias(c)).withColumn(c, F.when(F.col("__n") > 1, F.raise_error(F.lit("repeated key"))).otherwise(F.col(c))).drop("__n")
    return once(a, "correct_a").join(once(b, "correct_b"), keys)


def gains_losses(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("field").agg(F.count_if(F.expr("correct_a = 0 and correct_b = 1")).alias("ganados"), F.count_if(F.expr("correct_a = 1 and correct_b = 0")).alias("perdidos"), F.sum(F.col("correct_b") - F.col("correct_a")).alias("delta"))


def bootstrap(per_doc: DataFrame, reps: int, seed: int, buckets: int = 1000) -> DataFrame:
    """per_doc: dataset, id, num, den. Percentile interval of sum(num) / sum(den) under resampling within datasets.

    Documents are summed in ``buckets`` groups of each dataset, by a hash of the id, and groups are drawn with
    replacement: a draw costs the same whatever the corpus, and with as many groups the interval is that of documents.
    """
    bucket = F.conv(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 8), 16, 10).cast("long") % buckets
    groups = per_doc.groupBy("dataset", bucket.alias("bucket")).agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    places = groups.withColumn("pos", F.row_number().over(Window.partitionBy("dataset").orderBy("bucket")) - 1)
    sizes = groups.groupBy("dataset").agg(F.count("*").alias("n"))
    draws = sizes.select("dataset", "n", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")).withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    drawn = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), "dataset", F.col("rep").cast("string"), F.col("k").cast("string")), 256), 1, 8), 16, 10).cast("long") % F.col("n")
    means = draws.withColumn("pos", drawn).join(F.broadcast(places), ["dataset", "pos"]).groupBy("rep").agg((F.sum("num") / F.sum("den")).alias("v"))  # places: buckets rows a dataset
    point = per_doc.agg((F.sum("num") / F.sum("den") * 100).alias("punto"))
    return means.agg((F.percentile("v", F.lit(0.025)) * 100).alias("inferior"), (F.percentile("v", F.lit(0.975)) * 100).alias("superior"), F.count("*").alias("reps")).crossJoin(point)


def scenario_verdict(scenarios: DataFrame, reference: str, drop_pp: float = 10, silent_pct: float = 5, processed_pct: float = 90) -> DataFrame:
    """scenarios: escenario, exactitud, silenciosos, procesados; one row is the reference that drops are from."""
    ref = scenarios.where(F.col("escenario") == reference).select(F.col("exactitud").alias("__ref"))
    out = scenarios.crossJoin(F.broadcast(ref)).withColumn("caida_pp", F.col("__ref") - F.col("exactitud")).drop("__ref")
    good = (F.col("caida_pp") <= drop_pp) & (F.col("silenciosos") <= silent_pct) & (F.col("procesados") >= processed_pct)
    return out.withColumn("veredicto", F.when(good, "cumple").otherwise("no cumple"))


def cer_text(s: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(s, r"\s+", " ")))


def cer(pairs: DataFrame) -> DataFrame:
    """pairs: id, reference, hypothesis, ok. Edits over reference characters; a failed document has no hypothesis."""
    ref, hyp = cer_text(F.col("reference")), F.when(F.col("ok"), cer_text(F.coalesce("hypothesis", F.lit("")))).otherwise("")
    rows = pairs.select("id", F.levenshtein(ref, hyp).cast("long").alias("edits"), F.length(ref).cast("long").alias("reference_characters")).where("reference_characters > 0")
    return rows.withColumn("cer", F.col("edits") / F.col("reference_characters"))
