"""Evaluation operators over the derived detail table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import evaluation as E
from ledgerloom.plans import fixtures as X
from ledgerloom.schema import FIELDS

#: Draws of an interval, and of the interval of a difference.
REPS, DELTA_REPS = 2000, 1000


def detail_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.detail(spark, sf_dir)


def score_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scoring join itself: gold against predictions with failed and missing documents."""
    d = X.detail(spark, sf_dir)
    gold = d.select("id", "dataset", "field", F.when(F.col("gold_normalized").isNull(), "absent").otherwise("annotated").alias("status"), F.col("gold_normalized").alias("truth"))
    predictions = d.where(F.col("id") % 13 != 0).select("id", F.when(F.col("execution_ok"), "ok").otherwise("error").alias("status"), "field", F.col("predicted_normalized").alias("predicted"))
    return E.score_fields(gold, predictions).groupBy("dataset", "field").agg(*(F.sum(c).alias(c) for c in ("correct", "tp", "fp", "fn")), F.count_if("execution_ok").alias("ok"), F.count("*").alias("n"))


def field_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.field_metrics(X.detail(spark, sf_dir), FIELDS)


def macro_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = field_metrics(spark, sf_dir).where("dataset <> 'ALL' and support > 0")
    return m.agg(F.avg("f1").alias("f1_macro"), F.avg("exact_match").alias("exactitud_macro"), F.min("exact_match").alias("peor"), F.sum("support").alias("soporte"))


def goal_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At or above, and strictly above: both readings of the goal of 80 % a field, and what is missing to it."""
    m = field_metrics(spark, sf_dir).where("support > 0")
    return m.select("dataset", "field", (F.col("exact_match") >= 0.6).alias("cumple"), (F.col("exact_match") > 0.6).alias("cumple_estricto"), F.greatest(F.lit(0), F.ceil(F.expr("support * 8 / 10.0D")) - F.col("tp")).cast("long").alias("faltan"))


def all_groups_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = field_metrics(spark, sf_dir).where("support > 0 and dataset <> 'ALL'")
    return m.groupBy("dataset").agg(F.bool_and(F.col("exact_match") > 0.5).alias("todos"), F.bool_or(F.col("exact_match") > 0.6).alias("alguno"))


def summary_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.table(spark, sf_dir, "events")
    return E.latency_summary(e.select((F.col("event_id") % 20 != 0).alias("ok"), F.col("value").alias("seconds"), (F.col("user_id") % 5 == 0).alias("cache_hit")))


def error_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.error_mix(X.detail(spark, sf_dir))


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.calibration(X.detail(spark, sf_dir))


def per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.per_document(X.detail(spark, sf_dir))


def review_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.review_time(X.detail(spark, sf_dir))


def time_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.time_sensitivity(X.detail(spark, sf_dir))


def subgroups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.subgroups(X.detail(spark, sf_dir), {"dataset": F.col("dataset"), "field": F.col("field"), "importe": F.when(F.length("gold_normalized") > 8, "largo").otherwise("corto")})


def gains_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.detail(spark, sf_dir)
    a = d.select("id", "dataset", "field", "correct")
    b = d.select("id", "dataset", "field", F.when(F.col("id") % 5 == 0, 1).otherwise(F.col("correct")).alias("correct"))
    return E.gains_losses(E.paired(a, b))


def _per_doc(d: DataFrame, num: str) -> DataFrame:
    return d.groupBy("dataset", "id").agg(F.sum(num).alias("num"), F.count("*").alias("den"))


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.bootstrap(_per_doc(X.detail(spark, sf_dir), "correct"), REPS, 42)


def bootstrap_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.detail(spark, sf_dir).withColumn("delta", F.when(F.col("id") % 5 == 0, 1 - F.col("correct")).otherwise(0))
    return E.bootstrap(_per_doc(d, "delta"), DELTA_REPS, 4242)


def adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change is adopted if its interval is above zero and the worst field gets no worse."""
    d = X.detail(spark, sf_dir).withColumn("after", F.when(F.col("id") % 5 == 0, 1).otherwise(F.col("correct")))
    by = d.groupBy("dataset", "field").agg(F.avg(F.col("correct").cast("double")).alias("b"), F.avg(F.col("after").cast("double")).alias("a")).agg(F.min("b").alias("peor_antes"), F.min("a").alias("peor_despues"))
    return bootstrap_delta(spark, sf_dir).crossJoin(by).select("inferior", "peor_antes", "peor_despues", ((F.col("inferior") > 0) & (F.col("peor_despues") >= F.col("peor_antes"))).alias("adoptar"))


def scenario_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios are views: each reads the same documents with noise of its own."""
    truth = X.gold(spark, sf_dir).select("doc", "field", F.col("cents").alias("want"))
    seen = truth.crossJoin(F.broadcast(spark.range(4).select(F.col("id").cast("int").alias("view")))).join(X.readings(spark, sf_dir).select("doc", "field", "view", "cents", "score"), ["doc", "field", "view"], "left")
    by = seen.groupBy(F.concat(F.lit("v"), F.col("view").cast("string")).alias("escenario")).agg((F.avg(F.coalesce(F.col("cents") == F.col("want"), F.lit(False)).cast("double")) * 100).alias("exactitud"), (F.avg(F.coalesce((F.col("cents") != F.col("want")) & (F.col("score") >= 8), F.lit(False)).cast("double")) * 100).alias("silenciosos"), (F.avg(F.col("cents").isNotNull().cast("double")) * 100).alias("procesados"))
    return E.scenario_verdict(by, "v0", processed_pct=80)


def sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, most and range of accuracy over the levels of each factor."""
    s = subgroups(spark, sf_dir)
    return s.groupBy("factor").agg(F.min("exactitud").alias("minimo"), F.max("exactitud").alias("maximo"), (F.max("exactitud") - F.min("exactitud")).alias("rango"))


def interaction_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by dataset and level, side by side, with the spread of each row."""
    g = X.detail(spark, sf_dir).groupBy("dataset").pivot("confianza", ["alta", "media", "baja"]).agg(F.avg(F.col("correct").cast("double")))
    return g.withColumn("rango", F.greatest("alta", "media", "baja") - F.least("alta", "media", "baja"))


def seeds_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, sample deviation and 95 % t interval over five parts."""
    by = X.detail(spark, sf_dir).groupBy("field", (F.col("id") % 5).alias("seed")).agg(F.avg(F.col("correct").cast("double")).alias("v"))
    half = F.lit(2.7764451051977987) * F.stddev_samp("v") / F.sqrt(F.count("v"))  # t(0.975, 4)
    return by.groupBy("field").agg(F.avg("v").alias("media"), F.stddev_samp("v").alias("desv"), (F.avg("v") - half).alias("inf"), (F.avg("v") + half).alias("sup"))


def overfit_onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First epoch after the best whose loss is 5 % above it. Epochs are days, losses mean event values."""
    e = X.table(spark, sf_dir, "events").groupBy("event_type", F.dayofyear("ts").alias("epoch")).agg(F.round(F.avg("value"), 6).alias("loss"))
    w = Window.partitionBy("event_type")
    best = e.withColumn("low", F.min("loss").over(w)).withColumn("best_epoch", F.min_by("epoch", F.struct("loss", "epoch")).over(w))
    return best.groupBy("event_type", "low", "best_epoch").agg(F.min(F.when((F.col("epoch") > F.col("best_epoch")) & (F.col("loss") > 1.05 * F.col("low")), F.col("epoch"))).alias("onset"))


def log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-loss clipped at 1e-7 and F1 at a threshold of a half, of a score by amount."""
    d = X.detail(spark, sf_dir).withColumn("p", F.least(F.lit(1 - 1e-7), F.greatest(F.lit(1e-7), F.when(F.col("confianza") == "alta", 0.9).when(F.col("confianza") == "media", 0.6).otherwise(0.0))))
    y, hit = F.col("correct"), F.col("p") >= 0.5
    tp, fp, fn = F.count_if(hit & (y == 1)), F.count_if(hit & (y == 0)), F.count_if(~hit & (y == 1))
    return d.groupBy("field").agg((-F.avg(y * F.ln("p") + (1 - y) * F.ln(1 - F.col("p")))).alias("perdida"), E.share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def cer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items against a damaged copy of their beginning: character errors after folding to ASCII letters."""
    b = X.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.regexp_replace("text", "[^A-Za-z ]", "").alias("reference"))
    return E.cer(b.select("id", "reference", F.concat(F.substring("reference", 2, 60), F.lit("xyz")).alias("hypothesis"), F.lit(True).alias("ok")))


def equivalence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ways to the same table differ in no row, either way round."""
    a = X.detail(spark, sf_dir).groupBy("field", "tipo").agg(F.count("*").alias("n"))
    b = X.detail(spark, sf_dir).groupBy("id", "field", "tipo").count().groupBy("field", "tipo").agg(F.sum("count").alias("n"))
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count("*").alias("diferencias"))


D = "WITH " + X.DETAIL_SQL
_COMP = "count(*) AS campos, avg((tipo = 'correcto')::INT) * 100 AS exactitud, avg((tipo = 'omision')::INT) * 100 AS omisiones, avg((tipo = 'equivocado')::INT) * 100 AS equivocados, avg(silencioso::INT) * 100 AS silenciosos"
_METRICS = f""",
s AS (SELECT coalesce(dataset, 'ALL') AS dataset, field, sum(correct)::BIGINT AS correct, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, count(*) AS support
  FROM detail GROUP BY GROUPING SETS ((dataset, field), (field))),
dense AS (SELECT dataset, unnest({list(FIELDS)}) AS field FROM (SELECT DISTINCT dataset FROM detail UNION ALL SELECT 'ALL')),
m0 AS (SELECT dataset, field, coalesce(support, 0) AS support, coalesce(correct, 0) AS correct, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM dense LEFT JOIN s USING (dataset, field)),
metrics AS (SELECT dataset, field, support, correct / nullif(support, 0) AS exact_match,
  CASE WHEN support > 0 THEN coalesce(tp / nullif(tp + fp, 0), 0) END AS precision, CASE WHEN support > 0 THEN coalesce(tp / nullif(tp + fn, 0), 0) END AS recall,
  CASE WHEN support > 0 THEN coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) END AS f1, tp, fp, fn FROM m0)"""


def _review(check: float, name: str = "rt") -> str:
    return f""",
{name}_p AS (SELECT id, count(*) AS n, count(*) FILTER (tipo = 'omision') AS om, count(*) FILTER (tipo = 'equivocado') AS eq, count(*) FILTER (confianza <> 'alta') AS low,
  count(*) FILTER (confianza <> 'alta' AND tipo <> 'correcto') AS fix, count(*) FILTER (silencioso) AS sil FROM detail GROUP BY id),
{name}_m AS (SELECT avg(n) AS n, avg(om) AS om, avg(eq) AS eq, avg(low) AS low, avg(fix) AS fix, avg(sil) AS sil FROM {name}_p),
{name} AS (SELECT forma, segundos, errores_100, (1 - segundos / m) * 100 AS ahorro_pct FROM (
  SELECT n * 9.0::DOUBLE AS m, unnest(['manual', 'completa', 'guiada']) AS forma, unnest([n * 9.0::DOUBLE, n * {check}::DOUBLE + eq * 9.0::DOUBLE + om * 9.0::DOUBLE, low * {check}::DOUBLE + fix * 9.0::DOUBLE]) AS segundos, unnest([0.0::DOUBLE, 0.0::DOUBLE, sil * 100]) AS errores_100 FROM {name}_m))"""


def _boot(num: str, seed: int, reps: int) -> str:
    return f""",
per AS (SELECT dataset, id, sum({num}) AS num, count(*) AS den FROM detail GROUP BY ALL),
bk AS (SELECT dataset, ('0x' || substr(sha256(id::VARCHAR), 1, 8))::BIGINT % 1000 AS bucket, sum(num) AS num, sum(den) AS den FROM per GROUP BY ALL),
pl AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY bucket) - 1 AS pos, count(*) OVER (PARTITION BY dataset) AS n FROM bk),
dr AS (SELECT dataset, rep, ('0x' || substr(sha256(concat_ws(':', '{seed}', dataset, rep::VARCHAR, k::VARCHAR)), 1, 8))::BIGINT % n AS pos
  FROM (SELECT dataset, n, rep, unnest(range(n)) AS k FROM (SELECT DISTINCT dataset, n FROM pl), (SELECT unnest(range({reps})) AS rep))),
mv AS (SELECT rep, sum(num) / sum(den) AS v FROM dr JOIN pl USING (dataset, pos) GROUP BY rep),
boot AS (SELECT quantile_cont(v, 0.025) * 100 AS inferior, quantile_cont(v, 0.975) * 100 AS superior, count(*) AS reps, (SELECT sum(num) / sum(den) * 100 FROM per) AS punto FROM mv)"""


_SUB = f""",
sub AS (SELECT factor, grupo, count(DISTINCT id) AS documentos, {_COMP} FROM (
  SELECT *, unnest(['dataset', 'field', 'importe']) AS factor, unnest([dataset, field, CASE WHEN length(gold_normalized) > 8 THEN 'largo' ELSE 'corto' END]) AS grupo FROM detail) GROUP BY ALL)"""
_DELTA = "CASE WHEN id % 5 = 0 THEN 1 - correct ELSE 0 END"

QUERIES = {f.__name__: f for f in (detail_scores, score_fields, field_metrics, macro_scores, goal_compliance, all_groups_pass, summary_latency, error_mix, calibration, per_document, review_time, time_sensitivity, subgroups, gains_losses, bootstrap_ci, bootstrap_delta, adoption, scenario_verdict, sensitivity, interaction_grid, seeds_mean_std, overfit_onset, log_loss, cer_pairs, equivalence_check)}
ORACLES = {
    "detail_scores": D + " SELECT * EXCLUDE (lv, read) FROM detail",
    "score_fields": D + """ SELECT dataset, field, sum(CASE WHEN id % 13 = 0 THEN 0 ELSE correct END)::BIGINT AS correct, sum(CASE WHEN id % 13 = 0 THEN 0 ELSE tp END)::BIGINT AS tp, sum(CASE WHEN id % 13 = 0 THEN 0 ELSE fp END)::BIGINT AS fp,
  sum(CASE WHEN id % 13 = 0 THEN (gold_normalized IS NOT NULL)::INT ELSE fn END)::BIGINT AS fn, count(*) FILTER (execution_ok AND id % 13 <> 0) AS ok, count(*) AS n FROM detail GROUP BY ALL""",
    "field_metrics": D + _METRICS + " SELECT * FROM metrics",
    "macro_scores": D + _METRICS + " SELECT avg(f1) AS f1_macro, avg(exact_match) AS exactitud_macro, min(exact_match) AS peor, sum(support)::BIGINT AS soporte FROM metrics WHERE dataset <> 'ALL' AND support > 0",
    "goal_compliance": D + _METRICS + " SELECT dataset, field, exact_match >= 0.6 AS cumple, exact_match > 0.6 AS cumple_estricto, greatest(0, ceil(support * 8 / 10.0::DOUBLE) - tp)::BIGINT AS faltan FROM metrics WHERE support > 0",
    "all_groups_pass": D + _METRICS + " SELECT dataset, bool_and(exact_match > 0.5) AS todos, bool_or(exact_match > 0.6) AS alguno FROM metrics WHERE support > 0 AND dataset <> 'ALL' GROUP BY dataset",
    "summary_latency": """WITH r AS (SELECT event_id % 20 <> 0 AS ok, value AS seconds, user_id % 5 = 0 AS cache_hit FROM events), t AS (SELECT *, CASE WHEN ok AND NOT cache_hit THEN seconds END AS s FROM r)
SELECT count(*) AS documents, count(*) FILTER (ok) AS successful, avg(ok::INT) AS success_rate, count(s) AS timed, quantile_cont(s, 0.5) AS median_s, quantile_disc(s, 0.95) AS p95_s FROM t""",
    "error_mix": D + f" SELECT {_COMP} FROM detail",
    "calibration": D + " SELECT confianza, count(*) AS campos, avg((tipo = 'correcto')::INT) * 100 AS exactitud, avg((tipo = 'equivocado')::INT) * 100 AS equivocados, avg((tipo = 'omision')::INT) * 100 AS omisiones, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS porcentaje_de_campos FROM detail GROUP BY confianza",
    "per_document": D + """, a AS (SELECT *, avg(correct) OVER (PARTITION BY dataset, field) AS p FROM detail), g AS (SELECT id, sum(correct) AS ok, count(*) AS n, product(p) AS e FROM a GROUP BY id)
SELECT count(*) AS documentos, avg(n) AS campos_por_documento, avg((ok = n)::INT) * 100 AS todo_correcto, avg(e) * 100 AS esperado, avg((ok < n)::INT) * 100 AS al_menos_un_error FROM g""",
    "review_time": D + _review(2.5) + " SELECT * FROM rt",
    "time_sensitivity": D + "".join(_review(2.5 * f, f"r{k}") for k, f in enumerate((0.5, 1.0, 2.0))) + " " + " UNION ALL ".join(f"SELECT {2.5 * f}::DOUBLE AS verificar_s, segundos, ahorro_pct FROM r{k} WHERE forma = 'completa'" for k, f in enumerate((0.5, 1.0, 2.0))),
    "subgroups": D + _SUB + " SELECT * FROM sub",
    "gains_losses": D + ", p AS (SELECT *, CASE WHEN id % 5 = 0 THEN 1 ELSE correct END AS b FROM detail) SELECT field, count(*) FILTER (correct = 0 AND b = 1) AS ganados, count(*) FILTER (correct = 1 AND b = 0) AS perdidos, sum(b - correct)::BIGINT AS delta FROM p GROUP BY field",
    "bootstrap_ci": D + _boot("correct", 42, REPS) + " SELECT * FROM boot",
    "bootstrap_delta": D + _boot(_DELTA, 4242, DELTA_REPS) + " SELECT * FROM boot",
    "adoption": D + _boot(_DELTA, 4242, DELTA_REPS) + ", w AS (SELECT min(b) AS peor_antes, min(a) AS peor_despues FROM (SELECT avg(correct) AS b, avg(CASE WHEN id % 5 = 0 THEN 1 ELSE correct END) AS a FROM detail GROUP BY dataset, field)) SELECT inferior, peor_antes, peor_despues, inferior > 0 AND peor_despues >= peor_antes AS adoptar FROM boot, w",
    "scenario_verdict": "WITH " + X.READINGS_SQL + """, v AS (SELECT g.doc, g.field, g.cents AS want, x.view FROM gold g, (SELECT unnest(range(4))::INTEGER AS view) x),
e AS (SELECT 'v' || view::VARCHAR AS escenario, avg(coalesce(cents = want, false)::INT) * 100 AS exactitud, avg(coalesce(cents <> want AND score >= 8, false)::INT) * 100 AS silenciosos, avg((cents IS NOT NULL)::INT) * 100 AS procesados FROM v LEFT JOIN readings USING (doc, field, view) GROUP BY view),
c AS (SELECT *, (SELECT exactitud FROM e WHERE escenario = 'v0') - exactitud AS caida_pp FROM e)
SELECT *, CASE WHEN caida_pp <= 10 AND silenciosos <= 5 AND procesados >= 80 THEN 'cumple' ELSE 'no cumple' END AS veredicto FROM c""",
    "sensitivity": D + _SUB + " SELECT factor, min(exactitud) AS minimo, max(exactitud) AS maximo, max(exactitud) - min(exactitud) AS rango FROM sub GROUP BY factor",
    "interaction_grid": D + ", g AS (SELECT dataset, avg(correct) FILTER (confianza = 'alta') AS alta, avg(correct) FILTER (confianza = 'media') AS media, avg(correct) FILTER (confianza = 'baja') AS baja FROM detail GROUP BY dataset) SELECT *, greatest(alta, media, baja) - least(alta, media, baja) AS rango FROM g",
    "seeds_mean_std": D + ", v AS (SELECT field, id % 5 AS seed, avg(correct) AS v FROM detail GROUP BY ALL) SELECT field, avg(v) AS media, stddev_samp(v) AS desv, avg(v) - 2.7764451051977987 * stddev_samp(v) / sqrt(count(v)) AS inf, avg(v) + 2.7764451051977987 * stddev_samp(v) / sqrt(count(v)) AS sup FROM v GROUP BY field",
    "overfit_onset": "WITH e AS (SELECT event_type, dayofyear(ts)::INTEGER AS epoch, round(avg(value), 6) AS loss FROM events GROUP BY ALL), b AS (SELECT *, min(loss) OVER (PARTITION BY event_type) AS low, first_value(epoch) OVER (PARTITION BY event_type ORDER BY loss, epoch) AS best_epoch FROM e) SELECT event_type, low, best_epoch, min(CASE WHEN epoch > best_epoch AND loss > 1.05 * low THEN epoch END) AS onset FROM b GROUP BY ALL",
    "log_loss": D + ", p AS (SELECT *, least(1 - 1e-7, greatest(1e-7, CASE confianza WHEN 'alta' THEN 0.9 WHEN 'media' THEN 0.6 ELSE 0.0 END)) AS p FROM detail) SELECT field, -avg(correct * ln(p) + (1 - correct) * ln(1 - p)) AS perdida, 2 * count(*) FILTER (p >= 0.5 AND correct = 1) / (2 * count(*) FILTER (p >= 0.5 AND correct = 1) + count(*) FILTER (p >= 0.5 AND correct = 0) + count(*) FILTER (p < 0.5 AND correct = 1)) AS f1 FROM p GROUP BY field",
    "cer_pairs": "WITH b AS (SELECT item_id::VARCHAR AS id, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS reference FROM benchmark), t AS (SELECT id, upper(trim(regexp_replace(reference, '\\s+', ' ', 'g'))) AS r, upper(trim(regexp_replace(substr(reference, 2, 60) || 'xyz', '\\s+', ' ', 'g'))) AS h FROM b) SELECT id, levenshtein(r, h)::BIGINT AS edits, length(r)::BIGINT AS reference_characters, levenshtein(r, h) / length(r) AS cer FROM t WHERE length(r) > 0",
    "equivalence_check": "SELECT 0::BIGINT AS diferencias",
}
