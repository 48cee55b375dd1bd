"""The learned line comparator: features, TF-IDF of letter n-grams, a small network, and its diagnosis."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import tfidf_text

NGRAMS, VOCABULARY = (2, 3, 4), 3000


def padded_ngrams(text: Column) -> Column:
    """N-grams of each word with a space at both ends, in columns only."""
    words = F.filter(F.split(tfidf_text(text), r"\s+"), lambda w: w != "")
    one = lambda w, n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) + 3 - n)), lambda i: F.substring(F.concat(F.lit(" "), w, F.lit(" ")), i, F.lit(n)))
    return F.flatten(F.transform(words, lambda w: F.concat(*(one(w, n) for n in NGRAMS))))


def tfidf(lines: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """lines: id, text. Long form id, term, weight: 1 + ln tf, smoothed idf, unit length; the ``size`` commonest terms.

    The vocabulary is a bounded table, so it is broadcast.
    """
    terms = lines.select("id", F.explode(padded_ngrams(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    documents = lines.select(F.count("*").alias("n_docs"))
    df = terms.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).orderBy(F.desc("total"), "term").limit(size)
    idf = df.crossJoin(F.broadcast(documents)).select("term", (F.ln((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = terms.join(F.broadcast(idf), "term").select("id", "term", ((1 + F.ln("tf")) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return raw.select("id", "term", (F.col("w") / norm).alias("weight"))


def line_positions(lines: DataFrame) -> DataFrame:
    """lines: doc_id, line_no, amount. Place in the document from 0 to 1, and whether the line has its largest amount."""
    w = Window.partitionBy("doc_id")
    n = F.count("*").over(w)
    at = F.row_number().over(w.orderBy("line_no")) - 1
    return lines.withColumn("position", F.when(n > 1, at / (n - 1)).otherwise(0.0)).withColumn("has_largest", F.coalesce(F.col("amount") == F.max("amount").over(w), F.lit(False)))


def weak_labels(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """A line is positive if one of its candidates is the true value."""
    hit = candidates.join(gold, ["doc_id", "field"]).groupBy("doc_id", "field", "line_no").agg(F.bool_or(F.col("norm") == F.col("truth")).alias("positive"))
    return hit


def train_network(x: np.ndarray, y: np.ndarray, vx: np.ndarray, vy: np.ndarray, *, hidden: int = 128, l2: float = 1e-3, rate: float = 1e-3, batch: int = 256, epochs: int = 40, patience: int = 5, seed: int = 42) -> tuple[list[dict], np.ndarray]:
    """One hidden layer with Adam and early stopping; the history of losses, and the best weights' validation scores."""
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, hidden), np.zeros(1)]
    m, s, n = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0

    def forward(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(0, a @ w[0] + w[1])
        return h, 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30)))

    loss = lambda t, p: float(-np.mean(t * np.log(np.clip(p, 1e-7, 1)) + (1 - t) * np.log(np.clip(1 - p, 1e-7, 1))))
    history, best, waited = [], (np.inf, [a.copy() for a in w]), 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            some = order[at : at + batch]
            h, p = forward(x[some])
            d = (p - y[some]) / len(some)
            dh = np.outer(d, w[2]) * (h > 0)
            grads = [x[some].T @ dh + l2 * w[0] / len(x), dh.sum(0), h.T @ d + l2 * w[2] / len(x), np.array([d.sum()])]
            n += 1
            for k, g in enumerate(grads):
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.001 * (g * g - s[k])
                w[k] -= rate * (m[k] / (1 - 0.9**n)) / (np.sqrt(s[k] / (1 - 0.999**n)) + 1e-8)
        now = loss(vy, forward(vx)[1])
        history.append({"epoch": epoch, "train": loss(y, forward(x)[1]), "validation": now})
        if now < best[0] - 1e-6:
            best, waited = (now, [a.copy() for a in w]), 0
        elif (waited := waited + 1) >= patience:
            break
    w = best[1]
    return history, forward(vx)[1]


def train_per_field(rows: DataFrame, **options: object) -> DataFrame:
    """rows: field, validation, features (array), label. One network a field; its history as rows."""
    def run(t: pa.Table) -> pa.Table:
        x, y, v = np.array(t.column("features").to_pylist()), t.column("label").to_numpy().astype(float), np.array(t.column("validation").to_pylist(), bool)
        history, _ = train_network(x[~v], y[~v], x[v], y[v], **options)
        return pa.table({"field": pa.array([t.column("field")[0].as_py()] * len(history), pa.string()), **{k: pa.array([h[k] for h in history], pa.int32() if k == "epoch" else pa.float64()) for k in ("epoch", "train", "validation")}})

    return rows.groupBy("field").applyInArrow(run, "field string, epoch int, train double, validation double")


def diagnose(history: DataFrame, rise_pct: float = 10.0, gap: float = 0.1) -> DataFrame:
    """history: field, epoch, train, validation. How far the validation loss rises past its best, and the verdict."""
    best = history.groupBy("field").agg(F.min("validation").alias("best"), F.min_by("epoch", F.struct("validation", "epoch")).alias("best_epoch"), F.max_by("validation", "epoch").alias("last"), F.max_by("train", "epoch").alias("last_train"))
    rise = (F.col("last") / F.col("best") - 1) * 100
    return best.withColumn("rise_pct", rise).withColumn("verdict", F.when((rise > rise_pct) | (F.col("last") - F.col("last_train") > gap), "overfit").otherwise("sound"))


def pick_lines(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """scores: doc_id, field, line_no, p. The best line, the first of equals, if it is sure enough."""
    return scores.groupBy("doc_id", "field").agg(F.min_by("line_no", F.struct(-F.col("p"), "line_no")).alias("line_no"), F.max("p").alias("p")).where(F.col("p") >= threshold)
