"""Toxicity from subword-bag embeddings.

A word is its lower-cased letters between markers, and its character n-grams; each has a vector in a hashed table. A
word's vector is the mean of its own, a bag's the mean over its words, and a linear softmax of that gives the score.
Table and softmax are trained together, in numpy, on a bounded sample of labelled documents. A misspelling that
training never met still shares most n-grams with the word it was.

The bag that a document is judged by is its window of WINDOW words with the largest margin, as a few words in thousands
would drown in the mean over all. Training comes to that in two steps: first on whole documents, whose labels are all
there is, then on the window of each that the model so far finds worst, chosen again in every round, toxic or not. A
fifth of the sample, kept apart, sets slope and offset of the margin.

As the layer on top is linear, each n-gram adds one number to the difference of the two classes: scoring needs that
number for each table row only, a few MB whatever the corpus, which goes to the executors with the task.

Null counts as empty; an empty text gets the score of the bias alone. Rows that repeat are scored alike. Without labels
of both classes the score is the share of toxic ones, 0 if there are none. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import FILE_KEY, ROW, ROW_KEY, file_backed, give_back, hashed_sample, materialise, with_row_key

#: Bounds of the sample: documents of each class, and characters of all of them.
SAMPLE_DOCS, SAMPLE_CHARS = 1500, 8_000_000
BUCKETS, DIM = 1 << 18, 6
NGRAMS = (3, 4, 5)
EPOCHS, BATCH, RATE, DECAY, SCALE, DAMP, SEED = 16, 32, 0.5, 3e-5, 30.0, 1e-8, 7
WINDOW_SCALE, WINDOW_RATE = 8.0, 0.1
#: Rows that fewer of the sample's documents have are not trained: they would teach those by heart.
MIN_DOCS = 3
WINDOW, ROUNDS, WINDOW_EPOCHS = 8, 2, 6
#: What a worker remembers of words, in bytes, about; words hashed at once, and texts scored at once.
REMEMBERED_BYTES = 40 << 20
AT_ONCE, TEXTS = 1 << 14, 256
EDGES = string.punctuation + "¡¿«»“”„’"


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0


def core(raw: bytes) -> str:
    return f"<{raw.decode().lower().strip(EDGES)}>"


def _crc_table() -> np.ndarray:
    """What CRC-32 makes of each byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


CRC = _crc_table()


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of words and their n-grams, one word's after the other's, and where each word's begin, and the end.

    A row is named by the CRC-32 of the n-gram in UTF-8; those that begin at any character are hashed together, byte
    by byte.
    """
    cores = [core(w) for w in words]
    size = np.fromiter(map(len, cores), np.int64, len(cores))
    begins = np.concatenate([[0], np.cumsum(1 + sum(np.maximum(size - n + 1, 0) for n in NGRAMS))])
    rows = np.empty(int(begins[-1]), np.int32)
    rows[begins[:-1]] = np.fromiter((zlib.crc32(c.encode()) & (BUCKETS - 1) for c in cores), np.int32, len(cores))
    data = np.frombuffer("".join(cores).encode(), np.uint8)
    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where characters begin
    ends = np.cumsum(size)
    word, char = np.repeat(np.arange(len(cores)), size), np.arange(len(at) - 1)
    length, place, first = {}, {}, begins[:-1] + 1 - (ends - size)
    for n in NGRAMS:
        length[n] = np.where(char + n <= ends[word], at[np.minimum(char + n, len(char))] - at[:-1], 0)
        place[n] = first[word] + char
        first = first + np.maximum(size - n + 1, 0)
    reach = np.maximum.reduce([*length.values()])
    state, live, k = np.full(len(char), 0xFFFFFFFF, np.uint32), np.flatnonzero(reach), 0
    while len(live):
        now = state[live]
        state[live] = now = CRC[(now ^ data[at[live] + k]) & np.uint32(255)] ^ (now >> np.uint32(8))
        k += 1
        for n in NGRAMS:
            if k >= n:
                done = length[n][live] == k
                rows[place[n][live[done]]] = ~now[done] & np.uint32(BUCKETS - 1)
        live = live[reach[live] > k]
    return rows, begins


class Model:
    """What scoring needs: the margin that each table row adds, and the bias."""

    def __init__(self, margin: np.ndarray, bias: float) -> None:
        self.margin, self.bias = margin, bias


def _features(bags: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the table, their weights and where each bag's begin; a bag names each of its rows once."""
    number = {w: k for k, w in enumerate(sorted(set().union(*bags)))}
    names, of, at = [*number], [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for some in range(0, len(names), AT_ONCE):
        found, ends = grams(names[some : some + AT_ONCE])
        of.append(found)
        at.append(ends[1:] + at[-1][-1])
    of, at = np.concatenate(of), np.concatenate(at)
    rows, weights, begins = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)], [0]
    for bag in bags:
        words, times = np.unique(np.fromiter(map(number.__getitem__, bag), np.int64, len(bag)), return_counts=True)
        size = at[words + 1] - at[words]
        first = np.cumsum(size) - size
        here = of[np.arange(int(size.sum())) + np.repeat(at[words] - first, size)]
        ids, inverse = np.unique(here, return_inverse=True)
        rows.append(ids)
        weights.append(np.bincount(inverse, np.repeat(times / (max(1, len(bag)) * size), size), len(ids)).astype(np.float32))
        begins.append(begins[-1] + len(ids))
    return np.concatenate(rows), np.concatenate(weights), np.array(begins)


class Learner:
    """The table and the softmax, with what their steps have added up to."""

    def __init__(self) -> None:
        self.rng = np.random.default_rng(SEED)
        self.table = self.rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.out, self.bias = self.rng.normal(0, 0.1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
        self.seen_t = np.full((BUCKETS, 1), DAMP, np.float32)
        self.seen_o, self.seen_b = np.full_like(self.out, 1e-8), np.full_like(self.bias, 1e-8)
        self.trained = np.zeros(BUCKETS, bool)
        self.place = np.zeros(BUCKETS, np.int64)

    def fit(self, bags: list[list[bytes]], y: np.ndarray, scale: float, epochs: int, rate: float) -> None:
        """A bag's mean is scaled up so that steps are of use: of its words, hundreds in a document, a few matter."""
        rows, weights, begins = _features(bags)
        self.trained |= np.bincount(rows, minlength=BUCKETS) >= MIN_DOCS
        weights = np.where(self.trained[rows], weights, np.float32(0))
        share = y.mean()
        cost = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        for epoch in range(epochs):
            order, now = self.rng.permutation(len(y)), rate * (1 - epoch / epochs)
            for at in range(0, len(y), BATCH):
                self._step(order[at : at + BATCH], rows, weights, begins, y, cost, scale, now)

    def _step(self, docs: np.ndarray, rows: np.ndarray, weights: np.ndarray, begins: np.ndarray, y: np.ndarray, cost: np.ndarray, scale: float, rate: float) -> None:
        spans = [np.arange(begins[d], begins[d + 1]) for d in docs]
        lengths = np.array([len(s) for s in spans])
        live, here = lengths > 0, np.concatenate(spans)
        if not len(here):
            return
        r, w = rows[here], weights[here] * np.float32(scale)
        bag = np.zeros((len(docs), DIM), np.float32)
        bag[live] = np.add.reduceat(self.table[r] * w[:, None], np.r_[0, np.cumsum(lengths[live])[:-1]])
        z = bag @ self.out + self.bias
        dz = np.exp(z - z.max(axis=1, keepdims=True))
        dz /= dz.sum(axis=1, keepdims=True)
        dz[np.arange(len(docs)), y[docs].astype(int)] -= 1
        dz *= cost[docs][:, None] / len(docs)
        d_bag = dz @ self.out.T
        d_out, d_bias = bag.T @ dz + DECAY * self.out, dz.sum(axis=0)
        met = np.zeros(BUCKETS, bool)
        met[r] = True
        ids = np.flatnonzero(met)
        self.place[ids] = np.arange(len(ids))
        inverse = self.place[r]
        doc_of = np.repeat(np.arange(len(docs)), lengths)
        d_table = np.column_stack([np.bincount(inverse, w * d_bag[doc_of, k], len(ids)) for k in range(DIM)]).astype(np.float32) + DECAY * self.table[ids]
        self.seen_t[ids] += (d_table**2).mean(axis=1, keepdims=True)
        self.table[ids] -= rate * d_table / np.sqrt(self.seen_t[ids])
        self.seen_o += d_out**2
        self.out -= rate * d_out / np.sqrt(self.seen_o)
        self.seen_b += d_bias**2
        self.bias -= rate * d_bias / np.sqrt(self.seen_b)

    def model(self, scale: float) -> Model:
        return Model(scale * (self.table @ (self.out[:, 1] - self.out[:, 0])) * self.trained, float(self.bias[1] - self.bias[0]))


def fit(texts: list[str], labels: list[int]) -> Model:
    y, learner = np.array(labels, np.float32), Learner()
    once: dict[bytes, bytes] = {}
    words = [[once.setdefault(w, w) for w in t.encode().split()] for t in texts]
    learner.fit(words, y, SCALE, EPOCHS, RATE)
    for _ in range(ROUNDS):
        worst = Scorer(learner.model(WINDOW_SCALE))
        learner.fit([w[begin:end] for w, (begin, end) in zip(words, worst.windows(words), strict=True)], y, WINDOW_SCALE, WINDOW_EPOCHS, WINDOW_RATE)
    return learner.model(WINDOW_SCALE)


def calibrated(model: Model, texts: list[str], labels: list[int], prior: float) -> Model:
    """Slope and offset of the margin, by logistic regression on texts the model was not fitted on; each class weighs
    what it does in the corpus."""
    margin = Scorer(model)
    x = np.array([m for at in range(0, len(texts), TEXTS) for m in margin.many([t.encode() for t in texts[at : at + TEXTS]])])
    y = np.array(labels, float)
    weight = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    middle, spread = x.mean(), max(float(x.std()), 1e-6)
    features = np.column_stack([(x - middle) / spread, np.ones_like(x)])
    c = np.array([1.0, math.log(prior / (1 - prior))])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(features @ c, -30, 30)))
        slope = features.T @ (weight * (p - y)) + 1e-2 * (c - [1.0, 0.0]) * [1, 0]
        curve = (features * (weight * p * (1 - p) + 1e-6)[:, None]).T @ features + np.diag([1e-2, 1e-6])
        c = c - np.linalg.solve(curve, slope)
    c[0] = max(c[0], 1e-3)
    return Model(model.margin * np.float32(c[0] / spread), float((model.bias - middle) * c[0] / spread + c[1]))


def train(texts: list[str], labels: list[int], prior: float) -> Model:
    """prior: share of toxic ones among all labelled documents. A fifth of the sample calibrates what the rest taught."""
    apart = [zlib.crc32(t.encode()) % 5 == 1 for t in texts]
    parts = [[(t, y) for t, y, a in zip(texts, labels, apart, strict=True) if a is side] for side in (False, True)]
    if any({y for _, y in part} != {0, 1} for part in parts):
        if set(labels) != {0, 1}:
            return Model(np.zeros(BUCKETS, np.float32), math.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
        parts = [list(zip(texts, labels, strict=True))] * 2
    return calibrated(fit(*zip(*parts[0], strict=True)), *zip(*parts[1], strict=True), prior)


def sample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[str], list[int], float]:
    """Texts and labels to learn from, and the toxic share of all labelled rows; never of held-out ones.

    About SAMPLE_DOCS of each class, by a hash of the id, whole, as long as they fit in SAMPLE_CHARS.
    """
    docs = file_backed(docs)
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__y"))
    n, toxic = usable.agg(F.count("*"), F.coalesce(F.sum("__y"), F.lit(0))).first()
    chosen = [hashed_sample(usable.where(F.col("__y") == y), ["__id"], SAMPLE_DOCS) for y in (0, 1)]
    few = F.broadcast(chosen[0].unionByName(chosen[1]))  # 4 * SAMPLE_DOCS rows at most
    named = with_row_key(docs, F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    found = named.join(few, "__id").select("__id", "__y", *ROW, F.coalesce(F.length("__text"), F.lit(0)).alias("n"))
    # an id may stand for any number of rows: those that come first by their hash
    sizes = hashed_sample(materialise(found), ["__id", *ROW], 4 * SAMPLE_DOCS).collect()
    sizes.sort(key=lambda r: (zlib.crc32(str(r["__id"]).encode()), r["__id"], r[FILE_KEY], r[ROW_KEY]))
    taken, left = [], SAMPLE_CHARS
    for r in sizes:
        if r["n"] <= left:
            left -= r["n"]
            taken.append((r[FILE_KEY], r[ROW_KEY], r["__y"]))
    if not taken:
        return [], [], toxic / n if n else 0.0
    keys = F.broadcast(docs.sparkSession.createDataFrame(taken, f"{FILE_KEY} long, {ROW_KEY} long, __y int"))
    rows = named.join(keys, ROW).select(*ROW, "__text", "__y").collect()
    rows.sort(key=lambda r: (r["__text"] or "", r["__y"]))  # by what they say: a table moved elsewhere gives the same model
    return [r["__text"] or "" for r in rows], [r["__y"] for r in rows], toxic / n


class Scorer:
    """Margins of texts under one model, with the words a worker has met; it outlives the tasks of the worker."""

    def __init__(self, model: Model) -> None:
        self.margin, self.bias = model.margin.astype(np.float64), model.bias
        self.known: dict[bytes, float] = {}
        self.held = 0

    def learn(self, words: set[bytes]) -> None:
        new = sorted(words)
        for at in range(0, len(new), AT_ONCE):
            some = new[at : at + AT_ONCE]
            rows, begins = grams(some)
            self.known.update(zip(some, (np.add.reduceat(self.margin[rows], begins[:-1]) / np.diff(begins)).tolist(), strict=True))
        self.held += sum(map(len, new)) + 190 * len(new)

    def margins(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))

    def _total(self, words: list[bytes]) -> np.ndarray:
        return np.concatenate([[0.0], np.cumsum(self.margins(words))])

    def texts(self, texts: list[list[bytes]]) -> None:
        """Meet the words of texts, all at once."""
        if self.held > REMEMBERED_BYTES:
            self.known.clear()
            self.held = 0
        self.learn(set().union(*texts).difference(self.known))

    def window(self, words: list[bytes]) -> tuple[int, int]:
        """Begin and end of the window of WINDOW words where the mean is largest; of all words if they are no more."""
        if len(words) <= WINDOW:
            return 0, len(words)
        total = self._total(words)
        at = int(np.argmax(total[WINDOW:] - total[:-WINDOW]))
        return at, at + WINDOW

    def windows(self, texts: list[list[bytes]]) -> Iterator[tuple[int, int]]:
        for at in range(0, len(texts), TEXTS):
            self.texts(texts[at : at + TEXTS])
            yield from map(self.window, texts[at : at + TEXTS])

    def _margin(self, words: list[bytes]) -> float:
        if not words:
            return self.bias
        total = self._total(words)
        return (float((total[WINDOW:] - total[:-WINDOW]).max()) / WINDOW if len(words) >= WINDOW else float(total[-1]) / len(words)) + self.bias

    def __call__(self, text: bytes) -> float:
        return self.many([text])[0]

    def many(self, texts: list[bytes | None]) -> list[float]:
        words = [(t or b"").split() for t in texts]
        self.texts(words)
        return [*map(self._margin, words)]


_scorers: dict[int, Scorer] = {}


def scorer(model: Model) -> Scorer:
    """One for each worker: that of the model it scored with last."""
    name = zlib.crc32(model.margin.tobytes(), zlib.crc32(repr(model.bias).encode()))
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = Scorer(model)
    return _scorers[name]


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin = scorer(model)
        for b in batches:
            found: list[float] = []
            texts = b.column(2).cast(pa.binary())
            for at in range(0, b.num_rows, TEXTS):
                found += margin.many(texts.slice(at, TEXTS).to_pylist())
            p = 1 / (1 + np.exp(-np.clip(np.array(found, float), -60, 60)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(*sample(docs, labels)))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents whose score is 0.5 or more; all its columns, in its order."""
    model = train(*sample(docs, labels, text_col=text_col))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin = Scorer(model)  # gone with the task: the stages that follow need the worker's memory
        for b in batches:
            texts = b.column(schema.fieldNames().index(text_col)).cast(pa.binary())
            for at in range(0, b.num_rows, TEXTS):
                yield b.slice(at, TEXTS).filter(pa.array([m < 0 for m in margin.many(texts.slice(at, TEXTS).to_pylist())]))
        del margin
        give_back()

    return docs.mapInArrow(run, schema)
