"""What the pipeline's stages hold beside an executor's heap."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from ledgerloom.llm import packing, queries, toxicity
from ledgerloom.llm import recurrent_lm as lm

from fixtures_llm import PROSE

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def texts(n):
    rng, words = np.random.default_rng(3), PROSE.split()
    return [" ".join(f"{rng.choice(words)}{rng.integers(0, 500)}" for _ in range(40)) for _ in range(n)]


def test_pack_stage_gives_back_and_sends_small_batches(spark, frame, tmp_path):
    rows = [(k, t, "en", "a", 1) for k, t in enumerate(texts(60))]
    was = spark.conf.get(KEY)
    try:
        spark.conf.set(KEY, "10000")
        got = {(r.doc_id, r.length, r.ids_crc32) for r in corpus_pipeline.pack_sequences(spark, frame(rows), str(tmp_path)).collect()}
        assert int(spark.conf.get(KEY)) <= 1000
    finally:
        spark.conf.set(KEY, was)
    assert got == {(r.doc_id, r.length, r.ids_crc32) for r in packing.pack(frame(rows), queries.TOKENIZER).collect()}


def test_encoder_of_little_memory_encodes_the_same():
    little, much = packing.ChunkEncoder(queries.TOKENIZER, 1 << 14), packing.ChunkEncoder(queries.TOKENIZER)
    most = 0
    for t in texts(200):
        assert little(t.encode()) == much(t.encode())
        most = max(most, little.held, little.held_cores)
    assert most < 1 << 15 < much.held


@pytest.mark.parametrize("n", [0, 1, 30])
def test_training_hashes_few_words_at_once(monkeypatch, n):
    bags = [t.encode().split() for t in texts(n)]
    whole = toxicity._features(bags)
    sizes, grams = [], toxicity.grams
    monkeypatch.setattr(toxicity, "AT_ONCE", 16)
    monkeypatch.setattr(toxicity, "grams", lambda words: sizes.append(len(words)) or grams(words))
    for a, b in zip(whole, toxicity._features(bags), strict=True):
        assert a.dtype == b.dtype and np.array_equal(a, b)
    assert max(sizes, default=0) <= 16
    for k, bag in enumerate(bags[:3]):  # against hashing one word at a time
        rows = {zlib.crc32(toxicity.core(w).encode()) & (toxicity.BUCKETS - 1) for w in bag}
        assert rows <= set(whole[0][whole[2][k] : whole[2][k + 1]].tolist())


def test_recurrent_scoring_keeps_no_gates(monkeypatch):
    """What only the way back needs is neither kept nor computed in scoring, and scores are those of single steps."""
    rng = np.random.default_rng(5)
    v = lm.Vocabulary([(b"w%d" % k, 100 - k) for k in range(60)], [5.0] * lm.TAIL_CLASSES, 90, 5000)
    m = lm.Recurrent(v)
    m.w = {k: x + rng.normal(0, 0.3, x.shape).astype(np.float32) for k, x in m.w.items()}
    docs = [rng.integers(0, 60 + lm.TAIL_CLASSES, n) for n in (0, 1, 31, 32, 33, 200, 64, 5)]
    docs = [np.where(d == v.place[b""], 0, d) for d in docs]
    want = []
    for d in docs:
        h, last, total = np.zeros((1, lm.HIDDEN), np.float32), v.place[b""], 0.0
        for token in [*d, v.place[b""]]:
            h = m.step(h, np.array([last]))[0]
            total, last = total + float(m.log_probs(h, np.array([token]))[0]), token
        want.append(total)
    monkeypatch.setattr(lm.Recurrent, "_run", None)
    monkeypatch.setattr(lm, "AT_ONCE", 7)
    assert np.allclose(m.score(docs), want, rtol=1e-5, atol=1e-4)
