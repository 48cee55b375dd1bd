"""Words of the recurrent model as columns, and what it makes of rare ends and large weights."""

import collections
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import recurrent_lm as lm

ODD = [None, "", " ", "The  Gate\n", "\tA\x0bB\x0cC\rD ", "no break nel\u0085here  x", "a\x1cb \x1dc\x1e \x1f", "ÉCOLE İ Straße", "x" * 50, "q\x00r q", "end"]


@pytest.mark.parametrize("size", [1, 20, 1 << 20])
def test_words_are_those_of_bytes(monkeypatch, size):
    monkeypatch.setattr(lm, "TEXT_BYTES", size)
    for kind in (pa.string(), pa.large_string()):
        for texts in (pa.array(ODD, kind), pa.array(["gone", *ODD], kind).slice(1), pa.array([], kind)):
            got = [w[lo:hi].to_pylist() for w, ends in lm.words_of(texts) for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
            assert got == [(t or "").encode().lower().split() for t in texts.to_pylist()]


def test_words_are_encoded_as_one_by_one():
    v = lm.Vocabulary([(b"the", 9), (b"gate", 4), (b"\xc3\x89cole", 2)], [5.0] * lm.TAIL_CLASSES, 30, 900)
    words = [w for t in ODD if t for w in t.encode().lower().split()] + [b"the", b"gate", b"", b"a\x00", b"a", b"th"]
    assert v.encode(pa.array(words, pa.binary())).tolist() == [v.token(w) for w in words]
    assert v.encode(pa.array([], pa.binary())).tolist() == []


@pytest.mark.parametrize("most", [1, 99, 1 << 20])
def test_words_are_counted_by_block(monkeypatch, most):
    monkeypatch.setattr(lm, "WAITING_BYTES", most)
    monkeypatch.setattr(lm, "TEXT_BYTES", 30)
    rows = [(k // 9, k // 4, k % 3 == 0, t) for k, t in enumerate(ODD * 2)]
    schema = pa.schema([("f", pa.int64()), ("b", pa.int64()), ("h", pa.bool_()), ("t", pa.string())])
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    got, want = collections.Counter(), collections.Counter()
    for b in lm.counted(iter(table.to_batches(max_chunksize=5))):
        for *key, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            got[tuple(key)] += n
    for f, b, held, t in rows:
        for w in [*(t or "").encode().lower().split(), b""]:
            want[f, b, w] += not held
    assert got.keys() == want.keys() and got == want


@pytest.mark.parametrize("held", [False, True])
def test_an_end_that_is_rare_is_known(frame, monkeypatch, held):
    """Ends are few where documents are long; and no training document is left, or words are all the same."""
    monkeypatch.setattr(lm, "COMMON", 2)
    ids = [k for k in range(60) if (zlib.crc32(str(k).encode()) % 5 == 1) == held]
    rows = lm.lm_scores(frame([(k, "a b b c", "en", "a", 1) for k in ids])).collect()
    n = 0 if held else 5 * len(ids)
    c = {"b": 2 * n // 5, "": n // 5}
    base = sum(np.log10((c.get(w, n // 5) + 0.5) / (n + 0.5 * ((4 if n else 0) + 1))) for w in ["a", "b", "b", "c", ""])
    assert len(rows) == len(ids)
    for r in rows:
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (5, 5 if n else 0, n, held)
        assert r.base_score == pytest.approx(base) and np.isfinite(r.score)


def test_large_weights_leave_no_infinity():
    v = lm.Vocabulary([(b"w%d" % k, 100 - k) for k in range(60)], [5.0] * lm.TAIL_CLASSES, 90, 5000)
    m, rng = lm.Recurrent(v), np.random.default_rng(3)
    for k in ("classes", "words"):
        m.w[k] = rng.choice([-20, 20], m.w[k].shape).astype(np.float32)
    h = np.sign(rng.normal(size=(1, lm.HIDDEN))).astype(np.float32)
    h[0] = np.sign(m.w["classes"][:, 0])
    every = np.arange(v.n_head + lm.TAIL_CLASSES)
    found = m.log_probs(np.repeat(h, len(every), 0), every)
    assert np.isfinite(found).all() and np.exp(found).sum() == pytest.approx(1, abs=1e-3)


def test_a_shift_changes_no_gradient(monkeypatch):
    v = lm.Vocabulary([(b"w%d" % k, 100 - k) for k in range(60)], [5.0] * lm.TAIL_CLASSES, 90, 5000)
    m, rng = lm.Recurrent(v), np.random.default_rng(4)
    inputs, targets = rng.integers(0, 60 + lm.TAIL_CLASSES, (2, 9, 5))
    h = np.zeros((5, lm.HIDDEN), np.float32)
    state, g = m._window(h, inputs, targets)
    monkeypatch.setattr(lm, "SAFE", 0.0)
    monkeypatch.setattr(lm, "AT_ONCE", 7)
    again, shifted = m._window(h, inputs, targets)
    assert np.allclose(state, again) and all(np.allclose(g[k], shifted[k], atol=1e-6) for k in g)
