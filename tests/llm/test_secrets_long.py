"""Runs of token letters of any length are tested."""

import numpy as np

from ledgerloom.llm import secrets


def test_long_runs_are_candidates(frame):
    rng, letters = np.random.default_rng(10), list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    sizes = (512, 513, 1624, 40_000)
    texts = ["key " + "".join(rng.choice(letters, n)) + " end" for n in sizes] + ["zq12" * 400]
    rows = {r.doc_id: r for r in secrets.secret_report(frame([(k, t, "en", "a", 1) for k, t in enumerate(texts)])).collect()}
    assert [rows[k].spans for k in range(len(texts))] == [*(f"random:4:{4 + n}" for n in sizes), ""]
