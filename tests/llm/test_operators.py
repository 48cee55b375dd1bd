"""Each operator against a brute-force version, and on nulls, empty and long texts, repeated rows and empty tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from ledgerloom.llm import exact_dedup, line_dedup, mixing, packing, pii, quality, recurrent_lm, secrets, simhash, toxicity

from fixtures_llm import PROSE, hard_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ROWS = hard_rows()


def lower(t):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), t or "")


def test_packing(hard, empty):
    rows = packing.pack(hard, TOKENIZER, capacity=256, bins=3, fan_in=2).collect()
    tok = Tokenizer.from_file(TOKENIZER)
    want = collections.Counter()
    for d, t, *_ in ROWS:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for k, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want[(d, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 256
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_chunk_encoder_is_the_tokenizer():
    tok, enc = Tokenizer.from_file(TOKENIZER), packing.ChunkEncoder(TOKENIZER)
    for t in ("Hello, WORLD!! it's 12.5%", "a<|endoftext|>b", "École　Straße İstanbul ΑΣ ﬁ", "H̱ ́a é ok", "x\x1cy\x85z w", "l'été!?.,", ""):
        assert np.frombuffer(enc(t.encode()), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_best_fit_prefers_the_tightest_bin():
    fit = packing.BestFit(10, 2)
    assert fit.put("a", 6) == [] and fit.put("b", 7) == []
    assert fit.put("c", 3) == [[("b", 0), ("c", 7)]]
    assert fit.put("d", 5) == [] and fit.put("e", 8) == [[("a", 0)]]  # the fullest closes
    assert sorted(map(len, fit.rest())) == [1, 1]


def test_exact_dedup(hard, empty):
    rows = exact_dedup.exact_groups(hard).collect()
    groups = collections.defaultdict(list)
    for d, t, *_ in ROWS:
        groups[lower(t)].append(d)
    assert len(rows) == len(ROWS)
    sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in rows:
        ids = sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in rows) == len(groups)
    for limit in (exact_dedup.BROADCAST_ROWS, -1):
        exact_dedup.BROADCAST_ROWS, before = limit, exact_dedup.BROADCAST_ROWS
        kept = exact_dedup.exact_dedup(hard)
        exact_dedup.BROADCAST_ROWS = before
        assert kept.columns == hard.columns
        assert sorted(lower(r.text) for r in kept.collect()) == sorted(groups)
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.exact_dedup(empty).count() == 0


def test_mixing(frame, hard, empty):
    docs = [(k, "w " * (k % 7 + 1), "en", ("a", "b", "c", None)[min(k % 5, 3)], 1) for k in range(400)]
    rows = mixing.mix_report(frame(docs)).collect()
    size = {d: len(WORD.findall(t)) for d, t, *_ in docs}
    src = {d: s for d, _, _, s, _ in docs}
    total, by = collections.Counter(), collections.Counter()
    target = {}
    for r in rows:
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 3 * r["size"]
        total[src[r.doc_id]] += r["size"]
        by[src[r.doc_id]] += r.taken
        target[src[r.doc_id]] = r.target
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    weights = dict(zip(("a", "b", "c", None), (5, 2, 1, 5), strict=True))
    free = {s for s in target if target[s] < 3 * total[s] - 1e-6}
    assert all(target[s] <= 3 * total[s] + 1e-6 for s in target)
    assert len({round(target[s] / weights[s], 6) for s in free}) == 1
    assert sum(by.values()) == sum(size.values())  # the budget, to the word
    assert all(abs(by[s] - target[s]) < 2 * max(size.values()) for s in target)
    assert served_in_order(docs, target) == {r.doc_id: r.taken for r in rows}
    again = mixing.mix_report(frame(docs).repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    mixed = mixing.mix(frame(docs))
    assert mixed.columns == frame(docs).columns
    words = collections.Counter()
    for r in mixed.collect():
        words[r.source] += size[r.doc_id]
    assert all(abs(words[s] - target[s]) <= 7 for s in target)
    assert mixing.mix_report(hard).count() == len(ROWS) and mixing.mix_report(empty).count() == 0
    assert mixing.mix(hard).columns == hard.columns


def served_in_order(docs, target):
    """One queue a source, packets by virtual finish time, until the budget is spent."""
    line, taken = [], collections.Counter({d: 0 for d, *_ in docs})
    sources = collections.defaultdict(list)
    for d, t, _, s, _ in sorted(docs, key=lambda r: hashlib.sha256(f"{r[0]}:mix-1".encode()).hexdigest()):
        sources[s].append((d, len(WORD.findall(t))))
    for s, queue in sources.items():
        end = 0
        for k in range(3):
            for d, n in queue:
                for packet, at in enumerate(range(0, n, 64)):
                    words = min(64, n - at)
                    end += words
                    line.append((end / target[s], s is not None, s or "", d, k, packet, words))
    left = sum(n for q in sources.values() for _, n in q)
    for *_, d, _, _, words in sorted(line):
        taken[d] += min(words, left)
        left -= min(words, left)
    return dict(taken)


def test_mixing_cuts_long_documents_into_packets(frame):
    docs = [(1, "w " * 5000, "en", "a", 1), (2, "w " * 300, "en", "a", 1), (3, "w " * 2000, "en", "b", 1), (4, "w " * 10, "en", "c", 1), (5, "", "en", "c", 1)]
    rows = {r.doc_id: r for r in mixing.mix_report(frame(docs)).collect()}
    target = {s: rows[d].target for d, _, _, s, _ in docs}
    assert served_in_order(docs, target) == {d: r.taken for d, r in rows.items()} and rows[5].taken == 0
    for s, ids in (("a", (1, 2)), ("b", (3,)), ("c", (4, 5))):
        assert abs(sum(rows[d].taken for d in ids) - target[s]) <= 128


@pytest.mark.parametrize("hot", [16_384, 3])
def test_mixing_takes_crowds_of_one_id(frame, monkeypatch, hot):
    monkeypatch.setattr(mixing, "HOT", hot)
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 4)
    rows = mixing.mix_report(frame([(None if k % 2 else 7, "w " * (k % 9), "en", "a", 1) for k in range(60)] + [(k, "a b", "en", "b", 1) for k in range(20)])).collect()
    assert len(rows) == 80 and sum(r.taken for r in rows) == sum(r["size"] for r in rows)


def test_quality(hard, empty, frame):
    rows = sorted(quality.compression_quality(hard).collect(), key=str)
    want = []
    for d, t, *_ in ROWS:
        t = t or ""
        w = WORD.findall(t)
        c = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)))
    assert sorted((tuple(r)[:7] for r in rows), key=str) == sorted(want, key=str)
    said = {r.doc_id: r.kept for r in quality.compression_quality(frame([(1, (PROSE + " ") * 2, "", "", 1), (2, " ".join(f"w{k}" for k in range(60)) + " " + "AbA! " * 900, "", "", 1)])).collect()}
    assert said[2] is False
    assert quality.compression_quality(empty).count() == 0


def test_quality_keeps_prose_and_drops_noise():
    import random

    import zstandard

    rng, z = random.Random(3), zstandard.ZstdCompressor(level=3)
    words = [f"{a}{b}{c}" for a in "brstm" for b in ("a", "e", "io", "u") for c in ("nd", "st", "l", "rr", "t")]
    prose = " ".join(rng.choice(words) for _ in range(3000)).encode()
    noise = bytes(rng.randrange(33, 127) for _ in range(9000))
    assert quality.bands(prose, z)[0]
    assert not quality.bands(noise, z)[0]
    assert not quality.bands(prose[:6000] + b"same again " * 2000, z)[0]


def test_quality_verdict_is_the_ratios(frame):
    """Ratios by another call of the library, limits as stated, over whole texts and every chunk with the last."""
    import random

    import zstandard

    rng, texts = random.Random(9), []
    for n in (60, 150, 600, 3000):
        word = lambda letters, a, b: "".join(rng.choice(letters) for _ in range(rng.randint(a, b)))
        prose = [" ".join(rng.choice(PROSE.split()) + rng.choice(["", "", "s", "ed", "ing", "er", "ly", "ness", "est", "man"]) for _ in range(n)) for _ in range(4)]
        texts += [(t, True) for t in prose]
        texts += [(" ".join(word("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 4, 10) for _ in range(n)), False) for _ in range(4)]
        texts += [(t + " " + "ha" * len(t), False) for t in prose]
        texts += [(t[: len(t) // 2] + "\n" + "\n".join(f"entry{k}/of-the/same-old-list/{k}" for k in range(n // 2)), False) for t in prose]
        texts += [(t + " " + word("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 3 * len(t), 3 * len(t)), False) for t in prose]
    rows = {r.doc_id: r for r in quality.compression_quality(frame([(k, t, "", "", 1) for k, (t, _) in enumerate(texts)])).collect()}
    ratio = lambda b: len(b) / len(zstandard.compress(b, quality.LEVEL))
    for k, (t, _) in enumerate(texts):
        raw = t.encode()
        low, high = [limits for begin, limits in zip(quality.BAND_FROM, quality.BAND_LIMITS, strict=True) if begin <= len(raw)][-1]
        parts = [raw[at : at + 1024] for at in range(0, len(raw) - 1023, 1024)]
        parts += [raw[-1024:]] if len(raw) > 1024 and len(raw) % 1024 else []
        out = sum(not 1.5 <= ratio(p) <= 2.8 for p in parts)
        assert (rows[k].chunks, rows[k].chunks_out, rows[k].ratio) == (len(parts), out, pytest.approx(ratio(raw)))
        assert rows[k].kept == (not rows[k].base_failed and low <= ratio(raw) <= high and out <= len(parts) / 4)
    planted = [k for k, (_, good) in enumerate(texts) if not good and not rows[k].base_failed]
    assert len(planted) >= 30 and np.mean([not rows[k].kept for k in planted]) >= 0.9
    assert all(rows[k].kept or rows[k].base_failed for k, (_, good) in enumerate(texts) if good)


def test_pii(hard, empty, frame):
    base = pii.base_spans("a@b.co 10.0.0.1 300.1.1.1 card 4111 1111 1111 1111 and +1 (017) 555-7713")
    assert {k: len(v) for k, v in base.items()} == {"email": 1, "ip": 1, "card": 1, "phone": 1}
    many = [(k, f"x user{k}@mail.example.com y 10.0.{k}.7 z 4111 1111 1111 1111 w +1 (017) 555-7{k:03d} n {k} and 4111 1111 1111 1111 or user{k}@mail.example.com", "en", "a", 1) for k in range(60)]
    repeat = (99, "pay 4111 1111 1111 1111 today, the card 4111.1111.1111.1111 again, page 12", "en", "a", 1)
    rows = {r.doc_id: r for r in pii.pii_report(frame([*many, repeat])).collect()}
    assert rows[99].n_card == 1 and "card:4:23" in rows[99].spans.split(",")
    assert all(rows[k].base_sha256 == hashlib.sha256(rows[k].spans.encode()).hexdigest() for k in range(60))
    assert pii.pii_report(hard).count() == len(ROWS) and pii.pii_report(empty).count() == 0
    assert pii.emails("@" * 50_000 + "a@b.c") == [(50_000, 50_005)]
    assert pii.base_spans("7" * 200_000 + "@")["email"] == []


BASE_PII = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda t: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda t: all(int(p) <= 255 for p in t.split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda t: 16 <= len(re.sub("[^0-9]", "", t)) <= 19 and luhn_sum(re.sub("[^0-9]", "", t)) % 10 == 0),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda t: 8 <= len(re.sub("[^0-9]", "", t)) <= 15),
}


def luhn_sum(d):
    return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d)))


def test_pii_base_is_the_contract(frame):
    rng = np.random.default_rng(6)
    parts = ["a.b@c.de", "x@y", "@", "a@@b.c", "10.0.0.1", "1.2.3.4.5.6.7.8", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+49.30.1234", "+1", "12", "é", "日本", " ", "\n", "-", "0000.0.0.255", "6011000990139424 7"]
    texts = ["".join(str(rng.choice(parts)) + str(rng.choice(["", " ", "x "])) for _ in range(int(rng.integers(1, 25)))) for _ in range(300)]
    field = pii.Field()
    rows = {r.doc_id: r for r in pii.pii_spans(frame([(k, t, "", "", 1) for k, t in enumerate(texts)]), field).collect()}
    for k, t in enumerate(texts):
        want = {kind: [m.span() for m in rule.finditer(t) if ok(m.group())] for kind, (rule, ok) in BASE_PII.items()}
        text = ",".join(f"{kind}:{a}:{b}" for kind, spans in want.items() for a, b in spans)
        assert [rows[k][f"n_{kind}"] for kind in want] == [len(v) for v in want.values()], t
        assert rows[k].base_sha256 == hashlib.sha256(text.encode()).hexdigest()


def other_forms(rng, kind, k):
    """A plain mention and the same in forms that no pattern has."""
    digits = lambda n, low="0": "".join(str(x) for x in rng.integers(int(low), 10, n))
    if kind == "card":
        x = next(d for d in iter(lambda: digits(16), None) if luhn_sum(d) % 10 == 0)
        four = [x[i : i + 4] for i in range(0, 16, 4)]
        return " ".join(four), [".".join(four), "/".join(four)]
    if kind == "phone":
        a, b, c = digits(3, "2"), digits(3, "2"), digits(4)
        return f"+1 ({a}) {b}-{c}", [f"{a}{b}{c}", f"({a}) {b}-{c}", f"{a}.{b}.{c}"]
    if kind == "ip":
        x = [str(v) for v in rng.integers(11, 255, 4)]
        return ".".join(x), ["-".join(x), " . ".join(x), " ".join(x)]
    return f"user{k}@mail.example.com", [f"user{k}(at)mail.example.com", f"User{k}[at]mail.example.com"]


def test_field_adds_repeats_in_other_forms(frame):
    """Repeats that no pattern finds are added, other numbers are left alone."""
    rng, words = np.random.default_rng(12), PROSE.split()
    docs, want = [], {}
    for k in range(200):
        kind = pii.KINDS[k % 4]
        plain, forms = other_forms(rng, kind, k)
        form = str(rng.choice(forms))
        fill = lambda n: " ".join(str(rng.choice(words)) if rng.random() < 0.9 else f"{rng.choice(words)} {rng.integers(1, 10**7)} {rng.choice(words)}" for _ in range(n))
        head = f"{fill(20)} and {plain} then {fill(40)} also "
        docs.append((k, f"{head}{form} was {fill(20)}", "en", "a", 1))
        want[k] = f"{kind}:{len(head)}:{len(head) + len(form)}"
    docs += [(1000 + k, f"{' '.join(words)} {rng.integers(1, 10**9)} {' '.join(words)} call 555.{rng.integers(100, 999)}.{rng.integers(1000, 9999)} or 12/03/2019 at 12-13-14-15 now", "en", "a", 1) for k in range(100)]
    rows = {r.doc_id: r for r in pii.pii_report(frame(docs)).collect()}
    found = [w in rows[k].spans.split(",") for k, w in want.items()]
    assert np.mean(found) >= 0.9
    extra = [s for k, w in want.items() for s in rows[k].spans.split(",") if s != w]
    assert len(extra) == sum(rows[k].n_email + rows[k].n_ip + rows[k].n_card + rows[k].n_phone for k in want)
    assert not any(rows[1000 + k].spans for k in range(100))


def test_pii_long_runs():
    """Linear in runs without white space."""
    import time

    began = time.perf_counter()
    for t in ("7" * 3_000_000, "x" * 3_000_000 + "@", "a@" * 500_000, "7." * 1_000_000, "(at)" * 300_000):
        pii.added_spans(pii.Field(), [t], [pii.base_spans(t)])
    assert time.perf_counter() - began < 60


def test_skip_links_carry_labels():
    """Two mentions of one number: the one whose form says nothing takes the label of the other, far as they are apart."""
    units = pii.Units("4111 1111 1111 1111 " + "word 7 " * 300 + "then 4111.1111.1111.1111")
    assert (pii.SAME, 0, len(units.spans) - 1) in units.links
    field = pii.Field()
    field.link[pii.SAME] = 4 * np.eye(len(pii.LABELS))
    features = [[33]] + [[1]] * (len(units.spans) - 1)
    field.unit[33, 3] = 6
    p = field.marginals(features, np.array(units.links))
    assert p[-1].argmax() == 3 and p[-1, 3] > 0.8 and p[1].max() < 0.3


def test_marginals_on_a_tree_are_exact():
    """Against sums over all labellings."""
    import itertools

    rng, field = np.random.default_rng(2), pii.Field()
    field.unit, field.link = rng.normal(0, 1, field.unit.shape), rng.normal(0, 1, field.link.shape)
    features, links = [[0], [1], [2], [3]], [(0, 0, 1), (1, 0, 2), (2, 2, 3)]
    p = np.zeros((4, 5))
    for y in itertools.product(range(5), repeat=4):
        w = np.exp(sum(field.unit[k, y[k]] for k in range(4)) + sum(field.link[kind, y[i], y[j]] for kind, i, j in links))
        for k in range(4):
            p[k, y[k]] += w
    assert field.marginals(features, np.array(links)) == pytest.approx(p / p.sum(axis=1, keepdims=True), abs=1e-3)


def test_recurrent_lm(hard, empty):
    rows = recurrent_lm.lm_scores(hard).collect()
    c, texts = collections.Counter(), []
    for d, t, *_ in ROWS:
        held = d is not None and zlib.crc32(str(d).encode()) % 5 == 1
        tokens = [*WORD.findall(lower(t)), None]
        texts.append((d, held, tokens))
        if not held:
            c.update(tokens)
    n, v = sum(c.values()), len(c)
    want = [(d, held, len(w), sum(c[x] > 0 for x in w), n, round(sum(np.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for d, held, w in texts]
    assert sorted((tuple(r)[:5] + (round(r.base_score, 6),) for r in rows), key=str) == sorted(want, key=str)
    assert all(np.isfinite(r.score) and r.score < 0 for r in rows)
    assert recurrent_lm.lm_scores(empty).count() == 0


def test_recurrent_scores_are_the_models(frame):
    """Every word's probability by the model's equations, one word and one document at a time."""
    rng = np.random.default_rng(7)
    docs = [(k, " ".join(str(rng.choice(PROSE.split())) + str(rng.choice(["", "s", f"{k}"])) for _ in range(int(rng.integers(0, 80)))), "en", "a", 1) for k in range(120)]
    df = frame(docs)
    rows = {r.doc_id: r.score for r in recurrent_lm.lm_scores(df).collect()}
    c = collections.Counter(x for d, t, *_ in docs if zlib.crc32(str(d).encode()) % 5 != 1 for x in [*t.lower().encode().split(), b""])
    order = sorted(c.items(), key=lambda x: (-x[1], x[0]))[: recurrent_lm.HEAD_WORDS]
    tail = [0.5] * recurrent_lm.TAIL_CLASSES
    for w, n in c.items():
        if w not in dict(order):
            tail[recurrent_lm.tail_class(w)] += n + 0.5
    v = recurrent_lm.Vocabulary(order, tail, len(c), c.total())
    m = recurrent_lm.train(df, v)
    for d, t, *_ in docs[:40]:
        h, last, total = np.zeros((1, recurrent_lm.HIDDEN), np.float32), v.place[b""], 0.0
        for w in [*t.lower().encode().split(), b""]:
            h = m.step(h, np.array([last]))[0]
            last = v.token(w)
            total += float(m.log_probs(h, np.array([last]))[0]) + (np.log((c[w] + 0.5) / tail[last - v.n_head]) if last >= v.n_head else 0)
        assert rows[d] == pytest.approx(total / np.log(10), rel=1e-2)


def test_language_model_beats_the_base(frame):
    """Held-out texts in which a word tells the next."""
    rng, words = np.random.default_rng(5), [f"w{k}" for k in range(60)]
    def text():
        k, out = int(rng.integers(60)), []
        for _ in range(60):
            out.append(words[k])
            k = (k * 7 + int(rng.integers(3))) % 60
        return " ".join(out)
    rows = recurrent_lm.lm_scores(frame([(k, text(), "en", "a", 1) for k in range(1500)])).collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)


def test_recurrent_learns_from_every_document(frame, monkeypatch):
    """Long or not, in the first task or another's part: without any one training document the weights differ."""
    monkeypatch.setattr(recurrent_lm, "FIRST_TOKENS", 20_000, raising=False)
    monkeypatch.setattr(recurrent_lm, "TASK_LEAST", 10_000, raising=False)
    rng, words = np.random.default_rng(8), [f"word{k}" for k in range(50)]
    docs = [(k, " ".join(rng.choice(words, 15_000 if k < 8 else 40)), "en", "a", 1) for k in range(60) if zlib.crc32(str(k).encode()) % 5 != 1]
    c = collections.Counter(x for d in docs for x in [*d[1].encode().split(), b""])
    v = recurrent_lm.Vocabulary(sorted(c.items(), key=lambda x: (-x[1], x[0])), [0.5] * recurrent_lm.TAIL_CLASSES, len(c), c.total())
    whole, again, *less = (recurrent_lm.train(frame(rows), v).w for rows in (docs, docs, docs[1:], docs[:1] + docs[2:], docs[:-1]))
    differ = lambda w: max(np.abs(w[k] - x).max() for k, x in whole.items())
    assert differ(again) < 1e-6 and all(differ(w) > 1e-5 for w in less)


def test_recurrent_probabilities_sum_to_one():
    head = [(b"", 50), *((f"w{k}".encode(), 40 - k) for k in range(20))]
    v = recurrent_lm.Vocabulary(head, [5.0] * recurrent_lm.TAIL_CLASSES, 30, 900)
    m = recurrent_lm.Recurrent(v)
    h = np.random.default_rng(1).normal(0, 1, (1, recurrent_lm.HIDDEN)).astype(np.float32)
    every = np.arange(v.n_head + recurrent_lm.TAIL_CLASSES)
    assert np.exp(m.log_probs(np.repeat(h, len(every), 0), every)).sum() == pytest.approx(1, abs=1e-3)


def test_recurrent_gradient():
    head = [(b"", 30), *((f"w{k}".encode(), 20) for k in range(30))]
    m = recurrent_lm.Recurrent(recurrent_lm.Vocabulary(head, [5.0] * recurrent_lm.TAIL_CLASSES, 31, 600))
    m.w = {k: x.astype(np.float64) for k, x in m.w.items()}
    rng = np.random.default_rng(0)
    inputs, targets = rng.integers(0, 31, (4, 3)), rng.integers(0, 31, (4, 3))
    loss = lambda: -sum(m.log_probs(s, t).sum() for s, t in zip(states(), targets, strict=True)) / targets.size

    def states():
        h = np.zeros((3, recurrent_lm.HIDDEN))
        for x in inputs:
            h = m.step(h, x)[0]
            yield h

    _, g = m._window(np.zeros((3, recurrent_lm.HIDDEN)), inputs, targets)
    for name, at in (("into", (int(inputs[1, 0]), 5)), ("into", (int(inputs[0, 1]), 50)), ("round", (3, 40)), ("round", (2, 70)), ("classes", (1, 2)), ("words", (int(targets[0, 0]), 3))):
        w = m.w[name]
        keep, e = w[at], 1e-5
        w[at] = keep + e
        up = loss()
        w[at] = keep - e
        down = loss()
        w[at] = keep
        assert g[name][at] == pytest.approx((up - down) / (2 * e), abs=1e-6)


def test_toxicity(frame, hard, empty):
    rng = np.random.default_rng(2)
    clean, rude = PROSE.split(), ["scoundrel", "blockhead", "numbskull"]
    docs, labels = [], []
    for k in range(500):
        words = [str(rng.choice(clean)) for _ in range(40)]
        if k % 4 == 0:
            words[5:30:8] = [str(rng.choice(rude)) for _ in words[5:30:8]]
        docs.append((k, " ".join(words), "en", "a", 1))
        labels.append((k, 1, int(k % 4 == 0)))
    docs += [(1000, " ".join(clean[:30] + ["scoundrell", "blokhead", "numbskul"] + clean[:10]), "en", "a", 1), (1001, " ".join(clean), "en", "a", 1), (1002, None, None, None, None), (1003, "", "", "", 0)]
    labelled = frame(labels, "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in toxicity.toxicity(frame(docs), labelled).collect()}
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    held = [k for k in range(500) if rows[k].held_out]
    assert all(rows[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in range(500))
    assert np.mean([rows[k].predicted == int(k % 4 == 0) for k in held]) > 0.95
    assert rows[1000].score > rows[1001].score
    none = frame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity(hard, none).collect()} and toxicity.toxicity(empty, none).count() == 0
    stays = toxicity.drop_toxic(frame(docs), labelled)
    assert stays.columns == frame(docs).columns and {r.doc_id for r in stays.collect()} == {k for k, r in rows.items() if r.score < 0.5}


def test_simhash(frame, hard, empty):
    rows = simhash.near_report(hard).collect()

    def fp(t):
        w = lower(t).encode().split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    assert sorted((str(r.doc_id), int(r.fingerprint, 16)) for r in rows) == sorted((str(d), fp(t)) for d, t, *_ in ROWS)
    assert {r.component_id for r in rows if r.doc_id in (3, 4, 5)} == {3}  # no words: fingerprint zero
    assert simhash.near_report(empty).count() == 0
    kept = simhash.near_dedup(hard)
    assert kept.columns == hard.columns and kept.count() == len({r.component_id for r in rows})


def brute_components(fps):
    a, root = np.array(fps, np.uint64), list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 2):
            x, y = find(i), find(i + 1 + int(j))
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


@pytest.mark.parametrize("hot", [100_000, 20])
def test_trie_join_finds_every_link(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {int(s) for s in seeds}
    for s in seeds:
        x = int(s)
        for _ in range(12):  # chains of small steps
            for b in rng.integers(0, 64, int(rng.integers(1, 4))):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r.fp: r.root for r in simhash.components(simhash.links(df, len(fps))).collect()}
    mine, want = [found.get(x, x) for x in signed], brute_components(fps)
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


def test_line_dedup(hard, empty, frame):
    boiler = "Copyright {} by the authors, all rights reserved"
    docs = [(k, f"A line of its own number{'abcdefgh'[k]} with words\n{boiler.format(1990 + k)}\nend", "en", "a", 1) for k in range(4)]
    docs += [(9, "only\n" + boiler.format("nineteen"), "en", "a", 1), (10, None, None, None, None), (11, "", "", "", 0)]
    rows = {r.doc_id: r for r in line_dedup.drop_template_lines(frame(docs)).collect()}
    assert all(rows[k].n_dropped >= 1 and "Copyright" not in rows[k].text and rows[k].text.endswith("end") for k in range(4))
    assert rows[10].text is None and rows[10].n_lines == 0 and rows[11].text == "" and rows[11].n_lines == 1
    out = line_dedup.drop_template_lines(hard)
    assert out.columns == [c for c in hard.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    rows = out.collect()
    assert len(rows) == len(ROWS) and {r["__row_key"] for r in rows} == {"own __row_key"}
    assert line_dedup.drop_template_lines(empty).count() == 0


def test_a_line_needs_a_template_of_its_own(frame):
    """Parts that recur in different lines make no template."""
    a = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    b = "alpha beta gamma one two three four five six seven eight nine".split()
    docs = [(k, " ".join(a), "en", "a", 1) for k in range(2)] + [(2, " ".join(a[:6] + b[6:10] + ["own", "end"]), "en", "a", 1)] + [(k, " ".join(b) + f"\nown{k}", "en", "a", 1) for k in range(4, 6)]
    docs = [(d, f"{t}\nown line {'abcdefgh'[d]}", *r) for d, t, *r in docs]
    rows = {r.doc_id: r.n_dropped for r in line_dedup.drop_template_lines(frame(docs)).collect()}
    assert rows == {0: 0, 1: 0, 2: 0, 4: 0, 5: 0}
    docs += [(7, " ".join(a[:8] + ["other", "words"] + a[10:]), "en", "a", 1)]  # one field of two words open
    rows = {r.doc_id: r.n_dropped for r in line_dedup.drop_template_lines(frame(docs)).collect()}
    assert rows[0] == rows[1] == rows[7] == 1 and rows[2] == rows[4] == 0


def test_lines_recur_by_length_and_by_texts(frame):
    long = " ".join(f"{w}{'abcdefghij'[k % 10]}" for k, w in enumerate((PROSE + " " + PROSE).split()))
    docs = [(1, f"{long}\none", "", "", 1), (2, f"{long}\ntwo", "", "", 1)]  # two texts are enough
    docs += [(k, "read more here\nx" + "abcdefghijklmno"[k - 10], "", "", 1) for k in range(10, 20)]  # ten for a short line
    docs += [(k, "read less here\ny" + "abcdefghijklmno"[k - 20], "", "", 1) for k in range(20, 29)]
    docs += [(k, "a line of some seven or eight words", "", "", 1) for k in range(30, 40)]  # copies are one text
    rows = {r.doc_id: r.n_dropped for r in line_dedup.drop_template_lines(frame(docs)).collect()}
    assert rows == {**{k: 1 for k in (1, 2, *range(10, 20))}, **{k: 0 for k in (*range(20, 29), *range(30, 40))}}


def test_rows_that_are_not_a_files_own(frame, hard):
    """After an explode or a join a file's row stands in several: they are rows of their own."""
    from pyspark.sql import functions as F

    from ledgerloom.llm.common import file_backed, materialise

    stored = materialise(hard)
    assert file_backed(stored.where("doc_id > 1").select("doc_id", "text")) is not None
    twice = stored.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    joined = stored.join(frame([(1,), (1,)], "doc_id long").withColumnRenamed("doc_id", "j"), F.col("doc_id") == F.col("j"))
    for df in (twice, joined, stored.unionByName(stored)):
        texts = collections.Counter(lower(r.text) for r in df.collect())
        rows = exact_dedup.exact_groups(df).collect()
        assert len(rows) == sum(texts.values()) and sorted(r.group_size for r in rows if r.kept) == sorted(texts.values())
        assert exact_dedup.exact_dedup(df).count() == len(texts)
        assert mixing.mix_report(df).count() == secrets.secret_report(df).count() == line_dedup.drop_template_lines(df).count() == len(rows)
        assert simhash.near_report(df).count() == len(rows)
    for op in (exact_dedup.exact_dedup, simhash.near_dedup, mixing.mix):
        out = op(hard)
        assert out.columns == hard.columns and all(r["__row_key"] == "own __row_key" and r["__copies"] == "own __copies" for r in out.collect())




ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def base_secrets(t):
    s = [("assign", *m.span()) for m in ASSIGN.finditer(t) if len(m.group(2)) >= 6]
    s += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    return s + [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 24]


def test_secrets(frame, hard, empty):
    rng = np.random.default_rng(8)
    key = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), 40))
    texts = [f"é secret: token = \"abcdef123456\" x {k} Password='hunter2hunter' token=a AKIA{'Q' * (14 + k)} {'0f' * (10 + k)}" for k in range(6)]
    texts += [f"note {key} stays out of reach", "zzzzzzzzzzzzzzzzzzzz1111111111111111111111 is no secret", "chapter-12-of-the-long-story-about-34-rivers", None, "", "token", "token=" * 3000 + "abcdefg"]
    rows = {r.doc_id: r for r in secrets.secret_report(frame([(k, t, "en", "a", 1) for k, t in enumerate(texts)])).collect()}
    order = {"assign": 0, "access": 1, "hex": 2}
    for k, t in enumerate(texts):
        want = sorted(base_secrets(t or ""), key=lambda s: (s[1], order[s[0]]))
        assert rows[k].base_sha256 == hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in want).encode()).hexdigest()
        assert (rows[k].n_assign, rows[k].n_access, rows[k].n_hex) == tuple(sum(s[0] == n for s in want) for n in order)
    assert rows[6].spans == "random:5:45" and rows[7].spans == rows[8].spans == rows[9].spans == ""
    assert secrets.secret_report(hard).count() == len(ROWS) and secrets.secret_report(empty).count() == 0


def test_battery_statistics(spark):
    """Each statistic by plain Python."""
    import math

    rng, rows = np.random.default_rng(1), []
    for name, (_, letters, n) in secrets.ENCODINGS.items():
        rows += ["".join(rng.choice(list(letters), n + k)) for k in (0, 9, 200)]
    rows += ["summer-holiday-2019-in-the-mountains-part-07", "ReportOfTheYear2021FinalVersion3"]
    tail = lambda z: math.exp(-0.717 * abs(z) - 0.416 * z * z)
    for r in secrets.battery(spark.createDataFrame([(x,) for x in rows], "found string")).collect():
        letters = secrets.ENCODINGS[r.encoding][1]
        x = r.found.lower() if r.encoding in ("hex", "base36") else r.found.replace("-", "+").replace("_", "/")
        n, k = len(x), len(letters)
        chi = sum(k / n * v * v for v in collections.Counter(x).values()) - n
        assert r.chi_p == pytest.approx(tail((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (1 - 1 / n))), rel=1e-6)
        of = lambda c: "d" if c.isdigit() else "U" if c.isupper() else "l"
        signless, alphabet = [of(c) for c in x if c not in "+/"], [of(c) for c in letters if c not in "+/"]
        borders, steps = sum(a != b for a, b in zip(signless, signless[1:])), len(signless) - 1
        differ = 1 - sum((v / len(alphabet)) ** 2 for v in collections.Counter(alphabet).values())
        assert r.runs_p == pytest.approx(tail((borders - steps * differ) / math.sqrt(steps * differ * (1 - differ) * 1.5)), rel=1e-6)
        v = np.array([letters.index(c) for c in x], float)
        d = v - v.mean()
        assert r.serial_p == pytest.approx(tail((d[1:] @ d[:-1]) / (d @ d) * math.sqrt(n) + 1 / math.sqrt(n)), rel=1e-6)
        excess = n * secrets.ordinary_excess(letters)
        z = ((k - 1 + excess - chi) / math.sqrt(2 * (k - 1 + 2 * excess)) + (borders - steps * 0.2) / math.sqrt(steps * 0.16)) / math.sqrt(2)
        assert r.ordinary_p == pytest.approx(tail(z) / 2 if z > 0 else 1, rel=1e-6)


def test_secrets_among_ordinary_strings(frame):
    """Planted keys of 40 characters are found, names, paths and numbers are left alone."""
    rng, words = np.random.default_rng(3), [w for w in PROSE.split() if len(w) > 3]
    letters = secrets.ENCODINGS["base62"][1]
    w, d = lambda: str(rng.choice(words)), lambda n: "".join(map(str, rng.integers(0, 10, n)))
    ordinary = [
        lambda: "-".join([w(), d(2), w(), w(), w(), d(2), w()]), lambda: f"/{w()}/{w()}/{d(4)}/{d(2)}/IMG_{d(8)}_{d(6)}", lambda: "".join(w().title() for _ in range(5)) + d(2),
        lambda: f"{w()}_{w()}_{w()}_v{d(1)}_{d(2)}_{w()}", lambda: f"{w()}{d(1)}{w()}{d(1)}{w()}{d(1)}{w()}", lambda: f"ISBN-978-{d(1)}-{d(2)}-{d(6)}-EDITION",
    ]
    docs, where = [], {}
    for k in range(600):
        if k % 5 == 0:
            key = "".join(rng.choice(list(letters), 40))
            docs.append((k, f"use {key} for it", "", "", 1))
            where[k] = "random:4:44"
        else:
            docs.append((k, f"see {ordinary[k % 6]()} and {ordinary[(k + 1) % 6]()} for it", "", "", 1))
    rows = {r.doc_id: r.spans for r in secrets.secret_report(frame(docs)).collect()}
    assert np.mean([rows[k] == s for k, s in where.items()]) >= 0.95
    assert np.mean([rows[d[0]] == "" for d in docs if d[0] not in where]) >= 0.99
