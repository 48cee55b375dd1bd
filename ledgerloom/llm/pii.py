"""Personal data by patterns and a skip-chain conditional random field.

Patterns find the plain forms. The field then labels every unit of a document that could be personal data (runs of
digits with their separators, words with an @ or an "(at)"): neighbouring units share a chain potential, units with the
same digits, number parts or address a skip potential, and those whose last digits agree another, however far apart
they are. Loopy belief propagation over the whole document makes a mention whose own form says little take the label of
its repeats: a card written with points, a phone number without its country, an address with "(at)". Spans that the
field is sure of and the patterns lack are added.

Weights are learned by pseudo-likelihood from all documents. The patterns label the units; for some of those that they
find, the same number or address written in another way joins the document as one more unit of that label, linked as it
would be, which is what the skip potentials have to learn. A unit with a skip link to a labelled one that no pattern
finds is the very thing in question: its label is unknown and teaches nothing. The units of all
documents, a few bytes for each, are dealt out at random to tasks of UNITS_A_TASK, each learns from its own, and their
weights are averaged by units: the learning problem is convex and the tasks' shares are alike, whatever lies together
in the files. What is gathered is one small table.

A document's units are linked to the first of their like, so links grow with the units and any two repeats are two
links apart, which ROUNDS covers however many there are. Units of a batch of documents are labelled together, as one
graph without links between documents; those that the patterns found are evidence.

Null counts as empty: no spans. Rows that repeat are read alike. An empty table gives an empty result; other columns
are ignored. All steps are linear in the text, runs without white space included.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialise, parts_for

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# Digits' runs are taken whole, which finds the same matches and keeps long runs from being tried from every digit.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]|[(\[]at[)\]]")
AT = re.compile(r"@|[(\[]at[)\]]")
RUN = re.compile(r"\+?\(?[0-9](?:[\x20()./-]{0,3}[0-9])*+")
NOT_DIGIT = re.compile(r"[^0-9]")
PART = re.compile(r"[0-9]+")
SPACE = re.compile(r"[\x20\x09-\x0D]")
TRIM = ".,;:!?\"'(){}<>|#*$%&"

#: Units that are learned from at once, steps on them, the share of labelled units that are written once more, and the
#: units of a task.
CHUNK, STEPS, REWRITTEN, UNITS_A_TASK = 2048, 600, 1.0, 50_000
RATE, LEFT_OUT, DECAY, SEED = 0.3, 0.4, 1e-3, 11
ROUNDS, DAMPING, SURE = 12, 0.3, 0.5
#: What a pattern's find adds to its label, in logarithms.
GIVEN = 20.0
CHAIN, SAME, SIMILAR = 0, 1, 2
N_FEATURES = 40
#: Characters of the texts that are labelled together, and links that are worked on at once.
BATCH_CHARS, LINKS_AT_ONCE = 1 << 21, 1 << 16


def luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in twice)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Every @ in turn: the local letters before it, not past the last match, and a domain after it."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        local = len(before) - len(before.rstrip(LOCAL))
        free = at + 1
        if local and (m := DOMAIN.match(text, at + 1)):
            found.append((at - local, m.end()))
            free = m.end()
        at = text.find("@", free)
    return found


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    if not MARK.search(text):
        return {k: [] for k in KINDS}
    small = lambda part: len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255
    cards = [(m, NOT_DIGIT.sub("", m.group())) for m in CARD.finditer(text)]
    phones = [(m, NOT_DIGIT.sub("", m.group())) for m in PHONE.finditer(text)] if "+" in text else []
    return {
        "email": emails(text),
        "ip": [m.span() for m in IP.finditer(text) if all(map(small, m.group().split(".")))],
        "card": [m.span() for m, d in cards if 16 <= len(d) <= 19 and luhn(d)],
        "phone": [m.span() for m, d in phones if 8 <= len(d) <= 15],
    }


def at_words(text: str) -> Iterator[tuple[int, int]]:
    """Words with an @ or an (at), without marks around them."""
    past = 0
    for m in AT.finditer(text):
        if m.start() < past:
            continue
        begin = m.start()
        while begin > past and not SPACE.match(text, begin - 1):
            begin -= 1
        found = SPACE.search(text, m.end())
        past = found.start() if found else len(text)
        word = text[begin:past]
        left = len(word) - len(word.lstrip(TRIM))
        if core := word.strip(TRIM):
            yield begin + left, begin + left + len(core)


def unit_spans(text: str) -> list[tuple[int, int]]:
    """Words with an @, and runs of digits between them, in order."""
    spans, past = [], 0
    for a, b in [*at_words(text), (len(text), len(text))]:
        spans += [m.span() for m in RUN.finditer(text, past, a)]
        if a < b:
            spans.append((a, b))
        past = b
    return spans


class Units:
    """Units of one document: spans, features and links (kind, i, j)."""

    def __init__(self, text: str) -> None:
        self.spans: list[tuple[int, int]] = []
        self.words: list[str] = []
        self.features: list[list[int]] = []
        self.links: list[tuple[int, int, int]] = []
        self.hub: dict[str, int] = {}
        for a, b in unit_spans(text):
            here = self.add(text[a:b], text[max(0, a - 24) : a], text[b : b + 1])
            self.spans.append((a, b))
            if here:
                self.links.append((CHAIN, here - 1, here))

    def add(self, word: str, before: str = "", after: str = "") -> int:
        """Its number. It is linked to the first unit of each of its keys."""
        here, linked = len(self.words), set()
        for kind, key in self.keys(word):
            first = self.hub.setdefault(key, here)
            if first != here and first not in linked:
                self.links.append((kind, first, here))
                linked.add(first)
        self.words.append(word)
        self.features.append(self.describe(word, before, after))
        return here

    @staticmethod
    def keys(word: str) -> list[tuple[int, str]]:
        if AT.search(word):
            return [(SAME, AT.sub("@", word.lower()))]
        digits, parts = NOT_DIGIT.sub("", word), PART.findall(word) if len(word) < 24 else []
        found = [(SAME, digits)] if len(digits) >= 6 else []
        found += [(SAME, ".".join(p.lstrip("0") or "0" for p in parts))] if len(parts) == 4 else []
        return found + ([(SIMILAR, f"~{digits[-7:]}")] if len(digits) >= 7 else [])

    @staticmethod
    def describe(word: str, before: str, after: str) -> list[int]:
        digits = NOT_DIGIT.sub("", word)
        n, parts = len(digits), word.split(".")
        on = [0, 1 + min(n, 20)]
        on += [22] * ("@" in word) + [23] * word.startswith("+") + [24] * ("(" in word) + [25] * (" " in word) + [26] * ("-" in word)
        on += [27 + min(len(parts) - 1, 4)]
        on += [32] * (len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts))
        on += [33] * (16 <= n <= 19 and luhn(digits)) + [34] * bool("@" in word and DOMAIN.fullmatch(word.rpartition("@")[2]))
        on += [35] * before.rstrip(" \t").endswith(("=", ":", "\"")) + [36] * bool(before[-1:].isalnum() or after.isalnum())
        on += [37] * (word.isdigit() and n < 6) + [38] * bool(len(word) < 400 and AT.search(word) and "@" not in word) + [39] * ("/" in word)
        return on


def rewritten(word: str, kind: str, rng: np.random.Generator) -> str:
    """The same number or address in another form."""
    if kind == "email":
        return word.replace("@", str(rng.choice(["(at)", "[at]"])))
    digits, parts = NOT_DIGIT.sub("", word), PART.findall(word)
    if kind == "ip":
        return str(rng.choice(["-", " . ", " ", "/"])).join(parts)
    if kind == "phone":
        digits = digits[int(rng.integers(0, max(1, len(digits) - 9))) :]
    mark = str(rng.choice(["", ".", "-", " ", "/"]))
    size = int(rng.integers(3, 6))
    return mark.join(digits[k : k + size] for k in range(0, len(digits), size))


def _flat(features: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all units in a row, and the unit of each."""
    return np.fromiter((f for on in features for f in on), np.int64), np.repeat(np.arange(len(features)), [len(on) for on in features])


def weak_labels(units: Units, base: dict[str, list[tuple[int, int]]]) -> list[int]:
    """The kind of the pattern's span that covers half of the unit or more."""
    spans = sorted((a, b, k) for k, kind in enumerate(KINDS) for a, b in base[kind])
    begins = [s[0] for s in spans]
    out = []
    for a, b in units.spans:
        best = (0, 0)
        at = bisect_right(begins, b) - 1
        for s, e, k in reversed(spans[max(0, at - 8) : at + 1]):
            best = max(best, (min(b, e) - max(a, s), 1 + k))
        out.append(best[1] if 2 * best[0] >= max(1, b - a) else 0)
    return out


class Field:
    def __init__(self) -> None:
        self.unit = np.zeros((N_FEATURES, len(LABELS)))
        self.link = np.zeros((3, len(LABELS), len(LABELS)))
        self.seen_u, self.seen_l = np.full_like(self.unit, 1e-6), np.full_like(self.link, 1e-6)
        self.rng, self.n = np.random.default_rng(SEED), 0

    def fit(self, features: list[list[int]], labels: list[int], links: list[tuple[int, int, int]], steps: int = STEPS) -> "Field":
        """Steps on the pseudo-likelihood of some units. Of some, features are left out: the links have to stand in."""
        known = [k for k, y in enumerate(labels) if y >= 0]
        place = dict(zip(known, range(len(known)), strict=True))
        features, labels = [features[k] for k in known], [labels[k] for k in known]
        links = [(k, place[i], place[j]) for k, i, j in links if i in place and j in place]
        x, y = np.zeros((len(labels), N_FEATURES)), np.array(labels, int)
        on, owner = _flat(features)
        x[owner, on] = 1
        one = np.eye(len(LABELS))[y]
        kind, i, j = np.array(links, int).reshape(-1, 3).T
        sums = lambda at, what: np.column_stack([np.bincount(at, what[:, c], len(y)) for c in range(len(LABELS))])
        for _ in range(steps if len(y) else 0):
            hidden = self.rng.random(len(y)) < LEFT_OUT
            xs = np.where(hidden[:, None], 0.0, x)
            xs[:, 0] = 1
            z = xs @ self.unit + sums(i, self.link[kind, :, y[j]]) + sums(j, self.link[kind, y[i], :])
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            d = (p - one) / len(y)
            du, dl = xs.T @ d + DECAY / len(y) * self.unit, DECAY / len(y) * self.link
            np.add.at(dl, (kind, slice(None), y[j]), d[i])
            np.add.at(dl, (kind, y[i]), d[j])
            self.seen_u += du**2
            self.seen_l += dl**2
            self.unit -= RATE * du / np.sqrt(self.seen_u)
            self.link -= RATE * dl / np.sqrt(self.seen_l)
        self.n += len(y)
        return self

    def learn(self, parts: Iterator["Part"]) -> "Field":
        """From any number of documents' units, CHUNK at a time."""
        features, labels, links = [], [], []
        for p in parts:
            links += [(k, i + len(labels), j + len(labels)) for k, i, j in p[2]]
            features += p[0]
            labels += p[1]
            if len(labels) >= CHUNK:
                self.fit(features, labels, links)
                features, labels, links = [], [], []
        return self.fit(features, labels, links)

    def marginals(self, features: list[list[int]], links: np.ndarray, given: np.ndarray | None = None) -> np.ndarray:
        """Loopy sum-product, in logarithms, damped. given: labels that are known, 0 for the rest."""
        on, owner = _flat(features)
        sums = lambda at, what: np.column_stack([np.bincount(at, what[:, c], len(features)) for c in range(len(LABELS))])
        own = sums(owner, self.unit[on])
        if given is not None:
            known = np.flatnonzero(given)
            own[known, given[known]] += GIVEN
        z = own
        if len(links):
            kind, i, j = links.T
            source, target = np.r_[i, j], np.r_[j, i]
            weight = np.concatenate([self.link, self.link.transpose(0, 2, 1)])  # [kind and way, source label, target label]
            way = np.r_[kind, kind + len(self.link)]
            back = np.r_[np.arange(len(i)) + len(i), np.arange(len(i))]
            message = np.zeros((len(source), len(LABELS)))
            for _ in range(ROUNDS):
                z, new = own + sums(target, message), np.empty_like(message)
                for at in range(0, len(source), LINKS_AT_ONCE):
                    some = slice(at, at + LINKS_AT_ONCE)
                    inner = (z[source[some]] - message[back[some]])[:, :, None] + weight[way[some]]
                    top = inner.max(axis=1)
                    new[some] = top + np.log(np.exp(inner - top[:, None, :]).sum(axis=1))
                new -= new.max(axis=1, keepdims=True)
                message = DAMPING * message + (1 - DAMPING) * new
            z = own + sums(target, message)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _batches(column: pa.Array) -> Iterator[list[str]]:
    """Texts, up to 256 and BATCH_CHARS characters at a time; a longer one alone."""
    some, size = [], 0
    for t in (x.as_py() or "" for x in column):
        if some and (len(some) == 256 or size + len(t) > BATCH_CHARS):
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


#: Features, labels (-1 for unknown) and links of units that are learned from together.
Part = tuple[list[list[int]], list[int], list[tuple[int, int, int]]]


def lessons(text: str, rng: np.random.Generator) -> Iterator[Part]:
    """What a document teaches: its units and some of those that the patterns find written in another form; of a long
    document by CHUNK units, without the links between these parts."""
    u = Units(text)
    known = weak_labels(u, base_spans(text))
    for kind, i, j in u.links:
        if kind != CHAIN and (known[i] > 0) != (known[j] > 0):
            known[i if known[i] <= 0 else j] = -1
    for k in range(len(known)):
        if known[k] > 0 and rng.random() < REWRITTEN and len(u.words[k]) < 200:
            u.add(rewritten(u.words[k], LABELS[known[k]], rng))
            known.append(known[k])
    part = [[] for _ in range(-(-len(known) // CHUNK))]
    for k, i, j in u.links:
        if i // CHUNK == j // CHUNK:
            part[i // CHUNK].append((k, i % CHUNK, j % CHUNK))
    for n, links in enumerate(part):
        yield u.features[n * CHUNK : (n + 1) * CHUNK], known[n * CHUNK : (n + 1) * CHUNK], links


def train(docs: DataFrame, *, text_col: str = "text") -> Field:
    """From all documents with units. A table of weights comes back, whatever the number of tasks."""
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for texts in _batches(b.column(0)):
                parts = [p for t in texts for p in lessons(t, np.random.default_rng(zlib.crc32(t.encode())))]
                yield pa.RecordBatch.from_arrays([pa.array([len(p[1]) for p in parts], pa.int64()), pa.array([json.dumps(p) for p in parts], pa.string())], names=["n", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field().learn(json.loads(p.as_py()) for b in batches for p in b.column(0))
        flat = np.r_[field.unit.ravel(), field.link.ravel()] * field.n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat), pa.array(np.full(len(flat), field.n), pa.int64())], names=["k", "w", "n"])

    with_units = docs.select(F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike(MARK.pattern))
    parts = materialise(with_units.mapInArrow(extract, "n long, part string"))
    units = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    dealt = parts.select("part").repartition(parts_for(units, UNITS_A_TASK))
    rows = dealt.mapInArrow(run, "k long, w double, n long").groupBy("k").agg((F.sum("w") / F.greatest(F.sum("n"), F.lit(1))).alias("w")).collect()
    field, flat = Field(), np.zeros(field_size())
    for r in rows:
        flat[r["k"]] = r["w"]
    field.unit, field.link = flat[: field.unit.size].reshape(field.unit.shape), flat[field.unit.size :].reshape(field.link.shape)
    return field


def field_size() -> int:
    return N_FEATURES * len(LABELS) + 3 * len(LABELS) ** 2


def added_spans(field: Field, texts: list[str], bases: list[dict[str, list[tuple[int, int]]]]) -> list[list[tuple[str, int, int]]]:
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    owner, spans, features, links, given = [], [], [], [], []
    for d, t in enumerate(texts):
        if not MARK.search(t):
            continue
        u = Units(t)
        links += [(k, i + len(spans), j + len(spans)) for k, i, j in u.links]
        owner += [d] * len(u.spans)
        spans += u.spans
        features += u.features
        given += weak_labels(u, bases[d])
    if spans:
        known = [sorted(s for kind in KINDS for s in base[kind]) for base in bases]
        reach = [np.maximum.accumulate([e for _, e in k]).tolist() if k else [] for k in known]
        p = field.marginals(features, np.array(links, int).reshape(-1, 3), np.array(given))
        best = p.argmax(axis=1)
        for n in np.flatnonzero((best > 0) & (p.max(axis=1) >= SURE)):
            (a, b), d = spans[n], owner[n]
            before = bisect_right(known[d], (b - 1, 1 << 62))  # spans that begin before its end
            if not before or reach[d][before - 1] <= a:
                out[d].append((LABELS[best[n]], a, b))
    return out


def _written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def pii_spans(docs: DataFrame, field: Field, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts of the patterns' spans, their digest, and all spans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for texts in _batches(b.column(1)):
                bases = [base_spans(t) for t in texts]
                for base, more in zip(bases, added_spans(field, texts, bases), strict=True):
                    plain = [(k, a, e) for k in KINDS for a, e in base[k]]
                    rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(_written(plain).encode()).hexdigest(), _written(plain + more)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def pii_report(docs: DataFrame) -> DataFrame:
    return pii_spans(docs, train(docs))
