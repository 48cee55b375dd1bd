"""Secret scans: known forms, and a battery of randomness tests for the rest.

Known forms (assign, access, hex) are found by patterns. A pattern's matches and what lies between them, from
``regexp_extract_all`` and ``split``, give every match's place; a running sum over them turns lengths to offsets.

Any other run of token letters that has letters and digits is a candidate, however long. Its encoding is the smallest
alphabet that holds it (hex, base32, base36, base62, base64). Three statistics are taken of it: the chi-squared of its
letter counts against the alphabet's uniform ones, the runs of digits, upper and lower case, and the correlation of
neighbours. They are used twice:

- A random string has to pass all three: one that a test rejects at ODD is no secret.
- A secret has to be unlike ordinary text. Names and paths use letters as languages do and change between classes
  seldom; from that the chi-squared and the runs to expect of an ordinary string of the same encoding and length follow,
  and how far the candidate is from both is its p-value, ``ordinary_p``. The Benjamini-Hochberg rule, on a histogram of
  fixed size of these in each band of lengths over the whole corpus, keeps the expected share of false secrets under
  RATE. Short strings have little power, so they need a stronger contrast; the bands keep the many short ones from
  setting the rule for long ones.

Only DataFrame functions are used. Rows move between tasks for texts that have a match, as matches, never as text.
Null counts as empty: no spans. Rows that repeat are scanned alike. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import ROW, file_backed, materialise, union_all, with_row_key

#: Kind -> (pattern, group whose length counts, shortest). Hex and access keys are runs: a shorter run never holds a
#: match, so their shortest length is in the pattern.
BASE = {
    "assign": (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
ADDED = "random"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?![A-Za-z0-9+/_-])"
#: Encoding -> (pattern, alphabet in order, shortest length), smallest alphabet first. A string of base64 has one pair of
#: +/ and -_, which count as the same two letters: with both, long strings would lack two letters of 66.
ENCODINGS = {
    "hex": (r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 24),
    "base32": (r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 24),
    "base36": (r"^([0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz", 24),
    "base62": (r"^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 20),
    "base64": (r"^[0-9A-Za-z+/_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 24),
}
#: Bands begin at these lengths; share of false secrets; a random string's tests fail at this; p-value bins, a
#: twentieth of a power of ten each.
LENGTH_BANDS, RATE, ODD, BINS, BINS_A_POWER = (20, 32, 48, 96), 0.01, 0.001, 400, 20
#: Ordinary strings: shares of lower-case letters, capitals and digits, the chance that two letters of a language's text
#: are the same, that two digits are, and that a class ends at a character.
ORDINARY_SHARES, SAME_LETTER, SAME_DIGIT, ORDINARY_BORDER = (0.75, 0.05, 0.2), 0.067, 0.1, 0.2


def _matches(rows: DataFrame, kind: str, pattern: str, group: int, shortest: int) -> DataFrame:
    """ROW, kind, start, end, found: the kept matches of a pattern in ``text``, ends exclusive, in code points."""
    hit = rows.where(F.col("text").rlike(pattern))
    p = F.lit(pattern)
    lengths = hit.select(
        *ROW,
        F.posexplode(
            F.arrays_zip(
                F.transform(F.split("text", pattern, -1), F.length).alias("gap"),
                F.regexp_extract_all("text", p, F.lit(0)).alias("found"),
                F.transform(F.regexp_extract_all("text", p, F.lit(group)), F.length).alias("counts"),
            )
        ).alias("at", "m"),
    ).where("m.found is not null")  # what follows the last match
    lengths = lengths.select(*ROW, "at", "m.gap", "m.found", "m.counts")
    so_far = F.sum(F.col("gap") + F.length("found")).over(Window.partitionBy(*ROW).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = lengths.withColumn("end", so_far).where(F.col("counts") >= shortest)
    return ends.select(*ROW, F.lit(kind).alias("kind"), (F.col("end") - F.length("found")).alias("start"), "end", "found")


def _tail(z: Column) -> Column:
    """Two-sided p-value of a standard normal, to within a tenth."""
    z = F.abs(z)
    return F.exp(-0.717 * z - 0.416 * z * z)


def ordinary_excess(letters: str) -> float:
    """How much more often two places of an ordinary string agree than chance has it, times the alphabet's size: an
    ordinary string of n letters has a chi-squared above its degrees of freedom by n times this."""
    lower, upper, digit = ORDINARY_SHARES
    if not (any(c.islower() for c in letters) and any(c.isupper() for c in letters)):  # one case holds both
        lower, upper = lower + upper, 0.0
    # of fewer letters, or digits, two agree more often
    n_letters, n_digits = len({c.lower() for c in letters if c.isalpha()}), sum(c.isdigit() for c in letters)
    return len(letters) * ((lower**2 + upper**2) * SAME_LETTER * 26 / n_letters + digit**2 * SAME_DIGIT * 10 / n_digits) - 1


def battery(df: DataFrame, col: str = "found") -> DataFrame:
    """Adds encoding, chi_p, runs_p, serial_p, random_p (the least of the three, times three) and ordinary_p to rows with a
    candidate string; rows that no encoding fits are left out. Every step is linear in the string."""
    s = F.col(col)
    encoding = F.coalesce(*(F.when(s.rlike(rule) & (F.length(s) >= n), F.lit(name)) for name, (rule, _, n) in ENCODINGS.items()))
    one_case = F.col("encoding").isin("hex", "base36")
    of = lambda value: F.element_at(F.create_map(*(x for name, (_, letters, _) in ENCODINGS.items() for x in (F.lit(name), F.lit(value(letters))))), F.col("encoding"))
    df = df.withColumn("encoding", encoding).where(F.col("encoding").isNotNull())
    df = df.withColumn("__y", F.when(one_case, F.lower(s)).otherwise(F.translate(s, "-_", "+/"))).withColumn("__x", F.split("__y", "")).withColumn("__a", of(str))
    df = df.withColumn("__v", F.transform("__x", lambda c: F.position(c, F.col("__a")).cast("double")))
    n, k = F.size("__v").cast("double"), F.length("__a").cast("double")
    counts = F.transform(F.array_distinct("__x"), lambda c: (F.length("__y") - F.length(F.replace("__y", c, F.lit("")))).cast("double"))
    df = df.withColumn("__sq", F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c))
    chi, free = k / n * F.col("__sq") - n, k - 1
    chi_z = (chi - free) / F.sqrt(2 * free * (1 - 1 / n))
    excess = n * of(ordinary_excess)
    unlike_chi = (free + excess - chi) / F.sqrt(2 * (free + 2 * excess))
    # Runs of letter classes, signs left out: a border between neighbours has the chance that two draws differ in class.
    classed = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("__y", "[+/]", ""), "[0-9]", "0"), "[A-Z]", "1"), "[a-z]", "2")
    df = df.withColumn("__c", classed)
    steps = F.greatest(F.lit(1.0), F.length("__c").cast("double") - 1)
    borders = F.length(F.regexp_replace("__c", r"(.)\1*+", "x")).cast("double") - 1
    share = [F.length(F.regexp_replace("__a", f"[^{r}]", "")) / F.length(F.regexp_replace("__a", "[+/]", "")) for r in ("0-9", "A-Z", "a-z")]
    differ = 1 - sum((x * x for x in share), F.lit(0.0))
    runs_z = (borders - steps * differ) / F.sqrt(steps * differ * (1 - differ) * 1.5)
    unlike_runs = (borders - steps * ORDINARY_BORDER) / F.sqrt(steps * ORDINARY_BORDER * (1 - ORDINARY_BORDER))
    df = df.withColumn("__m", F.aggregate("__v", F.lit(0.0), lambda a, v: a + v) / n)
    df = df.withColumn("__var", F.aggregate("__v", F.lit(0.0), lambda a, v: a + (v - F.col("__m")) * (v - F.col("__m"))))
    pairs = F.struct(F.lit(0.0).alias("sum"), F.col("__m").alias("last"))
    cov = F.aggregate("__v", pairs, lambda a, v: F.struct((a["sum"] + (v - F.col("__m")) * (a["last"] - F.col("__m"))).alias("sum"), v.alias("last")))["sum"]
    serial_z = F.coalesce(F.try_divide(cov, F.col("__var")), F.lit(1.0)) * F.sqrt(n) + 1 / F.sqrt(n)
    df = df.withColumns({"chi_p": _tail(chi_z), "runs_p": _tail(runs_z), "serial_p": _tail(serial_z), "__z": (unlike_chi + unlike_runs) / F.sqrt(F.lit(2.0))})
    # one-sided: half of the two-sided p-value above zero
    df = df.withColumn("ordinary_p", F.when(F.col("__z") > 0, _tail(F.col("__z")) / 2).otherwise(1.0))
    df = df.withColumn("random_p", F.least(F.lit(1.0), 3 * F.least("chi_p", "runs_p", "serial_p")))
    return df.drop("__y", "__x", "__a", "__v", "__sq", "__c", "__m", "__var", "__z")


def random_ones(candidates: DataFrame) -> DataFrame:
    """Candidates that pass as random and that the rule tells from ordinary strings, by bands of length over all of them."""
    band = F.coalesce(*(F.when(F.length("found") >= n, F.lit(n)) for n in reversed(LENGTH_BANDS)), F.lit(0))
    bin_ = F.least(F.lit(BINS), F.floor(-F.log10(F.greatest("ordinary_p", F.lit(1e-300))) * BINS_A_POWER)).cast("int")
    tested = materialise(battery(candidates).withColumn("band", band).withColumn("bin", bin_))
    # Rows of this table: bands times bins, whatever the corpus.
    counts = tested.groupBy("band", "bin").agg(F.count("*").alias("n"))
    smaller = Window.partitionBy("band").orderBy(F.desc("bin"))
    ruled = counts.withColumn("upto", F.sum("n").over(smaller)).withColumn("all", F.sum("n").over(Window.partitionBy("band")))
    ruled = ruled.where(F.pow(F.lit(10.0), -F.col("bin") / F.lit(float(BINS_A_POWER))) <= RATE * F.col("upto") / F.col("all"))
    cuts = F.broadcast(ruled.groupBy("band").agg(F.min("bin").alias("cut")))
    return tested.join(cuts, "band").where((F.col("bin") >= F.col("cut")) & (F.col("random_p") >= ODD))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """ROW, kind, start, end: all spans of all rows."""
    rows = with_row_key(docs, F.col(text_col).cast("string").alias("text"))
    base = materialise(union_all([_matches(rows, kind, *rule) for kind, rule in BASE.items()]).drop("found"))
    letters = F.length(F.regexp_replace("found", "[^A-Za-z]", "")) >= 2
    digits = F.length(F.regexp_replace("found", "[^0-9]", "")) >= 2
    candidates = _matches(rows, ADDED, CANDIDATE, 0, 20).where(letters & digits)
    found = random_ones(candidates).alias("c")
    known = base.alias("b")
    apart = found.join(known, [F.col(f"c.{k}") == F.col(f"b.{k}") for k in ROW] + [F.col("c.start") < F.col("b.end"), F.col("b.start") < F.col("c.end")], "left_anti")
    return base.unionByName(apart.select(*ROW, "kind", "start", "end"))


def secret_report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts and spans."""
    docs = file_backed(docs)
    order = F.array(*(F.lit(k) for k in (*BASE, ADDED)))
    span = F.struct("start", F.array_position(order, F.col("kind")).alias("rank"), "end", "kind")
    by_row = secret_spans(docs).groupBy(*ROW).agg(F.sort_array(F.collect_list(span)).alias("spans"))
    named = with_row_key(docs, F.col("doc_id").cast("long").alias("doc_id"))
    out = named.join(by_row, ROW, "left")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return out.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,rank:bigint,end:bigint,kind:string>>"))).select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(_joined(of(*BASE)), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
