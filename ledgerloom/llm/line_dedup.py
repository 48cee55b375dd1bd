"""Line dedup by a log-template tree: recurring templates are dropped.

Fields that vary (tokens with a digit) are generalised first. A fixed-depth tree then sorts lines by their token count
and their first LEAD tokens. In a leaf that enough documents reach, a line is an instance of one template as it stands,
and, if it has WILD_TOKENS or more, of one for each choice of WILD of its SEGMENTS parts that are left open: variable
fields without digits, of which any that is no longer than a part lies in two parts at most. A template recurs when
enough documents have an instance of it, and then all its instances go. How many are enough depends on the length:
LONG_DOCS for lines of LONG_TOKENS tokens or more, which nobody writes twice, SHORT_DOCS for those under SHORT_TOKENS,
which many texts share by chance, MIN_DOCS else.

Documents count by their text, so that copies of one document are one: they do not make its lines boilerplate.

What moves between tasks is hashes of leaves, templates and texts; counts combine before they move. Texts are read
twice, and moved once, to meet the numbers of their dropped lines.

A null text has no lines and stays null. Lines without tokens stay. An empty table gives an empty result. Other columns
pass through; should some have the names of the two added ones, n_lines and n_dropped, the added ones take their place.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import DOC, ROW, WORD, file_backed, materialise, with_row_key

MIN_DOCS, LEAD = 3, 3
LONG_TOKENS, LONG_DOCS = 51, 2
SHORT_TOKENS, SHORT_DOCS = 5, 10
SEGMENTS, WILD, WILD_TOKENS = 6, 2, 8
VARIABLE = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"
#: Choices of the parts that stay.
FIXED = list(combinations(range(SEGMENTS), SEGMENTS - WILD))


def template_keys(lines: DataFrame) -> DataFrame:
    """lines: ROW, text_hash, line_no, line. Gives n, leaf, whole and parts of every line with tokens."""
    masked = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", VARIABLE, "<*>")).otherwise(F.col("line"))
    trimmed = F.regexp_replace(masked, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    tokens = lines.select(*ROW, "text_hash", "line_no", F.split(trimmed, r"[\x20\x09-\x0D]+", -1).alias("t")).where(F.col("t")[0] != "").withColumn("n", F.size("t"))

    def part(k: int) -> Column:
        begin, end = F.expr(f"n * {k} div {SEGMENTS}"), F.expr(f"n * {k + 1} div {SEGMENTS}")
        return F.xxhash64(F.slice("t", (begin + 1).cast("int"), (end - begin).cast("int")))

    parts = F.when(F.col("n") >= WILD_TOKENS, F.array(*map(part, range(SEGMENTS))))
    return tokens.select(*ROW, "text_hash", "line_no", "n", F.xxhash64("n", F.slice("t", 1, LEAD)).alias("leaf"), F.xxhash64("n", "t").alias("whole"), parts.alias("parts"))


def enough() -> Column:
    return F.when(F.col("n") >= LONG_TOKENS, LONG_DOCS).when(F.col("n") < SHORT_TOKENS, SHORT_DOCS).otherwise(MIN_DOCS)


def _recurring(df: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` that enough texts have."""
    return df.select("n", key, "text_hash").distinct().groupBy("n", key).agg(F.count("*").alias("texts")).where(F.col("texts") >= enough()).select(key)


def template_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """ROW and line_no (from 0) of every line of a recurring template."""
    text = F.col(text_col).cast("string")
    rows = with_row_key(docs, text.alias("text")).select(*ROW, F.xxhash64("text", F.length("text")).alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    keys = materialise(template_keys(rows))
    live = materialise(keys.join(_recurring(keys, "leaf"), "leaf", "left_semi"))
    # A template holds its line's token count and which parts are open.
    wild = F.array(*(F.xxhash64("n", F.lit(k), *(F.col("parts")[p] for p in fixed)) for k, fixed in enumerate(FIXED)))
    kinds = F.when(F.col("parts").isNull(), F.array("whole")).otherwise(F.concat(F.array("whole"), wild))
    each = live.select(*ROW, "text_hash", "line_no", "n", F.explode(kinds).alias("template"))
    return each.join(_recurring(each, "template"), "template", "left_semi").select(*ROW, "line_no").distinct()


def drop_template_lines(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with its texts cleaned, and n_lines and n_dropped."""
    docs = file_backed(docs)
    found = template_lines(docs, text_col).groupBy(*ROW).agg(F.sort_array(F.collect_list("line_no")).alias("gone"))
    joined = with_row_key(docs).join(found, ROW, "left")
    text = F.col(DOC)[text_col]
    lines = F.split(text.cast("string"), "\n", -1)
    # What stays lies between the dropped lines: a slice before each and one after the last.
    begins = F.concat(F.array(F.lit(1)), F.transform("gone", lambda k: k + 2))
    ends = F.concat(F.transform("gone", lambda k: k + 1), F.array(F.size(lines) + 1))
    kept = F.flatten(F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e")), lambda x: F.slice(lines, x["b"], x["e"] - x["b"])))
    cleaned = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *((cleaned if c == text_col else F.col(DOC)[c]).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")),
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


ENOUGH = f"CASE WHEN n >= {LONG_TOKENS} THEN {LONG_DOCS} WHEN n < {SHORT_TOKENS} THEN {SHORT_DOCS} ELSE {MIN_DOCS} END"
ORACLE = rf"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
k AS (
  SELECT doc_id, text, line_no, regexp_extract_all(regexp_replace(line, '{VARIABLE}', '<*>', 'g'), '{WORD}') AS t FROM l),
m AS (
  SELECT *, len(t) AS n, t[1:{LEAD}]::VARCHAR AS lead,
    list_transform(range({SEGMENTS}), lambda s: t[(len(t) * s) // {SEGMENTS} + 1 : (len(t) * (s + 1)) // {SEGMENTS}]::VARCHAR) AS parts
  FROM k WHERE len(t) > 0),
leaf AS (SELECT n, lead FROM m GROUP BY ALL HAVING count(DISTINCT text) >= {ENOUGH}),
live AS (SELECT m.* FROM m JOIN leaf USING (n, lead)),
e AS (
  SELECT doc_id, text, line_no, n, 'whole' AS fixed, t::VARCHAR AS template FROM live
  UNION ALL
  SELECT doc_id, text, line_no, n, c.fixed::VARCHAR, list_transform(c.fixed, lambda p: parts[p + 1])::VARCHAR
  FROM live, (SELECT unnest({[list(f) for f in FIXED]}) AS fixed) c WHERE n >= {WILD_TOKENS}),
r AS (SELECT n, fixed, template FROM e GROUP BY ALL HAVING count(DISTINCT text) >= {ENOUGH}),
gone AS (SELECT DISTINCT doc_id, line_no FROM e JOIN r USING (n, fixed, template)),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.line_no) AS n_dropped,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (WHERE g.line_no IS NULL), '') AS clean
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line_no = g.line_no GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN clean END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped
FROM documents d LEFT JOIN kept USING (doc_id)
"""
