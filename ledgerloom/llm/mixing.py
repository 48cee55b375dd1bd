"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled (by a hash of their id) and queue up in packets of QUANTUM words at most, as fair
queueing does with long messages. A packet's virtual finish time is its source's cumulative words, its own included,
over the source's target; a second and third pass over a source follow the first. Packets of all sources are then
ranked by finish time over ranges of virtual time, and the ranking is truncated where the running sum of words reaches
the budget, within a packet where need be. So what a source gets is what the common schedule serves by then, and it is
off its target by less than two packets.

Running sums are taken in two steps, over ranges and then within one, so a source may hold any share of the rows: its
ranges are of the shuffle key, and of the row where many rows share a key. Of the ranges of virtual time only the one
that the budget ends in is sorted, and it holds MOST_IN_RANGE words and a few packets a source at most. The table of
sources, one row each, is sorted in one task.

Nulls count as empty texts of no words; such documents take nothing. A null source is a source of its own, the last.
Rows that repeat are separate documents; their order is by size, then place in the files. An empty table gives an
empty result. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import DOC, FILE_KEY, ROW, ROW_KEY, file_backed, materialise, parts_for, row_masks, with_masks, with_row_key, words_in

WEIGHTS = (5.0, 2.0, 1.0)
REPEATS = 3
SEED = "mix-1"
#: Words of a packet.
QUANTUM = 64
#: Rows of the whole table for each range of the shuffle key; a range of more than HOT rows is split by its rows.
ROWS_PER_RANGE, HOT = 4096, 16_384
#: Words in a range of virtual time, about.
MOST_IN_RANGE = 1 << 18


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """sizes: source, source_size, one row each. Adds target: the share by weight, none above ``repeats`` times its size.

    Sources fill up in order of limit over weight; one is full when what it would get, once all before it are full,
    reaches its limit.
    """
    # bytes in UTF-8 sort as code points do
    ranked = sizes.withColumn("__k", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__k") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("__w", weight).withColumn("__limit", repeats * F.col("source_size"))
    order = Window.orderBy(F.col("__limit") / F.col("__w"), "__k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("__limit").over(before), F.lit(0))) / F.sum("__w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = ranked.withColumn("__level", level).withColumn("__full", F.col("__level") * F.col("__w") >= F.col("__limit"))
    final = F.max(F.when(~F.col("__full"), F.col("__level"))).over(Window.partitionBy())  # of the first that isn't full
    return levels.select("source", "source_size", F.when(F.col("__full"), F.col("__limit").cast("double")).otherwise(final * F.col("__w")).alias("target"))


def shuffle_key(doc_id: Column, seed: str = SEED) -> Column:
    return F.sha2(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")), 256)


def ordered(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: ROW, doc_id, source, size, source_size, target and end, the words of its source up
    to its own last."""
    rows = materialise(with_row_key(docs, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"), shuffle_key(F.col(id_col), seed).alias("key")))
    range_bits = min(32, (parts_for(rows.count(), ROWS_PER_RANGE) - 1).bit_length())
    rows = rows.withColumn("range", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - range_bits))
    here = lambda a, b, *keys: [F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")), *(F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in keys)]
    # Rows without an id, or of one id, share a key: such a range is cut by the rows' own hash.
    crowded = rows.groupBy("source", "range").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("source", "range", F.ceil(F.col("n") / ROWS_PER_RANGE).alias("cuts"))
    rows = rows.alias("r").join(crowded.alias("c"), here("r", "c", "range"), "left").select("r.*", F.when(F.col("c.cuts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*(F.col(f"r.{k}") for k in ROW)), F.col("c.cuts"))).alias("cut"))
    rows = materialise(rows)
    ranges = rows.groupBy("source", "range", "cut").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("range", "cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")
    ranges = materialise(ranges.withColumn("before", before))
    targets = materialise(source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, repeats))
    starts = ranges.alias("a").join(targets.alias("t"), here("a", "t")).select("a.source", "a.range", "a.cut", "a.before", "t.source_size", "t.target")
    joined = rows.alias("d").join(starts.alias("s"), here("d", "s", "range", "cut")).select("d.*", "s.before", "s.source_size", "s.target")
    within = Window.partitionBy("source", "range", "cut").orderBy("key", "doc_id", "size", *ROW).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.select(*ROW, "doc_id", "source", "size", "source_size", "target", (F.col("before") + F.sum("size").over(within)).alias("end"))


def packets(queue: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """One row per packet that can be served: ROW, doc_id, source, pass, packet, words and its virtual finish time.

    Packets that start before virtual time 1 fill the budget, so one that ends after all of them is never reached.
    """
    # the first packet past a source's target may be of QUANTUM words, which take this long at the least target
    least = queue.where("target > 0 and size > 0").agg(F.min("target")).first()[0] or 1.0
    each = queue.where("size > 0 and target > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    each = each.withColumn("start", F.col("end") - F.col("size") + F.col("pass") * F.col("source_size")).where(F.col("start") / F.col("target") <= 1 + QUANTUM / least)
    each = each.withColumn("packet", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {QUANTUM}"))))
    words = F.least(F.lit(QUANTUM).cast("long"), F.col("size") - QUANTUM * F.col("packet"))
    finish = (F.col("start") + QUANTUM * F.col("packet") + words) / F.col("target")
    return each.select(*ROW, "doc_id", "source", "size", "pass", "packet", words.alias("words"), finish.alias("finish")).where(F.col("finish") <= 1 + QUANTUM / least)


def served(queue: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """ROW, pass and taken: the words that the mix takes of a document in a pass over its source."""
    budget = queue.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    line = packets(queue, repeats).withColumn("range", F.floor(F.col("finish") * parts_for(budget, MOST_IN_RANGE)))
    sums = line.groupBy("range").agg(F.sum("words").alias("words"))
    # Ranges are few: MOST_IN_RANGE words of the corpus each.
    upto = sums.withColumn("upto", F.sum("words").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = upto.where(F.col("upto") >= budget).orderBy("range").select("range", F.col("upto") - F.col("words")).first()
    at, left = last or (1 << 62, 0)
    order = Window.orderBy("finish", "source", "doc_id", "pass", "packet", *ROW).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    final = line.where(F.col("range") == at).withColumn("upto", left + F.sum("words").over(order))
    final = final.select(*ROW, "pass", F.greatest(F.lit(0).cast("long"), F.col("words") - F.greatest(F.lit(0).cast("long"), F.col("upto") - budget)).alias("taken"))
    whole = line.where(F.col("range") < at).select(*ROW, "pass", F.col("words").alias("taken"))
    return whole.unionByName(final).groupBy(*ROW, "pass").agg(F.sum("taken").alias("taken"))


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: the columns of ``docs``, each document as many times as the schedule takes the better half of it.

    Documents stay whole here, so a source ends within half a document of what it was served.
    """
    docs = file_backed(docs)
    queue = materialise(ordered(docs, **options))
    passes = served(queue).join(queue.select(*ROW, "size"), ROW).where("2 * taken >= size").groupBy(*ROW).agg(F.count("*").alias("copies"))
    repeats = int(options.get("repeats", REPEATS))
    marked = with_masks(docs, row_masks(passes, *(F.col("copies") > k for k in range(repeats))))
    times = F.array_compact(F.array(*(F.when(F.col(f"f{k}"), k) for k in range(repeats))))
    return marked.withColumn("copy", F.explode(times)).select(f"{DOC}.*")


def mix_report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, its size, its source's size and target, and the words of it that the mix takes."""
    queue = materialise(ordered(docs))
    taken = served(queue).groupBy(*ROW).agg(F.sum("taken").alias("taken"))
    return queue.join(taken, ROW, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    sha256(doc_id::VARCHAR || ':mix-1') AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::BIGINT]::DOUBLE AS w FROM d GROUP BY source),
lv AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY 3 * source_size / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
t AS (
  SELECT source, source_size, CASE WHEN level * w >= 3 * source_size THEN (3 * source_size)::DOUBLE
    ELSE w * max(CASE WHEN level * w < 3 * source_size THEN level END) OVER () END AS target FROM lv),
q AS (
  SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size) AS fin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (
  SELECT *, unnest(range(3)) AS pass FROM q WHERE size > 0 AND target > 0),
b AS (
  SELECT *, fin - size + pass * source_size AS s0, unnest(range((size - 1) // 64 + 1)) AS packet FROM p),
f AS (
  SELECT *, least(64, size - 64 * packet) AS words, (s0 + 64 * packet + least(64, size - 64 * packet))::DOUBLE / target AS finish FROM b),
r AS (
  SELECT *, sum(words) OVER (ORDER BY finish, source NULLS FIRST, doc_id, pass, packet ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM f),
g AS (
  SELECT doc_id, sum(greatest(0, words - greatest(0, upto - (SELECT sum(size) FROM d)))) AS taken FROM r GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(g.taken, 0)::BIGINT AS taken FROM q LEFT JOIN g USING (doc_id)
"""
