"""Mixing sources to target weights by a low-discrepancy schedule. Native columns only.

1. Sources, in code point order with null last, take their weights in turn and share ``SHARE`` times all words. A target
   stops at ``REPEATS`` times its source's size; what is above is shared again by weight until nothing is (``targets``).
2. Each source's words are a stream: its documents in hashed order, and again in another order for each repetition. The
   stream is cut into blocks of ``BLOCK`` words (``blocks``); the last one a source uses ends at its target.
3. The mix has as many slots as all targets have blocks. The point of slot n is n's bits reversed behind the point (van
   der Corput); it falls into the interval of one source among the cumulative block counts (``schedule``). Slots are
   ranked per source and the k-th slot of a source takes its k-th block. Slots that a source has above its count stay
   empty; the few that another lacks come behind the last slot.

So each source's taken words are its target without the fraction, at every prefix of the schedule sources stand close to
their weights, and no document is taken more than ``REPEATS`` times. The order depends on doc_id, size and text alone.

No source is gathered: running sums are taken inside buckets of hashes or slots, with offsets from sums per bucket, and
slots and blocks meet on (source, rank), which is unique per slot. Points find their source by an equal join on the
block number. Null and empty texts have no words and no block; a null doc_id is ordered as an empty one; repeated rows
are taken each for itself (which of two equal rows comes first changes no row of the result as a whole). Columns of
``docs`` other than doc_id, text and source are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawloom.llm.common import shuffle_width, stored

WEIGHTS = (3, 1, 2)
SHARE, REPEATS = 1.5, 2
BLOCK = 512
WORD = r"[^\x20\x09-\x0D]+"
_BITS = 48
_CHUNK = 4096


def running(rows: DataFrame, by: list[str], bucket: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows before, within ``by``. ``bucket`` never falls along ``order``."""
    # A null key would not meet itself in the join; the keys here are never null.
    rows = rows.withColumns({"_bucket": bucket, "_value": value})
    sums = rows.groupBy(*by, "_bucket").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("_value").over(inside), F.lit(0))
    return rows.join(sums, [*by, "_bucket"]).withColumn(name, F.col("_offset") + own).drop("_bucket", "_value", "_offset")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the row's number from 0 in ``order``: ranges of rows are sorted apart, with offsets from counts per range."""
    ranges = stored(rows.repartitionByRange(shuffle_width(rows.sparkSession), *order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranges.join(counts, "_range").withColumn(name, F.col("_offset") + own).drop("_range", "_offset")


def sized(docs: DataFrame) -> DataFrame:
    """One slim row per document: _row, doc_id, source, size and a hash of the text."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("text").alias("_hash"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size) with the source's number ``s``, its weight and its target in words."""
    ranked = numbered(sources, [F.col("source").isNull(), F.col("source")], "s")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights) + 1).cast("int"))
    ranked = stored(ranked.withColumns({"weight": weight, "most": repeats * F.col("source_size")}))
    words, heavy, full = ranked.agg(F.sum("source_size"), F.sum("weight"), F.sum("most")).first()
    if not words:
        return ranked.withColumn("target", F.lit(0.0))
    total = min(share * words, float(full))
    level, capped = total / heavy, 0
    while True:
        above = F.col("weight") * F.lit(level) > F.col("most")
        n, most, weight = ranked.filter(above).agg(F.count(F.lit(1)), F.coalesce(F.sum("most"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if n == capped or weight == heavy:
            break
        level, capped = (total - most) / (heavy - weight), n
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("most").cast("double")))


def schedule(sources: DataFrame) -> DataFrame:
    """The slots of the mix as (s, rank, slot). ``sources`` has s and n_blocks."""
    spark = sources.sparkSession
    total = sources.agg(F.coalesce(F.sum("n_blocks"), F.lit(0))).first()[0]
    spans = running(sources.filter("n_blocks > 0").select("s", "n_blocks"), [], F.floor(F.col("s") / _CHUNK), ["s"], F.col("n_blocks"), "first")
    spans = stored(spans)
    owner = spans.select("s", F.explode(F.sequence("first", F.col("first") + F.col("n_blocks") - 1)).alias("v"))
    point = F.conv(F.reverse(F.lpad(F.bin("id"), _BITS, "0")), 2, 10).cast("double") / F.lit(float(2**_BITS))
    slots = spark.range(total).select(F.col("id").alias("slot"), F.floor(point * F.lit(float(total))).alias("v")).join(owner, "v")
    ranked = stored(running(slots.select("s", "slot"), ["s"], F.floor(F.col("slot") / _CHUNK), ["slot"], F.lit(1), "rank"))
    counts = ranked.groupBy("s").agg(F.count(F.lit(1)).alias("got"))
    short = spans.join(counts, "s", "left").select("s", "n_blocks", F.coalesce("got", F.lit(0)).alias("got")).filter("got < n_blocks")
    short = running(short, [], F.floor(F.col("s") / _CHUNK), ["s"], F.col("n_blocks") - F.col("got"), "behind")
    late = short.select("s", "got", "behind", F.explode(F.sequence("got", F.col("n_blocks") - 1)).alias("rank"))
    late = late.select("s", F.col("rank").cast("long"), (F.lit(total) + F.col("behind") + F.col("rank") - F.col("got")).alias("slot"))
    kept = ranked.join(spans.select("s", "n_blocks"), "s").filter("rank < n_blocks").select("s", "rank", "slot")
    return kept.unionByName(late)


def blocks(rows: DataFrame, repeats: int = REPEATS, block: int = BLOCK) -> DataFrame:
    """Parts of documents in blocks as (s, rank, _row, words). ``rows`` has _row, doc_id, s, size, source_size and quota."""
    each = rows.filter("size > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    each = each.filter(F.col("turn") * F.col("source_size") < F.col("quota"))
    each = each.withColumn("_key", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("turn").cast("string"))))
    placed = running(each, ["s", "turn"], F.substring("_key", 1, 3), ["_key", "size", "_hash", "_row"], F.col("size"), "_before")
    start = F.col("turn") * F.col("source_size") + F.col("_before")
    placed = placed.withColumn("_start", start).withColumn("_end", F.least(F.col("_start") + F.col("size"), "quota")).filter("_start < _end")
    cut = placed.withColumn("rank", F.explode(F.sequence(F.floor(F.col("_start") / block), F.floor((F.col("_end") - 1) / block))))
    words = F.least(F.col("_end"), (F.col("rank") + 1) * block) - F.greatest(F.col("_start"), F.col("rank") * block)
    return cut.select("s", "rank", "_row", words.alias("words"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, n_slots and first_slot (null if none)."""
    rows = stored(sized(docs))
    found = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats)
    quota = F.floor("target")
    sources = stored(found.select("s", "source", "source_size", "target", quota.alias("quota"), F.ceil(quota / block).alias("n_blocks")))
    rows = stored(rows.join(sources.drop("n_blocks").withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("source", "_source"))
    slots = schedule(sources)
    taken = blocks(rows, repeats, block).join(slots, ["s", "rank"]).groupBy("_row").agg(F.sum("words").alias("taken"), F.count(F.lit(1)).alias("n_slots"), F.min("slot").alias("first_slot"))
    out = rows.join(taken, "_row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("n_slots", F.lit(0)).alias("n_slots"), "first_slot")


def mix_sequence(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, block: int = BLOCK) -> DataFrame:
    """The mix itself: (slot, source, doc_id, words), the parts of documents in each slot."""
    rows = stored(sized(docs))
    found = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats)
    quota = F.floor("target")
    sources = stored(found.select("s", "source", "source_size", quota.alias("quota"), F.ceil(quota / block).alias("n_blocks")))
    rows = stored(rows.join(sources.drop("n_blocks").withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source"))
    parts = blocks(rows, repeats, block).join(schedule(sources), ["s", "rank"])
    return parts.join(rows.select("_row", "source", "doc_id"), "_row").select("slot", "source", "doc_id", "words")


#: The same mix for DuckDB over the table ``documents``.
MIX_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), src AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS s FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)
), w AS MATERIALIZED (
  SELECT *, {list(WEIGHTS)}[(s % {len(WEIGHTS)} + 1)::INT] AS weight, {REPEATS} * source_size AS most FROM src
), lists AS (
  SELECT least({SHARE}::DOUBLE * sum(source_size), sum(most)::DOUBLE)::DOUBLE AS total, sum(weight)::DOUBLE AS heavy, list({{'w': weight, 'm': most}}) AS l FROM w
), levels AS (
  SELECT 0 AS k, total / heavy AS level, total, heavy, l, -1 AS capped, len(list_filter(l, lambda x: x.w * (total / heavy) > x.m)) AS now FROM lists
  UNION ALL
  SELECT k + 1, level, total, heavy, l, now, len(list_filter(l, lambda x: x.w * level > x.m)) FROM (
    SELECT k, total, heavy, l, now,
      (total - coalesce(list_sum(list_transform(list_filter(l, lambda x: x.w * level > x.m), lambda x: x.m)), 0)::DOUBLE)
      / (heavy - coalesce(list_sum(list_transform(list_filter(l, lambda x: x.w * level > x.m), lambda x: x.w)), 0)::DOUBLE) AS level
    FROM levels WHERE now <> capped)
), t AS MATERIALIZED (
  SELECT s, source, source_size, least(weight * level, most::DOUBLE) AS target, floor(least(weight * level, most::DOUBLE))::BIGINT AS quota,
    ceil(floor(least(weight * level, most::DOUBLE)) / {BLOCK})::BIGINT AS n_blocks
  FROM w, (SELECT level FROM levels ORDER BY k DESC LIMIT 1)
), spans AS (
  SELECT s, n_blocks, sum(n_blocks) OVER (ORDER BY s)::BIGINT - n_blocks AS first FROM t WHERE n_blocks > 0
), total AS (SELECT sum(n_blocks)::BIGINT AS q FROM t
), owner AS (SELECT s, unnest(range(first, first + n_blocks)) AS v FROM spans
), slots AS (
  SELECT slot, s, row_number() OVER (PARTITION BY s ORDER BY slot) - 1 AS rank FROM (
    SELECT slot, floor(reverse(lpad(bin(slot), {_BITS}, '0'))::BIT::BIGINT::DOUBLE / {2**_BITS}::DOUBLE * q::DOUBLE)::BIGINT AS v
    FROM (SELECT unnest(range(q)) AS slot, q FROM total)) JOIN owner USING (v)
), short AS (
  SELECT s, got, n_blocks, sum(n_blocks - got) OVER (ORDER BY s)::BIGINT - (n_blocks - got) AS behind FROM (
    SELECT s, n_blocks, coalesce(got, 0) AS got FROM spans LEFT JOIN (SELECT s, count(*) AS got FROM slots GROUP BY s) USING (s)) WHERE got < n_blocks
), used AS (
  SELECT s, rank, slot FROM slots JOIN spans USING (s) WHERE rank < n_blocks
  UNION ALL
  SELECT s, rank, q + behind + rank - got FROM (SELECT s, got, behind, unnest(range(got, n_blocks)) AS rank FROM short), total
), placed AS (
  SELECT r, s, quota, turn * source_size + sum(size) OVER (PARTITION BY s, turn ORDER BY md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), turn)), size, r)::BIGINT - size AS a, size
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, (SELECT unnest(range({REPEATS})) AS turn) WHERE size > 0
), cut AS (
  SELECT *, unnest(range(a // {BLOCK}, (b - 1) // {BLOCK} + 1)) AS rank FROM (SELECT r, s, a, least(a + size, quota) AS b FROM placed WHERE a < quota)
), taken AS (
  SELECT r, sum(least(b, (rank + 1) * {BLOCK}) - greatest(a, rank * {BLOCK}))::BIGINT AS taken, count(*) AS n_slots, min(slot) AS first_slot
  FROM cut JOIN used USING (s, rank) GROUP BY r
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, coalesce(n_slots, 0) AS n_slots, first_slot
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN taken USING (r)
"""
