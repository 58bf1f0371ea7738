"""Benchmark decontamination by winnowing. Native columns only.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. A window is ``WINDOW`` words in a row of a
benchmark item (a shorter item that has words is one window). Every k-gram of words is hashed; the fingerprint of a
window is the least hash inside it. A document and an item that share a window share its fingerprint, so every span of
``WINDOW`` words or more is found. Fingerprints of documents meet those of items; for documents with a hit, each
place whose window has chosen a shared fingerprint is extended to the whole window and compared word by word.
Items shorter than a window are looked up by the hash of all their words, for the lengths that occur.

Documents are keyed by two hashes of their text, so copies are extended once. A list of hits is sent to all tasks only
if a count shows it to be small, and shuffled else.

Null and empty texts have no words and no hits; repeated rows each get a row; items without words or id are ignored, a
repeated item counts once; empty tables give no rows or no hits; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawloom.llm.common import fresh, lower_ascii, small_side, stored

WINDOW = 13
GRAM = 6
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once for all its uses in ``body`` (a merged projection would repeat it)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _BREAK), "")


def windows(items: Column, size: int, body) -> Column:
    """``body`` of every 1-based start of ``size`` consecutive elements; an empty array if there are fewer."""
    count = F.size(items) - size + 1
    return F.transform(F.when(count >= 1, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")), body)


def least_of(values: Column, width: int) -> Column:
    """Minimum of every ``width`` consecutive elements: minima of doubled width, the last step overlapping."""
    span = 1
    while span < width:
        step = min(span, width - span)
        values = let(values, lambda v, step=step: windows(v, step + 1, lambda i: F.least(F.element_at(v, i), F.element_at(v, i + step))))
        span += step
    return values


def marks(hashes: Column, length: int) -> Column:
    """Fingerprint of each window of ``length`` words, from the hashes of the words."""
    if length < WINDOW:
        return windows(hashes, length, lambda i: F.xxhash64(*(F.element_at(hashes, i + k) for k in range(length)), F.lit(length)))
    grams = windows(hashes, GRAM, lambda i: F.xxhash64(*(F.element_at(hashes, i + k) for k in range(GRAM))))
    return least_of(grams, length - GRAM + 1)


def short_mark(hashes: Column, size: Column) -> Column:
    """The fingerprint of an item of ``size`` words, fewer than a window."""
    return F.coalesce(*(F.when(size == n, F.element_at(marks(hashes, n), 1)) for n in range(1, WINDOW)))


def word_hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def item_windows(items: DataFrame) -> DataFrame:
    """item_id, length, fingerprint and text of every window of the benchmark."""
    base = items.filter("item_id is not null").select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    base = stored(base.select(F.col("item_id").cast("string").alias("item_id"), "w", F.least(F.size("w"), F.lit(WINDOW)).alias("length")))
    size = F.col("length")
    starts = base.select("item_id", "length", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))).alias("part"))
    hashed = let(word_hashes(F.col("part")), lambda h: F.when(size == WINDOW, F.element_at(marks(h, WINDOW), 1)).otherwise(short_mark(h, size)))
    return starts.select("item_id", "length", hashed.alias("mark"), F.array_join("part", " ").alias("window"))


def text_keys(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def compared(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text keys, n_words, n_hit and items (null: none) of every document."""
    known = stored(item_windows(items))
    lengths = sorted({WINDOW} | {r.length for r in known.select("length").distinct().collect()})  # at most WINDOW values
    key = text_keys(F.col("text"))
    choice = let(words(F.col("text")), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        let(word_hashes(w), lambda h: F.array_distinct(F.flatten(F.array(*(marks(h, n) for n in lengths))))).alias("marks"),
    ))
    prints = stored(docs.select("doc_id", *key, choice.alias("c")).select("doc_id", "k1", "k2", "c.n_words", "c.marks"))
    marked = stored(known.select("mark").distinct())
    hits = stored(prints.select("k1", "k2", F.explode("marks").alias("mark")).join(small_side(marked), "mark", "left_semi").select("k1", "k2").distinct())
    found = stored(extended(docs.select(*key, "text"), hits, marked, known, lengths))
    rows = prints.select("doc_id", "k1", "k2", "n_words").join(found, ["k1", "k2"], "left")
    return rows.withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (sorted ids as strings)."""
    none = F.array().cast("array<string>")
    return compared(docs, items).select("doc_id", "n_words", "n_hit", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"))


def clean_rows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    one, two = (fresh(docs, c) for c in ("_k1", "_k2"))
    bad = stored(compared(docs.select("doc_id", "text"), items).filter(contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("k1").alias(one), F.col("k2").alias(two)).distinct())
    k1, k2 = text_keys(F.col("text"))
    return docs.withColumns({one: k1, two: k2}).join(small_side(bad), [one, two], "left_anti").select(docs.columns)


def extended(docs: DataFrame, hits: DataFrame, marked: DataFrame, known: DataFrame, lengths: list[int]) -> DataFrame:
    """k1, k2, n_hit and items of each hit text, by comparing whole windows."""
    own = docs.join(small_side(hits), ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("text").alias("text"))
    own = stored(own.select("k1", "k2", words(F.col("text")).alias("w")))
    places = let(word_hashes(F.col("w")), lambda h: F.flatten(F.array(*(
        F.transform(marks(h, n), lambda m, i: F.struct(m.alias("mark"), (i + 1).alias("at"), F.lit(n).alias("length"))) for n in lengths
    ))))
    chosen = own.select("k1", "k2", F.explode(places).alias("p")).select("k1", "k2", "p.*").join(small_side(marked), "mark", "left_semi")
    spots = stored(chosen.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "length")).alias("spots")))
    cut = F.transform("spots", lambda s: F.struct(s["at"].alias("at"), s["length"].alias("length"), F.array_join(F.slice("w", s["at"], s["length"]), " ").alias("window")))
    seen = own.join(spots, ["k1", "k2"]).select("k1", "k2", F.explode(cut).alias("s")).select("k1", "k2", "s.*")
    texts = stored(known.select("length", "window").distinct())
    exact = stored(seen.join(texts, ["length", "window"], "left_semi"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))

    def add(acc, s):
        stop = s["at"] + s["length"]
        return F.struct(F.greatest(acc["end"], stop).alias("end"), (acc["total"] + F.greatest(F.lit(0), stop - F.greatest(acc["end"], s["at"]))).alias("total"))

    words_hit = exact.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("at", "length"))).alias("spans")).select("k1", "k2", F.aggregate("spans", start, add)["total"].alias("n_hit"))
    owners = known.groupBy("length", "window").agg(F.collect_set("item_id").alias("owners"))
    held = exact.select("k1", "k2", "length", "window").distinct().join(owners, ["length", "window"])
    listed = held.groupBy("k1", "k2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("owners")))).alias("items"))
    return words_hit.join(listed, ["k1", "k2"])


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)
