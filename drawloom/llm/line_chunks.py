"""Line dedup by content-defined chunks. Native columns only.

A line goes if it lies in a run of two or more lines with text that also stands at an earlier place of the table (the
same bytes), or if it is a passage (``PASSAGE`` words or more) that stands at an earlier place. Places are ordered by
(doc_id, line); one run may overlap its earlier copy. Every line that goes has a copy that stays. Blank lines between
two lines are part of the run; those behind a line that goes (and before the first one) go with it.

1. A rolling hash over the hashes of the last ``ROLL`` lines with text ends a chunk when it is divisible by ``MEAN``, so
   boundaries depend on nearby lines only and survive shifts. A passage is a chunk of its own.
2. Chunks whose hash stands twice are fetched and compared byte by byte. Each copy but the first goes whole.
3. A repeated run rarely begins and ends with its chunks. So the chunks that stay, and the seams between any two chunks,
   are compared line by line: each line with its next, which extends what was found to both sides and finds runs that
   hold no whole chunk. What lies inside a copy that goes need not be looked up again.

Only hashes are shuffled to find what repeats; texts follow only for repeated places. Rows with one doc_id and one text
are one document and are treated alike. A null doc_id counts as the last one. Null texts stay null, empty ones empty; a
text that loses all its lines becomes empty; other columns are kept, also those named like what is added (see ``cut``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawloom.llm.common import BROADCAST_ROWS, fresh, stored
from drawloom.llm.winnowing import let

ROLL, MEAN, PASSAGE = 2, 4, 50
_KEY = ["_id", "_k1", "_k2"]
_LAST = 2**63 - 1


def is_passage(line: Column) -> Column:
    """Words are parted by any white space."""
    return (F.octet_length(line) >= 2 * PASSAGE - 1) & (F.regexp_count(line, F.lit(r"(?U)\S+")) >= PASSAGE)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def chunk_starts(hashes: Column, passages: Column) -> Column:
    """0-based numbers of the lines with text that begin a chunk. A chunk's end depends on its last ``ROLL`` lines."""

    def ends(j: Column) -> Column:
        rolled = F.xxhash64(*(F.get(hashes, j - back) for back in reversed(range(ROLL))))
        return (F.pmod(rolled, F.lit(MEAN)) == 0) | F.get(passages, j) | F.get(passages, j + 1)

    return F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda j: F.when(j == 0, F.lit(True)).otherwise(ends(j - 1)))


def chunks(lines: Column) -> Column:
    """Chunks as (place, units): a place is (at, count, from, takes, hash), with the lines compared (1-based) and those that
    go with them; units are the pairs of neighbouring lines with text inside the chunk, and ``seam`` is the pair of its
    last line and the next chunk's first."""

    def of(l: Column, full: Column, hashes: Column, passages: Column, starts: Column) -> Column:
        def begin(j: Column) -> Column:
            return F.when(j == 0, F.lit(1)).otherwise(F.get(full, j))

        def place(first: Column, last: Column) -> Column:
            """From one line with text to another, by their numbers."""
            at = F.get(full, first)
            end = F.coalesce(F.get(full, last + 1), F.size(l) + 1)
            part = F.slice(l, at, F.get(full, last) - at + 1)
            return F.struct(at.alias("at"), F.size(part).alias("count"), begin(first).alias("from"), (end - begin(first)).alias("takes"), F.xxhash64(part).alias("hash"))

        def chunk(first: Column, i: Column) -> Column:
            last = F.coalesce(F.get(starts, i + 1), F.size(full)) - 1
            inner = F.transform(F.filter(F.sequence(first, last), lambda j: j < last), lambda j: place(j, j + 1))
            seam = F.when(last + 1 < F.size(full), place(last, last + 1))
            worth = (last > first) | F.get(passages, first)
            return F.struct(F.when(worth, place(first, last)).alias("place"), inner.alias("units"), seam.alias("seam"))

        return F.transform(starts, chunk)

    def numbered(l: Column, full: Column) -> Column:
        hashes = F.transform(full, lambda at: F.xxhash64(F.element_at(l, at)))
        passages = F.transform(full, lambda at: is_passage(F.element_at(l, at)))
        found = let(hashes, lambda h: let(passages, lambda p: let(chunk_starts(h, p), lambda s: of(l, full, h, p, s))))
        return F.when(F.size(full) > 0, found)

    def with_text(l: Column) -> Column:
        return F.filter(F.sequence(F.lit(1), F.size(l)), lambda i: F.element_at(l, i).rlike(r"(?U)\S"))

    return let(lines, lambda l: let(with_text(l), lambda full: numbered(l, full)))


def later(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Of ``places`` (key, at, count, from, takes, hash) those whose bytes stand at an earlier place too."""
    where = F.struct(*_KEY, "at")
    often = stored(places.groupBy("hash").agg(F.min(where).alias("lo"), F.max(where).alias("hi")).filter("lo < hi").select("hash"))
    spots = stored(places.join(often, "hash", "left_semi").groupBy(*_KEY).agg(F.collect_set(F.struct("at", "count", "from", "takes")).alias("spots")))
    whole = docs.select(*_KEY, "text").join(bounded(spots), _KEY).select(*_KEY, "spots", lines_of(F.col("text")).alias("lines"))
    bytes_of = F.transform("spots", lambda s: F.struct(*(s[c].alias(c) for c in ("at", "count", "from", "takes")), F.array_join(F.slice("lines", s["at"], s["count"]), "\n").alias("bytes")))
    found = stored(whole.select(*_KEY, F.explode(bytes_of).alias("t")).select(*_KEY, "t.*"))
    first = found.groupBy("bytes").agg(F.min(where).alias("first"), F.max(where).alias("last")).filter("first < last")
    first = stored(first.select("bytes", "first"))
    return stored(found.join(first, "bytes").filter(where != F.col("first")).select(*_KEY, "at", "count", "from", "takes"))


def repeated(docs: DataFrame) -> DataFrame:
    """The lines to remove: key, at, count. ``docs`` has the key columns and a text."""
    cut = stored(docs.select(*_KEY, F.explode(chunks(lines_of(F.col("text")))).alias("c")).select(*_KEY, "c.*"))
    copies = later(docs, cut.filter("place is not null").select(*_KEY, "place.*"))
    gone = copies.select(*_KEY, "at", "count").distinct().withColumnRenamed("count", "_count")
    marked = cut.join(gone, [F.col("place.at") == gone["at"], F.col("place.count") == gone["_count"], *(cut[c].eqNullSafe(gone[c]) for c in _KEY)], "left")
    inner = F.when(gone["at"].isNull(), F.col("units")).otherwise(F.array())
    units = F.concat(inner, F.array_compact(F.array("seam")))
    runs = later(docs, stored(marked.select(*(cut[c] for c in _KEY), F.explode(units).alias("u")).select(*_KEY, "u.*")))
    both = copies.unionByName(runs).groupBy(*_KEY).agg(F.collect_set(F.struct("from", "takes")).alias("units"))
    return both.select(*_KEY, F.explode(merged(F.col("units"))).alias("r")).select(*_KEY, "r.*")


def merged(taken: Column) -> Column:
    """The lines of overlapping or adjoining units as runs (at, count)."""
    lines = F.array_sort(F.array_distinct(F.flatten(F.transform(taken, lambda u: F.sequence(u["from"], u["from"] + u["takes"] - 1)))))

    def runs(l: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(l) - 1), lambda i: (i == 0) | (F.get(l, i - 1) != F.get(l, i) - 1))
        return let(starts, lambda s: F.transform(s, lambda i, j: F.struct(F.get(l, i).alias("at"), (F.coalesce(F.get(s, j + 1), F.size(l)) - i).alias("count"))))

    return let(lines, runs)


def bounded(rows: DataFrame) -> DataFrame:
    """Sends a stored table with short arrays to all tasks only if its elements are few, by count."""
    arrays = [c for c, kind in rows.dtypes if kind.startswith("array")]
    size = rows.agg(F.sum(sum((F.size(c) for c in arrays), F.lit(1)))).first()[0] or 0
    return F.broadcast(rows) if size <= BROADCAST_ROWS else rows


def cut(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows of ``docs`` with what repeats cut from ``text``, and the names of the columns added.

    n_lines, n_removed (lines) and n_chunks (runs removed) get underscores behind them where ``docs`` has such a column.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_id"), F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(1), text).alias("_k2"))
    gone = stored(repeated(rows.select(*_KEY, "doc.text")).groupBy(*_KEY).agg(F.collect_list(F.struct("at", "count")).alias("gone")))
    joined = rows.join(bounded(gone), _KEY, "left").withColumn("lines", lines_of(F.col("doc.text")))
    taken = F.flatten(F.transform("gone", lambda g: F.sequence(g["at"], g["at"] + g["count"] - 1)))
    each = F.transform("lines", lambda x, i: F.struct((i + 1).alias("i"), x.alias("x")))
    left = let(F.map_from_arrays(taken, F.transform(taken, lambda i: F.lit(True))), lambda m: F.transform(F.filter(each, lambda p: F.element_at(m, p["i"]).isNull()), lambda p: p["x"]))
    names = {c: fresh(docs, c) for c in ("n_lines", "n_removed", "n_chunks")}
    whole = F.col("gone").isNull()
    added = {
        "n_lines": F.when(F.coalesce("doc.text", F.lit("")) == "", F.lit(0)).otherwise(F.size("lines")),
        "n_removed": F.coalesce(F.aggregate("gone", F.lit(0), lambda a, g: a + g["count"]), F.lit(0)),
        "n_chunks": F.when(whole, F.lit(0)).otherwise(F.size("gone")),
    }
    kept = [F.when(whole, F.col("doc.text")).otherwise(F.array_join(left, "\n")).alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    return joined.select(*kept, *(v.cast("long").alias(names[c]) for c, v in added.items())), names


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with what repeats cut from ``text``; n_lines, n_removed and n_chunks are added (see ``cut``)."""
    return cut(docs)[0]
