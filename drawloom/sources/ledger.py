"""Append-only ledgers in parts, with a summary of the keys of each part.

A ledger is a folder ``rows`` of Parquet files in parts (a date-derived text column, such as the month) and a folder
``bits`` with, for each append and part, bitmaps of the hashed keys. An append looks up the bits of the parts it touches:
a key whose bit is not set is new without reading a row, and only parts with a key that may be stored are read, by their
own folders. So an append costs what it brings and the parts it may repeat, not the size of the ledger.

Bits are written before rows. A writer that is lost between the two leaves bits too many, which cost a read and nothing
else; one that is lost while its rows are moved leaves a part of them, and a replay adds the rest. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drawloom.session import cut_lineage
from drawloom.sources.sinks import _exists, payload_hash, plan_append

# Bits of one bitmap of Spark's bitmap functions.
BITS = 8 * 4096
# An append that touches more parts than this reads the ledger with a semi-join on parts instead of a list of folders.
LISTED_PARTS = 2000
_OWN = ("part", "payload_hash")


class Ledger:
    """Rows under unique ``keys``; ``part`` derives the part from the keys, so that a key always meets the same part.

    ``blocks`` bitmaps of 32,768 bits serve one part; ten bits for each expected key keep nine of ten new keys unread.
    Keys may be null, and nulls are equal. Columns named ``part`` or ``payload_hash`` are refused.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], payload: list[str], part: Column, blocks: int = 8):
        self.spark, self.path, self.keys, self.payload, self.part, self.blocks = spark, path, keys, payload, part, blocks

    def rows(self, like: DataFrame, parts: DataFrame | None = None) -> DataFrame:
        """What is stored, with the columns of ``like``, ``payload_hash`` and ``part``; of the named parts only, if given."""
        shape = like.withColumn("payload_hash", F.lit("")).withColumn("part", F.lit(""))
        home = f"{self.path}/rows"
        if not _exists(self.spark, home):
            return shape.limit(0)
        return self._read(home, shape.schema, parts)

    def _read(self, home: str, schema, parts: DataFrame | None) -> DataFrame:
        reader = self.spark.read.schema(schema).option("basePath", home)
        if parts is None:
            return reader.parquet(home)
        names = [r["part"] for r in parts.select("part").distinct().limit(LISTED_PARTS + 1).collect()]
        if len(names) > LISTED_PARTS:
            return reader.parquet(home).join(parts.select("part").distinct(), "part", "left_semi")
        folders = [f for f in (f"{home}/part={n}" for n in names) if _exists(self.spark, f)]
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _placed(self, df: DataFrame) -> DataFrame:
        """Rows with their part, and the block and position of their key's bit."""
        clash = [c for c in df.columns if c in _OWN]
        if clash:
            raise ValueError(f"A ledger names these columns itself: {', '.join(clash)}")
        bit = F.pmod(F.xxhash64(*self.keys), F.lit(BITS * self.blocks))
        named = F.regexp_replace(F.coalesce(self.part.cast("string"), F.lit("none")), "[^0-9A-Za-z.-]", "-")
        placed = df.withColumn("part", F.when(named == "", "none").otherwise(named))
        return placed.withColumn("_block", F.floor(bit / BITS).cast("int")).withColumn("_bit", F.pmod(bit, F.lit(BITS)))

    def _maybe_stored(self, placed: DataFrame) -> DataFrame:
        """Rows whose key has its bit set, so that it may be stored."""
        home = f"{self.path}/bits"
        if not _exists(self.spark, home):
            return placed.limit(0)
        bits = self._read(home, "_block int, bits binary, part string", placed)
        known = bits.groupBy("part", "_block").agg(F.bitmap_or_agg("bits").alias("_bits"))
        byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        shifted = F.floor(byte / F.pow(F.lit(2), F.pmod("_bit", F.lit(8))))
        return placed.join(known, ["part", "_block"]).filter(shifted % 2 == 1).drop("_bits")

    def _write(self, fresh: DataFrame) -> None:
        placed = self._placed(fresh.drop("payload_hash", "part"))
        bits = placed.groupBy("part", "_block").agg(F.bitmap_construct_agg("_bit").alias("bits"))
        bits.write.mode("append").partitionBy("part").parquet(f"{self.path}/bits")
        even = fresh.hint("rebalance", "part")  # few files a part, and a large part in several
        even.write.mode("append").partitionBy("part").parquet(f"{self.path}/rows")

    def append(self, incoming: DataFrame) -> DataFrame:
        """Adds the rows of new keys and returns (keys, reject) of the refused ones.

        A row that is stored already is a no-op. A stored key with another payload is ``changed_payload``, a key that
        comes twice with different payloads ``differs_within_batch``; neither adds a row.
        """
        own = cut_lineage(self._placed(incoming))
        known = self.rows(incoming, self._maybe_stored(own))
        added, rejects = plan_append(_wrapped(own.drop("_block", "_bit"), self.keys), _wrapped(known, self.keys), _names(self.keys), self.payload)
        refused = rejects.select(*[F.col(f"{w}.v").alias(k) for w, k in zip(_names(self.keys), self.keys)], "reject")
        both = added.drop(*_names(self.keys)).withColumn("reject", F.lit(None).cast("string")).unionByName(refused, allowMissingColumns=True)
        marked = cut_lineage(both)  # judged against the ledger as it was before the append
        self._write(marked.filter("reject is null").select(*incoming.columns, "payload_hash", "part"))
        return marked.filter("reject is not null").select(*self.keys, "reject")

    def insert_once(self, incoming: DataFrame, first: Column) -> DataFrame:
        """Adds a row for each key that is not stored yet, the least by ``first`` of its batch, and returns the stored row of
        each incoming key: the new one, or the one that was there. Rows that tie on ``first`` go by the hash of their payload."""
        own = cut_lineage(self._placed(incoming).withColumn("payload_hash", payload_hash(self.payload)))
        columns = [*incoming.columns, "payload_hash", "part"]
        row = F.struct(*[c for c in columns if c not in self.keys])
        once = own.withColumn("_first", first).groupBy(*self.keys).agg(F.min_by(row, F.struct("_first", "payload_hash")).alias("_row"))
        once = once.select(*self.keys, "_row.*").select(*columns)
        wanted = own.select(*self.keys).distinct()
        known = self.rows(incoming, self._maybe_stored(own)).select(*columns)
        kept = known.join(_renamed(wanted, self.keys), _same(known, self.keys), "left_semi")
        fresh = once.join(_renamed(kept, self.keys), _same(once, self.keys), "left_anti")
        out = cut_lineage(kept.withColumn("inserted", F.lit(False)).unionByName(fresh.withColumn("inserted", F.lit(True))))
        self._write(out.filter("inserted").select(*columns))
        return out.select(*incoming.columns, "inserted")


# Joins by name drop null keys. A struct around a key is never null itself, and its field compares null-safe.


def _names(keys: list[str]) -> list[str]:
    return [f"_key_{k}" for k in keys]


def _wrapped(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*[F.struct(F.col(k).alias("v")).alias(w) for w, k in zip(_names(keys), keys)], *df.columns)


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_other_{k}") for k in keys])


def _same(df: DataFrame, keys: list[str]) -> Column:
    same = [df[k].eqNullSafe(F.col(f"_other_{k}")) for k in keys]
    out = same[0]
    for s in same[1:]:
        out = out & s
    return out
