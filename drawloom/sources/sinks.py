"""Append-only and content-addressed sinks on Parquet."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drawloom.functions.scalars import canonical_json
from drawloom.session import cut_lineage
from drawloom.sources.files import below


def stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """What a ledger holds, or an empty relation with the schema of ``like`` when it does not exist yet."""
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return like.limit(0)


def payload_hash(columns: list[str]) -> Column:
    return F.sha2(canonical_json({c: F.col(c) for c in columns}), 256)


def plan_append(incoming: DataFrame, existing: DataFrame, keys: list[str], payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rejects). A replay is a no-op; the same key with another payload is a reject.

    Keys that arrive twice in one batch collapse to one row when equal, and are rejected when they differ.
    """
    hashed = incoming.withColumn("payload_hash", payload_hash(payload))
    row = F.struct(*[c for c in incoming.columns if c not in keys])
    once = hashed.groupBy(*keys).agg(
        F.min("payload_hash").alias("payload_hash"),
        (F.min("payload_hash") != F.max("payload_hash")).alias("_differs"),
        F.min_by(row, "payload_hash").alias("_row"),
    )
    known = existing.select(*keys, F.col("payload_hash").alias("_known"))
    joined = once.join(known, keys, "left")
    changed = F.coalesce(F.col("_known") != F.col("payload_hash"), F.lit(False))
    reject = F.when(F.col("_differs"), "differs_within_batch").when(changed, "changed_payload")
    marked = joined.withColumn("reject", reject)
    fresh = marked.filter("reject is null and _known is null").select(*keys, "_row.*", "payload_hash")
    return fresh, marked.filter("reject is not null").select(*keys, "reject")


def append_keyed(incoming: DataFrame, path: str, keys: list[str], payload: list[str]) -> DataFrame:
    """Appends new keys and returns the rejects."""
    spark = incoming.sparkSession
    like = incoming.withColumn("payload_hash", F.lit("").cast("string"))
    fresh, rejects = plan_append(incoming, stored(spark, path, like.select(*keys, *[c for c in like.columns if c not in keys])), keys, payload)
    rejects = cut_lineage(rejects)  # judged against the ledger as it was before the append
    fresh.write.mode("append").parquet(path)
    return rejects


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Insert-or-replace: the newest version per key, combined map-side."""
    both = existing.unionByName(incoming)
    row = F.struct(*[c for c in both.columns if c not in keys])
    return both.groupBy(*keys).agg(F.max_by(row, version).alias("_r")).select(*keys, "_r.*")


def insert_or_keep(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to add: keys not stored yet, each once."""
    return incoming.join(existing.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)


# --- fingerprints -------------------------------------------------------------------

# Hex digits per chunk of a row hash: 13 digits (52 bits) stay exact in a long, and sums fit decimal(38,0).
_CHUNKS = tuple((1 + 13 * i, 13) for i in range(4)) + ((53, 12),)


def fingerprint(df: DataFrame, columns: list[str] | None = None, keys: list[str] = ()) -> DataFrame:
    """Order-free content digest: SHA-256 of the row count and of the sums of all row-hash chunks.

    Sums combine map-side, so the digest needs no sort and collects no group, whatever the size of the table.
    """
    h = payload_hash(columns or df.columns)
    chunks = [F.conv(F.substring(h, at, n), 16, 10).cast("decimal(38,0)").alias(f"_c{i}") for i, (at, n) in enumerate(_CHUNKS)]
    sums = [F.sum(f"_c{i}").cast("string").alias(f"_c{i}") for i in range(len(_CHUNKS))]
    rows = df.select(*keys, *chunks).groupBy(*keys).agg(F.count("*").alias("rows"), *sums)
    text = F.concat_ws("|", F.col("rows").cast("string"), *[f"_c{i}" for i in range(len(_CHUNKS))])
    return rows.select(*keys, "rows", F.sha2(text, 256).alias("digest"))


def table_digests(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows, digest) of each named table."""
    parts = [fingerprint(df).withColumn("table", F.lit(name)) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def combined_digest(digests: DataFrame) -> DataFrame:
    """One digest over named tables (a handful of rows), independent of paths and order."""
    listed = F.array_sort(F.collect_list(F.concat_ws(":", "table", "digest")))
    return digests.agg(F.sha2(F.array_join(listed, "\n"), 256).alias("digest"))


def batch_digest(configuration: str, inputs: dict[str, DataFrame]) -> DataFrame:
    """Digest of a batch: its configuration text and the content of its inputs, never their location."""
    listed = F.array_sort(F.collect_list(F.concat_ws(":", "table", "digest")))
    return table_digests(inputs).agg(F.sha2(F.concat_ws("\n", F.lit(configuration), F.array_join(listed, "\n")), 256).alias("digest"))


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _files(spark, path)
    return fs.exists(p)


# Rows of a written file, at most: verification hashes a file as one value, so this bounds what a task holds.
FILE_ROWS = 500_000


# Folders of a snapshot that hold no table.
OWN_PARTS = ("files", "manifest")


def file_hashes(spark: SparkSession, root: str) -> DataFrame:
    """(file, size, sha256) of the Parquet files of a snapshot's tables, by their path from its folder, hashed where they are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root)
    hashed = found.select(below(F.col("path"), root).alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    return hashed.filter(~F.substring_index("file", "/", 1).isin(*OWN_PARTS))


def tree_digest(hashes: DataFrame) -> DataFrame:
    """Root of the hash tree over files: files fold into 4,096 groups by the hash of their path, groups into the root.

    A group holds a 4,096th of the file names, never the content.
    """
    leaf = F.concat_ws(":", "file", F.col("size").cast("string"), "sha256")
    groups = hashes.groupBy(F.substring(F.sha2("file", 256), 1, 3).alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(leaf)), "\n"), 256).alias("h"))
    listed = F.array_sort(F.collect_list(F.concat_ws(":", "g", "h")))
    return groups.agg(F.count("*").alias("groups"), F.sha2(F.array_join(listed, "\n"), 256).alias("digest"))


def write_snapshot(spark: SparkSession, root: str, tables: dict[str, DataFrame], blocking: list[str] = ()) -> str:
    """Publishes tables under ``root/<digest>``. Identical content is reused; blocking conditions refuse.

    Tables are written once to a staging folder and digested from the written files, so no input is
    computed twice; the folder then takes the name of its digest. ``files`` lists hash and size of each file, and
    ``manifest`` the digest of each table and, as ``files``, the root of the hash tree; it is written last.
    """
    if blocking:
        raise ValueError("Audit has blocking conditions: " + ", ".join(sorted(blocking)))
    if not set(tables).isdisjoint(OWN_PARTS):
        raise ValueError(f"Tables of a snapshot may not be named {', '.join(OWN_PARTS)}")
    staging = f"{root}/staging-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{staging}/{name}")
    digests = table_digests({name: spark.read.parquet(f"{staging}/{name}") for name in tables})
    file_hashes(spark, staging).write.parquet(f"{staging}/files")
    tree = tree_digest(spark.read.parquet(f"{staging}/files")).select(F.lit("files").alias("table"), F.col("groups").alias("rows"), "digest")
    digests.select("table", "rows", "digest").unionByName(tree).coalesce(1).write.parquet(f"{staging}/manifest")
    content = spark.read.parquet(f"{staging}/manifest").filter("table <> 'files'")  # equal rows, however they lie in files
    digest = combined_digest(content).first()["digest"]
    target, fs = _files(spark, f"{root}/{digest}")
    source, _ = _files(spark, staging)
    if fs.exists(target) or not fs.rename(source, target):
        fs.delete(source, True)
    return digest


def verify_files(spark: SparkSession, root: str, digest: str) -> DataFrame:
    """(part, item, reason) of files that are missing, added or changed, and of a file list that is not the published one."""
    home = f"{root}/{digest}"
    listed = spark.read.parquet(f"{home}/files")
    now = file_hashes(spark, home).select("file", F.col("size").alias("_size"), F.col("sha256").alias("_sha256"))
    reason = (
        F.when(F.col("_sha256").isNull(), "missing_file")
        .when(F.col("sha256").isNull(), "unlisted_file")
        .when(F.col("size") != F.col("_size"), "size_differs")
        .when(F.col("sha256") != F.col("_sha256"), "hash_differs")
    )
    damaged = listed.join(now, "file", "full").select(F.substring_index("file", "/", 1).alias("part"), F.col("file").alias("item"), reason.alias("reason"))
    roots = tree_digest(listed).select("digest").unionByName(spark.read.parquet(f"{home}/manifest").filter("table = 'files'").select("digest"))
    forged = roots.agg(F.count("*").alias("n"), F.countDistinct("digest").alias("d")).filter("n <> 2 or d <> 1")
    return damaged.filter("reason is not null").unionByName(forged.select(F.lit("files").alias("part"), F.lit("files").alias("item"), F.lit("list_differs").alias("reason")))


def verify_snapshot(spark: SparkSession, root: str, digest: str) -> DataFrame:
    """Tables whose recomputed digest or row count differs from the manifest; empty when the snapshot is intact."""
    listed = spark.read.parquet(f"{root}/{digest}/manifest").filter("table <> 'files'")
    names = [r["table"] for r in listed.select("table").collect()]  # a handful of table names
    actual = table_digests({n: spark.read.parquet(f"{root}/{digest}/{n}") for n in names})
    joined = listed.alias("l").join(actual.alias("a"), "table", "full")
    same = F.col("l.digest").eqNullSafe(F.col("a.digest")) & F.col("l.rows").eqNullSafe(F.col("a.rows"))
    return joined.filter(~same).select("table")


def write_once(df: DataFrame, path: str) -> str:
    """``written``, or ``unchanged`` when the stored content is identical; other content is refused."""
    spark = df.sparkSession
    if not _exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
        return "written"
    old, new = fingerprint(spark.read.parquet(path)).first(), fingerprint(df).first()
    if old["digest"] != new["digest"]:
        raise ValueError(f"Refusing to overwrite different content at {path}")
    return "unchanged"


def export_tables(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Writes each table as CSV files with a header below ``root`` and returns what those files hold, by the tables' own schemas."""
    back = {}
    for name, df in tables.items():
        df.write.option("header", True).csv(f"{root}/{name}")
        back[name] = spark.read.schema(df.schema).option("header", True).option("enforceSchema", False).csv(f"{root}/{name}")
    return back


def draw_layout(draws: DataFrame) -> DataFrame:
    """Canonical export columns, sorted by game and date."""
    mains = F.array_sort("mains")
    cells = [mains[i].alias(f"main_{i + 1}") for i in range(6)]
    return draws.select("game", "draw_date", "rule_code", *cells, "bonus", "observation_key").orderBy("game", "draw_date")


# --- ledgers -------------------------------------------------------------------------


def whole_portfolios(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of complete portfolios: indices 0..budget-1, each once. Budgets bound the group."""
    complete = lines.groupBy(*keys, "budget").agg(
        F.count("*").alias("_rows"), F.countDistinct("line_index").alias("_indices"), F.min("line_index").alias("_low"), F.max("line_index").alias("_top")
    ).filter("_rows = budget and _indices = budget and _low = 0 and _top = budget - 1")
    return lines.join(complete.select(*keys, "budget"), [*keys, "budget"], "left_semi")


def match_evaluations(evaluations: DataFrame, issued: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(evaluations of an issued line with equal numbers, the others)."""
    known = issued.select(*keys, F.col("mains").alias("_issued"))
    joined = evaluations.join(known, keys, "left").withColumn("_ok", F.col("_issued").eqNullSafe(F.col("mains")))
    columns = evaluations.columns
    return joined.filter("_ok").select(*columns), joined.filter("not _ok").select(*columns)
