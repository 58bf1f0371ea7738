"""File sources: draw exports, observation files, text tables, evidence bodies, curated facts, result folders.

A bad record never disappears: every source returns rows plus a ``reject`` reason, and a file-level rule
(one bad row rejects its file) is an anti-join on the few bad file names, not a window over a file.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawloom import schemas
from drawloom.operators.validate import bonus_ok, check_curated, check_observations, mains_ok

FILE = "_metadata.file_path"
NUMBERS = [f"n{i}" for i in range(1, 7)]


def below(path: Column, root: str) -> Column:
    """Path of a file relative to the folder it was found in: what follows the folder's own path, with any scheme.

    Where a mount point has renamed the folder, its last name is looked for instead.
    """
    own = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/") + "/"
    at = F.instr(path, own)
    return F.when(at > 0, F.substring(path, at + len(own), F.length(path))).otherwise(F.substring_index(path, own.split("/")[-2] + "/", -1))


def mark_bad_files(rows: DataFrame, bad: Column, reason: str = "bad_file") -> DataFrame:
    """Adds ``reject``: set on every row of a file that holds a bad row."""
    flagged = rows.withColumn("_row_bad", F.coalesce(bad, F.lit(True)))
    files = flagged.filter("_row_bad").select("file").distinct().withColumn("_file_bad", F.lit(True))
    joined = flagged.join(files, "file", "left")
    return joined.withColumn("reject", F.when(F.col("_file_bad"), reason)).drop("_row_bad", "_file_bad")


# Cells of a CSV line: commas outside of double quotes part them.
_COMMA = r",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"


def draw_exports(spark: SparkSession, path: str) -> DataFrame:
    """CSV draw exports (``date,n1..n6`` and optional columns). Outcome: Won above zero winners, Roll at zero, else null.

    Columns go by the names in the header of their own file, in any order. A bad row (cells unlike the header, an
    unreadable date, number, amount or winner count, numbers against the observation rules) rejects its file; so do
    a header without the required names, and a file without rows. No file with a usable header at all is an error.
    Lines hold one record each. A file of zero bytes yields one rejected row too.
    """
    raw = spark.read.text(path).select(F.col(FILE).alias("file"), F.regexp_replace("value", "^\ufeff|\r$", "").alias("value"))
    cells = F.transform(F.split("value", _COMMA, -1), lambda c: F.replace(F.regexp_replace(F.trim(c), '^"(.*)"$', "$1"), F.lit('""'), F.lit('"')))
    lines = raw.filter(F.trim("value") != "").select("file", cells.alias("cells"))
    is_header = F.array_contains("cells", "date") & F.array_contains("cells", "n1")
    headers = lines.filter(is_header).groupBy("file").agg(F.min("cells").alias("header"))  # one small row per file
    needed = F.array(*[F.lit(c) for c in ("date", *NUMBERS)])
    if headers.filter(F.size(F.array_intersect("header", needed)) == 7).isEmpty():
        found = headers.first()
        raise ValueError(f"Draw export lacks columns {sorted({'date', *NUMBERS} - set(found.header if found else ()))}")
    # Headers are few and small, so the lines of a big file stay where they were read; files without a line come apart.
    records = lines.filter(~is_header)
    bare = headers.join(records.select("file").distinct(), "file", "left_anti")
    empty = spark.createDataFrame([(f,) for f in zero_byte_files(spark, path)], "file string")
    rows = records.join(headers, "file", "left").unionByName(bare, allowMissingColumns=True).unionByName(empty, allowMissingColumns=True)
    known = F.coalesce("header", F.array().cast("array<string>"))

    def cell(name):
        at = F.array_position(known, name)
        return F.nullif(F.trim(F.when(at > 0, F.get("cells", (at - 1).cast("int")))), F.lit(""))

    day = F.when(cell("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(cell("date"), "yyyy-MM-dd"))
    winners = cell("jackpotWinners").try_cast("int")
    jackpot = cell("jackpot").try_cast("decimal(18,2)")
    parsed = rows.select(
        "file",
        day.alias("draw_date"),
        F.array(*[cell(c).try_cast("int") for c in NUMBERS]).alias("mains"),
        cell("bonus").try_cast("int").alias("bonus"),
        jackpot.alias("jackpot"),
        cell("currency").alias("currency"),
        F.when(winners > 0, "Won").when(winners == 0, "Roll").alias("outcome"),
        F.when(F.size(F.array_intersect(known, needed)) < 7, "bad_header")
        .when(F.col("cells").isNull(), "empty_file")
        .when(F.size("cells") != F.size(known), "bad_row")
        .when(cell("jackpotWinners").isNotNull() & F.coalesce(winners < 0, F.lit(True)), "bad_winners")
        .when(cell("bonus").isNotNull() & cell("bonus").try_cast("int").isNull(), "bad_bonus")
        .when(cell("jackpot").isNotNull() & F.coalesce(jackpot < 0, F.lit(True)), "bad_amount")
        .alias("_why"),
    )
    mains = F.col("mains")
    valid = mains_ok(mains, F.lit(99)) & bonus_ok(mains, F.col("bonus"), F.lit(99)) & F.col("draw_date").isNotNull()
    bad = F.col("_why").isNotNull() | ~F.coalesce(valid, F.lit(False))
    return mark_bad_files(parsed, bad).drop("_why")


def zero_byte_files(spark: SparkSession, path: str) -> list[str]:
    """Addresses of the files without a byte that a path or pattern names; Spark's own listing leaves them out."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = list(fs.globStatus(pattern) or [])
    listed = [f for s in found for f in (fs.listStatus(s.getPath()) if s.isDirectory() else [s])]
    empty = [f.getPath() for f in listed if f.isFile() and f.getLen() == 0]
    return [re.sub("^file:/(?!/)", "file:///", p.toUri().toString()) for p in empty if not p.getName().startswith(("_", "."))]


def empty_files(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files of a manifest (``file``) without a single record; must be empty."""
    return manifest.join(rows.select("file").distinct(), "file", "left_anti")


def observation_files(spark: SparkSession, root: str, artifacts: DataFrame) -> DataFrame:
    """JSON observation files. Each record's host must be its artifact's host; ``file:`` addresses must be equal.

    ``artifacts`` maps ``file`` (path below the root) to ``url``.
    """
    reader = spark.read.schema(schemas.OBSERVATION_FILE).option("multiLine", True).option("recursiveFileLookup", True)
    raw = reader.json(root)
    named = raw.select(below(F.col(FILE), root).alias("file"), F.explode("observations").alias("o"))
    rows = check_observations(named.select("file", "o.*")).join(artifacts.select("file", "url"), "file", "left")
    host, own = F.try_parse_url("url", F.lit("HOST")), F.try_parse_url("source_url", F.lit("HOST"))
    local = F.col("url").startswith("file:")
    mismatch = ~host.eqNullSafe(own) | (local & (F.col("url") != F.col("source_url")))
    marked = mark_bad_files(rows, mismatch | (F.size("reasons") > 0), "host_or_value_mismatch")
    return marked


# The groups of the journal table; group 2 holds the drawn numbers.
JOURNAL_GROUPS = ("1", "2", "3")
JOURNAL_KEPT = "2"


def journal_rows(spark: SparkSession, path: str, pool: int = 42) -> DataFrame:
    """Whitespace table of a group and six numbers per line; keeps the drawn group with its line number.

    Any malformed line rejects its file. Lines come from Spark's text source, so a file is split over tasks
    only where line numbers are not needed; here each file is read whole to number its lines.
    """
    whole = spark.read.text(path, wholetext=True).select("value", F.col(FILE).alias("file"))
    lines = whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    fields = F.split(F.trim("line"), r"\s+")
    rows = lines.filter(F.trim("line") != "").select("file", (F.col("pos") + 1).alias("source_row"), fields.alias("f"))
    numbers = F.transform(F.slice("f", 2, 6), lambda x: x.try_cast("int"))
    bad = (F.size("f") != 7) | ~F.col("f")[0].isin(*JOURNAL_GROUPS) | F.exists(numbers, lambda n: n.isNull())
    marked = mark_bad_files(rows, bad)
    kept = marked.filter((F.get("f", F.lit(0)) == JOURNAL_KEPT) | F.col("reject").isNotNull())
    return kept.select(
        "file", "source_row", numbers.alias("source_numbers"), F.array_sort(numbers).alias("mains"), F.lit(pool).alias("pool"), "reject"
    )


def wide_metrics(table: DataFrame, metrics: dict[str, tuple[str, str]], year: str = "Year") -> DataFrame:
    """Unpivot a yearly metric table into facts with unit, value and rounding increment.

    ``metrics`` maps a column to (metric name, kind). Kinds: money (``€884.1m`` with an optional percentage),
    count, percent, embedded_percent (the percentage in brackets). A cell that fits none gets a reject reason.
    """
    drift = {year, *metrics} ^ set(table.columns)
    if drift:
        raise ValueError(f"Metric table changed: {sorted(drift)}")
    long = table.unpivot([year], list(metrics), "column", "original_text")
    lookup = F.create_map(*[F.lit(x) for c, (m, k) in metrics.items() for x in (c, f"{m}|{k}")])
    tagged = long.withColumn("_m", F.split(F.element_at(lookup, F.col("column")), r"\|"))
    rows = tagged.withColumn("metric", F.col("_m")[0]).withColumn("kind", F.col("_m")[1])
    text, kind = F.col("original_text"), F.col("kind")
    figure = (
        F.when(kind == "money", F.regexp_extract(text, r"^€(\d+(?:\.\d+)?)m(?: \(\d+(?:\.\d+)?%\))?$", 1))
        .when(kind == "count", F.regexp_extract(text, r"^(\d+)$", 1))
        .when(kind == "percent", F.regexp_extract(text, r"^(\d+(?:\.\d+)?)%$", 1))
        .otherwise(F.regexp_extract(text, r"^.* \((\d+(?:\.\d+)?)%\)$", 1))
    )
    scale = F.when(kind == "money", F.lit(1_000_000)).otherwise(F.lit(1)).cast("decimal(10,0)")
    value = (figure.try_cast("decimal(18,6)") * scale).cast("decimal(28,6)")
    digits = F.length(F.regexp_extract(figure, r"\.(\d+)$", 1))
    years = table.groupBy(year).agg(F.count("*").alias("_years"))
    out = rows.withColumn("figure", figure).join(years, year)
    percent_high = kind.endswith("percent") & (value > 100)
    reject = (
        F.when(~F.col(year).cast("string").rlike(r"^20\d{2}$"), "bad_year")
        .when(F.col("_years") > 1, "duplicate_year")
        .when((F.col("figure") == "") | value.isNull() | percent_high, "unreviewed_cell")
    )
    unit = F.when(kind == "money", "EUR").when(kind == "count", "count").otherwise("percent")
    return out.select(
        F.col(year).cast("string").alias("year"),
        "metric",
        value.alias("value"),
        unit.alias("unit"),
        (F.pow(F.lit(10.0), -digits) * scale.cast("double")).alias("rounding_increment"),
        "original_text",
        reject.alias("reject"),
    )


# --- evidence ---------------------------------------------------------------------


def evidence_bodies(spark: SparkSession, root: str) -> DataFrame:
    """(path below the root, sha256, size) of every body; each executor hashes the files it reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(below(F.col("path"), root).alias("body_path"), F.sha2("content", 256).alias("actual_sha256"), F.col("length").alias("size"))


def bundled_bodies(bundles: DataFrame) -> DataFrame:
    """The same of bodies kept as rows (``body_path``, ``content``) of a few large files, where there are too many to list.

    A path may come again; copies that differ leave it without a hash, so that no artifact fits it.
    """
    hashed = bundles.select("body_path", F.sha2("content", 256).alias("_sha256"), F.octet_length("content").cast("long").alias("_size"))
    same = F.min("_sha256") == F.max("_sha256")
    return hashed.groupBy("body_path").agg(F.when(same, F.min("_sha256")).alias("actual_sha256"), F.max("_size").alias("size"))


def artifact_manifests(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Artifacts of version-1 manifests with their position in the list. A file is one manifest, or with ``lines`` one a line."""
    raw = spark.read.schema(schemas.ARTIFACT_MANIFEST).option("multiLine", not lines).json(path)
    return raw.filter("version = 1").select(F.posexplode("artifacts").alias("artifact_index", "a")).select("artifact_index", "a.*")


def check_evidence(artifacts: DataFrame, bodies: DataFrame) -> DataFrame:
    """Adds ``body_ok``: the listed body exists below the root, is not an escaping path, and has the listed hash."""
    escapes = F.col("body_path").contains("..") | F.col("body_path").startswith("/")
    joined = artifacts.join(bodies, "body_path", "left")
    ok = ~escapes & (F.col("status") == "valid") & (F.col("sha256") == F.col("actual_sha256"))
    return joined.withColumn("body_ok", F.coalesce(ok, F.lit(False)))


def evidence_by_hash(checked: DataFrame) -> DataFrame:
    """Any readable copy of a hash suffices."""
    return checked.groupBy("sha256").agg(F.max("body_ok").alias("evidence_ok"), F.count("*").alias("copies"))


def latest_valid(artifacts: DataFrame) -> DataFrame:
    """Newest valid artifact per address (``max_by`` combines map-side)."""
    row = F.struct("sha256", "body_path", "retrieved_at")
    newest = artifacts.filter("status = 'valid'").groupBy("url").agg(F.max_by(row, "retrieved_at").alias("a"))
    return newest.select("url", "a.*")


# --- curated facts, batches, results -----------------------------------------------


def curated_facts(spark: SparkSession, path: str, artifacts: DataFrame) -> DataFrame:
    """Curated records with validation reasons, tied to their artifact by position; out of range is a reject."""
    raw = spark.read.schema(schemas.CURATED).json(path)
    listed = artifacts.select("artifact_index", F.col("sha256").alias("artifact_sha256"), F.col("status").alias("_status"))
    joined = check_curated(raw).join(listed, "artifact_index", "left")
    reject = (
        F.when(F.col("_status").isNull(), "artifact_out_of_range")
        .when(F.col("_status") != "valid", "artifact_not_valid")
        .when(F.size("reasons") > 0, F.concat_ws(",", "reasons"))
    )
    return joined.withColumn("reject", reject).drop("_status")


def batch_rejects(**parts: DataFrame) -> DataFrame:
    """One row per input and reject reason; a batch is written only when this is empty."""
    out = None
    for name, df in parts.items():
        counted = df.filter("reject is not null").groupBy("reject").agg(F.count("*").alias("rows")).withColumn("input", F.lit(name))
        out = counted if out is None else out.unionByName(counted)
    return out


def study_results(spark: SparkSession, paths: list[str], schema: str, fmt: str = "parquet", depth: int = 2) -> DataFrame:
    """Result tables of several study folders; the folder ``depth`` levels above the file end names the ``study``."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    rows = reader.format(fmt).load(paths)
    return rows.select("*", F.element_at(F.split(F.col(FILE), "/"), -depth).alias("study"))


def adapter(url: Column) -> Column:
    """Which reader a page address needs; null means unsupported and is rejected."""
    host, path = F.try_parse_url(url, F.lit("HOST")), F.try_parse_url(url, F.lit("PATH"))
    game = F.try_parse_url(url, F.lit("QUERY"), F.lit("game"))
    # The hosts and address patterns of the known publishers.
    return (
        F.when((host == "www.lottery.ie") & (path == "/draw-games/results/view") & (game == "lotto"), "operator")
        .when((host == "irish.national-lottery.com") & path.rlike(r"^/irish-lotto/results-archive-\d{4}$"), "archive")
        .when((host == "irish.national-lottery.com") & path.rlike(r"^/irish-lotto/results-\d{2}-\d{2}-\d{4}$"), "detail")
        .when((host == "www.irishlottery.com") & path.rlike(r"^/(?:results/irish-lotto-)?results?-\d{2}-\d{2}-\d{4}$"), "detail")
        .when((host == "www.lotto.net") & path.rlike(r"^/irish-lotto/results/\d{4}$"), "year_archive")
        .when(host == "www.lotto.net", "year_detail")
    )
