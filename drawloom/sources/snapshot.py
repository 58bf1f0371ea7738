"""Readers and the verification of a published snapshot (a folder of Parquet tables named by its fingerprint).

Tables of a snapshot: ``draws`` (game, rule_code, draw_date, mains, bonus, observation_key), ``missing_days``,
``enrichment``, ``rules`` (game, code, starts_on, ends_on, pool, verified, artifact_sha256), ``lineage``
(observation_key, draw_date, mains, artifact_sha256) and ``evidence`` (artifact_sha256).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawloom.operators.intervals import mark_gaps
from drawloom.operators.validate import bonus_ok, mains_ok, reasons
from drawloom.sources import sinks


def read(spark: SparkSession, root: str, digest: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{digest}/{table}")


def draw_violations(draws: DataFrame, rules: DataFrame, lineage: DataFrame, evidence: DataFrame) -> DataFrame:
    """(part, item, reason) of draws that their snapshot does not carry.

    A draw needs one verified rule of its code that covers its date and whose evidence is present, valid numbers in
    that rule's pool, an observation of equal date and numbers with evidence present, and a date of its own in its
    game (dates are then strictly increasing in date order). Null keys count as absent. A draw with several faults
    has a row for each. Repeated rows of ``rules``, ``lineage`` or ``evidence`` count once; an observation key with
    unequal rows, or a rule code with several rules, is a fault of its draws.
    """
    shown = evidence.select("artifact_sha256").distinct()

    def with_evidence(df):
        return df.join(shown.withColumn("_shown", F.lit(True)), "artifact_sha256", "left").withColumn("_shown", F.coalesce("_shown", F.lit(False)))

    rule = with_evidence(rules.select("game", "code", "starts_on", "ends_on", "pool", "verified", "artifact_sha256").distinct())
    ruled = rule.groupBy("game", F.col("code").alias("rule_code")).agg(
        F.count("*").alias("_rules"), *[F.min(c).alias(f"_{c.strip('_')}") for c in ("starts_on", "ends_on", "pool", "verified")], F.min("_shown").alias("_rule_shown")
    )
    seen = with_evidence(lineage.select("observation_key", F.col("draw_date").alias("_date"), F.array_sort("mains").alias("_mains"), "artifact_sha256").distinct())
    observed = seen.groupBy("observation_key").agg(
        F.count("*").alias("_seen"), F.min("_date").alias("_date"), F.min("_mains").alias("_mains"), F.min("_shown").alias("_seen_shown")
    )
    repeated = draws.groupBy("game", "draw_date").agg(F.count("*").alias("_n")).filter("_n > 1")
    rows = (
        draws.select("game", "rule_code", "draw_date", "mains", "bonus", "observation_key")
        .join(ruled, ["game", "rule_code"], "left")
        .join(observed, "observation_key", "left")
        .join(repeated, ["game", "draw_date"], "left")
    )
    day, mains, pool = F.col("draw_date"), F.col("mains"), F.col("_pool")
    covered = (F.col("_rules") == 1) & (F.col("_starts_on") <= day) & (F.col("_ends_on").isNull() | (day <= F.col("_ends_on")))
    found = reasons(
        no_covering_rule=~F.coalesce(covered, F.lit(False)),
        unverified_rule=~F.coalesce(F.col("_verified") & F.col("_rule_shown"), F.lit(False)),
        invalid_numbers=~F.coalesce(mains_ok(mains, F.coalesce(pool, F.lit(99))) & bonus_ok(mains, F.col("bonus"), F.coalesce(pool, F.lit(99))), F.lit(False)),
        no_observation=F.col("_seen").isNull(),
        observation_differs=F.coalesce((F.col("_seen") > 1) | (F.col("_date") != day) | (F.col("_mains") != F.array_sort(mains)), F.lit(False)),
        no_evidence=F.coalesce(~F.col("_seen_shown"), F.lit(False)),
        repeated_date=F.col("_n").isNotNull() | day.isNull(),
    )
    item = F.concat_ws(":", "game", day.cast("string"))
    return rows.select(F.lit("draws").alias("part"), item.alias("item"), F.explode(found).alias("reason"))


def content_violations(spark: SparkSession, root: str, digest: str) -> DataFrame:
    """(part, item, reason) of table digests and counts that differ, of a snapshot without draws, and of its draws."""
    draws, *rest = [read(spark, root, digest, t) for t in ("draws", "rules", "lineage", "evidence")]
    digests = sinks.verify_snapshot(spark, root, digest).select(F.col("table").alias("part"), F.col("table").alias("item"), F.lit("content_differs").alias("reason"))
    none = draws.agg(F.count("*").alias("n")).filter("n = 0")
    empty = none.select(F.lit("draws").alias("part"), F.lit("draws").alias("item"), F.lit("no_draws").alias("reason"))
    return digests.unionByName(empty).unionByName(draw_violations(draws, *rest))


def violations(spark: SparkSession, root: str, digest: str) -> DataFrame:
    """All faults of a published snapshot, by file and by row; empty if it is intact."""
    return sinks.verify_files(spark, root, digest).unionByName(content_violations(spark, root, digest))


def require_intact(spark: SparkSession, root: str, digest: str) -> None:
    """Refuses a snapshot with any violation. Files come first: a damaged one may not be readable as a table."""
    for faults in (sinks.verify_files, content_violations):
        first = faults(spark, root, digest).first()
        if first is not None:
            raise ValueError(f"Snapshot {digest} is damaged: {first['part']}, {first['item']}: {first['reason']}")


def load_population(spark: SparkSession, root: str, digest: str, rule_code: str) -> DataFrame:
    """Draws of one regime with ``gap_before``, after verification; the filter is a row-group predicate of the scan."""
    require_intact(spark, root, digest)
    draws = read(spark, root, digest, "draws").filter(F.col("rule_code") == rule_code)
    return mark_gaps(draws, read(spark, root, digest, "missing_days"))


def load_context(spark: SparkSession, root: str, digest: str) -> DataFrame:
    """Jackpot and a map tier -> (winners, amount) per draw date, after verification."""
    require_intact(spark, root, digest)
    rows = read(spark, root, digest, "enrichment")
    tier = F.when(F.col("kind") == "prize", F.struct("tier", F.struct("winners", "amount").alias("v")))
    entries = F.array_sort(F.collect_list(tier))  # at most one entry per prize tier
    return rows.groupBy("game", "draw_date").agg(
        F.max(F.when(F.col("kind") == "context", F.col("amount"))).alias("jackpot"),
        F.map_from_entries(entries).alias("prizes"),
    )
