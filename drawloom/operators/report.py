"""Coverage reports: counts with filters, all as partial aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def yearly_coverage(draws: DataFrame) -> DataFrame:
    return draws.groupBy(F.year("draw_date").alias("year"), "status").agg(
        F.count("*").alias("draws"), F.min("draw_date").alias("first"), F.max("draw_date").alias("last")
    )


def observation_coverage(observations: DataFrame) -> DataFrame:
    return observations.groupBy("source", "status", "game", F.year("draw_date").alias("year")).agg(
        F.count("*").alias("records"), F.min("draw_date").alias("first"), F.max("draw_date").alias("last")
    )


def missingness(df: DataFrame, fields: list[str], keys: list[str] = ()) -> DataFrame:
    counts = [F.count_if(F.col(f).isNull()).alias(f"missing_{f}") for f in fields]
    return df.groupBy(*keys).agg(F.count("*").alias("records"), *counts)


def with_flags(draws: DataFrame, prizes: DataFrame, context: DataFrame) -> DataFrame:
    """Draws with availability flags; each flag is a semi-join against distinct keys."""
    key = ["game", "draw_date"]

    def flag(df, name):
        return df.select(*key).distinct().withColumn(name, F.lit(True))

    clean = context.filter("not disputed")
    out = (
        draws.join(flag(prizes, "_p"), key, "left")
        .join(flag(clean.filter("jackpot is not null"), "_j"), key, "left")
        .join(flag(clean.filter("outcome is not null"), "_o"), key, "left")
    )
    return out.select(
        *draws.columns,
        F.col("bonus").isNotNull().alias("has_bonus"),
        *[F.col(c).isNotNull().alias(n) for c, n in (("_p", "has_prizes"), ("_j", "has_jackpot"), ("_o", "has_outcome"))],
    )


MANDATORY = ("dated_draws", "verified_rules", "prize_breakdowns", "jackpot_context")


def acquisition_status(flagged: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per game: counts by status, first and last accepted date, field coverage, outstanding inputs."""
    accepted = F.col("status") == "accepted"

    def count(test):
        return F.count_if(accepted & test)

    base = flagged.groupBy("game").agg(
        F.count_if(accepted).alias("accepted"),
        F.count_if(F.col("status") == "quarantined").alias("quarantined"),
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.min(F.when(accepted, F.col("draw_date"))).alias("first"),
        F.max(F.when(accepted, F.col("draw_date"))).alias("last"),
        *[count(F.col(f"has_{f}")).alias(f"with_{f}") for f in ("bonus", "prizes", "jackpot", "outcome")],
    )
    backed = rules.groupBy("game").agg(F.count("evidence_url").alias("backed_rules"))
    joined = base.join(backed, "game", "left").withColumn("backed_rules", F.coalesce("backed_rules", F.lit(0)))
    absent = dict(zip(MANDATORY, ("accepted", "backed_rules", "with_prizes", "with_jackpot")))
    outstanding = F.array_compact(F.array(*[F.when(F.col(c) == 0, name) for name, c in absent.items()]))
    return joined.withColumn("outstanding", outstanding)


def regime_profile(rules: DataFrame, draws: DataFrame) -> DataFrame:
    """Draw counts per regime; regimes without draws stay with zeros."""
    counts = draws.groupBy("game", F.col("rule_code").alias("code")).agg(
        F.count("*").alias("draws"),
        F.count_if(F.col("status") == "accepted").alias("accepted"),
        F.count_if(F.col("status") == "quarantined").alias("quarantined"),
    )
    joined = rules.join(counts, ["game", "code"], "left")
    return joined.select(
        "game", "code", "starts_on", "ends_on", "pool", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("draws", "accepted", "quarantined")]
    )


def open_issues(issues: DataFrame) -> DataFrame:
    return issues.filter("resolved_at is null").groupBy("kind").agg(F.count("*").alias("records"))


def inventory(datasets: dict[str, DataFrame]) -> DataFrame:
    """Record count and availability of every named dataset, empty ones included."""
    counted = [df.agg(F.count("*").alias("records")).withColumn("dataset", F.lit(name)) for name, df in datasets.items()]
    state = F.when(F.col("records") > 0, "collected").otherwise("not_collected_or_unavailable")
    return reduce(DataFrame.unionByName, counted).withColumn("availability", state)
