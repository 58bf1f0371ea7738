"""Audit: rule bindings, eligibility, enrichment gate, counts and lineage selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawloom.operators import intervals
from drawloom.operators.validate import date_class, eligibility_reasons


def usable_evidence(artifacts: DataFrame) -> DataFrame:
    """Per (sha256, url): does any valid artifact have a body that checks?"""
    ok = (F.col("status") == "valid") & F.coalesce("body_ok", F.lit(False))
    return artifacts.groupBy("sha256", "url").agg(F.max(ok).alias("verified"))


def bind_rules(rules: DataFrame, bindings: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Rules with their reviewed binding: ``verified`` by evidence, ``binding_matches`` by address."""
    evidence = usable_evidence(artifacts).select(
        F.col("sha256").alias("artifact_sha256"), F.col("url").alias("source_url"), F.col("verified").alias("_ok")
    )
    bound = bindings.join(evidence, ["artifact_sha256", "source_url"], "left").select(
        "game", F.col("rule_code").alias("code"), "artifact_sha256", "source_url", F.coalesce("_ok", F.lit(False)).alias("_ok")
    )
    joined = rules.join(bound, ["game", "code"], "left")
    return joined.withColumn("verified", F.coalesce("_ok", F.lit(False))).withColumn(
        "binding_matches", F.coalesce(F.col("evidence_url") == F.col("source_url"), F.lit(False))
    ).drop("_ok")


def unknown_bindings(bindings: DataFrame, rules: DataFrame) -> DataFrame:
    """Bindings that name no known rule; must be empty."""
    return bindings.join(rules.select("game", F.col("code").alias("rule_code")), ["game", "rule_code"], "left_anti")


def rule_evidence(rules: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Rules with the hashes of all valid artifacts at their evidence address (null-free array, sorted)."""
    valid = artifacts.filter("status = 'valid'").select(F.col("url").alias("evidence_url"), "sha256").distinct()
    shas = F.array_sort(F.collect_set("sha256"))
    return rules.join(valid, "evidence_url", "left").groupBy("game", "code", "starts_on", "ends_on", "pool").agg(
        shas.alias("evidence_sha256")
    )


def assess_draws(draws: DataFrame, bound_rules: DataFrame) -> DataFrame:
    """Draws with every applicable exclusion reason.

    ``draws`` carries its recorded rule_code, the accepted observation (obs_*), evidence_ok and number_conflict.
    """
    recorded = bound_rules.select(
        "game",
        F.col("code").alias("rule_code"),
        "starts_on",
        "ends_on",
        "pool",
        F.col("verified").alias("rule_verified"),
        "binding_matches",
    )
    joined = draws.join(recorded, ["game", "rule_code"], "left")
    covers = (F.col("starts_on") <= F.col("draw_date")) & (F.col("ends_on").isNull() | (F.col("draw_date") <= F.col("ends_on")))
    return joined.withColumn("rule_covers", covers).withColumn("reasons", eligibility_reasons())


def exclusion_histogram(assessed: DataFrame) -> DataFrame:
    return assessed.select("game", F.explode("reasons").alias("reason")).groupBy("game", "reason").agg(F.count("*").alias("draws"))


def gate_enrichment(enrichment: DataFrame, eligible: DataFrame) -> DataFrame:
    """Enrichment of eligible dates only; ``kept`` is false where the evidence does not check."""
    dates = eligible.select("game", "draw_date").distinct()
    return enrichment.join(dates, ["game", "draw_date"], "left_semi").withColumn("kept", F.coalesce("evidence_ok", F.lit(False)))


def enrichment_counts(gated: DataFrame) -> DataFrame:
    kept = F.col("kept")
    return gated.groupBy("game").agg(
        F.count_if(kept).alias("enrichment_included"),
        F.count_if(kept & F.col("disputed")).alias("enrichment_disputed"),
        F.count_if(~kept).alias("unverifiable_evidence"),
    )


def audit_counts(assessed: DataFrame) -> DataFrame:
    fine = F.size("reasons") == 0
    return assessed.groupBy("game").agg(
        F.count("*").alias("canonical_candidates"), F.count_if(fine).alias("included"), F.count_if(~fine).alias("excluded")
    )


def staging_counts(observations: DataFrame, start: str, end: str) -> DataFrame:
    """Undated, malformed, staged and quarantined observations; ``date_text`` is the published date string."""
    kind = date_class(F.col("date_text"))
    in_range = F.col("date_text").between(start, end)
    return observations.groupBy(F.coalesce("game", F.lit("unknown")).alias("game")).agg(
        F.count_if(kind == "undated").alias("undated"),
        F.count_if(kind == "malformed").alias("malformed_date"),
        F.count_if((F.col("status") == "staged") & in_range).alias("staged_in_range"),
        F.count_if((F.col("status") == "quarantined") & in_range).alias("quarantined_in_range"),
    )


def full_audit(assessed: DataFrame, bound_rules: DataFrame, ranges: DataFrame, events: DataFrame, enrichment: DataFrame) -> DataFrame:
    """One row per game: counts, schedule coverage, warnings, blocking codes and ``snapshot_ready``."""
    eligible = assessed.filter(F.size("reasons") == 0)
    verified = bound_rules.filter("verified")
    cal = intervals.mark_observed(intervals.calendar(ranges, verified, events), eligible)
    coverage = intervals.schedule_summary(cal)
    unverified = bound_rules.groupBy("game").agg(F.count_if(~F.col("verified")).alias("_unverified"))
    enriched = enrichment_counts(gate_enrichment(enrichment, eligible))
    joined = (
        audit_counts(assessed).join(coverage, "game", "full").join(unverified, "game", "left").join(enriched, "game", "left")
    )
    warnings = F.array_compact(
        F.array(
            F.when(F.col("missing") > 0, "missing_scheduled_draws"),
            F.when(F.col("unknown_schedule_days") > 0, "unknown_schedule_days"),
            F.when(F.col("_unverified") > 0, "unverified_rules"),
        )
    )
    blocking = F.array_compact(
        F.array(
            F.when(F.col("conflicting_event_days") > 0, "conflicting_calendar_events"),
            F.when(F.col("overlapping_rule_days") > 0, "overlapping_rules"),
            F.when(F.col("unexpected") > 0, "unexpected_dates_require_reviewed_exception"),
            F.when(F.coalesce("included", F.lit(0)) == 0, "zero_eligible_draws"),
        )
    )
    coded = joined.withColumn("warnings", warnings).withColumn("blocking", blocking).drop("_unverified")
    return coded.withColumn("snapshot_ready", F.size("blocking") == 0)


def select_lineage(observations: DataFrame, draws: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Observations to keep: selected by a draw or by enrichment, or competing on a date of the population."""
    keys = (
        draws.select("observation_key").unionByName(enrichment.filter("kept").select("observation_key")).distinct()
    )
    dates = draws.select("game", "draw_date").distinct()
    by_key = observations.join(keys, "observation_key", "left_semi")
    by_date = observations.join(dates, ["game", "draw_date"], "left_semi")
    return by_key.unionByName(by_date).dropDuplicates(["observation_key"])


def needed_evidence(lineage: DataFrame, used_keys: DataFrame, bound_rules: DataFrame, events: DataFrame) -> DataFrame:
    """Distinct hashes a snapshot must carry: of used observations, verified rules and calendar events."""
    used = lineage.join(used_keys.select("observation_key"), "observation_key", "left_semi").select("artifact_sha256")
    ruled = bound_rules.filter("verified").select("artifact_sha256")
    return used.unionByName(ruled).unionByName(events.select("artifact_sha256")).distinct()
