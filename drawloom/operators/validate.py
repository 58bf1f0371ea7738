"""Validation as columns: every rule adds a code to ``reasons``; a row is valid when it is empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_INTS = "array<int>"


def reasons(**checks: Column) -> Column:
    """Sorted array of the names whose check is true. An unknown (null) check does not fire."""
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()])))


def _six_distinct(mains: Column) -> Column:
    return (F.size(mains) == 6) & (F.size(F.array_distinct(mains)) == 6)


def _within(mains: Column, top: Column) -> Column:
    return F.forall(mains, lambda n: n.isNotNull() & (n >= 1) & (n <= top))


def mains_ok(mains: Column, pool: Column) -> Column:
    return F.coalesce(_six_distinct(mains) & _within(mains, pool), F.lit(False))


def bonus_ok(mains: Column, bonus: Column, pool: Column) -> Column:
    """A null bonus is unknown and therefore fine."""
    inside = (bonus >= 1) & (bonus <= pool) & ~F.array_contains(mains, bonus)
    return bonus.isNull() | F.coalesce(inside, F.lit(False))


def draw_valid(mains: Column, bonus: Column, pool: Column) -> Column:
    """Six distinct mains and an optional other bonus, all in 1..pool, for a pool of at least seven."""
    return F.coalesce(pool >= 7, F.lit(False)) & mains_ok(mains, pool) & bonus_ok(mains, bonus, pool)


def check_draws(df: DataFrame) -> DataFrame:
    mains, bonus, pool = F.col("mains"), F.col("bonus"), F.col("pool")
    return df.withColumn(
        "reasons",
        reasons(
            bonus_in_mains=F.array_contains(mains, bonus),
            bonus_outside_pool=(bonus < 1) | (bonus > pool),
            duplicate_mains=F.size(F.array_distinct(mains)) < F.size(mains),
            mains_outside_pool=~_within(mains, pool),
            not_six_mains=F.size(mains) != 6,
            small_pool=pool < 7,
        ),
    )


def source_url_ok(url: Column) -> Column:
    """http(s) with a host, or an absolute local ``file:`` path; no whitespace and no credentials."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(authority, r":\d*$", "")
    web = url.rlike(r"(?i)^https?://") & (host != "")
    local = url.rlike(r"(?i)^file:///[^?#]") | url.rlike(r"(?i)^file://localhost/[^?#]")
    return F.coalesce(~url.rlike(r"\s") & ~authority.contains("@") & (web | local), F.lit(False))


def prizes_ok(prizes: Column) -> Column:
    return F.forall(
        prizes,
        lambda p: F.coalesce(p["winners"] >= 0, F.lit(True)) & F.coalesce(p["amount"] >= 0, F.lit(True)),
    )


def check_observations(df: DataFrame) -> DataFrame:
    """Observation rules: numbers in 1..99, unique tiers, non-negative money, identified source; mains get sorted."""
    mains, bonus = F.col("mains"), F.col("bonus")
    prizes = F.coalesce(F.col("prizes"), F.array().cast(df.schema["prizes"].dataType))
    tiers = F.transform(prizes, lambda p: p["tier"])
    return df.withColumn(
        "reasons",
        reasons(
            bad_mains=~mains_ok(mains, F.lit(99)),
            bad_bonus=~bonus_ok(mains, bonus, F.lit(99)),
            bad_outcome=~F.col("outcome").isin("Won", "Roll"),
            bad_source=~source_url_ok(F.col("source_url")),
            duplicate_tiers=F.size(F.array_distinct(tiers)) < F.size(tiers),
            negative_jackpot=F.col("jackpot") < 0,
            negative_prize=~prizes_ok(prizes),
        ),
    ).withColumn("mains", F.array_sort(mains))


def check_undated(df: DataFrame) -> DataFrame:
    """Numbers known by period only: sorted mains must equal the sorted published order."""
    mains = F.col("mains")
    return df.withColumn(
        "reasons",
        reasons(
            bad_mains=~mains_ok(mains, F.col("pool")),
            not_sorted=mains != F.array_sort(mains),
            differs_from_source=F.array_sort("source_numbers") != mains,
            bad_period=F.col("period_start") > F.col("period_end"),
        ),
    )


def check_artifacts(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "reasons",
        reasons(
            bad_hash=~F.col("sha256").rlike("^[0-9a-f]{64}$"),
            bad_status=~F.col("status").isin("valid", "blocked", "invalid", "error"),
            bad_url=~source_url_ok(F.col("url")),
            missing_time=F.col("retrieved_at").isNull(),
        ),
    )


# Keys each curated dataset must carry, and keys naming a private person.
CURATED_KEYS = {
    "rule_attributes": ("effective_from", "effective_to", "attribute", "value"),
    "calendar_events": ("day", "scheduled", "description"),
    "winning_ticket_reports": ("draw_date", "channel", "location_meaning"),
    "official_period_metrics": ("period_start", "period_end", "game_scope", "metric", "value", "unit"),
}
CURATED_DATES = ("effective_from", "effective_to", "day", "draw_date", "period_start", "period_end", "claim_date")
PRIVATE_KEYS = ("person_name", "player_name", "address", "email")


def private_fields(payload: Column) -> Column:
    return F.arrays_overlap(F.json_object_keys(payload), F.array(*map(F.lit, PRIVATE_KEYS)))


def check_curated(df: DataFrame) -> DataFrame:
    """Rules of the curated facts, chosen by dataset; the payload stays a JSON string."""
    payload, dataset = F.col("payload"), F.col("dataset")
    keys = F.json_object_keys(payload)

    def text(name):
        return F.get_json_object(payload, f"$.{name}")

    def iso(name):
        return F.when(text(name).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text(name), "yyyy-MM-dd"))

    required = F.coalesce(
        *[
            F.when(dataset == name, F.size(F.array_except(F.array(*map(F.lit, wanted)), keys)) > 0)
            for name, wanted in CURATED_KEYS.items()
        ]
    )
    bad_date = F.lit(False)
    for name in CURATED_DATES:
        bad_date = bad_date | (text(name).isNotNull() & iso(name).isNull())
    rule, metric = dataset == "rule_attributes", dataset == "official_period_metrics"
    ticket, event = dataset == "winning_ticket_reports", dataset == "calendar_events"
    # Places of a ticket report.
    places = ("purchase_county", "online_player_county", "unresolved")
    return df.withColumn(
        "reasons",
        reasons(
            unknown_dataset=~dataset.isin(*CURATED_KEYS),
            empty_key=F.length("record_key") < 1,
            missing_keys=required,
            bad_date=bad_date,
            bad_interval=(rule & (iso("effective_from") > iso("effective_to")))
            | (metric & (iso("period_start") > iso("period_end"))),
            bad_value=metric & text("value").try_cast("decimal(38,10)").isNull(),
            scheduled_not_boolean=event & ~F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(payload), "$.scheduled", "variant")) == "BOOLEAN", F.lit(False)),
            private_field=ticket & private_fields(payload),
            bad_channel=ticket & ~text("channel").isin("retail", "online"),
            bad_location=ticket & ~text("location_meaning").isin(*places),
            online_county=ticket & (text("channel") == "online") & (text("location_meaning") == "purchase_county"),
        ),
    )


def check_rules(df: DataFrame) -> DataFrame:
    """Rule definitions: pool, interval, weekdays, and a code used once per game."""
    repeated = df.groupBy("game", "code").agg(F.count("*").alias("uses"))
    schedule = F.col("schedule")
    return (
        df.join(repeated, ["game", "code"])
        .withColumn(
            "reasons",
            reasons(
                bad_interval=F.col("ends_on") < F.col("starts_on"),
                bad_weekday=~F.forall(schedule, lambda d: (d >= 0) & (d <= 6)),
                duplicate_code=F.col("uses") > 1,
                duplicate_weekday=F.size(F.array_distinct(schedule)) < F.size(schedule),
                empty_code=F.length("code") < 1,
                small_pool=F.col("pool") < 7,
            ),
        )
        .drop("uses")
    )


def check_bindings(df: DataFrame) -> DataFrame:
    """Reviewed rule bindings: one per rule code, hex hash, and a usable source address."""
    uses = df.groupBy("game", "rule_code").agg(F.count("*").alias("uses"))
    return (
        df.join(uses, ["game", "rule_code"])
        .withColumn(
            "reasons",
            reasons(
                bad_hash=~F.col("artifact_sha256").rlike("^[0-9a-f]{64}$"),
                bad_source=~source_url_ok(F.col("source_url")),
                duplicate_code=F.col("uses") > 1,
            ),
        )
        .drop("uses")
    )


def date_class(text: Column) -> Column:
    """``undated`` when absent, ``malformed`` when not ISO, ``impossible`` when no such day, else ``dated``."""
    return (
        F.when(text.isNull(), "undated")
        .when(~text.rlike(r"^\d{4}-\d{2}-\d{2}$"), "malformed")
        .when(F.try_to_date(text, "yyyy-MM-dd").isNull(), "impossible")
        .otherwise("dated")
    )


def eligibility_reasons() -> Column:
    """All exclusion codes of a canonical draw joined to its rule, evidence and accepted observation.

    Expects: status, mains, bonus, pool, game, draw_date, obs_game, obs_date, obs_mains, obs_bonus,
    has_observation, number_conflict, rule_verified, rule_covers, binding_matches, evidence_ok.
    """
    mains, bonus, pool = F.col("mains"), F.col("bonus"), F.col("pool")

    def false_or_unknown(name):
        return ~F.coalesce(F.col(name), F.lit(False))

    differs = (
        ~F.coalesce(F.col("has_observation"), F.lit(False))
        | ~F.col("obs_game").eqNullSafe(F.col("game"))
        | ~F.col("obs_date").eqNullSafe(F.col("draw_date"))
        | (F.array_sort(F.coalesce("obs_mains", F.array().cast(NO_INTS))) != F.array_sort(mains))
        | (F.col("obs_bonus").isNotNull() & ~F.col("obs_bonus").eqNullSafe(bonus))
    )
    return reasons(
        invalid_status=F.col("status") != "accepted",
        invalid_mains=~mains_ok(mains, pool),
        invalid_bonus=~bonus_ok(mains, bonus, pool),
        observation_mismatch=differs,
        number_conflict=F.coalesce("number_conflict", F.lit(False)),
        unverified_rule=false_or_unknown("rule_verified"),
        rule_mismatch=false_or_unknown("rule_covers") | false_or_unknown("binding_matches"),
        invalid_evidence=false_or_unknown("evidence_ok"),
    )


def leakage_violations(lines: DataFrame) -> DataFrame:
    """Issued lines that break input cutoff, index range or the six-number rule; must be empty."""
    return lines.withColumn(
        "reasons",
        reasons(
            late_input=F.col("max_input_date") >= F.col("target_date"),
            index_out_of_range=F.col("line_index") >= F.col("budget"),
            not_six=~_six_distinct(F.col("mains")),
        ),
    ).filter(F.size("reasons") > 0)


def portfolio_check(lines: DataFrame, keys: list[str]) -> DataFrame:
    """One row per portfolio: complete means exactly ``budget`` distinct valid lines."""
    text = F.array_join(F.array_sort("mains"), " ")
    return lines.groupBy(*keys).agg(
        F.count("*").alias("lines"),
        F.countDistinct(text).alias("distinct_lines"),
        F.min(mains_ok(F.col("mains"), F.col("pool")).cast("int")).alias("numbers_ok"),
    )
