"""Interval dimensions, calendars and continuity.

Range joins are rewritten as equi-joins on a coarse time bin plus the exact predicate, so Spark can
hash, sort-merge or (when its own size statistics allow) broadcast them, and AQE can split a hot game.
Windows here are partitioned by game and ordered by day: (game, day) is unique after the group-by, so a
partition holds at most one row per calendar day, whatever the size of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Years outside this range share the edge bins; the exact predicate is checked after the join.
FIRST_BIN, LAST_BIN = 1900, 2100


def _bin(day: Column) -> Column:
    return F.greatest(F.lit(FIRST_BIN), F.least(F.lit(LAST_BIN), F.year(day)))


def attach_rule(facts: DataFrame, rules: DataFrame, day: str = "draw_date") -> DataFrame:
    """Facts plus ``rule_count`` and, when exactly one rule covers the day, its code, pool and schedule.

    The rule dimension is folded to one row per (game, year bin) holding the rules that touch the year, so
    the facts need a single equi-join without fan-out; the day itself is tested inside the row.
    """
    last = F.coalesce(_bin(F.col("ends_on")), F.lit(LAST_BIN))
    first = _bin(F.col("starts_on"))
    rule = F.struct("code", "starts_on", "ends_on", "pool", "schedule")
    usable = rules.filter(F.coalesce(F.col("starts_on") <= F.col("ends_on"), F.lit(True)))
    by_year = (
        usable.select("game", F.explode(F.sequence(first, last)).alias("_bin"), rule.alias("r"))
        .groupBy("game", "_bin")
        .agg(F.collect_list("r").alias("_rules"))
    )
    joined = facts.withColumn("_bin", _bin(F.col(day))).join(by_year, ["game", "_bin"], "left")

    def covers(r):
        return (r["starts_on"] <= F.col(day)) & (r["ends_on"].isNull() | (F.col(day) <= r["ends_on"]))

    found = joined.withColumn("_hit", F.filter("_rules", covers))
    count = F.coalesce(F.size("_hit"), F.lit(0))
    only = F.when(count == 1, F.get("_hit", F.lit(0)))
    return found.select(
        *facts.columns,
        F.greatest(count, F.lit(0)).alias("rule_count"),
        only["code"].alias("rule_code"),
        only["pool"].alias("pool"),
        only["schedule"].alias("schedule"),
    )


def overlapping_rules(rules: DataFrame) -> DataFrame:
    """Pairs of rules of one game whose intervals overlap, each pair once.

    A rule is laid into the years it touches, open ends up to the game's last start, and a pair is taken in the year of
    its later start: an equi-join on game and year instead of all pairs of a game. A rule without a start meets nothing.
    """
    far = F.lit("9999-12-31").cast("date")
    last = rules.groupBy("game").agg(F.max("starts_on").alias("_last"))
    start = F.year("starts_on")
    years = F.sequence(start, F.greatest(start, F.year(F.least(F.coalesce("ends_on", "_last"), "_last"))))
    spread = rules.join(last, "game").select("game", "code", "starts_on", F.coalesce("ends_on", far).alias("ends_on"), F.explode(years).alias("_year"))
    a, b = spread.alias("a"), spread.alias("b")
    later = F.greatest("a.starts_on", "b.starts_on")
    meets = (F.col("a.starts_on") <= F.col("b.ends_on")) & (F.col("b.starts_on") <= F.col("a.ends_on"))
    once = (F.col("a.code") < F.col("b.code")) & (F.year(later) == F.col("a._year"))
    return a.join(b, (F.col("a.game") == F.col("b.game")) & (F.col("a._year") == F.col("b._year")) & once & meets).select(
        F.col("a.game").alias("game"), F.col("a.code").alias("code_a"), F.col("b.code").alias("code_b")
    )


def day_spine(ranges: DataFrame) -> DataFrame:
    """(game, day) for every day of each game's [start, end]; an inverted range gives no rows."""
    days = F.sequence(F.col("start"), F.col("end"), F.expr("interval 1 day"))
    return ranges.filter(F.col("start") <= F.col("end")).select("game", F.explode(days).alias("day"))


def event_overrides(events: DataFrame) -> DataFrame:
    """Reviewed events per day: the flag when all agree, and whether they conflict."""
    return events.groupBy("game", "day").agg(
        F.min("scheduled").alias("event_scheduled"),
        (F.min("scheduled") != F.max("scheduled")).alias("event_conflict"),
    )


def calendar(ranges: DataFrame, rules: DataFrame, events: DataFrame | None = None, empty_is_unknown: bool = True) -> DataFrame:
    """Day calendar with three-valued ``scheduled``: an event wins, then the one covering rule, else unknown."""
    days = day_spine(ranges)
    ruled = attach_rule(days, rules, "day")
    by_rule = F.array_contains("schedule", F.weekday("day"))
    if empty_is_unknown:
        by_rule = F.when(F.size("schedule") > 0, by_rule)
    ruled = ruled.withColumn("rule_scheduled", F.when(F.col("rule_count") == 1, by_rule))
    if events is None:
        out = ruled.withColumn("event_scheduled", F.lit(None).cast("boolean")).withColumn("event_conflict", F.lit(None).cast("boolean"))
    else:
        out = ruled.join(event_overrides(events), ["game", "day"], "left")
    return out.withColumn("scheduled", F.coalesce("event_scheduled", "rule_scheduled"))


def mark_observed(cal: DataFrame, draws: DataFrame) -> DataFrame:
    """Calendar plus whether a draw exists on the day."""
    seen = draws.select("game", F.col("draw_date").alias("day")).distinct().withColumn("_seen", F.lit(True))
    return cal.join(seen, ["game", "day"], "left").withColumn("observed", F.coalesce("_seen", F.lit(False))).drop("_seen")


def schedule_summary(observed_calendar: DataFrame) -> DataFrame:
    """Coverage per game: expected, observed, missing, unexpected and unknown days."""
    scheduled, observed = F.col("scheduled"), F.col("observed")
    missing, unexpected = scheduled & ~observed, ~scheduled & observed
    return observed_calendar.groupBy("game").agg(
        F.count_if(scheduled).alias("expected"),
        F.count_if(scheduled & observed).alias("eligible_observed"),
        F.count_if(missing).alias("missing"),
        F.min(F.when(missing, F.col("day"))).alias("first_missing"),
        F.max(F.when(missing, F.col("day"))).alias("last_missing"),
        F.count_if(unexpected).alias("unexpected"),
        F.count_if(scheduled.isNull()).alias("unknown_schedule_days"),
        F.count_if(scheduled.isNull() & observed).alias("eligible_on_unknown_days"),
        F.count_if(F.col("rule_count") > 1).alias("overlapping_rule_days"),
        F.count_if(F.coalesce("event_conflict", F.lit(False))).alias("conflicting_event_days"),
    )


def schedule_dates(observed_calendar: DataFrame) -> DataFrame:
    """(game, day, kind) of the days behind the counts: ``missing``, ``unexpected``, and days under ``overlapping_rules``.

    Days of unknown schedule are never missing. One row per day and kind, so a long list is never gathered.
    """
    scheduled, observed = F.col("scheduled"), F.col("observed")
    kinds = F.array_compact(F.array(
        F.when(scheduled & ~observed, "missing"), F.when(~scheduled & observed, "unexpected"), F.when(F.col("rule_count") > 1, "overlapping_rules")
    ))
    return observed_calendar.select("game", "day", F.explode(kinds).alias("kind"))


def mark_gaps(draws: DataFrame, missing_days: DataFrame) -> DataFrame:
    """``gap_before``: a missing scheduled day lies strictly between a draw and its predecessor.

    Missing days and draws are laid on one line per game; a running count of missing days differs
    between two neighbouring draws exactly when one lies between them. No range join is needed.
    """
    marks = missing_days.select("game", F.col("day").alias("draw_date")).distinct()
    line = draws.withColumn("_draw", F.lit(1)).unionByName(marks.withColumn("_draw", F.lit(0)), allowMissingColumns=True)
    by_day = Window.partitionBy("game").orderBy("draw_date", "_draw")
    counted = line.withColumn("_missing", F.sum(1 - F.col("_draw")).over(by_day)).filter("_draw = 1")
    series = Window.partitionBy("game", "rule_code").orderBy("draw_date")
    gap = F.col("_missing") > F.lag("_missing").over(series)
    return counted.withColumn("gap_before", F.coalesce(gap, F.lit(False))).drop("_draw", "_missing")


def mark_continuity(draws: DataFrame, cal: DataFrame) -> DataFrame:
    """``continuous_from_previous``: all days since the previous draw are known, and only this one was scheduled."""
    flags = cal.select(
        "game",
        F.col("day").alias("draw_date"),
        F.col("scheduled").alias("_scheduled"),
        F.lit(1).alias("_known_day"),
    )
    line = flags.join(draws.withColumn("_draw", F.lit(1)), ["game", "draw_date"], "full")
    running = Window.partitionBy("game").orderBy("draw_date")
    counted = (
        line.withColumn("_days", F.count("_known_day").over(running))
        .withColumn("_scheduled_days", F.count_if(F.col("_scheduled")).over(running))
        .withColumn("_unknown_days", F.count_if(F.col("_scheduled").isNull()).over(running))
        .filter("_draw = 1")
    )
    series = Window.partitionBy("game").orderBy("draw_date")

    def since(name):
        return F.col(name) - F.lag(name).over(series)

    continuous = (
        (F.lag("rule_code").over(series) == F.col("rule_code"))
        & (since("_days") == F.datediff("draw_date", F.lag("draw_date").over(series)))
        & (since("_unknown_days") == 0)
        & (since("_scheduled_days") == 1)
        & F.col("_scheduled")
    )
    return counted.withColumn("continuous_from_previous", F.coalesce(continuous, F.lit(False))).drop(
        "_draw", "_scheduled", "_known_day", "_days", "_scheduled_days", "_unknown_days"
    )
