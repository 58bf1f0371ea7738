"""Draw-level context derived from earlier draws: overlaps, streaks and prize values.

Windows run per game over canonical draws (one row per day at most).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drawloom.functions.scalars import adjacent_pairs, main_sum, odd_count, overlap

KEY = ["game", "draw_date"]


def face_values(prizes: DataFrame) -> DataFrame:
    """Winners x amount per currency, the cash-only EUR part and the number of tiers it rests on.

    A tier with any unknown among winners, amount and currency is skipped; no known cash tier means null, not 0.
    """
    known = prizes.filter("winners is not null and amount is not null and currency is not null")
    value = (F.col("winners") * F.col("amount")).cast("decimal(38,2)")
    cash = (F.col("currency") == "EUR") & (F.col("prize_type") == "cash")
    by_currency = known.groupBy(*KEY, "currency").agg(
        F.sum(value).alias("value"), F.sum(F.when(cash, value)).alias("cash"), F.count_if(cash).alias("tiers")
    )
    entries = F.array_sort(F.collect_list(F.struct("currency", "value")))  # one entry per currency
    return by_currency.groupBy(*KEY).agg(
        F.map_from_entries(entries).alias("face_values"),
        F.sum("cash").alias("cash_only_eur"),
        F.sum("tiers").alias("cash_known_tiers"),
    )


def without_open_conflicts(prizes: DataFrame, issues: DataFrame) -> DataFrame:
    """Prize tiers minus those with an open conflict."""
    open_tiers = issues.filter("kind = 'prize_conflict'").select(*KEY, "tier").distinct()
    return prizes.join(open_tiers, [*KEY, "tier"], "left_anti")


def previous_draw(draws: DataFrame) -> DataFrame:
    """Overlap with, and days since, the previous observed draw of the game."""
    w = Window.partitionBy("game").orderBy("draw_date")
    before = F.lag("mains").over(w)
    return draws.select(
        "*",
        F.when(before.isNotNull(), overlap(F.col("mains"), before)).alias("previous_overlap"),
        F.datediff("draw_date", F.lag("draw_date").over(w)).alias("days_since_previous"),
    )


def win_history(draws: DataFrame) -> DataFrame:
    """Last known win before each draw and the rollover streak.

    A streak is known from a win on, until an outcome is unknown or a link to the previous draw is not
    verified; then only a new win makes it known again. Written as three running maxima of positions.
    """
    w = Window.partitionBy("game").orderBy("draw_date")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    row = draws.withColumn("_i", F.row_number().over(w))

    def latest(test, frame):
        return F.max(F.when(test, F.col("_i"))).over(frame)

    won = F.col("outcome").eqNullSafe("Won")
    marked = (
        row.withColumn("_win", latest(won, past))
        .withColumn("_unknown", latest(F.col("outcome").isNull(), past))
        .withColumn("_break", latest(~F.coalesce("continuous_from_previous", F.lit(False)), upto))
        .withColumn("prior_known_win_date", F.max(F.when(won, F.col("draw_date"))).over(past))
    )
    known = (
        F.col("_win").isNotNull()
        & (F.coalesce("_unknown", F.lit(0)) < F.col("_win"))
        & (F.coalesce("_break", F.lit(0)) <= F.col("_win"))
    )
    return (
        marked.withColumn("prior_rollover_streak", F.when(known, F.col("_i") - 1 - F.col("_win")))
        .withColumn("days_since_prior_known_win", F.datediff("draw_date", "prior_known_win_date"))
        .drop("_i", "_win", "_unknown", "_break")
    )


def derive_context(draws: DataFrame, prizes: DataFrame) -> DataFrame:
    """The derived context table. ``draws`` carries outcome and continuous_from_previous."""
    described = draws.select(
        "*",
        main_sum(F.col("mains")).alias("main_sum"),
        odd_count(F.col("mains")).alias("odd_count"),
        adjacent_pairs(F.col("mains")).alias("adjacent_pairs"),
    )
    out = win_history(previous_draw(described)).join(face_values(prizes), KEY, "left")
    return out.withColumn("cash_known_tiers", F.coalesce("cash_known_tiers", F.lit(0)))


def duplicate_dates(draws: DataFrame) -> DataFrame:
    """Duplicate dates and non-increasing order per series; must be empty for a clean population."""
    return draws.groupBy("game", "rule_code", "draw_date").agg(F.count("*").alias("rows")).filter("rows > 1")
