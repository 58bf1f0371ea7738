"""Leakage-safe features: every frame ends one row before the target.

A series is (game, rule_code). (game, draw_date) is unique in a canonical population, so a window
partition holds at most one row per calendar day; number-level windows add ``number`` to the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawloom.functions.scalars import holiday_array

SERIES = ["game", "rule_code"]
# Windows, cap and names of the features.
WINDOWS = (10, 25, 50, 100)
RECENCY_CAP = 100
FEATURE_COLUMNS = (
    *(f"freq_{w}" for w in WINDOWS),
    "recency",
    "never_seen",
    "lag_1",
    "lag_2",
    "lag_3",
    "lag_1_valid",
    "lag_2_valid",
    "lag_3_valid",
    "freq_10_minus_100",
    "smoothed_frequency",
    *(f"weekday_{d}" for d in range(7)),
    "days_since_prior",
)


def sequence_draws(draws: DataFrame) -> DataFrame:
    """Adds ``draw_idx`` (0-based), ``max_input_date`` and ``lag_k_valid``: no gap on the k links before the draw."""
    w = Window.partitionBy(*SERIES).orderBy("draw_date")
    out = (
        draws.withColumn("draw_idx", F.row_number().over(w) - 1)
        .withColumn("max_input_date", F.lag("draw_date").over(w))
        .withColumn("_gaps", F.sum(F.col("gap_before").cast("int")).over(w))
    )
    for k in (1, 2, 3):
        # Rows idx-k+1..idx carry the k links; their gap count is a difference of running counts.
        clear = F.col("_gaps") == F.lag("_gaps", k).over(w)
        out = out.withColumn(f"lag_{k}_valid", F.coalesce(clear, F.lit(False)).cast("int"))
    return out.drop("_gaps")


def number_hits(sequenced: DataFrame) -> DataFrame:
    """One row per draw and number of the pool with a 0/1 ``hit``. Stays lazy; no join is needed."""
    return sequenced.withColumn("number", F.explode(F.sequence(F.lit(1), F.col("pool")))).withColumn(
        "hit", F.array_contains("mains", F.col("number")).cast("int")
    )


def feature_table(draws: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The 22 feature columns and the label per target draw and number; targets without history are absent."""
    base = [*SERIES, "draw_idx", "draw_date", "max_input_date", "pool", *keep]
    valid = [f"lag_{k}_valid" for k in (1, 2, 3)]
    hits = number_hits(sequence_draws(draws)).select(*base, *valid, "number", "hit")
    w = Window.partitionBy(*SERIES, "number").orderBy("draw_idx")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    last_seen = F.last(F.when(F.col("hit") == 1, F.col("draw_idx")), ignorenulls=True).over(past)
    counted = hits.select(
        "*",
        last_seen.alias("_last"),
        F.coalesce(F.sum("hit").over(past), F.lit(0)).alias("_count"),
        *[F.lag("hit", k).over(w).alias(f"_lag_{k}") for k in (1, 2, 3)],
    )

    # A rolling mean is a difference of running counts: one addition per row instead of a frame of w rows.
    def rolling(n):
        recent = F.col("_count") - F.coalesce(F.lag("_count", n).over(w), F.lit(0))
        return F.try_divide(recent, F.least(F.lit(n), F.col("draw_idx"))).alias(f"freq_{n}")

    framed = counted.select("*", *[rolling(n) for n in WINDOWS]).filter("draw_idx >= 1")
    recency = F.least(F.col("draw_idx") - F.col("_last"), F.lit(RECENCY_CAP))
    return framed.select(
        *base,
        "number",
        "hit",
        *[f"freq_{n}" for n in WINDOWS],
        F.coalesce(recency, F.lit(RECENCY_CAP)).cast("double").alias("recency"),
        F.col("_last").isNull().cast("double").alias("never_seen"),
        *[
            F.when(F.col(f"lag_{k}_valid") == 1, F.col(f"_lag_{k}")).otherwise(0).cast("double").alias(f"lag_{k}")
            for k in (1, 2, 3)
        ],
        *[F.col(v).cast("double").alias(v) for v in valid],
        (F.col("freq_10") - F.col("freq_100")).alias("freq_10_minus_100"),
        smoothed(F.col("_count"), F.col("draw_idx"), F.col("pool")).alias("smoothed_frequency"),
        *[(F.weekday("draw_date") == d).cast("double").alias(f"weekday_{d}") for d in range(7)],
        F.datediff("draw_date", "max_input_date").cast("double").alias("days_since_prior"),
    )


def smoothed(count: Column, draws: Column, pool: Column) -> Column:
    return (count + F.lit(6.0) / pool) / (draws + 1)


def frequency_marginals(draws: DataFrame) -> DataFrame:
    """Smoothed share of each number over the whole history of a series (two partial aggregations)."""
    sizes = draws.groupBy(*SERIES).agg(F.count("*").alias("draws"), F.max("pool").alias("pool"))
    seen = draws.select(*SERIES, F.explode("mains").alias("number")).groupBy(*SERIES, "number").agg(F.count("*").alias("count"))
    spine = sizes.withColumn("number", F.explode(F.sequence(F.lit(1), F.col("pool"))))
    return (
        spine.join(seen, [*SERIES, "number"], "left")
        .withColumn("count", F.coalesce("count", F.lit(0)))
        .withColumn("marginal", smoothed(F.col("count"), F.col("draws"), F.col("pool")))
    )


def next_target_features(draws: DataFrame, targets: DataFrame) -> DataFrame:
    """Features for a coming draw of each series: the target is appended as a row with no numbers."""
    blank = targets.select(*SERIES, "draw_date", "pool", F.array().cast("array<int>").alias("mains"), "gap_before")
    known = draws.select(*SERIES, "draw_date", "pool", "mains", "gap_before")
    both = known.withColumn("_next", F.lit(False)).unionByName(blank.withColumn("_next", F.lit(True)))
    return feature_table(both, keep=("_next",)).filter("_next").drop("_next", "hit")


# --- draw-level context --------------------------------------------------------

# Names of the context groups and their columns.
CONTEXT_GROUPS = {
    "jackpot": ("jackpot_log10", "rollovers", "days_since_jackpot_won"),
    "holiday": ("days_to_holiday", "holiday_window"),
    "prize": ("prev_match3_winners_log10", "prev_match4_prize_log10", "prev_match5_prize_log10"),
}


def _log10(value: Column) -> Column:
    return F.when(value > 0, F.log10(value.cast("double")))


def holiday_table(years: DataFrame) -> DataFrame:
    """(year, holidays of the year before, of it and after it) for a table of distinct years."""
    around = F.concat(*[holiday_array(F.col("year") + shift) for shift in (-1, 0, 1)])
    return years.select("year", around.alias("holidays"))


def days_to_holiday(draws: DataFrame) -> DataFrame:
    """Adds the distance in days to the nearest public holiday; holidays are computed once per year."""
    dated = draws.withColumn("year", F.year("draw_date"))
    table = holiday_table(dated.select("year").distinct())
    gaps = F.transform("holidays", lambda h: F.abs(F.datediff(h, F.col("draw_date"))))
    return dated.join(table, "year").withColumn("days_to_holiday", F.array_min(gaps)).drop("year", "holidays")


def context_table(draws: DataFrame, prizes: DataFrame, jackpots: DataFrame, groups=tuple(CONTEXT_GROUPS)) -> DataFrame:
    """Context known before each draw, zero where missing, plus one shared ``context_missing`` flag.

    ``prizes`` has (game, draw_date, tier, winners, amount); ``jackpots`` the advertised amount per draw.
    """
    wanted = ("Match 3", "Match 4", "Match 5", "Match 6")

    def pick(tier, column):
        return F.max(F.when(F.col("tier") == tier, F.col(column)))

    wide = (
        prizes.filter(F.col("tier").isin(*wanted))
        .groupBy("game", "draw_date")
        .agg(
            pick("Match 6", "winners").alias("_won"),
            pick("Match 3", "winners").alias("_m3"),
            pick("Match 4", "amount").alias("_m4"),
            pick("Match 5", "amount").alias("_m5"),
        )
    )
    key = ["game", "draw_date"]
    w = Window.partitionBy(*SERIES).orderBy("draw_date")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("_won") > 0
    rows = (
        draws.join(wide, key, "left")
        .join(jackpots.select(*key, "jackpot"), key, "left")
        .withColumn("draw_idx", F.row_number().over(w) - 1)
        .withColumn("_unknown_at", F.max(F.when(F.col("_won").isNull(), F.col("draw_idx"))).over(past))
        .withColumn("_win_at", F.max(F.when(won, F.col("draw_idx"))).over(past))
        .withColumn("_win_day", F.max(F.when(won, F.col("draw_date"))).over(past))
        .withColumn("prev_match3_winners_log10", _log10(F.lag("_m3").over(w)))
        .withColumn("prev_match4_prize_log10", _log10(F.lag("_m4").over(w)))
        .withColumn("prev_match5_prize_log10", _log10(F.lag("_m5").over(w)))
    )
    broken = F.coalesce(F.col("_unknown_at") > F.coalesce("_win_at", F.lit(-1)), F.lit(False))
    rolled = F.col("draw_idx") - F.coalesce("_win_at", F.lit(-1)) - 1
    rows = (
        days_to_holiday(rows)
        .withColumn("jackpot_log10", _log10(F.col("jackpot")))
        .withColumn("rollovers", F.when(~broken, rolled).cast("double"))
        .withColumn("days_since_jackpot_won", F.when(~broken, F.datediff("draw_date", "_win_day")).cast("double"))
        .withColumn("holiday_window", (F.col("days_to_holiday") <= 3).cast("double"))
    )
    names = [c for g in groups for c in CONTEXT_GROUPS[g]]
    missing = F.greatest(*[F.col(c).isNull().cast("int") for c in names])
    return rows.select(
        *SERIES,
        "draw_idx",
        "draw_date",
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names],
        missing.cast("double").alias("context_missing"),
    )


# --- splits ---------------------------------------------------------------------


def protocol_splits(draws: DataFrame, start: int = 175, block: int = 25, partial: int = 10, minimum: int = 282) -> DataFrame:
    """Chronological roles: the last fifth is holdout; validation blocks run from ``start`` up to it."""
    series = Window.partitionBy(*SERIES)
    w = series.orderBy("draw_date")
    out = draws.withColumn("draw_idx", F.row_number().over(w) - 1).withColumn("population", F.count("*").over(series))
    development = F.col("population") - F.ceil(F.col("population") / 5)
    out = out.withColumn("development", development.cast("long"))
    fold = F.floor((F.col("draw_idx") - start) / block)
    size = F.least(F.lit(block), F.col("development") - (F.lit(start) + fold * block))
    full_blocks = F.floor((F.col("development") - start) / block)
    inside = (F.col("draw_idx") >= start) & (F.col("draw_idx") < F.col("development"))
    kept = inside & ((size == block) | (size >= partial))
    role = F.when(F.col("draw_idx") >= F.col("development"), "holdout").when(kept, "validation").when(inside, "unused")
    return out.select(
        *SERIES,
        "draw_date",
        "draw_idx",
        "population",
        F.when(kept, fold).cast("int").alias("fold_id"),
        F.coalesce(role, F.lit("history")).alias("role"),
        ((F.col("population") >= minimum) & (full_blocks >= 2)).alias("sufficient"),
    )


def study_splits(draws: DataFrame, evaluation_days: int = 1826, block: int = 25, tuning_blocks: int = 4, warmup: int = 150) -> DataFrame:
    """Evaluation = draws within ``evaluation_days`` of the last; tuning = the blocks just before; plus refit block ids."""
    series = Window.partitionBy(*SERIES)
    w = series.orderBy("draw_date")
    cutoff = F.date_sub(F.max("draw_date").over(series), evaluation_days)
    out = draws.withColumn("draw_idx", F.row_number().over(w) - 1).withColumn("_eval", F.col("draw_date") > cutoff)
    first = F.min(F.when(F.col("_eval"), F.col("draw_idx"))).over(series)
    out = out.withColumn("evaluation_start", first).withColumn("tuning_start", first - tuning_blocks * block)
    idx = F.col("draw_idx")
    role = (
        F.when(F.col("_eval"), "evaluation")
        .when(idx >= F.col("tuning_start"), "tuning")
        .when(idx >= warmup, "training")
        .otherwise("warmup")
    )
    start = F.when(F.col("_eval"), F.col("evaluation_start")).when(idx >= F.col("tuning_start"), F.col("tuning_start"))
    return out.select(
        *SERIES,
        "draw_date",
        "draw_idx",
        "evaluation_start",
        "tuning_start",
        role.alias("role"),
        F.floor((idx - start) / block).cast("int").alias("block_id"),
        (F.col("tuning_start") - warmup >= block).alias("sufficient"),
    )


def training_rows(features: DataFrame, block_start: int, warmup: int = 150, window: int | None = None) -> DataFrame:
    """Supervised rows a model fitted at ``block_start`` may see: warm-up cut, optionally only the last targets."""
    first = warmup if window is None else max(warmup, block_start - window)
    return features.filter((F.col("draw_idx") >= first) & (F.col("draw_idx") < block_start))


def training_windows(features: DataFrame, blocks: DataFrame, warmup: int = 150, window: int | None = None) -> DataFrame:
    """All blocks at once: (block_start, row) pairs; ``blocks`` has one row per series and block start."""
    first = F.lit(warmup) if window is None else F.greatest(F.lit(warmup), F.col("block_start") - window)
    spans = blocks.select(*SERIES, "block_start", first.alias("_first"))
    on = features.join(spans, SERIES)
    return on.filter((F.col("draw_idx") >= F.col("_first")) & (F.col("draw_idx") < F.col("block_start"))).drop("_first")


def pool_regimes(features: DataFrame, studied: str, earlier: list[str], warmup: int = 150) -> DataFrame:
    """Rows of earlier regimes that end before the studied one starts, added with their base rate."""
    begins = features.filter(F.col("rule_code") == studied).groupBy("game").agg(F.min("draw_date").alias("_begins"))
    ends = (
        features.filter(F.col("rule_code").isin(*earlier)).groupBy("game", "rule_code").agg(F.max("draw_date").alias("_ends"))
    )
    usable = ends.join(begins, "game").filter("_ends < _begins").select("game", "rule_code")
    past = features.join(usable, ["game", "rule_code"], "left_semi")
    both = features.filter(F.col("rule_code") == studied).unionByName(past).filter(F.col("draw_idx") >= warmup)
    return both.withColumn("base_rate", F.lit(6.0) / F.col("pool"))
