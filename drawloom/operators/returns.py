"""Prize market per regime and the expected return of playing plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawloom.functions.scalars import TIERS, jackpot_share, tier_probability

# The prizes that a jackpot report names.
BIG_PRIZES = ("Match 6", "Match 5 + Bonus")
# The plans of the grid.
PLAN_LINES = (1, 2, 5, 10, 20, 50, 100)
PLAN_DRAWS = (1, 12, 52, 156)


def market(prizes: DataFrame, jackpots: DataFrame, regimes: DataFrame) -> DataFrame:
    """Per regime: median prize per tier, first and last jackpot, the next one, and lines sold per draw.

    ``prizes`` and ``jackpots`` carry rule_code. Medians are exact (``percentile`` keeps a value histogram).
    """
    key = ["game", "rule_code"]
    tiers = [name for name, _, _ in TIERS if name != "Match 6"]
    medians = prizes.groupBy(*key).agg(
        *[
            F.median(F.when(F.col("tier") == t, F.col("amount").cast("double"))).alias(f"prize_{i}")
            for i, t in enumerate(tiers)
        ],
        F.median(F.when(F.col("tier") == "Match 3", F.col("winners"))).alias("match3_winners"),
    )
    won = prizes.filter("tier = 'Match 6' and winners is not null").select(
        *key, "draw_date", (F.col("winners") > 0).alias("_won")
    )
    pots = jackpots.filter("jackpot is not null").join(won, [*key, "draw_date"], "left")
    ends = pots.groupBy(*key).agg(
        F.count("*").alias("draws"),
        F.max("draw_date").alias("last_draw"),
        F.min_by("jackpot", "draw_date").cast("double").alias("starting_jackpot"),
        F.max_by("jackpot", "draw_date").cast("double").alias("_last_jackpot"),
        F.max_by(F.coalesce("_won", F.lit(False)), F.col("draw_date")).alias("_last_won"),
    )
    p3 = tier_probability(F.col("pool"), 3, False)
    joined = regimes.select("game", "rule_code", "pool").join(ends, key).join(medians, key, "left")
    prizes_by_tier = F.map_from_entries(
        F.array(*[F.struct(F.lit(t).alias("k"), F.col(f"prize_{i}").alias("v")) for i, t in enumerate(tiers)])
    )
    return joined.select(
        *key,
        "pool",
        "draws",
        "last_draw",
        F.when(F.col("_last_won"), F.col("starting_jackpot")).otherwise(F.col("_last_jackpot")).alias("next_jackpot"),
        "starting_jackpot",
        prizes_by_tier.alias("prizes"),
        (F.col("match3_winners") / p3).alias("lines_sold"),
    )


def line_value(markets: DataFrame, lift: float = 1.0, jackpot: Column | None = None) -> DataFrame:
    """Expected return of one line and its parts."""
    pool = F.col("pool")
    p = {name: tier_probability(pool, m, b) for name, m, b in TIERS}
    pot = F.col("next_jackpot") if jackpot is None else jackpot
    share = jackpot_share(F.col("lines_sold"), p["Match 6"])
    rest = reduce(
        lambda a, b: a + b,
        [p[t] * F.coalesce(F.element_at("prizes", F.lit(t)), F.lit(0.0)) for t in p if t != "Match 6"],
    )
    return (
        markets.withColumn("p_jackpot_line", p["Match 6"])
        .withColumn("jackpot_share", share)
        .withColumn("rest_of_tiers", rest * lift)
        .withColumn("big_prize_probability", (p[BIG_PRIZES[0]] + p[BIG_PRIZES[1]]) * lift)
        .withColumn("expected_return", F.col("rest_of_tiers") + F.col("p_jackpot_line") * lift * pot * F.col("jackpot_share"))
    )


def plan_table(markets: DataFrame, price: float, lift: float = 1.0, lines=PLAN_LINES, draws=PLAN_DRAWS) -> DataFrame:
    """Every (lines per draw, draws played) plan of each regime. Both lists are literals, so they are exploded in place."""
    valued = line_value(markets, lift)
    n, d = F.col("lines_per_draw"), F.col("draws_played")
    plans = valued.withColumn("lines_per_draw", F.explode(F.array(*map(F.lit, lines)))).withColumn(
        "draws_played", F.explode(F.array(*map(F.lit, draws)))
    )
    per_draw = 1 - F.pow(1 - F.col("big_prize_probability"), n)
    return plans.select(
        "game",
        "rule_code",
        "lines_per_draw",
        "draws_played",
        (n * d * price).alias("cost"),
        (1 - F.pow(1 - per_draw, d)).alias("p_big_prize"),
        (1 - F.pow(1 - n * F.col("p_jackpot_line") * lift, d)).alias("p_jackpot"),
        (F.col("expected_return") * n * d).alias("expected_return"),
        ((F.col("expected_return") - price) * n * d).alias("expected_net"),
        (F.col("expected_return") / price).alias("return_per_euro"),
    )


def break_even(markets: DataFrame, price: float, lift: float = 1.0, targets=(0.01, 0.1, 0.5, 0.9)) -> DataFrame:
    """Jackpot at which a line returns its price (closed form: value is linear in it) and lines for target chances."""
    valued = line_value(markets, lift)
    need = (F.lit(price) - F.col("rest_of_tiers")) / (F.col("p_jackpot_line") * lift * F.col("jackpot_share"))
    out = valued.withColumn("break_even_jackpot", F.greatest(need, F.lit(0.0))).withColumn(
        "target", F.explode(F.array(*[F.lit(float(t)) for t in targets]))
    )
    lines = F.ceil(F.log(1 - F.col("target")) / F.log(1 - F.col("big_prize_probability")))
    return out.select("game", "rule_code", "break_even_jackpot", "target", lines.alias("lines_needed"))
