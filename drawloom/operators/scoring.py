"""Scoring of issued lines and probabilities against outcomes."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawloom.functions.scalars import match_probability, match_tail, overlap
from drawloom.functions.tails import clopper_pearson, normal_tail
from drawloom.session import cut_lineage, spread

EPSILON = 1e-15


def match_lines(lines: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Issued lines with the drawn numbers and match counts. A line without an outcome keeps a null count."""
    drawn = outcomes.select("game", "draw_date", F.col("mains").alias("outcome"))
    joined = lines.join(drawn, ["game", "draw_date"], "left")
    matched = overlap(F.col("mains"), F.col("outcome"))
    return joined.withColumn("matched", F.when(F.col("outcome").isNotNull(), matched))


def missing_outcomes(matched: DataFrame) -> DataFrame:
    """Lines whose target has no outcome; must be empty before a summary is trusted."""
    return matched.filter("outcome is null")


def match_summary(matched: DataFrame, keys: list[str]) -> DataFrame:
    """Per policy and budget: 7-bin histogram, line and any-line hit rates with numerators and denominators.

    Two partial aggregations: first per target date, so any-line hits need no distinct.
    """
    m = F.col("matched")
    per_date = matched.groupBy(*keys, "game", "draw_date").agg(
        F.count("*").alias("lines"),
        F.sum("matched").alias("total"),
        F.max("matched").alias("best"),
        *[F.count_if(m == k).alias(f"m{k}") for k in range(7)],
    )
    lines, dates = F.sum("lines"), F.count("*")
    hits3, hits5 = sum(F.sum(f"m{k}") for k in range(3, 7)), sum(F.sum(f"m{k}") for k in range(5, 7))
    any3, any5 = F.count_if(F.col("best") >= 3), F.count_if(F.col("best") >= 5)
    return per_date.groupBy(*keys).agg(
        dates.alias("draws"),
        lines.alias("lines"),
        F.min("draw_date").alias("first_date"),
        F.max("draw_date").alias("last_date"),
        *[F.sum(f"m{k}").alias(f"match_{k}") for k in range(7)],
        (F.sum("total") / lines).alias("mean_matches"),
        hits3.alias("line_3_plus"),
        hits5.alias("line_5_plus"),
        any3.alias("any_3_plus"),
        any5.alias("any_5_plus"),
        (hits3 / lines).alias("line_3_plus_rate"),
        (any3 / dates).alias("any_3_plus_rate"),
    )


def parity(lines: DataFrame) -> DataFrame:
    """Per policy: does it cover the (game, date, budget) population of all policies, with whole portfolios?"""
    slot = ["game", "draw_date", "budget"]
    portfolio = lines.groupBy("policy", *slot).agg(
        F.count("*").alias("rows"), F.countDistinct("line_index").alias("indices"), F.max("line_index").alias("top")
    )
    whole = (F.col("rows") == F.col("indices")) & (F.col("indices") == F.col("budget")) & (F.col("top") == F.col("budget") - 1)
    population = portfolio.select(*slot).distinct().agg(F.count("*")).scalar()
    return portfolio.groupBy("policy").agg(F.count("*").alias("slots"), F.count_if(~whole).alias("broken_portfolios")).withColumn(
        "covers_all", F.col("slots") == population
    )


def brier(p: Column, y: Column) -> Column:
    return F.pow(p - y, F.lit(2))


def log_loss(p: Column, y: Column) -> Column:
    clipped = F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), p))
    return -(y * F.log(clipped) + (1 - y) * F.log(1 - clipped))


def probability_scores(probabilities: DataFrame, keys: list[str], p: str = "probability", y: str = "drawn") -> DataFrame:
    """Mean over targets of the per-target mean Brier and log loss."""
    per_target = probabilities.groupBy(*keys, "game", "draw_date").agg(
        F.avg(brier(F.col(p), F.col(y))).alias("brier"), F.avg(log_loss(F.col(p), F.col(y))).alias("log_loss")
    )
    return per_target.groupBy(*keys).agg(
        F.count("*").alias("targets"), F.avg("brier").alias("brier"), F.avg("log_loss").alias("log_loss")
    )


def rank_candidates(scores: DataFrame, *order: Column) -> DataFrame:
    """Ranks from 1 under a full tie-break order, over any number of rows.

    Rows are sorted into ranges and written with their place in the range; the sizes of the ranges give each range its
    offset, so no task sees more than its range. Rows equal in the whole order get neighbouring ranks.
    """
    placed = cut_lineage(scores.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_range", F.shiftright("_at", 33)).withColumn("_place", F.col("_at").bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("n"))
    listed = sizes.agg(F.array_sort(F.collect_list(F.struct("_range", "n"))).alias("s"))  # one entry a range
    before = F.transform(
        "s", lambda x, i: F.struct(x["_range"].alias("_range"), F.aggregate(F.slice("s", F.lit(1), i), F.lit(0).cast("bigint"), lambda a, y: a + y["n"]).alias("_before"))
    )
    offsets = listed.select(F.inline(before))
    return placed.join(offsets, "_range").withColumn("rank", F.col("_before") + F.col("_place") + 1).drop("_at", "_range", "_place", "_before")


def top_candidates(scores: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows with their ranks: each task keeps its first ``n``, and only those meet."""
    return scores.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def calibration_bins(probabilities: DataFrame, keys: list[str], p: str, y: str, bins: int = 10) -> DataFrame:
    """Equal-width bins with the last one closed; empty bins stay with nulls."""
    which = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    filled = probabilities.groupBy(*keys, which.alias("bin")).agg(
        F.count("*").alias("count"), F.avg(p).alias("mean_probability"), F.avg(y).alias("observed_rate")
    )
    spine = filled.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = spine.join(filled, [*keys, "bin"], "left")
    return out.select(
        *keys,
        "bin",
        (F.col("bin") / bins).alias("lower"),
        ((F.col("bin") + 1) / bins).alias("upper"),
        F.coalesce("count", F.lit(0)).alias("count"),
        "mean_probability",
        "observed_rate",
    )


# --- chance of a portfolio -------------------------------------------------------


def canonical_structure(lines: Column) -> Column:
    """Numbers relabelled in order of first appearance: equal overlap patterns give equal text."""
    seen = F.array_distinct(F.flatten(lines))
    relabelled = F.transform(
        lines, lambda line: F.array_sort(F.transform(line, lambda n: F.array_position(seen, n).cast("int")))
    )
    return F.array_sort(relabelled)


def line_mask(numbers: Column) -> Column:
    """Numbers as bits of a long; a number outside 1..62 is an error, not a wrong mask."""
    bit = lambda n: F.when((n >= 1) & (n <= 62), F.call_function("shiftleft", F.lit(1).cast("long"), n)).otherwise(F.raise_error(F.lit("line masks hold numbers from 1 to 62")).cast("long"))
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda acc, n: acc.bitwiseOR(bit(n)))


#: Outcomes that one row holds while a structure is scored against them.
OUTCOME_BLOCK = 4096


def portfolio_chance(structures: DataFrame, outcomes: DataFrame) -> DataFrame:
    """For each distinct structure: share of outcomes with a line matching 3+, and moments of the best match.

    The structures are a query set against all outcomes: equal outcomes are counted together and packed into blocks
    of masks, each structure meets each block once, and the best matches of a block are added up inside its row.
    """
    # 128 hash bits stand for the nested array while it is joined and grouped.
    distinct = cut_lineage(
        structures.select("structure").distinct().withColumn("a", F.xxhash64("structure")).withColumn("b", F.xxhash64(F.lit("second"), "structure"))
    )
    counted = cut_lineage(outcomes.groupBy(line_mask(F.col("mains")).alias("mask")).agg(F.count("*").alias("times")))
    blocks = max(1, -(-counted.count() // OUTCOME_BLOCK))
    packed = cut_lineage(counted.groupBy(F.pmod(F.xxhash64("mask"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("mask", "times")).alias("drawn")))
    asked = distinct.select("a", "b", F.transform("structure", line_mask).alias("masks"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    best = F.transform("drawn", lambda o: F.struct(F.array_max(F.transform("masks", lambda m: F.bit_count(m.bitwiseAND(o["mask"])))).alias("best"), o["times"].alias("times")))
    add = lambda acc, o: F.struct(
        (acc["hits"] + F.when(o["best"] >= 3, o["times"]).otherwise(0)).alias("hits"), (acc["total"] + o["best"] * o["times"]).alias("total"), (acc["squares"] + o["best"] * o["best"] * o["times"]).alias("squares")
    )
    none = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("hits", "total", "squares")])
    scored = spread(asked, "a", "b", "block").join(packed, "block").select("a", "b", F.aggregate(best, none, add).alias("s"))
    sums = scored.groupBy("a", "b").agg(F.sum("s.hits").alias("_hits"), F.sum("s.total").alias("_sum"), F.sum("s.squares").alias("_squares"))
    total = outcomes.agg(F.count("*")).scalar()
    n = F.col("outcomes")
    mean = F.coalesce("_sum", F.lit(0)) / n
    return (
        distinct.join(sums, ["a", "b"], "left")
        .withColumn("outcomes", total)
        .select(
            "structure",
            "outcomes",
            (F.coalesce("_hits", F.lit(0)) / n).alias("chance"),
            mean.alias("match_mean"),
            (F.coalesce("_squares", F.lit(0)) / n - mean * mean).alias("match_variance"),
        )
    )


def single_line_chance(pool: Column) -> dict[str, Column]:
    """Closed form for one line: P(3+), mean and variance of its matches."""
    share = F.lit(6.0) / pool
    return {
        "chance": match_tail(pool, 3),
        "match_mean": share * 6,
        "match_variance": F.lit(6.0) * share * (1 - share) * (pool - 6) / (pool - 1),
    }


def with_chance(portfolios: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Portfolios plus their chance columns: closed form for one line, the outcome table for several."""
    # Used twice and far dearer to compute than to store.
    tagged = cut_lineage(portfolios.withColumn("structure", canonical_structure(F.col("lines"))))
    several = tagged.filter(F.size("lines") > 1).select("structure").distinct()
    table = portfolio_chance(several, outcomes)
    joined = tagged.join(table, "structure", "left")
    single = single_line_chance(F.col("pool"))
    one = F.size("lines") == 1
    return joined.select(
        *portfolios.columns, *[F.when(one, single[c]).otherwise(F.col(c)).alias(c) for c in single]
    )


# --- study summary ---------------------------------------------------------------


def outcome_rows(portfolios: DataFrame, draws: DataFrame) -> DataFrame:
    """One row per target, source and method: best match of the portfolio and its chance columns."""
    drawn = draws.select("game", "draw_date", F.col("mains").alias("outcome"))
    joined = portfolios.join(drawn, ["game", "draw_date"])
    best = F.array_max(F.transform("lines", lambda line: F.size(F.array_intersect(line, F.col("outcome")))))
    return joined.select(
        "game",
        "draw_date",
        "source",
        "method",
        F.size("lines").alias("lines"),
        best.alias("best_match"),
        *[c for c in ("chance", "match_mean", "match_variance") if c in portfolios.columns],
    )


def holm(tests: DataFrame, family: list[str], p: str = "p_value", name: str = "test", out: str = "holm_p_value") -> DataFrame:
    """Step-down adjustment within each family, ordered by (p, name). One row per test."""
    every = Window.partitionBy(*family)
    order = every.orderBy(p, name)
    step = F.least(F.lit(1.0), (F.count("*").over(every) - F.row_number().over(order) + 1) * F.col(p))
    stepped = tests.withColumn("_step", step)
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return stepped.withColumn(out, F.max("_step").over(running)).drop("_step")


def event_tail(rows: DataFrame, keys: list[str], hit: Column) -> DataFrame:
    """P(at least the observed number of hits) when each row hits with its own chance.

    Rows collapse to distinct chances first; that table is small, because equal portfolio structures share one.
    """
    folded = rows.groupBy(*keys, "chance").agg(F.count("*").alias("_n"), F.count_if(hit).alias("_hits"))
    return tail_of_sums(folded, keys)


def tail_of_sums(folded: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p_value) of rows (keys, chance, _n, _hits): the chance that independent events of ``_n`` trials each with
    ``chance`` come to the group's hits or more.

    The characteristic function at each frequency is a product over trials, so its logarithm and angle are sums, which
    combine on the map side; the tail is one more sum over frequencies (the inverse transform, summed over the counts).
    A group's frequencies, half as many as its trials, are rows of their own: nothing of a group lies in one task.
    """
    totals = folded.groupBy(*keys).agg(F.sum("_n").alias("_trials"), F.sum("_hits").alias("_seen"))
    same = [F.col(f"f.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    on = reduce(lambda a, b: a & b, same)
    rows = folded.alias("f").join(totals.alias("t"), on).select(*[F.col(f"f.{k}").alias(k) for k in keys], F.col("f.chance").cast("double").alias("_p"), "f._n", "t._trials", "t._seen")
    size = F.col("_trials") + 1
    at = rows.withColumn("_j", F.explode_outer(F.when(F.col("_trials") >= 1, F.sequence(F.lit(1).cast("long"), F.floor(size / 2)))))
    w = F.col("_j") * (2 * math.pi) / size
    p, real = F.col("_p"), 1 - F.col("_p") + F.col("_p") * F.cos(w)
    square = F.greatest(1 - 2 * p * (1 - p) * (1 - F.cos(w)), F.lit(1e-300))
    waves = at.groupBy(*keys, "_trials", "_seen", "_j").agg(F.sum(F.col("_n") * F.log(square) / 2).alias("_log"), F.sum(F.col("_n") * F.atan2(p * F.sin(w), real)).alias("_angle"))
    twice = F.when(2 * F.col("_j") == size, 1.0).otherwise(2.0)  # j and size - j have one real part
    term = twice * F.exp("_log") * F.cos(F.col("_angle") - w * (F.col("_seen") - 1) / 2) * F.sin(w * F.col("_seen") / 2) / F.sin(w / 2)
    summed = waves.groupBy(*keys, "_trials", "_seen").agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("_sum"))
    tail = (F.col("_trials") - F.col("_seen") + 1 - F.col("_sum")) / size
    return summed.select(*keys, F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)).alias("p_value"))


def study_summary(rows: DataFrame, significance: float = 0.05) -> DataFrame:
    """Per source and method: rate against chance, exact interval, both tests and their joint Holm adjustment."""
    keys = ["source", "method"]
    hit3, hit5 = F.col("best_match") >= 3, F.col("best_match") >= 5
    # One pass over the rows: equal chances fold together, and both the sums and the tail read the small fold.
    folded = rows.groupBy(*keys, "chance", "match_mean", "match_variance").agg(
        F.max("lines").alias("lines"),
        F.count("*").alias("_n"),
        F.count_if(hit3).alias("_hits"),
        F.count_if(hit5).alias("_five"),
        F.sum("best_match").alias("_best"),
    )
    n = F.col("_n")
    base = folded.groupBy(*keys).agg(
        F.max("lines").alias("lines"),
        F.sum("_n").alias("draws"),
        F.sum("_hits").alias("hits_3_plus"),
        F.sum("_five").alias("hits_5_plus"),
        (F.sum(F.col("chance") * n) / F.sum("_n")).alias("expected_rate"),
        F.sum("_best").alias("_matches"),
        F.sum(F.col("match_mean") * n).alias("_null_mean"),
        F.sum(F.col("match_variance") * n).alias("_null_var"),
    )
    tails = tail_of_sums(folded, keys)
    interval = clopper_pearson(F.col("hits_3_plus"), F.col("draws"))
    full = (
        base.join(tails, keys)
        .withColumn("rate", F.col("hits_3_plus") / F.col("draws"))
        .withColumn("interval", interval)
        .withColumn("match_p_value", normal_tail((F.col("_matches") - F.col("_null_mean")) / F.sqrt("_null_var")))
    )
    tests = full.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.lit("hit3").alias("metric"), F.col("p_value").alias("p")),
                F.struct(F.lit("match").alias("metric"), F.col("match_p_value").alias("p")),
            )
        ).alias("t"),
    ).select(*keys, "t.metric", "t.p", F.concat_ws(":", "t.metric", "source", "method").alias("test"), F.lit("all").alias("family"))
    adjusted = holm(tests, ["family"], p="p").groupBy(*keys).agg(
        F.max(F.when(F.col("metric") == "hit3", F.col("holm_p_value"))).alias("holm_p_value"),
        F.max(F.when(F.col("metric") == "match", F.col("holm_p_value"))).alias("match_holm_p_value"),
    )
    return full.join(adjusted, keys).select(
        *keys,
        "lines",
        "draws",
        "hits_3_plus",
        "rate",
        "expected_rate",
        (F.col("rate") / F.col("expected_rate")).alias("lift"),
        F.col("interval.lower").alias("rate_lower"),
        F.col("interval.upper").alias("rate_upper"),
        "hits_5_plus",
        "p_value",
        (F.col("_matches") / F.col("draws")).alias("mean_matches"),
        (F.col("_null_mean") / F.col("draws")).alias("expected_matches"),
        (F.col("_matches") / F.col("_null_mean")).alias("match_lift"),
        "match_p_value",
        "holm_p_value",
        "match_holm_p_value",
        (F.least("holm_p_value", "match_holm_p_value") < significance).alias("significant"),
    )


def yearly_rates(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source", "method", F.year("draw_date").alias("year")).agg(
        F.count("*").alias("draws"),
        F.count_if(F.col("best_match") >= 3).alias("hits_3_plus"),
        (F.count_if(F.col("best_match") >= 3) / F.count("*")).alias("rate"),
        F.avg("chance").alias("expected_rate"),
    )


def reconcile_metrics(recomputed: DataFrame, reported: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Differences between two metric tables, both directions; empty means they agree."""
    a, b = recomputed.alias("a"), reported.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    same = reduce(lambda x, y: x & y, [F.col(f"a.{m}").eqNullSafe(F.col(f"b.{m}")) for m in metrics])
    side = F.when(F.col(f"b.{keys[0]}").isNull(), "not_reported").when(F.col(f"a.{keys[0]}").isNull(), "not_recomputed").otherwise("differs")
    joined = a.join(b, on, "full").withColumn("difference", side).filter((F.col("difference") != "differs") | ~same)
    return joined.select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys], "difference")


def tail_band(rates: DataFrame, rate: str, p: str, n: str) -> DataFrame:
    """Rate against an exact probability: inside ``5 sd + 1/n``."""
    band = 5 * F.sqrt(F.col(p) * (1 - F.col(p)) / F.col(n)) + 1 / F.col(n)
    return rates.withColumn("band", band).withColumn("within_band", F.abs(F.col(rate) - F.col(p)) <= F.col("band"))

