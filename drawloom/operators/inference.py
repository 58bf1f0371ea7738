"""Exact rates, bootstrap and findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawloom.functions.scalars import match_tail, unit_uniform
from drawloom.functions.tails import binomial_tail, binomial_two_sided, clopper_pearson
from drawloom.operators.scoring import calibration_bins, holm, probability_scores
from drawloom.session import cut_lineage


#: Fixed value: replicates of the study's bootstrap tests.
REPLICATES = 10_000
#: Null replicates that the check of the exact null needs, and its level.
CHECK_REPLICATES = 100
CHECK_ALPHA = 0.001


def exact_rates(hits: DataFrame, keys: list[str], hit: str = "hit", pool: str = "pool", matches: int = 3) -> DataFrame:
    """Rate of a 0/1 column with its exact 95% interval, against the exact one-line chance."""
    grouped = hits.groupBy(*keys).agg(F.sum(hit).alias("events"), F.count("*").alias("trials"), F.max(pool).alias("pool"))
    p0 = match_tail(F.col("pool"), matches)
    out = grouped.withColumn("p0", p0).withColumn("i", clopper_pearson("events", "trials"))
    rate = F.col("events") / F.col("trials")
    return out.select(
        *keys,
        "events",
        "trials",
        rate.alias("rate"),
        "p0",
        F.col("i.lower").alias("rate_lower"),
        F.col("i.upper").alias("rate_upper"),
        (rate - F.col("p0")).alias("improvement"),
        (F.col("i.lower") - F.col("p0")).alias("improvement_lower"),
        (F.col("i.upper") - F.col("p0")).alias("improvement_upper"),
        (F.col("i.lower") > F.col("p0")).alias("excludes_zero"),
    )


def exact_tests(rates: DataFrame, events: str = "events", trials: str = "trials", p: str = "p0", out: str = "p_value") -> DataFrame:
    """One-sided exact binomial test on grouped rows."""
    return rates.withColumn(out, binomial_tail(F.col(events), F.col(trials), F.col(p)))


def monte_carlo_p(nulls: DataFrame, keys: list[str], statistic: str, observed: str) -> DataFrame:
    """(1 + number of null statistics at or above the observed) / (n + 1)."""
    return nulls.groupBy(*keys).agg(
        F.count("*").alias("replicates"),
        ((F.count_if(F.col(statistic) >= F.col(observed)) + 1) / (F.count("*") + 1)).alias("p_value"),
    )


def bootstrap_means(differences: DataFrame, keys: list[str], replicates: int = REPLICATES, seed: str = "", block: int = 1, chunk: int = 64) -> DataFrame:
    """Resampled means of paired differences: one row per series and replicate.

    ``differences`` has keys, ``row_idx`` (0..n-1) and ``difference``. Position j of replicate r takes the
    row ``(start + j % block) % n`` with a hash-derived start per block, so any subset of replicates can be
    recomputed alone. A series has one difference a day at most, so it travels as one array to chunks of replicates
    that are dealt over all tasks; each replicate is summed inside its row, and no resampled row is ever shuffled.
    """
    ordered = F.array_sort(F.collect_list(F.struct("row_idx", "difference")))
    series = differences.groupBy(*keys).agg(F.transform(ordered, lambda x: x["difference"]).alias("_values"))
    parts = -(-replicates // chunk)
    dealt = series.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = dealt.repartition(int(differences.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_part")
    last = F.least(F.lit(replicates - 1), (F.col("_part") + 1) * chunk - 1)
    reps = dealt.withColumn("replicate", F.explode(F.sequence(F.col("_part") * chunk, last)))
    names = [F.col(k).cast("string") for k in keys]
    n = F.size("_values")

    def drawn(at: Column) -> Column:
        """Sum of the block number ``at`` of the replicate."""
        start = F.floor(unit_uniform(seed, *names, F.col("replicate"), at) * n)
        inside = F.least(F.lit(block), n - at * block)
        return F.aggregate(F.sequence(F.lit(0), inside - 1), F.lit(0.0), lambda acc, k: acc + F.get("_values", F.pmod(start + k, n).cast("int")))

    total = F.aggregate(F.sequence(F.lit(0), F.ceil(n / block).cast("int") - 1), F.lit(0.0), lambda acc, at: acc + drawn(at))
    return reps.select(*keys, "replicate", (total / n).alias("mean"))


def bootstrap_summary(differences: DataFrame, means: DataFrame, keys: list[str], block: int = 1) -> DataFrame:
    """Mean difference, its 2.5/97.5% resampled quantiles, and the one-sided p (share of means at or below 0)."""
    observed = differences.groupBy(*keys).agg(F.avg("difference").alias("mean_difference"))
    spread = means.groupBy(*keys).agg(
        F.count("*").alias("replicates"),
        F.percentile("mean", [0.025, 0.975]).alias("q"),
        ((F.count_if(F.col("mean") <= 0) + 1) / (F.count("*") + 1)).alias("p_value"),
    )
    return observed.join(spread, keys).select(
        *keys,
        "replicates",
        F.lit(block).alias("block_length"),
        "mean_difference",
        F.col("q")[0].alias("lower"),
        F.col("q")[1].alias("upper"),
        "p_value",
    )


def any_line_hits(evaluated: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    """Per target date: did any line of the portfolio match at least ``threshold`` numbers?"""
    return evaluated.groupBy(*keys, "game", "draw_date").agg((F.max("matched") >= threshold).cast("int").alias("hit"))


def paired_differences(hits: DataFrame, model: str, baseline: str, keys: list[str]) -> DataFrame:
    """Model minus baseline per date, with a dense row index; hits has policy, keys, game, draw_date, hit."""
    from pyspark.sql import Window

    side = F.sum(F.when(F.col("policy") == model, F.col("hit"))) - F.sum(F.when(F.col("policy") == baseline, F.col("hit")))
    paired = (
        hits.filter(F.col("policy").isin(model, baseline))
        .groupBy(*dict.fromkeys([*keys, "game", "draw_date"]))
        .agg(side.cast("double").alias("difference"))
        .filter("difference is not null")
    )
    order = Window.partitionBy(*keys).orderBy("game", "draw_date")
    return paired.withColumn("row_idx", F.row_number().over(order) - 1)


def secondary_tests(evaluated: DataFrame, single: str, budgets: dict[int, tuple[str, str]], replicates: int, seed: str) -> DataFrame:
    """Secondary tests of each game with their Holm adjustment: game, test, trials, p_value, holm_p_value.

    ``evaluated`` has one row per line (method, game, draw_date, pool, matched). ``single`` is the method whose one line
    meets the exact chance of 5+; ``budgets`` names the model and the uniform method of each number of lines, whose
    any-line 3+ hits are compared by paired bootstrap.
    """
    five = evaluated.filter(F.col("method") == single).withColumn("hit", (F.col("matched") >= 5).cast("int"))
    exact = exact_tests(exact_rates(five, ["game"], matches=5)).select("game", F.lit("one_line_5_plus").alias("test"), F.col("trials").cast("long").alias("trials"), "p_value")
    hits = any_line_hits(evaluated, ["method"], 3).withColumnRenamed("method", "policy")
    parts = [paired_differences(hits, model, uniform, ["game"]).withColumn("test", F.lit(f"budget_{budget}_any_line_3_plus")) for budget, (model, uniform) in budgets.items()]
    rows = cut_lineage(reduce(DataFrame.unionByName, parts))
    keys = ["game", "test"]
    means = bootstrap_means(rows, keys, replicates, seed)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("trials"))
    resampled = bootstrap_summary(rows, means, keys).join(sizes, keys).select(*keys, "trials", "p_value")
    return holm(exact.unionByName(resampled), ["game"]).select(*keys, "trials", "p_value", "holm_p_value")


def verdict(improvement: Column, excludes_zero: Column, p_value: Column, final: Column, check_passed: Column) -> Column:
    promising = (improvement > 0) & excludes_zero & final & (p_value <= 0.05)
    return (
        F.when(F.coalesce(promising, F.lit(False)), "promising")
        .when(~F.coalesce(check_passed, F.lit(True)), "invalid")
        .when(~F.coalesce(final, F.lit(False)), "not_final")
        .otherwise("no_advantage")
    )


def rotated_nulls(lines: DataFrame, keys: list[str], replicates: int = CHECK_REPLICATES, threshold: int = 3) -> DataFrame:
    """Hits of each series' lines against outcomes of other dates: keys, replicate, events, trials.

    Replicate s sets the line of date i against the outcome of date i + s, going round, so each is a history in which
    lines know nothing of their outcome, with as many trials. A series of n dates has n - 1 of them. It holds one line
    a day at most and travels as one array to its replicates, which are dealt over all tasks.
    """
    ordered = F.array_sort(F.collect_list(F.struct("draw_date", "mains", "outcome")))
    series = lines.groupBy(*keys).agg(ordered.alias("_rows")).withColumn("trials", F.size("_rows")).filter("trials > 1")
    dealt = series.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.least(F.lit(replicates), F.col("trials") - 1))))
    dealt = dealt.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "replicate")

    def hit(i: Column) -> Column:
        other = F.get("_rows", F.pmod(i + F.col("replicate"), F.col("trials")))["outcome"]
        return (F.size(F.array_intersect(F.get("_rows", i)["mains"], other)) >= threshold).cast("int")

    events = F.aggregate(F.sequence(F.lit(0), F.col("trials") - 1), F.lit(0), lambda acc, i: acc + hit(i))
    return dealt.select(*keys, "replicate", events.alias("events"), "trials")


def exact_null(primary: DataFrame, nulls: DataFrame, keys: list[str]) -> DataFrame:
    """Primary rows with the exact p, the Monte Carlo p and the two-sided check of pooled null hits against ``p0``.

    ``final`` needs enough null replicates and a check that passes. A series without nulls is not final.
    """
    tested = exact_tests(primary, out="exact_p")
    observed = nulls.join(tested.select(*keys, F.col("events").alias("_events"), "p0"), keys)
    pooled = observed.groupBy(*keys).agg(
        F.count("*").alias("null_replicates"),
        F.sum("events").alias("_hits"),
        F.sum("trials").alias("_trials"),
        F.max("p0").alias("_p0"),
        ((F.count_if(F.col("events") >= F.col("_events")) + 1) / (F.count("*") + 1)).alias("monte_carlo_p"),
    )
    checked = pooled.withColumn("check_p", binomial_two_sided("_hits", "_trials", "_p0")).withColumn("check_passed", F.col("check_p") > CHECK_ALPHA)
    checked = checked.withColumn("final", (F.col("null_replicates") >= CHECK_REPLICATES) & F.col("check_passed")).drop("_hits", "_trials", "_p0")
    return tested.join(checked, keys, "left").na.fill({"null_replicates": 0, "final": False})


def findings(evaluated: DataFrame, probabilities: DataFrame, single: str, uniform: str, budgets: dict[int, tuple[str, str]], replicates: int = REPLICATES, seed: str = "") -> DataFrame:
    """One row per game: the primary rate at 3+ with its exact null, plain and block bootstrap against uniform lines at
    the same threshold, secondary tests with Holm values, calibration and verdict.

    ``evaluated`` holds the lines of the holdout (method, game, draw_date, pool, mains, outcome, matched) and
    ``probabilities`` its numbers (game, draw_date, probability, drawn).
    """
    keys = ["game"]
    top = evaluated.filter(F.col("method") == single)
    span = top.groupBy(*keys).agg(F.min("draw_date").alias("first_date"), F.max("draw_date").alias("last_date"), F.count("*").alias("holdout_draws"))
    primary = exact_rates(top.withColumn("hit", (F.col("matched") >= 3).cast("int")), keys)
    out = exact_null(primary, rotated_nulls(top, keys), keys).join(span, keys)
    hits = any_line_hits(evaluated.filter(F.col("method").isin(single, uniform)), ["method"], 3).withColumnRenamed("method", "policy")
    rows = cut_lineage(paired_differences(hits, single, uniform, keys))
    for name, block in (("", 1), ("block_", 5)):
        means = bootstrap_means(rows, keys, replicates, f"{seed}{name}", block)
        summary = bootstrap_summary(rows, means, keys, block)
        kept = [F.col(c).alias(f"{name}{c}") for c in ("lower", "upper")]
        out = out.join(summary.select(*keys, *([] if name else ["mean_difference"]), *kept), keys, "left")
    tests = secondary_tests(evaluated, single, budgets, replicates, f"{seed}second")
    named = [("five", "one_line_5_plus"), *((f"budget_{b}", f"budget_{b}_any_line_3_plus") for b in budgets)]
    columns = [F.max(F.when(F.col("test") == test, F.col(c))).alias(f"{name}_{short}") for name, test in named for c, short in (("p_value", "p"), ("holm_p_value", "holm"))]
    bins = calibration_bins(probabilities, keys, "probability", "drawn").filter("count > 0")
    gap = F.sum(F.col("count") * F.abs(F.col("mean_probability") - F.col("observed_rate"))) / F.sum("count")
    out = (
        out.join(tests.groupBy(*keys).agg(*columns), keys, "left")
        .join(bins.groupBy(*keys).agg(gap.alias("calibration_gap"), F.count("*").alias("calibration_bins")), keys, "left")
        .join(probability_scores(probabilities, keys).select(*keys, "brier", "log_loss"), keys, "left")
    )
    return out.withColumn("verdict", verdict(F.col("improvement"), F.col("excludes_zero"), F.col("exact_p"), F.col("final"), F.col("check_passed")))
