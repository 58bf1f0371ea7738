"""Values known by hand."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from drawloom.functions import scalars as sc
from drawloom.operators import derived, features, inference, intervals, lines, returns, scoring


def one(df):
    return df.first()


def test_holm(spark):
    rows = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03)], "family string, test string, p_value double")
    got = {r["test"]: r["holm_p_value"] for r in scoring.holm(rows, ["family"]).collect()}
    assert got == pytest.approx({"a": 0.03, "b": 0.06, "c": 0.06})


def test_calibration_bins(spark):
    rows = spark.createDataFrame([("s", p, 0) for p in (0.0, 0.05, 0.95, 1.0)], "source string, p double, y int")
    bins = {r["bin"]: r for r in scoring.calibration_bins(rows, ["source"], "p", "y").collect()}
    assert len(bins) == 10 and bins[0]["count"] == 2 and bins[9]["count"] == 2
    assert bins[4]["count"] == 0 and bins[4]["mean_probability"] is None


def test_odds(spark):
    pools = spark.sql("SELECT * FROM VALUES (45), (47) AS p(pool)")
    pool = F.col("pool")
    got = {
        r["pool"]: r
        for r in pools.select(
            "pool",
            sc.match_tail(pool, 3).alias("tail"),
            (1 / sc.tier_probability(pool, 6, None)).alias("six"),
            (1 / sc.tier_probability(pool, 5, True)).alias("five"),
        ).collect()
    }
    assert got[47]["tail"] == pytest.approx(75249 / 3579191)
    assert got[45]["six"] == pytest.approx(8145060) and got[45]["five"] == pytest.approx(1357510)


def test_choose_edges(spark):
    row = one(spark.range(1).select(sc.choose(F.lit(5), 0).alias("a"), sc.choose(F.lit(5), 6).alias("b"), sc.choose(F.lit(47), 6).alias("c")))
    assert (row["a"], row["b"], row["c"]) == (1.0, 0.0, 10737573.0)


def test_coverage_lines(spark):
    scores = spark.range(1, 48).select(F.lit("g").alias("game"), F.col("id").cast("int").alias("number"), (-F.col("id")).cast("double").alias("score"))
    ranked = lines.rank_numbers(scores, ["game"])
    row = one(ranked.select(lines.coverage_lines(F.col("ranked"), 5).alias("five"), lines.coverage_lines(F.col("ranked"), 10).alias("ten")))
    assert list(row["five"][0]) == [1, 2, 3, 4, 5, 6]
    assert len({n for line in row["five"] for n in line}) == 30
    assert len({tuple(line) for line in row["ten"]}) == 10


def test_coverage_lines_do_not_repeat_when_six_divides_the_pool(spark):
    scores = spark.range(1, 43).select(F.lit("g").alias("game"), F.col("id").cast("int").alias("number"), (-F.col("id")).cast("double").alias("score"))
    row = one(lines.rank_numbers(scores, ["game"]).select(lines.coverage_lines(F.col("ranked"), 10).alias("ten")))
    assert len({tuple(line) for line in row["ten"]}) == 10


def test_uniform_portfolio_of_a_small_pool(spark):
    row = one(spark.range(1).select(lines.uniform_portfolio(F.lit(7), 7, "s", attempts=400).alias("l")))
    assert len({tuple(x) for x in row["l"]}) == 7


def test_weighted_line_skips_zero_weights(spark):
    weights = [1.0 if n < 6 else 0.0 for n in range(10)]
    row = one(spark.createDataFrame([(weights,)], "w array<double>").select(lines.weighted_line(F.col("w"), "s").alias("l")))
    assert list(row["l"]) == [1, 2, 3, 4, 5, 6]


def test_monte_carlo_p(spark):
    nulls = spark.range(10000).select(F.lit("g").alias("game"), F.lit(0.0).alias("s"), F.lit(0.5).alias("o"))
    assert one(inference.monte_carlo_p(nulls, ["game"], "s", "o"))["p_value"] == pytest.approx(1 / 10001)


def test_bootstrap_mean(spark):
    rows = spark.createDataFrame([("g", i, d) for i, d in enumerate([1.0, 0.0, 0.0, 0.0, 0.0])], "game string, row_idx long, difference double")
    means = inference.bootstrap_means(rows, ["game"], 300, "seed", block=2)
    got = one(inference.bootstrap_summary(rows, means, ["game"], 2))
    assert got["mean_difference"] == pytest.approx(0.2) and got["replicates"] == 300
    again = {r["replicate"]: r["mean"] for r in inference.bootstrap_means(rows, ["game"], 300, "seed", block=2).collect()}
    assert again == {r["replicate"]: r["mean"] for r in means.collect()}


def test_lines_for_probability(spark):
    need = one(spark.range(1).select(F.ceil(F.log(F.lit(0.25)) / F.log(F.lit(0.5))).alias("n")))
    assert need["n"] == 2


def test_holidays(spark):
    years = spark.createDataFrame([(2022,), (2026,)], "year int")
    got = {r["year"]: set(r["h"]) for r in years.select("year", sc.holiday_array(F.col("year")).alias("h")).collect()}
    assert {date(2026, 4, 6), date(2026, 10, 26), date(2026, 2, 2)} <= got[2026]
    assert date(2022, 2, 1) not in got[2022]
    days = spark.createDataFrame([(date(2026, 12, 23),)], "draw_date date")
    assert one(features.days_to_holiday(days))["days_to_holiday"] == 2


def _draws(spark, rows):
    return spark.createDataFrame(rows, "game string, rule_code string, draw_date date, pool int, mains array<int>, gap_before boolean")


def test_lag_validity_and_recency(spark):
    a, b = [1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 7]
    base = [("g", "r", date(2020, 1, 6), 47, a, False), ("g", "r", date(2020, 1, 13), 47, b, True), ("g", "r", date(2020, 1, 20), 47, a, False)]
    rows = features.feature_table(_draws(spark, base)).filter("draw_idx = 2").collect()
    first = {r["number"]: r for r in rows}
    assert (first[1]["lag_1_valid"], first[1]["lag_2_valid"], first[1]["lag_3_valid"]) == (1.0, 0.0, 0.0)
    assert first[7]["lag_1"] == 1.0 and first[6]["lag_1"] == 0.0 and first[6]["lag_2"] == 0.0
    assert first[40]["recency"] == 100.0 and first[40]["never_seen"] == 1.0 and first[1]["recency"] == 1.0
    base[2] = (*base[2][:5], True)
    assert features.feature_table(_draws(spark, base)).filter("draw_idx = 2").first()["lag_1_valid"] == 0.0


def _rules(spark, schedule, end=None):
    return spark.createDataFrame([("g", "r", date(2020, 1, 1), end, 47, schedule)], "game string, code string, starts_on date, ends_on date, pool int, schedule array<int>")


def test_schedule_coverage(spark):
    ranges = spark.createDataFrame([("g", date(2020, 1, 6), date(2020, 1, 9))], "game string, start date, end date")
    drawn = spark.createDataFrame([("g", date(2020, 1, 8))], "game string, draw_date date")
    cal = intervals.mark_observed(intervals.calendar(ranges, _rules(spark, [0, 2])), drawn)
    got = one(intervals.schedule_summary(cal))
    assert (got["expected"], got["eligible_observed"], got["missing"], got["first_missing"]) == (2, 1, 1, date(2020, 1, 6))
    empty = one(intervals.schedule_summary(intervals.mark_observed(intervals.calendar(ranges, _rules(spark, [])), drawn)))
    assert (empty["expected"], empty["unknown_schedule_days"], empty["missing"], empty["eligible_on_unknown_days"]) == (0, 4, 0, 1)


def test_rules_beyond_the_bins_and_overlaps(spark):
    rules = spark.createDataFrame(
        [("g", "old", date(1800, 1, 1), date(1850, 1, 1), 47, [0]), ("g", "new", date(2150, 1, 1), None, 47, [0]), ("g", "new2", date(2160, 1, 1), None, 47, [0])],
        "game string, code string, starts_on date, ends_on date, pool int, schedule array<int>",
    )
    days = spark.createDataFrame([("g", date(1820, 5, 5)), ("g", date(1860, 5, 5)), ("g", date(2155, 1, 1)), ("g", date(2170, 1, 1))], "game string, draw_date date")
    got = {r["draw_date"].year: (r["rule_count"], r["rule_code"]) for r in intervals.attach_rule(days, rules).collect()}
    assert got == {1820: (1, "old"), 1860: (0, None), 2155: (1, "new"), 2170: (2, None)}
    assert [(r["code_a"], r["code_b"]) for r in intervals.overlapping_rules(rules).collect()] == [("new", "new2")]


def test_streak_is_unknown_after_a_break(spark):
    m = [1, 2, 3, 4, 5, 6]
    rows = [
        ("g", date(2020, 1, 6), m, "Won", True),
        ("g", date(2020, 1, 13), m, "Roll", True),
        ("g", date(2020, 1, 20), m, "Roll", True),
        ("g", date(2020, 1, 27), [2, 3, 4, 5, 6, 7], None, True),
        ("g", date(2020, 2, 3), m, "Won", False),
        ("g", date(2020, 2, 10), m, "Roll", True),
    ]
    df = spark.createDataFrame(rows, "game string, draw_date date, mains array<int>, outcome string, continuous_from_previous boolean")
    got = [r["prior_rollover_streak"] for r in derived.win_history(df).orderBy("draw_date").collect()]
    assert got == [None, 0, 1, 2, None, 0]
    assert derived.previous_draw(df).orderBy("draw_date").collect()[3]["previous_overlap"] == 5


def test_break_even_is_the_root(spark):
    prizes = {"Match 5 + Bonus": 10000.0, "Match 5": 1000.0, "Match 4 + Bonus": 100.0, "Match 4": 40.0, "Match 3 + Bonus": 25.0, "Match 3": 9.0}
    row = [("g", "r", 45, 100, date(2020, 1, 1), 3e6, 2e6, prizes, 5e5)]
    market = spark.createDataFrame(row, "game string, rule_code string, pool int, draws int, last_draw date, next_jackpot double, starting_jackpot double, prizes map<string,double>, lines_sold double")
    at = one(returns.break_even(market, 2.0))["break_even_jackpot"]
    assert one(returns.line_value(market, jackpot=F.lit(at)))["expected_return"] == pytest.approx(2.0)


def test_small_pools_are_drawn_until_full_or_refused(spark):
    def portfolio(pool, budget):
        made = lines.uniform_portfolio(F.lit(pool), budget, "p", F.col("id").cast("string"))
        return [r["l"] for r in spark.range(3).select(made.alias("l")).collect()]

    for got in portfolio(7, 7):
        assert len({tuple(line) for line in got}) == 7
    with pytest.raises(Exception, match="no 8 distinct lines"):
        portfolio(7, 8)


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(5)
    day = date(1990, 1, 1)
    rows = []
    for k in range(120):
        start = day + timedelta(days=rng.randrange(4000))
        end = rng.choice([None, start, start + timedelta(days=rng.randrange(-40, 1500)), start + timedelta(days=rng.randrange(60))])
        rows.append((f"g{k % 3}", f"c{k:03}", rng.choice([start, start, start, start, None]), end))
    far = date(9999, 12, 31)
    truth = {
        (a[0], a[1], b[1]) for a in rows for b in rows
        if a[0] == b[0] and a[1] < b[1] and a[2] and b[2] and a[2] <= (b[3] or far) and b[2] <= (a[3] or far)
    }
    rules = spark.createDataFrame(rows, "game string, code string, starts_on date, ends_on date")
    got = [tuple(r) for r in intervals.overlapping_rules(rules).collect()]
    assert len(got) == len(set(got)) and set(got) == truth
    assert intervals.overlapping_rules(rules.limit(0)).isEmpty()


def test_schedule_dates(spark):
    days = [(date(2020, 1, d), s, o, n) for d, s, o, n in ((6, True, False, 1), (7, False, True, 1), (8, None, True, 0), (9, True, True, 2), (10, False, True, 2), (11, False, False, 1))]
    cal = spark.createDataFrame([("g", *x) for x in days], "game string, day date, scheduled boolean, observed boolean, rule_count long")
    got = sorted((r["day"].day, r["kind"]) for r in intervals.schedule_dates(cal).collect())
    assert got == [(6, "missing"), (7, "unexpected"), (9, "overlapping_rules"), (10, "overlapping_rules"), (10, "unexpected")]
