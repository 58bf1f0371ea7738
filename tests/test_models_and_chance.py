"""Tails, portfolio chances, logistic fits and leakage against brute force."""

from datetime import date, timedelta
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawloom.functions.tails import beta_cdf, exact_interval
from drawloom.operators import features, learn, scoring

RNG = np.random.default_rng(5)


def test_binomial_tail_and_interval():
    for n, x, p in ((10, 3, 0.2), (257, 9, 0.021), (400, 400, 0.9), (50, 1, 0.5)):
        direct = sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x, n + 1))
        assert float(beta_cdf(x, n - x + 1, p)) == pytest.approx(direct, rel=1e-9)
    lower, upper = exact_interval(np.array([0, 5, 10]), np.array([10, 10, 10]))
    assert lower == pytest.approx([0.0, 0.187086, 0.691503], abs=1e-5)
    assert upper == pytest.approx([0.308497, 0.812914, 1.0], abs=1e-5)


def test_event_tail_against_convolution(spark):
    groups = {
        "mixed": ([0.02, 0.1, 0.5, 0.0, 1.0], [30, 12, 3, 4, 1]),
        "even": ([0.5], [8]),
        "long": ([0.021, 0.2, 0.0213], [900, 40, 700]),
        "never": ([0.0], [5]),
        "one": ([0.3], [1]),
    }
    rows, truth = [], {}
    for name, (p, n) in groups.items():
        pmf = np.ones(1)
        for value in np.repeat(p, n):
            pmf = np.convolve(pmf, [1 - value, value])
        for seen in (0, 1, 4, 9, 60):
            if seen <= sum(n):
                rows += [(f"{name}{seen}", None if name == "one" else "k", value, int(m), seen if k == 0 else 0) for k, (value, m) in enumerate(zip(p, n, strict=True))]
                truth[f"{name}{seen}"] = min(1.0, pmf[seen:].sum())
    folded = spark.createDataFrame(rows, "name string, other string, chance double, _n long, _hits long")
    got = {r["name"]: r["p_value"] for r in scoring.tail_of_sums(folded, ["name", "other"]).collect()}
    assert got == pytest.approx(truth, abs=1e-9) and len(truth) > 15


def test_bootstrap_takes_hashed_blocks(spark):
    """Each replicate's mean equals the mean of the rows its hashes name; the chunks change nothing."""
    from drawloom.functions.scalars import unit_uniform
    from drawloom.operators import inference

    values = [float(x) for x in RNG.integers(-3, 4, 37)]
    rows = spark.createDataFrame([("g", k, v) for k, v in enumerate(values)], "game string, row_idx int, difference double")
    for block in (1, 5):
        means = {r["replicate"]: r["mean"] for r in inference.bootstrap_means(rows, ["game"], 50, "s", block, chunk=7).collect()}
        assert means == {r["replicate"]: r["mean"] for r in inference.bootstrap_means(rows, ["game"], 50, "s", block).collect()}
        for r in (0, 13, 49):
            blocks = -(-37 // block)
            u = [x["u"] for x in spark.range(blocks).select(unit_uniform("s", F.lit("g"), F.lit(r), F.col("id")).alias("u")).collect()]
            picks = [values[(int(u[b] * 37) + k) % 37] for b in range(blocks) for k in range(block) if b * block + k < 37]
            assert means[r] == pytest.approx(np.mean(picks))
    assert inference.bootstrap_means(rows, ["game"], seed="s").count() == 10_000


def test_portfolio_chance_against_all_pairs(spark):
    outcomes = [sorted(int(x) + 1 for x in RNG.choice(20, 6, replace=False)) for _ in range(300)]
    books = [[sorted(int(x) + 1 for x in RNG.choice(20, 6, replace=False)) for _ in range(3)] for _ in range(5)]
    table = spark.createDataFrame([(f"o{i}", o) for i, o in enumerate(outcomes)], "outcome_id string, mains array<int>")
    got = scoring.portfolio_chance(spark.createDataFrame([(b,) for b in books], "structure array<array<int>>"), table).collect()
    assert len(got) == 5
    for r in got:
        best = np.array([max(len(set(line) & set(o)) for line in r["structure"]) for o in outcomes])
        assert r["chance"] == pytest.approx((best >= 3).mean())
        assert r["match_mean"] == pytest.approx(best.mean()) and r["match_variance"] == pytest.approx(best.var())


def test_equal_overlaps_share_a_structure(spark):
    books = [[[1, 2, 3, 4, 5, 6], [7, 8, 9, 10, 11, 12]], [[2, 9, 13, 20, 31, 44], [1, 3, 5, 7, 11, 17]]]
    df = spark.createDataFrame([(b,) for b in books], "lines array<array<int>>")
    assert df.select(scoring.canonical_structure(F.col("lines"))).distinct().count() == 1


def newton(x, y, c, steps=25):
    m, s = x.mean(0), x.std(0)
    z = np.column_stack([np.ones(len(x)), (x - m) / np.where(s > 1e-12, s, 1)])
    w, pen = np.zeros(z.shape[1]), np.diag([0.0] + [1 / c] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z @ w))
        w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pen, z.T @ (y - p) - pen @ w)
    return 1 / (1 + np.exp(-z @ w))


def test_logistic_fits_of_many_models(spark):
    rows, truth = [], {}
    for key, size in (("a", 900), ("b", 60), ("c", 200)):
        x = RNG.normal(size=(size, 3)) * [1, 5, 0.1]
        y = (RNG.random(size) < 1 / (1 + np.exp(-(x @ [0.8, -0.2, 3] - 1)))).astype(int)
        for cost in (0.01, 1.0):
            truth[key, cost] = newton(x, y, cost)
        rows += [(key, i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "key string, i int, u double, v double, w double, hit int")
    asked = df.withColumn("C", F.explode(F.array(F.lit(0.01), F.lit(1.0)))).repartition(6)
    columns = ["u", "v", "w"]
    models = learn.fit_logistic(asked, ["key", "C"], columns, c=F.col("C"))
    assert models.agg(F.max("last_step")).first()[0] < 1e-6
    for r in learn.predict_logistic(asked, models, ["key", "C"], columns).collect():
        assert r["probability"] == pytest.approx(truth[r["key"], r["C"]][r["i"]], abs=1e-6)


def _population(spark, n, change_last=False):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(n):
        mains = sorted(int(x) + 1 for x in rng.choice(20, 6, replace=False))
        if change_last and i == n - 1:
            mains = [1, 2, 3, 4, 5, 6]
        rows.append(("g", "r", date(2020, 1, 6) + timedelta(days=7 * i), 20, mains, i % 17 == 3))
    return spark.createDataFrame(rows, "game string, rule_code string, draw_date date, pool int, mains array<int>, gap_before boolean")


def test_changing_the_future_leaves_past_features_alone(spark):
    a = features.feature_table(_population(spark, 40))
    b = features.feature_table(_population(spark, 40, change_last=True))
    columns = ["draw_idx", "number", *features.FEATURE_COLUMNS]
    assert a.select(*columns).exceptAll(b.select(*columns)).isEmpty()
    assert not a.select("draw_idx", "number", "hit").exceptAll(b.select("draw_idx", "number", "hit")).isEmpty()


def test_walk_forward_sees_no_target(spark):
    columns = ["freq_10", "recency"]
    kept = ["draw_idx", "number", F.round("probability", 9).alias("p")]
    parts = []
    for change in (False, True):
        rows = features.feature_table(_population(spark, 60, change))
        predicted = learn.walk_forward_logistic(rows, 40, block=5, warmup=10, columns=columns)
        assert learn.leaked_targets(predicted).isEmpty() and predicted.count() == 20 * 20
        parts.append(predicted.select(*kept))
    assert parts[0].exceptAll(parts[1]).isEmpty()


def test_training_windows(spark):
    rows = features.feature_table(_population(spark, 30))
    blocks = spark.createDataFrame([("g", "r", 20), ("g", "r", 25)], "game string, rule_code string, block_start int")
    got = features.training_windows(rows, blocks, warmup=5, window=10).groupBy("block_start").agg(F.min("draw_idx"), F.max("draw_idx"), F.count("*"))
    assert {tuple(r) for r in got.collect()} == {(20, 10, 19, 200), (25, 15, 24, 200)}


def test_ranks_over_ranges_equal_a_plain_sort(spark):
    from drawloom.operators import scoring

    rows = spark.range(5000, numPartitions=7).select("id", F.pmod(F.xxhash64("id"), F.lit(40)).alias("v"))
    ranked = scoring.rank_candidates(rows, F.desc("v"), F.col("id"))
    want = {r["id"]: i + 1 for i, r in enumerate(sorted(rows.collect(), key=lambda r: (-r["v"], r["id"])))}
    assert {r["id"]: r["rank"] for r in ranked.collect()} == want
    top = scoring.top_candidates(rows, 10, F.desc("v"), F.col("id"))
    assert {r["id"]: r["rank"] for r in top.collect()} == {k: n for k, n in want.items() if n <= 10}
    assert scoring.rank_candidates(rows.limit(0), F.col("id")).isEmpty()


def test_two_sided_binomial_equals_the_sum_of_no_likelier_counts():
    from drawloom.functions.tails import two_sided

    for n, p in ((1, 0.5), (7, 0.02), (40, 0.3), (40, 0.5), (300, 0.021), (60, 0.97)):
        mass = [comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
        for x in range(n + 1):
            if mass[x] > 1e-280:
                assert two_sided(x, n, p) == pytest.approx(min(1.0, sum(m for m in mass if m <= mass[x] * (1 + 1e-7))), rel=1e-6, abs=1e-12)


def test_findings_are_judged_by_their_nulls(spark):
    from drawloom.operators import inference

    primary = spark.createDataFrame([("a", 9, 100, 0.02), ("b", 2, 100, 0.02), ("c", 2, 100, 0.02)], "game string, events bigint, trials bigint, p0 double")
    nulls = spark.createDataFrame([("a", s, 2, 100) for s in range(100)] + [("b", s, 9, 100) for s in range(100)], "game string, replicate int, events int, trials int")
    got = {r["game"]: r for r in inference.exact_null(primary, nulls, ["game"]).collect()}
    assert got["a"]["final"] and got["a"]["monte_carlo_p"] == pytest.approx(1 / 101)
    assert not got["b"]["final"] and got["b"]["check_p"] < 1e-9  # null histories disagree with the exact chance
    assert not got["c"]["final"] and got["c"]["null_replicates"] == 0
    lines = spark.createDataFrame([("g", i, [1, 2, 3], [1, 2, 3] if i == 0 else [7, 8, 9]) for i in range(3)], "game string, draw_date int, mains array<int>, outcome array<int>")
    assert [(r["replicate"], r["events"], r["trials"]) for r in inference.rotated_nulls(lines, ["game"]).orderBy("replicate").collect()] == [(1, 1, 3), (2, 1, 3)]
