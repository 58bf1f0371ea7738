"""Exact rates, tests, bootstrap, findings, market and return tables."""

from pyspark.sql import functions as F

from drawloom.functions import scalars as sc
from drawloom.operators import features, inference, returns, scoring
from drawloom.functions.tails import normal_tail
from drawloom.plans import relations as rel
from drawloom.plans.catalog.scoring import DIGEST, matched, probabilities  # noqa: F401
from drawloom.plans.registry import query
from drawloom.plans.relations_sql import RELATIONS, uniform
from drawloom.session import cut_lineage

SINGLES = ("top6", "hot", "cold", "overdue")

RELATIONS["single_hits"] = """
SELECT method AS policy, game, draw_date, matched, CAST(matched >= 3 AS INT) AS hit, CAST(matched >= 2 AS INT) AS near
FROM (SELECT l.source, CASE WHEN l.source = 'frequency' THEN 'top6' ELSE l.source END AS method, l.game, l.draw_date,
      CAST(len(list_intersect(l.mains, w.mains)) AS INT) AS matched
      FROM top_lines l JOIN week_draws w ON w.game = l.game AND w.draw_date = l.draw_date) x
"""
RELATIONS["hit_rates"] = """
SELECT policy, game, sum(hit) AS events, count(*) AS trials, 75249.0 / 3579191.0 AS p0 FROM single_hits GROUP BY 1, 2
"""
# P(Binomial(trials, p) >= events) by summing the probabilities.
_TAIL = """(SELECT coalesce(sum(exp(lgamma(r.trials + 1) - lgamma(k.k + 1) - lgamma(r.trials - k.k + 1) + k.k * ln({p}) + (r.trials - k.k) * ln(1 - {p}))), 0)
  FROM (SELECT CAST(range AS DOUBLE) AS k FROM range(0, 1000)) k WHERE k.k >= {x} AND k.k <= r.trials)"""


def single_hits(spark, d):
    lines = matched_singles(spark, d)
    return lines.select(
        F.col("method").alias("policy"),
        "game",
        "draw_date",
        "pool",
        "matched",
        (F.col("matched") >= 3).cast("int").alias("hit"),
        (F.col("matched") >= 2).cast("int").alias("near"),
    )


def matched_singles(spark, d):
    from drawloom.plans.catalog.scoring import study_lines

    return scoring.match_lines(study_lines(spark, d, SINGLES), rel.draws(spark, d))


@query(
    "D21_exact_rates",
    "policy:s game:s events:i trials:i rate:f p0:f improvement:f rate_lower:f rate_upper:f excludes_zero:i",
    f"""WITH RECURSIVE_MARK bisect AS (
         SELECT policy, game, CAST(events AS DOUBLE) AS events, CAST(trials AS DOUBLE) AS trials, p0, side, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi, 0 AS step
         FROM hit_rates, (VALUES ('lower'), ('upper')) s(side)
         UNION ALL
         SELECT policy, game, events, trials, p0, side,
           CASE WHEN below THEN (lo + hi) / 2 ELSE lo END, CASE WHEN below THEN hi ELSE (lo + hi) / 2 END, step + 1
         FROM (SELECT r.*, CASE WHEN side = 'lower' THEN {_TAIL.format(p='((r.lo + r.hi) / 2)', x='r.events')} < 0.025
                 ELSE {_TAIL.format(p='((r.lo + r.hi) / 2)', x='r.events + 1')} < 0.975 END AS below FROM bisect r WHERE r.step < 40) z),
       bounds AS (SELECT policy, game, max(CASE WHEN side = 'lower' THEN CASE WHEN events = 0 THEN 0 ELSE (lo + hi) / 2 END END) AS lower,
         max(CASE WHEN side = 'upper' THEN CASE WHEN events = trials THEN 1 ELSE (lo + hi) / 2 END END) AS upper FROM bisect WHERE step = 40 GROUP BY 1, 2)
       ;; SELECT h.policy, h.game, h.events, h.trials, h.events / h.trials AS rate, h.p0, h.events / h.trials - h.p0 AS improvement,
       b.lower AS rate_lower, b.upper AS rate_upper, CAST(b.lower > h.p0 AS INT) AS excludes_zero FROM hit_rates h JOIN bounds b USING (policy, game)""".replace(
        "RECURSIVE_MARK", "/*RECURSIVE*/"
    ),
)
def exact_rates(spark, d):
    return inference.exact_rates(single_hits(spark, d), ["policy", "game"])


@query(
    "D24_exact_binomial_test",
    "policy:s game:s events:i trials:i p_value:f",
    f"SELECT policy, game, events, trials, {_TAIL.format(p='r.p0', x='r.events')} AS p_value FROM hit_rates r",
)
def exact_binomial_test(spark, d):
    return inference.exact_tests(inference.exact_rates(single_hits(spark, d), ["policy", "game"]))


@query(
    "D22_event_tail",
    "policy:s p_value:f",
    f"""SELECT policy, {_TAIL.format(p='r.p0', x='r.events')} AS p_value
        FROM (SELECT policy, CAST(sum(events) AS DOUBLE) AS events, CAST(sum(trials) AS DOUBLE) AS trials, max(p0) AS p0 FROM hit_rates GROUP BY 1) r""",
)
def event_tail(spark, d):
    rows = single_hits(spark, d).withColumn("chance", sc.match_tail(F.col("pool"), 3))
    return scoring.event_tail(rows, ["policy"], F.col("hit") == 1)


_NORMAL = """(SELECT sum(CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(z + i * 0.003, 2) / 2)) * 0.003 / 3 / sqrt(2 * pi())
  FROM range(0, 4001) t(i))"""


@query(
    "D23_match_sum_test",
    "policy:s matches:i expected:f z:f p_value:f",
    f"""SELECT policy, matches, expected, z, {_NORMAL} AS p_value FROM (
        SELECT policy, sum(matched) AS matches, count(*) * 36.0 / 47 AS expected,
          (sum(matched) - count(*) * 36.0 / 47) / sqrt(count(*) * 6 * (6.0 / 47) * (1 - 6.0 / 47) * 41 / 46.0) AS z FROM single_hits GROUP BY 1) r""",
)
def match_sum_test(spark, d):
    moments = sc_moments()
    rows = single_hits(spark, d).select("policy", "matched", *moments)
    z = (F.col("matches") - F.col("expected")) / F.sqrt("variance")
    grouped = rows.groupBy("policy").agg(
        F.sum("matched").alias("matches"), F.sum("match_mean").alias("expected"), F.sum("match_variance").alias("variance")
    )
    return grouped.withColumn("z", z).withColumn("p_value", normal_tail("z"))


def sc_moments():
    chance = scoring.single_line_chance(F.col("pool"))
    return [chance[c].alias(c) for c in ("match_mean", "match_variance")]


@query(
    "E11_holm_adjustment",
    "family:s test:s p_value:f holm_p_value:f",
    f"""WITH t AS (SELECT game AS family, policy AS test, {_TAIL.format(p='r.p0', x='r.events')} AS p_value FROM hit_rates r),
        s AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p_value, test) + 1) * p_value) AS st FROM t)
        ;; SELECT family, test, p_value, max(st) OVER (PARTITION BY family ORDER BY p_value, test) AS holm_p_value FROM s""",
)
def holm_adjustment(spark, d):
    tests = inference.exact_tests(inference.exact_rates(single_hits(spark, d), ["policy", "game"]))
    named = tests.select(F.col("game").alias("family"), F.col("policy").alias("test"), "p_value")
    return scoring.holm(named, ["family"])


@query(
    "D25_monte_carlo_p",
    "game:s replicates:i p_value:f",
    """WITH yearly AS (SELECT policy, game, year(draw_date) AS y, avg(near) AS rate FROM single_hits GROUP BY 1, 2, 3)
       ;; SELECT game, count(*) FILTER (WHERE policy <> 'top6') AS replicates,
       (1 + count(*) FILTER (WHERE policy <> 'top6' AND rate >= obs)) / (1 + count(*) FILTER (WHERE policy <> 'top6')) AS p_value
       FROM (SELECT y1.*, (SELECT avg(near) FROM single_hits h WHERE h.policy = 'top6' AND h.game = y1.game) AS obs FROM yearly y1) z GROUP BY 1""",
)
def monte_carlo_p(spark, d):
    """Yearly rates of the rule-based lines as the null table, the overall top-six rate as the observed statistic."""
    hits = single_hits(spark, d)
    observed = hits.filter("policy = 'top6'").groupBy("game").agg(F.avg("near").alias("observed"))
    nulls = hits.filter("policy <> 'top6'").groupBy("policy", "game", F.year("draw_date")).agg(F.avg("near").alias("statistic"))
    return inference.monte_carlo_p(nulls.join(observed, "game"), ["game"], "statistic", "observed")


REPLICATES = inference.REPLICATES
RELATIONS["paired_rows"] = """
SELECT game, draw_date, d AS difference, row_number() OVER (PARTITION BY game ORDER BY draw_date) - 1 AS row_idx, count(*) OVER (PARTITION BY game) AS n
FROM (SELECT game, draw_date, CAST(sum(CASE policy WHEN 'top6' THEN near WHEN 'cold' THEN -near ELSE 0 END) AS DOUBLE) AS d FROM single_hits GROUP BY 1, 2) x
"""


def _boot_sql(block):
    start = uniform("'boot'", "s.game", "CAST(r.replicate AS VARCHAR)", f"CAST(p.row_idx // {block} AS VARCHAR)")
    return f"""WITH s AS (SELECT DISTINCT game, n FROM paired_rows), r AS (SELECT range AS replicate FROM range(0, {REPLICATES})),
      picks AS (SELECT s.game, r.replicate, (CAST(floor({start} * s.n) AS BIGINT) + p.row_idx % {block}) % s.n AS at FROM s JOIN paired_rows p ON p.game = s.game, r),
      means AS (SELECT k.game, k.replicate, avg(p.difference) AS mean FROM picks k JOIN paired_rows p ON p.game = k.game AND p.row_idx = k.at GROUP BY 1, 2)
      ;; SELECT m.game, count(*) AS replicates, {block} AS block_length, max(o.o) AS mean_difference, quantile_cont(mean, 0.025) AS lower, quantile_cont(mean, 0.975) AS upper,
      (1 + count(*) FILTER (WHERE mean <= 0)) / (count(*) + 1) AS p_value
      FROM means m JOIN (SELECT game, avg(difference) AS o FROM paired_rows GROUP BY 1) o USING (game) GROUP BY 1"""


def paired(spark, d):
    hits = single_hits(spark, d).select("policy", "game", "draw_date", F.col("near").alias("hit"))
    return inference.paired_differences(hits, "top6", "cold", ["game"])


for _block in (1, 5):

    @query(
        "D26_paired_bootstrap" if _block == 1 else "D26_block_bootstrap",
        "game:s replicates:i block_length:i mean_difference:f lower:f upper:f p_value:f",
        _boot_sql(_block),
    )
    def _bootstrap(spark, d, block=_block):
        rows = paired(spark, d)
        means = inference.bootstrap_means(rows, ["game"], REPLICATES, "boot", block)
        return inference.bootstrap_summary(rows, means, ["game"], block)


@query(
    "D33_rate_band",
    "policy:s game:s rate:f p0:f band:f within_band:i",
    """SELECT policy, game, events / trials AS rate, p0, 5 * sqrt(p0 * (1 - p0) / trials) + 1.0 / trials AS band,
       CAST(abs(events / trials - p0) <= 5 * sqrt(p0 * (1 - p0) / trials) + 1.0 / trials AS INT) AS within_band FROM hit_rates""",
)
def rate_band(spark, d):
    rates = inference.exact_rates(single_hits(spark, d), ["policy", "game"])
    return scoring.tail_band(rates, "rate", "p0", "trials")


@query(
    "R22_findings",
    "game:s holdout_draws:i first_date:s last_date:s events:i rate:f p0:f exact_p:f mean_difference:f lower:f upper:f log_loss:f verdict:s",
)
def findings(spark, d):
    """Primary rate, exact test, bootstrap and log loss of the top-six line, joined to one row per series."""
    hits = single_hits(spark, d)
    top = hits.filter("policy = 'top6'")
    span = top.groupBy("game").agg(F.min("draw_date").alias("first_date"), F.max("draw_date").alias("last_date"))
    primary = inference.exact_tests(inference.exact_rates(top, ["game"]), out="exact_p")
    rows = paired(spark, d)
    boot = inference.bootstrap_summary(rows, inference.bootstrap_means(rows, ["game"], REPLICATES, "boot"), ["game"])
    loss = scoring.probability_scores(probabilities(spark, d).filter("source = 'frequency'"), ["game"])
    final = F.col("trials") >= 100
    return (
        primary.join(span, "game")
        .join(boot.select("game", "mean_difference", "lower", "upper"), "game")
        .join(loss.select("game", "log_loss"), "game")
        .withColumn("holdout_draws", F.col("trials"))
        .withColumn("verdict", inference.verdict(F.col("improvement"), F.col("excludes_zero"), F.col("exact_p"), final, F.lit(True)))
    )


BUDGETS = (5, 10)
RELATIONS["secondary_rows"] = """
SELECT game, test, difference, row_number() OVER (PARTITION BY game, test ORDER BY draw_date) - 1 AS row_idx, count(*) OVER (PARTITION BY game, test) AS n FROM (
  SELECT h.game, 'budget_' || b.budget || '_any_line_3_plus' AS test, h.draw_date, CAST(sum(CASE WHEN h.method = 'coverage' || b.budget THEN h.hit ELSE -h.hit END) AS DOUBLE) AS difference
  FROM (SELECT method, game, draw_date, CAST(max(matched) >= 3 AS INT) AS hit FROM scored_lines GROUP BY 1, 2, 3) h
  JOIN (VALUES (5), (10)) b(budget) ON h.method IN ('coverage' || b.budget, 'random' || b.budget) GROUP BY 1, 2, 3) x
"""
_START = uniform("'second'", "s.game", "s.test", "CAST(r.replicate AS VARCHAR)", "CAST(p.row_idx AS VARCHAR)")


@query(
    "R25_secondary_tests",
    "game:s test:s trials:i p_value:f holm_p_value:f",
    f"""WITH five AS (SELECT game, CAST(sum(CAST(matched >= 5 AS INT)) AS DOUBLE) AS events, CAST(count(*) AS DOUBLE) AS trials, 247.0 / 10737573.0 AS p0 FROM single_hits WHERE policy = 'top6' GROUP BY 1),
       s AS (SELECT DISTINCT game, test, n FROM secondary_rows), r AS (SELECT range AS replicate FROM range(0, {REPLICATES})),
       picks AS (SELECT s.game, s.test, r.replicate, CAST(floor({_START} * s.n) AS BIGINT) AS at FROM s JOIN secondary_rows p ON p.game = s.game AND p.test = s.test, r),
       means AS (SELECT k.game, k.test, k.replicate, avg(p.difference) AS mean, max(p.n) AS n FROM picks k JOIN secondary_rows p ON p.game = k.game AND p.test = k.test AND p.row_idx = k.at GROUP BY 1, 2, 3),
       t AS (SELECT game, 'one_line_5_plus' AS test, trials, {_TAIL.format(p='r.p0', x='r.events')} AS p_value FROM five r
         UNION ALL SELECT game, test, max(n), (1 + count(*) FILTER (WHERE mean <= 0)) / (count(*) + 1) FROM means GROUP BY 1, 2),
       h AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY game) - row_number() OVER (PARTITION BY game ORDER BY p_value, test) + 1) * p_value) AS st FROM t)
       ;; SELECT game, test, trials, p_value, max(st) OVER (PARTITION BY game ORDER BY p_value, test) AS holm_p_value FROM h""",
)
def secondary(spark, d):
    """Exact test of one line at 5+, bootstrap tests of any line at 3+ against uniform lines, and their Holm adjustment."""
    from drawloom.plans.catalog.scoring import study_lines

    wanted = ("top6", *(f"{m}{b}" for m in ("coverage", "random") for b in BUDGETS))
    rows = scoring.match_lines(study_lines(spark, d, wanted), rel.draws(spark, d))
    return inference.secondary_tests(rows, "top6", {b: (f"coverage{b}", f"random{b}") for b in BUDGETS}, REPLICATES, "second")


_HOLD = "SELECT game, draw_date FROM (SELECT *, count(*) OVER (PARTITION BY game) AS n FROM week_pop) x WHERE draw_idx >= n - CAST(ceil(n / 5.0) AS INT)"
_BEFORE = "(lgamma(trials + 1) - lgamma(k + 1) - lgamma(trials - k + 1) + k * ln(p0) + (trials - k) * ln(1 - p0))"


def _means_sql(rows, keys, seed, block=1):
    """Resampled means of ``rows`` (keys, row_idx, n, difference) as the operator draws them."""
    names = [f"p.{k}" for k in keys]
    start = uniform(f"'{seed}'", *names, "CAST(r.replicate AS VARCHAR)", f"CAST(p.row_idx // {block} AS VARCHAR)")
    same = " AND ".join(f"q.{k} = k.{k}" for k in keys)
    listed = ", ".join(f"k.{k}" for k in keys)
    return f"""SELECT {listed}, k.replicate, avg(q.difference) AS mean, max(q.n) AS n FROM (
        SELECT {", ".join(names)}, r.replicate, (CAST(floor({start} * p.n) AS BIGINT) + p.row_idx % {block}) % p.n AS at FROM {rows} p, (SELECT range AS replicate FROM range(0, {REPLICATES})) r) k
      JOIN {rows} q ON {same} AND q.row_idx = k.at GROUP BY {listed}, k.replicate"""


@query(
    "R22_holdout_findings",
    "game:s holdout_draws:i first_date:s last_date:s events:i rate:f rate_lower:f rate_upper:f p0:f exact_p:f null_replicates:i monte_carlo_p:f check_p:f final:i mean_difference:f lower:f upper:f "
    "block_lower:f block_upper:f five_p:f five_holm:f budget_5_p:f budget_5_holm:f budget_10_p:f budget_10_holm:f calibration_gap:f calibration_bins:i brier:f log_loss:f verdict:s",
    f"""WITH /*RECURSIVE*/ hold AS MATERIALIZED (SELECT l.* FROM scored_lines l JOIN ({_HOLD}) h USING (game, draw_date)),
      tops AS MATERIALIZED (SELECT game, draw_date, mains, outcome, matched, row_number() OVER (PARTITION BY game ORDER BY draw_date) - 1 AS i, count(*) OVER (PARTITION BY game) AS n FROM hold WHERE method = 'top6'),
      hr AS MATERIALIZED (SELECT game, CAST(sum(CAST(matched >= 3 AS INT)) AS DOUBLE) AS events, CAST(sum(CAST(matched >= 5 AS INT)) AS DOUBLE) AS fives, CAST(count(*) AS DOUBLE) AS trials,
        75249.0 / 3579191.0 AS p0, 247.0 / 10737573.0 AS p5, min(draw_date) AS first_date, max(draw_date) AS last_date FROM tops GROUP BY 1),
      bisect AS (SELECT game, events, trials, side, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi, 0 AS step FROM hr, (VALUES ('lower'), ('upper')) s(side)
        UNION ALL SELECT game, events, trials, side, CASE WHEN below THEN (lo + hi) / 2 ELSE lo END, CASE WHEN below THEN hi ELSE (lo + hi) / 2 END, step + 1
        FROM (SELECT r.*, CASE WHEN side = 'lower' THEN {_TAIL.format(p='((r.lo + r.hi) / 2)', x='r.events')} < 0.025 ELSE {_TAIL.format(p='((r.lo + r.hi) / 2)', x='r.events + 1')} < 0.975 END AS below FROM bisect r WHERE r.step < 40) z),
      bounds AS (SELECT game, max(CASE WHEN side = 'lower' THEN CASE WHEN events = 0 THEN 0 ELSE (lo + hi) / 2 END END) AS rate_lower, max(CASE WHEN side = 'upper' THEN CASE WHEN events = trials THEN 1 ELSE (lo + hi) / 2 END END) AS rate_upper
        FROM bisect WHERE step = 40 GROUP BY 1),
      nulls AS MATERIALIZED (SELECT a.game, s.s, sum(CAST(len(list_intersect(a.mains, b.outcome)) >= 3 AS INT)) AS e FROM tops a JOIN (SELECT range AS s FROM range(1, {inference.CHECK_REPLICATES + 1})) s ON s.s < a.n
        JOIN tops b ON b.game = a.game AND b.i = (a.i + s.s) % a.n GROUP BY 1, 2),
      pooled AS MATERIALIZED (SELECT n.game, count(*) AS null_replicates, CAST(sum(e) AS DOUBLE) AS events, count(*) * max(r.trials) AS trials, max(r.p0) AS p0, (1 + count(*) FILTER (WHERE n.e >= r.events)) / (count(*) + 1) AS monte_carlo_p
        FROM nulls n JOIN hr r USING (game) GROUP BY 1),
      pmf AS MATERIALIZED (SELECT game, k, events, {_BEFORE} AS w FROM pooled, (SELECT CAST(range AS DOUBLE) AS k FROM range(0, 200000)) t WHERE k <= trials),
      checked AS (SELECT p.game, least(1.0, sum(exp(p.w))) AS check_p FROM pmf p JOIN pmf o ON o.game = p.game AND o.k = o.events WHERE p.w <= o.w + 1e-7 GROUP BY 1),
      hits AS MATERIALIZED (SELECT game, draw_date, method, CAST(max(matched) >= 3 AS INT) AS hit FROM hold GROUP BY 1, 2, 3),
      pairs AS (SELECT game, draw_date, t.test, CAST(sum(CASE WHEN h.method = t.model THEN h.hit ELSE -h.hit END) AS DOUBLE) AS difference
        FROM hits h JOIN (VALUES ('single', 'top6', 'random1'), ('budget_5_any_line_3_plus', 'coverage5', 'random5'), ('budget_10_any_line_3_plus', 'coverage10', 'random10')) t(test, model, base) ON h.method IN (t.model, t.base) GROUP BY 1, 2, 3),
      placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY game, test ORDER BY draw_date) - 1 AS row_idx, count(*) OVER (PARTITION BY game, test) AS n FROM pairs),
      ones AS MATERIALIZED (SELECT * FROM placed WHERE test = 'single'), others AS MATERIALIZED (SELECT * FROM placed WHERE test <> 'single'),
      boot AS (SELECT game, quantile_cont(mean, 0.025) AS lower, quantile_cont(mean, 0.975) AS upper FROM ({_means_sql('ones', ['game'], 'found')}) m GROUP BY 1),
      blocks AS (SELECT game, quantile_cont(mean, 0.025) AS block_lower, quantile_cont(mean, 0.975) AS block_upper FROM ({_means_sql('ones', ['game'], 'foundblock_', 5)}) m GROUP BY 1),
      tests AS (SELECT game, 'one_line_5_plus' AS test, {_TAIL.format(p='r.p5', x='r.fives')} AS p_value FROM hr r
        UNION ALL SELECT game, test, (1 + count(*) FILTER (WHERE mean <= 0)) / (count(*) + 1) FROM ({_means_sql('others', ['game', 'test'], 'foundsecond')}) m GROUP BY 1, 2),
      steps AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY game) - row_number() OVER (PARTITION BY game ORDER BY p_value, test) + 1) * p_value) AS st FROM tests),
      held AS MATERIALIZED (SELECT game, test, p_value AS p, max(st) OVER (PARTITION BY game ORDER BY p_value, test) AS h FROM steps),
      pivoted AS (SELECT game, max(p) FILTER (WHERE test LIKE 'one%') AS five_p, max(h) FILTER (WHERE test LIKE 'one%') AS five_holm, max(p) FILTER (WHERE test LIKE 'budget_5%') AS budget_5_p, max(h) FILTER (WHERE test LIKE 'budget_5%') AS budget_5_holm,
        max(p) FILTER (WHERE test LIKE 'budget_10%') AS budget_10_p, max(h) FILTER (WHERE test LIKE 'budget_10%') AS budget_10_holm FROM held GROUP BY 1),
      guesses AS MATERIALIZED (SELECT p.* FROM probability_rows p JOIN ({_HOLD}) h USING (game, draw_date) WHERE p.source = 'frequency'),
      cal AS (SELECT game, sum(c * abs(p - y)) / sum(c) AS calibration_gap, count(*) AS calibration_bins FROM (
        SELECT game, least(floor(probability * 10), 9) AS bin, count(*) AS c, avg(probability) AS p, avg(drawn) AS y FROM guesses GROUP BY 1, 2) b GROUP BY 1),
      loss AS (SELECT game, avg(b) AS brier, avg(l) AS log_loss FROM (SELECT game, draw_date, avg(pow(probability - drawn, 2)) AS b,
        avg(-(drawn * ln(greatest(least(probability, 1 - 1e-15), 1e-15)) + (1 - drawn) * ln(1 - greatest(least(probability, 1 - 1e-15), 1e-15)))) AS l FROM guesses GROUP BY 1, 2) t GROUP BY 1),
      whole AS (SELECT r.*, r.trials AS holdout_draws, r.events / r.trials AS rate, {_TAIL.format(p='r.p0', x='r.events')} AS exact_p, b.* EXCLUDE (game), coalesce(p.null_replicates, 0) AS null_replicates, p.monte_carlo_p, c.check_p,
        CAST(coalesce(p.null_replicates >= {inference.CHECK_REPLICATES} AND c.check_p > {inference.CHECK_ALPHA}, FALSE) AS INT) AS final, o.mean_difference, boot.* EXCLUDE (game), blocks.* EXCLUDE (game), pivoted.* EXCLUDE (game), cal.* EXCLUDE (game), loss.* EXCLUDE (game)
        FROM hr r JOIN bounds b USING (game) LEFT JOIN pooled p USING (game) LEFT JOIN checked c USING (game) LEFT JOIN (SELECT game, avg(difference) AS mean_difference FROM ones GROUP BY 1) o USING (game)
        LEFT JOIN boot USING (game) LEFT JOIN blocks USING (game) LEFT JOIN pivoted USING (game) LEFT JOIN cal USING (game) LEFT JOIN loss USING (game))
      ;; SELECT *, CASE WHEN rate > p0 AND rate_lower > p0 AND final = 1 AND exact_p <= 0.05 THEN 'promising' WHEN NOT coalesce(check_p > {inference.CHECK_ALPHA}, TRUE) THEN 'invalid' WHEN final = 0 THEN 'not_final' ELSE 'no_advantage' END AS verdict FROM whole""",
)
def holdout_findings(spark, d):
    """Findings over the holdout fifth of each series, all at the study's threshold of three numbers."""
    from drawloom.plans.catalog.scoring import study_lines

    roles = features.protocol_splits(rel.population(spark, d)).filter("role = 'holdout'").select("game", "draw_date")
    wanted = ("top6", "random1", *(f"{m}{b}" for m in ("coverage", "random") for b in BUDGETS))
    rows = scoring.match_lines(study_lines(spark, d, wanted), rel.draws(spark, d)).join(roles, ["game", "draw_date"])
    guesses = probabilities(spark, d).filter("source = 'frequency'").join(roles, ["game", "draw_date"])
    pairs = {b: (f"coverage{b}", f"random{b}") for b in BUDGETS}
    return inference.findings(cut_lineage(rows), cut_lineage(guesses), "top6", "random1", pairs, REPLICATES, "found")


# --- odds and returns ----------------------------------------------------------------

_C = "(SELECT exp(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1)))"


@query(
    "H9_match_odds",
    "pool:i draws:i p_3_plus:f mean:f tier:s odds:f",
    """WITH pools AS (SELECT pool, count(*) AS draws FROM day_pop GROUP BY 1),
         p AS (SELECT pool, draws, exp(lgamma(pool + 1) - lgamma(7) - lgamma(pool - 5)) AS total FROM pools),
         k AS (SELECT p.*, m.k, exp(lgamma(7) - lgamma(m.k + 1) - lgamma(7 - m.k)) * exp(lgamma(pool - 5) - lgamma(7 - m.k) - lgamma(pool - 11 + m.k)) / total AS pk
           FROM p, (SELECT CAST(range AS INT) AS k FROM range(0, 7)) m),
         t(tier, k, b) AS (VALUES ('Match 6', 6, 2), ('Match 5 + Bonus', 5, 1), ('Match 5', 5, 0), ('Match 4 + Bonus', 4, 1), ('Match 4', 4, 0),
           ('Match 3 + Bonus', 3, 1), ('Match 3', 3, 0), ('Match 2 + Bonus', 2, 1))
       ;; SELECT a.pool, a.draws, (SELECT sum(pk) FROM k WHERE k.pool = a.pool AND k.k >= 3) AS p_3_plus, 36.0 / a.pool AS mean, t.tier,
       a.pk * CASE t.b WHEN 2 THEN 1 WHEN 1 THEN (6.0 - t.k) / (a.pool - 6) ELSE 1 - (6.0 - t.k) / (a.pool - 6) END AS odds
       FROM k a JOIN t ON t.k = a.k""",
)
def match_odds(spark, d):
    pools = rel.population(spark, d, "day").groupBy("pool").agg(F.count("*").alias("draws"))
    pool = F.col("pool")
    tiers = F.array(*[F.struct(F.lit(n).alias("tier"), sc.tier_probability(pool, m, b).alias("odds")) for n, m, b in sc.TIERS])
    return pools.select(
        "pool", "draws", sc.match_tail(pool, 3).alias("p_3_plus"), (F.lit(36.0) / pool).alias("mean"), F.explode(tiers).alias("t")
    ).select("pool", "draws", "p_3_plus", "mean", "t.*")


RELATIONS["market_rows"] = """
SELECT p.game, p.rule_code, m3 / (exp(lgamma(7) - lgamma(4) - lgamma(4)) * exp(lgamma(42) - lgamma(4) - lgamma(39)) / exp(lgamma(48) - lgamma(7) - lgamma(42)) * (1 - 3.0 / 41)) AS lines_sold,
  j.draws, j.last_draw, CASE WHEN j.won THEN j.first_j ELSE j.last_j END AS next_jackpot, j.first_j AS starting_jackpot, p.p5b, p.p5, p.p4b, p.p4, p.p3b, p.p3
FROM (SELECT w.game, w.rule_code, median(CASE WHEN tier = 'Match 5 + Bonus' THEN CAST(amount AS DOUBLE) END) AS p5b, median(CASE WHEN tier = 'Match 5' THEN CAST(amount AS DOUBLE) END) AS p5,
        median(CASE WHEN tier = 'Match 4 + Bonus' THEN CAST(amount AS DOUBLE) END) AS p4b, median(CASE WHEN tier = 'Match 4' THEN CAST(amount AS DOUBLE) END) AS p4,
        median(CASE WHEN tier = 'Match 3 + Bonus' THEN CAST(amount AS DOUBLE) END) AS p3b, median(CASE WHEN tier = 'Match 3' THEN CAST(amount AS DOUBLE) END) AS p3,
        median(CASE WHEN tier = 'Match 3' THEN winners END) AS m3
      FROM week_pop w JOIN prize_facts f USING (game, draw_date) GROUP BY 1, 2) p
JOIN (SELECT w.game, count(*) AS draws, max(w.draw_date) AS last_draw, arg_min(CAST(c.jackpot AS DOUBLE), w.draw_date) AS first_j, arg_max(CAST(c.jackpot AS DOUBLE), w.draw_date) AS last_j,
        arg_max(coalesce(f.winners > 0, FALSE), w.draw_date) AS won
      FROM week_pop w JOIN context_rows c USING (game, draw_date)
      LEFT JOIN (SELECT * FROM prize_facts WHERE tier = 'Match 6') f ON f.game = w.game AND f.draw_date = w.draw_date GROUP BY 1) j ON j.game = p.game
"""


def markets(spark, d):
    population = rel.population(spark, d).select("game", "rule_code", "draw_date", "pool")
    prizes = population.join(rel.prize_facts(spark, d), ["game", "draw_date"])
    jackpots = population.join(rel.context_rows(spark, d), ["game", "draw_date"])
    regimes = population.groupBy("game", "rule_code").agg(F.max("pool").alias("pool"))
    return returns.market(prizes, jackpots, regimes)


@query(
    "D20_market_profile",
    "game:s rule_code:s draws:i last_draw:s next_jackpot:f starting_jackpot:f p5b:f p5:f p4b:f p4:f p3b:f p3:f lines_sold:f",
    "SELECT * FROM market_rows",
)
def market_profile(spark, d):
    names = {"p5b": "Match 5 + Bonus", "p5": "Match 5", "p4b": "Match 4 + Bonus", "p4": "Match 4", "p3b": "Match 3 + Bonus", "p3": "Match 3"}
    return markets(spark, d).select("*", *[F.col("prizes")[t].alias(c) for c, t in names.items()])


_VALUE = """v AS (SELECT m.*, o.p6, o.p6 + o.t5b AS big, CASE WHEN lines_sold IS NULL OR lines_sold = 0 THEN 1 ELSE (1 - exp(-lines_sold * p6)) / (lines_sold * p6) END AS share,
    t5b * p5b + t5 * m.p5 + t4b * p4b + t4 * m.p4 + t3b * p3b + t3 * m.p3 AS rest FROM market_rows m,
    (SELECT 1.0 / t AS p6, a5 * 1 / 41.0 / t AS t5b, a5 * (1 - 1 / 41.0) / t AS t5, a4 * 2 / 41.0 / t AS t4b, a4 * (1 - 2 / 41.0) / t AS t4, a3 * 3 / 41.0 / t AS t3b, a3 * (1 - 3 / 41.0) / t AS t3
     FROM (SELECT 10737573.0 AS t, 6 * 41.0 AS a5, 15 * 820.0 AS a4, 20 * 10660.0 AS a3) c) o),
  e AS (SELECT *, rest + p6 * next_jackpot * share AS er FROM v)"""


@query(
    "R23_plan_table",
    "game:s rule_code:s lines_per_draw:i draws_played:i cost:f p_big_prize:f p_jackpot:f expected_return:f expected_net:f return_per_euro:f",
    f"""WITH {_VALUE} ;; SELECT game, rule_code, n AS lines_per_draw, d AS draws_played, n * d * 2.0 AS cost, 1 - pow(1 - (1 - pow(1 - big, n)), d) AS p_big_prize,
       1 - pow(1 - n * p6, d) AS p_jackpot, er * n * d AS expected_return, (er - 2.0) * n * d AS expected_net, er / 2.0 AS return_per_euro
       FROM e, (VALUES (1), (2), (5), (10), (20), (50), (100)) x(n), (VALUES (1), (12), (52), (156)) y(d)""",
)
def plan_table(spark, d):
    return returns.plan_table(markets(spark, d), price=2.0)


@query(
    "H16_break_even",
    "game:s rule_code:s break_even_jackpot:f target:f lines_needed:i",
    f"""WITH {_VALUE} ;; SELECT game, rule_code, greatest((2.0 - rest) / (p6 * share), 0) AS break_even_jackpot, t AS target, ceil(ln(1 - t) / ln(1 - big)) AS lines_needed
       FROM e, (VALUES (0.01), (0.1), (0.5), (0.9)) x(t)""",
)
def break_even(spark, d):
    return returns.break_even(markets(spark, d), price=2.0)


@query(
    "D35_jackpot_association",
    "game:s low_numbers:i draws:i median_jackpot:f",
    """SELECT w.game, (SELECT count(*) FROM (SELECT unnest(w.mains) AS x) u WHERE u.x <= 31) AS low_numbers, count(*) AS draws, median(CAST(c.jackpot AS DOUBLE)) AS median_jackpot
       FROM week_draws w JOIN context_rows c USING (game, draw_date) GROUP BY 1, 2""",
)
def jackpot_association(spark, d):
    joined = rel.draws(spark, d).join(rel.context_rows(spark, d), ["game", "draw_date"])
    low = F.size(F.filter("mains", lambda x: x <= 31)).alias("low_numbers")
    return joined.groupBy("game", low).agg(F.count("*").alias("draws"), F.median(F.col("jackpot").cast("double")).alias("median_jackpot"))


@query(
    "D35_rank_correlation",
    "game:s draws:i rank_correlation:f",
    """WITH r AS (SELECT w.game, rank() OVER (PARTITION BY w.game ORDER BY c.jackpot) AS a, rank() OVER (PARTITION BY w.game ORDER BY list_sum(w.mains)) AS b
         FROM week_draws w JOIN context_rows c USING (game, draw_date)) ;; SELECT game, count(*) AS draws, corr(a, b) AS rank_correlation FROM r GROUP BY 1""",
)
def rank_correlation(spark, d):
    from pyspark.sql import Window

    joined = rel.draws(spark, d).join(rel.context_rows(spark, d), ["game", "draw_date"]).withColumn("s", sc.main_sum(F.col("mains")))
    ranks = joined.select(
        "game",
        F.rank().over(Window.partitionBy("game").orderBy("jackpot")).cast("double").alias("a"),
        F.rank().over(Window.partitionBy("game").orderBy("s")).cast("double").alias("b"),
    )
    return ranks.groupBy("game").agg(F.count("*").alias("draws"), F.corr("a", "b").alias("rank_correlation"))
