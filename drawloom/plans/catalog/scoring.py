"""Line selection, scoring and study tables over weekly draws."""

from pyspark.sql import functions as F

from drawloom.functions.scalars import line_text, overlap
from drawloom.operators import features, lines, scoring
from drawloom.plans import relations as rel
from drawloom.plans.registry import query
from drawloom.plans.relations_sql import RELATIONS, uniform

DIGEST = "study-1"
WARMUP = 100

RELATIONS["scored_numbers"] = f"""
SELECT game, rule_code, draw_idx, draw_date, max_input_date, number, hit, s.source,
  CASE s.source WHEN 'frequency' THEN smoothed_frequency WHEN 'hot' THEN freq_25 WHEN 'cold' THEN -freq_25 ELSE recency END AS score
FROM week_features, (VALUES ('frequency'), ('hot'), ('cold'), ('overdue')) s(source) WHERE draw_idx >= {WARMUP}
"""
RELATIONS["ranked_numbers"] = """
SELECT *, row_number() OVER (PARTITION BY game, draw_date, source ORDER BY score DESC, number) - 1 AS rk FROM scored_numbers
"""
RELATIONS["top_lines"] = """
SELECT game, draw_date, source, list_sort(list(number)) AS mains FROM ranked_numbers WHERE rk < 6 GROUP BY 1, 2, 3
"""
RELATIONS["cover_lines"] = """
SELECT r.game, r.draw_date, r.source, b.budget, k.k AS line_index, list_sort(list(r.number)) AS mains
FROM ranked_numbers r, (VALUES (5), (10)) b(budget), (SELECT range AS k FROM range(0, 10)) k, (SELECT range AS i FROM range(0, 6)) i
WHERE k.k < b.budget AND r.rk = (6 * k.k + (6 * k.k) // 47 + i.i) % 47 AND r.source = 'frequency'
GROUP BY 1, 2, 3, 4, 5
"""
_TARGET = "concat(t.game, ':', CAST(t.draw_date AS VARCHAR))"
RELATIONS["uniform_lines"] = f"""
SELECT game, draw_date, budget, line_index, mains FROM (
  SELECT game, draw_date, budget, mains, row_number() OVER (PARTITION BY game, draw_date, budget ORDER BY first_attempt) - 1 AS line_index FROM (
    SELECT game, draw_date, budget, mains, min(attempt) AS first_attempt FROM (
      SELECT game, draw_date, budget, attempt, list_sort(list(number)) AS mains FROM (
        SELECT *, row_number() OVER (PARTITION BY game, draw_date, budget, attempt ORDER BY u, number) AS place FROM (
          SELECT t.game, t.draw_date, b.budget, a.attempt, n.number,
            {uniform("'" + DIGEST + "'", "'random' || b.budget", _TARGET, "CAST(b.budget AS VARCHAR)", "CAST(a.attempt AS VARCHAR)", "CAST(n.number AS VARCHAR)")} AS u
          FROM (SELECT game, draw_date FROM week_pop WHERE draw_idx >= {WARMUP}) t, (VALUES (1), (5), (10)) b(budget),
            (SELECT range AS attempt FROM range(0, 14)) a, (SELECT CAST(range AS INT) AS number FROM range(1, 48)) n
          WHERE a.attempt < b.budget + 4) x) y WHERE place <= 6 GROUP BY 1, 2, 3, 4) z GROUP BY 1, 2, 3, 4) w) v
WHERE line_index < budget
"""
_WEIGHT_KEY = uniform("'" + DIGEST + "'", "'frequency:weighted'", _TARGET, "CAST(t.number AS VARCHAR)")
RELATIONS["weighted_lines"] = f"""
SELECT game, draw_date, list_sort(list(number)) AS mains FROM (
  SELECT game, draw_date, number, row_number() OVER (PARTITION BY game, draw_date ORDER BY -ln(u) / score, number) AS place FROM (
    SELECT t.*, greatest({_WEIGHT_KEY}, 1.1102230246251565e-16) AS u FROM scored_numbers t WHERE source = 'frequency') x) y
WHERE place <= 6 GROUP BY 1, 2
"""
RELATIONS["study_lines"] = """
SELECT game, draw_date, 'frequency' AS source, 'top6' AS method, 0 AS line_index, 1 AS budget, mains FROM top_lines WHERE source = 'frequency'
UNION ALL SELECT game, draw_date, 'heuristic', source, 0, 1, mains FROM top_lines WHERE source <> 'frequency'
UNION ALL SELECT game, draw_date, 'frequency', 'weighted', 0, 1, mains FROM weighted_lines
UNION ALL SELECT game, draw_date, source, 'coverage' || budget, line_index, budget, mains FROM cover_lines
UNION ALL SELECT game, draw_date, 'uniform', 'random' || budget, line_index, budget, mains FROM uniform_lines
"""
RELATIONS["scored_lines"] = """
SELECT l.*, w.mains AS outcome, CAST(len(list_intersect(l.mains, w.mains)) AS INT) AS matched
FROM study_lines l JOIN week_draws w ON w.game = l.game AND w.draw_date = l.draw_date
"""


def scored(spark, d):
    rows = rel.feature_rows(spark, d).filter(F.col("draw_idx") >= WARMUP)
    return lines.heuristic_scores(rows)


def portfolios(spark, d, methods=None):
    return lines.study_portfolios(scored(spark, d), DIGEST, methods)


def study_lines(spark, d, methods=None):
    return lines.explode_lines(portfolios(spark, d, methods).select("game", "draw_date", "max_input_date", "pool", "source", "method", "lines"))


def matched(spark, d):
    return scoring.match_lines(study_lines(spark, d), rel.draws(spark, d))


@query(
    "E18_top_line",
    "game:s draw_date:s source:s line:s",
    "SELECT game, draw_date, source, array_to_string(mains, ' ') AS line FROM top_lines",
)
def top_line(spark, d):
    ranked = lines.rank_numbers(scored(spark, d), ["game", "draw_date", "source"])
    return ranked.withColumn("line", line_text(lines.top_line(F.col("ranked"))))


@query(
    "E19_coverage_lines",
    "game:s draw_date:s budget:i line_index:i mains:a",
    "SELECT game, draw_date, budget, line_index, mains FROM cover_lines",
)
def coverage_lines(spark, d):
    rows = scored(spark, d).filter("source = 'frequency'")
    ranked = lines.rank_numbers(rows, ["game", "draw_date"])
    options = F.explode(F.array(*[lines.coverage_lines(F.col("ranked"), b) for b in (5, 10)])).alias("lines")
    return lines.explode_lines(ranked.select("game", "draw_date", options))


@query(
    "E20_heuristic_lines",
    "game:s draw_date:s method:s mains:a",
    "SELECT game, draw_date, method, mains FROM study_lines WHERE source = 'heuristic'",
)
def heuristic_lines(spark, d):
    return study_lines(spark, d, lines.HEURISTICS)


@query(
    "R10_uniform_portfolio",
    "game:s draw_date:s budget:i line_index:i mains:a",
    "SELECT game, draw_date, budget, line_index, mains FROM uniform_lines",
)
def uniform_portfolio(spark, d):
    return study_lines(spark, d, lines.UNIFORM_METHODS)


@query(
    "R11_weighted_line",
    "game:s draw_date:s mains:a",
    "SELECT game, draw_date, mains FROM weighted_lines",
)
def weighted_line(spark, d):
    return study_lines(spark, d, ("weighted",))


@query(
    "C11_line_outcomes",
    "game:s draw_date:s source:s method:s line_index:i mains:a outcome:a matched:i",
    "SELECT game, draw_date, source, method, line_index, mains, outcome, matched FROM scored_lines",
)
def line_outcomes(spark, d):
    return matched(spark, d)


_SUMMARY_SQL = """
SELECT source, method, count(*) AS draws, sum(lines) AS lines, min(draw_date) AS first_date, max(draw_date) AS last_date,
  sum(m0) AS match_0, sum(m1) AS match_1, sum(m2) AS match_2, sum(m3) AS match_3, sum(m4) AS match_4, sum(m5) AS match_5, sum(m6) AS match_6,
  sum(total) / sum(lines) AS mean_matches, sum(m3 + m4 + m5 + m6) AS line_3_plus, sum(m5 + m6) AS line_5_plus,
  count(*) FILTER (WHERE best >= 3) AS any_3_plus, count(*) FILTER (WHERE best >= 5) AS any_5_plus,
  sum(m3 + m4 + m5 + m6) / sum(lines) AS line_3_plus_rate, count(*) FILTER (WHERE best >= 3) / count(*) AS any_3_plus_rate
FROM (SELECT source, method, game, draw_date, count(*) AS lines, sum(matched) AS total, max(matched) AS best, """ + ", ".join(
    f"count(*) FILTER (WHERE matched = {k}) AS m{k}" for k in range(7)
) + """ FROM scored_lines GROUP BY 1, 2, 3, 4) x GROUP BY 1, 2
"""


@query(
    "D12_match_summary",
    "source:s method:s draws:i lines:i first_date:s last_date:s "
    + " ".join(f"match_{k}:i" for k in range(7))
    + " mean_matches:f line_3_plus:i line_5_plus:i any_3_plus:i any_5_plus:i line_3_plus_rate:f any_3_plus_rate:f",
    _SUMMARY_SQL,
)
def match_summary(spark, d):
    return scoring.match_summary(matched(spark, d), ["source", "method"])


@query(
    "D13_policy_parity",
    "policy:s slots:i broken_portfolios:i covers_all:i",
    """WITH p AS (SELECT method AS policy, game, draw_date, budget, count(*) AS r, count(DISTINCT line_index) AS i, max(line_index) AS t
         FROM study_lines WHERE budget = 1 OR method IN ('coverage5', 'random5', 'coverage10', 'random10') GROUP BY 1, 2, 3, 4)
       ;; SELECT policy, count(*) AS slots, count(*) FILTER (WHERE NOT (r = i AND i = budget AND t = budget - 1)) AS broken_portfolios,
       CAST(count(*) = (SELECT count(*) FROM (SELECT DISTINCT game, draw_date, budget FROM p)) AS INT) AS covers_all FROM p GROUP BY 1""",
)
def policy_parity(spark, d):
    return scoring.parity(study_lines(spark, d).withColumnRenamed("method", "policy"))


@query(
    "B19_portfolio_validity",
    "source:s method:s portfolios:i complete:i",
    """SELECT source, method, count(*) AS portfolios, count(*) FILTER (WHERE d = budget) AS complete FROM (
       SELECT source, method, game, draw_date, budget, count(DISTINCT array_to_string(mains, ' ')) AS d FROM study_lines GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2""",
)
def portfolio_validity(spark, d):
    from drawloom.operators.validate import portfolio_check

    checked = portfolio_check(study_lines(spark, d), ["source", "method", "game", "draw_date", "budget"])
    fine = (F.col("lines") == F.col("budget")) & (F.col("distinct_lines") == F.col("budget")) & (F.col("numbers_ok") == 1)
    return checked.groupBy("source", "method").agg(F.count("*").alias("portfolios"), F.count_if(fine).alias("complete"))


@query(
    "B17_leakage_violations",
    "game:s draw_date:s method:s line_index:i reasons:a",
    "SELECT game, draw_date, method, line_index, ['late_input'] AS reasons FROM study_lines WHERE FALSE",
)
def leakage(spark, d):
    from drawloom.operators.validate import leakage_violations

    return leakage_violations(study_lines(spark, d).withColumn("target_date", F.col("draw_date")))


@query(
    "D34_probability_table",
    "game:s draw_date:s number:i probability:f drawn:i",
    "SELECT game, draw_date, number, score AS probability, hit AS drawn FROM scored_numbers WHERE source = 'frequency'",
)
def probability_table(spark, d):
    rows = scored(spark, d).filter("source = 'frequency'")
    return rows.withColumnRenamed("score", "probability").withColumnRenamed("hit", "drawn")


def probabilities(spark, d):
    """Smoothed frequency, a uniform guess and the short window, as probabilities of each number."""
    rows = rel.feature_rows(spark, d).filter(F.col("draw_idx") >= WARMUP)
    options = F.array(
        F.struct(F.lit("frequency").alias("source"), F.col("smoothed_frequency").alias("probability")),
        F.struct(F.lit("recent").alias("source"), F.col("freq_100").alias("probability")),
        F.struct(F.lit("uniform").alias("source"), (F.lit(6.0) / F.col("pool")).alias("probability")),
    )
    return rows.select("game", "draw_date", "number", F.col("hit").alias("drawn"), F.explode(options).alias("x")).select(
        "game", "draw_date", "number", "drawn", "x.*"
    )


RELATIONS["probability_rows"] = f"""
SELECT game, draw_date, number, hit AS drawn, s.source,
  CASE s.source WHEN 'frequency' THEN smoothed_frequency WHEN 'recent' THEN freq_100 ELSE 6.0 / 47 END AS probability
FROM week_features, (VALUES ('frequency'), ('recent'), ('uniform')) s(source) WHERE draw_idx >= {WARMUP}
"""
_LOSS = """-(drawn * ln(greatest(1e-15, least(1 - 1e-15, probability))) + (1 - drawn) * ln(1 - greatest(1e-15, least(1 - 1e-15, probability))))"""
RELATIONS["probability_scores"] = f"""
SELECT source, count(*) AS targets, avg(b) AS brier, avg(l) AS log_loss FROM (
  SELECT source, game, draw_date, avg((probability - drawn) * (probability - drawn)) AS b, avg({_LOSS}) AS l FROM probability_rows GROUP BY 1, 2, 3) x GROUP BY 1
"""


@query("D15_brier_log_loss", "source:s targets:i brier:f log_loss:f", "SELECT * FROM probability_scores")
def brier_log_loss(spark, d):
    return scoring.probability_scores(probabilities(spark, d), ["source"])


@query(
    "D19_calibration_bins",
    "source:s bin:i lower:f upper:f count:i mean_probability:f observed_rate:f",
    """SELECT s.source, b.bin, b.bin / 10.0 AS lower, (b.bin + 1) / 10.0 AS upper, coalesce(x.c, 0) AS count, x.p AS mean_probability, x.y AS observed_rate
       FROM (SELECT DISTINCT source FROM probability_rows) s CROSS JOIN (SELECT CAST(range AS INT) AS bin FROM range(0, 10)) b
       LEFT JOIN (SELECT source, CAST(least(floor(probability * 10), 9) AS INT) AS bin, count(*) AS c, avg(probability) AS p, avg(drawn) AS y
         FROM probability_rows GROUP BY 1, 2) x ON x.source = s.source AND x.bin = b.bin""",
)
def calibration(spark, d):
    return scoring.calibration_bins(probabilities(spark, d), ["source"], "probability", "drawn")


@query(
    "D16_candidate_ranking",
    "source:s targets:i hits:i rate:f brier:f log_loss:f rank:i",
    f"""WITH tops AS (SELECT game, draw_date, source, list_sort(list(number)) AS mains FROM (
         SELECT *, row_number() OVER (PARTITION BY game, draw_date, source ORDER BY probability DESC, number) AS rk FROM probability_rows) WHERE rk <= 6 GROUP BY 1, 2, 3),
       hits AS (SELECT t.source, count(*) FILTER (WHERE len(list_intersect(t.mains, w.mains)) >= 3) AS hits, count(*) AS n FROM tops t JOIN week_draws w USING (game, draw_date) GROUP BY 1)
       ;; SELECT s.source, s.targets, h.hits, h.hits / h.n AS rate, s.brier, s.log_loss,
       row_number() OVER (ORDER BY h.hits / h.n DESC, s.brier, s.log_loss, s.source) AS rank FROM probability_scores s JOIN hits h USING (source)""",
)
def candidate_ranking(spark, d):
    p = probabilities(spark, d)
    scores = scoring.probability_scores(p, ["source"])
    ranked = lines.rank_numbers(p, ["game", "draw_date", "source"], score="probability")
    tops = ranked.select("game", "draw_date", "source", lines.top_line(F.col("ranked")).alias("mains"))
    hit = F.count_if(F.col("matched") >= 3)
    hits = scoring.match_lines(tops, rel.draws(spark, d)).groupBy("source").agg(hit.alias("hits"), (hit / F.count("*")).alias("rate"))
    return scoring.rank_candidates(
        scores.join(hits, "source"), F.desc("rate"), F.col("brier"), F.col("log_loss"), F.col("source")
    )


# --- chance and study summary ------------------------------------------------------

# The outcome table of the study: the daily draws of the same pool, each a given outcome.
RELATIONS["given_outcomes"] = "SELECT concat(game, ':', CAST(draw_date AS VARCHAR)) AS outcome_id, mains FROM day_draws"


def given_outcomes(spark, d):
    outcome = F.concat_ws(":", "game", F.col("draw_date").cast("string")).alias("outcome_id")
    return rel.draws(spark, d, "day").select(outcome, "mains")


def canonical_text(column="structure"):
    return F.array_join(F.transform(column, lambda line: F.array_join(line.cast("array<string>"), " ")), "|")


RELATIONS["line_structures"] = """
SELECT game, draw_date, method, list_sort(list(line)) AS lines, array_to_string(list_sort(list(line)), '|') AS structure FROM (
  SELECT game, draw_date, method, line_index, list_sort(list(label)) AS line FROM (
    SELECT u.game, u.draw_date, u.method, u.line_index, CAST(f.label AS INT) AS label FROM
      (SELECT game, draw_date, method, line_index, unnest(mains) AS number FROM study_lines WHERE budget > 1) u
      JOIN (SELECT game, draw_date, method, number, row_number() OVER (PARTITION BY game, draw_date, method ORDER BY min(line_index * 100 + number)) AS label
            FROM (SELECT game, draw_date, method, line_index, unnest(mains) AS number FROM study_lines WHERE budget > 1) v GROUP BY 1, 2, 3, 4) f
      USING (game, draw_date, method, number)) x GROUP BY 1, 2, 3, 4) y GROUP BY 1, 2, 3
"""
RELATIONS["structure_chance"] = """
SELECT structure, count(*) AS outcomes, avg(CAST(best >= 3 AS INT)) AS chance, avg(best) AS match_mean, var_pop(best) AS match_variance FROM (
  SELECT s.structure, o.outcome_id, max(bit_count(s.mask & o.mask)) AS best FROM
    (SELECT structure, list_sum(list_transform(line, lambda n: CAST(1 AS BIGINT) << n))::BIGINT AS mask FROM
      (SELECT structure, unnest(lines) AS line FROM (SELECT structure, any_value(lines) AS lines FROM line_structures GROUP BY 1) z) y) s,
    (SELECT outcome_id, list_sum(list_transform(mains, lambda n: CAST(1 AS BIGINT) << n))::BIGINT AS mask FROM given_outcomes) o GROUP BY 1, 2) x
GROUP BY 1
"""


@query(
    "C23_portfolio_chance",
    "structure:s outcomes:i chance:f match_mean:f match_variance:f",
    """SELECT replace(structure, ', ', ' ') AS structure, outcomes, chance, match_mean, match_variance FROM
       (SELECT translate(structure, '[]', '') AS structure, outcomes, chance, match_mean, match_variance FROM structure_chance) t""",
)
def portfolio_chance(spark, d):
    tagged = portfolios(spark, d).withColumn("structure", scoring.canonical_structure(F.col("lines")))
    distinct = tagged.filter(F.size("lines") > 1).select("structure").distinct()
    table = scoring.portfolio_chance(distinct, given_outcomes(spark, d))
    return table.withColumn("structure", canonical_text())


def outcome_table(spark, d):
    chanced = scoring.with_chance(portfolios(spark, d), given_outcomes(spark, d))
    return scoring.outcome_rows(chanced, rel.draws(spark, d))


@query(
    "D17_study_summary",
    "source:s method:s lines:i draws:i hits_3_plus:i rate:f expected_rate:f lift:f rate_lower:f rate_upper:f hits_5_plus:i p_value:f "
    "mean_matches:f expected_matches:f match_lift:f match_p_value:f holm_p_value:f match_holm_p_value:f significant:i",
)
def study_summary(spark, d):
    return scoring.study_summary(outcome_table(spark, d))


_P3 = "75249.0 / 3579191.0"  # exact chance that one line of a pool of 47 matches three or more


@query(
    "D17_study_rates",
    "source:s method:s lines:i draws:i hits_3_plus:i rate:f expected_rate:f lift:f hits_5_plus:i mean_matches:f expected_matches:f match_lift:f",
    f"""WITH r AS (SELECT l.source, l.method, l.game, l.draw_date, max(l.budget) AS lines, max(l.matched) AS best FROM scored_lines l GROUP BY 1, 2, 3, 4),
       c AS (SELECT r.*, CASE WHEN r.lines = 1 THEN {_P3} ELSE s.chance END AS chance, CASE WHEN r.lines = 1 THEN 36.0 / 47 ELSE s.match_mean END AS mean
         FROM r LEFT JOIN line_structures t ON t.game = r.game AND t.draw_date = r.draw_date AND t.method = r.method LEFT JOIN structure_chance s ON s.structure = t.structure)
       ;; SELECT source, method, max(lines) AS lines, count(*) AS draws, count(*) FILTER (WHERE best >= 3) AS hits_3_plus,
       count(*) FILTER (WHERE best >= 3) / count(*) AS rate, avg(chance) AS expected_rate, count(*) FILTER (WHERE best >= 3) / count(*) / avg(chance) AS lift,
       count(*) FILTER (WHERE best >= 5) AS hits_5_plus, avg(best) AS mean_matches, avg(mean) AS expected_matches, sum(best) / sum(mean) AS match_lift
       FROM c GROUP BY 1, 2""",
)
def study_rates(spark, d):
    return scoring.study_summary(outcome_table(spark, d))


@query(
    "D18_yearly_rates",
    "source:s method:s year:i draws:i hits_3_plus:i rate:f expected_rate:f",
    f"""WITH r AS (SELECT l.source, l.method, l.game, l.draw_date, max(l.budget) AS lines, max(l.matched) AS best FROM scored_lines l GROUP BY 1, 2, 3, 4)
       ;; SELECT r.source, r.method, year(r.draw_date) AS year, count(*) AS draws, count(*) FILTER (WHERE best >= 3) AS hits_3_plus,
       count(*) FILTER (WHERE best >= 3) / count(*) AS rate, avg(CASE WHEN r.lines = 1 THEN {_P3} ELSE s.chance END) AS expected_rate
       FROM r LEFT JOIN line_structures t ON t.game = r.game AND t.draw_date = r.draw_date AND t.method = r.method LEFT JOIN structure_chance s ON s.structure = t.structure
       GROUP BY 1, 2, 3""",
)
def yearly(spark, d):
    return scoring.yearly_rates(outcome_table(spark, d))



@query(
    "D28_any_line_hit",
    "method:s game:s draw_date:s hit:i",
    "SELECT method, game, draw_date, CAST(max(matched) >= 3 AS INT) AS hit FROM scored_lines GROUP BY 1, 2, 3",
)
def any_line_hit(spark, d):
    from drawloom.operators.inference import any_line_hits

    return any_line_hits(matched(spark, d), ["method"], 3)


@query(
    "G4_line_intersection",
    "game:s draw_date:s previous:i bonus_hit:i",
    """SELECT game, draw_date, CASE WHEN p IS NOT NULL THEN len(list_intersect(mains, p)) END AS previous, CAST(list_contains(p, bonus) AS INT) AS bonus_hit
       FROM (SELECT *, lag(mains) OVER (PARTITION BY game ORDER BY draw_date) AS p FROM day_draws) x""",
)
def line_intersection(spark, d):
    from pyspark.sql import Window

    before = F.lag("mains").over(Window.partitionBy("game").orderBy("draw_date"))
    return rel.draws(spark, d, "day").select(
        "game",
        "draw_date",
        F.when(before.isNotNull(), overlap(F.col("mains"), before)).alias("previous"),
        F.array_contains(before, F.col("bonus")).alias("bonus_hit"),
    )
