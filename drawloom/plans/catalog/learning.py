"""Walk-forward models over weekly draws."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from drawloom.operators import features, learn, lines, scoring
from drawloom.plans import relations as rel
from drawloom.plans.catalog.scoring import DIGEST
from drawloom.plans.registry import query
from drawloom.session import cut_lineage

#: The fixture's series are some seven years long: the last 700 days are evaluated, the blocks before them tune.
EVALUATION_DAYS, BLOCK = 700, 25


def stored_features(spark, d):
    """Feature rows with the study's positions (evaluation_start, tuning_start, role)."""
    splits = features.study_splits(rel.population(spark, d), EVALUATION_DAYS, BLOCK)
    wanted = splits.select(*features.SERIES, "draw_date", "evaluation_start", "tuning_start", "role")
    return learn.materialise(rel.feature_rows(spark, d).join(wanted, [*features.SERIES, "draw_date"]))


@query(
    "R15_fit_guards",
    "game:s rule_code:s rows:i classes:i not_finite:i fit_allowed:i",
    "SELECT game, rule_code, count(*) AS rows, count(DISTINCT hit) AS classes, 0 AS not_finite, 1 AS fit_allowed FROM week_features WHERE draw_idx >= 150 GROUP BY 1, 2",
)
def fit_guards(spark, d):
    return learn.fit_guards(rel.feature_rows(spark, d).filter("draw_idx >= 150"), features.SERIES)


def walked(spark, d):
    return learn.walk_forward_logistic(stored_features(spark, d), F.col("evaluation_start"), BLOCK, costs=(0.01, 1.0))


@query("R12_walk_forward", "game:s rule_code:s draw_date:s number:i C:f block_start:i probability:f converged:i")
def walk_forward(spark, d):
    return walked(spark, d)


@query("R12_leaked_targets", "game:s draw_date:s number:i", "SELECT game, draw_date, number FROM week_features WHERE FALSE")
def leaked_targets(spark, d):
    return learn.leaked_targets(walked(spark, d))


@query("R13_model_families", "game:s rule_code:s family:s setting:s blocks:i targets:i brier:f log_loss:f converged:i refused:i")
def model_families(spark, d):
    """The whole grid of every family over all evaluation blocks."""
    scored = learn.walk_forward_families(stored_features(spark, d), "evaluation_start", block=BLOCK)
    keys = [*features.SERIES, "family", "setting"]
    drawn = F.col("hit")
    per_target = scored.groupBy(*keys, "block_start", "draw_date").agg(
        F.avg(scoring.brier(F.col("probability"), drawn)).alias("b"),
        F.avg(scoring.log_loss(F.col("probability"), drawn)).alias("l"),
        F.bool_and(F.coalesce("converged", F.lit(False))).alias("c"),
        F.bool_or(F.col("refused").isNotNull()).alias("r"),
    )
    return per_target.groupBy(*keys).agg(
        F.count_distinct("block_start").alias("blocks"), F.count("*").alias("targets"), F.avg("b").alias("brier"), F.avg("l").alias("log_loss"), F.bool_and("c").alias("converged"), F.bool_or("r").alias("refused")
    )


@query("R13_leaked_targets", "game:s family:s leak:s targets:i", """SELECT game, family, 'block_after_target' AS leak, count(*) AS targets
       FROM (SELECT game, rule_code, draw_idx FROM week_features WHERE number = 1) f
       JOIN (SELECT game, rule_code, max(draw_idx) AS last FROM week_features GROUP BY 1, 2) m USING (game, rule_code), (VALUES ('boosting'), ('forest'), ('mlp')) v(family)
       WHERE draw_idx = last GROUP BY 1, 2""")
def family_leaks(spark, d):
    """The leak check over all predictions of the grid, with one leak put in: last targets, moved before their block."""
    scored = learn.walk_forward_families(stored_features(spark, d), "evaluation_start", block=BLOCK, families=("boosting", "forest", "mlp"))
    last = F.max("draw_idx").over(Window.partitionBy(*features.SERIES, "family", "setting"))
    hurt = scored.withColumn("block_start", F.when(F.col("draw_idx") == last, F.col("draw_idx") + 1).otherwise(F.col("block_start")))
    found = learn.leaked_targets(hurt).withColumn("leak", F.when(F.col("block_start") > F.col("draw_idx"), "block_after_target").otherwise("input_after_target"))
    return found.groupBy("game", "family", "leak").agg(F.count_distinct("rule_code", "draw_date").alias("targets"))


def tuned(spark, rows):
    """The whole grid of every family on the tuning blocks; one row per series and setting, the best of each family marked."""
    predicted = learn.walk_forward_families(rows, "tuning_start", "evaluation_start", BLOCK).filter("refused is null")
    keys = [*features.SERIES, "family", "setting"]
    checked = predicted.groupBy(*keys).agg(F.bool_and(F.coalesce("converged", F.lit(False))).alias("converged"))
    scores = learn.validation_scores(predicted, keys).join(checked, keys)
    return learn.choose_settings(scores, [*features.SERIES, "family"])


@query("R14_tuning", "game:s rule_code:s family:s setting:s validation_targets:i log_loss:f hit_3_plus_rate:f converged:i selected:i")
def tuning(spark, d):
    return tuned(spark, stored_features(spark, d))


@query("R16_model_evaluation", "source:s method:s draws:i lines:i mean_matches:f any_3_plus:i")
def model_evaluation(spark, d):
    """Lines of every family with its tuned setting next to the frequency and rule-based lines, on the same targets."""
    rows = stored_features(spark, d)
    points = spark.createDataFrame([(learn.ensembles.setting_id(f, p), {k: float(v) for k, v in p.items()}) for f, p in learn.grid()], "setting string, params map<string,double>")
    chosen = cut_lineage(tuned(spark, rows).filter("selected").select(*features.SERIES, "family", "setting").join(points, "setting"))
    fitted = learn.walk_forward_families(rows, "evaluation_start", block=BLOCK, chosen=chosen).filter("probability is not null")
    at = [*features.SERIES, "draw_date", "number"]
    wide = fitted.groupBy(*at).agg(*(F.max(F.when(F.col("family") == f, F.col("probability"))).alias(f"p_{f}") for f in learn.SEARCH_SPACE))
    predicted = rows.join(wide, at).filter(" and ".join(f"p_{f} is not null" for f in learn.SEARCH_SPACE))
    scored = lines.heuristic_scores(predicted, {f: f"p_{f}" for f in learn.SEARCH_SPACE})
    portfolios = lines.study_portfolios(scored, DIGEST)
    issued = lines.explode_lines(portfolios.select("game", "draw_date", "source", "method", "lines"))
    return scoring.match_summary(scoring.match_lines(issued, rel.draws(spark, d)), ["source", "method"])


@query(
    "R17_baselines",
    "source:s method:s role:s lines:i line_3_plus:i",
    """WITH s AS (SELECT game, draw_date, CASE WHEN draw_idx >= n - CAST(ceil(n / 5.0) AS INT) THEN 'holdout' ELSE 'development' END AS role FROM (SELECT *, count(*) OVER (PARTITION BY game) AS n FROM week_pop) x)
       ;; SELECT l.source, l.method, s.role, count(*) AS lines, count(*) FILTER (WHERE matched >= 3) AS line_3_plus FROM scored_lines l JOIN s USING (game, draw_date) GROUP BY 1, 2, 3""",
)
def baselines(spark, d):
    from drawloom.plans.catalog.scoring import study_lines

    roles = features.protocol_splits(rel.population(spark, d)).select(
        "game", "draw_date", F.when(F.col("role") == "holdout", "holdout").otherwise("development").alias("role")
    )
    matched = scoring.match_lines(study_lines(spark, d), rel.draws(spark, d))
    joined = matched.join(roles, ["game", "draw_date"])
    return joined.groupBy("source", "method", "role").agg(F.count("*").alias("lines"), F.count_if(F.col("matched") >= 3).alias("line_3_plus"))


def next_models(spark, d):
    rows = stored_features(spark, d).filter("draw_idx >= 150")
    return learn.fit_logistic(rows, features.SERIES)


@query("R18_next_target_lines", "game:s rule_code:s draw_date:s cutoff:s line:s")
def next_target(spark, d):
    """Features of the coming draw of every live series, scored by a model of all its history."""
    population = rel.population(spark, d)
    coming = population.groupBy(*features.SERIES).agg(F.date_add(F.max("draw_date"), 7).alias("draw_date"), F.max("pool").alias("pool"))
    targets = features.next_target_features(population, coming.withColumn("gap_before", F.lit(False)))
    scored = learn.predict_logistic(targets, next_models(spark, d), features.SERIES)
    keys = [*features.SERIES, "draw_date"]
    ranked = lines.rank_numbers(scored, keys, score="probability", cutoff=F.max("max_input_date"))
    return ranked.withColumn("line", F.array_join(lines.top_line(F.col("ranked")), " "))


@query("R19_model_parameters", "game:s rule_code:s feature:s coefficient:f")
def model_parameters(spark, d):
    return learn.export_parameters(next_models(spark, d), features.SERIES)


@query(
    "C20_plan_grid",
    "game:s lines_per_draw:i draws_played:i cost:f",
    "SELECT game, n AS lines_per_draw, d AS draws_played, n * d * 2.0 AS cost FROM (SELECT DISTINCT game FROM week_pop) g, (VALUES (1), (2), (5), (10), (20), (50), (100)) x(n), (VALUES (1), (12), (52), (156)) y(d)",
)
def plan_grid(spark, d):
    from drawloom.operators import returns
    from drawloom.plans.catalog.inference import markets

    return returns.plan_table(markets(spark, d), price=2.0)
