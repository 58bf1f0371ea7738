"""Features, windows, context and splits."""

from pyspark.sql import functions as F

from drawloom.operators import features, intervals
from drawloom.plans import relations as rel
from drawloom.plans.registry import query
from drawloom.plans.relations_sql import RELATIONS

_ALL = (
    "game:s rule_code:s draw_idx:i draw_date:s max_input_date:s number:i hit:i freq_10:f freq_25:f freq_50:f freq_100:f recency:f never_seen:f "
    "lag_1:f lag_2:f lag_3:f lag_1_valid:f lag_2_valid:f lag_3_valid:f freq_10_minus_100:f smoothed_frequency:f "
    + " ".join(f"weekday_{k}:f" for k in range(7))
    + " days_since_prior:f"
)
_WEEKDAYS = ", ".join(f"CASE WHEN weekday = {k} THEN 1.0 ELSE 0.0 END AS weekday_{k}" for k in range(7))


@query("R8_feature_table", _ALL, f"SELECT *, {_WEEKDAYS} FROM day_features")
def feature_table(spark, d):
    return features.feature_table(rel.population(spark, d, "day"))


@query(
    "C12_gap_before",
    "game:s rule_code:s draw_date:s gap_before:i",
    "SELECT game, rule_code, draw_date, CAST(gap_before AS INT) AS gap_before FROM day_pop",
)
def gap_before(spark, d):
    return rel.population(spark, d, "day")


@query(
    "C19_number_spine",
    "game:s draw_date:s number:i hit:i",
    "SELECT game, draw_date, n.number, CAST(list_contains(mains, n.number) AS INT) AS hit FROM week_pop, (SELECT CAST(range AS INT) AS number FROM range(1, 48)) n",
)
def number_spine(spark, d):
    return features.number_hits(rel.population(spark, d))


@query(
    "D14_frequency_marginals",
    "game:s rule_code:s number:i draws:i count:i marginal:f",
    """SELECT s.game, s.rule_code, n.number, s.draws, coalesce(c.c, 0) AS count, (coalesce(c.c, 0) + 6.0 / 47) / (s.draws + 1) AS marginal
       FROM (SELECT game, rule_code, count(*) AS draws FROM day_pop GROUP BY 1, 2) s
       CROSS JOIN (SELECT CAST(range AS INT) AS number FROM range(1, 48)) n
       LEFT JOIN (SELECT game, rule_code, number, count(*) AS c FROM (SELECT game, rule_code, unnest(mains) AS number FROM day_pop) GROUP BY 1, 2, 3) c
         ON c.game = s.game AND c.rule_code = s.rule_code AND c.number = n.number""",
)
def frequency_marginals(spark, d):
    return features.frequency_marginals(rel.population(spark, d, "day"))


for _name, _cols in (
    ("E4_rolling_frequency", ("freq_10", "freq_25", "freq_50", "freq_100")),
    ("E5_recency", ("recency", "never_seen")),
    ("E6_lags", ("lag_1", "lag_2", "lag_3", "lag_1_valid", "lag_2_valid", "lag_3_valid")),
    ("E7_smoothed_frequency", ("smoothed_frequency",)),
    ("E8_short_minus_long", ("freq_10_minus_100", "days_since_prior", "weekday_0")),
):

    @query(
        _name,
        "game:s rule_code:s draw_date:s number:i " + " ".join(f"{c}:f" for c in _cols),
        f"SELECT game, rule_code, draw_date, number, {', '.join(_cols)} FROM (SELECT *, {_WEEKDAYS} FROM week_features) w",
    )
    def _some_features(spark, d, cols=_cols):
        return rel.feature_rows(spark, d).select("game", "rule_code", "draw_date", "number", *cols)


@query(
    "E12_duplicate_and_order_check",
    "game:s rule_code:s not_increasing:i duplicates:i draws:i",
    """SELECT game, rule_code, count(*) FILTER (WHERE NOT coalesce(prev < draw_date, TRUE)) AS not_increasing,
       count(*) - count(DISTINCT draw_date) AS duplicates, count(*) AS draws
       FROM (SELECT *, lag(draw_date) OVER (PARTITION BY game, rule_code ORDER BY draw_idx) AS prev FROM day_pop) GROUP BY 1, 2""",
)
def order_check(spark, d):
    seq = features.sequence_draws(rel.population(spark, d, "day"))
    bad = ~F.coalesce(F.col("max_input_date") < F.col("draw_date"), F.lit(True))
    return seq.groupBy("game", "rule_code").agg(
        F.count_if(bad).alias("not_increasing"),
        (F.count("*") - F.countDistinct("draw_date")).alias("duplicates"),
        F.count("*").alias("draws"),
    )


@query(
    "E14_protocol_splits",
    "game:s draw_date:s draw_idx:i population:i fold_id:i role:s sufficient:i",
    """WITH s AS (SELECT *, count(*) OVER (PARTITION BY game) AS n FROM week_pop),
       t AS (SELECT *, n - CAST(ceil(n / 5.0) AS INT) AS dev, (draw_idx - 175) // 25 AS fold FROM s),
       u AS (SELECT *, least(25, dev - (175 + fold * 25)) AS size, draw_idx >= 175 AND draw_idx < dev AS inside FROM t)
       ;; SELECT game, draw_date, draw_idx, n AS population, CASE WHEN inside AND (size = 25 OR size >= 10) THEN fold END AS fold_id,
       CASE WHEN draw_idx >= dev THEN 'holdout' WHEN inside AND (size = 25 OR size >= 10) THEN 'validation' WHEN inside THEN 'unused' ELSE 'history' END AS role,
       CAST(n >= 282 AND (dev - 175) // 25 >= 2 AS INT) AS sufficient FROM u""",
)
def protocol_splits(spark, d):
    return features.protocol_splits(rel.population(spark, d))


@query(
    "E15_study_splits",
    "game:s draw_date:s draw_idx:i evaluation_start:i tuning_start:i role:s block_id:i sufficient:i",
    """WITH s AS (SELECT *, draw_date > max(draw_date) OVER (PARTITION BY game) - 700 AS ev FROM week_pop),
       t AS (SELECT *, min(CASE WHEN ev THEN draw_idx END) OVER (PARTITION BY game) AS es FROM s)
       ;; SELECT game, draw_date, draw_idx, es AS evaluation_start, es - 50 AS tuning_start,
       CASE WHEN ev THEN 'evaluation' WHEN draw_idx >= es - 50 THEN 'tuning' WHEN draw_idx >= 150 THEN 'training' ELSE 'warmup' END AS role,
       CASE WHEN ev THEN (draw_idx - es) // 25 WHEN draw_idx >= es - 50 THEN (draw_idx - es + 50) // 25 END AS block_id,
       CAST(es - 50 - 150 >= 25 AS INT) AS sufficient FROM t""",
)
def study_splits(spark, d):
    return features.study_splits(rel.population(spark, d), evaluation_days=700, tuning_blocks=2)


@query(
    "E16_training_window",
    "game:s block_start:i rows:i first_idx:i last_idx:i hits:i",
    """SELECT game, b AS block_start, count(*) AS rows, min(draw_idx) AS first_idx, max(draw_idx) AS last_idx, sum(hit) AS hits
       FROM week_features, (VALUES (200), (225), (250), (275)) x(b) WHERE draw_idx < b AND draw_idx >= greatest(150, b - 60) GROUP BY 1, 2""",
)
def training_window(spark, d):
    rows = rel.feature_rows(spark, d)
    starts = F.explode(F.array(*map(F.lit, (200, 225, 250, 275)))).alias("block_start")
    blocks = rows.select(*features.SERIES).distinct().select("*", starts)
    picked = features.training_windows(rows, blocks, window=60)
    return picked.groupBy("game", "block_start").agg(
        F.count("*").alias("rows"), F.min("draw_idx").alias("first_idx"), F.max("draw_idx").alias("last_idx"), F.sum("hit").alias("hits")
    )


@query(
    "R9_pooled_training_rows",
    "game:s rule_code:s rows:i hits:i base_rate:f first_date:s last_date:s",
    """SELECT game, rule_code, count(*) AS rows, sum(hit) AS hits, 6.0 / 47 AS base_rate, min(draw_date) AS first_date, max(draw_date) AS last_date
       FROM day_features WHERE draw_idx >= 150 GROUP BY 1, 2""",
)
def pooled_training_rows(spark, d):
    both = features.pool_regimes(rel.feature_rows(spark, d, "day"), "R2", ["R1"])
    return both.groupBy("game", "rule_code").agg(
        F.count("*").alias("rows"),
        F.sum("hit").alias("hits"),
        F.max("base_rate").alias("base_rate"),
        F.min("draw_date").alias("first_date"),
        F.max("draw_date").alias("last_date"),
    )


RELATIONS["holiday_gaps"] = """
WITH easter AS (SELECT y, (19 * (y % 19) + y // 100 - y // 400 - (y // 100 - (y // 100 + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM range(1990, 2010) t(y)),
       easter2 AS (SELECT y, h, (32 + 2 * ((y // 100) % 4) + 2 * ((y % 100) // 4) - h - (y % 100) % 4) % 7 AS l FROM easter),
       easter3 AS (SELECT y, h + l - 7 * ((y % 19 + 11 * h + 22 * l) // 451) + 114 AS n FROM easter2),
       easter4 AS (SELECT y, make_date(y, n // 31, n % 31 + 1) AS e FROM easter3),
       hol AS (SELECT unnest([make_date(y, 1, 1), make_date(y, 3, 17), make_date(y, 12, 25), make_date(y, 12, 26), e - 2, e + 1,
           make_date(y, 5, 1) + CAST((8 - isodow(make_date(y, 5, 1))) % 7 AS INT), make_date(y, 6, 1) + CAST((8 - isodow(make_date(y, 6, 1))) % 7 AS INT),
           make_date(y, 8, 1) + CAST((8 - isodow(make_date(y, 8, 1))) % 7 AS INT), make_date(y, 10, 31) - CAST(isodow(make_date(y, 10, 31)) - 1 AS INT)]) AS day FROM easter4)
SELECT d.draw_date, min(abs(date_diff('day', d.draw_date, h.day))) AS gap FROM (SELECT DISTINCT draw_date FROM week_draws) d, hol h GROUP BY 1
"""

_CONTEXT = [c for g in features.CONTEXT_GROUPS.values() for c in g]


@query(
    "E17_draw_context",
    "game:s draw_date:s " + " ".join(f"{c}:f" for c in _CONTEXT) + " context_missing:f",
    """WITH wide AS (SELECT game, draw_date, max(CASE WHEN tier = 'Match 6' THEN winners END) AS won, max(CASE WHEN tier = 'Match 3' THEN winners END) AS m3,
           max(CASE WHEN tier = 'Match 4' THEN amount END) AS m4, max(CASE WHEN tier = 'Match 5' THEN amount END) AS m5 FROM prize_facts GROUP BY 1, 2),
       base AS (SELECT p.*, w.won, w.m3, w.m4, w.m5, c.jackpot FROM week_pop p LEFT JOIN wide w USING (game, draw_date) LEFT JOIN context_rows c USING (game, draw_date)),
       win AS (SELECT *, max(CASE WHEN won IS NULL THEN draw_idx END) OVER p AS unk, max(CASE WHEN won > 0 THEN draw_idx END) OVER p AS wi,
           max(CASE WHEN won > 0 THEN draw_date END) OVER p AS wd, lag(m3) OVER s AS pm3, lag(m4) OVER s AS pm4, lag(m5) OVER s AS pm5
         FROM base WINDOW p AS (PARTITION BY game ORDER BY draw_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s AS (PARTITION BY game ORDER BY draw_date)),
       near AS (SELECT * FROM holiday_gaps),
       vals AS (SELECT w.game, w.draw_date, CASE WHEN jackpot > 0 THEN log10(CAST(jackpot AS DOUBLE)) END AS a,
           CASE WHEN NOT coalesce(unk > coalesce(wi, -1), FALSE) THEN draw_idx - coalesce(wi, -1) - 1 END AS b,
           CASE WHEN NOT coalesce(unk > coalesce(wi, -1), FALSE) THEN date_diff('day', wd, w.draw_date) END AS c,
           n.gap AS g, CASE WHEN pm3 > 0 THEN log10(CAST(pm3 AS DOUBLE)) END AS e, CASE WHEN pm4 > 0 THEN log10(CAST(pm4 AS DOUBLE)) END AS f,
           CASE WHEN pm5 > 0 THEN log10(CAST(pm5 AS DOUBLE)) END AS k FROM win w JOIN near n ON n.draw_date = w.draw_date)
       ;; SELECT game, draw_date, coalesce(a, 0) AS jackpot_log10, coalesce(b, 0) AS rollovers, coalesce(c, 0) AS days_since_jackpot_won,
       g AS days_to_holiday, CASE WHEN g <= 3 THEN 1 ELSE 0 END AS holiday_window, coalesce(e, 0) AS prev_match3_winners_log10,
       coalesce(f, 0) AS prev_match4_prize_log10, coalesce(k, 0) AS prev_match5_prize_log10,
       CASE WHEN a IS NULL OR b IS NULL OR c IS NULL OR e IS NULL OR f IS NULL OR k IS NULL THEN 1 ELSE 0 END AS context_missing FROM vals""",
)
def draw_context(spark, d):
    return features.context_table(rel.population(spark, d), rel.prize_facts(spark, d), rel.context_rows(spark, d))


@query(
    "H6_holiday_distance",
    "draw_date:s days_to_holiday:i",
    "SELECT draw_date, gap AS days_to_holiday FROM holiday_gaps",
)
def holiday_distance(spark, d):
    return features.days_to_holiday(rel.draws(spark, d).select("draw_date").distinct())


@query(
    "H3_date_spine",
    "game:s day:s",
    """SELECT game, CAST(unnest(generate_series(min(draw_date), max(draw_date), INTERVAL 1 DAY)) AS DATE) AS day FROM day_draws GROUP BY game""",
)
def date_spine(spark, d):
    return intervals.day_spine(rel.date_ranges(rel.draws(spark, d, "day")))
