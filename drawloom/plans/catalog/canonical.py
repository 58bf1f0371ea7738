"""Reconciliation, rules, calendars and audit over weekly draws."""

from pyspark.sql import functions as F

from drawloom.operators import intervals, reconcile
from drawloom.plans import relations as rel
from drawloom.plans.registry import query
from drawloom.session import cut_lineage


def staged(spark, d):
    return reconcile.stage_observations(rel.sightings(spark, d), rel.rules(spark))


@query(
    "C3_rule_interval_join",
    "game:s draw_date:s rule_count:i rule_code:s pool:i",
    """SELECT d.game, d.draw_date, count(r.code) AS rule_count,
       CASE WHEN count(r.code) = 1 THEN max(r.code) END AS rule_code, CASE WHEN count(r.code) = 1 THEN max(r.pool) END AS pool
       FROM week_draws d LEFT JOIN rule_rows r ON r.game = d.game AND d.draw_date >= r.starts_on
        AND (r.ends_on IS NULL OR d.draw_date <= r.ends_on) GROUP BY d.game, d.draw_date""",
)
def rule_interval_join(spark, d):
    return intervals.attach_rule(rel.draws(spark, d), rel.rules(spark))


@query(
    "R1_observation_outcomes",
    "source:s arrival_seq:i game:s draw_date:s issue:s outcome:s",
    """WITH folded AS (
         SELECT game, draw_date, q1 AS q, 'accepted' AS outcome FROM fold_4
         UNION ALL SELECT game, draw_date, q2, CASE WHEN c2 THEN 'quarantined' ELSE 'corroborated' END FROM fold_4 WHERE m2 IS NOT NULL
         UNION ALL SELECT game, draw_date, q3, CASE WHEN d3 THEN 'quarantined' ELSE 'corroborated' END FROM fold_4 WHERE m3 IS NOT NULL
         UNION ALL SELECT game, draw_date, q4, CASE WHEN d4 THEN 'quarantined' ELSE 'corroborated' END FROM fold_4 WHERE m4 IS NOT NULL)
       ;; SELECT s.source, s.arrival_seq, s.game, s.draw_date, s.issue, coalesce(f.outcome, 'staged') AS outcome
       FROM staged_sightings s LEFT JOIN folded f ON f.game = s.game AND f.draw_date = s.draw_date AND f.q = s.arrival_seq AND s.issue IS NULL""",
)
def observation_outcomes(spark, d):
    return reconcile.observation_outcomes(staged(spark, d))


@query(
    "R1_canonical_draws",
    "game:s draw_date:s mains:a bonus:i status:s accepted_seq:i",
    "SELECT game, draw_date, mains, bonus, status, accepted_seq FROM canonical",
)
def canonical_draws(spark, d):
    return reconcile.canonical_draws(staged(spark, d))


def resolutions(spark, d):
    return resolutions_of(spark, rel.draws(spark, d))


def resolutions_of(spark, draws):
    """Operator decisions, after the last observation, on half of the draws that source b contradicts."""
    hexes = F.md5(F.concat_ws("|", "game", F.col("draw_date").cast("string")))
    chosen = (F.substring(hexes, 2, 1) == "0") & (F.substring(hexes, 4, 1) < "8")
    ruled = intervals.attach_rule(draws.filter(chosen), rel.rules(spark)).filter("rule_count = 1")
    return ruled.select("game", "draw_date", F.lit(10).alias("resolution_seq"), "mains", "bonus")


@query(
    "R2_resolved_draws",
    "game:s draw_date:s mains:a bonus:i status:s",
    """SELECT c.game, c.draw_date, CASE WHEN r.f THEN w.mains ELSE c.mains END AS mains,
       CASE WHEN r.f THEN w.bonus ELSE c.bonus END AS bonus, CASE WHEN r.f THEN 'accepted' ELSE c.status END AS status
       FROM canonical c JOIN week_draws w USING (game, draw_date),
       LATERAL (SELECT c.status = 'quarantined' AND substr(md5(concat(c.game, '|', CAST(c.draw_date AS VARCHAR))), 2, 1) = '0' AND substr(md5(concat(c.game, '|', CAST(c.draw_date AS VARCHAR))), 4, 1) < '8' AS f) r""",
)
def resolved_draws(spark, d):
    return reconcile.canonical_draws(staged(spark, d), resolutions(spark, d))


@query(
    "R2_superseded_observations",
    "game:s draw_date:s arrival_seq:i",
    """WITH r AS (SELECT f.*, w.mains AS wm, w.bonus AS wb FROM fold_4 f JOIN week_draws w USING (game, draw_date)
         WHERE f.d4 AND substr(md5(concat(f.game, '|', CAST(f.draw_date AS VARCHAR))), 2, 1) = '0' AND substr(md5(concat(f.game, '|', CAST(f.draw_date AS VARCHAR))), 4, 1) < '8'),
       x AS (SELECT game, draw_date, q1 AS arrival_seq, m1 AS m, b1 AS b, TRUE AS involved, wm, wb FROM r
         UNION ALL SELECT game, draw_date, q2, m2, b2, c2, wm, wb FROM r
         UNION ALL SELECT game, draw_date, q3, m3, b3, c3, wm, wb FROM r
         UNION ALL SELECT game, draw_date, q4, m4, b4, c4, wm, wb FROM r)
       ;; SELECT game, draw_date, arrival_seq FROM x WHERE m IS NOT NULL AND involved AND (m <> wm OR coalesce(b <> wb, FALSE))""",
)
def superseded_observations(spark, d):
    return reconcile.observation_outcomes(staged(spark, d), resolutions(spark, d)).filter("outcome = 'superseded'")


def _prize_steps(last):
    """SQL twin of the stored-tuple fold, one step per arrival."""
    text = """s1 AS (SELECT game, draw_date, tier, winners AS w, amount AS a, currency AS c, prize_type AS t, 1 AS since, CAST(NULL AS VARCHAR) AS kind
        FROM prize_sightings WHERE arrival_seq = 1)"""
    for n in range(2, last + 1):
        text += f""",
        j{n} AS (SELECT s.*, n.winners AS nw, n.amount AS na, n.currency AS nc, n.prize_type AS nt,
          coalesce(s.w <> n.winners, FALSE) OR coalesce(s.a <> n.amount, FALSE) OR coalesce(s.c <> n.currency, FALSE)
            OR (s.t <> 'unresolved' AND n.prize_type <> 'unresolved' AND s.t <> n.prize_type) AS clash,
          (n.winners IS NOT NULL OR s.w IS NULL) AND (n.amount IS NOT NULL OR s.a IS NULL) AND (n.currency IS NOT NULL OR s.c IS NULL)
            AND ((s.w IS NULL AND n.winners IS NOT NULL) OR (s.a IS NULL AND n.amount IS NOT NULL) OR (s.c IS NULL AND n.currency IS NOT NULL)
              OR (s.t = 'unresolved' AND n.prize_type <> 'unresolved')) AS better
          FROM s{n - 1} s JOIN prize_sightings n USING (game, draw_date, tier) WHERE n.arrival_seq = {n}),
        s{n} AS (SELECT game, draw_date, tier,
          CASE WHEN better AND NOT clash THEN nw ELSE w END AS w, CASE WHEN better AND NOT clash THEN na ELSE a END AS a,
          CASE WHEN better AND NOT clash THEN nc ELSE c END AS c, CASE WHEN better AND NOT clash THEN nt ELSE t END AS t,
          CASE WHEN better AND NOT clash THEN {n} ELSE since END AS since,
          CASE WHEN clash THEN 'prize_conflict' WHEN better THEN NULL
               WHEN w IS DISTINCT FROM nw OR a IS DISTINCT FROM na OR c IS DISTINCT FROM nc THEN 'partial_prize' END AS kind FROM j{n})"""
    return text


@query(
    "R3_prize_tiers",
    "game:s draw_date:s tier:s winners:i amount:f currency:s prize_type:s observation_seq:i",
    f"WITH /*MATERIALIZED*/{_prize_steps(4).replace(' AS (', ' AS MATERIALIZED (')} ;; SELECT game, draw_date, tier, w AS winners, a AS amount, c AS currency, t AS prize_type, since AS observation_seq FROM s4",
)
def prize_tiers(spark, d):
    return reconcile.reconcile_prizes(rel.prize_sightings(spark, d))[0]


@query(
    "R3_prize_issues",
    "game:s draw_date:s tier:s arrival_seq:i kind:s",
    f"""WITH {_prize_steps(4)} ;; SELECT * FROM (SELECT game, draw_date, tier, 2 AS arrival_seq, kind FROM s2
       UNION ALL SELECT game, draw_date, tier, 3, kind FROM s3 UNION ALL SELECT game, draw_date, tier, 4, kind FROM s4) WHERE kind IS NOT NULL""",
)
def prize_issues(spark, d):
    return reconcile.reconcile_prizes(rel.prize_sightings(spark, d))[1]


def _context_steps():
    text = """k1 AS (SELECT row_number() OVER (PARTITION BY game, draw_date ORDER BY arrival_seq) AS rn, * FROM context_sightings
        WHERE jackpot IS NOT NULL OR outcome IS NOT NULL),
      t1 AS (SELECT game, draw_date, jackpot AS j, currency AS c, outcome AS o, FALSE AS disputed FROM k1 WHERE rn = 1)"""
    for n in (2, 3):
        text += f""",
      u{n} AS (SELECT t.*, n.jackpot AS nj, n.currency AS nc, n.outcome AS no,
         coalesce(t.j <> n.jackpot, FALSE) OR coalesce(t.c <> n.currency, FALSE) OR coalesce(t.o <> n.outcome, FALSE) AS clash,
         (n.jackpot IS NOT NULL OR t.j IS NULL) AND (n.currency IS NOT NULL OR t.c IS NULL) AND (n.outcome IS NOT NULL OR t.o IS NULL)
           AND ((t.j IS NULL AND n.jackpot IS NOT NULL) OR (t.c IS NULL AND n.currency IS NOT NULL) OR (t.o IS NULL AND n.outcome IS NOT NULL)) AS better
         FROM t{n - 1} t LEFT JOIN (SELECT * FROM k1 WHERE rn = {n}) n USING (game, draw_date)),
      t{n} AS (SELECT game, draw_date, CASE WHEN better AND NOT clash THEN nj ELSE j END AS j, CASE WHEN better AND NOT clash THEN nc ELSE c END AS c,
         CASE WHEN better AND NOT clash THEN no ELSE o END AS o, disputed OR clash AS disputed FROM u{n})"""
    return text


@query(
    "R4_draw_context",
    "game:s draw_date:s jackpot:f currency:s outcome:s disputed:i",
    f"WITH {_context_steps()} ;; SELECT game, draw_date, j AS jackpot, c AS currency, o AS outcome, disputed FROM t3",
)
def draw_context(spark, d):
    return reconcile.reconcile_context(rel.context_sightings(spark, d))


# --- enrichment after a resolution ---------------------------------------------------------


def replayed_log(spark, d):
    """(observations, resolutions): draws that were resolved are published by all sources once more, ten places later."""
    draws = cut_lineage(rel.draws(spark, d))  # few rows, read four times; the items behind them once
    first = reconcile.stage_observations(rel.sightings_of(draws), rel.rules(spark))
    fixes = resolutions_of(spark, draws)
    again = first.join(fixes.select("game", "draw_date"), ["game", "draw_date"], "left_semi").withColumn("arrival_seq", F.col("arrival_seq") + 10)
    return first.unionByName(again.select(first.columns)), fixes


def rebuilt(spark, d, rows):
    """Prize or context rows, those of resolved draws published again, as far as their observation allows; and resolutions."""
    log, fixes = replayed_log(spark, d)
    again = rows.join(fixes.select("game", "draw_date"), ["game", "draw_date"], "left_semi").withColumn("arrival_seq", F.col("arrival_seq") + 10)
    return cut_lineage(reconcile.enriching(rows.unionByName(again.select(rows.columns)), log, fixes)), fixes


def solved_draws():
    """SQL twin of the resolved draws with their decided numbers."""
    return """solved AS (SELECT f.*, w.mains AS wm, w.bonus AS wb FROM fold_4 f JOIN week_draws w USING (game, draw_date)
         WHERE f.d4 AND substr(md5(concat(f.game, '|', CAST(f.draw_date AS VARCHAR))), 2, 1) = '0' AND substr(md5(concat(f.game, '|', CAST(f.draw_date AS VARCHAR))), 4, 1) < '8')"""


def _gate(table):
    """SQL twin of the gate: rows of accepted and corroborated observations by epoch, numbered within their key."""
    key = "game, draw_date, tier, epoch" if table == "prize_sightings" else "game, draw_date, epoch"
    known = "TRUE" if table == "prize_sightings" else "(p.jackpot IS NOT NULL OR p.outcome IS NOT NULL)"
    bad = [f"(m{n} IS NOT NULL AND (m{n} <> wm OR coalesce(b{n} <> wb, FALSE)))" for n in range(1, 5)]
    late = " UNION ALL ".join(f"SELECT game, draw_date, q{n}, 10 FROM solved WHERE m{n} IS NOT NULL AND NOT ({' OR '.join(bad[:n])})" for n in range(1, 5))
    return f"""{solved_draws()},
       allowed AS (SELECT game, draw_date, q1 AS seq, 0 AS epoch FROM fold_4 UNION ALL SELECT game, draw_date, q2, 0 FROM fold_4 WHERE m2 IS NOT NULL AND NOT c2
         UNION ALL SELECT game, draw_date, q3, 0 FROM fold_4 WHERE m3 IS NOT NULL AND NOT d3 UNION ALL SELECT game, draw_date, q4, 0 FROM fold_4 WHERE m4 IS NOT NULL AND NOT d4
         UNION ALL {late}),
       gate AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY arrival_seq) AS rn FROM (
         SELECT p.* REPLACE (p.arrival_seq + a.epoch AS arrival_seq), a.epoch FROM {table} p
         JOIN allowed a ON a.game = p.game AND a.draw_date = p.draw_date AND a.seq = p.arrival_seq WHERE {known}) g),
       last AS (SELECT game, draw_date, CASE WHEN (game, draw_date) IN (SELECT (game, draw_date) FROM solved) THEN 10 ELSE 0 END AS epoch FROM fold_4)"""


def _climbed_prizes():
    text = _gate("prize_sightings") + """,
      s1 AS (SELECT game, draw_date, tier, epoch, winners AS w, amount AS a, currency AS c, prize_type AS t, arrival_seq AS since, CAST(NULL AS VARCHAR) AS kind, arrival_seq AS seq FROM gate WHERE rn = 1)"""
    for n in range(2, 5):
        text += f""",
        j{n} AS (SELECT s.*, n.winners AS nw, n.amount AS na, n.currency AS nc, n.prize_type AS nt, n.arrival_seq AS nseq,
          coalesce(s.w <> n.winners, FALSE) OR coalesce(s.a <> n.amount, FALSE) OR coalesce(s.c <> n.currency, FALSE)
            OR coalesce(s.t <> 'unresolved' AND n.prize_type <> 'unresolved' AND s.t <> n.prize_type, FALSE) AS clash,
          n.arrival_seq IS NOT NULL AND (n.winners IS NOT NULL OR s.w IS NULL) AND (n.amount IS NOT NULL OR s.a IS NULL) AND (n.currency IS NOT NULL OR s.c IS NULL)
            AND ((s.w IS NULL AND n.winners IS NOT NULL) OR (s.a IS NULL AND n.amount IS NOT NULL) OR (s.c IS NULL AND n.currency IS NOT NULL)
              OR (s.t = 'unresolved' AND n.prize_type <> 'unresolved')) AS better
          FROM s{n - 1} s LEFT JOIN (SELECT * FROM gate WHERE rn = {n}) n USING (game, draw_date, tier, epoch)),
        s{n} AS (SELECT game, draw_date, tier, epoch, CASE WHEN better AND NOT clash THEN nw ELSE w END AS w, CASE WHEN better AND NOT clash THEN na ELSE a END AS a,
          CASE WHEN better AND NOT clash THEN nc ELSE c END AS c, CASE WHEN better AND NOT clash THEN nt ELSE t END AS t, CASE WHEN better AND NOT clash THEN nseq ELSE since END AS since,
          CASE WHEN nseq IS NULL THEN NULL WHEN clash THEN 'prize_conflict' WHEN better THEN NULL
               WHEN w IS DISTINCT FROM nw OR a IS DISTINCT FROM na OR c IS DISTINCT FROM nc THEN 'partial_prize' END AS kind, nseq AS seq FROM j{n})"""
    return text.replace(" AS (", " AS MATERIALIZED (")


def _climbed_context():
    text = _gate("context_sightings") + """,
      t1 AS (SELECT game, draw_date, epoch, jackpot AS j, currency AS c, outcome AS o, FALSE AS disputed, arrival_seq AS since, FALSE AS clash, arrival_seq AS seq, arrival_seq AS previous FROM gate WHERE rn = 1)"""
    for n in (2, 3):
        text += f""",
      u{n} AS (SELECT t.game, t.draw_date, t.epoch, j, c, o, disputed, since, n.jackpot AS nj, n.currency AS nc, n.outcome AS no, n.arrival_seq AS nseq,
         coalesce(t.j <> n.jackpot, FALSE) OR coalesce(t.c <> n.currency, FALSE) OR coalesce(t.o <> n.outcome, FALSE) AS clash,
         n.arrival_seq IS NOT NULL AND (n.jackpot IS NOT NULL OR t.j IS NULL) AND (n.currency IS NOT NULL OR t.c IS NULL) AND (n.outcome IS NOT NULL OR t.o IS NULL)
           AND ((t.j IS NULL AND n.jackpot IS NOT NULL) OR (t.c IS NULL AND n.currency IS NOT NULL) OR (t.o IS NULL AND n.outcome IS NOT NULL)) AS better
         FROM t{n - 1} t LEFT JOIN (SELECT * FROM gate WHERE rn = {n}) n USING (game, draw_date, epoch)),
      t{n} AS (SELECT game, draw_date, epoch, CASE WHEN better AND NOT clash THEN nj ELSE j END AS j, CASE WHEN better AND NOT clash THEN nc ELSE c END AS c,
         CASE WHEN better AND NOT clash THEN no ELSE o END AS o, disputed OR clash AS disputed, CASE WHEN better AND NOT clash THEN nseq ELSE since END AS since, clash, nseq AS seq, since AS previous FROM u{n})"""
    return text.replace(" AS (", " AS MATERIALIZED (")


@query(
    "R2_rebuilt_prizes",
    "game:s draw_date:s tier:s epoch:i winners:i amount:f currency:s prize_type:s observation_seq:i",
    f"WITH /*MATERIALIZED*/{_climbed_prizes()} ;; SELECT game, draw_date, tier, epoch, w AS winners, a AS amount, c AS currency, t AS prize_type, since AS observation_seq FROM s4 JOIN last USING (game, draw_date, epoch)",
)
def rebuilt_prizes(spark, d):
    """Prize tiers read from accepted and corroborated observations only, rebuilt after a resolution."""
    rows, fixes = rebuilt(spark, d, rel.prize_sightings(spark, d))
    return reconcile.reconcile_prizes(rows, fixes)[0]


@query(
    "R3_accepted_prize_issues",
    "game:s draw_date:s tier:s epoch:i arrival_seq:i kind:s",
    f"WITH /*MATERIALIZED*/{_climbed_prizes()} ;; SELECT game, draw_date, tier, epoch, seq AS arrival_seq, kind FROM (SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4) x WHERE kind IS NOT NULL",
)
def accepted_prize_issues(spark, d):
    rows, fixes = rebuilt(spark, d, rel.prize_sightings(spark, d))
    return reconcile.reconcile_prizes(rows, fixes)[1]


@query(
    "R2_rebuilt_context",
    "game:s draw_date:s epoch:i jackpot:f currency:s outcome:s disputed:i observation_seq:i",
    f"WITH /*MATERIALIZED*/{_climbed_context()} ;; SELECT game, draw_date, epoch, j AS jackpot, c AS currency, o AS outcome, disputed, since AS observation_seq FROM t3 JOIN last USING (game, draw_date, epoch)",
)
def rebuilt_context(spark, d):
    """Draw context read from accepted and corroborated observations only; a resolution clears it and its dispute."""
    rows, fixes = rebuilt(spark, d, rel.context_sightings(spark, d))
    return reconcile.reconcile_context(rows, fixes)


@query(
    "R4_context_conflicts",
    "game:s draw_date:s epoch:i arrival_seq:i kind:s previous_seq:i",
    f"WITH /*MATERIALIZED*/{_climbed_context()} ;; SELECT game, draw_date, epoch, seq AS arrival_seq, 'context_conflict' AS kind, previous AS previous_seq FROM (SELECT * FROM t2 UNION ALL SELECT * FROM t3) x WHERE clash",
)
def context_conflicts(spark, d):
    return reconcile.context_conflicts(rebuilt(spark, d, rel.context_sightings(spark, d))[0])
