"""Audit, calendar, derived context and coverage reports."""

from pyspark.sql import functions as F

from drawloom.operators import audit, derived, intervals, reconcile, report
from drawloom.plans import relations as rel
from drawloom.plans.catalog.canonical import staged
from drawloom.plans.registry import query
from drawloom.plans.relations_sql import RELATIONS

_H = "substr(md5(concat({t}game, '|', CAST({t}draw_date AS VARCHAR))), {n}, 1)"


def _h(n, t=""):
    return _H.format(n=n, t=t)


def digit(n):
    return F.substring(F.md5(F.concat_ws("|", "game", F.col("draw_date").cast("string"))), n, 1)


# --- rules and bindings -----------------------------------------------------------

RELATIONS["bound_rules"] = """
SELECT r.*, 'https://rules.example.org/' || game || '/' || code AS evidence_url,
  CASE WHEN NOT (game = 'O' AND code = 'R2') THEN sha256(game || code) END AS artifact_sha256,
  game = 'F' AS verified, NOT (game = 'O' AND code = 'R2') AS binding_matches FROM rule_rows r
"""


def rule_dimension(spark):
    url = F.concat(F.lit("https://rules.example.org/"), "game", F.lit("/"), "code")
    return rel.rules(spark).withColumn("evidence_url", url)


def rule_artifacts(spark):
    """Evidence of the rules; the body of O/R1 does not check, and O/R2 has a second readable copy elsewhere."""
    rules = rule_dimension(spark)
    return rules.select(
        F.sha2(F.concat("game", "code"), 256).alias("sha256"),
        F.col("evidence_url").alias("url"),
        F.lit("valid").alias("status"),
        (~((F.col("game") == "O") & (F.col("code") == "R1"))).alias("body_ok"),
    )


def bindings(spark):
    rules = rule_dimension(spark).filter("not (game = 'O' and code = 'R2')")
    sha = F.sha2(F.concat("game", "code"), 256).alias("artifact_sha256")
    return rules.select("game", F.col("code").alias("rule_code"), sha, F.col("evidence_url").alias("source_url"))


def bound(spark):
    return audit.bind_rules(rule_dimension(spark), bindings(spark), rule_artifacts(spark))


@query(
    "C9_rule_bindings",
    "game:s code:s draws:i verified:i binding_matches:i",
    """SELECT b.game, b.code, count(w.draw_date) AS draws, CAST(any_value(b.verified) AS INT) AS verified, CAST(any_value(b.binding_matches) AS INT) AS binding_matches
       FROM bound_rules b LEFT JOIN week_draws w ON w.game = b.game AND w.draw_date >= b.starts_on AND (b.ends_on IS NULL OR w.draw_date <= b.ends_on) GROUP BY 1, 2""",
)
def rule_bindings(spark, d):
    used = intervals.attach_rule(rel.draws(spark, d), rel.rules(spark)).groupBy("game", F.col("rule_code").alias("code"))
    counts = used.agg(F.count("*").alias("draws"))
    joined = bound(spark).join(counts, ["game", "code"], "left")
    return joined.withColumn("draws", F.coalesce("draws", F.lit(0)))


@query(
    "C17_rule_evidence",
    "game:s code:s draws:i evidence:s listed:i",
    """SELECT b.game, b.code, count(w.draw_date) AS draws, sha256(b.game || b.code) AS evidence, CAST(b.artifact_sha256 IS NOT NULL AS INT) AS listed
       FROM bound_rules b LEFT JOIN week_draws w ON w.game = b.game AND w.draw_date >= b.starts_on AND (b.ends_on IS NULL OR w.draw_date <= b.ends_on)
       GROUP BY b.game, b.code, b.artifact_sha256""",
)
def rule_evidence(spark, d):
    evidence = audit.rule_evidence(rule_dimension(spark), rule_artifacts(spark))
    used = intervals.attach_rule(rel.draws(spark, d), rel.rules(spark)).groupBy("game", F.col("rule_code").alias("code"))
    wanted = bindings(spark).select("game", F.col("rule_code").alias("code"), "artifact_sha256")
    joined = evidence.join(used.agg(F.count("*").alias("draws")), ["game", "code"], "left").join(wanted, ["game", "code"], "left")
    listed = F.coalesce(F.array_contains("evidence_sha256", F.col("artifact_sha256")), F.lit(False))
    return joined.select(
        "game", "code", F.coalesce("draws", F.lit(0)).alias("draws"), F.array_join("evidence_sha256", ",").alias("evidence"), listed.alias("listed")
    )


@query(
    "C4_overlapping_rules",
    "game:s code_a:s code_b:s",
    """WITH y AS (SELECT game, 'Y' || year(draw_date) AS code, min(draw_date) AS starts_on, max(draw_date) + 10 AS ends_on FROM day_draws GROUP BY game, year(draw_date))
       ;; SELECT a.game, a.code AS code_a, b.code AS code_b FROM y a JOIN y b ON a.game = b.game AND a.code < b.code AND a.starts_on <= b.ends_on AND b.starts_on <= a.ends_on""",
)
def overlapping_rules(spark, d):
    """Yearly regimes that run ten days over their end."""
    year = F.concat(F.lit("Y"), F.year("draw_date").cast("string")).alias("code")
    spans = rel.draws(spark, d, "day").groupBy("game", year).agg(
        F.min("draw_date").alias("starts_on"), F.date_add(F.max("draw_date"), 10).alias("ends_on")
    )
    return intervals.overlapping_rules(spans)


# --- assessed draws ---------------------------------------------------------------

RELATIONS["audit_draws"] = f"""
SELECT c.game, c.draw_date, c.mains, c.bonus, c.status, r.code AS rule_code, r.pool, r.verified, r.binding_matches,
  {_h(1, 'c.')} <> 'f' AS evidence_ok, c.status = 'quarantined' AND {_h(3, 'c.')} < '8' AS number_conflict, {_h(1, 'c.')} <> 'e' AS has_observation,
  CASE WHEN {_h(4, 'c.')} = '5' THEN c.draw_date + 1 ELSE c.draw_date END AS obs_date, CASE WHEN {_h(4, 'c.')} = '6' THEN 1 ELSE c.bonus END AS obs_bonus,
  sha256(concat(c.game, '|', CAST(c.draw_date AS VARCHAR), '|', CAST(c.accepted_seq AS VARCHAR))) AS observation_key
FROM canonical c JOIN bound_rules r ON r.game = c.game AND c.draw_date >= r.starts_on AND (r.ends_on IS NULL OR c.draw_date <= r.ends_on)
"""
RELATIONS["assessed"] = """
SELECT *, list_concat(
  CASE WHEN NOT evidence_ok THEN ['invalid_evidence'] ELSE [] END,
  CASE WHEN status <> 'accepted' THEN ['invalid_status'] ELSE [] END,
  CASE WHEN number_conflict THEN ['number_conflict'] ELSE [] END,
  CASE WHEN NOT has_observation OR obs_date <> draw_date OR (obs_bonus IS NOT NULL AND obs_bonus IS DISTINCT FROM bonus) THEN ['observation_mismatch'] ELSE [] END,
  CASE WHEN NOT binding_matches THEN ['rule_mismatch'] ELSE [] END,
  CASE WHEN NOT verified THEN ['unverified_rule'] ELSE [] END) AS reasons FROM audit_draws
"""


def audit_draws(spark, d):
    now = reconcile.canonical_draws(staged(spark, d))
    ruled = intervals.attach_rule(now, rel.rules(spark)).drop("rule_count", "pool", "schedule")
    shifted = F.when(digit(4) == "5", F.date_add("draw_date", 1)).otherwise(F.col("draw_date"))
    return ruled.select(
        "*",
        (digit(1) != "f").alias("evidence_ok"),
        ((F.col("status") == "quarantined") & (digit(3) < "8")).alias("number_conflict"),
        (digit(1) != "e").alias("has_observation"),
        F.col("game").alias("obs_game"),
        shifted.alias("obs_date"),
        F.col("mains").alias("obs_mains"),
        F.when(digit(4) == "6", 1).otherwise(F.col("bonus")).alias("obs_bonus"),
        F.sha2(F.concat_ws("|", "game", F.col("draw_date").cast("string"), F.col("accepted_seq").cast("string")), 256).alias("observation_key"),
    )


def assessed(spark, d):
    return audit.assess_draws(audit_draws(spark, d), bound(spark))


@query("B10_eligibility_reasons", "game:s draw_date:s rule_code:s reasons:a", "SELECT game, draw_date, rule_code, reasons FROM assessed")
def eligibility(spark, d):
    return assessed(spark, d)


@query(
    "D8_exclusion_histogram",
    "game:s reason:s draws:i",
    "SELECT game, reason, count(*) AS draws FROM (SELECT game, unnest(reasons) AS reason FROM assessed) x GROUP BY 1, 2",
)
def exclusion_histogram(spark, d):
    return audit.exclusion_histogram(assessed(spark, d))


@query(
    "D8_audit_counts",
    "game:s canonical_candidates:i included:i excluded:i",
    "SELECT game, count(*) AS canonical_candidates, count(*) FILTER (WHERE len(reasons) = 0) AS included, count(*) FILTER (WHERE len(reasons) > 0) AS excluded FROM assessed GROUP BY 1",
)
def audit_counts(spark, d):
    return audit.audit_counts(assessed(spark, d))


RELATIONS["enrichment_rows"] = """
SELECT game, draw_date, tier, winners, amount, hex <> '3' AS evidence_ok, hex IN ('1', '2') AS disputed,
  sha256(concat(game, '|', CAST(draw_date AS VARCHAR), '|', tier)) AS observation_key FROM tier_rows
"""


def enrichment(spark, d):
    key = F.sha2(F.concat_ws("|", "game", F.col("draw_date").cast("string"), "tier"), 256)
    return rel.tier_rows(spark, d).select(
        "game",
        "draw_date",
        "tier",
        "winners",
        "amount",
        (F.col("hex") != "3").alias("evidence_ok"),
        F.col("hex").isin("1", "2").alias("disputed"),
        key.alias("observation_key"),
    )


@query(
    "B20_enrichment_gate",
    "game:s draw_date:s tier:s kept:i disputed:i",
    """SELECT e.game, e.draw_date, e.tier, CAST(e.evidence_ok AS INT) AS kept, CAST(e.disputed AS INT) AS disputed
       FROM enrichment_rows e JOIN assessed a ON a.game = e.game AND a.draw_date = e.draw_date AND len(a.reasons) = 0""",
)
def enrichment_gate(spark, d):
    return audit.gate_enrichment(enrichment(spark, d), assessed(spark, d).filter("size(reasons) = 0"))


RELATIONS["calendar_events"] = f"""
SELECT game, draw_date + 1 AS day, {_h(2)} < '8' AS scheduled FROM week_draws WHERE {_h(1)} = 'a'
UNION ALL SELECT game, draw_date + 1, {_h(2)} >= '8' FROM week_draws WHERE {_h(1)} = 'a' AND {_h(3)} = 'a'
"""
RELATIONS["week_calendar"] = """
SELECT s.game, s.day, r.code AS rule_code, e.sched AS event_scheduled, coalesce(e.conflict, FALSE) AS event_conflict,
  coalesce(e.sched, CASE WHEN r.code IS NOT NULL THEN isodow(s.day) = 1 END) AS scheduled, w.draw_date IS NOT NULL AS observed
FROM (SELECT game, CAST(unnest(generate_series(min(draw_date), max(draw_date), INTERVAL 1 DAY)) AS DATE) AS day FROM week_draws GROUP BY game) s
LEFT JOIN rule_rows r ON r.game = s.game AND s.day >= r.starts_on AND (r.ends_on IS NULL OR s.day <= r.ends_on)
LEFT JOIN (SELECT game, day, bool_and(scheduled) AS sched, bool_and(scheduled) <> bool_or(scheduled) AS conflict FROM calendar_events GROUP BY 1, 2) e ON e.game = s.game AND e.day = s.day
LEFT JOIN week_draws w ON w.game = s.game AND w.draw_date = s.day
"""


def calendar_events(spark, d):
    base = rel.draws(spark, d).filter(digit(1) == "a")
    flag = digit(2) < "8"
    rows = F.array_compact(F.array(F.struct(flag.alias("scheduled")), F.when(digit(3) == "a", F.struct((~flag).alias("scheduled")))))
    return base.select("game", F.date_add("draw_date", 1).alias("day"), F.explode(rows).alias("x")).select("game", "day", "x.scheduled")


def week_calendar(spark, d):
    draws = rel.draws(spark, d)
    cal = intervals.calendar(rel.date_ranges(draws), rel.rules(spark), calendar_events(spark, d))
    return intervals.mark_observed(cal, draws)


@query(
    "R5_calendar",
    "game:s day:s iso_year:i iso_week:i weekday:i rule_code:s scheduled:i observed:i",
    """SELECT game, day, isoyear(day) AS iso_year, weekofyear(day) AS iso_week, isodow(day) - 1 AS weekday, rule_code, CAST(scheduled AS INT) AS scheduled,
       CAST(observed AS INT) AS observed FROM week_calendar""",
)
def calendar(spark, d):
    from drawloom.functions.scalars import iso_fields

    fields = iso_fields(F.col("day"))
    return week_calendar(spark, d).select("*", *[c.alias(n) for n, c in fields.items()])


@query(
    "C10_event_override",
    "game:s day:s event_scheduled:i event_conflict:i scheduled:i",
    """SELECT game, day, CAST(event_scheduled AS INT) AS event_scheduled, CAST(event_conflict AS INT) AS event_conflict, CAST(scheduled AS INT) AS scheduled
       FROM week_calendar WHERE event_scheduled IS NOT NULL""",
)
def event_override(spark, d):
    return week_calendar(spark, d).filter("event_scheduled is not null")


@query(
    "D10_schedule_coverage",
    "game:s expected:i eligible_observed:i missing:i first_missing:s last_missing:s unexpected:i unknown_schedule_days:i eligible_on_unknown_days:i conflicting_event_days:i",
    """SELECT game, count(*) FILTER (WHERE scheduled) AS expected, count(*) FILTER (WHERE scheduled AND observed) AS eligible_observed, count(*) FILTER (WHERE scheduled AND NOT observed) AS missing,
       min(CASE WHEN scheduled AND NOT observed THEN day END) AS first_missing, max(CASE WHEN scheduled AND NOT observed THEN day END) AS last_missing,
       count(*) FILTER (WHERE NOT scheduled AND observed) AS unexpected, count(*) FILTER (WHERE scheduled IS NULL) AS unknown_schedule_days,
       count(*) FILTER (WHERE scheduled IS NULL AND observed) AS eligible_on_unknown_days, count(*) FILTER (WHERE event_conflict) AS conflicting_event_days
       FROM week_calendar GROUP BY 1""",
)
def schedule_coverage(spark, d):
    return intervals.schedule_summary(week_calendar(spark, d))


@query(
    "D10_schedule_dates",
    "game:s day:s kind:s",
    """WITH s AS (SELECT game, CAST(unnest(generate_series(min(draw_date), max(draw_date), INTERVAL 1 DAY)) AS DATE) AS day FROM day_draws GROUP BY game)
       ;; SELECT s.game, s.day, CASE WHEN isodow(s.day) = 1 THEN 'missing' ELSE 'unexpected' END AS kind FROM s
       JOIN rule_rows r ON r.game = s.game AND s.day >= r.starts_on AND (r.ends_on IS NULL OR s.day <= r.ends_on)
       LEFT JOIN day_draws w ON w.game = s.game AND w.draw_date = s.day WHERE (isodow(s.day) = 1) <> (w.draw_date IS NOT NULL)""",
)
def schedule_dates(spark, d):
    """Daily draws against a weekly schedule: Mondays without a draw, and draws on other days."""
    draws = rel.draws(spark, d, "day")
    return intervals.schedule_dates(intervals.mark_observed(intervals.calendar(rel.date_ranges(draws), rel.rules(spark)), draws))


@query(
    "R7_full_audit",
    "game:s canonical_candidates:i included:i excluded:i expected:i eligible_observed:i missing:i unexpected:i unknown_schedule_days:i enrichment_included:i "
    "enrichment_disputed:i unverifiable_evidence:i warnings:a blocking:a snapshot_ready:i",
    """WITH fine AS (SELECT game, draw_date FROM assessed WHERE len(reasons) = 0),
       cal AS (SELECT c.game, c.day, coalesce(c.event_scheduled, CASE WHEN c.rule_code IS NOT NULL AND c.game = 'F' THEN isodow(c.day) = 1 END) AS scheduled, c.event_conflict,
               f.draw_date IS NOT NULL AS observed FROM week_calendar c LEFT JOIN fine f ON f.game = c.game AND f.draw_date = c.day),
       cov AS (SELECT game, count(*) FILTER (WHERE scheduled) AS expected, count(*) FILTER (WHERE scheduled AND observed) AS eligible_observed, count(*) FILTER (WHERE scheduled AND NOT observed) AS missing,
               count(*) FILTER (WHERE NOT scheduled AND observed) AS unexpected, count(*) FILTER (WHERE scheduled IS NULL) AS unknown_schedule_days, count(*) FILTER (WHERE event_conflict) AS conf FROM cal GROUP BY 1),
       cnt AS (SELECT game, count(*) AS canonical_candidates, count(*) FILTER (WHERE len(reasons) = 0) AS included, count(*) FILTER (WHERE len(reasons) > 0) AS excluded FROM assessed GROUP BY 1),
       enr AS (SELECT e.game, count(*) FILTER (WHERE evidence_ok) AS enrichment_included, count(*) FILTER (WHERE evidence_ok AND disputed) AS enrichment_disputed, count(*) FILTER (WHERE NOT evidence_ok) AS unverifiable_evidence
               FROM enrichment_rows e JOIN fine f ON f.game = e.game AND f.draw_date = e.draw_date GROUP BY 1)
       ;; SELECT cnt.*, cov.expected, cov.eligible_observed, cov.missing, cov.unexpected, cov.unknown_schedule_days, enr.enrichment_included, enr.enrichment_disputed, enr.unverifiable_evidence,
       list_concat(CASE WHEN missing > 0 THEN ['missing_scheduled_draws'] ELSE [] END, CASE WHEN unknown_schedule_days > 0 THEN ['unknown_schedule_days'] ELSE [] END, CASE WHEN cnt.game = 'O' THEN ['unverified_rules'] ELSE [] END) AS warnings,
       list_concat(CASE WHEN conf > 0 THEN ['conflicting_calendar_events'] ELSE [] END, CASE WHEN unexpected > 0 THEN ['unexpected_dates_require_reviewed_exception'] ELSE [] END, CASE WHEN included = 0 THEN ['zero_eligible_draws'] ELSE [] END) AS blocking,
       CAST(conf = 0 AND unexpected = 0 AND included > 0 AS INT) AS snapshot_ready
       FROM cnt JOIN cov USING (game) LEFT JOIN enr USING (game)""",
)
def full_audit(spark, d):
    ranges = rel.date_ranges(rel.draws(spark, d))
    return audit.full_audit(assessed(spark, d), bound(spark), ranges, calendar_events(spark, d), enrichment(spark, d))


RELATIONS["lineage_rows"] = """
SELECT source, arrival_seq, game, draw_date, sha256(concat(game, '|', CAST(draw_date AS VARCHAR), '|', CAST(arrival_seq AS VARCHAR))) AS observation_key,
  sha256(concat(source, '|', game, '|', CAST(year(draw_date) AS VARCHAR))) AS artifact_sha256 FROM sightings
"""


def lineage(spark, d):
    day = F.col("draw_date").cast("string")
    return rel.sightings(spark, d).select(
        "source",
        "arrival_seq",
        "game",
        "draw_date",
        F.sha2(F.concat_ws("|", "game", day, F.col("arrival_seq").cast("string")), 256).alias("observation_key"),
        F.sha2(F.concat_ws("|", "source", "game", F.year("draw_date").cast("string")), 256).alias("artifact_sha256"),
    )


@query(
    "C24_lineage_selection",
    "source:s rows:i evidence:i",
    """SELECT l.source, count(*) AS rows, count(DISTINCT CASE WHEN a.observation_key = l.observation_key THEN artifact_sha256 END) AS evidence
       FROM lineage_rows l JOIN audit_draws a ON a.game = l.game AND a.draw_date = l.draw_date GROUP BY 1""",
)
def lineage_selection(spark, d):
    draws = audit_draws(spark, d).select("game", "draw_date", "observation_key")
    kept = audit.select_lineage(lineage(spark, d), draws, enrichment(spark, d).withColumn("kept", F.col("evidence_ok")))
    used = draws.select("observation_key").withColumn("used", F.lit(True))
    joined = kept.join(used, "observation_key", "left")
    return joined.groupBy("source").agg(F.count("*").alias("rows"), F.countDistinct(F.when(F.col("used"), F.col("artifact_sha256"))).alias("evidence"))


@query(
    "C1_lineage_join",
    "source:s kind:s game:s observations:i artifacts:i",
    """SELECT l.source, CASE l.source WHEN 'a' THEN 'operator' WHEN 'b' THEN 'archive' ELSE 'manual' END AS kind, l.game, count(*) AS observations, count(DISTINCT artifact_sha256) AS artifacts
       FROM lineage_rows l GROUP BY 1, 2, 3""",
)
def lineage_join(spark, d):
    """Observation -> artifact -> source; artifacts are the distinct hashes of the log, sources a four-row dimension."""
    log = lineage(spark, d)
    artifacts = log.select("artifact_sha256", "source").distinct()
    sources = spark.sql("SELECT * FROM VALUES ('a', 'operator'), ('b', 'archive'), ('c', 'manual'), ('d', 'manual') AS s(source, kind)")
    joined = log.drop("source").join(artifacts, "artifact_sha256").join(sources, "source")
    return joined.groupBy("source", "kind", "game").agg(F.count("*").alias("observations"), F.countDistinct("artifact_sha256").alias("artifacts"))


@query(
    "C2_draws_with_accepted_observation",
    "game:s draw_date:s status:s source:s observation_key:s artifact_sha256:s",
    """SELECT a.game, a.draw_date, a.status, l.source, l.observation_key, l.artifact_sha256 FROM audit_draws a
       LEFT JOIN lineage_rows l ON l.observation_key = a.observation_key AND a.has_observation""",
)
def draws_with_observation(spark, d):
    draws = audit_draws(spark, d).select("game", "draw_date", "status", F.when(F.col("has_observation"), F.col("observation_key")).alias("_key"))
    seen = lineage(spark, d).select("source", "observation_key", "artifact_sha256")
    return draws.join(seen, F.col("_key") == F.col("observation_key"), "left")


# --- derived context -----------------------------------------------------------------


def linked_draws(spark, d):
    draws = rel.draws(spark, d)
    ruled = intervals.attach_rule(draws, rel.rules(spark)).filter("rule_count = 1").drop("rule_count", "pool", "schedule")
    cal = intervals.calendar(rel.date_ranges(draws), rel.rules(spark))
    linked = intervals.mark_continuity(ruled, cal)
    return linked.join(rel.context_rows(spark, d).select("game", "draw_date", "outcome"), ["game", "draw_date"], "left")


RELATIONS["linked_draws"] = """
SELECT game, draw_date, mains, bonus, code AS rule_code, outcome,
  coalesce(lag(code) OVER s = code AND date_diff('day', lag(draw_date) OVER s, draw_date) = 7, FALSE) AS continuous_from_previous
FROM (SELECT w.*, r.code, c.outcome FROM week_draws w JOIN rule_rows r ON r.game = w.game AND w.draw_date >= r.starts_on AND (r.ends_on IS NULL OR w.draw_date <= r.ends_on)
      LEFT JOIN context_rows c ON c.game = w.game AND c.draw_date = w.draw_date) x WINDOW s AS (PARTITION BY game ORDER BY draw_date)
"""


@query(
    "C13_continuity",
    "game:s draw_date:s rule_code:s continuous_from_previous:i",
    "SELECT game, draw_date, rule_code, CAST(continuous_from_previous AS INT) AS continuous_from_previous FROM linked_draws",
)
def continuity(spark, d):
    return linked_draws(spark, d)


@query(
    "E1_previous_draw",
    "game:s draw_date:s previous_overlap:i days_since_previous:i",
    """SELECT game, draw_date, CASE WHEN p IS NOT NULL THEN len(list_intersect(mains, p)) END AS previous_overlap, date_diff('day', pd, draw_date) AS days_since_previous
       FROM (SELECT *, lag(mains) OVER s AS p, lag(draw_date) OVER s AS pd FROM linked_draws WINDOW s AS (PARTITION BY game ORDER BY draw_date)) x""",
)
def previous_draw(spark, d):
    return derived.previous_draw(linked_draws(spark, d))


_STREAK = """numbered AS (SELECT *, row_number() OVER (PARTITION BY game ORDER BY draw_date) AS i FROM linked_draws),
  walk AS (
    SELECT game, draw_date, i, outcome, CAST(NULL AS BIGINT) AS streak FROM numbered WHERE i = 1
    UNION ALL
    SELECT n.game, n.draw_date, n.i, n.outcome,
      CASE WHEN NOT n.continuous_from_previous THEN NULL WHEN w.outcome = 'Won' THEN 0 WHEN w.outcome = 'Roll' THEN w.streak + 1 END
    FROM walk w JOIN numbered n ON n.game = w.game AND n.i = w.i + 1)"""


@query(
    "E3_rollover_streak",
    "game:s draw_date:s prior_rollover_streak:i",
    f"WITH /*RECURSIVE*/ {_STREAK} ;; SELECT game, draw_date, streak AS prior_rollover_streak FROM walk",
)
def rollover_streak(spark, d):
    return derived.win_history(linked_draws(spark, d))


@query(
    "C22_last_known_win",
    "game:s draw_date:s prior_known_win_date:s days_since_prior_known_win:i",
    """SELECT *, date_diff('day', prior_known_win_date, draw_date) AS days_since_prior_known_win FROM (
       SELECT game, draw_date, max(CASE WHEN outcome = 'Won' THEN draw_date END) OVER (PARTITION BY game ORDER BY draw_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_known_win_date
       FROM linked_draws) x""",
)
def last_known_win(spark, d):
    return derived.win_history(linked_draws(spark, d))


RELATIONS["priced_tiers"] = """
SELECT game, draw_date, tier, winners, amount, CASE WHEN draw_date < DATE '1997-01-01' THEN 'IEP' WHEN tier = 'Match 4' AND draw_date < DATE '1997-06-01' THEN NULL ELSE currency END AS currency, prize_type FROM prize_facts
"""
RELATIONS["face_rows"] = """
SELECT game, draw_date, sum(CASE WHEN currency = 'EUR' THEN winners * CAST(amount AS DOUBLE) END) AS eur, sum(CASE WHEN currency = 'IEP' THEN winners * CAST(amount AS DOUBLE) END) AS iep,
  sum(CASE WHEN currency = 'EUR' AND prize_type = 'cash' THEN winners * CAST(amount AS DOUBLE) END) AS cash_only_eur, count(*) FILTER (WHERE currency = 'EUR' AND prize_type = 'cash') AS cash_known_tiers
FROM priced_tiers WHERE winners IS NOT NULL AND amount IS NOT NULL AND currency IS NOT NULL GROUP BY 1, 2
"""


def priced_tiers(spark, d):
    currency = (
        F.when(F.col("draw_date") < "1997-01-01", "IEP")
        .when((F.col("tier") == "Match 4") & (F.col("draw_date") < "1997-06-01"), None)
        .otherwise(F.col("currency"))
    )
    return rel.prize_facts(spark, d).withColumn("currency", currency)


@query("D27_face_values", "game:s draw_date:s eur:f iep:f cash_only_eur:f cash_known_tiers:i", "SELECT * FROM face_rows")
def face_values(spark, d):
    rows = derived.face_values(priced_tiers(spark, d))
    return rows.select("*", F.col("face_values")["EUR"].alias("eur"), F.col("face_values")["IEP"].alias("iep"))


@query(
    "R6_derived_context",
    "game:s draw_date:s main_sum:i odd_count:i adjacent_pairs:i previous_overlap:i days_since_previous:i prior_rollover_streak:i prior_known_win_date:s cash_only_eur:f cash_known_tiers:i",
    f"""WITH /*RECURSIVE*/ {_STREAK},
       prev AS (SELECT *, lag(mains) OVER s AS p, lag(draw_date) OVER s AS pd, max(CASE WHEN outcome = 'Won' THEN draw_date END) OVER (PARTITION BY game ORDER BY draw_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wd
         FROM linked_draws WINDOW s AS (PARTITION BY game ORDER BY draw_date))
       ;; SELECT v.game, v.draw_date, list_sum(v.mains) AS main_sum, v.mains[1] % 2 + v.mains[2] % 2 + v.mains[3] % 2 + v.mains[4] % 2 + v.mains[5] % 2 + v.mains[6] % 2 AS odd_count,
       CAST(v.mains[2] - v.mains[1] = 1 AS INT) + CAST(v.mains[3] - v.mains[2] = 1 AS INT) + CAST(v.mains[4] - v.mains[3] = 1 AS INT) + CAST(v.mains[5] - v.mains[4] = 1 AS INT) + CAST(v.mains[6] - v.mains[5] = 1 AS INT) AS adjacent_pairs,
       CASE WHEN v.p IS NOT NULL THEN len(list_intersect(v.mains, v.p)) END AS previous_overlap, date_diff('day', v.pd, v.draw_date) AS days_since_previous,
       w.streak AS prior_rollover_streak, v.wd AS prior_known_win_date, f.cash_only_eur, coalesce(f.cash_known_tiers, 0) AS cash_known_tiers
       FROM prev v JOIN walk w ON w.game = v.game AND w.draw_date = v.draw_date LEFT JOIN face_rows f ON f.game = v.game AND f.draw_date = v.draw_date""",
)
def derived_context(spark, d):
    return derived.derive_context(linked_draws(spark, d), priced_tiers(spark, d))


@query(
    "C6_tiers_without_conflict",
    "game:s tier:s kept:i",
    """SELECT game, tier, count(*) AS kept FROM tier_rows t WHERE NOT EXISTS (SELECT 1 FROM tier_rows q WHERE q.game = t.game AND q.draw_date = t.draw_date AND q.tier = t.tier
       AND q.hex IN ('7', 'a', 'b', 'e', 'f', '4')) GROUP BY 1, 2""",
)
def tiers_without_conflict(spark, d):
    """Issues whose kind marks an open conflict on the tier."""
    rows = rel.tier_rows(spark, d)
    kind = F.when(F.col("hex").isin("7", "a", "b", "e", "f", "4"), "prize_conflict").otherwise("partial_prize")
    kept = derived.without_open_conflicts(rows, rows.withColumn("kind", kind))
    return kept.groupBy("game", "tier").agg(F.count("*").alias("kept"))


# --- reports ---------------------------------------------------------------------------


@query(
    "D1_yearly_coverage",
    "year:i status:s draws:i first:s last:s",
    "SELECT year(draw_date) AS year, status, count(*) AS draws, min(draw_date) AS first, max(draw_date) AS last FROM canonical GROUP BY 1, 2",
)
def yearly_coverage(spark, d):
    return report.yearly_coverage(reconcile.canonical_draws(staged(spark, d)))


RELATIONS["status_rows"] = f"""
SELECT s.*, CASE WHEN issue IS NOT NULL THEN 'staged' WHEN {_h(2)} = '0' AND source = 'b' THEN 'quarantined' ELSE 'accepted' END AS status FROM staged_sightings s
"""


def status_rows(spark, d):
    mark = F.when(F.col("issue").isNotNull(), "staged").when((digit(2) == "0") & (F.col("source") == "b"), "quarantined")
    return staged(spark, d).withColumn("status", F.coalesce(mark, F.lit("accepted")))


@query(
    "D2_observation_coverage",
    "source:s status:s game:s year:i records:i first:s last:s",
    "SELECT source, status, game, year(draw_date) AS year, count(*) AS records, min(draw_date) AS first, max(draw_date) AS last FROM status_rows GROUP BY 1, 2, 3, 4",
)
def observation_coverage(spark, d):
    return report.observation_coverage(status_rows(spark, d))


@query(
    "D3_field_missingness",
    "source:s records:i missing_bonus:i missing_issue:i",
    "SELECT source, count(*) AS records, count(*) FILTER (WHERE bonus IS NULL) AS missing_bonus, count(*) FILTER (WHERE issue IS NULL) AS missing_issue FROM status_rows GROUP BY 1",
)
def field_missingness(spark, d):
    return report.missingness(status_rows(spark, d), ["bonus", "issue"], ["source"])


@query(
    "D3_prize_missingness",
    "records:i missing_winners:i missing_amount:i missing_currency:i",
    """SELECT count(*) AS records, count(*) FILTER (WHERE winners IS NULL) AS missing_winners, count(*) FILTER (WHERE amount IS NULL) AS missing_amount,
       count(*) FILTER (WHERE currency IS NULL) AS missing_currency FROM priced_tiers""",
)
def prize_missingness(spark, d):
    return report.missingness(priced_tiers(spark, d), ["winners", "amount", "currency"])


@query(
    "D4_acquisition_status",
    "game:s accepted:i quarantined:i pending:i first:s last:s with_bonus:i with_prizes:i with_jackpot:i with_outcome:i outstanding:a",
    """SELECT c.game, count(*) FILTER (WHERE status = 'accepted') AS accepted, count(*) FILTER (WHERE status = 'quarantined') AS quarantined, 0 AS pending,
       min(CASE WHEN status = 'accepted' THEN c.draw_date END) AS first, max(CASE WHEN status = 'accepted' THEN c.draw_date END) AS last,
       count(*) FILTER (WHERE status = 'accepted' AND c.bonus IS NOT NULL) AS with_bonus, count(*) FILTER (WHERE status = 'accepted' AND p.game IS NOT NULL) AS with_prizes,
       count(*) FILTER (WHERE status = 'accepted' AND x.jackpot IS NOT NULL AND x.hex <> 'c') AS with_jackpot, count(*) FILTER (WHERE status = 'accepted' AND x.outcome IS NOT NULL AND x.hex <> 'c') AS with_outcome, [] AS outstanding
       FROM canonical c LEFT JOIN (SELECT DISTINCT game, draw_date FROM prize_facts WHERE tier = 'Match 6') p ON p.game = c.game AND p.draw_date = c.draw_date
       LEFT JOIN context_rows x ON x.game = c.game AND x.draw_date = c.draw_date GROUP BY 1""",
)
def acquisition_status(spark, d):
    draws = reconcile.canonical_draws(staged(spark, d))
    context = rel.context_rows(spark, d).withColumn("disputed", F.col("hex") == "c")
    flagged = report.with_flags(draws, rel.prize_facts(spark, d).filter("tier = 'Match 6'"), context)
    return report.acquisition_status(flagged, rule_dimension(spark))


@query(
    "D5_regime_profile",
    "game:s code:s starts_on:s ends_on:s pool:i draws:i accepted:i quarantined:i",
    """SELECT r.game, r.code, r.starts_on, r.ends_on, r.pool, count(c.draw_date) AS draws, count(*) FILTER (WHERE c.status = 'accepted') AS accepted, count(*) FILTER (WHERE c.status = 'quarantined') AS quarantined
       FROM (SELECT * FROM rule_rows UNION ALL SELECT 'X', 'R0', DATE '1980-01-01', DATE '1980-12-31', 36) r
       LEFT JOIN canonical c ON c.game = r.game AND c.draw_date >= r.starts_on AND (r.ends_on IS NULL OR c.draw_date <= r.ends_on) GROUP BY 1, 2, 3, 4, 5""",
)
def regime_profile(spark, d):
    empty = spark.sql("SELECT 'X' AS game, 'R0' AS code, DATE'1980-01-01' AS starts_on, DATE'1980-12-31' AS ends_on, 36 AS pool, array(0) AS schedule")
    rules = rel.rules(spark).unionByName(empty)
    draws = intervals.attach_rule(reconcile.canonical_draws(staged(spark, d)), rules)
    return report.regime_profile(rules, draws)


@query(
    "D6_open_issues",
    "kind:s records:i",
    f"SELECT issue AS kind, count(*) AS records FROM staged_sightings WHERE issue IS NOT NULL AND {_h(1)} < '8' GROUP BY 1",
)
def open_issues(spark, d):
    issues = staged(spark, d).filter("issue is not null").withColumn("kind", F.col("issue"))
    return report.open_issues(issues.withColumn("resolved_at", F.when(digit(1) >= "8", F.current_timestamp())))


@query(
    "D7_dataset_inventory",
    "dataset:s records:i availability:s",
    """SELECT dataset, n AS records, CASE WHEN n > 0 THEN 'collected' ELSE 'not_collected_or_unavailable' END AS availability FROM (
       SELECT 'prize_breakdowns' AS dataset, count(*) AS n FROM prize_facts UNION ALL SELECT 'jackpot_context', count(*) FROM context_rows
       UNION ALL SELECT 'rules_and_prices', count(*) FROM rule_rows UNION ALL SELECT 'calendar_events', count(*) FROM calendar_events UNION ALL SELECT 'winning_ticket_reports', 0) x""",
)
def dataset_inventory(spark, d):
    return report.inventory(
        {
            "prize_breakdowns": rel.prize_facts(spark, d),
            "jackpot_context": rel.context_rows(spark, d),
            "rules_and_prices": rel.rules(spark),
            "calendar_events": calendar_events(spark, d),
            "winning_ticket_reports": rel.prize_facts(spark, d).limit(0),
        }
    )


@query(
    "D9_staging_counts",
    "game:s undated:i malformed_date:i staged_in_range:i quarantined_in_range:i",
    f"""WITH t AS (SELECT *, CASE {_h(4)} WHEN '0' THEN NULL WHEN '1' THEN replace(CAST(draw_date AS VARCHAR), '-', '/') ELSE CAST(draw_date AS VARCHAR) END AS dt FROM status_rows)
       ;; SELECT game, count(*) FILTER (WHERE dt IS NULL) AS undated, count(*) FILTER (WHERE dt LIKE '%/%') AS malformed_date,
       count(*) FILTER (WHERE status = 'staged' AND dt BETWEEN '1998-01-01' AND '1999-12-31') AS staged_in_range,
       count(*) FILTER (WHERE status = 'quarantined' AND dt BETWEEN '1998-01-01' AND '1999-12-31') AS quarantined_in_range FROM t GROUP BY 1""",
)
def staging_counts(spark, d):
    day = F.col("draw_date").cast("string")
    text = F.when(digit(4) == "0", None).when(digit(4) == "1", F.replace(day, F.lit("-"), F.lit("/"))).otherwise(day)
    return audit.staging_counts(status_rows(spark, d).withColumn("date_text", text), "1998-01-01", "1999-12-31")


@query(
    "D31_outcome_counts",
    "source:s outcome:s observations:i",
    """WITH folded AS (
         SELECT game, draw_date, q1 AS q, 'accepted' AS outcome FROM fold_4
         UNION ALL SELECT game, draw_date, q2, CASE WHEN c2 THEN 'quarantined' ELSE 'corroborated' END FROM fold_4 WHERE m2 IS NOT NULL
         UNION ALL SELECT game, draw_date, q3, CASE WHEN d3 THEN 'quarantined' ELSE 'corroborated' END FROM fold_4 WHERE m3 IS NOT NULL
         UNION ALL SELECT game, draw_date, q4, CASE WHEN d4 THEN 'quarantined' ELSE 'corroborated' END FROM fold_4 WHERE m4 IS NOT NULL)
       ;; SELECT s.source, coalesce(f.outcome, 'staged') AS outcome, count(*) AS observations
       FROM staged_sightings s LEFT JOIN folded f ON f.game = s.game AND f.draw_date = s.draw_date AND f.q = s.arrival_seq AND s.issue IS NULL GROUP BY 1, 2""",
)
def outcome_counts(spark, d):
    return reconcile.observation_outcomes(staged(spark, d)).groupBy("source", "outcome").agg(F.count("*").alias("observations"))


@query(
    "E13_first_arrival",
    "game:s draw_date:s accepted_seq:i",
    "SELECT game, draw_date, min(arrival_seq) AS accepted_seq FROM staged_sightings WHERE issue IS NULL GROUP BY 1, 2",
)
def first_arrival(spark, d):
    return reconcile.canonical_draws(staged(spark, d))
