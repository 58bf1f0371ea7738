"""Prospective tracking: issues before the deadline, scoring with revisions, ledgers and snapshots."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from drawloom.functions.scalars import deadline_instant
from drawloom.operators import lines, prospective, scoring
from drawloom.plans import relations as rel
from drawloom.plans.catalog.audit import _h, digit
from drawloom.plans.registry import query
from drawloom.plans.relations_sql import RELATIONS, uniform
from drawloom.session import cut_lineage, scratch
from drawloom.sources import sinks, snapshot
from drawloom.sources.ledger import Ledger

PROTOCOL = "protocol-1"
START = "1996-01-01"
BUDGETS = (1, 5)

# Requests: two arms per weekly target; some come late, some after the result, one arm starts before the protocol.
RELATIONS["issue_requests"] = f"""
SELECT game, draw_date, a.arm, CASE {_h(1)} WHEN '0' THEN CAST(draw_date AS TIMESTAMP) + INTERVAL 21 HOUR ELSE CAST(draw_date AS TIMESTAMP) + INTERVAL 10 HOUR END - CASE a.arm WHEN 'uniform-b' THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS recorded_at
FROM week_draws, (VALUES ('uniform-a'), ('uniform-b')) a(arm) WHERE NOT (a.arm = 'uniform-b' AND {_h(2)} = '1')
"""
RELATIONS["issue_status"] = f"""
SELECT game, draw_date, arm, CASE WHEN draw_date < DATE '{START}' THEN 'refused:before_start' WHEN {_h(3)} = '0' AND CASE {_h(1)} WHEN '0' THEN CAST(draw_date AS TIMESTAMP) + INTERVAL 1230 MINUTE ELSE CAST(draw_date AS TIMESTAMP) + INTERVAL 570 MINUTE END <= recorded_at THEN 'missed:result_available'
  WHEN recorded_at >= CAST(draw_date AS TIMESTAMP) + INTERVAL 20 HOUR THEN 'missed:deadline_passed' ELSE 'issued' END AS status FROM issue_requests
"""
_T = "concat(t.game, ':', CAST(t.draw_date AS VARCHAR))"
RELATIONS["issued_lines"] = f"""
SELECT game, draw_date, arm, budget, line_index, mains FROM (
  SELECT game, draw_date, arm, budget, mains, row_number() OVER (PARTITION BY game, draw_date, arm, budget ORDER BY first_attempt) - 1 AS line_index FROM (
    SELECT game, draw_date, arm, budget, mains, min(attempt) AS first_attempt FROM (
      SELECT game, draw_date, arm, budget, attempt, list_sort(list(number)) AS mains FROM (
        SELECT *, row_number() OVER (PARTITION BY game, draw_date, arm, budget, attempt ORDER BY u, number) AS place FROM (
          SELECT t.game, t.draw_date, t.arm, b.budget, a.attempt, n.number,
            {uniform("'" + PROTOCOL + "'", "t.arm", _T, "CAST(b.budget AS VARCHAR)", "CAST(a.attempt AS VARCHAR)", "CAST(n.number AS VARCHAR)")} AS u
          FROM (SELECT * FROM issue_status WHERE status = 'issued') t, (VALUES (1), (5)) b(budget), (SELECT range AS attempt FROM range(0, 9)) a,
            (SELECT CAST(range AS INT) AS number FROM range(1, 48)) n WHERE a.attempt < b.budget + 4) x) y WHERE place <= 6 GROUP BY 1, 2, 3, 4, 5) z GROUP BY 1, 2, 3, 4, 5) w) v
WHERE line_index < budget
"""
# Results: some draws have none yet, some are disputed, the evidence is a hash of the day.
RELATIONS["result_rows"] = f"""
SELECT game, draw_date, mains, CASE WHEN {_h(4)} IN ('0', '1') THEN 'quarantined' ELSE 'accepted' END AS status,
  CASE WHEN {_h(4)} NOT IN ('0', '1') THEN sha256(concat(game, '|', CAST(draw_date AS VARCHAR))) END AS evidence FROM week_draws WHERE {_h(4)} <> '2'
"""
# Earlier evaluations: revision 1 of a quarter of the lines, half of them on evidence that was corrected since.
RELATIONS["known_evaluations"] = f"""
SELECT l.game, l.draw_date, l.arm, l.budget, l.line_index, 1 AS revision, 0 AS matched,
  CASE WHEN {_h(5, 'l.')} < '4' THEN 'old' ELSE sha256(concat(l.game, '|', CAST(l.draw_date AS VARCHAR))) END AS evidence FROM issued_lines l WHERE {_h(5, 'l.')} < '8'
"""
RELATIONS["score_rows"] = """
SELECT l.*, r.evidence, CASE WHEN r.status IS NULL THEN 'pending' WHEN r.status <> 'accepted' THEN 'disputed' WHEN k.evidence = r.evidence THEN 'unchanged' WHEN k.revision IS NOT NULL THEN 'revised' ELSE 'scored' END AS action,
  coalesce(k.revision, 0) + 1 AS revision, len(list_intersect(l.mains, r.mains)) AS matched
FROM issued_lines l LEFT JOIN result_rows r ON r.game = l.game AND r.draw_date = l.draw_date
LEFT JOIN known_evaluations k ON k.game = l.game AND k.draw_date = l.draw_date AND k.arm = l.arm AND k.budget = l.budget AND k.line_index = l.line_index
"""
RELATIONS["latest_rows"] = """
SELECT game, draw_date, arm, budget, line_index, revision, matched FROM score_rows WHERE action IN ('scored', 'revised')
UNION ALL SELECT k.game, k.draw_date, k.arm, k.budget, k.line_index, k.revision, k.matched FROM known_evaluations k
  JOIN score_rows s ON s.game = k.game AND s.draw_date = k.draw_date AND s.arm = k.arm AND s.budget = k.budget AND s.line_index = k.line_index WHERE s.action NOT IN ('scored', 'revised')
"""


def asked_at():
    """The first arm asks in the morning, or after the deadline; the second an hour before it."""
    return F.col("draw_date").cast("timestamp") + F.when(digit(1) == "0", F.expr("interval 21 hours")).otherwise(F.expr("interval 10 hours"))


def requests(spark, d):
    arms = F.array_compact(F.array(F.lit("uniform-a"), F.when(digit(2) != "1", "uniform-b")))
    rows = rel.draws(spark, d).select("game", "draw_date", asked_at().alias("first"), F.explode(arms).alias("arm"))
    earlier = F.when(F.col("arm") == "uniform-b", F.expr("interval 1 hour")).otherwise(F.expr("interval 0 hours"))
    return rows.select("game", "draw_date", (F.col("first") - earlier).alias("recorded_at"), "arm")


def early_results(spark, d):
    """Some results come half an hour before the first arm asks, so the second has asked already."""
    return rel.draws(spark, d).filter(digit(3) == "0").select("game", "draw_date", (asked_at() - F.expr("interval 30 minutes")).alias("known_at"))


def deadlines(spark, d):
    at = deadline_instant(F.col("draw_date"), F.lit("20:00:00"), F.lit("UTC"), F.lit(None).cast("timestamp"))
    return rel.draws(spark, d).select("game", "draw_date", at.alias("deadline"), F.lit(START).cast("date").alias("start_date"), F.array(F.lit(0)).alias("schedule"))


def classified(spark, d):
    return prospective.classify_issues(requests(spark, d), early_results(spark, d), deadlines(spark, d))


def issued(spark, d):
    target = F.concat_ws(":", "game", F.col("draw_date").cast("string"))
    options = F.explode(F.array(*[lines.uniform_portfolio(F.lit(47), b, PROTOCOL, F.col("arm"), target) for b in BUDGETS])).alias("lines")
    picked = classified(spark, d).filter("status = 'issued'").select("game", "draw_date", "arm", options)
    return lines.explode_lines(picked)


def results(spark, d):
    four = digit(4)
    ok = ~four.isin("0", "1")
    evidence = F.when(ok, F.sha2(F.concat_ws("|", "game", F.col("draw_date").cast("string")), 256))
    return rel.draws(spark, d).filter(four != "2").select(
        "game", "draw_date", "mains", F.when(ok, "accepted").otherwise("quarantined").alias("status"), evidence.alias("evidence")
    )


def known_evaluations(spark, d):
    five = digit(5)
    fresh = F.sha2(F.concat_ws("|", "game", F.col("draw_date").cast("string")), 256)
    return issued(spark, d).filter(five < "8").select(
        *prospective.LINE, F.when(five < "4", "old").otherwise(fresh).alias("evidence"), F.lit(1).alias("revision"), F.lit(0).alias("matched")
    )


def score_rows(spark, d):
    return prospective.score_pass(issued(spark, d), results(spark, d), known_evaluations(spark, d))


@query("B18_issue_eligibility", "game:s draw_date:s arm:s status:s", "SELECT game, draw_date, arm, status FROM issue_status")
def issue_eligibility(spark, d):
    return classified(spark, d)


@query(
    "R20_issued_lines",
    "game:s draw_date:s arm:s budget:i line_index:i mains:a",
    f"SELECT game, draw_date, arm, budget, line_index, mains FROM issued_lines WHERE {_h(6)} <> '0'",
)
def issued_lines(spark, d):
    """Slots recorded before keep their issue; only new slots get lines."""
    before = requests(spark, d).filter(digit(6) == "0")
    return prospective.new_issues(issued(spark, d), before)


@query(
    "C18_score_actions",
    "game:s draw_date:s arm:s budget:i line_index:i action:s",
    "SELECT game, draw_date, arm, budget, line_index, action FROM score_rows",
)
def score_actions(spark, d):
    return score_rows(spark, d)


@query(
    "R21_scored_revisions",
    "game:s draw_date:s arm:s budget:i line_index:i evidence:s revision:i matched:i",
    "SELECT game, draw_date, arm, budget, line_index, evidence, revision, matched FROM score_rows WHERE action IN ('scored', 'revised')",
)
def scored_revisions(spark, d):
    return prospective.evaluation_rows(score_rows(spark, d))


def latest(spark, d):
    both = known_evaluations(spark, d).unionByName(prospective.evaluation_rows(score_rows(spark, d)))
    return prospective.latest_evaluations(both)


@query(
    "E9_latest_revision",
    "game:s draw_date:s arm:s budget:i line_index:i revision:i matched:i",
    "SELECT * FROM latest_rows",
)
def latest_revision(spark, d):
    return latest(spark, d)


@query(
    "D29_prospective_coverage",
    "game:s arm:s scheduled:i completed:i pending:i disputed:i missed:i failed:i unrecorded:i review_reached:i",
    f"""WITH spine AS (SELECT game, a.arm, draw_date FROM week_draws, (VALUES ('uniform-a'), ('uniform-b')) a(arm) WHERE draw_date >= DATE '{START}'),
       c AS (SELECT s.game, s.arm, CASE WHEN i.status IS NULL THEN 'unrecorded' WHEN i.status <> 'issued' THEN 'missed' WHEN r.status IS NULL THEN 'pending' WHEN r.status <> 'accepted' THEN 'disputed' ELSE 'completed' END AS st
         FROM spine s LEFT JOIN issue_status i ON i.game = s.game AND i.draw_date = s.draw_date AND i.arm = s.arm LEFT JOIN result_rows r ON r.game = s.game AND r.draw_date = s.draw_date)
       ;; SELECT game, arm, count(*) AS scheduled, """
    + ", ".join(f"count(*) FILTER (WHERE st = '{s}') AS {s}" for s in prospective.STATES)
    + ", CAST(count(*) FILTER (WHERE st = 'completed') >= 100 AS INT) AS review_reached FROM c GROUP BY 1, 2",
)
def coverage(spark, d):
    arms = F.explode(F.array(F.lit("uniform-a"), F.lit("uniform-b"))).alias("arm")
    spine = rel.draws(spark, d).filter(F.col("draw_date") >= START).select("game", "draw_date", arms)
    return prospective.coverage_summary(prospective.coverage(spine, classified(spark, d), results(spark, d)))


NEEDED = 150  # earlier draws that the frequency arm needs


@query(
    "D29_coverage_with_failures",
    "game:s arm:s scheduled:i completed:i pending:i disputed:i missed:i failed:i unrecorded:i review_reached:i",
    f"""WITH k AS (SELECT game, draw_date, row_number() OVER (PARTITION BY game ORDER BY draw_date) - 1 AS history FROM week_draws),
       c AS (SELECT s.game, a.arm, CASE WHEN {_h(1, 's.')} = '0' OR {_h(3, 's.')} = '0' THEN 'missed' WHEN a.arm = 'frequency' AND k.history < {NEEDED} THEN 'failed'
         WHEN r.status IS NULL THEN 'pending' WHEN r.status <> 'accepted' THEN 'disputed' ELSE 'completed' END AS st
         FROM week_draws s JOIN k ON k.game = s.game AND k.draw_date = s.draw_date CROSS JOIN (VALUES ('uniform-a'), ('frequency')) a(arm)
         LEFT JOIN result_rows r ON r.game = s.game AND r.draw_date = s.draw_date WHERE s.draw_date >= DATE '{START}')
       ;; SELECT game, arm, count(*) AS scheduled, """
    + ", ".join(f"count(*) FILTER (WHERE st = '{s}') AS {s}" for s in prospective.STATES)
    + ", CAST(count(*) FILTER (WHERE st = 'completed') >= 100 AS INT) AS review_reached FROM c GROUP BY 1, 2",
)
def coverage_with_failures(spark, d):
    """A uniform arm, and one that ranks numbers by their history and fails while there are too few draws."""
    order = Window.partitionBy("game").orderBy("draw_date")
    history = rel.draws(spark, d).select("game", "draw_date", asked_at().alias("recorded_at"), (F.row_number().over(order) - 1).alias("history"))
    asked = history.withColumn("arm", F.explode(F.array(F.lit("uniform-a"), F.lit("frequency"))))
    needed = F.when(F.col("arm") == "frequency", NEEDED).otherwise(0)
    failure = prospective.issue_failure(F.col("history"), needed, F.lit(47), F.lit(max(BUDGETS)))
    classified = prospective.classify_issues(asked, early_results(spark, d), deadlines(spark, d), failure)
    spine = asked.filter(F.col("draw_date") >= START).select("game", "draw_date", "arm")
    return prospective.coverage_summary(prospective.coverage(spine, classified, results(spark, d)))


@query(
    "D30_prospective_performance",
    "game:s arm:s budget:i completed_draws:i any_3_plus:i any_5_plus:i line_3_plus:i lines:i",
    """SELECT game, arm, budget, count(*) AS completed_draws, count(*) FILTER (WHERE best >= 3) AS any_3_plus, count(*) FILTER (WHERE best >= 5) AS any_5_plus, sum(hits) AS line_3_plus, sum(n) AS lines
       FROM (SELECT game, draw_date, arm, budget, count(*) AS n, max(matched) AS best, count(*) FILTER (WHERE matched >= 3) AS hits FROM latest_rows GROUP BY 1, 2, 3, 4) x WHERE n = budget GROUP BY 1, 2, 3""",
)
def performance(spark, d):
    return prospective.performance(latest(spark, d))


@query(
    "C14_lines_with_evaluations",
    "arm:s budget:i lines:i evaluated:i",
    """SELECT l.arm, l.budget, count(*) AS lines, count(k.revision) AS evaluated FROM issued_lines l LEFT JOIN known_evaluations k
       ON k.game = l.game AND k.draw_date = l.draw_date AND k.arm = l.arm AND k.budget = l.budget AND k.line_index = l.line_index GROUP BY 1, 2""",
)
def lines_with_evaluations(spark, d):
    known = known_evaluations(spark, d).select(*prospective.LINE, "revision")
    return issued(spark, d).join(known, prospective.LINE, "left").groupBy("arm", "budget").agg(F.count("*").alias("lines"), F.count("revision").alias("evaluated"))


# --- ledgers ---------------------------------------------------------------------------


@query(
    "A16_observation_log",
    "source:s appended:i rejected:i",
    """SELECT source, count(*) FILTER (WHERE source IN ('c', 'd')) AS appended, count(*) FILTER (WHERE source = 'b') AS rejected FROM sightings GROUP BY 1""",
)
def observation_log(spark, d):
    """A log of sources a and b receives a replay of a (no-op), a changed b (rejected), and c and d (appended)."""
    rows = rel.sightings(spark, d)
    log = Ledger(spark, scratch(spark, "log"), ["source", "game", "draw_date"], ["mains", "bonus"], F.year("draw_date"))
    log.append(rows.filter("source in ('a', 'b')"))
    changed = rows.withColumn("mains", F.when(F.col("source") == "b", F.reverse("mains")).otherwise(F.col("mains")))
    rejects = log.append(changed)
    logged = log.rows(rows).groupBy("source").agg(F.count("*").alias("logged"))
    refused = rejects.groupBy("source").agg(F.count("*").alias("rejected"))
    joined = logged.join(refused, "source", "left").na.fill(0)
    return joined.withColumn("appended", F.when(F.col("source").isin("c", "d"), F.col("logged")).otherwise(0))


@query(
    "A18_upsert_calendar",
    "game:s version:i days:i",
    f"SELECT game, CASE WHEN {_h(1)} < '8' THEN 2 ELSE 1 END AS version, count(*) AS days FROM week_draws GROUP BY 1, 2",
)
def upsert_calendar(spark, d):
    base = rel.draws(spark, d).select("game", "draw_date", F.lit(1).alias("version"), F.size("mains").alias("n"))
    newer = base.filter(digit(1) < "8").withColumn("version", F.lit(2))
    return sinks.upsert(base, newer, ["game", "draw_date"], "version").groupBy("game", "version").agg(F.count("*").alias("days"))


@query(
    "A19_retrieval_events",
    "event_type:s rows:i",
    "SELECT event_type, count(*) AS rows FROM (SELECT DISTINCT event_type, user_id, date_trunc('hour', ts) FROM events WHERE user_id % 2 = 1) x GROUP BY 1",
)
def retrieval_events(spark, d):
    """Unique per artifact, run and time; the even users are in the log already."""
    rows = rel.table(spark, d, "events").select("event_type", "user_id", F.date_trunc("hour", "ts").alias("at"))
    fresh = sinks.insert_or_keep(rows.filter("user_id % 2 = 0"), rows, ["event_type", "user_id", "at"])
    return fresh.groupBy("event_type").agg(F.count("*").alias("rows"))


@query(
    "A21_whole_portfolios",
    "arm:s budget:i lines:i",
    f"SELECT arm, budget, count(*) AS lines FROM issued_lines WHERE {_h(1)} >= '4' OR budget = 1 GROUP BY 1, 2",
)
def whole_portfolios(spark, d):
    """Portfolios that lost a line are refused whole."""
    torn = issued(spark, d).filter((digit(1) >= "4") | (F.col("line_index") != 2))
    kept = sinks.whole_portfolios(torn, ["game", "draw_date", "arm"])
    return kept.groupBy("arm", "budget").agg(F.count("*").alias("lines"))


@query(
    "A22_evaluation_ledger",
    "accepted:i rejected:i",
    f"SELECT count(*) FILTER (WHERE {_h(1)} <> '3') AS accepted, count(*) FILTER (WHERE {_h(1)} = '3') AS rejected FROM issued_lines",
)
def evaluation_ledger(spark, d):
    rows = issued(spark, d)
    claimed = rows.withColumn("mains", F.when(digit(1) == "3", F.slice("mains", 1, 5)).otherwise(F.col("mains")))
    fine, refused = sinks.match_evaluations(claimed, rows, prospective.LINE)
    both = fine.withColumn("ok", F.lit(True)).unionByName(refused.withColumn("ok", F.lit(False)))
    return both.agg(F.count_if("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("rejected"))


_FIRST = f"({_h(1)} >= '4' OR budget = 1)"


@query(
    "A21_portfolio_ledger",
    "arm:s budget:i first:i later:i refused:i",
    f"""SELECT arm, budget, count(*) FILTER (WHERE {_FIRST}) AS first, count(*) FILTER (WHERE NOT {_FIRST}) AS later,
       count(*) FILTER (WHERE {_FIRST} AND {_h(2)} = '7') AS refused FROM issued_lines GROUP BY 1, 2""",
)
def portfolio_ledger(spark, d):
    """Torn portfolios stay out of the first append and come whole with the second, where stored lines are no-ops and
    stored lines with other numbers are refused."""
    lines = cut_lineage(issued(spark, d))
    ledger = Ledger(spark, scratch(spark, "portfolios"), prospective.LINE, ["mains"], F.year("draw_date"))
    book = ["game", "draw_date", "arm"]
    ledger.append(sinks.whole_portfolios(lines.filter((digit(1) >= "4") | (F.col("line_index") != 2)), book))
    first = ledger.rows(lines).select(*prospective.LINE, F.lit(1).alias("first"))
    stored = (digit(1) >= "4") | (F.col("budget") == 1)
    other = F.when(stored & (digit(2) == "7"), F.reverse("mains")).otherwise(F.col("mains"))
    refused = ledger.append(sinks.whole_portfolios(lines.withColumn("mains", other), book)).select(*prospective.LINE, F.lit(1).alias("refused"))
    rows = ledger.rows(lines).join(first, prospective.LINE, "left").join(refused, prospective.LINE, "left")
    return rows.groupBy("arm", "budget").agg(
        F.count("first").alias("first"), F.count_if(F.col("first").isNull()).alias("later"), F.count("refused").alias("refused")
    )


@query(
    "A22_evaluation_inserts",
    "arm:s revision:i stored:i kept:i refused:i",
    f"""SELECT arm, CASE WHEN {_h(2)} < '8' THEN 1 ELSE 2 END AS revision, count(*) FILTER (WHERE {_h(1)} <> '3') AS stored,
       count(*) FILTER (WHERE {_h(1)} <> '3' AND {_h(2)} < '8') AS kept, count(*) FILTER (WHERE {_h(1)} = '3') AS refused FROM issued_lines GROUP BY 1, 2""",
)
def evaluation_inserts(spark, d):
    """Evaluations go into the ledger once: the first revision stays when a second comes, and an evaluation of numbers
    that were not issued is refused."""
    lines = cut_lineage(issued(spark, d))
    claimed = lines.withColumn("mains", F.when(digit(1) == "3", F.slice("mains", 1, 5)).otherwise(F.col("mains")))
    fine, refused = sinks.match_evaluations(claimed, lines, prospective.LINE)
    ledger = Ledger(spark, scratch(spark, "evaluations"), prospective.LINE, ["mains", "revision"], F.year("draw_date"))
    ledger.insert_once(fine.filter(digit(2) < "8").withColumn("revision", F.lit(1)), F.col("revision"))
    again = ledger.insert_once(fine.withColumn("revision", F.lit(2)), F.col("revision"))
    kept = again.select(*prospective.LINE, (~F.col("inserted")).alias("kept"))
    stored = ledger.rows(fine.withColumn("revision", F.lit(2))).join(kept, prospective.LINE, "left")
    revision = F.when(digit(2) < "8", 1).otherwise(2)
    both = stored.select("arm", "revision", "kept", F.lit(False).alias("no")).unionByName(
        refused.select("arm", revision.alias("revision"), F.lit(None).cast("boolean").alias("kept"), F.lit(True).alias("no"))
    )
    return both.groupBy("arm", "revision").agg(
        F.count_if(~F.col("no")).alias("stored"), F.count_if("kept").alias("kept"), F.count_if("no").alias("refused")
    )


# --- snapshots --------------------------------------------------------------------------

_SUMS = ", ".join(
    f"CAST(sum(CAST('0x' || substr(h, {at}, {n}) AS HUGEINT)) AS VARCHAR)" for at, n in ((1, 13), (14, 13), (27, 13), (40, 13), (53, 12))
)


@query(
    "A17_fingerprint",
    "game:s rows:i digest:s",
    f"""SELECT game, count(*) AS rows, sha256(concat_ws('|', CAST(count(*) AS VARCHAR), {_SUMS})) AS digest
       FROM (SELECT game, sha256('{{"bonus":' || CAST(bonus AS VARCHAR) || ',"draw_date":"' || CAST(draw_date AS VARCHAR) || '","game":"' || game || '","mains":[' || array_to_string(mains, ',') || ']}}') AS h FROM day_draws) x GROUP BY 1""",
)
def fingerprint(spark, d):
    return sinks.fingerprint(rel.draws(spark, d, "day"), keys=["game"], columns=["bonus", "draw_date", "game", "mains"])


def snapshot_tables(spark, d):
    """The daily population, its missing days, its enrichment, and the rules, observations and evidence it rests on."""
    from drawloom.operators import intervals

    draws = rel.draws(spark, d, "day")
    cal = intervals.mark_observed(intervals.calendar(rel.date_ranges(draws), rel.rules(spark, range(7))), draws)
    prizes = rel.prize_facts(spark, d).select(F.lit("prize").alias("kind"), "game", "draw_date", "tier", "winners", "amount")
    context = rel.context_rows(spark, d).select(
        F.lit("context").alias("kind"), "game", "draw_date", F.lit("jackpot").alias("tier"), F.lit(None).cast("int").alias("winners"), F.col("jackpot").alias("amount")
    )
    page = F.sha2(F.concat_ws("|", "game", F.year("draw_date").cast("string")), 256)
    rules = rel.rules(spark, range(7)).select(
        "game", "code", "starts_on", "ends_on", "pool", F.lit(True).alias("verified"), F.sha2(F.concat_ws("|", F.lit("rule"), "game", "code"), 256).alias("artifact_sha256")
    )
    lineage = draws.select(day_key().alias("observation_key"), "draw_date", "mains", page.alias("artifact_sha256"))
    return {
        "draws": rel.population(spark, d, "day").drop("gap_before").withColumn("observation_key", day_key()),
        "missing_days": cal.filter("scheduled and not observed").select("game", "day"),
        "enrichment": prizes.unionByName(context),
        "rules": rules,
        "lineage": lineage,
        "evidence": lineage.select("artifact_sha256").unionByName(rules.select("artifact_sha256")).distinct(),
    }


def day_key():
    return F.sha2(F.concat_ws("|", "game", F.col("draw_date").cast("string")), 256)


def published(spark, d):
    root = scratch(spark, "snapshots")
    tables = snapshot_tables(spark, d)
    return root, sinks.write_snapshot(spark, root, tables), tables


@query(
    "A11_snapshot_population",
    "game:s rule_code:s draw_date:s gap_before:i",
    "SELECT game, rule_code, draw_date, CAST(gap_before AS INT) AS gap_before FROM day_pop WHERE rule_code = 'R2'",
)
def snapshot_population(spark, d):
    root, digest, _ = published(spark, d)
    return snapshot.load_population(spark, root, digest, "R2")


@query(
    "A12_snapshot_context",
    "game:s draw_date:s jackpot:f match6:i match3:i tiers:i",
    """SELECT c.game, c.draw_date, c.jackpot, p.m6 AS match6, p.m3 AS match3, p.n AS tiers FROM context_rows c JOIN (SELECT game, draw_date, max(CASE WHEN tier = 'Match 6' THEN winners END) AS m6,
       max(CASE WHEN tier = 'Match 3' THEN winners END) AS m3, count(*) AS n FROM prize_facts GROUP BY 1, 2) p USING (game, draw_date)""",
)
def snapshot_context(spark, d):
    root, digest, _ = published(spark, d)
    rows = snapshot.load_context(spark, root, digest)
    tiers = F.col("prizes")
    return rows.select(
        "game", "draw_date", "jackpot", tiers["Match 6"]["winners"].alias("match6"), tiers["Match 3"]["winners"].alias("match3"), F.size("prizes").alias("tiers")
    )


RELATIONS["day_missing"] = """
SELECT s.game, s.day FROM (SELECT game, CAST(unnest(generate_series(min(draw_date), max(draw_date), INTERVAL 1 DAY)) AS DATE) AS day FROM day_draws GROUP BY game) s
JOIN rule_rows r ON r.game = s.game AND s.day >= r.starts_on AND (r.ends_on IS NULL OR s.day <= r.ends_on)
WHERE NOT EXISTS (SELECT 1 FROM day_draws w WHERE w.game = s.game AND w.draw_date = s.day)
"""


@query(
    "C15_snapshot_verification",
    "part:s rows:i faults:i",
    """SELECT 'draws' AS part, count(*) AS rows, 0 AS faults FROM day_pop UNION ALL SELECT 'enrichment', (SELECT count(*) FROM prize_facts) + (SELECT count(*) FROM context_rows), 0
       UNION ALL SELECT 'missing_days', count(*), 0 FROM day_missing UNION ALL SELECT 'rules', count(*), 0 FROM rule_rows UNION ALL SELECT 'lineage', count(*), 0 FROM day_draws
       UNION ALL SELECT 'evidence', (SELECT count(*) FROM (SELECT DISTINCT game, year(draw_date) FROM day_draws) x) + (SELECT count(*) FROM rule_rows), 0""",
)
def snapshot_verification(spark, d):
    root, digest, _ = published(spark, d)
    found = snapshot.violations(spark, root, digest).groupBy("part").agg(F.count("*").alias("faults"))
    listed = spark.read.parquet(f"{root}/{digest}/manifest").select(F.col("table").alias("part"), "rows")
    return listed.join(found, "part", "full").withColumn("faults", F.coalesce("faults", F.lit(0))).filter("part <> 'files' or faults > 0")


@query(
    "C15_snapshot_faults",
    "item:s reason:s",
    f"""WITH p AS (SELECT *, {_h(1)} AS a, game || ':' || CAST(draw_date AS VARCHAR) AS item FROM day_pop),
       t AS (SELECT game, min(year(draw_date)) AS y FROM day_draws GROUP BY 1)
       ;; SELECT item, 'no_covering_rule' AS reason FROM p WHERE a IN ('0', '1') UNION ALL SELECT item, 'unverified_rule' FROM p WHERE a = '0' OR (a <> '1' AND game = 'O' AND rule_code = 'R2') OR (a = '1' AND game = 'O' AND rule_code = 'R1')
       UNION ALL SELECT item, 'invalid_numbers' FROM p WHERE a = '2' UNION ALL SELECT item, 'observation_differs' FROM p WHERE a IN ('2', '4')
       UNION ALL SELECT item, 'no_observation' FROM p WHERE a = '3' UNION ALL SELECT item, 'repeated_date' FROM p, (VALUES (1), (2)) two(i) WHERE a = '5'
       UNION ALL SELECT item, 'unverified_rule' FROM p WHERE a = '5' AND game = 'O' AND rule_code = 'R2'
       UNION ALL SELECT item, 'no_evidence' FROM p JOIN t USING (game), (VALUES (1), (2)) two(i) WHERE year(draw_date) = y AND a <> '3' AND (a = '5' OR i = 1)""",
)
def snapshot_faults(spark, d):
    """A snapshot whose tables carry faults: draws of unknown or other rules, changed numbers, lost or changed
    observations, repeated dates, a rule without evidence, and the first year's page of each game not kept."""
    tables = dict(snapshot_tables(spark, d))
    h, m = digit(1), F.col("mains")
    other = F.when(F.col("rule_code") == "R1", "R2").otherwise("R1")
    draws = tables["draws"].withColumn("rule_code", F.when(h == "0", "R9").when(h == "1", other).otherwise(F.col("rule_code")))
    draws = draws.withColumn("mains", F.when(h == "2", F.concat(F.slice(m, 1, 5), F.array(m[0]))).otherwise(m))
    tables["draws"] = draws.unionByName(draws.filter(h == "5"))
    keyed = rel.draws(spark, d, "day").select(day_key().alias("observation_key"), h.alias("h"))
    seen = tables["lineage"].join(keyed, "observation_key")
    tables["lineage"] = seen.filter("h <> '3'").withColumn("draw_date", F.when(F.col("h") == "4", F.date_add("draw_date", 1)).otherwise(F.col("draw_date"))).drop("h")
    first = rel.draws(spark, d, "day").groupBy("game").agg(F.sha2(F.concat_ws("|", "game", F.min(F.year("draw_date")).cast("string")), 256).alias("artifact_sha256"))
    lost = first.select("artifact_sha256").unionByName(tables["rules"].filter("game = 'O' and code = 'R2'").select("artifact_sha256"))
    tables["evidence"] = tables["evidence"].join(lost, "artifact_sha256", "left_anti")
    root = scratch(spark, "faulty")
    return snapshot.violations(spark, root, sinks.write_snapshot(spark, root, tables))


@query(
    "A26_draw_layout",
    "game:s draw_date:s rule_code:s main_1:i main_6:i bonus:i observation_key:s",
    """SELECT game, draw_date, rule_code, mains[1] AS main_1, mains[6] AS main_6, bonus, sha256(concat(game, '|', CAST(draw_date AS VARCHAR))) AS observation_key FROM day_pop""",
)
def draw_layout(spark, d):
    key = F.sha2(F.concat_ws("|", "game", F.col("draw_date").cast("string")), 256)
    return sinks.draw_layout(rel.population(spark, d, "day").withColumn("observation_key", key))


@query(
    "R24_independent_recount",
    "source:s method:s difference:s",
    "SELECT source, method, 'differs' AS difference FROM study_lines WHERE FALSE",
)
def independent_recount(spark, d):
    """The match summary against a second path that explodes numbers and counts equi-join hits; must be empty."""
    from drawloom.plans.catalog.scoring import matched

    rows = matched(spark, d).persist()
    reported = scoring.match_summary(rows, ["source", "method"]).select("source", "method", "lines", "line_3_plus", "any_3_plus")
    key = ["game", "draw_date", "source", "method", "line_index"]
    picks = rows.select(*key, F.explode("mains").alias("number"))
    drawn = rel.draw_numbers(spark, d).filter("role = 'main'").select("game", "draw_date", "number")
    counts = picks.join(drawn, ["game", "draw_date", "number"], "left_semi").groupBy(*key).agg(F.count("*").alias("m"))
    full = rows.select(*key).join(counts, key, "left").na.fill(0)
    per_date = full.groupBy("game", "draw_date", "source", "method").agg(F.count("*").alias("n"), F.count_if(F.col("m") >= 3).alias("h"))
    recomputed = per_date.groupBy("source", "method").agg(
        F.sum("n").alias("lines"), F.sum("h").alias("line_3_plus"), F.count_if(F.col("h") > 0).alias("any_3_plus")
    )
    return scoring.reconcile_metrics(recomputed, reported, ["source", "method"], ["lines", "line_3_plus", "any_3_plus"])


@query(
    "C16_metric_reconciliation",
    "source:s difference:s",
    """SELECT source, CASE source WHEN 'recent' THEN 'not_reported' ELSE 'differs' END AS difference FROM (VALUES ('recent'), ('uniform')) x(source) WHERE EXISTS (SELECT 1 FROM week_features)""",
)
def metric_reconciliation(spark, d):
    """Score table against a report that lacks one source and misstates another."""
    from drawloom.plans.catalog.scoring import probabilities

    table = scoring.probability_scores(probabilities(spark, d), ["source"]).withColumn("brier", F.round("brier", 9))
    told = table.filter("source <> 'recent'").withColumn("targets", F.when(F.col("source") == "uniform", 0).otherwise(F.col("targets")))
    return scoring.reconcile_metrics(table, told, ["source"], ["targets", "brier"])
