"""Streaming jobs driven over files that Spark writes from the given tables, in two arrivals each."""

from pyspark.sql import functions as F

from drawloom.operators import prospective
from drawloom.plans import relations as rel
from drawloom.plans.catalog import prospective as cat
from drawloom.plans.catalog.audit import _h, digit
from drawloom.plans.catalog.canonical import replayed_log, solved_draws, staged
from drawloom.plans.registry import query
from drawloom.session import cut_lineage, scratch
from drawloom.streaming import jobs


@query("I1_stream_ingest", "source:s logged:i", "SELECT source, count(*) AS logged FROM sightings GROUP BY 1")
def stream_ingest(spark, d):
    """Sources a and b arrive, then everything again: the replay adds only c and d."""
    root = scratch(spark, "ingest")
    rows = rel.sightings(spark, d)
    keys, payload = ["source", "game", "draw_date"], ["mains", "bonus"]
    for part in (rows.filter("source in ('a', 'b')"), rows):
        part.write.mode("append").parquet(root + "/in")
        jobs.ingest(jobs.file_stream(spark, root + "/in", rows.schema), root + "/log", root + "/checkpoint", keys, payload)
    return spark.read.parquet(root + "/log").groupBy("source").agg(F.count("*").alias("logged"))


@query(
    "I2_stream_reconciliation",
    "game:s draw_date:s arrival_seq:i outcome:s",
    """SELECT game, draw_date, q1 AS arrival_seq, 'accepted' AS outcome FROM fold_4
       UNION ALL SELECT game, draw_date, q2, CASE WHEN c2 THEN 'quarantined' ELSE 'corroborated' END FROM fold_4 WHERE m2 IS NOT NULL
       UNION ALL SELECT game, draw_date, q3, CASE WHEN d3 THEN 'quarantined' ELSE 'corroborated' END FROM fold_4 WHERE m3 IS NOT NULL
       UNION ALL SELECT game, draw_date, q4, CASE WHEN d4 THEN 'quarantined' ELSE 'corroborated' END FROM fold_4 WHERE m4 IS NOT NULL""",
)
def stream_reconciliation(spark, d):
    """Arrivals one and two in a first run, three and four in a second one that resumes from the state store."""
    root = scratch(spark, "reconcile")
    valid = cut_lineage(staged(spark, d).filter("issue is null").select("game", "draw_date", "arrival_seq", "mains", "bonus"))
    width = jobs.state_width(spark, valid.select("game", "draw_date").distinct().count())
    for part in ("arrival_seq <= 2", "arrival_seq > 2"):
        valid.filter(part).write.mode("append").parquet(root + "/in")
        outcomes = jobs.reconcile(jobs.file_stream(spark, root + "/in", valid.schema))
        jobs.run_append(outcomes, root + "/checkpoint", root + "/out", width)
    return spark.read.parquet(root + "/out")


@query(
    "I2_stream_resolutions",
    "game:s draw_date:s arrival_seq:i outcome:s",
    f"""WITH {solved_draws()},
       x AS (SELECT *, {", ".join(f"(m{n} IS NOT NULL AND (m{n} <> wm OR coalesce(b{n} <> wb, FALSE))) AS e{n}" for n in range(1, 5))} FROM solved),
       said AS (SELECT game, draw_date, q1 AS arrival_seq, 'accepted' AS outcome FROM fold_4
         UNION ALL SELECT game, draw_date, q2, CASE WHEN c2 THEN 'quarantined' ELSE 'corroborated' END FROM fold_4 WHERE m2 IS NOT NULL
         UNION ALL SELECT game, draw_date, q3, CASE WHEN d3 THEN 'quarantined' ELSE 'corroborated' END FROM fold_4 WHERE m3 IS NOT NULL
         UNION ALL SELECT game, draw_date, q4, CASE WHEN d4 THEN 'quarantined' ELSE 'corroborated' END FROM fold_4 WHERE m4 IS NOT NULL),
       over AS (SELECT game, draw_date, q1 AS arrival_seq FROM x WHERE e1 UNION ALL SELECT game, draw_date, q2 FROM x WHERE c2 AND e2
         UNION ALL SELECT game, draw_date, q3 FROM x WHERE c3 AND e3 UNION ALL SELECT game, draw_date, q4 FROM x WHERE c4 AND e4)
       ;; SELECT s.game, s.draw_date, s.arrival_seq, CASE WHEN o.arrival_seq IS NULL THEN s.outcome ELSE 'superseded' END AS outcome
       FROM said s LEFT JOIN over o USING (game, draw_date, arrival_seq)
       UNION ALL SELECT game, draw_date, 10, 'resolved' FROM x
       {" ".join(f"UNION ALL SELECT game, draw_date, q{n} + 10, CASE WHEN {' OR '.join(f'e{k}' for k in range(1, n + 1))} THEN 'quarantined' ELSE 'corroborated' END FROM x WHERE m{n} IS NOT NULL" for n in range(1, 5))}""",
)
def stream_resolutions(spark, d):
    """Observations, resolutions and what is published after them in one stream over three runs; the last outcomes."""
    root = scratch(spark, "resolve")
    log, fixes = replayed_log(spark, d)
    columns = ["game", "draw_date", "arrival_seq", "mains", "bonus"]
    seen = log.filter("issue is null").select(*columns, F.lit(False).alias("resolves"))
    events = seen.unionByName(fixes.withColumnRenamed("resolution_seq", "arrival_seq").select(*columns, F.lit(True).alias("resolves")))
    events = cut_lineage(events)
    width = jobs.state_width(spark, events.select("game", "draw_date").distinct().count())
    for part in ("arrival_seq <= 2", "arrival_seq > 2 and arrival_seq <= 11", "arrival_seq > 11"):
        events.filter(part).write.mode("append").parquet(root + "/in")
        outcomes = jobs.reconcile(jobs.file_stream(spark, root + "/in", events.schema))
        jobs.run_append(outcomes, root + "/checkpoint", root + "/out", width)
    latest = F.max_by("outcome", "revision").alias("outcome")
    return spark.read.parquet(root + "/out").groupBy("game", "draw_date", "arrival_seq").agg(latest)


@query("I3_stream_issue_status", "game:s draw_date:s arm:s status:s", "SELECT game, draw_date, arm, status FROM issue_status")
def stream_issue_status(spark, d):
    root = scratch(spark, "issues")
    rows = cat.requests(spark, d)
    rows.write.parquet(root + "/in")
    marked = jobs.classify(jobs.file_stream(spark, root + "/in", rows.schema), cat.early_results(spark, d), cat.deadlines(spark, d))
    jobs.run_append(marked.select("game", "draw_date", "arm", "status"), root + "/checkpoint", root + "/out")
    return spark.read.parquet(root + "/out")


@query(
    "I4_stream_scoring",
    "game:s draw_date:s arm:s budget:i line_index:i revision:i matched:i",
    f"""WITH fixed AS (SELECT r.*, 1 AS v FROM result_rows r WHERE r.status = 'accepted'
         UNION ALL SELECT r.game, r.draw_date, list_sort(list_append(w.mains[2:6], w.bonus)), r.status, 'corrected', 2 FROM result_rows r JOIN week_draws w USING (game, draw_date) WHERE r.status = 'accepted' AND {_h(6, 'r.')} = '1')
       ;; SELECT l.game, l.draw_date, l.arm, l.budget, l.line_index, f.v AS revision, len(list_intersect(l.mains, f.mains)) AS matched
       FROM issued_lines l JOIN fixed f ON f.game = l.game AND f.draw_date = l.draw_date""",
)
def stream_scoring(spark, d):
    """Lines and first results arrive together; the second arrival brings corrections, which append revision two."""
    root = scratch(spark, "scoring")
    lines = cat.issued(spark, d).withColumn("issued_at", F.col("draw_date").cast("timestamp"))
    at = F.col("draw_date").cast("timestamp")
    results = cat.results(spark, d).withColumn("result_at", at + F.expr("interval 1 day"))
    shifted = F.array_sort(F.concat(F.slice("mains", 2, 5), F.array("bonus")))
    fixed = rel.draws(spark, d).filter((digit(6) == "1") & ~digit(4).isin("0", "1", "2"))
    corrected = fixed.select(
        "game", "draw_date", shifted.alias("mains"), F.lit("accepted").alias("status"), F.lit("corrected").alias("evidence"), (at + F.expr("interval 400 days")).alias("result_at")
    )
    lines.write.parquet(root + "/lines")
    for part in (results, corrected):
        part.write.mode("append").parquet(root + "/results")
        jobs.score(
            jobs.file_stream(spark, root + "/lines", lines.schema), jobs.file_stream(spark, root + "/results", results.schema), root + "/ledger", root + "/checkpoint"
        )
    return spark.read.parquet(root + "/ledger")


@query(
    "I5_late_corrections",
    "game:s corrected_lines:i",
    f"""SELECT l.game, count(*) AS corrected_lines FROM issued_lines l JOIN result_rows r ON r.game = l.game AND r.draw_date = l.draw_date
       WHERE r.status = 'accepted' AND {_h(6, 'r.')} = '1' GROUP BY 1""",
)
def late_corrections(spark, d):
    """The newest evaluation of each line is the late correction, and nothing was overwritten."""
    ledger = stream_scoring(spark, d)
    now = prospective.latest_evaluations(ledger)
    return now.filter("evidence = 'corrected' and revision = 2").groupBy("game").agg(F.count("*").alias("corrected_lines"))


@query(
    "I6_weekly_coverage",
    "window_start:s scheduled:i completed:i failed:i",
    """WITH w AS (SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS b, event_type FROM events)
       ;; SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) FILTER (WHERE event_type = 'signup') AS scheduled, count(*) FILTER (WHERE event_type = 'purchase') AS completed,
       count(*) FILTER (WHERE event_type = 'error') AS failed FROM w WHERE b + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events) GROUP BY b""",
)
def weekly_coverage(spark, d):
    root = scratch(spark, "coverage")
    rows = rel.table(spark, d, "events").select("ts", "event_type")
    rows.write.parquet(root + "/in")
    jobs.run_append(jobs.weekly_coverage(jobs.file_stream(spark, root + "/in", rows.schema)), root + "/checkpoint", root + "/out")
    return spark.read.parquet(root + "/out").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
