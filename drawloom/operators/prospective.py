"""Issue before the deadline, score as results come, keep every revision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawloom.functions.scalars import choose, overlap

SLOT = ["game", "draw_date", "arm"]
LINE = ["game", "draw_date", "arm", "budget", "line_index"]


def issue_failure(history: Column, needed: Column, pool: Column, budget: Column) -> Column:
    """Why lines cannot be made for a request, or null: too few earlier draws, or more lines than the pool allows."""
    return F.when(F.coalesce(history, F.lit(0)) < needed, "short_history").when(choose(pool, 6) < budget, "portfolio_too_large")


def classify_issues(requests: DataFrame, results: DataFrame, deadlines: DataFrame, failure: Column | None = None) -> DataFrame:
    """Status of issue requests (game, draw_date, arm, recorded_at).

    A request outside the start date or schedule is refused. A result known by the time of the request
    (``results`` has game, draw_date, known_at) is checked first, then the deadline, then whether lines can be made
    (``failure``, a reason or null): a request that comes in time but gets no lines is ``failed:<reason>``.
    """
    known = results.groupBy("game", "draw_date").agg(F.min("known_at").alias("_known_at"))
    joined = requests.join(deadlines, ["game", "draw_date"], "left").join(known, ["game", "draw_date"], "left")
    on_schedule = F.array_contains("schedule", F.weekday("draw_date"))
    refused = F.when(F.col("draw_date") < F.col("start_date"), "refused:before_start").when(
        ~F.coalesce(on_schedule, F.lit(False)), "refused:not_scheduled"
    )
    state = (
        F.when(F.col("_known_at") <= F.col("recorded_at"), "missed:result_available")
        .when(F.col("recorded_at") >= F.col("deadline"), "missed:deadline_passed")
        .when(failure.isNotNull() if failure is not None else F.lit(False), F.concat(F.lit("failed:"), failure if failure is not None else F.lit("")))
        .otherwise("issued")
    )
    return joined.withColumn("status", F.coalesce(refused, state)).drop("_known_at")


def new_issues(classified: DataFrame, existing: DataFrame) -> DataFrame:
    """Only slots not recorded before; an existing issue is kept as it is."""
    return classified.join(existing.select(*SLOT).distinct(), SLOT, "left_anti")


def score_pass(lines: DataFrame, results: DataFrame, evaluations: DataFrame) -> DataFrame:
    """One scoring pass: ``action`` is pending, disputed, unchanged, scored or revised, with the next revision.

    ``results`` has one canonical row per draw (status, evidence, mains). Known evaluations are reduced per line
    by partial aggregates, so a line with very many revisions stays cheap.
    """
    known = evaluations.groupBy(*LINE).agg(F.max("revision").alias("_revision"))
    same = evaluations.select(*LINE, F.col("evidence").alias("_evidence")).distinct().withColumn("_same", F.lit(True))
    outcome = results.select("game", "draw_date", F.col("status").alias("_status"), "evidence", F.col("mains").alias("outcome"))
    joined = lines.join(outcome, ["game", "draw_date"], "left").join(known, LINE, "left")
    on = [F.col(f"j.{c}") == F.col(f"k.{c}") for c in LINE]
    checked = joined.alias("j").join(same.alias("k"), [*on, F.col("j.evidence") == F.col("k._evidence")], "left")
    settled = (F.col("_status") == "accepted") & F.col("evidence").isNotNull()
    action = (
        F.when(F.col("_status").isNull(), "pending")
        .when(~settled, "disputed")
        .when(F.col("_same").isNotNull(), "unchanged")
        .when(F.col("_revision").isNotNull(), "revised")
        .otherwise("scored")
    )
    return checked.select(
        "j.*",
        action.alias("action"),
        (F.coalesce("_revision", F.lit(0)) + 1).alias("revision"),
        overlap(F.col("mains"), F.col("outcome")).alias("matched"),
    )


def evaluation_rows(scored: DataFrame) -> DataFrame:
    """Rows to append to the evaluation ledger."""
    return scored.filter(F.col("action").isin("scored", "revised")).select(*LINE, "evidence", "revision", "matched")


def latest_evaluations(evaluations: DataFrame) -> DataFrame:
    """The newest revision of each line, by ``max_by`` (combines map-side; no per-line sort)."""
    row = F.struct("evidence", "revision", "matched")
    return evaluations.groupBy(*LINE).agg(F.max_by(row, "revision").alias("r")).select(*LINE, "r.*")


def coverage(spine: DataFrame, issues: DataFrame, results: DataFrame) -> DataFrame:
    """Status of every scheduled date of every arm: (game, draw_date, arm) spine against issues and results."""
    outcome = results.select("game", "draw_date", F.col("status").alias("_status"), F.col("evidence").alias("_evidence"))
    joined = spine.join(issues.select(*SLOT, F.col("status").alias("_issue")), SLOT, "left").join(
        outcome, ["game", "draw_date"], "left"
    )
    settled = (F.col("_status") == "accepted") & F.col("_evidence").isNotNull()
    state = (
        F.when(F.col("_issue").isNull(), "unrecorded")
        .when(F.col("_issue") != "issued", F.split("_issue", ":")[0])
        .when(F.col("_status").isNull(), "pending")
        .when(~settled, "disputed")
        .otherwise("completed")
    )
    return joined.select(*SLOT, state.alias("coverage"))


STATES = ("completed", "pending", "disputed", "missed", "failed", "unrecorded")


def coverage_summary(covered: DataFrame, review_window: int = 100) -> DataFrame:
    state = F.col("coverage")
    counts = [F.count_if(state == s).alias(s) for s in STATES]
    out = covered.groupBy("game", "arm").agg(F.count("*").alias("scheduled"), *counts)
    return out.withColumn("review_reached", F.col("completed") >= review_window)


def performance(latest: DataFrame) -> DataFrame:
    """Hits of whole portfolios only, from the newest revisions."""
    per_target = latest.groupBy("game", "draw_date", "arm", "budget").agg(
        F.count("*").alias("lines"),
        F.max("matched").alias("best"),
        F.count_if(F.col("matched") >= 3).alias("hits"),
    ).filter("lines = budget")
    return per_target.groupBy("game", "arm", "budget").agg(
        F.count("*").alias("completed_draws"),
        F.count_if(F.col("best") >= 3).alias("any_3_plus"),
        F.count_if(F.col("best") >= 5).alias("any_5_plus"),
        F.sum("hits").alias("line_3_plus"),
        F.sum("lines").alias("lines"),
    )
