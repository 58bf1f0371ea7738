"""Set-based reconciliation against a plain state machine on random logs, batch and stream."""

import random
from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from drawloom.operators import reconcile
from drawloom.session import scratch
from drawloom.streaming import jobs

DAY = date(2020, 1, 6)
SETS = [[1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 7]]
STAGED = "game string, draw_date date, arrival_seq int, mains array<int>, bonus int, issue string"


def random_log(seed, games=60, length=7):
    rng = random.Random(seed)
    rows = []
    for g in range(games):
        for seq in range(1, rng.randint(2, length)):
            mains = SETS[0] if rng.random() < 0.85 else SETS[1]
            rows.append((f"g{g}", DAY, seq, mains, rng.choice([None, None, 10, 10, 11]), None))
    return rows


def fold(rows):
    mains, bonus, disputed, out = None, None, False, []
    for _, _, seq, m, b, _ in rows:
        if mains is None:
            mains, bonus, result = m, b, "accepted"
        elif m != mains or (bonus is not None and b is not None and b != bonus):
            disputed, result = True, "quarantined"
        elif disputed:
            result = "quarantined"
        else:
            bonus, result = b if bonus is None else bonus, "corroborated"
        out.append((seq, result))
    return mains, bonus, disputed, out


def by_game(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return groups


def test_numbers_match_the_state_machine(spark):
    rows = random_log(1)
    staged = spark.createDataFrame(rows, STAGED)
    now = {r["game"]: r for r in reconcile.canonical_draws(staged).collect()}
    outcomes = {(r["game"], r["arrival_seq"]): r["outcome"] for r in reconcile.observation_outcomes(staged).collect()}
    for game, group in by_game(rows).items():
        mains, bonus, disputed, out = fold(group)
        assert list(now[game]["mains"]) == mains and now[game]["bonus"] == bonus
        assert now[game]["status"] == ("quarantined" if disputed else "accepted")
        assert {s: outcomes[game, s] for s, _ in out} == dict(out)


def test_resolution_opens_a_new_epoch(spark):
    rows = [("g", DAY, 1, SETS[0], None, None), ("g", DAY, 2, SETS[0], 9, None), ("g", DAY, 3, SETS[1], None, None), ("g", DAY, 6, SETS[1], 8, None)]
    fixes = spark.createDataFrame([("g", DAY, 5, SETS[1], None)], "game string, draw_date date, resolution_seq int, mains array<int>, bonus int")
    staged = spark.createDataFrame(rows, STAGED)
    now = reconcile.canonical_draws(staged, fixes).first()
    assert (now["status"], list(now["mains"]), now["bonus"]) == ("accepted", SETS[1], 8)
    got = {r["arrival_seq"]: r["outcome"] for r in reconcile.observation_outcomes(staged, fixes).collect()}
    assert got[1] == "superseded" and got[6] == "corroborated"
    assert reconcile.premature_resolutions(staged, fixes).isEmpty()
    early = fixes.withColumn("resolution_seq", F.lit(2))
    assert not reconcile.premature_resolutions(staged.filter("arrival_seq <> 2"), early).isEmpty()


def test_stream_equals_batch(spark):
    rows = random_log(2, games=25)
    staged = spark.createDataFrame(rows, STAGED)
    root = scratch(spark, "test")
    columns = ["game", "draw_date", "arrival_seq", "mains", "bonus"]
    for part in ("arrival_seq <= 2", "arrival_seq in (3, 4)", "arrival_seq > 4"):
        staged.select(*columns).filter(part).write.mode("append").parquet(root + "/in")
        stream = jobs.file_stream(spark, root + "/in", staged.select(*columns).schema)
        jobs.run_append(jobs.reconcile(stream), root + "/checkpoint", root + "/out")
    key = ["game", "arrival_seq", "outcome"]
    stream_rows = spark.read.parquet(root + "/out").select(*key)
    batch_rows = reconcile.observation_outcomes(staged).select(*key)
    assert stream_rows.exceptAll(batch_rows).isEmpty() and batch_rows.exceptAll(stream_rows).isEmpty()


def test_stream_equals_batch_with_resolutions(spark):
    """Resolutions of quarantined draws, some twice, in a stream of four runs; overruled observations come again."""
    rng = random.Random(8)
    rows, fixes = [], []
    for game, group in by_game(random_log(6, games=40)).items():
        rows += group
        if fold(group)[2]:
            fixes.append((game, DAY, 10, SETS[rng.random() < 0.5], rng.choice([None, 10, 11])))
            later = [(game, DAY, 11 + k, SETS[rng.random() < 0.4], rng.choice([None, 10, 11]), None) for k in range(rng.randint(0, 4))]
            rows += later
            start = [(game, DAY, 10, *fixes[-1][3:], None)]
            if fold(start + later)[2]:
                fixes.append((game, DAY, 20, SETS[0], 10))
                rows.append((game, DAY, 21, SETS[0], 10, None))
    assert len(fixes) > 15 and any(f[2] == 20 for f in fixes)
    staged = spark.createDataFrame(rows, STAGED)
    resolved = spark.createDataFrame(fixes, "game string, draw_date date, resolution_seq int, mains array<int>, bonus int")
    columns = ["game", "draw_date", "arrival_seq", "mains", "bonus"]
    events = staged.select(*columns, F.lit(False).alias("resolves")).unionByName(resolved.withColumnRenamed("resolution_seq", "arrival_seq").select(*columns, F.lit(True).alias("resolves")))
    root = scratch(spark, "test")
    for part in ("arrival_seq <= 2", "arrival_seq between 3 and 10", "arrival_seq between 11 and 12", "arrival_seq > 12"):
        events.filter(part).repartition(2).write.mode("append").parquet(root + "/in")
        jobs.run_append(jobs.reconcile(jobs.file_stream(spark, root + "/in", events.schema)), root + "/checkpoint", root + "/out")
    out = spark.read.parquet(root + "/out")
    assert out.groupBy("game", "revision").count().filter("count > 1").isEmpty() and out.filter("outcome = 'premature'").isEmpty()
    latest = {(r.game, r.arrival_seq): r.outcome for r in out.groupBy("game", "arrival_seq").agg(F.max_by("outcome", "revision").alias("outcome")).collect()}
    truth = {(r.game, r.arrival_seq): r.outcome for r in reconcile.observation_outcomes(staged, resolved).collect()}
    assert {k: v for k, v in latest.items() if v != "resolved"} == truth and "superseded" in truth.values()


def test_enrichment_is_gated_and_rebuilt(spark):
    """A conflicting observation's prizes are not read; a resolution clears prizes and context, and later rows climb again."""
    rows = [("g", DAY, 1, SETS[0], 9, None), ("g", DAY, 2, SETS[1], 9, None), ("g", DAY, 3, SETS[0], 9, None), ("g", DAY, 6, SETS[1], 9, None), ("h", DAY, 1, SETS[0], 9, None)]
    fixes = spark.createDataFrame([("g", DAY, 5, SETS[1], 9)], "game string, draw_date date, resolution_seq int, mains array<int>, bonus int")
    staged = spark.createDataFrame(rows, STAGED)
    five = Decimal("5.00")
    prizes = spark.createDataFrame([(g, DAY, "T", n, n, five, "EUR", "cash") for g, n in (("g", 1), ("g", 2), ("g", 3), ("g", 6), ("h", 1))] + [("g", DAY, "U", 1, 1, five, "EUR", "cash")], PRIZE)
    before, _ = reconcile.reconcile_prizes(reconcile.enriching(prizes, staged))
    assert {(r.game, r.tier): r.winners for r in before.collect()} == {("g", "T"): 1, ("g", "U"): 1, ("h", "T"): 1}
    after, issues = reconcile.reconcile_prizes(reconcile.enriching(prizes, staged, fixes), fixes)
    assert {(r.game, r.tier): r.winners for r in after.collect()} == {("g", "T"): 6, ("h", "T"): 1} and issues.isEmpty()
    seven, eight = Decimal("7.00"), Decimal("8.00")
    context = spark.createDataFrame([("g", DAY, 1, seven, "EUR", None), ("g", DAY, 3, eight, "EUR", None), ("g", DAY, 5, eight, None, None), ("g", DAY, 6, eight, "EUR", "Won")], "game string, draw_date date, arrival_seq int, jackpot decimal(18,2), currency string, outcome string")
    gated = reconcile.enriching(context, staged, fixes)
    assert [(r.jackpot, r.outcome, r.disputed) for r in reconcile.reconcile_context(gated, fixes).collect()] == [(eight, "Won", False)]
    assert reconcile.context_conflicts(gated).isEmpty()  # the third observation was quarantined, so its context was not read
    found = reconcile.context_conflicts(context).collect()
    assert sorted((r.arrival_seq, r.kind, r.previous_seq) for r in found) == [(3, "context_conflict", 1), (5, "context_conflict", 1), (6, "context_conflict", 1)]


PRIZE = "game string, draw_date date, tier string, arrival_seq int, winners int, amount decimal(18,2), currency string, prize_type string"


def prize_fold(group):
    state, issues = None, []
    for _, _, _, seq, *new in group:
        values, kind = new[:3], new[3]
        if state is None:
            state = [*new, seq]
            continue
        old, old_kind = state[:3], state[3]
        clash = any(o is not None and v is not None and o != v for o, v in zip(old, values))
        clash |= kind != "unresolved" and old_kind != "unresolved" and kind != old_kind
        if clash:
            issues.append((seq, "prize_conflict"))
            continue
        covers = all(v is not None or o is None for o, v in zip(old, values))
        gains = any(o is None and v is not None for o, v in zip(old, values)) or (old_kind == "unresolved" and kind != "unresolved")
        if covers and gains:
            state = [*new, seq]
        elif old != values:
            issues.append((seq, "partial_prize"))
    return state, issues


def test_prizes_match_the_state_machine(spark):
    rng = random.Random(3)
    rows = []
    for g in range(150):
        for seq in range(1, rng.randint(2, 10)):
            rows.append(
                (f"g{g}", DAY, "T", seq, rng.choice([None, 1, 1, 1, 2]), rng.choice([None, Decimal("5.00"), Decimal("5.00")]), rng.choice([None, "EUR", "EUR"]), rng.choice(["unresolved", "unresolved", "cash", "ticket_or_cash"]))
            )
    stored, issues = reconcile.reconcile_prizes(spark.createDataFrame(rows, PRIZE))
    got = {r["game"]: [r["winners"], r["amount"], r["currency"], r["prize_type"], r["observation_seq"]] for r in stored.collect()}
    raised = {(r["game"], r["arrival_seq"]): r["kind"] for r in issues.collect()}
    groups = by_game(rows)
    for game, group in groups.items():
        state, expected = prize_fold(group)
        assert got[game] == state, group
        assert {k[1]: v for k, v in raised.items() if k[0] == game} == dict(expected), group


def test_a_repeated_prize_can_win_later(spark):
    """A resolved type is refused, then a fuller unresolved row replaces the state, then the refused row fits."""
    five = Decimal("5.00")
    rows = [
        ("g", DAY, "T", 1, 1, None, "EUR", "cash"),
        ("g", DAY, "T", 2, 1, five, "EUR", "ticket_or_cash"),
        ("g", DAY, "T", 3, 1, five, "EUR", "unresolved"),
        ("g", DAY, "T", 4, 1, five, "EUR", "ticket_or_cash"),
    ]
    stored, _ = reconcile.reconcile_prizes(spark.createDataFrame(rows, PRIZE))
    row = stored.first()
    assert (row["prize_type"], row["observation_seq"]) == ("ticket_or_cash", 4)


def test_context_matches_the_state_machine(spark):
    rng = random.Random(4)
    rows = []
    for g in range(150):
        for seq in range(1, rng.randint(2, 9)):
            rows.append((f"g{g}", DAY, seq, rng.choice([None, Decimal("7.00"), Decimal("7.00"), Decimal("8.00")]), rng.choice([None, "EUR"]), rng.choice([None, None, "Won", "Roll"])))
    df = spark.createDataFrame(rows, "game string, draw_date date, arrival_seq int, jackpot decimal(18,2), currency string, outcome string")
    got = {r["game"]: (r["jackpot"], r["currency"], r["outcome"], r["disputed"]) for r in reconcile.reconcile_context(df).collect()}
    for game, group in by_game(rows).items():
        state, disputed = None, False
        for _, _, _, *new in group:
            if new[0] is None and new[2] is None:
                continue
            if state is None:
                state = new
                continue
            pairs = list(zip(state, new))
            if any(o is not None and v is not None and o != v for o, v in pairs):
                disputed = True
            elif all(v is not None or o is None for o, v in pairs) and any(o is None and v is not None for o, v in pairs):
                state = new
        assert got.get(game) == (None if state is None else (*state, disputed))
