"""Reconciliation of many observations into one canonical fact.

The reference behaviour is a state machine over arrival order. Here it is restated with algebraic
aggregates (min, max, min_by), which Spark combines on the map side before any shuffle; no group is ever
collected, so one draw may hold a third of all observations.

Numbers. Within an epoch of a draw the accepted mains are those of the first valid observation. The
bonus is that of the first observation with equal mains and a known bonus, unless a conflict came
earlier. Everything else follows from comparing arrival positions.

Prizes and context. The stored tuple only ever moves up a ladder: a replacement has no fewer known fields
and either more of them or a resolved type. A row that contradicts the stored values or lacks one of them
can never replace a later state, so each round keeps only the rows that still can. The number of rounds
is bounded by the height of the ladder (three fields and a type: seven steps), not by the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawloom.operators.intervals import attach_rule
from drawloom.operators.validate import draw_valid
from drawloom.session import cut_lineage

KEY = ["game", "draw_date"]


def stage_observations(observations: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds the covering rule and ``issue``: ``unverified_rule`` or ``invalid_numbers`` rows stay staged."""
    ruled = attach_rule(observations, rules)
    ok = draw_valid(F.col("mains"), F.col("bonus"), F.col("pool"))
    issue = F.when(F.coalesce(F.col("rule_count"), F.lit(0)) != 1, "unverified_rule").when(~ok, "invalid_numbers")
    return ruled.withColumn("issue", issue)


def _epochs(staged: DataFrame, resolutions: DataFrame | None) -> DataFrame:
    """Adds ``epoch`` (0, or the sequence of the latest operator resolution before the observation)."""
    if resolutions is None:
        return staged.withColumn("epoch", F.lit(0).cast("long"))
    order = Window.partitionBy(*KEY).orderBy("resolution_seq")  # one row per operator decision on a draw
    spans = resolutions.select(
        *KEY,
        F.col("resolution_seq").cast("long").alias("epoch"),
        F.lead("resolution_seq").over(order).alias("_until"),
    )
    on = [F.col(f"o.{k}") == F.col(f"r.{k}") for k in KEY]
    inside = (F.col("o.arrival_seq") > F.col("r.epoch")) & (
        F.col("r._until").isNull() | (F.col("o.arrival_seq") < F.col("r._until"))
    )
    joined = staged.alias("o").join(spans.alias("r"), [*on, inside], "left")
    return joined.select("o.*", F.coalesce("r.epoch", F.lit(0)).alias("epoch"))


def number_states(staged: DataFrame, resolutions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid observations with their epoch, one state row per draw and epoch)."""
    valid = _epochs(staged.filter("issue is null"), resolutions)
    keys = [*KEY, "epoch"]
    rows = valid.select(*keys, "mains", "bonus", "arrival_seq")
    if resolutions is not None:
        opened = resolutions.select(
            *KEY,
            F.col("resolution_seq").cast("long").alias("epoch"),
            "mains",
            "bonus",
            F.col("resolution_seq").alias("arrival_seq"),
        )
        rows = rows.unionByName(opened)
    # Equal claims collapse before the shuffle: only their first arrival matters.
    claims = rows.groupBy(*keys, "mains", "bonus").agg(F.min("arrival_seq").alias("seq"))
    # Per set of mains: its first arrival, and the first arrival of each bonus (a bonus is one of at most 99 numbers).
    seen = F.array_sort(F.collect_list(F.when(F.col("bonus").isNotNull(), F.struct("seq", "bonus"))))
    sets = claims.groupBy(*keys, "mains").agg(F.min("seq").alias("seq"), seen.alias("bonuses"))
    # The earliest set is accepted; the second earliest is the first contradiction. The row_number limit is
    # applied on the map side, so a draw with many different claims still sends two rows per task.
    order = Window.partitionBy(*keys).orderBy("seq")
    two = sets.withColumn("_place", F.row_number().over(order)).filter("_place <= 2")
    top = F.col("_place") == 1
    states = two.groupBy(*keys).agg(
        F.max(F.when(top, F.col("seq"))).alias("accepted_seq"),
        F.max(F.when(top, F.col("mains"))).alias("mains"),
        F.max(F.when(~top, F.col("seq"))).alias("mains_conflict_seq"),
        F.max(F.when(top, F.col("bonuses"))).alias("_bonuses"),
    )
    first = F.get("_bonuses", F.lit(0))
    filled = F.coalesce(first["seq"] < F.col("mains_conflict_seq"), first["seq"].isNotNull())
    other = F.get(F.filter("_bonuses", lambda x: x["bonus"] != first["bonus"]), F.lit(0))
    states = states.select(
        *keys,
        "accepted_seq",
        "mains",
        "mains_conflict_seq",
        F.when(filled, first["bonus"]).alias("bonus"),
        F.when(filled, first["seq"]).alias("bonus_seq"),
        F.when(filled, other["seq"]).alias("bonus_conflict_seq"),
    ).withColumn("conflict_seq", F.least("mains_conflict_seq", "bonus_conflict_seq"))
    return valid, states.withColumn("status", F.when(F.col("conflict_seq").isNull(), "accepted").otherwise("quarantined"))


def _judged(staged: DataFrame, resolutions: DataFrame | None) -> DataFrame:
    """Valid observations with their epoch, ``then`` (the outcome on arrival), the outcome on replay, and a conflict flag."""
    valid, states = number_states(staged, resolutions)
    s = states.select(
        *KEY,
        "epoch",
        F.col("mains").alias("_mains"),
        F.col("bonus").alias("_bonus"),
        "bonus_seq",
        "accepted_seq",
        "conflict_seq",
    )
    last = states.groupBy(*KEY).agg(
        F.max("epoch").alias("_last_epoch"),
        F.max_by("mains", "epoch").alias("_now_mains"),
        F.max_by("bonus", "epoch").alias("_now_bonus"),
    )
    judged = valid.join(s, [*KEY, "epoch"]).join(last, KEY)
    bonus_set = F.col("_bonus").isNotNull() & (F.col("arrival_seq") > F.col("bonus_seq"))
    conflict = (F.col("mains") != F.col("_mains")) | (
        bonus_set & F.coalesce(F.col("bonus") != F.col("_bonus"), F.lit(False))
    )
    after = F.coalesce(F.col("arrival_seq") > F.col("conflict_seq"), F.lit(False))
    outcome = (
        F.when(F.col("arrival_seq") == F.col("accepted_seq"), "accepted")
        .when(conflict | after, "quarantined")
        .otherwise("corroborated")
    )
    overruled = (F.col("mains") != F.col("_now_mains")) | F.coalesce(F.col("bonus") != F.col("_now_bonus"), F.lit(False))
    involved = conflict | (F.col("arrival_seq") == F.col("accepted_seq"))
    replayed = F.when((F.col("epoch") < F.col("_last_epoch")) & overruled & involved, "superseded")
    judged = judged.withColumn("then", outcome).withColumn("outcome", F.coalesce(replayed, outcome))
    return judged.withColumn("conflicted", conflict & (F.col("arrival_seq") != F.col("accepted_seq")))


def observation_outcomes(staged: DataFrame, resolutions: DataFrame | None = None) -> DataFrame:
    """One outcome per observation: staged, accepted, corroborated, quarantined, or superseded by a resolution."""
    judged = _judged(staged, resolutions)
    kept = staged.columns
    waiting = staged.filter("issue is not null").withColumn("outcome", F.lit("staged")).withColumn("conflicted", F.lit(False))
    return judged.select(*kept, "outcome", "conflicted").unionByName(waiting.select(*kept, "outcome", "conflicted"))


def canonical_draws(staged: DataFrame, resolutions: DataFrame | None = None) -> DataFrame:
    """Current canonical row per draw: the state of its latest epoch."""
    _, states = number_states(staged, resolutions)
    row = F.struct("mains", "bonus", "status", "accepted_seq", "epoch")
    return states.groupBy(*KEY).agg(F.max_by(row, "epoch").alias("r")).select(*KEY, "r.*")


def premature_resolutions(staged: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Resolutions of a draw that was not quarantined when they came; must be empty."""
    _, states = number_states(staged, resolutions)
    order = Window.partitionBy(*KEY).orderBy("epoch")  # one row per resolution of a draw
    before = F.lag("status").over(order)
    return states.withColumn("_before", before).filter("epoch > 0 and coalesce(_before, 'none') != 'quarantined'").select(*KEY, "epoch")


# --- ladders: prizes and context -----------------------------------------------


def _clash(fields: list[str]) -> Column:
    """Some field is known on both sides and differs (false, never null)."""
    parts = [F.coalesce(F.col(f"n.{f}") != F.col(f"s.{f}"), F.lit(False)) for f in fields]
    return reduce(lambda a, b: a | b, parts)


def _covers(fields: list[str]) -> Column:
    parts = [F.col(f"n.{f}").isNotNull() | F.col(f"s.{f}").isNull() for f in fields]
    return reduce(lambda a, b: a & b, parts)


def _adds(fields: list[str]) -> Column:
    parts = [F.col(f"n.{f}").isNotNull() & F.col(f"s.{f}").isNull() for f in fields]
    return reduce(lambda a, b: a | b, parts)


def _type_clash() -> Column:
    known = (F.col("n.prize_type") != "unresolved") & (F.col("s.prize_type") != "unresolved")
    return known & (F.col("n.prize_type") != F.col("s.prize_type"))


def _type_gain() -> Column:
    return (F.col("s.prize_type") == "unresolved") & (F.col("n.prize_type") != "unresolved")


def climb(rows: DataFrame, keys: list[str], fields: list[str], typed: bool) -> DataFrame:
    """History of stored states per key: (keys, since_seq, until_seq, fields).

    ``rows`` needs the keys, ``arrival_seq`` and the fields. Each round keeps the rows that may still
    replace the state; the loop ends when none is left.
    """
    carried = [*fields, *(["prize_type"] if typed else [])]
    live = rows.select(*keys, "arrival_seq", *carried)
    packed = F.struct(*carried)
    state = live.groupBy(*keys).agg(F.min("arrival_seq").alias("since_seq"), F.min_by(packed, "arrival_seq").alias("s"))
    state = state.select(*keys, "since_seq", "s.*")
    levels = [state]
    for _ in range(7 if typed else 3):
        gains = _adds(fields) | _type_gain() if typed else _adds(fields)
        later = F.col("n.arrival_seq") > F.col("s.since_seq")
        joined = live.alias("n").join(state.alias("s"), keys).filter(later & ~_clash(fields) & _covers(fields) & gains)
        fits = ~_type_clash() if typed else F.lit(True)
        live = cut_lineage(joined.select(*keys, *[F.col(f"n.{c}").alias(c) for c in ("arrival_seq", *carried)], fits.alias("_fits")))
        if live.isEmpty():
            break
        state = (
            live.filter("_fits")
            .groupBy(*keys)
            .agg(F.min("arrival_seq").alias("since_seq"), F.min_by(packed, "arrival_seq").alias("s"))
            .select(*keys, "since_seq", "s.*")
        )
        levels.append(state)
    history = reduce(DataFrame.unionByName, levels)
    order = Window.partitionBy(*keys).orderBy("since_seq")  # at most eight states per key
    return history.withColumn("until_seq", F.lead("since_seq").over(order))


def _judge(rows: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """Rows joined to the state that was stored just before they arrived (n = row, s = state)."""
    stored = (F.col("n.arrival_seq") > F.col("s.since_seq")) & (
        F.col("s.until_seq").isNull() | (F.col("n.arrival_seq") <= F.col("s.until_seq"))
    )
    on = [F.col(f"n.{k}") == F.col(f"s.{k}") for k in keys]
    return rows.alias("n").join(history.alias("s"), [*on, stored])


PRIZE_KEY = ["game", "draw_date", "tier"]
PRIZE_FIELDS = ["winners", "amount", "currency"]


def enriching(rows: DataFrame, staged: DataFrame, resolutions: DataFrame | None = None) -> DataFrame:
    """Prize or context rows (game, draw_date, arrival_seq, ...) that may be read, with their ``epoch``.

    An observation that was quarantined or staged when it came enriches nothing. A resolution's own rows open its epoch.
    """
    taken = _judged(staged, resolutions).filter("then in ('accepted', 'corroborated')").select(*KEY, "arrival_seq", "epoch")
    if resolutions is not None:
        seq = F.col("resolution_seq")
        taken = taken.unionByName(resolutions.select(*KEY, seq.cast(taken.schema["arrival_seq"].dataType).alias("arrival_seq"), seq.cast("long").alias("epoch")))
    return rows.join(taken, [*KEY, "arrival_seq"])


def _current(history: DataFrame, resolutions: DataFrame | None) -> DataFrame:
    """The states that are stored now: the last one of each key, in the last epoch of its draw.

    A resolution clears what was stored before it, also where nothing has come since.
    """
    stored = history.filter("until_seq is null").drop("until_seq").withColumnRenamed("since_seq", "observation_seq")
    if resolutions is None:
        return stored
    last = resolutions.groupBy(*KEY).agg(F.max("resolution_seq").cast("long").alias("_last"))
    return stored.join(last, KEY, "left").filter(F.col("epoch") == F.coalesce("_last", F.lit(0))).drop("_last")


def reconcile_prizes(prizes: DataFrame, resolutions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(stored tier rows, issues). Prizes must come from observations that were accepted or corroborated.

    With an ``epoch`` column (see ``enriching``) each epoch climbs anew, and only the last one of a draw is stored.
    """
    keys = [*PRIZE_KEY, *(["epoch"] if "epoch" in prizes.columns else [])]
    history = climb(prizes, keys, PRIZE_FIELDS, typed=True)
    clash = _clash(PRIZE_FIELDS) | _type_clash()
    replaces = _covers(PRIZE_FIELDS) & (_adds(PRIZE_FIELDS) | _type_gain())
    equal = reduce(lambda a, b: a & b, [F.col(f"n.{f}").eqNullSafe(F.col(f"s.{f}")) for f in PRIZE_FIELDS])
    kind = F.when(clash, "prize_conflict").when(replaces, None).when(~equal, "partial_prize")
    issues = _judge(prizes, history, keys).select(
        *[F.col(f"n.{k}").alias(k) for k in keys], F.col("n.arrival_seq").alias("arrival_seq"), kind.alias("kind")
    )
    return _current(history, resolutions), issues.filter("kind is not null")


CONTEXT_FIELDS = ["jackpot", "currency", "outcome"]


def _context_history(context: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """(distinct tuples with their first and last arrival, history of stored states, keys)."""
    keys = [*KEY, *(["epoch"] if "epoch" in context.columns else [])]
    rows = context.filter("jackpot is not null or outcome is not null")
    # Equal tuples collapse to their first and last arrival: a tuple that cannot replace a state can
    # never replace a later one, and a contradiction, once true, stays true.
    claims = rows.groupBy(*keys, *CONTEXT_FIELDS).agg(
        F.min("arrival_seq").alias("arrival_seq"), F.max("arrival_seq").alias("last_seq")
    )
    return claims, climb(claims, keys, CONTEXT_FIELDS, typed=False), keys


def reconcile_context(context: DataFrame, resolutions: DataFrame | None = None) -> DataFrame:
    """Stored jackpot, currency and outcome per draw, with a sticky ``disputed`` flag.

    With an ``epoch`` column (see ``enriching``) a resolution clears the context and its dispute.
    """
    claims, history, keys = _context_history(context)
    on = [F.col(f"n.{k}") == F.col(f"s.{k}") for k in keys]
    disputed = (
        claims.alias("n")
        .join(history.alias("s"), on)
        .filter((F.col("n.last_seq") > F.col("s.since_seq")) & _clash(CONTEXT_FIELDS))
        .select(*[F.col(f"n.{k}").alias(k) for k in keys])
        .distinct()
        .withColumn("_disputed", F.lit(True))
    )
    stored = _current(history, resolutions)
    return stored.join(disputed, keys, "left").withColumn("disputed", F.coalesce("_disputed", F.lit(False))).drop("_disputed")


def context_conflicts(context: DataFrame) -> DataFrame:
    """One issue per row that contradicts the context stored when it came: (keys, arrival_seq, kind, previous_seq)."""
    _, history, keys = _context_history(context)
    rows = context.filter("jackpot is not null or outcome is not null")
    return _judge(rows, history, keys).filter(_clash(CONTEXT_FIELDS)).select(
        *[F.col(f"n.{k}").alias(k) for k in keys], F.col("n.arrival_seq").alias("arrival_seq"), F.lit("context_conflict").alias("kind"), F.col("s.since_seq").alias("previous_seq")
    )
