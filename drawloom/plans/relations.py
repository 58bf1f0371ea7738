"""Relations derived from the given tables: draws, observations, prizes, context, populations and issued lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawloom import schemas
from drawloom.operators import features, intervals

POOL = 47


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bucketed(spark, sf_dir, unit) -> DataFrame:
    """First appearance of each number per game and period; partial aggregation shrinks the scan before the shuffle."""
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy(
        F.col("l_linestatus").alias("game"),
        F.date_trunc(unit, "l_shipdate").cast("date").alias("draw_date"),
        (F.col("l_partkey") % POOL + 1).cast("int").alias("number"),
    ).agg(F.min(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"))


def draws(spark, sf_dir, unit="week") -> DataFrame:
    """(game, draw_date, mains sorted, bonus): the first seven numbers of each period. A period holds at most 47 numbers."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("k", "number"))), lambda x: x["number"])
    seven = _bucketed(spark, sf_dir, unit).groupBy("game", "draw_date").agg(ordered.alias("n")).filter(F.size("n") >= 7)
    return seven.select("game", "draw_date", F.array_sort(F.slice("n", 1, 6)).alias("mains"), F.col("n")[6].alias("bonus"))


def draw_numbers(spark, sf_dir, unit="week") -> DataFrame:
    """Long form (game, draw_date, number, role)."""
    d = draws(spark, sf_dir, unit)
    role = F.concat(
        F.transform("mains", lambda n: F.struct(n.alias("number"), F.lit("main").alias("role"))),
        F.array(F.struct(F.col("bonus").alias("number"), F.lit("bonus").alias("role"))),
    )
    return d.select("game", "draw_date", F.explode(role).alias("x")).select("game", "draw_date", "x.*")


def rules(spark, schedule=(0,)) -> DataFrame:
    """Two regimes per game with a gap between them (a fixed dimension of four rows)."""
    days = ",".join(map(str, schedule))
    rows = ", ".join(
        f"('{game}', 'R1', DATE'1990-01-01', DATE'1998-06-30', 47), ('{game}', 'R2', DATE'1999-01-01', CAST(NULL AS DATE), 47)"
        for game in ("F", "O")
    )
    return spark.sql(f"SELECT *, array({days}) AS schedule FROM VALUES {rows} AS r(game, code, starts_on, ends_on, pool)")


def whole_rule(spark, schedule=(0,)) -> DataFrame:
    """One open regime per game."""
    days = ",".join(map(str, schedule))
    return spark.sql(
        f"""SELECT game, 'ALL' AS code, DATE'1990-01-01' AS starts_on, CAST(NULL AS DATE) AS ends_on, 47 AS pool,
        array({days}) AS schedule FROM VALUES ('F'), ('O') AS g(game)"""
    )


def _hex(*parts, at=1):
    return F.substring(F.md5(F.concat_ws("|", *parts)), at, 1)


def sightings(spark, sf_dir) -> DataFrame:
    """Observations of each weekly draw by four sources, with missing, contradicting and invalid values."""
    return sightings_of(draws(spark, sf_dir))


def sightings_of(rows: DataFrame) -> DataFrame:
    day = F.col("draw_date").cast("string")
    h1, h2, h3 = (_hex("game", day, at=i) for i in (1, 2, 3))
    mains, bonus = F.col("mains"), F.col("bonus")
    none = F.lit(None).cast("int")
    shifted = F.array_sort(F.concat(F.slice(mains, 2, 5), F.array(bonus)))

    def seen(source, seq, m, b):
        return F.struct(F.lit(source).alias("source"), F.lit(seq).alias("arrival_seq"), m.alias("mains"), b.alias("bonus"))

    a = seen("a", 1, mains, F.when(~h1.isin("0", "1", "2", "3"), bonus))
    b = seen("b", 2, F.when(h2 == "0", shifted).otherwise(mains), F.when(h2 == "0", none).otherwise(bonus))
    c = seen("c", 3, mains, F.when(h3 == "1", (bonus % POOL + 1).cast("int")).otherwise(bonus))
    d = F.when(h2.isin("0", "1") | (h3 == "1"), seen("d", 4, mains, bonus))
    every = F.explode(F.array_compact(F.array(a, b, c, d))).alias("x")
    return rows.select("game", "draw_date", every).select(
        "x.source", "x.arrival_seq", "game", "draw_date", "x.mains", "x.bonus"
    )


# Prize tier of each line number.
TIER_OF_LINE = {
    1: "Match 6",
    2: "Match 5 + Bonus",
    3: "Match 5",
    4: "Match 4 + Bonus",
    5: "Match 4",
    6: "Match 3 + Bonus",
    7: "Match 3",
}


def tier_rows(spark, sf_dir) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    base = items.groupBy(
        F.col("l_linestatus").alias("game"),
        F.date_trunc("week", "l_shipdate").cast("date").alias("draw_date"),
        F.col("l_linenumber").alias("line"),
    ).agg(F.count("*").cast("int").alias("cnt"), F.max("l_extendedprice").cast(schemas.MONEY).alias("amount"))
    tier = F.element_at(F.create_map(*[F.lit(x) for kv in TIER_OF_LINE.items() for x in kv]), F.col("line"))
    seen = F.when(F.col("line") == 1, (F.col("cnt") % 3 == 0).cast("int")).otherwise(F.col("cnt"))
    return base.select(
        "game",
        "draw_date",
        tier.alias("tier"),
        seen.alias("seen"),
        F.when(F.col("cnt") % 5 != 0, seen).alias("winners"),
        "amount",
        _hex("game", F.col("draw_date").cast("string"), F.col("line").cast("string")).alias("hex"),
    )


def prize_facts(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("tier") == "Match 6", "cash").otherwise("unresolved")
    return tier_rows(spark, sf_dir).select(
        "game", "draw_date", "tier", "winners", "amount", F.lit("EUR").alias("currency"), kind.alias("prize_type")
    )


def prize_sightings(spark, sf_dir) -> DataFrame:
    hexes, seen, amount = F.col("hex"), F.col("seen"), F.col("amount")

    def row(seq, winners, money, kind):
        return F.struct(
            F.lit(seq).alias("arrival_seq"),
            winners.cast("int").alias("winners"),
            money.alias("amount"),
            F.lit("EUR").alias("currency"),
            kind.alias("prize_type"),
        )

    def kind(test, name):
        return F.when(test, name).otherwise("unresolved")

    rows = F.array(
        row(1, F.col("winners"), amount, kind(F.col("tier") == "Match 6", "cash")),
        row(2, seen, F.when(~hexes.isin("0", "1", "2", "3", "4"), amount), kind(hexes.isin("e", "f"), "cash")),
        row(3, seen + (hexes == "7").cast("int"), amount, kind(hexes.isin("a", "b", "4"), "ticket_or_cash")),
        row(4, seen, amount, F.lit("cash")),
    )
    return tier_rows(spark, sf_dir).select("game", "draw_date", "tier", F.explode(rows).alias("x")).select(
        "game", "draw_date", "tier", "x.*"
    )


def context_rows(spark, sf_dir) -> DataFrame:
    won = F.when(F.col("winners") == 1, "Won").when(F.col("winners") == 0, "Roll")
    return tier_rows(spark, sf_dir).groupBy("game", "draw_date").agg(
        F.round(F.sum("amount")).cast(schemas.MONEY).alias("jackpot"),
        F.max(F.when(F.col("tier") == "Match 6", won)).alias("outcome"),
    ).withColumn("hex", _hex(F.lit("c"), "game", F.col("draw_date").cast("string")))


def context_sightings(spark, sf_dir) -> DataFrame:
    hexes, jackpot, outcome = F.col("hex"), F.col("jackpot"), F.col("outcome")

    def row(seq, money, currency, result):
        return F.struct(
            F.lit(seq).alias("arrival_seq"),
            money.cast(schemas.MONEY).alias("jackpot"),
            currency.cast("string").alias("currency"),
            result.alias("outcome"),
        )

    rows = F.array(
        row(1, jackpot, F.lit(None), F.when(hexes < "8", outcome)),
        row(2, jackpot, F.lit("EUR"), F.when(hexes.isin("0", "9"), "Roll").otherwise(outcome)),
        row(3, F.when(hexes == "c", jackpot + 1).otherwise(jackpot), F.lit("EUR"), outcome),
    )
    return context_rows(spark, sf_dir).select("game", "draw_date", F.explode(rows).alias("x")).select("game", "draw_date", "x.*")


def date_ranges(d: DataFrame) -> DataFrame:
    return d.groupBy("game").agg(F.min("draw_date").alias("start"), F.max("draw_date").alias("end"))


def population(spark, sf_dir, unit="week") -> DataFrame:
    """Draws with their single rule and ``gap_before``, in one pass from the calendar.

    Weekly draws share one open regime; daily draws fall into two regimes with a hole between them.
    """
    d = draws(spark, sf_dir, unit)
    rule = whole_rule(spark) if unit == "week" else rules(spark, schedule=range(7))
    ruled = intervals.attach_rule(d, rule).filter("rule_count = 1").drop("rule_count", "schedule")
    cal = intervals.mark_observed(intervals.calendar(date_ranges(d), rule), d)
    missing = cal.filter("scheduled and not observed").select("game", "day")
    return intervals.mark_gaps(ruled, missing).select(
        "game", "rule_code", "draw_date", "pool", "mains", "bonus", "gap_before"
    )


def feature_rows(spark, sf_dir, unit="week") -> DataFrame:
    return features.feature_table(population(spark, sf_dir, unit))
