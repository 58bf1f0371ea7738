"""Validation rules and scalar functions over the given tables."""

from pyspark.sql import functions as F

from drawloom.functions import scalars as sc
from drawloom.operators import intervals, validate
from drawloom.plans import relations as rel
from drawloom.plans.catalog.audit import _h, bindings, digit
from drawloom.plans.catalog.canonical import staged
from drawloom.plans.registry import query
from drawloom.plans.relations_sql import RELATIONS

# Draws damaged by a digit of their hash: a repeated main, a number off the pool, a bonus among the mains, five mains.
RELATIONS["damaged"] = f"""
SELECT game, draw_date, 47 AS pool,
  CASE {_h(1)} WHEN '0' THEN [mains[1], mains[1], mains[3], mains[4], mains[5], mains[6]] WHEN '1' THEN [mains[1], mains[2], mains[3], mains[4], mains[5], 48]
    WHEN '2' THEN mains[1:5] ELSE mains END AS mains,
  CASE {_h(2)} WHEN '0' THEN mains[6] WHEN '1' THEN 0 WHEN '2' THEN NULL ELSE bonus END AS bonus FROM day_draws
"""


def damaged(spark, d):
    m, b = F.col("mains"), F.col("bonus")
    mains = (
        F.when(digit(1) == "0", F.array(m[0], m[0], m[2], m[3], m[4], m[5]))
        .when(digit(1) == "1", F.concat(F.slice(m, 1, 5), F.array(F.lit(48))))
        .when(digit(1) == "2", F.slice(m, 1, 5))
        .otherwise(m)
    )
    bonus = F.when(digit(2) == "0", m[5]).when(digit(2) == "1", 0).when(digit(2) == "2", None).otherwise(b)
    return rel.draws(spark, d, "day").select("game", "draw_date", F.lit(47).alias("pool"), mains.alias("mains"), bonus.alias("bonus"))


_REASONS = """list_concat(
  CASE WHEN coalesce(list_contains(mains, bonus), FALSE) THEN ['{bonus_in}'] ELSE [] END, CASE WHEN coalesce(bonus < 1 OR bonus > pool, FALSE) THEN ['{bonus_out}'] ELSE [] END,
  CASE WHEN len(list_distinct(mains)) < len(mains) THEN ['{dup}'] ELSE [] END, CASE WHEN list_max(mains) > pool THEN ['{out}'] ELSE [] END, CASE WHEN len(mains) <> 6 THEN ['{six}'] ELSE [] END)"""


@query(
    "B1_draw_validity",
    "game:s draw_date:s reasons:a",
    "SELECT game, draw_date, "
    + _REASONS.format(bonus_in="bonus_in_mains", bonus_out="bonus_outside_pool", dup="duplicate_mains", out="mains_outside_pool", six="not_six_mains")
    + " AS reasons FROM damaged",
)
def draw_validity(spark, d):
    return validate.check_draws(damaged(spark, d))


RELATIONS["full_observations"] = f"""
SELECT w.game, w.draw_date, w.mains, w.bonus, x.jackpot, x.outcome,
  CASE {_h(1, 'w.')} WHEN '0' THEN 'ftp://host.example.org/' || w.game WHEN '1' THEN 'https://user:pw@host.example.org/x' WHEN '2' THEN 'https://host.example.org/a b'
    WHEN '3' THEN 'file:///data/' || w.game WHEN '4' THEN 'file:relative' WHEN '5' THEN 'http:///nohost' ELSE 'https://host.example.org/' || w.game END AS source_url
FROM week_draws w JOIN context_rows x ON x.game = w.game AND x.draw_date = w.draw_date
"""


def full_observations(spark, d):
    one = digit(1)
    url = (
        F.when(one == "0", F.concat(F.lit("ftp://host.example.org/"), "game"))
        .when(one == "1", "https://user:pw@host.example.org/x")
        .when(one == "2", "https://host.example.org/a b")
        .when(one == "3", F.concat(F.lit("file:///data/"), "game"))
        .when(one == "4", "file:relative")
        .when(one == "5", "http:///nohost")
        .otherwise(F.concat(F.lit("https://host.example.org/"), "game"))
    )
    prize = F.struct(
        F.lit("Match 6").alias("tier"),
        F.lit(1).alias("winners"),
        F.col("jackpot").alias("amount"),
        F.lit("EUR").alias("currency"),
        F.lit("").alias("original_text"),
        F.lit("cash").alias("prize_type"),
    )
    prizes = F.when(digit(3) == "0", F.array(prize, prize)).otherwise(F.array(prize))
    context = rel.context_rows(spark, d).select("game", "draw_date", "jackpot", "outcome")
    joined = rel.draws(spark, d).join(context, ["game", "draw_date"])
    return joined.withColumn("source_url", url).withColumn("prizes", prizes)


@query(
    "B2_observation_validity",
    "game:s draw_date:s reasons:a",
    f"""SELECT game, draw_date, list_concat(CASE WHEN source_url LIKE 'ftp%' OR source_url LIKE '%@%' OR source_url LIKE '% %' OR source_url = 'file:relative' OR source_url = 'http:///nohost'
        THEN ['bad_source'] ELSE [] END, CASE WHEN {_h(3)} = '0' THEN ['duplicate_tiers'] ELSE [] END) AS reasons FROM full_observations""",
)
def observation_validity(spark, d):
    return validate.check_observations(full_observations(spark, d))


@query(
    "B5_source_identity",
    "source_url:s rows:i ok:i",
    "SELECT source_url, count(*) AS rows, CAST(any_value(source_url LIKE 'https://host.example.org/_' OR source_url LIKE 'file:///%') AS INT) AS ok FROM full_observations GROUP BY 1",
)
def source_identity(spark, d):
    return full_observations(spark, d).groupBy("source_url").agg(F.count("*").alias("rows"), F.max(validate.source_url_ok(F.col("source_url"))).alias("ok"))


@query(
    "B3_undated_validity",
    "game:s draw_date:s reasons:a",
    f"""SELECT game, draw_date, list_concat(CASE WHEN {_h(2)} = '0' THEN ['bad_period'] ELSE [] END, CASE WHEN {_h(1)} = '0' THEN ['differs_from_source'] ELSE [] END) AS reasons FROM week_draws""",
)
def undated_validity(spark, d):
    published = F.reverse(F.when(digit(1) == "0", F.concat(F.slice("mains", 1, 5), F.array(F.col("bonus")))).otherwise(F.col("mains")))
    end = F.when(digit(2) == "0", F.date_sub("draw_date", 1)).otherwise(F.date_add("draw_date", 6))
    rows = rel.draws(spark, d).select(
        "game", "draw_date", "mains", published.alias("source_numbers"), F.lit(47).alias("pool"), F.col("draw_date").alias("period_start"), end.alias("period_end")
    )
    return validate.check_undated(rows)


@query(
    "B4_prize_non_negative",
    "tier:s rows:i bad:i",
    "SELECT tier, count(*) AS rows, count(*) FILTER (WHERE hex = '0' OR (hex = '1' AND winners IS NOT NULL)) AS bad FROM tier_rows GROUP BY 1",
)
def prize_non_negative(spark, d):
    amount = F.when(F.col("hex") == "0", -F.col("amount")).otherwise(F.col("amount"))
    winners = F.when(F.col("hex") == "1", -F.col("winners") - 1).otherwise(F.col("winners"))
    prize = F.struct(winners.alias("winners"), amount.alias("amount"))
    ok = validate.prizes_ok(F.array(prize))
    return rel.tier_rows(spark, d).groupBy("tier").agg(F.count("*").alias("rows"), F.count_if(~ok).alias("bad"))


@query(
    "B6_artifact_validity",
    "page_id:i reasons:a",
    """SELECT page_id, list_concat(CASE WHEN page_id % 5 = 0 THEN ['bad_hash'] ELSE [] END, CASE WHEN page_id % 7 = 0 THEN ['bad_status'] ELSE [] END,
       CASE WHEN regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) = '' OR url LIKE '% %' OR regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) LIKE '%@%' OR NOT regexp_matches(url, '^(?i)https?://') THEN ['bad_url'] ELSE [] END) AS reasons FROM pages""",
)
def artifact_validity(spark, d):
    sha = F.sha2("html", 256)
    rows = rel.table(spark, d, "pages").select(
        "page_id",
        "url",
        F.when(F.col("page_id") % 5 == 0, F.upper(F.concat(F.lit("X"), F.substring(sha, 2, 63)))).otherwise(sha).alias("sha256"),
        F.when(F.col("page_id") % 7 == 0, "unknown").otherwise("valid").alias("status"),
        F.lit("2024-01-01").cast("timestamp").alias("retrieved_at"),
    )
    return validate.check_artifacts(rows)


RELATIONS["curated_rows"] = """
SELECT o_orderkey AS k, o_orderkey % 7 AS c, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(CAST(o_orderdate AS DATE) - CAST(1 AS INT) AS VARCHAR) AS before FROM orders
"""


def curated_rows(spark, d):
    """Curated facts written from orders; the key picks the dataset and the fault."""
    day = F.col("o_orderdate").cast("date")
    fields = {
        0: ("rule_attributes", {"effective_from": day, "effective_to": F.date_sub(day, 1), "attribute": F.lit("price"), "value": F.lit("2")}),
        1: ("calendar_events", {"day": day, "scheduled": F.lit(True), "description": F.lit("moved")}),
        2: ("calendar_events", {"day": day, "scheduled": F.lit("yes"), "description": F.lit("moved")}),
        3: ("winning_ticket_reports", {"draw_date": day, "channel": F.lit("online"), "location_meaning": F.lit("purchase_county"), "email": F.lit("x")}),
        4: ("winning_ticket_reports", {"draw_date": day, "channel": F.lit("kiosk"), "location_meaning": F.lit("unresolved")}),
        5: ("official_period_metrics", {"period_start": day, "period_end": day, "game_scope": F.lit("all"), "metric": F.lit("sales"), "value": F.lit("n/a")}),
        6: ("official_period_metrics", {"period_start": F.lit("2001-13-01"), "period_end": day, "game_scope": F.lit("all"), "metric": F.lit("sales"), "value": F.lit("1.5"), "unit": F.lit("EUR")}),
    }
    which = F.col("o_orderkey") % 7
    dataset = payload = None
    for k, (name, values) in fields.items():
        text = F.to_json(F.struct(*[v.alias(n) for n, v in values.items()]))
        dataset = F.when(which == k, name) if dataset is None else dataset.when(which == k, name)
        payload = F.when(which == k, text) if payload is None else payload.when(which == k, text)
    return rel.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"), dataset.alias("dataset"), F.col("o_orderkey").cast("string").alias("record_key"), payload.alias("payload")
    )


@query(
    "B7_curated_rules",
    "k:i reasons:a",
    """SELECT k, CASE c WHEN 0 THEN ['bad_interval'] WHEN 1 THEN [] WHEN 2 THEN ['scheduled_not_boolean'] WHEN 3 THEN ['online_county', 'private_field']
       WHEN 4 THEN ['bad_channel'] WHEN 5 THEN ['bad_value', 'missing_keys'] ELSE ['bad_date'] END AS reasons FROM curated_rows""",
)
def curated_rules(spark, d):
    return validate.check_curated(curated_rows(spark, d))


@query("B8_private_fields", "k:i", "SELECT k FROM curated_rows WHERE c = 3")
def private_fields(spark, d):
    return curated_rows(spark, d).filter(validate.private_fields(F.col("payload")))


@query(
    "B9_rule_definitions",
    "game:s code:s reasons:a",
    """WITH y AS (SELECT game, year(draw_date) AS y, min(draw_date) AS a, max(draw_date) AS b FROM day_draws GROUP BY 1, 2)
       ;; SELECT game, CASE WHEN y % 3 = 0 THEN 'Y' ELSE 'Y' || y END AS code, list_concat(CASE WHEN y % 4 = 0 AND a <> b THEN ['bad_interval'] ELSE [] END, CASE WHEN y % 2 = 0 THEN ['bad_weekday'] ELSE [] END,
       CASE WHEN y % 3 = 0 AND count(*) OVER (PARTITION BY game, y % 3 = 0) > 1 THEN ['duplicate_code'] ELSE [] END,
       CASE WHEN y % 5 = 0 THEN ['duplicate_weekday', 'small_pool'] ELSE [] END) AS reasons FROM y""",
)
def rule_definitions(spark, d):
    y = F.col("y")
    spans = rel.draws(spark, d, "day").groupBy("game", F.year("draw_date").alias("y")).agg(F.min("draw_date").alias("a"), F.max("draw_date").alias("b"))
    rules = spans.select(
        "game",
        F.when(y % 3 == 0, "Y").otherwise(F.concat(F.lit("Y"), y.cast("string"))).alias("code"),
        F.when(y % 4 == 0, F.col("b")).otherwise(F.col("a")).alias("starts_on"),
        F.when(y % 4 == 0, F.col("a")).otherwise(F.col("b")).alias("ends_on"),
        F.when(y % 5 == 0, 6).otherwise(47).alias("pool"),
        F.when(y % 10 == 0, F.array(F.lit(7), F.lit(7))).when(y % 5 == 0, F.array(F.lit(1), F.lit(1))).when(y % 2 == 0, F.array(F.lit(7))).otherwise(F.array(F.lit(0))).alias("schedule"),
    )
    return validate.check_rules(rules)


@query(
    "B22_binding_validity",
    "game:s rule_code:s draws:i reasons:a",
    """SELECT b.game, b.code AS rule_code, count(w.draw_date) AS draws, CASE WHEN b.game = 'O' THEN ['bad_hash', 'duplicate_code'] ELSE [] END AS reasons FROM
       (SELECT * FROM bound_rules WHERE artifact_sha256 IS NOT NULL UNION ALL SELECT * FROM bound_rules WHERE game = 'O' AND code = 'R1') b
       LEFT JOIN week_draws w ON w.game = b.game GROUP BY b.game, b.code""",
)
def binding_validity(spark, d):
    rows = bindings(spark)
    sha = F.when(F.col("game") == "O", F.upper("artifact_sha256")).otherwise(F.col("artifact_sha256"))
    doubled = rows.unionByName(rows.filter("game = 'O'")).withColumn("artifact_sha256", sha)
    checked = validate.check_bindings(doubled)
    draws = rel.draws(spark, d).select("game", "draw_date")
    return checked.join(draws, "game").groupBy("game", "rule_code", "reasons").agg(F.count("*").alias("draws"))


@query(
    "B11_observation_consistency",
    "game:s differing:i draws:i",
    "SELECT game, count(*) FILTER (WHERE list_contains(reasons, 'observation_mismatch')) AS differing, count(*) AS draws FROM assessed GROUP BY 1",
)
def observation_consistency(spark, d):
    from drawloom.plans.catalog.audit import assessed

    return assessed(spark, d).groupBy("game").agg(
        F.count_if(F.array_contains("reasons", "observation_mismatch")).alias("differing"), F.count("*").alias("draws")
    )


@query(
    "B12_population_filter",
    "game:s draw_date:s mains:a",
    "SELECT game, draw_date, mains FROM week_draws WHERE game = 'F' AND draw_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'",
)
def population_filter(spark, d):
    return rel.draws(spark, d).filter("game = 'F' and draw_date between date'1997-01-01' and date'1998-12-31'")


@query(
    "B13_json_path_predicate",
    "event_type:s rows:i large:i known_game:i",
    """SELECT event_type, count(*) AS rows, count(*) FILTER (WHERE CAST(json_extract_string(props, '$.k') AS INT) >= 50) AS large,
       count(*) FILTER (WHERE coalesce(json_extract_string(props, '$.game'), 'lotto') = 'lotto') AS known_game FROM events GROUP BY 1""",
)
def json_path_predicate(spark, d):
    payload = F.from_json("props", "k INT, game STRING")
    rows = rel.table(spark, d, "events").select("event_type", payload.alias("p"))
    return rows.groupBy("event_type").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("p.k") >= 50).alias("large"),
        F.count_if(F.coalesce("p.game", F.lit("lotto")) == "lotto").alias("known_game"),
    )


RELATIONS["date_texts"] = """
SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN strftime(o_orderdate, '%d/%m/%y') WHEN 2 THEN strftime(o_orderdate, '%Y-02-30')
  WHEN 3 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 4 THEN 'Lotto for ' || CAST(day(o_orderdate) AS VARCHAR) || 'th ' || strftime(o_orderdate, '%B %Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS text FROM orders
"""


def date_texts(spark, d):
    o, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    text = (
        F.when(k == 1, F.date_format(o, "dd/MM/yy"))
        .when(k == 2, F.date_format(o, "yyyy-02-30"))
        .when(k == 3, F.date_format(o, "dd-MM-yyyy"))
        .when(k == 4, F.concat(F.lit("Lotto for "), F.dayofmonth(o).cast("string"), F.lit("th "), F.date_format(o, "MMMM yyyy")))
        .when(k == 5, F.date_format(o, "yyyy-MM-dd"))
    )
    return rel.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), text.alias("text"))


@query(
    "B14_date_classes",
    "k:i date_class:s",
    "SELECT k, CASE k % 6 WHEN 0 THEN 'undated' WHEN 2 THEN 'impossible' WHEN 5 THEN 'dated' ELSE 'malformed' END AS date_class FROM date_texts",
)
def date_classes(spark, d):
    return date_texts(spark, d).withColumn("date_class", validate.date_class(F.col("text")))


@query("H5_date_parse", "k:i day:s", "SELECT k, CASE WHEN k % 6 NOT IN (0, 2) THEN day END AS day FROM date_texts")
def date_parse(spark, d):
    return date_texts(spark, d).withColumn("day", sc.published_date(F.col("text")))


@query("B15_upper_cutoff", "game:s draws:i last:s", "SELECT game, count(*) AS draws, max(draw_date) AS last FROM day_draws WHERE draw_date <= DATE '1999-06-30' GROUP BY 1")
def upper_cutoff(spark, d):
    kept = rel.draws(spark, d, "day").filter("draw_date <= date'1999-06-30'")
    return kept.groupBy("game").agg(F.count("*").alias("draws"), F.max("draw_date").alias("last"))


@query(
    "B16_schedule_exceptions",
    "game:s draw_date:s rule_code:s",
    """SELECT d.game, d.draw_date, r.code AS rule_code FROM day_draws d JOIN rule_rows r ON r.game = d.game AND d.draw_date >= r.starts_on AND (r.ends_on IS NULL OR d.draw_date <= r.ends_on)
       WHERE isodow(d.draw_date) - 1 NOT IN (0, 2, 5)""",
)
def schedule_exceptions(spark, d):
    ruled = intervals.attach_rule(rel.draws(spark, d, "day"), rel.rules(spark, (0, 2, 5))).filter("rule_count = 1")
    return ruled.filter(~F.array_contains("schedule", F.weekday("draw_date")))


@query(
    "B21_regime_purity",
    "game:s regimes:i pools:i extra_dates:i missing_dates:i",
    """SELECT game, count(DISTINCT rule_code) AS regimes, count(DISTINCT pool) AS pools, 0 AS extra_dates,
       (SELECT count(*) FROM day_draws d WHERE d.game = p.game AND d.draw_date BETWEEN DATE '1998-07-01' AND DATE '1998-12-31') AS missing_dates FROM day_pop p GROUP BY 1""",
)
def regime_purity(spark, d):
    """Population against a frozen list of dates: two-way multiset difference."""
    population = rel.population(spark, d, "day")
    frozen = rel.draws(spark, d, "day").select("game", "draw_date")
    mine = population.select("game", "draw_date")
    one_way = mine.exceptAll(frozen).withColumn("side", F.lit("extra"))
    other = frozen.exceptAll(mine).withColumn("side", F.lit("missing"))
    counts = one_way.unionByName(other).groupBy("game").agg(
        F.count_if(F.col("side") == "extra").alias("extra_dates"), F.count_if(F.col("side") == "missing").alias("missing_dates")
    )
    pure = population.groupBy("game").agg(F.countDistinct("rule_code").alias("regimes"), F.countDistinct("pool").alias("pools"))
    return pure.join(counts, "game", "left").na.fill(0)


@query(
    "B23_history_cut",
    "game:s draw_date:s history:i last_input:s",
    """SELECT game, draw_date, count(*) OVER p AS history, max(draw_date) OVER p AS last_input FROM week_pop
       WINDOW p AS (PARTITION BY game ORDER BY draw_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def history_cut(spark, d):
    from drawloom.operators.features import sequence_draws

    seq = sequence_draws(rel.population(spark, d))
    return seq.select("game", "draw_date", F.col("draw_idx").alias("history"), F.col("max_input_date").alias("last_input"))


# --- scalar functions ----------------------------------------------------------------

RELATIONS["price_texts"] = """
SELECT o_orderkey AS k, o_totalprice AS p, CASE o_orderkey % 4 WHEN 0 THEN '€' || format('{:,.2f}', o_totalprice) WHEN 1 THEN 'won £ ' || format('{:,.2f}', o_totalprice) || ' ticket'
  WHEN 2 THEN 'none' ELSE '€' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ' plus Quick Pick' END AS text FROM orders
"""


def price_texts(spark, d):
    p, k = F.col("o_totalprice"), F.col("o_orderkey") % 4
    money = F.format_number(p, 2)
    text = (
        F.when(k == 0, F.concat(F.lit("€"), money))
        .when(k == 1, F.concat(F.lit("won £ "), money, F.lit(" ticket")))
        .when(k == 2, "none")
        .otherwise(F.concat(F.lit("€"), F.floor(p).cast("string"), F.lit(" plus Quick Pick")))
    )
    return rel.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), text.alias("text"))


@query(
    "H1_money_parse",
    "k:i amount:f currency:s",
    """SELECT k, CASE k % 4 WHEN 2 THEN NULL WHEN 3 THEN floor(p) ELSE round(p, 2) END AS amount, CASE k % 4 WHEN 1 THEN 'POUND_UNRESOLVED' WHEN 2 THEN NULL ELSE 'EUR' END AS currency FROM price_texts""",
)
def money_parse(spark, d):
    t = F.col("text")
    return price_texts(spark, d).select("k", sc.money_amount(t).alias("amount"), sc.money_currency(t).alias("currency"))


@query(
    "H2_published_labels",
    "k:i tier:s prize_kind:s winners:i",
    """SELECT k, CASE WHEN k % 2 = 0 THEN 'Match 6' ELSE 'Match 5 + Bonus' END AS tier, CASE WHEN k % 4 IN (1, 3) THEN 'ticket_or_cash' ELSE 'unresolved' END AS prize_kind,
       CASE WHEN k % 5 <> 0 THEN k END AS winners FROM price_texts""",
)
def published_labels(spark, d):
    k = F.col("k")
    label = F.when(k % 2 == 0, "Jackpot").otherwise("Match 5   plus Bonus")
    winners = F.when(k % 5 == 0, "n/a").otherwise(F.format_number(k, 0))
    return price_texts(spark, d).select(
        "k", sc.tier_name(label).alias("tier"), sc.prize_kind(F.col("text")).alias("prize_kind"), sc.winner_count(winners).alias("winners")
    )


@query(
    "H4_iso_calendar",
    "day:s iso_year:i iso_week:i weekday:i",
    "SELECT DISTINCT draw_date AS day, isoyear(draw_date) AS iso_year, weekofyear(draw_date) AS iso_week, isodow(draw_date) - 1 AS weekday FROM day_draws",
)
def iso_calendar(spark, d):
    days = rel.draws(spark, d, "day").select(F.col("draw_date").alias("day")).distinct()
    return days.select("day", *[c.alias(n) for n, c in sc.iso_fields(F.col("day")).items()])


@query(
    "H7_pre_euro_blanking",
    "game:s draw_date:s jackpot:f currency:s",
    "SELECT game, draw_date, CASE WHEN draw_date >= DATE '1999-01-01' THEN jackpot END AS jackpot, CASE WHEN draw_date >= DATE '1999-01-01' THEN 'EUR' END AS currency FROM context_rows",
)
def pre_euro_blanking(spark, d):
    """Amounts published before a currency start date are blanked (the start date is a parameter)."""
    known = F.col("draw_date") >= "1999-01-01"
    return rel.context_rows(spark, d).select("game", "draw_date", F.when(known, F.col("jackpot")).alias("jackpot"), F.when(known, "EUR").alias("currency"))


@query(
    "H8_array_descriptors",
    "game:s draw_date:s main_sum:i odd_count:i adjacent_pairs:i",
    """SELECT game, draw_date, list_sum(mains) AS main_sum, mains[1] % 2 + mains[2] % 2 + mains[3] % 2 + mains[4] % 2 + mains[5] % 2 + mains[6] % 2 AS odd_count,
       CAST(mains[2] - mains[1] = 1 AS INT) + CAST(mains[3] - mains[2] = 1 AS INT) + CAST(mains[4] - mains[3] = 1 AS INT) + CAST(mains[5] - mains[4] = 1 AS INT) + CAST(mains[6] - mains[5] = 1 AS INT) AS adjacent_pairs FROM day_draws""",
)
def array_descriptors(spark, d):
    m = F.col("mains")
    return rel.draws(spark, d, "day").select(
        "game", "draw_date", sc.main_sum(m).alias("main_sum"), sc.odd_count(m).alias("odd_count"), sc.adjacent_pairs(m).alias("adjacent_pairs")
    )


@query(
    "H10_natural_key",
    "page_id:i observation_key:s",
    """SELECT page_id, sha256('{"artifact_sha256":"' || sha256(html) || '","parser_version":"1","record_key":"' || CAST(page_id AS VARCHAR) || '","source":"web","url":"' || url || '"}') AS observation_key FROM pages""",
)
def natural_key(spark, d):
    page = F.col("page_id").cast("string")
    key = sc.natural_key(F.lit("web"), F.col("url"), F.sha2("html", 256), F.lit("1"), page)
    return rel.table(spark, d, "pages").select("page_id", key.alias("observation_key"))


@query(
    "H11_canonical_json",
    "event_id:i body:s",
    """SELECT event_id, '{"amount":"' || CAST(CAST(round(value, 2) AS DECIMAL(18,2)) AS VARCHAR) || '","day":"' || CAST(CAST(ts AS DATE) AS VARCHAR) || '","kind":"' || event_type || '","seen":"' || strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') || '","unknown":null}' AS body FROM events""",
)
def canonical_json(spark, d):
    amount = F.round("value", 2).cast("decimal(18,2)").cast("string")
    body = sc.canonical_json(
        {"unknown": F.lit(None).cast("string"), "seen": F.date_trunc("second", "ts"), "kind": F.col("event_type"), "day": F.to_date("ts"), "amount": amount}
    )
    return rel.table(spark, d, "events").select("event_id", body.alias("body"))


@query(
    "H12_deadline_instant",
    "game:s draw_date:s deadline:s",
    f"""SELECT game, draw_date, strftime(CASE WHEN {_h(1)} = '0' THEN CAST(draw_date AS TIMESTAMP) + INTERVAL 12 HOUR ELSE timezone('UTC', timezone('Europe/Dublin', CAST(draw_date AS TIMESTAMP) + INTERVAL 1185 MINUTE)) END, '%Y-%m-%d %H:%M:%S') AS deadline FROM week_draws""",
)
def deadline_instant(spark, d):
    override = F.when(digit(1) == "0", F.to_timestamp(F.concat_ws(" ", F.col("draw_date").cast("string"), F.lit("12:00:00"))))
    at = sc.deadline_instant(F.col("draw_date"), F.lit("19:45:00"), F.lit("Europe/Dublin"), override)
    return rel.draws(spark, d).select("game", "draw_date", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("deadline"))


@query(
    "H13_hash_uniform",
    "event_id:i u:f",
    "SELECT event_id, CAST('0x' || substr(sha256('root|' || event_type || '|' || CAST(event_id AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM events",
)
def hash_uniform(spark, d):
    return rel.table(spark, d, "events").select("event_id", sc.unit_uniform("root", F.col("event_type"), F.col("event_id")).alias("u"))


@query(
    "H14_jackpot_share",
    "game:s draw_date:s share:f",
    "SELECT game, draw_date, CASE WHEN winners IS NULL OR winners = 0 THEN 1 ELSE (1 - exp(-winners * 1000 / 10737573.0)) / (winners * 1000 / 10737573.0) END AS share FROM tier_rows WHERE tier = 'Match 3'",
)
def jackpot_share(spark, d):
    rows = rel.tier_rows(spark, d).filter("tier = 'Match 3'")
    share = sc.jackpot_share((F.col("winners") * 1000).cast("double"), sc.match_probability(F.lit(47), 6))
    return rows.select("game", "draw_date", share.alias("share"))


@query(
    "H17_figure_precision",
    "k:i increment:f",
    "SELECT k, CASE k % 4 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0.01 END AS increment FROM price_texts",
)
def figure_precision(spark, d):
    figure = F.regexp_extract("text", r"([\d,]+(?:\.\d+)?)", 1)
    return price_texts(spark, d).select("k", sc.figure_precision(figure).alias("increment"))


@query(
    "H18_json_access",
    "event_type:s k_sum:i k_max:i",
    "SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_sum, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_max FROM events GROUP BY 1",
)
def json_access(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return rel.table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


# --- joins and set operations ------------------------------------------------------------


@query(
    "C5_result_exists",
    "game:s draw_date:s has_prizes:i",
    "SELECT game, draw_date, CAST(EXISTS (SELECT 1 FROM prize_facts p WHERE p.game = w.game AND p.draw_date = w.draw_date AND p.tier = 'Match 6' AND p.winners > 0) AS INT) AS has_prizes FROM week_draws w",
)
def result_exists(spark, d):
    won = rel.prize_facts(spark, d).filter("tier = 'Match 6' and winners > 0").select("game", "draw_date").distinct().withColumn("_w", F.lit(True))
    return rel.draws(spark, d).join(won, ["game", "draw_date"], "left").withColumn("has_prizes", F.col("_w").isNotNull())


@query(
    "C7_membership",
    "source:s observations:i",
    "SELECT source, count(*) AS observations FROM sightings s WHERE (game, draw_date) IN (SELECT game, draw_date FROM canonical WHERE status = 'quarantined') GROUP BY 1",
)
def membership(spark, d):
    from drawloom.operators.reconcile import canonical_draws

    disputed = canonical_draws(staged(spark, d)).filter("status = 'quarantined'")
    return rel.sightings(spark, d).join(disputed, ["game", "draw_date"], "left_semi").groupBy("source").agg(F.count("*").alias("observations"))


@query(
    "C8_long_to_wide",
    "game:s draw_date:s mains:a bonus:i",
    "SELECT game, draw_date, mains, bonus FROM day_draws",
)
def long_to_wide(spark, d):
    main = F.col("role") == "main"
    return rel.draw_numbers(spark, d, "day").groupBy("game", "draw_date").agg(
        F.array_sort(F.collect_list(F.when(main, F.col("number")))).alias("mains"), F.max(F.when(~main, F.col("number"))).alias("bonus")
    )


@query(
    "C21_positional_lookup",
    "artifact_index:i url:s records:i",
    """WITH a AS (SELECT row_number() OVER (ORDER BY page_id) - 1 AS i, url FROM pages), r AS (SELECT o_orderkey % 300 AS i, count(*) AS n FROM orders GROUP BY 1)
       ;; SELECT r.i AS artifact_index, a.url, r.n AS records FROM r LEFT JOIN a ON a.i = r.i""",
)
def positional_lookup(spark, d):
    """Records point at a position of the page list; positions beyond it have no address."""
    pages = rel.table(spark, d, "pages").select(F.col("page_id").alias("artifact_index"), "url")
    records = rel.table(spark, d, "orders").groupBy((F.col("o_orderkey") % 300).alias("artifact_index")).agg(F.count("*").alias("records"))
    return records.join(pages, "artifact_index", "left")


@query(
    "G1_union_enrichment",
    "kind:s game:s rows:i amount:f",
    """SELECT 'prize' AS kind, game, count(*) AS rows, sum(CAST(amount AS DOUBLE)) AS amount FROM prize_facts GROUP BY game
       UNION ALL SELECT 'context', game, count(*), sum(CAST(jackpot AS DOUBLE)) FROM context_rows GROUP BY game""",
)
def union_enrichment(spark, d):
    prizes = rel.prize_facts(spark, d).select(F.lit("prize").alias("kind"), "game", "draw_date", "tier", "amount")
    context = rel.context_rows(spark, d).select(F.lit("context").alias("kind"), "game", "draw_date", F.lit("jackpot").alias("tier"), F.col("jackpot").alias("amount"))
    both = prizes.unionByName(context)
    return both.groupBy("kind", "game").agg(F.count("*").alias("rows"), F.sum("amount").alias("amount"))


@query(
    "G2_set_difference",
    "game:s day:s",
    "SELECT game, draw_date AS day FROM day_draws EXCEPT SELECT game, draw_date FROM week_draws",
)
def set_difference(spark, d):
    return rel.draws(spark, d, "day").select("game", F.col("draw_date").alias("day")).subtract(rel.draws(spark, d).select("game", "draw_date"))


@query(
    "G3_set_equality",
    "only_left:i only_right:i",
    """SELECT (SELECT count(*) FROM (SELECT game, draw_date FROM week_draws EXCEPT ALL SELECT game, draw_date FROM context_rows)) AS only_left,
       (SELECT count(*) FROM (SELECT game, draw_date FROM context_rows EXCEPT ALL SELECT game, draw_date FROM week_draws)) AS only_right""",
)
def set_equality(spark, d):
    a, b = rel.draws(spark, d).select("game", "draw_date"), rel.context_rows(spark, d).select("game", "draw_date")
    sides = a.exceptAll(b).withColumn("s", F.lit("l")).unionByName(b.exceptAll(a).withColumn("s", F.lit("r")))
    return sides.agg(F.count_if(F.col("s") == "l").alias("only_left"), F.count_if(F.col("s") == "r").alias("only_right"))


@query("G5_distinct", "game:s number:i", "SELECT DISTINCT game, number FROM week_numbers")
def distinct(spark, d):
    return rel.draw_numbers(spark, d).select("game", "number").distinct()


@query("F1_total_order", "game:s draw_date:s number:i role:s", "SELECT game, draw_date, number, role FROM week_numbers")
def total_order(spark, d):
    return rel.draw_numbers(spark, d).orderBy("game", "draw_date", "role", "number")


@query(
    "F2_top_candidates",
    "game:s number:i marginal:f",
    """SELECT * FROM (SELECT game, number, (c + 6.0 / 47) / (n + 1) AS marginal FROM (SELECT game, number, count(*) AS c FROM (SELECT game, unnest(mains) AS number FROM week_pop) GROUP BY 1, 2) x
       JOIN (SELECT game, count(*) AS n FROM week_pop GROUP BY 1) y USING (game) ORDER BY marginal DESC, game, number LIMIT 10)""",
)
def top_candidates(spark, d):
    from drawloom.operators.features import frequency_marginals

    return frequency_marginals(rel.population(spark, d)).orderBy(F.desc("marginal"), "game", "number").limit(10)


@query(
    "F3_extreme_row_by_key",
    "game:s best_number:i best_count:i rarest_number:i",
    """WITH c AS (SELECT game, number, count(*) AS n FROM (SELECT game, unnest(mains) AS number FROM day_draws) GROUP BY 1, 2)
       ;; SELECT game, arg_max(number, n * 100 - number) AS best_number, max(n) AS best_count, arg_min(number, n * 100 + number) AS rarest_number FROM c GROUP BY 1""",
)
def extreme_row(spark, d):
    counts = rel.draws(spark, d, "day").select("game", F.explode("mains").alias("number")).groupBy("game", "number").agg(F.count("*").alias("n"))
    return counts.groupBy("game").agg(
        F.max_by("number", F.struct("n", -F.col("number"))).alias("best_number"),
        F.max("n").alias("best_count"),
        F.min_by("number", F.struct("n", "number")).alias("rarest_number"),
    )


@query(
    "D11_ordered_array",
    "game:s year:i dates:a",
    f"SELECT game, year(draw_date) AS year, list_sort(list(CAST(draw_date AS VARCHAR)) FILTER (WHERE {_h(1)} = '0')) AS dates FROM week_draws GROUP BY 1, 2 HAVING count(*) FILTER (WHERE {_h(1)} = '0') > 0",
)
def ordered_array(spark, d):
    """At most one date per day of the year enters an array."""
    day = F.when(digit(1) == "0", F.col("draw_date").cast("string"))
    grouped = rel.draws(spark, d).groupBy("game", F.year("draw_date").alias("year")).agg(F.array_sort(F.collect_list(day)).alias("dates"))
    return grouped.filter(F.size("dates") > 0)
