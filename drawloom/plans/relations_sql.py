"""The relations of ``relations.py`` as plain SQL, used only by the checking queries."""

_NUMBERS = """
SELECT game, draw_date, number, CASE WHEN rn <= 6 THEN 'main' ELSE 'bonus' END AS role FROM (
  SELECT game, draw_date, number,
         row_number() OVER (PARTITION BY game, draw_date ORDER BY k, number) AS rn,
         count(*) OVER (PARTITION BY game, draw_date) AS c
  FROM (SELECT l_linestatus AS game, CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS draw_date,
               CAST(l_partkey % 47 + 1 AS INT) AS number, min(l_orderkey * 8 + l_linenumber) AS k
        FROM lineitem GROUP BY 1, 2, 3) n) r
WHERE rn <= 7 AND c >= 7
"""

_WIDE = """
SELECT game, draw_date, list_sort(list(number) FILTER (WHERE role = 'main')) AS mains,
       max(CASE WHEN role = 'bonus' THEN number END) AS bonus
FROM {numbers} GROUP BY 1, 2
"""

RELATIONS = {
    "week_numbers": _NUMBERS.format(unit="week"),
    "week_draws": _WIDE.format(numbers="week_numbers"),
    "day_numbers": _NUMBERS.format(unit="day"),
    "day_draws": _WIDE.format(numbers="day_numbers"),
    "rule_rows": """
SELECT g.game, r.code, r.starts_on, r.ends_on, r.pool FROM (VALUES ('F'), ('O')) g(game),
 (VALUES ('R1', DATE '1990-01-01', DATE '1998-06-30', 47),
         ('R2', DATE '1999-01-01', CAST(NULL AS DATE), 47)) r(code, starts_on, ends_on, pool)
""",
    "keyed": """
SELECT *, substr(md5(concat(game, '|', CAST(draw_date AS VARCHAR))), 1, 1) AS h1,
       substr(md5(concat(game, '|', CAST(draw_date AS VARCHAR))), 2, 1) AS h2,
       substr(md5(concat(game, '|', CAST(draw_date AS VARCHAR))), 3, 1) AS h3
FROM week_draws
""",
    "sightings": """
SELECT 'a' AS source, 1 AS arrival_seq, game, draw_date, mains,
       CASE WHEN h1 IN ('0','1','2','3') THEN NULL ELSE bonus END AS bonus FROM keyed
UNION ALL
SELECT 'b', 2, game, draw_date,
       CASE WHEN h2 = '0' THEN list_sort(list_append(mains[2:6], bonus)) ELSE mains END,
       CASE WHEN h2 = '0' THEN NULL ELSE bonus END FROM keyed
UNION ALL
SELECT 'c', 3, game, draw_date, mains,
       CASE WHEN h3 = '1' THEN CAST(bonus % 47 + 1 AS INT) ELSE bonus END FROM keyed
UNION ALL
SELECT 'd', 4, game, draw_date, mains, bonus FROM keyed WHERE h2 IN ('0', '1') OR h3 = '1'
""",
    "staged_sightings": """
SELECT s.*, CASE WHEN r.code IS NULL THEN 'unverified_rule'
                 WHEN s.bonus IS NOT NULL AND list_contains(s.mains, s.bonus) THEN 'invalid_numbers' END AS issue
FROM sightings s LEFT JOIN rule_rows r ON r.game = s.game AND s.draw_date >= r.starts_on
 AND (r.ends_on IS NULL OR s.draw_date <= r.ends_on)
""",
    "sighting_pivot": """
SELECT game, draw_date,
  max(CASE WHEN rn = 1 THEN mains END) AS m1, max(CASE WHEN rn = 1 THEN bonus END) AS b1, max(CASE WHEN rn = 1 THEN arrival_seq END) AS q1,
  max(CASE WHEN rn = 2 THEN mains END) AS m2, max(CASE WHEN rn = 2 THEN bonus END) AS b2, max(CASE WHEN rn = 2 THEN arrival_seq END) AS q2,
  max(CASE WHEN rn = 3 THEN mains END) AS m3, max(CASE WHEN rn = 3 THEN bonus END) AS b3, max(CASE WHEN rn = 3 THEN arrival_seq END) AS q3,
  max(CASE WHEN rn = 4 THEN mains END) AS m4, max(CASE WHEN rn = 4 THEN bonus END) AS b4, max(CASE WHEN rn = 4 THEN arrival_seq END) AS q4
FROM (SELECT *, row_number() OVER (PARTITION BY game, draw_date ORDER BY arrival_seq) AS rn
      FROM staged_sightings WHERE issue IS NULL) v
GROUP BY 1, 2
""",
    "fold_2": """
SELECT *, m2 IS NOT NULL AND (m2 <> m1 OR coalesce(b2 <> b1, FALSE)) AS c2 FROM sighting_pivot
""",
    "fold_3": """
SELECT *, m3 IS NOT NULL AND (m3 <> m1 OR coalesce(b3 <> s2, FALSE)) AS c3 FROM (
  SELECT *, CASE WHEN b1 IS NULL AND NOT c2 THEN b2 ELSE b1 END AS s2, c2 AS d2 FROM fold_2) x
""",
    "fold_4": """
SELECT *, d3 OR c4 AS d4, CASE WHEN s3 IS NULL AND NOT c4 AND NOT d3 THEN b4 ELSE s3 END AS s4 FROM (
  SELECT *, m4 IS NOT NULL AND (m4 <> m1 OR coalesce(b4 <> s3, FALSE)) AS c4 FROM (
    SELECT *, CASE WHEN s2 IS NULL AND NOT c3 AND NOT d2 THEN b3 ELSE s2 END AS s3, d2 OR c3 AS d3 FROM fold_3) x) y
""",
    "canonical": """
SELECT game, draw_date, m1 AS mains, s4 AS bonus, q1 AS accepted_seq,
       CASE WHEN d4 THEN 'quarantined' ELSE 'accepted' END AS status FROM fold_4
""",
    "tier_rows": """
SELECT t.game, t.draw_date,
  CASE t.line WHEN 1 THEN 'Match 6' WHEN 2 THEN 'Match 5 + Bonus' WHEN 3 THEN 'Match 5' WHEN 4 THEN 'Match 4 + Bonus'
              WHEN 5 THEN 'Match 4' WHEN 6 THEN 'Match 3 + Bonus' ELSE 'Match 3' END AS tier,
  CASE WHEN t.line = 1 THEN CASE WHEN t.cnt % 3 = 0 THEN 1 ELSE 0 END ELSE t.cnt END AS seen,
  CASE WHEN t.cnt % 5 = 0 THEN NULL
       WHEN t.line = 1 THEN CASE WHEN t.cnt % 3 = 0 THEN 1 ELSE 0 END ELSE t.cnt END AS winners,
  t.amount, t.hex
FROM (SELECT l_linestatus AS game, CAST(date_trunc('week', l_shipdate) AS DATE) AS draw_date, l_linenumber AS line,
             CAST(count(*) AS INT) AS cnt, CAST(max(l_extendedprice) AS DECIMAL(18,2)) AS amount,
             substr(md5(concat(l_linestatus, '|', CAST(CAST(date_trunc('week', l_shipdate) AS DATE) AS VARCHAR), '|', CAST(l_linenumber AS VARCHAR))), 1, 1) AS hex
      FROM lineitem GROUP BY 1, 2, 3) t
""",
    "prize_facts": """
SELECT game, draw_date, tier, winners, amount, 'EUR' AS currency,
       CASE WHEN tier = 'Match 6' THEN 'cash' ELSE 'unresolved' END AS prize_type FROM tier_rows
""",
    "prize_sightings": """
SELECT game, draw_date, tier, 1 AS arrival_seq, winners, amount, 'EUR' AS currency,
       CASE WHEN tier = 'Match 6' THEN 'cash' ELSE 'unresolved' END AS prize_type FROM tier_rows
UNION ALL
SELECT game, draw_date, tier, 2, seen, CASE WHEN hex IN ('0','1','2','3','4') THEN NULL ELSE amount END, 'EUR',
       CASE WHEN hex IN ('e','f') THEN 'cash' ELSE 'unresolved' END FROM tier_rows
UNION ALL
SELECT game, draw_date, tier, 3, CAST(seen + CASE WHEN hex = '7' THEN 1 ELSE 0 END AS INT), amount, 'EUR',
       CASE WHEN hex IN ('a','b','4') THEN 'ticket_or_cash' ELSE 'unresolved' END FROM tier_rows
UNION ALL
SELECT game, draw_date, tier, 4, seen, amount, 'EUR', 'cash' FROM tier_rows
""",
    "context_rows": """
SELECT game, draw_date, CAST(round(sum(amount)) AS DECIMAL(18,2)) AS jackpot,
       max(CASE WHEN tier = 'Match 6' THEN CASE winners WHEN 1 THEN 'Won' WHEN 0 THEN 'Roll' END END) AS outcome,
       substr(md5(concat('c|', game, '|', CAST(draw_date AS VARCHAR))), 1, 1) AS hex
FROM tier_rows GROUP BY 1, 2
""",
    "context_sightings": """
SELECT game, draw_date, 1 AS arrival_seq, jackpot, CAST(NULL AS VARCHAR) AS currency, CASE WHEN hex < '8' THEN outcome END AS outcome FROM context_rows
UNION ALL
SELECT game, draw_date, 2, jackpot, 'EUR', CASE WHEN hex IN ('0','9') THEN 'Roll' ELSE outcome END FROM context_rows
UNION ALL
SELECT game, draw_date, 3, CASE WHEN hex = 'c' THEN jackpot + 1 ELSE jackpot END, 'EUR', outcome FROM context_rows
""",
    "week_pop": """
SELECT game, 'ALL' AS rule_code, draw_date, 47 AS pool, mains, bonus,
       coalesce(date_diff('day', lag(draw_date) OVER (PARTITION BY game ORDER BY draw_date), draw_date) > 7, FALSE) AS gap_before,
       CAST(row_number() OVER (PARTITION BY game ORDER BY draw_date) - 1 AS INT) AS draw_idx
FROM week_draws
""",
    "day_pop": """
SELECT game, rule_code, draw_date, 47 AS pool, mains, bonus,
       coalesce(date_diff('day', lag(draw_date) OVER (PARTITION BY game, rule_code ORDER BY draw_date), draw_date) > 1, FALSE) AS gap_before,
       CAST(row_number() OVER (PARTITION BY game, rule_code ORDER BY draw_date) - 1 AS INT) AS draw_idx
FROM (SELECT d.*, r.code AS rule_code FROM day_draws d JOIN rule_rows r ON r.game = d.game AND d.draw_date >= r.starts_on
      AND (r.ends_on IS NULL OR d.draw_date <= r.ends_on)) x
""",
}

_FEATURES = """
SELECT game, rule_code, draw_idx, draw_date, max_input_date, pool, number, hit,
  f10 AS freq_10, f25 AS freq_25, f50 AS freq_50, f100 AS freq_100,
  CAST(coalesce(least(draw_idx - last_idx, 100), 100) AS DOUBLE) AS recency,
  CASE WHEN last_idx IS NULL THEN 1.0 ELSE 0.0 END AS never_seen,
  CASE WHEN v1 THEN l1 ELSE 0 END AS lag_1, CASE WHEN v2 THEN l2 ELSE 0 END AS lag_2, CASE WHEN v3 THEN l3 ELSE 0 END AS lag_3,
  CAST(v1 AS INT) AS lag_1_valid, CAST(v2 AS INT) AS lag_2_valid, CAST(v3 AS INT) AS lag_3_valid,
  f10 - f100 AS freq_10_minus_100, (cnt + 6.0 / pool) / (draw_idx + 1) AS smoothed_frequency,
  date_diff('day', max_input_date, draw_date) AS days_since_prior, isodow(draw_date) - 1 AS weekday
FROM (
  SELECT game, rule_code, draw_idx, draw_date, pool, number, hit, max_input_date, v1, v2, v3,
    avg(hit) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS f10,
    avg(hit) OVER (w ROWS BETWEEN 25 PRECEDING AND 1 PRECEDING) AS f25,
    avg(hit) OVER (w ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS f50,
    avg(hit) OVER (w ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS f100,
    max(CASE WHEN hit = 1 THEN draw_idx END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_idx,
    sum(hit) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cnt,
    lag(hit, 1) OVER w AS l1, lag(hit, 2) OVER w AS l2, lag(hit, 3) OVER w AS l3
  FROM (
    SELECT p.*, n.number, CAST(list_contains(p.mains, n.number) AS INT) AS hit FROM (
      SELECT *, lag(draw_date) OVER s AS max_input_date,
        draw_idx >= 1 AND NOT gap_before AS v1,
        draw_idx >= 2 AND NOT gap_before AND NOT lag(gap_before, 1) OVER s AS v2,
        draw_idx >= 3 AND NOT gap_before AND NOT lag(gap_before, 1) OVER s AND NOT lag(gap_before, 2) OVER s AS v3
      FROM {pop} WINDOW s AS (PARTITION BY game, rule_code ORDER BY draw_date)) p,
      (SELECT CAST(range AS INT) AS number FROM range(1, 48)) n) h
  WINDOW w AS (PARTITION BY game, rule_code, number ORDER BY draw_idx)) f
WHERE draw_idx >= 1
"""
RELATIONS["week_features"] = _FEATURES.format(pop="week_pop")
RELATIONS["day_features"] = _FEATURES.format(pop="day_pop")


def uniform(*parts: str) -> str:
    """SQL text of the hash uniform over ``|``-joined parts."""
    joined = ", ".join(parts)
    return f"(CAST('0x' || substr(sha256(concat_ws('|', {joined})), 1, 13) AS BIGINT) / 4503599627370496.0)"
