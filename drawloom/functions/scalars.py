"""Scalar column functions: all native expressions, so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The name of a currency whose symbol alone does not identify it.
UNRESOLVED_POUND = "POUND_UNRESOLVED"


# --- hashing -----------------------------------------------------------------


def unit_uniform(*parts) -> Column:
    """A uniform double in [0, 1) from the SHA-256 of the ``|``-joined key parts (52 bits kept)."""
    key = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with keys in sorted order, ISO dates, Z timestamps, decimals as text, nulls kept."""
    ordered = [fields[k].alias(k) for k in sorted(fields)]
    return F.to_json(
        F.struct(*ordered),
        {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX", "dateFormat": "yyyy-MM-dd"},
    )


def natural_key(source: Column, url: Column, artifact_sha256: Column, parser_version: Column, record_key: Column) -> Column:
    """Portable identity of an observation: a hash of its natural key, no surrogate id."""
    return F.sha2(
        canonical_json(
            {
                "source": source,
                "url": url,
                "artifact_sha256": artifact_sha256,
                "parser_version": parser_version,
                "record_key": record_key,
            }
        ),
        256,
    )


# --- published text (fixed values: the patterns of money and labels) ----------


def money_amount(text: Column) -> Column:
    digits = F.regexp_extract(text, r"[€£]\s*([\d,]+(?:\.\d+)?)", 1)
    return F.regexp_replace(digits, ",", "").try_cast("decimal(18,2)")


def money_currency(text: Column) -> Column:
    return F.when(text.contains("€"), "EUR").when(text.contains("£"), UNRESOLVED_POUND)


def tier_name(label: Column) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(label, "plus", "+"), r"\s+", " ")
    return F.regexp_replace(spaced, "Jackpot", "Match 6")


def prize_kind(published: Column) -> Column:
    return F.when(published.rlike("(?i)quick pick|ticket"), "ticket_or_cash").otherwise("unresolved")


def winner_count(text: Column) -> Column:
    return F.when(text.rlike(r"^[\d,]+$"), F.regexp_replace(text, ",", "").try_cast("int"))


def published_date(text: Column) -> Column:
    """First of the accepted layouts that parses: ISO, ``dd-MM-yyyy``, ``dd/MM/yy`` or ``12th March 2001``."""
    plain = F.regexp_replace(F.trim(text), r"(\d)(st|nd|rd|th)\b", "$1")
    long_form = F.regexp_extract(plain, r"(\d{1,2} [A-Z][a-z]+ \d{4})", 1)
    short = F.try_to_date(plain, "dd/MM/yy")
    # Two-digit years 69..99 belong to the last century.
    short = F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short)
    return F.coalesce(
        F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(plain, "yyyy-MM-dd")),
        F.when(plain.rlike(r"^\d{2}-\d{2}-\d{4}$"), F.try_to_date(plain, "dd-MM-yyyy")),
        F.when(plain.rlike(r"^\d{2}/\d{2}/\d{2}$"), short),
        F.when(long_form != "", F.try_to_date(long_form, "d MMMM yyyy")),
    )


def figure_precision(figure: Column) -> Column:
    """Rounding increment of a published decimal figure: ``12.34`` -> 0.01, ``12`` -> 1."""
    return F.pow(F.lit(10.0), -F.length(F.regexp_extract(figure, r"\.(\d+)$", 1)))


# --- arrays ------------------------------------------------------------------


def main_sum(mains: Column) -> Column:
    return F.aggregate(mains, F.lit(0), lambda a, x: a + x)


def odd_count(mains: Column) -> Column:
    return F.size(F.filter(mains, lambda x: x % 2 == 1))


def adjacent_pairs(mains: Column) -> Column:
    """Neighbouring numbers in a sorted array that differ by one."""
    steps = F.zip_with(F.slice(mains, 2, F.size(mains)), mains, lambda b, a: b - a)
    return F.size(F.filter(steps, lambda d: d == 1))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def line_text(mains: Column) -> Column:
    return F.array_join(mains, " ")


# --- dates -------------------------------------------------------------------


def iso_fields(day: Column) -> dict[str, Column]:
    return {
        "iso_year": F.extract(F.lit("YEAROFWEEK"), day).cast("int"),
        "iso_week": F.weekofyear(day),
        "weekday": F.weekday(day),
    }


def easter_sunday(year: Column) -> Column:
    """Western Easter by the anonymous Gregorian computus, in integer column arithmetic."""

    def div(a, b):
        return F.floor(a / b).cast("int")

    a, b, c = year % 19, div(year, F.lit(100)), year % 100
    d, e = div(b, F.lit(4)), b % 4
    f = div(b + 8, F.lit(25))
    g = div(b - f + 1, F.lit(3))
    h = (a * 19 + b - d - g + 15) % 30
    i, k = div(c, F.lit(4)), c % 4
    w = (F.lit(32) + e * 2 + i * 2 - h - k) % 7
    m = div(a + h * 11 + w * 22, F.lit(451))
    n = h + w - m * 7 + 114
    return F.make_date(year, div(n, F.lit(31)), n % 31 + 1)


def first_monday(year: Column, month: int) -> Column:
    start = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(start, (F.lit(7) - F.weekday(start)) % 7)


def holiday_array(year: Column) -> Column:
    """Public holidays of a year (Irish calendar, Good Friday included; the February one from 2023). Fixed values."""
    easter = easter_sunday(year)
    october = F.make_date(year, F.lit(10), F.lit(31))
    february = F.make_date(year, F.lit(2), F.lit(1))
    fixed = [F.make_date(year, F.lit(m), F.lit(d)) for m, d in ((1, 1), (3, 17), (12, 25), (12, 26))]
    moving = [
        F.date_sub(easter, 2),
        F.date_add(easter, 1),
        first_monday(year, 5),
        first_monday(year, 6),
        first_monday(year, 8),
        F.date_sub(october, F.weekday(october)),
    ]
    brigid = F.when(year >= 2023, F.when(F.weekday(february) == 4, february).otherwise(first_monday(year, 2)))
    return F.array_sort(F.array_compact(F.array(*fixed, *moving, brigid)))


def deadline_instant(target: Column, local_time: Column, zone: Column, override: Column) -> Column:
    """UTC instant of a local deadline; an override for that date wins."""
    local = F.to_timestamp(F.concat_ws(" ", target.cast("string"), local_time))
    return F.coalesce(override, F.to_utc_timestamp(local, zone))


# --- odds --------------------------------------------------------------------


def choose(n: Column, k: int) -> Column:
    """Binomial coefficient C(n, k) as a double; 0 when k exceeds n."""
    if k == 0:
        return F.lit(1.0)
    product = F.aggregate(
        F.sequence(F.lit(1), F.lit(k)), F.lit(1.0), lambda a, i: a * (n - k + i).cast("double") / i
    )
    return F.when(n >= k, product).otherwise(F.lit(0.0))


def match_probability(pool: Column, k: int) -> Column:
    """P(one line matches exactly k of six drawn from the pool)."""
    six = float([1, 6, 15, 20, 15, 6, 1][k])
    return F.lit(six) * choose(pool - 6, 6 - k) / choose(pool, 6)


def match_tail(pool: Column, k: int) -> Column:
    total = match_probability(pool, k)
    for j in range(k + 1, 7):
        total = total + match_probability(pool, j)
    return total


# Prize tiers as (name, matched mains, bonus needed / excluded / not applicable).
TIERS = (
    ("Match 6", 6, None),
    ("Match 5 + Bonus", 5, True),
    ("Match 5", 5, False),
    ("Match 4 + Bonus", 4, True),
    ("Match 4", 4, False),
    ("Match 3 + Bonus", 3, True),
    ("Match 3", 3, False),
    ("Match 2 + Bonus", 2, True),
)


def tier_probability(pool: Column, matched: int, bonus: bool | None) -> Column:
    p = match_probability(pool, matched)
    if bonus is None:
        return p
    hit = F.lit(float(6 - matched)) / (pool - 6)
    return p * (hit if bonus else 1.0 - hit)


def jackpot_share(lines_sold: Column, p6: Column) -> Column:
    """Expected share of a won jackpot when other winners are Poisson(lines sold x p6)."""
    load = lines_sold * p6
    return F.when(F.coalesce(lines_sold, F.lit(0.0)) == 0, F.lit(1.0)).otherwise((1 - F.exp(-load)) / load)
