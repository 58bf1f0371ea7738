"""Record extraction from a (url, html) table, in native expressions: one row per repeated block of a page.

A page is rejected as a whole when its title reads like an error page, a block is invalid, or two blocks
contradict each other; rejected pages come out with their reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawloom.functions.scalars import (
    money_amount,
    money_currency,
    prize_kind,
    published_date,
    tier_name,
    winner_count,
)
from drawloom.operators.validate import bonus_ok, mains_ok

# Fixed value: texts of refused pages.
BLOCKED = r"(?i)captcha|access denied|just a moment|not found"


def plain_text(html: Column) -> Column:
    """Tags removed, the common entities decoded, white space folded."""
    bare = F.regexp_replace(html, r"<[^>]*>", " ")
    for name, char in (("&euro;", "€"), ("&pound;", "£"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def all_matches(html: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(group))


def page_facts(pages: DataFrame) -> DataFrame:
    """Title, host, path, heading, links and paragraph count of whole pages."""
    html, url = F.col("html"), F.col("url")
    return pages.select(
        "page_id",
        "url",
        F.try_parse_url(url, F.lit("HOST")).alias("host"),
        F.try_parse_url(url, F.lit("PATH")).alias("path"),
        plain_text(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)).alias("title"),
        plain_text(F.regexp_extract(html, r"(?s)<h1[^>]*>(.*?)</h1>", 1)).alias("heading"),
        all_matches(html, r'<a href="([^"]*)"').alias("links"),
        F.size(all_matches(html, r"(<p[ >])")).alias("paragraphs"),
        F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1).rlike(BLOCKED).alias("blocked"),
    )


def page_links(pages: DataFrame) -> DataFrame:
    """One row per link of a page, in page order."""
    return pages.select("page_id", F.posexplode(all_matches(F.col("html"), r'<a href="([^"]*)"')).alias("position", "target"))


def _balls(block: Column, bonus: bool) -> Column:
    pattern = r'(?s)<li class="[^"]*bonus-ball[^"]*">\s*(?:<span>)?\s*(\d+)' if bonus else r'(?s)<li(?: class="(?![^"]*bonus-ball)[^"]*")?>\s*(\d+)'
    return F.transform(all_matches(block, pattern), lambda x: x.try_cast("int"))


def _judge_pages(rows: DataFrame) -> DataFrame:
    """Adds the page's reject reason to its rows: an invalid block, or two different rows for a date."""
    row_ok = F.col("draw_date").isNotNull() & mains_ok(F.col("mains"), F.lit(99)) & bonus_ok(F.col("mains"), F.col("bonus"), F.lit(99))
    value = F.struct("mains", "bonus", "jackpot", "outcome")
    same_day = rows.groupBy("url", "draw_date").agg(
        F.count_if(~row_ok).alias("_bad"), (F.min(value) != F.max(value)).alias("_differs")
    )
    pages = same_day.groupBy("url").agg(F.sum("_bad").alias("_bad"), F.max("_differs").alias("_differs"))
    reason = F.when(F.col("_bad") > 0, "invalid_record").when(F.col("_differs"), "conflicting_rows")
    return rows.join(pages.select("url", reason.alias("reject_reason")), "url")


def archive_records(pages: DataFrame) -> DataFrame:
    """Archive tables: rows with a dated link, a ball list, jackpot and outcome cells."""
    open_pages = pages.filter(~F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).rlike(BLOCKED))
    blocks = open_pages.select("url", F.explode(all_matches(F.col("html"), r"(?s)<tr[^>]*>(.*?)</tr>")).alias("b"))
    link = F.regexp_extract("b", r'href="[^"]*/results-(\d{2}-\d{2}-\d{4})"', 1)
    with_balls = blocks.withColumn("_link", link).filter((F.col("_link") != "") & F.col("b").contains("<li"))
    pot = plain_text(F.regexp_extract("b", r'(?s)<td data-title="Jackpot">(.*?)</td>', 1))
    outcome = plain_text(F.regexp_extract("b", r'(?s)<td data-title="Outcome">(.*?)</td>', 1))
    bonus = _balls(F.col("b"), True)
    rows = with_balls.select(
        "url",
        published_date(F.col("_link")).alias("draw_date"),
        F.array_sort(_balls(F.col("b"), False)).alias("mains"),
        F.when(F.size(bonus) == 1, bonus[0]).alias("bonus"),
        money_amount(pot).alias("jackpot"),
        money_currency(pot).alias("currency"),
        F.when(outcome.isin("Won", "Roll"), outcome).alias("outcome"),
    )
    return _judge_pages(rows).dropDuplicates(["url", "draw_date"])


def detail_records(pages: DataFrame) -> DataFrame:
    """Single-draw pages: the address date must equal the published date; one ball list; an optional prize table."""
    html = F.col("html")
    in_url = F.regexp_extract("url", r"results?-(\d{2}-\d{2}-\d{4})$", 1)
    heading = plain_text(F.regexp_extract(html, r"(?s)<h1[^>]*>(.*?)</h1>", 1))
    lists = all_matches(html, r'(?s)<ul class="(?:ballRow|balls)">(.*?)</ul>')
    numbers = F.transform(
        all_matches(F.get(lists, F.lit(0)), r"(?s)<li[^>]*>\s*(\d+)"), lambda x: x.try_cast("int")
    )
    day, published = published_date(in_url), published_date(heading)
    mains = F.array_sort(F.slice(numbers, 1, 6))
    bonus = F.get(numbers, F.lit(6))
    reject = (
        F.when(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1).rlike(BLOCKED), "blocked_page")
        .when((in_url == "") | ~heading.contains("Lotto") | heading.contains("Plus"), "unrecognised_page")
        .when(~day.eqNullSafe(published), "date_mismatch")
        .when(F.size(lists) != 1, "ambiguous_numbers")
        .when(~F.size(numbers).isin(6, 7), "number_count")
        .when(~mains_ok(mains, F.lit(99)) | ~bonus_ok(mains, bonus, F.lit(99)), "invalid_record")
    )
    cells = F.transform(
        all_matches(html, r"(?s)<tr[^>]*>(.*?)</tr>"),
        lambda row: F.transform(all_matches(row, r"(?s)<td[^>]*>(.*?)</td>"), plain_text),
    )
    tiers = F.filter(cells, lambda c: (F.size(c) >= 3) & (c[0].startswith("Match") | (c[0] == "Jackpot")))
    prizes = F.transform(
        tiers,
        lambda c: F.struct(
            tier_name(c[0]).alias("tier"),
            winner_count(c[2]).alias("winners"),
            money_amount(c[1]).alias("amount"),
            money_currency(c[1]).alias("currency"),
            c[1].alias("original_text"),
            prize_kind(c[1]).alias("prize_type"),
        ),
    )
    return pages.select(
        "url", day.alias("draw_date"), mains.alias("mains"), bonus.alias("bonus"), prizes.alias("prizes"), reject.alias("reject_reason")
    )


def detail_prizes(records: DataFrame) -> DataFrame:
    """Prize rows of accepted detail pages."""
    return records.filter("reject_reason is null").select("url", "draw_date", F.explode("prizes").alias("p")).select(
        "url", "draw_date", "p.*"
    )
