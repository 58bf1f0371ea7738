"""Line selection. A target's scores are gathered into one ranked array (at most ``pool`` entries), and every
method reads that array in place, so all methods of a target share a single shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawloom.functions.scalars import unit_uniform
from drawloom.session import spread

TINY = float(2**-53)


def rank_numbers(scores: DataFrame, keys: list[str], score: str = "score", **extra: Column) -> DataFrame:
    """(keys, ranked, weights): numbers by falling score, ties to the smaller; weights in number order."""
    pairs = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col("number").alias("n"))))
    weights = F.array_sort(F.collect_list(F.struct(F.col("number").alias("n"), F.col(score).alias("w"))))
    out = spread(scores, *keys).groupBy(*keys).agg(pairs.alias("_p"), weights.alias("_w"), *[c.alias(n) for n, c in extra.items()])
    return out.select(
        *keys,
        *extra,
        F.transform("_p", lambda x: x["n"]).alias("ranked"),
        F.transform("_w", lambda x: x["w"]).alias("weights"),
    )


def top_line(ranked: Column) -> Column:
    return F.array_sort(F.slice(ranked, 1, 6))


def coverage_lines(ranked: Column, budget: int) -> Column:
    """Lines that walk the ranking six at a time, shifted by one rank at each wrap."""
    pool = F.size(ranked)

    def line(k):
        start = k * 6 + F.floor(k * 6 / pool).cast("int")
        return F.array_sort(
            F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.element_at(ranked, ((start + i) % pool) + 1))
        )

    return F.transform(F.sequence(F.lit(0), F.lit(budget - 1)), line)


def _six_smallest(keyed: Column) -> Column:
    return F.array_sort(F.transform(F.slice(F.array_sort(keyed), 1, 6), lambda x: x["n"]))


def _numbers(pool: Column) -> Column:
    return F.sequence(F.lit(1), pool)


def uniform_line(pool: Column, *seed) -> Column:
    """Six smallest of ``pool`` hash uniforms: a uniformly drawn line."""
    return _six_smallest(F.transform(_numbers(pool), lambda n: F.struct(unit_uniform(*seed, n).alias("u"), n.alias("n"))))


def weighted_line(weights: Column, *seed) -> Column:
    """Six numbers without replacement, proportional to their weights (exponential keys)."""

    def key(n):
        u = F.greatest(unit_uniform(*seed, n), F.lit(TINY))
        w = F.element_at(weights, n)
        return F.struct(F.when(w > 0, -F.log(u) / w).otherwise(F.lit(float("inf"))).alias("k"), n.alias("n"))

    return _six_smallest(F.transform(_numbers(F.size(weights)), key))


def distinct_lines(line_of_attempt, budget: int, attempts: int | None = None, first: Column | None = None) -> Column:
    """The first ``budget`` distinct lines over numbered attempts; ``first`` is put in front when given.

    Repeats are rare in pools of 30 or more, so four spare attempts are drawn at first. A portfolio that falls short
    of them draws up to ``attempts`` (1,000 and 100 a line by default); one that is short even then is an error.
    """
    limit = attempts or max(1000, 100 * budget)

    def drawn(tries):
        lines = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), line_of_attempt)
        if first is not None:
            lines = F.concat(F.array(first), lines)
        return F.slice(F.array_distinct(lines), 1, budget)

    def full(lines, otherwise):
        # One lambda variable holds the lines, so that they are drawn once.
        return F.element_at(F.transform(F.array(lines), lambda x: F.when(F.size(x) == budget, x).otherwise(otherwise)), 1)

    short = F.raise_error(F.lit(f"no {budget} distinct lines in {limit} attempts")).cast("array<array<int>>")
    return full(drawn(min(limit, budget + 4)), full(drawn(limit), short))


def uniform_portfolio(pool: Column, budget: int, *seed, attempts: int | None = None) -> Column:
    return distinct_lines(lambda a: uniform_line(pool, *seed, budget, a), budget, attempts)


def weighted_portfolio(ranked: Column, weights: Column, budget: int, *seed, attempts: int | None = None) -> Column:
    """Top line first, then weighted lines."""
    return distinct_lines(lambda a: weighted_line(weights, *seed, budget, a), budget, attempts, first=top_line(ranked))


def explode_lines(portfolios: DataFrame, lines: str = "lines") -> DataFrame:
    """One row per line with ``line_index`` and ``budget``."""
    keys = [c for c in portfolios.columns if c != lines]
    return portfolios.select(*keys, F.size(lines).alias("budget"), F.posexplode(lines).alias("line_index", "mains"))


# Names of the methods.
MARGINAL_METHODS = ("top6", "weighted", "coverage5", "coverage10")
UNIFORM_METHODS = ("random1", "random5", "random10")
HEURISTICS = ("hot", "cold", "overdue")


def study_portfolios(scored: DataFrame, digest: str, methods: tuple[str, ...] | None = None) -> DataFrame:
    """Portfolios of each target for the wanted methods (all by default).

    ``scored`` has series keys, draw_date, max_input_date, pool, number, source and score. Marginal sources
    give top6, weighted, coverage5, coverage10; heuristic sources carry one method each. Uniform lines need no
    score and ride on the row of the first heuristic, so the draws are not read again.
    """
    wanted = methods or (*MARGINAL_METHODS, *UNIFORM_METHODS, *HEURISTICS)
    keys = ["game", "rule_code", "draw_date", "source"]
    ranked = rank_numbers(scored, keys, pool=F.max("pool"), max_input_date=F.max("max_input_date"))
    target = F.concat_ws(":", "game", F.col("draw_date").cast("string"))
    numbers = F.col("ranked")

    def option(method, lines):
        return F.struct(F.lit(method).alias("method"), lines.alias("lines"))

    makers = {
        "top6": lambda: F.array(top_line(numbers)),
        "weighted": lambda: F.array(weighted_line(F.col("weights"), digest, F.concat_ws(":", "source", F.lit("weighted")), target)),
        "coverage5": lambda: coverage_lines(numbers, 5),
        "coverage10": lambda: coverage_lines(numbers, 10),
    }
    empty = F.array().cast("array<struct<method:string,lines:array<array<int>>>>")
    marginal = [option(m, makers[m]()) for m in MARGINAL_METHODS if m in wanted]
    uniform = [
        option(m, uniform_portfolio(F.col("pool"), int(m[6:]), digest, m, target)) for m in UNIFORM_METHODS if m in wanted
    ]
    source = F.col("source")
    own = F.array(F.struct(source.alias("method"), F.array(top_line(numbers)).alias("lines")))
    heuristic = F.when(source.isin(*wanted), own).otherwise(empty)
    options = (
        F.when(source == HEURISTICS[0], F.concat(heuristic, F.array(*uniform)) if uniform else heuristic)
        .when(source.isin(*HEURISTICS), heuristic)
        .otherwise(F.array(*marginal) if marginal else empty)
    )
    flat = ranked.select("game", "rule_code", "draw_date", "max_input_date", "pool", "source", F.explode(options).alias("o"))
    label = (
        F.when(F.col("o.method").isin(*UNIFORM_METHODS), "uniform").when(source.isin(*HEURISTICS), "heuristic").otherwise(source)
    )
    return flat.select("game", "rule_code", "draw_date", "max_input_date", "pool", label.alias("source"), "o.method", "o.lines")


def heuristic_scores(features: DataFrame, marginals: dict[str, str] | None = None) -> DataFrame:
    """Feature rows -> (source, score): smoothed frequency, hot, cold, overdue, plus extra score columns by source."""
    sources = {"frequency": F.col("smoothed_frequency"), "hot": F.col("freq_25"), "cold": -F.col("freq_25"), "overdue": F.col("recency")}
    for name, column in (marginals or {}).items():
        sources[name] = F.col(column)
    picks = F.array(*[F.struct(F.lit(n).alias("source"), c.alias("score")) for n, c in sources.items()])
    base = ["game", "rule_code", "draw_idx", "draw_date", "max_input_date", "pool", "number", "hit"]
    return features.select(*base, F.explode(picks).alias("x")).select(*base, "x.source", "x.score")
