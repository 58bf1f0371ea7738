"""Registry of runnable queries. Each has a column spec that shapes the Spark result and its SQL twin alike.

Spec letters: s text (dates too), i integer (booleans too), f double rounded to six places, a array as text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawloom.plans.relations_sql import RELATIONS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_TWINS: dict[str, tuple[str, str]] = {}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(item.split(":")) for item in spec.split()]


def shape(df: DataFrame, spec: str) -> DataFrame:
    def column(name, kind):
        c = F.col(name)
        if kind == "s":
            return c.cast("string").alias(name)
        if kind == "i":
            return c.cast("bigint").alias(name)
        if kind == "f":
            return (F.round(c.cast("double"), 6) + F.lit(0.0)).alias(name)
        return F.array_join(c.cast("array<string>"), " ").alias(name)

    return df.select(*[column(n, k) for n, k in _columns(spec)])


def _used(text: str) -> list[str]:
    """Relations the text needs, dependencies first."""
    found: list[str] = []

    def visit(body):
        for name, definition in RELATIONS.items():
            if name not in found and re.search(rf"\b{name}\b", body):
                visit(definition)
                if name not in found:
                    found.append(name)

    visit(text)
    return found


def oracle_text(spec: str, sql: str) -> str:
    def column(name, kind):
        if kind == "s":
            return f"CAST({name} AS VARCHAR) AS {name}"
        if kind == "i":
            return f"CAST({name} AS BIGINT) AS {name}"
        if kind == "f":
            return f"round(CAST({name} AS DOUBLE), 6) + 0.0 AS {name}"
        return f"array_to_string({name}, ' ') AS {name}"

    recursive = "RECURSIVE " if "RECURSIVE" in sql else ""
    kept = "MATERIALIZED " if "/*MATERIALIZED*/" in sql else ""
    sql = sql.replace("/*RECURSIVE*/", "").replace("/*MATERIALIZED*/", "")
    head = ",\n".join(f"{name} AS {kept}({RELATIONS[name].strip()})" for name in _used(sql))
    own = ""
    match = re.match(r"\s*WITH\s+(.*?)\s*;;\s*(.*)\s*$", sql, re.S)
    if match:  # "WITH own tables ;; SELECT" keeps local tables apart from the final select
        own, sql = match.group(1), match.group(2)
    tables = ",\n".join(t for t in (head, own) if t)
    picked = ", ".join(column(n, k) for n, k in _columns(spec))
    return (f"WITH {recursive}{tables}\n" if tables else "") + f"SELECT {picked} FROM ({sql.strip()}) result"


def query(name: str, spec: str, sql: str | None = None):
    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: shape(fn(spark, sf_dir), spec)
        if sql is not None:
            _TWINS[name] = (spec, sql)
        return fn

    return register


def oracles() -> dict[str, str]:
    """SQL twins, built after all modules have named their relations."""
    return {name: oracle_text(spec, sql) for name, (spec, sql) in _TWINS.items()}
