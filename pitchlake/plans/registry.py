"""Named queries and the SQL that gives the same rows."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pitchlake.sources.shared import cut

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Common table expressions that oracles may name; each may name others.
VIEWS: dict[str, str] = {}


#: Tables that the running query has materialized, by name; one dict while a query is being built.
_SCOPE: list[dict[str, DataFrame]] = []


def once(f: Query) -> Query:
    """A table that a query's plan reads several times: written once per query and read back."""

    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if not _SCOPE:
            return f(spark, sf_dir)
        if f.__name__ not in _SCOPE[-1]:
            _SCOPE[-1][f.__name__] = cut(f(spark, sf_dir))
        return _SCOPE[-1][f.__name__]

    return run


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            _SCOPE.append({})
            try:
                return f(spark, sf_dir)
            finally:
                _SCOPE.pop()

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return put


def with_views(body: str) -> str:
    """body behind the views that it needs, each after those that it needs itself."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bv_\w+", text)):
            if name in VIEWS and name not in order:
                need(VIEWS[name])
                if name not in order:
                    order.append(name)

    need(body)
    if not order:
        return body
    views = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"


def oracles() -> dict[str, str]:
    return {k: decimal_rounding(with_views(v)) for k, v in ORACLES.items()}


def decimal_rounding(sql: str) -> str:
    """round(x, n) as rounding of x's decimal text, half up, which is what Spark's round does."""
    out, at = "", 0
    while (found := re.search(r"\bround\(", sql[at:])) is not None:
        start = at + found.end()
        depth, comma, i = 1, None, start
        while depth:
            ch = sql[i]
            if ch == "'":
                i = sql.index("'", i + 1)
            elif ch in "([":
                depth += 1
            elif ch in ")]":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = i
            i += 1
        inner = sql[start : i - 1]
        out += sql[at : at + found.start()]
        if comma is not None and re.fullmatch(r"\s*\d\s*", sql[comma + 1 : i - 1]):
            out += f"(({decimal_rounding(sql[start:comma])})::DOUBLE::VARCHAR::DECIMAL(30,{sql[comma + 1 : i - 1].strip()})::DOUBLE)"
        else:
            out += f"round({decimal_rounding(inner)})"
        at = i
    return out + sql[at:]
