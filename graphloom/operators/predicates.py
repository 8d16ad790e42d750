"""Predicates as columns: tenant scope, visibility, policies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tenant_scope(df: DataFrame, tenant: str) -> DataFrame:
    return df.where(F.col("tenant") == tenant)


def live(flag: str) -> Column:
    """True unless the flag is set; an unknown flag isn't set."""
    return ~F.coalesce(F.col(flag), F.lit(False))


def as_of(valid_from: Column, valid_to: Column, recorded: Column, valid_at: Column, known_at: Column) -> Column:
    """Valid in a half-open interval and recorded by ``known_at``, that moment included; null ends are open."""
    return (valid_from.isNull() | (valid_from <= valid_at)) & (valid_to.isNull() | (valid_to > valid_at)) & (recorded.isNull() | (recorded <= known_at))


#: op -> (column, value) -> condition
TESTS = {
    "EQ": lambda c, v: c == v,
    "NE": lambda c, v: c != v,
    "IN": lambda c, v: c.isin(*v),
    "CONTAINS": lambda c, v: c.contains(v),
    "GT": lambda c, v: c > v,
    "GTE": lambda c, v: c >= v,
    "LT": lambda c, v: c < v,
    "LTE": lambda c, v: c <= v,
    "IS_EMPTY": lambda c, v: c.isNull() | (c.cast("string") == ""),
    "NOT_EMPTY": lambda c, v: c.isNotNull() & (c.cast("string") != ""),
}


def policy(rules: Sequence[dict], default: str) -> Column:
    """The result of the first rule that matches, by (priority, id). A rule has id, priority, mode (ALL or ANY), tests
    (column, op, value) and result; a test on null doesn't hold."""
    out = F.lit(default)
    for r in sorted(rules, key=lambda r: (r["priority"], r["id"]), reverse=True):
        tests = [F.coalesce(TESTS[op](F.col(c), v), F.lit(False)) for c, op, v in r["tests"]]
        hit = F.lit(r["mode"] == "ALL")
        for t in tests:
            hit = (hit & t) if r["mode"] == "ALL" else (hit | t)
        out = F.when(hit, F.lit(r["result"])).otherwise(out)
    return out


def reasons(checks: Sequence[tuple[str, Column]]) -> Column:
    """Names of the checks that fail, in order; an unknown check fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks]))


def filtered_or_all(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that match; all rows where none does."""
    any_ = df.agg(F.coalesce(F.bool_or(condition), F.lit(False)).alias("_any"))
    return df.crossJoin(F.broadcast(any_)).where(condition | ~F.col("_any")).drop("_any")
