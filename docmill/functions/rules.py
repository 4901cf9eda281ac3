"""Ordered rules: the first that matches wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = list[tuple[str, list[str]]]


def first_match(texts: list[Column], rules: Rules, default: str | None = None) -> Column:
    """The name of the first rule of which any pattern is contained in any of ``texts``.

    The rules are one literal array, so a plan holds them once, and a rule list of any length adds no branches.
    """
    if not rules:
        return F.lit(default).cast("string")
    table = F.array(*(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, patterns)).alias("patterns")) for name, patterns in rules))

    def hit(rule: Column) -> Column:
        def any_text(p):
            out = F.lit(False)
            for t in texts:
                out = out | F.contains(t, p)
            return out

        return F.exists(rule["patterns"], any_text)

    return F.coalesce(F.get(F.filter(table, hit), F.lit(0))["name"], F.lit(default))


def cascade(x: Column, branches: list[tuple[str, Column]], default: Column) -> Column:
    """``branches``: (substring, value); the value of the first substring that ``x`` contains."""
    out = None
    for part, value in branches:
        out = F.when(x.contains(part), value) if out is None else out.when(x.contains(part), value)
    return default if out is None else out.otherwise(default)
