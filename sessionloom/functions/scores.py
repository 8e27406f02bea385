"""Numeric rules: impact, clamping, severities, priorities, trend direction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def impact_score(frequency: Column, hours: Column) -> Column:
    """Half from frequency (capped at 100), half from hours (capped at 10)."""
    return (
        F.least(frequency.cast("double"), F.lit(100.0)) / 100.0 * 0.5
        + F.least(hours.cast("double"), F.lit(10.0)) / 10.0 * 0.5
    )


def finite_clamp(value: Column, low: float, high: float) -> Column:
    """Clamp to [low, high]; NaN and infinities become ``low``."""
    value = value.cast("double")
    broken = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(broken, F.lit(low)).otherwise(F.greatest(F.least(value, F.lit(high)), F.lit(low)))


def mapped(key: Column, table: dict, default=None) -> Column:
    """A lookup in a short literal table; ``key`` appears once in the plan."""

    def literal(value) -> str:
        if isinstance(value, str):
            return f"'{value}'"
        return f"{value!r}D" if isinstance(value, float) else repr(value)

    pairs = ", ".join(f"{literal(name)}, {literal(value)}" for name, value in table.items())
    return F.coalesce(F.try_element_at(F.expr(f"map({pairs})"), key), F.lit(default))


def priority(impact: Column) -> Column:
    return F.when(impact > 0.8, "High").when(impact > 0.7, "Medium").otherwise("Low")


def impact_label(minutes: Column, priority_name: Column) -> Column:
    rounded = F.bround(F.greatest(minutes, F.lit(0.0)), 0).cast("bigint")
    return F.when(
        minutes.isNotNull(), F.concat(F.lit("~"), rounded, F.lit(" min/day (evidence-based)"))
    ).otherwise(F.concat(F.lit("Estimated impact: "), priority_name))


def trend_direction(current: Column, previous: Column) -> Column:
    return (
        F.when(current > previous * 1.1, "Increasing")
        .when(current < previous * 0.9, "Decreasing")
        .otherwise("Stable")
    )


def two_decimals(value: Column) -> Column:
    """Text of a non-negative number with two decimals, rounded from its exact binary value.

    Number formatting on the JVM rounds the shortest decimal form, which differs
    for values such as 2.675. ``lost`` is the exact part of ``value * 1000`` that
    the product rounds away; together with the distance to the nearest whole
    thousandth it tells on which side of a half the value lies, and a true half
    goes to the even digit.
    """
    scaled = value * 134217729.0
    high = scaled - (scaled - value)
    product = value * 1000.0
    lost = (high * 1000.0 - product) + (value - high) * 1000.0
    whole = F.rint(product)
    side = (product - whole) + lost
    below = F.floor(whole / 10.0)
    up = (side > 0) | ((side == 0) & (below % 2 == 1))
    halves = (below + up.cast("int")) / 100.0
    rounded = F.when(F.pmod(whole, F.lit(10.0)) == 5.0, halves).otherwise(F.round(value, 2))
    return F.format_string("%.2f", rounded)


def trend_bars(current: Column, previous: Column, width: int = 20) -> Column:
    """Two labelled bars on a shared scale."""
    scale = F.lit(float(width)) / F.greatest(current, previous, F.lit(1.0))

    def bar(value: Column) -> Column:
        return F.repeat(F.lit("█"), (value * scale).cast("int"))

    def number(value: Column) -> Column:
        return F.format_string("%6s", two_decimals(value))

    return F.concat(
        F.lit(" Current  "), number(current), F.lit("  "), bar(current), F.lit("\n"),
        F.lit("Previous  "), number(previous), F.lit("  "), bar(previous),
    )


def friction_score(high_impact: Column, steering: Column) -> Column:
    high, steer = high_impact.cast("double"), steering.cast("double")
    both = (high / (high + 5.0) + steer / (steer + 20.0)) / 2.0
    return F.greatest(F.least(both, F.lit(1.0)), F.lit(0.0))
