"""Order-independent rounding helpers.

Sums of doubles depend on the order in which partitions arrive, so a retried
task could move a rounded percentage by one unit.  Rates are computed on
integers with exact half-up division; means of doubles add up their shown
decimal digits, 18 places of them, and only the last step is a double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

WIDE = "decimal(38,0)"
SHOWN = "decimal(38,18)"


def fixed(value: Column, digits: int) -> Column:
    """Double that was rounded to ``digits`` decimals as a scaled bigint.

    Plain arithmetic stays in generated code; ROUND would build a BigDecimal
    per row.
    """
    return F.floor(value.cast("double") * F.lit(float(10**digits)) + F.lit(0.5))


def ratio(num: Column, den: Column, dp: int, scale: int = 1, wide: bool = True) -> Column:
    """``scale * num / den`` rounded half-up to ``dp`` decimals, NULL on zero.

    ``wide`` carries the intermediate product in decimal(38,0); switch it off
    for per-row use where the operands are known to be small.
    """
    kind = WIDE if wide else "bigint"
    unit = 10**dp
    n = num.cast(kind)
    d = F.nullif(den.cast(kind), F.lit(0).cast(kind))
    doubled = F.abs(n) * F.lit(2 * scale * unit).cast("bigint") + d
    whole = F.call_function("div", doubled, d * F.lit(2))
    signed = F.when(n < 0, -whole).otherwise(whole)
    return signed.cast("double") / F.lit(float(unit)) if dp else signed.cast("double")


def pct(num: Column, den: Column, dp: int = 2) -> Column:
    """Percentage of ``num`` in ``den``; NULL when ``den`` is zero."""
    return ratio(num, den, dp, scale=100)


def shown(value: Column, kind: str = SHOWN) -> Column:
    """Decimal digits of a double as it prints; NULL for NaN, infinities and what has 21 digits or more."""
    return value.cast("double").try_cast(kind)


def mean_of(total: Column, n_shown: Column, n: Column, plain: Column, dp: int) -> Column:
    """Mean from the sum of shown digits and its count; ``plain`` where a value has no such digits.

    ``n`` counts all values that are not NULL.  A NaN or an infinity thus makes the mean one, as AVG does, and sums
    of 1e20 or more are those of doubles.
    """
    found = F.round(total / F.nullif(n_shown, F.lit(0)), dp).cast("double")
    return F.when((n_shown == n) & (total.isNotNull() | (n == 0)), found).otherwise(F.round(plain, dp))


def mean_exact(value: Column, dp: int, over: WindowSpec | None = None) -> Column:
    """AVG of a double column, rounded half up to ``dp``, whatever the order of its rows."""

    def each(c: Column) -> Column:
        return c if over is None else c.over(over)

    digits = shown(value)
    return mean_of(each(F.try_sum(digits)), each(F.count(digits)), each(F.count(value)), each(F.avg(value)), dp)


def mean_int(value: Column, dp: int) -> Column:
    """AVG of an integer column rounded to ``dp`` (aggregate)."""
    return ratio(F.sum(value.cast("long")), F.count(value), dp)


def n_where(cond: Column) -> Column:
    """Conditional count: 0, not NULL, on a non-empty group."""
    return F.count_if(cond).cast("long")
