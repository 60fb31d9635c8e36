"""Column expressions: predicates, buckets, dates, hashes and text formats."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names the results must carry.
TIER_UNREADABLE = "Unreadable"
TIER_NONE = "High Risk - No Anchors"
TIER_ONE = "Medium Risk - One Anchor"
TIER_BOTH = "Low Risk - Both Anchors"
PAYER_CODES = ("NORTHWAVE", "METRIDIAN", "BLUEHARBOR", "VERITAS", "SILVERPEAK")
SLA_HOURS = {"urgent": 72, "standard": 168}
OUTCOME_BOUNDS = (85, 70)
COMPLIANCE_FLOOR = 0.85


def day(ts: Column) -> Column:
    return F.to_date(ts)


def coalesce_true(flag: Column) -> Column:
    """A missing anchor flag counts as missing anchor."""
    return F.coalesce(flag, F.lit(True))


def present(value: Column) -> Column:
    return value.isNotNull()


def risk_tier(unreadable: Column, no_dob: Column, no_ssn4: Column) -> Column:
    """First matching tier; NULL anchor flags count as missing."""
    dob, ssn4 = coalesce_true(no_dob), coalesce_true(no_ssn4)
    return (
        F.when(unreadable, TIER_UNREADABLE)
        .when(dob & ssn4, TIER_NONE)
        .when(dob | ssn4, TIER_ONE)
        .otherwise(TIER_BOTH)
    )


def outcome_bucket(score: Column) -> Column:
    top, mid = OUTCOME_BOUNDS
    return (
        F.when(score >= top, "compliant")
        .when(score >= mid, "needs_review")
        .otherwise("high_risk")
    )


def score_band(score: Column) -> Column:
    """Documented coaching band; no curated view uses it."""
    return (
        F.when(score >= 90, "Excellent")
        .when(score >= 75, "Good")
        .when(score >= 60, "Needs Coaching")
        .otherwise("At Risk")
    )


def call_score(confidence: Column, coverage: Column, redaction: Column, disposition: Column) -> Column:
    """Documented rubric over four components given on a 0-100 scale."""
    return confidence * 0.35 + coverage * 0.35 + redaction * 0.20 + disposition * 0.10


def match_class(weight: Column, high: float, low: float) -> Column:
    """Strictly above ``high`` is a match, strictly above ``low`` a possible one."""
    return (
        F.when(weight > high, "match").when(weight > low, "possible_match").otherwise("non_match")
    )


def sla_hours(urgency: Column) -> Column:
    first, *rest = SLA_HOURS.items()
    expr = F.when(urgency == first[0], first[1])
    for name, hours in rest:
        expr = expr.when(urgency == name, hours)
    return expr


def days_between(end: Column, start: Column) -> Column:
    return F.datediff(end, start)


def within_sla(days: Column, target_hours: Column) -> Column:
    """False (not NULL) when there is no target."""
    return F.coalesce(days * 24 <= target_hours, F.lit(False))


def bucket(key: Column, n: int, salt: str = "") -> Column:
    """``abs(hash(key || salt)) % n`` widened first, so -2**31 cannot overflow."""
    hashed = F.hash(F.concat(key, F.lit(salt)) if salt else key)
    return F.abs(hashed.cast("long")) % F.lit(n)


def pick(values: Sequence[str], index: Column) -> Column:
    """Zero-based pick from a literal list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def spread_ts(key: Column, as_of: Column, days: int) -> Column:
    """Timestamp on one of the ``days`` days ending at ``as_of``."""
    date = F.date_sub(as_of, bucket(key, days).cast("int")).cast("timestamp")
    return date + F.make_interval(
        hours=bucket(key, 24, "h").cast("int"), mins=bucket(key, 60, "m").cast("int")
    )


def plus_minutes(ts: Column, minutes: int) -> Column:
    return ts + F.make_interval(mins=F.lit(minutes))


def since(date: Column, as_of: Column, days: int) -> Column:
    """Rows of the last ``days`` days, counted back from ``as_of``."""
    return date >= F.date_sub(as_of, days)


def month_to_date(date: Column, as_of: Column) -> Column:
    return date >= F.trunc(as_of, "month")


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def link_confidence(weight: Column, scale: float) -> Column:
    return F.round(F.least(F.lit(1.0), weight / F.lit(scale)), 4)


def fs_weights(m: float, u: float) -> tuple[float, float]:
    """Agreement and disagreement weights of one compared field, base-2 logs."""
    agree = math.log2(m / u) if u > 0 else 8.0
    disagree = math.log2((1 - m) / (1 - u)) if u < 1 else -4.0
    return agree, disagree


def fs_weight(agree: Column, m: float, u: float, missing: Column | None = None, mult: float = 1.0) -> Column:
    """Weight of one field as an expression; a missing field weighs nothing."""
    yes, no = (w * mult for w in fs_weights(m, u))
    expr = F.when(missing, 0.0) if missing is not None else F
    return expr.when(agree, yes).otherwise(no)


def above_multiple(value: Column, total: Column, n: Column, num: int, den: int = 1) -> Column:
    """``value > (num/den) * (total/n)`` decided on integers."""
    return value.cast("long") * n * F.lit(den) > total * F.lit(num)


# Text formats -------------------------------------------------------------


def padded_id(prefix: str, key: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(key.cast("string"), width, "0"))


def auth_number(created: Column, serial: Column) -> Column:
    return F.concat(
        F.lit("AUTH-"), F.date_format(created, "yyyy"), F.lit("-"), F.lpad(serial.cast("string"), 6, "0")
    )


def batch_id(ingested: Column, serial: Column) -> Column:
    return F.concat(
        F.lit("MRM-"), F.date_format(ingested, "yyyyMMdd"), F.lit("-"), F.lpad(serial.cast("string"), 3, "0")
    )


def template_id(call_type: Column, serial: Column) -> Column:
    return F.concat(
        F.lit("TPL_"), F.upper(F.substring(call_type, 1, 3)), F.lit("_"), F.lpad(serial.cast("string"), 2, "0")
    )


def score_sentence(score: Column, disposition: Column) -> Column:
    verdict = F.when(score >= OUTCOME_BOUNDS[1], "adequate").otherwise("insufficient")
    return F.concat(
        F.lit("Score "), score.cast("string"), F.lit(": "), disposition,
        F.lit(" call with "), verdict, F.lit(" documentation."),
    )
