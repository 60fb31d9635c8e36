"""Named dimensions and measures that re-aggregate at any grain."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselight.functions.exact import mean_exact, mean_int, n_where, pct
from caselight.plans import views as V
from caselight.sources.registry import Registry

Measure = Callable[[], Column]


@dataclass(frozen=True)
class MetricView:
    """A source with the dimensions and measures that may be asked of it."""

    source: DataFrame
    dimensions: Sequence[str]
    measures: dict[str, Measure] = field(default_factory=dict)

    def query(
        self,
        dims: Sequence[str] = (),
        measures: Sequence[str] | dict[str, str] = (),
        where: Column | None = None,
        having: Column | None = None,
        order: Sequence[Column] = (),
        limit: int | None = None,
    ) -> DataFrame:
        """Group by ``dims`` and compute ``measures`` (a dict maps measure to alias).

        ``where`` sees the source's columns, ``having`` and ``order`` the result's.
        """
        names = measures if isinstance(measures, dict) else {m: m for m in measures}
        unknown = [d for d in dims if d not in self.dimensions] + [
            m for m in names if m not in self.measures
        ]
        if unknown:
            raise KeyError(f"not in this metric view: {', '.join(unknown)}")
        rows = self.source if where is None else self.source.where(where)
        aggs = [self.measures[m]().alias(a) for m, a in names.items()]
        out = rows.groupBy(*dims).agg(*aggs) if aggs else rows.select(*dims).distinct()
        if having is not None:
            out = out.where(having)
        if order:
            out = out.orderBy(*order)
        return out if limit is None else out.limit(limit)


def _sum(col: str) -> Measure:
    return lambda: F.sum(col).cast("long")


def _count() -> Column:
    return F.count(F.lit(1))


def _share(cond: Callable[[], Column]) -> Measure:
    return lambda: pct(n_where(cond()), _count())


def doc_intake(reg: Registry, by_payer: bool = True) -> MetricView:
    """Intake volume over the per-payer view, or over the global one."""
    source = V.intake_daily_by_payer(reg) if by_payer else V.intake_daily(reg)
    return MetricView(
        source,
        ["intake_date", "is_volume_spike"],
        {
            "total_documents": _sum("total_docs"),
            "unreadable_documents": _sum("unreadable_docs"),
            "avg_ocr_quality": lambda: mean_exact(F.col("avg_quality_score"), 3),
            "fax_volume": _sum("via_fax"),
            "electronic_volume": _sum("via_electronic"),
            "upload_volume": _sum("via_upload"),
            "mail_volume": _sum("via_mail"),
            "spike_day_count": lambda: n_where(F.col("is_volume_spike")),
            "unreadable_rate_pct": lambda: pct(F.sum("unreadable_docs"), F.sum("total_docs")),
        },
    )


def doc_match(reg: Registry) -> MetricView:
    """Match quality; the ranking columns are not needed, so the plain detail serves."""
    return MetricView(
        V.match_detail_by_payer(reg),
        ["document_type", "source_channel", "match_class", "doc_risk_tier", "intake_date"],
        {
            "document_count": _count,
            "match_rate_pct": _share(lambda: F.col("match_class") == "match"),
            "avg_match_weight": lambda: mean_exact(F.col("match_weight"), 4),
            "high_risk_pct": _share(lambda: F.col("doc_risk_tier").like("High%")),
            "extraction_completeness_pct": _share(lambda: ~F.col("missing_dob") & ~F.col("missing_ssn4")),
            "non_match_count": lambda: n_where(F.col("match_class") == "non_match"),
        },
    )


def call_quality(reg: Registry) -> MetricView:
    """Call quality; built on call rows, as no measure reads the context columns."""
    return MetricView(
        V.call_rows(reg),
        ["agency_name", "call_type", "disposition", "outcome_bucket", "scored_date"],
        {
            "total_calls": _count,
            "avg_call_score": lambda: mean_int(F.col("call_score"), 1),
            "compliance_rate_pct": _share(lambda: F.col("outcome_bucket") == "compliant"),
            "high_risk_pct": _share(lambda: F.col("outcome_bucket") == "high_risk"),
            "escalation_count": lambda: n_where(F.col("disposition") == "escalated"),
            "escalation_rate_pct": _share(lambda: F.col("disposition") == "escalated"),
        },
    )


def prior_auth(reg: Registry) -> MetricView:
    """Prior-authorization decisions; rates are over approved, denied and partial ones."""
    judged = lambda: F.sum(F.col("approved") + F.col("denied") + F.col("partial"))
    return MetricView(
        V.pa_decisions_daily(reg),
        ["decision_date", "payer_code", "urgency"],
        {
            "pa_volume": _sum("total_decisions"),
            "approval_rate_pct": lambda: pct(F.sum("approved"), judged()),
            "denial_rate_pct": lambda: pct(F.sum("denied"), judged()),
            "sla_compliance_pct": lambda: pct(F.sum("within_sla_count"), F.sum("total_decisions")),
            # Mean of daily means, each day weighing the same.
            "avg_days_to_decision": lambda: mean_exact(F.col("avg_days_to_decision"), 2),
        },
    )


def payer_volume(reg: Registry) -> MetricView:
    """Payer mix; the approval rate is the plain mean of the payers' rates."""
    return MetricView(
        V.payer_mix(reg),
        ["payer_code", "payer_type"],
        {
            "documents": _sum("total_documents"),
            "pa_volume": _sum("total_pa_decisions"),
            "pa_approval_rate_pct": lambda: mean_exact(F.col("pa_approval_rate_pct"), 2),
        },
    )


def call_ops(reg: Registry) -> MetricView:
    """Call timings; wait and handle times are means of the daily means."""
    return MetricView(
        V.call_ops_daily(reg),
        ["ops_date", "agency_name", "call_type"],
        {
            "total_calls": _sum("total_calls"),
            "avg_wait_seconds": lambda: mean_exact(F.col("avg_wait_seconds"), 0),
            "avg_handle_seconds": lambda: mean_exact(F.col("avg_handle_seconds"), 0),
            "fcr_pct": lambda: pct(F.sum("fcr_resolved_count"), F.sum("total_calls")),
        },
    )


METRIC_VIEWS: dict[str, Callable[[Registry], MetricView]] = {
    "doc_intake": doc_intake,
    "doc_match": doc_match,
    "call_quality": call_quality,
    "prior_auth": prior_auth,
    "payer_volume": payer_volume,
    "call_ops": call_ops,
}
