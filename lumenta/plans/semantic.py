"""Governed metrics: definitions with an owner, a version and an approval state, and the frames built from them.

A metric is a sum, a count, a mean, an extreme, a distinct count or a ratio. Frames carry numerators and denominators
that add up; a mean or a ratio is taken last, so that coarser totals are never sums or means of ratios.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenta.sources.tables import within

KINDS = ("sum", "avg", "min", "max", "count", "count_distinct", "ratio")
WRITES = re.compile(r"\b(insert|update|delete|drop|alter|create|truncate|grant|merge|copy|call)\b", re.IGNORECASE)


@dataclass(frozen=True)
class Metric:
    """expression is the value of a row (sum, avg, ...) or of a ratio's numerator; denominator that of its denominator."""

    key: str
    label: str
    kind: str
    expression: str
    date_column: str
    base: str
    denominator: str | None = None
    dimensions: tuple[str, ...] = ()
    filters: tuple[str, ...] = ()
    description: str = ""
    unit: str = ""
    owner: str = ""
    higher_is_better: bool = True
    version: int = 1
    status: str = "draft"
    approver: str | None = None


class NotApproved(PermissionError):
    pass


def guard(metric: Metric) -> None:
    """Definitions are single read-only expressions; a ratio names both sides."""
    if metric.kind not in KINDS:
        raise ValueError(f"{metric.key}: unknown kind {metric.kind!r}")
    for text in filter(None, (metric.expression, metric.denominator, *metric.filters)):
        if ";" in text or WRITES.search(text):
            raise ValueError(f"{metric.key}: {text!r} is not a read-only expression")
    if metric.kind == "ratio" and not metric.denominator:
        raise ValueError(f"{metric.key}: a ratio needs a denominator")


@dataclass
class Registry:
    metrics: dict[str, Metric] = field(default_factory=dict)

    def register(self, metric: Metric) -> Metric:
        guard(metric)
        old = self.metrics.get(metric.key)
        own = replace(metric, version=old.version + 1 if old else 1, status="draft", approver=None)
        self.metrics[metric.key] = own
        return own

    def _set(self, key: str, **changes) -> Metric:
        self.metrics[key] = replace(self.metrics[key], **changes)
        return self.metrics[key]

    def approve(self, key: str, approver: str) -> Metric:
        return self._set(key, status="approved", approver=approver)

    def deprecate(self, key: str) -> Metric:
        return self._set(key, status="deprecated")

    def approved(self, key: str) -> Metric:
        if key not in self.metrics:
            raise KeyError(key)
        if self.metrics[key].status != "approved":
            raise NotApproved(f"{key} is {self.metrics[key].status}, not approved")
        return self.metrics[key]

    def listed(self, status: str | None = None) -> list[Metric]:
        return [m for _, m in sorted(self.metrics.items()) if status in (None, m.status)]

    def search(self, text: str, limit: int = 5) -> list[tuple[str, int]]:
        """(key, score): shared words of key, label and description, and three more where the text has the key as a phrase."""
        words, low = set(re.findall(r"[a-z0-9]+", text.lower())), text.lower()
        scored = []
        for m in self.metrics.values():
            own = set(re.findall(r"[a-z0-9]+", f"{m.key} {m.label} {m.description}".lower().replace("_", " ")))
            score = len(words & own) + 3 * (m.key.replace("_", " ") in low)
            if score:
                scored.append((m.key, score))
        return sorted(scored, key=lambda x: (-x[1], x[0]))[:limit]


def default_registry() -> Registry:
    """The seven governed metrics over the sales, sales_lines, customers and tickets views."""
    out = Registry()
    dims = ("region", "segment", "channel")
    for m in (
        Metric("revenue", "Net revenue", "sum", "total_amount", "order_date", "sales", dimensions=dims, description="Completed order value", unit="currency", owner="finance"),
        Metric("order_count", "Orders", "count", "order_id", "order_date", "sales", dimensions=dims, description="Number of completed orders", unit="count", owner="operations"),
        Metric("average_order_value", "Average order value", "ratio", "total_amount", "order_date", "sales", denominator="case when order_id is not null then 1 end", dimensions=dims, description="Revenue by completed order", unit="currency", owner="operations"),
        Metric("churn_rate", "Customer churn rate", "ratio", "churned", "period_start", "customers", denominator="active_at_start", dimensions=("region", "segment"), description="Customers lost in a period among those active at its start", unit="percent", owner="success", higher_is_better=False),
        Metric("support_first_response_hours", "First response time", "avg", "hours", "created_date", "tickets", dimensions=("category",), description="Mean hours to the first response", unit="hours", owner="support", higher_is_better=False),
        Metric("csat", "Customer satisfaction", "avg", "csat", "created_date", "tickets", dimensions=("category",), description="Mean satisfaction from 1 to 5", unit="score", owner="support"),
        Metric("discount_rate", "Effective discount rate", "ratio", "discount_amount", "order_date", "sales_lines", denominator="gross_amount", dimensions=("category",), description="Discounts as a share of gross value", unit="percent", owner="finance", higher_is_better=False),
    ):
        out.register(m)
        out.approve(m.key, "seed")
    return out


def metric_sql(metric: Metric, start: date, end: date, dims: list[str] | None = None) -> str:
    """The statement that gives the metric by day and dimensions between two days, both included; it is what admission judges."""
    own = [d for d in (metric.dimensions if dims is None else dims)]
    value = {
        "sum": f"sum({metric.expression})", "count": f"count({metric.expression})", "avg": f"avg({metric.expression})", "min": f"min({metric.expression})", "max": f"max({metric.expression})",
        "count_distinct": f"count(distinct {metric.expression})", "ratio": f"sum({metric.expression}) / nullif(sum({metric.denominator}), 0)",
    }[metric.kind]
    keys = ", ".join([metric.date_column, *own])
    where = " and ".join([f"{metric.date_column} between date '{start}' and date '{end}'", *(f"({c})" for c in metric.filters)])
    return f"select {keys}, {value} as {metric.key} from {metric.base} where {where} group by {keys}"


def inferred_columns(frame: DataFrame, metric: Metric) -> tuple[str, str | None]:
    """(value column, date column) of a result that need not have the metric's own names: its key, else the last numeric column; its
    date column, else the first date or timestamp, else none. A frame without any number can't be analysed."""
    numbers = [f.name for f in frame.schema if isinstance(f.dataType, T.NumericType)]
    days = [f.name for f in frame.schema if isinstance(f.dataType, T.DateType | T.TimestampType | T.TimestampNTZType)]
    value = metric.key if metric.key in frame.columns else numbers[-1] if numbers else None
    if value is None:
        raise ValueError("the result has no numeric column")
    return value, metric.date_column if metric.date_column in frame.columns else days[0] if days else None


def partials(metric: Metric) -> dict[str, Column]:
    """Aggregates that can be added up again: num, and den for means and ratios. Distinct counts and extremes have no sum."""
    x = F.expr(metric.expression)
    return {
        "sum": lambda: {"num": F.coalesce(F.sum(x), F.lit(0))},
        "count": lambda: {"num": F.count(x)},
        "avg": lambda: {"num": F.coalesce(F.sum(x), F.lit(0)), "den": F.count(x)},
        "ratio": lambda: {"num": F.coalesce(F.sum(x), F.lit(0)), "den": F.coalesce(F.sum(F.expr(metric.denominator)), F.lit(0))},
        "min": lambda: {"num": F.min(x)},
        "max": lambda: {"num": F.max(x)},
        "count_distinct": lambda: {"num": F.countDistinct(x)},
    }[metric.kind]()


def finished(metric: Metric) -> Column:
    return F.col("num") / F.nullif(F.col("den"), F.lit(0)) if metric.kind in ("avg", "ratio") else F.col("num")


def available(metric: Metric, frame: DataFrame, dims: list[str] | None = None) -> tuple[list[str], list[str]]:
    """Dimensions that the frame has, and those that it lacks."""
    asked = list(metric.dimensions if dims is None else dims)
    return [d for d in asked if d in frame.columns], [d for d in asked if d not in frame.columns]


def metric_frame(frame: DataFrame, metric: Metric, start: date | None = None, end: date | None = None, dims: list[str] | None = None, grain: str = "day", keep_null_dims: bool = True) -> DataFrame:
    """ds, dimensions, num (and den), and the metric under its key: one row for each day (or month, week) and dimensions."""
    have, _ = available(metric, frame, dims)
    rows = frame.where(within(F.col(metric.date_column).cast("timestamp_ntz"), start, end))
    for condition in metric.filters:
        rows = rows.where(F.expr(f"({condition})"))
    if not keep_null_dims:
        rows = rows.dropna(subset=have)
    day = F.col(metric.date_column) if grain == "day" else F.date_trunc(grain, metric.date_column)
    out = rows.groupBy(day.cast("date").alias("ds"), *have).agg(*[c.alias(n) for n, c in partials(metric).items()])
    return out.withColumn(metric.key, finished(metric))


def rolled_up(metric: Metric, frame: DataFrame, by: list[str]) -> DataFrame:
    """A metric frame at a coarser grain, from its partial sums."""
    if metric.kind == "count_distinct":
        raise ValueError("distinct counts don't add up; take them from base rows")
    parts = [F.min("num").alias("num")] if metric.kind == "min" else [F.max("num").alias("num")] if metric.kind == "max" else [F.sum(c).alias(c) for c in ("num", "den") if c in frame.columns]
    return frame.groupBy(*by).agg(*parts).withColumn(metric.key, finished(metric))


def periods(last: date, days: int = 31) -> tuple[tuple[date, date], tuple[date, date]]:
    """(previous, current): the last days up to a day, and as many before them."""
    start = last - timedelta(days=days - 1)
    return (start - timedelta(days=days), start - timedelta(days=1)), (start, last)


def churn(orders: DataFrame, customer: str, day: str, start: date, end: date, by: list[str]) -> DataFrame:
    """by, churned, active_at_start, churn_rate: a customer is lost if its last order lies in the window; it was active if its first lies before."""
    life = orders.groupBy(customer, *by).agg(F.min(day).alias("first"), F.max(day).alias("last"))
    active = life.where((F.col("first") < F.lit(start)) & (F.col("last") >= F.lit(start)))
    lost = F.sum(F.when(F.col("last") <= F.lit(end), 1).otherwise(0))
    out = active.groupBy(*by).agg(lost.alias("churned"), F.count("*").alias("active_at_start"))
    return out.withColumn("churn_rate", F.col("churned") / F.nullif(F.col("active_at_start"), F.lit(0)))


def segment_baseline(frame: DataFrame, dim: str, value: str, days: int) -> DataFrame:
    """dim, daily: a segment's total by day of a span."""
    return frame.groupBy(dim).agg((F.sum(value) / F.lit(days)).alias("daily"))
