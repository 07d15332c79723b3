"""Future-row generation (G1-G3, A3, J6-J8) and the monthly calendar.

Future rows = every distinct segment of the (filtered) history x every
future month, carrying the segment's exact cost medians and the month's
factors.  The month list is a generator (``explode(sequence(...))``) on
each segment row, so there is no cross join; the medians are one grouped
aggregate over the history (skew-safe, see ``medians``); the factor lookup
is a broadcast equi-join on month with the latest-row fallback.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.joins import factor_columns, factors_for_months
from ledgerlens.operators.medians import exact_medians
from ledgerlens.schema import COSTS, SEGMENT


def _as_date(v) -> _dt.date:
    if isinstance(v, _dt.datetime):
        return v.date()
    if isinstance(v, _dt.date):
        return v
    return _dt.date.fromisoformat(str(v))


def month_start(v) -> _dt.date:
    return _as_date(v).replace(day=1)


def next_month(d: _dt.date) -> _dt.date:
    return (d.replace(day=28) + _dt.timedelta(days=4)).replace(day=1)


def month_calendar(start, end):
    """G1 as a column: month starts from ``start``'s month to ``end``'s month
    inclusive (empty when end is before start)."""
    s, e = month_start(start), month_start(end)
    if e < s:
        return F.array().cast("array<date>")
    return F.sequence(F.lit(s), F.lit(e), F.expr("INTERVAL 1 MONTH"))


def future_start(last_history_date, forecast_start=None) -> _dt.date:
    """G2 (D3): the month after the last ledger date, or the month of
    ``forecast_start`` when that lies later."""
    nxt = next_month(month_start(last_history_date))
    if forecast_start is not None and _as_date(forecast_start) > _as_date(last_history_date):
        return max(nxt, month_start(forecast_start))
    return nxt


def segment_cost_medians(history: DataFrame, segment: list[str] | None = None) -> DataFrame:
    """A3 + J7: one row per distinct segment (NULL is a value) with the
    exact median of each cost column present."""
    seg = [c for c in (segment or SEGMENT) if c in history.columns]
    costs = [c for c in COSTS if c in history.columns]
    return exact_medians(history, seg, costs)


def future_rows(history: DataFrame, factors: DataFrame | None, start, end,
                segment: list[str] | None = None) -> DataFrame:
    """Segments x future months with cost medians and month factors.

    ``start``/``end`` are dates (see ``future_start``); the result has
    ``order_date`` (month start), the segment columns, the costs and the
    factors, and exactly ``segments x months`` rows."""
    med = segment_cost_medians(history, segment)
    rows = med.withColumn("order_date", F.explode(month_calendar(start, end)))
    if factors is not None and factor_columns(factors):
        rows = factors_for_months(rows, factors, month_col="order_date")
    return rows
