"""Date parsing and calendar features."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


_MONTHS = ("jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|"
           "sep(?:t|tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?")
_TIME = r"(?:[t ]+\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)? ?(?:[ap]m)?(?: ?(?:z|utc|[+-]\d{2}:?\d{2}))?)?"
_NTH = r"(?:st|nd|rd|th)?"
# two-digit years above this one belong to the last century (within fifty years of 2025)
_PIVOT = 75


def _month_number(name: Column) -> Column:
    return F.ceil(F.position(F.substring(name, 1, 3), F.lit("janfebmaraprmayjunjulaugsepoctnovdec")) / 3).cast("string")


def _year(text: Column) -> Column:
    short = F.length(text) == 2
    return F.when(short & (text.cast("int") > _PIVOT), F.concat(F.lit("19"), text)).when(short, F.concat(F.lit("20"), text)).otherwise(text)


def _date(y: Column, m: Column, d: Column) -> Column:
    """Year, month and day as texts of digits -> DATE; impossible ones NULL.
    The cast checks ranges itself and throws nothing."""
    return F.concat_ws("-", y, m, d).try_cast("date")


def parse_ledger_date(c) -> Column:
    """Text (or date/timestamp) -> DATE.

    Month first for slashes, dashes and dots (``01/02/2020`` and
    ``05-03-2021`` are 2 January and 3 May) unless there is no such month
    (``13/02/2020``); ISO with or without a time; compact ``yyyyMMdd``; year
    first; months by name before or after the day; month and year alone are
    the first of the month.  Anything else gives NULL; nothing raises.

    A plain ISO date is cast as it is.  The other shapes are a function of an
    array's element: inlined in the generated code, they make a method too long
    to be compiled, in which all columns beside the date are slow too."""
    s = F.lower(F.trim(_col(c).cast("string")))
    iso = (F.length(s) == 10) & (F.substring(s, 5, 1) == "-") & (F.substring(s, 8, 1) == "-")
    return F.coalesce(F.when(iso, s.try_cast("date")), F.get(F.transform(F.array(s), _shaped_date), F.lit(0)))


def _shaped_date(s: Column) -> Column:
    """The date of a trimmed text in lower case, by its shape."""
    one = F.lit("1")

    def shape(rx: str, build) -> tuple[Column, Column]:
        groups = [F.regexp_extract(s, rx, k) for k in range(1, 5) if k <= rx.replace(r"\(", "").count("(") - rx.count("(?:")]
        return s.rlike(rx), build(*groups)

    def parts(rx: str, ymd: str) -> tuple[Column, Column]:
        """A shape whose text turns into year-month-day by one replacement."""
        return s.rlike(rx), F.regexp_replace(s, rx, ymd).try_cast("date")

    shapes = [
        parts(rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_TIME}$", "$1-$2-$3"),
        shape(rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}}){_TIME}$", lambda a, b, y: F.when(
            a.cast("int") <= 12, _date(_year(y), a, b)).otherwise(_date(_year(y), b, a))),
        parts(rf"^(\d{{4}})(\d{{2}})(\d{{2}}){_TIME}$", "$1-$2-$3"),
        parts(r"^(\d{4})[-/](\d{1,2})$", "$1-$2-1"),
        parts(r"^(\d{1,2})[-/](\d{4})$", "$2-$1-1"),
        shape(rf"^({_MONTHS})[-./ ]*(\d{{4}})$", lambda m, y: _date(y, _month_number(m), one)),
        shape(rf"^({_MONTHS})-(\d{{2}})$", lambda m, y: _date(_year(y), _month_number(m), one)),
        shape(rf"^({_MONTHS})[-. ]+(\d{{1,2}}){_NTH}[-, ]+(\d{{4}}){_TIME}$", lambda m, d, y: _date(y, _month_number(m), d)),
        shape(rf"^(\d{{1,2}}){_NTH}[-. ]*({_MONTHS})[-., ]*(\d{{4}}|\d{{2}}){_TIME}$", lambda d, m, y: _date(_year(y), _month_number(m), d)),
    ]
    out = None
    for fits, value in shapes:
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def parse_factor_date(c) -> Column:
    """P4 then P3: ``Mon-YY`` (``Jan-20`` -> 2020-01-01) is tested before the
    generic formats, which would otherwise misread it."""
    s = F.lower(F.trim(_col(c).cast("string")))
    mon_yy = _date(F.concat(F.lit("20"), F.substring(s, 5, 2)), _month_number(s), F.lit("1"))
    return F.when(s.rlike(rf"^(?:{_MONTHS})-\d{{2}}$") & (F.length(s) == 6), mon_yy).otherwise(parse_ledger_date(s))


def date_from_year_mo(year, mo) -> Column:
    """P5: first day of ``year``/``mo``; bad parts -> NULL (make_date would raise)."""
    y = _col(year).cast("string").try_cast("double").try_cast("int")
    m = _col(mo).cast("string").try_cast("double").try_cast("int")
    txt = F.format_string("%04d-%02d-01", y, m)
    return F.to_date(F.try_to_timestamp(txt, F.lit("yyyy-MM-dd")))


def month_key(c) -> Column:
    """Month start of a date."""
    return F.trunc(_col(c), "MM")


def calendar_features(d) -> dict[str, Column]:
    """P7 + P8: the eleven date features of the model matrix, from a DATE.

    day_of_week is Monday = 0 (``weekday``), not ``dayofweek`` (Sunday = 1)."""
    d = _col(d)
    month = F.month(d)
    dow = F.weekday(d)
    two_pi = 2 * math.pi
    return {
        "year": F.year(d),
        "month_no": month,
        "day": F.dayofmonth(d),
        "day_of_week": dow,
        "quarter": F.quarter(d),
        "is_month_end": (d == F.last_day(d)).cast("int"),
        "is_month_start": (F.dayofmonth(d) == 1).cast("int"),
        "month_sin": F.sin(F.lit(two_pi) * month / 12),
        "month_cos": F.cos(F.lit(two_pi) * month / 12),
        "day_of_week_sin": F.sin(F.lit(two_pi) * dow / 7),
        "day_of_week_cos": F.cos(F.lit(two_pi) * dow / 7),
    }
