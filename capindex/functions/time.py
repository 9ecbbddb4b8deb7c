"""Time expressions: distance to an instant, date math, partial timestamps, CDX timestamp text."""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CDX_TIMESTAMP_FORMAT

UTC = _dt.timezone.utc


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def instant(t: str | _dt.datetime | int) -> _dt.datetime:
    """A UTC instant from ``datetime`` (naive = UTC), epoch seconds, ``yyyyMMddHHmmss`` (any prefix
    length >= 4 is padded with the smallest values) or ISO text (``2016-03-04T20:54:10Z``)."""
    if isinstance(t, _dt.datetime):
        return t.replace(tzinfo=UTC) if t.tzinfo is None else t.astimezone(UTC)
    if isinstance(t, int):
        return _dt.datetime.fromtimestamp(t, UTC)
    s = str(t).strip()
    if re.fullmatch(r"[0-9]{4,14}", s):
        return partial_range(s)[0]
    s = s[:-1] + "+00:00" if s.endswith("Z") else s
    return instant(_dt.datetime.fromisoformat(s))


def lit_ts(t) -> Column:
    """An instant as a TIMESTAMP literal (tz-aware datetimes are converted by PySpark)."""
    return F.lit(instant(t))


def epoch_ms(t) -> int:
    return int(instant(t).timestamp() * 1000)


def time_distance(date: Column | str, t) -> Column:
    """``|t - date|`` in milliseconds."""
    return F.abs(F.lit(epoch_ms(t)) - F.unix_millis(_c(date)))


def ts14(date: Column | str) -> Column:
    """The 14-digit CDX timestamp of an instant (session time zone is pinned to UTC)."""
    return F.date_format(_c(date), CDX_TIMESTAMP_FORMAT)


_UNITS = {4: "year", 6: "month", 8: "day", 10: "hour", 12: "minute", 14: "second"}


def partial_range(prefix: str) -> tuple[_dt.datetime, _dt.datetime]:
    """``'2014'``, ``'201401'``, ``'20140105'`` ... -> half-open UTC range ``[start, start + unit)``.

    Computed on the driver so the filter reaches the scan as two literal bounds.
    """
    if not re.fullmatch(r"[0-9]+", prefix) or len(prefix) not in _UNITS:
        raise ValueError(f"partial timestamp must have 4, 6, 8, 10, 12 or 14 digits: {prefix!r}")
    full = prefix + "00000101000000"[len(prefix):]
    start = _dt.datetime.strptime(full, "%Y%m%d%H%M%S").replace(tzinfo=UTC)
    unit = _UNITS[len(prefix)]
    if unit == "year":
        end = start.replace(year=start.year + 1)
    elif unit == "month":
        end = start.replace(year=start.year + start.month // 12, month=start.month % 12 + 1)
    else:
        end = start + {"day": _dt.timedelta(days=1), "hour": _dt.timedelta(hours=1),
                       "minute": _dt.timedelta(minutes=1), "second": _dt.timedelta(seconds=1)}[unit]
    return start, end


_MATH = re.compile(r"([+-])(\d+)(YEAR|MONTH|DAY|HOUR|MINUTE|SECOND)S?", re.I)


def date_math(now, truncate: str | None = None, add: str | None = None) -> Column:
    """Date math on an explicit ``now``: ``truncate='DAY'`` then ``add='+6MONTHS+3DAYS'`` or ``'-1DAY'``.

    ``now`` is passed in (a literal instant or a Column) so results are reproducible.
    """
    c = now if isinstance(now, Column) else lit_ts(now)
    if truncate:
        c = F.date_trunc(truncate.upper(), c)
    if add:
        pos = 0
        for m in _MATH.finditer(add):
            if m.start() != pos:
                raise ValueError(f"bad date math: {add!r}")
            pos = m.end()
            sign = 1 if m.group(1) == "+" else -1
            c = c + F.expr(f"INTERVAL {sign * int(m.group(2))} {m.group(3).upper()}")
        if pos != len(add):
            raise ValueError(f"bad date math: {add!r}")
    return c
