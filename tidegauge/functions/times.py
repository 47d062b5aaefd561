"""Time arithmetic on TIMESTAMP_NTZ columns, window tags and time ranges."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of a window tag such as w01h-s10m, in seconds.
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}

DAY_SECONDS = 86400


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970-01-01 as BIGINT, without any zone conversion."""
    return (
        F.unix_date(ts.cast("date")).cast("bigint") * DAY_SECONDS
        + F.hour(ts) * 3600
        + F.minute(ts) * 60
        + F.second(ts)
    ).cast("bigint")


def from_epoch_seconds(seconds: Column) -> Column:
    """Inverse of :func:`epoch_seconds`, as TIMESTAMP_NTZ."""
    origin = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return origin + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def parse_window_tag(tag: str) -> tuple[int, int]:
    """``w01h-s10m`` -> (3600, 600): window length and slide in seconds."""
    found = re.fullmatch(r"w(\d+)([smhd])-s(\d+)([smhd])", tag.strip())
    if not found:
        raise ValueError(f"not a window tag: {tag!r}")
    length, length_unit, slide, slide_unit = found.groups()
    return int(length) * UNIT_SECONDS[length_unit], int(slide) * UNIT_SECONDS[slide_unit]


@dataclass(frozen=True)
class DayRange:
    """Range of days with open or closed ends, written ``<a,b)``, ``(a,b>`` etc."""

    begin: date
    end: date
    left_closed: bool = True
    right_closed: bool = False

    @classmethod
    def of(cls, text: "str | DayRange") -> "DayRange":
        if isinstance(text, DayRange):
            return text
        text = text.strip()
        if text[:1] not in "<(" or text[-1:] not in ">)" or "," not in text:
            raise ValueError(f"not a time range: {text!r}")
        begin, end = (date.fromisoformat(part.strip()[:10]) for part in text[1:-1].split(",", 1))
        return cls(begin, end, text[0] == "<", text[-1] == ">")

    def covers(self, day: Column) -> Column:
        low = day >= F.lit(self.begin) if self.left_closed else day > F.lit(self.begin)
        high = day <= F.lit(self.end) if self.right_closed else day < F.lit(self.end)
        return low & high

    def __str__(self) -> str:
        left = "<" if self.left_closed else "("
        right = ">" if self.right_closed else ")"
        return f"{left}{self.begin},{self.end}{right}"


def covered_by_any(day: Column, ranges: list["str | DayRange"]) -> Column:
    """True where ``day`` lies in at least one of the ranges."""
    tests = [DayRange.of(r).covers(day) for r in ranges]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


# Fixed value: text form of a partial date, year with optional month and day.
PARTIAL_DATE = r"(\d{4})(?:[^0-9]?(\d{2})(?:[^0-9]?(\d{2}))?)?"


def partial_date_bounds(text: Column, inclusive_end: bool = True) -> tuple[Column, Column]:
    """Expand ``2019``, ``2019-01``, ``2019-01-05`` or ``a--b`` to begin and end dates.

    A single partial date covers its whole unit; the exclusive form ends at the
    start of the next unit. In ``a--b`` the inclusive end is the last day of
    b's unit and the exclusive end its first day. Other text gives NULL.
    """
    single = rf"^\s*{PARTIAL_DATE}\s*$"
    pair = rf"^\s*{PARTIAL_DATE}\s*--\s*{PARTIAL_DATE}\s*$"

    def part(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("int")

    def first_day(year: Column, month: Column, day: Column) -> Column:
        return F.make_date(year, F.coalesce(month, F.lit(1)), F.coalesce(day, F.lit(1)))

    def next_unit(start: Column, month: Column, day: Column) -> Column:
        return (
            F.when(month.isNull(), F.add_months(start, 12))
            .when(day.isNull(), F.add_months(start, 1))
            .otherwise(F.date_add(start, 1))
        )

    one = [part(single, g) for g in (1, 2, 3)]
    left = [part(pair, g) for g in (1, 2, 3)]
    right = [part(pair, g) for g in (4, 5, 6)]
    one_first, right_first = first_day(*one), first_day(*right)
    one_next = next_unit(one_first, one[1], one[2])
    if inclusive_end:
        one_end = F.date_sub(one_next, 1)
        right_end = F.date_sub(next_unit(right_first, right[1], right[2]), 1)
    else:
        one_end, right_end = one_next, right_first
    is_pair = F.regexp_like(text, F.lit(pair))
    begin = F.when(is_pair, first_day(*left)).otherwise(one_first)
    end = F.when(is_pair, right_end).otherwise(one_end)
    return begin, end
