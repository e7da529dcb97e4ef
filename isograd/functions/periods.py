"""Resampling periods (pandas offset aliases) as Column expressions over TIMESTAMP_NTZ."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from isograd.model import ValidationError, ntz

# Names used inside offset aliases.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
MONTH_BASED = {"MS": 1, "M": 1, "ME": 1, "QS": 3, "Q": 3, "QE": 3,
               "YS": 12, "AS": 12, "Y": 12, "YE": 12, "A": 12}
END_LABELLED = {"M", "ME", "Q", "QE", "Y", "YE", "A"}
SECONDS = {"D": 86400, "H": 3600, "h": 3600, "T": 60, "min": 60, "S": 1, "s": 1}


@dataclass(frozen=True)
class Period:
    """``count`` × ``unit``; months for calendar units, seconds for clock units, W for weeks."""

    alias: str
    unit: str
    count: int
    anchor: str | None

    @classmethod
    def parse(cls, alias: str) -> Period:
        found = re.fullmatch(r"(\d*)([A-Za-z]+?)(?:-([A-Z]{3}))?", alias or "")
        if not found:
            raise ValidationError(f'invalid period "{alias}"')
        count, unit, anchor = int(found[1] or 1), found[2], found[3]
        anchors = WEEKDAYS if unit == "W" else MONTHS if MONTH_BASED.get(unit, 1) > 1 else ()
        known = unit in MONTH_BASED or unit in SECONDS or unit == "W"
        if not known or count < 1 or (anchor and anchor not in anchors):
            raise ValidationError(f'invalid period "{alias}"')
        if count > 1 and (unit == "W" or anchor or (unit in MONTH_BASED and unit != "MS")):
            raise ValidationError(f'period "{alias}" is not supported')
        return cls(alias, unit, count, anchor)

    def bin(self, time: Column, first: dt.datetime) -> Column:
        """The label of the bin a time falls into; blocks count from ``first``."""
        if self.unit == "W":
            return self._week(time)
        if self.unit in SECONDS:
            origin = ntz(dt.datetime(first.year, first.month, first.day))
            size = self.count * SECONDS[self.unit]
            if size % 86400 == 0:
                blocks = F.floor(F.datediff(time, origin) / (size // 86400)) * (size // 86400)
                return F.date_add(origin.cast("date"), blocks.cast("int")).cast("timestamp_ntz")
            seconds = (F.unix_seconds(time.cast("timestamp"))
                       - F.unix_seconds(origin.cast("timestamp")))
            return F.timestamp_seconds(
                F.unix_seconds(origin.cast("timestamp")) + F.floor(seconds / size) * size
            ).cast("timestamp_ntz")
        start = self._block(time, first)
        if self.unit in END_LABELLED:
            last_month = F.add_months(start, MONTH_BASED[self.unit] - 1)
            return F.last_day(last_month).cast("timestamp_ntz")
        return start.cast("timestamp_ntz")

    def _block(self, time: Column, first: dt.datetime) -> Column:
        """First day of the block of months."""
        length = MONTH_BASED[self.unit] * self.count
        month = F.year(time) * 12 + F.month(time) - 1
        if self.unit == "MS":
            origin = first.year * 12 + first.month - 1
        elif self.anchor is None:
            origin = 0
        else:
            named = MONTHS.index(self.anchor)
            # an end-labelled anchor names the last month of the block, a start anchor the first
            origin = named + 1 if self.unit in END_LABELLED else named
        index = month - F.pmod(month - F.lit(origin), F.lit(length))
        return F.make_date(F.floor(index / 12).cast("int"),
                           (F.pmod(index, F.lit(12)) + 1).cast("int"), F.lit(1))

    def _week(self, time: Column) -> Column:
        """Weeks are closed and labelled on the right, by their last day (Sunday by default)."""
        day = self.anchor or "SUN"
        return F.next_day(F.date_sub(time.cast("date"), 1), day).cast("timestamp_ntz")

    def labels(self, low: Column, high: Column) -> Column:
        """All bin labels from ``low`` to ``high``, both of them labels, as an array."""
        low_day, high_day = low.cast("date"), high.cast("date")
        if self.unit in MONTH_BASED:
            months = F.expr(f"interval {MONTH_BASED[self.unit] * self.count} months")
            if self.unit in END_LABELLED:
                starts = F.sequence(F.trunc(low_day, "month"), F.trunc(high_day, "month"), months)
                return F.transform(starts, lambda d: F.last_day(d).cast("timestamp_ntz"))
            days = F.sequence(low_day, high_day, months)
        elif self.unit == "W":
            days = F.sequence(low_day, high_day, F.expr("interval 7 days"))
        else:
            seconds = SECONDS[self.unit] * self.count
            return F.sequence(low, high, F.expr(f"interval {seconds} seconds"))
        return F.transform(days, lambda d: d.cast("timestamp_ntz"))
