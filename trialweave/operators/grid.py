"""The cumulative grid of looks: calendar days are local and DST-safe, shorter steps absolute."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, date, datetime, time, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86400
_UNITS = {"s": 1, "sec": 1, "m": 60, "min": 60, "h": 3600, "hour": 3600, "d": DAY, "day": DAY, "w": 7 * DAY, "week": 7 * DAY}


def seconds(text: int | str) -> int:
    """A positive duration: whole seconds, or text like ``10min``, ``1h``, ``1d``, ``2w``."""
    if isinstance(text, bool):
        raise ValueError("a duration is a number of seconds or text")
    if isinstance(text, int):
        n = text
    else:
        m = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?\s*", text.lower()) or re.fullmatch(r"\s*(\d+)\s*(s)\s*", text.lower())
        if not m or m[2] not in _UNITS:
            raise ValueError(f"no duration: {text!r}")
        n = int(m[1]) * _UNITS[m[2]]
    if n <= 0:
        raise ValueError("a duration is positive")
    return n


def local_instant(value: date | datetime, zone: str) -> datetime:
    """A local wall-clock edge as naive UTC; of an ambiguous or skipped time, the first reading."""
    if not isinstance(value, datetime):
        value = datetime.combine(value, time())
    return value.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(UTC).replace(tzinfo=None)


def local_day(ts: datetime, zone: str) -> date:
    return ts.replace(tzinfo=UTC).astimezone(ZoneInfo(zone)).date()


@dataclass(frozen=True)
class Grid:
    start: datetime
    ends: tuple[datetime, ...]
    zone: str = "UTC"

    @property
    def horizon(self) -> datetime:
        return self.ends[-1]

    def frame(self, spark: SparkSession) -> DataFrame:
        """``look`` (from 0), ``end_ts``, ``is_horizon``, ``elapsed_days``."""
        rows = [(i, e, e == self.horizon, (e - self.start).total_seconds() / DAY) for i, e in enumerate(self.ends)]
        return spark.createDataFrame(rows, "look int, end_ts timestamp_ntz, is_horizon boolean, elapsed_days double")

    def look_of(self, ts: Column) -> Column:
        """The first look whose window holds ``ts``; null outside the whole window.

        An even grid needs arithmetic only; else the ends are searched.
        """
        micros = _micros(ts)
        ends = [_epoch(e) for e in self.ends]
        first = _epoch(self.start)
        step = {b - a for a, b in zip([first, *ends], ends)}
        inside = (micros >= first) & (micros < ends[-1])
        if len(step) == 1:
            at = F.floor((micros - F.lit(first)) / F.lit(step.pop())).cast("int")
        else:
            at = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= micros))
        return F.when(inside, at)


def _epoch(ts: datetime) -> int:
    return round((ts - datetime(1970, 1, 1)) / timedelta(microseconds=1))


def _micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    return F.unix_micros(F.to_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def make_grid(
    start: date | datetime, horizon: date | datetime, cadence=("1d",), zone: str = "UTC", anchor: str | datetime = "midnight", limit: int = 5000,
) -> Grid:
    """All looks ``anchor + k * every`` after the start up to the horizon, which is always one.

    ``cadence`` is a duration or segments ``(every, until)``, ``until`` counted from the
    start and null in the last; each segment steps coarser than the one before.  Steps of
    whole days fall on the anchor's local time of day.
    """
    begin, end = local_instant(start, zone), local_instant(horizon, zone)
    if end <= begin:
        raise ValueError("the horizon is not after the start")
    local_start = start if isinstance(start, datetime) else datetime.combine(start, time())
    base = {"midnight": datetime.combine(local_start.date(), time()), "start": local_start}.get(anchor, anchor) if isinstance(anchor, str) else anchor
    segments = [(cadence, None)] if isinstance(cadence, (str, int)) else [s if isinstance(s, tuple) else (s, None) for s in cadence]
    found: set[datetime] = set()
    low = begin
    for every, until in segments:
        step = seconds(every)
        high = end if until is None else min(end, _after(local_start, begin, seconds(until), zone))
        k = 0
        if step % DAY == 0:
            days = step // DAY
            k = max(0, (local_start.date() - base.date()).days // days - 1)
            at = lambda i, days=days: local_instant(base + timedelta(days=i * days), zone)
        else:
            origin = local_instant(base, zone)
            k = max(0, int((low - origin).total_seconds() // step) - 1)
            at = lambda i, step=step, origin=origin: origin + timedelta(seconds=i * step)
        while (point := at(k)) <= high:
            if point > low and point < end:
                found.add(point)
                if len(found) >= limit:
                    raise ValueError(f"more than {limit} looks")
            k += 1
        low = high
    return Grid(begin, (*sorted(found), end), zone)


def _after(local_start: datetime, begin: datetime, offset: int, zone: str) -> datetime:
    return local_instant(local_start + timedelta(seconds=offset), zone) if offset % DAY == 0 else begin + timedelta(seconds=offset)


def subsample(grid: Grid, cap: int) -> list[int]:
    """At most ``cap`` looks, dense early: squares of even steps, first and last kept, filled from the start."""
    n = len(grid.ends)
    if cap < 2:
        raise ValueError("a cap of two looks at least")
    if n <= cap:
        return list(range(n))
    chosen = {0, n - 1} | {round((k / (cap - 1)) ** 2 * (n - 1)) for k in range(cap)}
    spare = (i for i in range(n) if i not in chosen)
    while len(chosen) < cap:
        chosen.add(next(spare))
    return sorted(chosen)


def looks_before_horizon(grid: Grid) -> bool:
    """Whether the cadence gives any look before the last one."""
    return any(e < grid.horizon for e in grid.ends)


def pending(looks: DataFrame, computed: DataFrame, watermark: datetime, refresh_from: datetime | None = None) -> DataFrame:
    """Looks due at the watermark and not computed yet, or due for a refresh."""
    due = looks.filter(F.col("end_ts") <= F.lit(watermark).cast("timestamp_ntz"))
    fresh = computed.select("end_ts").distinct()
    if refresh_from is not None:
        fresh = fresh.filter(F.col("end_ts") < F.lit(refresh_from).cast("timestamp_ntz"))
    return due.join(fresh, "end_ts", "left_anti")


def closed_bound(origin: datetime, now: datetime, step: int, delay: int = 0) -> datetime | None:
    """The end of the last interval of ``step`` seconds that has closed and matured by ``now``."""
    k = int((now - origin - timedelta(seconds=delay)).total_seconds() // step)
    return origin + timedelta(seconds=k * step) if k > 0 else None


def closed_days(grid: Grid, watermark: datetime) -> list[tuple[date, datetime, datetime]]:
    """Whole local days within the grid that ended by the watermark; the first may open at the start."""
    out, day = [], local_day(grid.start, grid.zone)
    while True:
        a, b = local_instant(day, grid.zone), local_instant(day + timedelta(days=1), grid.zone)
        if b > min(watermark, grid.horizon):
            return out
        out.append((day, max(a, grid.start), b))
        day += timedelta(days=1)
