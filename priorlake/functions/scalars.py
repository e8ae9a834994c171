"""Scalar expressions."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EASTERN = "America/New_York"
DEFAULT_TIME = "13:00"
EPS = 1e-9


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null when b is 0 or null (ANSI mode raises on a plain division)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def local_to_utc(day: Column, time: Column, zone: str = EASTERN, default: str = DEFAULT_TIME) -> Column:
    """UTC instant of a local date and HH:MM; null where the local time does not exist or repeats."""
    local = F.try_to_timestamp(F.concat_ws(" ", day.cast("string"), F.coalesce(time, F.lit(default))), F.lit("yyyy-MM-dd HH:mm"))
    utc = F.to_utc_timestamp(local, zone)
    hour = F.expr("INTERVAL 1 HOUR")
    exists = F.from_utc_timestamp(utc, zone) == local
    repeats = (F.from_utc_timestamp(utc + hour, zone) == local) | (F.from_utc_timestamp(utc - hour, zone) == local)
    return F.when(exists & ~repeats, utc)


def report_due(kickoff: Column, zone: str = EASTERN, hour: int = 16) -> Column:
    """UTC time of the last status report: the day before a Thursday contest, else two days before."""
    local = F.from_utc_timestamp(kickoff, zone)
    lead = F.when(F.weekday(local) == 3, 1).otherwise(2)
    day = F.date_sub(F.to_date(local), lead)
    return F.to_utc_timestamp(F.make_timestamp(F.year(day), F.month(day), F.day(day), F.lit(hour), F.lit(0), F.lit(0.0)), zone)


def local_text(ts: Column, zone: str = EASTERN) -> Column:
    """'Fri Sep 25 4:00pm' in local time."""
    local = F.from_utc_timestamp(ts, zone)
    return F.concat(F.date_format(local, "EEE MMM dd h:mm"), F.lower(F.date_format(local, "a")))


# (label, weekday from Monday 0 or None for any, first hour, hour after the last); the first that fits counts.
SLOTS = (
    ("morning", None, 0, 12), ("sunday early", 6, 12, 15), ("sunday late", 6, 15, 19), ("sunday evening", 6, 19, 24), ("monday", 0, 12, 19),
    ("monday evening", 0, 19, 24), ("thursday", 3, 12, 19), ("thursday evening", 3, 19, 24), ("saturday", 5, 12, 24), ("weekday", None, 12, 24),
)
NO_SLOT = "no time"


def time_slot(weekday: Column, time: Column, slots: Sequence[tuple] = SLOTS, missing: str = NO_SLOT) -> Column:
    """Label of the first slot that holds a weekday and a local HH:MM."""
    hour = F.split(time, ":")[0].try_cast("int")
    table = F.array(*[F.struct(*[F.lit(v).cast(k).alias(n) for n, v, k in zip(("label", "day", "low", "high"), row, ("string", "int", "int", "int"))]) for row in slots])
    fits = F.filter(table, lambda s: F.coalesce(s["day"] == weekday, F.lit(True)) & (hour >= s["low"]) & (hour < s["high"]))
    return F.coalesce(F.try_element_at(fits, F.lit(1))["label"], F.lit(missing))


def time_slot_sql(weekday: str, hour: str, slots: Sequence[tuple] = SLOTS, missing: str = NO_SLOT) -> str:
    """The same rule as a CASE expression."""
    when = lambda day, low, high: " AND ".join([f"{weekday} = {day}"] * (day is not None) + [f"{hour} >= {low}", f"{hour} < {high}"])
    return "CASE " + " ".join(f"WHEN {when(d, low, high)} THEN '{label}'" for label, d, low, high in slots) + f" ELSE '{missing}' END"


def lookup(key: Column, table: Mapping, default) -> Column:
    """Dictionary value with a default for unknown and null keys."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, key), F.lit(default))


def status_weight(status: Column, out: Sequence[str], doubtful: str, doubtful_weight: float) -> Column:
    """1 for an unavailable status, a fraction for the uncertain one, else 0."""
    return F.when(status.isin(*out), 1.0).when(status == doubtful, doubtful_weight).otherwise(0.0)


def right_closed_bin(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the bin (lo, hi]; null outside all bins."""
    out = None
    for lo, hi, label in zip(edges, edges[1:], labels):
        hit = (x > lo) & (x <= hi)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def left_closed_bin(x: Column, inner: Sequence[float]) -> Column:
    """Bin number by inner edges, [lo, hi): the outer bins are open-ended."""
    total = F.lit(0)
    for e in inner:
        total = total + (x >= e).cast("int")
    return total


def tidy(x: Column, digits: int = 1) -> Column:
    """Rounded, with negative zero turned into zero."""
    return F.round(x, digits) + F.lit(0.0)


def _odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    return p / (1 - p)


def log5(p: Column, q: Column, base: Column) -> Column:
    """Odds-ratio combination of an own rate and a faced rate against a baseline."""
    odds = _odds(p) * _odds(q) / _odds(base)
    return odds / (1 + odds)


def blend_distribution(off: Column, faced: Column, base: Column) -> Column:
    """Element-wise log5 of three arrays, renormalised to sum to 1."""
    mixed = F.transform(F.arrays_zip(off.alias("o"), faced.alias("f"), base.alias("b")), lambda s: log5(s["o"], s["f"], s["b"]))
    return normalised(mixed)


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def normalised(a: Column) -> Column:
    """Scaled to sum to 1. Boxing the array in a one-element array evaluates it once."""

    def scale(v: Column) -> Column:
        total = array_sum(v)
        return F.transform(v, lambda x: x / F.when(total > 0, total).otherwise(F.lit(1.0)))

    return F.transform(F.array(a), scale)[0]


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def is_provisional(final: Column) -> Column:
    """Only an explicit "not final" counts; a missing value is unknown, hence false."""
    return F.coalesce(F.lower(F.trim(final.cast("string"))).isin("false", "0", "no"), F.lit(False))


def made_before_report(final: Column, generated_at: Column, kickoff: Column) -> Column:
    """Provisional by the record's own flag, or by its times where the flag is missing."""
    return F.when(final.isNotNull(), is_provisional(final)).otherwise(
        F.coalesce(generated_at < report_due(kickoff), F.lit(False))
    )


def block_id(season: Column, week: Column) -> Column:
    return (season * 100 + week).cast("long")


def log_loss_term(p: Column, y: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    return -(y * F.log(p) + (1 - y) * F.log(1 - p))


def season_of(day: Column, rollover: str = "0315") -> Column:
    """Season a date belongs to: the year starts at the rollover month and day."""
    return F.year(day) - (F.date_format(day, "MMdd") < rollover).cast("int")
