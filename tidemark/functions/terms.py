"""Solar terms: the sun's apparent longitude as a short series in column arithmetic, and the instants at which it reaches a mark.

Instants are days since 2000-01-01 00:00 UT, as doubles.  The series holds the
longitude to about a hundredth of a degree, a quarter of an hour, in the
centuries around 2000.  Civil time is eight hours ahead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE_HOURS = 8
# The mean longitude, the anomaly and the centre's equation, by powers of Julian centuries, and the 64 seconds of dynamical time.
CENTURY, NOON, DELTA = 36525.0, 0.5, 64 / 86400
TROPICAL = 365.2422


def instant(day: Column, hours: float | Column) -> Column:
    """The instant of a civil date and hours after its midnight."""
    return F.datediff(day, F.to_date(F.lit("2000-01-01"))).cast("double") + (hours - ZONE_HOURS) / 24.0


def instant_sql(day: str, hours: float | str) -> str:
    return f"(({day} - DATE '2000-01-01')::DOUBLE + ({hours} - {ZONE_HOURS}) / 24.0::DOUBLE)"


def longitude(at: Column) -> Column:
    """Apparent longitude of the sun in degrees, from 0 to below 360."""
    t = (at - NOON + DELTA) / CENTURY
    m = F.radians(t * 35999.05029 + 357.52911)
    centre = F.sin(m) * (1.914602 - t * 0.004817) + F.sin(m * 2) * 0.019993 + F.sin(m * 3) * 0.000289
    apparent = t * 36000.76983 + 280.46646 + centre - 0.00569 - F.sin(F.radians(125.04 - t * 1934.136)) * 0.00478
    return F.pmod(apparent, F.lit(360.0))


def longitude_sql(at: str) -> str:
    t = f"(({at} - {NOON}::DOUBLE + {DELTA!r}::DOUBLE) / {CENTURY}::DOUBLE)"
    m = f"radians({t} * 35999.05029::DOUBLE + 357.52911::DOUBLE)"
    centre = f"sin({m}) * (1.914602::DOUBLE - {t} * 0.004817::DOUBLE) + sin({m} * 2) * 0.019993::DOUBLE + sin({m} * 3) * 0.000289::DOUBLE"
    apparent = f"({t} * 36000.76983::DOUBLE + 280.46646::DOUBLE + {centre} - 0.00569::DOUBLE - sin(radians(125.04::DOUBLE - {t} * 1934.136::DOUBLE)) * 0.00478::DOUBLE)"
    return f"(({apparent} % 360.0::DOUBLE + 360.0::DOUBLE) % 360.0::DOUBLE)"


def month_index(at: Column) -> Column:
    """Months from the one that begins at 315 degrees (0) to the one before it (11); each begins at a term."""
    return F.floor(F.pmod(longitude(at) - 315.0, F.lit(360.0)) / 30.0).cast("int")


def month_index_sql(at: str) -> str:
    return f"CAST(floor((({longitude_sql(at)} - 315.0::DOUBLE + 360.0::DOUBLE) % 360.0::DOUBLE) / 30.0::DOUBLE) AS INT)"


def year_of(day: Column, month: Column) -> Column:
    """The civil year, less one before the term at 315 degrees."""
    return F.year(day) - F.when((F.month(day) <= 2) & (month >= 10), 1).otherwise(0)


def reached(guess: Column, mark: Column) -> Column:
    """The instant nearest to ``guess`` at which the longitude is ``mark``, by five steps of the mean motion."""

    def step(t, _):
        return t + (F.pmod(mark - longitude(t) + 540.0, F.lit(360.0)) - 180.0) * (TROPICAL / 360.0)

    return F.aggregate(F.sequence(F.lit(1), F.lit(5)), guess, step)


def reached_sql(guess: str, mark: str) -> str:
    step = f"t + ((({mark} - {longitude_sql('t')} + 540.0::DOUBLE) % 360.0::DOUBLE) - 180.0::DOUBLE) * {TROPICAL / 360.0!r}::DOUBLE"
    return f"list_reduce([1, 2, 3, 4, 5], lambda t, k: {step}, {guess})"


def term_after(at: Column) -> Column:
    """The instant of the next term that begins a month."""
    month = F.pmod(longitude(at) - 315.0, F.lit(360.0)) / 30.0
    mark = F.pmod(F.floor(month) * 30.0 + 345.0, F.lit(360.0))
    return reached(at + (F.floor(month) + 1 - month) * (TROPICAL / 12.0), mark)


def term_before(at: Column) -> Column:
    """The instant of the last term that began a month."""
    month = F.pmod(longitude(at) - 315.0, F.lit(360.0)) / 30.0
    mark = F.pmod(F.floor(month) * 30.0 + 315.0, F.lit(360.0))
    return reached(at - (month - F.floor(month)) * (TROPICAL / 12.0), mark)


def term_sql(at: str, after: bool) -> str:
    """``at`` should be a column's name: it occurs often."""
    month = f"((({longitude_sql(at)} - 315.0::DOUBLE + 360.0::DOUBLE) % 360.0::DOUBLE) / 30.0::DOUBLE)"
    mark = f"((floor({month}) * 30.0::DOUBLE + {345 if after else 315}.0::DOUBLE) % 360.0::DOUBLE)"
    guess = f"{at} + (floor({month}) + 1 - {month}) * {TROPICAL / 12.0!r}::DOUBLE" if after else f"{at} - ({month} - floor({month})) * {TROPICAL / 12.0!r}::DOUBLE"
    return reached_sql(guess, mark)


def civil(at: Column) -> Column:
    """The civil time of an instant, to the nearest minute, as a timestamp without a zone."""
    minutes = F.floor(at * 1440.0 + ZONE_HOURS * 60 + 0.5).cast("long")
    day = F.date_add(F.to_date(F.lit("2000-01-01")), F.floor(minutes / 1440).cast("int"))
    return F.make_timestamp_ntz(F.year(day), F.month(day), F.dayofmonth(day), F.floor(F.pmod(minutes, F.lit(1440)) / 60).cast("int"), (F.pmod(minutes, F.lit(1440)) % 60).cast("int"), F.lit(0))


def civil_sql(at: str) -> str:
    return f"(TIMESTAMP '2000-01-01' + to_minutes(floor({at} * 1440.0::DOUBLE + {ZONE_HOURS * 60} + 0.5::DOUBLE)::BIGINT))"
