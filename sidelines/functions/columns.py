"""Small column expressions that several rules share."""

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(by: list[str], *order: str) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def earlier(by: list[str], *order: str) -> WindowSpec:
    """All rows before a row."""
    return ordered(by, *order).rowsBetween(Window.unboundedPreceding, -1)


def later(by: list[str], *order: str) -> WindowSpec:
    """All rows after a row, the nearest one last: in reverse order they come before it, so that each row adds one to what
    the row before has seen."""
    return Window.partitionBy(*by).orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, -1)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def changed(by: list[str], order: str, *columns: str) -> Column:
    """Whether any of the columns differs from the row before; true on the first row."""
    w = ordered(by, order)
    now = F.struct(*columns)
    return ~F.coalesce(F.lag(now).over(w).eqNullSafe(now), F.lit(False)) | (F.row_number().over(w) == 1)


def clock_ms(text: Column) -> Column:
    """Milliseconds of MM:SS(.mmm), HH:MM:SS or seconds, commas as points; null for anything else."""
    t = F.trim(F.regexp_replace(text, ",", "."))
    parts = F.split(t, ":")
    value = lambda i: F.element_at(parts, i).try_cast("double")
    ok = t.rlike(r"^\d+(\.\d+)?$|^\d+:\d{1,2}(\.\d+)?$|^\d+:\d{1,2}:\d{1,2}(\.\d+)?$")
    seconds = F.when(F.size(parts) == 1, value(1)).when(F.size(parts) == 2, value(1) * 60 + value(2)).otherwise(value(1) * 3600 + value(2) * 60 + value(3))
    return F.when(ok, F.rint(seconds * 1000).cast("long"))
