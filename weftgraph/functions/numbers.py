"""Numbers held against each other as decimals, so that 1.1 - 1.0 is 0.1."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, FractionalType

#: What a float is read as from its shortest text; one with more digits is compared as a double.
FLOAT = "decimal(28,14)"
_WIDE = "decimal(38,20)"


def _exact(c: Column, kind: DataType) -> Column:
    """``c`` as a decimal, or null where it has none of 28 digits."""
    if isinstance(kind, DecimalType):  # a difference needs a digit more, and would be rounded at 38
        return c.try_cast(f"decimal(37,{min(kind.scale, 36)})") if kind.precision > 37 else c
    if not isinstance(kind, FractionalType):
        return c.cast("decimal(20,0)")
    text = c.cast("string")
    narrow = text.try_cast(FLOAT)
    return F.when(narrow == text.try_cast(_WIDE), narrow)


def _limit(value: float | str | Decimal) -> Column:
    return F.lit(Decimal(str(value)))


def within(x: Column, y: Column, kind: DataType, absolute: float | str = 0, relative: float | str = 0) -> Column:
    """Whether two numbers differ by at most ``absolute``, or by ``relative`` times the larger of them; null equals null alone."""
    a, b = _exact(x, kind), _exact(y, kind)
    apart = F.abs(b - a)
    near = (apart <= _limit(absolute)) | (apart <= _limit(relative) * F.greatest(F.abs(a), F.abs(b)))
    p, q = x.cast("double"), y.cast("double")
    rough = F.abs(q - p) <= F.greatest(F.lit(float(absolute)), F.lit(float(relative)) * F.greatest(F.abs(p), F.abs(q)))
    return F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull()).when(a.isNotNull() & b.isNotNull(), F.coalesce(near, rough)).otherwise(rough)


def moved_by(x: Column, y: Column, kind: DataType, least: float | str, most: float | str) -> Column:
    """Whether ``y - x`` lies from ``least`` to ``most``; null equals null alone."""
    a, b = _exact(x, kind), _exact(y, kind)
    rough = (y.cast("double") - x.cast("double")).between(float(least), float(most))
    return F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull()).when(a.isNotNull() & b.isNotNull(), F.coalesce((b - a).between(_limit(least), _limit(most)), rough)).otherwise(rough)
