"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeloom import fixed


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: str | Column, digits: int) -> Column:
    """Rounded value; adding zero turns a negative zero into zero."""
    return F.round(col(c), digits) + F.lit(0.0)


def kept(*issues: tuple[Column, str]) -> Column:
    """The texts whose condition holds, as an array."""
    flagged = F.array(*[F.when(condition, F.lit(text)) for condition, text in issues])
    return F.filter(flagged, lambda x: x.isNotNull())


def norm_symbol(c: str | Column) -> Column:
    return F.upper(F.trim(col(c)))


def to_number(c: str | Column) -> Column:
    """Text to double; what cannot be read counts as 0."""
    return F.coalesce(col(c).try_cast("double"), F.lit(0.0))


def to_utc(c: str | Column, zone: str | Column | None = None) -> Column:
    """Wall-clock time of ``zone`` as UTC; a time without a zone is already UTC."""
    return col(c) if zone is None else F.to_utc_timestamp(col(c), zone)


def exchange_of(c: str | Column) -> Column:
    s = F.upper(col(c))
    return (
        F.when(s.endswith(".SZ"), "SZSE").when(s.endswith(".SH"), "SSE").when(s.endswith(".HK"), "HKEX")
        .when(s.startswith("6"), "SSE").when(s.substr(1, 1).isin("0", "2", "3"), "SZSE").otherwise("NASDAQ")
    )


def report_period(c: str | Column) -> Column:
    month = F.month(col(c))
    return F.when(month == 3, "q1").when(month == 6, "q2").when(month == 9, "q3").otherwise("annual")


def item(c: str | Column, key: str) -> Column:
    """Map item with the default 0."""
    return F.coalesce(F.try_element_at(col(c), F.lit(key)), F.lit(0.0))


def macro_code(c: str | Column) -> Column:
    """Series code of a macro data type."""
    t = col(c)
    known = F.create_map(*[F.lit(x) for pair in fixed.MACRO_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, t), F.upper(t))


def price_order_broken(price: str) -> Column:
    """low <= price <= high does not hold; a missing value counts as broken."""
    inside = (F.col("low") <= F.col(price)) & (F.col(price) <= F.col("high"))
    return ~F.coalesce(inside, F.lit(False))
