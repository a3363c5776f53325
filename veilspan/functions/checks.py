"""Checksums and calendar rules, as plain functions and as column expressions."""

from __future__ import annotations

import calendar

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: weights of the official checksums
INN10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12_FIRST = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12_SECOND = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)


def digits_of(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """13 to 19 digits with a valid Luhn sum."""
    if not 13 <= len(digits) <= 19:
        return False
    twice = "0246813579"
    return sum(int(twice[int(d)] if i % 2 else d) for i, d in enumerate(reversed(digits))) % 10 == 0


def sequential(digits: str) -> bool:
    """Each digit is the one before plus one, 0 after 9."""
    return len(digits) > 1 and all((int(b) - int(a)) % 10 == 1 for a, b in zip(digits, digits[1:]))


def snils(digits: str) -> bool:
    if len(digits) != 11:
        return False
    return sum(int(d) * (9 - i) for i, d in enumerate(digits[:9])) % 101 % 100 == int(digits[9:])


def inn(digits: str) -> bool:
    def control(weights: tuple[int, ...]) -> bool:
        return sum(w * int(d) for w, d in zip(weights, digits)) % 11 % 10 == int(digits[len(weights)])

    return len(digits) == 10 and control(INN10) or len(digits) == 12 and control(INN12_FIRST) and control(INN12_SECOND)


def valid_date(day: int, month: int, year: int) -> bool:
    return 1900 <= year <= 2100 and 1 <= month <= 12 and 1 <= day <= calendar.monthrange(year, month)[1]


def full_year(year: int) -> int | None:
    """Two digits from 30 are of the 20th century, others of the 21st; None outside 1900 to 2100."""
    if year <= 99:
        return year + (1900 if year >= 30 else 2000)
    return year if 1900 <= year <= 2100 else None


def numeric_date(first: int, second: int, third: int) -> tuple[int, int, int] | None:
    """(day, month, year): year first if it is one, and day before month where both are possible."""
    if first >= 1900:
        order = ((third, second, first), (second, third, first))[::-1]
    else:
        year = full_year(third)
        if year is None:
            return None
        order = ((first, second, year), (second, first, year))
    return next((d for d in order if valid_date(*d)), None)


# The same as column expressions.


def digits_col(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_col(digits: Column) -> Column:
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def _weighted(digits: Column, weights: tuple[int, ...]) -> Column:
    return sum((F.substring(digits, i + 1, 1).cast("int") * w for i, w in enumerate(weights)), F.lit(0))


def snils_col(digits: Column) -> Column:
    return (F.length(digits) == 11) & (_weighted(digits, tuple(range(9, 0, -1))) % 101 % 100 == F.substring(digits, 10, 2).cast("int"))


def inn_col(digits: Column) -> Column:
    def control(weights: tuple[int, ...]) -> Column:
        return _weighted(digits, weights) % 11 % 10 == F.substring(digits, len(weights) + 1, 1).cast("int")

    return F.when(F.length(digits) == 10, control(INN10)).when(F.length(digits) == 12, control(INN12_FIRST) & control(INN12_SECOND)).otherwise(False)


def sequential_col(digits: Column) -> Column:
    steps = F.transform(F.sequence(F.lit(1), F.length(digits) - 1), lambda i: F.pmod(F.substring(digits, i + 1, F.lit(1)).cast("int") - F.substring(digits, i, F.lit(1)).cast("int"), F.lit(10)))
    return F.when(F.length(digits) > 1, F.forall(steps, lambda d: d == 1)).otherwise(False)


def date_col(day: Column, month: Column, year: Column) -> Column:
    """Whether it is a day of the calendar in 1900 to 2100."""
    text = F.format_string("%04d-%02d-%02d", year, month, day)
    sane = year.between(1900, 2100) & month.between(1, 12) & day.between(1, 31)
    return F.coalesce(F.when(sane, F.try_to_date(text, "yyyy-MM-dd").isNotNull()), F.lit(False))
