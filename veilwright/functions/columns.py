"""Small expressions that the checks and the scanner are made of, as SQL text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from veilwright.functions import sqltext as F
from veilwright.functions.sqltext import Sql, let

__all__ = ["let"]


def no() -> Sql:
    return F.lit(False)



def only_digits(v: Sql) -> Sql:
    return F.regexp_replace(v, r"\D", "")


def compact(v: Sql) -> Sql:
    """Without white space, upper case."""
    return F.upper(F.regexp_replace(v, r"\s+", ""))


def tidy(v: Sql) -> Sql:
    """Without white space at its ends, upper case."""
    return F.upper(F.regexp_replace(v, r"^\s+|\s+$", ""))


def chars(v: Sql) -> Sql:
    return F.split(v, "")


def numbers(v: Sql) -> Sql:
    """The digits of a string of digits."""
    return F.transform(chars(v), lambda c: c.cast("int"))


def varied(d: Sql) -> Sql:
    """Not one character over and over."""
    return F.size(F.array_distinct(chars(d))) > 1


def digits_of(v: Sql, length: int | tuple[int, int], check: Callable[[Sql], Sql], first: str = "0-9", vary: bool = True) -> Sql:
    """The digits of v are as many as stated, begin so, vary, and pass the check."""
    low, high = length if isinstance(length, tuple) else (length, length)

    def judged(d: Sql) -> Sql:
        shape = F.rlike(d, F.lit(f"^[{first}][0-9]{{{low - 1},{high - 1}}}$"))
        if vary:
            shape = shape & varied(d)
        return F.when(shape, check(d)).otherwise(no())

    return F.coalesce(let(only_digits(v), judged), no())


def shaped(v: Sql, pattern: str, check: Callable[[Sql], Sql]) -> Sql:
    """v matches the whole pattern and passes the check."""
    return F.coalesce(let(v, lambda x: F.when(F.rlike(x, F.lit(f"^(?:{pattern})$")), check(x)).otherwise(no())), no())


def digit(d: Sql, place: int) -> Sql:
    """The digit at a place from 0."""
    return F.substring(d, place + 1, 1).cast("int")


def number(d: Sql, place: int, length: int) -> Sql:
    return F.substring(d, place + 1, length).cast("bigint")


def constants(values: Sequence) -> Sql:
    """An array of numbers, as one expression."""
    return F.expr(f"array({', '.join(map(str, values))})")


def values_weighted(values: Sql, weights: Sequence[int]) -> Sql:
    """The sum of numbers times weights; further numbers don't count."""
    return F.aggregate(F.zip_with(values, constants(weights), lambda x, w: x * w), F.lit(0), lambda a, x: a + x)


def weighted(d: Sql, weights: Sequence[int], start: int = 0) -> Sql:
    """The sum of the digits from a place on times weights."""
    return values_weighted(numbers(F.substring(d, start + 1, len(weights))), weights)


def letter_values(v: Sql) -> Sql:
    """0-9 as they are, A as 10 to Z as 35."""
    return F.transform(chars(v), lambda c: F.when(F.rlike(c, F.lit("[0-9]")), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))


def letter(table: str, place: Sql) -> Sql:
    return F.substring(F.lit(table), place.cast("int") + 1, F.lit(1))


def is_date(year: Sql, month: Sql, day: Sql) -> Sql:
    """A real date of the years 1 to 9999."""
    text = F.format_string("%04d%02d%02d", year.cast("int"), month.cast("int"), day.cast("int"))
    return (year >= 1) & F.try_to_timestamp(text, F.lit("yyyyMMdd")).isNotNull()


def luhn(d: Sql) -> Sql:
    return F.call_function("luhn_check", d)


def mod_11_10(d: Sql) -> Sql:
    """ISO 7064 MOD 11,10 with the check digit last."""
    rest = F.aggregate(
        numbers(F.substring(d, F.lit(1), F.length(d) - 1)),
        F.lit(10),
        lambda p, x: let((x + p) % 10, lambda s: (F.when(s == 0, 10).otherwise(s) * 2) % 11),
    )
    return F.when(rest == 1, 0).otherwise(11 - rest) == F.right(d, F.lit(1)).cast("int")
