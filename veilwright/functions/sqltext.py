"""Column expressions as SQL text, for large ones: they are put together here and parsed once.

Sql stands for an expression and has the operators of a Column; the functions have the names of
pyspark.sql.functions, with plain strings as literals. apply() runs a function of Sql on a Column.
Names of lambda variables follow from the depth, so that equal expressions have equal text. Operators
are written as calls: to parse an opening bracket, the parser looks ahead to its end each time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_depth = 0


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, int):
        return str(x) if -(1 << 31) <= x < 1 << 31 else f"{x}L"
    if isinstance(x, float):
        return f"{x!r}D"
    escaped = x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    return f"'{escaped}'"


def text_of(x) -> str:
    return x.text if isinstance(x, Sql) else literal(x)


def _binary(sign: str):
    return lambda self, other: Sql(f"`{sign}`({self.text}, {text_of(other)})")


def _swapped(sign: str):
    return lambda self, other: Sql(f"`{sign}`({text_of(other)}, {self.text})")


class Sql:
    """An expression; `cases` are the branches of one that when() began."""

    def __init__(self, text: str, cases: tuple[str, ...] = ()):
        self.text, self.cases = text, cases

    __add__, __sub__, __mul__, __truediv__, __mod__ = map(_binary, "+-*/%")
    __radd__, __rsub__, __rmul__, __rtruediv__, __rmod__ = map(_swapped, "+-*/%")
    __and__, __or__, __eq__ = map(_binary, ("and", "or", "="))
    __ne__ = lambda self, other: ~(self == other)
    __lt__, __le__, __gt__, __ge__ = map(_binary, ("<", "<=", ">", ">="))
    bitwiseAND, bitwiseXOR = _binary("&"), _binary("^")
    __hash__ = None

    def __invert__(self):
        return Sql(f"not({self.text})")

    def __neg__(self):
        return Sql(f"negative({self.text})")

    def __bool__(self):
        raise TypeError("an expression has no truth value here; use & and |")

    def __getitem__(self, field: str) -> Sql:
        return Sql(f"{self.text}.{field}")

    def alias(self, name: str) -> Sql:
        return Sql(f"{self.text} AS {name}")

    def cast(self, kind: str) -> Sql:
        return Sql(f"CAST({self.text} AS {kind})")

    def isin(self, *values) -> Sql:
        return Sql(f"`in`({self.text}, {', '.join(map(text_of, values))})")

    def between(self, low, high) -> Sql:
        return Sql(f"`between`({self.text}, {text_of(low)}, {text_of(high)})")

    def isNull(self) -> Sql:
        return Sql(f"isnull({self.text})")

    def isNotNull(self) -> Sql:
        return Sql(f"isnotnull({self.text})")

    def when(self, condition, value) -> Sql:
        return _case((*self.cases, condition.text, text_of(value)))

    def otherwise(self, value) -> Sql:
        return Sql(_case((*self.cases, text_of(value))).text)


def _case(cases: tuple[str, ...]) -> Sql:
    return Sql(f"`when`({', '.join(cases)})", cases)


def when(condition: Sql, value) -> Sql:
    return _case((condition.text, text_of(value)))


def lit(x) -> Sql:
    return Sql(literal(x))


def expr(text: str) -> Sql:
    return Sql(text)


def call_function(name: str, *args) -> Sql:
    return Sql(f"{name}({', '.join(map(text_of, args))})")


def lambda_text(f: Callable) -> str:
    """The text of a lambda function; Sql arguments are variables."""
    global _depth
    names = [f"{'xyz'[i]}{_depth}" for i in range(f.__code__.co_argcount - len(f.__defaults__ or ()))]
    _depth += 1
    try:
        body = text_of(f(*map(Sql, names)))
    finally:
        _depth -= 1
    return f"{names[0] if len(names) == 1 else '(' + ', '.join(names) + ')'} -> {body}"


def transform(array: Sql, f: Callable) -> Sql:
    return Sql(f"transform({array.text}, {lambda_text(f)})")


def filter(array: Sql, f: Callable) -> Sql:  # noqa: A001
    return Sql(f"filter({array.text}, {lambda_text(f)})")


def exists(array: Sql, f: Callable) -> Sql:
    return Sql(f"exists({array.text}, {lambda_text(f)})")


def zip_with(left: Sql, right: Sql, f: Callable) -> Sql:
    return Sql(f"zip_with({left.text}, {right.text}, {lambda_text(f)})")


def array_sort(array: Sql, f: Callable) -> Sql:
    return Sql(f"array_sort({array.text}, {lambda_text(f)})")


def aggregate(array: Sql, start, merge: Callable, finish: Callable | None = None) -> Sql:
    return Sql(f"aggregate({array.text}, {text_of(start)}, {lambda_text(merge)}{', ' + lambda_text(finish) if finish else ''})")


def __getattr__(name: str):
    """All other functions, by the name that SQL has for them too."""
    if name.startswith("__"):
        raise AttributeError(name)
    return lambda *args: call_function(name, *args)


def let(value: Sql, then: Callable[[Sql], Sql]) -> Sql:
    """then(value), with the value computed once wherever `then` uses it."""
    return call_function("get", transform(call_function("array", value), then), 0)


def apply(f: Callable[[Sql], Sql], value: Column) -> Column:
    """f of a column, parsed as one expression."""
    return parsed(lambda_text(lambda x: f(x)), value)


def parsed(function: str, value: Column) -> Column:
    """The lambda function, given as text, of a column."""
    return F.get(F.call_function("transform", F.array(value), F.expr(function)), F.lit(0))


def on_columns(f: Callable) -> Callable:
    """A function of Sql that takes columns too."""
    from functools import wraps

    @wraps(f)
    def either(value):
        return f(value) if isinstance(value, Sql) else apply(f, value)

    return either
