"""Values as canonical JSON text: their three equalities, numbers, bounds and exact decimals."""

from __future__ import annotations

import json
from decimal import ROUND_HALF_EVEN, Context, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = Context(prec=50, rounding=ROUND_HALF_EVEN)


def canonical(value: object) -> str:
    """The text under which a value is stored: sorted keys; a Decimal as its own one-key object."""
    return json.dumps(value, sort_keys=True, default=lambda d: {"$decimal": str(d)})


def decoded(text: str) -> object:
    def hook(o: dict) -> object:
        if set(o) == {"$decimal"} and isinstance(o["$decimal"], str):
            try:
                d = Decimal(o["$decimal"])
            except ArithmeticError:
                return o
            return d if d.is_finite() else o
        return o

    return json.loads(text, object_hook=hook)


def text_of(value: Column) -> Column:
    """The content of a JSON string; null for other values. One without escapes is cut out, not parsed."""
    plain = F.when(value.rlike(r'^"[^"\\\x00-\x1f]*"\z'), value.substr(F.lit(2), F.length(value) - 2))
    return F.when(value.startswith('"'), F.coalesce(plain, F.get_json_object(value, "$")))


def number_of(value: Column) -> Column:
    """A number, exact ones as double; null for booleans, strings and the rest."""
    plain = F.when(value.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), value.try_cast("double"))
    return F.coalesce(plain, F.get_json_object(F.when(value.startswith("{"), value), "$['$decimal']").try_cast("double"))


def equal_key(value: Column) -> Column:
    """Equal for values that compare equal: 1, 1.0, true and the exact 1.00 are one."""
    number = F.coalesce(number_of(value), F.when(value == "true", F.lit(1.0)).when(value == "false", F.lit(0.0)))
    return F.coalesce(F.concat(F.lit("#"), number.cast("string")), value)


def bound(value: Column, name: str) -> Column:
    return F.get_json_object(F.when(value.startswith("{"), value), f"$.{name}").try_cast("double")


def exact_total(values: list[str | None]) -> str | None:
    """Sum of decimal texts with 50 digits, half to even; the scale is that of the addends."""
    total: Decimal | None = None
    for v in values:
        if v is not None:
            total = Decimal(v) if total is None else EXACT.add(total, Decimal(v))
    return None if total is None else str(total)


def exact_sum(column: Column) -> Column:
    """exact_total() of a group, as a grouped aggregate over Arrow batches."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> str:
        return exact_total(values.tolist())

    return run(column)


def exact_div(a: Column, b: Column) -> Column:
    """Quotient of decimal texts with 50 digits, half to even; null for null and for division by zero."""

    @F.pandas_udf("string")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None or not Decimal(q) else str(EXACT.divide(Decimal(p), Decimal(q))) for p, q in zip(x, y)], dtype=object)

    return run(a, b)


def unmixed(value: Column, column: Column) -> Column:
    """An aggregate ``column`` of a group, or an error if its values mix exact decimals with inexact numbers, which have no common sum."""
    exact = F.coalesce(value.startswith('{"$decimal"'), F.lit(False))
    loose = F.coalesce(value.rlike(r"^-?[0-9]+(\.[0-9]+|\.?[0-9]*[eE][-+]?[0-9]+)$"), F.lit(False)) & value.rlike("[.eE]")
    return F.when(F.bool_or(exact) & F.bool_or(loose), F.raise_error(F.lit("exact decimals and floats in one sum"))).otherwise(column)


def content_tokens(text: Column) -> Column:
    """Words of a name that tell something: lower case, without possessives, articles, titles and single letters."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(text), "['’]s\\b", ""), "[^\\p{L}\\p{N}]+", " ")
    drop = F.array(*map(F.lit, "the a an of mr mrs ms dr sir lady lord master miss".split()))
    return F.filter(F.split(F.trim(clean), " +"), lambda w: (F.length(w) > 1) & ~F.array_contains(drop, w))
