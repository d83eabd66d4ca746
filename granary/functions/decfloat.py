"""DECFLOAT arithmetic: decimal floating point of 16 or 34 digits, values held as their texts.

No JVM type holds an exponent of its own, so these run in Arrow batches over Python's decimal arithmetic, which follows
the same standard: trailing zeros are kept, comparison is by value. Nulls give null; division by zero, overflow and
texts that are no numbers raise.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ADD, SUBTRACT, MULTIPLY, DIVIDE, COMPARE, ROUND = "add", "subtract", "multiply", "divide", "compare", "round"


def _context(digits: int) -> decimal.Context:
    least, most = (-6143, 6144) if digits == 34 else (-383, 384)
    return decimal.Context(prec=digits, rounding=decimal.ROUND_HALF_UP, Emin=least, Emax=most, traps=[decimal.DivisionByZero, decimal.Overflow, decimal.InvalidOperation])


def _work(operation: str, digits: int) -> Callable[[str, str], str]:
    context = _context(digits)
    if operation == COMPARE:
        return lambda a, b: str(int(context.compare(decimal.Decimal(a), decimal.Decimal(b))))
    if operation == ROUND:
        return lambda a, b: str(decimal.Decimal(a).quantize(decimal.Decimal(1).scaleb(-int(b)), context=context))
    name = {ADD: "add", SUBTRACT: "subtract", MULTIPLY: "multiply", DIVIDE: "divide"}[operation]
    return lambda a, b: str(getattr(context, name)(context.create_decimal(a), context.create_decimal(b)))


def decfloat(operation: str, a: Column, b: Column, digits: int = 34) -> Column:
    """a operation b, both as texts or numbers; round takes the number of decimals, halves away from zero; compare gives -1, 0 or 1."""

    @F.pandas_udf("string")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        work = _work(operation, digits)
        return pd.Series([None if p is None or q is None else work(p, q) for p, q in zip(x, y, strict=True)], dtype=object)

    out = run(a.cast("string"), b.cast("string"))
    return out.cast("int") if operation == COMPARE else out
