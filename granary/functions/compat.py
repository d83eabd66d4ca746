"""Column functions whose rules differ from Spark's own.

Each takes and returns Columns, stays inside code generation where Spark's parts do, and raises under
ANSI where its rule is to raise.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- numbers ------------------------------------------------------------------------------------


def int_div(a: Column, b: Column) -> Column:
    """Integer division towards zero; division by zero raises."""
    return F.call_function("div", a, b)


def _unscaled(x: Column, scale: int) -> Column:
    """The whole number whose last scale digits are the decimals of x."""
    return (x.cast(f"decimal(28,{scale})") * F.lit(10**scale).cast(f"decimal({scale + 1},0)")).cast("decimal(28,0)")


def dec_div(a: Column, b: Column, scale_a: int, scale_b: int) -> Column:
    """Decimal division of up to 28 digits: the scales add up (to 8 at most), further digits are cut off; division by zero raises."""
    up, down = _unscaled(a, scale_a).cast("decimal(38,0)") * F.lit(10 ** (2 * scale_b)).cast(f"decimal({2 * scale_b + 1},0)"), _unscaled(b, scale_b)
    whole = ((up - up % down) / down).cast("decimal(28,0)")  # without a remainder, so nothing is rounded
    scale = scale_a + scale_b
    return (whole / F.lit(10**scale).cast(f"decimal({scale + 1},0)")).cast(f"decimal(38,{scale})")


def dec_mul(a: Column, b: Column, scale_a: int, scale_b: int) -> Column:
    """Decimal multiplication of up to 18 digits each: the scales add up and no digit is lost."""
    return (a.cast(f"decimal(18,{scale_a})") * b.cast(f"decimal(18,{scale_b})")).cast(f"decimal(38,{scale_a + scale_b})")


def wide(x: Column) -> Column:
    """A 64-bit integer as one of 38 digits: sums, differences and products of two of them do not overflow."""
    return x.cast("decimal(19,0)")


def truncate(x: Column, scale: int) -> Column:
    """A decimal cut off (towards zero) after scale digits."""
    wide = x.cast(f"decimal(38,{scale + 6})")
    return (F.sign(wide).cast("int") * F.floor(F.abs(wide) * F.lit(10**scale)) / F.lit(10**scale)).cast(f"decimal(38,{scale})")


def sum_wide(x: Column) -> Column:
    """Sum of integers one step wider than they are: it does not overflow where a BIGINT sum would."""
    return F.sum(x.cast("decimal(38,0)"))


def avg_int(x: Column) -> Column:
    """Average of integers as an integer, cut off towards zero."""
    return F.call_function("div", F.sum(x.cast("bigint")), F.count(x))


def avg_dec(x: Column, scale: int) -> Column:
    """Average of decimals at their own scale, cut off."""
    return truncate(F.sum(x.cast(f"decimal(28,{scale})")) / F.count(x), scale)


def to_int(x: Column, kind: str = "int") -> Column:
    """Cast to an integer type, halves away from zero; out of range raises."""
    return F.round(x.cast("decimal(38,10)"), 0).cast(kind)


def text_number(x: Column) -> Column:
    """A text as a number: blanks around are ignored, decimals and exponents are read, 0x and up to 16 hexadecimal digits is their two's complement; other text raises."""
    t = F.trim(x)
    digits = F.lpad(F.substring(t, 3, 16), 16, "0")
    high = F.conv(F.substring(digits, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(digits, 9, 8), 16, 10).cast("bigint")
    value = F.when(high >= 1 << 31, high - (1 << 32)).otherwise(high).cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + low
    plain = F.when(t.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), t).otherwise(F.when(t.isNotNull(), F.raise_error(F.lit("conversion error from string"))))
    return F.when(t.rlike(r"\A0[xX][0-9A-Fa-f]{1,16}\z"), value.cast("decimal(38,10)")).otherwise(plain.cast("decimal(38,10)"))


def text_to_int(x: Column, kind: str = "int") -> Column:
    """Cast of a text: as text_number(), decimals round half away from zero."""
    return to_int(text_number(x), kind)


def to_decimal(x: Column, precision: int, scale: int) -> Column:
    """Cast to a decimal, halves away from zero."""
    return x.cast(f"decimal({precision},{scale})")


def mod(a: Column, b: Column) -> Column:
    """Remainder with the dividend's sign; both sides are rounded to integers first, halves away from zero."""
    return to_int(a, "bigint") % to_int(b, "bigint")


def sign(x: Column) -> Column:
    """-1, 0 or 1, as a SMALLINT."""
    return F.sign(x).cast("smallint")


def finite(x: Column) -> Column:
    """A double; infinite results raise."""
    return F.when(F.abs(x) == F.lit(float("inf")), F.raise_error(F.lit("arithmetic overflow"))).otherwise(x)


def double_text(x: Column, digits: int = 16) -> Column:
    """A double as text with 16 significant digits (a float: 8), zeros kept; an exponent below -4 or of digits and more is written out.

    The digits are those of the exact binary value, which the JVM's formatting does not give (it pads the shortest text), so
    this runs in Arrow batches.
    """

    @F.pandas_udf("string")
    def shown(values: pd.Series) -> pd.Series:
        return values.map(lambda v: f"{v:#.{digits}g}", na_action="ignore").astype(object)

    return F.when(x.isNotNull(), shown(F.coalesce(x.cast("double"), F.lit(0.0))))


def float_text(x: Column) -> Column:
    """A float as text with 8 significant digits."""
    return double_text(x, 8)


# --- texts --------------------------------------------------------------------------------------


def pad_eq(a: Column, b: Column) -> Column:
    """Equality that ignores trailing blanks."""
    return F.rtrim(a) == F.rtrim(b)


def substring(s: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """SUBSTRING as a window over positions 1 and up: what lies before position 1 uses length up."""
    start = F.lit(start) if isinstance(start, int) else start
    if length is None:
        return s.substr(F.greatest(start, F.lit(1)), F.length(s))
    length = F.lit(length) if isinstance(length, int) else length
    checked = F.when(length < 0, F.raise_error(F.lit("negative substring length")).cast("int")).otherwise(length)
    end = start + checked
    return s.substr(F.greatest(start, F.lit(1)), F.greatest(end - F.greatest(start, F.lit(1)), F.lit(0)))


def trim(s: Column, what: str = " ", side: str = "both") -> Column:
    """Strip whole repetitions of a string, not single characters of it; an empty one strips nothing."""
    if not what:
        return s
    some = f"(?:{re.escape(what)})+"
    if side in ("both", "leading"):
        s = F.regexp_replace(s, rf"\A{some}", "")
    if side in ("both", "trailing"):
        s = F.regexp_replace(s, rf"{some}\z", "")
    return s


def position(needle: Column, s: Column, start: int = 1) -> Column:
    """1-based place of needle at or after start, 0 if none; an empty needle is found at start, if that is not past the end."""
    empty = F.when(F.lit(start) <= F.length(s) + 1, F.lit(start)).otherwise(0)
    return F.when(needle == "", empty).otherwise(F.call_function("locate", needle, s, F.lit(start)))


def char_text(x: Column, n: int) -> Column:
    """Cast to CHAR(n): padded with blanks; more than n characters raise, unless they are blanks."""
    return F.rpad(varchar_text(x, n), n, " ")


def varchar_text(x: Column, n: int) -> Column:
    """Cast to VARCHAR(n): more than n characters raise, unless they are blanks."""
    text = x.cast("string")
    return F.when(F.length(F.rtrim(text)) > n, F.raise_error(F.lit("string truncation"))).otherwise(F.substring(text, 1, n))


def text_bool(x: Column) -> Column:
    """Text to boolean: TRUE and FALSE in any case, blanks around ignored; anything else raises."""
    t = F.upper(F.trim(x))
    return F.when(t == "TRUE", True).when(t == "FALSE", False).when(x.isNotNull(), F.raise_error(F.lit("conversion error")).cast("boolean"))


def bool_text(x: Column) -> Column:
    """A boolean as TRUE or FALSE."""
    return F.upper(x.cast("string"))


def transliterate(x: Column, charset: str) -> Column:
    """The bytes of a text in another character set; a character that it does not have raises."""
    return F.encode(x, charset)


def from_charset(x: Column, charset: str) -> Column:
    """The text that bytes of a character set spell."""
    return F.decode(x, charset)


def starting(x: Column, prefix: str) -> Column:
    """STARTING WITH: no trimming; numbers by their text; an empty prefix holds for all but null."""
    return x.cast("string").startswith(prefix)


_CLASSES = {"ALPHA": "A-Za-z", "UPPER": "A-Z", "LOWER": "a-z", "DIGIT": "0-9", "SPACE": r"\x20", "WHITESPACE": r"\s", "ALNUM": "A-Za-z0-9"}


def similar_pattern(pattern: str, escape: str | None = None) -> str:
    """A SIMILAR TO pattern as an anchored regular expression."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape:
            if i + 1 == len(pattern):
                raise ValueError("pattern ends in its escape character")
            i += 1
            out.append(re.escape(pattern[i]))
        elif c == "[":
            end = i + 1
            while end < len(pattern) and pattern[end] != "]":
                end = pattern.index(":]", end) + 2 if pattern.startswith("[:", end) else end + 1
            body = pattern[i + 1 : end]
            body = re.sub(r"\[:(\w+):\]", lambda m: _CLASSES[m[1].upper()], body)
            out.append("[" + body.replace("\\", "\\\\") + "]")
            i = end
        elif c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        elif c in "|*+?(){}":
            out.append(c)
        else:
            out.append(re.escape(c))
        i += 1
    return rf"\A(?s:{''.join(out)})\z"


def similar_to(x: Column, pattern: str, escape: str | None = None) -> Column:
    """SIMILAR TO: the whole text must match."""
    return x.rlike(similar_pattern(pattern, escape))


# --- conditions ---------------------------------------------------------------------------------


def iif(condition: Column, yes: Column, no: Column) -> Column:
    """yes where the condition is true; no where it is false or unknown."""
    return F.when(condition, yes).otherwise(no)


def decode(x: Column, *pairs: Column, default: Column | None = None) -> Column:
    """First result whose search value equals x; null equals nothing, not even null."""
    out = F.when(x == pairs[0], pairs[1])
    for search, result in zip(pairs[2::2], pairs[3::2], strict=True):
        out = out.when(x == search, result)
    return out if default is None else out.otherwise(default)


# --- time ---------------------------------------------------------------------------------------

#: Units of a clock in microseconds.
_CLOCK = {"hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1_000}


def extract(part: str, x: Column) -> Column:
    """EXTRACT: WEEKDAY from 0 = Sunday, YEARDAY from 0, SECOND with 4 decimals, MILLISECOND with 1."""
    part = part.lower()
    if part == "weekday":
        return F.dayofweek(x) - 1
    if part == "yearday":
        return F.dayofyear(x) - 1
    if part == "week":
        return F.weekofyear(x)
    if part == "second":
        return (F.unix_micros(x.cast("timestamp")) % 60_000_000 / F.lit(1_000_000)).cast("decimal(9,4)")
    if part == "millisecond":
        return (F.unix_micros(x.cast("timestamp")) % 1_000_000 / F.lit(1_000)).cast("decimal(9,1)")
    return getattr(F, {"year": "year", "month": "month", "day": "day", "hour": "hour", "minute": "minute"}[part])(x)


def date_add(unit: str, n: Column | int, x: Column) -> Column:
    """DATEADD on a date: months keep the day or end at the month's last; smaller units than a day are cut off to whole days."""
    unit = unit.lower()
    n = F.lit(n) if isinstance(n, int) else n
    if unit in ("year", "month"):
        return F.add_months(x, n * (12 if unit == "year" else 1))
    if unit in ("week", "day"):
        return F.date_add(x, (n * (7 if unit == "week" else 1)).cast("int"))
    return F.date_add(x, F.call_function("div", n.cast("bigint") * _CLOCK[unit], F.lit(86_400_000_000)).cast("int"))


def timestamp_add(unit: str, n: Column | int, x: Column) -> Column:
    """DATEADD on a timestamp."""
    unit = unit.lower()
    n = F.lit(n) if isinstance(n, int) else n
    if unit in _CLOCK:
        return F.timestamp_micros(F.unix_micros(x) + n.cast("bigint") * _CLOCK[unit])
    moved = date_add(unit, n, F.to_date(x))
    return F.timestamp_micros(F.unix_micros(moved.cast("timestamp")) + F.pmod(F.unix_micros(x), F.lit(86_400_000_000)))


def date_diff(unit: str, a: Column, b: Column) -> Column:
    """DATEDIFF from a to b: years and months by their numbers, weeks of days, clock units by boundaries crossed."""
    unit = unit.lower()
    if unit == "year":
        return (F.year(b) - F.year(a)).cast("bigint")
    if unit == "month":
        return ((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)).cast("bigint")
    days = F.datediff(F.to_date(b), F.to_date(a)).cast("bigint")
    if unit == "day":
        return days
    if unit == "week":
        return F.call_function("div", days, F.lit(7))
    if unit == "millisecond":  # counted in tenths
        tenths = lambda x: F.floor(F.unix_micros(x.cast("timestamp")) / F.lit(100))
        return ((tenths(b) - tenths(a)).cast("decimal(20,0)") / F.lit(10)).cast("decimal(20,1)")
    ticks = lambda x: F.floor(F.unix_micros(x.cast("timestamp")) / F.lit(_CLOCK[unit]))
    return (ticks(b) - ticks(a)).cast("bigint")


def time_add(unit: str, n: Column | int, ticks: Column) -> Column:
    """DATEADD on a time of day, held as 1/10000 seconds since midnight: it wraps at midnight."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.pmod(ticks + n.cast("bigint") * (_CLOCK[unit.lower()] // 100), F.lit(864_000_000))


def days_between(a: Column, b: Column) -> Column:
    """DATE - DATE: a number of days."""
    return F.datediff(a, b)


def timestamp_days(a: Column, b: Column) -> Column:
    """TIMESTAMP - TIMESTAMP: days with 9 decimals."""
    return ((F.unix_micros(a) - F.unix_micros(b)).cast("decimal(28,0)") / F.lit(86_400_000_000)).cast("decimal(18,9)")


def date_plus(x: Column, days: Column) -> Column:
    """DATE + number: a number with decimals is rounded half away from zero."""
    return F.date_add(x, to_int(days))


def timestamp_plus(x: Column, days: Column) -> Column:
    """TIMESTAMP + number of days, to the ten-thousandth of a second, halves away from zero."""
    ticks = F.round(days.cast("decimal(28,9)") * F.lit(864_000_000), 0).cast("bigint")
    return F.timestamp_micros(F.unix_micros(x.cast("timestamp")) + ticks * 100)


def time_minus(a: Column, b: Column) -> Column:
    """TIME - TIME, both held as 1/10000 seconds since midnight: seconds with 4 decimals."""
    return ((a - b).cast("decimal(20,0)") / F.lit(10_000)).cast("decimal(13,4)")


def time_of_day(x: Column) -> Column:
    """The time of a timestamp, as 1/10000 seconds since midnight."""
    return F.pmod(F.floor(F.unix_micros(x.cast("timestamp")) / F.lit(100)), F.lit(864_000_000))


def at_zone(x: Column, zone: str) -> Column:
    """The clock in a zone (by name or offset) at an instant of UTC."""
    return F.from_utc_timestamp(x, zone)


def from_zone(x: Column, zone: str) -> Column:
    """The instant of UTC at which the clock in a zone shows x."""
    return F.to_utc_timestamp(x, zone)
