"""Text predicates and formatting as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels that mean "no label" (fixed values; other spellings are labels).
MISSING = ("", "Unknown", "UNKNOWN")


def strip(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def code_of(primary: Column, alternative: Column) -> Column:
    """``primary`` unless it is null or empty, else ``alternative``; white space alone isn't empty."""
    return F.coalesce(F.nullif(primary, F.lit("")), alternative)


def has_complexity(time: Column, space: Column) -> Column:
    """Whether either label says something."""
    said = lambda x: ~F.coalesce(x, F.lit("")).isin(*MISSING)
    return said(time) | said(space)


def long_enough(code: Column, least: int = 10, strict: bool = False) -> Column:
    """Whether the stripped code has ``least`` characters (more, if ``strict``); null and empty code never has."""
    n = F.length(strip(F.coalesce(code, F.lit(""))))
    return (F.coalesce(code, F.lit("")) != "") & ((n > least) if strict else (n >= least))


def preview(text: Column, size: int = 200) -> Column:
    """The first ``size`` characters, with dots where something follows."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def pad_right(text: Column, width: int) -> Column:
    """Padded with spaces; longer texts stay whole."""
    return F.rpad(text, F.greatest(F.lit(width), F.length(text)), F.lit(" "))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def lines(text: Column) -> Column:
    """Lines with their ends, split at every line end of Unicode; an empty text has none."""
    parts = F.split(text, "(?<=\r\n)|(?<=[\n\x0b\x0c\x1c\x1d\x1e\x85  ])|(?<=\r)(?!\n)", -1)
    return F.filter(parts, lambda x: x != "")


def milliseconds(seconds: Column) -> Column:
    return seconds * F.lit(1000.0)


def _halves(x: Column, power: Column, half: Column) -> Column:
    """The sign of x * power - half, exactly: x in two halves of 26 bits, whose products with a power of ten have no error.

    Holds for powers of ten up to 10**11 and a ``half`` near the product; far from it the sign is plain anyway.
    """
    wide = x * F.lit(134217729.0)
    upper = wide - (wide - x)
    return F.signum((upper * power - half) + (x - upper) * power)


def _nearest(whole: Column, sign: Column, odd: Column | None = None) -> Column:
    """``whole`` or the next integer, by the sign of what is above a half; ties go up where ``whole`` is odd."""
    return whole + F.when((sign > 0) | ((sign == 0) & (whole % 2 == 1 if odd is None else odd)), 1).otherwise(0)


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def fixed(value: Column, places: int, grouped: bool = False) -> Column:
    """A number with ``places`` (up to 8) digits after the point, as C and Python write it: its exact binary value is rounded, ties to even.

    ``grouped`` sets thousands apart. Numbers of 2**126 and more, and those that aren't finite, are written as the JVM does.
    """
    decimal = lambda x: x.cast("decimal(38,0)")
    negative = lambda v: (v < 0) | (v.cast("string") == "-0.0")

    def shown(v: Column, top: Column, low: Column, digits: Column) -> Column:
        carried = digits >= 10**places
        whole = decimal(decimal(top) * decimal(F.lit(str(2**63))) + decimal(low) + decimal(carried.cast("int"))).cast("string")
        if grouped:
            whole = F.reverse(F.regexp_replace(F.reverse(whole), r"(\d{3})(?=\d)", "$1,"))
        fraction = F.concat(F.lit("."), F.lpad(F.when(carried, 0).otherwise(digits).cast("string"), places, "0")) if places else F.lit("")
        return F.concat(F.when(negative(v), "-").otherwise(""), whole, fraction)

    def rounded(part: Column, low: Column) -> Column:
        up = F.lit(10.0**places)
        return bound(F.floor(part * up), lambda count: _nearest(count, _halves(part, up, count.cast("double") + 0.5), None if places else low % 2 == 1))

    def split(v: Column) -> Column:
        # The whole part, exactly, from two stretches of 63 bits; what is left of the number is exact too.
        high = F.lit(2.0**63)
        by_low = lambda top, rest, low: bound(rounded(rest - low.cast("double"), low), lambda digits: shown(v, top, low, digits))
        by_rest = lambda top, rest: bound(F.floor(rest), lambda low: by_low(top, rest, low))
        return bound(F.floor(F.abs(v) / high), lambda top: bound(F.abs(v) - top.cast("double") * high, lambda rest: by_rest(top, rest)))

    return bound(value.cast("double"), lambda v: F.when(F.abs(v) < 2.0**126, split(v)).when(v.isNotNull(), F.format_string(f"%.{places}f", v)))


def power(value: Column, places: int = 2) -> Column:
    """A number as d.dde+dd, with ``places`` (up to 3) digits after the point, rounded as in ``fixed``.

    Exact from 1e-8 to 1e17; other numbers are written as the JVM does.
    """
    tens = F.array(*(F.lit(float(f"1e{k}")) for k in range(-9, 19)))
    ten = lambda k: F.get(tens, (k + 9).cast("int"))

    def shown(v: Column, e: Column, digits: Column) -> Column:
        carried = digits >= 10 ** (places + 1)
        kept = F.when(carried, F.lit(10**places)).otherwise(digits).cast("string")
        point = F.concat(F.substring(kept, 1, 1), F.lit("."), F.substring(kept, 2, places)) if places else kept
        e = e + carried.cast("int")
        return F.concat(F.when(v < 0, "-").otherwise(""), point, F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), 2, "0"))

    def rounded(a: Column, e: Column) -> Column:
        up, down = ten(F.greatest(places - e, F.lit(0))), ten(F.greatest(e - places, F.lit(0)))
        sign = lambda half: F.when(e <= places, _halves(a, up, half)).otherwise(F.signum(a - half * down))
        return bound(F.floor(a * up / down), lambda count: _nearest(count, sign(count.cast("double") + 0.5)))

    def split(v: Column) -> Column:
        a = F.abs(v)
        exponent = lambda near: near + F.when(a >= ten(near + 1), 1).when(a < ten(near), -1).otherwise(0)
        return bound(bound(F.floor(F.log10(a)), exponent), lambda e: bound(rounded(a, e), lambda digits: shown(v, e, digits)))

    exact = lambda v: F.abs(v).between(1e-8, float(f"{1e17 - 16:.0f}"))
    return bound(value.cast("double"), lambda v: F.when(exact(v), split(v)).when(v.isNotNull(), F.format_string(f"%.{places}e", v)))


def number_formats(value: Column) -> dict[str, Column]:
    """A number as reports show it: four and two places, powers of ten, and whole with thousands set apart."""
    value = value.cast("double")
    return {"places4": fixed(value, 4), "places2": fixed(value, 2), "power": power(value), "thousands": F.format_string("%,d", F.floor(value))}


def run_name(moment: Column, prefix: str = "run") -> Column:
    """``prefix_yyyyMMdd_HHmmss``."""
    return F.concat(F.lit(f"{prefix}_"), F.date_format(moment, "yyyyMMdd_HHmmss"))
