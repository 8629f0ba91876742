"""Deal values: cleaning, plausibility, comparable size and display."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsfunnel import dims


_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def clean_number(c: Column) -> Column:
    """A positive finite number out of text such as '1,200'; everything else is NULL."""
    plain = F.trim(F.replace(c, F.lit(","), F.lit("")))
    n = F.when(plain.rlike(_DECIMAL), plain.try_cast("double"))
    return F.when((n > 0) & (n < F.lit(float("inf"))), n)


def plausible_value(
    value: Column, currency: Column, caps: dict[str, float] = dims.MAX_VALUE
) -> Column:
    """The value, unless its currency is absent or unknown or it exceeds the currency's cap."""
    cap = F.lit(None).cast("double")
    for code, limit in caps.items():
        cap = F.when(currency == code, F.lit(limit)).otherwise(cap)
    return F.when(value <= cap, value)


def usd_millions(value: Column, currency: Column) -> Column:
    """Rough USD millions for ordering and bucketing only; never shown."""
    out = F.lit(None).cast("double")
    for code, factor in dims.USD_MILLION_FACTOR.items():
        out = F.when(currency == code, value * F.lit(factor)).otherwise(out)
    for code, divisor in dims.USD_MILLION_DIVISOR.items():
        out = F.when(currency == code, value / F.lit(divisor)).otherwise(out)
    return out


def size_score(value: Column, currency: Column) -> Column:
    usd = usd_millions(value, currency)
    out = F.when(usd.isNull(), F.lit(dims.SIZE_UNKNOWN))
    for floor, score in dims.SIZE_STEPS:
        out = out.when(usd >= floor, F.lit(score))
    return out.otherwise(F.lit(dims.SIZE_SMALLEST))


def indian_number(value: Column) -> Column:
    """12,34,567.891: the last three digits, then pairs; at most three decimals."""
    text = F.round(value, 3).cast("decimal(38,3)").cast("string")
    whole = F.substring_index(text, ".", 1)
    fraction = F.regexp_replace(F.substring_index(text, ".", -1), "0+$", "")
    grouped = F.regexp_replace(whole, r"(\d)(?=(\d{2})*\d{3}$)", "$1,")
    return F.when(fraction == "", grouped).otherwise(F.concat(grouped, F.lit("."), fraction))


def format_value(value: Column, currency: Column) -> Column:
    """'₹2,955 cr', '$8 mn', 'Undisclosed': never a blank cell."""
    n = indian_number(value)
    return (
        F.when(value.isNull(), F.lit(dims.UNDISCLOSED))
        .when(currency == "INR_CRORE", F.concat(F.lit("₹"), n, F.lit(" cr")))
        .when(currency == "USD_MILLION", F.concat(F.lit("$"), n, F.lit(" mn")))
        .when(currency == "INR", F.concat(F.lit("₹"), n))
        .when(currency == "USD", F.concat(F.lit("$"), n))
        .when(F.coalesce(currency, F.lit("")) == "", n)
        .otherwise(F.concat(n, F.lit(" "), currency))
    )
