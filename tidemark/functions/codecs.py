"""Text form of feature values and back, as column expressions.

Typed columns are the stored form; text is only for edges that need it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.model import DTYPES

# Spellings that decode to true, and Python's number syntax.
TRUE_TEXT = ("true", "1", "yes")
INT_TEXT = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"
FLOAT_TEXT = (
    r"(?i)^\s*[+-]?(([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)"
    r"(e[+-]?[0-9]+(_[0-9]+)*)?|inf(inity)?|nan)\s*$"
)


def float_text(value: Column) -> Column:
    """A double as Python prints it: plain digits from 1e-4 up to 1e16, else exponent form.

    Spark changes to exponent form at 1e-3 and 1e7, so those ranges are written out.
    """
    text = F.abs(value).cast("string")
    mantissa = F.split_part(text, F.lit("E"), F.lit(1))
    exponent = F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.", ""), "0+$", "")
    width = F.length(digits)
    whole = F.rpad(digits, exponent + 1, "0")
    large = F.when(width <= exponent + 1, F.concat(whole, F.lit(".0"))).otherwise(
        F.concat_ws(".", F.substring(digits, F.lit(1), exponent + 1), F.substring(digits, exponent + 2, width))
    )
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    sign = F.when(exponent < 0, "-").otherwise("+")
    power = F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), "0")
    scientific = F.concat(F.regexp_replace(mantissa, r"\.0$", ""), F.lit("e"), sign, power)
    unsigned = (
        F.when(exponent.isNull(), text)
        .when((exponent >= 7) & (exponent < 16), large)
        .when((exponent >= -4) & (exponent < 0), small)
        .otherwise(scientific)
    )
    negative = value.cast("string").startswith("-")
    return (
        F.when(F.isnan(value), "nan")
        .when(text == "Infinity", F.when(value > 0, "inf").otherwise("-inf"))
        .otherwise(F.concat(F.when(negative, "-").otherwise(""), unsigned))
    )


def encode_value(value: Column, dtype: T.DataType) -> Column:
    """Text as the hash store keeps it: JSON for lists, Python's `str` for the rest."""
    if isinstance(dtype, T.ArrayType):
        element = dtype.elementType
        cells = F.transform(value, lambda x: F.coalesce(_json_number(x, element), F.lit("null")))
        text = F.concat(F.lit("["), F.array_join(cells, ", "), F.lit("]"))
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        text = float_text(value.cast("double"))
    elif isinstance(dtype, T.BooleanType):
        text = F.initcap(value.cast("string"))
    elif isinstance(dtype, T.BinaryType):
        text = F.base64(value)
    else:
        text = value.cast("string")
    return F.when(value.isNull(), "None").otherwise(text)


def _json_number(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        # JSON spells the special values out.
        plain = float_text(value.cast("double"))
        return (
            F.when(plain == "nan", "NaN")
            .when(plain == "inf", "Infinity")
            .when(plain == "-inf", "-Infinity")
            .otherwise(plain)
        )
    return value.cast("string")


def decode_value(text: Column, dtype: str) -> Column:
    """Typed value of stored text; text that does not parse gives null."""
    if dtype in ("list_float64", "list_int64"):
        return F.from_json(text, DTYPES[dtype])
    if dtype == "float64":
        bare = F.regexp_replace(F.trim(text), "_", "")
        return F.when(F.regexp_like(text, F.lit(FLOAT_TEXT)), bare.try_cast("double"))
    if dtype == "int64":
        bare = F.regexp_replace(F.trim(text), "_", "")
        return F.when(F.regexp_like(text, F.lit(INT_TEXT)), bare.try_cast("bigint"))
    if dtype == "bool":
        return F.lower(text).isin(*TRUE_TEXT)
    if dtype == "bytes":
        return F.unbase64(text)
    return text


def decode_untyped(text: Column) -> tuple[Column, Column]:
    """Read without a type: the text itself, and its numbers where it spells a list."""
    looks_like_list = text.startswith("[") & text.endswith("]")
    return text, F.when(looks_like_list, F.from_json(text, T.ArrayType(T.DoubleType())))
