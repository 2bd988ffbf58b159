"""Column types for text input, decided over whole columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepforge.functions.columns import quoted

# The texts that stand for a missing value in CSV input.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]

_INTEGER = r"^\s*[+-]?[0-9]+\s*$"
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_INFINITY = r"(?i)^\s*[+-]?inf(inity)?\s*$"


def null_tokens(col: Column) -> Column:
    return F.when(~col.isin(NULL_TOKENS), col)


def _as_bigint(col: Column) -> Column:
    return F.when(col.rlike(_INTEGER), col.try_cast("bigint"))


def _as_double(col: Column) -> Column:
    return F.when(col.rlike(_NUMBER) | col.rlike(_INFINITY), col.try_cast("double"))


def retype_strings(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Text columns become bigint, double or boolean when no value is lost.

    Null tokens count as missing. One aggregate over all text columns takes
    the decision, one projection applies it. A column without any value
    becomes double. Boolean needs a column without gaps.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)
             and (columns is None or f.name in columns)]
    if not names:
        return df
    values = {c: null_tokens(quoted(c)) for c in names}
    seen = df.agg(F.count(F.lit(1)).alias("rows"), *[
        e for i, c in enumerate(names) for e in (
            F.count(values[c]).alias(f"n{i}"),
            F.count(_as_bigint(values[c])).alias(f"i{i}"),
            F.count(_as_double(values[c])).alias(f"d{i}"),
            F.count_if(values[c].isin(TRUE_TOKENS + FALSE_TOKENS)).alias(f"b{i}"),
        )]).first()
    typed = {}
    for i, c in enumerate(names):
        n = seen[f"n{i}"]
        if n and seen[f"i{i}"] == n:
            typed[c] = _as_bigint(values[c])
        elif seen[f"d{i}"] == n:
            typed[c] = _as_double(values[c])
        elif seen[f"b{i}"] == seen["rows"]:
            typed[c] = values[c].isin(TRUE_TOKENS)
        else:
            typed[c] = values[c]
    return df.select(*[typed[c].alias(c) if c in typed else quoted(c) for c in df.columns])
