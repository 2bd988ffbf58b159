"""Power features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepforge.functions.columns import as_number, quoted
from prepforge.operators.longform import named


def power_names(columns: list[str], degree: int, include_bias: bool = False) -> list[str]:
    names = ["bias"] if include_bias else []
    names += columns
    return names + [f"{c}_pow{d}" for d in range(2, degree + 1) for c in columns]


def create_polynomial_features(df: DataFrame, columns: list[str] | None = None, degree: int = 2,
                               include_bias: bool = False, keep: list[str] = ()) -> DataFrame:
    """Powers of each column: originals, all squares, all cubes …; no cross terms.

    ``keep`` names columns carried through unchanged in front.
    """
    cols = [c for c in named(df, columns) if c not in keep]
    out = [quoted(c) for c in keep]
    if include_bias:
        out.append(F.lit(1.0).alias("bias"))
    out += [quoted(c) for c in cols]
    out += [F.pow(as_number(df, c), F.lit(d)).alias(f"{c}_pow{d}")
            for d in range(2, degree + 1) for c in cols]
    return df.select(*out)
