"""Scalers: fitted by one aggregate, applied by one projection.

The fitted state is a centre and a spread per column. The ML library's own
scalers are not used because they differ in results: sample instead of
population deviation, mid-range for constant columns, approximate quartiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepforge.errors import DataError
from prepforge.functions.columns import as_number, is_scalable, quoted
from prepforge.operators.quantiles import exact_quantiles


class ColumnScaler:
    """Shared behaviour; subclasses say what is measured and how it is applied."""

    kind = ""

    def __init__(self) -> None:
        self.columns: list[str] | None = None
        self.state: dict[str, list[float | None]] = {}

    # fitting ---------------------------------------------------------------
    def aggregates(self, df: DataFrame, columns: list[str]) -> list[Column]:
        """Aggregates to fit on, in the order ``absorb`` expects them."""
        raise NotImplementedError

    def absorb(self, columns: list[str], measured: list) -> None:
        raise NotImplementedError

    def fit(self, df: DataFrame, columns: list[str] | None = None) -> "ColumnScaler":
        names = columns or default_columns(df)
        if not names:
            raise DataError("no numeric column to scale")
        self.absorb(names, list(df.agg(*self.aggregates(df, names)).first()))
        return self

    # applying --------------------------------------------------------------
    def forward(self, x: Column, i: int) -> Column:
        raise NotImplementedError

    def backward(self, x: Column, i: int) -> Column:
        raise NotImplementedError

    def _project(self, df: DataFrame, change) -> DataFrame:
        if self.columns is None:
            raise DataError("scaler is not fitted; call fit() first")
        missing = [c for c in self.columns if c not in df.columns]
        if missing:
            raise DataError(f"missing column: {missing[0]}")
        place = {c: i for i, c in enumerate(self.columns)}
        return df.select(*[
            change(as_number(df, c), place[c]).alias(c) if c in place else quoted(c)
            for c in df.columns
        ])

    def transform(self, df: DataFrame) -> DataFrame:
        return self._project(df, self.forward)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return self._project(df, self.backward)

    def fit_transform(self, df: DataFrame, columns: list[str] | None = None) -> DataFrame:
        return self.fit(df, columns).transform(df)

    # state -----------------------------------------------------------------
    def options(self) -> dict:
        return {}

    def to_dict(self) -> dict:
        return {"kind": self.kind, "columns": self.columns, "state": self.state, **self.options()}

    @staticmethod
    def from_dict(data: dict) -> "ColumnScaler":
        options = {k: v for k, v in data.items() if k not in ("kind", "columns", "state")}
        scaler = make_scaler(data["kind"], **options)
        scaler.columns, scaler.state = data["columns"], data["state"]
        return scaler

    def _get(self, name: str, i: int) -> Column:
        return F.lit(self.state[name][i]).cast("double")


class StandardScaler(ColumnScaler):
    """(x - mean) / population deviation; a constant column becomes 0."""

    kind = "standard"

    def aggregates(self, df, columns):
        return [e for c in columns for e in (
            F.avg(as_number(df, c)), F.stddev_pop(as_number(df, c)))]

    def absorb(self, columns, measured):
        self.columns = list(columns)
        self.state = {"mean": measured[0::2], "std": [_spread(s) for s in measured[1::2]]}

    def forward(self, x, i):
        return (x - self._get("mean", i)) / self._get("std", i)

    def backward(self, x, i):
        return x * self._get("std", i) + self._get("mean", i)


class MinMaxScaler(ColumnScaler):
    """Maps min..max to the feature range; later values are not clipped."""

    kind = "minmax"

    def __init__(self, feature_range: tuple[float, float] = (0.0, 1.0)) -> None:
        super().__init__()
        self.low, self.high = (float(v) for v in feature_range)

    def aggregates(self, df, columns):
        return [e for c in columns for e in (F.min(as_number(df, c)), F.max(as_number(df, c)))]

    def absorb(self, columns, measured):
        self.columns = list(columns)
        low, high = measured[0::2], measured[1::2]
        spans = [None if a is None else _spread(b - a) for a, b in zip(low, high)]
        self.state = {
            "min": low, "max": high,
            "scale": [None if s is None else (self.high - self.low) / s for s in spans],
        }

    def forward(self, x, i):
        return (x - self._get("min", i)) * self._get("scale", i) + F.lit(self.low)

    def backward(self, x, i):
        return (x - F.lit(self.low)) / self._get("scale", i) + self._get("min", i)

    def options(self):
        return {"feature_range": [self.low, self.high]}


class RobustScaler(ColumnScaler):
    """(x - median) / interquartile range, both exact."""

    kind = "robust"

    def fit(self, df, columns=None):
        names = columns or default_columns(df)
        if not names:
            raise DataError("no numeric column to scale")
        quartiles = exact_quantiles(df, names, [0.25, 0.5, 0.75])
        self.columns = list(names)
        self.state = {
            "median": [quartiles[c][1] for c in names],
            "iqr": [None if quartiles[c][0] is None
                    else _spread(quartiles[c][2] - quartiles[c][0]) for c in names],
        }
        return self

    def forward(self, x, i):
        return (x - self._get("median", i)) / self._get("iqr", i)

    def backward(self, x, i):
        return x * self._get("iqr", i) + self._get("median", i)


def _spread(value: float | None) -> float | None:
    return 1.0 if value == 0.0 else value


def default_columns(df: DataFrame, exclude: list[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if is_scalable(f.dataType) and f.name not in exclude]


def make_scaler(kind: str, **options) -> ColumnScaler:
    for cls in (StandardScaler, MinMaxScaler, RobustScaler):
        if cls.kind == kind:
            return cls(**options)
    raise DataError(f"unknown scaler type: {kind}")
