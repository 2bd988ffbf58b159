"""Chains of scalers and encoders with one joint fit."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from prepforge.errors import DataError
from prepforge.operators.encode import LabelEncoder, OneHotEncoder, fit_categories
from prepforge.operators.impute import apply_fills, fit_fills, handle_missing_values
from prepforge.operators.scale import (
    ColumnScaler, RobustScaler, default_columns, make_scaler)

ENCODERS = {"label": LabelEncoder, "onehot": OneHotEncoder}


@dataclass
class Step:
    kind: str                                   # a scaler or encoder kind
    columns: list[str] | None
    options: dict[str, Any] = field(default_factory=dict)
    fitted: list = field(default_factory=list)  # scalers / encoders in order

    @property
    def encodes(self) -> bool:
        return self.kind in ENCODERS


class PreprocessingPipeline:
    """Steps are all fitted on the raw input and applied in order.

    Fitting reads the data once for all mean / min / max statistics, once for
    all dictionaries, and a few times for exact quartiles when a robust scaler
    is present, however many columns there are.
    """

    def __init__(self) -> None:
        self.steps: list[Step] = []
        self.fitted = False
        self.fills: dict[str, Any] = {}

    def add_scaler(self, scaler_type: str = "standard", columns: list[str] | None = None,
                   **options) -> "PreprocessingPipeline":
        make_scaler(scaler_type, **options)
        self.steps.append(Step(scaler_type, columns, options))
        return self

    def add_encoder(self, encoder_type: str = "label", columns: list[str] | None = None,
                    **options) -> "PreprocessingPipeline":
        if encoder_type not in ENCODERS:
            raise DataError(f"unknown encoder type: {encoder_type}")
        ENCODERS[encoder_type](**options)
        self.steps.append(Step(encoder_type, columns, options))
        return self

    def fit(self, df: DataFrame) -> "PreprocessingPipeline":
        encoded = [c for s in self.steps if s.encodes for c in s.columns or [] if c in df.columns]
        categories = fit_categories(df, list(dict.fromkeys(encoded)))
        plain: list[tuple[ColumnScaler, list[str]]] = []
        for step in self.steps:
            step.fitted = []
            if step.encodes:
                present = [c for c in step.columns or [] if c in df.columns]
                if step.kind == "label":
                    step.fitted = [LabelEncoder().adopt(c, categories[c]) for c in present]
                elif present:
                    encoder = OneHotEncoder(**step.options)
                    step.fitted = [encoder.adopt({c: categories[c] for c in present})]
                continue
            names = step.columns or default_columns(df, exclude=encoded)
            if not names:
                continue
            scaler = make_scaler(step.kind, **step.options)
            step.fitted = [scaler]
            if isinstance(scaler, RobustScaler):
                scaler.fit(df, names)
            else:
                plain.append((scaler, names))
        if plain:
            parts = [s.aggregates(df, names) for s, names in plain]
            measured = list(df.agg(*[
                e.alias(f"m{i}") for i, e in enumerate(x for p in parts for x in p)]).first())
            for (scaler, names), part in zip(plain, parts):
                scaler.absorb(names, measured[:len(part)])
                measured = measured[len(part):]
        self.fitted = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.fitted:
            raise DataError("pipeline is not fitted; call fit() first")
        out = apply_fills(df, self.fills) if self.fills else df
        for step in self.steps:
            for part in step.fitted:
                if isinstance(part, LabelEncoder) and part.column not in out.columns:
                    continue
                out = part.transform(out)
        return out

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def to_dict(self) -> dict[str, Any]:
        return {
            "fitted": self.fitted, "fills": self.fills,
            "steps": [{"kind": s.kind, "columns": s.columns, "options": s.options,
                       "fitted": [p.to_dict() for p in s.fitted]} for s in self.steps],
        }

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> "PreprocessingPipeline":
        out = cls()
        out.fitted, out.fills = data["fitted"], dict(data.get("fills", {}))
        for s in data["steps"]:
            load = ENCODERS[s["kind"]] if s["kind"] in ENCODERS else ColumnScaler
            out.steps.append(Step(s["kind"], s["columns"], dict(s["options"]),
                                  [load.from_dict(p) for p in s["fitted"]]))
        return out


# The keys of a preparation setting and their defaults.
PREPARATION_DEFAULTS: dict[str, Any] = {
    "missing_strategy": "mean", "fill_value": None, "scale": True, "scaler_type": "standard",
    "numeric_columns": None, "categorical_columns": [], "encoder_type": "label",
    "store_imputation": False,
}


def apply_preprocessing_pipeline(df: DataFrame, config: dict[str, Any],
                                 pipeline: PreprocessingPipeline | None = None,
                                 fit_on: DataFrame | None = None,
                                 carried: list[str] = ()):
    """``(prepared frame, pipeline)``; a given pipeline is only applied.

    A new one imputes, scales and encodes as configured. Imputation is part of
    the stored pipeline only with ``store_imputation``. ``fit_on`` limits the
    rows that statistics are taken from (default: all rows of ``df``);
    ``carried`` names columns that are no features and pass through.
    """
    if pipeline is not None:
        return pipeline.transform(df), pipeline
    setting = {**PREPARATION_DEFAULTS, **config}
    basis = fit_on if fit_on is not None else df
    strategy = setting["missing_strategy"]
    features = [c for c in df.columns if c not in carried]
    fills: dict[str, Any] = {}
    if strategy == "drop":
        df, basis = (handle_missing_values(d, "drop", columns=features) for d in (df, basis))
    else:
        fills = fit_fills(basis, strategy, setting["fill_value"], features)
        df, basis = apply_fills(df, fills), apply_fills(basis, fills)

    made = PreprocessingPipeline()
    categorical = list(setting["categorical_columns"] or [])
    if setting["scale"]:
        columns = setting["numeric_columns"] or default_columns(
            basis, exclude=[*categorical, *carried])
        if columns:
            made.add_scaler(setting["scaler_type"], columns)
    if categorical:
        options = {}
        if "handle_unknown" in setting and setting["encoder_type"] == "onehot":
            options["handle_unknown"] = setting["handle_unknown"]
        made.add_encoder(setting["encoder_type"], categorical, **options)
    prepared = made.fit(basis).transform(df)
    if setting["store_imputation"]:
        made.fills = fills
    return prepared, made
