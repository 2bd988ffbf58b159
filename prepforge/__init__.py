"""Preparing, modelling and auditing tabular data on Spark."""

from prepforge.errors import (
    DataError, DuplicateDataError, InferenceError, PrepForgeError, RegistryError, TrainingError)
from prepforge.operators.asof import asof_join
from prepforge.operators.concat import concat
from prepforge.operators.encode import LabelEncoder, OneHotEncoder
from prepforge.operators.features import create_polynomial_features
from prepforge.operators.fingerprint import fingerprint
from prepforge.operators.impute import handle_missing_values
from prepforge.operators.lineage import lineage
from prepforge.operators.metrics import (
    accuracy, f1_score, mae, mse, precision, r2_score, recall, rmse)
from prepforge.operators.profile import profile
from prepforge.operators.roc import roc_auc, roc_curve
from prepforge.operators.scale import MinMaxScaler, RobustScaler, StandardScaler
from prepforge.operators.split import train_test_split
from prepforge.plans.catalog import DatasetCatalog
from prepforge.plans.preparation import PreprocessingPipeline, apply_preprocessing_pipeline
from prepforge.plans.registry import ModelRegistry
from prepforge.plans.scoring import Predictor
from prepforge.plans.training import Trainer, train_model

__all__ = [
    "DataError", "DatasetCatalog", "DuplicateDataError", "InferenceError", "LabelEncoder",
    "MinMaxScaler", "ModelRegistry", "OneHotEncoder", "Predictor", "PrepForgeError",
    "PreprocessingPipeline", "RegistryError", "RobustScaler", "StandardScaler", "Trainer",
    "TrainingError", "accuracy", "apply_preprocessing_pipeline", "asof_join", "concat",
    "create_polynomial_features", "f1_score", "fingerprint", "handle_missing_values", "lineage",
    "mae", "mse", "precision", "profile", "r2_score", "recall", "rmse", "roc_auc", "roc_curve",
    "train_model", "train_test_split",
]
