import json

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepforge.errors import DataError
from prepforge.operators.encode import LabelEncoder, OneHotEncoder
from prepforge.operators.features import create_polynomial_features
from prepforge.operators.impute import handle_missing_values, modes
from prepforge.operators.profile import profile
from prepforge.operators.quantiles import exact_quantiles, grouped_quantiles
from prepforge.operators.scale import ColumnScaler, MinMaxScaler, RobustScaler, StandardScaler
from prepforge.operators.split import train_test_split, with_split
from prepforge.plans.preparation import PreprocessingPipeline, apply_preprocessing_pipeline


@pytest.fixture
def matrix(spark):
    return spark.createDataFrame([(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)], "a double, b double")


@pytest.fixture
def gaps(spark):
    return spark.createDataFrame([(1.0, 1.0), (2.0, None), (None, 3.0), (4.0, 4.0)], "a double, b double")


def column(df, name):
    return [r[name] for r in df.collect()]


# quantiles -------------------------------------------------------------------

@pytest.mark.parametrize("limit,accuracy", [(50_000, 10_000), (20, 100), (3, 50)])
def test_quantiles_equal_numpy(spark, limit, accuracy):
    rng = np.random.default_rng(1)
    columns = {
        "normal": rng.normal(size=20_000), "heavy": np.exp(3 * rng.normal(size=20_000)),
        "hot": np.where(rng.random(20_000) < 0.4, 7.0, rng.normal(size=20_000)),
        "few": rng.integers(0, 3, 20_000).astype(float), "same": np.full(20_000, 2.5),
    }
    import pandas as pd
    df = spark.createDataFrame(pd.DataFrame(columns))
    probs = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    found = exact_quantiles(df, list(columns), probs, max_values=limit, accuracy=accuracy)
    for name, values in columns.items():
        assert found[name] == pytest.approx(np.quantile(values, probs), rel=1e-12, abs=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, float("nan")), (None, 1.0)], "x double, y double")
    assert exact_quantiles(df, ["x", "y"], [0.5]) == {"x": [None], "y": [1.0]}


# profile ---------------------------------------------------------------------

def test_profile_of_empty_and_single_values(spark):
    df = spark.createDataFrame([(None, 1.0, "a"), (None, float("nan"), "a"), (None, None, None)],
                               "x double, y double, s string")
    got = {r["column"]: r for r in profile(df).collect()}
    assert got["x"]["null_count"] == 3 and got["x"]["unique_count"] == 0
    assert all(got["x"][k] is None for k in ("mean", "std", "min", "max", "median"))
    assert got["y"]["null_count"] == 2 and got["y"]["mean"] == 1.0 and got["y"]["std"] is None
    assert got["s"]["unique_count"] == 1 and got["s"]["mean"] is None


def test_profile_approximate_agrees_roughly(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).cast("string").alias("s"))
    exact = {r["column"]: r for r in profile(df).collect()}
    rough = {r["column"]: r for r in profile(df, approximate=True).collect()}
    assert exact["id"]["unique_count"] == 1000 and exact["s"]["unique_count"] == 7
    assert rough["id"]["unique_count"] == pytest.approx(1000, rel=0.15)
    assert rough["id"]["mean"] == exact["id"]["mean"]


# imputation ------------------------------------------------------------------

@pytest.mark.parametrize("strategy", ["mean", "median"])
def test_impute_leaves_no_gap(gaps, strategy):
    out = handle_missing_values(gaps, strategy)
    assert out.where("a IS NULL OR b IS NULL").count() == 0


def test_impute_values(gaps, spark):
    assert column(handle_missing_values(gaps, "mean"), "a")[2] == pytest.approx(7 / 3)
    assert column(handle_missing_values(gaps, "median"), "a")[2] == 2.0
    assert column(handle_missing_values(gaps, "constant", 0), "a") == [1.0, 2.0, 0.0, 4.0]
    assert handle_missing_values(gaps, "drop").count() == 2
    assert handle_missing_values(gaps, "drop", columns=["a", "unknown"]).count() == 3
    ties = spark.createDataFrame([(3,), (1,), (1,), (3,), (2,), (None,)], "x int")
    assert modes(ties, ["x"]) == {"x": 1}
    assert column(handle_missing_values(ties, "mode"), "x")[-1] == 1


def test_impute_by_type(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, None), (None, "a", None)],
                               "i int, s string, e double")
    mean = handle_missing_values(df, "mean")
    assert dict(mean.dtypes) == {"i": "double", "s": "string", "e": "double"}
    assert column(mean, "i")[2] == 1.5 and column(mean, "s")[1] is None and column(mean, "e") == [None] * 3
    mode = handle_missing_values(df, "mode")
    assert column(mode, "s") == ["a", "a", "a"] and column(mode, "e") == [None] * 3
    assert dict(mode.dtypes)["i"] == "int"


def test_impute_errors(gaps):
    with pytest.raises(DataError):
        handle_missing_values(gaps, "guess")
    with pytest.raises(DataError):
        handle_missing_values(gaps, "constant")


# scalers ---------------------------------------------------------------------

def test_standard_scaler(matrix):
    scaler = StandardScaler().fit(matrix)
    out = np.array(scaler.transform(matrix).collect())
    assert np.allclose(out.mean(axis=0), 0, atol=1e-10) and np.allclose(out.std(axis=0), 1, atol=1e-10)
    back = np.array(scaler.inverse_transform(scaler.transform(matrix)).collect())
    assert np.allclose(back, np.array(matrix.collect()))


def test_minmax_scaler(matrix):
    out = np.array(MinMaxScaler().fit_transform(matrix).collect())
    assert out.min() == 0.0 and out.max() == 1.0
    wide = np.array(MinMaxScaler((-1, 1)).fit_transform(matrix).collect())
    assert wide.min() == -1.0 and wide.max() == 1.0


def test_robust_scaler(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (5.0,), (100.0,)], "a double")
    scaler = RobustScaler().fit(df)
    assert scaler.state == {"median": [4.0], "iqr": [26.25]}


@pytest.mark.parametrize("make", [StandardScaler, MinMaxScaler, RobustScaler])
def test_scaler_state_and_constant(spark, matrix, make):
    fitted = make().fit(matrix)
    again = ColumnScaler.from_dict(fitted.to_dict())
    assert again.transform(matrix).collect() == fitted.transform(matrix).collect()
    same = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert column(make().fit_transform(same), "x") == [0.0, 0.0]
    with pytest.raises(DataError):
        make().transform(matrix)


# encoders --------------------------------------------------------------------

@pytest.fixture
def letters(spark):
    return spark.createDataFrame([(i, v) for i, v in enumerate("abcab")], "id int, y string")


@pytest.mark.parametrize("limit", [10, 2])
def test_label_encoder(letters, limit):
    encoder = LabelEncoder().fit(letters, "y", max_listed=limit)
    coded = encoder.transform(letters).orderBy("id")
    assert column(coded, "y") == [0, 1, 2, 0, 1]
    assert column(encoder.inverse_transform(coded).orderBy("id"), "y") == list("abcab")
    again = LabelEncoder.from_dict(encoder.to_dict())
    assert column(again.transform(letters).orderBy("id"), "y") == [0, 1, 2, 0, 1]


@pytest.mark.parametrize("limit", [10, 1])
def test_label_encoder_unseen(spark, letters, limit):
    encoder = LabelEncoder().fit(letters.where("y <> 'c'"), "y", max_listed=limit)
    with pytest.raises(Exception, match="unseen category"):
        encoder.transform(letters).collect()
    with pytest.raises(Exception, match="unseen category"):
        encoder.transform(spark.createDataFrame([(1, None)], "id int, y string")).collect()
    with pytest.raises(Exception, match="unknown code"):
        encoder.inverse_transform(spark.createDataFrame([(1, 9)], "id int, y int")).collect()


def test_many_categories_take_the_join_path(spark):
    df = spark.range(500).select("id", F.concat(F.lit("v"), (F.col("id") % 211).cast("string")).alias("y"))
    encoder = LabelEncoder().fit(df, "y")
    assert len(encoder.categories.values) == 211
    expected = {v: i for i, v in enumerate(sorted({f"v{i % 211}" for i in range(500)}))}
    joined = encoder.transform(df).join(df.withColumnRenamed("y", "v"), "id").collect()
    assert all(r["y"] == expected[r["v"]] for r in joined)


def test_one_hot(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "x string")
    encoder = OneHotEncoder().fit(df, "x")
    out = encoder.transform(df)
    assert out.columns == ["x_a", "x_b", "x_c"] and out.count() == 4
    assert [list(r) for r in out.collect()] == [[1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 0, 0]]
    assert encoder.get_feature_names(["z"]) == ["z_a", "z_b", "z_c"]
    other = spark.createDataFrame([("q",), (None,)], "x string")
    with pytest.raises(Exception, match="unseen category"):
        encoder.transform(other).collect()
    lenient = OneHotEncoder("ignore").fit(df, "x")
    assert [list(r) for r in lenient.transform(other).collect()] == [[0, 0, 0], [0, 0, 0]]
    vector = lenient.transform_vector(spark.createDataFrame([("b",), ("q",)], "x string"), "x", "v")
    assert [r["v"].toArray().tolist() for r in vector.collect()] == [[0, 1, 0], [0, 0, 0]]


# features, split -------------------------------------------------------------

def test_powers(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "a double, b double")
    out = create_polynomial_features(df, degree=2)
    assert out.columns == ["a", "b", "a_pow2", "b_pow2"]
    assert [list(r) for r in out.collect()] == [[1, 2, 1, 4], [3, 4, 9, 16]]
    assert create_polynomial_features(df, degree=3, include_bias=True).columns[0] == "bias"


def test_split_is_disjoint_and_stable(spark):
    df = spark.range(5000).select("id", (F.col("id") * 3).alias("v"))
    train, val = train_test_split(df, ["id"])
    assert train.count() + val.count() == 5000 and train.intersect(val).count() == 0
    assert val.count() == pytest.approx(1000, rel=0.1)
    moved = with_split(df.repartition(7), ["id"]).where("split = 'val'")
    assert sorted(column(moved, "id")) == sorted(column(val, "id"))


# chains ----------------------------------------------------------------------

def test_chain_shape_and_round_trip(spark):
    df = spark.createDataFrame([(1.0, 10.0, "x"), (2.0, 20.0, "y"), (3.0, 30.0, "x"), (4.0, 40.0, "z")],
                               "a double, b double, c string")
    made = PreprocessingPipeline().add_scaler("standard").add_encoder("label", ["c"])
    out = made.fit_transform(df)
    assert out.columns == ["a", "b", "c"] and out.count() == 4
    again = PreprocessingPipeline.from_dict(made.to_dict())
    assert again.transform(df).collect() == out.collect()


def test_chain_keeps_unknown_handling(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "c string, x double")
    made = PreprocessingPipeline().add_encoder("onehot", ["c"], handle_unknown="ignore").fit(df)
    again = PreprocessingPipeline.from_dict(made.to_dict())
    out = again.transform(spark.createDataFrame([("q", 1.0)], "c string, x double"))
    assert out.columns == ["x", "c_a", "c_b"] and list(out.first()) == [1.0, 0.0, 0.0]


def test_chain_errors(spark, matrix):
    with pytest.raises(DataError):
        PreprocessingPipeline().add_scaler("unknown")
    with pytest.raises(DataError):
        PreprocessingPipeline().add_encoder("unknown")
    with pytest.raises(DataError):
        PreprocessingPipeline().add_scaler().transform(matrix)


def test_default_preparation(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (3, 3.0, "a")], "k int, x double, c string")
    out, made = apply_preprocessing_pipeline(df, {"categorical_columns": ["c"], "scaler_type": "minmax"})
    assert [list(r) for r in out.collect()] == [[0.0, 0.0, 0], [0.5, 0.5, 1], [1.0, 1.0, 0]]
    unfilled, _ = apply_preprocessing_pipeline(df, {}, made)
    assert column(unfilled, "x")[1] is None
    _, storing = apply_preprocessing_pipeline(
        df, {"categorical_columns": ["c"], "scaler_type": "minmax", "store_imputation": True})
    filled, _ = apply_preprocessing_pipeline(df, {}, storing)
    assert column(filled, "x")[1] == 0.5
    dropped, _ = apply_preprocessing_pipeline(df, {"missing_strategy": "drop", "scale": False})
    assert dropped.count() == 2


def test_numeric_categories_are_not_scaled(spark):
    df = spark.createDataFrame([(10, 1.0), (20, 2.0)], "c int, x double")
    out, _ = apply_preprocessing_pipeline(df, {"categorical_columns": ["c"]})
    assert [r["c"] for r in out.collect()] == [0, 1]


def test_hot_category_in_a_table(spark):
    df = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("v"), F.col("id").cast("string"))).alias("y"))
    encoder = LabelEncoder().fit(df, "y", max_listed=5)
    assert encoder.categories.table
    order = sorted({r["y"] for r in df.collect()})
    out = encoder.transform(df).join(df.withColumnRenamed("y", "v"), "id").collect()
    assert len(out) == 900 and all(order[r["y"]] == r["v"] for r in out)


def test_wide_values_are_not_held_by_the_driver(spark, monkeypatch):
    monkeypatch.setattr("prepforge.operators.encode.MAX_LISTED_BYTES", 100)
    df = spark.createDataFrame([(1, "x" * 60), (2, "y" * 60), (3, "x" * 60)], "id int, y string")
    encoder = LabelEncoder().fit(df, "y")
    assert encoder.categories.values is None
    assert [r["y"] for r in encoder.transform(df).orderBy("id").collect()] == [0, 1, 0]


def test_dictionaries_survive_saving(spark):
    df = spark.sql("""SELECT * FROM VALUES
        (CAST(1.50 AS DECIMAL(5,2)), X'00ff', DATE'2020-01-02', TIMESTAMP'2020-01-02 03:04:05', true, 'a', 1.5D),
        (CAST(2.25 AS DECIMAL(5,2)), X'0a', DATE'2021-01-02', TIMESTAMP'2021-01-02 03:04:05', false, 'b', 2.5D)
        AS t(dec, bin, day, at, flag, txt, num)""")
    for c in df.columns:
        encoder = LabelEncoder().fit(df, c)
        again = LabelEncoder.from_dict(json.loads(json.dumps(encoder.to_dict())))
        assert sorted(r[c] for r in again.transform(df).collect()) == [0, 1]
        assert again.inverse_transform(again.transform(df)).exceptAll(df).count() == 0


@pytest.mark.parametrize("listed", [1, 100])
def test_codes_are_whole_numbers(spark, listed):
    encoder = LabelEncoder().fit(spark.createDataFrame([("a",), ("b",), ("c",)], "y string"), "y", max_listed=listed)
    whole = spark.createDataFrame([(2.0,), (0.0,)], "y double")
    assert [r["y"] for r in encoder.inverse_transform(whole).collect()] == ["c", "a"]
    with pytest.raises(Exception, match="unknown code"):
        encoder.inverse_transform(spark.createDataFrame([(1.5,)], "y double")).collect()


def test_names_of_a_table_dictionary(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "y string")
    encoder = OneHotEncoder().fit(df, "y", max_listed=1)
    assert encoder.categories["y"].values is None
    assert encoder.get_feature_names() == ["x0_a", "x0_b", "x0_c"]
    assert encoder.get_feature_names(["y"]) == ["y_a", "y_b", "y_c"]


def test_quantiles_of_groups(spark):
    rows = [(k, None if i % 11 == 5 else float("nan") if i % 13 == 5 else float(i * 37 % 91))
            for i in range(400) for k in ["a" if i % 5 else None]] + [("b", 3.5), ("c", None), ("d", 1.0), ("d", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r["g"]: (r["lo"], r["mid"], r["hi"]) for r in grouped_quantiles(
        df, ["g"], "v", [0.0, 0.5, 0.93], ["lo", "mid", "hi"]).collect()}
    assert set(got) == {"a", None, "b", "c", "d"} and got["c"] == (None, None, None)
    for g in ("a", None, "b", "d"):
        known = [v for k, v in rows if k == g and v is not None and v == v]
        assert got[g] == pytest.approx(tuple(np.quantile(known, [0.0, 0.5, 0.93])))
    assert grouped_quantiles(df.limit(0), ["g"], "v", [0.5], ["m"]).count() == 0
