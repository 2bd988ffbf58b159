import numpy as np
import pytest
from pyspark.sql import functions as F

from prepforge.errors import DuplicateDataError, InferenceError, RegistryError, TrainingError
from prepforge.models.linear import LinearModel
from prepforge.plans.catalog import DatasetCatalog
from prepforge.plans.registry import ModelRegistry
from prepforge.plans.training import Trainer, known_options, train_model


def linear_rows(spark, n=100, seed=42):
    rng = np.random.default_rng(seed)
    f1, f2, noise = rng.normal(size=(3, n))
    y = 2 * f1 + 3 * f2 + 0.1 * noise
    return spark.createDataFrame([tuple(map(float, r)) for r in zip(f1, f2, y)],
                                 "feature1 double, feature2 double, target double")


@pytest.fixture(scope="module")
def trained(spark):
    """A workspace with one dataset, a linear model and its fine-tuned child."""
    from prepforge.session import scratch_path

    trainer = Trainer(spark, scratch_path(spark, "test-run"))
    trainer.catalog.register(linear_rows(spark), "test_dataset")
    first, metrics = trainer.train(config())
    second, _ = trainer.train(config(training_mode="fine_tune", base_model_version=first,
                                     allow_duplicates=True))
    return trainer, first, second, metrics


def config(**more):
    return {"dataset_names": ["test_dataset"], "model_type": "linear_regression",
            "feature_columns": ["feature1", "feature2"], "target_column": "target", **more}


def test_linear_training(trained):
    trainer, first, _, metrics = trained
    assert first == "1.0.0"
    assert set(metrics) == {f"{s}_{m}" for s in ("train", "val") for m in ("mae", "mse", "r2")}
    assert metrics["val_r2"] > 0.99
    record = trainer.registry.get(first)
    assert record["metadata"]["total_rows"] == 100
    assert record["metadata"]["feature_columns"] == ["feature1", "feature2"]


def test_fine_tune_lineage(trained):
    trainer, first, second, _ = trained
    assert second == "1.1.0"
    assert trainer.registry.lineage(second) == [second, first]
    record = trainer.registry.get(second)
    assert record["training_mode"] == "fine_tune" and record["parent"] == first
    assert [r["version"] for r in trainer.registry.children(first).collect()] == [second]


def test_duplicate_data_is_blocked(trained):
    trainer, first, _, _ = trained
    with pytest.raises(DuplicateDataError, match="test_dataset.*overfitting"):
        trainer.train(config(training_mode="fine_tune", base_model_version=first))
    newest = trainer.recent_runs(1).first()
    assert newest["status"] == "failed" and "overfitting" in newest["error_message"]
    assert newest["completed_at"] is not None


def test_run_log(trained):
    trainer, first, _, _ = trained
    done = trainer.recent_runs().where(F.col("result_version") == first).first()
    assert done["status"] == "completed" and done["error_message"] is None
    assert trainer.job_history(done["job_id"]).first()["dataset_name"] == "test_dataset"


def test_listing_and_lookup(trained):
    trainer, first, second, _ = trained
    listed = [r["version"] for r in trainer.registry.list_versions().collect()]
    assert listed[:2] == [second, first] or set(listed) >= {first, second}
    tuned = trainer.registry.list_versions(training_mode="fine_tune").collect()
    assert [r["version"] for r in tuned] == [second]
    assert trainer.registry.list_versions(model_type="other").count() == 0
    with pytest.raises(RegistryError):
        trainer.registry.get("9.9.9")


def test_config_errors(trained):
    trainer, first, _, _ = trained
    with pytest.raises(TrainingError):
        trainer.train({"model_type": "linear_regression", "target_column": "target"})
    with pytest.raises(TrainingError, match="unknown model type"):
        trainer.train(config(model_type="magic"))
    with pytest.raises(TrainingError, match="base model"):
        trainer.train(config(training_mode="fine_tune"))
    with pytest.raises(TrainingError, match="not a random_forest"):
        trainer.train(config(model_type="random_forest", training_mode="fine_tune",
                             base_model_version=first, allow_duplicates=True))
    with pytest.raises(TrainingError, match="not found"):
        trainer.train(config(dataset_names=["nothing"]))


def test_unknown_hyperparameters_fall_away():
    given = {"n_estimators": 5, "max_depth": "", "alpha": 3}
    assert known_options("random_forest", given) == {"n_estimators": 5}
    assert known_options("linear_regression", given) == {}


def test_missing_target_raises(spark, root):
    trainer = Trainer(spark, root)
    trainer.catalog.register(spark.createDataFrame([(1.0, 1.0), (2.0, None)], "x double, y double"), "d")
    with pytest.raises(TrainingError, match="1 missing"):
        trainer.train({"dataset_name": "d", "model_type": "linear_regression", "target_column": "y"})


def test_two_datasets(spark, root):
    trainer = Trainer(spark, root)
    trainer.catalog.register(linear_rows(spark, 50, 1), "one")
    trainer.catalog.register(linear_rows(spark, 50, 2), "two")
    version, _ = trainer.train(config(dataset_names=["one", "two"], model_type="sgd_regressor"))
    assert trainer.registry.get(version)["metadata"]["total_rows"] == 100
    used = {r["dataset_name"]: r["row_count"] for r in trainer.registry.history(version).collect()}
    assert used == {"one": 50, "two": 50}
    tuned, metrics = trainer.train(config(
        dataset_names=["one"], model_type="sgd_regressor", training_mode="fine_tune",
        base_model_version=version, allow_duplicates=True))
    assert tuned == "1.1.0" and metrics["val_r2"] > 0.9
    again, _ = trainer.train(config(
        dataset_names=["one"], model_type="sgd_regressor", training_mode="fine_tune",
        base_model_version=version, allow_duplicates=True))
    assert again == "1.2.0"


def test_forest_and_network_runs(spark, root):
    trainer = Trainer(spark, root)
    rows = linear_rows(spark, 200).withColumn(
        "kind", F.when(F.col("target") > 0, "up").otherwise("down"))
    trainer.catalog.register(rows, "test_dataset")
    _, metrics = trainer.train(config(model_type="random_forest", hyperparameters={
        "n_estimators": 10, "max_depth": 5}))
    assert metrics["train_r2"] > 0.8 and "val_r2" in metrics
    version, metrics = trainer.train(config(model_type="random_forest_classifier", target_column="kind",
                                            hyperparameters={"n_estimators": 10}))
    assert set(metrics) == {f"{s}_{m}" for s in ("train", "val") for m in ("accuracy", "f1")}
    assert metrics["train_accuracy"] > 0.9
    model, preprocessor = trainer.registry.load(version)
    scored = model.predict(preprocessor.transform(rows.select("feature1", "feature2")))
    assert {r["prediction"] for r in scored.collect()} == {"up", "down"}
    base, metrics = trainer.train(config(model_type="torch_mlp", hyperparameters={
        "epochs": 15, "learning_rate": 0.02, "dropout": 0.0}))
    assert metrics["train_r2"] > 0.7
    tuned, better = trainer.train(config(
        model_type="torch_mlp", training_mode="fine_tune", base_model_version=base,
        allow_duplicates=True, hyperparameters={"epochs": 5, "learning_rate": 0.01, "dropout": 0.0}))
    assert better["train_mse"] < metrics["train_mse"] * 1.2


def test_drop_strategy_and_categories(spark, root):
    rows = linear_rows(spark, 80).withColumn("c", F.when(F.rand(1) > 0.5, "x").otherwise("y")).withColumn(
        "feature1", F.when(F.abs("feature1") < 1.5, F.col("feature1")))
    catalog = DatasetCatalog(spark, root)
    catalog.register(rows, "d")
    version, _ = train_model(spark, root, {
        "dataset_name": "d", "model_type": "linear_regression", "target_column": "target",
        "preprocess_config": {"missing_strategy": "drop", "categorical_columns": ["c"],
                              "encoder_type": "onehot"}, "fit_on": "train", "test_size": 0.3})
    record = ModelRegistry(spark, root).get(version)
    assert record["metadata"]["model_inputs"] == ["feature1", "feature2", "c_x", "c_y"]
    assert record["metadata"]["feature_columns"] == ["feature1", "feature2", "c"]


# registry --------------------------------------------------------------------

@pytest.fixture
def registry(spark, root):
    return ModelRegistry(spark, root)


def toy(value=1.0):
    return LinearModel("linear_regression", ["x"], [value], 0.0)


def test_versions_and_save_load(spark, registry):
    assert registry.next_version() == "1.0.0"
    first = registry.save(toy(), "linear_regression", {"mae": 0.0})
    second = registry.save(toy(2.0), "linear_regression", {})
    assert (first["version"], second["version"]) == ("1.0.0", "1.0.1")
    assert [registry.next_version("1.2.3", p) for p in ("major", "minor", "patch")] == [
        "2.0.0", "1.3.0", "1.2.4"]
    model, preprocessor = registry.load("1.0.1")
    assert preprocessor is None
    x = spark.createDataFrame([(4.0,)], "x double")
    assert model.predict(x).first()["prediction"] == 8.0
    with pytest.raises(RegistryError):
        registry.save(toy(), "linear_regression", {}, parent_version="7.0.0")
    with pytest.raises(RegistryError):
        registry.save(toy(), "linear_regression", {}, version="1.0.0")


def test_tampering_is_noticed(registry):
    record = registry.save(toy(), "linear_regression", {})
    folder = f"{record['path']}/model/state".replace("file:", "")
    import glob
    part = [f for f in glob.glob(f"{folder}/*") if not f.endswith("_SUCCESS")][0]
    with open(part, "a") as f:
        f.write(" ")
    import os
    crc = os.path.join(os.path.dirname(part), "." + os.path.basename(part) + ".crc")
    if os.path.exists(crc):
        os.remove(crc)
    with pytest.raises(RegistryError, match="mismatch"):
        registry.load(record["version"])
    registry.load(record["version"], verify_hash=False)


def test_delete_cuts_children_and_history(registry):
    registry.save(toy(), "linear_regression", {})
    registry.record_history("1.0.0", {"d": "h"}, {"d": 3})
    child = registry.save(toy(), "linear_regression", {}, training_mode="fine_tune", parent_version="1.0.0")
    assert registry.duplicate_datasets(child["version"], {"x": "no", "d": "h"}) == ["d"]
    registry.delete("1.0.0")
    assert registry.get(child["version"])["parent"] is None
    assert registry.history().count() == 0
    assert registry.duplicate_datasets(child["version"], {"d": "h"}) == []
    with pytest.raises(RegistryError):
        registry.delete("1.0.0")


def test_records_have_the_stored_types(spark):
    from prepforge.plans.scoring import records_frame

    types = {"a": "bigint", "b": "double", "c": "string"}
    rows = records_frame(spark, [{"a": 1, "b": 2}, {"a": None, "c": "x", "d": 1}, {"b": None, "d": 2.5, "e": None}], types)
    assert dict(rows.dtypes) == {"__row": "bigint", "a": "bigint", "b": "double", "c": "string", "d": "double", "e": "double"}
    assert [tuple(r)[1:] for r in rows.orderBy("__row").collect()] == [
        (1, 2.0, None, None, None), (None, None, "x", 1.0, None), (None, None, None, 2.5, None)]
    assert dict(records_frame(spark, [{"a": 1}, {"a": 2.5}], types).dtypes)["a"] == "double"
    with pytest.raises(InferenceError):
        records_frame(spark, [{"b": "many"}], types)
