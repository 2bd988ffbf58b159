import numpy as np
import pytest

from prepforge.errors import DataError
from prepforge.operators import diagnostics, metrics
from prepforge.operators.roc import roc_auc, roc_curve


def pairs(spark, y, p, kind="int"):
    return spark.createDataFrame(list(zip(y, p)), f"y {kind}, p {kind}")


def test_regression_metrics(spark):
    equal = pairs(spark, [1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.0], "double")
    assert metrics.mae(equal, "y", "p") == 0 and metrics.mse(equal, "y", "p") == 0
    assert metrics.r2_score(equal, "y", "p") == 1.0
    shifted = pairs(spark, [1.0, 2.0, 3.0, 4.0], [2.0, 3.0, 4.0, 5.0], "double")
    assert metrics.mae(shifted, "y", "p") == 1 and metrics.mse(shifted, "y", "p") == 1
    assert metrics.rmse(shifted, "y", "p") == 1
    assert metrics.r2_score(pairs(spark, [3.0, 3.0, 3.0], [1.0, 2.0, 3.0], "double"), "y", "p") == 0.0


def test_classification_metrics(spark):
    equal = pairs(spark, [1, 1, 0, 0], [1, 1, 0, 0])
    assert [f(equal, "y", "p") for f in (metrics.accuracy, metrics.precision, metrics.recall,
                                         metrics.f1_score)] == [1.0] * 4
    assert metrics.accuracy(pairs(spark, [1, 1, 0, 0], [1, 0, 1, 0]), "y", "p") == 0.5


@pytest.mark.parametrize("average", ["macro", "weighted", "micro", "anything"])
def test_averages(spark, average):
    df = pairs(spark, [0, 1, 2, 2], [0, 2, 2, 1])
    for f in (metrics.precision, metrics.recall, metrics.f1_score):
        assert f(df, "y", "p", average) == pytest.approx(0.5)


def test_macro_f1_is_not_the_mean_of_f1(spark):
    df = pairs(spark, [0, 0, 1], [0, 1, 1])
    assert metrics.f1_score(df, "y", "p", "macro") == pytest.approx(0.75)


def test_empty_denominators(spark):
    df = pairs(spark, [0, 0], [0, 0])
    assert metrics.precision(df, "y", "p") == 0.0 and metrics.recall(df, "y", "p") == 0.0
    assert metrics.f1_score(df, "y", "p") == 0.0


def test_roc(spark):
    y = [1, 0, 1, 1, 0, 0, 1, 0]
    s = [0.9, 0.8, 0.7, 0.6, 0.55, 0.5, 0.4, 0.3]
    df = spark.createDataFrame(list(zip(y, s)), "y int, s double")
    assert roc_auc(df, "y", "s") == pytest.approx(0.6875)
    assert roc_auc(df.where("y = 1"), "y", "s") == 0.5
    assert roc_auc(df.selectExpr("y", "1.0 AS s"), "y", "s") == 0.5
    last = roc_curve(df, "y", "s").orderBy("score").first()
    assert (last["tp"], last["fp"], last["tpr"], last["fpr"]) == (4, 4, 1.0, 1.0)


def test_roc_against_pair_counting(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 300), np.round(rng.normal(size=300), 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    diff = s[y == 1][:, None] - s[y == 0][None, :]
    assert roc_auc(df, "y", "s") == pytest.approx(((diff > 0) + 0.5 * (diff == 0)).mean())


def test_confusion(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b")], "y string, p string")
    cells = {(r["y"], r["p"]): r["n"] for r in diagnostics.confusion_matrix(df, "y", "p").collect()}
    assert cells == {("a", "a"): 1, ("a", "b"): 1, ("b", "a"): 0, ("b", "b"): 0}
    shares = {(r["y"], r["p"]): r["share"]
              for r in diagnostics.confusion_matrix(df, "y", "p", normalize=True).collect()}
    assert shares[("a", "a")] == 0.5 and shares[("b", "a")] == 0.0 and shares[("b", "b")] == 0.0


def test_histogram(spark):
    df = spark.createDataFrame([(float(i),) for i in range(31)], "x double")
    bins = [r["n"] for r in diagnostics.histogram(df, "x").orderBy("bin").collect()]
    assert len(bins) == 30 and sum(bins) == 31 and bins[29] == 2
    same = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    counts = [r["n"] for r in diagnostics.histogram(same, "x").orderBy("bin").collect()]
    assert counts == np.histogram([2.0, 2.0], bins=30)[0].tolist()
    with pytest.raises(DataError):
        diagnostics.histogram(same.where("x > 5"), "x")
