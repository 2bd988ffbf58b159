import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prepforge.errors import InferenceError, TrainingError
from prepforge.models import forest, sgd
from prepforge.models import trees as trees_module
from prepforge.models.forest import fit_forest, fit_forest_classifier
from prepforge.models.linear import LinearModel, fit_least_squares
from prepforge.models.mlp import Layers, MlpModel, fit_mlp
from prepforge.models.sgd import descend, fit_sgd
from prepforge.plans import attribution
from prepforge.plans.attribution import (
    contributions, lime, shap_importance, standard_deviations)
from prepforge.plans.scoring import Predictor
from prepforge.plans.training import Trainer


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    y = 1.5 * x[:, 0] - 2 * x[:, 1] + 0.5 * x[:, 2] + 4
    frame = pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=np.arange(400), y=y)
    return spark.createDataFrame(frame).cache()


FEATURES = ["a", "b", "c"]


def test_least_squares(points):
    model = fit_least_squares(points, FEATURES, "y")
    assert model.weights == pytest.approx([1.5, -2, 0.5]) and model.intercept == pytest.approx(4)


def test_wide_linear_expression(spark):
    names = [f"f{i}" for i in range(150)]
    df = spark.range(1).select(*[F.lit(float(i)).alias(n) for i, n in enumerate(names)])
    model = LinearModel("linear_regression", names, [2.0] * 150, 1.0)
    assert model.predict(df).first()["prediction"] == 2.0 * sum(range(150)) + 1


def test_sgd_approaches_least_squares(points):
    model, history = fit_sgd(points, FEATURES, "y")
    assert model.weights == pytest.approx([1.5, -2, 0.5], abs=5e-3)
    assert model.intercept == pytest.approx(4, abs=5e-3)
    assert history[-1] <= history[0]
    more, _ = fit_sgd(points, FEATURES, "y", start=model, max_iter=1)
    assert more.extra["steps"] == model.extra["steps"] + 400
    with pytest.raises(TrainingError, match="diverged"):
        fit_sgd(points.withColumn("a", F.col("a") * 1e6), FEATURES, "y")


def test_descend_is_one_step_per_row():
    r = np.random.default_rng(4)
    x, y, w = r.normal(size=(9, 2)), r.normal(size=9), np.array([0.3, -1.0, 2.0])
    want, lost = w.copy(), 0.0
    for i in range(9):
        rate = 0.01 / (5 + 1 + i) ** 0.25
        error = want[0] + x[i] @ want[1:] - y[i]
        lost += error ** 2 / 2
        want = np.concatenate([[want[0] - rate * error], want[1:] - rate * (error * x[i] + 1e-3 * want[1:])])
    got, found = descend(w, x, y, 5, 0.01, 0.25, 1e-3)
    assert got == pytest.approx(want, rel=1e-12) and found == pytest.approx(lost)


def test_sgd_order_layout_and_parts(points, monkeypatch):
    one, other = (fit_sgd(points.repartition(n), FEATURES, "y", max_iter=2)[0] for n in (1, 7))
    assert one.weights == other.weights
    drawn, _ = fit_sgd(points, FEATURES, "y", max_iter=2, random_state=7)
    assert drawn.weights != one.weights and drawn.weights == pytest.approx(one.weights, abs=0.2)
    monkeypatch.setattr(sgd, "PART_ROWS", 30)
    parts, history = fit_sgd(points, FEATURES, "y", max_iter=25, tol=1e-9)
    assert parts.weights == pytest.approx([1.5, -2, 0.5], abs=0.5) and parts.extra["steps"] == pytest.approx(
        len(history) * 400 / 14)


@pytest.mark.parametrize("intercept", [True, False])
def test_least_squares_of_least_length(spark, points, intercept):
    df = points.select("a", "b", (F.col("a") + F.col("b")).alias("s"), F.lit(2.0).alias("one"), F.col("a").alias("a2"),
                       (F.col("y") + F.sin("id")).alias("y")).repartition(40)
    names = ["a", "b", "s", "one", "a2"]
    model = fit_least_squares(df, names, "y", fit_intercept=intercept)
    rows = np.array([list(r) for r in df.collect()])
    x, y = rows[:, :-1], rows[:, -1]
    mean_x, mean_y = (x.mean(axis=0), y.mean()) if intercept else (0, 0)
    want = np.linalg.lstsq(x - mean_x, y - mean_y, rcond=None)[0]
    assert model.weights == pytest.approx(want, abs=1e-9)
    assert model.intercept == pytest.approx(mean_y - mean_x @ want if intercept else 0.0, abs=1e-9)


def test_fewer_rows_than_features_and_wide_tables(spark):
    r = np.random.default_rng(8)
    x, w = r.normal(size=(300, 2050)), r.normal(size=2050)
    names = [f"f{i}" for i in range(2050)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(y=x @ w + 3)).repartition(3).cache()
    model = fit_least_squares(df, names, "y")
    centred = x - x.mean(axis=0)
    assert model.weights == pytest.approx(np.linalg.lstsq(centred, centred @ w, rcond=None)[0], abs=1e-6)
    sgd_model, history = fit_sgd(df, names, "y", max_iter=2, eta0=1e-4)
    assert len(sgd_model.weights) == 2050 and history[-1] < history[0]
    with pytest.raises(TrainingError, match="no rows"):
        fit_least_squares(df.limit(0).select("f1", "y"), ["f1"], "y")


@pytest.mark.parametrize("width", [3, 25])
def test_missing_features_have_one_rule(spark, width):
    names = [f"f{i}" for i in range(width)]
    df = spark.range(40).select(*[
        F.when(F.col("id") % 20 != i % 7, F.rand(i)).alias(n) for i, n in enumerate(names)], F.rand(99).alias("y"))
    gaps = df.where(" OR ".join(f"{n} IS NULL" for n in names)).count()
    for fit in (fit_sgd, fit_least_squares, fit_mlp, fit_forest, fit_forest_classifier):
        with pytest.raises(TrainingError, match=f"{gaps} rows lack"):
            fit(df, names, "y")


def test_network_does_not_depend_on_the_layout(spark, points):
    one, _ = fit_mlp(points.repartition(3), FEATURES, "y", epochs=2)
    two, _ = fit_mlp(points.coalesce(1), FEATURES, "y", epochs=2)
    assert np.array_equal(one.weights, two.weights)


def test_network_gradient_by_differences():
    layers = Layers([3, 4, 2, 1])
    flat = layers.initial(1)
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(7, 3)), rng.normal(size=7)
    grad, _ = layers.gradient(flat, x, y, 0.0, rng)
    loss = lambda w: float(np.mean((layers.forward(w, x) - y) ** 2))
    for k in range(0, layers.count, 3):
        step = np.zeros_like(flat)
        step[k] = 1e-6
        assert grad[k] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-6, abs=1e-5)


def test_network_learns_and_continues(points):
    model, history = fit_mlp(points, FEATURES, "y", epochs=12, learning_rate=0.02, dropout=0.0,
                             validation=points)
    assert history[-1][0] < history[0][0] / 5 and history[-1][1] < 2.0
    again = MlpModel.from_dict(model.to_dict())
    a, b = (m.predict(points).agg(F.sum("prediction")).first()[0] for m in (model, again))
    assert a == pytest.approx(b)
    _, more = fit_mlp(points, FEATURES, "y", start=model, epochs=1, learning_rate=0.001, dropout=0.0)
    assert more[0][0] < history[0][0]


# attribution -------------------------------------------------------------------

def test_linear_attribution(points):
    model = fit_least_squares(points, FEATURES, "y")
    phi = contributions(model.predict(points), model, ["prediction"])
    mean = points.agg(F.avg("y")).first()[0]
    off = phi.select(F.abs(F.col("phi_a") + F.col("phi_b") + F.col("phi_c") + mean - F.col("prediction")))
    assert max(r[0] for r in off.collect()) < 1e-9
    got = {r["feature"]: r["importance"] for r in shap_importance(points, model).collect()}
    assert got["b"] > got["a"] > got["c"]


def path_value(parts, x, known):
    """Mean output when only the features in ``known`` are given."""
    def walk(unit, node):
        tree = parts[unit]
        f = tree.feature[node]
        if f < -1:
            return walk(-2 - f, 0)
        if f < 0:
            return tree.value[node], tree.weight[node]
        (left, n_left), (right, n_right) = walk(unit, tree.left[node]), walk(unit, tree.right[node])
        if f in known:
            return (left if x[f] <= tree.threshold[node] else right), n_left + n_right
        return (n_left * left + n_right * right) / (n_left + n_right), n_left + n_right
    return walk(-1 if -1 in parts else 0, 0)[0]


def brute_shapley(value, d):
    phi = np.zeros(d)
    for i in range(d):
        others = [j for j in range(d) if j != i]
        for size in range(d):
            for s in itertools.combinations(others, size):
                w = math.factorial(size) * math.factorial(d - size - 1) / math.factorial(d)
                phi[i] += w * (value({*s, i}) - value(set(s)))
    return phi


@pytest.mark.parametrize("classify, unit, group", [(False, 10 ** 6, 10 ** 8), (True, 10 ** 6, 10 ** 8), (False, 30, 10 ** 8),
                                                  (True, 30, 1)])
def test_tree_attribution_against_all_subsets(spark, points, monkeypatch, classify, unit, group):
    monkeypatch.setattr(forest, "UNIT_ROWS", unit)
    monkeypatch.setattr(forest, "GROUP_BYTES", group)
    if classify:
        df = points.withColumn("k", F.when(F.col("y") > 4, "p").otherwise("n"))
        model = fit_forest_classifier(df, FEATURES, "k", n_estimators=3, max_depth=4)
    else:
        model = fit_forest(points, FEATURES, "y", n_estimators=3, max_depth=4)
    trees = {}
    for groups in model.groups(spark, whole_trees=True):
        for t, u, tree, _ in groups:
            trees.setdefault(t, {})[u] = tree
    assert len(trees) == 3 and (unit > 30) == all(set(parts) == {0} for parts in trees.values())
    rows = contributions(points.limit(5), model, FEATURES).collect()
    for r in rows:
        x, got = [r[f] for f in FEATURES], np.array([r[f"phi_{f}"] for f in FEATURES])
        value = lambda known: np.mean([path_value(parts, x, known) for parts in trees.values()])
        assert got == pytest.approx(brute_shapley(value, 3), abs=1e-9)
        assert got.sum() + model.expected(spark) == pytest.approx(value({0, 1, 2}))


def test_network_attribution_adds_up(points):
    model, _ = fit_mlp(points, FEATURES, "y", epochs=2)
    phi = contributions(model.predict(points), model, ["prediction"])
    gap = phi.select((F.col("prediction") - F.col("phi_a") - F.col("phi_b") - F.col("phi_c")).alias("e"))
    low, high = gap.agg(F.min("e"), F.max("e")).first()
    assert high - low < 1e-8       # the same mean output is left for every row


def test_lime_recovers_a_linear_model(points):
    model = fit_least_squares(points, FEATURES, "y")
    spreads = standard_deviations(points, FEATURES)
    out = lime(points.limit(3), model, "id", spreads, samples=200, ridge=0.0)
    for r in out.collect():
        weight = model.weights[FEATURES.index(r["feature"])]
        assert r["weight"] == pytest.approx(weight * spreads[r["feature"]], rel=1e-6)
    assert out.count() == 9


# scoring -----------------------------------------------------------------------

@pytest.fixture(scope="module")
def predictor(spark):
    from prepforge.session import scratch_path

    root = scratch_path(spark, "test-score")
    trainer = Trainer(spark, root)
    trainer.catalog.register(spark.createDataFrame(
        [(1.0, 2.0, 3.0), (3.0, 4.0, 7.0), (5.0, 6.0, 11.0), (7.0, 8.0, 15.0), (2.0, 5.0, 7.0)],
        "x1 double, x2 double, y double"), "sums")
    version, _ = trainer.train({"dataset_name": "sums", "model_type": "linear_regression",
                                "target_column": "y", "test_size": 0.01})
    return Predictor(spark, root), version


def test_score_records(predictor):
    service, version = predictor
    result = service.predict(version, {"x1": 2, "x2": 3})
    assert result["version"] == version and result["predictions"][0] == pytest.approx(5, abs=0.1)
    many = service.predict(version, [{"x1": 1.0, "x2": 2.0}, {"x2": 4.0, "x1": 3.0}, {"x1": 5.0, "x2": 6.0}])
    assert many["predictions"] == pytest.approx([3, 7, 11], abs=0.1)
    with pytest.raises(InferenceError, match="x2"):
        service.predict(version, {"x1": 1.0})


def test_scoring_is_logged(predictor):
    service, version = predictor
    result = service.predict(version, [{"x1": 1.0, "x2": 2.0}, {"x1": 3.0, "x2": 4.0}])
    rows = service.log_rows().where(F.col("call_id") == result["call_id"]).collect()
    assert len(rows) == 2 and {r["model_version"] for r in rows} == {version}
    assert {r["input"] for r in rows} == {'{"x1":1.0,"x2":2.0}', '{"x1":3.0,"x2":4.0}'}
    assert service.recent_calls(1).first()["rows"] == 2


def test_score_file_and_frame(spark, predictor, tmp_path):
    service, version = predictor
    path = tmp_path / "in.csv"
    path.write_text("x1,x2,extra\n1,2,a\n3,4,b\n")
    out = service.predict_file(version, str(path))["frame"]
    assert out.columns == ["x1", "x2", "extra", "prediction"] and out.count() == 2
    assert sorted(r["prediction"] for r in out.collect()) == pytest.approx([3, 7], abs=0.1)


def test_analysis(predictor):
    service, version = predictor
    data = [{"x1": 1.0, "x2": 2.0}, {"x1": 3.0, "x2": 4.0}, {"x1": 9.0, "x2": 4.0}]
    shap = service.predict(version, data, analyze=True)["analysis"]
    assert shap["method"] == "shap" and set(shap["feature_importance"]) == {"x1", "x2"}
    near = service.predict(version, data, analyze=True, analysis_method="lime")["analysis"]
    assert near["method"] == "lime" and set(near["feature_importance"]) == {"x1", "x2"}


def test_tree_contributions_are_looked_up_between_cuts(monkeypatch):
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 3))
    tree = trees_module.grow(x, x @ [1.0, 2.0, -1.0], np.ones(3000), False, 5, 2, 3, r)
    leaves = attribution.tree_leaves({0: tree})
    cuts = tree.threshold[tree.feature == 0]
    odd = [(v, w, 0.1) for v in (np.nan, np.inf, -np.inf, cuts[0], np.nextafter(cuts[0], 9)) for w in (0.0, np.nan, -np.inf)]
    rows = np.concatenate([x, odd])
    want, seen = attribution.leaf_shapley(rows, leaves), []
    plain = attribution.leaf_shapley
    monkeypatch.setattr(attribution, "leaf_shapley", lambda at, known: seen.append(len(at)) or plain(at, known))
    explain = attribution.tree_shapley(leaves, 3)
    assert (explain(rows) == want).all() and (explain(rows[::-1]) == want[::-1]).all()
    assert len(seen) == 1 and seen[0] <= attribution.GRID_CELLS      # nothing is worked out row by row
    monkeypatch.setattr(attribution, "GRID_CELLS", 3)
    assert (attribution.tree_shapley(leaves, 3)(rows) == want).all() and seen[-1] == len(rows)


def test_network_attribution_in_blocks_against_plain_formula(spark, points, monkeypatch):
    model, _ = fit_mlp(points, FEATURES, "y", epochs=1)
    base = [[float(v) for v in x] for x in points.select(*FEATURES).limit(3).collect()]
    monkeypatch.setattr(attribution, "background_sample", lambda *a: spark.createDataFrame(base, FEATURES))
    layers, widest = model.layers.views(model.weights), []

    def one(x):
        total = np.zeros(len(x))
        for ref in np.array(base):
            a, b, pre = x, ref, []
            for w, bias in layers[:-1]:
                a, b = a @ w + bias, b @ w + bias
                pre.append((a, b))
                a, b = np.maximum(a, 0), np.maximum(b, 0)
            back = layers[-1][0][:, 0]
            for (w, _), (p, q) in zip(layers[-2::-1], pre[::-1]):
                slope = [(u > 0) if abs(u - v) < 1e-9 else (max(u, 0) - max(v, 0)) / (u - v) for u, v in zip(p, q)]
                back = w @ (back * np.array(slope, float))
            total += back * (x - ref)
        return total / len(base)

    monkeypatch.setattr(attribution, "BLOCK_ROWS", 7)
    real = attribution._in_batches
    monkeypatch.setattr(attribution, "_in_batches", lambda df, f, keep, explain: widest.append(explain) or real(df, f, keep, explain))
    for r in contributions(points.limit(40), model, FEATURES).collect():
        assert [r[f"phi_{f}"] for f in FEATURES] == pytest.approx(one(np.array([r[f] for f in FEATURES])), abs=1e-12)
    x = np.array(base * 5)
    assert widest[0](x) == pytest.approx(np.array([one(v) for v in x]), abs=1e-12) and widest[0](x[:0]).shape == (0, 3)
