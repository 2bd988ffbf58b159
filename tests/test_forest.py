"""Forests: the grower against a plain recursive one, units against whole trees, classes, depth, groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepforge.errors import TrainingError
from prepforge.models import forest, store
from prepforge.models.forest import fit_forest, fit_forest_classifier
from prepforge.models.trees import bootstrap_weights, grow, leaves, merged

SEED = lambda: np.random.default_rng(1)


def plain(x, y, w, classify, depth, least):
    """Nested (feature, threshold, left, right) or the leaf's answer."""
    def impurity(rows):
        if classify:
            shares = np.array([w[rows][y[rows] == c].sum() for c in np.unique(y)])
            return shares.sum() - (shares ** 2).sum() / shares.sum()
        mean = np.average(y[rows], weights=w[rows])
        return (w[rows] * (y[rows] - mean) ** 2).sum()

    def node(rows, left_depth):
        best = None
        if len(rows) >= least and len(np.unique(y[rows])) > 1 and left_depth:
            for f in range(x.shape[1]):
                values = np.unique(x[rows, f])
                for low, high in zip(values[:-1], values[1:]):
                    left, right = rows[x[rows, f] <= low], rows[x[rows, f] > low]
                    gain = impurity(rows) - impurity(left) - impurity(right)
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, f, (low + high) / 2, left, right)
        if best is None:
            if classify:
                return {c: w[rows][y[rows] == c].sum() / w[rows].sum() for c in np.unique(y[rows])}
            return np.average(y[rows], weights=w[rows])
        return best[1], best[2], node(best[3], left_depth - 1), node(best[4], left_depth - 1)

    return node(np.arange(len(x)), depth)


def nested(tree, classify, node=0):
    if tree.feature[node] < 0:
        if classify:
            a, b = tree.votes_first[node], tree.votes_first[node + 1]
            return dict(zip(tree.votes_class[a:b].tolist(), tree.votes_share[a:b].tolist()))
        return tree.value[node]
    return (tree.feature[node], tree.threshold[node], nested(tree, classify, tree.left[node]),
            nested(tree, classify, tree.right[node]))


def same(a, b):
    if isinstance(a, tuple):
        return isinstance(b, tuple) and a[0] == b[0] and a[1] == pytest.approx(b[1]) and same(a[2], b[2]) and same(a[3], b[3])
    return a == pytest.approx(b)


@pytest.mark.parametrize("classify", [False, True])
@pytest.mark.parametrize("seed, depth, least", [(0, np.inf, 2), (1, 3, 2), (2, np.inf, 9), (3, 0, 2), (4, 6, 5)])
def test_grower_against_a_plain_one(classify, seed, depth, least):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(70, 3)), 1)
    y = r.integers(0, 4, 70).astype(float) if classify else r.normal(size=70)
    w = r.integers(1, 4, 70).astype(float)
    tree = grow(x, y, w, classify, depth, least, 3, SEED())
    assert same(plain(x, y, w, classify, depth, least), nested(tree, classify))
    assert tree.weight[0] == w.sum() and (tree.gain >= 0).all()
    inner = tree.feature >= 0
    assert np.allclose(tree.weight[inner], tree.weight[tree.left[inner]] + tree.weight[tree.right[inner]])


def test_odd_inputs_of_the_grower():
    one = grow(np.array([[1.0]]), np.array([5.0]), np.array([2.0]), False, np.inf, 2, 1, SEED())
    assert one.feature.tolist() == [-1] and one.value[0] == 5.0
    flat = grow(np.ones((6, 2)), np.arange(6.0), np.ones(6), False, np.inf, 2, 2, SEED())
    assert flat.feature.tolist() == [-1] and flat.value[0] == 2.5
    near = np.array([[1.0], [np.nextafter(1.0, 2)]])
    tree = grow(near, np.array([0.0, 1.0]), np.ones(2), False, np.inf, 2, 1, SEED())
    assert tree.value[leaves(tree, near)].tolist() == [0.0, 1.0]
    xor = np.array([[0, 0], [0, 1], [1, 0], [1, 1]], dtype=float)
    tree = grow(xor, np.array([0, 1, 1, 0.0]), np.ones(4), True, np.inf, 2, 2, SEED())
    assert tree.value[leaves(tree, xor)].tolist() == [1, 0, 0, 1]


def test_fewer_features_are_drawn_among_those_that_differ():
    r = np.random.default_rng(3)
    x = np.column_stack([np.ones(200), r.normal(size=200), r.normal(size=200)])
    tree = grow(x, r.normal(size=200), np.ones(200), False, np.inf, 2, 1, SEED())
    assert set(tree.feature.tolist()) == {-1, 1, 2} and (np.sort(tree.weight)[0] == 1)


def test_bootstrap_is_poisson_and_differs_by_tree():
    ids = np.arange(200_000)
    w = bootstrap_weights(ids, 0, 42)
    assert w.mean() == pytest.approx(1, abs=0.01) and (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.005)
    assert abs(np.corrcoef(w, bootstrap_weights(ids, 1, 42))[0, 1]) < 0.01


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(3000).select(
        (F.col("id") % 50).cast("double").alias("a"), (F.col("id") * 7 % 31).cast("int").alias("b"),
        F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise(F.lit(-1.0)).alias("c"),
    ).withColumn("y", F.col("a") * F.col("a") / 100 + F.sin(F.col("b").cast("double")) + F.col("c")).withColumn(
        "k", F.concat(F.lit("class "), (F.col("a") * 40 + F.col("b")).cast("int").cast("string"))).repartition(5).cache()


NAMES = ["a", "b", "c"]


def test_trees_without_a_limit_learn_every_row(rows):
    scored = fit_forest(rows, NAMES, "y", n_estimators=1, bootstrap=False).predict(rows, "p")
    assert scored.where("abs(y - p) > 1e-9").count() == 0 and scored.columns == [*rows.columns, "p"]
    model = fit_forest_classifier(rows, NAMES, "k", n_estimators=1, bootstrap=False, max_features=3)
    assert rows.select("k").distinct().count() > 1000
    assert model.predict(rows, "p").where("k <> p").count() == 0


@pytest.mark.parametrize("classify", [False, True])
def test_upper_levels_cut_like_one_task_does(rows, monkeypatch, classify):
    df = rows.withColumn("k", F.when(F.col("y") > 8, "x").when(F.col("y") > 3, "y").otherwise("z"))
    fit = (lambda: fit_forest_classifier(df, NAMES, "k", n_estimators=2, bootstrap=False, max_features=3, max_depth=7)
           ) if classify else (lambda: fit_forest(df, NAMES, "y", n_estimators=2, bootstrap=False, max_depth=7))
    whole = fit()
    monkeypatch.setattr(forest, "UNIT_ROWS", 150)
    monkeypatch.setattr(forest, "CELLS", 4000)
    parts = fit()
    spark = rows.sparkSession
    assert parts.units(spark).where("unit >= 0").count() > 10 and whole.units(spark).count() == 2
    both = parts.predict(whole.predict(df, "p"), "q")
    assert both.where("p <> q" if classify else "abs(p - q) > 1e-9").count() == 0
    of = lambda m: {r["feature"]: r["importance"] for r in m.importances(spark).collect()}
    assert of(parts) == pytest.approx(of(whole)) and sum(of(whole).values()) == pytest.approx(1)
    assert parts.expected(spark) == pytest.approx(whole.expected(spark))
    monkeypatch.setattr(forest, "GROUP_BYTES", 2000)
    assert len(list(parts.groups(spark))) > 3
    again = parts.predict(both, "r")
    assert again.where("r <> q" if classify else "abs(r - q) > 1e-9").count() == 0


def test_large_pure_and_shallow_nodes_stay_above(rows, monkeypatch):
    df = rows.withColumn("k", F.when(F.col("c") > 0, "x").otherwise("y"))
    monkeypatch.setattr(forest, "UNIT_ROWS", 100)
    model = fit_forest_classifier(df, NAMES, "k", n_estimators=2, bootstrap=False, max_features=3)
    assert model.units(rows.sparkSession).where("unit >= 0").count() == 0
    assert model.predict(df, "p").where("k <> p").count() == 0
    flat = fit_forest(df, NAMES, "y", n_estimators=2, max_depth=0)
    low, high = flat.predict(df, "p").agg(F.min("p"), F.max("p")).first()
    assert low == high == pytest.approx(flat.expected(rows.sparkSession))


def test_layout_does_not_matter_once_rows_are_written(rows, tmp_path):
    path = str(tmp_path / "rows")
    rows.write.parquet(path)
    stored = rows.sparkSession.read.parquet(path)
    a, b = (fit_forest(stored, NAMES, "y", n_estimators=4, max_depth=6).predict(stored, "p").agg(F.sum("p")).first()[0]
            for _ in range(2))
    assert a == b


def test_saved_forest_and_gaps(spark, rows, tmp_path):
    model = fit_forest_classifier(rows.withColumn("k", F.col("c") > 0), NAMES, "k", n_estimators=3, max_depth=3)
    store.save_model(spark, model, str(tmp_path / "m"))
    again = store.load_model(spark, str(tmp_path / "m"))
    assert again.predict(model.predict(rows, "p"), "q").where("p <> q").count() == 0
    gappy = rows.withColumn("a", F.when(F.col("b") != 3, F.col("a")))
    with pytest.raises(TrainingError, match=f"{rows.where('b = 3').count()} rows lack"):
        fit_forest(gappy, NAMES, "y")
    with pytest.raises(TrainingError, match="no rows"):
        fit_forest(rows.limit(0), NAMES, "y")
    with pytest.raises(TrainingError):
        fit_forest(rows, NAMES, "y", n_estimators=0)


@pytest.mark.parametrize("classify", [False, True])
def test_equal_rows_grow_as_one(classify):
    r = np.random.default_rng(7)
    x, y = r.integers(0, 4, (400, 2)).astype(float), r.integers(0, 3, 400).astype(float)
    w = r.integers(1, 3, 400).astype(float)
    for least in (2, 9):
        u, v, place = merged(x, y)
        one = grow(u, v, np.bincount(place, w), classify, np.inf, least, 2, SEED(), np.bincount(place))
        every = grow(x, y, w, classify, np.inf, least, 2, SEED())
        assert len(u) < 60 and same(nested(one, classify), nested(every, classify))


@pytest.mark.parametrize("distinct", [False, True])
def test_rounds_bound_what_trees_send(spark, monkeypatch, distinct):
    """Whatever the number of trees, a round sends no more than the room; before, all trees sent all rows at once."""
    rounds = []
    kept = forest.freed_shuffles
    monkeypatch.setattr(forest, "freed_shuffles", lambda s: rounds.append(1) or kept(s))
    monkeypatch.setattr(forest, "ROUND_BYTES", 1)
    df = spark.range(800).select((F.col("id") if distinct else F.col("id") % 5).cast("double").alias("a"),
                                 (F.col("id") % 5).cast("double").alias("y"))
    model = fit_forest(df, ["a"], "y", n_estimators=6)
    assert model.units(spark).count() == 6 and (len(rounds) >= 4 if distinct else len(rounds) <= 2)
    monkeypatch.setattr(forest, "ROUND_BYTES", 1 << 30)
    assert [list(r) for r in fit_forest(df, ["a"], "y", n_estimators=6).nodes(spark).orderBy("tree", "unit", "node").collect()] == [
        list(r) for r in model.nodes(spark).orderBy("tree", "unit", "node").collect()]
