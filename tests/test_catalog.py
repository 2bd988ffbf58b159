import os

import pytest
from pyspark.sql import functions as F

from prepforge.errors import DataError
from prepforge.operators.concat import concat
from prepforge.operators.fingerprint import fingerprint
from prepforge.plans.catalog import DatasetCatalog, safe_view_name


@pytest.fixture
def catalog(spark, root):
    return DatasetCatalog(spark, root)


@pytest.fixture
def sample(tmp_path):
    path = tmp_path / "sample.csv"
    path.write_text("col1,col2,col3\n" + "".join(
        f"{i},{10.0 * i},{c}\n" for i, c in zip(range(1, 6), "abcde")))
    return str(path)


def test_register_csv_and_read_back(catalog, sample):
    entry = catalog.register(sample, "test_dataset")
    assert entry["row_count"] == 5 and entry["column_names"] == ["col1", "col2", "col3"]
    assert entry["file_type"] == "csv"
    assert entry["statistics"]["col1"]["mean"] == 3.0 and entry["statistics"]["col2"]["median"] == 30.0
    assert catalog.load("test_dataset", limit=2).count() == 2
    assert catalog.load("test_dataset", columns=["col1"]).columns == ["col1"]
    assert catalog.preview("test_dataset", 3).count() == 3
    assert catalog.query("SELECT * FROM test_dataset WHERE col1 > 2").count() == 3
    info = catalog.info("test_dataset")
    assert info["statistics"]["col1"]["mean"] == 3.0 and len(info["hash"]) == 64
    assert catalog.list_datasets().columns == ["name", "file_type", "row_count", "column_names", "created_at"]


def test_register_parquet_in_place(catalog, spark, root):
    path = f"{root}/in.parquet"
    spark.range(5).selectExpr("id AS col1", "id * 1.5D AS col2").write.parquet(path)
    entry = catalog.register(path, "p", materialize=False)
    assert entry["file_type"] == "parquet" and entry["row_count"] == 5 and entry["file_path"] == path
    assert entry["has_nan"] is False
    catalog.delete("p")
    assert os.path.exists(path.replace("file:", ""))


def test_nan_in_place_counts_as_missing(catalog, spark, root):
    path = f"{root}/nan.parquet"
    spark.createDataFrame([(1.0,), (float("nan"),)], "x double").write.parquet(path)
    entry = catalog.register(path, "n", materialize=False)
    assert entry["has_nan"] is True and entry["statistics"]["x"]["null_count"] == 1
    assert catalog.load("n").where("x IS NULL").count() == 1


def test_filters_reach_the_scan(catalog, spark, capsys):
    catalog.register(spark.range(5).selectExpr("id * 1.5D AS x", "id"), "d")
    catalog.query("SELECT id FROM d WHERE x > 2").explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThan(x,2.0)" in plan and "ReadSchema: struct<x:double,id:bigint>" in plan


@pytest.mark.parametrize("name,view", [
    ("2024-01-data", "_2024_01_data"), ("my-dataset-v2", "my_dataset_v2"),
    ("123_numeric_start", "_123_numeric_start"), ("data.v2 x", "data_v2_x")])
def test_awkward_names(catalog, spark, name, view):
    assert safe_view_name(name) == view
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "col1 bigint, col2 string")
    catalog.register(df, name)
    assert catalog.load(name).count() == 3
    assert catalog.load(name, ["col2"]).columns == ["col2"]
    assert catalog.query(f"SELECT * FROM {view}").count() == 3
    catalog.delete(name)
    with pytest.raises(DataError):
        catalog.load(name)


def test_replace_keeps_creation_time(catalog, spark):
    first = catalog.register(spark.range(3), "d")
    second = catalog.register(spark.range(5), "d")
    assert second["created_at"] == first["created_at"] and second["updated_at"] > first["updated_at"]
    assert catalog.load("d").count() == 5 and catalog.list_datasets().count() == 1
    assert catalog.query("SELECT count(*) AS n FROM d").first()["n"] == 5


def test_delete_removes_files(catalog, sample):
    entry = catalog.register(sample, "gone")
    local = entry["file_path"].replace("file:", "")
    assert os.path.exists(local)
    catalog.delete("gone")
    assert not os.path.exists(local) and catalog.list_datasets().count() == 0
    with pytest.raises(DataError):
        catalog.delete("gone")


def test_errors(catalog, spark):
    with pytest.raises(DataError):
        catalog.load("nothing")
    catalog.register(spark.range(3), "my data")
    with pytest.raises(DataError):
        catalog.register(spark.range(3), "my-data")
    with pytest.raises(DataError):
        catalog.load("my data", columns=["nope"])
    with pytest.raises(DataError):
        catalog.query("SELECT nope FROM my_data")
    with pytest.raises(DataError):
        catalog.load_multiple([])


def test_load_multiple(catalog, spark):
    catalog.register(spark.createDataFrame([(1, 2.0, "x")], "a int, b double, c string"), "one")
    catalog.register(spark.createDataFrame([(3.5, 4)], "b double, a bigint"), "two")
    union, marks = catalog.load_multiple(["one", "two"])
    assert union.columns == ["a", "b"] and union.count() == 2
    assert marks == {"one": catalog.fingerprint("one"), "two": catalog.fingerprint("two")}
    catalog.register(spark.createDataFrame([("z",)], "q string"), "three")
    with pytest.raises(DataError):
        catalog.load_multiple(["one", "three"])


def test_concat_type_clash(spark):
    a = spark.createDataFrame([(1,)], "x bigint")
    b = spark.createDataFrame([("y",)], "x string")
    out = concat([a, b])
    assert sorted(r["x"] for r in out.collect()) == ["1", "y"]


# fingerprints ----------------------------------------------------------------

@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0), (3, "c", None)], "k bigint, s string, x double")


def test_fingerprint_ignores_order(rows):
    mark = fingerprint(rows)
    assert len(mark) == 64
    assert mark == fingerprint(rows.orderBy(F.col("k").desc())) == fingerprint(rows.repartition(3))


def test_fingerprint_sees_changes(spark, rows):
    mark = fingerprint(rows)
    pair = rows.where("k = 1")
    assert mark != fingerprint(rows.withColumn("x", F.when(F.col("k") == 1, 1.5).otherwise(F.col("x"))))
    assert mark != fingerprint(rows.unionByName(pair).unionByName(pair))
    assert mark != fingerprint(rows.withColumnRenamed("s", "t"))
    assert mark != fingerprint(rows.withColumn("k", F.col("k").cast("int")))
    one = spark.createDataFrame([(1, None)], "a int, b int")
    two = spark.createDataFrame([(None, 1)], "a int, b int")
    assert fingerprint(one) != fingerprint(two)


def test_fingerprint_of_special_values(spark):
    nan = spark.createDataFrame([(float("nan"),)], "x double")
    null = spark.createDataFrame([(None,)], "x double")
    assert fingerprint(nan) == fingerprint(null)
    assert fingerprint(null) != fingerprint(null.limit(0))
    maps = spark.sql("SELECT map('a', 1, 'b', 2) AS m")
    assert fingerprint(maps) == fingerprint(spark.sql("SELECT map('b', 2, 'a', 1) AS m"))


def test_two_catalogs_and_failing_queries(spark, root):
    one, two = DatasetCatalog(spark, f"{root}/one"), DatasetCatalog(spark, f"{root}/two")
    one.register(spark.range(3), "lines")
    two.register(spark.range(7), "lines")
    assert one.query("SELECT * FROM lines").count() == 3 and two.query("SELECT * FROM lines").count() == 7
    with pytest.raises(DataError):
        one.rows("SELECT raise_error('no') FROM lines")
    with pytest.raises(DataError):
        one.query("SELECT nothing FROM lines")
