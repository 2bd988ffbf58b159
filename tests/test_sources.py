import hashlib
import random
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from prepforge.sources.digest import file_digests, folder_digest
from prepforge.sources.files import detect_format, read_csv, read_file
from prepforge.sources.typing import retype_strings


def write(path, text):
    path.write_text(text)
    return str(path)


def test_format_from_name():
    assert detect_format("a/B.PARQUET") == "parquet"
    assert detect_format("a/b.csv") == "csv"
    assert detect_format("a/b.txt") == "csv"


def test_csv_null_tokens_keep_numbers(spark, tmp_path):
    path = write(tmp_path / "n.csv", "a,b,c,d,e\n1.5,1,x,True,1\nNA,,NaN,False,2\n,3,y,True,3.5\n")
    df = read_csv(spark, path)
    assert dict(df.dtypes) == {"a": "double", "b": "bigint", "c": "string", "d": "boolean", "e": "double"}
    assert [r["a"] for r in df.collect()] == [1.5, None, None]
    assert [r["b"] for r in df.collect()] == [1, None, 3]
    assert [r["c"] for r in df.collect()] == ["x", None, "y"]


def test_csv_keeps_text_that_only_looks_numeric(spark, tmp_path):
    path = write(tmp_path / "t.csv", "a,b,c,d\n1d,2020-01-05,12345678901234567890,inf\n2f,2021-01-05,1,-1\n")
    df = read_csv(spark, path)
    assert dict(df.dtypes) == {"a": "string", "b": "string", "c": "double", "d": "double"}
    assert df.first()["d"] == float("inf")


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    path = write(tmp_path / "q.csv", 'a,b\n"x ""y"", z",1\n"two\nlines",2\n')
    rows = read_csv(spark, path, multiline=True).collect()
    assert [r["a"] for r in rows] == ['x "y", z', "two\nlines"]


def test_retype_scientific_and_blank(spark):
    df = spark.createDataFrame([("1e-3", "", " 5"), ("2", "", "6 ")], "a string, b string, c string")
    out = retype_strings(df)
    assert dict(out.dtypes) == {"a": "double", "b": "double", "c": "bigint"}
    assert out.first()["a"] == 0.001 and out.first()["b"] is None


def test_parquet_nan_becomes_null(spark, root):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    df.write.parquet(f"{root}/x.parquet")
    back = read_file(spark, f"{root}/x.parquet")
    assert back.where("x IS NULL").count() == 2


def test_folder_digest_sees_any_change(spark, tmp_path):
    folder = tmp_path / "m"
    folder.mkdir()
    (folder / "one").write_bytes(b"abc")
    (folder / "two").write_bytes(b"def")
    before = folder_digest(spark, str(folder))
    assert before == folder_digest(spark, str(folder))
    digests = {r["name"]: r["sha256"] for r in file_digests(spark, str(folder)).collect()}
    import hashlib
    assert digests["one"] == hashlib.sha256(b"abc").hexdigest()
    (folder / "_SUCCESS").write_bytes(b"")
    assert before == folder_digest(spark, str(folder))
    (folder / "two").write_bytes(b"deftampered")
    assert before != folder_digest(spark, str(folder))


def test_malformed_and_multi_line_csv(spark, root):
    spark.createDataFrame([("a,b\n1,2\n3,4,5",)], "value string").coalesce(1).write.text(f"{root}/wide")
    with pytest.raises(Exception, match="MALFORMED"):
        read_file(spark, f"{root}/wide", "csv").select("a").collect()
    spark.createDataFrame([('a,b\n1,"x\ny"\n2,z',)], "value string").coalesce(1).write.text(f"{root}/long")
    assert [tuple(r) for r in read_file(spark, f"{root}/long", "csv", multiline=True).orderBy("a").collect()] == [
        (1, "x\ny"), (2, "z")]


def test_digest_of_files_in_ranges(spark, tmp_path):
    r = random.Random(3)
    contents = {"a.bin": r.randbytes(50_000), "b.txt": b"line\n" * 3000, "c": b"x" * 20_000, "d": r.randbytes(999), "e": b"",
                "f": b"\xef\xbb\xbf" + b"ab\r\n" * 4000 + b"end", "g h": b"\n" * 5000, "i": b"\n\n" + r.randbytes(4096) * 2}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "_SUCCESS").write_bytes(b"")
    for block in ("128m", "7000b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        try:
            for leaf in (1000, 4096, 1 << 20):
                got = {x["name"]: (x["length"], x["sha256"]) for x in file_digests(spark, str(tmp_path), leaf).collect()}
                want = {}
                for name, c in contents.items() - {("e", b"")}:          # the source skips empty files
                    parts = [hashlib.sha256(c[i:i + leaf]).hexdigest() for i in range(0, len(c), leaf)]
                    want[name] = (len(c), hashlib.sha256(c).hexdigest() if len(c) <= leaf
                                  else hashlib.sha256("".join(parts).encode()).hexdigest())
                assert {unquote(k): v for k, v in got.items()} == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
