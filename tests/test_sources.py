import datetime as dt

import pytest
from conftest import rows

from tidemark.session import scratch_path, stored
from tidemark.sources import files


def test_csv_inference_and_delimiter(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a;b;c d\n1;x;2.5\n;'y';\n")
    df = files.read_csv(spark, str(path), sep=";")
    assert df.dtypes == [("a", "int"), ("b", "string"), ("c d", "double")]
    assert rows(df) == [(1, "x", 2.5), (None, "'y'", None)]
    typed = files.read_csv(spark, str(path), sep=";", schema="a string, b string, c string")
    assert rows(typed) == [("1", "x", "2.5"), (None, "'y'", None)]


def test_csv_keeps_awkward_texts(spark, tmp_path):
    data = [(1, 'say "hi"', dt.datetime(2024, 1, 2, 3, 4, 5)), (2, "a,b;c", None), (3, "two\nlines", None), (4, None, None)]
    df = spark.createDataFrame(data, "k int, t string, at timestamp_ntz")
    files.write_csv(df, str(tmp_path / "out"))
    back = files.read_csv(spark, str(tmp_path / "out"), schema=df.schema, multiline=True)
    assert rows(back) == rows(df)


def test_result_tables(spark, tmp_path):
    folder = str(tmp_path / "results")
    first = spark.createDataFrame([(1, True)], "run_id int, x boolean")
    second = spark.createDataFrame([(1, False)], "run_id int, y boolean")
    for _ in range(2):  # the second writing replaces the first
        files.write_results({"one": first, "two": second}, folder)
    out = files.read_tagged(spark, {"d1": f"{folder}/one", "d2": f"{folder}/two"})
    assert rows(out.select("run_id", "x", "dataset", "y")) == [(1, None, "d2", False), (1, True, "d1", None)]
    with pytest.raises(ValueError):
        files.read_tagged(spark, {})
    files.write_csv(out, f"{folder}/three")
    with pytest.raises(ValueError, match="already exists"):
        files.read_tagged(spark, {"d": f"{folder}/three"})


def test_parquet(spark, tmp_path):
    df = spark.range(5)
    files.write_parquet(df, str(tmp_path / "p"))
    assert rows(files.read_parquet(spark, str(tmp_path / "p"))) == rows(df)


def test_scratch_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch_path(spark, "x")
    assert path.startswith(named) if named else path
    assert scratch_path(spark, "x") != path
    assert rows(stored(spark.range(3), "numbers")) == [(0,), (1,), (2,)]


def test_no_local_scratch_on_a_cluster():
    class Conf:
        def get(self, name, default):
            return default

    class Cluster:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "yarn"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(Cluster(), "x")
