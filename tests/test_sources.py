import pytest
from pyspark.sql import functions as F

from orderloom.functions import storage
from orderloom.sources import files, layers
from orderloom.sources.schemas import landing_schema
from orderloom.streaming.file_load import load_new_files


def dims(spark, *rows):
    return spark.createDataFrame(list(rows), landing_schema("restaurants_dim"))


def test_csv_round_trip_keeps_quotes_commas_and_missing_values(spark, tmp_path):
    rows = [("1", 'the "best", grill', None, "x"), ("2", "plain", "NaN", ""), ("3", "a\\b", "null", "NULL")]
    files.write_csv(dims(spark, *rows).toDF("Restaurant ID", "Name", "Subzone", "City"), f"{tmp_path}/csv")
    back = files.read_landing_csv(spark, "restaurants_dim", f"{tmp_path}/csv")
    assert back.columns == landing_schema("restaurants_dim").names  # by position, not by header
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == [
        ("1", 'the "best", grill', None, "x"), ("2", "plain", None, None), ("3", "a\\b", None, None)]


def test_line_breaks_inside_quotes_stay_in_their_row(spark, tmp_path):
    rows = [("1", "cold\nlate again", "z", "c"), ("2", "a", "z", "c")]
    files.write_csv(dims(spark, *rows), f"{tmp_path}/csv")
    back = files.read_landing_csv(spark, "restaurants_dim", f"{tmp_path}/csv")
    assert sorted(map(tuple, back.collect())) == rows


@pytest.mark.parametrize("line", ["1,a,b", "1,a,b,c,d"])
def test_a_row_with_a_wrong_number_of_columns_stops_the_load(spark, tmp_path, line):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.csv").write_text(f"A,B,C,D\n1,a,b,c\n{line}\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_landing_csv(spark, "restaurants_dim", f"{tmp_path}/in").select("city").collect()
    with pytest.raises(Exception, match="(?i)malformed|failed"):
        load_new_files(spark, "restaurants_dim", f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/memory")
    loose = files.read_landing_csv(spark, "restaurants_dim", f"{tmp_path}/in", on_error="PERMISSIVE")
    assert loose.count() == 2


def test_fractions_are_no_whole_numbers(spark):
    texts = spark.createDataFrame([("1",), ("1.0",), ("1.5",), ("0.9",), ("-2.000",), ("x",), (None,)], "t string")
    got = [r[0] for r in texts.select(files.cast_text(F.col("t"), "int")).collect()]
    assert got == [1, 1, None, None, -2, None, None]


def test_append_and_layers(spark, tmp_path):
    house = layers.Warehouse(spark, str(tmp_path))
    house.append("raw", "restaurants_dim", dims(spark, ("1", "a", "z", "c")))
    house.append("raw", "restaurants_dim", dims(spark, ("1", "a", "z", "c")))
    assert house.source("raw", "restaurants_dim").count() == 2  # repeated rows stay
    house.publish("staging", "outlets", house.source("raw", "restaurants_dim").distinct())
    house.publish("marts", "outlet_count", spark.table("staging_outlets").groupBy("city").count())
    assert [tuple(r) for r in spark.table("marts_outlet_count").collect()] == [("c", 1)]
    assert house.source("marts", "outlet_count").count() == 1
    assert house.describe().count() == 4
    with pytest.raises(KeyError):
        house.path("gold", "x")


def test_batches_match_columns_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([("x", 1)], "s string, i int")
    assert [tuple(r) for r in layers.append_batches(a, b).collect()] == [(1, "x"), (1, "x")]


def test_reconciliation(spark):
    expected = spark.createDataFrame([("t", 3), ("u", 3), ("gone", 1)], "table_name string, expected_rows int")
    got = layers.reconcile_row_counts({"t": spark.range(3), "u": spark.range(2)}, expected)
    assert {r.table_name: (r.actual_rows, r.ok) for r in got.collect()} == {
        "t": (3, True), "u": (2, False), "gone": (None, False)}


def test_files_are_loaded_once(spark, tmp_path):
    source, target, memory = (f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))
    load = lambda: load_new_files(spark, "restaurants_dim", source, target, memory)
    files.write_csv(dims(spark, ("1", "a", "NaN", "c")), source, "append")
    load()
    load()
    assert [tuple(r) for r in spark.read.parquet(target).collect()] == [("1", "a", None, "c")]
    files.write_csv(dims(spark, ("2", "b", "z", "c")), source, "append")
    load()
    assert sorted(r.restaurant_id for r in spark.read.parquet(target).collect()) == ["1", "2"]


class Session:
    """Stands in for a session with the given master and settings."""

    def __init__(self, master, setting=None, checkpoint=None):
        self.master, self.setting, self.checkpoint = master, setting, checkpoint
        self.conf = self.sparkContext = self

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.setting or default

    def getCheckpointDir(self):
        return self.checkpoint

    def setCheckpointDir(self, folder):
        self.checkpoint = folder


def test_shared_folder_comes_from_the_session():
    assert storage.shared_folder(Session("yarn", "hdfs://x/scratch/")) == "hdfs://x/scratch"
    assert storage.shared_folder(Session("yarn", None, "hdfs://x/y")) == "hdfs://x/y"
    with pytest.raises(ValueError):
        storage.shared_folder(Session("yarn"))  # no folder of one machine on a cluster
    local = Session("local[2]")
    assert "orderloom-" in storage.shared_folder(local)
    assert local.checkpoint is None  # the session's settings stay as they are


def test_frozen_tables_go_where_the_caller_says(spark, tmp_path):
    frozen = storage.freeze(spark.range(3), "t", path=f"{tmp_path}/mine")
    assert frozen.count() == 3 and f"{tmp_path}/mine" in frozen.inputFiles()[0]


def test_frozen_rows_are_read_back_from_the_shared_folder(spark):
    frozen = storage.freeze(spark.range(10).withColumn("x", F.col("id") * 2), "t")
    assert frozen.count() == 10
    assert all(storage.shared_folder(spark) in f for f in frozen.inputFiles())
