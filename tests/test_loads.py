"""Loads that happen once, keep malformed rows, and count while they write."""

import json

import pytest
from pyspark.sql import functions as F

from orderloom.sources import commits, quarantine
from tests.test_plans import executed_plan
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n bigint")


def test_a_batch_is_loaded_once(spark, tmp_path):
    table = commits.CommittedTable(spark, f"{tmp_path}/t")
    assert table.read(schema=numbers(spark).schema).count() == 0
    with pytest.raises(Exception, match="committed"):
        table.read()
    assert table.append("one", numbers(spark, 1, 2))
    assert not table.append("one", numbers(spark, 1, 2))
    assert table.append("two", numbers(spark))
    assert sorted(r.n for r in table.read().collect()) == [1, 2]
    assert {(r.batch, r.rows) for r in table.commits().collect()} == {("one", 2), ("two", 0)}
    with pytest.raises(ValueError):
        table.append("../x", numbers(spark))


def test_a_load_that_stops_half_way_is_not_seen_and_can_be_repeated(spark, tmp_path):
    table = commits.CommittedTable(spark, f"{tmp_path}/t")
    table.append("one", numbers(spark, 1))
    broken = numbers(spark, 2, 3, 4).repartition(3).withColumn("n", F.expr("IF(n = 4, raise_error('lost'), n)"))
    with pytest.raises(Exception, match="lost"):
        table.append("two", broken.withColumn("n", F.col("n").cast("bigint")))
    numbers(spark, 7).write.parquet(f"{tmp_path}/t/data/two-half")  # written, never committed
    assert [r.n for r in table.read().collect()] == [1]
    assert table.append("two", numbers(spark, 2, 3, 4))
    assert sorted(r.n for r in table.read().collect()) == [1, 2, 3, 4]


def test_of_two_loads_at_once_one_wins(spark, tmp_path):
    """Both have written when the first commits."""
    table = commits.CommittedTable(spark, f"{tmp_path}/t")
    record = json.dumps({"batch": "one", "folder": "data/a", "rows": 1, "metrics": {}})
    assert table._commit("one", record, False)
    assert not table._commit("one", record.replace("data/a", "data/b"), False)
    assert [r.folder for r in table.commits().collect()] == ["data/a"]


def test_a_batch_can_be_replaced(spark, tmp_path):
    table = commits.CommittedTable(spark, f"{tmp_path}/t")
    table.append("one", numbers(spark, 1, 2), metrics={"total": F.sum("n")})
    table.append("two", numbers(spark, 10), metrics={"total": F.sum("n")})
    assert table.append("one", numbers(spark, 5), metrics={"total": F.sum("n")}, replace=True)
    assert sorted(r.n for r in table.read().collect()) == [5, 10]
    assert dict(map(tuple, table.totals().collect())) == {"rows": 2, "total": 15}


def test_malformed_rows_are_kept_with_file_and_reason(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = ['1,a,b,c', '2,"x, ""y""",b,null', '3,"two\nlines",b,c']
    bad = ['4,a,b', '5,a,b,c,"d, e"', "6"]
    (tmp_path / "in" / "x.csv").write_text("A,B,C,D\n" + "\n".join([*good[:2], bad[0], good[2], bad[1]]) + "\n")
    (tmp_path / "in" / "y.csv").write_text("A,B,C,D\n" + bad[2] + "\n")
    table = commits.CommittedTable(spark, f"{tmp_path}/t")
    assert quarantine.load_checked(table, "one", "restaurants_dim", f"{tmp_path}/in")
    assert not quarantine.load_checked(table, "one", "restaurants_dim", f"{tmp_path}/in")
    rows = sorted(map(tuple, quarantine.good_rows(table, "restaurants_dim").collect()))
    assert rows == [("1", "a", "b", "c"), ("2", 'x, "y"', "b", None), ("3", "two\nlines", "b", "c")]
    refused = {(r.record, r.file, r.reason) for r in quarantine.refused_rows(table).collect()}
    assert refused == {
        (bad[0], "x.csv", "too few fields"), (bad[1], "x.csv", "too many fields"), (bad[2], "y.csv", "too few fields")}
    assert dict(map(tuple, table.totals().collect())) == {
        "rows": 6, "good_rows": 3, "too_few_fields": 2, "too_many_fields": 1}


def test_a_load_without_errors_has_no_error_folder(spark, tmp_path):
    (tmp_path / "x.csv").write_text("A,B,C,D\n1,a,b,c\n")
    table = commits.CommittedTable(spark, f"{tmp_path}/t")
    quarantine.load_checked(table, "one", "restaurants_dim", f"{tmp_path}/x.csv")
    assert quarantine.refused_rows(table).count() == 0
    assert quarantine.good_rows(table, "restaurants_dim").count() == 1
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.csv").write_text("A,B,C,D\n")
    quarantine.load_checked(table, "two", "restaurants_dim", f"{tmp_path}/none")
    assert quarantine.good_rows(table, "restaurants_dim").count() == 1


def test_the_stream_remembers_files(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def load():
        quarantine.stream_checked_files(
            spark, "restaurants_dim", f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/memory")
        return quarantine.streamed_rows(spark, "restaurants_dim", f"{tmp_path}/out")

    (tmp_path / "in" / "x.csv").write_text("A,B,C,D\n1,a,b,c\n2,a\n")
    assert load().count() == 2
    (tmp_path / "in" / "y.csv").write_text("A,B,C,D\n3,a,b,c\n")
    load()
    got = load()
    assert {(r.restaurant_id, r.rejected, r.reason) for r in got.collect()} == {
        ("1", False, None), ("2", True, "too few fields"), ("3", False, None)}


@pytest.mark.parametrize("name", ["a5_counts_from_load", "b12_defects_from_load"])
def test_reports_on_a_load_read_no_table(spark, name):
    plan = executed_plan(QUERIES[name](spark, SF))
    assert "json" in plan and "/data/" not in plan
