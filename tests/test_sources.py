import pytest

from scarpline.sources import tables


def test_delimiters():
    assert tables.sniff_delimiter(["a;b;c", "1;2,5;3"]) == ";"
    assert tables.sniff_delimiter(["a\tb", "1\t2"]) == "\t"
    assert tables.sniff_delimiter(["abc", ""]) == "," == tables.sniff_delimiter([])


def test_tables_and_kinds(spark, tmp_path):
    (tmp_path / "t.csv").write_text("when;rain;name\n2024-01-01;1.5;A\n2024-01-02;2;B\n")
    df = tables.read_table(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["when", "rain", "name"] and df.count() == 2
    assert tables.column_kinds(df) == {"when": "datetime", "rain": "numeric", "name": "string"}


def test_ragged_files_take_their_widest_full_line_as_names(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Station A\ndate,rain,temp\n1,2\n3,4,5\n")
    rows = tables.read_ragged(spark, str(tmp_path / "r.csv")).orderBy("line_no").collect()
    assert [(r["date"], r["rain"], r["temp"]) for r in rows] == [("Station A", None, None), ("date", "rain", "temp"), ("1", "2", None), ("3", "4", "5")]


def test_upsert_treats_nulls_as_equal_keys(spark):
    a = spark.createDataFrame([("x", None, 1), ("y", "s", 2)], "k string, sub string, v int")
    b = spark.createDataFrame([("x", None, 9), ("z", None, 3)], "k string, sub string, v int")
    assert sorted((r["k"], r["v"]) for r in tables.upsert(a, b, ["k", "sub"]).collect()) == [("x", 9), ("y", 2), ("z", 3)]


def test_association_and_differences(spark):
    a = spark.createDataFrame([("p", "old"), ("q", "old")], "cls string, id string")
    new = spark.createDataFrame([("p", "n1")], "cls string, id string")
    assert sorted(map(tuple, tables.associate(a, new, "cls", ["id"]).collect())) == [("p", "n1"), ("q", "old")]
    with pytest.raises(Exception, match="more than one row"):
        tables.associate(a, new.union(new), "cls", ["id"]).collect()
    x = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k int, v double")
    y = spark.createDataFrame([(1, 1.0005), (2, 2.5), (3, None)], "k int, v double")
    assert [r["k"] for r in tables.differences(x, y, ["k"], 0.001).collect()] == [2]
