import pytest

from helpers import rows_of
from tidegauge.sources.delimited import load_numeric_tsv, read_delimited, write_tsv


def test_numeric_tsv(spark, tmp_path):
    cells = ["1", "", " ", "None", "NaN", "inf", "-inf", "abc", "2.5"]
    lines = ["a\tin_sum_orig_bytes"] + [f"{c}\t{k * 1048576 + 5}" for k, c in enumerate(cells)]
    (tmp_path / "f.tsv").write_text("\n".join(lines) + "\n")
    got = load_numeric_tsv(spark, str(tmp_path / "f.tsv"))
    assert dict(got.dtypes) == {"a": "double", "in_sum_orig_bytes": "bigint"}
    found = [r["a"] for r in got.orderBy("in_sum_orig_bytes").collect()]
    assert found == [1.0] + [0.0] * 7 + [2.5]
    assert [r[1] for r in got.orderBy("in_sum_orig_bytes").collect()] == list(range(9))


def test_columns_by_name_and_position(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a,b,c\n1,2,3\n")
    read = read_delimited(spark, str(tmp_path / "f.csv"), sep=",", columns="2, a")
    assert read.columns == ["a", "c"] and rows_of(read) == [("1", "3")]
    bare = read_delimited(spark, str(tmp_path / "f.csv"), sep=",", header=False, columns=[1])
    assert rows_of(bare) == [("2",), ("b",)]
    with pytest.raises(ValueError):
        read_delimited(spark, str(tmp_path / "f.csv"), sep=",", columns="z")


def test_gap_fill_on_read(spark, tmp_path):
    lines = ["window_start\twindow_end\tn"]
    lines += [f"2019-06-01 00:{m}:00\t2019-06-01 00:{m + 10}:00\t{m}" for m in (10, 20, 40)]
    (tmp_path / "f.tsv").write_text("\n".join(lines) + "\n")
    got = read_delimited(spark, str(tmp_path / "f.tsv"), gap_slide_seconds=600)
    assert got.count() == 144 and got.where("n IS NOT NULL").count() == 3
    with pytest.raises(ValueError):
        read_delimited(spark, str(tmp_path / "f.tsv"), columns="n", gap_slide_seconds=600)


def test_round_trip_keeps_awkward_text(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"'), (2, '{"k": 1}'), (3, "a, b")], "k long, text string")
    write_tsv(df, str(tmp_path / "out"))
    back = read_delimited(spark, str(tmp_path / "out"))
    assert rows_of(back) == [("1", 'say "hi"'), ("2", '{"k": 1}'), ("3", "a, b")]


@pytest.mark.parametrize("split", [None, "40"])
def test_lines_around_the_table_are_left_out(spark, tmp_path, split):
    for k in range(3):
        rows = [f"{k}\t{i}" for i in range(20)]
        (tmp_path / f"f{k}.tsv").write_text("\n".join(["# export", "# of a day", "a\tb", *rows, "# 20 rows", "# end"]) + "\n")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        wanted = sorted(((str(k), str(i)) for k in range(3) for i in range(20)), key=repr)
        for arguments in ({"skip_rows": 2}, {"header": 2}, {"skip_rows": 1, "header": 1}):
            got = read_delimited(spark, str(tmp_path), skip_footer=2, **arguments)
            assert got.columns == ["a", "b"] and rows_of(got) == wanted
        bare = read_delimited(spark, str(tmp_path), header=False, skip_rows=3, skip_footer=21, columns=[1])
        assert rows_of(bare) == [("0",)] * 3
        assert rows_of(read_delimited(spark, str(tmp_path), skip_rows=2, skip_footer=30)) == []
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_line_numbers_hold_when_scans_are_split_anew(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.tsv").write_text("\n".join(["# export", "a\tb", *[f"{k}\t{i}" for i in range(200)], "# end"]) + "\n")
    wanted = sorted(((str(k), str(i)) for k in range(3) for i in range(200)), key=repr)
    got = read_delimited(spark, str(tmp_path), skip_rows=1, skip_footer=1)
    try:
        for size in ("100", "333", "5000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            assert rows_of(got.select("a", "b")) == wanted
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
