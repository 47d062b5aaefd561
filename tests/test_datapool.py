import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from helpers import plan_of, rows_of
from tidegauge.functions.times import DayRange, partial_date_bounds
from tidegauge.sources.archive import land_archives, list_archives
from tidegauge.sources.datapool import (
    cached_series, convert_units, datapool_scan, in_ranges, parse_spec, read_datapool, read_stored, ranges_from_text, select_series, spec_key,
    store_partitions,
)
from tidegauge.sources.manifest import common_type, read_manifest

SPEC = (
    "conn|in_count_uid~conn_in|out_count_uid~conn_out;dns|in_distinct_query~dns_in_distinct;"
    "ssh|in~ssh_in#window_start,window_end"
)
COLUMNS = {
    "conn": ["in_count_uid", "out_count_uid"], "dns": ["in_distinct_query"], "ssh": ["in"], "sip": ["internal_count_uid"],
}
ALL = sorted({c for names in COLUMNS.values() for c in names})


def member_text(columns, day, slots, length=60, step=10):
    lines = ["\t".join(["window_start", "window_end", *columns, "ignored"])]
    for slot in slots:
        start = day + dt.timedelta(minutes=step * slot)
        cells = [str(slot + k) for k in range(len(columns))]
        lines.append("\t".join([str(start), str(start + dt.timedelta(minutes=length)), *cells, "z"]))
    return "\n".join(lines) + "\n"


def write_zip(path, members):
    with zipfile.ZipFile(path, "w") as archive:
        for name, text in members.items():
            archive.writestr(name, text)


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """Three days of four protocols in two archives, one of them a folder down."""
    root = tmp_path_factory.mktemp("archives")
    (root / "more").mkdir()
    (root / "more" / "deep").mkdir()
    days = [dt.datetime(2019, 6, d) for d in (1, 2, 3)]
    first = {
        f"{p}/{d:%Y/%m/%d}/w01h-s10m.tsv": member_text(COLUMNS[p], d, range(144)) for p in ("conn", "dns") for d in days
    }
    first["conn/2019/06/01/w10m-s10m.tsv"] = member_text(COLUMNS["conn"], days[0], range(144), length=10)
    first["readme.txt"] = "not a member"
    write_zip(root / "2019-06.zip", first)
    second = {f"ssh/{d:%Y/%m/%d}/w01h-s10m.tsv": member_text(COLUMNS["ssh"], d, range(144)) for d in days}
    second["sip/2019/06/01/w01h-s10m.tsv"] = member_text(COLUMNS["sip"], days[0], range(0, 144, 2))
    write_zip(root / "more" / "other.ZIP", second)
    write_zip(root / "more" / "deep" / "too-deep.zip", {"late/2019/06/01/w01h-s10m.tsv": member_text(["in"], days[0], [0])})
    pool = str(tmp_path_factory.mktemp("pool") / "table")
    land_archives(spark, str(root), pool, ALL)
    return root, pool


def test_archives_one_folder_down(spark, landed):
    root, _ = landed
    names = sorted(r["archive"].rsplit("/", 1)[1] for r in list_archives(spark, str(root)).collect())
    assert names == ["2019-06.zip", "other.ZIP"]
    assert list_archives(spark, str(root), depth=None).count() == 3


def test_landing(spark, landed):
    _, path = landed
    pool = spark.read.parquet(path)
    counts = {(r["protocol"], r["ws"]): r["count"] for r in pool.groupBy("protocol", "ws").count().collect()}
    assert counts == {
        ("conn", "w01h-s10m"): 432, ("conn", "w10m-s10m"): 144, ("dns", "w01h-s10m"): 432,
        ("ssh", "w01h-s10m"): 432, ("sip", "w01h-s10m"): 72,
    }
    assert pool.where("protocol = 'dns' AND `in` IS NOT NULL").count() == 0


def test_landing_adds_only_new_members(spark, landed, tmp_path):
    root, path = landed
    before = spark.read.parquet(path).count()
    stamps = {f: f.stat().st_mtime_ns for f in __import__("pathlib").Path(path).rglob("*.parquet")}
    land_archives(spark, str(root), path, ALL)
    assert spark.read.parquet(path).count() == before
    assert {f: f.stat().st_mtime_ns for f in stamps} == stamps
    day = dt.datetime(2019, 6, 4)
    write_zip(tmp_path / "new.zip", {"ssh/2019/06/04/w01h-s10m.tsv": member_text(["in"], day, range(5))})
    land_archives(spark, str(tmp_path), path, ALL)
    assert spark.read.parquet(path).count() == before + 5


def test_one_day_of_three_protocols(spark, landed):
    pool = spark.read.parquet(landed[1])
    got = select_series(pool, SPEC, "w01h-s10m", "<2019-06-01,2019-06-03)", ["<2019-06-02,2019-06-03)"])
    assert got.columns == ["window_start", "window_end", "conn_in", "conn_out", "dns_in_distinct", "ssh_in"]
    assert got.count() == 144
    assert got.where("conn_in <> ssh_in OR conn_out <> conn_in + 1").count() == 0


def test_absent_protocol_gives_an_empty_result(spark, landed):
    pool = spark.read.parquet(landed[1])
    got = select_series(pool, "conn|in_count_uid;ftp|x#window_start,window_end", "w01h-s10m", "<2019-06-01,2019-06-03)")
    assert got.columns == ["window_start", "window_end", "in_count_uid", "x"] and got.count() == 0


def test_scan_prunes_folders_and_columns(spark, landed):
    pool = spark.read.parquet(landed[1])
    plan = plan_of(datapool_scan(pool, ["dns"], "w01h-s10m", ["in_distinct_query"], "<2019-06-01,2019-06-03)"))
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    filters = scan[scan.index("PartitionFilters"):scan.index("PushedFilters")]
    assert all(name in filters for name in ("protocol", "ws", "day"))
    schema = scan[scan.index("ReadSchema"):]
    assert "in_distinct_query" in schema and "in_count_uid" not in schema


def test_spec_grammar():
    entries, keys = parse_spec(" conn | a~b | c ;dns|d # window_start , window_end")
    assert entries == [{"protocol": "conn", "columns": {"a": "b", "c": "c"}}, {"protocol": "dns", "columns": {"d": "d"}}]
    assert keys == ["window_start", "window_end"]
    assert parse_spec("conn|a")[1] == []


def test_spec_with_repeated_names(spark, landed):
    pool = spark.read.parquet(landed[1])
    with pytest.raises(ValueError):
        select_series(pool, "conn|in_count_uid~x;dns|in_distinct_query~x#window_start", "w01h-s10m")
    with pytest.raises(ValueError):
        select_series(pool, "conn|in_count_uid;dns|in_distinct_query", "w01h-s10m")


def test_single_protocol_without_merge_keys(spark, landed):
    pool = spark.read.parquet(landed[1])
    got = select_series(pool, "sip|internal_count_uid~sip_in", "w01h-s10m")
    assert got.columns == ["window_start", "sip_in"] and got.where("sip_in IS NOT NULL").count() == 72


@pytest.mark.parametrize(
    "text, expected",
    [("<2019-06-01,2019-06-03)", [1, 2]), ("(2019-06-01,2019-06-03>", [2, 3]), ("<2019-06-01,2019-06-03>", [1, 2, 3]),
     ("(2019-06-01,2019-06-03)", [2])],
)
def test_range_ends(spark, text, expected):
    days = spark.createDataFrame([(dt.date(2019, 6, d),) for d in range(1, 5)], "day date")
    assert [r[0][0].day for r in zip(rows_of(days.where(DayRange.of(text).covers(F.col("day")))))] == expected
    assert str(DayRange.of(text)) == text


def test_partial_dates(spark):
    texts = ["2019", "2019-02", "2019-01-05", "2018-11--2019-02", "201902", "2019--2020-01-31", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    begin, end = partial_date_bounds(F.col("text"))
    _, open_end = partial_date_bounds(F.col("text"), inclusive_end=False)
    got = {r["text"]: tuple(str(v) for v in (r["b"], r["e"], r["o"])) for r in df.select("text", begin.alias("b"), end.alias("e"), open_end.alias("o")).collect()}
    assert got == {
        "2019": ("2019-01-01", "2019-12-31", "2020-01-01"),
        "2019-02": ("2019-02-01", "2019-02-28", "2019-03-01"),
        "2019-01-05": ("2019-01-05", "2019-01-05", "2019-01-06"),
        "2018-11--2019-02": ("2018-11-01", "2019-02-28", "2019-02-01"),
        "201902": ("2019-02-01", "2019-02-28", "2019-03-01"),
        "2019--2020-01-31": ("2019-01-01", "2020-01-31", "2020-01-31"),
        "x": ("None", "None", "None"),
    }


def test_ranges_as_a_table(spark):
    days = spark.createDataFrame([(dt.date(2019, 1, d),) for d in range(1, 32)] + [(dt.date(2020, 5, 5),)], "day date")
    ranges = ranges_from_text(spark, "2019-01-02--2019-01-04, 2019-01-03, 2020, nonsense")
    assert [str(r[0]) for r in rows_of(in_ranges(days, ranges))] == ["2019-01-02", "2019-01-03", "2019-01-04", "2020-05-05"]
    assert in_ranges(days, ranges, keep=False).count() == 28
    half_open = ranges_from_text(spark, ["2019-01-02--2019-01-04", "2019-01-10--2019-01-10"], inclusive_end=False)
    assert in_ranges(days, half_open).count() == 2


def test_unit_conversion(spark):
    df = spark.createDataFrame([(2047, -1048577, None, 5)], "a_kb long, b_MB long, c_gb long, plain long")
    assert rows_of(convert_units(df)) == [(1, -1, None, 5)]


def test_cache_is_reused_and_keyed(spark, landed, tmp_path):
    path = landed[1]
    root = str(tmp_path / "cache")
    arguments = (SPEC, "w01h-s10m", root, "<2019-06-01,2019-06-02)")
    first = cached_series(spark, path, *arguments)
    stored = sorted(p.name for p in (tmp_path / "cache").iterdir())
    assert rows_of(cached_series(spark, path, *arguments)) == rows_of(first)
    assert sorted(p.name for p in (tmp_path / "cache").iterdir()) == stored and len(stored) == 1
    day = dt.datetime(2019, 6, 9)
    write_zip(tmp_path / "later.zip", {"ssh/2019/06/09/w01h-s10m.tsv": member_text(["in"], day, range(5))})
    land_archives(spark, str(tmp_path), path, ALL)
    cached_series(spark, path, *arguments)
    assert len(list((tmp_path / "cache").iterdir())) == 2
    keys = {
        spec_key("p", SPEC, "w", "<2019-06-01,2019-06-02)", []),
        spec_key("q", SPEC, "w", "<2019-06-01,2019-06-02)", []),
        spec_key("p", SPEC, "v", "<2019-06-01,2019-06-02)", []),
        spec_key("p", SPEC, "w", "<2019-06-01,2019-06-02>", []),
        spec_key("p", "a|x|y", "w", None, []),
        spec_key("p", "a|y|x", "w", None, []),
    }
    assert len(keys) == 6


def test_writes_replace_only_their_partitions(spark, tmp_path):
    path = str(tmp_path / "pool")

    def rows(day, value):
        return spark.createDataFrame(
            [("p", "w", dt.date(2024, 1, day), dt.datetime(2024, 1, day, h), value) for h in range(3)],
            "protocol string, ws string, day date, window_start timestamp_ntz, n long",
        )

    store_partitions(rows(1, 1).union(rows(2, 1)), path)
    store_partitions(rows(2, 9), path)
    got = spark.read.parquet(path).groupBy("day", "n").count()
    assert rows_of(got) == [(dt.date(2024, 1, 1), 1, 3), (dt.date(2024, 1, 2), 9, 3)]


def test_protocols_written_apart_keep_their_own_features(spark, tmp_path):
    path = str(tmp_path / "pool")
    day = dt.datetime(2024, 1, 1)

    def written(protocol, feature, value):
        rows = [(protocol, "w01h-s10m", day.date(), day + dt.timedelta(minutes=10 * k), day + dt.timedelta(minutes=10 * k + 60), value) for k in range(139)]
        store_partitions(spark.createDataFrame(rows, f"protocol string, ws string, day date, window_start timestamp_ntz, window_end timestamp_ntz, {feature} long"), path)

    written("conn", "a", 1)
    written("dns", "b", 2)
    spec = "conn|a;dns|b#window_start,window_end"
    got = select_series(read_datapool(spark, path), spec, "w01h-s10m")
    assert rows_of(got.select("a", "b").distinct()) == [(1, 2)] and got.count() == 139
    with pytest.raises(ValueError, match="no columns"):
        select_series(read_datapool(spark, path), "conn|misspelt", "w01h-s10m")
    assert cached_series(spark, path, spec, "w01h-s10m", str(tmp_path / "cache")).where("b = 2").count() == 139
    written("ssh", "c", 3)
    assert cached_series(spark, path, "ssh|c", "w01h-s10m", str(tmp_path / "cache")).where("c = 3").count() == 139


def test_archives_may_share_a_day_and_bring_columns_later(spark, tmp_path):
    day, pool = dt.datetime(2019, 6, 1), str(tmp_path / "pool")
    name = "ssh/2019/06/01/w01h-s10m.tsv"
    for folder in ("one", "two", "three"):
        (tmp_path / folder).mkdir()
    write_zip(tmp_path / "one" / "a.zip", {name: member_text(["in"], day, range(72))})
    write_zip(tmp_path / "one" / "b.zip", {name: member_text(["in"], day, range(144))})
    land_archives(spark, str(tmp_path / "one"), pool)
    assert read_datapool(spark, pool).count() == 72 + 144  # every row of both
    write_zip(tmp_path / "two" / "c.zip", {"dns/2019/06/01/w01h-s10m.tsv": member_text(["in_distinct_query"], day, range(144))})
    for _ in range(2):
        land_archives(spark, str(tmp_path / "two"), pool)
    landed = read_datapool(spark, pool)
    assert landed.count() == 72 + 288 and landed.where("in_distinct_query IS NOT NULL").count() == 144


def test_landing_keeps_equal_lines_and_replaces_a_changed_member(spark, tmp_path):
    day, pool, root = dt.datetime(2019, 6, 1), str(tmp_path / "pool"), tmp_path / "in"
    root.mkdir()
    name = "ssh/2019/06/01/w01h-s10m.tsv"

    def counts():
        found = read_datapool(spark, pool).groupBy("window_start").count().collect()
        return sorted((r["window_start"].hour * 60 + r["window_start"].minute, r["count"]) for r in found)

    write_zip(root / "a.zip", {name: member_text(["in"], day, [0, 0, 0, 1])})
    for _ in range(2):
        land_archives(spark, str(root), pool)
        assert counts() == [(0, 3), (10, 1)]
    write_zip(root / "b.zip", {name: member_text(["in"], day, [0, 2])})
    land_archives(spark, str(root), pool)
    assert counts() == [(0, 4), (10, 1), (20, 1)]
    write_zip(root / "a.zip", {name: member_text(["in"], day, [3, 3])})
    land_archives(spark, str(root), pool)
    assert counts() == [(0, 1), (20, 1), (30, 2)]
    write_zip(root / "a.zip", {name: member_text(["in"], day, [0, 0, 0, 1])})  # as it was at first
    for _ in range(2):
        land_archives(spark, str(root), pool)
    assert counts() == [(0, 4), (10, 1), (20, 1)]
    lines = read_stored(spark, pool, read_manifest(spark, pool)).where("_member LIKE 'a.zip!%'")
    assert sorted(r["_line"] for r in lines.collect()) == [0, 1, 2, 3]


def test_an_interrupted_landing_is_made_good(spark, tmp_path, monkeypatch):
    day, pool, root = dt.datetime(2019, 6, 1), str(tmp_path / "pool"), tmp_path / "in"
    root.mkdir()
    write_zip(root / "a.zip", {"ssh/2019/06/01/w01h-s10m.tsv": member_text(["in"], day, [0, 0, 5])})
    write_zip(root / "b.zip", {"ssh/2019/06/01/w01h-s10m.tsv": member_text(["in"], day, [5])})
    land_archives(spark, str(root), pool)
    before = rows_of(read_datapool(spark, pool))
    __import__("shutil").rmtree(f"{pool}/_landed_members")  # as if it had ended before the last step
    land_archives(spark, str(root), pool)
    assert rows_of(read_datapool(spark, pool)) == before and len(before) == 4


def test_text_lands_beside_numbers(spark, tmp_path):
    day, pool, root = dt.datetime(2019, 6, 1), str(tmp_path / "pool"), tmp_path / "in"
    root.mkdir()
    numbers = [("conn", "w01h-s10m", day.date(), day, day + dt.timedelta(hours=1), 7)]
    schema = "protocol string, ws string, day date, window_start timestamp_ntz, window_end timestamp_ntz, `in` {}"
    store_partitions(spark.createDataFrame(numbers, schema.format("long")), pool)
    assert dict(read_datapool(spark, pool).dtypes)["in"] == "bigint"
    text = member_text(["in"], day, range(3)).replace("\t1\t", "\tNone\t")
    write_zip(root / "a.zip", {"ssh/2019/06/01/w01h-s10m.tsv": text, "conn/2019/06/01/w01h-s10m.tsv": member_text(["in"], day, [6])})
    for _ in range(2):
        land_archives(spark, str(root), pool)
    found = read_datapool(spark, pool)
    assert dict(found.dtypes)["in"] == "double"
    assert rows_of(found, "protocol", "in") == [("conn", 6.0), ("conn", 7.0), ("ssh", 0.0), ("ssh", 2.0), ("ssh", None)]
    # What was written is still there as it came.
    stored = read_stored(spark, pool, read_manifest(spark, pool))
    assert {r["in__string"] for r in stored.where("protocol = 'ssh'").collect()} == {"0", "None", "2"}
    store_partitions(spark.createDataFrame([("dns", "w01h-s10m", day.date(), day, day, 0.5)], schema.format("double")), pool)
    assert rows_of(read_datapool(spark, pool).where("protocol = 'dns'"), "in") == [(0.5,)]


def test_a_column_that_only_another_protocol_has_is_an_error(spark, landed):
    pool = read_datapool(spark, landed[1])
    with pytest.raises(ValueError, match="dns .w01h-s10m. has no columns .*in_count_uid"):
        datapool_scan(pool, ["dns", "conn"], "w01h-s10m", ["in_count_uid"])
    with pytest.raises(ValueError, match="no columns"):
        datapool_scan(pool, None, "w01h-s10m", ["in", "unheard"])
    assert datapool_scan(pool, ["ftp"], "w01h-s10m", ["in", "unheard"]).count() == 0
    assert datapool_scan(pool, None, "w01h-s10m", ["in"]).where("`in` IS NOT NULL").count() == pool.where("protocol = 'ssh'").count()


def test_reading_opens_no_file_and_old_pools_are_adopted(spark, tmp_path):
    pool = str(tmp_path / "pool")
    day = dt.datetime(2024, 1, 1)
    fields = "protocol string, ws string, day date, window_start timestamp_ntz, n {}"
    rows = spark.createDataFrame([("p", "w", day.date(), day, 1)], fields.format("int"))
    rows.write.partitionBy("protocol", "ws", "day").parquet(pool)  # no manifest
    assert rows_of(read_datapool(spark, pool), "n") == [(1,)]
    store_partitions(spark.createDataFrame([("q", "w", day.date(), day, 2**40)], fields.format("long")), pool)
    found = read_datapool(spark, pool)
    assert dict(found.dtypes)["n"] == "bigint" and rows_of(found, "protocol", "n") == [("p", 1), ("q", 2**40)]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("read", "reading a pool")
    read_datapool(spark, pool)
    jobs = tracker.getJobIdsForGroup("read")
    tasks = sum(tracker.getStageInfo(s).numTasks for j in jobs for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert tasks <= 8  # those that read the manifest; none for the pool's files
    assert common_type({"int", "bigint"}) == "bigint" and common_type({"bigint", "string"}) == "double"
    assert common_type({"date", "timestamp_ntz"}) == "timestamp_ntz" and common_type({"boolean", "bigint"}) == "string"


def test_units_of_landed_text(spark):
    rows = spark.createDataFrame([("1024.0",), ("",), (" 5000 ",), ("None",), (None,)], "x_kb string")
    assert [r["x_kb"] for r in convert_units(rows).collect()] == [1, None, 4, None, None]


def test_list_specs_take_their_own_keys():
    entries = [{"protocol": "conn", "columns": {"a": "a"}}]
    assert parse_spec(entries) == (entries, ["window_start", "window_end"])
    assert parse_spec([*entries, {"keys": ["k"]}]) == (entries, ["k"])
