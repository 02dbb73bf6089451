"""Readers and writers on files."""

import json

from helpers import panel_of
from panelcast.operators import reshape as R
from panelcast.plans.datasets import query_prices, train_test_panel
from panelcast.sources import readers, writers


def _write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_bus_prices_from_two_files(spark, tmp_path):
    a = _write(tmp_path / "a.csv", "DeliveryDate,HourEnding,BusName,LMP,DSTFlag", "01/02/2011,01:00,A,1.5,N",
               "01/02/2011,24:00,A,3.5,N", "DeliveryDate,HourEnding,BusName,LMP,DSTFlag", "01/02/2011,01:00,B,bad,N")
    b = _write(tmp_path / "b.csv", "DeliveryDate,HourEnding,BusName,LMP,DSTFlag", "2012-1-2,02:00,A,-7,N")
    got = sorted((str(r.delivery_date), r.hour_ending, r.node, r.price) for r in readers.read_prices(spark, [a, b]).collect())
    assert got == [("2011-01-02", 1, "A", 1.5), ("2011-01-02", 1, "B", None), ("2011-01-02", 24, "A", 3.5),
                   ("2012-01-02", 2, "A", -7.0)]


def test_zone_prices_take_other_fields(spark, tmp_path):
    path = _write(tmp_path / "z.csv", "Delivery Date,Hour Ending,Repeated,Settlement Point,Price",
                  "2011-01-02,05:00,N,HB_NORTH,20.25")
    row = readers.read_prices(spark, path, readers.ZONE_PRICE_FIELDS).first()
    assert (row.hour_ending, row.node, row.price) == (5, "HB_NORTH", 20.25)


def test_repeated_hour_is_averaged(spark, tmp_path):
    path = _write(tmp_path / "d.csv", "2011-11-06,02:00,A,1.0", "2011-11-06,02:00,A,3.0")
    rows = R.to_panel(readers.read_prices(spark, path)).collect()
    assert [(r.series_id, r.value) for r in rows] == [("A", 2.0)]


def test_both_load_files_roll_up_alike(spark, tmp_path):
    actual = _write(tmp_path / "a.csv", ",".join(readers.LOAD_HEADERS["actual"]),
                    "2011-01-01,01:00,10,1,2,3,4,5,6,7,38,N", "2011-01-01,02:00,10,0,2,3,4,5,6,7,37,N")
    forecast = _write(tmp_path / "f.csv", ",".join(readers.LOAD_HEADERS["forecast"]),
                      "2011-01-01,01:00,10,1,2,3,4,6,5,7,38,N")
    for path, variant, zones in ((actual, "actual", R.ACTUAL_ZONE_MAP), (forecast, "forecast", R.FORECAST_ZONE_MAP)):
        load = readers.read_load(spark, path, variant)
        kept = R.rollup_zones(R.drop_any_zero(load, readers.load_zones(variant)), zones).collect()
        assert [(r.west, r.north, r.south, r.houston) for r in kept] == [(9.0, 8.0, 11.0, 10.0)]


def test_tables_and_edges(spark, tmp_path):
    spark.createDataFrame([("a", "b")], "Source string, Sink string").write.parquet(str(tmp_path / "e"))
    assert readers.load_edges(spark, str(tmp_path / "e")).columns == ["source", "sink"]
    panel_of(spark, {"s": [1, 2]}).createOrReplaceTempView("stored_prices")
    assert readers.load_panel(spark, "stored_prices").count() == 2


def test_wide_round_trip(spark):
    df = panel_of(spark, {"A.1": [1, 2], "B#2": [3]})
    wide = R.pivot_prices(df, ["A.1", "B#2", "C"])
    assert R.wide_catalog(wide, ["ts"], R.HUB_ZONE_NODES).count() == 3 + len(R.HUB_ZONE_NODES)
    back = readers.unpivot_prices(wide, ["ts"])
    assert back.count() == 6
    kept = {(r.ts, r.node, r.price) for r in back.filter("price is not null").collect()}
    assert kept == {(r.ts, r.series_id, r.value) for r in df.collect()}


def test_name_files(spark, tmp_path):
    names = [f"N{i:03d}" for i in range(25)]
    catalog = spark.createDataFrame([(n,) for n in reversed(names)], "node string")
    writers.write_catalog(catalog, str(tmp_path / "one"), single_file=True)
    parts = sorted((tmp_path / "one").glob("part-*"))
    assert len(parts) == 1 and parts[0].read_text().split() == names
    writers.write_catalog(catalog, str(tmp_path / "many"))
    assert [x for p in sorted((tmp_path / "many").glob("part-*")) for x in p.read_text().split()] == names
    writers.write_shard_map(R.assign_shards(catalog, 10), str(tmp_path / "map"))
    merged = {}
    for p in (tmp_path / "map").glob("part-*"):
        for line in p.read_text().splitlines():
            merged.update(json.loads(line))
    assert merged == {f"table{i}": names[i * 10:(i + 1) * 10] for i in range(3)}


def test_report_file(spark, tmp_path):
    report = spark.createDataFrame([("CAL", "log", "0.1+/-0.0")], "node string, type string, mae string")
    writers.write_report(report, str(tmp_path / "r"), single_file=True)
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("part-*"))
    assert text == "node\ttype\tmae\nCAL\tlog\t0.1+/-0.0\n"


def test_splits_are_stored_by_centre(spark, tmp_path):
    rows = spark.createDataFrame([("c", 0, 1.0, "train"), ("c", 0, 2.0, "test"), ("01", 0, 3.0, "train")],
                                 "center string, member int, value double, split string")
    back = writers.materialize_splits(rows, str(tmp_path / "s"))
    assert (tmp_path / "s" / "center=c" / "split=test").is_dir()
    assert {tuple(r) for r in back.select("center", "member", "value", "split").collect()} == set(map(tuple, rows.collect()))


def test_price_query_and_dataset(spark):
    df = panel_of(spark, {"a": range(1, 101), "b": range(1, 51)})
    shards = R.assign_shards(R.node_catalog(df), 1)
    kept = query_prices(df, "a", "2024-1-1", "2024-1-4", shards).collect()
    assert len(kept) == 26 and min(r.ts for r in kept).day == 2
    rows = train_test_panel(df, normalize=True, include_calendar=True, log_differences=True)
    assert {"hour", "month", "weekday", "split"} <= set(rows.columns)
    test = rows.filter("series_id = 'a' and split = 'test'").orderBy("pos").collect()
    assert [r.pos for r in test] == list(range(1, 20)) and {r.n for r in test} == {19}
