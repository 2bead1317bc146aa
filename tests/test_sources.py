import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberfield.sources import SOURCES, drop_embedded_headers, load_observations, read_delimited, read_stage, read_yearly, rename_positional, write_stage


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_daily_station(spark, tmp_path):
    header = ",".join(f'"{h}"' for h in SOURCES["daily_station"].headers)
    body = '"2013/07/09 00:00:00",1.5,"12.8",10.25,34.6,2100,0.3,NA,0,0,700\n"2012/03/04 00:00:00",0,",",NA,NA,NA,NA,NA,NA,NA,NA\n'
    df = load_observations(spark, write(tmp_path / "d.csv", "﻿" + header + "\n" + body), "daily_station")
    a, b = df.orderBy(F.desc("date")).collect()
    assert a["date"] == dt.date(2013, 7, 9) and a["sun_exposure"] == 12.8 and a["pseudo"] == 700.0 and a["fire_intensity"] is None
    assert b["sun_exposure"] is None and b["rainfall"] == 0.0 and b["total_phytoplankton"] is None
    assert "salinity" in df.columns


def test_bay_taxa_flag(spark, tmp_path):
    header = ",".join(f'"{h}"' for h in SOURCES["bay_taxa"].headers)
    body = '"Alpha sp.","2011/11/11 00:00:00",12.5,NA,-7.5,3.5,41,TRUE\n"Other","2016/01/21 00:00:00",1,"2016/01/21 00:00:00",5,1,1,NA\n'
    rows = load_observations(spark, write(tmp_path / "b.csv", header + "\n" + body), "bay_taxa").orderBy("taxon").collect()
    assert [r["alexandrium"] for r in rows] == [1.0, None]
    assert rows[0]["date_unique"] is None and rows[1]["date_unique"] == dt.date(2016, 1, 21)


def test_yearly_files_and_headings(spark, tmp_path):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("Source", "Location ID", "Latitude")])
    paths = [write(tmp_path / f"{y}.csv", f"Source,Location ID,Latitude\nYear,Month,GHI\n{y},1,10\n{y},2,NA\n") for y in (2016, 2017)]
    raw = read_yearly(spark, paths, schema)
    assert raw.count() == 6
    kept = drop_embedded_headers(raw, "Source", "Location ID")
    assert {(r[0], r[2]) for r in kept.collect()} == {("2016", None), ("2016", "10"), ("2017", None), ("2017", "10")}
    assert read_delimited(spark, paths[0], schema).count() == 3


def test_positional_names_need_the_right_count(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert rename_positional(df, ["x", "y"]).columns == ["x", "y"]
    with pytest.raises(ValueError):
        rename_positional(df, ["x"])


def test_stage_round_trip(spark, tmp_path):
    df = spark.range(10).withColumn("g", (F.col("id") > 4).cast("string"))
    write_stage(df, str(tmp_path / "s"), ["g"])
    assert read_stage(spark, str(tmp_path / "s")).filter("g = 'true'").count() == 5


def test_columns_are_found_by_header(spark, tmp_path):
    names = [c for c, _, _ in SOURCES["estuary_station"].columns]
    cells = {c: str(i) for i, c in enumerate(names)} | {"Date": "2015/05/05 00:00:00"}

    def path(name, order):
        return write(tmp_path / name, ",".join(order) + "\n" + ",".join(cells[c] for c in order) + "\n")

    swapped = [names[0], names[2], names[1], *reversed(names[3:])]
    for paths in (path("a.csv", names), path("b.csv", swapped), [path("c.csv", names), path("d.csv", swapped)]):
        for r in load_observations(spark, paths, "estuary_station").collect():
            assert (r["rainfall"], r["sun_exposure"], r["pseudo"]) == (1.0, 2.0, 9.0)
    for wrong in (names[:-1], [*names, "extra"], [*names[:-1], "sudo"]):
        cells["extra"] = cells["sudo"] = "1"
        with pytest.raises(ValueError, match="headers"):
            load_observations(spark, path(f"{len(wrong)}{wrong[-1]}.csv", wrong), "estuary_station")
    assert SOURCES["bay_taxa"].canonical("Total Phyto") == "total_phytoplankton"
